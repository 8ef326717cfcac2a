"""Jobs that chain operators: layer publishing, versions and the SQL console."""
