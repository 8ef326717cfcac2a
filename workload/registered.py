"""Import every query module so that its queries are registered."""

from workload import cleaning, documents, gold, layers, profiles, relations, texts  # noqa: F401
