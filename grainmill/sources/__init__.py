"""Readers, layer tables and exports."""
