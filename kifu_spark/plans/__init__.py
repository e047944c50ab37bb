"""Registered queries over the driver tables, by capability."""
