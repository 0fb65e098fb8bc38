"""Queries over the driver's tables: bindings, registered queries and their SQL."""
