"""Composed plans: the driver-data adapter, the queries and their SQL."""
