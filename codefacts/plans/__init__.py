"""End-to-end plans: the full analysis, the adapters over the driver tables, and the query catalogue."""
