"""Event-log indexing and reconciliation on Spark."""
