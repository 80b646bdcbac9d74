"""Sources of raw logs."""
