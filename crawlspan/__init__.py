"""Site-audit analytics on Spark."""
