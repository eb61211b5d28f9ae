"""Sports-market analytics on Spark."""
