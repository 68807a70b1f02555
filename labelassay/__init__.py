"""Label verification analytics on Spark."""
