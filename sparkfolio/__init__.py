"""Document retrieval and metering analytics on Spark."""
