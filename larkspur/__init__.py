"""larkspur: detection-event analytics on Spark."""
