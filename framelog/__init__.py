"""framelog: analytics over timestamped, sequence-numbered frame and event logs, on Spark."""
