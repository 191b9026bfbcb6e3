"""Access-trace analytics on Spark: declarative DataFrame operators over reads, regions, rules and captures."""
