"""Architecture-graph analytics on Spark."""
