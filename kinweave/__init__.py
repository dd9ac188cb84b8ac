"""Record linkage over hierarchical data, expressed as Spark DataFrame operations."""
