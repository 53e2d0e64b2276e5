"""Incremental group-by aggregation on Spark, with mergeable partial states."""
