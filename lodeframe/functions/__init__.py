"""Column functions that Spark lacks: average ranks, exact quantile buckets, guarded correlation."""
