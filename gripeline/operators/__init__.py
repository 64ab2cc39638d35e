"""Operators of the pain-point analytics: DataFrame in, DataFrame out; no actions but those that size batches or carry sums on."""
