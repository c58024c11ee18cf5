"""Exact top-k search over vectors in float, int8 and sign-bit form, on Spark."""
