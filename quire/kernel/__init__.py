"""Byte-level kernels in plain Python; nothing here imports Spark."""
