"""Bit-serial parts of decoding, as plain Python and NumPy functions that run inside Spark's Python workers."""
