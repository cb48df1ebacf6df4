"""Decoding and analysing wavelet-compressed image codestreams (ISO/IEC 15444-1) with Spark DataFrames."""
