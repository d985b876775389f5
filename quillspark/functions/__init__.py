"""Scalar and table functions: text analysis, vectors, chunking, question understanding, metrics."""
