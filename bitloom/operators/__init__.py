"""Bit vectors, packed integer vectors, index tables, rank and select."""
