"""Reading and writing tables."""

from sparrix.sources.sniff import read_matrix, write_matrix

__all__ = ["read_matrix", "write_matrix"]
