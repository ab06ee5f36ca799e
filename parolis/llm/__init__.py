"""Operators that prepare training data: speaker turns, redaction, nearest-time pairs, neighbour graphs, leak search,
source mixing and long shared spans. Nothing outside this sub-package imports it."""
