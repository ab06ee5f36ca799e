"""Readers of the domain formats; every schema is explicit."""
