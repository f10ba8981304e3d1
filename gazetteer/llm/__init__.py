"""Operators that prepare training text: dedup, filters, mixing, packing, archives."""
