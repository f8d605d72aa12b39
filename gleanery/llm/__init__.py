"""Training-data operators: dedup, token counts, packing, archives, formatting and quality rules.

Nothing else in the library imports this package.
"""
