"""Training-data operators: token counts, packing, scoring, joins, mixing, fingerprints, passage removal.

Nothing outside this folder imports it; ``catalog.py`` registers its queries.
"""
