"""Training-data operators: token counts, page text, secrets, quality, near duplicates, packing,
nearest neighbours, byte-pair encoding, web archives and repeated passages.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
