"""Training-data operators: quality, media, licences, packing, HTML, deduplication, URLs, tokenizing.

Nothing else in the library imports this subpackage.
"""
