"""Training-data operators: mixing, packing, search, PII, quality, dedup, URLs, licences, HTML.

Nothing else in the package imports this subpackage.
"""
