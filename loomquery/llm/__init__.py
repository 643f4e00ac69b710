"""Training-data operators: quality rules, near-duplicates, fingerprints, PII,
URL filters, packing, mixing, licence scans, line dedup and language ID.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
