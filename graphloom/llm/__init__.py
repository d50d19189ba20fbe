"""Training-data operators: packing, media shards, near-duplicate joins, BPE,
exact dedup, WARC archives, chat templates, PII, page extraction and quality.

Nothing outside this subpackage imports it.
"""
