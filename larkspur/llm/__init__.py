"""Training-data operators: language ID, dedup, secrets, WARC, tokenisation, PII, quality, sharding, decontamination.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
