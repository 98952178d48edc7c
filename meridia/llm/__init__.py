"""Training-data operators: language ID, dedup, mixing, tokenisation, secrets, search.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
