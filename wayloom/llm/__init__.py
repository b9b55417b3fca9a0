"""Training-data operators: formatting, deduplication, packing, language and fingerprints.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
