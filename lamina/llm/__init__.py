"""Training-data operators: search, packing, classifiers, fingerprints, dedup, sharding, tokens.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
