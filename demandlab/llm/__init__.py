"""Operators for training-data preparation (near-duplicates, fingerprints, mixing,
extraction, quality, language model, embeddings, secrets, tokenizing, archives).

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
