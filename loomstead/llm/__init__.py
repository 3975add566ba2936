"""Operators for preparing language-model training data.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded hook in
``__spark_entry__.py`` uses this subpackage; the engine works without it.
"""
