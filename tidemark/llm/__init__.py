"""Operators that prepare text and vectors for training, as Spark jobs.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
