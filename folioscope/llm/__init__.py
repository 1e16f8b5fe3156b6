"""Training-data operators: scoring, de-duplication, scanning and packing of document corpora.

Nothing outside this folder (but for the guarded registration in ``__spark_entry__``) imports it.
"""
