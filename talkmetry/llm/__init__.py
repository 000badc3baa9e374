"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its queries when it is there.
"""
