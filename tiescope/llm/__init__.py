"""Operators for training-data pipelines over documents and embeddings.

Each module holds one operator with a general interface; ``queries`` holds
the registered queries. Nothing outside this package imports it.
"""
