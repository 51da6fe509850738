"""Operators of a training-data pipeline over a corpus of documents.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
