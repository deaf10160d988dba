"""Operators of a training-data pipeline over `documents`, `pages`, `embeddings` and
`conversations`.  Nothing outside this package imports it; `queries.py` lists its queries."""
