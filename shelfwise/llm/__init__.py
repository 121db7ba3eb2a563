"""Operators of a large training-data pipeline over documents, embeddings and conversations."""
