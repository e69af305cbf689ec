"""Operators for preparing training data from documents, pages and embeddings."""
