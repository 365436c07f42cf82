"""Relational operators of retrieval, chunking, auditing and evaluation."""
