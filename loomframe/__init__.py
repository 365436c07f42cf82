"""Retrieval, answer-audit and corpus analytics as Spark plans."""
