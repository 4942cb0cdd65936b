"""Corpus operators: scoring, deduplication, filtering, mixing and tokenisation of text tables."""
