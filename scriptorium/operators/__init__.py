"""Relational operators over document corpora, DataFrame to DataFrame."""
