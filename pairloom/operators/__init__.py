"""Relational operators over clips and trials."""
