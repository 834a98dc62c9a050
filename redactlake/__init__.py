"""Reversible redaction of text corpora as Spark DataFrame operators."""
