"""Corpus analytics for long structured documents, written as plain PySpark DataFrame jobs."""
