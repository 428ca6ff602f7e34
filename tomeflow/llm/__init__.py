"""Operators for training-data pipelines: dedup, secrets, language, token counts, decontamination, mixing, quality."""
