"""Operators for training-data pipelines: language, near copies, personal data, secrets, mixing, tokens, pages, vectors."""
