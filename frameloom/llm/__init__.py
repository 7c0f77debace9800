"""Operators for training-data pipelines of language models; nothing outside this folder imports it."""
