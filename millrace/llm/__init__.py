"""Corpus preparation for language models. Nothing outside this folder imports it."""
