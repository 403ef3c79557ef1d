"""Operators of a training-data pipeline: near-duplicates, preference rendering, packing, token files, BPE, quality, exact
search, secrets, repeated lines and token counts. Nothing outside this subpackage imports it."""
