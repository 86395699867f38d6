"""Operators for training data: private data, near copies, token counts, neighbours, quality, mixing, scoring, packing.

Each module holds one operator with its own interface; ``queries`` registers the thin queries over whole tables.
Nothing outside this folder imports it.
"""
