"""Operators for preparing training data: tokens, near-duplicates, mixing, quality, shards, chats."""
