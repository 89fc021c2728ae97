"""Operators for preparing training data: tokens, chats, filters, search, shards, deduplication."""
