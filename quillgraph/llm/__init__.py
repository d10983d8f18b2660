"""Operators for preparing language-model training data (dedup, tokens, quality, shards, archives)."""
