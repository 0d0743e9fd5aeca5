"""Operators of training-data pipelines: tokenise, pack, score, deduplicate, shard, search."""
