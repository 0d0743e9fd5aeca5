"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q01_packing", "q02_toxicity", "q03_ngram_join", "q04_line_dedup", "q05_bpe", "q06_topk", "q07_sharding", "q08_quality", "q09_token_files", "q10_chat", "q11_langid", "q12_centroids", "q13_runs"]


def modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in modules() for k, s in m.ORACLES.items()}
