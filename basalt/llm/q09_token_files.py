"""Query op9: every document into Simple-8b token files, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import Stash, ship, table
from .token_files import documents_of, read_token_files, write_token_files

END_ID = 2


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    out = f"{Stash(spark, 'tokens').root}/files"
    write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return documents_of(read_token_files(spark, out))


QUERIES = {"op9_token_files": op9_token_files}
ORACLES: dict[str, str] = {}
