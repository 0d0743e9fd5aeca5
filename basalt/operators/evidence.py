"""Evidence from prose: segments of a text, with their kind, authority, and ids that follow from content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.canonical import quoted, stable_id

LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
CLAUSE = ".+?(?:[.!?。！？](?=\\s|$)|$)"
STOP = "[.!?。！？]\\s*$"


def segments(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, place (from 1), start_line, end_line, rule, content: prose by clauses, fenced code whole.

    A segment ends with a clause that ends in a full stop, ! or ?, with a list item, before a blank line, and at fences.
    A fence that never closes is prose up to the end. Islands are found by counts over a text's lines, in windows by
    key: lines spill, and a text is never one value that grows. Null and empty texts have no segments. Keys are unique.
    """
    body = F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", "")
    lines = texts.where(F.length(text) > 0).select(key, F.posexplode(F.split(body, LINE_ENDS)).alias("n", "line"))
    bare = F.regexp_replace("line", "^\\s+|\\s+$", "")
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith("bare", F.lit("```"))
    rows = lines.withColumn("bare", bare).withColumn("fence", fence).withColumn("odd", F.sum(F.col("fence").cast("int")).over(upto) % 2 == 1)
    opens, closes, coded = F.col("fence") & F.col("odd"), F.col("fence") & ~F.col("odd"), F.col("odd") & ~F.col("fence")
    clauses = F.filter(F.transform(F.regexp_extract_all("bare", F.lit(CLAUSE), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.col("fence") | F.col("odd")
    parts = F.when(whole, F.array("line")).when(F.col("bare") == "", F.array(F.lit(None).cast("string"))).otherwise(clauses)
    item = F.startswith("bare", F.lit("- ")) | F.startswith("bare", F.lit("* "))
    each = rows.select(key, "n", opens.alias("opens"), closes.alias("closes"), whole.alias("whole"), item.alias("item"), F.posexplode(parts).alias("k", "part"))
    blank = F.col("part").isNull()
    ends = blank | F.col("closes") | (~F.col("whole") & (F.col("part").rlike(STOP) | F.col("item")))
    before = Window.partitionBy(key).orderBy("n", "k")
    past = F.coalesce(F.sum(F.col("ends").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.sum(F.col("opens").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    islands = each.withColumn("ends", ends).withColumn("island", past + starts).where(F.col("part").isNotNull())
    content = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "part"))), lambda x: x["part"]), "\n"), "^\\s+|\\s+$", "")
    out = islands.groupBy(key, "island").agg((F.min("n") + 1).alias("start_line"), (F.max("n") + 1).alias("end_line"), F.bool_or("closes").alias("closed"), content.alias("content"))
    rule = F.when(F.col("closed"), "fenced_code").otherwise("clause_segment")
    place = F.row_number().over(Window.partitionBy(key).orderBy("island"))
    return out.select(key, place.alias("place"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), rule.alias("rule"), "content")


def evidence_ids(kind: Column, source: Column, start: Column, end: Column, content: Column) -> Column:
    """struct(evidence_id, cluster, content_hash)."""
    digest = F.sha2(quoted(content), 256)
    span = F.concat(F.lit('{"end_column":0,"end_line":'), end.cast("string"), F.lit(',"source":'), quoted(source), F.lit(',"start_column":0,"start_line":'), start.cast("string"), F.lit("}"))
    own = stable_id(F.lit("evidence"), quoted(kind), span, quoted(digest))
    cluster = stable_id(F.lit("cluster"), quoted(kind), quoted(source), start.cast("string"))
    return F.struct(own.alias("evidence_id"), cluster.alias("cluster"), digest.alias("content_hash"))


def issue_evidence(found: DataFrame, source: Column, discussion: bool = False) -> DataFrame:
    """segments' rows with kind, authority, rule and ids. Discussion is context only: a witness without authority, whose
    ids are those of the issue's rule."""
    kind, authority = tx.evidence_kind(F.col("content")), tx.evidence_authority(F.col("content"))
    ids = evidence_ids(kind, source, F.col("start_line"), F.col("end_line"), F.col("content"))
    rows = found.withColumn("ids", ids)
    if discussion:
        kind, authority = F.lit("ISSUE_WITNESS"), F.lit("PROVISIONAL")
        rows = rows.withColumn("rule", F.concat(F.lit("public_discussion:"), "rule"))
    return rows.select(*found.columns, kind.alias("kind"), authority.alias("authority"), "ids.evidence_id", "ids.cluster", "ids.content_hash")


def contract_evidence(contracts: DataFrame) -> DataFrame:
    """contracts' rows with authority, end_line and ids: documentation and types have authority B, other contracts C.
    contracts: source, content, kind."""
    authority = F.when(F.col("kind").isin("DOCUMENTATION", "TYPE_CONTRACT"), "B").otherwise("C")
    end = F.greatest(F.lit(1), F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + 1)
    ids = evidence_ids(F.col("kind"), F.col("source"), F.lit(1), end, F.col("content"))
    return contracts.select(*contracts.columns, authority.alias("authority"), end.cast("long").alias("end_line"), ids.alias("__ids")).select(*contracts.columns, "authority", "end_line", "__ids.evidence_id", "__ids.cluster", "__ids.content_hash")
