"""Graphs as rows of JSON with a digest each, read back and checked; edges taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import graph_digest

NODE = "node string, kind string, label string, attributes map<string,string>, provenance array<string>"
EDGE = "edge_id string, kind string, source_ids array<string>, target_ids array<string>, condition string, confidence double, attributes map<string,string>, provenance array<string>"


def _sorted(attributes: str) -> Column:
    """A map whose keys stand in order, so that equal maps make equal texts; null is empty."""
    entries = F.coalesce(F.map_entries(F.col(attributes)), F.array().cast("array<struct<key:string,value:string>>"))
    return F.map_from_entries(F.array_sort(entries))


def _body(df: DataFrame, schema: str, part: str, key: str) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    fields = [_sorted(c).alias(c) if c == "attributes" else F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "provenance" else F.col(c) for c in names]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.where(F.col(key).isNotNull()).select("graph", F.lit(part).alias("part"), F.col(key).alias("id"), body.alias("body")).dropDuplicates(["graph", "part", "id", "body"])


def _digests(packed: DataFrame) -> DataFrame:
    return graph_digest(packed.select("graph", F.concat_ws("\x00", "part", "body").alias("key")), "key", "graph")


def pack_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packed: graph, part, id, body; digests: graph, n, digest). nodes: graph and the columns of NODE; edges: graph and
    those of EDGE. A digest doesn't hang on the order of rows or keys; equal rows count once; a row without an id is none."""
    packed = _body(nodes, NODE, "node", "node").unionByName(_body(edges, EDGE, "edge", "edge_id"))
    return packed, _digests(packed)


def unpack_graphs(packed: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges of the graphs that are whole; broken: graph, reason). A graph whose rows don't make its digest again is
    DIGEST_MISMATCH, one with an edge whose end it hasn't is MISSING_NODE; a graph without a stored digest isn't checked."""
    read = lambda part, schema: packed.where(F.col("part") == part).select("graph", F.from_json("body", schema).alias("x")).select("graph", "x.*")
    nodes, edges = read("node", NODE), read("edge", EDGE)
    _, again = pack_graphs(nodes, edges)
    differ = digests.select("graph", F.col("digest").alias("was")).join(again.select("graph", "digest"), "graph", "left").where(~F.col("was").eqNullSafe(F.col("digest")) & F.col("was").isNotNull())
    ends = edges.select("graph", F.explode(F.array_union("source_ids", "target_ids")).alias("node"))
    lost = ends.join(nodes.select("graph", "node"), ["graph", "node"], "left_anti").select("graph").distinct()
    broken = differ.select("graph", F.lit("DIGEST_MISMATCH").alias("reason"))
    broken = broken.unionByName(lost.join(differ, "graph", "left_anti").select("graph", F.lit("MISSING_NODE").alias("reason")))
    return nodes.join(broken, "graph", "left_anti"), edges.join(broken, "graph", "left_anti"), broken


def remove_edges(edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges without those of `gone` (edge_id), the removed ones, ids that no edge has)."""
    ids = gone.select("edge_id").where("edge_id is not null").distinct()
    return edges.join(ids, "edge_id", "left_anti"), edges.join(ids, "edge_id", "left_semi"), ids.join(edges.select("edge_id"), "edge_id", "left_anti")
