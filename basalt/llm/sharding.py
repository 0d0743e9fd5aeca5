"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has SLOTS slots; each shard owns `vnodes` of them, and an arc is the run of slots up to the next virtual
node. A key's hash picks its slot. Keys go to their arc's shard until it is full; those over continue clockwise to
the next shard with room. Counting keys per arc (a bounded table) is enough to settle that: which ranks of an arc
go to which shard is worked out once, and each row then finds its shard and its gapless slot from its rank.

A row's rank in its arc follows from the hash of its `order` columns, so files split otherwise move nothing. Rows equal
in all of these are interchangeable; they are numbered by reading partition, so a hot key's rows are in many tasks.
Nulls: a null key hashes like any other value; a null text has size 16. Repeated rows are separate keys.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, reproducible
from .tokens import free_name

SLOTS = 1 << 16
#: An arc's row hashes are dealt to so many groups, which take ranks one after another.
SALTS = 1 << 14


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of the virtual nodes, clockwise."""
    def slot(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % SLOTS

    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            taken.setdefault(slot(shard, v), shard)
    return sorted(taken.items())


def settle(nodes: list[tuple[int, int]], demand: dict[int, int], n_shards: int, load_factor: float) -> list[tuple[int, int, int, int, int]]:
    """Who takes what: (arc, first rank, end rank, shard, slot of the first). load_factor 1: counts at most one apart."""
    total = sum(demand.values())
    own = [0] * n_shards
    for a, (_, s) in enumerate(nodes):
        own[s] += demand.get(a, 0)
    if load_factor <= 1:
        low, more = divmod(total, n_shards)
        wanted = sorted(range(n_shards), key=lambda s: (-own[s], s))
        cap = [low] * n_shards
        for s in wanted[:more]:
            cap[s] += 1
    else:
        cap = [int(-(-total * load_factor // n_shards))] * n_shards
    load, out, over = [0] * n_shards, [], []
    m = len(nodes)

    def take(arc: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, cap[shard] - load[shard])
        if n > 0:
            out.append((arc, first, first + n, shard, load[shard]))
            load[shard] += n
            return first + n
        return first

    for a, (_, s) in enumerate(nodes):
        n = demand.get(a, 0)
        if (rest := take(a, 0, n, s)) < n:
            over.append((a, rest, n))
    onward = list(range(m))  # towards the next node whose shard has room

    def find(i: int) -> int:
        path = []
        while True:
            if load[nodes[i][1]] < cap[nodes[i][1]]:
                break
            path.append(i)
            nxt = onward[i] if onward[i] != i else (i + 1) % m
            i = nxt
            if len(path) > m:
                raise AssertionError("no room left")
        for p in path:
            onward[p] = i
        return i

    for a, first, end in over:
        at = (a + 1) % m
        while first < end:
            at = find(at)
            first = take(a, first, end, nodes[at][1])
    return out


def assign(df: DataFrame, n_shards: int, key: str = "doc_id", vnodes: int = 64, load_factor: float = 1.0, order: tuple[str, ...] = (), stash: Stash | None = None) -> DataFrame:
    """df with shard and slot (with underscores, if df has such columns: `names` tells). `order`: columns that make a row's
    rank in its arc; by default the key."""
    spark = df.sparkSession
    nodes = ring(n_shards, vnodes)
    slots = [s for s, _ in nodes]
    arc_of = [(s, bisect_left(slots, s) % len(nodes)) for s in range(SLOTS)]
    arcs = spark.createDataFrame(arc_of, "__slot int, __arc int")
    own = [f"c{i}" for i in range(len(df.columns))]
    col = dict(zip(df.columns, own, strict=True))
    rows = df.toDF(*own)
    hashed = rows.withColumn("__slot", F.pmod(F.xxhash64(col[key]), F.lit(SLOTS)).cast("int")).withColumn("__h", F.xxhash64(*[col[c] for c in order or (key,)])).withColumn("__read", F.spark_partition_id())
    # SLOTS rows whatever the input
    placed = hashed.join(F.broadcast(arcs), "__slot").drop("__slot").withColumn("__salt", F.pmod(F.col("__h"), F.lit(SALTS)).cast("int"))
    if not reproducible(df):  # what is counted must be what is placed
        placed = (stash or Stash(spark, "ring")).put(placed, "placed")
    alike = placed.groupBy("__arc", "__salt", "__h", "__read").agg(F.count("*").alias("__n"))
    groups = alike.groupBy("__arc", "__salt").agg(F.sum("__n").alias("__n"))
    # a row per arc at most
    demand = {r["__arc"]: r["n"] for r in groups.groupBy("__arc").agg(F.sum("__n").alias("n")).collect()}
    plan = spark.createDataFrame(settle(nodes, demand, n_shards, load_factor) or [(-1, 0, 0, 0, 0)], "__arc int, __from long, __to long, __shard int, __slot0 long")
    before = Window.partitionBy("__arc").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    earlier = groups.select("__arc", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__earlier"))
    inside = Window.partitionBy("__arc", "__salt").orderBy("__h", "__read").rowsBetween(Window.unboundedPreceding, -1)
    first = alike.withColumn("__first", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(earlier, ["__arc", "__salt"]).select("__arc", "__h", "__read", (F.col("__first") + F.col("__earlier")).alias("__first"))
    same = Window.partitionBy("__arc", "__h", "__read").orderBy("__h")
    ranked = placed.withColumn("__rn", F.row_number().over(same) - 1).join(first, ["__arc", "__h", "__read"]).withColumn("__rank", F.col("__rn") + F.col("__first"))
    # the plan has a row per arc and per overflow, bounded by the ring
    out = ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.__arc") == F.col("p.__arc")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    shard, slot = names(df)
    return out.select(*[F.col(f"r.{c}").alias(n) for n, c in col.items()], F.col("__shard").alias(shard), (F.col("__rank") - F.col("__from") + F.col("__slot0")).alias(slot))


def names(df: DataFrame) -> tuple[str, str]:
    return free_name(df, "shard"), free_name(df, "slot")
