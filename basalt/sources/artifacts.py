"""A content-addressed, append-only artifact table, as Parquet partitioned by type; indexes are queries.

Beside the table stands its journal: what each batch added, in order. An envelope: artifact_id, artifact_type, schema_version, instance_id, parent_ids, content_hash, producer, created_at,
authority, confidence, status, payload (canonical JSON text). Adding the same id with the same content changes
nothing; with other content, or with a parent that isn't stored, the whole batch is refused.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_json, quoted, stable_id

JOURNAL = "artifact_id string, artifact_type string, instance_id string, content_hash string, created_at string, batch long"
SCHEMA_VERSION = "1.0.0"
SCHEMA = "artifact_id string, schema_version string, instance_id string, parent_ids array<string>, content_hash string, producer string, created_at string, authority string, confidence string, status string, payload string, artifact_type string"


class ArtifactError(ValueError):
    pass


def envelopes(rows: DataFrame) -> DataFrame:
    """rows: artifact_type, instance_id, producer, payload, and optionally parent_ids, authority, confidence, status,
    created_at. Adds hashes and ids; the payload is canonical JSON."""
    default = {"parent_ids": F.array().cast("array<string>"), "authority": F.lit("PROVISIONAL"), "confidence": F.lit("UNKNOWN"), "status": F.lit("ACTIVE"), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")}
    for name, value in default.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    rows = rows.withColumn("content_hash", F.sha2("payload", 256)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    own = stable_id(F.col("artifact_type"), quoted(F.col("instance_id")), quoted(F.col("content_hash")), canonical_json(F.col("parent_ids"), T.ArrayType(T.StringType())), quoted(F.col("producer")), quoted(F.col("status")))
    return rows.withColumn("artifact_id", own)


def schema_errors(rows: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(artifact_id, error): unknown types, and payloads without a required field."""
    known = F.create_map(*[x for t, fields in required.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in fields]).cast("array<string>"))])
    need = known[F.col("artifact_type")]
    have = F.json_object_keys("payload")
    error = F.when(need.isNull(), F.concat(F.lit("unknown type "), F.col("artifact_type"))).otherwise(F.concat(F.lit("missing "), F.array_join(F.array_except(need, F.coalesce(have, F.array().cast("array<string>"))), ",")))
    return rows.select("artifact_id", error.alias("error")).where("error <> 'missing '")


class ArtifactTable:
    def __init__(self, spark: SparkSession, path: str, required: dict[str, list[str]]):
        self.spark, self.path, self.required = spark, path, required
        self.journal_path = f"{path.rstrip('/')}_journal"

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def create(self) -> "ArtifactTable":
        self.spark.createDataFrame([], SCHEMA).write.mode("ignore").partitionBy("artifact_type").parquet(self.path)
        self.spark.createDataFrame([], JOURNAL).write.mode("ignore").parquet(self.journal_path)
        return self

    def journal(self) -> DataFrame:
        return self.spark.read.schema(JOURNAL).parquet(self.journal_path)

    def read_envelopes(self) -> DataFrame:
        """The stored envelopes with `place`, in the journal's order."""
        from pyspark.sql import Window

        order = Window.partitionBy("instance_id").orderBy("batch", "created_at", "artifact_id")
        rows = self.rows().join(self.journal().select("artifact_id", "batch"), "artifact_id")
        return rows.withColumn("place", F.row_number().over(order)).drop("batch")

    def put(self, rows: DataFrame) -> int:
        """Adds a batch; returns how many were new."""
        new = envelopes(rows).select([c.split()[0] for c in SCHEMA.split(", ")]).dropDuplicates(["artifact_id"])
        if (bad := schema_errors(new, self.required).first()) is not None:
            raise ArtifactError(f"{bad['artifact_id']}: {bad['error']}")
        old = self.rows()
        same = new.alias("n").join(old.alias("o"), "artifact_id").where("n.payload <> o.payload or n.authority <> o.authority or n.confidence <> o.confidence")
        if (bad := same.select("artifact_id").first()) is not None:
            raise ArtifactError(f"artifact id collision for {bad['artifact_id']}")
        stored = old.select("artifact_id").union(new.select("artifact_id"))
        if (bad := _dangling(new, stored).first()) is not None:
            raise ArtifactError(f"unknown parent artifact: {bad['parent']}")
        fresh = new.join(old.select("artifact_id"), "artifact_id", "left_anti")
        ids = fresh.select("artifact_id", "artifact_type", "instance_id", "content_hash", "created_at")
        batch = (self.journal().agg(F.max("batch")).first()[0] or 0) + 1
        n = fresh.count()
        if n:
            # the journal is written first: a batch that broke off shows as entries without envelopes, and can be put again
            ids.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(self.journal_path)
            fresh.write.mode("append").partitionBy("artifact_type").parquet(self.path)
        return n

    def get(self, artifact_id: str) -> DataFrame:
        return self.rows().where(F.col("artifact_id") == artifact_id)

    def find_by_content_hash(self, digest: str) -> DataFrame:
        return self.rows().where(F.col("content_hash") == digest)

    def list(self, artifact_type: str | None = None, instance_id: str | None = None) -> DataFrame:
        rows = self.rows()
        rows = rows.where(F.col("artifact_type") == artifact_type) if artifact_type else rows
        return (rows.where(F.col("instance_id") == instance_id) if instance_id else rows).orderBy("artifact_id")

    def latest(self) -> DataFrame:
        """Per instance and type the newest by created_at, ties to the larger id."""
        best = F.max_by(F.struct("artifact_id", "created_at", "payload"), F.struct("created_at", "artifact_id"))
        return self.rows().groupBy("instance_id", "artifact_type").agg(best.alias("x")).select("instance_id", "artifact_type", "x.*")

    def verify(self) -> DataFrame:
        """(artifact_id, error): everything wrong with what is stored: hashes, ids, journal, schemas, parents, repeats."""
        rows = self.rows()
        said = lambda df, text: df.select("artifact_id", F.lit(text).alias("error"))
        hashes = said(rows.where(F.sha2("payload", 256) != F.col("content_hash")), "hash mismatch")
        made = envelopes(rows.withColumnRenamed("artifact_id", "__was"))
        ids = made.where("artifact_id <> __was").select(F.col("__was").alias("artifact_id"), F.lit("id mismatch").alias("error"))
        journal = self.journal()
        listed = journal.select("artifact_id", F.col("content_hash").alias("digest"))
        unlisted = said(rows.join(listed, "artifact_id", "left_anti"), "not in the journal")
        absent = said(listed.join(rows, "artifact_id", "left_anti").distinct(), "journal entry without envelope")
        other = said(rows.join(listed, "artifact_id").where("content_hash <> digest"), "journal hash mismatch")
        twice = said(rows.groupBy("artifact_id").count().where("count > 1"), "stored twice")
        loose = _dangling(rows, rows.select("artifact_id")).select("artifact_id", F.concat(F.lit("dangling parent "), "parent").alias("error"))
        out = schema_errors(rows, self.required)
        for part in (hashes, ids, unlisted, absent, other, twice, loose):
            out = out.union(part)
        return out

    def recover(self) -> dict[str, int]:
        """Writes the journal anew from the stored envelopes; refused if one is corrupt or has a dangling parent."""
        rows = self.rows()
        corrupt = rows.where(F.sha2("payload", 256) != F.col("content_hash")).count()
        dangling = _dangling(rows, rows.select("artifact_id")).count()
        if corrupt or dangling:
            raise ArtifactError(f"recovery found corrupt={corrupt}, dangling_parents={dangling}")
        order = rows.select("artifact_id", "artifact_type", "instance_id", "content_hash", "created_at").withColumn("batch", F.lit(1).cast("long"))
        order.write.mode("overwrite").parquet(self.journal_path)
        return {"artifacts": rows.count()}

    def sequential_digest(self, exclude: list[str] | None = None) -> str:
        """Hash of the canonical JSON of all records in the order of their ids, as certificates carry it. One pass over
        sorted rows, a partition at a time; `digest` is the one for large tables."""
        rows = self.rows().where(~F.col("artifact_type").isin(exclude)) if exclude else self.rows()
        kind = T.StructType([T.StructField(c, T.StringType()) for c in ("artifact_id", "artifact_type", "instance_id", "content_hash")])
        text = canonical_json(F.struct(*kind.names), kind)
        out, first = hashlib.sha256(b"["), True
        for row in rows.select("artifact_id", text.alias("json")).orderBy("artifact_id").toLocalIterator():
            out.update((row["json"] if first else "," + row["json"]).encode())
            first = False
        out.update(b"]")
        return out.hexdigest()

    def digest(self, exclude: list[str] | None = None) -> str:
        """One digest of all rows but some types, whatever their order: a sum of row hashes, so nothing is gathered."""
        rows = self.rows().where(~F.col("artifact_type").isin(exclude)) if exclude else self.rows()
        row = F.sha2(F.concat_ws("|", "artifact_id", "content_hash", "status"), 256)
        halves = [F.sum(F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 13, 25)]
        got = rows.agg(F.count("*").alias("n"), *halves).first()
        return "-".join(f"{int(x or 0):x}" for x in got)

    def export_jsonl(self, out: str, artifact_type: str) -> None:
        self.list(artifact_type).write.mode("errorifexists").json(out)


def _dangling(rows: DataFrame, stored: DataFrame) -> DataFrame:
    claims = rows.select("artifact_id", F.explode("parent_ids").alias("parent"))
    return claims.join(stored.select(F.col("artifact_id").alias("parent")), "parent", "left_anti")
