"""What the operators share: tables, the shared folder, shipping of this package, bounded helpers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_HELD: dict[str, dict[Any, Any]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, for Spark's own default of 10,000: texts are long, and a batch of them stands in the JVM and
#: in Python at once.
BATCH_ROWS, BATCH_CONF = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application, so Python stages can import it anywhere; keep batches small
    unless the session says otherwise."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{root.name}_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_basalt_shared", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="basalt-shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            spark.sparkContext._basalt_shared = folder
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stash:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._quiet_drop, self.root)

    def _quiet_drop(self, path: str) -> None:
        try:
            delete(self.spark, path)
        except Exception:  # the session may have ended before the interpreter
            pass

    def write(self, df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
        path = f"{self.root}/{self.n}-{name}"
        self.n += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self.write(df, name)[0]


def reproducible(df: DataFrame) -> bool:
    """Is df a plain scan of files, whose rows come in the same order whenever it is read?"""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in ("LogicalRelation", "Relation", "Project", "Filter"):
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def numbered(df: DataFrame, name: str, stash: Stash) -> DataFrame:
    """df with a unique number per row that is the same at each reading; what isn't a plain scan is written first."""
    out = df.withColumn(name, F.monotonically_increasing_id())
    return out if reproducible(df) else stash.put(out, "numbered")


def held(by: str) -> dict[Any, Any]:
    """What a process remembers for one operator from task to task.

    Spark's Python workers serve one stage after another, so what another operator remembered goes first: tables and memos
    of several would stand in each worker at once.
    """
    if by not in _HELD:
        _HELD.clear()
        let_go()
        _HELD[by] = {}
    return _HELD[by]


def let_go() -> None:
    """Gives memory of what is no longer referred to back to the system, cycles and Arrow's pool too."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
