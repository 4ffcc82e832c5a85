"""What driver and executors share: this package, where their own paths may not have it, and a folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession) -> None:
    """Once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp()) / "tessera_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._tessera_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset and Spark is a single process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate rows, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's numbers of parts before it merges small ones, and the bytes up to which it merges them.
PARTS, MERGED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Bytes of input for which a part is made, parts at most, and bytes of a merged part: keys and IRIs take 10 to 100 times as
#: much in the memory of a task as when they are shuffled.
PART_BYTES, MOST_PARTS, MERGED_BYTES = 8 << 20, 10_000, 2 << 20


def spread(spark: SparkSession, size: int) -> None:
    """Has what is shuffled dealt into more parts the larger the input is, so that a task's memory does not grow with it. The
    number only rises, as frames that were made before may still run; what the user has set stays. Where Spark makes as many
    parts anyway, only their merging is bounded: it would undo them as soon as each core has one."""
    sc, floor = spark.sparkContext, int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, mine = min(size // PART_BYTES, MOST_PARTS), getattr(sc, "_tessera_parts", None)
    if spark.conf.get(PARTS, None) not in (None, str(mine)):
        return
    if n > max(floor, mine or 0):
        spark.conf.set(PARTS, str(n))
        sc._tessera_parts = n
    if n > min(floor, sc.defaultParallelism) and spark.conf.get(MERGED, None) is None:
        spark.conf.set(MERGED, str(MERGED_BYTES))


def size_of_frame(df) -> int:
    """Bytes that Spark estimates for a frame; 0 where it knows none, as of a stream, which has no plan before it is started."""
    if df.isStreaming:
        return 0
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def size_of_files(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
