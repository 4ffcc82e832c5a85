"""Helpers that the corpus operators share: shipping code, cutting lineage, grouped Arrow maps, words."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import removed, shared_folder, ship_code

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch; long texts times this stay far below a worker's memory.
ROWS = 1000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of one, which the JVM and the worker both hold; rows of packed numbers reach them.
BYTES = 16 << 20

_WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors and sets small Arrow batches."""
    ship_code(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's default
        spark.conf.set(BATCH_ROWS, str(ROWS))
    if spark.conf.get(BATCH_BYTES, None) is None:  # nobody has set it
        spark.conf.set(BATCH_BYTES, str(BYTES))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder, which outlives lost executors. What was shuffled for it, and
    tables that were cut before and are not used any more, are deleted: Spark does so only when the driver's JVM collects
    its garbage, until when the files of all steps would stay on the executors' disks."""
    spark = df.sparkSession
    shared(spark)
    # a frame of its own, as one that has run holds its shuffles as long as a caller holds it
    out = df.select("*").checkpoint(eager=True)
    settle_driver(spark)
    return out


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. Rows numbered by the tasks that make them keep their numbers, and columns that
    a reader leaves out are not read."""
    to = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.parquet(to)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_memos: list[weakref.ref] = []


def kept(memo) -> None:
    """Has settle() clear a cache that lives longer than a task."""
    _memos.append(weakref.ref(memo, _memos.remove))


def settle() -> None:
    """Empties this process's caches and gives its memory back."""
    for ref in list(_memos):
        if (memo := ref()) is not None:
            memo.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def settle_driver(spark: SparkSession) -> None:
    """Gives back what the driver's Python and JVM don't hold any more, and what Spark keeps for it on executors."""
    gc.collect()
    settle()
    spark._jvm.System.gc()


_stage: list[int] = []


def _begin() -> None:
    """Forgets what tasks of another stage left to those that would follow them."""
    task = TaskContext.get()
    now = [task.stageId()] if task is not None else []
    if now != _stage:
        _stage[:] = now
        settle()  # what was used since is kept once more,
        settle()  # and then not


def tidy(run: Callable):
    """A mapInArrow function that gives its memory back when it ends, as workers stay for later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        try:
            yield from run(batches)
        finally:
            settle()

    return wrapped


def over_groups(keys: list[str], fn: Callable[[pa.Table, int], pa.Table | None], schema: pa.Schema, most: int = 1 << 62):
    """A mapInArrow function for rows sorted by integer keys: fn sees one whole group at a time, or runs of
    `most` rows of it, with the run's number within the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []  # the last group so far, which may go on in the next batch
        last: tuple | None = None
        done: list[pa.Table] = []
        waiting = rows = part = 0

        def close():
            nonlocal waiting
            out = fn(pa.concat_tables(kept).combine_chunks(), part)
            if out is not None and out.num_rows:
                done.append(out)
                waiting += out.num_rows

        def flush():
            nonlocal waiting
            for b in pa.concat_tables(done).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays(b.columns, schema=schema)
            done.clear()
            waiting = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            cols = [t[k].to_numpy() for k in keys]
            change = np.zeros(t.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in cols)
            if last is not None and first != last:
                close()
                kept, rows, part = [], 0, 0
            at = [0, *np.flatnonzero(change).tolist(), t.num_rows]
            for k, (a, b) in enumerate(zip(at, at[1:])):
                if k:
                    close()
                    kept, rows, part = [], 0, 0
                while rows + b - a > most:
                    kept.append(t.slice(a, most - rows))
                    close()
                    a += most - rows
                    kept, rows, part = [], 0, part + 1
                kept.append(t.slice(a, b - a))
                rows += b - a
            last = tuple(c[-1] for c in cols)
            if waiting >= 20_000:
                yield from flush()
        if kept:
            close()
        if done:
            yield from flush()

    return run


def grouped(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn over each whole group of integer keys; groups must be bounded by the caller."""
    arrow = arrow_schema(df.sparkSession, schema)
    dealt = df.repartition(partitions(df), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(over_groups(keys, fn, arrow)), schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


#: Characters that are hashed at a time, and those of the longest word that is hashed with others.
SPAN, LONGEST = 1 << 18, 255
_ODD = 0x9E3779B97F4A7C15
_tables: dict[tuple[str, int], np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """Which characters belong to words (as \\w has it), and the powers of _ODD and of its inverse."""
    if (name, SPAN) not in _tables:
        if name == "word":
            made = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
        else:
            base = _ODD if name == "powers" else pow(_ODD, -1, 1 << 64)
            made = np.full(SPAN + LONGEST + 1, base, np.uint64)
            made[0] = 1
            made = np.cumprod(made, dtype=np.uint64)
        _tables[name, SPAN] = made
    return _tables[name, SPAN]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words() of all texts, one after the other, and how many each text has: polynomials of
    their characters, taken from running sums, so that no word becomes an object."""
    found, counts, held, size = [], np.zeros(len(texts), np.int64), [], 0
    for k, text in enumerate(texts):
        for part in _slices(text.lower()) if text else ():
            if size + len(part) > SPAN and held:
                found.append(_hashed(held, counts))
                held, size = [], 0
            held.append((k, part))
            size += len(part)
    if held:
        found.append(_hashed(held, counts))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def _slices(text: str) -> Iterator[str]:
    """Parts of about SPAN characters, cut at blanks."""
    at = 0
    while len(text) - at > SPAN:
        cut = text.rfind(" ", at + 1, at + SPAN)
        if cut < 0 and (cut := text.find(" ", at + SPAN)) < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _hashed(held: list[tuple[int, str]], counts: np.ndarray) -> np.ndarray:
    """Hashes of the words of parts of texts (number, part); adds to the counts of the texts."""
    low = [part for _, part in held]
    flat = "\n".join(low)
    if flat:
        char = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(char) + 2, np.int8)
        inside[1:-1] = _table("word")[char]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum([len(t) + 1 for t in low])
        np.add.at(counts, [k for k, _ in held], np.diff(np.searchsorted(start, ends), prepend=0))
        h = np.zeros(len(start), np.uint64)
        short = end - start <= LONGEST
        for k in range(0, len(char), SPAN):
            a, b = np.searchsorted(start, (k, k + SPAN))
            w = np.arange(a, b)[short[a:b]]
            if not len(w):
                continue
            part = char[k : k + SPAN + LONGEST].astype(np.uint64)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _table("powers")[: len(part)], dtype=np.uint64)])
            h[w] = (run[end[w] - k] - run[start[w] - k]) * _table("inverse")[start[w] - k]
        h = mixed(h + (end - start).astype(np.uint64) * np.uint64(_ODD))
        for k in np.flatnonzero(~short):
            h[k] = word_hash(flat[start[k] : end[k]])
        return h
    return np.zeros(0, np.uint64)


class Memo(dict):
    """A bounded cache of a module: value(key) is computed on a miss, and the cache starts anew when it is full or,
    unless its owner sees to that, a task ends."""

    def __init__(self, value: Callable, most: int = 300_000, owned: bool = False):
        super().__init__()
        self.value, self.most = value, most
        if not owned:
            kept(self)

    def __missing__(self, key):
        out = self.value(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = out
        return out


def gone(spark: SparkSession, path: str) -> None:
    """Deletes what was kept in the shared folder and is not read any more."""
    removed(spark, path)


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, mod n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns with fixed types; extra and clashing columns stay outside."""
    low = {c.lower(): c for c in df.columns}
    return df.select(*[df[f"`{low[c.lower()]}`"].cast(t).alias(c) for c, t in types.items()])


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of the session's own where none is set, in one process."""
    return shared_folder(spark)


#: Ids that are broadcast at most, 16 bytes each; beyond that both sides are shuffled.
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """left_semi or left_anti join with a computed frame of ids: without shuffling df while they are few."""
    ids = ids.select(on)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)
