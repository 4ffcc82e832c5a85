"""Hard negatives by distributed radix selection.

A window is what one anchor looks for: the first k rows, by falling score and then rising id, of the same label (its
positives) or of another one with a score between two bounds (negatives beside a positive). Scores are never sorted nor
kept. Each round, tasks count the scores of all windows by one digit of 8 bits of their distance from the window's
upper bound; Spark adds the counts, and the digit that holds the kth score becomes the window's range for the next
round. Once few rows are left up to that digit, or the last digit is known, the qualifying rows are gathered; rows of
equal scores at the limit are cut to k by id within each task, so that any number of equal vectors is no burden.

Rows lie in blocks of 512, anchors in tiles of 256, each packed as one row. Blocks are dealt over the tasks once
a round, tiles go to each part of the deal; a task sees one pair of block and tile at a time, and scores are one exact
matrix product. Nothing is broadcast by hand, and nothing but two numbers and the state of the loop comes to the driver.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of
unequal lengths have no score; those of length 0 score 0. Components are floor(scale * x), held to 2**62; scores beyond
2**62 - 1 count as that. Repeated rows are rows of their own, as anchors, positives and negatives; an
anchor is never its own positive. Of equal scores a null id comes first. An empty table, or one without anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
#: Rows of a block and anchors of a tile.
BLOCK_ROWS, TILE_ANCHORS = 512, 256
#: Bits of a digit, and of a row's place in its block and a block's in its task.
DIGIT, PLACE_BITS, TASK_BITS = 8, 10, 23
#: Gathering begins once a window has no more rows than this many times k.
ENOUGH = 4
#: Counts or rows that a task holds before it hands them on.
HELD = 200_000
#: Greatest score and component.
MOST, WIDEST = (1 << 62) - 1, 1 << 62
#: Stands for a null id, and comes before all others as null does.
NAMELESS = -(1 << 63)

BLOCK = "block long, dim int, top long, n_anchors int, ids binary, labels binary, anchors binary, q binary"
TILE = "tile long, dim int, rows binary, ids binary, labels binary, q binary"
ANCHOR = "row long, dim int, id long, label long, q binary"
COUNT = "tile long, slot int, w int, digit int, n long"
HIT = "tile long, slot int, w int, score long, id long"


def _narrow(q: np.ndarray) -> bytes:
    """Whole numbers in the fewest of 2, 4 or 8 bytes."""
    top = int(np.abs(q).max(initial=0))
    return q.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes()


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    if not n * dim:
        return np.zeros((n, dim), np.int64)
    return np.frombuffer(data, f"<i{len(data) // (n * dim)}").reshape(n, dim)


def _scaled(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        q = np.floor(np.array(vectors, np.float64) * scale)
    return np.clip(q, -WIDEST, WIDEST).astype(np.int64)


def _blocks(scale: float, schema: pa.Schema):
    """(id, label, anchor, vector) to blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            ids, labels, anchor = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists = batch.column(3)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            size = np.diff(at)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                for a in range(0, len(rows), BLOCK_ROWS):
                    r = rows[a : a + BLOCK_ROWS]
                    q = _scaled([flat[at[x] : at[x] + dim] for x in r.tolist()], scale)
                    out = (k, dim, int(np.abs(q).max(initial=0)), int(anchor[r].sum()), ids[r].astype("<i8").tobytes(), labels[r].astype("<i8").tobytes(), anchor[r].astype(np.uint8).tobytes(), _narrow(q))
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema)], schema=schema)
                    k += 1

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            on = np.flatnonzero(np.frombuffer(r["anchors"], np.uint8))
            ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
            q = _wide(r["q"], len(ids), r["dim"])[on]
            cols = [(r["block"] << PLACE_BITS) + on, np.full(len(on), r["dim"], np.int32), ids[on], labels[on]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([_narrow(x) for x in q], pa.binary())], names=["row", "dim", "id", "label", "q"])


def _tiles(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << TASK_BITS
        waiting: dict[int, list] = {}

        def tile(dim: int) -> pa.RecordBatch:
            nonlocal k
            rows, ids, labels, q = zip(*waiting.pop(dim))
            q = np.array([_wide(x, 1, dim)[0].astype(np.int64) for x in q]).reshape(len(ids), dim)
            out = (k, dim, *(np.array(x, "<i8").tobytes() for x in (rows, ids, labels)), _narrow(q))
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema)], schema=schema)

        for batch in batches:
            for row, dim, i, label, q in zip(*(c.to_pylist() for c in batch.columns)):
                held = waiting.setdefault(dim, [])
                held.append((row, i, label, q))
                if len(held) == TILE_ANCHORS:
                    yield tile(dim)
        for dim in [*waiting]:
            yield tile(dim)

    return run


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, held to MOST."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 53:
        kind = np.float32 if top < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    if top <= MOST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows with their lists of numbers as arrays."""
    for k in range(batch.num_rows):
        row = {}
        for n, c in zip(batch.schema.names, batch.columns):
            row[n] = c[k].values.to_numpy() if pa.types.is_list(c.type) else c[k].as_py()
        yield row


def _hits(r: dict, same: bool):
    """A pair of block and tile: (window, row of the block, score) of all that lies in a window's bounds. Windows are
    sorted by slot."""
    ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
    mine, rows = np.frombuffer(r["t_labels"], "<i8"), np.frombuffer(r["t_rows"], "<i8")
    slot, lo, hi = r["slot"], r["lo"], r["hi"]
    n = np.bincount(slot, minlength=len(mine))
    first = np.cumsum(n) - n
    on = np.flatnonzero(n)
    low, high = np.minimum.reduceat(lo, first[on]), np.maximum.reduceat(hi, first[on])
    q = _wide(r["q"], len(ids), r["dim"])
    s = scores(_wide(r["t_q"], len(mine), r["dim"])[on], q)
    ok = (mine[on][:, None] == labels[None, :]) == same
    ok &= (s >= low[:, None]) & (s <= high[:, None])
    itself = rows[on] - (r["block"] << PLACE_BITS)
    own = np.flatnonzero((itself >= 0) & (itself < len(ids)))
    ok[own, itself[own]] = False
    a, b = np.nonzero(ok)
    s = s[a, b]
    a = on[a]
    for j in range(int(n.max(initial=0))):
        has = n[a] > j
        w = first[a[has]] + j
        x = s[has]
        inside = (x >= lo[w]) & (x <= hi[w])
        yield w[inside], b[has][inside], x[inside]


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of (keys..., n) with n added for equal keys."""
    t = np.concatenate(parts, axis=1)
    t = t[:, np.lexsort(t[-2::-1])]
    new = np.concatenate([[True], (t[:-1, 1:] != t[:-1, :-1]).any(axis=0)])
    at = np.flatnonzero(new)
    return np.concatenate([t[:-1, at], np.add.reduceat(t[-1], at)[None, :]])


def _counted(same: bool, schema: pa.Schema):
    """Pairs to counts of each window's digits, added within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(_merged(parts), schema)], schema=schema)

        for batch in batches:
            for r in _rows(batch):
                base, shift, hi, slot, w = (r[c] for c in ("base", "shift", "hi", "slot", "w"))
                for k, _, x in _hits(r, same):
                    digit = (hi[k] - x - base[k]) >> shift[k]
                    fits = (digit >= 0) & (digit < 1 << DIGIT)
                    keys, n = np.unique((k[fits] << DIGIT) + digit[fits], return_counts=True)
                    if len(keys):
                        k = keys >> DIGIT
                        parts.append(np.array([np.full(len(k), r["tile"]), slot[k], w[k], keys & ((1 << DIGIT) - 1), n]))
                        held += len(k)
            if held > HELD:
                parts = [_merged(parts)]
                held = parts[0].shape[1]
                if held > HELD // 2:
                    yield out()
                    parts, held = [], 0
        if parts:
            yield out()

    return run


def _first(parts: list[np.ndarray], k: int) -> np.ndarray:
    """The first k rows of each window of rows (tile, slot, w, score, id)."""
    t = np.concatenate(parts, axis=1)
    t = t[:, np.lexsort((t[4], -t[3], t[2], t[1], t[0]))]
    at = np.flatnonzero(np.concatenate([[True], (t[:3, 1:] != t[:3, :-1]).any(axis=0)]))
    rank = np.arange(t.shape[1]) - np.repeat(at, np.diff(np.append(at, t.shape[1])))
    return t[:, rank < k]


def _gathered(same: bool, k: int, schema: pa.Schema):
    """Pairs to the rows that a window keeps, the first k of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(_first(parts, k), schema)], schema=schema)

        for batch in batches:
            for r in _rows(batch):
                ids = np.frombuffer(r["ids"], "<i8")
                last, hi, slot, w = (r[c] for c in ("last", "hi", "slot", "w"))
                for x, b, s in _hits(r, same):
                    stays = hi[x] - s <= last[x]
                    x, b, s = x[stays], b[stays], s[stays]
                    if len(x):
                        parts.append(np.array([np.full(len(x), r["tile"]), slot[x], w[x], s, ids[b]]))
                        held += len(x)
                if held > HELD:
                    parts = [_first(parts, k)]
                    held = parts[0].shape[1]
                    if held > HELD // 2:
                        yield out()
                        parts, held = [], 0
        if parts:
            yield out()

    return run


class Miner:
    """The blocks and tiles of a table, and selections over all their pairs."""

    def __init__(self, rows: DataFrame, anchor: Column, scale: float = SCALE):
        self.spark = spark = common.ship(rows.sparkSession)
        df = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NAMELESS)).alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("v"))
        whole = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is greater
        df = df.where(F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
        self.blocks = common.written(df.mapInArrow(common.tidy(_blocks(scale, self.arrow(BLOCK))), BLOCK))
        anchors = self.blocks.mapInArrow(common.tidy(_anchors), ANCHOR)
        size = self.blocks.select(F.max("top"), F.max("dim"), F.sum("n_anchors")).first()
        #: No score is greater.
        self.most = min(MOST, (size[0] or 0) ** 2 * (size[1] or 0))
        self.tiles = common.written(anchors.repartition(max(1, -(-(size[2] or 0) // TILE_ANCHORS))).mapInArrow(common.tidy(_tiles(self.arrow(TILE))), TILE))

    def arrow(self, schema: str) -> pa.Schema:
        return common.arrow_schema(self.spark, schema)

    def slots(self) -> DataFrame:
        """(tile, slot, anchor_id)"""

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    ids = np.frombuffer(r["ids"], "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["tile"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["tile", "slot", "anchor_id"])

        return self.tiles.select("tile", "ids").mapInArrow(run, "tile long, slot int, anchor_id long")

    def pairs(self, windows: DataFrame) -> DataFrame:
        """Blocks beside the tiles that have windows, and those windows."""
        n = common.partitions(self.blocks)
        state = ("slot", "w", "lo", "hi", "base", "shift", "last")
        by = windows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct(*state))).alias("windows"))
        by = by.select("tile", *[F.col(f"windows.{c}").cast("array<long>").alias(c) for c in state])
        tiles = self.tiles.join(by, "tile").select("tile", "dim", F.col("rows").alias("t_rows"), F.col("labels").alias("t_labels"), F.col("q").alias("t_q"), *state)
        tiles = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        blocks = self.blocks.select("block", "dim", "ids", "labels", "q").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
        return blocks.repartition(n, "dim", "part").join(tiles, ["dim", "part"])

    def select(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(tile, slot, w, rank, id, score): the first k rows of each window (tile, slot, w, lo, hi), rank from 1."""
        span = F.col("hi") - F.col("lo")
        bits = F.length(F.bin(span)).cast("long")
        state = windows.select("tile", "slot", "w", "lo", "hi", F.lit(0).cast("long").alias("base"), F.greatest(F.lit(0).cast("long"), bits - DIGIT).alias("shift"), F.lit(0).cast("long").alias("before"), span.alias("last"), F.lit(False).alias("done"))
        state = common.cut(state)
        while not state.where("NOT done").isEmpty():
            state = common.cut(self.narrowed(state, k, same))
        found = self.pairs(state).mapInArrow(common.tidy(_gathered(same, k, self.arrow(HIT))), HIT)
        rank = F.row_number().over(Window.partitionBy("tile", "slot", "w").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def narrowed(self, state: DataFrame, k: int, same: bool) -> DataFrame:
        """The state after one more digit: base is the distance at which the bucket of the kth row begins, before how many
        rows come before it, last the greatest distance that is gathered."""
        key = ["tile", "slot", "w"]
        counts = self.pairs(state.where("NOT done")).mapInArrow(common.tidy(_counted(same, self.arrow(COUNT))), COUNT)
        counts = counts.groupBy(*key, "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("digit"))
        counts = counts.withColumn("upto", upto).join(state.select(*key, "before"), key)
        kth = counts.where(F.col("before") + F.col("upto") >= k).groupBy(*key).agg(F.min(F.struct("digit", "upto", "n")).alias("kth"))
        x, reached = state.join(kth, key, "left"), F.col("kth").isNotNull() & ~F.col("done")
        base = F.col("base") + F.call_function("shiftleft", F.col("kth.digit").cast("long"), F.col("shift").cast("int"))
        end = base + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift").cast("int")) - 1
        few = (F.col("before") + F.col("kth.upto") <= ENOUGH * k) | (F.col("shift") == 0)
        return x.select(
            *key,
            "lo",
            "hi",
            F.when(reached, base).otherwise(F.col("base")).alias("base"),
            F.when(reached & ~few, F.greatest(F.lit(0).cast("long"), F.col("shift") - DIGIT)).otherwise(F.col("shift")).alias("shift"),
            F.when(reached, F.col("before") + F.col("kth.upto") - F.col("kth.n")).otherwise(F.col("before")).alias("before"),
            F.when(reached, F.least("last", end)).otherwise(F.col("last")).alias("last"),
            (F.col("done") | F.col("kth").isNull() | few).alias("done"),
        )


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = SCALE) -> DataFrame:
    """rows: vec_id, label, embedding. For each row that is an anchor its first rows of the same label, and beside each of
    these the first rows of other labels whose score is `low` percent of the positive's or more, and no more than it."""
    miner = Miner(rows, anchor, scale)
    every = miner.slots().select("tile", "slot", F.lit(0).alias("w"), F.lit(-miner.most).cast("long").alias("lo"), F.lit(miner.most).cast("long").alias("hi"))
    best = common.cut(miner.select(every, positives, True).select("tile", "slot", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low percent, rounded up, of numbers of any size
    s = F.col("positive_score")
    least = F.expr("(positive_score - pmod(positive_score, 100)) div 100") * low + F.ceil(F.pmod(s, F.lit(100)) * low / 100).cast("long")
    windows = best.select("tile", "slot", "w", least.alias("lo"), s.alias("hi")).where("lo <= hi")
    found = miner.select(windows, negatives, False)
    out = found.join(best, ["tile", "slot", "w"]).join(miner.slots(), ["tile", "slot"])
    named = lambda c, to: F.when(F.col(c) != NAMELESS, F.col(c)).alias(to)
    return out.select(named("anchor_id", "anchor_id"), named("positive_id", "positive_id"), F.col("rank").cast("int").alias("rank"), named("id", "negative_id"), "positive_score", F.col("score").alias("negative_score"))
