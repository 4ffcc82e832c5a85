"""Counting links and components from hash buckets, without listing the pairs of a bucket.

Rows share a bucket (t, key) where a hash table t gives them one key. A pair belongs to the first table that
brings it together, so it is looked at once. Buckets of more than BLOCK rows are split into blocks by a hash
of the id; each pair of blocks is a group of its own, so no task holds a whole hot bucket, and the work of a
bucket spreads over the cluster.

Step one looks at codes only and marks the rows that have a candidate in a bucket. Step two ships whole
vectors or sets to the marked buckets only, checks each candidate exactly, and returns counts and local
components: never more rows than it got.

Rows of one content are one class, which is joined once. A row is known by its id where that is its own, and
else (no id, or an id of several contents) by 64 bits of a hash of id and content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a block of codes, and of one of whole vectors or sets.
BLOCK, WHOLE_BLOCK = 1024, 384
#: Pairs that are compared in one vector operation.
PAIRS = 100_000
#: A class of more than this share of all rows is broadcast; so there are fewer of them than its inverse.
HEAVY = 1 / 4096

KEYS = ["t", "key", "bi", "bj"]
MARK = "t int, key long, id long"


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows (t, key, n, id, ...) of buckets of n rows, once for each other block of their bucket."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    df = rows.withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("id", F.lit(17)), F.col("nb")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return df.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("n", "nb", "other")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of buckets of two rows or more, with the number of these."""
    return rows.join(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["t", "key"])


def _pairs(low: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each place with those from low on, counts of them, in slices of about PAIRS."""
    total = np.cumsum(counts)
    a = 0
    while a < len(counts):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        c = counts[a:b]
        yield np.repeat(np.arange(a, b), c), np.repeat(low[a:b], c) + _ramp(c)
        a = b


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def matrix(col) -> np.ndarray:
    """A column of equally long binary values of 64-bit integers as rows of a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    if not n:
        return np.zeros((0, 1), np.uint64)
    offsets = np.frombuffer(col.buffers()[1], np.int32, n + 1, 4 * col.offset)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint64).reshape(n, -1) if data.size else np.zeros((n, 0), np.uint64)


def _marker(candidate: Callable):
    """For runs of rows sorted by KEYS and block: those with a candidate, as MARK rows."""
    out = pa.schema([("t", pa.int32()), ("key", pa.int64()), ("id", pa.int64())])

    def marks(t: pa.Table) -> pa.RecordBatch:
        cols = [t[k].to_numpy() for k in KEYS]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        first = np.flatnonzero(new)
        n = np.diff([*first, t.num_rows])
        early = t["blk"].to_numpy() == cols[2]
        same = cols[2] == cols[3]
        end = np.repeat(first + n, n)
        second = np.repeat(first + np.add.reduceat(early.astype(np.int64), first), n)  # where the other block begins
        low = np.where(same, np.arange(t.num_rows) + 1, np.where(early, second, end))
        ids, code, table = t["id"].to_numpy(), matrix(t["code"]), cols[0]
        hit = np.zeros(t.num_rows, bool)
        for i, j in _pairs(low, end - low):
            ok = candidate(code[i], code[j], table[i])
            hit[i[ok]] = True
            hit[j[ok]] = True
        m = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([pa.array(cols[0][m], pa.int32()), pa.array(cols[1][m]), pa.array(ids[m])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < 20_000:
                continue
            t = pa.concat_tables(held)
            cols = [t[k].to_numpy() for k in KEYS]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
            if len(change):
                at = int(change[-1]) + 1
                yield marks(t.slice(0, at).combine_chunks())
                t = t.slice(at)
            held, rows = [t], t.num_rows
        if rows:
            yield marks(pa.concat_tables(held).combine_chunks())

    return run


def marks(nodes: DataFrame, coded: DataFrame, candidate: Callable) -> DataFrame:
    """Bucket rows (t, key, id) that have a candidate there. coded: (id, code). candidate(codes, codes, t): which
    pairs count, and first meet in t. Codes go to rows that share a bucket only."""
    shared = _sized(nodes).join(coded.select("id", "code"), "id")
    df = _dealt(shared, BLOCK).select(*KEYS, "blk", "id", "code")
    dealt = df.repartition(common.partitions(df), *KEYS).sortWithinPartitions(*KEYS, "blk")
    return dealt.mapInArrow(common.tidy(_marker(candidate)), MARK).distinct()


PART = "id long, links long, to long"


def counted(rows: DataFrame, candidate: Callable, similar: Callable) -> DataFrame:
    """rows: marks with code, size (rows that the id stands for) and item. Returns for each id and group its
    links there, by size of the partners, and the least id that they reach there.
    similar(table) -> square bool matrix of the pairs that really link."""
    df = _dealt(_sized(rows), WHOLE_BLOCK)
    schema = common.arrow_schema(rows.sparkSession, PART)

    def check(t: pa.Table, _: int) -> pa.Table | None:
        n = t.num_rows
        ids, blk, code = t["id"].to_numpy(), t["blk"].to_numpy(), matrix(t["code"])
        i, j = np.nonzero(ids[:, None] < ids[None, :])
        if t["bi"][0] != t["bj"][0]:
            ok = blk[i] != blk[j]
            i, j = i[ok], j[ok]
        ok = np.concatenate([candidate(code[i[a : a + PAIRS]], code[j[a : a + PAIRS]], np.full(len(i[a : a + PAIRS]), t["t"][0].as_py())) for a in range(0, len(i), PAIRS)] or [np.zeros(0, bool)])
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        ok = similar(t)[i, j]
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        size = t["size"].to_numpy()
        links = np.zeros(n, np.int64)
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        least = ids.copy()
        while True:
            low = least.copy()
            np.minimum.at(low, i, least[j])
            np.minimum.at(low, j, low[i])
            if (low == least).all():
                break
            least = low
        m = np.flatnonzero(links)
        return pa.table([pa.array(ids[m]), pa.array(links[m]), pa.array(least[m])], schema=schema)

    return common.grouped(df, KEYS, check, PART)


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for the ids of edges (id, to) that reach a smaller id: component is the least of them.

    Large-star and small-star rounds: a logarithmic number of them, each a few joins and aggregations on the
    edges, which hot ids cannot unbalance beyond what skew handling splits.
    """
    e = common.cut(edges.select(F.greatest("id", "to").alias("u"), F.least("id", "to").alias("v")).where("u != v").distinct())
    seen = _sum(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = common.cut(small.where("u != v").distinct())
        if (now := _sum(e)) == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _sum(e: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes; equal for equal sets."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def members(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows (id, h1, h2, n), one for each row of the input, as (key, id, h1, h2, n, copies), one for each id and
    content; and whether some ids are not their rows' own."""
    one = rows.groupBy("id", "h1", "h2").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    several = common.cut(rows.select("id", "h1", "h2").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 OR id IS NULL").select("id"))
    if several.isEmpty():
        return common.cut(one.select(F.col("id").alias("key"), "*")), False
    flagged = one.join(several.where("id IS NOT NULL").withColumn("shared", F.lit(True)), "id", "left")
    own = F.col("id").isNotNull() & F.col("shared").isNull()
    key = F.when(own, F.col("id")).otherwise(F.xxhash64(F.lit(77), "id", "h1", "h2"))
    return common.cut(flagged.select(key.alias("key"), "id", "h1", "h2", "n", "copies")), True


def settled(parts: DataFrame, known: DataFrame, classes: DataFrame, shared_ids: bool) -> DataFrame:
    """known: what members() returned; classes: (h1, h2, rep, size), rep a key; parts: what counted() returned.
    known with n_links, component_id (the least id of the component, null if it has none) and stays, which is
    true for one key of each component."""
    parts = common.cut(parts)
    links = parts.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    reach = components(parts.select("id", "to")).withColumnRenamed("id", "rep")
    found = classes.join(links, "rep", "left").join(reach, "rep", "left")
    found = common.cut(found.select("h1", "h2", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("c")))
    full, none = known.where("n > 0"), known.where("n = 0")
    total = full.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    on = ["h1", "h2"]
    # classes with more than HEAVY of all rows: at most 1 / HEAVY of them
    heavy = F.broadcast(found.where(F.col("size") > total * HEAVY).drop("size"))
    light = found.where(F.col("size") <= total * HEAVY).drop("size")
    out = full.join(heavy, on).unionByName(full.join(heavy, on, "left_anti").join(light, on))
    out = out.unionByName(none.withColumns({"n_links": F.lit(0).cast("long"), "c": F.col("key")}))
    if not shared_ids:
        return out.select("key", "id", *on, "copies", "n_links", F.col("c").alias("component_id"), (F.col("c") == F.col("key")).alias("stays"))
    first = out.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *on)).alias("x"))
    mine = F.struct(F.col("id").isNull().alias("none"), "id", *on)
    return out.join(first, "c").select("key", "id", *on, "copies", "n_links", F.col("x.id").alias("component_id"), mine.eqNullSafe(F.col("x")).alias("stays"))


def listed(rows: DataFrame) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of the input."""
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("stays"))
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("id", "n_links", "component_id", kept.alias("kept"))
