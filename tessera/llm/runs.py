"""Runs of repeated words: maximal periodic stretches by Karp-Miller-Rosenberg naming.

Level k names the stretches of 2**k words that begin at each place: equal stretches of a document have one name, made from
the pair of names of their halves. A stretch that its document has once only needs no name, as nothing can equal it, so
levels thin out quickly and end where nothing repeats. How far two places agree, forward or backward, is read off by
descending levels.

A run of period p and length L has L - p places that equal the place p further on, and L - p is step(p) at least. So a grid of
that step meets each run of period p, and the pair (i, i + p) at the grid's place agrees forward or backward over half
a step: one comparison of names on that level leaves few candidates, which are extended to both sides. A multiple of the
smallest period gives the same stretch, of which the smallest one is kept.

All places of many documents are named, compared and extended in one vector operation; a document is never split, so a
worker holds 4 bytes for each word and level of its longest document.

Defined cases: words are separated by ASCII white space; a null or empty text, or one of white space only, has no words,
no runs and an empty collapsed text; repeated rows are answered each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of the shortest run.
SHORTEST = 12
#: Bytes of texts that are named together, unless one text has more.
TOGETHER = 3_000_000
#: Pairs that are compared at a time.
PAIRS = 500_000

SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 to c - 1 for each count c."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _named(key: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of n places: those of equal keys where two places at least have them, else one of their own below 0."""
    out = -1 - np.arange(n, dtype=np.int32)
    if len(key):
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        group = np.cumsum(new) - 1
        again = size[group] > 1
        out[at[order[again]]] = group[again]
    return out


def levels(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Names on each level that has an equal pair. doc: the document of each place, below 0 between documents."""
    n, at = len(codes), np.flatnonzero(doc >= 0)
    key = doc[at].astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes[at]
    out = [_named(key, at, n)]
    while True:
        last, width = out[-1], 1 << (len(out) - 1)
        at = np.flatnonzero(last >= 0)
        if not len(at):
            return out[:-1]
        at = at[at + width < n]
        at = at[last[at + width] >= 0]
        out.append(_named(last[at].astype(np.int64) * n + last[at + width], at, n))


def forward(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on."""
    far = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        far += (names[k][i + far] == names[k][j + far]).astype(np.int64) << k
    return far


def backward(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j, for i below j."""
    far = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = i - far - (1 << k), j - far - (1 << k)
        far += ((a >= 0) & (names[k][a] == names[k][b])).astype(np.int64) << k
    return far


def step(p: np.ndarray, shortest: int) -> np.ndarray:
    return np.maximum(np.maximum(p, shortest - p), 1)


def _grids(first: np.ndarray, sizes: np.ndarray, periods: np.ndarray, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs' first places and periods: the grids of the ascending periods over documents, about PAIRS at a time."""
    fits = np.searchsorted(periods, sizes // 2, "right")  # periods that a document may have
    d, p = np.repeat(np.arange(len(sizes)), fits), periods[_ramp(fits)]
    g = step(p, shortest)
    counts = np.maximum(0, (sizes[d] - p - 1) // g + 1)
    total = np.cumsum(counts)
    a = 0
    while a < len(d):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        c = counts[a:b]
        yield np.repeat(first[d[a:b]], c) + _ramp(c) * np.repeat(g[a:b], c), np.repeat(p[a:b], c)
        a = b


def find(codes: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of documents whose words have these codes, one document after the other: document, start within it, length
    and smallest period, sorted by document, start and period."""
    none = np.zeros(0, np.int64)
    # a place between documents, which equals nothing, ends what is compared
    first = np.cumsum(sizes + 1) - sizes - 1
    n = int(sizes.sum()) + len(sizes)
    doc = np.full(n, -1, np.int32)
    place = np.repeat(first, sizes) + _ramp(sizes)
    doc[place] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    spread = np.zeros(n, np.int64)
    spread[place] = codes
    names = levels(spread, doc) if len(codes) else []
    if not names:
        return none, none, none, none
    periods = np.arange(1, int(sizes.max()) // 2 + 1)
    half = -(-step(periods, shortest) // 2)
    level = np.frexp(half.astype(np.float64))[1] - 1  # the greatest k with 2**k in half a step
    starts, ends, found = [none], [none], [none]
    for k, on in enumerate(names):
        some = np.unique(doc[on >= 0])
        some = some[(sizes[some] >= shortest) & (sizes[some] > 1)]
        if not len(some):
            continue
        for i, p in _grids(first[some], sizes[some], periods[level == k], shortest):
            j, w = i + p, 1 << k
            near = (on[i] == on[j]) | ((i >= w) & (on[i - w] == on[j - w]))
            i, j, p = i[near], j[near], p[near]
            after, before = forward(names, i, j), backward(names, i, j)
            long = after + before >= step(p, shortest)
            starts.append((i - before)[long])
            ends.append((j + after)[long])
            found.append(p[long])
    start, end, p = np.concatenate(starts), np.concatenate(ends), np.concatenate(found)
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[least], end[least], p[least]
    order = np.lexsort((p, start))
    start, end, p = start[order], end[order], p[order]
    d = np.searchsorted(first, start, "right") - 1
    return d, start - first[d], end - start, p


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.filter(pa.array(full)), np.diff(ends[offsets])


def _answers(ids: pa.Array, texts: pa.Array, shortest: int, schema: pa.Schema) -> pa.RecordBatch:
    words, sizes = split(texts)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    d, start, length, period = find(codes, sizes, shortest)
    ends = np.cumsum(sizes)
    if len(d):
        at = ends[d] - sizes[d] + start
        covers = np.zeros(len(codes) + 1, np.int64)
        np.add.at(covers, at + period, 1)
        np.add.at(covers, at + length, -1)
        stays = np.cumsum(covers[:-1]) == 0
        words = words.filter(pa.array(stays))
        ends = np.concatenate([[0], np.cumsum(stays)])[ends]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), words)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(sizes)))])
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
    collapsed = pc.binary_join(lists, pa.scalar(" ", words.type)).cast(schema.field("collapsed").type)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs).cast(schema.field("runs").type), collapsed], schema=schema)


def _found(shortest: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            total, a = np.cumsum(size), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + TOGETHER, "right")))
                yield _answers(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), shortest, schema)
                a = b

    return run


def found(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Per document its runs of `shortest` words and two periods at least, and its text without repetitions: the words that
    no run has beyond its first period, joined by one space."""
    spark = common.ship(docs.sparkSession)
    df = common.only(docs, doc_id="long", text="string")
    return df.mapInArrow(common.tidy(_found(shortest, common.arrow_schema(spark, SCHEMA))), SCHEMA)


def longest(runs: Column) -> Column:
    """The run of the greatest length; of several, that of the smallest start, then period."""
    key = lambda r: F.struct(-r["length"], r["start"], r["period"])
    return F.array_min(F.transform(runs, lambda r: F.struct(key(r).alias("key"), r.alias("run"))))["run"]


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one, and checksums of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    df = found.withColumn("best", longest(F.col("runs")))
    return df.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which those whose checksum ends in 0 repeat a part of theirs up to their end: of n words, that from place
    a on becomes a cycle of p words, a and p being taken from crc32 of the id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    df = common.only(docs, doc_id="long", text="string").withColumn("h", h)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    df = df.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    df = df.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    cycled = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return df.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))
