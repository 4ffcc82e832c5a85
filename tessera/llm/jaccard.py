"""Similarity join of documents on word n-grams by a MinHash LSH forest, checked exactly.

A document is the set of hashes of its runs of five words (one run of all its words if it has fewer). Equal
sets are one class, which is joined once. Each tree of the forest is a trie over signatures of DEEPEST MinHash
values of its own; rows sorted by a prefix of it make runs, the nodes. A document's prefix is matched in each tree
as long as it has to be for its node to have CROWD documents at most, from LEAST values on. Where prefixes are then so
long, over all trees of a document, that a partner of the least similarity would meet it with less than the target
recall, they are shortened from the deepest level upward, node by node, until every document has it. So thin parts of
the tries are matched by short prefixes, and crowded ones, such as those of passages that many documents share, by long
ones. Pairs of a node are compared by their codes, and candidates then by their whole sets.

The result is (id, n_links, component_id, kept), a row for each document, links being other documents with a
Jaccard similarity of 0.8 or more; kept marks the document of the least id of each component.

Defined cases: null texts and those without a word link with nothing; repeated rows are documents of their own,
equal ones, and all come back; so are rows of one id with different texts, and rows without an id, whose
component_id is the least id that the component has, null if it has none (then one of its rows is kept); an empty
table gives no rows; other columns are not read; texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, links

SHINGLE, SIMILARITY = 5, 0.8
#: Trees, values of a signature, and the recall at the least similarity that no document's prefixes fall below.
TREES, DEEPEST, RECALL = 16, 8, 0.99
#: The shortest prefix is that which all trees together need for this recall; documents of a node that isn't taken deeper.
SURE, CROWD = 0.9995, 128

_P = np.uint64(0x9E3779B97F4A7C15)


def depth(trees: int = TREES, deepest: int = DEEPEST, similarity: float = SIMILARITY, recall: float = SURE) -> int:
    """The longest prefix with which pairs at the similarity meet with the recall."""
    d = deepest
    while d > 1 and 1 - (1 - similarity**d) ** trees < recall:
        d -= 1
    return d


_mix = common.mixed


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of words."""
    flat, counts = common.hashed_words(texts)
    runs = np.full(max(len(flat) - SHINGLE + 1, 0), SHINGLE, np.uint64)
    for k in range(SHINGLE):
        runs = runs * _P + flat[k : k + len(runs)]
    runs = _mix(runs)
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(runs[at : at + n - SHINGLE + 1]))
        elif n:
            h = np.full(1, n, np.uint64)
            for k in range(n):
                h = h * _P + flat[at + k]
            out.append(_mix(h))
        else:
            out.append(flat[:0])
        at += n
    return out


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def _signatures(trees: int, deepest: int):
    rng = np.random.default_rng(20_240_601)
    a = rng.integers(1, 2**63, (trees, deepest), np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, (trees, deepest), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            n = np.array([len(s) for s in sets], np.int64)
            halves = [_halves(s) for s in sets]
            sig = np.zeros((len(sets), trees, deepest), np.uint16)
            full = np.flatnonzero(n > 3)  # smaller sets are similar to their equals only
            # runs of sets whose hashes fit in the processor's cache
            for at in np.split(full, np.flatnonzero(np.diff(np.cumsum(n[full]) // 50_000)) + 1):
                if not len(at):
                    continue
                flat = np.concatenate([sets[k] for k in at])
                first = np.concatenate([[0], np.cumsum(n[at])[:-1]])
                for t in range(trees):
                    for k in range(deepest):
                        sig[at, t, k] = (np.minimum.reduceat(flat * a[t, k] + b[t, k], first) >> np.uint64(8)).astype(np.uint16)
            raw, size = sig.tobytes(), 2 * trees * deepest
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in halves], pa.int64()), pa.array([h for _, h in halves], pa.int64()), pa.array(n), pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())],
                names=["id", "h1", "h2", "n", "sig"],
            )

    return run


def _prefixes(sig: np.ndarray, deepest: int) -> np.ndarray:
    """Hashes of the prefixes of 1, 2, ... values: documents x trees x lengths."""
    values = sig.view(np.uint16).reshape(len(sig), -1, deepest).astype(np.uint64)
    out = np.empty(values.shape, np.uint64)
    key = np.broadcast_to(np.arange(values.shape[1], dtype=np.uint64), values.shape[:2])
    for k in range(deepest):
        key = _mix(key * _P + values[:, :, k] + np.uint64(1))
        out[:, :, k] = key
    return out


def _levels(least: int, deepest: int):
    """A row for each tree of a document, with the hashes of its prefixes from the shortest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _prefixes(links.matrix(batch.column(1)), deepest).view(np.int64)
            n, trees, _ = p.shape
            cols = [pa.array(np.repeat(batch.column(0).to_numpy(), trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(p[:, :, d - 1].ravel()) for d in range(least, deepest + 1)], names=["id", "t", *(f"k{d}" for d in range(least, deepest + 1))])

    return run


def _codes(trees: int, least: int, deepest: int):
    """The hash of each tree's node; `at` has the trees where it is deeper than the shortest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _prefixes(links.matrix(batch.column(1)), deepest)
            d = np.full(p.shape[:2], least)
            if batch.num_columns > 2:
                for k, at in enumerate(batch.column(2).to_pylist()):
                    for x in at or ():
                        d[k, x["t"]] = x["depth"]
            code = np.ascontiguousarray(_mix(np.take_along_axis(p, d[:, :, None] - 1, 2)[:, :, 0] + d.astype(np.uint64)))
            raw = code.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[k : k + 8 * trees] for k in range(0, len(raw), 8 * trees)], pa.binary())], names=["id", "code"])

    return run


def forest(sig: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, crowd: int | None = None) -> DataFrame:
    """(id, code): the nodes of each document (id, sig), one hash for each tree."""
    crowd = CROWD if crowd is None else crowd
    least = depth(trees, deepest, similarity)
    over = deeper(sig, similarity, trees, least, deepest, recall, crowd)
    if over is None:
        return sig.select("id", "sig").mapInArrow(common.tidy(_codes(trees, least, deepest)), "id long, code binary")
    at = over.groupBy("id").agg(F.collect_list(F.struct("t", "depth")).alias("at"))
    return sig.select("id", "sig").join(at, "id", "left").mapInArrow(common.tidy(_codes(trees, least, deepest)), "id long, code binary")


def deeper(sig: DataFrame, similarity: float, trees: int, least: int, deepest: int, recall: float, crowd: int) -> DataFrame | None:
    """(id, t, depth) where a document's prefix is longer than the shortest; None if nowhere."""
    if least == deepest:
        return None
    names = [f"k{d}" for d in range(least, deepest + 1)]
    rows = sig.select("id", "sig").mapInArrow(common.tidy(_levels(least, deepest)), "id long, t int, " + ", ".join(f"{k} long" for k in names))
    crowded = common.cut(rows.groupBy("t", names[0]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("t", names[0]))
    if crowded.isEmpty():
        return None
    few = crowded.count() <= common.BROADCAST_IDS
    rows = common.cut(rows.join(F.broadcast(crowded) if few else crowded, ["t", names[0]], "left_semi"))
    # leaves of the crowded nodes, with the sizes of the nodes above them
    leaves = rows.groupBy("t", *names).agg(F.count(F.lit(1)).alias("n"))
    leaves = common.cut(leaves)
    deep = F.lit(deepest)
    for d in range(deepest - 1, least, -1):  # the shortest that isn't crowded comes last
        size = leaves.groupBy("t", f"k{d}").agg(F.sum("n").alias(f"n{d}"))
        leaves = leaves.join(size, ["t", f"k{d}"])
        deep = F.when(F.col(f"n{d}") <= crowd, F.lit(d)).otherwise(deep)
    leaves = common.cut(leaves.select("t", *names, deep.alias("depth")))
    # what a longer prefix takes from the logarithm of the chance to miss a partner, and what there is to take
    miss = {d: float(np.log1p(-(similarity**d))) for d in range(least, deepest + 1)}
    spare = float(np.log1p(-recall)) - trees * miss[least]
    cost = F.create_map(*[x for d in miss for x in (F.lit(d), F.lit(miss[d] - miss[least]))])
    for d in range(deepest, least, -1):
        mine = rows.select("id", "t", names[-1]).join(leaves, ["t", names[-1]])
        short = mine.groupBy("id").agg(F.sum(cost[F.col("depth")]).alias("cost")).where(F.col("cost") > spare + 1e-9).select("id")
        above = common.cut(mine.where(F.col("depth") == d).join(short, "id", "left_semi").select("t", f"k{d - 1}").distinct().withColumn("up", F.lit(True)))
        if above.isEmpty():
            continue
        leaves = common.cut(leaves.join(above, ["t", f"k{d - 1}"], "left").withColumn("depth", F.when(F.col("up"), F.least("depth", F.lit(d - 1))).otherwise(F.col("depth"))).drop("up"))
    return rows.select("id", "t", names[-1]).join(leaves.where(F.col("depth") > least), ["t", names[-1]]).select("id", "t", "depth")


def _first_tree(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether a pair meets in no tree before t."""
    return (a == b).argmax(1) == t if len(a) else np.zeros(0, bool)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket row for each tree of a row (id, code)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = links.matrix(batch.column(1))
        n, trees = code.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(code.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), trees))], names=["t", "key", "id"])


def _halves(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash and the set of each text."""
    for batch in batches:
        sets = shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist())
        halves = [_halves(s) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in halves], pa.int64()), pa.array([h for _, h in halves], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["h1", "h2", "item"])


def _similar(least: float):
    def similar(t: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["item"]]
        n = np.array([len(s) for s in sets])
        both = np.zeros((len(sets), len(sets)))
        _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common_to = np.flatnonzero(count > 1)
        rank = np.full(len(count), -1)
        rank[common_to] = np.arange(len(common_to))
        col, row = rank[place], np.repeat(np.arange(len(sets)), n)
        keep = col >= 0
        col, row = col[keep], row[keep]
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        for a in range(0, len(common_to), 4096):
            lo, hi = np.searchsorted(col, [a, a + 4096])
            m = np.zeros((len(sets), min(4096, len(common_to) - a)), np.float32)
            m[row[lo:hi], col[lo:hi] - a] = 1
            both += m @ m.T
        return both >= least * (n[:, None] + n[None, :] - both) - 1e-9

    return similar


def _settled(docs: DataFrame, similarity: float, trees: int, recall: float) -> tuple[DataFrame, bool]:
    """What links.settled() says of (id, text), and whether some ids are not their rows' own."""
    common.ship(docs.sparkSession)
    df = common.only(docs, doc_id="long", text="string")
    rows = common.cut(df.mapInArrow(common.tidy(_signatures(trees, DEEPEST)), "id long, h1 long, h2 long, n long, sig binary"))
    known, shared_ids = links.members(rows.select("id", "h1", "h2", "n"))
    odd = F.col("id").isNull() | (F.col("key") != F.col("id"))
    classes = known.where("n > 0").groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.sum("copies").alias("size"), F.min("n").alias("n"), F.min(F.when(~odd, F.col("id"))).alias("row"))
    classes = common.cut(classes)
    # a set of fewer than four can only be similar to its equals
    able = common.cut(classes.where("n > 3").join(rows.where("n > 3").groupBy("h1", "h2").agg(F.first("sig").alias("sig")), ["h1", "h2"]).select(F.col("rep").alias("id"), "h1", "h2", "row", "size", "sig"))
    coded = common.cut(forest(able, similarity, trees, DEEPEST, recall))
    marked = links.marks(coded.mapInArrow(common.tidy(_trees), "t int, key long, id long"), coded, _first_tree)
    marked = marked.groupBy("id").agg(F.collect_list(F.struct("t", "key")).alias("at"))
    marked = common.cut(marked.join(able.drop("sig"), "id").join(coded, "id"))
    texts = common.by_ids(df, marked.where("row IS NOT NULL").select(F.col("row").alias("doc_id")), "doc_id", "left_semi").select("text")
    if shared_ids:  # texts that no id leads to
        ids = known.where(odd & F.col("id").isNotNull()).select(F.col("id").alias("doc_id")).distinct()
        texts = texts.union(df.where("doc_id IS NULL").select("text")).union(common.by_ids(df, common.cut(ids), "doc_id", "left_semi").select("text"))
    sets = texts.mapInArrow(common.tidy(_sets), "h1 long, h2 long, item binary").join(marked.select("h1", "h2"), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    items = sets.join(marked, ["h1", "h2"]).select("id", "size", "code", "item", F.explode("at").alias("x")).select("x.*", "id", "size", "code", "item")
    parts = links.counted(items, _first_tree, _similar(similarity))
    return links.settled(parts, known, classes, shared_ids), shared_ids


def join(docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for each document."""
    return links.listed(_settled(docs, similarity, trees, recall)[0])


def _hashed(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = [_halves(x) for x in shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h for h, _ in halves], pa.int64()), pa.array([h for _, h in halves], pa.int64())], names=[*names, "set h1", "set h2"])

    return run


def kept(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the least id, and one of those that repeat it."""
    found, shared_ids = _settled(docs, SIMILARITY, TREES, RECALL)
    found = common.cut(found)
    gone = common.cut(found.where("NOT stays AND key = id").select(F.col("id").alias("doc_id")).distinct())
    again = found.where("copies > 1" + (" OR id IS NULL OR key != id" if shared_ids else ""))
    ids = common.cut(again.where("id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct())
    if not shared_ids and ids.isEmpty():
        return common.by_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    plain = common.by_ids(docs.where("doc_id IS NOT NULL"), ids, "doc_id", "left_anti")
    plain = common.by_ids(plain, gone, "doc_id", "left_anti").select(*docs.columns)
    # rows that their id does not tell apart are told apart by their sets
    rest = common.by_ids(docs, ids, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id IS NULL"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rest = rest.mapInArrow(common.tidy(_hashed(docs.columns)), f"{schema}, `set h1` long, `set h2` long")
    stay = again.where("stays").union(found.where("stays AND id IS NULL")).select(F.col("id").alias("stay id"), F.col("h1").alias("stay h1"), F.col("h2").alias("stay h2")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("stay id")) & (F.col("set h1") == F.col("stay h1")) & (F.col("set h2") == F.col("stay h2"))
    rest = rest.join(stay, same, "left_semi").dropDuplicates(["doc_id", "set h1", "set h2"]).select(*docs.columns)
    return plain.union(rest)
