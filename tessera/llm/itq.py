"""Near copies among vectors by iterative quantisation.

A sample's mean is taken out, and a rotation learned on it makes the signs of a vector's rotated components a
balanced binary code. Codes are cut into substrings, one Hamming table each: vectors that agree in a whole substring
meet in its table. Pairs that meet, and whose whole codes are near, are reranked by the cosine of the original vectors
in double precision. How long a substring is and how many there are is found on the sample, whatever shape the vectors'
cloud has: there are as many as pairs at the threshold, made from vectors of the sample, need for the recall, and of all
lengths that is taken which costs least in rows of tables and in comparisons of vectors that meet by chance.

Result: (id, n_links, component_id, kept) by cosine >= 0.9, a row for each vector. Equal vectors are one class that is
searched once.

The model is fitted on at most SAMPLE vectors of the least hashes of their contents; all vectors are indexed.
A pair at exactly 0.9 is met with a probability of RECALL, and of more above that.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor
do vectors of different lengths with each other; repeated rows, rows of one id with different vectors and rows without
an id are vectors of their own (links.py); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, links

COSINE = 0.9
#: Bits of a substring (from, below), the recall at the threshold, and tables at most.
WIDTHS, RECALL, TABLES = (4, 33), 0.985, 768
#: Bits and random pairs that chances are estimated on, and what a row of a table costs, in comparisons of two codes.
BITS, STRANGERS, ROW = 512, 400_000, 30.0
#: Pairs of the sample that the driver compares at once.
AT_ONCE = 10_000
#: Vectors of the sample at most, those that rotations are fitted on, those that the recall is measured on, and rounds of fitting.
SAMPLE, FITTED, PROBED, ROUNDS = 10_000, 4_000, 2_000, 20
#: Components of the longest vectors whose rotation is learned; longer ones are cut into parts of this many.
PART = 512
#: Lengths of vectors that have models at most, the commonest; all vectors of another length, or of one that so few have, meet.
LENGTHS, ALL = 64, 64


class Model:
    """Projections to bits behind the mean; tables x width of them count, and codes at most `most` bits apart."""

    def __init__(self, x: np.ndarray, n: int, cosine: float = COSINE, seed: int = 7):
        """x: unit vectors of the sample; n: all vectors."""
        rng = np.random.default_rng(seed)
        self.mean = x.mean(0)
        self.out = np.zeros((x.shape[1], 0))
        u = np.linalg.svd((x - self.mean).T @ (x - self.mean) / max(len(x), 1))[0]
        probed = x[rng.permutation(len(x))[:PROBED]]
        pairs = [(probed, neighbours(probed, cosine, rng)), (probed, towards(probed, cosine, rng))]
        self._grow(x, u, BITS, rng)
        # bits that differ: in pairs at the threshold, and in pairs below it
        bits = (x - self.mean) @ self.out[:, :BITS] >= 0
        differ = [((a - self.mean) @ self.out[:, :BITS] >= 0) ^ ((b - self.mean) @ self.out[:, :BITS] >= 0) for a, b in pairs]
        i, j = rng.integers(0, len(x), (2, STRANGERS))
        apart = np.concatenate([(x[i[k : k + AT_ONCE]] * x[j[k : k + AT_ONCE]]).sum(1) < cosine for k in range(0, STRANGERS, AT_ONCE)])
        i, j = (k[(i != j) & apart] for k in (i, j))
        packed = np.packbits(bits, axis=1)
        strange = np.concatenate([np.bitwise_count(packed[i[k : k + AT_ONCE]] ^ packed[j[k : k + AT_ONCE]]).sum(1, dtype=np.int64) for k in range(0, STRANGERS, AT_ONCE)]) / BITS
        least = None
        for width in range(*WIDTHS):
            tables = max(needed(meeting(d, width)) for d in differ)
            cost = tables * (ROW + n * float(((1 - strange) ** width).sum()) / STRANGERS)
            if tables <= TABLES and (least is None or cost < least):
                least, self.width = cost, width
        apart = []
        met = [np.zeros(len(probed), bool) for _ in pairs]
        self.tables = 0
        while self.tables < TABLES and min(m.mean() for m in met) < RECALL:
            more = min(4, TABLES - self.tables)
            self._grow(x, u, (self.tables + more) * self.width, rng)
            both = [tuple(codes(v, self, more, self.tables) for v in pair) for pair in pairs]
            met = [m | (a == b).any(1) for m, (a, b) in zip(met, both)]
            apart.append([np.bitwise_count(a ^ b).sum(1, dtype=np.int64) for a, b in both])
            self.tables += more
        self.out = self.out[:, : self.tables * self.width]
        total = np.concatenate([sum(part) for part in zip(*apart)])
        self.most = int(np.ceil(max(total.mean() + 4 * total.std(), np.quantile(total, 0.999))))

    def _grow(self, x: np.ndarray, u: np.ndarray, bits: int, rng) -> None:
        """Rotations, each learned from a start of its own, until there are enough bits."""
        dim = x.shape[1]
        c = min(dim, PART)
        x = x[:FITTED] - self.mean
        while self.out.shape[1] < bits:
            r = np.linalg.qr(rng.standard_normal((c, c)))[0]
            # the main directions are all kept, so angles are too
            base = u[:, :c] if c == dim else np.linalg.qr(rng.standard_normal((dim, c)))[0]
            v = x @ base
            for _ in range(ROUNDS):
                b = np.where(v @ r >= 0, 1.0, -1.0)
                s, _, st = np.linalg.svd(b.T @ v)
                r = (s @ st).T
            self.out = np.c_[self.out, (base @ r)[:, rng.permutation(c)]]


def neighbours(x: np.ndarray, cosine: float, rng) -> np.ndarray:
    """For each unit vector one at the cosine, in any direction."""
    e = rng.standard_normal(x.shape)
    return _at(x, e, cosine)


def towards(x: np.ndarray, cosine: float, rng) -> np.ndarray:
    """For each unit vector one at the cosine, in the direction of another one."""
    return _at(x, x[rng.permutation(len(x))] + 1e-3 * rng.standard_normal(x.shape), cosine)


def _at(x: np.ndarray, e: np.ndarray, cosine: float) -> np.ndarray:
    e = e - (e * x).sum(1, keepdims=True) * x
    length = np.sqrt((e * e).sum(1, keepdims=True))
    return np.where(length > 1e-9, cosine * x + np.sqrt(1 - cosine * cosine) * e / np.maximum(length, 1e-9), x)


def meeting(differ: np.ndarray, width: int) -> np.ndarray:
    """The chance of each pair to agree in a whole substring, from the bits in which it differs."""
    alone = (1 - differ.mean(1)) ** width  # were the bits of a substring independent
    n = differ.shape[1] // width
    together = float((~differ[:, : n * width].reshape(len(differ), n, width).any(2)).mean())
    return np.minimum(1.0, alone * together / max(float(alone.mean()), 1e-300))


def needed(meet: np.ndarray) -> int:
    """Tables with which pairs that meet in each with these chances meet in some with RECALL on average."""
    low, high = 1, 2 * TABLES
    while low < high:
        t = (low + high) // 2
        if 1 - float(((1 - meet) ** t).mean()) >= RECALL:
            high = t
        else:
            low = t + 1
    return low


def vector(values) -> np.ndarray | None:
    """The vector in double precision, or None if it links with nothing."""
    if values is None or not len(values) or any(x is None for x in values):
        return None
    v = np.asarray(values, np.float64)
    return v + 0.0 if np.isfinite(v).all() and v.any() else None


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [None if (v := vector(x)) is None else v.tobytes() for x in batch.column(1).to_pylist()]
        h = [xxhash.xxh3_128_intdigest(r) if r is not None else 0 for r in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(x >> 64) - (1 << 63) for x in h], pa.int64()), pa.array([(x & (2**64 - 1)) - (1 << 63) for x in h], pa.int64()), pa.array([len(r) // 8 if r else 0 for r in raw], pa.int64()), pa.array(raw, pa.binary())], names=["id", "h1", "h2", "n", "item"])


def codes(x: np.ndarray, model: Model, tables: int, begin: int = 0) -> np.ndarray:
    """Substrings of the codes of unit vectors, as 32-bit integers: vectors x tables."""
    w = model.width
    place = np.uint32(1) << np.arange(w, dtype=np.uint32)
    out = np.empty((len(x), tables), np.uint32)
    for at in range(0, len(x), 200):
        bits = (x[at : at + 200] - model.mean) @ model.out[:, begin * w : (begin + tables) * w] >= 0
        out[at : at + 200] = bits.reshape(-1, tables, w).astype(np.uint32) @ place
    return out


def _tables(models: dict[int, Model]) -> int:
    """Substrings of all codes, an odd number of them, so that with the length before them they fill 64-bit words."""
    most = max([1, *(m.tables for m in models.values())])
    return most + 1 - most % 2


def _codes(sent):
    """The length of a vector, and its substrings; vectors whose length has no model have one code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            n = batch.column(1).to_numpy()
            items = batch.column(2).to_pylist()
            code = np.zeros((len(items), 1 + _tables(models)), np.uint32)
            code[:, 0] = n
            for dim in np.unique(n):
                if (model := models.get(int(dim))) is not None:
                    m = np.flatnonzero(n == dim)
                    code[m, 1 : model.tables + 1] = codes(unit(np.stack([np.frombuffer(items[k], np.float64) for k in m])), model, model.tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in code], pa.binary())], names=["id", "code"])

    return run


def _buckets(sent):
    """One bucket row for each table of a vector (id, code); lengths of vectors have tables of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, code = batch.column(0).to_numpy(), links.matrix(batch.column(1)).view(np.uint32)
            for dim in np.unique(code[:, 0]).tolist():
                m = np.flatnonzero(code[:, 0] == dim)
                tables = models[dim].tables if dim in models else 1
                key = code[m, 1 : tables + 1].astype(np.int64) | (dim << 32)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(m))), pa.array(key.ravel()), pa.array(np.repeat(ids[m], tables))], names=["t", "key", "id"])

    return run


def _candidate(most: dict[int, int]):
    """most: bits in which codes may differ, by the length of the vectors."""

    def candidate(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.zeros(0, bool)
        a, b = a.view(np.uint32).reshape(len(a), -1), b.view(np.uint32).reshape(len(b), -1)
        x = a[:, 1:] ^ b[:, 1:]
        dims, place = np.unique(a[:, 0], return_inverse=True)
        limit = np.array([most.get(int(d), 0) for d in dims])[place]
        return ((x == 0).argmax(1) == t) & (np.bitwise_count(x).sum(1, dtype=np.int64) <= limit)

    return candidate


def _similar(cosine: float):
    def similar(t: pa.Table) -> np.ndarray:
        x = unit(np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in t["item"]]))
        return x @ x.T >= cosine

    return similar


def join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) for each vector."""
    spark = common.ship(vectors.sparkSession)
    df = common.only(vectors, **{id_col: "long", vector_col: "array<double>"})
    rows = common.cut(df.mapInArrow(_hashes, "id long, h1 long, h2 long, n long, item binary"))
    known, shared_ids = links.members(rows.select("id", "h1", "h2", "n"))
    classes = common.cut(known.where("n > 0").groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.sum("copies").alias("size"), F.min("n").alias("n")))
    items = classes.join(rows.where("n > 0").groupBy("h1", "h2").agg(F.first("item").alias("item")), ["h1", "h2"])
    items = common.cut(items.select(F.col("rep").alias("id"), "h1", "size", "n", "item"))
    lengths = items.groupBy("n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > ALL).orderBy(F.desc("k"), "n").limit(LENGTHS).collect()
    models = {}
    for r in lengths:
        picked = items.where(F.col("n") == r.n).orderBy("h1", "id").limit(SAMPLE).select("item").collect()
        models[r.n] = Model(unit(np.stack([np.frombuffer(x.item, np.float64) for x in picked])), r.k, cosine)
    sent = spark.sparkContext.broadcast(models)
    coded = common.cut(items.select("id", "n", "item").mapInArrow(_codes(sent), "id long, code binary"))
    candidate = _candidate({d: m.most for d, m in models.items()})
    marked = links.marks(coded.mapInArrow(_buckets(sent), "t int, key long, id long"), coded, candidate)
    marked = marked.groupBy("id").agg(F.collect_list(F.struct("t", "key")).alias("at"))
    found = items.join(coded, "id").join(marked, "id").select("id", "size", "item", "code", F.explode("at").alias("x"))
    parts = links.counted(found.select("x.*", "id", "size", "item", "code"), candidate, _similar(cosine))
    return links.listed(links.settled(parts, known, classes, shared_ids))
