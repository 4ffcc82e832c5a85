"""Token ids in Simple-8b, a word-aligned code.

A 64-bit word holds a 4-bit selector and as many ids of equal width as its other 60 bits take. Ids are coded
in blocks of BLOCK ids; a shard's index has the byte offset of each block, so any block is decoded by itself,
and all words of one selector are decoded in one vector operation.

Shard layout, little-endian: magic `S8B1`, then u32 number of blocks, u64 number of ids, u32 offsets
of the blocks counted in words (one more than there are blocks), then the words. Selector 0 is the escape: the
word's low 60 bits are a count of ids that follow raw, one in each 64-bit word.

Shards lie in ascending order of documents in a table of rows (shard, data, doc_ids, sizes) that Spark's
writers commit, so lost tasks leave nothing half written.

Defined cases: a null or empty text has only its end id; repeated ids keep all their rows; an empty table has
no shards; other columns are not read; ids up to 64 bits round-trip.
"""

from __future__ import annotations

import re
import struct
import weakref
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"S8B1"
BLOCK = 4096
#: Ids to a word and bits of each, by selector 1 to 14; 0 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // n for n in COUNTS)
#: Ids of a shard at most, unless one document has more.
SHARD_IDS = 2_000_000
#: Parts, and words, whose ids a worker keeps.
MOST = 500_000


_WIDTHS = sorted(set(BITS))
#: For ids below 2**16: how many of the widths are too narrow.
_NEED = np.searchsorted(_WIDTHS, [max(1, k.bit_length()) for k in range(1 << 16)]).astype(np.uint8)


def _choices(ids: np.ndarray) -> np.ndarray:
    """ids: blocks x BLOCK, padded by zeros. The selector with most ids that fits from each place; 0: escape."""
    width = ids.shape[1]
    best = np.zeros(ids.shape, np.uint8)
    if int(ids.max()) < 1 << 16:
        need = _NEED[ids]
    else:
        need = np.zeros(ids.shape, np.uint8)
        for b in _WIDTHS:
            need += (ids >> np.uint64(b)) > 0
    for s in range(len(COUNTS), 0, -1):
        n, level = COUNTS[s - 1], _WIDTHS.index(BITS[s - 1])
        run, have = need <= level, 1  # whether `have` ids from here on fit
        while have < n and run.any():
            step = min(have, n - have)
            new = run.copy()
            new[:, : width - step] &= run[:, step:]
            run, have = new, have + step
        best[run] = s
    return best


def encode(ids: np.ndarray) -> bytes:
    """A shard of the ids (0 or more, of up to 64 bits)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return MAGIC + struct.pack("<IQ", 0, 0) + struct.pack("<I", 0)
    grid = np.zeros((blocks, BLOCK), np.uint64)
    grid.ravel()[: len(ids)] = ids
    length = np.full(blocks, BLOCK, np.int64)
    length[-1] = len(ids) - BLOCK * (blocks - 1)
    chosen = _choices(grid)
    takes = np.array([1, *COUNTS], np.int64)
    # all blocks are walked together, a word of each at a time
    at, alive, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(alive):
        s = chosen[alive, at[alive]]
        steps.append((alive, at[alive].copy(), s))
        at[alive] += takes[s]
        alive = alive[at[alive] < length[alive]]
    row = np.concatenate([x[0] for x in steps])
    order = np.argsort(row, kind="stable")
    row, place, sel = row[order], np.concatenate([x[1] for x in steps])[order], np.concatenate([x[2] for x in steps])[order]
    words_of = np.where(sel == 0, 2, 1)
    pos = np.cumsum(words_of) - words_of
    words = np.zeros(int(words_of.sum()), np.uint64)
    flat = np.concatenate([grid.ravel(), np.zeros(64, np.uint64)])
    begin = row * BLOCK + place
    for s in range(len(COUNTS) + 1):
        m = np.flatnonzero(sel == s)
        if not len(m):
            continue
        if s == 0:
            words[pos[m]] = 1
            words[pos[m] + 1] = flat[begin[m]]
            continue
        word = np.full(len(m), s << 60, np.uint64)
        end = (row[m] + 1) * BLOCK
        for k in range(COUNTS[s - 1]):
            v = flat[begin[m] + k]
            word |= np.where(begin[m] + k < end, v, 0).astype(np.uint64) << np.uint64(k * BITS[s - 1])
        words[pos[m]] = word
    offsets = np.zeros(blocks + 1, np.int64)
    np.add.at(offsets, row + 1, words_of)
    return MAGIC + struct.pack("<IQ", blocks, len(ids)) + np.cumsum(offsets).astype("<u4").tobytes() + words.astype("<u8").tobytes()


def _decode_words(words: np.ndarray) -> np.ndarray:
    """All ids of the words of one block, its padding included."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    k = 0
    escapes = np.flatnonzero(sel == 0)
    while k < len(escapes):  # a raw word may look like an escape: go from each escape past its run
        n = int(words[escapes[k]])
        first = int(escapes[k])
        raw[first + 1 : first + 1 + n] = True
        k = int(np.searchsorted(escapes, first + 1 + n))
    lead = ~raw & (sel == 0)
    takes = np.array([1, *COUNTS, 0], np.int64)[sel]
    takes[raw], takes[lead] = 1, 0
    start = np.cumsum(takes) - takes
    out = np.zeros(int(takes.sum()), np.uint64)
    out[start[raw]] = words[raw]
    plain = ~raw & ~lead
    for s in np.unique(sel[plain]):
        m = np.flatnonzero(plain & (sel == s))
        b = np.uint64(BITS[s - 1])
        mask = np.uint64((1 << BITS[s - 1]) - 1)
        lanes = np.arange(COUNTS[s - 1])
        out[start[m][:, None] + lanes] = (words[m][:, None] >> (lanes.astype(np.uint64) * b)) & mask
    return out


def _header(data: bytes) -> tuple[int, int, np.ndarray, int]:
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b shard")
    blocks, count = struct.unpack_from("<IQ", data, 4)
    return blocks, count, np.frombuffer(data, "<u4", blocks + 1, 16), 16 + 4 * (blocks + 1)


def decode(data: bytes) -> np.ndarray:
    """All ids of a shard."""
    blocks, count, _, at = _header(data)
    if not blocks:
        return np.zeros(0, np.uint64)
    return _strip(data, 0, blocks)


def _strip(data: bytes, first: int, last: int) -> np.ndarray:
    """The ids of blocks first to last, without the padding of their last words."""
    _, count, offsets, at = _header(data)
    words = np.frombuffer(data, "<u8", int(offsets[last] - offsets[first]), at + 8 * int(offsets[first]))
    sel = (words >> np.uint64(60)).astype(np.int64)
    n = min(count, last * BLOCK) - first * BLOCK
    begin = (offsets[first:last] - offsets[first]).astype(np.int64)
    if not sel.all():  # with escapes, block by block
        end = [*begin[1:], len(words)]
        return np.concatenate([_decode_words(words[a:b])[: min(BLOCK, n - k * BLOCK)] for k, (a, b) in enumerate(zip(begin, end))])
    takes = np.array([0, *COUNTS], np.int64)[sel]
    before = np.cumsum(takes) - takes
    block = np.repeat(np.arange(last - first), np.diff([*begin, len(words)]))
    place = block * BLOCK + before - before[begin][block]
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.empty(n, np.uint64)
    for s in np.unique(sel):
        m = np.flatnonzero(sel == s)
        b = np.uint64(BITS[s - 1])
        mask = np.uint64((1 << BITS[s - 1]) - 1)
        lanes = np.arange(COUNTS[s - 1])
        to = place[m][:, None] + lanes
        inside = to < stop[m][:, None]
        out[to[inside]] = ((words[m][:, None] >> (lanes.astype(np.uint64) * b)) & mask)[inside]
    return out


def decode_range(data: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a shard; only the blocks that hold them are read."""
    if stop <= start:
        return np.zeros(0, np.uint64)
    first, last = start // BLOCK, -(-stop // BLOCK)
    return _strip(data, first, last)[start - first * BLOCK : stop - first * BLOCK]


#: Letters that are one code point in NFC, whose lower case is one letter, with a full stop or comma behind.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the
    next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


_LETTERS = _byte_letters()


class _Parts(dict):
    """Ids of parts that were encoded; others are encoded as they are asked for."""

    def __init__(self, owner: Tokenizer):
        super().__init__()
        self.owner = weakref.proxy(owner)

    def __missing__(self, part: str) -> bytes:
        ids = self.owner.part(part) if part else b""
        if len(part) <= 100:
            if len(self) >= self.owner.most:
                self.clear()
            self[part] = ids
        return ids


class Tokenizer:
    """Ids of whole texts by the tokenizers library, each distinct part being encoded once.

    White space separates pre-tokens in these vocabularies, so a text's ids are those of its space-separated
    parts one after the other. Words of plain Latin letters go to the library's model directly, all other
    parts through its whole chain; a probe checks at the start that both agree for this vocabulary.
    """

    def __init__(self, path: str, most: int = MOST):
        import tokenizers

        self.full = tokenizers.Tokenizer.from_file(path)
        self.model = self.full.model
        self.most, self.known, self.words = most, _Parts(self), {}
        self.used = True
        common.kept(self)
        self.tails = {x: self._whole(x) for x in (".", ",")} | {"": b""}
        probe = ["word", "Word.", "THE,", "été", "Straße", "ÜBER,", "ciónñ.", "ÀÿØþ", "edtionrereinsh"]
        self.direct = all(self._direct(m) == self._whole(x) for x in probe for m in [_PLAIN.fullmatch(x)])
        self.words.clear()

    def clear(self) -> None:
        """Forgets the parts that were encoded, once a task has ended that did not use them."""
        if not self.used:
            self.known.clear()
            self.words.clear()
            if self in _TOKENIZERS.values():  # the model itself, too
                _TOKENIZERS.clear()
        self.used = False

    def _whole(self, part: str) -> bytes:
        return array("I", self.full.encode(part, add_special_tokens=False).ids).tobytes()

    def _direct(self, m: re.Match) -> bytes:
        return self._word(m[1].lower()) + self.tails[m[2]]

    def _word(self, low: str) -> bytes:
        ids = self.words.get(low)
        if ids is None:
            mapped = low if low.isascii() else "".join(map(_LETTERS.__getitem__, low.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(low) <= 100:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[low] = ids
        return ids

    def plain(self, part: str) -> tuple[str, str] | None:
        """The word and the mark after it of a part that the library's model takes directly."""
        if not self.direct:
            return None
        if part.isascii():  # as _PLAIN has it
            if part.isalpha():
                return part.lower(), ""
            return (part[:-1].lower(), part[-1]) if part[-1] in ".," and part[:-1].isalpha() else None
        m = _PLAIN.fullmatch(part)
        return (m[1].lower(), m[2]) if m else None

    def part(self, part: str) -> bytes:
        found = self.plain(part)
        return self._word(found[0]) + self.tails[found[1]] if found else self._whole(part)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


_TOKENIZERS: dict[tuple[str, int], Tokenizer] = {}


def tokenizer(path: str, most: int = MOST) -> Tokenizer:
    if (path, most) not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path, most] = Tokenizer(path, most)
    _TOKENIZERS[path, most].used = True
    return _TOKENIZERS[path, most]


FILES = "shard long, first_doc long, data binary, doc_ids array<long>, sizes array<long>"


def _shards(path: str, end: int, shard_ids: int):
    schema = pa.schema([("shard", pa.int64()), ("first_doc", pa.int64()), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        docs: list[int] = []
        parts: list[bytes] = []
        held = n = 0

        def close():
            data = encode(np.frombuffer(b"".join(parts), "<u4"))
            row = pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([docs[0]], pa.int64()), pa.array([data], pa.binary()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in parts]], pa.list_(pa.int64()))], schema=schema)
            docs.clear()
            parts.clear()
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + stop if text else stop
                if docs and held + len(ids) > 4 * shard_ids:
                    yield close()
                    held, n = 0, n + 1
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
        if docs:
            yield close()

    return run


def write(docs: DataFrame, to: str, path: str, end: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Encodes texts in ascending order of doc_id into shards and writes them to the folder `to`.

    A tie between rows of one id is broken by the text. Rows of a null id come first.
    """
    spark = common.ship(docs.sparkSession)
    df = common.only(docs, doc_id="long", text="string")
    parts = common.partitions(df)
    dealt = df.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(_shards(path, end, shard_ids), FILES).withColumn("part", F.spark_partition_id())
    # incompressible words gain nothing from a second code
    rows.write.mode("overwrite").option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(to)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, doc_ids, sizes, base in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
            n = np.array(sizes.values.to_numpy(zero_copy_only=False), np.int64)
            ids = decode(data.as_buffer().to_pybytes()).astype("<u4")
            if int(n.sum()) != len(ids):
                raise ValueError("a shard's ids and sizes differ")
            ends = np.cumsum(n)
            starts = ends - n
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(starts + base.as_py()), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark, path: str) -> DataFrame:
    """Per document of the written shards: start among all ids, number of ids, crc32 of them."""
    common.ship(spark)
    files = spark.read.parquet(path)
    # one row per shard, without its data: sums by part first, so the ordered window runs over parts only
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    inner = Window.partitionBy("part").orderBy("shard")
    shards = files.select("part", "shard", size.alias("n"))
    totals = shards.groupBy("part").agg(F.sum("n").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    at = shards.select("part", "shard", (F.sum("n").over(inner) - F.col("n")).alias("inner_base")).join(bases, "part").select("part", "shard", (F.col("part_base") + F.col("inner_base")).alias("base"))
    rows = files.select("part", "shard", "data", "doc_ids", "sizes").join(F.broadcast(at) if _few(spark, path) else at, ["part", "shard"])
    return rows.select("data", "doc_ids", "sizes", "base").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Shards whose starts may be broadcast: 24 bytes each.
BROADCAST_SHARDS = 200_000


def _few(spark, path: str) -> bool:
    return spark.read.parquet(path).select("shard").count() <= BROADCAST_SHARDS
