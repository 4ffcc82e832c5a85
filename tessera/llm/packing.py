"""Variable-capacity best-fit packing.

Documents become pieces of at most the largest permitted length; the pieces of a group, longest first, go to
the open bin with the least room that takes them. Where none does, the bin size opens that costs least per
token it can still be filled with, given what is left to place. At the end each bin shrinks to the smallest
permitted length that holds its contents.

Lengths, starts and capacities count ids of a tokenizer where its file is given, as the query and the pipeline do, so
a piece is ids start to start + length of its document with one end mark; else they count white-space separated words.

sequences() joins the ids themselves to their places and returns whole sequences.

Groups are hashes of the id and hold about `group_rows` pieces, whatever the size of the corpus; a group that
repeated ids make larger is cut into runs of `group_rows`. Only ids and lengths are shuffled.

Defined cases: a null or empty text has length 0 and still takes its end mark; repeated rows are packed each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simple8b

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Tokens that opening a sequence costs beyond its length.
OVERHEAD = 32
GROUP_ROWS = 20_000
#: Runs that a group is cut into at most, as bits of a bin's id.
RUN_BITS = 24

SCHEMA = "doc_id long, piece long, start long, length long, bin_id long, bin_capacity long, bin_offset long"


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the final capacity of each bin."""
    caps = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    size = np.array([lengths[k] for k in order], np.int64)
    left_after = np.concatenate([np.cumsum(size[::-1])[::-1], [0]])  # tokens from a place in the order on
    falling = -size
    room: dict[int, list[int]] = {}  # free tokens -> bins
    open_rooms = 0  # bit r: some bin has r tokens free
    free: list[int] = []
    used: list[int] = []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for at, k in enumerate(order):
        n = lengths[k]
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            best = None
            for c in caps:
                if c >= n:
                    first = max(at + 1, int(np.searchsorted(falling, -(c - n), "left")))
                    filled = n + min(c - n, int(left_after[min(first, len(size))]))
                    # a bin that stays short is downsized, so its cost is that of the size it ends with
                    cost = (overhead + next(x for x in caps if x >= filled)) / max(filled, 1)
                    if best is None or cost < best[0]:
                        best = (cost, c)
            b, r = len(free), best[1]
            free.append(r)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        free[b] = r - n
        room.setdefault(free[b], []).append(b)
        open_rooms |= 1 << free[b]
    return bins, offsets, [next(c for c in caps if c >= u) for u in used]


def pack_pieces(pieces: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Packs rows of doc_id and length (0 or more)."""
    return _packed(common.only(pieces, doc_id="long", length="long").withColumn("row", F.lit(0).cast("long")), capacities, overhead, group_rows).drop("row")


def _packed(df: DataFrame, capacities: tuple[int, ...], overhead: int, group_rows: int) -> DataFrame:
    """df: (doc_id, row, length), row being what tells rows of one id apart."""
    spark = common.ship(df.sparkSession)
    top = max(capacities)
    groups = max(1, -(-df.count() // group_rows))
    bits = group_rows.bit_length()  # bins of a run have fewer
    schema = SCHEMA + ", row long"
    df = df.select("doc_id", "row", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("length") / top) - 1).cast("long"))).alias("piece"))
    df = df.withColumn("start", F.col("piece") * top).withColumn("n", F.least(F.lit(top), F.col("length") - F.col("start")))
    df = df.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"), "doc_id", "row", "piece", "start", F.col("n").alias("length"))

    def bins(t: pa.Table, part: int) -> pa.Table:
        b, o, caps = pack(t["length"].to_pylist(), capacities, overhead)
        b = np.array(b, np.int64)
        ids = (t["g"].to_numpy() << (bits + RUN_BITS)) + (part << bits) + b
        return pa.table([t["doc_id"], t["piece"], t["start"], t["length"], pa.array(ids), pa.array(np.array(caps, np.int64)[b]), pa.array(o, pa.int64()), t["row"]], names=[x.split()[0] for x in schema.split(", ")])

    dealt = df.repartition(max(1, min(groups, common.partitions(df))), "g").sortWithinPartitions("g", "doc_id", "row", "piece", "start", "length")
    return dealt.mapInArrow(common.tidy(common.over_groups(["g"], bins, common.arrow_schema(spark, schema), most=group_rows)), schema)


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id and its number of white-space separated tokens with one end mark."""
    df = common.only(docs, doc_id="long", text="string")
    text = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\r", "   "))
    words = F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " +")))
    return df.select("doc_id", (words + 1).cast("long").alias("length"))


#: Parts, and words, whose numbers of ids a worker keeps.
MOST_KNOWN = 200_000


class Lengths:
    """Numbers of ids. Only these are kept: the ids of as many words would take the memory that other cores' workers need."""

    def __init__(self, path: str, most: int):
        self.enc = simple8b.Tokenizer(path, most=1)
        self.words = common.Memo(lambda low: len(self.enc._word(low)) // 4, most, owned=True)
        self.parts = common.Memo(self._part, most, owned=True)
        self.used = True
        common.kept(self)
        self.tails = {k: len(x) // 4 for k, x in self.enc.tails.items()}

    def _part(self, part: str) -> int:
        if not part:
            return 0
        found = self.enc.plain(part)
        return self.words[found[0]] + self.tails[found[1]] if found else len(self.enc._whole(part)) // 4

    def clear(self) -> None:
        """Forgets all once a task has ended that did not use it."""
        if not self.used:
            self.words.clear()
            self.parts.clear()
            if self in _LENGTHS.values():
                _LENGTHS.clear()
        self.used = False

    def of(self, text: str) -> int:
        return sum(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))


_LENGTHS: dict[tuple[str, int], Lengths] = {}


def _token_lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, MOST_KNOWN) not in _LENGTHS:
            _LENGTHS.clear()
            _LENGTHS[path, MOST_KNOWN] = Lengths(path, MOST_KNOWN)
        known = _LENGTHS[path, MOST_KNOWN]
        known.used = True
        for batch in batches:
            n = [known.of(t) + 1 if t else 1 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "length"])

    return run


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and its number of ids with one end mark, as simple8b writes them; computed once."""
    common.ship(docs.sparkSession)
    return common.cut(common.only(docs, doc_id="long", text="string").mapInArrow(common.tidy(_token_lengths(path)), "doc_id long, length long"))


def packed(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """path: the tokenizer whose ids are packed; words are where there is none."""
    return pack_pieces(token_lengths(docs, path) if path else lengths(docs), **options)


SEQUENCE = "bin_id long, bin_capacity long, ids array<int>, doc_ids array<long>, starts array<int>"


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = simple8b.tokenizer(path)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            ids = [(enc.encode(t) if t else b"") + last for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "row", "length", "ids"])

    return run


def _sequence(t: pa.Table, part: int) -> pa.Table:
    order = np.lexsort((t["length"].to_numpy(), t["bin_offset"].to_numpy()))
    data = [t["ids"][k].as_buffer() for k in order.tolist()]
    ids = np.concatenate([np.frombuffer(x, "<u4").astype(np.int32) for x in data])
    starts = t["bin_offset"].to_numpy()[order].astype(np.int32)
    return pa.table([t["bin_id"].slice(0, 1), t["bin_capacity"].slice(0, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([t["doc_id"].take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int32()))], names=[x.split()[0] for x in SEQUENCE.split(", ")])


def sequences(docs: DataFrame, path: str, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group_rows: int = GROUP_ROWS, end: int = 1) -> DataFrame:
    """A row for each bin: its ids, and the documents of its pieces with the places where they begin. Ids are
    shuffled once, to their bins; a bin has no more than the largest capacity."""
    spark = common.ship(docs.sparkSession)
    df = common.only(docs, doc_id="long", text="string")
    df = df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    coded = common.cut(df.mapInArrow(common.tidy(_encoded(path, end)), "doc_id long, row long, length long, ids binary"))
    pieces = _packed(coded.select("doc_id", "row", "length"), tuple(capacities), overhead, group_rows)
    same = coded.dropDuplicates(["row"]).select("row", "ids")
    cut = F.expr("substring(ids, int(start * 4 + 1), int(length * 4))")
    parts = pieces.join(same, "row").select("bin_id", "bin_capacity", "bin_offset", "length", "doc_id", cut.alias("ids"))
    dealt = parts.repartition(common.partitions(parts), "bin_id").sortWithinPartitions("bin_id")
    return dealt.mapInArrow(common.over_groups(["bin_id"], _sequence, common.arrow_schema(spark, SEQUENCE)), SEQUENCE)
