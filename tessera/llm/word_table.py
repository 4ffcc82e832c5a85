"""BPE encoding and decoding by a table of distinct words and one of pieces.

Texts are split into words by Spark. The documents of a task become blocks of about half a million words; a block has its
distinct words once, dealt over parts by their hashes, and for each document the places of its words among them. Each part
of all blocks goes to one task, so all occurrences of a word meet there: the tokenizers library encodes it once, and
its ids go back to each block that has it, where they are joined to the words' positions. Decoding joins each id with its piece.

What is shuffled are the distinct words of blocks and their ids, compressed; texts are not, and the places of words lie
in a table bucketed by block, so ids are joined to them where they are. A word comes at most once from a block, however
common it is. A task that encodes holds the distinct words of its
part, which are fewer the more shuffle partitions there are. Only the vocabulary's pieces are sent to all workers; the size
of its file bounds them.

Words of these vocabularies never hold white space, so what is between blanks can be encoded by itself; other white
space stays within a word and is left to the tokenizer. Special tokens whose text stands in a document are found, as the
library does. Truncation and padding of the file are not used.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null list of ids is like an empty one, and
null ids in it count for nothing; ids that the vocabulary lacks are left out in decoding, as the library does;
repeated rows are answered each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a block, unless one document has more.
BLOCK_WORDS = 500_000
#: Words that are given to the tokenizers library at a time.
TOGETHER = 2000
#: Words of a block that are looked up at a time, unless one document has more.
TOGETHER_WORDS = 50_000
#: Ids that are decoded at a time, unless one document has more.
TOGETHER_IDS = 50_000
#: Buckets that Spark permits; with more shuffle partitions the table is shuffled, too.
MOST_BUCKETS = 100_000
#: Bits of a block's id below those of the partition that made it.
BLOCK_BITS = 33

#: refs: for each word 0 where it is new to the block, else 1 and its place among the distinct ones; dealt: the part of
#: each distinct word; parts: those words by part. All packed.
BLOCK = "block long, doc_ids array<long>, sizes array<int>, refs binary, dealt binary, parts array<binary>"
#: ids of the words of a part of a block: how many each has, and all of them, packed.
CODED = "block long, part int, counts binary, ids binary"


#: Words take a fifth less than on the lowest level, for a few milliseconds a block.
LEVEL = 6


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32, byte by byte of equal weight, which compresses better."""
    return packed(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def split(docs: DataFrame) -> DataFrame:
    """doc_id and the words of its text, in order; blanks that follow each other have empty words between them."""
    df = common.only(docs, doc_id="long", text="string")
    return df.select("doc_id", F.split(F.translate(F.coalesce("text", F.lit("")), "\n\t\r", "   "), " ").alias("words"))


def _blocks(parts: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << BLOCK_BITS
        held: list[pa.RecordBatch] = []
        waiting = 0

        def block() -> pa.RecordBatch:
            nonlocal k, held, waiting
            lists = pa.concat_arrays([b.column(1) for b in held])
            docs = pa.concat_arrays([b.column(0) for b in held])
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            part = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % parts for w in words), np.int64, len(words))
            refs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            new = refs > np.maximum.accumulate(np.concatenate([[-1], refs]))[:-1]
            in_order = [words[x] for x in np.argsort(part, kind="stable").tolist()]
            n = np.bincount(part, minlength=parts)
            data = [packed(" ".join(in_order[b - m : b]).encode("utf-8", "surrogatepass")) if m else None for b, m in zip(np.cumsum(n).tolist(), n.tolist())]
            row = (k, docs.to_pylist(), sizes, packed_numbers(np.where(new, 0, refs + 1)), packed_numbers(part), data)
            k, held, waiting = k + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += len(batch.column(1).flatten())
                if waiting >= BLOCK_WORDS:
                    yield block()
        if held:
            yield block()

    return run


def blocks(docs: DataFrame) -> DataFrame:
    spark = common.ship(docs.sparkSession)
    schema = common.arrow_schema(spark, BLOCK)
    made = split(docs).mapInArrow(common.tidy(_blocks(common.partitions(docs), schema)), BLOCK)
    # a table, as only these have buckets; its frame needs no name once it is there
    name = f"words_{uuid.uuid4().hex}"
    made.write.bucketBy(min(common.partitions(docs), MOST_BUCKETS), "block").option("compression", "zstd").option("path", f"{common.shared(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def library(path: str):
    import tokenizers

    full = tokenizers.Tokenizer.from_file(path)
    full.no_truncation()
    full.no_padding()
    return full


def _coded(path: str, schema: pa.Schema):
    """Packed words of a part of blocks to their ids; a word is encoded where it first occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = library(path)
        known: dict[str, list[int]] = {}
        for batch in batches:
            for block, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                words = unpacked(data).decode("utf-8", "surrogatepass").split(" ")
                new = [w for w in words if w not in known]
                for a in range(0, len(new), TOGETHER):
                    some = new[a : a + TOGETHER]
                    known |= zip(some, (x.ids for x in full.encode_batch(some, add_special_tokens=False)))
                ids = [known[w] for w in words]
                counts = packed_numbers(np.fromiter(map(len, ids), np.uint32, len(ids)))
                flat = packed_numbers(np.array([x for i in ids for x in i], np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, part, counts, flat), schema)], schema=schema)

    return run


def word_ids(blocks: DataFrame, path: str) -> DataFrame:
    """The ids of the words of each part of each block, all occurrences of a word being looked up in one task."""
    schema = common.arrow_schema(blocks.sparkSession, CODED)
    parts = blocks.select("block", F.posexplode("parts").alias("part", "words")).where(F.col("words").isNotNull())
    dealt = parts.repartition(common.partitions(parts), "part")
    return dealt.mapInArrow(common.tidy(_coded(path, schema)), CODED)


def _with_ids(docs: DataFrame, path: str) -> DataFrame:
    """Blocks beside the ids of their words, part after part."""
    made = blocks(docs)
    by = word_ids(made, path).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "counts", "ids"))).alias("coded"))
    by = by.select("block", F.col("coded.counts").alias("counts"), F.col("coded.ids").alias("ids"))
    return made.select("block", "doc_ids", "sizes", "refs", "dealt").join(by, "block", "left").select("doc_ids", "sizes", "refs", "dealt", "counts", "ids")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of some documents of a block at a time their ids one after the other, and where documents begin and end in these."""
    for batch in batches:
        for k in range(batch.num_rows):
            docs, sizes, refs, dealt, counts, ids = (c[k] for c in batch.columns)
            size = np.concatenate([unpacked_numbers(x) for x in counts.as_py() or [packed_numbers(np.zeros(0))]])
            flat = np.concatenate([unpacked_numbers(x) for x in ids.as_py() or [packed_numbers(np.zeros(0))]])
            first = np.cumsum(size, dtype=np.int64) - size
            place = np.argsort(np.argsort(unpacked_numbers(dealt.as_py()), kind="stable"), kind="stable")
            size, first = size[place].astype(np.int64), first[place]
            refs = unpacked_numbers(refs.as_py())
            new = refs == 0
            refs = refs - np.uint32(1)
            refs[new] = np.arange(np.count_nonzero(new), dtype=np.uint32)
            edges = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(), dtype=np.int64)])
            for a, b in spans(edges, TOGETHER_WORDS):
                some = refs[edges[a] : edges[b]]
                n = size[some]
                ends = np.concatenate([[0], np.cumsum(n)])
                out = flat[np.repeat(first[some] - ends[:-1], n) + np.arange(ends[-1])]
                yield docs.values[a:b], out, ends[edges[a : b + 1] - edges[a]]


def spans(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents that have so many words together, unless one has more."""
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + most, "right")) - 1)
        yield a, b
        a = b


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for docs, ids, edges in _documents(batches):
        yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its text."""
    return _with_ids(docs, path).mapInArrow(common.tidy(_lists), "doc_id long, ids array<int>")


class Pieces:
    """The pieces of a vocabulary by id. A vocabulary without a decoder of its own, as those that mark the ends of words,
    is decoded to its pieces with blanks between them."""

    def __init__(self, path: str):
        held = json.loads(Path(path).read_text("utf-8"))
        if held.get("decoder") is not None:
            raise ValueError("only vocabularies without a decoder of their own are decoded")
        by = {i: p for p, i in held["model"]["vocab"].items()} | {t["id"]: t["content"] for t in held["added_tokens"]}
        table = [by[k].encode("utf-8") + b" " if k in by else b"" for k in range(max(by) + 1)]
        self.size = np.array([len(x) for x in table], np.int64)
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def texts(self, ids: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
        """Each document's pieces, by joining its ids with the table, for some documents at a time: the places of
        characters take 24 bytes each."""
        for a, b in spans(edges, TOGETHER_IDS):
            yield from self._texts(ids[edges[a] : edges[b]], edges[a : b + 1] - edges[a])

    def _texts(self, ids: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
        ids = ids.astype(np.int64)
        there = (ids >= 0) & (ids < len(self.size))
        ids = np.where(there, ids, 0)
        n = np.where(there, self.size[ids], 0)
        ends = np.concatenate([[0], np.cumsum(n)])
        first = np.cumsum(self.size) - self.size
        data = self.flat[np.repeat(first[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = ends[edges].tolist()
        for a, b in zip(at, at[1:]):
            yield data[a : max(a, b - 1)]  # without the last blank


def _decoded(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            texts = [x.decode("utf-8") for x in pieces.texts(lists.flatten().to_numpy(zero_copy_only=False), edges)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to doc_id and text; special tokens are shown."""
    common.ship(coded.sparkSession)
    lists = common.only(coded, doc_id="long", ids="array<int>").withColumn("ids", F.array_compact("ids"))
    return lists.mapInArrow(common.tidy(_decoded(Pieces(path))), "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, ids, edges in _documents(batches):
            at = edges.tolist()
            coded = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at, at[1:])]
            shown = [hashlib.sha256(x).hexdigest() for x in pieces.texts(ids, edges)]
            yield pa.RecordBatch.from_arrays([docs, pa.array(np.diff(edges), pa.int64()), pa.array(coded, pa.string()), pa.array(shown, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document how many ids its text has, and checksums of these and of the text that they decode to."""
    return _with_ids(docs, path).mapInArrow(common.tidy(_digests(Pieces(path))), DIGESTS)
