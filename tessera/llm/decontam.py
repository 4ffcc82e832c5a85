"""Benchmark decontamination by templates.

Words of a text become a template: numbers, names and units are replaced by typed placeholders. Windows of
WINDOW template words of the benchmark are hash-joined with those of the documents. A pair of whole windows counts
if its slot values are equal, whatever its words. Else it counts if it has FIXED words that are not placeholders, and
if its slots are consistent, that is, equal slot values of the item stand against equal values of the document, and
different against different ones. So re-parameterised questions are caught and chance templates are not. Where no
window of a document and an item counts by itself, RUN windows in a row do, if all their slots together are consistent
and they have RUN_FIXED words that are not placeholders.

Numbers are words that begin with a digit, number words included; units are words of UNITS; a name is a word
with a capital first letter whose lower-case form the benchmark and the start of a sentence do not explain:
one that stands inside a sentence. An item shorter than the window has one window of all its words; it counts where it
has FIXED words that are not placeholders, and else only where a whole sentence of the document is the same, so that
items of a word or two don't remove every document that holds these.

Result of matches(): (doc_id, item_id, n_windows, exact), a row for each pair that is found; n_windows are the
windows that count by themselves, or else those that begin a run; exact tells that all their slot values are equal.
Windows of an item are kept in full, in a table that is joined by hash; documents are first tested against a Bloom
filter, which only saves shuffling. Its size follows the number of windows, up to 64 MB.

Defined cases: null and empty texts match nothing; repeated rows of documents or items are found each once by
their ids; rows without an id are not reported by matches(), but clean() removes those that hold an item; rows of one id
go together; an empty table gives no rows; other columns are not read; texts are used whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .jaccard import _mix

WINDOW = 8
#: Words of an alignment that must not be placeholders.
FIXED = 5
#: Windows in a row that are judged together, and words of theirs that must not be placeholders.
RUN, RUN_FIXED = 4, 3
#: Bits of the Bloom filter for each window, at least and at most in all.
BLOOM_EACH, BLOOM_LEAST, BLOOM_MOST = 24, 1 << 16, 1 << 29

NUM, NAME, UNIT = "\x01num", "\x01name", "\x01unit"
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split())

_TOKEN = re.compile(r"[^\W\d_]+|\d[\d.,]*|[.!?\n]")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def template(text: str | None, begins: list[int] | None = None) -> tuple[list[str], list[str]]:
    """The template words and the lower-case words they stand for. begins: gets the places where sentences begin."""
    forms: list[str] = []
    values: list[str] = []
    fresh = True
    for w in _TOKEN.findall(text or ""):
        c = w[0]
        if fresh and begins is not None and c not in ".!?\n":
            begins.append(len(forms))
        if c.isdigit():
            forms.append(NUM)
            values.append(w.rstrip(".,"))
            fresh = False
        elif c in ".!?\n":
            fresh = True
        else:
            low = w.lower()
            if low in NUMBERS:
                forms.append(NUM)
            elif low in UNITS:
                forms.append(UNIT)
            elif not fresh and c.isupper() and not w.isupper():
                forms.append(NAME)
            else:
                forms.append(low)
            values.append(low)
            fresh = False
    return forms, values


_HASH = common.Memo(common.word_hash)


def hashes(forms: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, forms), np.uint64, len(forms))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` words."""
    if len(h) < width or not width:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _MULT + h[k : len(h) - width + 1 + k]
    return _mix(out)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forms, values = template(text)
            width = min(WINDOW, len(forms))
            rows += [(w, item, k, width, forms[k : k + width], values[k : k + width]) for k, w in enumerate(windows(hashes(forms), width).view(np.int64).tolist())]
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["w", "item_id", "item_at", "width", "forms", "item_values"])


def _places(w: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (w % np.uint64(bits)).astype(np.int64), ((w >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)


def _doc_windows(bloom, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        size = 8 * len(bits)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                begins: list[int] = []
                forms, values = template(text, begins)
                edges = {*begins, len(forms)}
                h = hashes(forms)
                for width in widths:
                    w = windows(h, width)
                    a, b = _places(w, size)
                    for k in np.flatnonzero((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).tolist():
                        rows.append((int(w[k].view(np.int64)), doc, k, forms[k : k + width], values[k : k + width], k in edges and k + width in edges))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["w", "doc_id", "doc_at", "doc_forms", "doc_values", "sentence"])

    return run


def _filter_bits(spark, items: DataFrame):
    """The Bloom filter, or'ed together on the executors, in bytes."""
    n = items.count()
    size = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (BLOOM_EACH * max(n, 1) - 1).bit_length()))

    def places(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), size)))
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    words = items.select("w").mapInArrow(common.tidy(places), "at long").select((F.col("at") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(size // 64, np.int64)
    t = words.toArrow()  # no more words than the filter has
    bits[t["word"].to_numpy()] = t["bits"].to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint8))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = common.ship(docs.sparkSession)
    bench = common.only(benchmark, item_id="long", text="string").where("item_id IS NOT NULL").dropDuplicates(["item_id", "text"])
    items = common.cut(bench.mapInArrow(common.tidy(_item_windows), "w long, item_id long, item_at int, width int, forms array<string>, item_values array<string>"))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # WINDOW of them at most
    df = common.only(docs, doc_id="long", text="string").where("doc_id IS NOT NULL")
    found = df.mapInArrow(common.tidy(_doc_windows(_filter_bits(spark, items), widths)), "w long, doc_id long, doc_at int, doc_forms array<string>, doc_values array<string>, sentence boolean")
    pairs = found.join(items, "w").where("doc_forms = forms")
    fixed = F.size(F.filter("forms", lambda x: ~x.startswith("\x01")))
    slots = F.filter(F.arrays_zip(F.col("forms"), F.col("item_values").alias("item_values"), F.col("doc_values").alias("doc_values")), lambda x: x["forms"].startswith("\x01"))
    whole = F.col("width") == WINDOW
    equal = F.col("item_values") == F.col("doc_values")
    enough = fixed >= FIXED
    plain = F.filter(F.transform("forms", lambda x, k: F.when(~x.startswith("\x01"), F.col("item_at") + k)), lambda x: x.isNotNull())
    good = pairs.withColumn("slots", slots).where(_consistent("slots"))
    good = good.select("doc_id", "item_id", "item_at", "slots", whole.alias("whole"), plain.alias("plain"), equal.alias("equal"), (enough | (whole | F.col("sentence")) & equal).alias("alone"), (F.col("doc_at") - F.col("item_at")).alias("shift"))
    ahead = Window.partitionBy("doc_id", "item_id", "shift").orderBy("item_at").rangeBetween(0, RUN - 1)
    good = good.withColumns({"run": F.size(F.collect_set("item_at").over(ahead)), "all_slots": F.flatten(F.collect_list("slots").over(ahead)), "all_plain": F.flatten(F.collect_list("plain").over(ahead))})
    run = F.col("whole") & (F.col("run") == RUN) & (F.size(F.array_distinct("all_plain")) >= RUN_FIXED) & _consistent("all_slots")
    at, same = {}, {}
    for k, x in (("alone", F.col("alone")), ("run", run)):
        at[k], same[k] = F.countDistinct(F.when(x, F.col("item_at"))).cast("long").alias(f"n_{k}"), F.every(F.when(x, F.col("equal"))).alias(f"{k}_equal")
    found = good.groupBy("doc_id", "item_id").agg(*at.values(), *same.values()).where("n_alone > 0 OR n_run > 0")
    return found.selectExpr("doc_id", "item_id", "if(n_alone > 0, n_alone, n_run) AS n_windows", "if(n_alone > 0, alone_equal, run_equal) AS exact")


def _consistent(name: str):
    """Whether the slot values of item and document map one to one."""
    forward = F.array_distinct(F.transform(name, lambda x: F.struct(x["forms"], x["item_values"], x["doc_values"])))
    left = F.array_distinct(F.transform(name, lambda x: F.struct(x["forms"], x["item_values"])))
    right = F.array_distinct(F.transform(name, lambda x: F.struct(x["forms"], x["doc_values"])))
    return (F.size(forward) == F.size(left)) & (F.size(forward) == F.size(right))


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document: its items in order, and its windows."""
    return matches(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("n_windows").alias("n_windows"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found."""
    bad = common.cut(matches(docs, benchmark).select("doc_id").distinct())
    left = common.by_ids(docs, bad, "doc_id", "left_anti").select(*docs.columns)
    low = {c.lower(): c for c in docs.columns}
    doc, text = low["doc_id"], low["text"]
    alone = docs.where(F.col(doc).isNull())
    if alone.isEmpty():
        return left
    # rows without an id are known by their texts here
    key = F.xxhash64(F.col(text)).alias("doc_id")
    bad = common.cut(matches(alone.select(key, F.col(text).alias("text")), benchmark).select(F.col("doc_id").alias("text key")).distinct())
    alone = common.by_ids(alone.withColumn("text key", F.xxhash64(F.col(text))), bad, "text key", "left_anti").select(*docs.columns)
    return left.where(F.col(doc).isNotNull()).union(alone)
