"""JSON and XML documents of any size as rows: one for each element of an array, or for each element of a name.

A file is read by as many tasks as it has splits. Of XML a split's records end at the closing tag of the row. Of JSON they end
at closing braces, wherever these stand; what they mean depends on all that came before, so each split first tells how
many quotes it has and how it changes the depth, outside or inside of a string; running sums over the splits of a
file tell each split the state in which it begins, and it cuts its elements. An element that ends in a later split is
put together from its parts.

Rows are (file, split, local, body): local numbers the elements of a split, ordinals() those of a document.

What is not seen: rows within rows of the same name in XML, and tags of that name in comments and CDATA sections;
elements of JSON arrays that are no objects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import shared_folder, ship_code

ROWS = "file string, split long, local long, body string"
_SUMMARY = "file string, split long, quotes long, outside long, inside long"
_PART = "file string, split long, local long, opened boolean, closed boolean, array string, body string"


def _records(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Texts up to each end, which they lack, in the order of their splits."""
    df = spark.read.option("lineSep", end).text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], dict]]:
    """Runs of records of one split, and the other columns of their first row."""
    for batch in batches:
        files, splits, values = (batch.column(batch.schema.get_field_index(c)) for c in ("file", "split", "value"))
        at = splits.to_numpy()
        names = files.dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(edges, edges[1:]):
            rest = {n: c[a].as_py() for n, c in zip(batch.schema.names, batch.columns) if n not in ("file", "split", "value")}
            yield (files[a].as_py(), int(at[a])), values.slice(a, b - a).to_pylist(), rest


def _marks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text that begins outside of strings: its code points, which of them are quotes, and the depth that each
    bracket outside of quotes adds."""
    char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.arange(len(char))
    slash = char == 92
    last = np.maximum.accumulate(np.where(slash, -1, at)) if len(char) else at
    before = np.concatenate([[-1], last[:-1]]) if len(char) else last  # the last place before that is no backslash
    quote = (char == 34) & ((at - 1 - before) % 2 == 0)
    return char, quote, np.isin(char, (123, 91)).astype(np.int64) - np.isin(char, (125, 93))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list[int]] = {}
    for key, values, _ in _by_split(batches):
        _, quote, step = _marks("}".join(values) + "}")
        odd = (np.cumsum(quote) % 2).astype(bool)
        sums = found.setdefault(key, [0, 0, 0])
        flip = sums[0] % 2 == 1
        out, inside = int(step[~odd].sum()), int(step[odd].sum())
        for k, x in enumerate((int(quote.sum()), inside if flip else out, out if flip else inside)):
            sums[k] += x
    if found:
        cols = [[k[0] for k in found], [k[1] for k in found], *([x[c] for x in found.values()] for c in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[x.split()[0] for x in _SUMMARY.split(", ")])


_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$')


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with the state (odd, depth) of their split to the objects of the arrays of a document: those of an outermost
    array, or of the arrays in the outermost object. Of an object that begins or ends in another split a part."""
    state: dict = {}
    rows: list[tuple] = []

    def close(tail: bool) -> None:
        if state and state["held"] and tail:
            rows.append((*state["key"], state["n"], state["opened"], False, state["array"], "".join(state["held"])))

    for key, values, rest in _by_split(batches):
        if state.get("key") != key:
            close(True)
            odd, depth = bool(rest["odd"]), int(rest["depth"])
            # deeper than the arrays: the split begins within an element
            level = int(rest["level"])
            state = {"key": key, "odd": odd, "depth": depth, "level": level, "n": 0, "held": [""] if depth > level or odd and depth == level else [], "opened": False, "array": None, "before": ""}
        text = "}".join(values) + "}"
        # inside of a string the text is what would be outside behind a quote
        char, quote, step = _marks(text)
        odd = (np.cumsum(quote) + state["odd"]) % 2 == 1
        depth = state["depth"] + np.cumsum(np.where(odd, 0, step))
        level = state["level"]
        events = np.flatnonzero(~odd & (step != 0) & ((depth == level) | (depth == level + 1) & (step > 0) | (depth == level - 1)))
        done = 0
        for k in events.tolist():
            c, d = char[k], int(depth[k])
            if c == 91 and d == level and level > 1:  # an array of the outermost object opens
                found = _KEY.search((state["before"] + text[done:k])[-10_000:])
                state["array"] = found[1] if found else ""
            elif c == 123 and d == level + 1 and not state["held"]:
                state["held"], state["opened"], done = [""], True, k
            elif c == 125 and d == level and state["held"]:
                state["held"].append(text[done : k + 1])
                rows.append((*key, state["n"], state["opened"], True, state["array"], "".join(state["held"])))
                state["held"], state["opened"], state["n"], done = [], False, state["n"] + 1, k + 1
        if state["held"]:
            state["held"].append(text[done:])
        else:
            state["before"] = (state["before"] + text[done:])[-10_000:]
        state["odd"], state["depth"] = bool(odd[-1]), int(depth[-1])
        if len(rows) >= 1000:
            yield _batch(rows, _PART)
            rows = []
    close(True)
    if rows:
        yield _batch(rows, _PART)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def json_elements(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """The objects of the outermost array of each document, or of the array that the outermost object has as `field`."""
    ship_code(spark)
    level = 1 if field is None else 2
    records = _records(spark, path, "}")
    sums = _once(records.mapInArrow(_summed, _SUMMARY))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    states = sums.withColumn("odd", quotes == 1)
    step = F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))
    states = states.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    # a row for each split of a file: far fewer than could not be sent to all tasks
    states = states.select("file", "split", "odd", "depth", F.lit(level).alias("level"))
    parts = _once(records.join(F.broadcast(states), ["file", "split"]).mapInArrow(_cut, _PART))
    whole = parts.where("opened AND closed")
    torn = parts.where("NOT (opened AND closed)")
    # a part that opens an element begins it, those that follow in later splits belong to it
    in_order = Window.partitionBy("file").orderBy("split", "opened")
    torn = torn.withColumn("first", F.last(F.when(F.col("opened"), F.struct("split", "local")), ignorenulls=True).over(in_order))
    mended = torn.where("first IS NOT NULL").groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("split", "body", "closed", "array"))).alias("x"))
    mended = mended.where(F.exists("x", lambda x: x["closed"])).select("file", F.col("first.split").alias("split"), F.col("first.local").alias("local"), F.col("x")[0]["array"].alias("array"), F.array_join("x.body", "").alias("body"))
    out = whole.select("file", "split", "local", "array", "body").unionByName(_once(mended))
    if field is not None:
        # an array that was opened in an earlier split
        ends = parts.where("array IS NOT NULL").groupBy("file", "split").agg(F.max_by("array", "local").alias("ends"))
        ends = sums.select("file", "split").join(ends, ["file", "split"], "left")
        ends = _once(ends.withColumn("goes_on", F.last("ends", ignorenulls=True).over(before)).select("file", "split", "goes_on"))
        out = out.join(F.broadcast(ends), ["file", "split"]).where(F.coalesce("array", "goes_on") == field)
    return out.select("file", "split", "local", "body")


def _rows_of(tag: str):
    start = re.compile(rf"<{re.escape(tag)}(?=[\s/>])")
    alone = re.compile(rf"<{re.escape(tag)}(?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*/>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for key, values, _ in _by_split(batches):
            if key != at:
                at, n = key, 0
            rows = []
            for value in values:
                place = 0
                while m := start.search(value, place):
                    if own := alone.match(value, m.start()):
                        rows.append((*key, n, own[0]))
                        place = own.end()
                    else:
                        rows.append((*key, n, f"{value[m.start() :]}</{tag}>"))
                        place = len(value)
                    n += 1
            if rows:
                yield _batch(rows, ROWS)

    return run


def xml_elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The elements of a name in each document, which has none of that name within another."""
    ship_code(spark)
    return _once(_records(spark, path, f"</{tag}>").mapInArrow(_rows_of(tag), ROWS))


def _once(df: DataFrame) -> DataFrame:
    """Elements, cut once: they are counted and read, several times maybe; and what is told of splits."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ordinals(elements: DataFrame, of: Column | None = None) -> DataFrame:
    """Elements with their places among all of a document (or of what `of` names), from 1."""
    counts = elements.groupBy("file", "split").agg((F.max("local") + 1).alias("n"))
    upto = F.sum("n").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1))
    base = _once(counts.select("file", "split", F.coalesce(upto, F.lit(0)).alias("base")))  # a row for each split
    return elements.join(F.broadcast(base), ["file", "split"]).withColumn("ordinal", F.col("base") + F.col("local") + 1).drop("base")


def write_documents(elements: DataFrame, path: str, head: str, between: str, tail: str) -> None:
    """Texts (value) as documents, one for each partition: head, the texts with something between them, tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield _batch([((head if first else between) + between.join(texts),)], "value string")
                first = False
        yield _batch([((head if first else "") + tail,)], "value string")

    ship_code(elements.sparkSession)
    elements.select("value").mapInArrow(run, "value string").write.mode("overwrite").text(path)
