"""Grouping over Arrow batches, caches and id joins."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import common


def batches(keys, size):
    t = pa.table({"k": pa.array(keys, pa.int64()), "x": pa.array(range(len(keys)), pa.int64())})
    return t.to_batches(max_chunksize=size)


def test_groups_are_whole_across_batches():
    seen = []

    def fn(t, part):
        seen.append((t["k"][0].as_py(), t["x"].to_pylist(), part))

    keys = [1, 1, 1, 2, 3, 3, 3, 3, 3, 4]
    for size in (1, 2, 3, 10):
        seen.clear()
        list(common.over_groups(["k"], fn, pa.schema([("x", pa.int64())]))(iter(batches(keys, size))))
        assert seen == [(1, [0, 1, 2], 0), (2, [3], 0), (3, [4, 5, 6, 7, 8], 0), (4, [9], 0)]


def test_large_groups_are_cut_into_runs():
    seen = []
    fn = lambda t, part: seen.append((t["k"][0].as_py(), t.num_rows, part))
    for size in (1, 3, 10):
        seen.clear()
        list(common.over_groups(["k"], fn, pa.schema([("x", pa.int64())]), most=2)(iter(batches([1, 1, 1, 1, 1, 2, 2], size))))
        assert seen == [(1, 2, 0), (1, 2, 1), (1, 1, 2), (2, 2, 0)]


def test_hashed_words_are_those_of_the_texts(monkeypatch):
    import random

    monkeypatch.setattr(common, "SPAN", 64)
    rnd = random.Random(2)
    words = ["a", "ab", "ba", "Straße", "İx", "ΑΣ", "été", "x" * 300, "y" * 400, "y" * 401, "漢字", "1_2", "𝒳", "b" * 60, "c" * 70]
    texts = [None, "", " - ", *["".join(rnd.choice(words) + rnd.choice([" ", "\n", ", ", "--"]) for _ in range(rnd.randrange(30))) for _ in range(60)]]
    h, counts = common.hashed_words(texts)
    plain = [common.words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in plain]
    by: dict = {}
    for w, x in zip([w for ws in plain for w in ws], h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    assert common.hashed_words([])[0].tolist() == []
    monkeypatch.undo()
    one = common.hashed_words([texts[5]])[0]
    assert one.tolist() == [by[w] for w in plain[5]]


def test_memo_is_bounded():
    m = common.Memo(len, 3)
    assert [m[x] for x in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1] and len(m) <= 3


def test_id_joins_are_the_same_either_way(spark, monkeypatch):
    df, ids = spark.range(20), spark.range(3, 9)
    few = sorted(r.id for r in common.by_ids(df, ids, "id", "left_anti").collect())
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert few == sorted(r.id for r in common.by_ids(df, ids, "id", "left_anti").collect()) == [0, 1, 2, *range(9, 20)]


def test_clashing_columns_stay_outside(spark):
    df = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("held_out"))
    assert common.only(df, doc_id="long", text="string").columns == ["doc_id", "text"]


def test_tokenizers_forget_parts_when_another_task_ends():
    import public_tokenizers

    from tessera.llm import simple8b

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = simple8b.tokenizer(path)
    ids = enc.encode("some words of a text")
    common.settle()
    assert enc.known  # the task that ended has used them, and the next one may
    common.settle()
    assert not enc.known and not enc.words and simple8b.tokenizer(path).encode("some words of a text") == ids


def test_cut_gives_back_what_was_shuffled(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark._jvm.System.gc()
    time.sleep(1)
    before = tracker.shuffleStatuses().size()
    made = [spark.range(40).repartition(3, "id").groupBy((F.col("id") % (k + 2)).alias("k")).count() for k in range(6)]
    cuts = [common.cut(df) for df in made]
    end = time.time() + 10
    # two shuffles each, of which Spark's threads may hold those of the last
    while tracker.shuffleStatuses().size() > before + 2 and time.time() < end:
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() <= before + 2
    assert [sorted(tuple(r) for r in df.collect()) for df in cuts] == [sorted(tuple(r) for r in df.collect()) for df in made]
    assert [df.count() for df in cuts] == [k + 2 for k in range(6)]


def test_a_task_of_another_stage_begins_without_what_the_one_before_left(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from tessera.llm import packing

    stage = [1]
    monkeypatch.setattr(common.TaskContext, "get", staticmethod(lambda: type("Task", (), {"stageId": lambda self: stage[0]})()))
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], names=["doc_id", "text"])
    run = common.tidy(packing._token_lengths(path))
    assert [b.column(1).to_pylist() for b in run(iter([batch]))] == [[3, 1]]
    held = packing._LENGTHS[path, packing.MOST_KNOWN]
    assert held.parts  # for the stage's next task
    list(run(iter([batch])))
    assert packing._LENGTHS[path, packing.MOST_KNOWN] is held
    stage[0] = 2
    assert list(common.tidy(lambda batches: iter(()))(iter(()))) == [] and not packing._LENGTHS and not held.parts
