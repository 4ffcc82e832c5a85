"""Runs of repeated words against a plain search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import queries, runs

SF = "/root/testdata/sf0.001"


def plain(ws, shortest=12):
    """(start, length, period) of all runs, by start and period."""
    n, out = len(ws), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if ws[i] != ws[i + p]:
                i += 1
                continue
            s = i
            while i < n - p and ws[i] == ws[i + p]:
                i += 1
            if i - s + p >= max(shortest, 2 * p):
                out.setdefault((s, i - s + p), p)
    return sorted(((s, m, p) for (s, m), p in out.items()), key=lambda x: (x[0], x[2]))


def collapsed(ws, found):
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    return " ".join(w for k, w in enumerate(ws) if k not in gone)


def coded(docs):
    ids = {}
    return np.array([ids.setdefault(w, len(ids)) for d in docs for w in d], np.int64), np.array([len(d) for d in docs], np.int64)


def test_find_equals_plain_search():
    rng = random.Random(4)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            ws = [str(rng.randrange(rng.choice([1, 2, 3, 40]))) for _ in range(rng.randint(0, 80))]
            if ws and rng.random() < 0.5:
                a = rng.randrange(len(ws))
                p = 1 + rng.randrange(len(ws) - a)
                ws = [ws[a + (i - a) % p] if i >= a else w for i, w in enumerate(ws)]
            docs.append(ws)
        for shortest in (12, 4, 1):
            d, *rest = runs.find(*coded(docs), shortest)
            for k, ws in enumerate(docs):
                assert [tuple(map(int, x)) for x in zip(*(r[d == k] for r in rest))] == plain(ws, shortest)


def test_fibonacci_words_have_their_many_runs():
    a, b = ["x"], ["x", "y"]
    while len(b) < 400:
        a, b = b, b + a
    d, *rest = runs.find(*coded([b]), 2)
    assert [tuple(map(int, x)) for x in zip(*rest)] == plain(b, 2) and len(d) > 250


def test_a_long_cycle_and_a_long_word_list():
    ws = [f"w{k}" for k in range(9000)] + [f"c{k % 777}" for k in range(20_000)] + ["z"] * 30_000
    d, s, m, p = runs.find(*coded([ws, ws[:100]]))
    assert list(zip(d.tolist(), s.tolist(), m.tolist(), p.tolist())) == [(0, 9000, 20_000, 777), (0, 29_000, 30_000, 1)]


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == docs.count()
    some = 0
    for r in docs.collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(ws)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[a + (i - a) % p] if i >= a else w for i, w in enumerate(ws)]
        found = plain(ws)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        some += bool(found)
        want = (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest(), hashlib.sha256(collapsed(ws, found).encode()).hexdigest())
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == want
    assert some > 5


def test_odd_rows(spark):
    many = "a b c " * 40_000
    rows = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, many), (5, "é ü x\x1cy " * 12), (6, "x " * 12), (6, "x " * 12), (None, "x " * 12), (7, "x " * 11), (8, "A a " * 6)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, RUNS string, start int")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.found(df).orderBy("doc_id").collect()]
    assert got == [
        (None, [(0, 12, 1)], "x"),
        (1, [], ""),
        (2, [], ""),
        (3, [], ""),
        (4, [(0, 120_000, 3)], "a b c"),
        (5, [(0, 12, 1)], "é ü x\x1cy"),
        (6, [(0, 12, 1)], "x"),
        (6, [(0, 12, 1)], "x"),
        (7, [], " ".join("x" * 11)),
        (8, [(0, 12, 2)], "A a"),
    ]
    assert runs.found(df.limit(0)).count() == 0 and runs.digests(runs.found(runs.planted(df))).count() == 10
    empty = runs.digests(runs.found(df.where(F.col("doc_id") == 1))).first()
    assert (empty.n_runs, empty.start, empty.length, empty.period, empty.exponent_milli) == (0, None, None, None, None)
    assert empty.runs_sha256 == empty.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
