"""Similarity joins against brute force."""

import numpy as np
import pytest

from tessera.llm import itq, jaccard, links

SF = "/root/testdata/sf0.001"


def truth(ids, linked):
    """n_links and component of each id from a square bool matrix."""
    n = len(ids)
    linked = linked & ~np.eye(n, dtype=bool)
    least = np.array(ids)
    while True:
        low = np.array([min([least[k], *least[linked[k]]]) for k in range(n)])
        if (low == least).all():
            return {i: (int(linked[k].sum()), int(least[k])) for k, i in enumerate(ids)}
        least = low


def near_texts(seed=3, groups=12, copies=9):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(groups):
        base = list(rng.choice(vocab, int(rng.integers(30, 200))))
        for _ in range(copies):
            ws = list(base)
            for _ in range(int(rng.integers(0, 5))):
                ws[int(rng.integers(len(ws)))] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(ws)))
    return rows


def check_jaccard(spark, rows, df=None):
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    m = np.array([[bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    want = truth([i for i, _ in rows], m)
    got = {r.id: (r.n_links, r.component_id) for r in jaccard.join(df or spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_jaccard_equals_brute_force(spark):
    check_jaccard(spark, near_texts())


def test_jaccard_on_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_jaccard(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_jaccard_blocks_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 8)
    monkeypatch.setattr(links, "WHOLE_BLOCK", 5)
    check_jaccard(spark, near_texts(5, 3, 40))


def signatures(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.mapInArrow(jaccard._signatures(jaccard.TREES, jaccard.DEEPEST), "id long, h1 long, h2 long, n long, sig binary").select("id", "sig")


def passage_texts(n=220, seed=6):
    """Texts that share most of a passage, beside others of their own."""
    rng = np.random.default_rng(seed)
    vocab = [f"v{k}" for k in range(5000)]
    passage = list(rng.choice(vocab, 120))
    return [(k, " ".join(passage + list(rng.choice(vocab, 60)))) for k in range(n)] + [(n + k, " ".join(rng.choice(vocab, 90))) for k in range(60)]


def test_crowded_nodes_are_taken_deeper_and_keep_the_recall(spark):
    rows = passage_texts()
    least = jaccard.depth()
    got = jaccard.deeper(signatures(spark, rows), 0.8, jaccard.TREES, least, jaccard.DEEPEST, jaccard.RECALL, 10).collect()
    by = {}
    for r in got:
        assert least < r.depth <= jaccard.DEEPEST
        by.setdefault(r.id, {})[r.t] = r.depth
    assert by and not set(by) & set(range(220, 280))  # what shares nothing is matched by short prefixes
    assert {d for x in by.values() for d in x.values()} >= {least + 1, least + 2}
    for x in by.values():
        miss = np.prod([1 - 0.8 ** x.get(t, least) for t in range(jaccard.TREES)])
        assert 1 - miss >= jaccard.RECALL - 1e-9
    # documents of a node agree on it: equal codes are equal prefixes of one length
    codes = {r.id: np.frombuffer(r.code, np.uint64) for r in jaccard.forest(signatures(spark, rows), crowd=10).collect()}
    flat = {r.id: np.frombuffer(r.code, np.uint64) for r in jaccard.forest(signatures(spark, rows), crowd=10**6).collect()}
    pairs = lambda c: {(a, b) for t in range(jaccard.TREES) for part in groups({i: x[t] for i, x in c.items()}) for a in part for b in part if a < b}
    assert pairs(codes) < pairs(flat)


def groups(key):
    out = {}
    for i, k in key.items():
        out.setdefault(k, []).append(i)
    return out.values()


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_forest_recall_at_a_similarity(spark, similarity):
    """Pairs of sets at the similarity, all of whose nodes are crowded, still meet."""
    rng = np.random.default_rng(9)
    n, rows = 300, []
    own = round(n * (1 - similarity) / (1 + similarity))
    for k in range(400):
        base = [f"b{k}x{m}" for m in range(n - own)]
        for side in "ab":
            rows.append((len(rows), base + [f"{side}{k}y{m}" for m in range(own)]))
    import xxhash

    sets = [np.unique(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in ws], np.uint64)) for _, ws in rows]
    run = jaccard._signatures(jaccard.TREES, jaccard.DEEPEST)
    saved, jaccard.shingle_sets = jaccard.shingle_sets, lambda texts: [sets[int(t)] for t in texts]
    try:
        import pyarrow as pa

        batch = next(run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([str(k) for k in range(len(rows))])], names=["id", "text"])])))
    finally:
        jaccard.shingle_sets = saved
    p = jaccard._prefixes(links.matrix(batch.column(4)), jaccard.DEEPEST)
    miss = lambda d: (1 - 0.8**d) ** jaccard.TREES
    deep = max(d for d in range(1, jaccard.DEEPEST + 1) if 1 - miss(d) >= jaccard.RECALL)
    assert deep > jaccard.depth()
    met = [(p[a, :, deep - 1] == p[a + 1, :, deep - 1]).any() for a in range(0, len(rows), 2)]
    assert np.mean(met) >= 0.97


def test_jaccard_with_crowded_nodes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 6)
    rows = near_texts(5, 3, 40) + [(1000 + k, t) for k, t in passage_texts(60)]
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    m = np.array([[bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    want = truth([i for i, _ in rows], m)
    got = {r.id: (r.n_links, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, there = sum(x for x, _ in got.values()), sum(x for x, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.98 * there > 0
    assert {k: c for k, (_, c) in got.items()} == {k: c for k, (_, c) in want.items()}


def test_jaccard_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (5, "one two three four five six"), (5, "one two three four five six"), (None, "a b"), (7, "x " * 40_000), (8, "other text"), (8, "a b"), (9, ""), (9, None), (None, "alone here"), (None, "alone here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    got = sorted((str(r.id), r.n_links, str(r.component_id), r.kept) for r in jaccard.join(df).collect())
    assert got == [("1", 0, "1", True), ("2", 0, "2", True), ("3", 3, "3", True), ("4", 3, "3", False), ("5", 1, "5", True), ("5", 1, "5", True), ("7", 0, "7", True), ("8", 0, "8", True), ("8", 3, "3", False), ("9", 0, "9", True), ("9", 0, "9", True), ("None", 1, "None", True), ("None", 1, "None", True), ("None", 3, "3", False)]
    assert jaccard.join(df.limit(0)).count() == 0
    left = sorted((str(r.doc_id), str(r.text)[:10]) for r in jaccard.kept(df).collect())
    assert [x for x in left if x[0] != "9"] == [("1", "None"), ("2", ""), ("3", "a b"), ("5", "one two th"), ("7", "x x x x x "), ("8", "other text"), ("None", "alone here")] and len(left) == 8
    assert jaccard.kept(df).columns == df.columns and jaccard.kept(df.limit(0)).count() == 0
    plain = df.where("doc_id IN (1, 2, 3, 4, 7)")
    assert sorted(r.doc_id for r in jaccard.kept(plain).collect()) == [1, 2, 3, 7]


def test_depth_reaches_the_recall():
    d = jaccard.depth()
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= jaccard.SURE > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES


def vectors(seed=1, n=300, dim=64, turn=0.3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dim))
    x = np.concatenate([base + turn * rng.uniform(0, 1.6, (len(base), 1)) * rng.standard_normal(base.shape) for _ in range(6)])
    return x.astype(np.float32)


def test_itq_equals_brute_force(spark):
    x = vectors()
    x[7] = x[3]
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = itq.unit(x.astype(np.float64))
    m = u @ u.T >= 0.9
    want = truth(list(range(len(x))), m)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in itq.join(df).collect()}
    assert all(got[k][0] <= want[k][0] for k in want)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert there > 300 and found >= 0.97 * there
    assert all(g[2] == (k == g[1]) for k, g in got.items())


def clouds():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64))
    yield "round", x, 1 << 24
    yield "few vectors", x, 3000
    yield "a shared component", x + 1.5, 1 << 20
    yield "a spectrum", x / np.sqrt(np.arange(1, 65)), 1 << 20
    yield "8 dimensions", x[:, :8], 1 << 20
    yield "2 dimensions", x[:, :2], 1 << 20


@pytest.mark.parametrize(("name", "x", "n"), list(clouds()), ids=lambda v: v if isinstance(v, str) else "")
def test_itq_recall_at_the_threshold(name, x, n):
    x = itq.unit(x)
    m = itq.Model(x, n)
    code = itq.codes(x, m, m.tables)
    for make in (itq.neighbours, itq.towards):
        other = make(x, 0.9, np.random.default_rng(1))
        apart = np.bitwise_count(code ^ itq.codes(other, m, m.tables))
        met = (apart == 0).any(1) & (apart.sum(1, dtype=np.int64) <= m.most)
        assert met.mean() >= 0.96
    sizes = [np.unique(code[:, t], return_counts=True)[1].max() / len(x) for t in range(m.tables)]
    if "dimensions" not in name:
        assert max(sizes) < (0.02 if n > 3000 else 0.2)


def test_itq_substrings_grow_with_the_vectors():
    x = itq.unit(np.random.default_rng(0).standard_normal((3000, 64)))
    a, b = itq.Model(x, 3000), itq.Model(x, 1 << 28)
    assert a.width < b.width and a.tables < b.tables


def test_itq_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, one), (7, one), (8, [2.0, 4.0, 6.0]), (9, [1.0, 2.0]), (6, one), (None, one), (10, [0.0, 1.0, 0.0]), (10, [0.0, 0.0, 1.0]), (11, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    got = sorted((str(r.id), r.n_links, str(r.component_id), r.kept) for r in itq.join(df).collect())
    assert got == [("1", 0, "1", True), ("10", 0, "10", True), ("10", 1, "10", True), ("11", 1, "10", False), ("2", 0, "2", True), ("3", 0, "3", True), ("4", 0, "4", True), ("5", 0, "5", True), ("6", 4, "6", True), ("6", 4, "6", True), ("7", 4, "6", False), ("8", 4, "6", False), ("9", 0, "9", True), ("None", 4, "6", False)]
    assert itq.join(df.limit(0)).count() == 0


def test_itq_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(itq, "LENGTHS", 1)
    rng = np.random.default_rng(4)
    rows = []
    for dim, n in ((16, 150), (8, 90), (3, 5)):
        base = rng.standard_normal((n, dim))
        rows += [v for v in base] + [v + 0.05 * rng.standard_normal(dim) for v in base[: n // 2]]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    m = np.zeros((len(rows), len(rows)), bool)
    rows = [v.astype(np.float32).astype(np.float64) for v in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            m[i, j] = len(a) == len(b) and a @ b >= 0.9 * np.sqrt((a @ a) * (b @ b))
    want = truth(list(range(len(rows))), m)
    got = {r.id: (r.n_links, r.component_id) for r in itq.join(df).collect()}
    few = [k for k in want if len(rows[k]) != 16]
    assert all(got[k] == want[k] for k in few)  # lengths without a model are compared whole
    assert sum(got[k][0] for k in want) >= 0.97 * sum(x for x, _ in want.values())


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(400, 460)]
    got = {r.id: r.component for r in links.components(spark.createDataFrame(pairs, "id long, to long")).collect()}
    ids = sorted({x for p in pairs for x in p if p[0] != p[1]})
    m = np.zeros((500, 500), bool)
    for a, b in pairs:
        m[a, b] = m[b, a] = True
    want = truth(list(range(500)), m)
    assert got == {i: want[i][1] for i in ids if want[i][1] != i}


def test_fitting_codes_takes_little_of_the_drivers_memory():
    import tracemalloc

    x = itq.unit(np.random.default_rng(5).standard_normal((1000, 64)))
    tracemalloc.start()
    itq.Model(x, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
