"""Toxicity, decontamination and language identification."""

import itertools
import re
import zlib

import numpy as np

from tessera.llm import decontam, langid, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "en"), (2, "", "en"), (3, "12 34 ...", None), (4, "word " * 30_000, "en"), (5, "the same text", "en"), (5, "the same text", "en"), (None, "no id here", "fr")]


def odd(spark):
    return spark.createDataFrame([(*r, "x", 0) for r in ODD], "doc_id long, text string, lang string, TOXIC string, score int")


def held(doc, n, rest):
    return zlib.crc32(str(doc).encode()) % n == rest


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got.values())
    rows = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    toxic, other = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert np.mean([a > b for a in toxic for b in other]) > 0.75


def test_toxicity_does_not_see_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    from tessera.llm import common

    flipped = labels.withColumn("toxic", F.when(common.crc_mod("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.scored(docs, labels, 100).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.scored(docs, flipped, 100).collect()}


def test_kneser_ney_model_is_a_distribution_and_shares_its_backoff():
    texts = [["a b a c", "b a"], ["a bad c", "x bad b", "y bad", "z bad a", "b bad", "c bad", "u bad"]]
    ids = {w: k + 1 for k, w in enumerate(sorted({w for part in texts for t in part for w in t.split()}))}
    m = toxicity.Model(ids, [[np.array([ids[w] for w in t.split()], np.int32) for t in part] for part in texts])
    assert m.word[m.ids["bad"]] > 0.3
    low = m.word[m.ids["x"]], m.word[m.size - 1]
    assert abs(low[0] - low[1]) < 1e-9  # once seen is discounted to what both classes share


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(4, 0, "a"), (5, 1, "a"), (5, 1, "a"), (None, 1, "a"), (1, None, "a"), (77, 1, "a")], "doc_id long, toxic int, text string")
    rows = toxicity.scored(odd(spark), labels).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(odd(spark), labels.limit(0)).where("score = 0 AND predicted = 0").count() == 7
    assert toxicity.scored(odd(spark).limit(0), labels).count() == 0


def plain_matches(docs, items):
    """Every pair of windows compared."""
    found = {}
    for (doc, a), (item, b) in itertools.product(docs, items):
        begins = []
        fa, va = decontam.template(a, begins)
        fb, vb = decontam.template(b)
        width = min(decontam.WINDOW, len(fb))
        hits = set()
        for x in range(len(fb) - width + 1 if width else 0):
            for y in range(len(fa) - width + 1):
                if fa[y : y + width] != fb[x : x + width]:
                    continue
                slots = {(f, p, q) for f, p, q in zip(fb[x : x + width], vb[x : x + width], va[y : y + width]) if f[0] == "\x01"}
                fixed = sum(f[0] != "\x01" for f in fb[x : x + width])
                same = vb[x : x + width] == va[y : y + width]
                sentence = y in begins and (y + width in begins or y + width == len(fa))
                if (fixed >= 5 or same and (width == decontam.WINDOW or sentence)) and len(slots) == len({s[:2] for s in slots}) == len({(s[0], s[2]) for s in slots}):
                    hits.add(x)
        if hits:
            found[doc, item] = len(hits)
    return found


QUESTIONS = [(1, "A train leaves Boston at 5 and a car leaves Boston at 7, when do they meet each other again?"), (2, "How many apples does Mary have if she buys 3 kg of them for 12 dollars in total?"), (3, "Short question here"), (4, "1 2 3 4 5 6 7 8 9"), (5, None), (6, "")]
TEXTS = [
    (1, "Intro. a train leaves Paris at 9 and a car leaves Paris at 2, when do they meet each other again? Yes."),
    (2, "Intro. a train leaves Paris at 9 and a car leaves London at 2, nobody knows."),
    (3, "so how many apples does John have if she buys seven pounds of them for 99 dollars in total"),
    (4, "this is a short question here it is"),
    (5, "9 8 7 6 5 4 3 2 1"),
    (6, "nothing of the kind"),
    (7, None),
    (8, ""),
    (9, "short question here " + "filler " * 20_000),
    (10, "He asked. Short question here! And left."),
]


def test_templates_equal_plain_comparison(spark):
    docs = spark.createDataFrame([(*r, "z") for r in [*TEXTS, TEXTS[0]]], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*r, "z") for r in [*QUESTIONS, QUESTIONS[0], (None, "nothing of the kind")]], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontam.matches(docs, bench).collect()}
    assert got == plain_matches(TEXTS, QUESTIONS)
    assert {d for d, _ in got} == {1, 2, 3, 10}  # three words count as a whole sentence only
    assert (2, 1) in got and got[2, 1] < got[1, 1]  # two cities where the item has one: those windows are inconsistent
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [4, 5, 6, 7, 8, 9]
    nameless = docs.selectExpr("CASE WHEN doc_id > 2 THEN doc_id END AS doc_id", "text", "item_id")
    assert sorted(str(r.doc_id) for r in decontam.clean(nameless, bench).collect()) == ["4", "5", "6", "7", "8", "9"]
    assert decontam.matches(docs.limit(0), bench).count() == 0 == decontam.matches(docs, bench.limit(0)).count()


def test_passages_of_the_benchmark_are_found_and_clean_documents_stay(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    runs = {}
    for r in bench.collect():
        ws = re.findall(r"\w+", r.text.lower())
        runs |= {tuple(ws[k : k + 10]): r.item_id for k in range(len(ws) - 9)}
    want = {r.doc_id for r in docs.collect() for ws in [re.findall(r"\w+", r.text.lower())] if any(tuple(ws[k : k + 10]) in runs for k in range(len(ws) - 9))}
    got = {r.doc_id for r in decontam.flagged(docs, bench).collect()}
    assert want <= got and len(got) <= len(want) + 2


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    rows = [(got[r.doc_id], r.lang) for r in docs.collect()]
    assert all(g.held_out == held(g.doc_id, 3, 1) and 0 <= g.score <= 1 for g, _ in rows)
    assert np.mean([g.lang_pred == lang for g, lang in rows if g.held_out]) > 0.97


def small_crf():
    words = {"en": "the cat and dog with this that", "fr": "le chat et chien avec cette la", "de": "der hund und katze mit das die"}
    labels = sorted(words)
    texts = [[words[k].split() * 3] * 5 for k in labels]
    return langid.Crf(labels, [set(words[k].split()) for k in labels]).fit(texts)


def test_segments_give_the_marginals_of_the_whole_chain(monkeypatch):
    crf = small_crf()
    rng = np.random.default_rng(0)
    table = rng.uniform(0.05, 1, (30, 3))
    lengths = np.array([1, 5, 40, 7, 23])
    ids = rng.integers(0, 30, lengths.sum())
    monkeypatch.setattr(langid, "SEGMENT", 7)
    got = crf.sums(table, ids, lengths)
    at = 0
    for k, n in enumerate(lengths):
        node, _ = crf._expect(np.log(table[ids[at : at + n]])[None])
        assert np.allclose(got[k], node[0].sum(0))
        at += n


def test_marginals_equal_enumeration():
    crf = small_crf()
    table = np.random.default_rng(1).uniform(0.1, 1, (4, 3))
    total = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        s = crf.start[path[0]] + sum(crf.step[a, b] for a, b in zip(path, path[1:])) + sum(np.log(table[k, p]) for k, p in enumerate(path))
        for k, p in enumerate(path):
            total[k, p] += np.exp(s)
    assert np.allclose(crf._expect(np.log(table)[None])[0][0], total / total.sum(1, keepdims=True))


def test_code_switched_words_are_labelled_apart():
    crf = small_crf()
    lab = langid.Labeller(crf)
    assert lab.predict(["the cat and this dog", "le chat avec cette chien", "... 12"])[0] == ["en", "fr", "und"]
    words = "the cat and this dog le chat avec cette chien".split()
    e = crf.emissions(words)
    assert [crf.labels[k] for k in crf._expect(e[None].astype(float))[0][0].argmax(1)] == ["en"] * 5 + ["fr"] * 5


def test_language_odd_rows(spark):
    rows = langid.identified(odd(spark)).collect()
    assert len(rows) == 7 and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert langid.identified(odd(spark).limit(0)).count() == 0


def test_toxicity_counts_all_labelled_texts_and_all_words_of_the_corpus(spark, monkeypatch):
    texts = [(k, f"plain talk number{k} about things") for k in range(40)] + [(k, f"plain talk number{k} you vile{k % 4} thing") for k in range(40, 80)] + [(200, "unlabelled words only"), (201, None)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, int(k >= 40)) for k in range(80)], "doc_id long, toxic int")
    c = toxicity.Counts(docs, labels, 80)
    key = lambda *ws: toxicity.keys(list(ws), c.mask)[0]
    at = int(np.searchsorted(c.words, key("vile3")[0]))
    assert c.stats.where(f"word = {key('vile3')[0]}").select("un20", "un21", "n").first() == (0, 1, 10)
    words = [w for _, t in texts if t for w in set(t.split())]
    assert np.isclose(c.shared[at], 10.5 / (len(words) + 0.5 * (len(set(words)) + 1)))  # "unlabelled" and "only" take their share
    few = toxicity.fit(docs, labels, 2)  # the sample has 2 texts a class, the models all
    ratio = dict(zip("you vile3 thing".split(), few.model.ratios(key(*"you vile3 thing".split()))))
    assert ratio["vile3"] > 0.3 and set(key(*[f"number{k}" for k in range(80)])) <= set(few.model.words)
    ids = {w: k + 1 for k, w in enumerate(sorted(set(words)))}
    shared = np.bincount([ids[w] for w in words], minlength=len(ids) + 2)
    plain = toxicity.Model(ids, [[np.array([ids[w] for w in t.split()]) for k, t in texts[:80] if (k >= 40) == y] for y in (False, True)], shared)
    w = "plain talk number50 you vile2 thing".split()
    full = c.model(2)
    assert len(full.pairs) == len(plain.pairs) and np.allclose(np.sort(full.pair), np.sort(plain.pair), atol=0.02)
    assert np.allclose(full.ratios(key(*w)), plain.ratios(np.array([ids[x] for x in w])), atol=0.02)
    monkeypatch.setattr(toxicity, "MOST_PAIRS", 8)
    shared = c.model(2)
    assert shared.slots and np.allclose(shared.ratios(key(*w)), full.ratios(key(*w)), atol=0.02)
    # pairs that were never seen back off as without slots, however full these are
    monkeypatch.setattr(toxicity, "SLOTS", 64)
    few = c.model(2)
    odd = "things vile1 number3 thing about plain".split()  # no two of them follow each other anywhere
    assert (few.pairs > 0).mean() > 0.8 and np.allclose(few.ratios(key(*odd)), full.ratios(key(*odd)), atol=0.02)


def test_one_id_with_many_texts_stays_a_bounded_sample(spark):
    from pyspark.sql import functions as F

    many = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("vile thing number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = many.union(spark.range(8, 40).select("id", F.concat(F.lit("plain talk of day "), F.col("id").cast("string")), F.lit("fr")))
    labels = spark.createDataFrame([(k, int(k == 7)) for k in range(7, 40)], "doc_id long, toxic int")
    c = toxicity.fit(docs.select("doc_id", "text"), labels, 50)
    assert c.scores(["vile thing", "plain talk"])[0] > 0.5 > c.scores(["vile thing", "plain talk"])[1]
    assert langid.picked(docs.select("doc_id", "text", "lang"), 50).groupBy("lang").count().where("count > 50").count() == 0


def test_passages_of_many_slots_are_found(spark):
    items = [(1, "5 km in 2 hours and 3 km in 1 hour and 9 km in 4 days"), (2, "1 2 3 4 5 6 7 8 9"), (3, "so Ann Bob Cid Dan Eve Fay Gus Hal Ian")]
    texts = [
        (1, "he ran 5 km in 2 hours and 3 km in 1 hour and 9 km in 4 days then slept"),  # copied
        (2, "they ran 6 km in 7 hours and 8 km in 5 hour and 1 km in 3 days then slept"),  # other numbers
        (3, "they ran 6 km in 7 hours and 6 km in 7 hour and 6 km in 7 days then slept"),  # one value for several
        (4, "count 1 2 3 4 5 6 7 8 9 now"),
        (5, "count 9 8 7 6 5 4 3 2 1 now"),
        (6, "with Ann Bob Cid Dan Eve Fay Gus Hal Ian here"),
        (7, "ran 6 km in 7 hours and stopped"),
    ]
    got = {(r.doc_id, r.item_id): r.exact for r in decontam.matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): True, (2, 1): False, (4, 2): True, (6, 3): True}


def test_items_of_a_word_delete_nothing(spark):
    docs = spark.createDataFrame([(1, "we saw the house on page 9 of it"), (2, "Yes. the end"), (3, "Is it so? Yes. No.")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the"), (2, "Yes"), (3, "page 7"), (4, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).orderBy("doc_id").collect()] == [(2, 2), (3, 2)]
    assert [r.doc_id for r in decontam.clean(docs, bench.where("item_id != 2")).orderBy("doc_id").collect()] == [1, 2, 3]


def test_the_filter_loses_nothing_whatever_its_size(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    bench = spark.createDataFrame(QUESTIONS, "item_id long, text string")
    want = sorted(map(tuple, decontam.matches(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOOM_LEAST", 64)
    monkeypatch.setattr(decontam, "BLOOM_MOST", 64)
    assert sorted(map(tuple, decontam.matches(docs, bench).collect())) == want


def plain_kneser_ney(parts, shared, size):
    """Log ratios of (before, word) by plain dictionaries: parts are the texts of both classes, as word numbers."""
    import math

    logs = []
    for texts in parts:
        behind, of_pair = {}, {}
        for t in texts:
            for a, b, c in zip([0, *t[:-1]], t, [*t[1:], size - 1]):
                of_pair.setdefault((a, b), set()).add(c)
        for a, b in of_pair:
            behind.setdefault(b, set()).add(a)
        n = {p: len(x) for p, x in of_pair.items()}
        ones, twos = sum(x == 1 for x in n.values()), sum(x == 2 for x in n.values())
        d = min(ones / (ones + 2 * twos), 0.9)
        total = sum(len(x) for x in behind.values())
        base = sum(shared) + 0.5 * size

        def low(w, behind=behind, total=total, base=base):
            k = len(behind.get(w, ()))
            left = sum(min(len(x), 1) for x in behind.values()) / total
            return (k - min(k, 1)) / total + left * (shared[w] + 0.5) / base

        def p(a, b, n=n, d=d, low=low):
            row = {x: k for (y, x), k in n.items() if y == a}
            if not row:
                return low(b)
            return (max(row.get(b, 0) - d, 0) + d * len(row) * low(b)) / sum(row.values())

        logs.append(p)
    return lambda a, b: math.log(logs[1](a, b)) - math.log(logs[0](a, b))


def test_kneser_ney_equals_plain_dictionaries():
    rng = np.random.default_rng(3)
    ids = {f"w{k}": k + 1 for k in range(12)}
    parts = [[[int(x) for x in rng.integers(1, 13, rng.integers(1, 9))] for _ in range(25)] for _ in range(2)]
    shared = np.zeros(14)
    for w in range(1, 13):
        shared[w] = sum(w in t for part in parts for t in part) + 3
    m = toxicity.Model(ids, [[np.array(t) for t in part] for part in parts], shared)
    plain = plain_kneser_ney(parts, shared.tolist(), 14)
    for t in parts[0][:10] + parts[1][:10]:
        assert np.allclose(m.ratios(np.array(t)), [plain(a, b) for a, b in zip([0, *t[:-1]], t)])


def test_toxicity_is_the_same_however_many_words_and_pairs_there_are(spark, monkeypatch):
    texts = [(k, f"plain talk number{k} about things") for k in range(40)] + [(k, f"plain talk number{k} you vile{k % 4} thing") for k in range(40, 80)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, int(k >= 40)) for k in range(80)], "doc_id long, toxic int")
    want = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "MOST_PAIRS", 8)
    monkeypatch.setattr(toxicity, "SLOTS", 64)
    monkeypatch.setattr(toxicity, "AT_ONCE", 50)
    got = toxicity.fit(docs, labels)
    assert got.model.mask == want.model.mask and sorted(got.model.pairs.tolist()) == sorted(want.model.pairs.tolist())
    every = [t for _, t in texts] + [None, "", "things vile1 number3 thing about plain"]
    assert np.array_equal(got.scores(every), want.scores(every))
    key, gain = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 1000)), np.linspace(-9, 9, 1000)
    back = toxicity.unpacked(toxicity.packed(key, gain))
    assert np.array_equal(back[0], key) and np.array_equal(back[1], gain.astype(np.float16))
