"""The pipeline end to end and each stage on odd rows."""

import corpus_pipeline
from tessera.llm import common, decontam, jaccard, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontamination", "pii", "best_fit_packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, at, SF))
        assert out.columns == docs.columns and 0 < out.count() <= at.count()
        if name == "ngram_jaccard":
            assert jaccard.join(out).where("n_links > 0").count() == 0
        if name == "decontamination":
            assert decontam.matches(out, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "pii":
            assert pii.spans(out).where("spans != ''").count() == 0
        if name == "toxicity":
            bad = toxicity.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").count()
            assert out.count() == docs.count() - bad
        at = out
    ids = {r.doc_id for r in at.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_stages_equal_plain_versions(spark):
    """Each stage against what plain Python makes of the same documents."""
    import re

    import numpy as np
    import public_tokenizers
    import tokenizers

    from tessera.llm import packing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    words = {d: re.findall(r"\w+", t.lower()) for d, t in texts.items()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    least = {d: d for d in texts}
    while True:
        now = {d: min([least[d], *(least[e] for e in texts if sets[d] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]))]) for d in texts}
        if now == least:
            break
        least = now
    single = common.cut(stage["ngram_jaccard"](spark, docs, SF))
    assert {r.doc_id for r in single.collect()} == {d for d, x in least.items() if x == d}
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 9]) for w in items for k in range(len(w) - 8)}
    seen = {d for d, w in words.items() if any(tuple(w[k : k + 9]) in runs for k in range(len(w) - 8))}
    clean = {r.doc_id for r in stage["decontamination"](spark, docs, SF).collect()}
    assert clean.isdisjoint(seen) and len(texts) - len(clean) <= len(seen) + 2
    private = common.cut(stage["pii"](spark, docs, SF))
    assert {r.doc_id: r.text for r in private.collect()} == {d: pii.redact(t) for d, t in texts.items()}
    tk = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {d: len(tk.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    pieces = sorted((d, k, min(8192, n[d] - 8192 * k)) for d in n for k in range(-(-n[d] // 8192)))
    bins, offsets, caps = packing.pack([x for _, _, x in pieces])
    want = sorted((d, k, x, caps[b], o) for (d, k, x), b, o in zip(pieces, bins, offsets))
    assert sorted((r.doc_id, r.piece, r.length, r.bin_capacity, r.bin_offset) for r in stage["best_fit_packing"](spark, docs, SF).collect()) == want
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.scored(docs, labels).where("score >= 0.5").collect()}
    assert {r.doc_id for r in stage["toxicity"](spark, docs, SF).collect()} == set(texts) - bad


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "plain words here", "en", "s", 16, "x"), (3, "plain words here", "en", "s", 16, "x"), (None, "no id", "en", None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, LABEL string")
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, SF)
            if name != "best_fit_packing":
                assert out.columns == list(pii.DOCUMENT)
            assert out.count() == (4 if name == "ngram_jaccard" and part is docs else part.count())  # one of two equal rows


def test_the_toxicity_stage_keeps_the_same_however_many_words_and_pairs_there_are(spark, monkeypatch):
    texts = [(k, f"plain talk number{k} about things") for k in range(40)] + [(k, f"plain talk number{k} you vile{k % 4} thing") for k in range(40, 80)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, int(k >= 40)) for k in range(80)], "doc_id long, toxic int")
    want = sorted(r.doc_id for r in toxicity.accepted(docs, docs, labels).collect())
    monkeypatch.setattr(toxicity, "MOST_PAIRS", 8)
    monkeypatch.setattr(toxicity, "SLOTS", 8)
    assert 0 < len(want) < 80 and sorted(r.doc_id for r in toxicity.accepted(docs, docs, labels).collect()) == want
