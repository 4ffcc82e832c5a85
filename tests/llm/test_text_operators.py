"""PII, WARC, Simple-8b, packing and token counts against plain versions and round trips."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, pii, simple8b, token_trie, warc

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "1" * 50_000 + "@" * 1000 + "a" * 50_000


def frame(spark, rows, schema="doc_id long, text string, DOC_ID2 string"):
    return spark.createDataFrame(rows, schema)


def odd(spark):
    return frame(spark, [(1, None, "x"), (2, "", "x"), (3, "   \n ", "x"), (4, LONG, "x"), (5, "same text", "x"), (5, "same text", "x"), (None, "no id", None)])


def plain_detect(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@+-0123456789 ()%é", max_size=60))
def test_base_spans_equal_plain_regexes(text):
    assert pii.detect(text) == plain_detect(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to john [at] mail (dot) example [dot] com now", "email", "john [at] mail (dot) example [dot] com"),
        ("write jоhn@mаil.com", "email", "jоhn@mаil.com"),
        ("jo​hn@mail.com", "email", None),
        ("john at mail dot example dot com", "email", "john at mail dot example dot com"),
        ("call plus one four one five five five five one two one two today", "phone", "plus one four one five five five five one two one two"),
        ("１２７.0.0.1 is home", "ip", "１２７.0.0.1"),
        ("card 4111 1111 1111 one one one one ok", "card", "4111 1111 1111 one one one one"),
        ("host one two seven dot zero dot zero dot one up", "ip", "one two seven dot zero dot zero dot one"),
        ("mail ann_at_mail&#46;com soon", "email", "ann_at_mail&#46;com"),
        ("ring +1 (4l5) 555-O123 now", "phone", "+1 (4l5) 555-O123"),
        ("tel +1 double five five, one two three, nine nine", "phone", "+1 double five five, one two three, nine nine"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    base, spans = pii.find(text)
    assert set(base) <= set(spans)
    if part:
        assert (kind, text.index(part), text.index(part) + len(part)) in spans
    assert pii.redact(text) != text


def test_pii_query_on_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: plain_detect(r.text) for r in docs.collect()}
    for r in pii.spans(docs).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want[r.doc_id]).encode()).hexdigest()
        assert r.n_email == sum(k == "email" for k, *_ in want[r.doc_id])
    got = pii.spans(odd(spark)).collect()
    assert len(got) == 7 and all(r.spans == "" for r in got if r.doc_id != 4)
    assert pii.spans(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["one of the two at home", "un deux trois", "meet me at noon.ok", "x <at> y", "model l5 and O2 +3", "uno dos tres cuatro cinco", "ten o'clock 10.5.3 a.b", "look at this. dot it"])
def test_prose_is_left_alone(text):
    assert pii.find(text) == ([], [])


def test_redaction_keeps_clean_text(spark):
    assert pii.redact("nothing here") == "nothing here"
    assert pii.redact("x a.b@c.de y") == "x <EMAIL> y"
    assert pii.redact(None) is None


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 2 * pages.count()
    records = warc.parse(b"".join(map(warc.serialise, rows)))
    for r, (head, body) in zip(rows, records, strict=True):
        assert head["WARC-Refers-To"] == r.response_id == r.refers_to
        assert body.decode() == r.body and head["WARC-Block-Digest"] == warc.digest(body)
    by_id = {r.response_id: r for r in warc.responses(pages).selectExpr("record_id response_id", "payload").collect()}
    assert all(r.source_digest == warc.digest(by_id[r.response_id].payload.encode()) for r in rows)
    assert not any(re.search(r"<(p|div|script)\b|track\(", r.body) for r in rows if r.record_type == "conversion")


def independent_records(data):
    """A reader of WARC files that knows nothing of the writer's."""
    out = []
    while data:
        m = re.match(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n", data)
        head = [x.split(b": ", 1) for x in m[1].split(b"\r\n") if x]
        assert len({k for k, _ in head}) == len(head)
        head = {k.decode(): v.decode() for k, v in head}
        n = int(head["Content-Length"])
        out.append((head, data[m.end() : m.end() + n]))
        assert data[m.end() + n : m.end() + n + 4] == b"\r\n\r\n"
        data = data[m.end() + n + 4 :]
    return out


def test_warc_files_are_written_and_read(spark, tmp_path, monkeypatch):
    import base64
    import gzip

    page = '<html lang="en"><title>A\n B</title><a title="x>y href=no" href=/about>q</a><A HREF=\'/b?c&amp;d\'>r</A><a href="http://x/&#13;&#10;title: forged">z</a>\r\n\r\nWARC/1.1 text</html>'
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page.encode()
    source = b"".join(b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:%d>\r\nwarc-target-uri: http://h/%d\r\nWARC-Date: 2020-01-0%dT00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, k, k, k, len(body), body) for k, kind in ((1, b"response"), (2, b"request"), (3, b"response")))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(source[:200]) + gzip.compress(source[200:]))
    (tmp_path / "in" / "b.warc").write_bytes(source.replace(b"urn:uuid:", b"urn:uuid:b"))
    found = warc.read(spark, str(tmp_path / "in"))
    assert found.count() == 6
    made = warc.derivatives(found.where("record_type = 'response'"))
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    warc.write(made, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    records = [r for f in files for r in independent_records(f.read_bytes())]
    assert len(files) > 1 and len(records) == 8 == len({h["WARC-Record-ID"] for h, _ in records})
    for head, data in records:
        assert head["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert head["WARC-Source-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
        assert base64.b64decode(head["WARC-Source-Headers"]) == b"HTTP/1.1 200 OK\r\nContent-Type: text/html"
        assert head["WARC-Refers-To"].startswith("<urn:uuid:") and head["WARC-Date"][:9] == "2020-01-0"
    lines = next(d for h, d in records if h["WARC-Type"] == "metadata").decode().split("\r\n")
    assert lines == [f"originalContentLength: {len(page)}", "declaredLanguage: en", "title: A B", "outlink: /about A/@href", "outlink: /b?c&d A/@href", "outlink: http://x/%0D%0Atitle: forged A/@href", ""]
    again = {r.record_id: r for r in warc.read(spark, str(tmp_path / "out")).collect()}
    for r in made.collect():
        assert (again[r.record_id].payload, again[r.record_id].refers_to, again[r.record_id].source_headers) == (r.body, r.refers_to, r.source_headers)


def test_warc_ids_differ_where_responses_do(spark):
    rows = [(None, "u", "a"), (None, "u", "b"), (None, "v", "a"), ("same", "u", "a"), ("same", "u", "b"), ("same", "u", "b")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "record_id string, target_uri string, payload string, body string, BLOCK_digest int").selectExpr("*", "string(null) AS warc_date", "string(null) AS headers")
    got = warc.derivatives(df).collect()
    assert len(got) == 12 and len({r.record_id for r in got}) == 10 and all(r.warc_date is None and r.source_headers is None for r in got)
    assert warc.derivatives(df.limit(0)).count() == 0
    assert warc.plain("<p>" + "long " * 200_000) == ("long " * 200_000).strip() and len(warc.links("<a <a " * 50_000)) == 0


def test_warc_odd_pages(spark):
    df = spark.createDataFrame([("a", None, None, None, None), ("b", "u", "d", "h", "<p>x<script>y"), ("b", "u", "d", "h", "<p>x<script>y")], "record_id string, target_uri string, warc_date string, headers string, payload string")
    rows = warc.derivatives(df).collect()
    assert sorted(r.body for r in rows if r.record_type == "conversion") == ["", "x", "x"]
    assert warc.plain('a<b title="1>2">c</b>&amp;<!-- open') == "ac&"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_simple8b_round_trip(ids, times):
    ids = np.array(ids * times, np.uint64)
    data = simple8b.encode(ids)
    assert (simple8b.decode(data) == ids).all()
    a, b = len(ids) // 3, len(ids) // 2
    assert (simple8b.decode_range(data, a, b) == ids[a:b]).all()


def test_simple8b_query(spark, tmp_path):
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = tokenizers.Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(frame(spark, [(-1, None, "en", "s", 0), (-2, "Straße ÉCOLE d'été <|endoftext|>x don't İ", "en", "s", 0), (-3, "a\tb\x1cc\x85d e", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    simple8b.write(docs, str(tmp_path / "s8b"), path, shard_ids=5000)
    got = {r.doc_id: r for r in simple8b.read(spark, str(tmp_path / "s8b")).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_simple8b_odd_rows(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    simple8b.write(odd(spark), str(tmp_path / "a"), path)
    assert simple8b.read(spark, str(tmp_path / "a")).count() == 7
    simple8b.write(odd(spark).limit(0), str(tmp_path / "b"), path)
    assert simple8b.read(spark, str(tmp_path / "b")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8192), max_size=200))
def test_packing_is_whole_and_tight(lengths):
    bins, offsets, caps = packing.pack(lengths)
    by = {}
    for k, b in enumerate(bins):
        by.setdefault(b, []).append((offsets[k], lengths[k]))
    assert sorted(by) == list(range(len(caps)))
    for b, items in by.items():
        at = 0
        for o, n in sorted(items, key=lambda x: (x[0], x[1])):
            assert o == at
            at += n
        assert at <= caps[b] and not any(c >= at for c in packing.CAPACITIES if c < caps[b])


def test_packing_wastes_no_more_than_one_size():
    lengths = [int(x) for x in np.random.default_rng(1).lognormal(5.5, 1, 5000).clip(1, 8192)]
    several = sum(packing.pack(lengths)[2])
    one = sum(packing.pack(lengths, (8192,))[2])
    assert several <= one and several < 1.02 * sum(lengths)


def test_packing_query(spark):
    docs = odd(spark)
    rows = packing.packed(docs, capacities=(64, 1024), group_rows=4).collect()
    long = sorted((r.start, r.length) for r in rows if r.doc_id == 4)
    assert sum(n for _, n in long) == len(LONG.split()) + 1 and all(b[0] == a[0] + a[1] for a, b in zip(long, long[1:]))
    assert sum(r.doc_id == 5 for r in rows) == 2
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5}
    fill = {}
    for r in rows:
        fill[r.bin_id, r.bin_capacity] = fill.get((r.bin_id, r.bin_capacity), 0) + r.length
    assert len({b for b, _ in fill}) == len(fill) and all(n <= c for (_, c), n in fill.items())
    assert packing.packed(docs.limit(0)).count() == 0


def plain_count(word, scores):
    byte = min(scores.values()) - 1.0
    best = [(0.0, 0)]
    for k in range(1, len(word) + 1):
        n = len(word[k - 1].encode())
        options = [(best[k - 1][0] + byte * n, -(best[k - 1][1] + n))]
        options += [(best[j][0] + scores[word[j:k]], -(best[j][1] + 1)) for j in range(k) if word[j:k] in scores]
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_token_counts_equal_plain_dynamic_programming(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_trie.pieces(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    got = {r.doc_id: r for r in token_trie.token_counts(docs, path).collect()}
    for r in docs.collect():
        ws = r.text.split()
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (len(ws), sum(plain_count(token_trie.MARK + w, scores) for w in ws))
    trie = token_trie.TrieCounts(scores)
    trie.counts(["▁anything", "▁anyone", "▁any"])
    assert trie.computed == len("▁anything") + len("one")
    rows = token_trie.token_counts(odd(spark), path).collect()
    assert len(rows) == 7 and [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]


def test_packing_counts_tokens(spark):
    import tokenizers

    import corpus_pipeline

    tk = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = frame(spark, [(1, "antidisestablishmentarianism " * 2000, "x"), (2, "https://example.com/a?b=c&d=" * 4000, "x"), (3, None, "x"), (4, "", "x")])
    want = {r.doc_id: len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert want[2] > 8192
    pieces = {}
    for r in corpus_pipeline.pack(spark, docs, None).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, n in want.items():
        runs = sorted(pieces[doc])
        assert sum(x for _, x in runs) == n and runs[0][0] == 0 and all(x <= 8192 for _, x in runs)
        assert all(b[0] == a[0] + a[1] for a, b in zip(runs, runs[1:]))


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("card 4111 1111 1111 11 one one ok", "card", "4111 1111 1111 11 one one"),
        ("card 4111 1111 1111 111 one ok", "card", "4111 1111 1111 111 one"),
        ("card 4111 1111 1111 one one\none one ok", "card", "4111 1111 1111 one one\none one"),
        ("call +1 555 12 five five now", "phone", "+1 555 12 five five"),
        ("write to maria at example.ch soon", "email", "maria at example.ch"),
        ("write to jan at voorbeeld.nl soon", "email", "jan at voorbeeld.nl"),
        ("write to john at mail.example dot com soon", "email", "john at mail.example dot com"),
        ("escribe a juan arroba correo punto es hoy", "email", "juan arroba correo punto es"),
        ("contact jean arobase exemple point fr merci", "email", "jean arobase exemple point fr"),
        ("mail an hans at beispiel punkt de bitte", "email", "hans at beispiel punkt de"),
        ("mail hans@beispiel punkt de bitte", "email", "hans@beispiel punkt de"),
    ],
)
def test_ordinary_disguises_are_found(text, kind, part):
    assert (kind, text.index(part), text.index(part) + len(part)) in pii.find(text)[1]


@pytest.mark.parametrize("text", ["look at this point in time", "we met at home and un punto es un punto", "chapter 12 one of 3 two", "le point de vue est un point fr", "the two at one point to note"])
def test_prose_with_dots_and_numbers_is_left_alone(text):
    assert pii.find(text) == ([], [])


def test_digit_runs_of_any_length(spark):
    text = "0" * 5000 + ".1.1.1 and " + "9" * 6000 + ".1.1.1 and 1." + "0" * 4400 + "7.2.3"
    assert pii.detect(text) == [("ip", 0, 5006), ("ip", len(text) - 4407, len(text))]
    assert pii.spans(frame(spark, [(1, text, "x")])).first().n_ip == 2


BITS = ["one", "Two", "three", "fünf", "deux", "double", "triple", "plus", "dot", "point", "punkt", "at", "arroba", "@", "com", "de", "mail", "john", "x.y", "4", "41", "555", "l", "O", "ſeven", "sıx", "+1"]
GAPS = [" ", "  ", "-", ", ", "(", ") ", " [", "]", "\"", "' ", ": ", "/", "\n", "", ".", "_", "“", "—", "\u00a0"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(BITS), st.sampled_from(GAPS)), max_size=14))
def test_the_cheap_look_hides_nothing(parts):
    text = "".join(a + b for a, b in parts)
    quick = pii.find(text)
    saved, pii._hinted = pii._hinted, lambda t: True
    try:
        assert quick == pii.find(text)
    finally:
        pii._hinted = saved


@pytest.mark.parametrize("text", ["call +1 (four one five) 5551234", 'call +1 "four one five" 5551234', "call +1: four one five 555 1234", "call +1/four one five 5551234"])
def test_number_words_beside_any_mark(text):
    saved, pii._hinted = pii._hinted, lambda t: True
    try:
        want = pii.find(text)
    finally:
        pii._hinted = saved
    assert pii.find(text) == want
    if "(" in text:
        assert [k for k, _, _ in want[1]] == ["phone"]


def disguised(kind, how, rnd):
    """A value of the kind, disguised."""
    words = "zero one two three four five six seven eight nine".split()
    if kind == "email":
        name, host, end = (rnd.choice(x) for x in (["ann", "bob.k", "c_d", "eva1"], ["mail", "corp-x", "uni"], ["com", "org", "ch", "fr"]))
        return {
            "brackets": f"{name} [at] {host} (dot) {end}",
            "spaced": f"{name} at {host} dot {end}",
            "glyphs": f"{name}@{host}.{end}".replace("a", "а").replace("o", "о").replace("i", "і"),
            "invisible": f"{name}\u200b@{host}\u200d.{end}",
            "entities": f"{name}&#64;{host}&#46;{end}",
        }[how]
    if kind == "card":
        digits = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        value = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
    elif kind == "phone":
        value = "+" + rnd.choice("123456789") + "".join(rnd.choice("0123456789") for _ in range(9))
    else:
        value = ".".join(str(rnd.randrange(256)) for _ in range(4))
    if how == "wide":
        return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in value)
    if how == "spelled":
        return " ".join({"+": "plus", ".": "dot"}.get(c) or words[int(c)] for c in value)
    if how == "tail":
        return value[:-3] + (" " if kind != "ip" else "") + " ".join(words[int(c)] for c in value[-3:]) if kind != "ip" else value.replace(".", " dot ")
    return value.replace("0", "O").replace("1", "l") if any(c in value for c in "01") else value


KINDS = [("email", h) for h in ("brackets", "spaced", "glyphs", "invisible", "entities")] + [(k, h) for k in ("card", "phone", "ip") for h in ("wide", "spelled", "tail", "alike")]


@pytest.mark.parametrize(("kind", "how"), KINDS)
def test_recall_of_planted_disguises(kind, how):
    import random

    rnd = random.Random(f"{kind}{how}")
    hits = 0
    for _ in range(100):
        value = disguised(kind, how, rnd)
        text = f"Please note {value} for later."
        a = text.index(value)
        hits += any(k == kind and x < a + len(value) and y > a and y - x >= 0.8 * len(value) for k, x, y in pii.find(text)[1])
    assert hits >= (80 if how == "alike" else 90)


def plain_best_fit(lengths, capacities, overhead):
    """Contents and capacity of each bin, all bins looked at for each piece."""
    left = sorted(lengths, reverse=True)
    bins = []
    for at, n in enumerate(left):
        open_ = [b for b in bins if b[1] - sum(b[0]) >= n]
        if open_:
            least = min(b[1] - sum(b[0]) for b in open_)
            b = max((b for b in open_ if b[1] - sum(b[0]) == least), key=lambda b: b[2])  # of equal room, the last one used
            b[0].append(n)
            b[2] = at
            continue
        best = None
        for c in sorted(capacities):
            if c < n:
                continue
            filled = n + min(c - n, sum(x for x in left[at + 1 :] if x <= c - n))
            cost = (overhead + min(x for x in capacities if x >= filled)) / max(filled, 1)
            if best is None or cost < best[0]:
                best = (cost, c)
        bins.append([[n], best[1], at])
    return sorted((sorted(b), min(c for c in capacities if c >= sum(b))) for b, _, _ in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40, unique=True), st.sampled_from([(64,), (16, 64), (8, 16, 32, 64), (24, 40, 64)]))
def test_packing_equals_plain_best_fit(lengths, capacities):
    bins, _, caps = packing.pack(lengths, capacities, 3)
    got = sorted((sorted(n for n, b in zip(lengths, bins) if b == k), c) for k, c in enumerate(caps))
    assert got == plain_best_fit(lengths, capacities, 3)


def test_sequences_hold_the_ids_of_their_documents(spark):
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = tokenizers.Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(frame(spark, [(-1, None, "x"), (-2, "a b c " * 9000, "x"), (-3, "twice", "x"), (-3, "twice", "x"), (None, "no id", "x")]).select("doc_id", "text"))
    rows = packing.sequences(docs, path, group_rows=50).collect()
    assert len({r.bin_id for r in rows}) == len(rows) and all(len(r.ids) <= r.bin_capacity for r in rows)
    got = {}
    for r in rows:
        for doc, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.ids)]):
            got.setdefault(doc, []).append(r.ids[a:b])
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*tk.encode(r.text or "", add_special_tokens=False).ids, 1])
    assert set(got) == set(want)
    for doc, parts in want.items():
        assert sorted(x for p in got[doc] for x in p) == sorted(x for p in parts for x in p)
        if len(parts[0]) <= 8192:
            assert sorted(got[doc]) == sorted(parts)
    assert packing.sequences(docs.limit(0), path).count() == 0


def test_bins_of_many_runs_keep_their_ids(spark):
    rows = packing.pack_pieces(spark.range(9000).selectExpr("7L AS doc_id", "int(400) AS length"), group_rows=1).select("bin_id", "bin_capacity").collect()
    assert len({r.bin_id for r in rows}) == 9000


def test_plain_ascii_parts_take_no_pattern_and_get_the_library_s_ids(monkeypatch):
    import public_tokenizers

    from tessera.llm import simple8b

    enc = simple8b.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))

    class Never:
        def fullmatch(self, part):
            raise AssertionError(part)

    monkeypatch.setattr(simple8b, "_PLAIN", Never())
    for text in ("Some words, and THE end.", "x1 a-b  two  'q' .", ", . a. ,b"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.full.encode(text, add_special_tokens=False).ids
