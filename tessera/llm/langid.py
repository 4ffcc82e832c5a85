"""Language identification by a linear-chain conditional random field over words.

Each word has a language as its label, so texts that switch between languages are labelled word by word.
Features are affixes, character n-grams, the word itself and its membership in the lexicon of a language, hashed
to DIM weights for each label; transitions between labels are learned with them. Training sequences are spans
of labelled texts, some of them put together from texts of several languages. Marginals come from the
forward-backward algorithm over the whole text; the language with the largest mean marginal is predicted,
and that mean is the score.

The model is fitted on at most PER_LANG labelled texts of each language, those with the least hashes of their
ids; every text is labelled whole, in segments whose messages are exact.

Defined cases: null texts and those without a letter get `und` with score 0, as do all texts if no language is
known; repeated rows are labelled each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PER_LANG = 400
DIM = 1 << 17
#: Training sequences, words of each, passes over them, and sequences of a step.
SEQUENCES, LENGTH, PASSES, STEP = 2400, 32, 4, 48
#: Words of a lexicon, and of a segment of forward-backward.
LEXICON, SEGMENT = 500, 256
HELD, HELD_REST = 3, 1
#: Parts that the texts of a language are dealt to before the least are taken of all.
SPREAD = 16

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Lower-case words of the text that have a letter."""
    if not text:
        return []
    ws = _LETTERS.findall(text.lower())
    return ws if text.isascii() else [w for w in ws if w.isalpha() or any(map(str.isalpha, w))]


class Crf:
    def __init__(self, labels: list[str], lexicons: list[set[str]]):
        self.labels, self.n = labels, len(labels)
        self.member: dict[str, list[int]] = {}
        for k, words in enumerate(lexicons):
            for w in words:
                self.member.setdefault(w, []).append(DIM + k)
        self.weight = np.zeros((DIM + self.n, self.n))
        self.step = np.zeros((self.n, self.n))  # transitions
        self.start = np.zeros(self.n)

    def features(self, word: str) -> list[int]:
        h = xxhash.xxh32_intdigest
        w = f"^{word}$"
        n = len(w)
        found = [h(f"w{word}")]
        found += [h(f"p{w[:k]}") for k in (2, 3, 4) if k < n] + [h(f"s{w[-k:]}") for k in (2, 3, 4) if k < n]
        found += [h(w[a : a + k]) for k in (1, 2, 3) for a in range(n - k + 1)]
        return [x % DIM for x in found] + self.member.get(word, [])

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, self.n))
        lists = [self.features(w) for w in words]
        size = np.array([len(x) for x in lists])
        flat = np.fromiter((x for f in lists for x in f), np.int64, int(size.sum()))
        return np.add.reduceat(self.weight[flat], np.cumsum(size) - size) / np.sqrt(size)[:, None]

    def fit(self, texts: list[list[list[str]]], seed: int = 5) -> Crf:
        """texts: words of each text, by label."""
        rng = np.random.default_rng(seed)
        pools = [[t for t in part if t] for part in texts]
        usable = [k for k in range(self.n) if pools[k]]
        spans, labels = [], []
        for s in range(SEQUENCES):
            seq: list[str] = []
            lab: list[int] = []
            switches = s % 2 == 1 and len(usable) > 1
            k = int(rng.choice(usable))
            while len(seq) < LENGTH:
                t = pools[k][int(rng.integers(len(pools[k])))]
                take = min(LENGTH - len(seq), int(rng.integers(4, 17)) if switches else LENGTH, len(t))
                a = int(rng.integers(len(t) - take + 1))
                seq += t[a : a + take]
                lab += [k] * take
                if switches:
                    k = int(rng.choice([x for x in usable if x != k]))
            spans.append(seq)
            labels.append(lab)
        index = {w: k for k, w in enumerate(dict.fromkeys(w for s in spans for w in s))}
        lists = [self.features(w) for w in index]
        size = np.array([len(x) for x in lists])
        flat = np.fromiter((x for f in lists for x in f), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        words = np.array([[index[w] for w in s] for s in spans])
        gold = np.array(labels)
        seen = [np.full(x.shape, 1e-8) for x in (self.weight, self.step, self.start)]
        for turn in range(PASSES):
            order = rng.permutation(len(spans))
            for a in range(0, len(order), STEP):
                m = order[a : a + STEP]
                x, y = words[m], gold[m]
                used, place = np.unique(x, return_inverse=True)
                place = place.reshape(x.shape)
                n = size[used]
                at = np.repeat(begin[used], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                feats = flat[at]
                scale = 1 / np.sqrt(n)[:, None]
                e = (np.add.reduceat(self.weight[feats], np.cumsum(n) - n) * scale)[place]
                node, edge = self._expect(e)
                one = np.eye(self.n)[y]
                diff = (one - node) / len(m)
                g = np.zeros((len(used), self.n))
                np.add.at(g, place.ravel(), diff.reshape(-1, self.n))
                rows, where = np.unique(feats, return_inverse=True)
                gw = np.zeros((len(rows), self.n))
                np.add.at(gw, where, np.repeat(g * scale, n, axis=0))
                seen[0][rows] += gw * gw
                self.weight[rows] += 0.3 * gw / np.sqrt(seen[0][rows])
                gt = (np.einsum("bti,btj->ij", one[:, :-1], one[:, 1:]) - edge) / len(m)
                seen[1] += gt * gt
                self.step += 0.1 * gt / np.sqrt(seen[1])
                gs = diff[:, 0].sum(0)
                seen[2] += gs * gs
                self.start += 0.1 * gs / np.sqrt(seen[2])
        self.weight = self.weight.astype(np.float32)
        return self

    def _expect(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and expected transitions of equally long sequences (batch x time x label)."""
        f = np.exp(e - e.max(2, keepdims=True))
        t = np.exp(self.step)
        alpha, beta = np.empty_like(f), np.empty_like(f)
        alpha[:, 0] = f[:, 0] * np.exp(self.start)
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for k in range(1, f.shape[1]):
            alpha[:, k] = (alpha[:, k - 1] @ t) * f[:, k]
            alpha[:, k] /= alpha[:, k].sum(1, keepdims=True)
        beta[:, -1] = 1
        for k in range(f.shape[1] - 2, -1, -1):
            beta[:, k] = (f[:, k + 1] * beta[:, k + 1]) @ t.T
            beta[:, k] /= beta[:, k].sum(1, keepdims=True)
        node = alpha * beta
        node /= node.sum(2, keepdims=True)
        edge = alpha[:, :-1, :, None] * t * (f[:, 1:] * beta[:, 1:])[:, :, None, :]
        edge /= edge.sum((2, 3), keepdims=True)
        return node, edge.sum((0, 1))

    def sums(self, table: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of the marginals of each text. table: exp of emissions by word; ids: words of all texts, one
        after the other; lengths: words of each text, all above 0. Long texts are cut into segments, whose
        incoming messages are products of the transfer matrices of those before and behind them."""
        t, n = np.exp(self.step), self.n
        texts = np.repeat(np.arange(len(lengths)), -(-lengths // SEGMENT))
        first_of = np.concatenate([[0], np.cumsum(-(-lengths // SEGMENT))])[:-1]
        rank = np.arange(len(texts)) - first_of[texts]
        begin = (np.cumsum(lengths) - lengths)[texts] + rank * SEGMENT
        size = np.minimum(SEGMENT, lengths[texts] - rank * SEGMENT)
        head = np.exp(self.start - self.start.max())
        # pass one: transfer matrices of the segments of texts of several
        several = np.flatnonzero(lengths[texts] > SEGMENT)
        enter = np.zeros((len(texts), n))  # what comes in before the first word, transitions applied
        enter[rank == 0] = head
        leave = np.ones((len(texts), n))  # what comes back behind the last word
        if len(several):
            m = np.broadcast_to(np.eye(n), (len(several), n, n)).copy()
            longest = int(size[several].max())
            for k in range(longest):
                on = np.flatnonzero(size[several] > k)
                f = table[ids[begin[several[on]] + k]]
                x = m[on] * f[:, None, :] if k == 0 else (m[on] @ t) * f[:, None, :]
                m[on] = x / x.sum((1, 2), keepdims=True)
            place = np.full(len(texts), -1)
            place[several] = np.arange(len(several))
            last = lengths[texts] <= (rank + 1) * SEGMENT
            for r in range(1, int(rank.max()) + 1):
                s = np.flatnonzero(rank == r)
                x = np.einsum("si,sij->sj", enter[s - 1], m[place[s - 1]]) @ t
                enter[s] = x / x.sum(1, keepdims=True)
            for r in range(int(rank.max()) - 1, -1, -1):
                s = np.flatnonzero((rank == r) & ~last)
                x = np.einsum("sij,sj->si", m[place[s + 1]], leave[s + 1]) @ t.T
                leave[s] = x / x.sum(1, keepdims=True)
        # pass two: forward, then backward, all segments at once, the longest first
        order = np.argsort(-size, kind="stable")
        begin, size, of = begin[order], size[order], texts[order]
        enter, back = enter[order], leave[order]
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
        forward = []
        alpha = enter
        for k, a in enumerate(active):
            f = table[ids[begin[:a] + k]]
            alpha = (alpha[:a] if k == 0 else alpha[:a] @ t) * f
            alpha /= alpha.sum(1, keepdims=True)
            forward.append(alpha)
        out = np.zeros((len(lengths), n))
        got = np.zeros((len(size), n))
        for k in range(len(active) - 1, -1, -1):
            a = active[k]
            p = forward[k] * back[:a]
            got[:a] += p / p.sum(1, keepdims=True)
            if k:
                x = (back[:a] * table[ids[begin[:a] + k]]) @ t.T
                back[:a] = x / x.sum(1, keepdims=True)
        np.add.at(out, of, got)
        return out


class Labeller:
    """A worker's view of a model: emissions of words are kept from batch to batch."""

    MOST = 400_000

    def __init__(self, crf: Crf | None):
        self.crf = crf
        self.clear()

    def clear(self):
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, self.crf.n if self.crf else 0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        split = [letters(t) for t in texts]
        rows = [k for k, ws in enumerate(split) if ws]
        if self.crf is None or not rows:
            return lang, score
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.ids))
        if len(self.ids) + len(new) > self.MOST:
            self.clear()
            new = list(dict.fromkeys(w for ws in split for w in ws))
        fresh = [self.crf.emissions(new[a : a + 20_000]) for a in range(0, len(new), 20_000)]
        if new:
            e = np.concatenate(fresh).astype(np.float64)
            self.table = np.concatenate([self.table, np.exp(np.maximum(e - e.max(1, keepdims=True), -60))])
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        get = self.ids.__getitem__
        lengths = np.array([len(split[k]) for k in rows])
        ids = np.fromiter((get(w) for k in rows for w in split[k]), np.int64, int(lengths.sum()))
        mean = self.crf.sums(self.table, ids, lengths) / lengths[:, None]
        for k, p in zip(rows, mean):
            best = int(p.argmax())
            lang[k], score[k] = self.crf.labels[best], min(1.0, float(p[best]))
        return lang, score


def picked(docs: DataFrame, per_lang: int) -> DataFrame:
    """(lang, text): for each language the per_lang different texts of the least hashes of their ids.

    Each partition keeps the least of its own, and spread keys merge these before a language's meet, so that the
    last step sees per_lang x SPREAD rows of a language, however many partitions there are."""
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"))
    for deal in (F.pmod(F.xxhash64("doc_id", "t"), F.lit(SPREAD)), F.lit(0)):
        order = Window.partitionBy("lang", "deal").orderBy("h", "doc_id", "t")
        rows = rows.withColumn("deal", deal).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).drop("deal", "k")
    rows = rows.select("lang", "doc_id", "t").distinct()
    found = docs.withColumn("t", F.xxhash64("text")).join(F.broadcast(rows), ["lang", "doc_id", "t"]).select("lang", "doc_id", "t", "text")
    # a text that an id repeats comes once
    return found.groupBy("lang", "doc_id", "t").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Crf | None:
    """docs: (doc_id, text, lang), held-out ids excluded by the caller."""
    # per_lang rows of each language
    rows = picked(docs, per_lang).collect()
    unique: dict[str, dict[str | None, None]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text or "")):
        unique.setdefault(r.lang, {})[r.text] = None
    labels = list(unique)
    texts = [[letters(t) for t in unique[lang]] for lang in labels]
    have = [k for k in range(len(labels)) if any(texts[k])]
    labels, texts = [labels[k] for k in have], [texts[k] for k in have]
    if not labels:
        return None
    held = [Counter(w for ws in part for w in set(ws)) for part in texts]
    lexicons = [{w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n > 2} for c in held]
    return Crf(labels, lexicons).fit(texts)


def identified(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; learned from documents that are not held out."""
    spark = common.ship(docs.sparkSession)
    df = common.only(docs, doc_id="long", text="string", lang="string")
    held = F.coalesce(common.crc_mod("doc_id", HELD) == HELD_REST, F.lit(False))
    sent = spark.sparkContext.broadcast(fit(df.where(~held), per_lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in batches:
            lang, score = labeller.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return df.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, SCHEMA)
