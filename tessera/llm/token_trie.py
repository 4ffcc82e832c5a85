"""Unigram token counts by dynamic programming over a trie of distinct pre-tokens.

Pieces come from a public vocabulary; its order is turned into unigram probabilities by Zipf's rule,
p(rank) ~ 1 / (rank + 1). A pre-token is a white-space separated word behind the word mark. Distinct
pre-tokens are put into a trie; the forward score of a node (the best score of any segmentation of its prefix,
and the tokens it has) is computed once for all words that share the prefix, and terminals keep the count.
The trie is walked depth first over the sorted words, so only the path to the current node is held.

Characters outside the vocabulary cost one byte token for each of their UTF-8 bytes. Between equal scores the
segmentation with fewer tokens counts.

Defined cases: null and empty texts, and those of white space only, have 0 tokens; repeated rows are counted
each; an empty table gives no rows; words of any length are segmented whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
SCHEMA = "doc_id long, n_words long, n_tokens long"


@lru_cache(2)
def pieces(path: str) -> dict[str, float]:
    """Log probability of each piece of a sentencepiece file, by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    norm = math.log(sum(1 / (k + 1) for k in range(len(plain))))
    return {p: -math.log(k + 1) - norm for k, p in enumerate(plain)}


class TrieCounts:
    """Token counts of distinct pre-tokens; scores of shared prefixes are computed once."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.byte = min(scores.values()) - 1.0
        # a suffix can only end a piece of these lengths, by last character
        ends: dict[str, set[int]] = {}
        for p in scores:
            ends.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: sorted(x) for c, x in ends.items()}
        self.computed = 0

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        scores, ends, byte = self.scores, self.ends, self.byte
        out: dict[str, int] = {}
        path = ""  # the prefix whose node the walk is at
        best, tokens = [0.0], [0]  # forward score and token count of each prefix of path
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for at in range(shared + 1, len(word) + 1):
                c = word[at - 1]
                n = len(c.encode("utf-8", "surrogatepass"))
                top, few = best[at - 1] + byte * n, tokens[at - 1] + n
                for length in ends.get(c, ()):
                    if length > at:
                        break
                    s = scores.get(word[at - length : at])
                    if s is not None:
                        s += best[at - length]
                        k = tokens[at - length] + 1
                        if s > top or s == top and k < few:
                            top, few = s, k
                best.append(top)
                tokens.append(few)
            self.computed += len(word) - shared
            path = word
            out[word] = tokens[-1]
        return out


#: Words that a worker remembers, and the longest of them.
KNOWN, KNOWN_CHARS = 500_000, 100


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = TrieCounts(pieces(path)), {}
        for batch in batches:
            split = [t.split() if t else [] for t in batch.column(1).to_pylist()]
            new = {w for ws in split for w in ws if w not in known}
            if len(known) + len(new) > KNOWN:
                known = {}
                new = {w for ws in split for w in ws}
            got = {w[1:]: n for w, n in trie.counts(MARK + w for w in new).items()}
            known |= got
            totals = [sum(map(known.__getitem__, ws)) for ws in split]
            for w in [w for w in got if len(w) > KNOWN_CHARS]:
                del known[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(ws) for ws in split], pa.int64()), pa.array(totals, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Words and tokens of each document; no shuffle."""
    common.ship(docs.sparkSession)
    return common.only(docs, doc_id="long", text="string").mapInArrow(_counter(path), SCHEMA)
