"""Offset-preserving deobfuscation of personal data.

A transducer rewrites disguises (homoglyphs, invisible characters, spelled digits, at/dot words) into plain
ASCII and keeps, for each character it writes, the span of the source that it stands for. The detectors run on
the source itself and, where a disguise is present, on the rewritten text; spans found there are mapped back.

Defined cases: a null or empty text has no spans; repeated rows give repeated rows; an empty table gives an
empty result; columns beyond the id and the text are not read. A mapped span that overlaps a span of the
source of any kind is left out, so the source's own spans always stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A match never starts inside a run of digits: had the run's first digit failed, so would each later one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds the first @ after its local part, so the search runs from @ to @ in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def detect(text: str) -> list[Span]:
    """The plain detectors, sorted by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: Letters of other scripts that look like an ASCII letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "。": ".", "．": ".", "․": ".", "‧": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ",
}
#: Invisible characters, which the rewritten text leaves out.
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣﻿"
#: Number words of the four languages of the corpus.
NUMBER_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
REPEATS = {"double": 2, "triple": 3}
_TO_DIGIT = str.maketrans("OolI", "0011")
_GAPS = str.maketrans({chr(c): " " for c in range(128) if not (chr(c).isalnum() or c == 95)})

_NUM = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_UNIT = rf"(?:(?:double|triple)[\s-]+)?(?:{_NUM})(?!\w)"
_STEP = rf"(?:[\s,-]+(?:(?:dot|point)[\s-]+)?(?:{_UNIT}|[0-9]+(?!\w)))"
#: Number words next to each other or to digits; a lone one is ordinary prose.
_SPELLED = rf"(?P<beside>(?<=[0-9])[\s,-]+(?={_UNIT}))?(?<!\w)(?P<plus>plus[\s-]+)?(?P<run>{_UNIT}(?(beside){_STEP}*+|{_STEP}++))"
#: Endings of hosts: all country codes and the usual others.
_TLD = "(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|xyz|online|site|shop|store|cloud|tech|blog|email|eu|" + "|".join(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
) + ")"
#: Words for a dot; "at this point in" is prose.
_POINT = r"(?:punkt|punto|point(?!\s+(?:in|is|it|to|so|no|at|be|me|my|as|us|do|am|re|we)\b))"
_HOST = rf"[\w-]+(?:\s*[\[({{<]|(?:\.[\w-]+)*\s+dot\s|(?:\.[\w-]+)*\.{_TLD}\b(?!-)|(?:(?:\.|\s+{_POINT}\s+)[\w-]+)*?\s+{_POINT}\s+{_TLD}\b)"
_AT = rf"(?P<at>&#0*64;|&commat;|\s*[\[({{<_*]\s*(?:at|@|arroba|arobase)\s*[\])}}>_*]\s*|(?<=[\w%+-])\s+(?:at|arroba|arobase)\s+(?={_HOST})|\s+@\s+(?=[\w-]+(?:\.|\s+dot\s|\s+{_POINT}\s|\s*[\[({{<])))"
_DOT = r"(?P<dot>&#0*46;|&period;|\s*[\[({<_*]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>_*]\s*|(?<=\w)\s+dot\s+(?=\w))"
#: A dot only in a host, behind an at.
_DOT_IN_HOST = rf"(?P<point>(?<=\w)\s+{_POINT}\s+(?=\w))"
_LABELS = re.compile(r"[\w-]+(?:\.[\w-]+)*")
#: Letters that stand for 0 and 1 next to digits.
_ALIKE = r"(?P<alike>(?<=[0-9])[OolI]+(?![^\W\d_])|(?<![^\W\d_])[OolI]+(?=[0-9]))"
_RULES = re.compile(rf"{_AT}|{_SPELLED}|{_DOT}|{_DOT_IN_HOST}|(?-i:{_ALIKE})", re.IGNORECASE)
_WORDS = re.compile(rf"(?P<times>double|triple)|(?P<word>{_NUM})|(?P<point>dot|point)|(?P<digits>[0-9]+)", re.IGNORECASE)
#: Cheap looks before the rules.
_WRAPPED = re.compile(r"[\[({<_*]\s*(?:at|@|dot|\.|arroba|arobase|punkt|point|punto)\s*[\])}>_*]|&#0*(?:64|46);|&commat;|&period;", re.IGNORECASE)
_NEAR_DIGIT = re.compile(r"[0-9][OolI]|[OolI][0-9]")
_SPACED = re.compile(rf"\s(?:at|arroba|arobase|@)\s+[\w-]+(?:\s*[\[({{<]|\s+dot\s|\s+{_POINT}\s|\.|(?:\.[\w-]+)*\s+(?:dot|{_POINT})\s)|@[\w.-]+\s+{_POINT}\s", re.IGNORECASE)
#: A number word beside another one or beside digits: what each match of _SPELLED begins with.
_BESIDE = re.compile(rf"(?<!\w)(?:{_NUM})(?!\w)[\s,-]+(?:(?:dot|point)[\s-]+)?(?:(?:double|triple)[\s-]+)?(?:{_NUM}|[0-9])|[0-9][\s,-]+(?:(?:double|triple)[\s-]+)?(?:{_NUM})(?!\w)", re.IGNORECASE)
#: Letters that an expression without case takes for i, s and k, though lower() doesn't.
_FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")
_FOLD = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")
_TOKEN = re.compile(r"\w+")


def _hinted(text: str) -> bool:
    """False only where no rule can change what the detectors find: each look takes all that its rule takes."""
    if _WRAPPED.search(text) or _NEAR_DIGIT.search(text) or _FOLDED.search(text):
        return True
    low = text.lower()
    known = set(low.translate(_GAPS).split() if text.isascii() else _TOKEN.findall(low))
    if "dot" in known or ("@" in text or not known.isdisjoint(("at", "arroba", "arobase"))) and _SPACED.search(text):
        return True
    return not known.isdisjoint(NUMBER_WORDS) and _BESIDE.search(text) is not None


def _plain(c: str) -> str | None:
    """What a non-ASCII character stands for: "" if invisible, ASCII if it is a look-alike, else None."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if unicodedata.category(c) in ("Nd", "Lu", "Ll", "Po", "Ps", "Pe", "Sm", "Pd"):
        k = unicodedata.normalize("NFKC", c)
        if len(k) == 1 and k.isascii():
            return k
        if (d := unicodedata.decimal(c, None)) is not None:
            return str(d)
    return None


_GLYPH = common.Memo(_plain, 70_000)
_FOREIGN = re.compile(r"[^\x00-\x7fÀ-ÿĀ-İĲ-ſ]| |­|·")


def rewrite(text: str) -> tuple[str, list[int], list[int]] | None:
    """The rewritten text with the source start and end of each of its characters; None if nothing changes."""
    changed = False
    chars, starts, ends = list(text), None, None
    if _FOREIGN.search(text):
        out = [(r, k) for k, c in enumerate(text) if (r := c if c.isascii() or (p := _GLYPH[c]) is None else p) != ""]
        chars, starts = [r for r, _ in out], [k for _, k in out]
        ends = [k + 1 for k in starts]
        changed = len(chars) != len(text) or any(text[k] != r for r, k in out)
    flat = "".join(chars)
    if _hinted(flat):
        pieces: list[str] = []
        new_s: list[int] = []
        new_e: list[int] = []
        s = starts if starts is not None else range(len(flat))
        e = ends if ends is not None else range(1, len(flat) + 1)
        done = host = 0  # host: where the host behind the last at, or its next label, begins
        for m in _RULES.finditer(flat):
            a, b = m.span()
            if m["point"] and not ((h := max(host, flat.rfind("@", max(0, a - 255), a) + 1)) and _LABELS.fullmatch(flat, h, a)):
                continue
            if m["at"] or m["point"] or m["dot"]:
                host = b
            pieces.append(flat[done:a])
            new_s += s[done:a]
            new_e += e[done:a]
            if m["alike"]:
                pieces.append(flat[a:b].translate(_TO_DIGIT))
                new_s += s[a:b]
                new_e += e[a:b]
            elif m["at"] or m["dot"] or m["point"]:
                pieces.append("@" if m["at"] else ".")
                new_s.append(s[a])
                new_e.append(e[b - 1])
            else:
                if m["plus"]:
                    pieces.append("+")
                    new_s.append(s[a])
                    new_e.append(e[m.end("plus") - 1])
                times, at = 1, 0
                for w in _WORDS.finditer(flat, m.start("run"), m.end("run")):
                    if w["times"]:
                        times, at = REPEATS[w["times"].translate(_FOLD).lower()], w.start()
                        continue
                    if w["point"]:
                        pieces.append(".")
                        new_s.append(s[w.start()])
                        new_e.append(e[w.end() - 1])
                        continue
                    digits = NUMBER_WORDS[w["word"].translate(_FOLD).lower()] * times if w["word"] else w["digits"]
                    at = at if times > 1 else w.start()
                    for k, d in enumerate(digits):
                        pieces.append(d)
                        new_s.append(s[at if w["word"] else w.start() + k])
                        new_e.append(e[w.end() - 1 if w["word"] else w.start() + k])
                    times = 1
            done, changed = b, True
        pieces.append(flat[done:])
        new_s += s[done:]
        new_e += e[done:]
        flat, starts, ends = "".join(pieces), new_s, new_e
    return (flat, list(starts), list(ends)) if changed else None


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """The source's own spans, and all spans with those that the rewritten text adds."""
    if not text:
        return [], []
    base = detect(text)
    new = rewrite(text)
    if new is None:
        return base, base
    flat, starts, ends = new
    taken = sorted((a, b) for _, a, b in base)
    reach: list[int] = []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    added = []
    for kind, a, b in detect(flat):
        a, b = starts[a], ends[b - 1]
        k = bisect_right(taken, (b - 1, 1 << 62))  # spans that start before b
        if not (k and reach[k - 1] > a):
            added.append((kind, a, b))
    return base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None) -> str | None:
    """Replaces each span, overlapping ones together, by the kind of its first."""
    spans = sorted((a, b, k) for k, a, b in find(text)[1])
    if not spans:
        return text
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, cols = batch.column(0), {k: [] for k in ("email", "ip", "card", "phone", "sha", "spans")}
        for text in batch.column(1).to_pylist():
            base, spans = find(text)
            for kind in KINDS:
                cols[kind].append(sum(k == kind for k, _, _ in spans))
            cols["sha"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols["spans"].append(joined(spans))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(cols[k], pa.int64()) for k in KINDS], pa.array(cols["sha"], pa.string()), pa.array(cols["spans"], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def spans(docs: DataFrame) -> DataFrame:
    """One row per document with its spans; no shuffle."""
    common.ship(docs.sparkSession)
    return common.only(docs, doc_id="long", text="string").mapInArrow(common.tidy(_rows), SCHEMA)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [redact(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(f.name, c) for f, c in zip(batch.schema, batch.columns)], names=batch.schema.names)


DOCUMENT = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their spans replaced by <EMAIL>, <IP>, <CARD> or <PHONE>."""
    common.ship(docs.sparkSession)
    df = common.only(docs, **DOCUMENT)
    return df.mapInArrow(common.tidy(_redacted), ", ".join(f"{k} {v}" for k, v in DOCUMENT.items()))
