"""Keyword-stuffed pages, link lists and product tags, told from prose and records by shares calibrated per language.

Each text is cut into segments of running words. For every segment six shares are measured: its top content words,
words in n-grams the text repeats, duplicate lines and list items, link text, separators and function words of the
text's language. What is usual for a language comes from the quantiles of the segments of all its documents; a segment
is stuffed if enough of its shares lie beyond the thresholds that follow from them, and a page if more than half of
its characters lie in such segments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.session import checkpoint, widen

# Frequent function words of the languages of the corpus.
FUNCTION_WORDS = {
    "en": "a an and any are as at be been before between but by can each for from had has have if in into is it its may no not of on or our per shall that the their this to under until upon was were when where which while whose will with without",
    "de": "als am an auf aus bei bis das dem den der des die durch ein eine einem einen einer es für hat im in ist keine mit nach nicht oder sich sind über um und von vor war werden wird wurde zu zum zur",
    "fr": "à a au aux avec ce ces dans de des du en est et il la le les leur ne ou par pas pour que qui sa sans se ses son sont sous sur un une",
    "hi": "और का की के को गई गया चाहिए जा जो तक तथा थी था ने नहीं पर भी मे में यह से है हैं ही हो होगा होगी करके की देगा या वह",
    "mr": "आणि आला आली आले आहे आहेत असून करण्यात का की च ज्या तो ती ते त्या नाही पूर्वी ही हा हे होता होती व या येईल येथे जाईल भरावा देईल",
    "ta": "அன்று அது அந்த ஆகும் இது இந்த உள்ள உள்ளது என என்று ஒரு கொண்டு செலுத்தப்படும் செலுத்தப்பட்டது செய்யப்பட்டது மற்றும் முன் வேண்டும் அமைந்துள்ளது",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_FUNCTION.values())
# Scripts that tell a language, or the languages that share one.
_SCRIPTS = ((re.compile(r"[஀-௿]+"), ("ta",)), (re.compile(r"[ऀ-ॿ]+"), ("hi", "mr")), (re.compile(r"[A-Za-zÀ-ÿ]+"), ("en", "de", "fr")))
# Labels of a language beside its first two letters.
_LABELS = {"eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr", "hin": "hi", "hindi": "hi", "mar": "mr", "marathi": "mr", "tam": "ta", "tamil": "ta"}

_LINK = re.compile(r"<a\b[^<>]*>[^<]*</a>|\[[^\[\]\n]*\]\([^()\s]+\)|(?:https?://|www\.)[^\s<>()|,]+|(?<!\w)#[^\W\d_][\w-]*")
_LABELLED = re.compile(r"[^\W\d_][\w'-]*(?: [^\W\d_][\w'-]*){0,4}: ?$")
_WORD = re.compile(r"[^\W_][\w'ऀ-෿-]*")
_NUMERIC = re.compile(r"(?<!\S)[^\s\d]*\d")
# What separates the items of a list, and what ends a sentence.
_SEPARATORS = ",;|/>•·»\t"
_CUT = str.maketrans(dict.fromkeys(_SEPARATORS + ":", "\n"))
_STOPS = (" - ", ". ", "! ", "? ", "। ")
# What begins a row of product codes, and a row of tags.
_CODES = re.compile(r"^(?:SKU|EAN|UPC|ASIN|MPN)s?[:#]?(?:[\s,;|]+[A-Z]*-?\d[\w-]*){3,}$")
_TAGS = re.compile(r"^(?:Tags?|Keywords?|Labels?|Categories|Topics)\s*:", re.I)

#: Words of a segment; most words of a list item; occurrences that make an n-gram or an item repeated; content words
#: counted as the top ones.
WINDOW, PHRASE, REPEATED, TOPS = 40, 5, 3, 5
SHARES = ("top_word", "ngrams", "dup_lines", "links", "separators", "function_words", "numbers")
#: A share scores one where it lies SPREAD times as far above its language's median as the upper quartile does, within
#: these bounds; function words score one where they lie LOW times as far below their median as the lower quartile.
SPREAD, LOW = 4.0, 2.0
BOUNDS = {"top_word": (0.5, 0.65), "ngrams": (0.35, 0.7), "dup_lines": (0.25, 0.7), "links": (0.15, 0.5), "separators": (0.2, 0.5)}
#: Most that a share may score; the sum that makes a segment stuffed, and what repetition and links add to it at least.
MOST = {"top_word": 2, "ngrams": 2, "dup_lines": 2, "links": 1, "separators": 1, "function_words": 2}
SCORE, REPETITION = 3.5, 1.0
#: Link text that makes a segment stuffed alone; most tokens with digits of a segment that is no record; the share of a
#: page's characters that stuffed segments must exceed.
LINKED, NUMBERS, MORE_THAN = 0.5, 0.12, 0.5
#: Quartiles of a language of which nothing is known yet, and how many segments they count as against those seen.
PRIOR = {"top_word": (0.13, 0.17, 0.22), "ngrams": (0.0, 0.15, 0.35), "dup_lines": (0.0, 0.0, 0.0), "links": (0.0, 0.0, 0.0), "separators": (0.05, 0.1, 0.15), "function_words": (0.2, 0.25, 0.3)}
PRIOR_FUNCTION = {"en": (0.29, 0.35, 0.39), "de": (0.31, 0.36, 0.4), "fr": (0.28, 0.32, 0.38), "hi": (0.11, 0.16, 0.21), "mr": (0.17, 0.2, 0.24), "ta": (0.18, 0.21, 0.25)}
PRIOR_SEGMENTS = 20

FEATURES = (*(s for s in SHARES if s != "numbers"), "stuffed")
Usual = dict[str, tuple[float, float, float]]


def language(label: str | None, text: str, words: list[str]) -> str:
    """One name per language: by the script that most of the whole text is in; where languages share it, by the label
    if it names one of them, else by the language with most function words in the text; else the label's first two
    letters, ``un`` where there is none."""
    tag = (label or "").strip().lower()
    tag = _LABELS.get(tag, tag[:2])
    tag = tag if re.fullmatch("[a-z]{2}", tag) else "un"
    if text.isascii():
        most, names = True, _SCRIPTS[-1][1]
    else:
        most, names = max(((sum(map(len, p.findall(text))), names) for p, names in _SCRIPTS), key=lambda c: c[0])
    if not most or (text.isascii() and not words):
        return tag
    if tag in names or len(names) == 1:
        return tag if tag in names else names[0]
    hits = {n: sum(w in _FUNCTION[n] for w in words) for n in names}
    best = max(names, key=hits.__getitem__)
    return best if hits[best] else (tag if tag not in _FUNCTION else names[0])


def _tags(line: str) -> bool:
    """Whether a line is a row of four or more short items without digits, joined by ``>`` or named as tags."""
    named = _TAGS.match(line)
    if not named and (line.count(">") < 3 or "<" in line):
        return False
    items = [x.strip() for x in re.split(r"[,;|>]", line[named.end() :] if named else line)]
    return len(items) >= 4 and all(i and i.count(" ") < PHRASE and not any(c.isdigit() for c in i) for i in items)


def _items(text: str) -> list[str]:
    """The items of a lower-case text: what stands between separators, line ends and ends of sentences."""
    text = text.translate(_CUT)
    for stop in _STOPS:
        text = text.replace(stop, "\n")
    return [i for x in text.split("\n") if (i := x.strip(" .!?।"))]


def _parts(text: str) -> Iterator[list[tuple[str, int, str]]]:
    """The paragraphs of a text (between blank lines) as parts: (kind, characters, text); link items, hashtags, rows of
    product codes and trails of tags are ``link``, all else is ``text``."""
    held: list[tuple[str, int, str]] = []
    for line in text.splitlines():
        line = line.strip()
        if not line:
            if held:
                yield held
            held = []
            continue
        if _CODES.match(line) or _tags(line):
            held.append(("link", sum(map(len, line.split())), ""))
            continue
        end = 0
        if "://" in line or "www." in line or "<a" in line or "#" in line:
            for m in _LINK.finditer(line):
                start = m.start()
                if line[start] in "hw<" and (label := _LABELLED.search(line, max(end, line.rfind("  ", 0, start)), start)):
                    start = label.start()  # "Name: link" is one item
                if (rest := line[end:start]).strip():
                    held.append(("text", sum(map(len, rest.split())), rest))
                held.append(("link", sum(map(len, line[start : m.end()].split())), ""))
                end = m.end()
        if (rest := line[end:]).strip():
            held.append(("text", sum(map(len, rest.split())), rest))
    if held:
        yield held


def segments(text: str | None, label: str | None = None) -> tuple[str, list[tuple[float, ...]]]:
    """The text's language and its segments: (characters without white space, *SHARES), shares from 0 to 1.

    A segment is a run of up to ``WINDOW`` words of one paragraph (a link item counts as one word). Repetition is
    judged over the whole text. Null, empty and blank texts have no segments.
    """
    if not text or not text.strip():
        return language(label, "", []), []
    groups = list(_windows(text))
    words_all = [w for g in groups for _, _, words in g for w in words]
    lang = language(label, text, words_all)
    function = _FUNCTION.get(lang, frozenset())
    repeated = {p for p, n in Counter(pairwise(words_all)).items() if n >= REPEATED}
    items = [_items(low) for g in groups for _, low, _ in g]
    often = {i for i, n in Counter(i for x in items for i in x).items() if n >= REPEATED and i.count(" ") < PHRASE and not i.isdigit()}
    out: list[tuple[float, ...]] = []
    at = iter(items)
    for g in groups:
        size = linked = dup = bare = seps = tokens = digits = covered = 0
        counts: Counter = Counter()
        hit, before = False, None  # n-grams go over a line's end, but not over a link
        for n, low, words in g:
            own = next(at)
            size += n
            if not low:
                linked += n
                hit, before = False, None
                continue
            seps += sum(map(low.count, _SEPARATORS)) + low.count(" - ")
            tokens += low.count(" ") + 1 - low.count("| ")
            digits += len(_NUMERIC.findall(low))
            counts.update(words)
            if often:
                bare += sum(map(len, own))
                dup += sum(len(i) for i in own if i in often)
            if repeated:
                for w in words:
                    if before is not None and (before, w) in repeated:
                        covered += 1 if hit else 2
                        hit = True
                    else:
                        hit = False
                    before = w
        total = sum(counts.values())
        n = max(1, total)
        known = sum(c for w, c in counts.items() if w in (function or _ANY))
        content = sorted((c for w, c in counts.items() if w not in function and not w[0].isdigit()), reverse=True)
        top = sum(content[:TOPS]) if n >= 2 * TOPS else 0
        out.append((float(size), top / n, covered / n, dup / max(1, bare), linked / max(1, size), min(1.0, seps / n), known / n, min(1.0, digits / max(1, tokens))))
    return lang, out


def _windows(text: str) -> Iterator[list[tuple[int, str, list[str]]]]:
    """The segments as lists of parts: (characters, lower-case text, words); a link has no text and no words."""
    for p in _parts(text):
        group: list[tuple[int, str, list[str]]] = []
        held = 0
        for kind, size, t in p:
            if kind == "link":
                group.append((size, "", []))
                held += 1
            else:
                tokens = t.lower().split()
                for lo in range(0, len(tokens), WINDOW):
                    part = tokens[lo : lo + WINDOW]
                    if held and held + len(part) > WINDOW:
                        yield group
                        group, held = [], 0
                    low = " ".join(part)
                    group.append((len(low) - len(part) + 1, low, _WORD.findall(low)))
                    held += len(part)
            if held >= WINDOW:
                yield group
                group, held = [], 0
        if group:
            yield group


def prior(lang: str) -> Usual:
    """The quartiles a language is taken to have before any of its texts is seen."""
    return PRIOR | ({"function_words": PRIOR_FUNCTION[lang]} if lang in PRIOR_FUNCTION else {})


def calibrated(lang: str, quartiles: Usual, seen: float) -> Usual:
    """Quartiles of ``seen`` segments mixed with the prior, so that a language of few texts is judged by it."""
    w = seen / (seen + PRIOR_SEGMENTS)
    return {f: tuple(w * q + (1 - w) * p for q, p in zip(quartiles[f], values, strict=True)) for f, values in prior(lang).items()}


def stuffed(shares: dict[str, np.ndarray], usual: Usual) -> np.ndarray:
    """For each segment whether it is stuffed: its shares beyond those usual for its language."""
    total, repetition = np.zeros(len(shares["links"])), np.zeros(len(shares["links"]))
    for f, (least, most) in BOUNDS.items():
        _, middle, upper = usual[f]
        high = min(most, max(least, middle + SPREAD * (upper - middle)))
        score = np.clip((shares[f] - middle) / max(0.05, high - middle), 0, MOST[f])
        total += score
        if f in ("ngrams", "dup_lines", "links"):
            repetition += score
    lower, middle, _ = usual["function_words"]
    if middle >= 0.05:
        total += np.clip((middle - shares["function_words"]) / min(0.6 * middle, max(0.25 * middle, LOW * (middle - lower))), 0, MOST["function_words"])
    return ((total >= SCORE) & (repetition >= REPETITION) & (shares["numbers"] <= NUMBERS)) | (shares["links"] > LINKED)


def features(text: str | None, label: str | None = None, usual: Usual | None = None) -> dict[str, float]:
    """The shares of a whole text, weighted by the characters of its segments, and the share of its characters in
    stuffed segments; without ``usual`` a segment is judged by the prior."""
    lang, found = segments(text, label)
    rows = np.array(found, dtype=float).reshape(-1, 1 + len(SHARES))
    if not len(rows):
        return dict.fromkeys(FEATURES, 0.0)
    size = rows[:, 0] / rows[:, 0].sum()
    shares = {f: rows[:, i + 1] for i, f in enumerate(SHARES)}
    out = {f: float(min(1.0, (size * shares[f]).sum())) for f in FEATURES[:-1]}
    return out | {"stuffed": float(min(1.0, size[stuffed(shares, usual or prior(lang))].sum()))}


_SEGMENT = pa.struct([(f, pa.float32()) for f in ("size", *SHARES)])
_MEASURED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("segments", pa.list_(_SEGMENT))])
_SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((f, pa.float64()) for f in FEATURES)])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        measured = [segments(t, lang) for t, lang in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows = np.array([r for _, rs in measured for r in rs], dtype=np.float32).reshape(-1, 1 + len(SHARES))
        offsets = np.cumsum([0, *(len(rs) for _, rs in measured)], dtype=np.int32)
        values = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(rows.shape[1])], fields=list(_SEGMENT))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in measured], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), values)], schema=_MEASURED)


def _judge(usual: dict[str, Usual]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column, langs = b.column(2), np.array(b.column(1).to_pylist(), dtype=object)
            counts = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            of = np.repeat(np.arange(b.num_rows), counts)
            size, *rest = (flat.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1 + len(SHARES)))
            shares = dict(zip(SHARES, rest, strict=True))
            hit = np.zeros(len(size), bool)
            for lang in set(langs):
                at = np.flatnonzero((langs == lang)[of])
                hit[at] = stuffed({f: v[at] for f, v in shares.items()}, usual.get(lang) or prior(lang))
            whole = np.maximum(np.bincount(of, size, b.num_rows), 1)
            columns = [np.minimum(1.0, np.bincount(of, size * (hit if f == "stuffed" else shares[f]), b.num_rows) / whole) for f in FEATURES]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, columns)], schema=_SCORED)

    return run


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, lang and the shares of :func:`features` of every document, with the verdict ``stuffed_page``.

    A segment is stuffed if the scores of its shares (how far each lies beyond the quartiles of its language) sum up,
    repetition or links among them, or if most of it is links; a page is if more than half of its characters (without
    white space) lie in such segments. Quartiles are taken over the segments of all documents of a language that are
    no records. Null, empty and blank texts are no cases; rows stay rows.
    """
    d = documents.select("doc_id", "lang", "text")
    rows = checkpoint(widen(d).mapInArrow(_measure, "doc_id bigint, lang string, segments array<struct<" + ", ".join(f"{f}: float" for f in ("size", *SHARES)) + ">>"))
    each = rows.select("lang", F.inline("segments")).where(F.col("numbers") <= NUMBERS)
    quartiles = each.groupBy("lang").agg(F.count(F.lit(1)).alias("seen"), *(F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f) for f in PRIOR))
    # one row a language, and a language is two letters
    usual = {r.lang: calibrated(r.lang, {f: tuple(r[f]) for f in PRIOR}, r.seen) for r in quartiles.collect()}
    return rows.mapInArrow(_judge(usual), "doc_id bigint, lang string, " + ", ".join(f"{f} double" for f in FEATURES)).withColumn("stuffed_page", F.col("stuffed") > MORE_THAN)
