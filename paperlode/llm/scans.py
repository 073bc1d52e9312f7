"""Text of scanned pages: lines labelled by a hidden Markov model, broken and misread words put right, paragraphs joined.

Lines are labelled as header, page number or body (blank lines are breaks) by Viterbi over position, shape and
repetition; the model's prior is refitted once on the labels it gives all pages (hard EM; the counts are a few dozen
numbers). Words are judged against the counts of all words of the corpus: a word is misread if undoing a known
confusion gives a word that is far more frequent, and a broken word is written as the corpus writes it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlode.session import checkpoint

STATES = ("header", "page_number", "body")
# Prior of the model: start, change and emission probabilities by state. Positions are first, second, second last and
# last line of text, or between; shapes are those of ``shape``; repeated is the share of lines found on several pages.
PRIOR = {
    "start": {"header": 0.3, "page_number": 0.05, "body": 0.65},
    "header": {"header": 0.1, "page_number": 0.15, "body": 0.75},
    "page_number": {"header": 0.35, "page_number": 0.02, "body": 0.63},
    "body": {"header": 0.06, "page_number": 0.06, "body": 0.88},
    "position": {
        "header": {"first": 0.6, "second": 0.05, "last": 0.28, "second_last": 0.0695, "between": 0.0005},
        "page_number": {"first": 0.1, "second": 0.1, "last": 0.5, "second_last": 0.299, "between": 0.001},
        "body": {"first": 0.05, "second": 0.05, "last": 0.05, "second_last": 0.05, "between": 0.8},
    },
    "shape": {
        "header": {"short": 0.7, "titled": 0.26, "full": 0.03, "ended": 0.002, "number": 0.005, "heading": 1e-5, "table": 1e-5},
        "page_number": {"short": 1e-3, "titled": 1e-3, "full": 1e-5, "ended": 1e-5, "number": 0.99, "heading": 1e-5, "table": 1e-5},
        "body": {"short": 0.04, "titled": 5e-4, "full": 0.66, "ended": 0.2, "number": 5e-4, "heading": 0.05, "table": 0.05},
    },
    "repeated": {"header": {True: 0.75, False: 0.25}, "page_number": {True: 0.5, False: 0.5}, "body": {True: 0.03, False: 0.97}},
}
#: Weight of the prior against the counts of the pages when the model is refitted.
PRIOR_WEIGHT = 0.5

# Confusions of character recognition, as read -> as printed.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("cl", "d"), ("c", "e"), ("ii", "u"), ("rn", "m"), ("vv", "w"),
    ("m", "rn"), ("d", "cl"), ("e", "c"), ("u", "ii"), ("w", "vv"), ("l", "i"), ("I", "l"), ("nn", "m"), ("li", "h"), ("h", "b"), ("tl", "d"), ("0", "O"), ("1", "I"), ("5", "S"), ("8", "B"), ("6", "G"), ("|", "l"), ("|", "I"), ("q", "g"), ("f", "t"),
)
# Letters read in place of digits.
AS_DIGIT = {"S": "5", "B": "8", "O": "0", "o": "0", "l": "1", "I": "1", "!": "1", "|": "1", "Z": "2", "G": "6", "g": "9", "q": "9"}
AS_LETTER = {"0": "O", "1": "I", "5": "S", "8": "B", "6": "G"}

_HYPHENS = "-­‐¬‑"
_NUMBER = r"[\[(]?\s*(?:[-–—~]\s*)?(?:[Pp][aoe0]g[ecoa0]|PAGE|[Pp]g|[Pp])?\.?\s*[\dlIOoSB!]{1,4}(?:\s*(?:of|0f|oi|/)\s*[\dlIOoSB!]{1,4})?(?:\s*[-–—~])?\s*[\])]?"
_PAGE_NUMBER = re.compile(rf"\s*(?=.*\d|.*[lIOS]){_NUMBER}\s*")
_TITLED = re.compile(rf".*\S(?:\s{{2,}}|\t|\s+\|\s+)(?=.*\d|.*[lIO]){_NUMBER}\s*")
_KEY = str.maketrans({"0": "o", "1": "l", "!": "i", "5": "s", "9": "g", "6": "b", "c": "e"})
_LEAD, _TRAIL = "([{\"'“‘*_<>|~", ")]}\"'”’.,;:?…*_<>|~"
_MAY_END = set(".!?।:;'\")]*")
_ENDED = re.compile(r"[.!?।:;]['\")\]]*\s*$")

LABELLED = "doc_id string, page_no int, kind string, line int, a string, b string"
_LABELLED = pa.schema([("doc_id", pa.string()), ("page_no", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("a", pa.string()), ("b", pa.string())])


def key(line: str) -> str:
    """What remains of a running line when page numbers and misread characters are evened out."""
    bare = re.sub(rf"(?:\s{{2,}}|\t){_NUMBER}\s*$", "", line.strip())
    bare = bare.lower().translate(_KEY).replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("vv", "w")
    return re.sub(r"[^\w]+", "", re.sub(r"\d+", "", bare))


def shape(line: str, width: int) -> str:
    """The shape of a line of text."""
    s = line.strip()
    if s.startswith("#"):
        return "heading"
    if s.startswith("|"):
        return "table"
    if len(s) <= 24 and _PAGE_NUMBER.fullmatch(s):
        return "number"
    ended = s[-1] in _MAY_END and _ENDED.search(s)
    if not ended and len(s) <= 90 and ("  " in s or "\t" in s or " | " in s) and _TITLED.fullmatch(s):
        return "titled"
    if ended:
        return "ended"
    return "short" if len(s) < 0.72 * width and s[-1] not in _HYPHENS + "," and (s[0].isupper() or not s[0].isalpha()) else "full"


def observe(lines: list[str], repeated: set[str]) -> tuple[list[int], list[tuple[str, str, bool]]]:
    """Indexes of the lines with text, and what the model sees of each."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    sizes = sorted(len(lines[i].strip()) for i in at if not lines[i].lstrip().startswith(("|", "#")))
    width = sizes[int(0.9 * (len(sizes) - 1))] if sizes else 0
    seen = []
    for n, i in enumerate(at):
        place = "first" if n == 0 else "last" if n == len(at) - 1 else "second" if n == 1 else "second_last" if n == len(at) - 2 else "between"
        edge = place != "between"
        seen.append((place, shape(lines[i], max(width, 40)), edge and key(lines[i]) in repeated))
    return at, seen


def model(counts: dict[tuple, float] | None = None, weight: float = PRIOR_WEIGHT) -> dict:
    """The model's log probabilities: the prior, mixed with counts ((table, state, value) -> n) where given."""
    out: dict = {}
    for table, states in (("move", {"start": PRIOR["start"], **{s: PRIOR[s] for s in STATES}}), *((t, PRIOR[t]) for t in ("position", "shape", "repeated"))):
        for state, values in states.items():
            total = sum((counts or {}).get((table, state, str(v)), 0.0) for v in values)
            for v, p in values.items():
                share = (counts or {}).get((table, state, str(v)), 0.0) / total if total else p
                out[table, state, v] = math.log(weight * p + (1 - weight) * share if total else p)
    return out


def label(seen: list[tuple[str, str, bool]], m: dict) -> list[str]:
    """The most likely state of every line."""
    if not seen:
        return []
    move = [[m["move", p, s] for p in STATES] for s in STATES]
    known: dict[tuple, list[float]] = {}

    def emit(o: tuple[str, str, bool]) -> list[float]:
        e = known.get(o)
        if e is None:
            e = known[o] = [m["position", s, o[0]] + m["shape", s, o[1]] + m["repeated", s, o[2]] for s in STATES]
        return e

    score = [m["move", "start", s] + e for s, e in zip(STATES, emit(seen[0]), strict=True)]
    back = []
    for o in seen[1:]:
        step, origin = [], []
        for row, e in zip(move, emit(o), strict=True):
            a, b, c = score[0] + row[0], score[1] + row[1], score[2] + row[2]
            best = max(a, b, c)
            origin.append(0 if best == a else 1 if best == b else 2)
            step.append(best + e)
        back.append(origin)
        score = step
    state = score.index(max(score))
    path = [state]
    for origin in reversed(back):
        state = origin[state]
        path.append(state)
    return [STATES[s] for s in reversed(path)]


def core(token: str) -> str:
    """A token without adjoining punctuation."""
    return token.lstrip(_LEAD).rstrip(_TRAIL)


def number(word: str) -> str | None:
    """A number or code with letters read for digits, put right; None if the word is none or has none."""
    m = re.fullmatch(r"([A-Z0158]{2,3})/([\dSBOlIoZG!]{2})/([\dSBOlIoZG!]{3,6})", word)
    if m and any(c.isalpha() and c not in AS_DIGIT for c in m[1]):
        fixed = "/".join(("".join(AS_LETTER.get(c, c) for c in m[1]), *("".join(AS_DIGIT.get(c, c) for c in x) for x in m.groups()[1:])))
        return fixed if fixed != word else None
    m = re.fullmatch(r"(\D{0,3}?)([\dSBOloI!ZG][\dSBOloI!ZG,./:-]*)(st|nd|rd|th|%)?", word)
    if not m or m[1] and not re.fullmatch(r"[-+(₹]*", m[1]):
        return None
    body = m[2]
    digits, letters = sum(c.isdigit() for c in body), sum(c in AS_DIGIT for c in body)
    if not letters or not digits or letters > digits + (1 if len(body) > 3 else 0):
        return None
    if len(body) == 2 and body[1] in "SBG" or re.fullmatch(r"[A-Z]\d{1,3}", body) and "," not in body:
        return None
    return m[1] + "".join(AS_DIGIT.get(c, c) for c in body) + (m[3] or "")


#: Doubtful characters of a word that are read each on its own; beyond it one reading holds for all equal ones.
MARKS = 3
#: Letters of the longest word that may be a misread one of letters only; longer runs are codes, not words.
LONGEST = 64


def suspects(word: str) -> list[tuple[str, int]]:
    """Words this one may have been printed as: (word, rank); rank 1 undoes characters no word has, 2 letters only."""
    letters = sum(c.isalpha() for c in word)
    if letters < 2 or "@" in word or "://" in word:
        return []
    marks = [i for i, c in enumerate(word) if c in "015689!|"]
    if marks and letters < len(marks):
        return []
    forms = {word: 0}
    shouted = sum(c.isupper() for c in word) * 2 > letters and letters > 2
    if len(marks) <= MARKS:
        for i in marks:  # every such character has to go
            grown = {}
            for f in forms:
                for read, printed in CONFUSIONS:
                    if read == word[i] and len(printed) == 1:
                        p = printed.upper() if shouted else printed
                        grown[f[:i] + p + f[i + 1 :]] = 1
                        if i == 0:
                            grown[p.upper() + f[1:]] = 1
            forms = grown
    else:  # one letter for each character, the same throughout the word
        kinds = sorted(set(word) & set("015689!|"))
        for letters_of in product(*([p for read, p in CONFUSIONS if read == c and len(p) == 1] for c in kinds)):
            f = word.translate(str.maketrans(dict(zip(kinds, letters_of, strict=True))))
            forms[f.upper() if shouted else f] = 1
        forms.pop(word)
    out = dict(forms) if marks else {}
    for f in forms:
        if not f.isascii() or len(f) > LONGEST:
            continue
        for read, printed in CONFUSIONS:
            if read.isalpha():
                k = f.lower().find(read)
                while k >= 0:
                    p = printed.upper() if shouted else printed.capitalize() if k == 0 and f[0].isupper() else printed
                    out.setdefault(f[:k] + p + f[k + len(read) :], 2)
                    k = f.lower().find(read, k + 1)
    out.pop(word, None)
    return list(out.items())


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the two first and last lines of text of every page."""
    schema = pa.schema([("doc_id", pa.string()), ("page_no", pa.int32()), ("key", pa.string())])
    for b in batches:
        docs, nos, keys = [], [], []
        for d, n, md in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = [x for x in md.split("\n") if x.strip()]
            for k in {key(x) for x in text[:2] + text[-2:]}:
                if k:
                    docs.append(d)
                    nos.append(n)
                    keys.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(nos, pa.int32()), pa.array(keys, pa.string())], schema=schema)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the prior labels on all pages: counts by table, state and value."""
    m = model()
    counts: Counter = Counter()
    for b in batches:
        for _, _, md, repeated in zip(*(c.to_pylist() for c in b.columns), strict=True):
            _, seen = observe(md.split("\n"), set(repeated or ()))
            before = "start"
            for o, s in zip(seen, label(seen, m), strict=True):
                counts["move", before, s] += 1
                for t, v in zip(("position", "shape", "repeated"), o, strict=True):
                    counts[t, s, str(v)] += 1
                before = s
    yield pa.RecordBatch.from_pylist([{"t": t, "s": s, "v": v, "n": n} for (t, s, v), n in counts.items()], schema=pa.schema([("t", pa.string()), ("s", pa.string()), ("v", pa.string()), ("n", pa.int64())]))


def _label(m: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, n, md, repeated in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = md.split("\n")
                at, seen = observe(lines, set(repeated or ()))
                states = label(seen, m)
                text = [i for i, s in zip(at, states, strict=True) if s == "body"]
                for i, s in zip(at, states, strict=True):
                    if s != "body":
                        rows.append((d, n, s, i + 1, "", ""))
                joined = ""  # what a line before has taken from this one
                opens, hangs, hangs_at = "", "", 0
                for k, i in enumerate(text):
                    tokens = lines[i].split()
                    if k == 0:
                        opens = core(tokens[0]) or tokens[0]
                    if joined:
                        tokens = tokens[1:]
                        joined = ""
                    if not tokens:
                        continue
                    last = tokens[-1]
                    if len(last) > 1 and last[-1] in _HYPHENS and last[-2].isalnum() and not lines[i].lstrip().startswith("|"):
                        left = last.rstrip(_HYPHENS).lstrip(_LEAD)
                        if k + 1 < len(text):
                            nxt = lines[text[k + 1]].split()[0]
                            if (nxt[0].isalnum() or nxt[0] == "!") and not nxt.startswith(("#", "|")):
                                rows.append((d, n, "broken", i + 1, left + "\x1f" + last[-1], core(nxt)))
                                joined = nxt
                                tokens = tokens[:-1]
                        else:
                            hangs, hangs_at = left + "\x1f" + last[-1], i + 1
                            tokens = tokens[:-1]
                    rows.append((d, n, "words", i + 1, "\x1f".join({t.lstrip(_LEAD).rstrip(_TRAIL) for t in tokens}), ""))
                if text:
                    rows.append((d, n, "page", hangs_at, opens, hangs))
            columns = zip(*rows, strict=True) if rows else [()] * len(_LABELLED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LABELLED, strict=True)], schema=_LABELLED)

    return run


def pages(pages_in: DataFrame, shard_results: DataFrame) -> DataFrame:
    """Every page once: doc_id, page_no, md. Of several texts of a page the longest stands (a failed try is empty);
    null, empty and blank pages are left out."""
    one = pages_in.select("doc_id", "page_no", "md")
    two = shard_results.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_no", "p.md")
    both = one.unionByName(two).where(F.col("doc_id").isNotNull() & F.col("page_no").isNotNull() & (F.length(F.trim("md")) > 0))
    return both.groupBy("doc_id", "page_no").agg(F.max(F.struct(F.length("md"), "md")).alias("x")).select("doc_id", "page_no", F.col("x.md").alias("md"))


def labelled(p: DataFrame) -> DataFrame:
    """Labels and words of all pages (see ``_label``): headers, page numbers, the words of a line joined by unit
    separators, broken words, and of each page its first word (a) and the part of a word that hangs at its end (b)."""
    edges = p.mapInArrow(_edges, "doc_id string, page_no int, key string")
    again = edges.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "key")
    known = edges.join(again.hint("merge"), ["doc_id", "key"], "left_semi").groupBy("doc_id", "page_no").agg(F.collect_set("key").alias("repeated"))
    seen = checkpoint(p.join(known.hint("merge"), ["doc_id", "page_no"], "left").select("doc_id", "page_no", "md", "repeated"))
    counts = {(r.t, r.s, r.v): float(r.n) for r in seen.mapInArrow(_count, "t string, s string, v string, n bigint").groupBy("t", "s", "v").agg(F.sum("n").alias("n")).collect()}
    return checkpoint(seen.mapInArrow(_label(model(counts)), LABELLED))


def _guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("printed", pa.string()), ("rank", pa.int32())])
    for b in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fixed = number(w)
            for printed, rank in ([(fixed, 0)] if fixed else suspects(w)):
                for name, v in zip(out, (w, n, printed, rank), strict=True):
                    out[name].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


#: A word of letters only is misread if the printed one is so many times as frequent, and has so many occurrences.
TIMES, LEAST = 5, 4


def fixes(words: DataFrame) -> DataFrame:
    """word -> fixed, and how often fixed is printed, for the misread words of a table of words and counts (word, n);
    words that only stand for a broken one have count 0."""
    guesses = words.mapInArrow(_guess, "word string, n bigint, printed string, rank int")
    known = words.where("n > 0").select(F.col("word").alias("printed"), F.col("n").alias("times"))
    j = guesses.join(known.hint("merge"), "printed", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    single = F.regexp_count("word", F.lit("[015689!|]")) == 1
    fits = (
        (F.col("rank") == 0)
        | ((F.col("rank") == 1) & (F.col("times") > 0))
        | ((F.col("rank") == 1) & single & F.col("word").rlike(r"^[A-Za-z0!]+$") & (F.regexp_count("word", F.lit("[A-Za-z]")) >= 4))
        | ((F.col("rank") == 2) & (F.col("times") >= LEAST) & (F.col("times") >= TIMES * F.col("n")))
    )
    best = j.where(fits).groupBy("word").agg(F.max(F.struct((F.col("times") > 0).alias("known"), -F.col("rank"), "times", "printed")).alias("x"))
    return best.select("word", F.col("x.printed").alias("fixed"), F.col("x.times").alias("fixed_n"))


def repairs(pages_in: DataFrame, shard_results: DataFrame) -> DataFrame:
    """What is repaired: doc_id, page_no, line_in_page, kind (hyphen, ocr, header, page_number), fixed.

    Null, empty and blank pages and failed tries have nothing to repair; copies of a page count once; a page may
    stand in any order and stand alone. Lines that begin with ``#`` are text. A word of one character is never
    repaired.
    """
    return _repairs(labelled(pages(pages_in, shard_results)))[0]


#: Page numbers of a block in which pages are put in order.
BLOCK = 4096
#: A word with more than one in so many occurrences is frequent; so there are at most so many frequent words.
FREQUENT = 10_000


def _follow(rows: DataFrame) -> DataFrame:
    """Every page with text and the next one of its document: doc_id, page_no, line, opens, hangs, next_no, right (the
    first word there). Pages are put in order within blocks of page numbers, so that one document may have any number
    of pages; what follows a block's last page comes from a window over one row a block."""
    block = F.floor(F.col("page_no") / BLOCK).alias("block")
    pages = rows.where("kind = 'page'").select("doc_id", block, "page_no", "line", F.col("a").alias("opens"), F.col("b").alias("hangs")).repartition("doc_id", "block")
    here = Window.partitionBy("doc_id", "block").orderBy("page_no")
    inside = pages.withColumn("next_no", F.lead("page_no").over(here)).withColumn("right", F.lead("opens").over(here)).where("next_no is not null").drop("block")
    edges = pages.groupBy("doc_id", "block").agg(F.min(F.struct("page_no", "opens")).alias("first"), F.max(F.struct("page_no", "line", "opens", "hangs")).alias("last"))
    after = F.lead("first").over(Window.partitionBy("doc_id").orderBy("block"))
    last = edges.withColumn("after", after).select("doc_id", "last.page_no", "last.line", "last.opens", "last.hangs", F.col("after.page_no").alias("next_no"), F.col("after.opens").alias("right"))
    return inside.unionByName(last)


def _repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repairs, and the order of the pages (see ``_follow``). Tables that grow with the corpus meet in sort-merge
    joins only; what is broadcast are the at most ``FREQUENT`` frequent words, which need not travel."""
    order = checkpoint(_follow(rows))
    tokens = rows.where("kind = 'words'").select("doc_id", "page_no", "line", F.explode(F.split("a", "\x1f")).alias("word")).where(F.length("word") > 1)
    met = order.where("hangs != '' and right is not null").select("doc_id", "page_no", "line", F.col("hangs").alias("a"), F.col("right").alias("b"))
    broken = (
        rows.where("kind = 'broken'").select("doc_id", "page_no", "line", "a", "b").unionByName(met)
        .select("doc_id", "page_no", "line", F.split("a", "\x1f")[0].alias("left"), F.split("a", "\x1f")[1].alias("mark"), F.col("b").alias("right"))
    )
    # the two ways to write a broken word; each is a word of the vocabulary, if only with no occurrence
    both = F.array(F.struct(F.concat("left", "right").alias("word"), F.lit(False).alias("dash")), F.struct(F.concat_ws("-", "left", "right").alias("word"), F.lit(True).alias("dash")))
    written = broken.select("left", "mark", "right").distinct().select("left", "mark", "right", F.inline(both))
    vocabulary = checkpoint(tokens.select("word", F.lit(1).cast("bigint").alias("n")).unionByName(written.select("word", F.lit(0).cast("bigint").alias("n"))).groupBy("word").agg(F.sum("n").alias("n")))
    misread = checkpoint(fixes(vocabulary))
    counted = written.join(vocabulary.hint("merge"), "word").join(misread.hint("merge"), "word", "left")
    digits = F.col("left").rlike(r"\d$") & F.col("right").rlike(r"^\d") & (F.col("mark") == "-")
    score = F.struct(F.col("n") > 0, "n", F.coalesce("fixed_n", F.lit(0)), F.when(digits, F.col("dash")).otherwise(~F.col("dash")), F.when(F.col("n") > 0, F.col("word")).otherwise(F.coalesce("fixed", "word")).alias("whole"))
    whole = counted.groupBy("left", "mark", "right").agg(F.max(score).alias("s")).select("left", "mark", "right", F.col("s.whole").alias("fixed"))
    hyphen = broken.join(whole.hint("merge"), ["left", "mark", "right"]).select("doc_id", "page_no", "line", F.lit("hyphen").alias("kind"), "fixed")
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    frequent = vocabulary.where((F.col("n") * FREQUENT > total) & (F.length("word") <= LONGEST)).select("word").join(misread.hint("merge"), "word", "left_anti")
    rare = tokens.join(F.broadcast(frequent), "word", "left_anti")
    ocr = rare.join(misread.hint("merge"), "word").select("doc_id", "page_no", "line", F.lit("ocr").alias("kind"), "fixed").distinct()
    running = rows.where("kind in ('header', 'page_number')").select("doc_id", "page_no", "line", "kind", F.lit("").alias("fixed"))
    return hyphen.unionByName(ocr).unionByName(running).withColumnRenamed("line", "line_in_page"), order


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.string()), ("page_no", pa.int32()), ("para_no", pa.int32()), ("text", pa.string()), ("open_start", pa.bool_()), ("open_end", pa.bool_())])
    for b in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for d, n, md, mended, taken in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for k, (text, start, end) in enumerate(rebuild(md, [(m["line"], m["kind"], m["fixed"]) for m in mended or ()], bool(taken))):
                for name, v in zip(out, (d, n, k, text, start, end), strict=True):
                    out[name].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def rebuild(md: str, mended: list[tuple[int, str, str]], taken: bool) -> list[tuple[str, bool, bool]]:
    """Paragraphs of a page with its repairs made: (text, goes on from the page before, goes on on the next page).

    ``taken`` tells that the page before has taken the first word of this one. Headings and table rows stay lines of
    their own.
    """
    drop = {line for line, kind, _ in mended if kind in ("header", "page_number")}
    words: dict[int, list[str]] = {}
    whole: dict[int, str] = {}
    for line, kind, fixed in mended:
        if kind == "ocr":
            words.setdefault(line, []).append(fixed)
        elif kind == "hyphen":
            whole[line] = fixed
    paragraphs: list[list[str]] = [[]]
    skip = taken
    for i, line in enumerate(md.split("\n"), 1):
        if i in drop:
            continue
        if not line.strip():
            if paragraphs[-1] and not skip:
                paragraphs.append([])
            continue
        tokens = line.split()
        if skip:
            rest = tokens[0]
            tail = rest[len(rest.rstrip(_TRAIL)) :]
            if paragraphs[-1]:
                paragraphs[-1][-1] += tail
            tokens, skip = tokens[1:], False
        goal = set(words.get(i, ()))
        if goal:
            for k, t in enumerate(tokens):
                w = core(t)
                options = {number(w)} if number(w) else {p for p, _ in suspects(w)}
                if w and (hit := goal & options):
                    tokens[k] = t.replace(w, hit.pop(), 1)
        if i in whole and tokens:
            lead = tokens[-1][: len(tokens[-1]) - len(tokens[-1].lstrip(_LEAD))]
            tokens[-1] = lead + whole[i]
            skip = True
        if not tokens:
            continue
        if line.lstrip().startswith(("#", "|")):
            if paragraphs[-1]:
                paragraphs.append([])
            paragraphs[-1].append(" ".join(tokens))
            paragraphs.append([])
        else:
            paragraphs[-1] += [" ".join(tokens)]
    texts = [" ".join(p) for p in paragraphs if p]
    fixed = lambda t: t.startswith(("#", "|"))
    return [
        (t, k == 0 and not fixed(t) and (taken or not t[:1].isupper()), k == len(texts) - 1 and not fixed(t) and (skip or not _ENDED.search(t)))
        for k, t in enumerate(texts)
    ]


def paragraphs(pages_in: DataFrame, shard_results: DataFrame) -> DataFrame:
    """The repaired text: doc_id, page_no, para_no, text.

    A paragraph that goes on on the next page stands on the page it begins on, and the part it continues with is
    left out there (a page that is a single such part keeps its own). Pages without text give no paragraphs.
    """
    p = checkpoint(pages(pages_in, shard_results))
    found, order = _repairs(labelled(p))
    by_page = found.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct(F.col("line_in_page").alias("line"), "kind", "fixed")).alias("mended"))
    # the page that a hanging word goes on takes its first word away
    follows = order.where("next_no is not null").select("doc_id", "page_no", "next_no")
    taken = order.where("hangs != '' and right is not null").select("doc_id", F.col("next_no").alias("page_no"), F.lit(True).alias("taken"))
    parts = checkpoint(
        p.join(by_page.hint("merge"), ["doc_id", "page_no"], "left").join(taken.hint("merge"), ["doc_id", "page_no"], "left").select("doc_id", "page_no", "md", "mended", "taken")
        .mapInArrow(_rebuild, "doc_id string, page_no int, para_no int, text string, open_start boolean, open_end boolean")
    )
    first = parts.where("open_start and not open_end").select("doc_id", F.col("page_no").alias("next_no"), F.col("text").alias("tail"), F.lit(True).alias("open_end"))
    last = parts.where("open_end").select("doc_id", "page_no").join(follows.hint("merge"), ["doc_id", "page_no"])
    tails = last.join(first.hint("merge"), ["doc_id", "next_no"]).select("doc_id", "page_no", "tail", "open_end")
    gone = last.select("doc_id", F.col("next_no").alias("page_no"), F.lit(0).alias("para_no"), F.lit(True).alias("moved"))
    return (
        parts.join(tails.hint("merge"), ["doc_id", "page_no", "open_end"], "left")
        .withColumn("text", F.concat_ws(" ", "text", "tail"))
        .join(gone.hint("merge"), ["doc_id", "page_no", "para_no"], "left")
        .where(~(F.coalesce("moved", F.lit(False)) & F.col("open_start") & ~F.col("open_end")))
        .select("doc_id", "page_no", "para_no", "text")
    )
