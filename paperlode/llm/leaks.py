"""Held-out passages inside a corpus, by one Aho-Corasick automaton over the normalised items.

Any n consecutive words of an item hold one of its blocks of ``(n + 1) // 2`` words that begin at a multiple of that
length. Only these blocks are in the automaton, which so has no more nodes than the items have characters; where one is
met in a text, the passage is extended word by word in both directions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.session import widen

#: Consecutive words that make a passage.
WORDS = 13
#: Characters of items in one automaton, which takes about 35 bytes for each; a larger set of items is scanned in
#: several passes.
AUTOMATON = 8_000_000

_WORD = re.compile(r"[^\W_]+")

OUT = "item_id bigint, doc_id bigint, char_start bigint, char_end bigint, words int"


def normalised(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words (runs of letters and digits) and where each stands in the text."""
    words, places = [], []
    for m in _WORD.finditer(text):
        words.append(m.group().lower())
        places.append(m.span())
    return words, places


class Blocks:
    """The blocks of all items in one automaton, and the words of the items."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        import ahocorasick

        self.n, self.length = n, (n + 1) // 2
        self.words: dict[int, list[str]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            words = normalised(text)[0]
            if len(words) < n:
                continue
            self.words[item] = words
            for p in range(0, len(words) - self.length + 1, self.length):
                at.setdefault(" " + " ".join(words[p : p + self.length]) + " ", []).append((item, p))
        self.automaton = None
        if at:
            self.automaton = ahocorasick.Automaton()
            while at:
                block, places = at.popitem()
                self.automaton.add_word(block, tuple(places))
            self.automaton.make_automaton()

    def runs(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each item the stretches of the words (first, one past the last) that are n or more words of it;
        stretches that overlap or touch are one."""
        if self.automaton is None or len(words) < self.n:
            return {}
        at: dict[int, int] = {}  # the blank after a word -> the words up to it; made when there is a first hit
        done: dict[tuple[int, int], int] = {}  # item and shift against it -> words already extended over
        found: dict[int, list[tuple[int, int]]] = {}
        for end, places in self.automaton.iter(" " + " ".join(words) + " "):
            if not at:
                count = 0
                for i, w in enumerate(words, 1):
                    count += len(w) + 1
                    at[count] = i
            first = at[end] - self.length
            for item, p in places:
                if done.get((item, first - p), 0) > first:
                    continue
                own = self.words[item]
                a, b = first, first + self.length
                x, y = p, p + self.length
                while a and x and words[a - 1] == own[x - 1]:
                    a, x = a - 1, x - 1
                while b < len(words) and y < len(own) and words[b] == own[y]:
                    b, y = b + 1, y + 1
                done[item, first - p] = b
                if b - a >= self.n:
                    found.setdefault(item, []).append((a, b))
        for item, stretches in found.items():
            merged: list[tuple[int, int]] = []
            for a, b in sorted(stretches):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            found[item] = merged
        return found


#: The last automaton this worker has built, by the key of its items.
_BUILT: dict[str, Blocks] = {}


def _blocks(key: str, items, n: int) -> Blocks:
    """The automaton of these items, built once a worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Blocks(items.value, n)
    return _BUILT[key]


def _scan(key: str, items, n: int):
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(key, items, n)
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found = blocks.runs([w.lower() for w in _WORD.findall(text)])
                if not found:
                    continue
                places = normalised(text)[1]
                for item, stretches in found.items():
                    for first, last in stretches:
                        for name, value in (("item_id", item), ("doc_id", doc), ("char_start", places[first][0]), ("char_end", places[last - 1][1]), ("words", last - first)):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def leaked(documents: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """Every passage of n or more consecutive words of an item inside a document, with its place in the text.

    Out: item_id, doc_id, char_start, char_end (offsets in the text as it stands), words. Words are runs of letters
    and digits, compared in lower case; all between them is ignored. Null and empty texts, and items of fewer than n
    words, match nothing. Items are a held-out set; they go to the workers in automata of bounded size, one pass
    over the texts each, so any number of items is scanned in full.
    """
    spark = documents.sparkSession
    kept = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    size = kept.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // AUTOMATON))
    texts = widen(documents.select("doc_id", "text"))
    found = None
    for p in range(passes):
        part = [(r.item_id, r.text) for r in kept.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toLocalIterator()]
        hits = texts.mapInArrow(_scan(uuid.uuid4().hex, spark.sparkContext.broadcast(part), n), OUT)
        found = hits if found is None else found.unionByName(hits)
    return found
