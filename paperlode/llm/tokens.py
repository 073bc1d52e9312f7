"""Token ids of whole texts by a public byte-level BPE vocabulary.

Words (pieces of the vocabulary's split pattern) are encoded together through an index of pair occurrences: every
adjacent pair of symbols maps to all its positions in the batch, the ranks present are applied in ascending order,
each to all its positions at once, and only the pairs beside a merge are updated. A merge never creates a pair of a
lower rank than its own, so the order equals that of merging word by word.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from paperlode.session import widen

#: Words a worker remembers; beyond it starts anew. It bounds memory and changes no result.
REMEMBERED = 400_000

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank (also the id) of every token of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairIndex:
    """Encodes many words at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.byte = [ranks[bytes([b])] for b in range(256)]
        token = {i: t for t, i in ranks.items()}
        self.merges: dict[tuple[int, int], int] = {}
        self.ranks, self.token = ranks, token

    def _rank(self, pair: tuple[int, int]) -> int | None:
        """The rank of a pair, looked up once and kept."""
        r = self.merges.get(pair, -1)
        if r == -1:
            r = self.merges[pair] = self.ranks.get(self.token[pair[0]] + self.token[pair[1]])
        return r

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        symbol: list[int] = []
        ends: list[int] = []
        for w in words:
            symbol.extend(map(self.byte.__getitem__, w.encode("utf-8", "surrogatepass")))
            symbol.append(-1)  # between words
            ends.append(len(symbol))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            if symbol[i] >= 0 and symbol[i + 1] >= 0:
                places.setdefault((symbol[i], symbol[i + 1]), []).append(i)
        queue = [(r, p) for p in places if (r := self._rank(p)) is not None]
        heapq.heapify(queue)
        while queue:
            r, pair = heapq.heappop(queue)
            left, right = pair
            at = places.pop(pair, None)
            if at is None:
                continue
            at.sort()
            for i in at:
                if symbol[i] != left:
                    continue  # taken by an earlier merge
                j = after[i]
                if j >= n or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = r, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                for a, b in ((before[i], i), (i, k)):
                    if a >= 0 and b < n and symbol[a] >= 0 and symbol[b] >= 0:
                        new = (symbol[a], symbol[b])
                        if new in places:
                            places[new].append(a)
                        elif (q := self._rank(new)) is not None:
                            places[new] = [a]
                            heapq.heappush(queue, (q, new))
        out, start = [], 0
        for e in ends:
            out.append([s for s in symbol[start : e - 1] if s >= 0])
            start = e
        return out


def _encode(ranks, pattern: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        split = regex.compile(pattern).findall
        index = PairIndex(ranks.value)
        known: dict[str, list[int]] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                pieces = [split(t) if t else [] for t in part.column(1).to_pylist()]
                if len(known) > REMEMBERED:
                    known = {}
                fresh = list({w for p in pieces for w in p if w not in known})
                known.update(zip(fresh, index.encode(fresh), strict=True))
                if len(index.merges) > 4 * REMEMBERED:
                    index.merges.clear()
                flat: list[int] = []
                offsets = [0]
                for p in pieces:
                    for w in p:
                        flat += known[w]
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], schema=schema)

    return run


def token_ids(documents: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids (the token ids of its whole text, without special tokens) of every row.

    In: doc_id bigint, text; further columns are ignored. Names of special tokens inside a text are plain text. An
    empty and a null text both give an empty list; repeated rows stay repeated. The vocabulary (a few MB, fixed by
    its file) is the only thing broadcast.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return widen(documents.select("doc_id", "text")).mapInArrow(_encode(ranks, pattern), "doc_id bigint, ids array<int>")
