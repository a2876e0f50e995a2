"""Benchmark decontamination by greedy string tiling (operator 1).

Texts and benchmark items are lower-cased words; in scripts that put no blanks
between words (Thai, Lao, Khmer, Chinese, Japanese), each character is a word. A seed is a run of
``min_match`` words that a document and an item share; its Karp-Rabin hash is
looked up in an index of the items' seeds. For each item that a document shares
seeds with, tiles are laid: running Karp-Rabin hashes of shrinking length find
the longest common runs of words that no tile covers yet, in both texts, and
they are marked, longest first, until none of ``min_match`` words is left. An
item leaks if tiles cover ``coverage`` of its words; order does not matter, so
reordered passages are caught.

The benchmark is the stated query set. It is dealt into blocks of at most
``block_words`` words, each is sent to the executors once and is compared with
all documents in a pass without a shuffle, so neither its size nor hot
passages gather anything in one place.

Defined results: null and empty texts share nothing. Items of fewer than
``min_match`` words (null ones too) have no seed and never leak. Items with
equal texts leak each. Repeated rows are rows of their own. Of equally long
tiles the first in the item, then in the document is laid. Empty tables give an
empty result; extra columns are ignored by ``leaks``, passed through by
``decontaminate``. Item ids and doc_ids may be null.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_MATCH, COVERAGE = 5, 0.5
BLOCK_WORDS = 500_000
#: Characters of scripts without blanks between words.
_ALONE = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rolling(codes: list[int], size: int) -> Iterator[int]:
    """The Karp-Rabin hash of each run of ``size`` codes."""
    if size > len(codes):
        return
    h, top = 0, pow(_BASE, size - 1, _MOD)
    for c in codes[:size]:
        h = (h * _BASE + c) % _MOD
    yield h
    for gone, c in zip(codes, codes[size:], strict=False):
        h = ((h - gone * top) * _BASE + c) % _MOD
        yield h


def _free_runs(marked: list[bool]) -> Iterator[tuple[int, int]]:
    start = None
    for k, m in enumerate([*marked, True]):
        if m and start is not None:
            yield start, k
            start = None
        elif not m and start is None:
            start = k


def _same(a: list[int], i: int, b: list[int], j: int, most: int) -> int:
    """How many of the next ``most`` codes are equal."""
    n, step = 0, 64
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, 2 * step
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
            most = min(most, n + 2 * step + 1)
    return n


def _scan(a: list[int], b: list[int], ma: list[bool], mb: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Common runs (length, in a, in b) of unmarked codes of ``size`` or more, each extended as far as it goes.

    The index holds places by hash and then by the code before (None where a
    free run begins), so places that only go on with a run that starts before
    are passed over together.
    """
    index: dict[int, dict[int | None, list[tuple[int, int]]]] = {}
    for s, e in _free_runs(ma):
        for k, h in enumerate(rolling(a[s:e], size), s):
            index.setdefault(h, {}).setdefault(a[k - 1] if k > s else None, []).append((k, e))
    found = []
    for s, e in _free_runs(mb):
        for j, h in enumerate(rolling(b[s:e], size), s):
            for before, places in index.get(h, {}).items():
                if before is not None and j > s and b[j - 1] == before:
                    continue
                for i, end in places:
                    n = _same(a, i, b, j, min(end - i, e - j))
                    if n >= size:
                        found.append((n, i, j))
    return found


def tiles(a: list[int], b: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """The tiles (start in a, start in b, length) of greedy string tiling by running Karp-Rabin."""
    ma, mb, out, left = [False] * len(a), [False] * len(b), [], len(a)
    size = max(min_match, min(len(a), len(b)))
    while True:
        heap = [(-n, i, j) for n, i, j in _scan(a, b, ma, mb, size)]
        heapify(heap)
        while heap and left:
            n, i, j = heappop(heap)
            own, other = ma[i : i - n], mb[j : j - n]
            if True not in own and True not in other:
                ma[i : i - n], mb[j : j - n] = [True] * -n, [True] * -n
                out.append((i, j, -n))
                left += n
                continue
            if False not in own or False not in other:
                continue
            for s, e in _free_runs([x or y for x, y in zip(own, other, strict=True)]):  # what earlier tiles left of it
                if e - s >= size:
                    heappush(heap, (s - e, i + s, j + s))
        if size == min_match or left < min_match:
            return out
        size = max(min_match, size // 2)


class Index:
    """The seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int = MIN_MATCH):
        self.min_match, self.code, self.ids, self.codes = min_match, {}, [], []
        self.seeds: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if len(words) < min_match:
                continue
            codes = [self.code.setdefault(w, len(self.code) + 1) for w in words]
            for h in set(rolling(codes, min_match)):
                self.seeds[h].append(len(self.ids))
            self.ids.append(item_id)
            self.codes.append(codes)
        self.seeds = dict(self.seeds)

    def leaks(self, text: str | None, coverage: float = COVERAGE) -> list[tuple[int | None, float, list[tuple[int, int, int]]]]:
        """(item, share of its words that tiles cover, tiles) of each item that leaks."""
        get = self.code.get
        codes = [get(w, 0) for w in words_of(text)]  # 0: no item has the word
        m, touched, keep = self.min_match, set(), [False] * len(codes)
        start = 0
        while start < len(codes):  # runs without unknown words
            if not codes[start]:
                start += 1
                continue
            try:
                end = codes.index(0, start)
            except ValueError:
                end = len(codes)
            if end - start >= m:
                for k, h in enumerate(rolling(codes[start:end], m), start):
                    if h in self.seeds:
                        touched.update(self.seeds[h])
                        keep[k : k + m] = [True] * m
            start = end
        if not touched:
            return []
        # words outside of seeds can't be in a tile: each gap of them is one unknown word
        place = [k for k in range(len(codes)) if keep[k] or k and keep[k - 1]]
        near = [codes[k] if keep[k] else -1 for k in place]
        out = []
        for t in sorted(touched):
            laid = tiles(self.codes[t], near, m)
            share = sum(n for _, _, n in laid) / len(self.codes[t])
            if share >= coverage:
                out.append((self.ids[t], share, [(i, place[j], n) for i, j, n in laid]))
        return out


def blocks(benchmark: DataFrame, item_id: str | None = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items of the benchmark in blocks of bounded size; the driver holds one block at a time."""
    block, words = [], 0
    for row in benchmark.select((F.col(item_id) if item_id else F.lit(None)).cast("long"), F.col(text)).toLocalIterator():
        n = len(words_of(row[1]))
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((row[0], row[1]))
        words += n
    if block:
        yield block


_LEAK = "doc_id long, item_id long, coverage double, tiles array<struct<item_word:int,doc_word:int,words:int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item that leaks into it: doc_id, item_id, coverage, tiles."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])))])
    out = spark.createDataFrame([], _LEAK)
    for block in blocks(benchmark, item_id, item_text, block_words):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            index = Index(sent.value, min_match)
            for b in batches:
                found = [
                    {"doc_id": doc.as_py(), "item_id": item, "coverage": share, "tiles": [{"item_word": i, "doc_word": j, "words": n} for i, j, n in laid]}
                    for doc, t in zip(b.column(0), b.column(1), strict=True)
                    for item, share, laid in index.leaks(t.as_py(), coverage)
                ]
                yield pa.RecordBatch.from_pylist(found, schema)

        out = out.unionByName(rows.mapInArrow(run, _LEAK))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs``, with all its columns, without the rows into which an item of the benchmark leaks."""
    at = docs.columns.index(text)
    for block in blocks(benchmark, None, item_text, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            index = Index(sent.value, min_match)
            for b in batches:
                yield b.filter(pa.array([not index.leaks(t.as_py(), coverage) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
