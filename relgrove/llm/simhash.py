"""SimHash near-dedup by bit-sliced comparison (operator 3).

1. Fingerprints, one pass over the texts: words are cut at ASCII white space,
   A-Z is lower-cased, and each 4-word shingle is hashed by XXH64 (seed 42). A
   bit is set if it is set in over half of the shingles, repeats included.
2. Equal fingerprints become one row. To find those at ``radius`` bits or
   fewer, the 64 bits are cut into ``blocks`` blocks: two such fingerprints
   agree in at least ``blocks - radius`` of them, so they share a bucket of one
   of the tables over that many blocks (6 blocks: 15 tables of 21 bits or so).
   There are as many blocks as keep buckets at some ``BUCKET`` of the distinct
   fingerprints on average: 7, with 35 tables of 27 bits, for over 1e9 of them.
3. Buckets over ``chunk`` rows are dealt into chunks, and each pair of chunks
   becomes a bucket of its own, so no task gets an unbounded bucket.
4. Within a bucket, fingerprints are bit planes that are compared by XOR and
   carry-save counters (``bitslice``). A bucket returns a star for each of its
   components, so it returns fewer links than it has rows.
5. Components over the links, by star rounds.

Defined results: null and empty texts have no words and fingerprint zero, which
links like any other; texts of fewer than four words have one shingle. Repeated
rows are rows of their own with equal fingerprints. A null doc_id never is the
component_id unless all ids of the component are null. An empty table gives an
empty result; extra columns are ignored by ``near_duplicates``, passed through
by ``deduplicate``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgrove.llm import bitslice
from relgrove.llm.common import checkpointed, free_name, row_number_of_scan
from relgrove.llm.components import connected_components

WORDS, SEED, RADIUS, CHUNK = 4, 42, 4, 4096
LEAST_BLOCKS, MOST_BLOCKS, BUCKET = 6, 10, 512
#: Shingle hashes whose bits are counted at once; bounds memory (64 bytes each).
_AT_ONCE = 60_000


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of a text, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z is lowered, only ASCII white space cuts
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def _majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprints of texts given the hashes of each."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        counts = np.zeros((len(full), 64), np.int64)
        for row, k in enumerate(full.tolist()):
            own = np.array(hashes[k], np.uint64)
            if len(own) > _AT_ONCE:
                for at in range(0, len(own), _AT_ONCE):
                    counts[row] += np.unpackbits(own[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        small = [(row, k) for row, k in enumerate(full.tolist()) if sizes[k] <= _AT_ONCE]
        if small:
            own = np.fromiter((h for _, k in small for h in hashes[k]), np.uint64, int(sum(sizes[k] for _, k in small)))
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            firsts = np.r_[0, np.cumsum([sizes[k] for _, k in small])[:-1]]
            counts[[row for row, _ in small]] = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
        out[full] = np.ascontiguousarray(np.packbits(2 * counts > sizes[full][:, None], axis=1, bitorder="little")).view(np.uint64)[:, 0]
    return out


def fingerprints_of(texts, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints (uint64) of an iterable of texts."""
    out, held, n = [], [], 0
    for t in texts:
        held.append(shingle_hashes(t, words, seed))
        n += len(held[-1])
        if n >= _AT_ONCE:
            out.append(_majority(held))
            held, n = [], 0
    out.append(_majority(held))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = fingerprints_of(x.as_py() for x in b.column(2)) if b.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["rid", "doc_id", "fp"])

    df = docs.select(row_number_of_scan().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return df.mapInArrow(run, "rid long, doc_id long, fp long")


def masks(radius: int, blocks: int) -> list[int]:
    """A bit mask for each table: the bits of ``blocks - radius`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(one[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _bucket_rows(distinct: DataFrame, radius: int, blocks: int, chunk: int) -> DataFrame:
    """(fp, key): a row for each bucket of a fingerprint."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius, blocks)]
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "part"))
    crowded = keyed.groupBy("t", "part").count().where(F.col("count") > chunk).select("t", "part", F.ceil(F.col("count") / chunk).cast("int").alias("m"))
    dealt = keyed.join(crowded, ["t", "part"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    return dealt.select("fp", "t", "part", F.inline(pairs))


def _linked(radius: int):
    def run(batches):
        held: list[np.ndarray] = []

        def out(rows):
            keys, fps = rows
            new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(fps)][np.cumsum(new) - 1]
            a, b = bitslice.links(fps, ends, radius)
            return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], ["u", "v"])

        keys = np.zeros((0, 4), np.int64)
        fps = np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.concatenate([keys, np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(1, 5)], axis=1)])
            fps = np.concatenate([fps, b.column(0).to_numpy().view(np.uint64)])
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield out((keys[:cut], fps[:cut]))
                keys, fps = keys[cut:], fps[cut:]
        if len(fps):
            yield out((keys, fps))

    return run


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Into how many blocks the bits of n distinct fingerprints are cut."""
    blocks = max(LEAST_BLOCKS, radius + 1)
    while blocks < MOST_BLOCKS + radius and n > BUCKET << 64 * (blocks - radius) // blocks:
        blocks += 1
    return blocks


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = LEAST_BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that connect just those fingerprints (column fp, each once) that links within the radius connect."""
    if not 0 <= radius <= bitslice.MAX_RADIUS or blocks <= radius:
        raise ValueError("the radius must be from 0 to 6, and there must be more blocks than that")
    keys = ["t", "part", "i", "j"]
    rows = _bucket_rows(distinct, radius, blocks, chunk).repartition(*keys).sortWithinPartitions(*keys)
    return rows.select("fp", *keys).mapInArrow(_linked(radius), "u long, v long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(rid, doc_id, fingerprint, component_id, kept) of each row; kept: the component's first row."""
    thin = checkpointed(fingerprints(docs, doc_id, text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    distinct = checkpointed(thin.groupBy("fp").agg(first))
    roots = connected_components(links(distinct.select("fp"), radius, blocks or blocks_for(distinct.count(), radius), chunk))
    tied = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "first")
    heads = distinct.join(roots.select("root").distinct(), distinct.fp == F.col("root")).select("fp", "root", "first")
    every = tied.unionByName(heads)
    least = every.groupBy("root").agg(F.min("first").alias("least"))
    moved = every.join(least, "root").select("fp", "least")
    firsts = distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))
    firsts = checkpointed(firsts)  # so that both sides of the join below are shuffled for it, and it may split the rows of a hot fingerprint
    return thin.join(firsts, "fp").select(
        "rid", "doc_id", hex_of(F.col("fp")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("kept")
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs``, with all its columns; of each component the row with the smallest doc_id stays."""
    rid = free_name(docs, "rid")
    dropped = near_duplicates(docs, doc_id, text, **options).where(~F.col("kept")).select(F.col("rid").alias(rid))
    return docs.withColumn(rid, row_number_of_scan()).join(dropped, rid, "left_anti").drop(rid)
