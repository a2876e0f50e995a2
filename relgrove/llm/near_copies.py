"""Near copies by SimHash, for the pipeline's near-dedup stage; an exact Jaccard check follows.

Two texts are near copies if their sets of five-word shingles (words as in
``simhash``) have a Jaccard similarity of 0.8 or more.

1. One pass over the texts: shingle set and its hash, and a SimHash fingerprint
   of 256 bits over the set (repeats don't count, as they don't for Jaccard).
   At 0.8 two of them differ by some 39 bits (up to 48 if there are only four
   shingles), unrelated ones by 128, so a ``radius`` of 66 (76 for at
   most five shingles) parts them; of 64 bits these would be 10 and 32.
2. Equal shingle sets become one node.
3. Blocks of fingerprints are tables: each takes ``rows`` of the bits as a key,
   so many that a bucket has some ``BUCKET`` nodes; two fingerprints at 0.8
   agree in a key with probability 0.85^rows. There are ``bands`` tables, see
   ``bands_for``.
4. Within a bucket, fingerprints are bit planes that are compared by XOR and
   carry-save counters (``bitslice.wide_neighbours``), in the order of their
   sets' sizes and as far as sizes allow the similarity.
5. Each node with candidates is compared with the least of them in the bucket,
   exactly, by the shingles.
6. Groups of candidates with more pairs than that, joined over the tables where
   they share members, whose members these links leave in different components
   are compared whole. Their members' sets of
   shingle hashes become the rows of a bit matrix, whose AND and popcounts give
   the exact overlaps of all pairs at once, within a task. A group returns a
   spanning forest of what it links, so it returns fewer links than it has
   members, however many pairs are similar.
7. Components over the links; the first row of each stays.

Groups of over ``chunk`` members, or with more shingles than a task should
hold, are dealt into pairs of chunks, as in ``simhash``, and so are buckets of
over eight times as many; each pair of members meets in one of them at least.

Defined results: null, empty and blank texts have the empty set and equal each
other; texts of fewer than five words have one shingle. Of repeated rows and
equal sets one row stays. Null ids rank behind all others. An empty table gives
an empty result; all columns pass through, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrove.llm import bitslice
from relgrove.llm.common import checkpointed, free_name, numbered, row_number_of_scan, sized
from relgrove.llm.components import connected_components
from relgrove.llm.simhash import SEED, shingle_hashes

WORDS, SIMILARITY, RADIUS = 5, 0.8, 76
BITS, BUCKET, CHUNK = 256, 2048, 1024
#: How often two bits differ at the similarity, at most (sets of four and five shingles; 0.15 for large sets), and how often no table may hold a pair of which they do so.
_DIFFER, _MISSED = 0.1875, 5e-5
_AT_ONCE, _NODES = 8192, 512
#: Sets of more than five shingles differ in 0.157 of the bits at most, so their radius is less.
_FEW, _LESS = 5, 10
#: Shingles of a chunk of a group, about, and columns of its bit matrix at once.
_HELD_SETS, _COLUMNS = 1 << 20, 4096
#: A bucket may have so many chunks' nodes; lanes compared at once, about; pairs of these held.
_CHUNKS, _LANES, _PAIRS = 8, 1 << 17, 1 << 21
_WORDS = [f"f{k}" for k in range(BITS // 64)]


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes (uint64), as words: a bit is 1 if set in over half of them, mixed anew for each word."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        words = hashes[at : at + _AT_ONCE, None] + np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        words = (words ^ words >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        words = (words ^ words >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((words ^ words >> np.uint64(31)).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of bytes
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def rows_for(n: int) -> int:
    """How many bits a key has, given the number of nodes."""
    return max(0, math.ceil(math.log2(max(1, n) / BUCKET)))


def bands_for(rows: int) -> int:
    """How many tables there are; a quarter more than independent keys would need, as keys of one fingerprint are not."""
    return math.ceil(1.25 * math.log(_MISSED) / math.log(1 - (1 - _DIFFER) ** rows)) if rows else 1


def positions(bands: int, rows: int) -> np.ndarray:
    """(bands, rows): the bits of each table's key; tables share bits as seldom as can be."""
    rng, out = np.random.default_rng(SEED), []
    while rows and len(out) < bands:
        order = rng.permutation(BITS)
        out += [order[k : k + rows] for k in range(0, BITS - rows + 1, rows)]
    return np.array(out[:bands], np.int64).reshape(bands, rows)


def _keys(bands: int, rows: int):
    """Each node's keys, as signed longs; columns rid, size and the fingerprint's words."""
    at, by = positions(bands, rows), np.int64(1) << np.arange(rows, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, _NODES):
                b = batch.slice(first, _NODES)
                bits = np.unpackbits(_fingerprints(b, 2).view(np.uint8), axis=1, bitorder="little")
                keys = (bits[:, at.ravel()].reshape(b.num_rows, bands, rows) * by).sum(axis=2) + (np.arange(bands) << rows)
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["rid", "size", *_WORDS, "keys"])

    return run


def _fingerprints(b: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([b.column(first + k).to_numpy().view(np.uint64) for k in range(len(_WORDS))], axis=1)


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def signatures(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(rid, doc_id, node, size, words of the fingerprint): node stands for the shingle set, size is its size."""

    def run(batches):
        for b in batches:
            nodes, sizes, fps = [], [], np.zeros((b.num_rows, len(_WORDS)), np.uint64)
            for k, t in enumerate(b.column(2)):
                own = np.unique(np.array(shingle_hashes(t.as_py(), words), np.uint64))
                nodes.append(xxhash.xxh128_digest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps[k] = fingerprint(own)
            columns = [pa.array(f) for f in fps.view(np.int64).T]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), *columns], ["rid", "doc_id", "node", "size", *_WORDS])

    df = docs.select(row_number_of_scan().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return df.mapInArrow(run, "rid long, doc_id long, node binary, size long, " + ", ".join(f"{w} long" for w in _WORDS))


def _verified(docs: DataFrame, pairs: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of row numbers, u < v, whose texts are similar enough; each text comes once for a pair's v, and once for all pairs of a u."""
    needed = sized(pairs.select("u", F.col("v").alias("rid")).unionByName(pairs.select("u", F.col("u").alias("rid")).distinct()))
    texts = numbered(docs.select(row_number_of_scan().alias("rid"), F.col(text).alias("text")), "rid", needed.select("rid"))

    def run(batches):
        u, own = None, set()
        for b in batches:
            left, right = [], []
            for at, rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                these = shingles(t.as_py(), words)
                if rid == at:
                    u, own = at, these
                elif at != u:
                    raise ValueError(f"no text for row {at}")
                elif jaccard(own, these) >= similarity:
                    left.append(at)
                    right.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    dealt = needed.join(texts, "rid").select("u", "rid", "text").repartition("u").sortWithinPartitions("u", "rid")
    return dealt.mapInArrow(run, "u long, v long")


def reach(bucket: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """For rows by bucket and size: the end of those after each whose sizes allow the similarity."""
    most = np.floor(sizes / similarity + 1e-9).astype(np.int64)
    span = int(most.max(initial=0)) + 1
    return np.searchsorted(bucket * span + sizes, bucket * span + most, side="right")


def candidates(bucket: np.ndarray, rids: np.ndarray, sizes: np.ndarray, fps: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, ...]:
    """(u, v, member, group) of rows by bucket and size.

    v: row numbers with a candidate among the lesser ones of their bucket, u is
    the least of these. Where that leaves pairs out, all members of the group,
    which stands for the component of candidates within the bucket.
    """
    n = len(rids)
    least, before = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    a, b, held = [], [], 0
    for i, j in bitslice.wide_neighbours(fps, reach(bucket, sizes, similarity), radius):
        near = (np.minimum(sizes[i], sizes[j]) <= _FEW) | (np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= radius - _LESS)
        i, j = i[near], j[near]
        first = rids[i] < rids[j]
        lesser, later = np.where(first, i, j), np.where(first, j, i)
        np.minimum.at(least, later, rids[lesser])
        np.add.at(before, later, 1)
        a.append(i)
        b.append(j)
        held += len(i)
        if held > _PAIRS:  # a star for each component says as much
            label = bitslice.merged(n, np.concatenate(a), np.concatenate(b))
            rest = np.flatnonzero(label != np.arange(n))
            a, b, held = [rest], [label[rest]], 0
    v = np.flatnonzero(before)
    if not len(v):
        return (np.zeros(0, np.int64),) * 4
    label = bitslice.merged(n, np.concatenate(a), np.concatenate(b))
    member = np.flatnonzero(np.isin(label, label[before > 1]))
    return least[v], rids[v], member, label[member]


def _candidates(similarity: float, radius: int):
    """Rows (rid, v, key, i, j, head) of buckets: candidate pairs, and with a null v the members of the group of ``head``; rows come by (key, i, j, size) in columns 0 to 3, then rid and fingerprint."""

    def run(batches):
        def out(held):
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            rids = b.column(4).to_numpy()
            bucket = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)])
            u, v, member, group = candidates(bucket, rids, b.column(3).to_numpy(), _fingerprints(b, 5), similarity, radius)
            none, own = pa.nulls(len(u), pa.int64()), keys[member]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none, none, none, none], names)
            yield pa.RecordBatch.from_arrays([pa.array(rids[member]), pa.nulls(len(member), pa.int64()), *(pa.array(own[:, k]) for k in range(3)), pa.array(rids[group])], names)

        names = ["rid", "v", "key", "i", "j", "head"]
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            if n >= _LANES:
                keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
                before = [held[-1].column(k)[-1].as_py() for k in range(3)]
                cut = np.flatnonzero((keys != before).any(axis=1))
                if len(cut):  # the last bucket ends here
                    yield from out([*held, b.slice(0, int(cut[0]))])
                    b, held, n = b.slice(int(cut[0])), [], 0
            held.append(b)
            n += b.num_rows
        if held:
            yield from out(held)

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of some sets (uint64, each hash once) share."""
    sizes = np.array([len(s) for s in sets], np.int64)
    whose = np.repeat(np.arange(len(sets)), sizes)
    _, column, copies = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    shared = copies[column] > 1  # what only one set holds is in no overlap
    number = np.cumsum(copies > 1) - 1
    whose, column = whose[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    whose, column = whose[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int((copies > 1).sum()), _COLUMNS):
        own = slice(*np.searchsorted(column, [first, first + _COLUMNS]))
        bits = np.zeros((len(sets), _COLUMNS), bool)
        bits[whose[own], column[own] - first] = True
        planes = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, (1 << 22) // planes.size)
        for at in range(0, len(sets), step):
            out[at : at + step] += np.bitwise_count(planes[at : at + step, None, :] & planes[None, :, :]).sum(axis=2, dtype=np.int64)
    out[np.diag_indices(len(sets))] = sizes
    return out


def forest(rids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between members of different components that connect all that the similar pairs connect."""
    both = overlaps(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    near = np.triu(both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1) >= similarity, 1) & (roots[:, None] != roots[None, :])
    _, comp = np.unique(roots, return_inverse=True)
    u, v = np.nonzero(near)
    label, out = list(range(len(rids))), []

    def find(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    _, some = np.unique(comp[u] * len(rids) + comp[v], return_index=True)  # one pair for each two components
    for k in some.tolist():
        a, b = find(int(comp[u[k]])), find(int(comp[v[k]]))
        if a != b:
            label[a] = b
            out.append((int(rids[u[k]]), int(rids[v[k]])))
    return out


def _whole_buckets(similarity: float):
    """Links of buckets; rows come sorted by (key, i, j) in columns 0 to 2, then rid, root, hashes."""

    def run(batches):
        key, rids, roots, sets = None, [], [], []

        def links():
            found = forest(np.array(rids), np.array(roots), sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            for own, rid, root, hashes in zip(keys, b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                if own != key:
                    if rids:
                        yield links()
                    key, rids, roots, sets = own, [], [], []
                rids.append(rid)
                roots.append(root)
                sets.append(hashes.values.to_numpy().view(np.uint64))
        if rids:
            yield links()

    return run


def hash_sets(docs: DataFrame, rids: DataFrame, text: str, words: int) -> DataFrame:
    """(rid, hashes): the set of shingle hashes of the rows numbered in ``rids``."""

    def run(batches):
        for b in batches:
            sets = [np.unique(np.array(shingle_hashes(t.as_py(), words), np.uint64)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rid", "hashes"])

    texts = docs.select(row_number_of_scan().alias("rid"), F.col(text).alias("text"))
    return numbered(texts, "rid", rids).mapInArrow(run, "rid long, hashes array<long>")


def _dealt(m):
    """(i, j): the pairs of m chunks that hold a row's own chunk."""
    own = F.pmod(F.xxhash64("rid"), m).cast("int")
    return F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))


def groups(found: DataFrame, nodes: DataFrame, chunk: int) -> DataFrame:
    """(rid, size, key): the members of the groups to compare whole, given those of the tables' groups as (rid, head, key).

    Tables find much the same members again and again, each in groups of its
    own. Groups that share members, of any tables, become one, which holds all
    their pairs. Groups over a task's share stay as found where dealing the one
    into pairs of chunks would take more rows than these have.
    """
    found = checkpointed(found)
    joined = connected_components(found.select(F.col("rid").alias("u"), F.col("head").alias("v")))
    own = found.groupBy("rid").count().join(joined, F.col("rid") == joined.node, "left").select("rid", "count", F.coalesce("root", "rid").alias("key"))
    own = checkpointed(own.join(nodes.select("rid", "size"), "rid"))
    large = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"), F.sum("count").alias("found"))
    large = large.withColumn("m", F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("held") / _HELD_SETS))).where("m > 1 AND n * m > found")
    large = own.join(sized(large.select("key")), "key", "left_semi").select("rid", "size")
    large = checkpointed(found.select("rid", F.xxhash64("key", "head").alias("key")).join(large, "rid"))
    return own.join(large.select("rid").distinct(), "rid", "left_anti").select("rid", "size", "key").unionByName(large.select("rid", "size", "key"))


def links(docs: DataFrame, nodes: DataFrame, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, bands: int | None = None, rows: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) between nodes (rid, size, words of the fingerprint: each shingle set once) that connect just what near copies connect."""
    if rows is None:
        rows = rows_for(nodes.count())
    deal, thin = ["key", "i", "j"], ["rid", "size", *_WORDS]
    keyed = nodes.where("size > 0").select(*thin).mapInArrow(_keys(bands or bands_for(rows), rows), ", ".join(f"{c} long" for c in thin) + ", keys array<long>")
    keyed = keyed.select(*thin, F.explode("keys").alias("key"))
    crowded = sized(keyed.groupBy("key").count().where(F.col("count") > _CHUNKS * chunk).select("key", F.ceil(F.col("count") / (_CHUNKS * chunk)).cast("int").alias("m")))
    buckets = keyed.join(crowded, "key", "left").select("key", *thin, F.inline(_dealt(F.coalesce("m", F.lit(1)))))
    buckets = buckets.repartition(*deal).sortWithinPartitions(*deal, "size").select(*deal, "size", "rid", *_WORDS)
    found = checkpointed(buckets.mapInArrow(_candidates(similarity, radius), "rid long, v long, key long, i long, j long, head long"))
    stars = checkpointed(found.where("v IS NOT NULL").select(F.col("rid").alias("u"), "v").distinct())
    first = checkpointed(_verified(docs, stars, text, words, similarity))
    roots = connected_components(first)
    members = groups(found.where("v IS NULL").select("rid", "head", F.xxhash64(*deal).alias("key")), nodes, chunk)
    tied = members.join(roots, members.rid == roots.node, "left").select("key", "rid", "size", F.coalesce("root", "rid").alias("root"))
    mixed = tied.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"), F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key", "n", "held")
    mixed = checkpointed(mixed)  # so that both sides of the join are shuffled for it, and it may split the rows of a crowded key
    m = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("held") / _HELD_SETS)).cast("int")
    rest = checkpointed(tied.join(mixed, "key").select("key", "rid", "root", F.inline(_dealt(m))))
    sets = checkpointed(hash_sets(docs, rest.select("rid"), text, words))
    whole = rest.join(sets, "rid").repartition(*deal).sortWithinPartitions(*deal).select(*deal, "rid", "root", "hashes")
    return first.unionByName(whole.mapInArrow(_whole_buckets(similarity), "u long, v long"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, bands: int | None = None, rows: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``docs``, with all its columns; of each group of near copies the row with the smallest doc_id stays."""
    thin = checkpointed(signatures(docs, doc_id, text, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    heads = checkpointed(thin.groupBy("node").agg(first, F.min_by(F.struct("rid", "size", *_WORDS), "rid").alias("own")))
    nodes = heads.select("own.*")
    roots = connected_components(links(docs, nodes, text, words, similarity, radius, bands, rows, chunk))
    tied = heads.join(roots, F.col("own.rid") == roots.node, "left").select("first", F.coalesce("root", "own.rid").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("least")).select("least.rid")
    rid = free_name(docs, "rid")
    return numbered(docs.withColumn(rid, row_number_of_scan()), rid, least).drop(rid)
