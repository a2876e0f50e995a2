"""Best-fit packing of tokenised documents into sequences (operator 8).

Bulk-synchronous best-fit decreasing. A document is its token ids and one end
id; only a document longer than a sequence is cut, its first piece takes the
remainder. Rounds go down the lengths by halves: first the pieces over half a
sequence, then those over a quarter, an eighth, and the rest. In each round

- the round's pieces and the gaps of open sequences that may hold one are dealt
  to shares of some ``share`` rows by their rank among equals, so that all
  shares have alike pieces and gaps, and no two want the same gap;
- a share is range-sorted, and a successor sweep from the longest piece down
  gives each the smallest gap that holds it, or else a new sequence. Lengths are
  whole numbers, so equal pieces and equal gaps are runs that are swept at once;
- gaps shrink by what they got, and all are dealt anew in the next round.

A share may open a sequence where another share had room. At most about one
sequence for each share is left that empty, and a last sweep over the contents
of emptier sequences (``SPARE`` of their length is free) puts them together.
A piece crosses the network once, a gap once a round; the driver sees counts of
rounds only.

Defined results: null text counts as empty and gives a piece of the end id
alone. Repeated rows are packed as documents of their own. A null doc_id stays
null. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Sequence
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from tokenizers import Tokenizer

from relgrove.llm.common import checkpointed, own_folder, written

SEQUENCE, END = 2048, 0
#: Pieces or gaps of a share, about; and how much of a sequence must be free for the last sweep to move its contents.
SHARE, SPARE = 4096, 0.25
VOCABULARY = "byte_bpe_50k.json"
_PROBE = "It's 12 o'clock,  naïve Übermut\n\n\tno—日本語 🙂 don't!!! <|endoftext|> \r\n x=1;  "


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids, those that ``tokenizers`` gives for the vocabulary at ``path``.

    The vocabulary is run by a faster library for the same byte-level BPE, with
    the same special tokens; on a probe with all kinds of characters both must
    give equal ids. Texts that the faster one can't take (it gives up on a
    million blanks in a row) go to ``tokenizers``.
    """
    slow = Tokenizer.from_file(path)
    bytes_of = _byte_alphabet()
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    ranks = {bytes(bytes_of[c] for c in token): i for token, i in slow.get_vocab().items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def exact(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    def quick(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            return exact(text)

    return quick if quick(_PROBE) == exact(_PROBE) else exact


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes a byte as a printable character: itself if it is printable Latin-1, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def cuts(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= sequence:
        return [(0, n)]
    first = n % sequence
    return ([(0, first)] if first else []) + [(s, sequence) for s in range(first, n, sequence)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, sequence: int = SEQUENCE, end: int = END, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each row."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids

    def run(batches):
        encode = encoder(path)
        for b in batches:
            cols: list[list] = [[] for _ in fields]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.array([*encode(text.as_py() or ""), end], "<u4")
                for k, (s, n) in enumerate(cuts(len(own), sequence)):
                    row = [doc, k, s, n, zlib.crc32(own[s : s + n].tobytes())] + [own[s : s + n].astype(np.int32)] * ids
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [f for f, _ in fields])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def plan(counts: dict[int, int], sequence: int = SEQUENCE, rooms: Sequence[int] = ()) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) for so many pieces of each length.

    rooms: those of open sequences, ascending; they are the first ones by number, new ones follow.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    free: list[int] = []  # the rooms that some gap has, ascending
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
    opened = len(rooms)

    def leave(room: int, first: int, count: int) -> None:
        if room:
            if room not in gaps:
                insort(free, room)
                gaps[room] = []
            gaps[room].append((first, count))

    at = 0
    for room, same in groupby(rooms):
        n = sum(1 for _ in same)
        leave(int(room), at, n)
        at += n
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(free, length)
            if at < len(free):  # the successor: the smallest room that holds the piece
                room = free[at]
                first, count = gaps[room].pop()
                if count > left:
                    gaps[room].append((first + left, count - left))
                    count = left
                if not gaps[room]:
                    del gaps[room]
                    free.pop(at)
            else:
                room, first, count = sequence, opened, -(-left // (sequence // length))
                opened += count
            runs.append((length, rank, count, first, sequence - room))
            leave(room - length, first, count)
            rank, left = rank + count, left - count
    return runs


def ranks(values: np.ndarray) -> np.ndarray:
    """The number of equal values before each."""
    order = np.argsort(values, kind="stable")
    own = values[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    out = np.empty(len(own), np.int64)
    out[order] = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return out


def place(sizes: np.ndarray, rooms: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence and offset of each piece, and the rooms that all sequences have then. rooms: ascending, those of the first sequences."""
    values, counts = np.unique(sizes, return_counts=True)
    runs = np.array(sorted(plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), sequence, rooms.tolist())), np.int64).reshape(-1, 5)
    rank = ranks(sizes)
    run = np.searchsorted(runs[:, 0] << 44 | runs[:, 1], sizes << 44 | rank, side="right") - 1
    own, offset = runs[run, 3] + rank - runs[run, 1], runs[run, 4]
    opened = max(0, int(own.max()) + 1 - len(rooms)) if len(own) else 0
    left = np.r_[rooms, np.full(opened, sequence, np.int64)]
    np.subtract.at(left, own, sizes)
    return own, offset, left


def _deal(shares: int):
    """Adds the share of each row: by its rank among the partition's rows of one kind and size, from a start that partitions don't share."""

    def run(batches):
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            size = b.column(b.schema.get_field_index("size")).to_numpy().astype(np.int64)
            kind = size * 2 + b.column(b.schema.get_field_index("gap")).to_numpy(zero_copy_only=False)
            values, counts = np.unique(kind, return_counts=True)
            before = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
            for v, n in zip(values.tolist(), counts.tolist(), strict=True):
                seen[v] = seen.get(v, 0) + n
            rank = ranks(kind) + before[np.searchsorted(values, kind)]
            share = (rank + kind * 40_503 + part * 7_919) % shares
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(share)], [*b.schema.names, "share"])

    return run


def _swept(sequence: int, number: int, fields: list[str]):
    """Sweeps each share; rows come sorted by it. Pieces get their place, sequences with room are gap rows."""

    def one(rows: pa.Table, share: int) -> list[pa.RecordBatch]:
        gap, size = rows.column("gap").to_numpy().astype(bool), rows.column("size").to_numpy()
        held, pieces = np.flatnonzero(gap), np.flatnonzero(~gap)
        held = held[np.argsort(size[held], kind="stable")]
        own, offset, left = place(size[pieces], size[held], sequence)
        given = rows.column("sequence_id").take(held).to_numpy()  # only those of gaps: with nulls they would become floats
        ids = np.r_[given.astype(np.int64), (number << 56) + (share << 24) + np.arange(len(left) - len(held))]
        placed = rows.select(fields).take(pieces)
        for name, values in (("gap", np.zeros(len(pieces), bool)), ("size", size[pieces]), ("sequence_id", ids[own]), ("offset", offset)):
            placed = placed.append_column(name, pa.array(values))
        some = np.flatnonzero(left)
        open_ = pa.table([pa.nulls(len(some), placed.schema.field(f).type) for f in fields], fields)
        for name, values in (("gap", np.ones(len(some), bool)), ("size", left[some]), ("sequence_id", ids[some]), ("offset", sequence - left[some])):
            open_ = open_.append_column(name, pa.array(values))
        return [b for t in (placed, open_) for b in t.combine_chunks().to_batches()]

    def run(batches):
        share, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            of = b.column(b.schema.get_field_index("share")).to_numpy()
            edges = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and of[s] != share:
                    yield from one(pa.Table.from_batches(held), share)
                    held = []
                share = int(of[s])
                held.append(b.slice(s, e - s))
        if held:
            yield from one(pa.Table.from_batches(held), share)

    return run


def _sweep(rows: DataFrame, n: int, number: int, path: str, fields: list[StructField], sequence: int, share: int) -> DataFrame:
    """One round over ``rows`` (the fields, gap, size, sequence_id), of which the greater kind has n: dealt, swept, and stored."""
    shares = max(1, -(-n // share))
    dealt = rows.mapInArrow(_deal(shares), StructType([*rows.schema.fields, StructField("share", LongType())]))
    dealt = dealt.repartition(shares, "share").sortWithinPartitions("share")
    nullable = [StructField(f.name, f.dataType, True) for f in fields]
    schema = StructType([*nullable, StructField("gap", BooleanType()), *(StructField(c, LongType()) for c in ("size", "sequence_id", "offset"))])
    return written(dealt.mapInArrow(_swept(sequence, number, [f.name for f in fields]), schema), path)


def pack(made: DataFrame, sequence: int = SEQUENCE, share: int = SHARE) -> DataFrame:
    """``made``, pieces with their length (any further columns pass through), with sequence_id and offset.

    ``made`` must be a checkpoint or a table, as it is read once a round.
    """
    folder, fields = own_folder(made.sparkSession, "packing"), made.schema.fields
    mine = {"gap": F.lit(False), "size": F.col("length").cast("long"), "sequence_id": F.lit(None).cast("long")}
    pieces = made.select(*(F.col(f.name) for f in fields), *(c.alias(n) for n, c in mine.items()))
    bounds = [(sequence // 2, sequence), (sequence // 4, sequence // 2), (sequence // 8, sequence // 4), (0, sequence // 8)]
    level = F.coalesce(*(F.when(F.col("length") > lo, F.lit(k)) for k, (lo, _) in enumerate(bounds)))
    todo = {r["level"]: r["count"] for r in made.groupBy(level.alias("level")).count().collect()}  # a row for each round
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    done, gaps = [], None
    for k, (lo, hi) in enumerate(bounds):
        if not todo.get(k):
            continue
        rows, n = pieces.where((F.col("length") > lo) & (F.col("length") <= hi)), todo[k]
        if gaps is not None:
            fit = gaps.where(F.col("size") > lo)
            n = max(n, fit.count())
            rows = rows.unionByName(fit.select(*nothing, F.lit(True).alias("gap"), "size", "sequence_id"))
        swept = _sweep(rows, n, k, f"{folder}/{k}", fields, sequence, share)
        done.append(swept.where("NOT gap"))
        new = swept.where("gap").select("size", "sequence_id")
        gaps = new if gaps is None else new.unionByName(gaps.where(F.col("size") <= lo))
    if not done:
        return made.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    placed = reduce(DataFrame.unionByName, done).drop("gap", "size")
    # the last sweep: what emptier sequences hold are its pieces
    emptier = gaps.where(F.col("size") >= int(SPARE * sequence))
    spare = emptier.select(F.col("sequence_id").alias("old"), F.lit(False).alias("gap"), (F.lit(sequence) - F.col("size")).alias("size"), F.lit(None).cast("long").alias("sequence_id"))
    moved = _sweep(spare, emptier.count(), len(bounds), f"{folder}/moved", [StructField("old", LongType())], sequence, share)
    moved = moved.where("NOT gap").select(F.col("old").alias("sequence_id"), F.col("sequence_id").alias("new"), F.col("offset").alias("shift"))
    names = [f.name for f in fields]
    together = placed.join(moved, "sequence_id", "left")
    return together.select(*names, F.coalesce("new", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def best_fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, sequence: int = SEQUENCE, end: int = END, ids: bool = False, share: int = SHARE) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    packed = pack(checkpointed(pieces(docs, doc_id, text, vocabulary, sequence, end, ids)), sequence, share)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids, "sequence_id", "offset")
