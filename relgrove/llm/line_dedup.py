"""Line dedup by content-defined chunks of lines (operator 9, DataFrame functions only).

Each line is hashed, and a hash rolls over the hashes of two neighbouring
lines. Two bits of it decide for one chunking whether a chunk begins between
the two lines (three times in four), the next two bits for another, and so on:
``chunkings`` chunkings of each text. A boundary depends on two lines only, so
lines that come or go elsewhere shift nothing. At the edges of a shared passage
one line is foreign, and each copy has its own; a single chunking would seldom
cut just there in all copies, but one of many does. The boundaries of all
chunkings are the bits of a number, so they are compared at once.

A line of ``LONG_LINE`` blanks or more, so of over 50 words, is a passage by
itself and a chunk of its own, besides.

Chunks of 2 to ``max_lines`` lines, and long lines, that occur again anywhere in
the corpus are removed, all but the first by (doc_id, position). What is cut points to an
earlier copy, so the first copy of each line that repeats stays somewhere. A
line that follows itself is no passage; such runs stay unless they repeat.

Chunks meet by a 128-bit hash of their lines' hashes, sixteen bytes a chunk.
Those that occur again are compared: the lists of their lines' identifiers, and
byte by byte the lines of each identifier (the least with the greatest), so a
line that many chunks share moves once a text. Where anything differs, the
copies of that key, and only they, are grouped again by the chunks' bytes. Texts
are shuffled once, by row number: comparisons and result read the same shuffle.

Defined results: null text counts as empty, which is one empty line. Repeated
rows count as documents of their own. Rows without doc_id come after all
others. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgrove.llm.common import checkpointed, row_number_of_scan, scratch, text_of, written

CHUNKINGS, MAX_LINES, LONG_LINE = 24, 8, 50
#: Bits of a line's hash; 31 times it and another still fit into a long.
_HASH_DIGITS = 14
KEY = ["key", "key_2"]

#: For each line: its number, the boundaries before it and the next ones, the hashes of as many lines from it on, and whether it is long.
_LINES = r"""
transform(array(transform(ls, l -> cast(conv(substring(md5(l), 1, {digits}), 16, 10) as bigint))), hs ->
 transform(array(transform(hs, (h, i) -> if(i = 0, {every}L, (hs[i - 1] * 31 + h | shiftright(hs[i - 1] * 31 + h, 1)) & {every}L))), bs ->
  transform(hs, (h, i) -> named_struct('pos', i, 'b', slice(bs, i + 1, {lines} + 1), 'h', slice(hs, i + 1, {lines}), 'long', length(ls[i]) - length(replace(ls[i], ' ', '')) >= {long}))
 )[0])[0]
"""


def every_chunking(chunkings: int = CHUNKINGS) -> int:
    """A boundary of all chunkings: each even bit."""
    if not 1 <= chunkings <= 28:
        raise ValueError("there must be 1 to 28 chunkings")
    return int("01" * chunkings, 2)


def _lines_of(text: str) -> Column:
    return F.split(text_of(text), "\n")


def _piece(pos: Column, n: Column) -> Column:
    return F.array_join(F.slice("ls", pos + 1, n), "\n")


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunkings: int = CHUNKINGS, max_lines: int = MAX_LINES, hash_bits: int = 128) -> DataFrame:
    """(rid, doc_id, pos, n, key, key_2): the chunks of 2 to ``max_lines`` lines and the long lines; pos is the first line, from 0.

    The keys are a hash of 128 bits, or of ``hash_bits`` bits if that is under 64.
    """
    every = every_chunking(chunkings)
    lines = _LINES.format(digits=_HASH_DIGITS, every=every, lines=int(max_lines), long=LONG_LINE)
    texts = docs.select(row_number_of_scan().alias("rid"), F.col(doc_id).alias("doc_id"), _lines_of(text).alias("ls"))
    rows = texts.select("rid", "doc_id", F.inline(F.expr(lines)))
    after = lambda k: F.coalesce(F.get("b", F.lit(k)), F.lit(every))  # noqa: E731: the end of the text is a boundary of all chunkings
    sizes = [F.when(F.col("long"), F.lit(1))]
    for n in range(2, max_lines + 1):
        through = reduce(lambda m, k: m.bitwiseAND(F.bitwise_not(after(k))), range(1, n), F.get("b", F.lit(0)))
        sizes.append(F.when(through.bitwiseAND(after(n)) != 0, F.lit(n)))
    found = rows.withColumn("n", F.explode(F.array_compact(F.array(*sizes)))).withColumn("h", F.slice("h", F.lit(1), F.col("n")))
    keys = _bits(F.xxhash64("h"), hash_bits), F.xxhash64(F.lit(1), "h") if hash_bits >= 64 else F.lit(0).cast("long")
    return found.select("rid", "doc_id", "pos", "n", *(k.alias(name) for k, name in zip(keys, KEY, strict=True)))


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "pos")


def _gone() -> Column:
    return (F.col("rid") != F.col("keep.rid")) | (F.col("pos") != F.col("keep.pos"))


def repeats(every: DataFrame) -> DataFrame:
    """(rid, cut) for each row with chunks whose key occurs again: those chunks as (pos, n, key, key_2, gone); gone: not the first one."""
    found = checkpointed(every.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min(_first()).alias("keep")).where("copies > 1"))
    return every.join(found.drop("copies"), KEY).groupBy("rid").agg(F.collect_list(F.struct("pos", "n", *KEY, _gone().alias("gone"))).alias("cut"))


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, row): the id as text and the lines of each row, in one array.

    One column, so that all readers of its shuffle need the same columns of it,
    and Spark makes that shuffle once for all of them.
    """
    return docs.select(row_number_of_scan().alias("rid"), F.concat(F.array(F.col(doc_id).cast("string")), _lines_of(text)).alias("row"))


def _opened(texts: DataFrame, *columns: str) -> DataFrame:
    return texts.select("rid", F.get("row", F.lit(0)).alias("id"), F.slice("row", F.lit(2), F.size("row")).alias("ls"), *columns)


def _bits(h: Column, hash_bits: int) -> Column:
    return F.pmod(h, F.lit(1 << hash_bits)) if hash_bits < 64 else h


def _pieces(texts: DataFrame, cuts: DataFrame, doc_id_type: str) -> DataFrame:
    """(rid, doc_id, pos, n, key, key_2, chunk) for the chunks in the cuts."""
    rows = _opened(texts.join(cuts, "rid"), "cut").select("rid", F.col("id").cast(doc_id_type).alias("doc_id"), "ls", F.explode("cut").alias("c"))
    return rows.select("rid", "doc_id", "c.pos", "c.n", *(f"c.{k}" for k in KEY), _piece(F.col("c.pos"), F.col("c.n")).alias("chunk"))


def unverified(texts: DataFrame, cuts: DataFrame, hash_bits: int = 128) -> DataFrame:
    """The keys that may stand for chunks that differ: their lists of line identifiers do, or an identifier stands for lines that do, by comparing bytes."""
    rows = _opened(texts.join(cuts, "rid"), "cut")
    ids = F.transform("ls", lambda line: _bits(F.xxhash64(line), hash_bits))
    entries = rows.select(ids.alias("ids"), F.explode("cut").alias("c")).select(*(f"c.{k}" for k in KEY), F.slice("ids", F.col("c.pos") + 1, F.col("c.n")).alias("ids"))
    mixed = entries.groupBy(*KEY).agg(F.min("ids").alias("least"), F.max("ids").alias("greatest")).where("least != greatest").select(*KEY)
    lines = rows.select(F.explode(F.expr("array_distinct(flatten(transform(cut, c -> slice(ls, c.pos + 1, c.n))))")).alias("line"))
    several = lines.groupBy(_bits(F.xxhash64("line"), hash_bits).alias("id")).agg(F.min("line").alias("least"), F.max("line").alias("greatest")).where("least != greatest").select("id")
    holders = entries.select(*KEY, F.explode("ids").alias("id")).join(several, "id", "left_semi").select(*KEY)
    return mixed.unionByName(holders).distinct()


def regrouped(texts: DataFrame, cuts: DataFrame, bad: DataFrame, doc_id_type: str) -> DataFrame:
    """(rid, again): the chunks of keys in ``bad`` as (pos, n, gone), grouped by their bytes."""
    suspects = cuts.select("rid", F.inline("cut")).join(bad, KEY, "left_semi")
    pieces = _pieces(texts, suspects.groupBy("rid").agg(F.collect_list(F.struct("pos", "n", *KEY)).alias("cut")), doc_id_type)
    same = [*KEY, "chunk"]
    keep = pieces.groupBy(*same).agg(F.min(_first()).alias("keep"))
    return pieces.join(keep, same).groupBy("rid").agg(F.collect_list(F.struct("pos", "n", _gone().alias("gone"))).alias("again"))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunkings: int = CHUNKINGS, max_lines: int = MAX_LINES, hash_bits: int = 128) -> DataFrame:
    """(rid, cut): for each row that has chunks whose key occurs again, those chunks as (pos, n, key, key_2, gone)."""
    with scratch(docs.sparkSession) as folder:
        return checkpointed(repeats(written(chunks(docs, doc_id, text, chunkings, max_lines, hash_bits), folder)))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunkings: int = CHUNKINGS, max_lines: int = MAX_LINES, hash_bits: int = 128) -> DataFrame:
    """(doc_id, n_lines, removed_lines, text): each row's text without the lines of chunks that stand elsewhere already."""
    cuts = removals(docs, doc_id, text, chunkings, max_lines, hash_bits)
    texts, id_type = texts_of(docs, doc_id, text), docs.schema[doc_id].dataType.simpleString()
    again = regrouped(texts, cuts, unverified(texts, cuts, hash_bits), id_type)
    valid = F.expr(
        """array_distinct(flatten(concat(
            transform(filter(cut, c -> c.gone AND NOT exists(again, a -> a.pos = c.pos AND a.n = c.n)), c -> sequence(c.pos, c.pos + c.n - 1)),
            transform(filter(again, a -> a.gone), a -> sequence(a.pos, a.pos + a.n - 1)))))"""
    )
    none = F.expr("cast(array() as array<struct<pos:int,n:int,gone:boolean>>)")
    rows = _opened(texts.join(cuts, "rid", "left").join(again, "rid", "left").withColumn("again", F.coalesce("again", none)), "cut", "again")
    rows = rows.select(F.col("id").cast(id_type).alias("doc_id"), "ls", F.when(F.col("cut").isNotNull(), valid).alias("gone"))
    left = F.expr(r"array_join(transform(array_except(sequence(0, size(ls) - 1), gone), i -> ls[i]), '\n')")
    return rows.select(
        "doc_id",
        F.size("ls").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"),
        F.when(F.col("gone").isNull(), F.array_join("ls", "\n")).otherwise(left).alias("text"),
    )
