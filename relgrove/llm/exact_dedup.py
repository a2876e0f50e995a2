"""Exact dedup by content-defined chunk recipes (operator 7, DataFrame functions only).

A text is cut where its own characters say so, which gives equal texts equal
chunks. Each distinct chunk gets an identifier, its hash, and one pass
over the chunks verifies the identifiers: per hash, the least and the greatest
chunk are compared byte by byte. A document is then its ordered list of
identifiers (the recipe), and equal lists are equal texts. A text crosses the
network once, as chunks that are already deduplicated on the map side; the
grouping moves recipes only, some sixteen bytes for 700 characters.

Identifiers are 128-bit hashes. Should one stand for two chunks all the same,
texts that hold such a chunk also carry those chunks themselves in their
recipe, and all other texts keep their hashes; results are exact either way.

Defined results: null text counts as empty; all empty texts are equal. Of
repeated rows (same id, same text) exactly one is kept. A null doc_id ranks
below every other id. An empty table gives an empty result. Extra columns of
the input are ignored by ``decisions`` and passed through by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgrove.llm.common import checkpointed, free_name, numbered, row_number_of_scan, text_of

#: A chunk has 512 characters at least and ends before a blank or a punctuation
#: mark that two letters of certain classes follow; 4096 characters end it anyway.
CHUNK = r"(?s).{512,4095}?(?:(?=[\s\p{P}][a-eA-EÀ-ß一-忿][m-sM-Sà-ï怀-翿])|\z)|.{1,4096}"  # "[\s\S]" for the dot would take ten times as long

#: So many colliding identifiers are brought to the driver at most; of 10^11 chunks none is to be expected.
MAX_BAD = 4096


def chunks_of(text: Column) -> Column:
    """The chunks of a text; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _hash(chunk: Column, hash_bits: int) -> Column:
    """The identifier of a chunk: two longs, or one of ``hash_bits`` bits and zero if that is under 64."""
    if hash_bits < 64:
        return F.struct(F.pmod(F.xxhash64(chunk), F.lit(1 << hash_bits)).alias("a"), F.lit(0).cast("long").alias("b"))
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


def unverified_hashes(docs: DataFrame, text: str = "text", hash_bits: int = 128) -> DataFrame:
    """(a, b): the identifiers that stand for more than one chunk, by comparing bytes."""
    chunks = docs.select(F.explode(chunks_of(text_of(text))).alias("chunk")).select("chunk", _hash(F.col("chunk"), hash_bits).alias("h"))
    return (
        chunks.groupBy("h.a", "h.b")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
        .where(F.col("least") != F.col("greatest"))
        .select("a", "b")
    )


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_bits: int = 128) -> DataFrame:
    """(rid, doc_id, text_sha256, recipe, chunks) of each row; rid is the row's number in the scan.

    chunks: those of the text's chunks whose identifier is not theirs alone, in
    order. Over ``MAX_BAD`` such identifiers it is all chunks of each text.
    """
    bad = [(r["a"], r["b"]) for r in unverified_hashes(docs, text, hash_bits).limit(MAX_BAD + 1).collect()]
    parts = chunks_of(text_of(text))
    ids = F.transform(parts, lambda c: _hash(c, hash_bits))
    if not bad:
        own = F.array().cast("array<string>")
    elif len(bad) > MAX_BAD:
        own = parts
    else:
        firsts = F.array(*(F.lit(a) for a, _ in bad))  # one half of an identifier is enough to choose what is compared
        own = F.filter(parts, lambda c: F.array_contains(firsts, _hash(c, hash_bits)["a"]))
    return docs.select(
        row_number_of_scan().alias("rid"),
        F.col(doc_id).alias("doc_id"),
        F.sha2(text_of(text), 256).alias("text_sha256"),
        F.flatten(F.transform(ids, lambda h: F.array(h["a"], h["b"]))).alias("recipe"),
        own.alias("chunks"),
    )


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_bits: int = 128) -> DataFrame:
    """A row for each input row: rid, doc_id, keep_id, group_size, kept, text_sha256."""
    thin = checkpointed(recipes(docs, doc_id, text, hash_bits))
    groups = thin.groupBy("recipe", "chunks").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    groups = checkpointed(groups)  # so that both sides of the join are shuffled for it, and it may split the rows of a hot recipe
    return thin.join(groups, ["recipe", "chunks"], "left").select(
        "rid",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, with all its columns, without the rows that another equal row replaces."""
    rid = free_name(docs, "rid")
    dropped = decisions(docs, doc_id, text).where(~F.col("kept")).select("rid")
    return numbered(docs.withColumn(rid, row_number_of_scan()), rid, dropped, keep=False).drop(rid)
