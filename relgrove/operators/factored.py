"""Lists of all pairs of subjects and objects, without a shuffle of the pairs.

What subjects hold on the ``via`` of edges (via, object_id) has a row for each
subject and object that it reaches: their product, if all reach all. Subjects
that hold the same vias are one class, so that distinct (class, object) rows and
the classes' members say the same in far fewer rows; the pairs are made from
these last, each of them once. Large classes are dealt in chunks on both sides,
so no task gets all pairs of a class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrove.operators.common import checkpointed, union_of

O = "object_id"
#: Subjects or objects of a class in one chunk, about; pairs that a task makes, about.
CHUNK, PAIRS = 1_000, 8_000_000


@dataclass(frozen=True)
class Over:
    """Edges (via, object_id), and what subjects hold on the vias: (via, and the columns of a subject). Both are distinct."""

    edges: DataFrame
    held: DataFrame


def joined(parts: list[Over]) -> Over:
    """One of several, whose vias are told apart by their place."""
    tag = lambda f, k: f.withColumn("via", F.concat(F.lit(f"{k}:"), "via"))
    return Over(union_of([tag(p.edges, k) for k, p in enumerate(parts)]), union_of([tag(p.held, k) for k, p in enumerate(parts)]))


class Classes:
    """Subjects by the set of vias that they hold, as far as edges have them: members (cls, subject) and vias (cls, via)."""

    def __init__(self, over: Over, subject: list[str]):
        self.subject = subject
        held = checkpointed(over.held.join(over.edges.select("via").distinct(), "via", "left_semi"))
        # equal sets have the same count and the same two sums by xor of 64-bit hashes; other sets that do have a chance of 2 ** -128
        of = ["n", "a", "b"]
        prints = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.lit(1), "via")).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), "via")).alias("b")]
        sets = checkpointed(held.groupBy(*subject).agg(*prints))
        first = checkpointed(sets.groupBy(*of).agg(F.min(F.struct(*subject)).alias("first")).withColumn("cls", F.monotonically_increasing_id().cast("string")))
        self.members = checkpointed(sets.join(first, of).select("cls", *subject))
        self.vias = checkpointed(held.join(first.select("cls", "first.*"), subject).select("cls", "via"))
        self.fewer_vias = self.vias.select("via").distinct().count() <= first.count()

    def reached(self, edges: DataFrame) -> DataFrame:
        """Distinct (cls, object_id) over edges (via, object_id)."""
        return edges.join(self.vias, "via").select("cls", O).distinct()

    def carried(self, edges: DataFrame) -> DataFrame:
        """(carrier, object_id): what rounds carry over further edges, the vias or the classes, whichever are fewer."""
        if self.fewer_vias:
            return edges.join(self.vias.select("via").distinct(), "via", "left_semi").select(F.col("via").alias("carrier"), O)
        return self.reached(edges).withColumnRenamed("cls", "carrier")

    def arrived(self, carried: DataFrame) -> DataFrame:
        """Distinct (cls, object_id) of what the rounds carried."""
        if self.fewer_vias:
            return self.reached(carried.withColumnRenamed("carrier", "via"))
        return carried.withColumnRenamed("carrier", "cls").select("cls", O)

    def uncovered(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """Of rows (subject, object_id), those that the pairs (cls, object_id) don't give."""
        return rows.join(self.members, self.subject, "left").join(pairs, ["cls", O], "left_anti").select(*rows.columns)

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """All (subject, object_id) of stored and distinct (cls, object_id)."""
        p, m = (f.groupBy("cls").agg(F.count(F.lit(1)).alias(n)) for f, n in ((pairs, "p"), (self.members, "m")))
        chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
        sizes = checkpointed(p.join(m, "cls").select("cls", (F.col("p").cast("double") * F.col("m")).alias("out"), chunks("p").alias("i"), chunks("m").alias("j"), (F.col("p") * chunks("m") + F.col("m") * chunks("p")).alias("dealt")))
        out, dealt = sizes.agg(F.sum("out"), F.sum("dealt")).first()
        if out is None or out <= PAIRS or dealt * 10 > out:
            return pairs.join(self.members, "cls").select(*self.subject, O)
        tasks = max(int(out // PAIRS), min(int(out // 1_000_000), self.members.sparkSession.sparkContext.defaultParallelism))

        def deal(rows: DataFrame, own: str, other: str, key: str) -> DataFrame:
            rows = rows.join(sizes.select("cls", F.col(own).alias("n"), F.col(other).alias("copies")), "cls")
            rows = rows.withColumn(own, F.pmod(F.xxhash64(key), F.col("n")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            return rows.drop("n", "copies").repartition(tasks, "cls", "i", "j")

        objects, subjects = deal(pairs, "i", "j", O), deal(self.members, "j", "i", self.subject[-1])
        return objects.join(subjects, ["cls", "i", "j"]).select(*self.subject, O)
