"""Relationship tuples, derived from ordinary tables.

A tuple is (subject_type, subject_id, relation, object_type, object_id), five
strings. ``Mapping`` says how a table's rows become tuples, ``tuples_of`` makes
their union. ``layouts`` writes the two sort orders that large stores want:
lookups by object and lookups by subject each read few row groups.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

COLUMNS = ("subject_type", "subject_id", "relation", "object_type", "object_id")
STORE_KEYS = ("object_type", "relation")
SCHEMA = StructType([StructField(c, StringType(), False) for c in COLUMNS])


@dataclass(frozen=True)
class Mapping:
    """Tuples from a table: ids (and, where given as columns, relations) per row, for rows that ``where`` keeps."""

    source: DataFrame
    subject_type: str | Column
    subject_id: str | Column
    relation: str | Column
    object_type: str | Column
    object_id: str | Column
    where: Column | None = None

    def tuples(self) -> DataFrame:
        """The ids may be column names; types and relations given as strings are literals."""
        rows = self.source if self.where is None else self.source.where(self.where)
        name = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
        ids = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
        return rows.select(name(self.subject_type).alias(COLUMNS[0]), ids(self.subject_id).alias(COLUMNS[1]), name(self.relation).alias(COLUMNS[2]), name(self.object_type).alias(COLUMNS[3]), ids(self.object_id).alias(COLUMNS[4])).dropna()


def tuples_of(mappings: Iterable[Mapping]) -> DataFrame:
    """The union of the mappings' tuples. Duplicates stay; all queries are set-valued."""
    frames = [m.tuples() for m in mappings]
    if not frames:
        raise ValueError("at least one mapping is needed")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tuples_from_rows(spark: SparkSession, rows: Iterable[tuple[str, str, str, str, str]]) -> DataFrame:
    """Tuples from literal rows, none at all included."""
    return spark.createDataFrame([tuple(map(str, r)) for r in rows], SCHEMA)


def parse_tuple(user: str, relation: str, obj: str) -> tuple[str, str, str, str, str]:
    """A tuple from ``type:id``, ``type:id#relation`` or ``type:*``, a relation and ``type:id``."""
    st, colon, sid = user.partition(":")
    ot, colon2, oid = obj.partition(":")
    if not (colon and colon2 and st and sid and ot and oid and relation):
        raise ValueError(f"not a tuple: {user!r} {relation!r} {obj!r}")
    return st, sid, relation, ot, oid


def with_contextual(tuples: DataFrame, extra: DataFrame | Iterable[tuple[str, str, str, str, str]] | None) -> DataFrame:
    """``tuples`` and the request's own tuples, which are never stored."""
    if extra is None:
        return tuples
    more = extra if isinstance(extra, DataFrame) else tuples_from_rows(tuples.sparkSession, extra)
    return tuples.select(*COLUMNS).unionByName(more.select(*COLUMNS))


def read(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Stored tuples of any format that Spark reads; rows with a null are no tuples."""
    return spark.read.format(format).load(path).select(*(F.col(c).cast("string").alias(c) for c in COLUMNS)).dropna()


#: A task that writes a store has as many files open at once; rows of further relations are sorted first.
_OPEN = 100
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_store(tuples: DataFrame, path: str) -> None:
    """Writes the tuples in folders by object type and relation, so that readers skip what they don't ask for.

    Rows stay in the tasks and in the order that they come in: tables of any
    size are written in one pass, without a shuffle or a sort.
    """
    conf = tuples.sparkSession.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, str(_OPEN))
    try:
        tuples.select(*COLUMNS).write.partitionBy(*STORE_KEYS).parquet(path)
    finally:
        conf.set(_WRITERS, before)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The tuples of a store that ``write_store`` wrote."""
    return spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS)


@dataclass(frozen=True)
class Layout:
    """A copy of the tuples that some questions want: partitioned by a column, sorted by others; only the wildcards, if so."""

    name: str
    partition_by: str
    sort_by: tuple[str, ...]
    wildcards_only: bool
    serves: tuple[str, ...]  # the verbs and relations that read it


def recommend(analysis) -> list[Layout]:
    """The fewest layouts that a model's relations want: by object for checks and lists of subjects, by subject for lists of objects, the wildcards apart."""
    model = analysis.model
    nodes = sorted(model.nodes())
    if not nodes:
        return []
    each = lambda verbs, of: tuple(f"{v} {t}#{r}" for t, r in of for v in verbs)
    out = [
        Layout("by_object", "object_type", ("relation", "object_id"), False, each(("check", "list subjects"), nodes)),
        Layout("by_subject", "subject_type", ("relation", "subject_id"), False, each(("list objects",), nodes)),
    ]
    starred = [n for n in nodes if any(x.wildcard for x in model.refs(*n))]
    if starred:
        out.append(Layout("wildcards", "object_type", ("relation", "object_id"), True, each(("check", "list subjects"), starred)))
    return out


def write_layout(tuples: DataFrame, layout: Layout, path: str) -> None:
    """Writes a layout below ``path``, by range with the id as a key, so that a type with most tuples spreads over many partitions."""
    rows = tuples.where(F.col("subject_id") == "*") if layout.wildcards_only else tuples
    keys = (layout.partition_by, *layout.sort_by)
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy(layout.partition_by).parquet(f"{path}/{layout.name}")


def layouts(tuples: DataFrame, path: str, analysis=None) -> list[Layout]:
    """Writes the layouts that the model wants; without a model ``by_object`` and ``by_subject``."""
    wanted = recommend(analysis) if analysis is not None else [Layout("by_object", "object_type", ("relation", "object_id"), False, ()), Layout("by_subject", "subject_type", ("relation", "subject_id"), False, ())]
    for layout in wanted:
        write_layout(tuples, layout, path)
    return wanted


def advise(tuples: DataFrame, rows: int | None = None, analysis=None) -> list[str]:
    """Advice on the layout of a store of tuples, by its size and by what the model's relations read."""
    rows = tuples.count() if rows is None else rows
    if rows < 1_000_000:
        return [f"{rows} tuples: one sorted table is enough"]
    if analysis is None:
        return [f"{rows} tuples: keep two copies, sorted by (object_type, relation, object_id) and by (subject_type, relation, subject_id)"]
    return [f"{rows} tuples: keep {x.name}{' (subject_id is * only)' * x.wildcards_only}, partitioned by {x.partition_by} and sorted by {', '.join(x.sort_by)}, for {len(x.serves)} verbs" for x in recommend(analysis)]
