"""SQL table functions for the verbs, a set for each relation.

``register`` defines views over a relation's value for the given subjects, and
over these the functions

    check_T_R(st, sid, oid)       allowed: 1 or 0
    list_T_R_obj(st, sid)         object_id
    list_T_R_sub(oid, st)         subject_id
    expand_T_R(oid)               leaf, kind, value: the entries of its tree
    explain_T_R(st, sid, oid)     the same entries, and whether each holds for the subject

The views are plans over the engine's tuples, so functions see what these hold
when they are called; only recursive relations are evaluated once, by ``register``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrove.operators.common import union_of
from relgrove.operators.trees import expand_rows, leaves
from relgrove.operators.verbs import Engine
from relgrove.plans.analysis import Analysis, Node
from relgrove.plans.model import Computed, FromLink, This


def function_name(verb: str, type_name: str, relation: str, suffix: str = "") -> str:
    return "_".join(x for x in (verb, re.sub(r"\W", "_", type_name), re.sub(r"\W", "_", relation), suffix) if x)


def statements(type_name: str, relation: str) -> dict[str, str]:
    """The SQL that defines a relation's functions, by name."""
    name = lambda verb, suffix="": function_name(verb, type_name, relation, suffix)
    held, entries, refs = name("held"), name("entries"), name("refs")
    own = f"{held}.subject_type = st AND {held}.subject_id = sid"
    holds = "x.value = concat(st, ':', sid) OR x.value = concat(st, ':*') AND sid NOT LIKE '%#%' AND sid <> '*' OR r.userset IS NOT NULL"
    joined = f"{entries} x LEFT JOIN {refs} r ON r.userset = x.value AND r.subject_type = st AND r.subject_id = sid"
    body = {
        name("check"): ("st STRING, sid STRING, oid STRING", "allowed INT", f"SELECT cast(count(*) > 0 AS INT) AS allowed FROM {held} WHERE {own} AND {held}.object_id = oid"),
        name("list", "obj"): ("st STRING, sid STRING", "object_id STRING", f"SELECT object_id FROM {held} WHERE {own}"),
        name("list", "sub"): ("oid STRING, st STRING", "subject_id STRING", f"SELECT subject_id FROM {held} WHERE {held}.object_id = oid AND subject_type = st"),
        name("expand"): ("oid STRING", "leaf INT, kind STRING, value STRING", f"SELECT leaf, kind, value FROM {entries} WHERE {entries}.object_id = oid"),
        name("explain"): ("st STRING, sid STRING, oid STRING", "leaf INT, kind STRING, value STRING, holds BOOLEAN", f"SELECT x.leaf, x.kind, x.value, {holds} AS holds FROM {joined} WHERE x.object_id = oid"),
    }
    return {n: f"CREATE OR REPLACE TEMPORARY FUNCTION {n}({given}) RETURNS TABLE({out}) RETURN {sql}" for n, (given, out, sql) in body.items()}


def pointed(analysis: Analysis, type_name: str, relation: str) -> list[Node]:
    """The relations that the entries of a relation's tree point to."""
    model, out = analysis.model, []
    for x in leaves(model.expr(type_name, relation)):
        if isinstance(x, This):
            out += [(r.type, r.relation) for r in x.refs if r.relation]
        elif isinstance(x, Computed):
            out.append((type_name, x.relation))
        elif isinstance(x, FromLink):
            out += [(p, x.relation) for p in model.link_types(type_name, x.link) if model.expr(p, x.relation) is not None]
    return list(dict.fromkeys(out))


def register(engine: Engine, type_name: str, relation: str, subjects: DataFrame) -> None:
    """Defines the functions of one relation for the given subjects (subject_type, subject_id)."""
    spark = engine.tuples.sparkSession
    view = lambda df, kind: df.createOrReplaceTempView(function_name(kind, type_name, relation))
    view(engine.objects_of(subjects, relation, type_name), "held")
    view(expand_rows(engine.tuples, engine.analysis, type_name, relation), "entries")
    below = [engine.objects_of(subjects, r, t).select("subject_type", "subject_id", F.concat(F.lit(f"{t}:"), "object_id", F.lit(f"#{r}")).alias("userset")) for t, r in pointed(engine.analysis, type_name, relation)]
    view(union_of(below).distinct() if below else subjects.select("subject_type", "subject_id", F.lit("").alias("userset")).where("false"), "refs")
    for sql in statements(type_name, relation).values():
        spark.sql(sql)


def bulk_from_arrays(engine: Engine, df: DataFrame, columns: list[str]) -> DataFrame:
    """(idx, allowed) for requests given as five parallel arrays in one row; idx counts from 1."""
    names = ["subject_type", "subject_id", "relation", "object_type", "object_id"]
    rows = df.selectExpr(f"posexplode(arrays_zip({', '.join(columns)})) AS (pos, x)")
    picked = [f"x.{c} AS {n}" for c, n in zip(columns, names, strict=True)]
    return engine.check_bulk(rows.selectExpr("cast(pos + 1 AS INT) AS idx", *picked))
