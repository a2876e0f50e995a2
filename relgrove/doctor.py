"""Health report: does the schema hold, do the tuples fit it, is the install current?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrove.functions.userset import is_wildcard, subject_relation
from relgrove.plans.analysis import MAX_DEPTH, Analysis, CyclicSchema, UnstratifiedSchema
from relgrove.sources.tuples import COLUMNS, advise
from relgrove.sources.views import parse_view

OK, WARN, FAIL = "ok", "warn", "fail"


@dataclass(frozen=True)
class Finding:
    category: str
    name: str
    status: str
    message: str = ""
    hint: str = ""


def signatures(tuples: DataFrame) -> DataFrame:
    """How many tuples there are of each kind: the one aggregation that finds all misfits."""
    keys = [F.col("object_type"), F.col("relation"), F.col("subject_type"), subject_relation("subject_id").alias("subject_relation"), is_wildcard("subject_id").alias("wildcard")]
    return tuples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def misfits(analysis: Analysis, found: list) -> list[tuple[str, str, int]]:
    """(what is wrong, the signature, rows) for signatures that the schema doesn't know."""
    model, out = analysis.model, []
    for row in found:
        t, r, s, rel, star, n = (row[c] for c in ("object_type", "relation", "subject_type", "subject_relation", "wildcard", "n"))
        shown = f"{s}{'#' + rel if rel else ':*' if star else ''} {r} {t}"
        if t not in model.types:
            out.append(("unknown object type", shown, n))
        elif model.expr(t, r) is None:
            out.append(("unknown relation", shown, n))
        elif s not in model.types:
            out.append(("unknown subject type", shown, n))
        elif not any(x.type == s and x.relation == rel and x.wildcard == star for x in model.refs(t, r)):
            out.append(("invalid subject", shown, n))
    return out


def examine(analysis: Analysis | None, tuples: DataFrame | None = None, registry=None, schema_text: str | None = None, schema_error: str | None = None, view_sql: str | None = None) -> list[Finding]:
    """All checks that the given parts allow. view_sql: the SQL that defines the tuples, if they are a view."""
    out: list[Finding] = []
    add = lambda *x: out.append(Finding(*x))
    if analysis is None:
        add("Schema File", "parses", FAIL, schema_error or "no schema", "run the validate command")
        return out
    add("Schema File", "parses", OK, f"{len(analysis.model.types)} types, {len(analysis.model.nodes())} relations")
    try:
        analysis.check_cycles()
        add("Schema File", "cycles", OK)
    except CyclicSchema as e:
        add("Schema File", "cycles", FAIL, str(e))
    try:
        analysis.check_stratified(analysis.order)
        add("Schema File", "stratified", OK)
    except UnstratifiedSchema as e:
        add("Schema File", "stratified", WARN, str(e))
    deep = [f"{t}.{r}" for (t, r), d in analysis.userset_depth.items() if d >= MAX_DEPTH]
    add("Schema File", "depth", FAIL if deep else OK, ", ".join(deep))
    if registry is not None:
        last = registry.last()
        if last is None:
            add("Migration State", "installed", FAIL, "no model is installed", "run the migrate command")
        else:
            add("Migration State", "installed", OK, f"version {last['version']}")
            same = schema_text is not None and registry.checksum(schema_text) == last["schema_checksum"]
            add("Migration State", "current", OK if same else WARN, "" if same else "the schema has changed since", "" if same else "run the migrate command")
            names = {f"{t}.{r}" for t, r in analysis.model.nodes()}
            add("Generated Functions", "complete", OK if names <= set(last["relations"]) else FAIL, ", ".join(sorted(names - set(last["relations"]))))
            orphans = sorted(set(last["relations"]) - names)
            add("Generated Functions", "orphans", WARN if orphans else OK, ", ".join(orphans))
    if tuples is None:
        add("Tuples Source", "present", FAIL, "no tuples", "name a table of tuples")
        return out
    missing = [c for c in COLUMNS if c not in tuples.columns]
    add("Tuples Source", "columns", FAIL if missing else OK, ", ".join(missing))
    if missing:
        return out
    wrong = [f"{f.name}: {f.dataType.simpleString()}" for f in tuples.schema if f.name in COLUMNS and f.dataType.simpleString() != "string"]
    add("Tuples Source", "types", FAIL if wrong else OK, ", ".join(wrong))
    found = signatures(tuples).collect()  # a row for each kind of tuple
    rows = sum(x["n"] for x in found)
    add("Tuples Source", "rows", OK if rows else WARN, str(rows))
    bad = misfits(analysis, found)
    for kind in ("unknown object type", "unknown relation", "unknown subject type", "invalid subject"):
        own = [(s, n) for k, s, n in bad if k == kind]
        add("Data Health", kind, WARN if own else OK, ", ".join(f"{s} ({n} rows)" for s, n in sorted(own)))
    nulls = tuples.where(F.greatest(*(F.col(c).isNull() for c in COLUMNS))).count()
    add("Data Health", "nulls", WARN if nulls else OK, f"{nulls} rows" if nulls else "")
    blank = tuples.where(F.greatest(*(F.trim(c) == "" for c in COLUMNS))).count()
    add("Data Health", "blanks", WARN if blank else OK, f"{blank} rows with an empty field" if blank else "")
    shape = F.col("subject_id").rlike("#.*#|^#|#$|^[*]#")
    odd = tuples.where(shape).count()
    add("Data Health", "usersets", WARN if odd else OK, f"{odd} subjects that are no id, * or id#relation" if odd else "")
    distinct = tuples.select(*COLUMNS).distinct().count()
    add("Data Health", "duplicates", WARN if distinct < rows * 0.9 else OK, f"{rows - distinct} of {rows} rows repeat another")
    unused = sorted(f"{t}.{r}" for t, r in analysis.model.nodes() if analysis.model.refs(t, r) and not any((x["object_type"], x["relation"]) == (t, r) for x in found))
    add("Data Health", "unused relations", OK, ", ".join(unused))
    top = tuples.groupBy("object_type", "object_id", "relation").count().agg(F.max("count")).first()[0] or 0
    add("Performance", "hot objects", WARN if rows > 10_000 and top > rows // 3 else OK, f"{top} tuples of one object and relation")
    add("Performance", "recursion", OK, ", ".join(sorted(f"{t}.{r}" for g in analysis.order if analysis.recursive(g) for t, r in g)))
    for line in advise(tuples, rows, analysis):
        add("Performance", "layout", OK, line)
    if view_sql is not None:
        out += examine_view(tuples.sparkSession, view_sql)
    stars = sum(x["n"] for x in found if x["wildcard"])
    add("Performance", "wildcards", WARN if rows and stars > rows // 2 else OK, f"{stars} of {rows} rows")
    return out


def examine_view(spark, sql: str) -> list[Finding]:
    """The checks of a view over tuples: does it parse, does it sort for nothing, which tables does it read, do filters reach them?"""
    try:
        view = parse_view(spark, sql)
    except ValueError as e:
        return [Finding("Performance", "view parsed", FAIL, str(e))]
    out = [Finding("Performance", "view parsed", OK, f"{len(view.branches)} branches")]
    missing = view.missing()
    out.append(Finding("Tuples Source", "view columns", FAIL if missing else OK, ", ".join(missing)))
    out.append(Finding("Performance", "union all", WARN if view.distinct else OK, "UNION drops repeats by a shuffle of all tuples" if view.distinct else "", "use UNION ALL" if view.distinct else ""))
    out.append(Finding("Performance", "source tables", OK, ", ".join(view.tables())))
    casts = [f"{', '.join(b.tables)}.{c.source} as {c.column}" for b in view.branches for c in b.casts if c.column in ("object_id", "subject_id")]
    out.append(Finding("Performance", "converted ids", WARN if casts else OK, ", ".join(casts), "filters on these don't reach the tables: store the tuples" if casts else ""))
    return out


def render(findings: list[Finding]) -> str:
    lines, last = [], None
    for f in findings:
        if f.category != last:
            lines.append(f.category)
            last = f.category
        lines.append(f"  [{f.status}] {f.name}" + f": {f.message}" * bool(f.message) + f" ({f.hint})" * bool(f.hint))
    return "\n".join(lines)
