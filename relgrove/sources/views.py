"""What the SQL of a view over tuples says: its branches, their tables, columns and casts. Spark's own parser reads it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from relgrove.sources.tuples import COLUMNS


@dataclass(frozen=True)
class Cast:
    """A column of the view that converts a source column, so that a filter on it is no filter on the source."""

    column: str
    source: str
    type: str


@dataclass(frozen=True)
class Branch:
    tables: tuple[str, ...]
    columns: dict[str, str] = field(default_factory=dict)  # view column -> source expression
    casts: tuple[Cast, ...] = ()


@dataclass(frozen=True)
class View:
    branches: tuple[Branch, ...]
    distinct: bool  # a UNION without ALL somewhere

    def missing(self) -> list[str]:
        """The columns of a tuple that some branch does not name; later branches go by the first one's names."""
        return [c for c in COLUMNS if c not in self.branches[0].columns]

    def tables(self) -> list[str]:
        return sorted({t for b in self.branches for t in b.tables})


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _children(node) -> list:
    seq = node.children()
    return [seq.apply(k) for k in range(seq.size())]


def _walk(node) -> Iterator:
    yield node
    for c in _children(node):
        yield from _walk(c)


def _branches(node) -> Iterator:
    if _kind(node) == "Union":
        for c in _children(node):
            yield from _branches(c)
    elif _kind(node) in ("Distinct", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "View") and _kind(_children(node)[0]) in ("Union", "Distinct", "SubqueryAlias"):
        yield from _branches(_children(node)[0])
    else:
        yield node


def _branch(node, names: list[str] | None) -> Branch:
    plan = node
    while _kind(plan) not in ("Project", "Aggregate") and len(_children(plan)) == 1:
        plan = _children(plan)[0]
    tables = tuple(dict.fromkeys(x.multipartIdentifier().mkString(".") for x in _walk(node) if _kind(x) == "UnresolvedRelation"))
    columns, casts = {}, []
    exprs = plan.projectList() if _kind(plan) == "Project" else plan.aggregateExpressions() if _kind(plan) == "Aggregate" else None
    for k in range(exprs.size() if exprs is not None else 0):
        e = exprs.apply(k)
        named = _kind(e) == "Alias"
        source = _children(e)[0] if named or _kind(e) == "UnresolvedAlias" else e
        name = names[k] if names and k < len(names) else e.name() if named or _kind(e) == "UnresolvedAttribute" else f"column {k + 1}"
        columns[name] = source.sql() if _kind(source) != "UnresolvedFunction" else source.toString()
        for x in _walk(source):
            if _kind(x) == "Cast":
                casts.append(Cast(name, _children(x)[0].sql(), x.dataType().simpleString()))
    return Branch(tables, columns, tuple(casts))


def parse_view(spark: SparkSession, sql: str) -> View:
    """The view that a SELECT (or unions of them, or a CREATE VIEW over them) defines; a text that is no SQL raises ValueError."""
    body = sql
    if sql.lstrip()[:6].lower() == "create":
        lowered = sql.lower()
        at = next((k for k in (lowered.find(w) for w in (" as select", "\nas select", " as\n", " as (", "\nas\n")) if k >= 0), -1)
        if at < 0:
            raise ValueError("a CREATE VIEW without AS SELECT")
        body = sql[at + 3 :].lstrip()
    if not body.strip():
        raise ValueError("an empty view")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body.strip().rstrip(";"))
    except Exception as e:  # the parser's own exception comes through the gateway
        raise ValueError("not the SQL of a view: " + next((x.strip() for x in str(e).splitlines() if x.strip()), "")) from None
    found: list[Branch] = []
    for node in _branches(plan):
        found.append(_branch(node, list(found[0].columns) if found else None))
    return View(tuple(found), any(_kind(x) == "Distinct" for x in _walk(plan)))


def advise_view(view: View) -> list[str]:
    """Where the view keeps filters from its tables, and what to do."""
    out = []
    if view.distinct:
        out.append("UNION sorts all tuples to drop repeats, which no query needs: use UNION ALL")
    for b in view.branches:
        for c in b.casts:
            if c.column in ("object_id", "subject_id"):
                out.append(f"{', '.join(b.tables)}: {c.column} converts {c.source} to {c.type}, so a filter on it reads the whole table: store tuples with write_store, or keep the id as {c.type}")
    return list(dict.fromkeys(out))
