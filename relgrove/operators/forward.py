"""Subject-first evaluation: which objects can each of a set of subjects reach?

A relation's value is a DataFrame (subject_type, subject_id, object_id) of
distinct rows, for all subjects asked about at once. Expressions become joins:

- direct grants: an equi-join of tuples and subjects by id, and, apart from it,
  one of wildcard tuples and subjects by type (a single join on ``id = or *``
  would become a nested loop);
- usersets and links: an equi-join of tuples and the value of the relation that
  they refer to;
- or, and, but not: union, semi-join, anti-join. What ``and`` and ``but not``
  test against usersets and links is tested row by row: the candidates' edges
  are joined with what their subjects hold, never all that the edges reach.

Mutually dependent relations are evaluated by rounds that join only what the
last round added. A subject that is a userset, ``x#s``, holds a relation on
``x`` itself if ``s`` implies the relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrove.functions.userset import is_userset, is_wildcard, subject_object, subject_relation
from relgrove.operators.common import checkpointed, union_of
from relgrove.operators.factored import Classes, Over, joined
from relgrove.plans.analysis import MAX_DEPTH, Analysis, Node
from relgrove.plans.model import Computed, Difference, Expr, FromLink, Intersection, This, Union, walk

KEY = ["subject_type", "subject_id", "object_id"]
#: A type that no subject has, of rows that carry vias or classes.
_CARRIER = "#"
#: Subjects that are multiplied by wildcard grants in one task, about.
_DEAL = 10_000


class ResolutionTooDeep(RuntimeError):
    """Resolution didn't end within the greatest depth (code 2002)."""

    code = 2002


class Forward:
    """Values of relations for the given subjects (subject_type, subject_id)."""

    def __init__(self, analysis: Analysis, tuples: DataFrame, subjects: DataFrame, wildcards: bool = True, max_depth: int = MAX_DEPTH, demand: dict[Node, DataFrame | None] | None = None, few: list[str] | None = None, ids: dict[Node, list[str]] | None = None):
        self.analysis, self.model, self.tuples = analysis, analysis.model, tuples
        #: Relations whose value is wanted for some objects (object_id) only, or (None) for none.
        self.demand = demand or {}
        #: Relations that are asked about on these few objects only, by which scans may filter.
        self.ids = ids or {}
        #: The subjects' ids, if they are so few that scans may filter by them.
        self.few = few
        subjects = subjects.select("subject_type", "subject_id")
        self.subjects = subjects if few else checkpointed(subjects.distinct())  # stored, as each direct grant joins them
        self.wildcards, self.max_depth = wildcards, max_depth
        self.values: dict[Node, DataFrame] = {}
        self._deals: int | None = None
        #: The relations whose recursion was cut off at the greatest depth.
        self.truncated: set[Node] = set()
        #: Within a loop, what each round joins is stored once: edges by their place in the schema.
        self.edges: dict[tuple, DataFrame] | None = None

    def _edge(self, key: tuple, rows: DataFrame) -> DataFrame:
        if self.edges is None:
            return rows
        if key not in self.edges:
            self.edges[key] = checkpointed(rows)
        return self.edges[key]

    def value(self, type_name: str, relation: str) -> DataFrame:
        """The value of a relation; empty if the model has no such relation."""
        node = (type_name, relation)
        if self.model.expr(*node) is None:
            return self._empty()
        groups = self.analysis.needed([node])
        self.analysis.check_stratified(groups)
        self._evaluate(groups)
        return self.values[node]

    def _evaluate(self, groups: list[list[Node]]) -> None:
        for group in groups:
            if group[0] not in self.values:
                if self.analysis.recursive(group):
                    self._loop(group)
                else:
                    self.values[group[0]] = self._whole(group[0]).distinct()

    def listed(self, type_name: str, relation: str) -> DataFrame:
        """The value of a relation, for lists of all its pairs: those that usersets and links give are made last, and neither shuffled nor stored."""
        node = (type_name, relation)
        if self.model.expr(*node) is None:
            return self._empty()
        groups = self.analysis.needed([node])
        self.analysis.check_stratified(groups)
        self._evaluate(groups[:-1])
        group, self.edges = groups[-1], {}
        try:
            return self._factored(node, group)
        finally:
            self.edges = None

    def _factored(self, node: Node, group: list[Node]) -> DataFrame:
        recursive = self.analysis.recursive(group)
        inside = set(group) if recursive else set()
        terms = {n: self._terms(n, self.model.expr(*n), inside) for n in group}
        if any(t is None for t in terms.values()) or not any(over for _, over in terms.values()):
            return self.value(*node)
        over = joined([o for _, own in terms.values() for o in own])
        classes = Classes(over, KEY[:2])
        rows = {n: union_of([*terms[n][0], self._self_rows(n)]).distinct() for n in group}
        if not recursive:
            plain, pairs = rows[node], classes.reached(over.edges)
        else:
            # rounds carry the edges' vias (or the classes, if these are fewer) in place of the subjects that hold them
            first, base = 0, {}
            for n in group:
                mine = F.split_part("via", F.lit(":"), F.lit(1)).cast("int").between(first, first + len(terms[n][1]) - 1)
                first += len(terms[n][1])
                carried = classes.carried(over.edges.where(mine)).select(F.lit(_CARRIER).alias("subject_type"), F.col("carrier").alias("subject_id"), "object_id")
                base[n] = rows[n].unionByName(carried)
            total = self._rounds(group, {}, base)[node]
            plain, carried = total.where(F.col("subject_type") != _CARRIER), total.where(F.col("subject_type") == _CARRIER)
            pairs = classes.arrived(carried.select(F.col("subject_id").alias("carrier"), "object_id"))
        pairs = checkpointed(pairs)
        return classes.pairs(pairs).unionByName(classes.uncovered(plain, pairs))

    def _terms(self, node: Node, e: Expr, inside: set[Node]) -> tuple[list[DataFrame], list[Over]] | None:
        """What an expression takes from outside of a group: rows, and edges with what is held over them. None if ``and`` or ``but not`` stand over relations of the group."""
        held = lambda f: f.withColumnRenamed("object_id", "via")
        if isinstance(e, Union):
            parts = [self._terms(node, p, inside) for p in e.parts]
            return None if None in parts else ([f for rows, _ in parts for f in rows], [o for _, over in parts for o in over])
        if isinstance(e, This):
            refs = [r for r in e.refs if r.relation and (r.type, r.relation) not in inside]
            return self._direct(node, e), [Over(self._grants(node, r), held(self.values[r.type, r.relation])) for r in refs]
        if isinstance(e, FromLink):
            return [], [Over(edges, held(v)) for edges, v in self._over(node, e, {n: v for n, v in self.values.items() if n not in inside})]
        if isinstance(e, Computed):
            other = (node[0], e.relation)
            if other in inside:
                return [], []
            if self.analysis.recursive(self.analysis.order[self.analysis.group_of[other]]):
                return [self.values[other]], []
            rows, over = self._terms(other, self.model.expr(*other), inside)
            return [*rows, self._self_rows(other)], over
        return None if inside & set(self.analysis.depends(node, e)) else ([self._eval(node, e, self.values, None)], [])

    def _empty(self) -> DataFrame:
        return self.subjects.select("subject_type", "subject_id", F.lit("").alias("object_id")).where("false")

    def _whole(self, node: Node) -> DataFrame:
        own = self._self_rows(node)
        value = self._eval(node, self.model.expr(*node), self.values, None)
        return value.unionByName(own) if own is not None else value

    def _self_rows(self, node: Node) -> DataFrame | None:
        """Userset subjects on their own objects; exclusions don't apply to them."""
        own = self.subjects.where((F.col("subject_type") == node[0]) & subject_relation("subject_id").isin(*self.analysis.closure[node]))
        return own.select(F.lit(node[0]).alias("subject_type"), "subject_id", subject_object("subject_id").alias("object_id"))

    def _rows(self, node: Node, relation: str, *types: str) -> DataFrame:
        rows = self.tuples.where((F.col("object_type") == node[0]) & (F.col("relation") == relation) & F.col("subject_type").isin(*types))
        if node in self.ids:
            rows = rows.where(F.col("object_id").isin(*self.ids[node]))
        if node not in self.demand:
            return rows
        return rows.where("false") if self.demand[node] is None else rows.join(self.demand[node], "object_id", "left_semi")

    def _named(self, node: Node, e: This) -> DataFrame:
        """Plain subjects that tuples name, and the wildcard as itself."""
        plain = [r.type for r in e.refs if not r.relation and not r.wildcard]
        stars = [r.type for r in e.refs if r.wildcard]
        typed = F.col("subject_type").isin(*plain) & ~is_userset("subject_id") if plain else F.lit(False)
        star = F.col("subject_type").isin(*stars) & is_wildcard("subject_id") if stars else F.lit(False)
        return self._rows(node, node[1], *plain, *stars).where((typed & ~is_wildcard("subject_id")) | star).select(*KEY)

    def _everyone(self, node: Node, e: This) -> DataFrame:
        """(subject_type, object_id) of wildcard grants."""
        stars = [r.type for r in e.refs if r.wildcard]
        return self._rows(node, node[1], *stars).where(is_wildcard("subject_id")).select("subject_type", "object_id").distinct()

    def _direct(self, node: Node, e: This) -> list[DataFrame]:
        out = []
        plain = [r.type for r in e.refs if not r.relation and not r.wildcard]
        stars = [r.type for r in e.refs if r.wildcard]
        if plain or stars:
            named = self._named(node, e)
            named = named.where(F.col("subject_id").isin(*self.few)) if self.few else named
            out.append(named.join(self.subjects, ["subject_type", "subject_id"]).select(*KEY))
            if stars and self.wildcards:
                single = self.subjects.where(~is_userset("subject_id") & ~is_wildcard("subject_id"))
                out.append(self._for_all(self._everyone(node, e), single))
        return out

    def _for_all(self, granted: DataFrame, single: DataFrame) -> DataFrame:
        """Wildcard grants multiplied by the subjects asked about, as a list for all of them wants; subjects are dealt, so that no task gets all pairs of a type."""
        if self._deals is None:
            self._deals = 1 if self.few else max(1, -(-single.count() // _DEAL))
        if self._deals == 1:
            return granted.join(single, "subject_type").select(*KEY)
        each = granted.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(self._deals - 1))))
        own = single.withColumn("deal", F.pmod(F.xxhash64("subject_id"), F.lit(self._deals)).cast("int"))
        return each.join(own, ["subject_type", "deal"]).select(*KEY)

    def _grants(self, node: Node, ref) -> DataFrame:
        """(via, object_id): the usersets that a relation takes, by the object they belong to."""
        grants = self._rows(node, node[1], ref.type).where(subject_relation("subject_id") == ref.relation)
        return self._edge((node, ref), grants.select(subject_object("subject_id").alias("via"), "object_id").distinct())

    def _links(self, node: Node, e: FromLink, parent: str) -> DataFrame:
        """(via, object_id): the objects that a link leads to."""
        links = self._rows(node, e.link, parent).where(~is_userset("subject_id") & ~is_wildcard("subject_id"))
        return self._edge((node, e, parent), links.select(F.col("subject_id").alias("via"), "object_id").distinct())

    def _over(self, node: Node, e: FromLink, values: dict[Node, DataFrame]) -> list[tuple[DataFrame, DataFrame]]:
        """The edges of a link with the values that it leads to."""
        parents = [p for p in self.model.link_types(node[0], e.link) if self.model.expr(p, e.relation) is not None]
        return [(self._links(node, e, p), values[p, e.relation]) for p in parents if (p, e.relation) in values]

    @staticmethod
    def _via(edges: DataFrame, held: DataFrame) -> DataFrame:
        return edges.join(held.withColumnRenamed("object_id", "via"), "via").select(*KEY)

    @staticmethod
    def _tested(rows: DataFrame, edges: DataFrame, held: DataFrame) -> DataFrame:
        """Of candidate rows, those with an edge to something that the subject holds: as many rows as the candidates have edges, whatever the edges reach."""
        at = held.withColumnRenamed("object_id", "via")
        return rows.join(edges, "object_id").join(at, ["subject_type", "subject_id", "via"], "left_semi").select(*KEY).distinct()

    def _eval(self, node: Node, e: Expr, values: dict[Node, DataFrame], delta: dict[Node, DataFrame] | None) -> DataFrame | None:
        """The value of an expression; with ``delta``, what the delta's rows add to it, None if nothing can."""
        look = lambda n: values.get(n) if delta is None else delta.get(n)
        if isinstance(e, This):
            out = self._direct(node, e) if delta is None else []
            for ref in e.refs:
                if ref.relation and (held := look((ref.type, ref.relation))) is not None:
                    out.append(self._via(self._grants(node, ref), held))
        elif isinstance(e, Computed):
            out = [held] if (held := look((node[0], e.relation))) is not None else []
        elif isinstance(e, FromLink):
            out = [self._via(edges, held) for edges, held in self._over(node, e, values if delta is None else delta)]
        elif isinstance(e, Union):
            out = [v for p in e.parts if (v := self._eval(node, p, values, delta)) is not None]
        elif isinstance(e, Intersection):
            out = []
            # without wildcards first: the others then only test its rows, and no wildcard is multiplied by all subjects
            parts = sorted(e.parts, key=lambda p: self._starred(node, p))
            for k, p in enumerate(parts if delta is not None else parts[:1]):
                if (value := self._eval(node, p, values, delta)) is not None:
                    for j, other in enumerate(parts):
                        if j != k:
                            value = self._keep(node, other, values, value)
                    out.append(value)
        else:
            base = self._eval(node, e.base, values, delta)
            out = [] if base is None else [self._drop(node, e.subtract, values, base)]
        if not out:
            return None if delta is not None else self._empty()
        return union_of(out)

    def _starred(self, node: Node, e: Expr) -> bool:
        return any(isinstance(x, This) and any(r.wildcard for r in x.refs) for x in walk(e)) or any(self.analysis.wildcard_types[n] for n in self.analysis.depends(node, e))

    def _tests(self, node: Node, e: This) -> list[tuple[DataFrame, list[str]]]:
        """What grants directly, as (rows, columns to join by); wildcards are joined by type and object."""
        named = [(self._named(node, e), KEY)] if any(not r.relation for r in e.refs) else []
        star = [(self._everyone(node, e), ["subject_type", "object_id"])] if self.wildcards and any(r.wildcard for r in e.refs) else []
        return named + star

    def _single(self, node: Node) -> bool:
        """Whether a relation's own expression can test rows; else its value does."""
        return not self.analysis.recursive(self.analysis.order[self.analysis.group_of[node]])

    def _keep(self, node: Node, e: Expr, values: dict[Node, DataFrame], rows: DataFrame) -> DataFrame:
        """Of candidate rows, those that the expression grants."""
        if isinstance(e, This):
            kept = [self._testable(rows, on).join(t, on, "left_semi") for t, on in self._tests(node, e)]
            kept += [self._tested(rows, self._grants(node, r), values[r.type, r.relation]) for r in e.refs if r.relation]
            return kept[0] if len(kept) == 1 else union_of(kept).distinct()
        if isinstance(e, Computed):
            other = (node[0], e.relation)
            if not self._single(other):
                return rows.join(values[other], KEY, "left_semi")
            return self._keep(other, self.model.expr(*other), values, rows).unionByName(rows.join(self._self_rows(other), KEY, "left_semi")).distinct()
        if isinstance(e, Union):
            return union_of([self._keep(node, p, values, rows) for p in e.parts]).distinct()
        if isinstance(e, Intersection):
            for p in e.parts:
                rows = self._keep(node, p, values, rows)
            return rows
        if isinstance(e, Difference):
            return self._drop(node, e.subtract, values, self._keep(node, e.base, values, rows))
        kept = [self._tested(rows, edges, held) for edges, held in self._over(node, e, values)]
        return union_of(kept).distinct() if kept else rows.where("false")

    def _drop(self, node: Node, e: Expr, values: dict[Node, DataFrame], rows: DataFrame) -> DataFrame:
        """Of candidate rows, those that the expression does not grant."""
        if isinstance(e, This):
            for t, on in self._tests(node, e):
                if on == KEY:
                    rows = rows.join(t, KEY, "left_anti")
                else:
                    t = t.select(F.col("subject_type").alias("star_type"), F.col("object_id").alias("star_object"))
                    same = (F.col("subject_type") == F.col("star_type")) & (F.col("object_id") == F.col("star_object")) & ~is_userset("subject_id") & ~is_wildcard("subject_id")
                    rows = rows.join(t, same, "left_anti")
            for r in e.refs:
                if r.relation:
                    rows = rows.join(self._tested(rows, self._grants(node, r), values[r.type, r.relation]), KEY, "left_anti")
            return rows
        if isinstance(e, Computed) and self._single((node[0], e.relation)):
            other = (node[0], e.relation)
            return self._drop(other, self.model.expr(*other), values, rows).join(self._self_rows(other), KEY, "left_anti")
        if isinstance(e, Union):
            for p in e.parts:
                rows = self._drop(node, p, values, rows)
            return rows
        return rows.join(self._keep(node, e, values, rows), KEY, "left_anti")

    @staticmethod
    def _testable(rows: DataFrame, on: list[str]) -> DataFrame:
        """Wildcards cover plain ids only."""
        return rows if on == KEY else rows.where(~is_userset("subject_id") & ~is_wildcard("subject_id"))

    def holding(self, type_name: str, relation: str, rows: DataFrame) -> DataFrame:
        """Of candidate rows (subject_type, subject_id, object_id), those whose subject holds the relation.

        Only recursive relations, and those reached over links and usersets, are
        evaluated for all subjects; the rest is tested row by row with semi-joins.
        """
        self.value(type_name, relation)  # prepares what is recursive; the rest is a plan that nothing runs
        return self._keep((type_name, relation), Computed(relation), self.values, rows.select(*KEY).distinct())

    def _loop(self, group: list[Node]) -> None:
        """Rounds until nothing new comes; each joins the rows that the last one added."""
        inside = set(group)
        below = {d for n in group for d in self.analysis.depends(n)} - inside
        outer = {n: checkpointed(self.values[n]) for n in below}
        self.values |= outer
        self.edges = {}
        none = {n: self._empty() for n in group}
        base = {n: union_of([self._eval(n, self.model.expr(*n), outer | none, None), self._self_rows(n)]).distinct() for n in group}
        self.values |= self._rounds(group, outer, base)
        self.edges = None

    def _rounds(self, group: list[Node], outer: dict[Node, DataFrame], base: dict[Node, DataFrame]) -> dict[Node, DataFrame]:
        inside = set(group)
        delta = {n: checkpointed(base[n]) for n in group}
        total = dict(delta)
        depth = 1
        while True:
            delta = {n: d for n, d in delta.items() if not d.isEmpty()}
            if not delta:
                break
            if depth >= self.max_depth:
                self.truncated |= inside
                break
            new = {}
            for n in group:
                added = self._eval(n, self.model.expr(*n), outer | total, delta)
                if added is not None:
                    new[n] = checkpointed(added.distinct().join(total[n], KEY, "left_anti"))
            for n, d in new.items():
                total[n] = total[n].unionByName(d)
            delta, depth = new, depth + 1
        return total


