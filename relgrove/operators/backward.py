"""Object-first evaluation: which subjects of a type hold a relation on each object?

A wildcard stands for subjects that nobody has listed, so a relation's value is
a triple per object: the ids that are granted by name (``e``), whether the
wildcard is (``s``), and the ids that the wildcard does not cover (``x``).
A subject u holds the relation if u is in e, or s and u is not in x.

    or       e: both   s: either   x: what every side with a wildcard excepts
    and      e: named on one side and held on the other
             s: both   x: either
    but not  e: named and not held by the subtracted side; and ids that the
                subtracted wildcard excepts, if both have a wildcard
             s: only the base has it   x: the base's and the ids named by the other

``s`` or ``x`` is None where the schema rules it out, which keeps plans small.
With ``relation`` set, the subjects are usersets ``id#relation`` of the type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrove.functions.userset import as_userset, is_userset, is_wildcard, subject_object, subject_relation
from relgrove.operators.common import checkpointed, marked, union_of
from relgrove.operators.factored import Classes, Over, joined
from relgrove.plans.analysis import MAX_DEPTH, Analysis, Node
from relgrove.plans.model import WILDCARD, Computed, Difference, Expr, FromLink, Intersection, This, Union, walk

O, PAIR = "object_id", ["object_id", "subject_id"]


@dataclass(frozen=True)
class Held:
    """Who holds a relation: e and x have (object_id, subject_id), s has object_id; all rows are distinct."""

    e: DataFrame
    s: DataFrame | None = None
    x: DataFrame | None = None

    def frames(self) -> list[DataFrame]:
        return [f for f in (self.e, self.s, self.x) if f is not None]

    def stored(self) -> Held:
        return Held(*(None if f is None else checkpointed(f) for f in (self.e, self.s, self.x)))


def either(a: Held, b: Held) -> Held:
    e = a.e.unionByName(b.e).distinct()
    if a.s is None or b.s is None:
        one = b if a.s is None else a
        return Held(e, one.s, one.x)
    parts = [f for f in (None if a.x is None else a.x.join(b.s, O, "left_anti"), None if b.x is None else b.x.join(a.s, O, "left_anti"), None if a.x is None or b.x is None else a.x.join(b.x, PAIR, "left_semi")) if f is not None]
    return Held(e, a.s.unionByName(b.s).distinct(), union_of(parts) if parts else None)


def _in(rows: DataFrame, b: Held) -> DataFrame:
    """The pairs that b grants."""
    named = rows.join(b.e, PAIR, "left_semi")
    if b.s is None:
        return named
    starred = rows.join(b.s, O, "left_semi")
    return named.unionByName(starred if b.x is None else starred.join(b.x, PAIR, "left_anti")).distinct()


def _out(rows: DataFrame, b: Held) -> DataFrame:
    """The pairs that b does not grant."""
    rows = rows.join(b.e, PAIR, "left_anti")
    if b.s is None:
        return rows
    plain = rows.join(b.s, O, "left_anti")
    return plain if b.x is None else plain.unionByName(rows.join(b.s, O, "left_semi").join(b.x, PAIR, "left_semi"))


def both(a: Held, b: Held) -> Held:
    e = _in(a.e, b)
    if a.s is not None:
        e = e.unionByName(_in(b.e, a)).distinct()
    if a.s is None or b.s is None:
        return Held(e)
    s = a.s.join(b.s, O, "left_semi")
    x = [f for f in (a.x, b.x) if f is not None]
    return Held(e, s, union_of(x).distinct().join(s, O, "left_semi") if x else None)


def without(a: Held, b: Held) -> Held:
    e = _out(a.e, b)
    if a.s is None:
        return Held(e)
    if b.s is not None and b.x is not None:
        e = e.unionByName(_out(_in(b.x.join(b.s, O, "left_semi"), a), b)).distinct()
    s = a.s if b.s is None else a.s.join(b.s, O, "left_anti")
    x = [f for f in (a.x, b.e) if f is not None]
    return Held(e, s, union_of(x).distinct().join(s, O, "left_semi"))


class Backward:
    """Values of relations for subjects of one type; ``objects`` (object_id) limits the objects of the relation asked for."""

    def __init__(self, analysis: Analysis, tuples: DataFrame, subject_type: str, relation: str = "", max_depth: int = MAX_DEPTH):
        self.analysis, self.model, self.tuples = analysis, analysis.model, tuples
        self.subject_type, self.relation, self.max_depth = subject_type, relation, max_depth
        self.truncated = False
        #: The relations whose demand was cut off at the greatest depth.
        self.cut: set[Node] = set()
        self.demand: dict[Node, DataFrame] | None = None
        #: Within a loop, what each round joins is stored once: edges by their place in the schema.
        self.edges: dict[tuple, DataFrame] | None = None

    def _edge(self, key: tuple, rows: DataFrame) -> DataFrame:
        if self.edges is None:
            return rows
        if key not in self.edges:
            self.edges[key] = checkpointed(rows)
        return self.edges[key]

    def value(self, type_name: str, relation: str, objects: DataFrame | None = None) -> Held:
        node = (type_name, relation)
        if self.model.expr(*node) is None:
            return Held(self._none())
        groups = self.analysis.needed([node])
        self.analysis.check_stratified(groups)
        self.demand = None
        if objects is not None:
            self.demands({node: objects})
        values: dict[Node, Held] = {}
        for group in groups:
            if objects is None and node in group and (whole := self._listed(node, group, values)) is not None:
                return whole
            if objects is None and len(group) == 1 and self.analysis.recursive(group) and (whole := self._listed(group[0], group, values)) is not None:
                values[group[0]] = whole.stored()
            elif self.analysis.recursive(group):
                values |= self._loop(group, values)
            else:
                values[group[0]] = self._with_self(group[0], self._eval(group[0], self.model.expr(*group[0]), values, None))
        return values[node]

    def _listed(self, node: Node, group: list[Node], values: dict[Node, Held]) -> Held | None:
        """The value for lists of all its pairs: those that usersets and links give are made last, and neither shuffled nor stored. None if it has no such pairs, or recursion with wildcards or under ``and`` and ``but not``."""
        recursive = self.analysis.recursive(group)
        if recursive and self._wild(group):
            return None
        self.edges = {}
        try:
            inside = set(group) if recursive else set()
            terms = {n: self._terms(n, self.model.expr(*n), values, inside) for n in group}
            if any(t is None for t in terms.values()) or not any(over for _, over in terms.values()):
                return None
            over = joined([o for _, own in terms.values() for o in own])
            classes = Classes(over, ["subject_id"])
            rows = {n: union_of([*terms[n][0], *([] if (own := self._own(n)) is None else [own])]).distinct() if terms[n][0] or self._own(n) is not None else self._none() for n in group}
            if not recursive:
                plain, pairs, rest = rows[node], classes.reached(over.edges), self._eval(node, self.model.expr(*node), values, None)
            else:
                # rounds carry the edges' vias (or the classes, if these are fewer) in place of the subjects that hold them
                first, base, mark = 0, {}, lambda c, name: F.concat(F.lit(c), name).alias("subject_id")
                for n in group:
                    mine = F.split_part("via", F.lit(":"), F.lit(1)).cast("int").between(first, first + len(terms[n][1]) - 1)
                    first += len(terms[n][1])
                    base[n] = rows[n].select(O, mark("=", "subject_id")).unionByName(classes.carried(over.edges.where(mine)).select(O, mark("#", "carrier")))
                total, rest = self._rounds_of_news(group, values, base)[node].e, Held(self._none())
                bare = F.expr("substring(subject_id, 2)")
                plain = total.where(F.col("subject_id").startswith("=")).select(O, bare.alias("subject_id"))
                pairs = classes.arrived(total.where(F.col("subject_id").startswith("#")).select(O, bare.alias("carrier")))
            pairs = checkpointed(pairs)
            return Held(classes.pairs(pairs).unionByName(classes.uncovered(plain, pairs)), rest.s, rest.x)
        finally:
            self.edges = None

    def _terms(self, node: Node, e: Expr, values: dict[Node, Held], inside: set[Node]) -> tuple[list[DataFrame], list[Over]] | None:
        """What an expression names from outside of a group: pairs, and edges with what is held over them. None if ``and`` or ``but not`` stand over relations of the group."""
        held = lambda n: values[n].e.withColumnRenamed(O, "via")
        if isinstance(e, Union):
            parts = [self._terms(node, p, values, inside) for p in e.parts]
            return None if None in parts else ([f for rows, _ in parts for f in rows], [o for _, over in parts for o in over])
        if isinstance(e, This):
            refs = [r for r in e.refs if r.relation and (r.type, r.relation) not in inside]
            plain = not self.relation and any(r.type == self.subject_type and not r.relation for r in e.refs)
            return [self._direct(node, e).e] if plain else [], [Over(self._grants(node, r), held((r.type, r.relation))) for r in refs]
        if isinstance(e, FromLink):
            parents = [p for p in self.model.link_types(node[0], e.link) if (p, e.relation) in values and (p, e.relation) not in inside]
            return [], [Over(self._links(node, e.link, p), held((p, e.relation))) for p in parents]
        if isinstance(e, Computed):
            other = (node[0], e.relation)
            if other in inside:
                return [], []
            if self.analysis.recursive(self.analysis.order[self.analysis.group_of[other]]):
                return [values[other].e], []
            rows, over = self._terms(other, self.model.expr(*other), values, inside)
            return [*rows, *([] if (own := self._own(other)) is None else [own])], over
        return None if inside & set(self.analysis.depends(node, e)) else ([self._eval(node, e, values, None).e], [])

    def _wild(self, group: list[Node]) -> bool:
        return not self.relation and any(self.subject_type in self.analysis.wildcard_types[n] for n in group)

    def _none(self) -> DataFrame:
        return self.tuples.select(F.col("object_id"), F.col("subject_id")).where("false")

    def _rows(self, node: Node, relation: str, kind: str) -> DataFrame:
        rows = self.tuples.where((F.col("object_type") == node[0]) & (F.col("relation") == relation) & (F.col("subject_type") == kind))
        if self.demand is not None:
            rows = rows.join(self.demand[node], O, "left_semi") if node in self.demand else rows.where("false")
        return rows

    def _grants(self, node: Node, ref) -> DataFrame:
        """(via, object_id): the usersets that a relation takes, by the object they belong to."""
        rows = self._rows(node, node[1], ref.type).where(subject_relation("subject_id") == ref.relation)
        return self._edge((node, ref), rows.select(subject_object("subject_id").alias("via"), O).distinct())

    def _links(self, node: Node, link: str, parent: str) -> DataFrame:
        rows = self._rows(node, link, parent).where(~is_userset("subject_id") & ~is_wildcard("subject_id"))
        return self._edge((node, link, parent), rows.select(F.col("subject_id").alias("via"), O).distinct())

    def demands(self, asked: dict[Node, DataFrame]) -> dict[Node, DataFrame]:
        """The objects (object_id) of each relation on which relations' values on given objects depend, found from these down.

        ``cut`` tells the relations at which they end early.
        """
        groups = self.analysis.needed(list(asked))
        self.demand = {node: objects.select(O).distinct() for node, objects in asked.items()}
        for group in reversed(groups):
            if self.analysis.recursive(group):
                self._demand_loop(group)
            for node in group:
                if node in self.demand:
                    for n, more in self._asks(node):
                        if n not in group:
                            self.demand[n] = self.demand[n].unionByName(more).distinct() if n in self.demand else more.distinct()
        return self.demand

    def _demand_loop(self, group: list[Node]) -> None:
        front = {n: self.demand[n] for n in group if n in self.demand}
        for _ in range(self.max_depth):
            whole, new = dict(self.demand), {}
            for node in front:
                self.demand = {node: front[node]}
                for n, more in self._asks(node):
                    if n in group:
                        new[n] = new[n].unionByName(more) if n in new else more
            self.demand = whole
            front = {}
            for n, more in new.items():
                more = more.distinct()
                more = checkpointed(more.join(self.demand[n], O, "left_anti") if n in self.demand else more)
                if not more.isEmpty():
                    front[n] = more
                    self.demand[n] = self.demand[n].unionByName(more) if n in self.demand else more
            if not front:
                return
        self.cut |= set(group)

    def _asks(self, node: Node):
        for x in walk(self.model.expr(*node)):
            if isinstance(x, This):
                for ref in x.refs:
                    if ref.relation:
                        yield (ref.type, ref.relation), self._grants(node, ref).select(F.col("via").alias(O))
            elif isinstance(x, Computed):
                yield (node[0], x.relation), self.demand[node]
            elif isinstance(x, FromLink):
                for parent in self.model.link_types(node[0], x.link):
                    if self.model.expr(parent, x.relation) is not None:
                        yield (parent, x.relation), self._links(node, x.link, parent).select(F.col("via").alias(O))

    def _direct(self, node: Node, e: This) -> Held:
        refs = [r for r in e.refs if r.type == self.subject_type and not r.relation] if not self.relation else []
        if not refs:
            return Held(self._none())
        rows = self._rows(node, node[1], self.subject_type)
        named = self._none()
        if any(not r.wildcard for r in refs):
            named = rows.where(~is_wildcard("subject_id") & ~is_userset("subject_id")).select(*PAIR).distinct()
        star = rows.where(is_wildcard("subject_id")).select(O).distinct() if any(r.wildcard for r in refs) else None
        return Held(named, star)

    def _through(self, via: DataFrame, held: Held) -> Held:
        """The value over edges (via, object_id): each object has the union of its branches."""
        branch = lambda f: via.join(f.withColumnRenamed(O, "via"), "via")
        e = branch(held.e).select(*PAIR).distinct()
        if held.s is None:
            return Held(e)
        stars = branch(held.s)
        s = stars.select(O).distinct()
        if held.x is None:
            return Held(e, s)
        branches = stars.groupBy(O).agg(F.count(F.lit(1)).alias("stars"))
        excepted = branch(held.x.join(held.s, O, "left_semi")).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
        return Held(e, s, excepted.join(branches, O).where("n = stars").select(*PAIR))

    def _eval(self, node: Node, e: Expr, values: dict[Node, Held], delta: dict[Node, Held] | None) -> Held | None:
        look = values.get if delta is None else delta.get
        if isinstance(e, This):
            out = [self._direct(node, e)] if delta is None else []
            for ref in e.refs:
                if ref.relation and (held := look((ref.type, ref.relation))) is not None:
                    out.append(self._through(self._grants(node, ref), held))
        elif isinstance(e, Computed):
            out = [held] if (held := look((node[0], e.relation))) is not None else []
        elif isinstance(e, FromLink):
            out = []
            for parent in self.model.link_types(node[0], e.link):
                if self.model.expr(parent, e.relation) is not None and (held := look((parent, e.relation))) is not None:
                    out.append(self._through(self._links(node, e.link, parent), held))
        elif isinstance(e, Union):
            out = [v for p in e.parts if (v := self._eval(node, p, values, delta)) is not None]
        elif isinstance(e, Intersection):
            out = []
            # without wildcards and edges first: the others then only test its rows
            parts = sorted(e.parts, key=lambda p: (self._starred(node, p), any(isinstance(x, FromLink) or isinstance(x, This) and any(r.relation for r in x.refs) for x in walk(p))))
            for k, p in enumerate(parts if delta is not None else parts[:1]):
                if (value := self._eval(node, p, values, delta)) is not None:
                    for j, other in enumerate(parts):
                        if j != k:
                            value = both(value, self._eval(node, other, values, None)) if value.s is not None else Held(self._keep(node, other, values, value.e))
                    out.append(value)
        else:
            base = self._eval(node, e.base, values, delta)
            if base is None:
                out = []
            elif base.s is None:
                out = [Held(base.e.join(self._keep(node, e.subtract, values, base.e), PAIR, "left_anti"))]
            else:
                out = [without(base, self._eval(node, e.subtract, values, None))]
        if not out:
            return Held(self._none()) if delta is None else None
        result = out[0]
        for v in out[1:]:
            result = either(result, v)
        return result

    def _starred(self, node: Node, e: Expr) -> bool:
        """Whether the expression may grant a wildcard of the subjects' type."""
        if self.relation:
            return False
        own = any(isinstance(x, This) and any(r.wildcard and r.type == self.subject_type for r in x.refs) for x in walk(e))
        return own or any(self.subject_type in self.analysis.wildcard_types[n] for n in self.analysis.depends(node, e))

    def _keep(self, node: Node, e: Expr, values: dict[Node, Held], rows: DataFrame) -> DataFrame:
        """Of candidate pairs, those that the expression grants. Over links and usersets the candidates' edges are tested, never all that these reach."""
        if isinstance(e, Union):
            return union_of([self._keep(node, p, values, rows) for p in e.parts]).distinct()
        if isinstance(e, Intersection):
            for p in e.parts:
                rows = self._keep(node, p, values, rows)
            return rows
        if isinstance(e, Difference):
            rows = self._keep(node, e.base, values, rows)
            return rows.join(self._keep(node, e.subtract, values, rows), PAIR, "left_anti")
        if isinstance(e, Computed):
            other = (node[0], e.relation)
            if self.analysis.recursive(self.analysis.order[self.analysis.group_of[other]]):
                return _in(rows, values[other])
            kept, own = self._keep(other, self.model.expr(*other), values, rows), self._own(other)
            return kept if own is None else kept.unionByName(rows.join(own, PAIR, "left_semi")).distinct()
        if isinstance(e, This):
            kept = [_in(rows, self._direct(node, e))]
            over = [(self._grants(node, r), values[r.type, r.relation]) for r in e.refs if r.relation]
        else:
            kept = []
            parents = [p for p in self.model.link_types(node[0], e.link) if (p, e.relation) in values]
            over = [(self._links(node, e.link, p), values[p, e.relation]) for p in parents]
        for edges, held in over:
            reached = rows.join(edges, O).select(F.col(O).alias("at"), F.col("via").alias(O), "subject_id")
            kept.append(_in(reached, held).select(F.col("at").alias(O), "subject_id"))
        return union_of(kept).distinct() if kept else rows.where("false")

    def _own(self, node: Node) -> DataFrame | None:
        """Usersets on their own objects, where these hold the relation."""
        if not self.relation or node[0] != self.subject_type or self.relation not in self.analysis.closure[node]:
            return None
        kind = self.subject_type
        ids = [self.tuples.where(F.col("object_type") == kind).select(O), self.tuples.where((F.col("subject_type") == kind) & ~is_wildcard("subject_id")).select(subject_object("subject_id").alias(O))]
        if self.demand is not None and node in self.demand:
            ids = [self.demand[node]]
        return union_of(ids).distinct().select(O, as_userset(O, self.relation).alias("subject_id"))

    def _with_self(self, node: Node, held: Held) -> Held:
        """Adds usersets on their own objects, which exclusions don't touch."""
        own = self._own(node)
        return held if own is None else either(held, Held(own))

    def _loop(self, group: list[Node], outer: dict[Node, Held]) -> dict[Node, Held]:
        below = {d for n in group for d in self.analysis.depends(n)} - set(group)
        outer |= {n: outer[n].stored() for n in below}
        self.edges = {}
        try:
            return self._rounds_of_all(group, outer) if self._wild(group) else self._rounds_of_news(group, outer)
        finally:
            self.edges = None

    def _rounds_of_news(self, group: list[Node], outer: dict[Node, Held], base: dict[Node, DataFrame] | None = None) -> dict[Node, Held]:
        """Without wildcards, values only grow: each round joins the last round's new pairs. base: the first ones, if not the group's own."""
        total = {n: Held(self._none()) for n in group}
        base = base or {n: self._with_self(n, self._eval(n, self.model.expr(*n), outer | total, None)).e for n in group}
        delta = {n: Held(checkpointed(f)) for n, f in base.items()}
        total = dict(delta)
        for depth in range(1, self.max_depth + 1):
            delta = {n: d for n, d in delta.items() if not d.e.isEmpty()}
            if not delta:
                return total
            self.truncated = depth == self.max_depth
            if self.truncated:
                break
            new = {}
            for n in group:
                added = self._eval(n, self.model.expr(*n), outer | total, delta)
                if added is not None:
                    new[n] = Held(checkpointed(added.e.distinct().join(total[n].e, PAIR, "left_anti")))
            total |= {n: Held(total[n].e.unionByName(d.e)) for n, d in new.items()}
            delta = new
        return total

    def _rounds_of_all(self, group: list[Node], outer: dict[Node, Held]) -> dict[Node, Held]:
        """With wildcards, exceptions may shrink as branches come: each round evaluates the whole."""
        total: dict[Node, Held] = {}
        seen = None
        none = Held(self._none())
        for depth in range(self.max_depth + 1):
            start = {n: total.get(n, none) for n in group}
            total = {n: self._with_self(n, self._eval(n, self.model.expr(*n), outer | start, None)).stored() for n in group}
            marks = [marked(f) for n in group for f in total[n].frames()]
            if marks == seen:
                return total
            seen, self.truncated = marks, depth == self.max_depth
        return total


def listed(held: Held) -> DataFrame:
    """(object_id, subject_id): the subjects granted by name, and the wildcard where it is granted."""
    if held.s is None:
        return held.e
    return held.e.unionByName(held.s.select(O, F.lit(WILDCARD).alias("subject_id")))
