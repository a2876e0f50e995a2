"""What a model's text says before any tuple is read: closures, cycles, order of evaluation, depth."""

from __future__ import annotations

from functools import cached_property

from relgrove.plans.model import Computed, Difference, Expr, FromLink, Intersection, Model, This, Union, walk

Node = tuple[str, str]
#: Resolution goes through this many steps at most.
MAX_DEPTH = 25


class CyclicSchema(ValueError):
    """Relations imply one another in a circle."""


class UnstratifiedSchema(ValueError):
    """A relation is subtracted from one that it depends on itself."""


def implied_by(e: Expr) -> set[str]:
    """The relations of the same object that alone grant the expression, exclusions left aside."""
    if isinstance(e, Computed):
        return {e.relation}
    if isinstance(e, Union):
        return set().union(*map(implied_by, e.parts))
    return implied_by(e.base) if isinstance(e, Difference) else set()


def strongly_connected(graph: dict) -> list[list]:
    """The strongly connected components, each after those that it depends on (Tarjan, without recursion)."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in graph:
        if root in index:
            continue
        work = [(root, iter(graph[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(graph[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    out.append(part)
    return out


class Analysis:
    """Derived facts of a model; all are small and live on the driver."""

    def __init__(self, model: Model):
        self.model = model

    @cached_property
    def closure(self) -> dict[Node, dict[str, tuple[str, ...]]]:
        """For each relation, the relations of the same type that imply it (itself included), with the way to them."""
        out = {}
        for t, r in self.model.nodes():
            found, front = {r: (r,)}, [r]
            while front:
                here = front.pop(0)
                for nxt in sorted(implied_by(self.model.expr(t, here))):
                    if nxt not in found:
                        found[nxt] = (*found[here], nxt)
                        front.append(nxt)
            out[t, r] = found
        return out

    def closure_rows(self) -> list[tuple[str, str, str, str]]:
        """(object type, relation, satisfying relation, way)."""
        return [(t, r, s, " > ".join(way)) for (t, r), found in self.closure.items() for s, way in found.items()]

    def userset_rules(self) -> list[tuple[str, str, str, str, str]]:
        """(object type, relation, subject type, subject relation, satisfying relation) for each userset that a relation takes."""
        rows = []
        for t, r in self.model.nodes():
            for ref in self.model.refs(t, r):
                if ref.relation:
                    rows += [(t, r, ref.type, ref.relation, s) for s in self.closure[ref.type, ref.relation]]
        return rows

    def depends(self, node: Node, e: Expr | None = None) -> list[Node]:
        """The relations that a relation's (or an expression's) value is computed from."""
        out: list[Node] = []
        for x in walk(e or self.model.expr(*node)):
            if isinstance(x, This):
                out += [(ref.type, ref.relation) for ref in x.refs if ref.relation]
            elif isinstance(x, Computed):
                out.append((node[0], x.relation))
            elif isinstance(x, FromLink):
                out += [(p, x.relation) for p in self.model.link_types(node[0], x.link) if self.model.expr(p, x.relation) is not None]
        return list(dict.fromkeys(out))

    @cached_property
    def order(self) -> list[list[Node]]:
        """Groups of mutually dependent relations, each group after those that it needs."""
        return strongly_connected({n: self.depends(n) for n in self.model.nodes()})

    @cached_property
    def group_of(self) -> dict[Node, int]:
        return {n: k for k, group in enumerate(self.order) for n in group}

    def recursive(self, group: list[Node]) -> bool:
        return len(group) > 1 or group[0] in self.depends(group[0])

    def needed(self, targets: list[Node]) -> list[list[Node]]:
        """The groups that the targets depend on, in order."""
        seen, front = set(targets), list(targets)
        while front:
            for n in self.depends(front.pop()):
                if n not in seen:
                    seen.add(n)
                    front.append(n)
        return [g for g in self.order if g[0] in seen]

    def subtracted(self, node: Node) -> set[Node]:
        """The relations that take something away from a relation's value."""
        direct = [d for g in self.needed([node]) for n in g for x in walk(self.model.expr(*n)) if isinstance(x, Difference) for d in self.depends(n, x.subtract)]
        return {n for g in self.needed(direct) for n in g}

    def check_stratified(self, groups: list[list[Node]]) -> None:
        for group in groups:
            for node in group:
                for x in walk(self.model.expr(*node)):
                    if isinstance(x, Difference) and set(self.depends(node, x.subtract)) & set(group) and self.recursive(group):
                        raise UnstratifiedSchema(f"{node[0]}.{node[1]} subtracts a relation that depends on it; only check() and explain() can resolve it")

    def stratified(self, node: Node) -> bool:
        """Whether sets can resolve a relation: none that it needs is subtracted from itself."""
        try:
            self.check_stratified(self.needed([node]) if self.model.expr(*node) is not None else [])
        except UnstratifiedSchema:
            return False
        return True

    def check_cycles(self) -> None:
        """Refuses circles of relations that imply one another, and circles of links over different types and relations."""
        for t in self.model.types.values():
            graph = {r: [c for c in sorted(_computed(e)) if c in t.relations] for r, e in t.relations.items()}
            for part in strongly_connected(graph):
                if len(part) > 1 or part[0] in graph[part[0]]:
                    raise CyclicSchema(f"{t.name}: {' > '.join(sorted(part))} imply one another")
        links = {n: [(p, x.relation) for x in walk(self.model.expr(*n)) if isinstance(x, FromLink) for p in self.model.link_types(n[0], x.link) if self.model.expr(p, x.relation) is not None] for n in self.model.nodes()}
        for part in strongly_connected(links):
            if len({t for t, _ in part}) > 1 and len({r for _, r in part}) > 1:
                raise CyclicSchema("links form a circle over " + ", ".join(f"{t}.{r}" for t, r in sorted(part)))

    @cached_property
    def userset_depth(self) -> dict[Node, int]:
        """The longest chain of usersets that the schema itself (not the tuples) demands of a relation."""
        depth: dict[Node, int] = {}
        for group in self.order:
            inside = set(group)
            best = 0
            for n in group:
                for ref in self.model.refs(*n):
                    if ref.relation and (ref.type, ref.relation) not in inside:
                        best = max(best, 1 + depth[ref.type, ref.relation])
                for x in walk(self.model.expr(*n)):
                    if isinstance(x, Computed) and (n[0], x.relation) not in inside:
                        best = max(best, depth[n[0], x.relation])
                    elif isinstance(x, FromLink):
                        best = max([best, *(depth[p, x.relation] for p in self.model.link_types(n[0], x.link) if (p, x.relation) in depth and (p, x.relation) not in inside)])
            depth |= dict.fromkeys(group, best)
        return depth

    @cached_property
    def resolved_types(self) -> dict[Node, set[str]]:
        """The types of plain subjects that can hold a relation, through whatever path."""
        out: dict[Node, set[str]] = {n: set(self.model.relation_subjects(*n)) for n in self.model.nodes()}
        changed = True
        while changed:
            changed = False
            for n in out:
                more = set().union(*(out[d] for d in self.depends(n)), set())
                if not more <= out[n]:
                    out[n] |= more
                    changed = True
        return out

    @cached_property
    def wildcard_types(self) -> dict[Node, set[str]]:
        """The types of which a wildcard can reach a relation."""
        out = {n: {r.type for r in self.model.refs(*n) if r.wildcard} for n in self.model.nodes()}
        changed = True
        while changed:
            changed = False
            for n in out:
                more = set().union(*(out[d] for d in self.depends(n)), set())
                if not more <= out[n]:
                    out[n] |= more
                    changed = True
        return out

    def features(self, node: Node) -> set[str]:
        names = {This: "direct", Computed: "implied", FromLink: "link", Intersection: "intersection", Difference: "exclusion"}
        out = {names[type(x)] for x in walk(self.model.expr(*node)) if type(x) in names}
        refs = self.model.refs(*node)
        out |= {"userset"} if any(r.relation for r in refs) else set()
        out |= {"wildcard"} if any(r.wildcard for r in refs) else set()
        return out | ({"recursive"} if self.recursive(self.order[self.group_of[node]]) else set())


def _computed(e: Expr) -> set[str]:
    return {x.relation for x in walk(e) if isinstance(x, Computed)}


def validate(model: Model) -> Analysis:
    """The model's analysis; raises where the schema can't be used."""
    a = Analysis(model)
    a.check_cycles()
    return a
