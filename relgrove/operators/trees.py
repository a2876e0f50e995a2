"""Explain and expand: why a subject holds a relation, and what a relation consists of.

Expand shows one level. ``expand_rows`` does so for many objects in one plan, a
row for each entry of a leaf; the tree of one object is made of its rows.
Explain resolves one request; its facts (the tuples that can matter: usersets,
links, the subject's own and the wildcard's) are fetched for all objects of a
level at once, as long as a level is no larger than the trace may become, and
after that object by object as the trace reaches them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relgrove.functions.userset import is_userset, is_wildcard, subject_object
from relgrove.operators.common import checkpointed, union_of
from relgrove.operators.forward import ResolutionTooDeep
from relgrove.plans.analysis import MAX_DEPTH, Analysis
from relgrove.plans.model import WILDCARD, Computed, Difference, Expr, FromLink, Intersection, This, Union, children, walk

#: Nodes of a trace, unless a call or the setting says otherwise. Leaves of a tree have no limit of their own.
MAX_NODES = 100
NODES_SETTING, LEAF_SETTING = "spark.relgrove.explain.nodes", "spark.relgrove.expand.leaf"
#: How many objects' facts explain fetches at once, for each node that the trace may have.
_AHEAD = 20
#: Up to so many objects are asked for by a filter on their ids, more by a join.
_LITERALS = 200


def _text(relation: str = "") -> Column:
    return F.concat_ws(":", "subject_type", "subject_id") if not relation else F.concat(F.concat_ws(":", "subject_type", "subject_id"), F.lit(f"#{relation}"))


def expand_users(tuples: DataFrame, object_type: str, relation: str, cap: int | None = None) -> DataFrame:
    """(object_id, users, users_truncated) for all objects: the subjects of a relation's tuples by type and id, all or up to a cap.

    Without a cap, an object's users are one row; ``expand_rows`` has a row for each.
    """
    rows = tuples.where((F.col("object_type") == object_type) & (F.col("relation") == relation))
    users = rows.select("object_id", "subject_type", "subject_id").distinct()
    if cap is not None:  # a task ranks its own rows of an object first, and passes on cap + 1 of them at most
        users = users.withColumn("k", F.row_number().over(Window.partitionBy("object_id").orderBy("subject_type", "subject_id"))).where(F.col("k") <= cap + 1)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("subject_type", "subject_id"))), lambda x: F.concat_ws(":", x["subject_type"], x["subject_id"]))
    grouped = users.groupBy("object_id").agg(in_order.alias("a"))
    if cap is None:
        return grouped.select("object_id", F.col("a").alias("users"), F.lit(False).alias("users_truncated"))
    return grouped.select("object_id", F.slice("a", 1, cap).alias("users"), (F.size("a") > cap).alias("users_truncated"))


def expand_links(tuples: DataFrame, analysis: Analysis, object_type: str, link: str, relation: str) -> DataFrame:
    """(object_id, computed) for all objects: a pointer ``type:id#relation`` for each linked object, sorted."""
    kinds = analysis.model.link_types(object_type, link)
    rows = tuples.where((F.col("object_type") == object_type) & (F.col("relation") == link) & F.col("subject_type").isin(*kinds) & ~is_userset("subject_id"))
    pointers = rows.select("object_id", _text(relation).alias("u")).distinct()
    return pointers.groupBy("object_id").agg(F.sort_array(F.collect_list("u")).alias("computed"))


def leaves(e: Expr) -> Iterator[Expr]:
    """The leaves of an expression, from left to right."""
    below = children(e)
    if not below:
        yield e
    for c in below:
        yield from leaves(c)


def expand_rows(tuples: DataFrame, analysis: Analysis, object_type: str, relation: str, objects: DataFrame | None = None, subject_type: str | None = None) -> DataFrame:
    """(object_id, leaf, kind, subject_type, value): the entries of all leaves of a relation's tree, for many objects at once.

    leaf counts the leaves of the expression from left to right, from 0. Kinds:
    ``user`` (a subject of the relation's own tuples as text), ``computed`` (a
    pointer to another relation of the object), ``link`` (a pointer to a
    relation of a linked object). objects (object_id): else all that occur.
    """
    model = analysis.model
    of = tuples.where(F.col("object_type") == object_type)
    if objects is not None:
        objects = objects.select("object_id").distinct()
        of = of.join(objects, "object_id", "left_semi")
    out = []
    e = model.expr(object_type, relation)
    for k, x in enumerate(leaves(e) if e is not None else ()):
        if isinstance(x, Computed):
            ids = of.select("object_id").distinct() if objects is None else objects
            value = F.concat(F.lit(f"{object_type}:"), "object_id", F.lit(f"#{x.relation}"))
            out.append(ids.select("object_id", F.lit(k).alias("leaf"), F.lit("computed").alias("kind"), F.lit(object_type).alias("subject_type"), value.alias("value")))
            continue
        if isinstance(x, This):
            rows, kind, value = of.where((F.col("relation") == relation) & F.col("subject_type").isin(*{r.type for r in x.refs})), "user", _text()
            if subject_type:
                rows = rows.where(F.col("subject_type") == subject_type.partition("#")[0])
        else:
            rows = of.where((F.col("relation") == x.link) & F.col("subject_type").isin(*model.link_types(object_type, x.link)) & ~is_userset("subject_id") & ~is_wildcard("subject_id"))
            kind, value = "link", _text(x.relation)
        out.append(rows.select("object_id", F.lit(k).alias("leaf"), F.lit(kind).alias("kind"), "subject_type", value.alias("value")).distinct())
    if not out:
        return of.select("object_id", F.lit(0).alias("leaf"), F.lit("user").alias("kind"), "subject_type", F.lit("").alias("value")).where("false")
    return union_of(out)


class _Stop(Exception):
    """The trace has as many nodes as it may."""


class Trees:
    """Builds traces (explain) and userset trees (expand) as dicts ready for JSON."""

    def __init__(self, analysis: Analysis, tuples: DataFrame, max_depth: int = MAX_DEPTH):
        self.analysis, self.model, self.tuples, self.max_depth = analysis, analysis.model, tuples, max_depth

    def _setting(self, name: str, given: int | None, default: int | None) -> int | None:
        if given is not None:
            return given
        value = self.tuples.sparkSession.conf.get(name, None)
        return default if value is None else int(value)

    # -- expand ---------------------------------------------------------------

    def expand(self, object_type: str, object_id: str, relation: str, subject_type: str | None = None, max_leaf: int | None = None) -> dict:
        """One level of a relation as a userset tree; unknown relations are an empty leaf.

        max_leaf, or else the setting, limits the users of each leaf; without
        both all are listed.
        """
        name = f"{object_type}:{object_id}#{relation}"
        e = self.model.expr(object_type, relation)
        if e is None:
            return {"root": {"name": name, "leaf": {"users": {"users": []}}}}
        cap = self._setting(LEAF_SETTING, max_leaf, None)
        one = self.tuples.sparkSession.createDataFrame([(object_id,)], "object_id string")
        rows = expand_rows(self.tuples, self.analysis, object_type, relation, one, subject_type)
        if cap is not None:
            within = Window.partitionBy("leaf").orderBy("subject_type", "value")
            rows = rows.withColumn("k", F.row_number().over(within)).where((F.col("kind") != "user") | (F.col("k") <= cap + 1))
        found: dict[int, list[str]] = defaultdict(list)
        for x in sorted(rows.collect(), key=lambda x: (x["leaf"], x["subject_type"], x["value"])):
            found[x["leaf"]].append(x["value"])
        numbers = iter(range(1 << 30))
        return {"root": self._tree(f"{object_type}:{object_id}", name, e, numbers, found, cap)}

    def _tree(self, obj: str, name: str, e: Expr, numbers: Iterator[int], found: dict[int, list[str]], cap: int | None) -> dict:
        below = [self._tree(obj, name, c, numbers, found, cap) for c in children(e)]
        if isinstance(e, Difference):
            return {"name": name, "difference": {"base": below[0], "subtract": below[1]}}
        if below:
            return {"name": name, "union" if isinstance(e, Union) else "intersection": {"nodes": below}}
        values = found.get(next(numbers), [])
        if isinstance(e, This):
            more = {"users_truncated": True} if cap is not None and len(values) > cap else {}
            return {"name": name, "leaf": {"users": {"users": values[:cap]} | more}}
        if isinstance(e, Computed):
            return {"name": name, "leaf": {"computed": {"userset": values[0]}}}
        return {"name": name, "leaf": {"tuple_to_userset": {"tupleset": f"{obj}#{e.link}", "computed": [{"userset": v} for v in values]}}}

    def reached_users(self, asked: DataFrame, relation_of: list[tuple[str, str]], subject_type: str | None = None) -> DataFrame:
        """(user): all that expanding pointers reaches from ``asked`` (object_type, object_id, relation), which is of the given (type, relation) pairs.

        Usersets and wildcards stay strings, subtracted sides are left out. A
        level of pointers is one job over all of them, and none comes to the driver.
        """
        key = ["object_type", "object_id", "relation"]
        front = checkpointed(asked.select(*key).distinct())
        seen, users, nodes = front, [], set(relation_of)
        while not front.isEmpty():
            pointers, below = [], set()
            for t, r in sorted(nodes):
                e = self.model.expr(t, r)
                if e is None:
                    continue
                counted = _granting(e)
                rows = expand_rows(self.tuples, self.analysis, t, r, front.where((F.col("object_type") == t) & (F.col("relation") == r)), subject_type)
                rows = rows.where(F.col("leaf").isin(counted))
                users.append(rows.where("kind = 'user'").select(F.col("value").alias("user")))
                at = F.length("value") - F.length(F.substring_index("value", "#", -1))  # of the last #
                split = [F.col("subject_type").alias("object_type"), F.expr("substring(value, length(subject_type) + 2)").alias("rest")]
                pointers.append(rows.where("kind != 'user'").withColumn("at", at - F.length("subject_type") - 1).select(*split, "at").selectExpr("object_type", "substring(rest, 1, at - 1) AS object_id", "substring(rest, at + 1) AS relation"))
                below |= set(self._pointed(t, r, e))
            if not pointers:
                break
            front, nodes = checkpointed(union_of(pointers).distinct().join(seen, key, "left_anti")), below
            seen = seen.unionByName(front)
        if not users:
            return asked.select(F.lit("").alias("user")).where("false")
        return union_of(users).distinct()

    def _pointed(self, t: str, r: str, e: Expr) -> Iterator[tuple[str, str]]:
        for x in walk(e):
            if isinstance(x, Computed):
                yield t, x.relation
            elif isinstance(x, FromLink):
                yield from ((p, x.relation) for p in self.model.link_types(t, x.link))

    def expand_recursive(self, object_type: str, object_id: str, relation: str, subject_type: str | None = None) -> list[str]:
        """All users that expanding pointers reaches, sorted. Usersets and wildcards stay strings, subtracted sides are left out."""
        one = self.tuples.sparkSession.createDataFrame([(object_type, object_id, relation)], "object_type string, object_id string, relation string")
        return sorted(x[0] for x in self.reached_users(one, [(object_type, relation)], subject_type).collect())

    # -- explain --------------------------------------------------------------

    def explain(self, subject_type: str, subject_id: str, relation: str, object_type: str, object_id: str, max_nodes: int | None = None) -> dict:
        """The trace of one check: each branch tried, its outcome and the tuples that prove it."""
        cap = self._setting(NODES_SETTING, max_nodes, MAX_NODES)
        out = {"object": f"{object_type}:{object_id}", "relation": relation, "subject": f"{subject_type}:{subject_id}"}
        if self.model.expr(object_type, relation) is None:
            return out | {"result": False, "root": {"type": "union", "label": "unknown relation", "result": False}, "node_count": 1}
        facts = _Facts(self, (subject_type, subject_id), cap)
        facts.ahead((object_type, object_id))
        run = _Explain(self, (subject_type, subject_id), facts, cap)
        try:
            root = run.relation(object_type, object_id, relation, ())
        except _Stop:
            root = {"type": "truncated", "label": f"more than {cap} nodes"}
        return out | {"result": root.get("result", False), "root": root} | ({"truncated": True} if run.count > cap else {}) | {"node_count": run.count}

    def check(self, *request: str) -> int:
        """1 or 0 by the same resolution, without a limit of nodes; also for relations that subtract themselves."""
        return int(bool(self.explain(*request, max_nodes=1 << 30)["result"]))


def _granting(e: Expr) -> list[int]:
    """The numbers of the leaves that are on no subtracted side."""
    out, k = [], 0

    def add(x: Expr, counts: bool) -> None:
        nonlocal k
        below = children(x)
        if not below:
            out.extend([k] * counts)
            k += 1
        for j, c in enumerate(below):
            add(c, counts and not (isinstance(x, Difference) and j))

    add(e, True)
    return out


class _Facts:
    """The tuples that can matter to one request, by object, as far as the trace needs them."""

    def __init__(self, trees: Trees, subject: tuple[str, str], cap: int):
        self.trees, self.cap = trees, cap
        links = sorted({x.link for n in trees.model.nodes() for x in walk(trees.model.expr(*n)) if isinstance(x, FromLink)})
        own = (F.col("subject_type") == subject[0]) & ((F.col("subject_id") == subject[1]) | is_wildcard("subject_id"))
        # a trace of cap nodes tries no more than cap usersets or links of one object and relation
        rank = F.row_number().over(Window.partitionBy("object_type", "object_id", "relation").orderBy(F.desc(own.cast("int")), "subject_type", "subject_id"))
        useful = trees.tuples.where(own | is_userset("subject_id") | F.col("relation").isin(*links))
        self.useful, self.rank = useful, rank
        self.known: dict[tuple[str, str], dict[str, list[tuple[str, str]]]] = {}

    def _load(self, objects: set[tuple[str, str]], limit: int | None = None) -> list | None:
        """The rows of the objects; None if there are more than the limit."""
        if len(objects) <= _LITERALS:  # as a filter, so that a scan reads no more than it must
            ids: dict[str, list[str]] = defaultdict(list)
            for t, o in sorted(objects):
                ids[t].append(o)
            rows = self.useful.where(reduce(or_, ((F.col("object_type") == t) & F.col("object_id").isin(*own) for t, own in ids.items())))
        else:
            asked = self.trees.tuples.sparkSession.createDataFrame(sorted(objects), "object_type string, object_id string")
            rows = self.useful.join(asked, ["object_type", "object_id"])
        rows = rows.select("object_type", "object_id", "relation", "subject_type", "subject_id").distinct()
        if self.cap < 1 << 29:
            rows = rows.withColumn("k", self.rank).where(F.col("k") <= self.cap + 2).drop("k")
        found = (rows if limit is None else rows.limit(limit + 1)).collect()
        if limit is not None and len(found) > limit:
            return None
        for o in objects:
            self.known[o] = defaultdict(list)
        for t, o, r, st, sid in sorted(map(tuple, found)):
            self.known[t, o][r].append((st, sid))
        return found

    def ahead(self, start: tuple[str, str]) -> None:
        """Fetches level by level, until a level is too large for a trace of so many nodes."""
        front, limit = {start}, min(_AHEAD * self.cap, 1 << 30)
        for _ in range(self.trees.max_depth + 1):
            front -= self.known.keys()
            if not front or len(front) > limit:
                return
            found = self._load(front, limit)
            if found is None:
                return
            front = {(x[3], x[4].partition("#")[0]) for x in found if x[4] != WILDCARD}

    def rows(self, t: str, o: str, r: str) -> list[tuple[str, str]]:
        if (t, o) not in self.known:
            self._load({(t, o)})
        return self.known[t, o].get(r, [])


class _Explain:
    def __init__(self, trees: Trees, subject: tuple[str, str], facts: _Facts, cap: int):
        self.trees, self.model, self.closure, self.facts, self.cap, self.count = trees, trees.model, trees.analysis.closure, facts, cap, 0
        self.type, self.id = subject
        self.object, _, self.rel = self.id.partition("#")

    def node(self, kind: str, label: str, result: bool | None = None, **more) -> dict:
        self.count += 1
        if self.count > self.cap:
            raise _Stop
        out = {"type": kind, "label": label}
        if result is not None:
            out["result"] = result
        return out | {k: v for k, v in more.items() if v}

    def evidence(self, t: str, o: str, r: str, s: tuple[str, str]) -> list[dict]:
        return [{"subject_type": s[0], "subject_id": s[1], "relation": r, "object_type": t, "object_id": o}]

    def relation(self, t: str, o: str, r: str, path: tuple) -> dict:
        """The trace of one relation on one object."""
        key, label = (t, o, r), f"{t}:{o}#{r}"
        if key in path:
            return self.node("cycle", label)
        if len(path) >= self.trees.max_depth:
            raise ResolutionTooDeep(f"no answer within {self.trees.max_depth} steps")
        if self.rel and t == self.type and o == self.object and self.rel in self.closure[t, r]:
            return self.node("implied", f"{self.type}:{self.id} is a userset of {label}", True)
        return self.expr(t, o, r, self.model.expr(t, r), (*path, key), label)

    def any_of(self, kind: str, label: str, tries) -> dict:
        """Tries until one holds; a failure shows all of them."""
        failed = []
        for one in tries:
            if one.get("result"):
                return one
            failed.append(one)
        return failed[0] if len(failed) == 1 else self.node(kind, label, False, children=failed)

    def expr(self, t, o, r, e, path, label) -> dict:
        if isinstance(e, This):
            return self.any_of("union", label, self.this(t, o, r, e, path))
        if isinstance(e, Computed):
            below = self.relation(t, o, e.relation, path)
            return self.node("implied", f"{label} from {e.relation}", bool(below.get("result")), children=[below])
        if isinstance(e, FromLink):
            return self.any_of("union", label, self.links(t, o, e, path))
        if isinstance(e, Union):
            return self.any_of("union", label, (self.expr(t, o, r, p, path, label) for p in e.parts))
        if isinstance(e, Intersection):
            below = []
            for p in e.parts:
                below.append(self.expr(t, o, r, p, path, label))
                if not below[-1].get("result"):
                    break
            return self.node("intersection", label, all(b.get("result") for b in below), children=below)
        base = self.expr(t, o, r, e.base, path, label)
        if not base.get("result"):
            return base
        minus = self.expr(t, o, r, e.subtract, path, label)
        return self.node("exclusion", label, not minus.get("result"), children=[base, minus])

    def this(self, t, o, r, e: This, path):
        rows = self.facts.rows(t, o, r)
        plain = any(x.type == self.type and not x.relation and not x.wildcard for x in e.refs)
        star = any(x.type == self.type and x.wildcard for x in e.refs)
        if plain or star:
            me = (self.type, self.id)
            held = me in rows and not self.rel and (star if self.id == WILDCARD else plain)
            yield self.node("direct", f"{t}:{o}#{r}", held, evidence=self.evidence(t, o, r, me) if held else None)
            if star and not held and not self.rel and (self.type, WILDCARD) in rows:
                yield self.node("wildcard", f"{self.type}:*", True, evidence=self.evidence(t, o, r, (self.type, WILDCARD)), users=[{"type": self.type, "id": WILDCARD}])
        for x in e.refs:
            if x.relation:
                for s in rows:
                    via, _, rel = s[1].partition("#")
                    if s[0] == x.type and rel == x.relation:
                        below = self.relation(s[0], via, rel, path)
                        yield self.node("userset", f"{s[0]}:{s[1]}", bool(below.get("result")), evidence=self.evidence(t, o, r, s), children=[below])

    def links(self, t, o, e: FromLink, path):
        kinds = [k for k in self.model.link_types(t, e.link) if self.model.expr(k, e.relation) is not None]
        any_link = False
        for s in self.facts.rows(t, o, e.link):
            if s[0] in kinds and "#" not in s[1] and s[1] != WILDCARD:
                any_link = True
                below = self.relation(s[0], s[1], e.relation, path)
                yield self.node("ttu", f"{e.relation} from {e.link}", bool(below.get("result")), evidence=self.evidence(t, o, e.link, s), children=[below])
        if not any_link:
            yield self.node("ttu", f"{e.relation} from {e.link}", False)


def flatten(node: dict) -> tuple[list[str], list[str]]:
    """(users, pointers) of an expanded tree; of a difference only the base counts."""
    users, pointers = [], []
    leaf = node.get("leaf", {})
    users += leaf.get("users", {}).get("users", [])
    pointers += [leaf["computed"]["userset"]] if "computed" in leaf else []
    pointers += [c["userset"] for c in leaf.get("tuple_to_userset", {}).get("computed", [])]
    below = node.get("union", node.get("intersection", {})).get("nodes", [])
    for n in [*below, *([node["difference"]["base"]] if "difference" in node else [])]:
        u, p = flatten(n)
        users, pointers = users + u, pointers + p
    return users, pointers


_MARK = {True: "+", False: "-", None: "?"}


def render_trace(trace: dict) -> str:
    """A trace as indented text."""
    lines = [f"{trace['subject']} {trace['relation']} {trace['object']}: {'allowed' if trace['result'] else 'denied'}" + " (truncated)" * trace.get("truncated", False)]

    def add(node: dict, depth: int) -> None:
        proof = "".join(f"  <{x['subject_type']}:{x['subject_id']} {x['relation']} {x['object_type']}:{x['object_id']}>" for x in node.get("evidence", []))
        lines.append(f"{'  ' * depth}{_MARK[node.get('result')]} {node['type']} {node['label']}{proof}")
        for c in node.get("children", []):
            add(c, depth + 1)

    add(trace["root"], 1)
    return "\n".join(lines)


def render_expand(tree: dict) -> str:
    """A userset tree as indented text."""
    lines = []

    def add(node: dict, depth: int) -> None:
        pad = "  " * depth
        if "leaf" in node:
            users, pointers = flatten(node)
            lines.append(pad + ", ".join([*users, *(f"-> {p}" for p in pointers)] or ["(nobody)"]))
            return
        kind = next(k for k in ("union", "intersection", "difference") if k in node)
        lines.append(pad + kind)
        for c in node[kind].get("nodes") or [node[kind]["base"], node[kind]["subtract"]]:
            add(c, depth + 1)

    lines.append(tree["root"]["name"])
    add(tree["root"], 1)
    return "\n".join(lines)


def objects_seen(tuples: DataFrame, kind: str) -> DataFrame:
    """(object_id): all ids of a type that occur as object or subject."""
    as_object = tuples.where(F.col("object_type") == kind).select("object_id")
    as_subject = tuples.where((F.col("subject_type") == kind) & ~is_wildcard("subject_id")).select(subject_object("subject_id").alias("object_id"))
    return as_object.unionByName(as_subject).distinct()
