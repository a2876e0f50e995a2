"""The client: checks with decisions, cache and validation, lists, bulk checks, explain and expand."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from relgrove.operators.forward import ResolutionTooDeep
from relgrove.operators.trees import Trees
from relgrove.operators.verbs import Engine
from relgrove.plans.analysis import UnstratifiedSchema
from relgrove.plans.model import WILDCARD
from relgrove.sources.tuples import SCHEMA, tuples_from_rows

ALLOW, DENY, UNSET = "allow", "deny", None
MAX_BULK = 10_000


class InvalidRequest(ValueError):
    """A request that the model can't answer (code 2000)."""

    code = 2000


class UnknownType(InvalidRequest):
    """A type or relation that the model doesn't have (code 2001)."""

    code = 2001


class Denied(PermissionError):
    """must() was denied."""


@dataclass(frozen=True)
class Object:
    """An object or a subject: ``type:id``."""

    type: str
    id: str

    def __str__(self) -> str:
        return f"{self.type}:{self.id}"

    @classmethod
    def of(cls, x: Object | str) -> Object:
        if isinstance(x, Object):
            return x
        kind, colon, ident = str(x).partition(":")
        if not (colon and kind and ident):
            raise InvalidRequest(f"not of the form type:id: {x!r}")
        return cls(kind, ident)


@dataclass(frozen=True)
class Page:
    """A page of a list: up to ``limit`` ids after a cursor."""

    limit: int = 0
    after: str | None = None


class Cache:
    """Results by key for a while. Errors are never kept."""

    def __init__(self, ttl: float = 60.0, clock=time.monotonic):
        self.ttl, self.clock, self.items = ttl, clock, {}

    def get(self, key):
        found = self.items.get(key)
        if found is None or self.ttl and self.clock() - found[1] > self.ttl:
            self.items.pop(key, None)
            return None
        return found[0]

    def set(self, key, value) -> None:
        self.items[key] = (value, self.clock())

    def clear(self) -> None:
        self.items.clear()

    def __len__(self) -> int:
        return len(self.items)


def _validate(engine: Engine, subject: Object, relation: str | None, obj_type: str | None, strict: bool) -> None:
    model = engine.analysis.model
    if "#" in subject.id:
        ident, _, rel = subject.id.partition("#")
        if not ident or not rel or ident == WILDCARD:
            raise InvalidRequest(f"not a userset: {subject}")
        if strict and model.expr(subject.type, rel) is None:
            raise UnknownType(f"unknown userset {subject.type}#{rel}")
    if strict and subject.type not in model.types:
        raise UnknownType(f"unknown subject type {subject.type}")
    if strict and obj_type is not None and model.expr(obj_type, relation) is None:
        raise UnknownType(f"unknown relation {obj_type}#{relation}")


@dataclass(frozen=True)
class Checker:
    """Asks an engine.

    decision: overrides all checks (and, if it denies, lists). ``with_decision``
    makes a checker for one context, whose decision goes first. strict: unknown
    types and relations raise instead of being denied.
    """

    engine: Engine
    cache: Cache | None = None
    decision: str | None = UNSET
    context_decision: str | None = UNSET
    strict: bool = False

    def with_decision(self, decision: str | None) -> Checker:
        return replace(self, context_decision=decision)

    def _decided(self) -> str | None:
        return self.context_decision or self.decision

    def _tuples(self, contextual) -> list | None:
        if not contextual:
            return None
        rows = [tuple(map(str, r)) for r in contextual]
        model = self.engine.analysis.model
        for st, sid, r, ot, oid in rows:
            if not all((st, sid, r, ot, oid)):
                raise InvalidRequest("a contextual tuple has an empty field")
            rel, star = sid.partition("#")[2], sid == WILDCARD
            if not any(x.type == st and x.relation == rel and x.wildcard == star for x in model.refs(ot, r)):
                raise InvalidRequest(f"the model doesn't take {st}:{sid} as {r} of {ot}")
        return rows

    def check(self, subject, relation: str, obj, contextual=None) -> bool:
        if (d := self._decided()) is not None:
            return d == ALLOW
        s, o = Object.of(subject), Object.of(obj)
        _validate(self.engine, s, relation, o.type, self.strict)
        key = ("check", s, relation, o)
        if self.cache is not None and not contextual and (found := self.cache.get(key)) is not None:
            return found
        request = (s.type, s.id, relation, o.type, o.id)
        rows = self._tuples(contextual)
        try:
            held = bool(self.engine.check(*request, contextual=rows))
        except UnstratifiedSchema:  # resolved path by path, as sets can't
            held = bool(self._trees(rows).check(*request))
        if self.cache is not None and not contextual:
            self.cache.set(key, held)
        return held

    def must(self, subject, relation: str, obj, contextual=None) -> None:
        if not self.check(subject, relation, obj, contextual):
            raise Denied(f"{subject} is not {relation} of {obj}")

    def list_objects(self, subject, relation: str, object_type: str, page: Page = Page(), contextual=None) -> tuple[list[str], str | None]:
        """(ids, cursor of the next page or None)."""
        if self._decided() == DENY:
            return [], None
        s = Object.of(subject)
        _validate(self.engine, s, relation, object_type, self.strict)
        rows = self.engine.list_objects(s.type, s.id, relation, object_type, page.limit, page.after, self._tuples(contextual)).collect()
        return [r["object_id"] for r in rows], rows[0]["next_cursor"] if rows else None

    def list_subjects(self, obj, relation: str, subject_type: str, page: Page = Page(), contextual=None) -> tuple[list[str], str | None]:
        """(ids, cursor of the next page or None); ``type#relation`` lists usersets."""
        if self._decided() == DENY:
            return [], None
        o = Object.of(obj)
        kind = subject_type.partition("#")[0]
        if self.strict and kind not in self.engine.analysis.model.types:
            raise UnknownType(f"unknown subject type {kind}")
        _validate(self.engine, o, relation, o.type, self.strict)
        rows = self.engine.list_subjects(o.type, o.id, relation, subject_type, page.limit, page.after, self._tuples(contextual)).collect()
        return [r["subject_id"] for r in rows], rows[0]["next_cursor"] if rows else None

    def list_all_objects(self, subject, relation: str, object_type: str, contextual=None) -> list[str]:
        return list(self.each_object(subject, relation, object_type, contextual))

    def list_all_subjects(self, obj, relation: str, subject_type: str, contextual=None) -> list[str]:
        return list(self.each_subject(obj, relation, subject_type, contextual))

    def each_object(self, subject, relation: str, object_type: str, contextual=None) -> Iterator[str]:
        """All ids, a partition of them at a time on the driver: evaluated once, where pages would be evaluated each anew."""
        if self._decided() == DENY:
            return
        s = Object.of(subject)
        _validate(self.engine, s, relation, object_type, self.strict)
        for row in self.engine.list_objects(s.type, s.id, relation, object_type, contextual=self._tuples(contextual)).toLocalIterator():
            yield row["object_id"]

    def each_subject(self, obj, relation: str, subject_type: str, contextual=None) -> Iterator[str]:
        """All ids, the wildcard first, a partition of them at a time on the driver."""
        if self._decided() == DENY:
            return
        o = Object.of(obj)
        if self.strict and subject_type.partition("#")[0] not in self.engine.analysis.model.types:
            raise UnknownType(f"unknown subject type {subject_type}")
        _validate(self.engine, o, relation, o.type, self.strict)
        for row in self.engine.list_subjects(o.type, o.id, relation, subject_type, contextual=self._tuples(contextual)).toLocalIterator():
            yield row["subject_id"]

    def _trees(self, rows=None) -> Trees:
        tuples = self.engine.tuples if rows is None else self.engine.tuples.select(*SCHEMA.names).unionByName(tuples_from_rows(self.engine.tuples.sparkSession, rows))
        return Trees(self.engine.analysis, tuples, self.engine.max_depth)

    def explain(self, subject, relation: str, obj, max_nodes: int | None = None) -> dict:
        s, o = Object.of(subject), Object.of(obj)
        return self._cached(("explain", s, relation, o, max_nodes), lambda: self._trees().explain(s.type, s.id, relation, o.type, o.id, max_nodes))

    def expand(self, obj, relation: str, subject_type: str | None = None, max_leaf: int | None = None) -> dict:
        o = Object.of(obj)
        return self._cached(("expand", o, relation, subject_type, max_leaf), lambda: self._trees().expand(o.type, o.id, relation, subject_type, max_leaf))

    def expand_recursive(self, obj, relation: str, subject_type: str | None = None) -> list[str]:
        o = Object.of(obj)
        return self._trees().expand_recursive(o.type, o.id, relation, subject_type)

    def _cached(self, key, make):
        if self.cache is None:
            return make()
        found = self.cache.get(key)
        if found is None:
            found = make()
            self.cache.set(key, found)
        return found

    def bulk(self) -> BulkCheck:
        return BulkCheck(self)


@dataclass
class BulkResult:
    id: str
    subject: Object
    relation: str
    object: Object
    allowed: bool = False
    error: Exception | None = None


@dataclass
class BulkResults:
    items: list[BulkResult]

    def all(self) -> bool:
        """Whether all are allowed; of no checks, no."""
        return bool(self.items) and all(r.allowed for r in self.items)

    def any(self) -> bool:
        return any(r.allowed for r in self.items)

    def none(self) -> bool:
        return not self.any()

    def allowed(self) -> list[BulkResult]:
        return [r for r in self.items if r.allowed]

    def denied(self) -> list[BulkResult]:
        return [r for r in self.items if not r.allowed]

    def errors(self) -> list[BulkResult]:
        return [r for r in self.items if r.error is not None]

    def get(self, ident: str) -> BulkResult | None:
        return next((r for r in self.items if r.id == ident), None)

    def all_or_error(self) -> None:
        for r in self.items:
            if r.error is not None:
                raise r.error
            if not r.allowed:
                raise Denied(f"{r.subject} is not {r.relation} of {r.object}")


@dataclass
class BulkCheck:
    """Collects checks and answers them in one job."""

    checker: Checker
    items: list[BulkResult] = field(default_factory=list)
    contextual: tuple = ()

    def add(self, subject, relation: str, obj, ident: str | None = None) -> BulkCheck:
        if len(self.items) >= MAX_BULK:
            raise InvalidRequest(f"more than {MAX_BULK} checks; use Engine.check_bulk with a DataFrame")
        ident = str(len(self.items)) if ident is None else ident
        if any(r.id == ident for r in self.items):
            raise InvalidRequest(f"two checks have the id {ident!r}")
        self.items.append(BulkResult(ident, Object.of(subject), relation, Object.of(obj)))
        return self

    def add_many(self, subject, relation: str, objects: Iterable) -> BulkCheck:
        for o in objects:
            self.add(subject, relation, o)
        return self

    def with_contextual(self, *tuples) -> BulkCheck:
        """Tuples (subject type, subject id, relation, object type, object id) that count for this batch only."""
        self.contextual += tuples
        return self

    def execute(self) -> BulkResults:
        """A request that can't be answered has an error of its own; the others are answered. Batches with contextual tuples leave the cache alone."""
        c = self.checker
        if (d := c._decided()) is not None:
            return BulkResults([replace(r, allowed=d == ALLOW) for r in self.items])
        extra = c._tuples(self.contextual)
        cache = c.cache if extra is None else None
        known: dict[tuple, bool | Exception] = {}
        for r in self.items:
            key = ("check", r.subject, r.relation, r.object)
            try:
                _validate(c.engine, r.subject, r.relation, r.object.type, c.strict)
            except InvalidRequest as e:
                r.error = e
                continue
            if cache is not None and (found := cache.get(key)) is not None:
                known[key] = found
        open_keys = list(dict.fromkeys(k for r in self.items if r.error is None and (k := ("check", r.subject, r.relation, r.object)) not in known))
        by_path = {k for k in open_keys if not c.engine.analysis.stratified((k[3].type, k[2]))}
        known |= self._at_once([k for k in open_keys if k not in by_path], extra)
        for k in by_path:  # as sets can't resolve them
            try:
                known[k] = bool(c._trees(extra).check(k[1].type, k[1].id, k[2], k[3].type, k[3].id))
            except ResolutionTooDeep as e:
                known[k] = e
        for k in open_keys:
            if cache is not None and not isinstance(known[k], Exception):
                cache.set(k, known[k])
        for r in self.items:
            found = known.get(("check", r.subject, r.relation, r.object), False)
            if isinstance(found, Exception):
                r.error = r.error or found
            r.allowed = r.error is None and found is True
        return BulkResults(self.items)

    def _at_once(self, keys: list[tuple], extra: list | None) -> dict[tuple, bool | Exception]:
        """The answers of one job."""
        if not keys:
            return {}
        engine = self.checker.engine
        rows = [(i, s.type, s.id, rel, o.type, o.id) for i, (_, s, rel, o) in enumerate(keys)]
        schema = "idx int, subject_type string, subject_id string, relation string, object_type string, object_id string"
        pairs = sorted({(o.type, rel) for _, _, rel, o in keys if engine.analysis.model.expr(o.type, rel) is not None})
        asked = engine.tuples.sparkSession.createDataFrame(rows, schema)
        too_deep = ResolutionTooDeep(f"no answer within {engine.max_depth} steps")
        return {keys[row["idx"]]: too_deep if row["error"] else bool(row["allowed"]) for row in engine.check_bulk(asked, extra, pairs, errors=True).collect()}


def errors_by_code() -> dict[int, type[Exception]]:
    return {e.code: e for e in (InvalidRequest, UnknownType, ResolutionTooDeep)}
