"""The authorization model: types, relations, and each relation's expression tree.

The tree is kept as written. Evaluation walks it, so grouping, nesting and the
order of operands mean what they mean in the schema.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

WILDCARD = "*"


@dataclass(frozen=True)
class SubjectRef:
    """A subject that a relation takes directly: ``type``, ``type#relation`` or ``type:*``."""

    type: str
    relation: str = ""
    wildcard: bool = False

    def __str__(self) -> str:
        return self.type + (f"#{self.relation}" if self.relation else ":*" if self.wildcard else "")


@dataclass(frozen=True)
class This:
    """Direct grants: tuples of the relation itself, from subjects of the listed kinds."""

    refs: tuple[SubjectRef, ...]


@dataclass(frozen=True)
class Computed:
    """Another relation of the same object."""

    relation: str


@dataclass(frozen=True)
class FromLink:
    """``relation`` on the objects that ``link`` tuples name."""

    relation: str
    link: str


@dataclass(frozen=True)
class Union:
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Intersection:
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Difference:
    base: Expr
    subtract: Expr


Expr = This | Computed | FromLink | Union | Intersection | Difference


def children(e: Expr) -> tuple[Expr, ...]:
    if isinstance(e, Union | Intersection):
        return e.parts
    return (e.base, e.subtract) if isinstance(e, Difference) else ()


def walk(e: Expr) -> Iterator[Expr]:
    """``e`` and all expressions below it."""
    yield e
    for c in children(e):
        yield from walk(c)


def to_dsl(e: Expr, top: bool = True) -> str:
    if isinstance(e, This):
        return "[" + ", ".join(map(str, e.refs)) + "]"
    if isinstance(e, Computed):
        return e.relation
    if isinstance(e, FromLink):
        return f"{e.relation} from {e.link}"
    word = {Union: " or ", Intersection: " and ", Difference: " but not "}[type(e)]
    text = word.join(to_dsl(c, False) for c in children(e))
    return text if top else f"({text})"


@dataclass(frozen=True)
class TypeDef:
    name: str
    relations: dict[str, Expr] = field(default_factory=dict)


class UnknownName(ValueError):
    """A schema names a type or a relation that it does not define."""


@dataclass(frozen=True)
class Model:
    types: dict[str, TypeDef]
    schema_version: str = "1.1"

    def expr(self, type_name: str, relation: str) -> Expr | None:
        t = self.types.get(type_name)
        return t.relations.get(relation) if t else None

    def nodes(self) -> list[tuple[str, str]]:
        """All (type, relation)."""
        return [(t.name, r) for t in self.types.values() for r in t.relations]

    def refs(self, type_name: str, relation: str) -> tuple[SubjectRef, ...]:
        """The subjects that a relation takes directly."""
        e = self.expr(type_name, relation)
        return tuple(dict.fromkeys(r for x in walk(e) if isinstance(x, This) for r in x.refs)) if e else ()

    def link_types(self, type_name: str, link: str) -> list[str]:
        """The types of objects that tuples of a linking relation name."""
        return list(dict.fromkeys(r.type for r in self.refs(type_name, link) if not r.relation and not r.wildcard))

    def subject_types(self) -> list[str]:
        """The types that some relation takes as plain subjects or wildcards."""
        return sorted({r.type for n in self.nodes() for r in self.refs(*n) if not r.relation})

    def relation_subjects(self, type_name: str, relation: str) -> list[str]:
        """The types of plain subjects that a relation takes directly."""
        return sorted({r.type for r in self.refs(type_name, relation) if not r.relation})

    def check_names(self) -> None:
        for t, r in self.nodes():
            for x in walk(self.expr(t, r)):
                if isinstance(x, This):
                    for ref in x.refs:
                        if ref.type not in self.types:
                            raise UnknownName(f"{t}.{r}: type {ref.type} is not defined")
                        if ref.relation and self.expr(ref.type, ref.relation) is None:
                            raise UnknownName(f"{t}.{r}: relation {ref} is not defined")
                elif isinstance(x, Computed) and self.expr(t, x.relation) is None:
                    raise UnknownName(f"{t}.{r}: relation {x.relation} is not defined")
                elif isinstance(x, FromLink):
                    if self.expr(t, x.link) is None:
                        raise UnknownName(f"{t}.{r}: linking relation {x.link} is not defined")
                    if not any(self.expr(p, x.relation) is not None for p in self.link_types(t, x.link)):
                        raise UnknownName(f"{t}.{r}: no type that {x.link} names has a relation {x.relation}")

    def to_dsl(self) -> str:
        lines = ["model", f"  schema {self.schema_version}"]
        for t in self.types.values():
            lines += ["", f"type {t.name}"] + ["  relations"] * bool(t.relations)
            lines += [f"    define {r}: {to_dsl(e)}" for r, e in t.relations.items()]
        return "\n".join(lines) + "\n"
