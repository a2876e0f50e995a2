"""Parser of the schema language, by recursive descent over tokens.

    expr    := operand (("or" operand)+ | ("and" operand)+ | "but not" operand)?
    operand := "[" refs "]" | name ("from" name)? | "(" expr ")"

Operators of different kinds need parentheses at one level, as the language
demands. Conditions are not supported and are refused by name.
"""

from __future__ import annotations

import re
from pathlib import Path

from relgrove.plans.model import Computed, Difference, Expr, FromLink, Intersection, Model, SubjectRef, This, TypeDef, Union


class SchemaError(ValueError):
    """The schema's text can't be read; the message has the line's number."""


_TOKEN = re.compile(r"\s*(?:([A-Za-z_][\w.\-/]*)|([\[\]():,#*]))")
_COMMENT = re.compile(r"(^|\s)#.*$")


class _Tokens:
    def __init__(self, text: str, where: str):
        self.where, self.items, at = where, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"{where}: unexpected {text[at:].strip()[:20]!r}")
            self.items.append(m.group(1) or m.group(2))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def next(self, want: str | None = None) -> str:
        t = self.peek()
        if t is None or want is not None and t != want:
            raise SchemaError(f"{self.where}: expected {want or 'more'!r}, found {t or 'the end of the line'!r}")
        self.at += 1
        return t

    def name(self) -> str:
        t = self.next()
        if not re.match(r"[A-Za-z_]", t):
            raise SchemaError(f"{self.where}: expected a name, found {t!r}")
        return t


def _ref(tokens: _Tokens) -> SubjectRef:
    kind = tokens.name()
    ref = SubjectRef(kind)
    if tokens.peek() == "#":
        tokens.next()
        ref = SubjectRef(kind, relation=tokens.name())
    elif tokens.peek() == ":":
        tokens.next()
        tokens.next("*")
        ref = SubjectRef(kind, wildcard=True)
    if tokens.peek() == "with":
        raise SchemaError(f"{tokens.where}: conditions ('with') are not supported")
    return ref


def _operand(tokens: _Tokens) -> Expr:
    if tokens.peek() == "(":
        tokens.next()
        inner = _expr(tokens)
        tokens.next(")")
        return inner
    if tokens.peek() == "[":
        tokens.next()
        refs = [_ref(tokens)]
        while tokens.peek() == ",":
            tokens.next()
            refs.append(_ref(tokens))
        tokens.next("]")
        return This(tuple(refs))
    name = tokens.name()
    if tokens.peek() == "from":
        tokens.next()
        return FromLink(name, tokens.name())
    return Computed(name)


def _expr(tokens: _Tokens) -> Expr:
    parts, word = [_operand(tokens)], None
    while tokens.peek() in ("or", "and", "but"):
        op = tokens.next()
        if op == "but":
            tokens.next("not")
        if word and (op != word or op == "but"):
            raise SchemaError(f"{tokens.where}: mixing operators needs parentheses")
        word = op
        parts.append(_operand(tokens))
    if word == "but":
        return Difference(*parts)
    return parts[0] if word is None else (Union if word == "or" else Intersection)(tuple(parts))


def parse_expression(text: str, where: str = "expression") -> Expr:
    tokens = _Tokens(text, where)
    e = _expr(tokens)
    if tokens.peek() is not None:
        raise SchemaError(f"{where}: unexpected {tokens.peek()!r}")
    return e


def _statements(text: str, name: str):
    """(place, statement) for each; a definition may go on over lines while a bracket is open."""
    held, start = "", 0
    for n, line in enumerate(text.splitlines(), 1):
        line = _COMMENT.sub("", line).rstrip()
        if not line.strip():
            continue
        held, start = (f"{held} {line.strip()}", start) if held else (line.strip(), n)
        if sum(held.count(c) for c in "([") > sum(held.count(c) for c in ")]"):
            continue
        yield f"{name}:{start}", held
        held = ""
    if held:
        raise SchemaError(f"{name}:{start}: a bracket is never closed")


def _read(text: str, name: str, types: dict[str, dict[str, Expr]], extensions: list) -> str | None:
    """Adds a file's types; returns the schema version it names."""
    version, current = None, None
    for where, line in _statements(text, name):
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        if line == "model" or word == "module" or line == "relations":
            continue
        if word == "schema":
            version = rest
        elif word == "type":
            if rest in types:
                raise SchemaError(f"{where}: type {rest} is defined twice")
            current = types.setdefault(rest, {})
        elif line.startswith("extend type "):
            current = {}
            extensions.append((where, line.removeprefix("extend type ").strip(), current))
        elif word == "define":
            relation, colon, body = rest.partition(":")
            relation = relation.strip()
            if not colon or current is None:
                raise SchemaError(f"{where}: 'define' needs a type before it and a colon")
            if relation in current:
                raise SchemaError(f"{where}: relation {relation} is defined twice")
            current[relation] = parse_expression(body.strip(), where)
        elif word == "condition":
            raise SchemaError(f"{where}: conditions are not supported")
        else:
            raise SchemaError(f"{where}: unexpected {line[:40]!r}")
    return version


def _model(files: list[tuple[str, str]], version: str | None = None) -> Model:
    types: dict[str, dict[str, Expr]] = {}
    extensions: list = []
    for name, text in files:
        version = _read(text, name, types, extensions) or version
    for where, type_name, relations in extensions:
        if type_name not in types:
            raise SchemaError(f"{where}: type {type_name} is extended, but not defined")
        if twice := set(relations) & set(types[type_name]):
            raise SchemaError(f"{where}: relations {sorted(twice)} of {type_name} are defined twice")
        types[type_name].update(relations)
    if version is None:
        raise SchemaError("no schema version is named")
    if version not in ("1.1", "1.2"):
        raise SchemaError(f"schema version {version} is not supported")
    model = Model({t: TypeDef(t, r) for t, r in types.items()}, version)
    model.check_names()
    return model


def parse(text: str) -> Model:
    """The model of a schema in one text."""
    return _model([("schema", text)])


def parse_modules(files: dict[str, str], version: str = "1.2") -> Model:
    """The model of a schema that is split into modules, by file name."""
    return _model(list(files.items()), version)


def load(path: str | Path) -> Model:
    """The model of a ``.fga`` file, or of the modules that an ``fga.mod`` file lists."""
    path = Path(path)
    if path.name != "fga.mod":
        return parse(path.read_text())
    version, names = "1.2", []
    for line in path.read_text().splitlines():
        line = _COMMENT.sub("", line).strip()
        if line.startswith("schema:"):
            version = line.partition(":")[2].strip(" '\"")
        elif line.startswith("-"):
            names.append(line[1:].strip(" '\""))
    return parse_modules({n: (path.parent / n).read_text() for n in names}, version)
