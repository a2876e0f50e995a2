"""Models in the JSON form that model services exchange: type definitions with rewrites, and the kinds of subjects beside them."""

from __future__ import annotations

import json

from relgrove.plans.dsl import SchemaError
from relgrove.plans.model import Computed, Difference, Expr, FromLink, Intersection, Model, SubjectRef, This, TypeDef, Union


def _rewrite(x: dict, refs: tuple[SubjectRef, ...], where: str) -> Expr:
    if "this" in x:
        return This(refs)
    if "computedUserset" in x:
        return Computed(x["computedUserset"]["relation"])
    if "tupleToUserset" in x:
        return FromLink(x["tupleToUserset"]["computedUserset"]["relation"], x["tupleToUserset"]["tupleset"]["relation"])
    for word, kind in (("union", Union), ("intersection", Intersection)):
        if word in x:
            return kind(tuple(_rewrite(c, refs, where) for c in x[word]["child"]))
    if "difference" in x:
        return Difference(_rewrite(x["difference"]["base"], refs, where), _rewrite(x["difference"]["subtract"], refs, where))
    raise SchemaError(f"{where}: unknown rewrite {sorted(x)}")


def from_json(text: str | dict) -> Model:
    """The model of a JSON text (or its dict); names it does not define raise."""
    data = json.loads(text) if isinstance(text, str) else text
    types = {}
    try:
        for t in data["type_definitions"]:
            kinds = ((t.get("metadata") or {}).get("relations")) or {}
            relations = {}
            for name, x in (t.get("relations") or {}).items():
                listed = (kinds.get(name) or {}).get("directly_related_user_types") or []
                refs = tuple(SubjectRef(k["type"], k.get("relation", ""), "wildcard" in k) for k in listed)
                relations[name] = _rewrite(x, refs, f"{t['type']}.{name}")
            types[t["type"]] = TypeDef(t["type"], relations)
    except (KeyError, TypeError, AttributeError) as e:
        raise SchemaError(f"not the JSON of a model: {e!r}") from e
    model = Model(types, data.get("schema_version", "1.1"))
    model.check_names()
    return model


def _as_dict(e: Expr) -> dict:
    if isinstance(e, This):
        return {"this": {}}
    if isinstance(e, Computed):
        return {"computedUserset": {"relation": e.relation}}
    if isinstance(e, FromLink):
        return {"tupleToUserset": {"tupleset": {"relation": e.link}, "computedUserset": {"relation": e.relation}}}
    if isinstance(e, Difference):
        return {"difference": {"base": _as_dict(e.base), "subtract": _as_dict(e.subtract)}}
    return {"union" if isinstance(e, Union) else "intersection": {"child": [_as_dict(c) for c in e.parts]}}


def to_json(model: Model) -> dict:
    """The JSON form of a model. A relation with several lists of subjects has their union, as the form knows only one."""
    out = []
    for t in model.types.values():
        entry: dict = {"type": t.name}
        if t.relations:
            entry["relations"] = {r: _as_dict(e) for r, e in t.relations.items()}
            entry["metadata"] = {"relations": {r: {"directly_related_user_types": [{"type": x.type} | ({"relation": x.relation} if x.relation else {}) | ({"wildcard": {}} if x.wildcard else {}) for x in model.refs(t.name, r)]} for r in t.relations}}
        out.append(entry)
    return {"schema_version": model.schema_version, "type_definitions": out}
