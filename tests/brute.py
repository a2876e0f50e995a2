"""A naive evaluator: for each relation the set of (subject, object id), by repeated evaluation until nothing changes."""

from relgrove.plans.analysis import Analysis
from relgrove.plans.model import Computed, Difference, FromLink, Intersection, This, Union


def evaluate(model, tuples, probes):
    """{(type, relation): {(subject type, subject id, object id)}} for the probes."""
    analysis = Analysis(model)
    objects = {}
    for st, sid, _, ot, oid in tuples:
        objects.setdefault(ot, set()).add(oid)
        objects.setdefault(st, set()).add(sid.split("#")[0])
    for st, sid in probes:
        objects.setdefault(st, set()).add(sid.split("#")[0])
    value = {n: set() for n in model.nodes()}

    def holds(e, node, p, oid):
        st, sid = p
        if isinstance(e, This):
            for a, b, r, t, o in tuples:
                if (t, o, r) != (node[0], oid, node[1]):
                    continue
                for ref in e.refs:
                    if ref.type != a:
                        continue
                    if ref.relation:
                        if b.endswith("#" + ref.relation) and (st, sid, b.split("#")[0]) in value[ref.type, ref.relation]:
                            return True
                    elif a == st and "#" not in sid and (b == "*" and ref.wildcard or not ref.wildcard and b == sid and b != "*"):
                        return True
            return False
        if isinstance(e, Computed):
            return (st, sid, oid) in value[node[0], e.relation]
        if isinstance(e, FromLink):
            kinds = model.link_types(node[0], e.link)
            return any((t, o, r) == (node[0], oid, e.link) and a in kinds and "#" not in b and b != "*" and (st, sid, b) in value.get((a, e.relation), ()) for a, b, r, t, o in tuples)
        if isinstance(e, Union):
            return any(holds(p2, node, p, oid) for p2 in e.parts)
        if isinstance(e, Intersection):
            return all(holds(p2, node, p, oid) for p2 in e.parts)
        assert isinstance(e, Difference)
        return holds(e.base, node, p, oid) and not holds(e.subtract, node, p, oid)

    for group in analysis.order:
        while True:
            before = {n: set(value[n]) for n in group}
            for n in group:
                for oid in objects.get(n[0], ()):
                    for p in probes:
                        rel = p[1].partition("#")[2]
                        own = p[0] == n[0] and p[1].partition("#")[0] == oid and rel in analysis.closure[n]
                        if own or holds(model.expr(*n), n, p, oid):
                            value[n].add((*p, oid))
            if all(before[n] == value[n] for n in group):
                break
    return value
