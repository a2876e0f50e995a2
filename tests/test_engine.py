import random

import pytest

from relgrove.operators.forward import ResolutionTooDeep
from relgrove.operators.trees import Trees
from relgrove.operators.verbs import Engine
from relgrove.plans.analysis import validate
from relgrove.plans.dsl import parse
from relgrove.sources.tuples import parse_tuple, tuples_from_rows
from tests.brute import evaluate

SHAPES = """
model
  schema 1.1
type user
type group
  relations
    define member: [user, user:*, group#member]
    define banned: [user, user:*]
    define live: [user, user:*, group#live] but not banned
type doc
  relations
    define parent: [doc]
    define owner: [user]
    define editor: [user, group#member] or owner
    define public: [user:*]
    define blocked: [user, user:*, group#member]
    define viewer: [user, group#live] or editor or public or viewer from parent
    define both: viewer and editor
    define safe: viewer but not blocked
    define nested: (viewer but not blocked) and (editor or public)
    define gated: [user, user:*, doc#safe] and safe from parent
    define mixed: safe or (editor but not safe)
"""


def random_tuples(rng, n):
    out = set()
    users, groups, docs = [f"u{k}" for k in range(4)] + ["*"], [f"g{k}" for k in range(3)], [f"d{k}" for k in range(4)]
    for _ in range(n):
        pick = rng.randrange(8)
        if pick == 0:
            out.add(("group", f"{rng.choice(groups)}#member", "member", "group", rng.choice(groups)))
        elif pick == 1:
            out.add(("group", f"{rng.choice(groups)}#live", rng.choice(["live"]), "group", rng.choice(groups)))
        elif pick == 2:
            out.add(("user", rng.choice(users), rng.choice(["member", "live", "banned"]), "group", rng.choice(groups)))
        elif pick == 3:
            out.add(("doc", rng.choice(docs), "parent", "doc", rng.choice(docs)))
        elif pick == 4:
            out.add(("group", f"{rng.choice(groups)}#{rng.choice(['member', 'live'])}", rng.choice(["editor", "blocked", "viewer"]), "doc", rng.choice(docs)))
        elif pick == 5:
            out.add(("doc", f"{rng.choice(docs)}#safe", "gated", "doc", rng.choice(docs)))
        else:
            out.add(("user", rng.choice(users), rng.choice(["owner", "editor", "public", "blocked", "viewer", "gated"]), "doc", rng.choice(docs)))
    return sorted(out)


PROBES = [("user", f"u{k}") for k in range(5)] + [("user", "*"), ("group", "g0#member"), ("group", "g1#live"), ("doc", "d1#safe"), ("group", "g0")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_naive_evaluation(spark, seed):
    rng = random.Random(seed)
    rows = random_tuples(rng, 22)
    model = parse(SHAPES)
    want = evaluate(model, rows, PROBES)
    engine = Engine(validate(model), tuples_from_rows(spark, rows))
    requests, idx = [], 0
    for t, r in model.nodes():
        for st, sid in PROBES:
            for oid in [f"g{k}" for k in range(3)] if t == "group" else [f"d{k}" for k in range(4)]:
                idx += 1
                requests.append((idx, st, sid, r, t, oid))
    df = spark.createDataFrame(requests, "idx int, subject_type string, subject_id string, relation string, object_type string, object_id string")
    got = {r["idx"]: r["allowed"] for r in engine.check_bulk(df).collect()}
    wrong = [q for q in requests if got[q[0]] != int((q[1], q[2], q[5]) in want[q[4], q[3]])]
    assert not wrong and any(got.values()) and not all(got.values())
    for t, r in [("doc", "gated"), ("doc", "mixed"), ("group", "live")]:
        listed = {(x["object_id"], x["subject_id"]) for x in engine.subjects_of(t, r, "user").collect()}
        held = {(o, s) for st, s, o in want[t, r] if st == "user"}
        assert listed <= held, (t, r)
        starred = {o for o, s in listed if s == "*"}
        assert {(o, s) for o, s in held if o not in starred} == {(o, s) for o, s in listed if o not in starred}, (t, r)
        assert starred == {o for o, s in held if s == "*"}, (t, r)
    one = spark.createDataFrame([("d2",)], "object_id string")
    for kind in ("user", "group#member"):
        whole = {x["subject_id"] for x in engine.subjects_of("doc", "mixed", kind).where("object_id = 'd2'").collect()}
        assert {x["subject_id"] for x in engine.subjects_of("doc", "mixed", kind, one).collect()} == whole
    usersets = {(x["object_id"], x["subject_id"]) for x in engine.subjects_of("doc", "viewer", "group#member").collect()}
    assert {o for o, s in usersets if s == "g0#member"} == {o for st, s, o in want["doc", "viewer"] if s == "g0#member"}
    trees = Trees(engine.analysis, engine.tuples)
    for q in rng.sample(requests, 12):
        assert trees.explain(*q[1:], max_nodes=10_000)["result"] == bool(got[q[0]]), q


BASE = """
model
  schema 1.1
type user
type group
  relations
    define member: [user, group#member]
type doc
  relations
    define viewer: [user, user:*, group#member]
    define banned: [user]
    define odd: [user] but not odd from parent
    define parent: [doc]
"""


def engine_of(spark, *tuples, schema=BASE, **options):
    return Engine(validate(parse(schema)), tuples_from_rows(spark, [parse_tuple(*t.split()) for t in tuples]), **options)


def test_unknown_names_are_denied(spark):
    e = engine_of(spark, "user:a viewer doc:1")
    assert e.check("user", "a", "viewer", "doc", "1") == 1
    for request in (("user", "a", "nope", "doc", "1"), ("user", "a", "viewer", "nope", "1"), ("robot", "a", "viewer", "doc", "1"), ("user", "a", "viewer", "doc", "2")):
        assert e.check(*request) == 0
    assert e.list_objects("user", "a", "nope", "doc").count() == 0
    assert e.list_subjects("doc", "1", "nope", "user").count() == 0


def test_contextual_tuples_count_once(spark):
    e = engine_of(spark, "user:a member group:g")
    assert e.check("user", "a", "viewer", "doc", "1") == 0
    assert e.check("user", "a", "viewer", "doc", "1", contextual=[("group", "g#member", "viewer", "doc", "1")]) == 1
    assert e.check("user", "a", "viewer", "doc", "1") == 0


def test_pages(spark):
    e = engine_of(spark, *(f"user:a viewer doc:{k}" for k in "abcde"), "user:* viewer doc:c", "user:b viewer doc:c")

    def objects(**page):
        return [tuple(r) for r in e.list_objects("user", "a", "viewer", "doc", **page).collect()]

    assert objects(limit=2) == [("a", "b"), ("b", "b")]
    assert objects(limit=2, after="b") == [("c", "d"), ("d", "d")]
    assert objects(limit=2, after="d") == [("e", None)]
    assert objects(limit=5) == [(k, None) for k in "abcde"]  # exactly full: no cursor
    assert objects(limit=0) == [(k, None) for k in "abcde"]
    assert objects(limit=1, after="bb") == [("c", "c")]  # a cursor that matches no row
    assert objects(limit=1, after="z") == []

    def subjects(**page):
        return [tuple(r) for r in e.list_subjects("doc", "c", "viewer", "user", **page).collect()]

    assert subjects() == [("*", None), ("a", None), ("b", None)]
    assert subjects(limit=1) == [("*", "*")]
    assert subjects(limit=1, after="*") == [("a", "a")]


def test_cycles_end_and_depth_raises(spark):
    ring = [f"group:g{k}#member member group:g{(k + 1) % 5}" for k in range(5)]
    e = engine_of(spark, *ring, "user:a member group:g0")
    assert e.list_objects("user", "a", "member", "group").count() == 5
    chain = [f"group:g{k}#member member group:g{k + 1}" for k in range(8)]
    e = engine_of(spark, *chain, "user:a member group:g0", max_depth=4)
    with pytest.raises(ResolutionTooDeep):
        e.check("user", "a", "member", "group", "g8")
    assert e.check("user", "a", "member", "group", "g2") == 1
    assert e.list_objects("user", "a", "member", "group").count() == 4  # lists stop there


def test_expand(spark):
    e = engine_of(spark, "user:b viewer doc:1", "user:a viewer doc:1", "group:g#member viewer doc:1", "user:c member group:g")
    t = Trees(e.analysis, e.tuples)
    tree = t.expand("doc", "1", "viewer", max_leaf=2)
    assert tree["root"]["leaf"] == {"users": {"users": ["group:g#member", "user:a"], "users_truncated": True}}
    assert t.expand("doc", "1", "nope")["root"]["leaf"] == {"users": {"users": []}}
    assert t.expand_recursive("doc", "1", "viewer") == ["group:g#member", "user:a", "user:b"]
    trace = t.explain("user", "c", "viewer", "doc", "1")
    assert trace["result"] and trace["root"]["type"] == "userset"
    assert t.explain("user", "c", "viewer", "doc", "1", max_nodes=1)["truncated"]


def test_expand_has_no_cap_of_its_own(spark):
    e = engine_of(spark, *(f"user:u{k} viewer doc:1" for k in range(150)))
    t = Trees(e.analysis, e.tuples)
    users = t.expand("doc", "1", "viewer")["root"]["leaf"]["users"]
    assert len(users["users"]) == 150 and "users_truncated" not in users
    spark.conf.set("spark.relgrove.expand.leaf", "20")
    try:
        users = t.expand("doc", "1", "viewer")["root"]["leaf"]["users"]
        assert len(users["users"]) == 20 and users["users_truncated"] and "truncated" not in t.explain("user", "u1", "viewer", "doc", "1")
    finally:
        spark.conf.unset("spark.relgrove.expand.leaf")


def test_trees_of_links_and_large_objects(spark):
    schema = "model\n  schema 1.1\ntype user\ntype group\n  relations\n    define member: [user, group#member]\ntype doc\n  relations\n    define parent: [doc]\n    define viewer: [user, group#member] or viewer from parent\n"
    e = engine_of(spark, "doc:p parent doc:1", "doc:q parent doc:1", "user:a viewer doc:q", *(f"group:g{k}#member viewer doc:p" for k in range(300)), "user:z member group:g299", schema=schema)
    t = Trees(e.analysis, e.tuples)
    link = t.expand("doc", "1", "viewer")["root"]["union"]["nodes"][1]["leaf"]
    assert link == {"tuple_to_userset": {"tupleset": "doc:1#parent", "computed": [{"userset": "doc:p#viewer"}, {"userset": "doc:q#viewer"}]}}
    assert len(t.expand_recursive("doc", "1", "viewer")) == 301
    found = t.explain("user", "a", "viewer", "doc", "1", max_nodes=5000)
    assert found["result"]
    assert t.explain("user", "z", "viewer", "doc", "1")["truncated"]  # a hundred nodes don't reach the last group
    assert t.explain("user", "z", "viewer", "doc", "1", max_nodes=5000)["result"]
    assert t.check("user", "z", "viewer", "doc", "1") == 1


def test_depth_concerns_recursive_relations_only(spark):
    chain = [f"group:g{k}#member member group:g{k + 1}" for k in range(8)]
    e = engine_of(spark, *chain, "user:a member group:g0", max_depth=5)
    rows = [(1, "user", "a", "member", "group", "g2"), (2, "user", "b", "banned", "doc", "1")]
    asked = spark.createDataFrame(rows, "idx int, subject_type string, subject_id string, relation string, object_type string, object_id string")
    assert sorted(map(tuple, e.check_bulk(asked).collect())) == [(1, 1), (2, 0)]


def test_plan_text_and_wildcards_off(spark):
    e = engine_of(spark, "user:* viewer doc:1", "user:a viewer doc:2")
    one = spark.createDataFrame([("user", "a")], "subject_type string, subject_id string")
    assert "Join" in e.explain_plan(one, "viewer", "doc")
    with_star, _ = e.grants(one, [("doc", "viewer")])
    without, _ = e.grants(one, [("doc", "viewer")], wildcards=False)
    assert {r["object_id"] for r in with_star.collect()} == {"1", "2"} and {r["object_id"] for r in without.collect()} == {"2"}


CASES = [
    # (schema lines of type doc, tuples, (subject, relation, object) -> allowed)
    ("define r: [user:*] but not b\n    define b: [user]", ["user:* r doc:1", "user:bob b doc:1"], {("user:ann", "r", "doc:1"): 1, ("user:bob", "r", "doc:1"): 0, ("user:*", "r", "doc:1"): 1}),
    ("define r: [user] but not b\n    define b: [user:*]", ["user:ann r doc:1", "user:* b doc:1"], {("user:ann", "r", "doc:1"): 0}),
    ("define r: a and p\n    define a: [user]\n    define p: [user:*]", ["user:ann a doc:1", "user:* p doc:1"], {("user:ann", "r", "doc:1"): 1, ("user:bob", "r", "doc:1"): 0}),
    ("define r: [user, doc#r]", ["doc:2#r r doc:1", "user:ann r doc:2"], {("user:ann", "r", "doc:1"): 1, ("doc:2#r", "r", "doc:1"): 1, ("doc:1#r", "r", "doc:1"): 1, ("doc:3#r", "r", "doc:1"): 0}),
    ("define o: [user]\n    define r: [user, doc#o] or o", ["doc:2#o r doc:1"], {("doc:1#o", "r", "doc:1"): 1, ("doc:2#o", "r", "doc:1"): 1, ("doc:2#r", "r", "doc:1"): 0}),
    ("define parent: [doc, group]\n    define r: [user] or r from parent", ["group:x parent doc:1", "user:ann r doc:x"], {("user:ann", "r", "doc:1"): 0, ("user:ann", "r", "doc:x"): 1}),
    ("define r: (a but not b) or c\n    define a: [user]\n    define b: [user]\n    define c: [user]", ["user:ann c doc:1", "user:ann b doc:1"], {("user:ann", "r", "doc:1"): 1}),
    ("define r: [user] and (a or b)\n    define a: [user]\n    define b: a", ["user:ann r doc:1", "user:bob a doc:1"], {("user:ann", "r", "doc:1"): 0, ("user:bob", "r", "doc:1"): 0}),
]


@pytest.mark.parametrize("lines, tuples, wanted", CASES)
def test_shapes(spark, lines, tuples, wanted):
    schema = f"model\n  schema 1.1\ntype user\ntype group\n  relations\n    define r: [user]\ntype doc\n  relations\n    {lines}\n"
    e = engine_of(spark, *tuples, schema=schema)
    rows = [(k, *parse_tuple(*q)) for k, q in enumerate(wanted)]
    got = e.check_bulk(spark.createDataFrame(rows, "idx int, subject_type string, subject_id string, relation string, object_type string, object_id string"))
    assert [r["allowed"] for r in got.orderBy("idx").collect()] == list(wanted.values())
