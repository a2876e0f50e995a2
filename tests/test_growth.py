"""Steps whose rows must not grow faster than the input: the most rows that any step of a plan made."""

import random

import pytest

from relgrove.operators import factored
from relgrove.operators.trees import Trees
from relgrove.operators.verbs import Engine
from relgrove.plans.analysis import validate
from relgrove.plans.dsl import parse
from relgrove.sources.tuples import parse_tuple, read_store, tuples_from_rows, write_store

SCHEMA = """
model
  schema 1.1
type user
type org
  relations
    define auditor: [user]
type group
  relations
    define member: [user]
type order
  relations
    define org: [org]
    define owner: [user]
    define auditor: auditor from org
    define watcher: [group#member]
    define owner_auditor: owner and auditor from org
    define owner_watcher: owner and watcher
    define outside_owner: owner but not auditor from org
    define outside_watcher: owner but not watcher
"""


def most_rows(df, metric: str = "numOutputRows") -> int:
    """The largest number of rows that a step of the plan put out (or shuffled) when it ran."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        made = node.metrics().get(metric)
        below = node.children()
        return max([made.get().value() if made.isDefined() else 0, *(walk(below.apply(k)) for k in range(below.size()))])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def crowd(spark, n: int) -> Engine:
    """One org with n auditors, which are the members of a group too, and n orders of it, each with an owner; every second owner is an auditor."""
    rows = [f"user:u{k} auditor org:a" for k in range(n)] + [f"user:u{k} member group:g" for k in range(n)]
    rows += [f"org:a org order:o{k}" for k in range(n)] + [f"group:g#member watcher order:o{k}" for k in range(n)]
    rows += [f"user:{'u' if k % 2 else 'x'}{k} owner order:o{k}" for k in range(n)]
    return Engine(validate(parse(SCHEMA)), tuples_from_rows(spark, [parse_tuple(*r.split()) for r in rows]))


def owners(spark, n: int):
    return spark.createDataFrame([("user", f"{'u' if k % 2 else 'x'}{k}") for k in range(n)], "subject_type string, subject_id string")


def test_links_and_usersets_are_tested_for_the_candidates_only(spark):
    n = 200
    e = crowd(spark, n)
    for relation, odd in (("outside_owner", 0), ("owner_auditor", 1), ("outside_watcher", 0), ("owner_watcher", 1)):
        df = e.objects_of(owners(spark, n), relation, "order")
        assert most_rows(df) <= 6 * n, relation  # n * n if all that the link reaches were joined
        assert sorted(r["object_id"] for r in df.collect()) == sorted(f"o{k}" for k in range(n) if k % 2 == odd)


def test_lists_of_subjects_test_links_and_usersets_for_the_candidates_only(spark):
    n = 200
    e = crowd(spark, n)
    for relation, odd in (("outside_owner", 0), ("owner_auditor", 1), ("outside_watcher", 0), ("owner_watcher", 1)):
        df = e.subjects_of("order", relation, "user")
        assert most_rows(df) <= 6 * n, relation
        assert sorted(r["object_id"] for r in df.collect()) == sorted(f"o{k}" for k in range(n) if k % 2 == odd)


def test_a_store_is_written_without_a_shuffle(spark, tmp_path):
    rows = [("user", "a", "owner", "doc", "1"), ("user", "a", "owner", "doc", "1"), ("user", "*", "viewer", "doc", "2"), ("doc", "1", "parent", "folder", "f")]
    tuples = tuples_from_rows(spark, rows)
    written = tuples.sparkSession.sparkContext.statusTracker()
    tuples.sparkSession.sparkContext.setJobGroup("store", "store")
    write_store(tuples, str(tmp_path / "s"))
    stages = [len(written.getJobInfo(k).stageIds) for k in written.getJobIdsForGroup("store")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(stages) == 1
    assert sorted(p.name for p in (tmp_path / "s" / "object_type=doc").iterdir()) == ["relation=owner", "relation=viewer"]
    assert sorted(map(tuple, read_store(spark, str(tmp_path / "s")).collect())) == sorted(rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


@pytest.mark.parametrize("chunk", [1_000, 7])
def test_lists_over_links_and_usersets_do_not_shuffle_their_pairs(spark, monkeypatch, chunk):
    n = 200
    monkeypatch.setattr(factored, "CHUNK", chunk)
    monkeypatch.setattr(factored, "PAIRS", 10 * chunk)  # chunks of 7: the one class is dealt
    e = crowd(spark, n)
    users = spark.createDataFrame([("user", f"u{k}") for k in range(n)], "subject_type string, subject_id string")
    want = {(f"u{k}", f"o{j}") for k in range(n) for j in range(n)}
    for relation in ("auditor", "watcher"):
        for df in (e.objects_of(users, relation, "order"), e.subjects_of("order", relation, "user")):
            got = [(r["subject_id"], r["object_id"]) for r in df.collect()]
            assert len(got) == n * n and set(got) == want
            assert most_rows(df, "shuffleRecordsWritten") <= n * (2 * n // chunk + 2)


TREE = """
model
  schema 1.1
type user
type group
  relations
    define member: [user]
type folder
  relations
    define parent: [folder]
    define viewer: [user, group#member, folder#viewer] or viewer from parent
    define reader: viewer or helper
    define helper: [group#member, user]
"""


@pytest.mark.parametrize("groups", [2, 40])
def test_lists_through_recursion_have_each_pair_once(spark, groups):
    rng = random.Random(groups)
    member = {(f"u{rng.randrange(12)}", f"g{rng.randrange(groups)}") for _ in range(4 * groups)}
    parent = {(f"f{rng.randrange(k)}", f"f{k}") for k in range(1, 20)} | {("f19", "f3")}
    own = {(f"u{rng.randrange(12)}", f"f{rng.randrange(20)}") for _ in range(8)}
    given = {(f"g{rng.randrange(groups)}", f"f{rng.randrange(20)}") for _ in range(12)}
    helps = {(f"g{rng.randrange(groups)}", f"f{rng.randrange(20)}") for _ in range(6)}
    rows = [("user", u, "member", "group", g) for u, g in member] + [("folder", a, "parent", "folder", b) for a, b in parent] + [("user", u, "viewer", "folder", f) for u, f in own]
    rows += [("group", f"{g}#member", "viewer", "folder", f) for g, f in given] + [("folder", "f2#viewer", "viewer", "folder", "f1")] + [("group", f"{g}#member", "helper", "folder", f) for g, f in helps] + [("user", "u1", "helper", "folder", "f1")]
    views = own | {(u, f) for g, f in given for u, h in member if h == g}
    while more := {(u, b) for u, f in views for a, b in parent | {("f2", "f1")} if a == f} - views:
        views |= more
    helped = {("u1", "f1")} | {(u, f) for g, f in helps for u, h in member if h == g}
    e = Engine(validate(parse(TREE)), tuples_from_rows(spark, rows))
    users = spark.createDataFrame([("user", f"u{k}") for k in range(12)], "subject_type string, subject_id string")
    for relation, want in (("viewer", views), ("reader", views | helped), ("helper", helped)):
        for df in (e.objects_of(users, relation, "folder"), e.subjects_of("folder", relation, "user")):
            assert sorted((r["subject_id"], r["object_id"]) for r in df.collect()) == sorted(want), relation


def test_single_checks_and_traces_filter_scans_by_object(spark, monkeypatch):
    e = Engine(validate(parse(TREE)), tuples_from_rows(spark, [("user", "u", "viewer", "folder", "f0"), ("folder", "f0", "parent", "folder", "f1"), ("user", "v", "helper", "folder", "f1"), ("user", "w", "helper", "folder", "f0")]))
    assert e._local([("folder", "reader")]) == {("folder", "reader"), ("folder", "helper")}  # viewer is asked about on parents too
    assert e._local([("folder", "viewer")]) == set()
    assert [e.check("user", s, "reader", "folder", "f1") for s in "uvw"] == [1, 1, 0]
    trees = Trees(e.analysis, e.tuples)
    monkeypatch.setattr(type(spark), "createDataFrame", None)  # no table of the objects asked for: they are a filter
    assert [trees.explain("user", s, "reader", "folder", "f1")["result"] for s in "uvw"] == [True, True, False]
