import json

import pytest

from relgrove import codegen, config, doctor, migrations
from relgrove.__main__ import main
from relgrove.checker import ALLOW, DENY, Cache, Checker, Denied, InvalidRequest, Object, Page, UnknownType
from relgrove.functions.sql import bulk_from_arrays, register, statements
from relgrove.operators.forward import ResolutionTooDeep
from relgrove.plans.analysis import validate
from relgrove.plans.dsl import SchemaError, parse
from relgrove.plans.json_model import from_json, to_json
from relgrove.plans.model import UnknownName
from relgrove.registry import Registry, difference
from relgrove.sources.tuples import COLUMNS, Mapping, advise, layouts, read, recommend, tuples_of
from relgrove.sources.views import Cast, advise_view, parse_view
from relgrove.streaming.checks import answer, store_changes
from tests.test_engine import BASE, SHAPES, engine_of


def test_checker(spark):
    c = Checker(engine_of(spark, "user:a viewer doc:1", "user:b viewer doc:2"), cache=Cache(ttl=10))
    assert c.check("user:a", "viewer", "doc:1") and len(c.cache) == 1
    assert not c.check(Object("user", "b"), "viewer", "doc:1")
    with pytest.raises(Denied):
        c.must("user:b", "viewer", "doc:1")
    with pytest.raises(InvalidRequest):
        c.check("user", "viewer", "doc:1")
    with pytest.raises(InvalidRequest):
        c.check("group:#member", "viewer", "doc:1")
    with pytest.raises(InvalidRequest):
        c.check("user:a", "viewer", "doc:1", contextual=[("robot", "x", "viewer", "doc", "1")])
    with pytest.raises(UnknownType):
        Checker(c.engine, strict=True).check("user:a", "nope", "doc:1")
    assert c.with_decision(DENY).list_objects("user:a", "viewer", "doc") == ([], None)
    assert not c.with_decision(DENY).check("user:a", "viewer", "doc:1")
    assert Checker(c.engine, decision=ALLOW).check("user:z", "viewer", "doc:9")
    assert Checker(c.engine, decision=ALLOW).list_objects("user:a", "viewer", "doc", Page(1)) == (["1"], None)
    assert c.list_all_subjects("doc:2", "viewer", "user") == ["b"]


def test_cache_expires():
    now = [0.0]
    cache = Cache(ttl=5, clock=lambda: now[0])
    cache.set("k", True)
    assert cache.get("k") is True
    now[0] = 6
    assert cache.get("k") is None


def test_bulk(spark):
    c = Checker(engine_of(spark, "user:a viewer doc:1", "user:a viewer doc:3"))
    results = c.bulk().add_many("user:a", "viewer", ["doc:1", "doc:2", "doc:3", "doc:1"]).add("user:a", "nope", "doc:1", "x").execute()
    assert [r.allowed for r in results.items] == [True, False, True, True, False]
    assert results.any() and not results.all() and not results.none()
    assert len(results.denied()) == 2 and not results.errors() and results.get("x").relation == "nope"
    with pytest.raises(Denied):
        results.all_or_error()
    assert not c.bulk().execute().all()
    with pytest.raises(InvalidRequest):
        c.bulk().add("user:a", "viewer", "doc:1", "k").add("user:a", "viewer", "doc:2", "k")


def test_bulk_errors_are_those_of_their_requests(spark):
    chain = [f"group:g{k}#member member group:g{k + 1}" for k in range(8)]
    e = engine_of(spark, *chain, "user:a member group:g0", "user:a viewer doc:1", "user:a odd doc:1", "user:a banned doc:2", max_depth=4)
    c = Checker(e, cache=Cache())
    bulk = c.bulk().add("user:a", "member", "group:g8", "deep").add("user:a", "member", "group:g2", "near").add("user:b", "banned", "doc:1", "plain").add("user:a", "odd", "doc:1", "path").add("group:#x", "viewer", "doc:1", "shape")
    got = bulk.execute()
    assert [r.allowed for r in got.items] == [False, True, False, True, False]
    assert [r.id for r in got.errors()] == ["deep", "shape"] and isinstance(got.get("deep").error, ResolutionTooDeep)
    assert len(c.cache) == 3  # errors are not kept
    with pytest.raises(ResolutionTooDeep):
        got.all_or_error()


def test_bulk_contextual(spark):
    c = Checker(engine_of(spark, "user:a member group:g"), cache=Cache())
    ask = lambda: c.bulk().add("user:a", "viewer", "doc:1").add("user:b", "viewer", "doc:1")
    assert [r.allowed for r in ask().with_contextual(("group", "g#member", "viewer", "doc", "1")).execute().items] == [True, False]
    assert len(c.cache) == 0 and not ask().execute().any()
    with pytest.raises(InvalidRequest):
        ask().with_contextual(("robot", "x", "viewer", "doc", "1")).execute()


def test_unstratified_checks_by_path(spark):
    c = Checker(engine_of(spark, "user:a odd doc:1", "user:a odd doc:2", "doc:1 parent doc:2"))
    assert c.check("user:a", "odd", "doc:1") and not c.check("user:a", "odd", "doc:2")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "b", "y")], "id int, u string, extra string")
    t = tuples_of([Mapping(df, "user", "u", "viewer", "doc", "id"), Mapping(df, "user", "extra", "viewer", "doc", "id", df.id > 2)])
    assert sorted(tuple(r) for r in t.collect()) == [("user", "a", "viewer", "doc", "1"), ("user", "b", "viewer", "doc", "3"), ("user", "y", "viewer", "doc", "3")]
    layouts(t, str(tmp_path / "t"))
    assert read(spark, str(tmp_path / "t" / "by_subject")).count() == 3


def test_doctor_and_registry(spark, tmp_path):
    e = engine_of(spark, "user:a viewer doc:1", "user:a nope doc:1", "robot:a viewer doc:1", "user:a viewer thing:1", "group:g viewer doc:1")
    registry = Registry(spark, str(tmp_path / "registry"))
    assert registry.status() == {"installed": False}
    first = registry.migrate(BASE)
    assert first["version"] == 1 and not first["skipped"] and registry.migrate(BASE)["skipped"]
    changed = BASE.replace("define banned: [user]", "define banned: [user, user:*]").replace("define odd", "define even")
    changed = changed.replace("odd from parent", "even from parent")
    plan = registry.migrate(changed, dry_run=True)
    assert plan["changed"] == ["doc.banned"] and plan["added"] == ["doc.even"] and plan["removed"] == ["doc.odd"]
    assert registry.last()["version"] == 1
    found = {(f.category, f.name): f for f in doctor.examine(e.analysis, e.tuples, registry, BASE)}
    for kind in ("unknown object type", "unknown relation", "unknown subject type", "invalid subject"):
        assert found["Data Health", kind].status == doctor.WARN, kind
    assert found["Migration State", "current"].status == doctor.OK
    assert "unknown relation" in doctor.render(list(found.values()))
    assert "+ doc.even" in difference(parse(BASE), parse(changed))


def test_generated_client():
    text = codegen.python_client(parse(BASE))
    scope: dict = {}
    exec(text, scope)
    assert scope["TYPE_DOC"] == "doc" and scope["REL_VIEWER"] == "viewer" and str(scope["doc"](7)) == "doc:7" and scope["any_user"]().id == "*"


def test_clients_in_other_languages():
    files = codegen.client(parse(BASE), "typescript", relation_prefix="v")
    assert 'export const doc = (id: string): Ref => ({ type: ObjectTypes.Doc, id: String(id) });' in files["schema.ts"]
    assert 'Viewer: "viewer",' in files["types.ts"] and "banned" not in files["types.ts"] and "async listObjects" in files["checker.ts"]
    (go,) = codegen.client(parse(BASE), "go", id_type="int64", package="access").values()
    assert go.startswith("// Generated") and "package access" in go and 'import "fmt"' in go and "func AnyDoc() Object" in go and 'RelViewer Relation = "viewer"' in go
    assert all(text.count("{") == text.count("}") for text in (go, *files.values()))
    assert list(codegen.client(parse(BASE), "python")) == ["authz.py"]
    with pytest.raises(ValueError):
        codegen.client(parse(BASE), "cobol")


def test_json_models():
    model = parse(SHAPES)
    again = from_json(json.dumps(to_json(model)))
    assert again == model and validate(again)
    assert from_json({"type_definitions": [{"type": "user"}]}).nodes() == []
    for bad in ("{}", '{"type_definitions": [{"type": "d", "relations": {"r": {"odd": {}}}}]}', '{"type_definitions": [{"relations": {}}]}'):
        with pytest.raises(SchemaError):
            from_json(bad)
    with pytest.raises(UnknownName):
        from_json('{"type_definitions": [{"type": "d", "relations": {"r": {"computedUserset": {"relation": "s"}}}}]}')


def test_migration_files(spark, tmp_path):
    old, new = parse(BASE), parse(BASE.replace("define banned: [user]", "define banned: [user, user:*]").replace("odd", "even"))
    first = migrations.write(tmp_path, "first", old)
    assert [f.name.partition("_")[2] for f in first] == ["first.up.sql", "first.down.sql"] and migrations.write(tmp_path, "same", old, old) == []
    text = migrations.up(new, old)
    assert "DROP TEMPORARY FUNCTION IF EXISTS check_doc_odd;" in text and "FUNCTION check_doc_even(" in text and "FUNCTION check_doc_banned(" in text
    assert "FUNCTION check_doc_viewer(" not in text and "-- changed relations: 2 of 5" in text
    assert migrations.down(new).count("DROP TEMPORARY FUNCTION") == 5 * 5
    (both,) = migrations.write(tmp_path, "both", new, old, "single")
    assert "-- up" in both.read_text() and "-- down" in both.read_text()
    e = engine_of(spark, "user:a viewer doc:1")
    register(e, "doc", "viewer", e.tuples.select("subject_type", "subject_id"))
    for statement in migrations.down(old).split("\n"):
        if statement.startswith("DROP") and "doc_viewer" in statement:
            spark.sql(statement.rstrip(";"))
    for statement in statements("doc", "viewer").values():  # what the files hold is what Spark runs
        spark.sql(statement)
    with pytest.raises(ValueError):
        migrations.write(tmp_path, "no/name", old)


def test_settings(tmp_path):
    (tmp_path / "relgrove.toml").write_text('schema = "a.fga"\n[migrate]\nforce = true\n')
    below = tmp_path / "x" / "y"
    below.mkdir(parents=True)
    assert config.find(below) == tmp_path / "relgrove.toml"
    found = config.load(config.find(below), {"RELGROVE_SCHEMA": "b.fga", "RELGROVE_MIGRATE_DRY_RUN": "yes"})
    assert (found["schema"], found["migrate.force"], found["migrate.dry_run"], found["client.language"]) == ("b.fga", True, True, "python")
    (tmp_path / "x" / ".git").mkdir()
    assert config.find(below) is None
    for bad in ('schema = 1', 'nope = "x"', "[migrate]\nforce = 'x'", "="):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / "bad.toml", {})


def test_views(spark):
    view = parse_view(spark, "CREATE OR REPLACE VIEW tuples AS SELECT 'user' AS subject_type, concat('u', m.user_id) AS subject_id, 'member' AS relation, 'org' AS object_type, o.id::string AS object_id FROM db.members m JOIN orgs o ON m.org = o.id WHERE m.ok UNION ALL (SELECT kind, who, 'owner', 'doc', doc FROM owners)")
    assert view.tables() == ["db.members", "orgs", "owners"] and not view.distinct and view.missing() == [] and len(view.branches) == 2
    assert view.branches[0].casts[0] == Cast("object_id", "o.id", "string") and view.branches[1].columns["subject_id"] == "who"
    assert any("object_id converts o.id" in x for x in advise_view(view))
    for bad in ("", "SELEC x", "CREATE VIEW v"):
        with pytest.raises(ValueError):
            parse_view(spark, bad)


def test_layouts_by_model(spark, tmp_path):
    e = engine_of(spark, "user:a viewer doc:1", "user:* viewer doc:2")
    wanted = recommend(e.analysis)
    assert [x.name for x in wanted] == ["by_object", "by_subject", "wildcards"] and wanted[2].serves == ("check doc#viewer", "list subjects doc#viewer")
    layouts(e.tuples, str(tmp_path / "t"), e.analysis)
    assert read(spark, str(tmp_path / "t" / "wildcards")).count() == 1 and read(spark, str(tmp_path / "t" / "by_object")).count() == 2
    assert len(advise(e.tuples, 10**7, e.analysis)) == 3 and len(recommend(validate(parse("model\n  schema 1.1\ntype user\n")))) == 0


def test_two_installs_get_two_numbers(spark, tmp_path):
    one, two = (Registry(spark, str(tmp_path / "r")) for _ in range(2))
    assert one._claim(1) == 1 and two._claim(1) == 2  # both had read the same state
    assert one.migrate(BASE)["version"] == 3 and two.last()["version"] == 3


def test_sql_functions(spark):
    e = engine_of(spark, "user:a viewer doc:1", "user:b viewer doc:1")
    register(e, "doc", "viewer", e.tuples.select("subject_type", "subject_id"))
    assert {r[0] for r in spark.sql("SELECT * FROM list_doc_viewer_sub('1', 'user')").collect()} == {"a", "b"}
    assert [r[0] for r in spark.sql("SELECT * FROM list_doc_viewer_obj('user', 'a')").collect()] == ["1"]
    assert spark.sql("SELECT * FROM check_doc_viewer('user', 'c', '1')").first()[0] == 0
    f = engine_of(spark, "group:g#member viewer doc:1", "user:c member group:g", "user:b viewer doc:1")
    register(f, "doc", "viewer", spark.createDataFrame([("user", "c"), ("user", "b")], "subject_type string, subject_id string"))
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM expand_doc_viewer('1')").collect()) == [(0, "user", "group:g#member"), (0, "user", "user:b")]
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM explain_doc_viewer('user', 'c', '1')").collect()) == [(0, "user", "group:g#member", True), (0, "user", "user:b", False)]
    register(e, "doc", "viewer", e.tuples.select("subject_type", "subject_id"))
    df = spark.createDataFrame([(["user", "user"], ["a", "x"], ["viewer", "viewer"], ["doc", "doc"], ["1", "1"])], "a array<string>, b array<string>, c array<string>, d array<string>, e array<string>")
    assert sorted(tuple(r) for r in bulk_from_arrays(e, df, list("abcde")).collect()) == [(1, 1), (2, 0)]


def test_streams(spark, tmp_path):
    e = engine_of(spark, "user:a viewer doc:1")
    rows = [(1, "user", "a", "viewer", "doc", "1"), (2, "user", "b", "viewer", "doc", "1")]
    schema = "idx int, " + ", ".join(f"{c} string" for c in COLUMNS)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = answer(stream, e, lambda df, n: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [(1, 1), (2, 0)]
    q = store_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert read(spark, str(tmp_path / "out")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    schema = tmp_path / "m.fga"
    schema.write_text(BASE)
    engine_of(spark, "user:a viewer doc:1", "user:* viewer doc:2").tuples.write.parquet(str(tmp_path / "t"))
    t, s = str(tmp_path / "t"), str(schema)
    assert main(["validate", s]) == 0
    assert main(["check", s, t, "user:a", "viewer", "doc:1"]) == 0
    assert main(["check", s, t, "user:b", "viewer", "doc:1"]) == 1
    assert main(["doctor", s, "--tuples", t]) == 0
    assert main(["migrate", s, str(tmp_path / "r")]) == 0 and main(["status", s, str(tmp_path / "r")]) == 0
    capsys.readouterr()
    assert main(["list-objects", s, t, "user:a", "viewer", "doc"]) == 0
    assert capsys.readouterr().out.split() == ["1", "2"]
    assert main(["list-subjects", s, t, "doc:2", "viewer", "user"]) == 0
    assert capsys.readouterr().out.split() == ["*"]
    assert main(["explain", s, t, "user:a", "viewer", "doc:1"]) == 0
    assert "allowed" in capsys.readouterr().out
    assert main(["expand", s, t, "doc:1", "viewer", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["root"]["leaf"]["users"]["users"] == ["user:a"]
    assert main(["expand", s, t, "doc:1", "viewer", "--recursive"]) == 0
    assert main(["client", s]) == 0 and main(["version"]) == 0
    bad = tmp_path / "bad.fga"
    bad.write_text("model\n  schema 1.1\ntype doc\n  relations\n    define a: b\n")
    assert main(["validate", str(bad)]) == 3 and main(["doctor", str(bad)]) == 1
    assert main(["init", str(tmp_path / "new.fga")]) == 0 and main(["validate", str(tmp_path / "new.fga")]) == 0
    assert main(["init", s]) == 1
    assert main(["check", s, str(tmp_path / "no_such_table"), "user:a", "viewer", "doc:1"]) == 4
    odd = tmp_path / "odd.toml"
    odd.write_text("schemas = 1")
    assert main(["--config", str(odd), "validate", s]) == 2
    assert main(["license"]) == 0 and main(["config"]) == 0
    capsys.readouterr()
    assert main(["convert", s]) == 0
    (tmp_path / "m.json").write_text(capsys.readouterr().out)
    assert main(["validate", str(tmp_path / "m.json")]) == 0 and main(["convert", str(tmp_path / "m.json")]) == 0
    assert "define viewer: [user, user:*, group#member]" in capsys.readouterr().out
    settings = tmp_path / "relgrove.toml"
    settings.write_text(f'[client]\nlanguage = "typescript"\noutput = "{tmp_path}/ts"\n[migration]\noutput = "{tmp_path}/sql"\n')
    assert main(["--config", str(settings), "client", s, "--write"]) == 0
    assert sorted(x.name for x in (tmp_path / "ts").iterdir()) == ["checker.ts", "index.ts", "schema.ts", "types.ts"]
    assert main(["--config", str(settings), "migration", s, "--name", "first"]) == 0 and len(list((tmp_path / "sql").iterdir())) == 2
    view = tmp_path / "view.sql"
    view.write_text("SELECT 'user' AS subject_type, cast(u AS STRING) AS subject_id, 'viewer' AS relation, 'doc' AS object_type, d AS object_id FROM t UNION SELECT 'user', v, 'viewer', 'doc', e FROM w")
    capsys.readouterr()
    assert main(["doctor", s, "--tuples", t, "--view", str(view)]) == 0
    shown = capsys.readouterr().out
    assert "[warn] union all" in shown and "[warn] converted ids: t.u as subject_id" in shown and "t, w" in shown
