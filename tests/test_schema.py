import pytest

from relgrove.plans.analysis import Analysis, CyclicSchema, UnstratifiedSchema, validate
from relgrove.plans.dsl import SchemaError, load, parse, parse_expression, parse_modules
from relgrove.plans.model import Computed, Difference, FromLink, Intersection, SubjectRef, This, Union, UnknownName


def model(*lines, version="1.1"):
    return parse(f"model\n  schema {version}\n" + "\n".join(lines))


def test_expressions():
    assert parse_expression("[user, user:*, group#member]") == This((SubjectRef("user"), SubjectRef("user", wildcard=True), SubjectRef("group", "member")))
    assert parse_expression("a or b from c") == Union((Computed("a"), FromLink("b", "c")))
    assert parse_expression("a and (b but not c)") == Intersection((Computed("a"), Difference(Computed("b"), Computed("c"))))
    assert parse_expression("((a))") == Computed("a")
    for bad in ("a or b and c", "a but not b but not c", "a or", "[user", "a b", "[user with c]", "", "a from", "a ? b"):
        with pytest.raises(SchemaError):
            parse_expression(bad)


def test_statements_and_comments():
    m = model("# a comment", "type user  # with more", "type group", "  relations", "    define member: [user, group#member]  # usersets keep their sign", "    define long: [user,", "      group#member] or member")
    assert m.refs("group", "member") == (SubjectRef("user"), SubjectRef("group", "member"))
    assert isinstance(m.expr("group", "long"), Union)
    assert parse(m.to_dsl()) == m


@pytest.mark.parametrize(
    "lines, error",
    [
        (["type user", "type user"], SchemaError),
        (["define a: [user]"], SchemaError),
        (["type user", "what is this"], SchemaError),
        (["type user", "condition c(x: int) {"], SchemaError),
        (["type doc", "  relations", "    define a: [user]"], UnknownName),
        (["type doc", "  relations", "    define a: b"], UnknownName),
        (["type user", "type doc", "  relations", "    define p: [user]", "    define a: b from p"], UnknownName),
        (["type user", "type doc", "  relations", "    define a: [user#nope]"], UnknownName),
    ],
)
def test_refused(lines, error):
    with pytest.raises(error):
        model(*lines)


def test_versions():
    with pytest.raises(SchemaError):
        model("type user", version="1.0")
    with pytest.raises(SchemaError):
        parse("model\ntype user")


def test_modules(tmp_path):
    (tmp_path / "core.fga").write_text("module core\ntype user\ntype org\n  relations\n    define member: [user]\n")
    (tmp_path / "docs.fga").write_text("module docs\nextend type org\n  relations\n    define editor: [user] or member\n")
    (tmp_path / "fga.mod").write_text("schema: '1.2'\ncontents:\n  - core.fga\n  - docs.fga\n")
    m = load(tmp_path / "fga.mod")
    one = parse("model\n  schema 1.2\ntype user\ntype org\n  relations\n    define member: [user]\n    define editor: [user] or member\n")
    assert m == one
    with pytest.raises(SchemaError):
        parse_modules({"a": "module a\nextend type nope\n  relations\n    define x: [nope]\n"})


def test_closure_and_rules():
    a = Analysis(model("type user", "type doc", "  relations", "    define owner: [user]", "    define editor: [user] or owner", "    define viewer: editor but not banned", "    define banned: [user, doc#editor]"))
    assert set(a.closure["doc", "viewer"]) == {"viewer", "editor", "owner"}
    assert ("doc", "viewer", "owner", "viewer > editor > owner") in a.closure_rows()
    assert {r[4] for r in a.userset_rules()} == {"editor", "owner"}
    assert a.features(("doc", "viewer")) == {"implied", "exclusion"}
    assert a.resolved_types["doc", "viewer"] == {"user"}


def test_cycles():
    with pytest.raises(CyclicSchema):
        validate(model("type user", "type doc", "  relations", "    define a: [user] or b", "    define b: a"))
    same_relation = ["type user", "type a", "  relations", "    define p: [b]", "    define v: [user] or v from p", "type b", "  relations", "    define p: [a]", "    define v: [user] or v from p"]
    validate(model(*same_relation))
    with pytest.raises(CyclicSchema):
        validate(model("type user", "type a", "  relations", "    define p: [b]", "    define v: [user] or w from p", "type b", "  relations", "    define p: [a]", "    define w: v from p"))


def test_unstratified_and_depth():
    m = model("type user", "type doc", "  relations", "    define p: [doc]", "    define v: [user] but not v from p")
    with pytest.raises(UnstratifiedSchema):
        Analysis(m).check_stratified(Analysis(m).order)
    lines = ["type user", "type g", "  relations", "    define r0: [user]"] + [f"    define r{k}: [g#r{k - 1}]" for k in range(1, 27)]
    assert Analysis(model(*lines)).userset_depth["g", "r26"] == 26
