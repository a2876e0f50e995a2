"""Command line: python -m relgrove COMMAND ...

Arguments that are left out come from the settings (see ``config``).
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from relgrove import __version__, codegen, config, doctor, migrations
from relgrove.plans.analysis import Analysis, CyclicSchema, validate
from relgrove.plans.dsl import SchemaError, load
from relgrove.plans.json_model import from_json, to_json
from relgrove.plans.model import Model, UnknownName

#: Exit codes: done; denied, unhealthy or another error; settings or arguments; a schema; a table that can't be read.
DONE, GENERAL, CONFIG, SCHEMA, STORAGE = range(5)

_CODES = [((SchemaError, UnknownName, CyclicSchema), SCHEMA), (config.ConfigError, CONFIG), ((ValueError, OSError), GENERAL)]

EXAMPLE = """model
  schema 1.1

type user

type document
  relations
    define owner: [user]
    define viewer: [user, user:*] or owner
"""

LICENSE = "relgrove is for use under the terms that its repository states. It runs on Apache Spark (Apache License 2.0)."


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("relgrove").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _model(path: str) -> Model:
    return from_json(Path(path).read_text()) if str(path).endswith(".json") else load(path)


def _analysis(args) -> Analysis:
    return validate(_model(args.schema))


def _engine(args, spark):
    from relgrove.operators.verbs import Engine
    from relgrove.sources.tuples import read

    return Engine(_analysis(args), read(spark, args.tuples, args.settings["format"]))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="relgrove")
    p.add_argument("--config", help="the settings' file")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, given: tuple[str, ...] = ()):
        """names: required arguments; given: options that settings may name, too."""
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        for n in given:
            c.add_argument(f"--{n.rpartition('.')[2].replace('_', '-')}", dest=n)
        return c

    command("version")
    command("license")
    command("config")
    command("init", "path")
    command("validate", "schema")
    command("convert", "schema")
    command("diff", "old", "new")
    c = command("client", "schema", given=("client.language", "client.output", "client.package", "client.filter", "client.id_type"))
    c.add_argument("--write", action="store_true", help="write files instead of printing them")
    c = command("migration", "schema", given=("migration.output", "migration.name", "migration.form"))
    c.add_argument("--from", dest="old", help="the schema that is installed")
    for name in ("check", "explain"):
        c = command(name, "schema", "tuples", "subject", "relation", "object")
        c.add_argument("--json", action="store_true")
        c.add_argument("--max-nodes", type=int)
    c = command("expand", "schema", "tuples", "object", "relation")
    c.add_argument("--recursive", action="store_true")
    c.add_argument("--json", action="store_true")
    c.add_argument("--max-leaf", type=int)
    command("list-objects", "schema", "tuples", "subject", "relation", "type").add_argument("--limit", type=int, default=0)
    command("list-subjects", "schema", "tuples", "object", "relation", "type").add_argument("--limit", type=int, default=0)
    c = command("migrate", "schema", "registry")
    c.add_argument("--force", action="store_true", default=None, dest="migrate.force")
    c.add_argument("--dry-run", action="store_true", default=None, dest="migrate.dry_run")
    command("status", "schema", "registry")
    command("doctor", "schema", given=("tuples", "registry", "doctor.view"))
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        args.settings = config.load(args.config)
        for name, value in args.settings.items():  # what was not given comes from the settings
            if getattr(args, name, None) is None:
                setattr(args, name, value)
        return _run(args)
    except Exception as e:
        code = next((c for kinds, c in _CODES if isinstance(e, kinds)), None)
        if code is None and type(e).__module__.partition(".")[0] not in ("pyspark", "py4j"):
            raise
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return STORAGE if code is None else code


def _run(args) -> int:
    if args.command == "version":
        print(__version__)
        return DONE
    if args.command == "license":
        print(LICENSE)
        return DONE
    if args.command == "config":
        print("\n".join(f"{k} = {v!r}" for k, v in args.settings.items()))
        return DONE
    if args.command == "init":
        path = Path(args.path)
        if path.exists():
            raise ValueError(f"{path} is there already")
        path.write_text(EXAMPLE)
        return DONE
    if args.command == "diff":
        from relgrove.registry import difference

        print(difference(_model(args.old), _model(args.new)))
        return DONE
    if args.command == "validate":
        a = _analysis(args)
        print(f"{len(a.model.types)} types, {len(a.model.nodes())} relations")
        return DONE
    if args.command == "convert":
        import json

        model = _model(args.schema)
        print(model.to_dsl() if args.schema.endswith(".json") else json.dumps(to_json(model), indent=2))
        return DONE
    if args.command == "client":
        option = lambda n: getattr(args, f"client.{n}")
        files = codegen.client(_model(args.schema), option("language"), option("id_type"), option("package"), option("filter"))
        for name, text in files.items():
            if args.write:
                Path(option("output")).mkdir(parents=True, exist_ok=True)
                (Path(option("output")) / name).write_text(text)
            else:
                print(text, end="")
        return DONE
    if args.command == "migration":
        option = lambda n: getattr(args, f"migration.{n}")
        made = migrations.write(option("output"), option("name"), _model(args.schema), _model(args.old) if args.old else None, option("form"))
        print("\n".join(map(str, made)) or "nothing changes")
        return DONE
    spark = _spark()
    if args.command in ("migrate", "status"):
        from relgrove.registry import Registry, as_json

        text, registry = Path(args.schema).read_text(), Registry(spark, args.registry)
        print(as_json(registry.migrate(text, getattr(args, "migrate.force"), getattr(args, "migrate.dry_run")) if args.command == "migrate" else registry.status(text)))
        return DONE
    if args.command == "doctor":
        from relgrove.registry import Registry
        from relgrove.sources.tuples import read

        text = Path(args.schema).read_text()
        try:
            analysis, error = _analysis(args), None
        except (SchemaError, UnknownName, CyclicSchema) as e:
            analysis, error = None, str(e)
        view = getattr(args, "doctor.view")
        found = doctor.examine(analysis, read(spark, args.tuples, args.settings["format"]) if args.tuples else None, Registry(spark, args.registry) if args.registry else None, text, error, Path(view).read_text() if view else None)
        print(doctor.render(found))
        return GENERAL if any(f.status == doctor.FAIL for f in found) else DONE
    from relgrove.checker import Checker, Page
    from relgrove.operators.trees import render_expand, render_trace
    from relgrove.registry import as_json

    checker = Checker(_engine(args, spark))
    if args.command == "check":
        held = checker.check(args.subject, args.relation, args.object)
        print("allowed" if held else "denied")
        return DONE if held else GENERAL
    if args.command == "explain":
        trace = checker.explain(args.subject, args.relation, args.object, args.max_nodes)
        print(as_json(trace) if args.json else render_trace(trace))
    elif args.command == "expand":
        if args.recursive:
            print("\n".join(checker.expand_recursive(args.object, args.relation)))
        else:
            tree = checker.expand(args.object, args.relation, max_leaf=args.max_leaf)
            print(as_json(tree) if args.json else render_expand(tree))
    elif args.command == "list-objects":
        print("\n".join(checker.list_objects(args.subject, args.relation, args.type, Page(args.limit))[0]))
    else:
        print("\n".join(checker.list_subjects(args.object, args.relation, args.type, Page(args.limit))[0]))
    return DONE


if __name__ == "__main__":
    sys.exit(main())
