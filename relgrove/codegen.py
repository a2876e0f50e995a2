"""Generates clients' constants and constructors for a model's types and relations, in Python, TypeScript and Go."""

from __future__ import annotations

import json
import keyword
import re

from relgrove.plans.analysis import validate
from relgrove.plans.model import Model

LANGUAGES = ("python", "typescript", "go")


def _name(text: str) -> str:
    name = re.sub(r"\W", "_", text)
    return f"{name}_" if keyword.iskeyword(name) or name[:1].isdigit() else name


def _pascal(text: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[^A-Za-z0-9]+", text) if w)


def _camel(text: str) -> str:
    name = _pascal(text)
    return name[:1].lower() + name[1:]


def _relations(model: Model, prefix: str) -> list[str]:
    return sorted({r for _, r in model.nodes() if r.startswith(prefix)})


def python_client(model: Model, id_type: str = "str", relation_prefix: str = "") -> str:
    """The module's text. relation_prefix: only relations that begin so get a constant."""
    lines = ['"""Types and relations of the authorization model."""', "", "from relgrove.checker import Object", ""]
    lines += [f'TYPE_{_name(t).upper()} = "{t}"' for t in model.types] + [""]
    lines += [f'REL_{_name(r).upper()} = "{r}"' for r in _relations(model, relation_prefix)]
    for t in model.types:
        lines += ["", "", f"def {_name(t)}(id: {id_type}) -> Object:", f'    return Object("{t}", str(id))']
    for t in model.subject_types():
        lines += ["", "", f"def any_{_name(t)}() -> Object:", f'    return Object("{t}", "*")']
    return "\n".join(lines) + "\n"


def typescript_client(model: Model, id_type: str = "string", relation_prefix: str = "") -> dict[str, str]:
    """Files by name: ``types.ts`` (constants), ``schema.ts`` (constructors), ``checker.ts`` (the verbs over a connection that runs SQL), ``index.ts``."""
    types, relations = sorted(model.types), _relations(model, relation_prefix)
    table = lambda name, items: [f"export const {name} = {{", *(f"  {_pascal(x)}: {json.dumps(x)}," for x in items), "} as const;", f"export type {name[:-1]} = (typeof {name})[keyof typeof {name}];", ""]
    consts = table("ObjectTypes", types) + table("Relations", relations) + ["export interface Ref {", "  type: ObjectType;", "  id: string;", "}"]
    makers = ['import { ObjectTypes, type Ref } from "./types.js";', ""]
    for t in types:
        makers += [f"export const {_camel(t)} = (id: {id_type}): Ref => ({{ type: ObjectTypes.{_pascal(t)}, id: String(id) }});", f'export const any{_pascal(t)} = (): Ref => ({{ type: ObjectTypes.{_pascal(t)}, id: "*" }});']
    return {
        "types.ts": "\n".join(consts) + "\n",
        "schema.ts": "\n".join(makers) + "\n",
        "checker.ts": _CHECKER_TS,
        "index.ts": "".join(f'export * from "./{m}.js";\n' for m in ("types", "schema", "checker")),
    }


_CHECKER_TS = """import type { ObjectType, Ref, Relation } from "./types.js";

/** Runs a statement with ? parameters over any connection to Spark SQL and gives its rows. */
export type Query = (sql: string, parameters: string[]) => Promise<Record<string, unknown>[]>;

const part = (text: string): string => text.replace(/\\W/g, "_");
const fn = (verb: string, type: string, relation: string, suffix = ""): string =>
  [verb, part(type), part(relation), suffix].filter((x) => x !== "").join("_");

export class Denied extends Error {}

/** The verbs, by the SQL functions that the engine registers for each relation. */
export class Checker {
  private readonly cache = new Map<string, { value: boolean; at: number }>();

  constructor(
    private readonly query: Query,
    private readonly options: { ttl?: number; decision?: "allow" | "deny" } = {},
  ) {}

  async check(subject: Ref, relation: Relation, object: Ref): Promise<boolean> {
    if (this.options.decision) return this.options.decision === "allow";
    const key = JSON.stringify([subject, relation, object]);
    const ttl = this.options.ttl ?? 0;
    const known = this.cache.get(key);
    if (known && Date.now() - known.at < ttl) return known.value;
    const rows = await this.query(`SELECT allowed FROM ${fn("check", object.type, relation)}(?, ?, ?)`, [subject.type, subject.id, object.id]);
    const value = Number(rows[0]?.allowed ?? 0) === 1;
    if (ttl > 0) this.cache.set(key, { value, at: Date.now() });
    return value;
  }

  async must(subject: Ref, relation: Relation, object: Ref): Promise<void> {
    if (!(await this.check(subject, relation, object))) throw new Denied(`${subject.type}:${subject.id} is not ${relation} of ${object.type}:${object.id}`);
  }

  async checkBulk(requests: { subject: Ref; relation: Relation; object: Ref }[]): Promise<boolean[]> {
    return Promise.all(requests.map((r) => this.check(r.subject, r.relation, r.object)));
  }

  async listObjects(subject: Ref, relation: Relation, type: ObjectType, page: { limit?: number; after?: string } = {}): Promise<{ items: string[]; nextCursor?: string }> {
    if (this.options.decision === "deny") return { items: [] };
    return this.page(fn("list", type, relation, "obj"), "object_id", [subject.type, subject.id], page);
  }

  async listSubjects(object: Ref, relation: Relation, type: ObjectType, page: { limit?: number; after?: string } = {}): Promise<{ items: string[]; nextCursor?: string }> {
    if (this.options.decision === "deny") return { items: [] };
    return this.page(fn("list", object.type, relation, "sub"), "subject_id", [object.id, type], page);
  }

  async explain(subject: Ref, relation: Relation, object: Ref): Promise<Record<string, unknown>[]> {
    return this.query(`SELECT * FROM ${fn("explain", object.type, relation)}(?, ?, ?)`, [subject.type, subject.id, object.id]);
  }

  async expand(object: Ref, relation: Relation): Promise<Record<string, unknown>[]> {
    return this.query(`SELECT * FROM ${fn("expand", object.type, relation)}(?)`, [object.id]);
  }

  private async page(table: string, column: string, parameters: string[], page: { limit?: number; after?: string }): Promise<{ items: string[]; nextCursor?: string }> {
    const call = `${table}(${parameters.map(() => "?").join(", ")})`;
    const after = page.after === undefined ? "" : ` WHERE ${column} > ?`;
    const limit = page.limit && page.limit > 0 ? ` LIMIT ${Math.floor(page.limit) + 1}` : "";
    const sql = `SELECT DISTINCT ${column} FROM ${call}${after} ORDER BY ${column}${limit}`;
    const found = (await this.query(sql, page.after === undefined ? parameters : [...parameters, page.after])).map((r) => String(r[column]));
    if (!limit || found.length <= Math.floor(page.limit as number)) return { items: found };
    const items = found.slice(0, Math.floor(page.limit as number));
    return { items, nextCursor: items[items.length - 1] };
  }
}
"""


def go_client(model: Model, package: str = "authz", id_type: str = "string", relation_prefix: str = "") -> str:
    """A Go file of constants and constructors; it needs nothing but the standard library."""
    types, relations = sorted(model.types), _relations(model, relation_prefix)
    block = lambda word, kind, items: ["const (", *(f"\t{word}{_pascal(x)} {kind} = {json.dumps(x)}" for x in items), ")", ""]
    lines = ["// Generated from the authorization model. Do not edit.", "", f"package {package}", ""]
    lines += ['import "fmt"', ""] if id_type != "string" else []
    lines += ["type ObjectType string", "", "type Relation string", "", "type Object struct {", "\tType ObjectType", "\tID   string", "}", ""]
    lines += block("Type", "ObjectType", types) + block("Rel", "Relation", relations)
    as_text = "id" if id_type == "string" else "fmt.Sprint(id)"
    for t in types:
        lines += [f"func {_pascal(t)}(id {id_type}) Object {{ return Object{{Type: Type{_pascal(t)}, ID: {as_text}}} }}", "", f'func Any{_pascal(t)}() Object {{ return Object{{Type: Type{_pascal(t)}, ID: "*"}} }}', ""]
    return "\n".join(lines)


def client(model: Model, language: str, id_type: str | None = None, package: str = "authz", relation_prefix: str = "") -> dict[str, str]:
    """The files of a client, by name; a model that can't be used raises."""
    validate(model)
    if language == "python":
        return {f"{_name(package)}.py": python_client(model, id_type or "str", relation_prefix)}
    if language == "typescript":
        return typescript_client(model, id_type or "string", relation_prefix)
    if language == "go":
        return {"schema_gen.go": go_client(model, package, id_type or "string", relation_prefix)}
    raise ValueError(f"no client for {language!r}; there is one for each of {', '.join(LANGUAGES)}")
