"""The registered queries: a model over the order tables, its tuples, and each query with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgrove.doctor import misfits, signatures
from relgrove.functions.sql import bulk_from_arrays, register
from relgrove.operators.common import new_folder
from relgrove.operators.trees import Trees, expand_links, expand_rows, expand_users
from relgrove.operators.verbs import REQUEST, Engine
from relgrove.plans.analysis import Analysis, validate
from relgrove.plans.dsl import parse
from relgrove.sources.tuples import COLUMNS, Mapping, read_store, tuples_from_rows, tuples_of, with_contextual, write_store

SCHEMA = """
model
  schema 1.1

type user
type service

type region
  relations
    define head: [user]

type org
  relations
    define region: [region]
    define owner: [user]
    define admin: [user] or owner
    define member: [user] or admin
    define auditor: [user]
    define head: head from region

type group
  relations
    define member: [user, group#member]
    define banned: [user]
    define live: [user, user:*, group#live] but not banned

type folder
  relations
    define parent: [folder]
    define shared: [group#member]
    define viewer: [user, group#member] or viewer from parent
    define visitor: [group#live]
    define approved: viewer and viewer from parent

type club
  relations
    define guest: [user]

type order
  relations
    define org: [org]
    define owner: [user]
    define supplier: [service]
    define public: [user:*]
    define active: [user]
    define seen: [user]
    define blocked: [user]
    define frozen: [user, user:*]
    define can_read: owner or active
    define visible: [user] or public or owner
    define auditor: auditor from org
    define head: head from org
    define own_active: owner and active
    define confirmed: [user] and owner
    define owner_auditor: owner and auditor from org
    define unblocked: active but not blocked
    define safe: owner but not frozen
    define other_owner: owner but not own_active
    define outside_owner: owner but not auditor from org
    define calm_owner: owner but not (active and blocked)
    define grouped: (owner or active) and (seen or (blocked but not frozen))
    define readable: safe or unblocked
"""

#: How many orders there are; ids of events are spread over them.
_SQL_TUPLES = """
n AS (SELECT count(*) AS n FROM orders),
tuples AS (
 SELECT 'user' AS subject_type, 'c' || o_custkey AS subject_id, 'owner' AS relation, 'order' AS object_type, 'o' || o_orderkey AS object_id FROM orders
 UNION ALL SELECT 'user', 'c' || c_custkey, CASE WHEN c_acctbal > 9000 THEN 'owner' WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'member' END, 'org', 'n' || c_nationkey FROM customer
 UNION ALL SELECT 'user', 'c' || c_custkey, 'auditor', 'org', 'n' || c_nationkey FROM customer WHERE c_acctbal > 9900
 UNION ALL SELECT 'region', 'r' || n_regionkey, 'region', 'org', 'n' || n_nationkey FROM nation
 UNION ALL SELECT 'user', 'c' || r_regionkey, 'head', 'region', 'r' || r_regionkey FROM region
 UNION ALL SELECT 'org', 'n' || c_nationkey, 'org', 'order', 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT 'service', 's' || l_suppkey, 'supplier', 'order', 'o' || l_orderkey FROM lineitem
 UNION ALL SELECT 'user', 'c' || c_custkey, 'member', 'group', 'g' || (c_custkey % 64) FROM customer
 UNION ALL SELECT 'group', 'g' || i || '#member', 'member', 'group', 'g' || ((i - 1) // 2) FROM (SELECT unnest(generate_series(1, 63)) AS i)
 UNION ALL SELECT 'folder', 'p' || ((p_partkey - 1) // 2), 'parent', 'folder', 'p' || p_partkey FROM part WHERE p_partkey >= 1
 UNION ALL SELECT 'group', 'g' || s_suppkey % 64 || '#member', 'shared', 'folder', 'p' || s_suppkey FROM supplier
 UNION ALL SELECT 'group', 'g' || s_suppkey % 64 || '#member', 'viewer', 'folder', 'p' || (s_suppkey * 5 + 40) FROM supplier WHERE s_suppkey >= 32
 UNION ALL SELECT 'user', 'c' || c_custkey, 'viewer', 'folder', 'p' || (c_custkey + 3) FROM customer WHERE c_acctbal > 9500
 UNION ALL SELECT 'user', '*', 'public', 'order', 'o' || o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'
 UNION ALL SELECT 'user', '*', 'frozen', 'order', 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P'
 UNION ALL SELECT 'user', 'c' || user_id, CASE event_type WHEN 'purchase' THEN 'active' WHEN 'view' THEN 'seen' WHEN 'error' THEN 'blocked' WHEN 'click' THEN 'visible' ELSE 'frozen' END, 'order', 'o' || event_id % n.n FROM events, n
 UNION ALL SELECT 'user', 'c' || o_custkey, 'active', 'order', 'o' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT 'user', 'c' || o_custkey, 'blocked', 'order', 'o' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
 UNION ALL SELECT 'user', 'c' || o_custkey, 'confirmed', 'order', 'o' || o_orderkey FROM orders WHERE o_totalprice > 100000
 UNION ALL SELECT 'user', 'c' || c_custkey, 'live', 'group', 'g' || (c_custkey % 64) FROM customer WHERE c_mktsegment = 'BUILDING'
 UNION ALL SELECT 'user', 'c' || c_custkey, 'banned', 'group', 'g' || (c_custkey % 32) FROM customer WHERE c_acctbal < -500
 UNION ALL SELECT 'group', 'g' || i || '#live', 'live', 'group', 'g' || (i // 8 * 8 + (i + 1) % 8) FROM (SELECT unnest(generate_series(0, 63)) AS i)
 UNION ALL SELECT 'group', 'g' || s_suppkey % 64 || '#live', 'visitor', 'folder', 'p' || s_suppkey FROM supplier
 UNION ALL SELECT 'user', 'c' || c_custkey, 'guest', 'club', 'k' || (c_custkey % 3) FROM customer
)"""


@lru_cache(maxsize=1)
def analysis() -> Analysis:
    return validate(parse(SCHEMA))


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tuples of the model, from the tables below ``sf_dir``."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    ident = lambda prefix, c: F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))
    low = lambda c: F.expr(f"({c} - 1) div 2")
    events = t["events"].crossJoin(t["orders"].agg(F.count(F.lit(1)).alias("n")))
    kinds = F.when(F.col("event_type") == "purchase", "active").when(F.col("event_type") == "view", "seen").when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "click", "visible").otherwise("frozen")
    role = F.when(F.col("c_acctbal") > 9000, "owner").when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("member")
    numbers = lambda a, b: spark.range(a, b).withColumnRenamed("id", "i")
    group = F.concat(F.lit("g"), (F.col("s_suppkey") % 64).cast("string"))
    of_orders = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return tuples_of(
        [
            Mapping(t["orders"], "user", ident("c", "o_custkey"), "owner", "order", ident("o", "o_orderkey")),
            Mapping(t["customer"], "user", ident("c", "c_custkey"), role, "org", ident("n", "c_nationkey")),
            Mapping(t["customer"], "user", ident("c", "c_custkey"), "auditor", "org", ident("n", "c_nationkey"), F.col("c_acctbal") > 9900),
            Mapping(t["nation"], "region", ident("r", "n_regionkey"), "region", "org", ident("n", "n_nationkey")),
            Mapping(t["region"], "user", ident("c", "r_regionkey"), "head", "region", ident("r", "r_regionkey")),
            Mapping(of_orders, "org", ident("n", "c_nationkey"), "org", "order", ident("o", "o_orderkey")),
            Mapping(t["lineitem"], "service", ident("s", "l_suppkey"), "supplier", "order", ident("o", "l_orderkey")),
            Mapping(t["customer"], "user", ident("c", "c_custkey"), "member", "group", ident("g", F.col("c_custkey") % 64)),
            Mapping(numbers(1, 64), "group", F.concat(ident("g", "i"), F.lit("#member")), "member", "group", ident("g", low("i"))),
            Mapping(t["part"], "folder", ident("p", low("p_partkey")), "parent", "folder", ident("p", "p_partkey"), F.col("p_partkey") >= 1),
            Mapping(t["supplier"], "group", F.concat(group, F.lit("#member")), "shared", "folder", ident("p", "s_suppkey")),
            Mapping(t["supplier"], "group", F.concat(group, F.lit("#member")), "viewer", "folder", ident("p", F.col("s_suppkey") * 5 + 40), F.col("s_suppkey") >= 32),
            Mapping(t["customer"], "user", ident("c", "c_custkey"), "viewer", "folder", ident("p", F.col("c_custkey") + 3), F.col("c_acctbal") > 9500),
            Mapping(t["orders"], "user", F.lit("*"), "public", "order", ident("o", "o_orderkey"), F.col("o_orderpriority") == "5-LOW"),
            Mapping(t["orders"], "user", F.lit("*"), "frozen", "order", ident("o", "o_orderkey"), F.col("o_orderstatus") == "P"),
            Mapping(events, "user", ident("c", "user_id"), kinds, "order", ident("o", F.col("event_id") % F.col("n"))),
            Mapping(t["orders"], "user", ident("c", "o_custkey"), "active", "order", ident("o", "o_orderkey"), urgent),
            Mapping(t["orders"], "user", ident("c", "o_custkey"), "blocked", "order", ident("o", "o_orderkey"), urgent & (F.col("o_orderstatus") == "F")),
            Mapping(t["orders"], "user", ident("c", "o_custkey"), "confirmed", "order", ident("o", "o_orderkey"), F.col("o_totalprice") > 100000),
            Mapping(t["customer"], "user", ident("c", "c_custkey"), "live", "group", ident("g", F.col("c_custkey") % 64), F.col("c_mktsegment") == "BUILDING"),
            Mapping(t["customer"], "user", ident("c", "c_custkey"), "banned", "group", ident("g", F.col("c_custkey") % 32), F.col("c_acctbal") < -500),
            Mapping(numbers(0, 64), "group", F.concat(ident("g", "i"), F.lit("#live")), "live", "group", ident("g", F.expr("i div 8 * 8 + (i + 1) % 8"))),
            Mapping(t["supplier"], "group", F.concat(group, F.lit("#live")), "visitor", "folder", ident("p", "s_suppkey")),
            Mapping(t["customer"], "user", ident("c", "c_custkey"), "guest", "club", ident("k", F.col("c_custkey") % 3)),
        ]
    )


#: Where the tuples of a folder of tables are stored, by application and folder.
_STORES: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's tuples, derived from the tables by the application's first query and stored for the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = new_folder(spark, "tuples")
        write_store(tuples(spark, sf_dir), path)
        _STORES[key] = path
    return read_store(spark, _STORES[key])


def engine(spark: SparkSession, sf_dir: str, max_depth: int = 100) -> Engine:
    return Engine(analysis(), stored(spark, sf_dir), max_depth=max_depth)


def _users(e: Engine) -> DataFrame:
    """All users that have a tuple, apart from the wildcard."""
    return e.tuples.where("subject_type = 'user' AND subject_id != '*'").select("subject_type", "subject_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(body: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {_SQL_TUPLES}{',' if ctes else ''}\n{ctes}\n{body}"


def _rel(relation: str, kind: str = "order", where: str = "subject_id <> '*'") -> str:
    """(s, o) of a relation's own tuples of plain users."""
    return f"(SELECT DISTINCT subject_id AS s, object_id AS o FROM tuples WHERE relation = '{relation}' AND object_type = '{kind}' AND subject_type = 'user' AND {where})"


def _register(name: str, run: Callable[[Engine, SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(engine(spark, sf_dir), spark, sf_dir)
    if sql:
        ORACLES[name] = sql


def _objects(name: str, relation: str, value: str, kind: str = "order", ctes: str = "") -> None:
    """Registers list objects for all users at once; ``value`` is SQL for (s, o)."""
    _register(name, lambda e, *_: e.objects_of(_users(e), relation, kind).select("subject_id", "object_id"), _sql(f"SELECT DISTINCT s AS subject_id, o AS object_id FROM ({value}) v", ctes))


def _subjects(name: str, relation: str, value: str, kind: str = "order", subject: str = "user", ctes: str = "") -> None:
    """Registers list subjects for all objects at once."""
    _register(name, lambda e, *_: e.subjects_of(kind, relation, subject).select("object_id", "subject_id"), _sql(f"SELECT DISTINCT o AS object_id, s AS subject_id FROM ({value}) v", ctes))


OWNER, ACTIVE, BLOCKED, SEEN = (f"SELECT * FROM {_rel(r)}" for r in ("owner", "active", "blocked", "seen"))
AUDITOR = "SELECT DISTINCT a.subject_id AS s, l.object_id AS o FROM tuples a JOIN tuples l ON l.relation = 'org' AND l.object_type = 'order' AND l.subject_type = 'org' AND l.subject_id = a.object_id WHERE a.relation = 'auditor' AND a.object_type = 'org'"
STARRED = "SELECT object_id FROM tuples WHERE relation = 'frozen' AND subject_id = '*'"
FROZEN_NAMES = _rel("frozen")
SAFE = f"SELECT s, o FROM ({OWNER}) x WHERE o NOT IN ({STARRED}) AND NOT EXISTS (SELECT 1 FROM {FROZEN_NAMES} f WHERE f.s = x.s AND f.o = x.o)"
UNBLOCKED = f"SELECT s, o FROM ({ACTIVE}) a EXCEPT SELECT s, o FROM ({BLOCKED}) b"
MEMBERS = """
m AS (
 SELECT subject_id AS s, object_id AS o FROM tuples WHERE object_type = 'group' AND relation = 'member' AND subject_type = 'user'
 UNION SELECT m.s, t.object_id FROM m JOIN tuples t ON t.object_type = 'group' AND t.relation = 'member' AND t.subject_type = 'group' AND t.subject_id = m.o || '#member'
)"""
VIEWERS = (
    MEMBERS
    + """,
v AS (
 SELECT subject_id AS s, object_id AS o FROM tuples WHERE object_type = 'folder' AND relation = 'viewer' AND subject_type = 'user'
 UNION SELECT m.s, t.object_id FROM m JOIN tuples t ON t.object_type = 'folder' AND t.relation = 'viewer' AND t.subject_id = m.o || '#member'
 UNION SELECT v.s, t.object_id FROM v JOIN tuples t ON t.object_type = 'folder' AND t.relation = 'parent' AND t.subject_id = v.o
)"""
)
GROUPS_OF = """
gg AS (
 SELECT DISTINCT object_id AS s, object_id AS o FROM tuples WHERE object_type = 'group'
 UNION SELECT gg.s, t.object_id FROM gg JOIN tuples t ON t.object_type = 'group' AND t.relation = 'member' AND t.subject_type = 'group' AND t.subject_id = gg.o || '#member'
),
fv AS (
 SELECT gg.s || '#member' AS s, t.object_id AS o FROM gg JOIN tuples t ON t.object_type = 'folder' AND t.relation = 'viewer' AND t.subject_id = gg.o || '#member'
 UNION SELECT fv.s, t.object_id FROM fv JOIN tuples t ON t.object_type = 'folder' AND t.relation = 'parent' AND t.subject_id = fv.o
)"""
LIVE = """
bn AS (SELECT DISTINCT subject_id AS s, object_id AS o FROM tuples WHERE object_type = 'group' AND relation = 'banned'),
lv AS (
 SELECT subject_id AS s, object_id AS o FROM tuples t WHERE object_type = 'group' AND relation = 'live' AND subject_type = 'user' AND NOT EXISTS (SELECT 1 FROM bn WHERE bn.s = t.subject_id AND bn.o = t.object_id)
 UNION SELECT lv.s, t.object_id FROM lv JOIN tuples t ON t.object_type = 'group' AND t.relation = 'live' AND t.subject_id = lv.o || '#live' WHERE NOT EXISTS (SELECT 1 FROM bn WHERE bn.s = lv.s AND bn.o = t.object_id)
)"""

_register("scan_tuples", lambda e, *_: e.tuples.where("object_type = 'org'").select(*COLUMNS).distinct(), _sql("SELECT DISTINCT * FROM tuples WHERE object_type = 'org'"))
_objects("list_objects_direct", "owner", OWNER)
_subjects("list_subjects_direct", "owner", OWNER)
_subjects("list_subjects_service", "supplier", "SELECT subject_id AS s, object_id AS o FROM tuples WHERE relation = 'supplier'", subject="service")
_objects("computed_union", "can_read", f"{OWNER} UNION {ACTIVE}")
_objects("role_closure", "member", "SELECT subject_id AS s, object_id AS o FROM tuples WHERE object_type = 'org' AND relation IN ('owner', 'admin', 'member')", "org")
_register(
    "wildcard_list_objects",
    lambda e, *_: e.list_objects("user", "c42", "visible", "order"),
    _sql("SELECT DISTINCT object_id, CAST(NULL AS VARCHAR) AS next_cursor FROM tuples WHERE object_type = 'order' AND ((relation IN ('visible', 'owner') AND subject_id = 'c42') OR relation = 'public')"),
)
_subjects("wildcard_list_subjects", "visible", "SELECT subject_id AS s, object_id AS o FROM tuples WHERE object_type = 'order' AND relation IN ('visible', 'owner', 'public')")
_objects("userset_simple", "shared", "SELECT m.s, t.object_id AS o FROM m JOIN tuples t ON t.relation = 'shared' AND t.subject_id = m.o || '#member'", "folder", MEMBERS)
_objects("userset_nested_recursive", "member", "SELECT s, o FROM m", "group", MEMBERS)
_subjects("userset_nested_subjects", "member", "SELECT s, o FROM m", "group", ctes=MEMBERS)
_objects("ttu_cross_type", "auditor", AUDITOR)
_objects("ttu_recursive_tree", "viewer", "SELECT s, o FROM v", "folder", VIEWERS)
_subjects("ttu_recursive_subjects", "viewer", "SELECT s, o FROM v", "folder", ctes=VIEWERS)
_objects("ttu_chain", "head", "SELECT h.subject_id AS s, o.object_id AS o FROM tuples h JOIN tuples r ON r.relation = 'region' AND r.subject_id = h.object_id JOIN tuples o ON o.relation = 'org' AND o.subject_id = r.object_id WHERE h.relation = 'head'")
_objects("intersection_two", "own_active", f"{OWNER} INTERSECT {ACTIVE}")
_objects("intersection_this", "confirmed", f"SELECT * FROM {_rel('confirmed')} INTERSECT {OWNER}")
_objects("intersection_ttu", "owner_auditor", f"{OWNER} INTERSECT {AUDITOR}")
_objects("exclusion_simple", "unblocked", UNBLOCKED)
_objects("exclusion_wildcard", "safe", SAFE)
_subjects("exclusion_wildcard_subjects", "safe", SAFE)
_objects("exclusion_complex", "other_owner", f"{OWNER} EXCEPT ({OWNER} INTERSECT {ACTIVE})")
_objects("exclusion_ttu", "outside_owner", f"{OWNER} EXCEPT {AUDITOR}")
_objects("exclusion_intersection", "calm_owner", f"{OWNER} EXCEPT ({ACTIVE} INTERSECT {BLOCKED})")
_objects("grouped_expression", "grouped", f"SELECT * FROM ({OWNER} UNION {ACTIVE}) a INTERSECT SELECT * FROM ({SEEN} UNION SELECT s, o FROM ({BLOCKED}) b WHERE o NOT IN ({STARRED}) AND NOT EXISTS (SELECT 1 FROM {FROZEN_NAMES} f WHERE f.s = b.s AND f.o = b.o)) c")
_objects("closure_inherited_exclusion", "readable", f"({SAFE}) UNION ({UNBLOCKED})")
_objects("recursive_exclusion", "live", "SELECT s, o FROM lv", "group", LIVE)
_subjects("recursive_exclusion_subjects", "live", "SELECT s, o FROM lv", "group", ctes=LIVE)
_subjects("userset_of_recursive_exclusion", "visitor", "SELECT lv.s, t.object_id AS o FROM lv JOIN tuples t ON t.relation = 'visitor' AND t.subject_id = lv.o || '#live'", "folder", ctes=LIVE)
_subjects("userset_filter_subjects", "viewer", "SELECT s, o FROM fv", "folder", "group#member", GROUPS_OF)
_register(
    "userset_subject_objects",
    lambda e, *_: e.list_objects("group", "g40#member", "viewer", "folder"),
    _sql("SELECT DISTINCT o AS object_id, CAST(NULL AS VARCHAR) AS next_cursor FROM fv WHERE s = 'g40#member'", GROUPS_OF),
)


def _requests(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    """A request for each event: may its user do that with the order of its number?"""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("event_id") + 1).cast("int").alias("idx"),
        F.lit("user").alias("subject_type"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("subject_id"),
        F.lit(relation).alias("relation"),
        F.lit("order").alias("object_type"),
        F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("object_id"),
    )


_register(
    "bulk_check",
    lambda e, spark, d: e.check_bulk(_requests(spark, d, "readable")),
    _sql(f"SELECT CAST(event_id + 1 AS INTEGER) AS idx, CAST(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.s = 'c' || user_id AND r.o = 'o' || event_id) THEN 1 ELSE 0 END AS INTEGER) AS allowed FROM events", f"r AS (({SAFE}) UNION ({UNBLOCKED}))"),
)
_register("bulk_check_unknown", lambda e, spark, d: e.check_bulk(_requests(spark, d, "no_such_relation")), "SELECT CAST(event_id + 1 AS INTEGER) AS idx, CAST(0 AS INTEGER) AS allowed FROM events")
_register(
    "contextual_check",
    lambda e, spark, d: e.check_bulk(_requests(spark, d, "readable"), contextual=[("user", "c7", "owner", "order", "o7"), ("user", "c7", "blocked", "order", "o14"), ("user", "*", "frozen", "order", "o3")]),
    _sql(
        "SELECT CAST(event_id + 1 AS INTEGER) AS idx, CAST(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.s = 'c' || user_id AND r.o = 'o' || event_id) THEN 1 ELSE 0 END AS INTEGER) AS allowed FROM events",
        f"r AS (({SAFE}) UNION ({UNBLOCKED}))",
    ).replace(
        "\n)", "\n UNION ALL SELECT 'user', 'c7', 'owner', 'order', 'o7' UNION ALL SELECT 'user', 'c7', 'blocked', 'order', 'o14' UNION ALL SELECT 'user', '*', 'frozen', 'order', 'o3'\n)", 1
    ),
)
_register(
    "page_objects",
    lambda e, *_: e.list_objects("user", "c7", "can_read", "order", limit=20, after="o1"),
    _sql("SELECT o AS object_id, CASE WHEN (SELECT count(*) FROM a) > 20 THEN (SELECT max(o) FROM p) END AS next_cursor FROM p", f"a AS (SELECT DISTINCT o FROM ({OWNER} UNION {ACTIVE}) x WHERE s = 'c7' AND o > 'o1'), p AS (SELECT o FROM a ORDER BY o LIMIT 20)"),
)
_register(
    "page_subjects_wildcard_first",
    lambda e, *_: e.list_subjects("folder", "p300", "viewer", "user", limit=25),
    _sql("SELECT s AS subject_id, CASE WHEN (SELECT count(*) FROM a) > 25 THEN (SELECT max(s) FROM p) END AS next_cursor FROM p", VIEWERS + ", a AS (SELECT DISTINCT s FROM v WHERE o = 'p300'), p AS (SELECT s FROM a ORDER BY s LIMIT 25)"),
)
_register(
    "expand_users_leaf",
    lambda e, *_: expand_users(e.tuples, "order", "owner", 100),
    _sql("SELECT object_id, list(u ORDER BY u) AS users, count(*) > 100 AS users_truncated FROM (SELECT DISTINCT object_id, subject_type || ':' || subject_id AS u FROM tuples WHERE object_type = 'order' AND relation = 'owner') GROUP BY object_id"),
)
_register(
    "expand_ttu_leaf",
    lambda e, *_: expand_links(e.tuples, analysis(), "order", "org", "auditor"),
    _sql("SELECT object_id, list(u ORDER BY u) AS computed FROM (SELECT DISTINCT object_id, subject_type || ':' || subject_id || '#auditor' AS u FROM tuples WHERE object_type = 'order' AND relation = 'org') GROUP BY object_id"),
)
_register("doctor_signatures", lambda e, *_: signatures(e.tuples), _sql("SELECT object_type, relation, subject_type, CASE WHEN contains(subject_id, '#') THEN string_split(subject_id, '#')[2] ELSE '' END AS subject_relation, subject_id = '*' AS wildcard, count(*) AS n FROM tuples GROUP BY ALL"))


_subjects("intersection_subjects", "own_active", f"{OWNER} INTERSECT {ACTIVE}")
_subjects("intersection_ttu_subjects", "owner_auditor", f"{OWNER} INTERSECT {AUDITOR}")
_subjects(
    "intersection_userset_filter",
    "approved",
    "SELECT s, o FROM fv INTERSECT SELECT fv.s, t.object_id FROM fv JOIN tuples t ON t.object_type = 'folder' AND t.relation = 'parent' AND t.subject_id = fv.o",
    "folder",
    "group#member",
    GROUPS_OF,
)
_register(
    "no_wildcard_objects",
    lambda e, *_: e.grants(_users(e), [("order", "visible")], wildcards=False)[0].select("subject_id", "object_id"),
    _sql("SELECT DISTINCT subject_id, object_id FROM tuples WHERE object_type = 'order' AND relation IN ('visible', 'owner') AND subject_type = 'user' AND subject_id <> '*'"),
)
_register(
    "scan_by_pattern",
    lambda e, *_: e.tuples.where(F.col("object_id").like("o1_") & ~F.col("subject_id").like("c%9")).select(*COLUMNS).distinct(),
    _sql("SELECT DISTINCT * FROM tuples WHERE object_id LIKE 'o1_' AND subject_id NOT LIKE 'c%9'"),
)
_register(
    "expand_users_unbounded",
    lambda e, *_: expand_users(e.tuples, "club", "guest"),
    _sql("SELECT object_id, list(subject_type || ':' || subject_id ORDER BY subject_type, subject_id) AS users, false AS users_truncated FROM (SELECT DISTINCT * FROM tuples WHERE object_type = 'club' AND relation = 'guest') GROUP BY object_id"),
)
_register(
    "expand_users_capped",
    lambda e, *_: expand_users(e.tuples, "club", "guest", 7),
    _sql("SELECT object_id, list(subject_type || ':' || subject_id ORDER BY subject_type, subject_id)[1:7] AS users, count(*) > 7 AS users_truncated FROM (SELECT DISTINCT * FROM tuples WHERE object_type = 'club' AND relation = 'guest') GROUP BY object_id"),
)


def _extra(rows: list[tuple[str, str, str, str, str]]) -> str:
    """SQL that adds tuples to those of the tables."""
    return "".join(f"\n UNION ALL SELECT {', '.join(repr(c) for c in r)}" for r in rows) + "\n)"


_MORE = [("user", "c7", "owner", "order", "o7"), ("user", "x1", "active", "order", "o7"), ("user", "x1", "blocked", "order", "o9"), ("user", "x1", "active", "order", "o9"), ("user", "*", "frozen", "order", "o7")]
_register(
    "contextual_objects",
    lambda e, spark, _: e.objects_of(_named(spark, "c7", "x1"), "readable", "order", _MORE).select("subject_id", "object_id"),
    _sql(f"SELECT DISTINCT s AS subject_id, o AS object_id FROM (({SAFE}) UNION ({UNBLOCKED})) v WHERE s IN ('c7', 'x1')").replace("\n)", _extra(_MORE), 1),
)
_register(
    "contextual_subjects",
    lambda e, spark, _: e.subjects_of("order", "readable", "user", spark.createDataFrame([("o7",), ("o9",)], "object_id string"), _MORE).select("object_id", "subject_id"),
    _sql(f"SELECT DISTINCT o AS object_id, s AS subject_id FROM (({SAFE}) UNION ({UNBLOCKED})) v WHERE o IN ('o7', 'o9')").replace("\n)", _extra(_MORE), 1),
)


def _named(spark: SparkSession, *users: str) -> DataFrame:
    return spark.createDataFrame([("user", u) for u in users], "subject_type string, subject_id string")


#: A chain of folders over the tables' own: z0 in z1 in z2 and so on, which the last one's viewer reaches by as many steps.
_CHAIN = [("folder", f"z{k}", "parent", "folder", f"z{k + 1}") for k in range(40)] + [("user", "deep", "viewer", "folder", "z0")]


def _deep(e: Engine, spark: SparkSession, _: str) -> DataFrame:
    """Checks by recursion of up to 40 steps where 25 are allowed, beside others."""
    asked = [(k, "user", "deep", "viewer", "folder", f"z{k}") for k in range(41)] + [(50, "user", "deep", "owner", "order", "o7"), (51, "user", "other", "nope", "order", "o7")]
    return Engine(e.analysis, e.tuples).check_bulk(spark.createDataFrame(asked, "idx int, " + ", ".join(f"{c} string" for c in REQUEST)), _CHAIN, errors=True)


_register(
    "check_depth_25",
    _deep,
    _sql(
        "SELECT CAST(k AS INTEGER) AS idx, CAST(CASE WHEN k IN (SELECT d FROM chain) THEN 1 ELSE 0 END AS INTEGER) AS allowed, CAST(CASE WHEN k < 41 AND k NOT IN (SELECT d FROM chain) THEN 2002 END AS INTEGER) AS error FROM (SELECT unnest(generate_series(0, 40) || [50, 51]) AS k)",
        "chain AS (SELECT object_id AS o, 0 AS d FROM tuples WHERE relation = 'viewer' AND object_type = 'folder' AND subject_id = 'deep' UNION ALL SELECT t.object_id, c.d + 1 FROM chain c JOIN tuples t ON t.relation = 'parent' AND t.subject_type = 'folder' AND t.subject_id = c.o WHERE c.d + 1 < 25)",
    ).replace("\n)", _extra(_CHAIN), 1),
)


def _single(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single checks, one after the other: the owners of two orders, and somebody else."""
    asked = [(f"c{r[1]}", f"o{r[0]}") for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(2).collect()]
    rows = [(s, o, e.check("user", s, "readable", "order", o)) for s, o in [*asked, ("nobody", asked[0][1])]]
    return spark.createDataFrame(rows, "subject_id string, object_id string, allowed int")


_FIRST = "f AS (SELECT 'c' || o_custkey AS s, 'o' || o_orderkey AS o FROM orders ORDER BY o_orderkey LIMIT 2)"
_register(
    "check_single",
    _single,
    _sql(
        "SELECT q.s AS subject_id, q.o AS object_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.s = q.s AND r.o = q.o) THEN 1 ELSE 0 END AS INTEGER) AS allowed FROM q",
        f"r AS (({SAFE}) UNION ({UNBLOCKED})), {_FIRST}, q AS (SELECT * FROM f UNION ALL SELECT 'nobody', 'o' || min(o_orderkey) FROM orders)",
    ),
)

# -- trees, as rows ------------------------------------------------------------


def _entries(name: str, kind: str, relation: str, sql: str) -> None:
    """Registers expand for all objects of a type at once; ``sql`` gives (object_id, leaf, kind, value)."""
    _register(
        name,
        lambda e, *_: expand_rows(e.tuples, e.analysis, kind, relation).select("object_id", "leaf", "kind", "value"),
        _sql(f"SELECT DISTINCT object_id, CAST(leaf AS INTEGER) AS leaf, kind, value FROM ({sql}) v"),
    )


def _pointer(leaf: int, kind: str, relation: str) -> str:
    return f"SELECT object_id, {leaf} AS leaf, 'computed' AS kind, '{kind}:' || object_id || '#{relation}' AS value FROM tuples WHERE object_type = '{kind}'"


def _own(leaf: int, kind: str, relation: str) -> str:
    return f"SELECT object_id, {leaf}, 'user', subject_type || ':' || subject_id FROM tuples WHERE object_type = '{kind}' AND relation = '{relation}'"


_entries("expand_computed", "order", "grouped", " UNION ALL ".join(_pointer(k, "order", r) for k, r in enumerate(("owner", "active", "seen", "blocked", "frozen"))))
_entries("expand_union", "order", "visible", f"{_pointer(1, 'order', 'public')} UNION ALL {_pointer(2, 'order', 'owner')} UNION ALL {_own(0, 'order', 'visible')}")
_entries("expand_difference", "group", "live", f"{_pointer(1, 'group', 'banned')} UNION ALL {_own(0, 'group', 'live')}")
_entries(
    "expand_ttu",
    "folder",
    "viewer",
    f"{_own(0, 'folder', 'viewer')} UNION ALL SELECT object_id, 1, 'link', subject_type || ':' || subject_id || '#viewer' FROM tuples WHERE object_type = 'folder' AND relation = 'parent'".replace("SELECT object_id, 0, 'user',", "SELECT object_id, 0 AS leaf, 'user' AS kind,", 1).replace("subject_id FROM", "subject_id AS value FROM", 1),
)


def _flat(node: dict, path: str = "0") -> list[tuple[str, str, str | None]]:
    """(path, kind, text) of an expanded tree's nodes."""
    if "leaf" in node:
        (kind, leaf), *_ = node["leaf"].items()
        values = leaf["users"] if kind == "users" else [leaf["userset"]] if kind == "computed" else [leaf["tupleset"], *(c["userset"] for c in leaf["computed"])]
        return [(path, kind, v) for v in values] or [(path, kind, None)]
    kind = next(k for k in ("union", "intersection", "difference") if k in node)
    below = node[kind].get("nodes") or [node[kind]["base"], node[kind]["subtract"]]
    return [(path, kind, node["name"])] + [x for k, n in enumerate(below) for x in _flat(n, f"{path}.{k}")]


def _expand(e: Engine, spark: SparkSession, _: str) -> DataFrame:
    trees = Trees(e.analysis, e.tuples)
    rows = [(f"{t}:{o}#{r}", *x) for t, o, r in (("order", "o7", "grouped"), ("folder", "p5", "viewer"), ("order", "o7", "auditor"), ("group", "g3", "live"), ("order", "o7", "nope")) for x in _flat(trees.expand(t, o, r)["root"])]
    return spark.createDataFrame(rows, "tree string, path string, kind string, text string")


def _users_or_none(tree: str, path: str, where: str) -> str:
    own = f"SELECT DISTINCT subject_type || ':' || subject_id AS u FROM tuples WHERE {where}"
    return f"SELECT '{tree}' AS tree, '{path}' AS path, 'users' AS kind, u AS text FROM (SELECT 1) one LEFT JOIN ({own}) own ON true"


def _fixed(tree: str, *rows: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{tree}' AS tree, '{path}' AS path, '{kind}' AS kind, '{tree if text == '' else text}' AS text" for path, kind, text in rows)


_register(
    "expand",
    _expand,
    _sql(
        " UNION ALL ".join(
            [
                _fixed("order:o7#grouped", ("0", "intersection", ""), ("0.0", "union", ""), ("0.0.0", "computed", "order:o7#owner"), ("0.0.1", "computed", "order:o7#active"), ("0.1", "union", ""), ("0.1.0", "computed", "order:o7#seen"), ("0.1.1", "difference", ""), ("0.1.1.0", "computed", "order:o7#blocked"), ("0.1.1.1", "computed", "order:o7#frozen")),
                _fixed("folder:p5#viewer", ("0", "union", ""), ("0.1", "tuple_to_userset", "folder:p5#parent")),
                _users_or_none("folder:p5#viewer", "0.0", "object_type = 'folder' AND object_id = 'p5' AND relation = 'viewer'"),
                "SELECT DISTINCT 'folder:p5#viewer', '0.1', 'tuple_to_userset', 'folder:' || subject_id || '#viewer' FROM tuples WHERE object_type = 'folder' AND object_id = 'p5' AND relation = 'parent'",
                _fixed("order:o7#auditor", ("0", "tuple_to_userset", "order:o7#org")),
                "SELECT DISTINCT 'order:o7#auditor', '0', 'tuple_to_userset', 'org:' || subject_id || '#auditor' FROM tuples WHERE object_type = 'order' AND object_id = 'o7' AND relation = 'org'",
                _fixed("group:g3#live", ("0", "difference", ""), ("0.1", "computed", "group:g3#banned")),
                _users_or_none("group:g3#live", "0.0", "object_type = 'group' AND object_id = 'g3' AND relation = 'live'"),
                "SELECT 'order:o7#nope', '0', 'users', NULL",
            ]
        )
    ),
)


def _reached(e: Engine, spark: SparkSession, _: str) -> DataFrame:
    asked = spark.createDataFrame([("folder", "p300", "viewer"), ("order", "o7", "visible")], "object_type string, object_id string, relation string")
    return Trees(e.analysis, e.tuples).reached_users(asked, [("folder", "viewer"), ("order", "visible")])


_register(
    "expand_recursive",
    _reached,
    _sql(
        "SELECT DISTINCT subject_type || ':' || subject_id AS user FROM tuples t JOIN up ON t.object_id = up.o WHERE object_type = 'folder' AND relation = 'viewer' UNION SELECT subject_type || ':' || subject_id FROM tuples WHERE object_type = 'order' AND object_id = 'o7' AND relation IN ('visible', 'public', 'owner')",
        "up AS (SELECT 'p300' AS o UNION SELECT t.subject_id FROM up JOIN tuples t ON t.object_type = 'folder' AND t.relation = 'parent' AND t.object_id = up.o)",
    ),
)


def _nodes(node: dict, path: str = "0") -> list[tuple]:
    proof = [f"{x['subject_type']}:{x['subject_id']} {x['relation']} {x['object_type']}:{x['object_id']}" for x in node.get("evidence", [])]
    return [(path, node["type"], node["label"], node.get("result"), proof[0] if proof else None)] + [x for k, c in enumerate(node.get("children", [])) for x in _nodes(c, f"{path}.{k}")]


def _traces(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of traces of ``can_read``: of the first orders' owners, of the first purchases' users, and of nobody."""
    orders, events = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "events"))
    asked = [(f"c{r[0]}", f"o{r[1]}") for r in orders.orderBy("o_orderkey").limit(2).select("o_custkey", "o_orderkey").collect()]
    n = orders.count()
    asked += [(f"c{r[0]}", f"o{r[1] % n}") for r in events.where("event_type = 'purchase'").orderBy("event_id").limit(2).select("user_id", "event_id").collect()]
    trees = Trees(e.analysis, e.tuples)
    rows = []
    for s, o in [*asked, ("nobody", "o7")]:
        made = trees.explain("user", s, "can_read", "order", o)
        rows += [(s, o, made["result"], made["node_count"], *x) for x in _nodes(made["root"])]
    return spark.createDataFrame(rows, "subject_id string, object_id string, allowed boolean, node_count int, path string, type string, label string, result boolean, evidence string")


def _held_by(relation: str, number: int) -> str:
    """The trace where a relation holds, as the ``number``-th that was tried."""
    return (
        f"SELECT s, o, true AS allowed, {2 * number} AS node_count, '0' AS path, 'implied' AS type, 'order:' || o || '#can_read from {relation}' AS label, true AS result, CAST(NULL AS VARCHAR) AS evidence FROM h WHERE h.{relation}{' AND NOT h.owner' * (number - 1)}"
        f" UNION ALL SELECT s, o, true, {2 * number}, '0.0', 'direct', 'order:' || o || '#{relation}', true, 'user:' || s || ' {relation} order:' || o FROM h WHERE h.{relation}{' AND NOT h.owner' * (number - 1)}"
    )


def _denied() -> str:
    rows = [("0", "union", "#can_read")] + [x for k, r in enumerate(("owner", "active")) for x in ((f"0.{k}", "implied", f"#can_read from {r}"), (f"0.{k}.0", "direct", f"#{r}"))]
    return " UNION ALL ".join(f"SELECT s, o, false, 5, '{p}', '{t}', 'order:' || o || '{label}', false, NULL FROM h WHERE NOT h.owner AND NOT h.active" for p, t, label in rows)


_register(
    "explain",
    _traces,
    _sql(
        f"SELECT s AS subject_id, o AS object_id, allowed, CAST(node_count AS INTEGER) AS node_count, path, type, label, result, evidence FROM ({_held_by('owner', 1)} UNION ALL {_held_by('active', 2)} UNION ALL {_denied()}) v",
        f"{_FIRST}, p AS (SELECT 'c' || user_id AS s, 'o' || event_id % n.n AS o FROM events, n WHERE event_type = 'purchase' ORDER BY event_id LIMIT 2), q AS (SELECT * FROM f UNION ALL SELECT * FROM p UNION ALL SELECT 'nobody', 'o7'), "
        "h AS (SELECT s, o, EXISTS (SELECT 1 FROM tuples t WHERE t.object_type = 'order' AND t.object_id = q.o AND t.relation = 'owner' AND t.subject_type = 'user' AND t.subject_id = q.s) AS owner, EXISTS (SELECT 1 FROM tuples t WHERE t.object_type = 'order' AND t.object_id = q.o AND t.relation = 'active' AND t.subject_type = 'user' AND t.subject_id = q.s) AS active FROM q)",
    ),
)


# -- traces of other shapes ------------------------------------------------------


def _trace_rows(e: Engine, spark: SparkSession, asked: list[tuple[str, str, str, str]]) -> DataFrame:
    """The nodes of traces; asked: (user, relation, object type, object)."""
    trees, rows = Trees(e.analysis, e.tuples), []
    for s, r, t, o in asked:
        made = trees.explain("user", s, r, t, o)
        rows += [(s, f"{t}:{o}#{r}", made["result"], made["node_count"], *x) for x in _nodes(made["root"])]
    return spark.createDataFrame(rows, "subject_id string, asked string, allowed boolean, node_count int, path string, type string, label string, result boolean, evidence string")


def _trace_sql(name: str, relation: str, requests: Callable[[SparkSession, str], list[tuple[str, str]]], kind: str, ask: str, flags: dict[str, str], nodes: list[tuple[str, str, str, str, str, str]], allowed: str, count: str) -> None:
    """Registers explain of one relation. ask: SQL for (s, o); flags: named conditions on q.s and q.o; nodes: (condition, path, type, label, result, evidence) in SQL."""
    columns = ", ".join(f"({sql}) AS {n}" for n, sql in flags.items())
    rows = " UNION ALL ".join(f"SELECT s, '{kind}:' || o || '#{relation}' AS asked, ({allowed}) AS allowed, ({count}) AS node_count, '{p}' AS path, '{t}' AS type, {label} AS label, ({result}) AS result, {proof} AS evidence FROM h WHERE {when}" for when, p, t, label, result, proof in nodes)
    _register(
        name,
        lambda e, spark, d: _trace_rows(e, spark, [(s, relation, kind, o) for s, o in requests(spark, d)]),
        _sql(f"SELECT s AS subject_id, asked, allowed, CAST(node_count AS INTEGER) AS node_count, path, type, label, result, CAST(evidence AS VARCHAR) AS evidence FROM ({rows}) v", f"q AS ({ask}), h AS (SELECT q.s, q.o, {columns} FROM q)"),
    )


def _tuple_of(relation: str, subject: str = "q.s", kind: str = "order", obj: str = "q.o") -> str:
    return f"EXISTS (SELECT 1 FROM tuples t WHERE t.object_type = '{kind}' AND t.object_id = {obj} AND t.relation = '{relation}' AND t.subject_type = 'user' AND t.subject_id = {subject})"


def _urgent(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The owners of three urgent orders, which are active there, and of two others."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return [(f"c{r[0]}", f"o{r[1]}") for urgent, n in ((True, 3), (False, 2)) for r in orders.where(F.col("urgent") == urgent).orderBy("o_orderkey").limit(n).collect()]


_URGENT = "SELECT * FROM (SELECT 'c' || o_custkey AS s, 'o' || o_orderkey AS o FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 3) a UNION ALL SELECT * FROM (SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' ORDER BY o_orderkey LIMIT 2) b"
_ON = "'order:' || o"
_PROOF = "CASE WHEN {0} THEN 'user:' || s || ' {0} order:' || o END"

_trace_sql(
    "explain_intersection",
    "own_active",
    _urgent,
    "order",
    _URGENT,
    {"owner": _tuple_of("owner"), "active": _tuple_of("active")},
    [
        ("true", "0", "intersection", f"{_ON} || '#own_active'", "owner AND active", "NULL"),
        ("true", "0.0", "implied", f"{_ON} || '#own_active from owner'", "owner", "NULL"),
        ("true", "0.0.0", "direct", f"{_ON} || '#owner'", "owner", _PROOF.format("owner")),
        ("owner", "0.1", "implied", f"{_ON} || '#own_active from active'", "active", "NULL"),
        ("owner", "0.1.0", "direct", f"{_ON} || '#active'", "active", _PROOF.format("active")),
    ],
    "owner AND active",
    "CASE WHEN owner THEN 5 ELSE 3 END",
)
_trace_sql(
    "explain_exclusion",
    "unblocked",
    _urgent,
    "order",
    _URGENT,
    {"active": _tuple_of("active"), "blocked": _tuple_of("blocked")},
    [
        ("active", "0", "exclusion", f"{_ON} || '#unblocked'", "NOT blocked", "NULL"),
        ("active", "0.0", "implied", f"{_ON} || '#unblocked from active'", "true", "NULL"),
        ("active", "0.0.0", "direct", f"{_ON} || '#active'", "true", _PROOF.format("active")),
        ("active", "0.1", "implied", f"{_ON} || '#unblocked from blocked'", "blocked", "NULL"),
        ("active", "0.1.0", "direct", f"{_ON} || '#blocked'", "blocked", _PROOF.format("blocked")),
        ("NOT active", "0", "implied", f"{_ON} || '#unblocked from active'", "false", "NULL"),
        ("NOT active", "0.0", "direct", f"{_ON} || '#active'", "false", "NULL"),
    ],
    "active AND NOT blocked",
    "CASE WHEN active THEN 5 ELSE 2 END",
)


def _links(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """Orders of the first customers, each asked about for an auditor of the customer's nation (if there is one) and for nobody."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    first = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).orderBy("o_orderkey").limit(3).select("o_orderkey", "c_nationkey")
    auditors = customers.where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.min("c_custkey").alias("a"))
    return [(f"c{r[1]}" if r[1] is not None else "nobody", f"o{r[0]}") for r in first.join(auditors, "c_nationkey", "left").select("o_orderkey", "a").orderBy("o_orderkey").collect()] + [("nobody", "o-none")]


_trace_sql(
    "explain_ttu",
    "auditor",
    _links,
    "order",
    "SELECT coalesce('c' || a, 'nobody') AS s, 'o' || o_orderkey AS o FROM (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 3) f LEFT JOIN (SELECT c_nationkey AS n, min(c_custkey) AS a FROM customer WHERE c_acctbal > 9900 GROUP BY ALL) g ON n = c_nationkey UNION ALL SELECT 'nobody', 'o-none'",
    {
        "org": "SELECT max(t.subject_id) FROM tuples t WHERE t.object_type = 'order' AND t.relation = 'org' AND t.object_id = q.o",
        "held": "EXISTS (SELECT 1 FROM tuples t JOIN tuples a ON a.object_type = 'org' AND a.object_id = t.subject_id AND a.relation = 'auditor' WHERE t.object_type = 'order' AND t.relation = 'org' AND t.object_id = q.o AND a.subject_id = q.s)",
    },
    [
        ("true", "0", "ttu", "'auditor from org'", "held", "CASE WHEN org IS NOT NULL THEN 'org:' || org || ' org order:' || o END"),
        ("org IS NOT NULL", "0.0", "direct", "'org:' || org || '#auditor'", "held", "CASE WHEN held THEN 'user:' || s || ' auditor org:' || org END"),
    ],
    "held",
    "CASE WHEN org IS NULL THEN 1 ELSE 2 END",
)
_trace_sql(
    "explain_wildcard",
    "public",
    lambda spark, d: [("c1", f"o{r[0]}") for low in (True, False) for r in spark.read.parquet(f"{d}/orders.parquet").where((F.col("o_orderpriority") == "5-LOW") == low).orderBy("o_orderkey").limit(2).select("o_orderkey").collect()],
    "order",
    "SELECT * FROM (SELECT 'c1' AS s, 'o' || o_orderkey AS o FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderkey LIMIT 2) a UNION ALL SELECT * FROM (SELECT 'c1', 'o' || o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' ORDER BY o_orderkey LIMIT 2) b",
    {"everyone": _tuple_of("public", "'*'")},
    [
        ("everyone", "0", "wildcard", "'user:*'", "true", "'user:* public order:' || o"),
        ("NOT everyone", "0", "direct", f"{_ON} || '#public'", "false", "NULL"),
    ],
    "everyone",
    "CASE WHEN everyone THEN 2 ELSE 1 END",
)
_trace_sql(
    "explain_userset",
    "shared",
    lambda spark, d: [(f"c{r[0]}", f"p{r[0]}") for r in spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").orderBy("s_suppkey").limit(3).collect()] + [("c1", "p-none")],
    "folder",
    "SELECT * FROM (SELECT 'c' || s_suppkey AS s, 'p' || s_suppkey AS o FROM supplier ORDER BY s_suppkey LIMIT 3) a UNION ALL SELECT 'c1', 'p-none'",
    {"held": "SELECT max(t.subject_id) FROM tuples t WHERE t.object_type = 'folder' AND t.relation = 'shared' AND t.object_id = q.o"},
    [
        ("held IS NOT NULL", "0", "userset", "'group:' || held", "true", "'group:' || held || ' shared folder:' || o"),
        ("held IS NOT NULL", "0.0", "direct", "'group:' || held", "true", "'user:' || s || ' member group:' || string_split(held, '#')[1]"),
        ("held IS NULL", "0", "union", "'folder:' || o || '#shared'", "false", "NULL"),
    ],
    "held IS NOT NULL",
    "CASE WHEN held IS NOT NULL THEN 2 ELSE 1 END",
)

# -- sources and functions -------------------------------------------------------


def _by_functions(e: Engine, spark: SparkSession, _: str) -> DataFrame:
    """The SQL functions of a relation, called for a few subjects and objects."""
    register(e, "org", "admin", _named(spark, "c3", "c7", "c11"))
    return spark.sql(
        "SELECT 'objects' AS kind, q.s AS a, f.object_id AS b FROM VALUES ('c3'), ('c7'), ('c11') AS q(s), LATERAL list_org_admin_obj('user', q.s) f"
        " UNION ALL SELECT 'subjects', q.o, f.subject_id FROM VALUES ('n1'), ('n2') AS q(o), LATERAL list_org_admin_sub(q.o, 'user') f"
        " UNION ALL SELECT 'check', q.o, cast(f.allowed AS STRING) FROM VALUES ('n1'), ('n2'), ('n3') AS q(o), LATERAL check_org_admin('user', 'c7', q.o) f"
        " UNION ALL SELECT 'expand', q.o, concat(f.leaf, ' ', f.kind, ' ', f.value) FROM VALUES ('n1'), ('n2') AS q(o), LATERAL expand_org_admin(q.o) f"
        " UNION ALL SELECT 'explain', q.o, concat(f.leaf, ' ', f.value, ' ', f.holds) FROM VALUES ('n1'), ('n2') AS q(o), LATERAL explain_org_admin('user', 'c7', q.o) f"
    )


_ADMINS = "d AS (SELECT DISTINCT subject_id AS s, object_id AS o, relation FROM tuples WHERE object_type = 'org' AND relation IN ('admin', 'owner')), x AS (SELECT DISTINCT s, o FROM d WHERE s IN ('c3', 'c7', 'c11')), en AS (SELECT o, '0' AS leaf, 'user' AS kind, 'user:' || s AS v FROM d WHERE relation = 'admin' UNION ALL SELECT o, '1', 'computed', 'org:' || o || '#owner' FROM (SELECT DISTINCT object_id AS o FROM tuples WHERE object_type = 'org') w)"
_register(
    "sql_functions",
    _by_functions,
    _sql(
        "SELECT 'objects' AS kind, s AS a, o AS b FROM x UNION ALL SELECT 'subjects', o, s FROM x WHERE o IN ('n1', 'n2')"
        " UNION ALL SELECT 'check', o, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.s = 'c7' AND x.o = w.o) THEN '1' ELSE '0' END FROM (VALUES ('n1'), ('n2'), ('n3')) w(o)"
        " UNION ALL SELECT 'expand', o, leaf || ' ' || kind || ' ' || v FROM en WHERE o IN ('n1', 'n2')"
        " UNION ALL SELECT 'explain', o, leaf || ' ' || v || ' ' || CASE WHEN v = 'user:c7' OR kind = 'computed' AND EXISTS (SELECT 1 FROM d WHERE d.s = 'c7' AND d.o = en.o AND d.relation = 'owner') THEN 'true' ELSE 'false' END FROM en WHERE o IN ('n1', 'n2')",
        _ADMINS,
    ),
)


def _arrays(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of the first hundred events as five arrays of one row."""
    first = _requests(spark, sf_dir, "readable").where("idx <= 100").orderBy("idx")
    one = first.agg(F.sort_array(F.collect_list(F.struct("idx", *REQUEST))).alias("x")).select(*(F.col(f"x.{c}").alias(c) for c in REQUEST))
    return bulk_from_arrays(e, one, list(REQUEST))


_register(
    "bulk_from_arrays",
    _arrays,
    _sql(
        "SELECT CAST(event_id + 1 AS INTEGER) AS idx, CAST(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.s = 'c' || user_id AND r.o = 'o' || event_id) THEN 1 ELSE 0 END AS INTEGER) AS allowed FROM events WHERE event_id < 100",
        f"r AS (({SAFE}) UNION ({UNBLOCKED}))",
    ),
)
_ROWS = [("user", "a", "member", "group", "g1"), ("group", "g1#member", "member", "group", "g2"), ("user", "b", "member", "group", "g2"), ("user", "a", "member", "group", "g3")]
_register(
    "inline_tuples",
    lambda e, spark, _: Engine(e.analysis, tuples_from_rows(spark, _ROWS)).subjects_of("group", "member", "user").select("object_id", "subject_id"),
    "WITH t(k, s, r, ot, o) AS (VALUES " + ", ".join(str(r) for r in _ROWS) + ") SELECT DISTINCT o AS object_id, s AS subject_id FROM t WHERE k = 'user' UNION SELECT b.o, a.s FROM t a JOIN t b ON b.s = a.o || '#member' WHERE a.k = 'user'",
)
_register(
    "list_depth_25",
    lambda e, spark, _: Engine(e.analysis, e.tuples).objects_of(_named(spark, "deep"), "viewer", "folder", _CHAIN).select("subject_id", "object_id"),
    _sql(
        "SELECT 'deep' AS subject_id, o AS object_id FROM chain",
        "chain AS (SELECT object_id AS o, 0 AS d FROM tuples WHERE relation = 'viewer' AND object_type = 'folder' AND subject_id = 'deep' UNION ALL SELECT t.object_id, c.d + 1 FROM chain c JOIN tuples t ON t.relation = 'parent' AND t.subject_type = 'folder' AND t.subject_id = c.o WHERE c.d + 1 < 25)",
    ).replace("\n)", _extra(_CHAIN), 1),
)
_register(
    "list_subjects_depth_25",
    lambda e, spark, _: Engine(e.analysis, e.tuples).subjects_of("folder", "viewer", "user", spark.createDataFrame([(f"z{k}",) for k in range(41)], "object_id string"), _CHAIN).select("object_id", "subject_id"),
    _sql(
        "SELECT o AS object_id, 'deep' AS subject_id FROM chain",
        "chain AS (SELECT object_id AS o, 0 AS d FROM tuples WHERE relation = 'viewer' AND object_type = 'folder' AND subject_id = 'deep' UNION ALL SELECT t.object_id, c.d + 1 FROM chain c JOIN tuples t ON t.relation = 'parent' AND t.subject_type = 'folder' AND t.subject_id = c.o WHERE c.d + 1 < 25)",
    ).replace("\n)", _extra(_CHAIN), 1),
)
_ODD = [("user", "x", "no_such_relation", "order", "o1"), ("robot", "x", "owner", "order", "o1"), ("user", "x", "owner", "planet", "m"), ("service", "x", "owner", "order", "o1"), ("user", " ", "owner", "order", "o1"), ("user", "#x", "owner", "order", "o2")]


def _misfits(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of tuples that the schema doesn't know, with their rows."""
    found = signatures(with_contextual(tuples(spark, sf_dir), _ODD)).collect()
    return spark.createDataFrame([(k, s, n) for k, s, n in misfits(e.analysis, found)], "what string, signature string, n long")


_register(
    "doctor_misfits",
    _misfits,
    "SELECT * FROM (VALUES ('unknown relation', 'user no_such_relation order', 1), ('unknown subject type', 'robot owner order', 1), ('unknown object type', 'user owner planet', 1), ('invalid subject', 'service owner order', 1), ('invalid subject', 'user#x owner order', 1)) v(what, signature, n)",
)
