"""The registered queries of the engine's operators over the given tables, and the same in SQL.

The tables hold no repository, so one is derived from them by the same expressions on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import diff, graph, log, sync, trees
from ..session import ship
from ..tables import FILE, TREE, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(ship(spark), folder)
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_BLOB = r"sha1(encode('blob ' || octet_length(encode({0}))) || '\x00'::BLOB || encode({0}))"


@query(f"SELECT doc_id, {_BLOB.format('text')} AS hash FROM documents")
def object_id(spark, folder):
    return table(spark, folder, "documents").select("doc_id", codec.object_id(F.lit("blob"), codec.utf8(F.col("text"))).alias("hash"))


@query(f"SELECT {_BLOB.format('text')} AS hash, count(*) AS copies, min(doc_id) AS first_id, max(octet_length(encode(text))) AS size FROM documents GROUP BY 1")
def dedup_objects(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", codec.object_id(F.lit("blob"), codec.utf8(F.col("text"))).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return rows.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("size").alias("size"))


_HEAD = "SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, conv_id LIMIT 1"


@query(f"SELECT conv_id || '/' || turn AS commit, (max(turn) OVER () - turn)::INT AS depth FROM conversations WHERE conv_id = ({_HEAD})")
def first_parent_log(spark, folder):
    rows = table(spark, folder, "conversations")
    longest = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last")).orderBy(F.desc("n"), "conv_id").first()
    commit = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    edges = rows.filter("turn > 0").select(commit(F.col("turn")).alias("child"), commit(F.col("turn") - 1).alias("parent"), F.lit(0).alias("ord"))
    return graph.first_parents(edges, f"{longest['conv_id']}/{longest['last']}")


def part_edges(spark: SparkSession, folder: str) -> DataFrame:
    """A history on part keys: k has the parent k / 2, and k / 3 too where 5 divides k; 0 is the root."""
    k = F.col("p_partkey")
    rows = table(spark, folder, "part").select(k)
    first = rows.filter(k >= 1).select(k.alias("child"), F.floor(k / 2).alias("parent"), F.lit(0).alias("ord"))
    second = rows.filter((k >= 5) & (k % 5 == 0)).select(k.alias("child"), F.floor(k / 3).alias("parent"), F.lit(1).alias("ord"))
    return first.unionByName(second).select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"), "ord")


_EDGES = """e AS (SELECT p_partkey AS c, p_partkey // 2 AS p, 0 AS ord FROM part WHERE p_partkey >= 1
  UNION ALL SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey >= 5 AND p_partkey % 5 = 0)"""
_HEADS = ["125", "90", "77"]
_REACH = f"""WITH RECURSIVE {_EDGES},
h AS (SELECT * FROM (VALUES (0, 125), (1, 90), (2, 77)) t(i, c)),
r AS (SELECT i, c, 0 AS d FROM h UNION SELECT r.i, e.p, r.d + 1 FROM r JOIN e ON e.c = r.c),
m AS (SELECT i, c, min(d) AS d FROM r GROUP BY i, c)"""
_ROUND = f"""{_REACH},
v AS (SELECT c, max(d) AS cover FROM m GROUP BY c HAVING count(*) = 3),
s AS (SELECT min(cover) AS r FROM v)"""


@query(f"{_REACH} SELECT c::VARCHAR AS commit, min(d)::INT AS depth FROM m GROUP BY c")
def walk_commits(spark, folder):
    return graph.walk(part_edges(spark, folder), spark.createDataFrame([(h,) for h in _HEADS], "commit string"))


@query(f"{_ROUND} SELECT c::VARCHAR AS commit FROM v, s WHERE cover = r")
def merge_base(spark, folder):
    best = graph.merge_base(part_edges(spark, folder), _HEADS).best
    return spark.createDataFrame([(b,) for b in best], "commit string")


@query(f"{_ROUND} SELECT h.c::VARCHAR AS commit FROM h, s WHERE (SELECT count(*) FROM m WHERE m.c = h.c AND m.d <= s.r) = 1")
def leaves(spark, folder):
    found = graph.merge_base(part_edges(spark, folder), _HEADS).leaves
    return spark.createDataFrame([(b,) for b in found], "commit string")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_ref(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    return graph.latest(rows, keys=("user_id", "event_type"), order=("ts", "event_id")).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, event_id FROM events WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_valid_ref(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return graph.latest(rows, F.col("value") > 50, ("user_id", "event_type"), ("ts", "event_id")).select("user_id", "event_type", "event_id")


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events")
def reflog_previous(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    return graph.previous(rows, ("user_id", "event_type"), ("ts", "event_id"), "event_id").select("event_id", "previous")


_FORMS = "CASE event_id % 4 WHEN 0 THEN 'refs/remotes/' || user_id || '/' || event_type WHEN 1 THEN 'refs/heads/' || event_type WHEN 2 THEN 'refs/remotes/' || user_id ELSE 'Refs/remotes/' || user_id || '/' || event_type END"


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id::VARCHAR END AS client, CASE WHEN event_id % 4 = 0 THEN event_type END AS branch, {_FORMS} AS ref FROM events")
def parse_ref(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.expr(_FORMS.replace("|| user_id", "|| cast(user_id as string)")).alias("ref"))
    return rows.select("event_id", codec.parsed_branch(F.col("ref")).alias("b"), "ref").select("event_id", "b.client", "b.branch", "ref")


def region_entries(spark: SparkSession, folder: str) -> DataFrame:
    """A tree of three levels: regions, their nations, and these nations' customers as files."""
    t = lambda n: table(spark, folder, n)
    entry = lambda df, tree, name, mode, child: df.select(tree.alias("tree_hash"), F.lit(0).alias("ord"), name.alias("name"), F.lit(mode).alias("mode"), child.alias("child_hash"))
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        entry(t("region"), F.lit("root"), F.col("r_name"), TREE, s("r", "r_regionkey")),
        entry(t("nation"), s("r", "n_regionkey"), F.col("n_name"), TREE, s("n", "n_nationkey")),
        entry(t("customer"), s("n", "c_nationkey"), F.col("c_name"), FILE, s("c", "c_custkey")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FLAT = """f AS (SELECT r_name AS path, 16384 AS mode, 0 AS depth FROM region
  UNION ALL SELECT r_name || '/' || n_name, 16384, 1 FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, 33188, 2 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey)"""


@query(f"WITH {_FLAT} SELECT path, mode, depth FROM f")
def flatten_tree(spark, folder):
    return trees.flatten(region_entries(spark, folder), spark.createDataFrame([("root",)], "root string")).select("path", "mode", "depth")


@query("SELECT r_name || '/' || n_name AS path FROM region JOIN nation ON n_regionkey = r_regionkey")
def list_children(spark, folder):
    flat = trees.flatten(region_entries(spark, folder), spark.createDataFrame([("root",)], "root string"))
    regions = table(spark, folder, "region").select(F.col("r_name").alias("up"))
    return flat.withColumn("up", codec.parent(F.col("path"))).join(F.broadcast(regions), "up").select("path")


_TREE_HASH = r"sha1(encode('tree ' || octet_length({0})) || '\x00'::BLOB || {0})"
_CUSTOMER = _BLOB.format("c_mktsegment")


@query(
    f"""WITH n0 AS (SELECT n_name, n_regionkey, unhex(string_agg(hex(encode('100644 ' || c_name)) || '00' || {_CUSTOMER}, '' ORDER BY encode(c_name))) AS b
  FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey),
n AS (SELECT n_name, n_regionkey, {_TREE_HASH.format('b')} AS hash FROM n0),
r0 AS (SELECT r_name, unhex(string_agg(hex(encode('40000 ' || n_name)) || '00' || hash, '' ORDER BY encode(n_name || '/'))) AS b FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_name),
r AS (SELECT r_name, {_TREE_HASH.format('b')} AS hash FROM r0),
t0 AS (SELECT unhex(string_agg(hex(encode('40000 ' || r_name)) || '00' || hash, '' ORDER BY encode(r_name || '/'))) AS b FROM r)
SELECT '' AS path, {_TREE_HASH.format('b')} AS hash FROM t0
UNION ALL SELECT r_name, hash FROM r
UNION ALL SELECT r_name || '/' || n_name, hash FROM n JOIN region ON n_regionkey = r_regionkey"""
)
def merkle_rollup(spark, folder):
    t = lambda n: table(spark, folder, n)
    rows = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves_ = rows.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.lit(FILE).alias("mode"), codec.object_id(F.lit("blob"), codec.utf8(F.col("c_mktsegment"))).alias("hash"))
    return trees.roll_up(leaves_).select("path", "hash")


@query(
    """WITH g AS (SELECT quality, toxic, doc_id FROM labels),
x AS (SELECT DISTINCT quality || '-' || toxic || '-' || doc_id % 10 AS root, doc_id FROM g)
SELECT root, bool_and(doc_id % 17 <> 3 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = x.doc_id)) AS complete FROM x GROUP BY root"""
)
def reachability(spark, folder):
    labels = table(spark, folder, "labels").select(F.concat_ws("-", "quality", "toxic", F.col("doc_id") % 10).alias("tree_hash"), F.col("doc_id").cast("string").alias("child_hash"))
    entries = labels.select("tree_hash", F.lit(0).alias("ord"), F.col("child_hash").alias("name"), F.lit(FILE).alias("mode"), "child_hash")
    roots = labels.select(F.col("tree_hash").alias("root")).distinct()
    objects = table(spark, folder, "documents").filter("doc_id % 17 <> 3").select(F.col("doc_id").cast("string").alias("hash")).unionByName(roots.select(F.col("root").alias("hash")))
    return trees.fully_reachable(entries, objects, roots)


def order_sides(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Orders as a base, and two sides that delete, change and add by key."""
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("v"))
    side = lambda keep, change, more: rows.filter(keep).withColumn("v", F.when(F.expr(change), F.concat("v", F.lit(more))).otherwise(F.col("v")))
    made = [rows.filter("k % 13 <> 5"), side("k % 11 <> 3", "k % 7 = 1", "+a"), side("k % 17 <> 4", "k % 5 = 2", "+b")]
    return [df.select(F.concat(F.lit("o/"), F.col("k").cast("string")).alias("path"), F.when(F.expr(f"k % 19 = {n}"), "directory").otherwise("file").alias("kind"), F.sha1("v").alias("hash")) for n, df in enumerate(made)]


def _side(keep: str, change: str, more: str, n: int) -> str:
    return f"SELECT 'o/' || o_orderkey AS path, CASE WHEN o_orderkey % 19 = {n} THEN 'directory' ELSE 'file' END AS kind, sha1(o_orderstatus || '|' || o_orderpriority || CASE WHEN {change} THEN '{more}' ELSE '' END) AS hash FROM orders WHERE {keep}"


_SIDES = f"""base AS ({_side('o_orderkey % 13 <> 5', 'false', '', 0)}), a AS ({_side('o_orderkey % 11 <> 3', 'o_orderkey % 7 = 1', '+a', 1)}), b AS ({_side('o_orderkey % 17 <> 4', 'o_orderkey % 5 = 2', '+b', 2)})"""


def _changed(s: str) -> str:
    return f"CASE WHEN base.kind IS NULL AND {s}.kind IS NULL THEN false WHEN base.kind IS NULL OR {s}.kind IS NULL THEN true WHEN base.kind <> {s}.kind THEN true WHEN {s}.kind = 'directory' THEN false ELSE base.hash IS DISTINCT FROM {s}.hash END"


@query(
    f"""WITH {_SIDES}, j AS (SELECT path, {_changed('a')} AS a_changed, {_changed('b')} AS b_changed, a.hash AS a_hash FROM base FULL JOIN a USING (path) FULL JOIN b USING (path))
SELECT path, a_changed, b_changed, CASE WHEN a_changed AND b_changed THEN 'both' WHEN a_changed THEN 'a' WHEN b_changed THEN 'b' ELSE 'unchanged' END AS class, a_hash AS result_hash FROM j"""
)
def three_way_diff(spark, folder):
    rows = diff.merged_files(diff.three_way(*order_sides(spark, folder)))
    return rows.select("path", "a_changed", "b_changed", "class", "result_hash")


@query(
    f"""WITH {_SIDES}, j AS (SELECT path AS container, base.hash AS o, a.hash AS x, b.hash AS y FROM a FULL JOIN b USING (path) LEFT JOIN base USING (path)),
d AS (SELECT *, CASE WHEN x = y THEN 'keep' WHEN x IS NOT NULL AND y IS NOT NULL AND o IS NOT NULL THEN 'merge' WHEN x IS NOT NULL AND y IS NOT NULL THEN 'a' WHEN o IS NOT NULL THEN 'delete' ELSE 'keep' END AS decision FROM j)
SELECT container, decision, CASE WHEN decision IN ('merge', 'delete') THEN NULL ELSE coalesce(x, y) END AS hash FROM d"""
)
def container_reconcile(spark, folder):
    base, a, b = (df.select(F.col("path").alias("container"), "hash", F.lit(0).cast("long").alias("seconds")) for df in order_sides(spark, folder))
    return diff.container_decisions(base, a, b).select("container", "decision", "hash")


@query("SELECT DISTINCT sha1(concat_ws('|', l_orderkey, l_linenumber, l_partkey)) AS hash FROM lineitem WHERE l_orderkey % 3 <> 0 EXCEPT SELECT sha1(concat_ws('|', l_orderkey, l_linenumber, l_partkey)) FROM lineitem WHERE l_partkey % 4 = 1")
def sync_levels(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.sha1(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey")).alias("hash"), "l_orderkey", "l_partkey")
    return sync.missing_objects(rows.filter("l_orderkey % 3 <> 0"), rows.filter("l_partkey % 4 = 1").select("hash"))


@query(
    """SELECT event_id, CASE WHEN n <= 256 THEN substr(h, 5, 2) WHEN n <= 65536 THEN substr(h, 3, 2) || '/' || substr(h, 5, 2)
  ELSE substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || substr(h, 5, 2) END AS path FROM (SELECT event_id, lpad(lower(to_hex(event_id)), 6, '0') AS h, count(*) OVER () AS n FROM events)"""
)
def aol_path(spark, folder):
    rows = table(spark, folder, "events").select("event_id")
    return rows.select("event_id", log.address(F.col("event_id"), log.width(rows.count())).alias("path"))


@query("SELECT count(*) AS n FROM events")
def aol_count(spark, folder):
    rows = table(spark, folder, "events").select("event_id")
    paths = rows.select(log.address(F.col("event_id"), log.width(rows.count())).alias("path"))
    return spark.createDataFrame([(log.count(paths),)], "n long")


_MODES = [0o040000, 0o100000, 0o100644, 0o100755, 0o120000, 0o160000]


@query(f"SELECT mode, (mode & 32768) = 32768 AS is_blob, (mode & 61440) = 32768 AS is_file, CASE WHEN mode = 16384 THEN 'tree' WHEN (mode & 61440) = 57344 THEN 'commit' ELSE 'blob' END AS type FROM (SELECT unnest({_MODES})::INT AS mode)")
def mode_predicates(spark, folder):
    m = F.col("mode")
    return spark.createDataFrame([(x,) for x in _MODES], "mode int").select("mode", codec.is_blob(m).alias("is_blob"), codec.is_file(m).alias("is_file"), codec.mode_type(m).alias("type"))


@query(
    """SELECT c_custkey, c_name || ' <' || lower(c_mktsegment) || '@example.com> ' || (1700000000 + c_custkey) || ' '
  || CASE WHEN o > 0 THEN '-' ELSE '+' END || lpad((abs(o) // 60)::VARCHAR, 2, '0') || lpad((abs(o) % 60)::VARCHAR, 2, '0') AS line,
  1700000000 + c_custkey AS seconds, o::INT AS "offset" FROM (SELECT *, (c_custkey % 49 - 24) * 30 AS o FROM customer)"""
)
def person_codec(spark, folder):
    rows = writers(spark, folder).select("c_custkey", codec.person_line(F.col("person")).alias("line"))
    return rows.select("c_custkey", "line", codec.parsed_person(F.col("line")).alias("p")).select("c_custkey", "line", "p.seconds", "p.offset")


@query(None)
def traverse_listings(spark, folder):
    """N-way traversal in path order of the three sides of `order_sides`."""
    return written(trees.traverse([df for df in order_sides(spark, folder)]), "traverse").select("path", F.col("at_0").isNotNull().alias("in_base"), F.col("at_1").isNotNull().alias("in_a"), F.col("at_2").isNotNull().alias("in_b"))


SQL["traverse_listings"] = f"WITH {_SIDES} SELECT path, base.path IS NOT NULL AS in_base, a.path IS NOT NULL AS in_a, b.path IS NOT NULL AS in_b FROM base FULL JOIN a USING (path) FULL JOIN b USING (path)"


_ZONE = "CASE WHEN o > 0 THEN '-' ELSE '+' END || lpad((abs(o) // 60)::VARCHAR, 2, '0') || lpad((abs(o) % 60)::VARCHAR, 2, '0')"
_WRITER = f"c_name || ' <' || lower(c_mktsegment) || '@example.com> ' || (1700000000 + c_custkey) || ' ' || {_ZONE}"
_WRITTEN = "SELECT *, (c_custkey % 49 - 24) * 30 AS o FROM customer"


def writers(spark: SparkSession, folder: str) -> DataFrame:
    """(c_custkey, c_name, c_nationkey, person): customers as people who write commits.

    They are few bytes and much work, and the rows of a row group are read by one task, so they are spread over all tasks first.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number, for rows of few bytes would be coalesced again
    offset = ((F.col("c_custkey") % 49 - 24) * 30).cast("int")
    person = F.struct(F.col("c_name").alias("name"), F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("email"), (F.col("c_custkey") + 1_700_000_000).alias("seconds"), offset.alias("offset"))
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").repartition(tasks, "c_custkey")
    return rows.select("c_custkey", "c_name", "c_nationkey", person.alias("person"))


@query(
    rf"""WITH w AS ({_WRITTEN}),
b AS (SELECT c_custkey, c_nationkey % 3 AS n, sha1('tree' || c_custkey) AS tree, 'tree ' || sha1('tree' || c_custkey) || chr(10)
  || CASE WHEN c_nationkey % 3 > 0 THEN 'parent ' || sha1('p0' || c_custkey) || chr(10) ELSE '' END || CASE WHEN c_nationkey % 3 > 1 THEN 'parent ' || sha1('p1' || c_custkey) || chr(10) ELSE '' END
  || 'author ' || {_WRITER} || chr(10) || 'committer ' || {_WRITER} || chr(10) || chr(10) || 'Work of ' || c_name || chr(10) || chr(10) || 'in full' AS body, (1700000000 + c_custkey) AS seconds, c_name FROM w)
SELECT c_custkey, sha1(encode('commit ' || octet_length(encode(body))) || '\x00'::BLOB || encode(body)) AS hash, tree, n::INT AS parents, seconds, 'Work of ' || c_name || chr(10) || chr(10) || 'in full' AS message FROM b"""
)
def commit_codec(spark, folder):
    key, n = F.col("c_custkey").cast("string"), F.col("c_nationkey") % 3
    made = lambda prefix: F.sha1(F.concat(F.lit(prefix), key))
    parents = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(made("p0"))).otherwise(F.array(made("p0"), made("p1")))
    message = F.concat(F.lit("Work of "), "c_name", F.lit("\n\nin full"))
    rows = writers(spark, folder).select("c_custkey", codec.commit_body(made("tree"), parents, F.col("person"), F.col("person"), message).alias("body"))
    rows = rows.select("c_custkey", codec.object_id(F.lit("commit"), F.col("body")).alias("hash"), codec.parsed_commit(F.col("body")).alias("c"))
    return rows.select("c_custkey", "hash", "c.tree", F.size("c.parents").alias("parents"), "c.committer.seconds", "c.message")


@query(
    rf"""WITH w AS ({_WRITTEN}),
b AS (SELECT c_custkey, sha1('t' || c_custkey) AS target, 'object ' || sha1('t' || c_custkey) || chr(10) || 'type commit' || chr(10) || 'tag v' || c_custkey || chr(10) || 'tagger ' || {_WRITER} || chr(10) || chr(10) || c_name AS body, c_name FROM w)
SELECT c_custkey, sha1(encode('tag ' || octet_length(encode(body))) || '\x00'::BLOB || encode(body)) AS hash, target, 'commit' AS type, 'v' || c_custkey AS tag, c_name AS message FROM b"""
)
def tag_codec(spark, folder):
    key = F.col("c_custkey").cast("string")
    body = codec.tag_body(F.sha1(F.concat(F.lit("t"), key)), F.lit("commit"), F.concat(F.lit("v"), key), F.col("person"), F.col("c_name"))
    rows = writers(spark, folder).select("c_custkey", body.alias("body"))
    rows = rows.select("c_custkey", codec.object_id(F.lit("tag"), F.col("body")).alias("hash"), codec.parsed_tag(F.col("body")).alias("t"))
    return rows.select("c_custkey", "hash", F.col("t.object").alias("target"), "t.type", "t.tag", "t.message")


@query(
    f"""WITH w AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE sha1('old' || c_custkey) END AS previous FROM ({_WRITTEN}))
SELECT c_custkey, coalesce(previous, repeat('0', 40)) || ' ' || sha1('new' || c_custkey) || ' ' || {_WRITER} || chr(9) || 'commit: ' || c_name || chr(10) AS line, previous, sha1('new' || c_custkey) AS "new", 'commit: ' || c_name AS description FROM w"""
)
def journal_codec(spark, folder):
    key = F.col("c_custkey").cast("string")
    previous = F.when(F.col("c_custkey") % 5 != 0, F.sha1(F.concat(F.lit("old"), key)))
    line = codec.journal_line(previous, F.sha1(F.concat(F.lit("new"), key)), F.col("person"), F.concat(F.lit("commit: "), "c_name", F.lit("\nmore of it")))
    rows = writers(spark, folder).select("c_custkey", line.alias("line"))
    return rows.select("c_custkey", "line", F.element_at(codec.parsed_journal(F.col("line")), 1).alias("e")).select("c_custkey", "line", "e.previous", "e.new", "e.description")


_IDS = "CASE event_id % 4 WHEN 0 THEN sha1('e' || event_id) WHEN 1 THEN upper(sha1('e' || event_id)) WHEN 2 THEN substr(sha1('e' || event_id), 2) ELSE sha1('e' || event_id) || chr(10) END"


@query(f"SELECT event_id, event_id % 4 = 0 AS valid, 'objects/' || substr(sha1('e' || event_id), 1, 2) || '/' || substr(sha1('e' || event_id), 3) AS path, sha1('e' || event_id) AS back, 20::BIGINT AS size, sha1('e' || event_id) AS ref FROM events")
def hash_codec(spark, folder):
    plain = F.sha1(F.concat(F.lit("e"), F.col("event_id").cast("string")))
    given = F.expr(_IDS.replace("|| event_id", "|| cast(event_id as string)").replace("chr(10)", "'\n'"))
    rows = table(spark, folder, "events").select("event_id", plain.alias("plain"), given.alias("given"))
    packed = codec.packed(F.col("plain"))
    return rows.select("event_id", codec.valid_hash(F.col("given")).alias("valid"), codec.object_path(F.col("plain")).alias("path"), codec.unpacked(packed).alias("back"), F.octet_length(packed).cast("long").alias("size"), codec.parsed_ref_line(codec.ref_line(F.col("plain"))).alias("ref"))


@query(
    """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderstatus || '/' || o_orderpriority ELSE o_orderstatus || '/' || o_orderpriority || '/' || o_orderkey END AS path FROM orders)
SELECT o_orderkey, path, CASE WHEN path <> '' THEN regexp_extract(path, '[^/]+$') END AS leaf, CASE WHEN path <> '' THEN regexp_replace(path, '/?[^/]+$', '') END AS parent,
  CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END::INT AS segments, path = '' AS root, path = 'O' OR path LIKE 'O/%' AS under, path LIKE 'O/%' AND path NOT LIKE 'O/%/%' AS child FROM p"""
)
def path_functions(spark, folder):
    key = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, "/").when(F.col("o_orderkey") % 4 == 1, F.concat("o_orderstatus", F.lit("/"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("/"), "o_orderstatus", F.lit("/"), "o_orderpriority")).otherwise(F.concat_ws("/", "o_orderstatus", "o_orderpriority", key))
    path, up = F.col("path"), F.lit("O")
    rows = table(spark, folder, "orders").select("o_orderkey", codec.parsed_path(raw).alias("path"))
    return rows.select("o_orderkey", "path", codec.leaf(path).alias("leaf"), codec.parent(path).alias("parent"), codec.num_segments(path).alias("segments"), codec.is_root(path).alias("root"), codec.starts_with(path, up).alias("under"), codec.is_immediate_parent_of(up, path).alias("child"))


@query("SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) + (SELECT count(*) FROM events) - 1)::BIGINT AS idx, l_orderkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)")
def aol_append(spark, folder):
    """Distinct line items appended to a log of the events."""
    start = table(spark, folder, "events").select(F.col("event_id").alias("idx"), F.lit(None).cast("string").alias("payload"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    more = table(spark, folder, "lineitem").select(*keys).distinct().select(F.struct(*keys).alias("ord"), F.col("l_orderkey").cast("string").alias("payload"))
    return log.appended(start, more).filter("payload is not null").select("idx", F.col("payload").cast("long").alias("l_orderkey"))


@query("SELECT conv_id || '/' || turn AS commit, (max(turn) OVER (PARTITION BY conv_id) - turn)::INT AS depth FROM conversations")
def walk_conversations(spark, folder):
    """The walk from every conversation's last turn at once, whatever the table's size."""
    rows = table(spark, folder, "conversations")
    commit = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    edges = rows.filter("turn > 0").select(commit(F.col("turn")).alias("child"), commit(F.col("turn") - 1).alias("parent"), F.lit(0).alias("ord"))
    return graph.walk(edges, rows.groupBy("conv_id").agg(F.max("turn").alias("last")).select(commit(F.col("last")).alias("commit")))
