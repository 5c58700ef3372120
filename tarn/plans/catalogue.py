"""The queries over the driver's tables and their DuckDB equivalents.

Documents, pages and conversations stand in for blobs, sources for trees, and the foreign keys
region > nation > customer > orders > part for the reference graph. Ids are in sha256 mode, which
both engines compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import canonical, ids, names, scan
from tarn.functions.canonical import package_json, spec_json, tree_json
from tarn.functions.hashing import blob_id, meta_id
from tarn.operators import build, graph, store, tree
from tarn.operators.shared import shared_path, stored
from tarn.sources import pack

A = "sha256"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- blobs


def _documents(spark, sf: str) -> DataFrame:
    """doc_id, source, and the document as a blob: id, size, content."""
    rows = _table(spark, sf, "documents").select("doc_id", "source", F.encode("text", "utf-8").alias("content"))
    return rows.withColumns({"id": blob_id(F.col("content"), False, A), "size": F.octet_length("content").cast("long")})


_DOCS = "d AS (SELECT doc_id, source, text, sha256('blob:' || text) AS id, strlen(text)::BIGINT AS size FROM documents)"
_UNIQUE = f"{_DOCS}, u AS (SELECT id, max(size) AS size FROM d GROUP BY id)"


def _unique(spark, sf: str) -> DataFrame:
    """id, kind, size of the distinct documents."""
    return _documents(spark, sf).groupBy("id").agg(F.max("size").alias("size")).select("id", F.lit("blob").alias("kind"), "size")


@query(f"WITH {_DOCS} SELECT doc_id, id, size FROM d")
def blob_ids(spark, sf):
    return _documents(spark, sf).select("doc_id", "id", "size")


@query()
def blob_ids_blake3(spark, sf):
    rows = _table(spark, sf, "documents")
    return rows.select("doc_id", blob_id(F.encode("text", "utf-8")).alias("id"))


@query("SELECT page_id, sha256('blob:' || html) AS blob_id, sha256('exec:' || html) AS exec_id FROM pages")
def exec_vs_blob_ids(spark, sf):
    html = F.encode("html", "utf-8")
    return _table(spark, sf, "pages").select("page_id", blob_id(html, False, A).alias("blob_id"), blob_id(html, True, A).alias("exec_id"))


@query(f"WITH {_DOCS}, g AS (SELECT id, count(*) AS n, max(size) AS size FROM d GROUP BY id) SELECT sum(n)::BIGINT AS objects, count(*)::BIGINT AS distinct_objects, sum(n * size)::BIGINT AS bytes, sum(size)::BIGINT AS distinct_bytes FROM g")
def dedup_report(spark, sf):
    return store.dedup_report(_documents(spark, sf).select("id", "size"))


@query(f"WITH {_DOCS} SELECT id, count(*)::BIGINT AS copies FROM d GROUP BY id HAVING count(*) > 1")
def dedup_groups(spark, sf):
    return _documents(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query(f"WITH {_DOCS} SELECT doc_id, substr(id, 1, 2) || '/' || substr(id, 3) || '.blob' AS path, 'ObjectId(' || id || ')' AS shown FROM d")
def object_paths(spark, sf):
    return _documents(spark, sf).select("doc_id", ids.object_path(F.col("id"), F.lit("blob")).alias("path"), ids.debug(F.col("id")).alias("shown"))


@query("SELECT conv_id, turn, upper(sha256(text)) AS given, sha256(text) AS id FROM conversations")
def parsed_ids(spark, sf):
    given = F.upper(F.sha2(F.encode("text", "utf-8"), 256))
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", given.alias("given"))
    return rows.withColumn("id", ids.from_bytes(ids.to_bytes(ids.parse_id(F.col("given")))))


@query("""SELECT part_kind AS kind, kind_rank, count(*)::BIGINT AS n FROM (
  SELECT (['blob','tree','pkg','spec'])[(p_partkey % 4 + 1)::INT] AS part_kind, (p_partkey % 4)::INT AS kind_rank FROM part) GROUP BY 1, 2""")
def kind_counts(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("blob", "tree", "pkg", "spec"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = _table(spark, sf, "part").select(kind.alias("kind"))
    return rows.groupBy("kind", ids.kind_rank(F.col("kind")).alias("kind_rank")).agg(F.count(F.lit(1)).alias("n"))


# ---- trees, packages, specs


def _source_trees(spark, sf: str) -> DataFrame:
    """A tree per source: source, entries, json, id."""
    none = F.lit(None).cast("string")
    pair = F.struct(F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"), F.struct(F.lit("Blob").alias("type"), F.col("id"), none.alias("target")).alias("entry"))
    trees = _documents(spark, sf).groupBy("source").agg(F.map_from_entries(F.collect_list(pair)).alias("entries"))
    json = tree_json(F.col("entries"))
    return trees.withColumn("json", json).withColumn("id", meta_id("tree", F.col("json"), A))


_TREES = f"""{_DOCS}, t AS (SELECT source, '{{"entries":{{' || string_agg('"doc_' || doc_id || '":{{"type":"Blob","id":"' || id || '"}}', ',' ORDER BY 'doc_' || doc_id) || '}}}}' AS json FROM d GROUP BY source),
trees AS (SELECT source, json, sha256('tree:' || json) AS id FROM t)"""


@query(f"WITH {_TREES} SELECT source, id, strlen(json)::BIGINT AS size FROM trees")
def tree_ids(spark, sf):
    return _source_trees(spark, sf).select("source", "id", F.octet_length("json").cast("long").alias("size"))


@query(f"WITH {_TREES} SELECT t.id AS tree_id, 'doc_' || d.doc_id AS name, 'Blob' AS type, d.id AS child_id FROM trees t JOIN d ON d.source = t.source")
def tree_entries(spark, sf):
    return tree.entries(_source_trees(spark, sf)).select("tree_id", "name", "type", "child_id")


_PKG_JSON = """'{"name":"' || name || '","system":"x86_64-linux-gnu","references":[' || refs || '],"self_references":{},"tree":"' || tree || '"}'"""


@query(f"""WITH p AS (SELECT n_nationkey, 'nation-' || n_nationkey AS name, '"' || sha256('r' || n_regionkey) || '"' AS refs, sha256('t' || n_nationkey) AS tree FROM nation)
SELECT n_nationkey, sha256('pkg:' || {_PKG_JSON}) AS id, name || '-' || sha256('pkg:' || {_PKG_JSON}) AS install_name FROM p""")
def package_ids(spark, sf):
    row = {
        "name": F.concat(F.lit("nation-"), F.col("n_nationkey")),
        "system": F.lit("x86_64-linux-gnu"),
        "references": F.array(F.sha2(F.concat(F.lit("r"), F.col("n_regionkey")), 256)),
        "self_references": F.create_map().cast("map<string,array<bigint>>"),
        "tree": F.sha2(F.concat(F.lit("t"), F.col("n_nationkey")), 256),
    }
    rows = _table(spark, sf, "nation").select("n_nationkey", row["name"].alias("name"), meta_id("pkg", package_json(row), A).alias("id"))
    return rows.select("n_nationkey", "id", names.install_name(F.col("name"), F.col("id")).alias("install_name"))


@query("""SELECT s_suppkey, sha256('spec:{"name":"s","version":"1.' || s_nationkey || '.0","description":null,"license":' || CASE WHEN s_suppkey % 2 = 0 THEN '"MIT"' ELSE 'null' END
 || ',"target":null,"dependencies":[],"build_dependencies":[],"builder":"b\\\\n\\"' || s_suppkey || '\\u001f"}') AS id FROM supplier""".replace("\\\\n", "\\n"))
def spec_ids(spark, sf):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    row = {
        "name": F.lit("s"),
        "version": F.concat(F.lit("1."), F.col("s_nationkey"), F.lit(".0")),
        "description": none,
        "license": F.when(F.col("s_suppkey") % 2 == 0, "MIT"),
        "target": none,
        "dependencies": empty,
        "build_dependencies": empty,
        "builder": F.concat(F.lit('b\n"'), F.col("s_suppkey"), F.lit("\x1f")),
    }
    return _table(spark, sf, "supplier").select("s_suppkey", meta_id("spec", spec_json(row), A).alias("id"))


@query("""WITH x AS (SELECT s_suppkey, 'v' || s_suppkey AS n, '1.' || s_nationkey || '.0' || CASE WHEN s_suppkey % 3 = 0 THEN '-rc.1+b5' WHEN s_suppkey % 3 = 1 THEN '' ELSE '.9' END AS version FROM supplier)
SELECT s_suppkey, version, n || '-' || version AS package, CASE WHEN s_suppkey % 3 < 2 THEN split_part(version, '.', 2)::BIGINT END AS minor, CASE WHEN s_suppkey % 3 = 0 THEN 'rc.1' END AS pre FROM x""")
def spec_versions(spark, sf):
    k = F.col("s_suppkey")
    version = F.concat(F.lit("1."), F.col("s_nationkey"), F.lit(".0"), F.when(k % 3 == 0, "-rc.1+b5").when(k % 3 == 1, "").otherwise(".9"))
    rows = _table(spark, sf, "supplier").select("s_suppkey", version.alias("version"))
    parts = names.version_parts(F.col("version"))
    return rows.select("s_suppkey", "version", names.package_name(F.concat(F.lit("v"), k), F.col("version")).alias("package"), parts["minor"].alias("minor"), parts["pre"].alias("pre"))


# ---- the graph


def _graph(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name: _table(spark, sf, name)
    id_ = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key))
    nodes, edges = None, None
    for kind, name, key in (("pkg", "region", "r_regionkey"), ("pkg", "nation", "n_nationkey"), ("spec", "customer", "c_custkey"), ("tree", "orders", "o_orderkey"), ("blob", "part", "p_partkey")):
        one = t(name).select(id_(name, key).alias("id"), F.lit(kind).alias("kind"), F.length(id_(name, key)).cast("long").alias("size"))
        nodes = one if nodes is None else nodes.unionByName(one)
    for name, parent, pk, child, ck in (("nation", "region", "n_regionkey", "nation", "n_nationkey"), ("customer", "nation", "c_nationkey", "customer", "c_custkey"), ("orders", "customer", "o_custkey", "orders", "o_orderkey"), ("lineitem", "orders", "l_orderkey", "part", "l_partkey")):
        one = t(name).select(id_(parent, pk).alias("parent_id"), id_(child, ck).alias("child_id")).distinct()
        edges = one if edges is None else edges.unionByName(one)
    # keys without a row of their own are left out
    edges = edges.join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").join(nodes.select(F.col("id").alias("child_id")), "child_id", "left_semi")
    return nodes, edges.select("parent_id", "child_id")


def _stored_graph(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """The graph, written once: every round of a walk reads it."""
    nodes, edges = _graph(spark, sf)
    return stored(nodes, "nodes"), stored(edges, "edges")


_GRAPH = """nodes AS MATERIALIZED (
  SELECT 'region:' || r_regionkey AS id, 'pkg' AS kind FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'pkg' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'spec' FROM customer UNION ALL SELECT 'orders:' || o_orderkey, 'tree' FROM orders UNION ALL SELECT 'part:' || p_partkey, 'blob' FROM part),
pairs AS (
  SELECT 'region:' || n_regionkey AS parent_id, 'nation:' || n_nationkey AS child_id FROM nation UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey FROM orders UNION SELECT 'orders:' || l_orderkey, 'part:' || l_partkey FROM lineitem),
edges AS MATERIALIZED (SELECT parent_id, child_id FROM pairs WHERE parent_id IN (SELECT id FROM nodes) AND child_id IN (SELECT id FROM nodes))"""
_REACH = """reach(id) AS (SELECT 'nation:3' UNION SELECT e.child_id FROM reach r JOIN edges e ON e.parent_id = r.id)"""


def _roots(spark, *ids_: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids_], "id string")


@query(f"WITH {_GRAPH} SELECT parent_id, child_id FROM edges")
def edges_all(spark, sf):
    return _graph(spark, sf)[1]


@query(f"WITH RECURSIVE {_GRAPH}, {_REACH} SELECT n.id, n.kind, strlen(n.id)::BIGINT AS size FROM reach JOIN nodes n ON n.id = reach.id")
def closure_nodes(spark, sf):
    return graph.closure(_roots(spark, "nation:3"), *_stored_graph(spark, sf)).nodes


@query(f"WITH RECURSIVE {_GRAPH}, {_REACH} SELECT e.parent_id, e.child_id FROM edges e WHERE e.parent_id IN (SELECT id FROM reach)")
def closure_edges(spark, sf):
    return graph.closure(_roots(spark, "nation:3"), *_stored_graph(spark, sf)).edges


@query(f"WITH RECURSIVE {_GRAPH}, {_REACH} SELECT count(*)::BIGINT AS num_objects, sum(strlen(id))::BIGINT AS unpacked_size FROM reach")
def closure_size(spark, sf):
    found = graph.closure(_roots(spark, "nation:3"), *_stored_graph(spark, sf)).nodes
    return found.agg(F.count(F.lit(1)).alias("num_objects"), F.sum("size").alias("unpacked_size"))


@query(f"""WITH RECURSIVE {_GRAPH}, ok AS (SELECT id FROM nodes WHERE NOT (kind = 'spec' AND id LIKE '%2')),
reach(id) AS (SELECT id FROM ok WHERE id = 'nation:3' UNION SELECT e.child_id FROM reach r JOIN edges e ON e.parent_id = r.id WHERE e.child_id IN (SELECT id FROM ok)) SELECT id FROM reach""")
def closure_filtered(spark, sf):
    enter = ~((F.col("kind") == "spec") & F.col("id").endswith("2"))
    return graph.closure(_roots(spark, "nation:3"), *_stored_graph(spark, sf), enter).nodes.select("id")


_LEVELS = "up(id, level) AS (SELECT id, 0 FROM nodes UNION SELECT e.parent_id, u.level + 1 FROM up u JOIN edges e ON e.child_id = u.id), levels AS (SELECT id, max(level)::INT AS level FROM up GROUP BY id)"


@query(f"WITH RECURSIVE {_GRAPH}, {_LEVELS} SELECT id, level FROM levels")
def topo_levels(spark, sf):
    return graph.levels(*_stored_graph(spark, sf))


@query(f"WITH RECURSIVE {_GRAPH}, {_LEVELS} SELECT l.id, n.kind, CASE n.kind WHEN 'spec' THEN 0 WHEN 'pkg' THEN 2 ELSE 1 END AS group_rank, level FROM levels l JOIN nodes n ON n.id = l.id")
def yield_order(spark, sf):
    return graph.yield_order(*_stored_graph(spark, sf)).select("id", "kind", "group_rank", "level")


@query(f"""WITH {_GRAPH}, s AS (SELECT id FROM nodes WHERE kind NOT IN ('blob', 'tree'))
SELECT id, '' AS seq, '  "' || id || '" [shape = box]' AS line FROM s
UNION ALL SELECT parent_id, child_id, '  "' || child_id || '" -> "' || parent_id || '"' FROM edges WHERE parent_id IN (SELECT id FROM s) AND child_id IN (SELECT id FROM s)""")
def dot_lines(spark, sf):
    return graph.dot_lines(*_graph(spark, sf))


_CYCLE = """e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey % 7 = 0)"""


@query(f"WITH RECURSIVE {_CYCLE}, reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS id FROM reach WHERE a = b")
def cycle_check(spark, sf):
    n = _table(spark, sf, "nation")
    region, nation = F.concat(F.lit("r"), F.col("n_regionkey")), F.concat(F.lit("n"), F.col("n_nationkey"))
    down = n.select(region.alias("parent_id"), nation.alias("child_id"))
    back = n.where("n_nationkey % 7 = 0").select(nation.alias("parent_id"), region.alias("child_id"))
    return graph.cycle_nodes(down.unionByName(back))


def _there(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.substring(F.sha2("id", 256), 1, 1).isin("0", "1", "2", "3"))


_DELTA = """there AS (SELECT id FROM nodes WHERE substr(sha256(id), 1, 1) IN ('0', '1', '2', '3')),
met(id, present) AS (SELECT id, id IN (SELECT id FROM there) FROM nodes WHERE id IN ('nation:3', 'nation:4', 'nation:5')
  UNION SELECT e.child_id, e.child_id IN (SELECT id FROM there) FROM met m JOIN edges e ON e.parent_id = m.id WHERE NOT m.present)"""


def _delta(spark, sf: str) -> graph.Delta:
    nodes, edges = _stored_graph(spark, sf)
    return graph.delta(_roots(spark, "nation:3", "nation:4", "nation:5"), nodes, edges, _there(nodes))


@query(f"WITH RECURSIVE {_GRAPH}, {_DELTA} SELECT id FROM met WHERE NOT present")
def delta_missing(spark, sf):
    return _delta(spark, sf).missing.nodes.select("id")


@query(f"WITH RECURSIVE {_GRAPH}, {_DELTA} SELECT id FROM met WHERE present")
def delta_present(spark, sf):
    return _delta(spark, sf).present.select("id")


# ---- lookups


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def contains_semi(spark, sf):
    parts = _table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"))
    asked = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"))
    return store.contains(parts, asked).withColumnRenamed("id", "l_partkey")


@query("SELECT DISTINCT l_orderkey AS id, l_partkey AS reference FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def missing_refs(spark, sf):
    orders = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("references"))
    have = _table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"))
    return store.missing_references(orders, have)


def _kinds(spark, sf: str) -> DataFrame:
    """The same ids under several kinds: id, kind, size."""
    part = _table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.explode(F.array(*map(F.lit, ("spec", "pkg", "tree", "blob")))).alias("kind"), F.col("p_partkey").alias("k"))
    return part.where((F.col("k") + ids.kind_rank(F.col("kind"))) % 3 == 0).select("id", "kind", F.length("id").cast("long").alias("size"))


@query("""WITH k AS (SELECT p_partkey, unnest(['blob', 'tree', 'pkg', 'spec']) AS kind, unnest([0, 1, 2, 3]) AS r FROM part),
o AS (SELECT p_partkey::VARCHAR AS id, kind, r, row_number() OVER (PARTITION BY p_partkey ORDER BY r) AS i FROM k WHERE (p_partkey + r) % 3 = 0) SELECT id, kind, strlen(id)::BIGINT AS size FROM o WHERE i = 1""")
def lookup_by_kind(spark, sf):
    asked = _table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return store.lookup(_kinds(spark, sf), asked).where("kind IS NOT NULL")


# ---- a store on disk


def _new_store(spark, name: str) -> store.Store:
    return store.Store.init_bare(spark, shared_path(spark, name), A)


def _filled(spark, sf: str) -> tuple[store.Store, DataFrame]:
    """A store with the documents, a tree for each source and a package for each tree; and the packages' ids."""
    docs = _table(spark, sf, "documents").select(F.encode("text", "utf-8").alias("content"))
    trees = store.metas(_source_trees(spark, sf), "tree", algorithm=A)
    row = {
        "name": F.concat(F.lit("p-"), F.substring("id", 1, 8)),
        "system": F.lit("x86_64-linux-gnu"),
        "references": F.array().cast("array<string>"),
        "self_references": F.create_map().cast("map<string,array<bigint>>"),
        "tree": F.col("id"),
    }
    packages = store.metas(trees.select(package_json(row).alias("json")), "pkg", algorithm=A)
    s = _new_store(spark, "store")
    s.insert(store.blobs(docs, algorithm=A).unionByName(trees), verify=True)
    s.insert(packages)
    s.insert(packages)  # adds nothing
    return s, stored(packages.select("id"), "roots")


_PACKAGES = f"""{_TREES}, p AS (SELECT source, 'p-' || substr(id, 1, 8) AS name, '{{"name":"p-' || substr(id, 1, 8) || '","system":"x86_64-linux-gnu","references":[],"self_references":{{}},"tree":"' || id || '"}}' AS json FROM trees),
pkgs AS (SELECT source, name, json, sha256('pkg:' || json) AS id FROM p),
objects AS (SELECT DISTINCT id, 'blob' AS kind, size FROM d UNION ALL SELECT id, 'tree', strlen(json)::BIGINT FROM trees UNION ALL SELECT id, 'pkg', strlen(json)::BIGINT FROM pkgs)"""


@query(f"WITH {_PACKAGES} SELECT id, kind, size FROM objects")
def store_objects(spark, sf):
    return _filled(spark, sf)[0].nodes()


@query(f"WITH {_PACKAGES} SELECT id, name, name || '-' || id AS path FROM pkgs")
def store_installed(spark, sf):
    return _filled(spark, sf)[0].installed()


@query(f"""WITH {_PACKAGES} SELECT p.id AS parent_id, 'pkg' AS parent_kind, t.id AS child_id, 'tree' AS child_kind FROM pkgs p JOIN trees t ON t.source = p.source
UNION ALL SELECT t.id, 'tree', d.id, 'blob' FROM trees t JOIN d ON d.source = t.source""")
def store_edges(spark, sf):
    return _filled(spark, sf)[0].edges()


@query(f"WITH {_PACKAGES} SELECT id, kind, size FROM objects WHERE kind <> 'pkg'")
def store_sizes(spark, sf):
    s, _ = _filled(spark, sf)
    return s.sizes(s.nodes().where("kind <> 'pkg'"))


@query(f"WITH {_PACKAGES} SELECT id, kind, size FROM objects")
def pack_round_trip(spark, sf):
    """A closure sent as a pack and received by an empty store."""
    s, roots = _filled(spark, sf)
    where = shared_path(spark, "pack")
    s.send_pack(s.closure(roots), where)
    other = _new_store(spark, "store")
    other.recv_pack(where)
    return other.nodes()


@query(f"""WITH {_PACKAGES}, half AS (SELECT id FROM pkgs WHERE substr(id, 1, 1) < '8')
SELECT o.id, o.kind, o.size, o.kind = 'pkg' AND o.id IN (SELECT id FROM half) AS was_there FROM objects o""")
def copy_closure(spark, sf):
    """Half the packages are copied, then all: what the second copy met and copied makes up the whole."""
    s, roots = _filled(spark, sf)
    other = _new_store(spark, "store")
    s.copy_to(other, roots.where("substr(id, 1, 1) < '8'"))
    found = s.copy_to(other, roots)
    there = found.present.where("kind = 'pkg'").select("id", "kind", F.lit(True).alias("was_there"))
    return other.nodes().join(there, ["id", "kind"], "left").select("id", "kind", "size", F.coalesce("was_there", F.lit(False)).alias("was_there"))


@query(f"""WITH {_PACKAGES}, sent AS (SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'pkg' THEN 2 ELSE 1 END, CASE kind WHEN 'blob' THEN 0 ELSE 1 END, id) - 1 AS position FROM objects)
SELECT position * 2 AS seq, 'begin' AS event, id, kind, size, NULL::BIGINT AS bytes, NULL::BIGINT AS num_objects FROM sent
UNION ALL SELECT position * 2 + 1, 'read', id, NULL, NULL, size, NULL FROM sent UNION ALL SELECT count(*) * 2, 'finished', NULL, NULL, NULL, sum(size)::BIGINT, count(*) FROM sent""")
def copy_events(spark, sf):
    s, roots = _filled(spark, sf)
    return store.copy_events(s.closure(roots))


_JSON_NAMES = ["a-1.0", ".a", "", "a b"]
_JSON_SYSTEMS = ["x86_64-linux-gnu", "i686-darwin", "arm-linux", "x86_64-darwin-z"]


def _package_texts(spark, sf: str) -> DataFrame:
    """Packages as JSON, some with a name, a system or an id that is not valid: p_partkey, json."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n) % len(values) + 1).cast("int"))
    id_ = F.when(k % 5 == 0, F.substring(F.sha2("p_name", 256), 1, 63)).otherwise(F.sha2("p_name", 256))
    json = F.concat(F.lit('{"name":"'), pick(_JSON_NAMES, 1), F.lit('","system":"'), pick(_JSON_SYSTEMS, 4), F.lit('","references":["'), id_, F.lit('"],"self_references":{},"tree":"'), F.sha2("p_brand", 256), F.lit('"}'))
    return _table(spark, sf, "part").select("p_partkey", json.alias("json"))


@query(f"""WITH x AS (SELECT p_partkey, ({_JSON_NAMES!r})[(p_partkey % 4 + 1)::INT] AS name, ({_JSON_SYSTEMS!r})[(p_partkey // 4 % 4 + 1)::INT] AS system, p_partkey % 5 = 0 AS short FROM part)
SELECT p_partkey, CASE WHEN name <> 'a-1.0' THEN 'not a package name: ' || name WHEN system = 'arm-linux' THEN 'not a platform: ' || system WHEN short THEN 'a reference that is no object id' END AS fault FROM x""")
def package_faults(spark, sf):
    return _package_texts(spark, sf).select("p_partkey", canonical.fault("pkg", canonical.parse("pkg", F.col("json"))).alias("fault"))


@query(f"""SELECT p_partkey, 'a-1.0' AS name, (['x86_64-linux-gnu', 'i686-darwin', '', 'x86_64-darwin'])[(p_partkey // 4 % 4 + 1)::INT] AS system FROM part WHERE p_partkey % 4 = 0 AND p_partkey // 4 % 4 <> 2 AND p_partkey % 5 <> 0""")
def package_fields(spark, sf):
    """Packages decoded with every check on."""
    texts = _package_texts(spark, sf).withColumn("ok", canonical.fault("pkg", canonical.parse("pkg", F.col("json"))).isNull())
    f = canonical.decode("pkg", F.when(F.col("ok"), F.col("json")))
    return texts.where("ok").select("p_partkey", f.alias("f")).select("p_partkey", "f.name", "f.system")


# ---- packs


@query(f"WITH {_UNIQUE} SELECT id, size, (11 + coalesce(sum(size + 41) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS entry_offset FROM u")
def pack_layout(spark, sf):
    rows = _unique(spark, sf).withColumn("run", F.substring("id", 1, 2))
    return pack.layout(rows, ["id"], "run").select("id", "size", "entry_offset")


@query(f"WITH {_UNIQUE} SELECT id, id || '00' || printf('%016x', size) AS header FROM u")
def pack_headers(spark, sf):
    raw = pack.header_column(F.col("id"), F.col("kind"), F.lit(False), F.col("size"))
    return _unique(spark, sf).select("id", F.lower(F.hex(raw)).alias("header"))


def _sent(spark, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select(F.col("doc_id").alias("position"), "id", F.lit("blob").alias("kind"), "size")
    return pack.progress(docs, "position")


_SENT = f"""{_DOCS}, sent AS (SELECT doc_id * 2 AS seq, 'begin' AS event, id, 'blob' AS kind, size, NULL::BIGINT AS bytes, NULL::BIGINT AS num_objects FROM d
UNION ALL SELECT doc_id * 2 + 1, 'read', id, NULL, NULL, size, NULL FROM d UNION ALL SELECT max(doc_id) * 2 + 2, 'finished', NULL, NULL, NULL, sum(size)::BIGINT, count(*) FROM d)"""


@query(f"WITH {_SENT} SELECT * FROM sent")
def progress_events(spark, sf):
    return _sent(spark, sf)


@query(f"WITH {_SENT} SELECT sum(CASE WHEN event = 'read' THEN bytes END)::BIGINT AS received_bytes, count(*) FILTER (WHERE event = 'begin')::BIGINT AS num_objects FROM sent")
def progress_totals(spark, sf):
    from tarn.streaming.ingest import event_totals

    return event_totals(_sent(spark, sf))


@query("SELECT sha256('blob:' || text) AS id, 'blob' AS kind, sha256('blob:' || text || 'x') AS found FROM documents WHERE doc_id % 10 = 0")
def integrity_check(spark, sf):
    rows = _documents(spark, sf).select("id", F.lit("blob").alias("kind"), F.lit(False).alias("is_executable"), F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit(b"x"))).otherwise(F.col("content")).alias("content"))
    return store.mismatches(rows, A)


# ---- references and rewriting


def _with_tokens(spark, sf: str) -> DataFrame:
    h = lambda tag: F.sha2(F.concat(F.lit(tag), F.col("doc_id") % 50), 256)
    text = F.concat("text", F.lit(" a.b-"), F.upper(h("x")), F.lit("ff-"), h("y"), F.lit(" /-"), h("z"), F.lit("\nq-"), h("w"), F.lit(" q-"), h("w"))
    return _table(spark, sf, "documents").select("doc_id", "source", text.alias("text"))


_TOKENS = """tokens AS (SELECT doc_id, source, text || ' a.b-' || upper(sha256('x' || (doc_id % 50))) || 'ff-' || sha256('y' || (doc_id % 50)) || ' /-' || sha256('z' || (doc_id % 50)) || chr(10) || 'q-' || sha256('w' || (doc_id % 50)) || ' q-' || sha256('w' || (doc_id % 50)) AS text FROM documents),
refs AS (SELECT doc_id, source, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9+\\-._?=]-([0-9a-fA-F]{64})[0-9a-fA-F]*', 1), lambda x: lower(x)))) AS refs FROM tokens)"""


@query(f"WITH {_TOKENS} SELECT doc_id, unnest(refs) AS reference FROM refs")
def reference_scan(spark, sf):
    rows = _with_tokens(spark, sf)
    return rows.select("doc_id", F.explode(scan.references(F.col("text"))).alias("reference"))


@query(f"WITH {_TOKENS} SELECT doc_id, unnest(refs) AS reference FROM refs")
def binary_reference_scan(spark, sf):
    rows = _with_tokens(spark, sf)
    return rows.select("doc_id", F.explode(scan.binary_references(F.encode("text", "utf-8"))).alias("reference"))


@query(f"WITH {_TOKENS} SELECT DISTINCT source, unnest(refs) AS reference FROM refs")
def references_by_tree(spark, sf):
    rows = _with_tokens(spark, sf)
    return rows.select("source", F.explode(scan.references(F.col("text"))).alias("reference")).distinct()


@query(f"WITH {_TOKENS} SELECT doc_id, list_has_all([sha256('x' || (doc_id % 50)), sha256('w' || (doc_id % 40))], refs) AS is_subset, len(list_filter(refs, lambda r: r <> sha256('w' || (doc_id % 50))))::INT AS without_own FROM refs")
def reference_subset(spark, sf):
    h = lambda tag, n: F.sha2(F.concat(F.lit(tag), F.col("doc_id") % n), 256)
    refs = scan.references(F.col("text"))
    return _with_tokens(spark, sf).select("doc_id", (F.size(F.array_except(refs, F.array(h("x", 50), h("w", 40)))) == 0).alias("is_subset"), F.size(F.array_remove(refs, h("w", 50))).alias("without_own"))


def _with_paths(spark, sf: str) -> DataFrame:
    text = F.concat(F.lit("/tmp/build/out"), F.col("text"), F.lit("/tmp/build/out/tmp/build/ou"))
    return _table(spark, sf, "documents").select("doc_id", F.encode(text, "utf-8").alias("content"))


@query("SELECT doc_id, sha256(replace('/tmp/build/out' || text || '/tmp/build/out/tmp/build/ou', '/tmp/build/out', '/store/x//////')) AS id FROM documents")
def rewrite_text(spark, sf):
    done = scan.rewrite(F.col("content"), "/tmp/build/out", "/store/x")
    return _with_paths(spark, sf).select("doc_id", F.sha2(done["content"], 256).alias("id"))


@query("SELECT doc_id, unnest([0, 14 + strlen(text)])::BIGINT AS at FROM documents")
def rewrite_offsets(spark, sf):
    done = scan.rewrite(F.col("content"), "/tmp/build/out", "/store/x")
    return _with_paths(spark, sf).select("doc_id", F.explode(done["offsets"]).alias("at"))


@query("SELECT doc_id, sha256(replace('/tmp/build/out' || text || '/tmp/build/out/tmp/build/ou', '/tmp/build/out', '/store/abc-def')) AS id FROM documents")
def write_at_offsets(spark, sf):
    rows = _with_paths(spark, sf).withColumn("r", scan.rewrite(F.col("content"), "/tmp/build/out", "/store/x"))
    return rows.select("doc_id", F.sha2(scan.write_at(F.col("r.content"), F.col("r.offsets"), F.lit("/store/abc-def")), 256).alias("id"))


# ---- names and platforms


def _names(spark, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("."), F.col("p_brand"))).when(k % 5 == 1, F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).when(k % 5 == 2, F.repeat(F.lit("a"), (k % 4 + 189).cast("int"))).when(k % 5 == 3, F.lit("")).otherwise(F.concat(F.lit("a b"), k))
    return _table(spark, sf, "part").select("p_partkey", name.alias("name"))


_NAMES = """n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.' || p_brand WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN repeat('a', (p_partkey % 4 + 189)::INT) WHEN 3 THEN '' ELSE 'a b' || p_partkey END AS name FROM part)"""


@query(f"""WITH {_NAMES} SELECT p_partkey, name, name <> '' AND strlen(name) <= 191 AND name NOT LIKE '.%' AND regexp_full_match(name, '[A-Za-z0-9+\\-._?=]*') AS valid,
CASE WHEN name = '' THEN 'a package name must not be empty' WHEN strlen(name) > 191 THEN 'a package name has at most 191 bytes' WHEN name LIKE '.%' THEN 'a package name must not begin with a period'
WHEN NOT regexp_full_match(name, '[A-Za-z0-9+\\-._?=]*') THEN 'a package name has letters, digits and + - . _ ? = only' END AS error FROM n""")
def package_name_valid(spark, sf):
    return _names(spark, sf).select("p_partkey", "name", names.is_name(F.col("name")).alias("valid"), names.name_error(F.col("name")).alias("error"))


@query("SELECT p_partkey, 'p-' || p_size AS name, sha256(p_name) AS id, 'p-' || p_size || '-' || sha256(p_name) AS install_name FROM part")
def install_names(spark, sf):
    whole = names.install_name(F.concat(F.lit("p-"), F.col("p_size")), F.sha2("p_name", 256))
    rows = _table(spark, sf, "part").select("p_partkey", whole.alias("install_name"))
    name, id_ = names.install_parts(F.col("install_name"))
    return rows.select("p_partkey", name.alias("name"), id_.alias("id"), "install_name")


_PLATFORMS = ["x86_64-linux-gnu", "i686-linux-musl", "x86_64-darwin", "i686-darwin-x", "arm-darwin", "x86_64-linux", "x86_64-linux-gnu-x", ""]


@query(f"""WITH p AS (SELECT p_partkey, ({_PLATFORMS!r})[(p_partkey % 8 + 1)::INT] AS text FROM part)
SELECT p_partkey, text, CASE text WHEN 'x86_64-linux-gnu' THEN text WHEN 'i686-linux-musl' THEN text WHEN 'x86_64-darwin' THEN text WHEN 'i686-darwin-x' THEN 'i686-darwin' END AS platform FROM p""")
def platform_parse(spark, sf):
    text = F.element_at(F.array(*map(F.lit, _PLATFORMS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = _table(spark, sf, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", "text", names.platform(F.col("text")).alias("platform"))


# ---- installing


@query(f"""WITH {_TREES}, l AS (SELECT source, substr(source, 4) AS n, id FROM trees),
up AS (SELECT n, id, 'pkg-' || n || '-' || sha256('p' || n) AS base FROM l)
SELECT sha256('p' || u.n) AS package_id, u.base || '/docs/doc_' || d.doc_id AS path, CASE WHEN d.doc_id % 3 = 0 THEN 'rewrite' ELSE 'link' END AS action, d.id AS blob_id, NULL::VARCHAR AS target
FROM up u JOIN d ON d.source = 'src' || u.n UNION ALL SELECT sha256('p' || n), base || '/latest', 'symlink', NULL, 'docs' FROM up""".replace("CASE WHEN d.doc_id % 3 = 0", "CASE WHEN EXISTS (SELECT 1 FROM d x WHERE x.source = d.source AND x.id = d.id AND x.doc_id % 3 = 0)"))
def install_manifest(spark, sf):
    # trees and self-references stay rows: one of a source's tree or references would hold all its documents
    docs = stored(_documents(spark, sf).select("doc_id", "source", "id"), "blob-ids")
    none = F.lit(None).cast("string")
    leaves = docs.select(F.col("source").alias("tree"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"), F.lit("Blob").alias("type"), "id", none.alias("target"))
    trees = stored(tree.streamed_ids(leaves).withColumnRenamed("tree", "source"), "source-trees")
    n = F.substring("source", 4, 100)
    pkg, top = F.sha2(F.concat(F.lit("p"), n), 256), F.sha2(F.concat(F.lit("top"), n), 256)
    own = docs.where("doc_id % 3 = 0").select(pkg.alias("package_id"), F.col("id").alias("blob_id"), F.array(F.lit(0).cast("long")).alias("offsets"))
    packages = trees.select(pkg.alias("id"), F.concat(F.lit("pkg-"), n).alias("name"), top.alias("tree"))
    upper = trees.select(top.alias("tree_id"), F.explode(F.array(
        F.struct(F.lit("docs").alias("name"), F.lit("Tree").alias("type"), F.col("id").alias("child_id"), none.alias("target")),
        F.struct(F.lit("latest").alias("name"), F.lit("Symlink").alias("type"), none.alias("child_id"), F.lit("docs").alias("target")),
    )).alias("e")).select("tree_id", "e.*")
    named = trees.select("source", F.col("id").alias("tree_id"))
    lower = leaves.join(named, F.col("tree").eqNullSafe(F.col("source"))).select("tree_id", "name", "type", F.col("id").alias("child_id"), "target")
    found = build.install_manifest(packages, stored(upper.unionByName(lower), "tree-entries"), docs.select("id"), self_references=own)
    return found.select("package_id", "path", "action", "blob_id", "target")


