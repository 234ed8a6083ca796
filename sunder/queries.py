"""Queries over the driver's tables, and their DuckDB twins.

One entry per operator.  Sizes are those of the operator's defaults, 80 % train
and 20 % test, unless a query says otherwise.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunder.functions.hashing import hash_key_sql
from sunder.operators import audit, baseline, lineage, pairs, property as prop, protocol, similarity as sim, structure
from sunder.plans.distance import scaled_vectors, token_edges, token_links, vector_edges
from sunder.plans.groups import assign_groups

QUERIES: dict = {}
ORACLE_SQL: dict = {}

N_TEST = "CAST(floor(0.2 * n + 0.5) AS BIGINT)"
#: Squared distance, in units of 1/1024, below which vectors count as near.
NEAR = 1_500_000.0


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def greedy_sql(rows: str, test: str = N_TEST, name: str = "") -> str:
    """Whole groups of ``rows`` (SQL giving id, key), largest first, to the side with most room."""
    return f"""
WITH RECURSIVE rows_ AS ({rows}), g AS (SELECT key, count(*) AS size, min(id) AS first_ FROM rows_ GROUP BY key),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, first_) AS r, row_number() OVER (ORDER BY first_) - 1 AS grp FROM g),
cap AS (SELECT n - {test} AS tr, {test} AS te FROM (SELECT count(*) AS n FROM rows_)),
f(r, a, b, part) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), ''
  UNION ALL
  SELECT o.r, CASE WHEN tr - a >= te - b THEN a + size ELSE a END, CASE WHEN tr - a >= te - b THEN b ELSE b + size END,
         CASE WHEN tr - a >= te - b THEN 'train' ELSE 'test' END
  FROM f JOIN o ON o.r = f.r + 1 CROSS JOIN cap
)
SELECT rows_.id, f.part AS partition, CAST(o.grp AS BIGINT) AS "group"
FROM rows_ JOIN o ON rows_.key IS NOT DISTINCT FROM o.key JOIN f ON f.r = o.r"""


# --- baseline -------------------------------------------------------------------------------


def _hashed(purpose: str, k, table: str, id_col: str) -> str:
    return f"row_number() OVER (ORDER BY {hash_key_sql(0, purpose, k, id_col)}, {id_col}) - 1"


@query("random", f"""SELECT id, CASE WHEN pos < n - {N_TEST} THEN 'train' ELSE 'test' END AS partition FROM (
  SELECT o_orderkey AS id, {_hashed('random.permutation', 0, 'orders', 'o_orderkey')} AS pos, count(*) OVER () AS n FROM orders)""")
def _(spark, sf):
    return baseline.random_split(_t(spark, sf, "orders"), "o_orderkey")


@query("stratified_random", f"""WITH s AS (
  SELECT o_orderkey AS id, count(*) OVER () AS n, count(*) OVER (PARTITION BY o_orderpriority) AS m,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash_key_sql(0, 'stratified.permutation', 0, 'o_orderkey')}, o_orderkey) - 1 AS pos
  FROM orders), t AS (SELECT *, n - {N_TEST} AS tr, {N_TEST} AS te FROM s)
SELECT id, CASE WHEN pos < (m * tr) // n + CASE WHEN (m * tr) % n + (m * te) % n > 0 AND (m * tr) % n >= (m * te) % n THEN 1 ELSE 0 END
           THEN 'train' ELSE 'test' END AS partition FROM t""")
def _(spark, sf):
    return baseline.stratified_random(_t(spark, sf, "orders"), "o_orderkey", "o_orderpriority")


@query("k_fold", f"""SELECT o_orderkey AS id, CAST(ntile(5) OVER (ORDER BY {hash_key_sql(0, 'kfold.permutation', 0, 'o_orderkey')}, o_orderkey) - 1 AS INTEGER) AS fold FROM orders""")
def _(spark, sf):
    return baseline.k_fold(_t(spark, sf, "orders"), "o_orderkey", 5)


@query("k_fold_stratified", f"""SELECT o_orderkey AS id, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash_key_sql(0, 'kfold.permutation', 0, 'o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""")
def _(spark, sf):
    return baseline.k_fold(_t(spark, sf, "orders"), "o_orderkey", 5, label="o_orderpriority")


@query("monte_carlo", f"""SELECT id, CAST(k AS INTEGER) AS repeat, CASE WHEN pos < n - {N_TEST} THEN 'train' ELSE 'test' END AS partition FROM (
  SELECT o_orderkey AS id, k, row_number() OVER (PARTITION BY k ORDER BY {hash_key_sql(0, 'montecarlo.permutation', 'k', 'o_orderkey')}, o_orderkey) - 1 AS pos,
         count(*) OVER (PARTITION BY k) AS n FROM orders CROSS JOIN range(3) AS r(k))""")
def _(spark, sf):
    return baseline.monte_carlo(_t(spark, sf, "orders"), "o_orderkey", 3)


@query("predefined", """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'train' WHEN 'F' THEN 'test' ELSE 'discard' END AS partition FROM orders""")
def _(spark, sf):
    part = F.when(F.col("o_orderstatus") == "O", "train").when(F.col("o_orderstatus") == "F", "test")
    return baseline.predefined(_t(spark, sf, "orders").withColumn("given", part), "o_orderkey", "given")


@query("predefined_fold", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'test' WHEN o_orderkey % 4 = 0 THEN 'discard' ELSE 'train' END AS partition FROM orders""")
def _(spark, sf):
    fold = F.when(F.col("o_orderkey") % 4 == 0, -1).otherwise(F.col("o_orderkey") % 4)
    return baseline.predefined(_t(spark, sf, "orders").withColumn("fold", fold), "o_orderkey", fold_column="fold", fold=1)


# --- keys -----------------------------------------------------------------------------------


def _by_key(name: str, table: str, id_col: str, key: str):
    """A query that groups by a key expression both engines share."""
    QUERIES[name] = lambda spark, sf: assign_groups(_t(spark, sf, table), id_col, F.expr(key), check=False)
    ORACLE_SQL[name] = greedy_sql(f"SELECT {id_col} AS id, {key} AS key FROM {table}")


_by_key("murcko_scaffold", "part", "p_partkey", "concat(p_brand, '/', p_type)")
_by_key("generic_scaffold", "part", "p_partkey", "p_type")
_by_key("scaffold_tree", "part", "p_partkey", "substring(p_brand, 1, 7)")
_by_key("protein_family", "customer", "c_custkey", "c_mktsegment")
_by_key("source", "documents", "doc_id", "coalesce(source, '__MISSING__')")
_by_key("source_hierarchy", "customer", "c_custkey", "concat(CAST(c_nationkey AS STRING), '/', c_mktsegment)")
_by_key("group_assignment_fine", "orders", "o_orderkey", "o_custkey % 701")

_PART_KEYS = "[concat('p', CAST(p_retailprice AS VARCHAR)), concat('n', p_name)]"


def components_sql(edges: str, ids: str) -> str:
    """``id, key``: the smallest id reachable by edges(a, b)."""
    return f"""SELECT i.id, coalesce(min(y), i.id) AS key FROM ({ids}) i LEFT JOIN (
  WITH RECURSIVE e AS ({edges}), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(x, y) AS (SELECT a, a FROM both_ UNION SELECT r.x, b FROM reach r JOIN both_ ON a = r.y) SELECT x, y FROM reach
) q ON q.x = i.id GROUP BY i.id"""


@query("ring_system", greedy_sql(components_sql(
    f"WITH k AS (SELECT p_partkey AS id, unnest({_PART_KEYS}) AS k FROM part) SELECT x.id AS a, m.b FROM k x JOIN (SELECT k, min(id) AS b FROM k GROUP BY k) m USING (k) WHERE x.id <> m.b",
    "SELECT p_partkey AS id FROM part")))
def _(spark, sf):
    part = _t(spark, sf, "part").withColumn("keys", F.array(F.concat(F.lit("p"), F.col("p_retailprice").cast("string")), F.concat(F.lit("n"), "p_name")))
    edges = sim.shared_key_edges(part, "p_partkey", "keys")
    return sim.component_split(part.select(F.col("p_partkey").alias("id")), edges, check=False)


@query("matched_molecular_series", greedy_sql(components_sql(
    "WITH k AS (SELECT o_orderkey AS id, o_custkey AS k FROM orders) SELECT x.id AS a, m.b FROM k x JOIN (SELECT k, min(id) AS b, count(*) AS c FROM k GROUP BY k) m USING (k) WHERE x.id <> m.b AND c >= 2",
    "SELECT o_orderkey AS id FROM orders")))
def _(spark, sf):
    orders = _t(spark, sf, "orders").withColumn("keys", F.array("o_custkey"))
    return sim.component_split(orders.select(F.col("o_orderkey").alias("id")), sim.shared_key_edges(orders, "o_orderkey", "keys"), check=False)


_MATCH = "coalesce(p_type LIKE '%A%' OR p_size < 10, FALSE)"


@query("substructure", f"""WITH m AS (SELECT p_partkey AS id, {_MATCH} AS hit, count(*) OVER () AS n, row_number() OVER (PARTITION BY {_MATCH} ORDER BY {hash_key_sql(0, 'substructure.valid', 0, 'p_partkey')}, p_partkey) - 1 AS pos FROM part)
SELECT id, CASE WHEN hit THEN 'test' WHEN pos < CAST(floor(0.1 * n + 0.5) AS BIGINT) THEN 'valid' ELSE 'train' END AS partition FROM m""")
def _(spark, sf):
    return structure.substructure(_t(spark, sf, "part"), "p_partkey", [F.col("p_type").like("%A%"), F.col("p_size") < 10], train=None, valid=0.1, test=0.2)


@query("substructure_all", """SELECT p_partkey AS id, CASE WHEN p_type LIKE '%A%' AND p_size < 10 THEN 'train' ELSE 'test' END AS partition FROM part""")
def _(spark, sf):
    return structure.substructure(_t(spark, sf, "part"), "p_partkey", [F.col("p_type").like("%A%"), F.col("p_size") < 10], "all", "train")


@query("ring_system_all_shared", greedy_sql("SELECT p_partkey AS id, p_name AS key FROM part"))
def _(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", F.array("p_name", "p_name").alias("keys"))
    return assign_groups(part, "p_partkey", structure.key_set("keys"), check=False)


@query("scaffold_empty_discard", f"""SELECT * FROM ({greedy_sql("SELECT p_partkey AS id, p_type AS key FROM part WHERE p_type NOT LIKE '%A%'")})
UNION ALL SELECT p_partkey, 'discard', NULL FROM part WHERE p_type LIKE '%A%'""")
def _(spark, sf):
    part = _t(spark, sf, "part").withColumn("key", F.when(~F.col("p_type").like("%A%"), F.col("p_type")))
    return structure.scaffold_split(part, "p_partkey", "key", "discard", check=False)


@query("matched_molecular_series_boundary", f"""WITH s AS ({greedy_sql("SELECT o_orderkey AS id, o_orderdate AS key FROM orders")}), c AS (SELECT s.*, concat(CAST(o_custkey AS VARCHAR), '/', o_orderpriority) AS k FROM s JOIN orders ON o_orderkey = id)
SELECT id, CASE WHEN partition = 'test' AND k IN (SELECT k FROM c WHERE partition = 'train') THEN 'discard' ELSE partition END AS partition FROM c""")
def _(spark, sf):
    orders = _t(spark, sf, "orders").withColumn("contexts", F.array(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority")))
    return structure.discard_boundary(assign_groups(orders, "o_orderkey", F.col("o_orderdate"), check=False), orders, "o_orderkey", "contexts")


_WORDS = "list_distinct(string_split(text, ' '))"
_TOKEN_EDGES = f"""WITH s AS (SELECT doc_id AS id, unnest({_WORDS}) AS w FROM documents), c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
  i AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.w = y.w AND x.id < y.id GROUP BY ALL)
  SELECT a, b, k AS inter, p.n AS na, q.n AS nb FROM i JOIN c p ON p.id = a JOIN c q ON q.id = b WHERE k * 10 >= 8 * (p.n + q.n - k)"""


def _documents(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"), "n_chars", "source")


@query("token_edges", f"SELECT a, b, inter, na, nb FROM ({_TOKEN_EDGES})")
def _(spark, sf):
    return token_edges(_documents(spark, sf), "doc_id", "words", 8, 10).select("a", "b", F.col("inter").cast("long"), F.col("na").cast("long"), F.col("nb").cast("long"))


@query("similarity_threshold", greedy_sql(components_sql(f"SELECT a, b FROM ({_TOKEN_EDGES})", "SELECT doc_id AS id FROM documents")))
def _(spark, sf):
    docs = _documents(spark, sf)
    return sim.component_split(docs.select(F.col("doc_id").alias("id")), token_links(docs, "doc_id", "words", 8, 10), check=False)


def _cliffs(spark, sf):
    rows = _documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("y"), "words")
    return rows.select("id", "y"), structure.cliff_links(rows, "words", 8, 10, 1.02, "linear")


_CLIFFS = f"""e AS ({_TOKEN_EDGES}), cl AS (SELECT a, b FROM e JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE greatest(x.n_chars, y.n_chars) / least(x.n_chars, y.n_chars) >= 1.02 - 1e-9),
  cn AS (SELECT a AS id FROM cl UNION SELECT b FROM cl)"""


@query("activity_cliff", f"""WITH {_CLIFFS}, ck AS ({components_sql("SELECT a, b FROM cl", "SELECT id FROM cn")}),
u AS (SELECT key, count(*) AS size FROM ck GROUP BY key), us AS (SELECT *, sum(size) OVER (ORDER BY size DESC, key) - size AS start FROM u),
k AS (SELECT count(*) AS n, (SELECT count(*) FROM cn) AS c FROM documents),
rest AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {hash_key_sql(0, 'cliff.assign', 0, 'doc_id')}, doc_id) - 1 + (SELECT c FROM k) AS start FROM documents WHERE doc_id NOT IN (SELECT id FROM cn)),
p AS (SELECT id, start FROM ck JOIN us USING (key) UNION ALL SELECT * FROM rest),
t AS (SELECT greatest((SELECT max(start + size) FROM us, k WHERE start < {N_TEST}), (SELECT {N_TEST} FROM k)) AS t)
SELECT id, CASE WHEN start < t THEN 'test' ELSE 'train' END AS partition FROM p, t""")
def _(spark, sf):
    rows, links = _cliffs(spark, sf)
    return structure.activity_cliff(rows, None, links=links)


@query("activity_cliff_balanced", f"""WITH {_CLIFFS}, ck AS ({components_sql("SELECT a, b FROM cl", "SELECT id FROM cn")}), g0 AS ({greedy_sql("SELECT id, key FROM ck UNION ALL SELECT doc_id, doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM cn)")})
SELECT id, partition FROM g0""")
def _(spark, sf):
    rows, links = _cliffs(spark, sf)
    return structure.activity_cliff(rows, None, links=links, target="balanced")


# --- property -------------------------------------------------------------------------------

_RANK = "SELECT o_orderkey AS id, o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders"

for _dir, _cond in (
    ("high_test", f"pos >= n - {N_TEST}"),
    ("low_test", f"pos < {N_TEST}"),
    ("extremes_test", f"pos < {N_TEST} // 2 OR pos >= n - ({N_TEST} - {N_TEST} // 2)"),
    ("middle_test", f"pos >= (n - {N_TEST}) // 2 AND pos < (n - {N_TEST}) // 2 + {N_TEST}"),
):
    query(f"property_{_dir}", f"SELECT id, CASE WHEN {_cond} THEN 'test' ELSE 'train' END AS partition FROM ({_RANK})")(
        partial(lambda d, spark, sf: prop.property_split(_t(spark, sf, "orders"), "o_orderkey", "o_totalprice", d), _dir)
    )


@query("property_valid", """WITH r AS (SELECT p_partkey AS id, p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part),
t AS (SELECT *, pos >= n - CAST(floor(0.2 * n + 0.5) AS BIGINT) AS tested FROM r), b AS (SELECT min(v) AS lo, max(v) AS hi FROM t WHERE tested),
k AS (SELECT id, row_number() OVER (ORDER BY least(abs(v - lo), abs(v - hi)), id) - 1 AS near FROM t, b WHERE NOT tested)
SELECT t.id, CASE WHEN tested THEN 'test' WHEN near < CAST(floor(0.1 * n + 0.5) AS BIGINT) THEN 'valid' ELSE 'train' END AS partition FROM t LEFT JOIN k USING (id)""")
def _(spark, sf):
    return prop.property_split(_t(spark, sf, "part"), "p_partkey", "p_retailprice", train=None, valid=0.1, test=0.2)


@query("label_extrapolation", """WITH r AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS v, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part),
c AS (SELECT v AS cut FROM r WHERE pos = n - CAST(floor(0.2 * n + 0.5) AS BIGINT)), b AS (SELECT min(v) AS lo, max(v) AS hi FROM r, c WHERE v >= cut)
SELECT id, CASE WHEN v >= cut THEN 'test' WHEN abs(v - lo) < 2.0 OR abs(v - hi) < 2.0 THEN 'discard' ELSE 'train' END AS partition FROM r, c, b""")
def _(spark, sf):
    return prop.label_extrapolation(_t(spark, sf, "part"), "p_partkey", "p_size", buffer=2.0)


@query("distinct_label", f"""SELECT p_partkey AS id, CASE WHEN row_number() OVER (PARTITION BY floor(p_retailprice / 10.0) ORDER BY {hash_key_sql(0, 'distinct_label.pick', 0, 'p_partkey')}, p_partkey) = 1 THEN 'train' ELSE 'test' END AS partition FROM part""")
def _(spark, sf):
    return prop.distinct_label(_t(spark, sf, "part"), "p_partkey", "p_retailprice", resolution=10.0)


@query("stratified_distribution", f"""WITH e AS (SELECT quantile_cont(o_totalprice, {[k / 20 for k in range(1, 20)]}) AS q, count(*) AS n FROM orders),
b AS (SELECT o_orderkey AS id, n, len(list_filter(q, lambda x: o_totalprice > x)) AS bin FROM orders, e),
p AS (SELECT id, n, row_number() OVER (PARTITION BY bin ORDER BY {hash_key_sql(0, 'stratdist.permutation', 0, 'id')}, id) - 1 AS pos, count(*) OVER (PARTITION BY bin) AS m FROM b)
SELECT id, CASE WHEN pos < round_even(m * ({N_TEST} / n), 0) THEN 'test' ELSE 'train' END AS partition FROM p""")
def _(spark, sf):
    return prop.stratified_distribution(_t(spark, sf, "orders"), "o_orderkey", "o_totalprice")


_TRIALS = f"""t AS (SELECT o_orderkey AS id, o_totalprice AS v, k, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY {hash_key_sql(0, 'stratdist.trial', 'k', 'o_orderkey')}, o_orderkey) - 1 AS pos FROM orders CROSS JOIN range(8) AS r(k)),
p AS (SELECT id, v, k, CASE WHEN pos < n - {N_TEST} THEN 'train' ELSE 'test' END AS partition FROM t)"""
_MOMENTS = "(SELECT k, round((abs(avg(v) FILTER (partition = 'test') - avg(v) FILTER (partition = 'train')) + abs(stddev_pop(v) FILTER (partition = 'test') - stddev_pop(v) FILTER (partition = 'train'))) / (SELECT stddev_pop(o_totalprice) FROM orders), 12) AS loss FROM p GROUP BY k)"
_KS = """(SELECT k, round(max(abs(x - y)), 12) AS loss FROM (SELECT k, sum(a) OVER w / sum(a) OVER (PARTITION BY k) AS x, sum(b) OVER w / sum(b) OVER (PARTITION BY k) AS y
  FROM (SELECT k, v, CAST(count(*) FILTER (partition = 'train') AS DOUBLE) AS a, CAST(count(*) FILTER (partition = 'test') AS DOUBLE) AS b FROM p GROUP BY k, v) WINDOW w AS (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING)) GROUP BY k)"""
for _method, _loss in (("moments", _MOMENTS), ("ks", _KS)):
    query(f"stratified_distribution_{_method}", f"WITH {_TRIALS} SELECT id, partition FROM p WHERE k = (SELECT k FROM {_loss} ORDER BY loss, k LIMIT 1)")(
        partial(lambda m, spark, sf: prop.stratified_distribution(_t(spark, sf, "orders"), "o_orderkey", "o_totalprice", method=m, n_trials=8), _method)
    )


# --- lineage --------------------------------------------------------------------------------


@query("temporal", f"""WITH r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
c AS (SELECT d AS cut FROM r WHERE pos = n - {N_TEST} - 1)
SELECT id, CASE WHEN d <= cut THEN 'train' WHEN d < cut + 30 THEN 'discard' ELSE 'test' END AS partition FROM r, c""")
def _(spark, sf):
    return lineage.temporal(_t(spark, sf, "orders"), "o_orderkey", "o_orderdate", embargo="1M")


@query("temporal_valid", """WITH r AS (SELECT event_id AS id, CAST(ts AS DATE) AS d, row_number() OVER (ORDER BY CAST(ts AS DATE), event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
c AS (SELECT d AS cut FROM r WHERE pos = n - CAST(floor(0.2 * n + 0.5) AS BIGINT) - 1),
t AS (SELECT id, n, d, d < cut AS tr, row_number() OVER (PARTITION BY d < cut ORDER BY d DESC, id) - 1 AS back FROM r, c)
SELECT id, CASE WHEN NOT tr THEN 'test' WHEN back < CAST(floor(0.1 * n + 0.5) AS BIGINT) THEN 'valid' ELSE 'train' END AS partition FROM t""")
def _(spark, sf):
    return lineage.temporal(_t(spark, sf, "events"), "event_id", "ts", tie_policy="test", train=None, valid=0.1, test=0.2)


for _mode, _since in (("rolling", "d >= s - 365"), ("expanding", "TRUE")):
    query(f"temporal_{_mode}", f"""WITH r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, max(CAST(o_orderdate AS DATE)) OVER () AS hi FROM orders),
w AS (SELECT id, d, CAST(k AS INTEGER) AS k, hi - CAST((3 - k) * 365 AS INTEGER) AS s, hi - CAST((2 - k) * 365 AS INTEGER) AS e FROM r CROSS JOIN range(3) AS x(k))
SELECT id, k AS "window", CASE WHEN d >= s AND (d < e OR (k = 2 AND d <= e)) THEN 'test' WHEN d < s AND {_since} THEN 'train' ELSE 'discard' END AS partition FROM w""")(
        partial(lambda m, spark, sf: lineage.temporal_windows(_t(spark, sf, "orders"), "o_orderkey", "o_orderdate", m, 3), _mode)
    )


@query("deposition_date", "SELECT o_orderkey AS id, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '2000-01-01' THEN 'train' ELSE 'test' END AS partition FROM orders")
def _(spark, sf):
    return lineage.deposition_date(_t(spark, sf, "orders"), "o_orderkey", "o_orderdate", "2000-01-01")


@query("deposition_date_pruned", """WITH p AS (SELECT doc_id AS id, text, CASE WHEN doc_id <= 400 THEN 'train' ELSE 'test' END AS partition FROM documents),
s AS (SELECT id, partition, unnest(list_distinct(string_split(text, ' '))) AS w FROM p), c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
i AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.w = y.w WHERE x.partition = 'train' AND y.partition = 'test' GROUP BY ALL),
gone AS (SELECT DISTINCT a AS id FROM i JOIN c p ON p.id = a JOIN c q ON q.id = b WHERE k * 10 >= 8 * (p.n + q.n - k))
SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN 'discard' ELSE partition END AS partition FROM p""")
def _(spark, sf):
    # A day for each document, in the order of the ids.
    docs = _documents(spark, sf).withColumn("day", F.date_add(F.lit("2000-01-01").cast("date"), F.col("doc_id").cast("int")))
    return lineage.deposition_date(docs, "doc_id", "day", "2001-02-04", token_edges(docs, "doc_id", "words", 8, 10))


@query("fidelity", f"""WITH c AS (SELECT *, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS l, count(*) OVER () AS n FROM orders),
s AS (SELECT l, count(*) AS m, max(n) AS n FROM c GROUP BY l), u AS (SELECT l, n, coalesce(sum(m) OVER (ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM s),
p AS (SELECT o_orderkey AS id, o_custkey AS k, CASE WHEN l = (SELECT max(l) FROM s) THEN 'train' WHEN before_ < floor(0.2 * n + 0.5) THEN 'test' ELSE 'train' END AS part FROM c JOIN u USING (l, n))
SELECT id, CASE WHEN part = 'train' AND k IN (SELECT k FROM p WHERE part = 'test') THEN 'discard' ELSE part END AS partition FROM p""")
def _(spark, sf):
    orders = _t(spark, sf, "orders").withColumn("level", F.substring("o_orderpriority", 1, 1))
    return lineage.fidelity_split(orders, "o_orderkey", "level", "o_custkey", ["5", "4", "3", "2", "1"])


@query("party", """SELECT c_custkey AS id, held_out, CASE WHEN c_mktsegment = held_out THEN 'test' ELSE 'train' END AS partition
FROM customer CROSS JOIN (SELECT DISTINCT c_mktsegment AS held_out FROM customer)""")
def _(spark, sf):
    return lineage.party_split(_t(spark, sf, "customer"), "c_custkey", "c_mktsegment")


@query("party_label_skew")
def _(spark, sf):
    return lineage.synthetic_parties(_t(spark, sf, "customer"), "c_custkey", 4, "c_mktsegment")


# --- pairs ----------------------------------------------------------------------------------

_PAIRS = "SELECT l_partkey * 100000 + l_suppkey AS id, l_partkey AS a, l_suppkey % 25 AS b FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"


def _pairs(spark, sf):
    line = _t(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return line.select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"), F.col("l_partkey").alias("a"), (F.col("l_suppkey") % 25).alias("b"))


for _name, _axis in (("cold_drug", "a % 300"), ("cold_target", "b")):
    query(_name, greedy_sql(f"SELECT id, {_axis} AS key FROM ({_PAIRS})"))(
        partial(lambda axis, spark, sf: assign_groups(_pairs(spark, sf), "id", F.expr(axis), check=False), _axis)
    )

_AXIS_TEST = "CAST(round_even(sqrt(CAST(floor(0.2 * n + 0.5) AS DOUBLE) / n) * n, 0) AS BIGINT)"
for _name, _how, _case in (
    ("cold_pair", "both_novel", "CASE WHEN x.partition = y.partition THEN x.partition ELSE 'discard' END"),
    ("complex_joint", "either_novel", "CASE WHEN x.partition = 'test' OR y.partition = 'test' THEN 'test' ELSE 'train' END"),
):
    query(_name, f"""SELECT x.id, {_case} AS partition FROM ({greedy_sql(f"SELECT id, a % 300 AS key FROM ({_PAIRS})", _AXIS_TEST)}) x
JOIN ({greedy_sql(f"SELECT id, b AS key FROM ({_PAIRS})", _AXIS_TEST)}) y ON x.id = y.id""")(
        partial(lambda how, spark, sf: pairs.assign_pairs(_pairs(spark, sf), "id", F.col("a") % 300, F.col("b"), how), _how)
    )


# --- whole entities ---------------------------------------------------------------------------

# The SQL twins above and of group_k_fold fold their keys by a modulo, so their queries do as well.
# These hold out the entities themselves; brute force is their check.


def _entity_pairs(spark, sf):
    line = _t(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return line.select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))


for _name, _axis in (("cold_drug_entities", "a"), ("cold_target_entities", "b")):
    query(_name)(partial(lambda axis, spark, sf: pairs.cold_entity(_entity_pairs(spark, sf), "id", axis, check=False), _axis))

for _name, _how in (("cold_pair_entities", "both_novel"), ("complex_joint_entities", "either_novel")):
    query(_name)(partial(lambda how, spark, sf: pairs.assign_pairs(_entity_pairs(spark, sf), "id", F.col("a"), F.col("b"), how), _how))


@query("group_assignment_entities")
def _(spark, sf):
    return assign_groups(_t(spark, sf, "orders"), "o_orderkey", F.col("o_custkey"), check=False)


@query("group_k_fold_entities")
def _(spark, sf):
    return protocol.group_k_fold(_t(spark, sf, "orders"), "o_orderkey", "o_custkey", 3)


# --- similarity -----------------------------------------------------------------------------

_VEC = "SELECT vec_id AS id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v, label AS y FROM embeddings"
_D2 = "list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_VEDGES = f"WITH v AS ({_VEC}) SELECT x.id AS a, y.id AS b, {_D2} AS d FROM v x JOIN v y ON x.id < y.id WHERE {_D2} <= {NEAR}"


def _vectors(spark, sf):
    return scaled_vectors(_t(spark, sf, "embeddings"), "vec_id", "embedding")


def _near(spark, sf):
    rows = _vectors(spark, sf)
    return rows, vector_edges(rows, NEAR)


@query("vector_edges", _VEDGES)
def _(spark, sf):
    return _near(spark, sf)[1]


def _mis_sql(order: str) -> str:
    """Greedy visit in an order; then each record's centre."""
    return f"""WITH RECURSIVE e AS ({_VEDGES}), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
n AS (SELECT vec_id AS id, coalesce(list(b), []) AS adj FROM embeddings LEFT JOIN both_ ON a = vec_id GROUP BY vec_id),
n2 AS (SELECT id, list_filter(adj, lambda x: x IS NOT NULL) AS adj FROM n),
o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM n2),
f(r, c) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT o.r, CASE WHEN list_has_any(o.adj, f.c) THEN f.c ELSE list_append(f.c, o.id) END FROM f JOIN o ON o.r = f.r + 1),
c AS (SELECT unnest(c) AS id FROM f WHERE r = (SELECT max(r) FROM o)), cr AS (SELECT c.id, r FROM c JOIN o USING (id)),
m AS (SELECT a AS id, arg_min(cr.id, cr.r) AS near FROM both_ JOIN cr ON cr.id = b GROUP BY a)
SELECT o.id, CASE WHEN o.id IN (SELECT id FROM c) THEN o.id ELSE m.near END AS key FROM o LEFT JOIN m USING (id)"""


@query("butina", _mis_sql("len(adj) DESC, id"))
def _(spark, sf):
    return sim.butina_keys(*_near(spark, sf))


@query("sphere_exclusion", _mis_sql(f"{hash_key_sql(0, 'sphere_exclusion.order', 0, 'id')}, id"))
def _(spark, sf):
    return sim.sphere_keys(*_near(spark, sf), seed=0)


@query("sphere_exclusion_by_id", _mis_sql("id"))
def _(spark, sf):
    return sim.sphere_keys(*_near(spark, sf))


@query("binding_site", _mis_sql("len(adj) DESC, id"))
def _(spark, sf):
    return sim.butina_keys(*_near(spark, sf))


_DBSCAN = f"""WITH RECURSIVE e AS ({_VEDGES}), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
core AS (SELECT a AS id FROM both_ GROUP BY a HAVING count(*) + 1 >= 5), ce AS (SELECT a, b FROM both_ WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(x, y) AS (SELECT id, id FROM core UNION SELECT r.x, b FROM reach r JOIN ce ON a = r.y), cc AS (SELECT x AS id, min(y) AS key FROM reach GROUP BY x),
bo AS (SELECT a AS id, min(cc.key) AS key FROM both_ JOIN cc ON cc.id = b GROUP BY a)
SELECT vec_id AS id, coalesce(cc.key, bo.key, -vec_id - 1) AS key, cc.key IS NULL AND bo.key IS NULL AS noise
FROM embeddings LEFT JOIN cc ON cc.id = vec_id LEFT JOIN bo ON bo.id = vec_id"""


@query("density_cluster", _DBSCAN)
def _(spark, sf):
    return sim.density_keys(*_near(spark, sf))


@query("leave_one_cluster_out", f"""WITH k AS ({_mis_sql('len(adj) DESC, id')}), g AS (SELECT key, count(*) AS s, min(id) AS f FROM k GROUP BY key),
t AS (SELECT key, row_number() OVER (ORDER BY s DESC, f) - 1 AS fold FROM g)
SELECT k.id, CAST(CASE WHEN fold < 50 THEN fold ELSE -1 END AS INTEGER) AS fold FROM k JOIN t USING (key)""")
def _(spark, sf):
    return sim.leave_one_cluster_out(sim.butina_keys(*_near(spark, sf)))


_TOTALS = f"v AS ({_VEC}), tot AS (SELECT x.id, any_value(x.y) AS y, sum({_D2}) AS total FROM v x CROSS JOIN v y GROUP BY x.id)"


def _classes(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"))


@query("minimal_test_set_dissimilarity", f"""WITH {_TOTALS}, b AS (SELECT *, ntile((SELECT CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) FROM embeddings)) OVER (ORDER BY y DESC, id) AS bin FROM tot)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY bin ORDER BY total, id) = 1 THEN 'test' ELSE 'train' END AS partition FROM b""")
def _(spark, sf):
    return sim.minimal_test_dissimilarity(_vectors(spark, sf), _classes(spark, sf), squared=True)  # as its SQL adds them


@query("minimal_test_set_distance")
def _(spark, sf):
    return sim.minimal_test_dissimilarity(_vectors(spark, sf), _classes(spark, sf))


@query("perimeter", f"""WITH {_TOTALS} SELECT id, CASE WHEN row_number() OVER (ORDER BY total DESC, id) <= (SELECT CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) FROM embeddings) THEN 'test' ELSE 'train' END AS partition FROM tot""")
def _(spark, sf):
    return sim.perimeter_outliers(_vectors(spark, sf), squared=True)  # as its SQL adds them


@query("perimeter_distance")
def _(spark, sf):
    return sim.perimeter_outliers(_vectors(spark, sf))


_SPLIT = f"SELECT id, CASE WHEN pos < n - {N_TEST} THEN 'train' ELSE 'test' END AS partition FROM (SELECT vec_id AS id, {_hashed('random.permutation', 0, 'embeddings', 'vec_id')} AS pos, count(*) OVER () AS n FROM embeddings)"
_NN = f"""v AS ({_VEC}), sp AS ({_SPLIT}), nn AS (SELECT x.id, min({_D2}) AS d FROM v x JOIN sp s ON s.id = x.id AND s.partition = 'test'
  CROSS JOIN (SELECT v.* FROM v JOIN sp USING (id) WHERE sp.partition = 'train') y GROUP BY x.id)"""


@query("applicability_domain", f"WITH {_NN} SELECT id, CAST(ntile(5) OVER (ORDER BY d, id) - 1 AS INTEGER) AS band FROM nn")
def _(spark, sf):
    return protocol.applicability_domain(_vectors(spark, sf), baseline.random_split(_t(spark, sf, "embeddings"), "vec_id"))


@query("applicability_splits", f"""WITH {_NN}, b AS (SELECT id, CAST(ntile(5) OVER (ORDER BY d, id) - 1 AS INTEGER) AS band FROM nn)
SELECT sp.id, CAST(k AS INTEGER) AS band, CASE WHEN partition = 'train' THEN 'train' WHEN b.band = k THEN 'test' ELSE 'discard' END AS partition
FROM sp CROSS JOIN range(5) AS r(k) LEFT JOIN b ON b.id = sp.id""")
def _(spark, sf):
    return protocol.applicability_splits(_vectors(spark, sf), baseline.random_split(_t(spark, sf, "embeddings"), "vec_id"))


#: All distances as rows of a matrix, records in the order of their ids.
_MATRIX = f"""v AS ({_VEC}), o AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM v),
pairs AS MATERIALIZED (SELECT p.rn AS i, q.rn AS j, x.y AS yi, y.y AS yj, {_D2} AS d FROM v x JOIN o p ON p.id = x.id CROSS JOIN v y JOIN o q ON q.id = y.id),
mt AS MATERIALIZED (SELECT i, list(d ORDER BY j) AS r FROM pairs GROUP BY i), k AS (SELECT count(*) AS n, {N_TEST.replace('n)', 'count(*))').replace('* n', '* count(*)')} AS te FROM v)"""
_LOWER = "list_transform(list_zip({a}, {b}), lambda x: least(x[1], x[2]))"


def _farthest_first_sql(matrix: str, rows: str, picks: str, picked: str, rest: str) -> str:
    """From the farthest pair, always the record that is farthest from those picked, the first of equals."""
    mark = lambda near, at: f"list_transform({near}, lambda x, i: CASE WHEN list_contains({at}, i) THEN -1.0 ELSE x END)"
    return f"""WITH RECURSIVE {matrix}, s AS (SELECT arg_min(i, (-d, i, j)) AS a, arg_min(j, (-d, i, j)) AS b FROM {rows}_pairs),
f(c, taken, near) AS (
  SELECT 2, [a, b], {mark(_LOWER.format(a='x.r', b='y.r'), '[a, b]')} FROM s JOIN {rows} x ON x.i = a JOIN {rows} y ON y.i = b
  UNION ALL
  SELECT c + 1, list_append(taken, p), {mark(_LOWER.format(a='near', b='m.r'), '[p]')} FROM (SELECT *, list_position(near, list_max(near)) AS p FROM f) g JOIN {rows} m ON m.i = p WHERE c < (SELECT {picks} FROM k)
), z AS (SELECT unnest(taken) AS rn FROM f WHERE c = (SELECT max(c) FROM f))
SELECT id, CASE WHEN rn IN (SELECT rn FROM z) THEN '{picked}' ELSE '{rest}' END AS partition FROM o"""


_XY = f"""{_MATRIX}, top AS (SELECT max(sqrt(d)) AS dx, max(abs(yi - yj)) AS dy FROM pairs),
xy_pairs AS MATERIALIZED (SELECT i, j, sqrt(d) / (CASE WHEN dx > 0 THEN dx ELSE 1 END) + abs(yi - yj) / (CASE WHEN dy > 0 THEN CAST(dy AS DOUBLE) ELSE 1 END) AS d FROM pairs, top),
xy AS MATERIALIZED (SELECT i, list(d ORDER BY j) AS r FROM xy_pairs GROUP BY i)"""


@query("max_min", _farthest_first_sql(f"{_MATRIX}, mt_pairs AS (SELECT i, j, d FROM pairs)", "mt", "n - te", "train", "test"))
def _(spark, sf):
    return sim.max_min(_vectors(spark, sf), init="kennard_stone")


@query("spxy", _farthest_first_sql(_XY, "xy", "n - te", "train", "test"))
def _(spark, sf):
    y = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y"))
    return sim.spxy(_vectors(spark, sf).join(y, "id"))


@query("duplex")
def _(spark, sf):
    return sim.duplex(_vectors(spark, sf))


@query("max_dissimilarity", f"""WITH {_MATRIX}, s AS (SELECT arg_min(i, (-d, i, j)) AS a, arg_min(j, (-d, i, j)) AS b FROM pairs WHERE i < j),
w AS (SELECT j AS rn, row_number() OVER (ORDER BY j <> b, d, j) AS nth FROM pairs, s WHERE i = b AND j <> a)
SELECT id, CASE WHEN coalesce(nth <= te, FALSE) THEN 'test' ELSE 'train' END AS partition FROM k, o LEFT JOIN w USING (rn)""")
def _(spark, sf):
    return sim.max_dissimilarity(_vectors(spark, sf))


@query("perimeter_pairs", f"""WITH RECURSIVE {_MATRIX}, f(gone) AS (
  SELECT CAST([] AS BIGINT[]) UNION ALL
  SELECT list_concat(gone, (SELECT arg_min([i, j], (-d, i, j)) FROM pairs WHERE i <> j AND NOT list_contains(gone, i) AND NOT list_contains(gone, j))) FROM f WHERE len(gone) < (SELECT te FROM k)
), z AS (SELECT unnest(gone[1:CAST((SELECT te FROM k) AS BIGINT)]) AS rn FROM f WHERE len(gone) = (SELECT max(len(gone)) FROM f))
SELECT id, CASE WHEN rn IN (SELECT rn FROM z) THEN 'test' ELSE 'train' END AS partition FROM o""")
def _(spark, sf):
    return sim.perimeter_pairs(_vectors(spark, sf))


@query("seeded_growth", f"""WITH RECURSIVE {_MATRIX}, s AS (SELECT arg_min(i, (-t, i)) AS a FROM (SELECT i, sum(d) AS t FROM pairs GROUP BY i)),
f(c, taken, near) AS (
  SELECT 1, [a], r FROM s JOIN mt ON i = a
  UNION ALL
  SELECT c + 1, list_append(taken, p), {_LOWER.format(a='near', b='m.r')} FROM (SELECT *, list_position(hid, list_min(hid)) AS p FROM (SELECT *, list_transform(near, lambda x, i: CASE WHEN list_contains(taken, i) THEN 1e300 ELSE x END) AS hid FROM f)) g
  JOIN mt m ON m.i = p WHERE c < (SELECT te FROM k)
), z AS (SELECT taken, near FROM f WHERE c = (SELECT max(c) FROM f))
SELECT id, CASE WHEN list_contains(taken, rn) THEN 'test' WHEN near[rn] > {NEAR} THEN 'train' ELSE 'discard' END AS partition FROM o, z""")
def _(spark, sf):
    return sim.seeded_growth(_vectors(spark, sf), NEAR)


@query("greedy_prune", f"""WITH e AS ({_VEDGES}), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), sp AS ({_SPLIT}),
gone AS (SELECT DISTINCT a AS id FROM both_ JOIN sp x ON x.id = a JOIN sp y ON y.id = b WHERE x.partition = 'test' AND y.partition = 'train')
SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN 'discard' ELSE partition END AS partition FROM sp""")
def _(spark, sf):
    return sim.greedy_prune(baseline.random_split(_t(spark, sf, "embeddings"), "vec_id"), _near(spark, sf)[1])


@query("butina_shared_singletons", f"""WITH k AS ({_mis_sql('len(adj) DESC, id')}), s AS (SELECT key FROM k GROUP BY key HAVING count(*) = 1)
SELECT id, CASE WHEN key IN (SELECT key FROM s) THEN (SELECT min(key) FROM s) ELSE key END AS key FROM k""")
def _(spark, sf):
    return sim.regroup_singletons(sim.butina_keys(*_near(spark, sf)), "shared_group")


@query("butina_nearest_cluster", f"""WITH k AS ({_mis_sql('len(adj) DESC, id')}), s AS (SELECT key, count(*) AS c FROM k GROUP BY key), v AS ({_VEC}),
nn AS (SELECT x.id, arg_min(y.id, ({_D2}, y.id)) AS nn FROM v x JOIN s sx ON sx.key = x.id AND sx.c = 1 CROSS JOIN (SELECT v.* FROM v JOIN s ON s.key = v.id WHERE s.c > 1) y GROUP BY x.id)
SELECT k.id, coalesce(nn.nn, k.key) AS key FROM k LEFT JOIN nn USING (id)""")
def _(spark, sf):
    return sim.regroup_singletons(sim.butina_keys(*_near(spark, sf)), "nearest_cluster", _vectors(spark, sf))


@query("density_noise_to_test", f"""WITH k AS ({_DBSCAN}), p AS ({greedy_sql(f"SELECT id, key FROM ({_DBSCAN}) WHERE NOT noise")})
SELECT id, partition, "group" FROM p UNION ALL SELECT id, 'test', NULL FROM k WHERE noise""")
def _(spark, sf):
    return sim.density_split(sim.density_keys(*_near(spark, sf)), "test")


@query("merged_groups", components_sql(
    "WITH k AS (SELECT p_partkey AS id, unnest([concat('n', p_name), concat('r', CAST(p_retailprice AS VARCHAR))]) AS k FROM part) SELECT x.id AS a, m.b FROM k x JOIN (SELECT k, min(id) AS b FROM k GROUP BY k) m USING (k) WHERE x.id <> m.b",
    "SELECT p_partkey AS id FROM part"))
def _(spark, sf):
    part = _t(spark, sf, "part")
    key = lambda c: part.select(F.col("p_partkey").alias("id"), F.col(c).alias("key"))
    return sim.merged_keys(key("p_name"), key("p_retailprice"))


# --- protocol -------------------------------------------------------------------------------


@query("group_k_fold", """WITH RECURSIVE g AS (SELECT o_custkey % 211 AS key, count(*) AS size, min(o_orderkey) AS f FROM orders GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, f) AS r, row_number() OVER (ORDER BY f) - 1 AS grp FROM g),
s(r, c0, c1, c2, fold) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), -1 UNION ALL
  SELECT o.r, CASE WHEN k = 0 THEN c0 + size ELSE c0 END, CASE WHEN k = 1 THEN c1 + size ELSE c1 END, CASE WHEN k = 2 THEN c2 + size ELSE c2 END, k
  FROM (SELECT *, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS k FROM s) s JOIN o ON o.r = s.r + 1)
SELECT o_orderkey AS id, CAST(s.fold AS INTEGER) AS fold, CAST(o.grp AS BIGINT) AS "group" FROM orders JOIN o ON o.key = o_custkey % 211 JOIN s ON s.r = o.r""")
def _(spark, sf):
    return protocol.group_k_fold(_t(spark, sf, "orders").withColumn("key", F.col("o_custkey") % 211), "o_orderkey", "key", 3)


_RAND = f"SELECT id, CASE WHEN pos < n - {N_TEST} THEN 'train' ELSE 'test' END AS partition FROM (SELECT id, {_hashed('random.permutation', 0, 'x', 'id')} AS pos, count(*) OVER () AS n FROM ({{}}))"


@query("three_way", f"""WITH a AS ({_RAND.format('SELECT o_orderkey AS id FROM orders')}), b AS ({_RAND.format("SELECT id FROM a WHERE partition = 'train'")})
SELECT a.id, CASE WHEN b.partition = 'test' THEN 'valid' ELSE coalesce(b.partition, a.partition) END AS partition FROM a LEFT JOIN b USING (id)""")
def _(spark, sf):
    split = lambda df: baseline.random_split(df, "o_orderkey")
    return protocol.three_way(_t(spark, sf, "orders"), "o_orderkey", split, split)


@query("repeated", f"""SELECT id, CAST(k AS INTEGER) AS repeat, CASE WHEN pos < n - {N_TEST} THEN 'train' ELSE 'test' END AS partition FROM (
  SELECT o_orderkey AS id, k, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws(':', CAST(k AS VARCHAR), 'random.permutation', '0', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS pos,
         count(*) OVER (PARTITION BY k) AS n FROM orders CROSS JOIN range(3) AS r(k))""")
def _(spark, sf):
    return protocol.repeated(_t(spark, sf, "orders"), lambda df, s: baseline.random_split(df, "o_orderkey", s), 3)


_FOLD = f"CAST(ntile(3) OVER (ORDER BY {hash_key_sql(0, 'kfold.permutation', 0, 'id')}, id) - 1 AS INTEGER)"


@query("nested_cv", f"""WITH o AS (SELECT id, {_FOLD} AS f FROM (SELECT c_custkey AS id FROM customer)),
i AS (SELECT k, id, CAST(ntile(3) OVER (PARTITION BY k ORDER BY {hash_key_sql(0, 'kfold.permutation', 0, 'id')}, id) - 1 AS INTEGER) AS g FROM o CROSS JOIN range(3) AS r(k) WHERE f <> k)
SELECT id, CAST(k AS INTEGER) AS outer_fold, CAST(j AS INTEGER) AS inner_fold, CASE WHEN g = j THEN 'valid' ELSE 'train' END AS partition FROM i CROSS JOIN range(3) AS q(j)
UNION ALL SELECT id, CAST(f AS INTEGER), CAST(j AS INTEGER), 'test' FROM o CROSS JOIN range(3) AS q(j)""")
def _(spark, sf):
    customer = _t(spark, sf, "customer")
    fold = lambda df, k=0: baseline.k_fold(df, "c_custkey", 3)
    return protocol.nested_cv(customer, "c_custkey", 3, fold(customer), fold)


@query("external_holdout", """SELECT doc_id AS id, 'internal' AS origin, 'train' AS partition FROM documents UNION ALL SELECT item_id, 'external', 'test' FROM benchmark""")
def _(spark, sf):
    return protocol.external_holdout(_t(spark, sf, "documents"), "doc_id", _t(spark, sf, "benchmark"), "item_id")


@query("intersection", f"""WITH a AS ({_RAND.format('SELECT o_orderkey AS id FROM orders')}), m AS (SELECT a.*, o_custkey AS k FROM a JOIN orders ON o_orderkey = id)
SELECT id, CASE WHEN partition = 'train' AND k IN (SELECT k FROM m WHERE partition = 'test') THEN 'discard' ELSE partition END AS partition FROM m""")
def _(spark, sf):
    orders = _t(spark, sf, "orders")
    return protocol.intersection(baseline.random_split(orders, "o_orderkey"), protocol.labels_of(orders, "o_orderkey", "o_custkey"))


# --- audit and preprocessing ----------------------------------------------------------------

_OS = f"sp AS ({_RAND.format('SELECT o_orderkey AS id FROM orders')})"


def _order_split(spark, sf):
    orders = _t(spark, sf, "orders")
    return orders, baseline.random_split(orders, "o_orderkey")


@query("audit_nn_profile", f"WITH {_NN} SELECT " + ", ".join(f"quantile_cont(d, {q}) AS q{round(100 * q):03d}" for q in audit.QUANTILES) + ", avg(d) AS mean, count(*) AS n FROM nn")
def _(spark, sf):
    return audit.nn_profile(_vectors(spark, sf), baseline.random_split(_t(spark, sf, "embeddings"), "vec_id"))


@query("audit_duplicates", f"""WITH sp AS ({_RAND.format('SELECT doc_id AS id FROM documents')}), r AS (SELECT sp.*, text FROM sp JOIN documents ON doc_id = id)
SELECT t.id AS test_id, f.train_id FROM r t JOIN (SELECT text, min(id) AS train_id FROM r WHERE partition = 'train' GROUP BY text) f USING (text) WHERE t.partition = 'test'""")
def _(spark, sf):
    docs = _t(spark, sf, "documents")
    return audit.duplicates_across(docs, "doc_id", "text", baseline.random_split(docs, "doc_id"))


@query("audit_shared_groups", f"""WITH {_OS}, r AS (SELECT partition, o_custkey AS k FROM sp JOIN orders ON o_orderkey = id), g AS (SELECT k, max(CAST(partition = 'train' AS INT)) AS a, max(CAST(partition = 'test' AS INT)) AS b FROM r GROUP BY k)
SELECT CAST(sum(a) AS BIGINT) AS n_train, CAST(sum(b) AS BIGINT) AS n_test, CAST(sum(a * b) AS BIGINT) AS n_shared FROM g""")
def _(spark, sf):
    orders, split = _order_split(spark, sf)
    return audit.shared_groups(orders, "o_orderkey", "o_custkey", split)


@query("audit_label_shift", f"""WITH {_OS} SELECT partition, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std,
  round((avg(o_totalprice ^ 3) - 3 * avg(o_totalprice) * avg(o_totalprice ^ 2) + 2 * avg(o_totalprice) ^ 3) / stddev_pop(o_totalprice) ^ 3, 4) AS skew FROM sp JOIN orders ON o_orderkey = id GROUP BY partition""")
def _(spark, sf):
    orders, split = _order_split(spark, sf)
    out = audit.label_shift(orders, "o_orderkey", "o_totalprice", split)
    return out.select("partition", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "skew")])


@query("audit_property_shift", f"""WITH {_OS}, r AS (SELECT partition, o_totalprice AS y FROM sp JOIN orders ON o_orderkey = id), s AS (SELECT partition AS p, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM r GROUP BY partition)
SELECT round((b.m - a.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohens_d FROM s a, s b WHERE a.p = 'train' AND b.p = 'test'""")
def _(spark, sf):
    orders, split = _order_split(spark, sf)
    return audit.property_shift(orders, "o_orderkey", "o_totalprice", split).select(F.round("cohens_d", 6).alias("cohens_d"))


@query("audit_ks", f"""WITH {_OS}, r AS (SELECT partition, o_totalprice AS y FROM sp JOIN orders ON o_orderkey = id), g AS (SELECT y, count(*) FILTER (partition = 'train') AS a, count(*) FILTER (partition = 'test') AS b FROM r GROUP BY y)
SELECT round(max(gap), 9) AS ks FROM (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS gap FROM g WINDOW w AS (ORDER BY y ROWS UNBOUNDED PRECEDING))""")
def _(spark, sf):
    orders, split = _order_split(spark, sf)
    return audit.ks_statistic(orders, "o_orderkey", "o_totalprice", split).select(F.round("ks", 9).alias("ks"))


@query("find_duplicates", "SELECT text AS key, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark, sf):
    return audit.find_duplicates(_t(spark, sf, "documents"), "doc_id", "text")


@query("aggregate_replicates", """SELECT l_partkey AS key, min(l_orderkey) AS first, round(median(l_quantity), 6) AS value, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING max(l_quantity) - min(l_quantity) <= 45""")
def _(spark, sf):
    out = audit.aggregate_replicates(_t(spark, sf, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", max_spread=45.0)
    return out.withColumn("value", F.round("value", 6))


# --- tasks, embeddings ----------------------------------------------------------------------

from sunder.operators import embedding as emb, task  # noqa: E402


#: Squared distances below which vectors are one coarse cluster, or too similar to be apart.
COARSE, APART = 1_300_000.0, 1_400_000.0


def _hi_sql() -> str:
    edges = lambda cut: _VEDGES.replace(str(NEAR), str(cut))
    clusters = _mis_sql("len(adj) DESC, id").replace(_VEDGES, edges(COARSE))
    across = f"WITH c AS ({clusters}), e AS ({edges(APART)}) SELECT x.key AS a, y.key AS b FROM e JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE x.key <> y.key"
    merged = components_sql(across, f"SELECT DISTINCT key AS id FROM ({clusters})")
    return greedy_sql(f"SELECT c.id, m.key FROM ({clusters}) c JOIN ({merged}) m ON m.id = c.key")


@query("hi", _hi_sql())
def _(spark, sf):
    rows = _vectors(spark, sf)
    # The SQL places one component that spans all records in train.
    return task.hi(rows, vector_edges(rows, APART), vector_edges(rows, COARSE), empty="keep")


@query("hi_search")
def _(spark, sf):
    rows = _vectors(spark, sf)
    return task.hi(rows, vector_edges(rows, APART), vector_edges(rows, COARSE), "search", empty="keep")


def _labels(spark, sf, cut: int | None = None):
    y = F.col("label").cast("double")
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), y.alias("y"), (y < (cut or 5)).cast("int").alias("active"))


@query("lo")
def _(spark, sf):
    rows, edges = _near(spark, sf)
    return task.lo(_labels(spark, sf).select("id", "y"), edges, std_threshold=0.1)


@query("scaffold_hop")
def _(spark, sf):
    rows = _vectors(spark, sf)
    part = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 37).alias("scaffold"), F.lit(True).alias("active"))
    return task.scaffold_hop(part, vectors=rows, cutoff=4 * NEAR)


def _area(c: str) -> str:
    curve = f"list_transform(range(101), lambda k: coalesce(len(list_filter({c}, lambda s: s >= k / 100.0 - 1e-6)) / nullif(len({c}), 0), 0.0))"
    return f"(list_sum(list_transform(range(1, 101), lambda k: (({curve})[k] + ({curve})[k + 1]) / 2)) / 100)"


_AVE = f"""WITH v AS ({_VEC}), sp AS ({_SPLIT}), r AS (SELECT v.id, v.v, CAST(y < 5 AS INT) AS active, sp.partition AS p FROM v JOIN sp USING (id)),
nn AS (SELECT x.id, x.active AS c, y.active AS e, 1 / (1 + sqrt(min({_D2})) / 1024) AS s FROM r x JOIN r y ON x.p = 'test' AND y.p = 'train' GROUP BY x.id, x.active, y.active),
l AS (SELECT coalesce(list(s) FILTER (c = 1 AND e = 1), []) AS aa, coalesce(list(s) FILTER (c = 1 AND e = 0), []) AS ai, coalesce(list(s) FILTER (c = 0 AND e = 0), []) AS ii, coalesce(list(s) FILTER (c = 0 AND e = 1), []) AS ia FROM nn),
k AS (SELECT {', '.join(f'{_area(c)} AS {c}' for c in ('aa', 'ai', 'ii', 'ia'))} FROM l)
SELECT round(aa, 9) AS aa, round(ai, 9) AS ai, round(ii, 9) AS ii, round(ia, 9) AS ia, round(aa - ai + ii - ia, 9) AS bias FROM k"""


@query("ave_bias", _AVE)
def _(spark, sf):
    out = task.ave_bias(_vectors(spark, sf), _labels(spark, sf).select("id", "active"), baseline.random_split(_t(spark, sf, "embeddings"), "vec_id"))
    return out.select(*[F.round(c, 9).alias(c) for c in ("aa", "ai", "ii", "ia", "bias")])


@query("ave")
def _(spark, sf):
    return task.ave_split(_vectors(spark, sf), _labels(spark, sf).select("id", "active"))


@query("simpd")
def _(spark, sf):
    rows, edges = _near(spark, sf)
    return task.time_like(rows, _labels(spark, sf).select("id", "y"), clusters=sim.butina_keys(rows, edges))


@query("decoy_benchmark", greedy_sql("""WITH b AS (SELECT min(c_acctbal) AS lx, max(c_acctbal) AS hx, min(c_nationkey) AS ly, max(c_nationkey) AS hy FROM customer)
SELECT c_custkey AS id, least(9, floor((c_acctbal - lx) / ((hx - lx) / 10))) * 10 + least(9, floor((c_nationkey - ly) / ((hy - ly) / 10))) AS key FROM customer, b"""))
def _(spark, sf):
    return task.decoy_cells(_t(spark, sf, "customer"), "c_custkey", F.col("c_acctbal"), F.col("c_nationkey"))


@query("decoy_matched")
def _(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return task.matched_decoys(part.where("p_brand = 'Brand#11'"), part.where("p_brand <> 'Brand#11'"), {"price": 50.0, "size": 3.0})


@query("stratified_iterative")
def _(spark, sf):
    return task.stratified_multilabel(_t(spark, sf, "labels"), "doc_id", ["quality", "toxic"])


@query("balanced_multi_task")
def _(spark, sf):
    rows, edges = _near(spark, sf)
    tasks = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("t0"), F.when(F.col("vec_id") % 3 == 0, F.col("label") % 3 == 0).cast("int").alias("t1"))
    return task.balanced_multi_task(sim.butina_keys(rows, edges), tasks, ["t0", "t1"])


@query("sequence_identity", greedy_sql(components_sql("""WITH s AS (SELECT p_partkey AS id, p_name AS s FROM part)
SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.id < y.id
WHERE 10 * len(list_filter(range(1, CAST(least(length(x.s), length(y.s)) AS BIGINT) + 1), lambda k: x.s[k] = y.s[k])) > 9 * least(length(x.s), length(y.s))""", "SELECT p_partkey AS id FROM part")))
def _(spark, sf):
    part = _t(spark, sf, "part")
    edges = task.sequence_edges(part, "p_partkey", "p_name", 9, 10)
    return sim.component_split(part.select(F.col("p_partkey").alias("id")), edges, check=False)


@query("sequence_identity_7")
def _(spark, sf):
    """At the operator's 7/10; the SQL of ``sequence_identity`` states 9/10."""
    part = _t(spark, sf, "part")
    return sim.component_split(part.select(F.col("p_partkey").alias("id")), task.sequence_edges(part, "p_partkey", "p_name"), check=False)


for _name, _f in (
    ("k_means_cluster", lambda v: emb.k_means_keys(v)),
    ("latent_space", lambda v: emb.latent_space(v)),
    ("projection_axis", lambda v: emb.projection(v)),
    ("projection_grid", lambda v: emb.projection(v, "grid")),
    ("projection_cluster", lambda v: emb.projection(v, "cluster")),
    ("self_organizing_map", lambda v: emb.som_keys(v)),
    ("spectral", lambda v: emb.spectral_keys(v)),
    ("umap_cluster", lambda v: emb.umap_keys(v)),
    ("opti_sim", lambda v: emb.opti_sim(v, NEAR, 40)),
    ("d_optimal", lambda v: emb.d_optimal(v)),
):
    query(_name)(partial(lambda f, spark, sf: f(_vectors(spark, sf)), _f))


@query("support_points")
def _(spark, sf):
    return emb.support_points(_vectors(spark, sf), _labels(spark, sf).select("id", "y"))


@query("mood")
def _(spark, sf):
    rows = _vectors(spark, sf)
    candidates = {"random": lambda v: baseline.random_split(v, "id"), "perimeter": lambda v: sim.perimeter_outliers(v)}
    # The deployment set: the records of one label.
    deployed = rows.join(_t(spark, sf, "embeddings").where("label = 0").select(F.col("vec_id").alias("id")), "id", "left_semi")
    return emb.mood(rows, deployed, candidates)[2]


@query("adversarial")
def _(spark, sf):
    rows = _vectors(spark, sf)
    return emb.adversarial(rows, baseline.random_split(rows, "id"))


@query("audit_report")
def _(spark, sf):
    rows, table = _vectors(spark, sf), _t(spark, sf, "embeddings")
    records = table.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), F.col("label").alias("scaffold"), F.to_json("embedding").alias("key"))
    report = audit.audit_split(
        rows, baseline.random_split(rows, "id"), records, key="key", scaffold="scaffold", label="label", properties=("label",), auc=lambda v, s: emb.adversarial_auc(v, s)[0]
    )
    # One row per figure.
    found = [(k, None if v is None else float(v)) for k, v in report.items() if k != "flags"] + [(f"flag {k}", 1.0) for k in report["flags"]]
    return spark.createDataFrame(found, "metric string, value double")


@query("mahalanobis_vectors")
def _(spark, sf):
    return emb.whitened(_vectors(spark, sf))
