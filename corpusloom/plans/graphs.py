"""Graph queries over customers, orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import graph as gr
from corpusloom.plans.registry import query
from corpusloom.sources.entities import table

# nodes: regions, nations, customers, suppliers; edges from each to where it belongs, and customers to the suppliers' nations' first customer
_G = """nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier),
edges AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'IN' AS relation FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey, 'CALLS' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'INHERITS' FROM supplier UNION ALL
  SELECT 'c' || c_custkey, 'c' || (c_custkey + 7), 'CALLS' FROM customer WHERE c_custkey % 5 = 0)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def t(name: str, prefix: str, key: str, label: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"))

    def e(name: str, source: F.Column, target: F.Column, relation: str, where: str = "true") -> DataFrame:
        return table(spark, d, name).filter(where).select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"))

    at = lambda prefix, c: F.concat(F.lit(prefix), F.expr(c).cast("string"))
    nodes = t("region", "r", "r_regionkey", "region").unionByName(t("nation", "n", "n_nationkey", "nation"))
    nodes = nodes.unionByName(t("customer", "c", "c_custkey", "customer")).unionByName(t("supplier", "s", "s_suppkey", "supplier"))
    edges = e("nation", at("n", "n_nationkey"), at("r", "n_regionkey"), "IN")
    edges = edges.unionByName(e("customer", at("c", "c_custkey"), at("n", "c_nationkey"), "CALLS", "c_custkey % 3 = 0"))
    edges = edges.unionByName(e("supplier", at("s", "s_suppkey"), at("n", "s_nationkey"), "INHERITS"))
    return nodes, edges.unionByName(e("customer", at("c", "c_custkey"), at("c", "c_custkey + 7"), "CALLS", "c_custkey % 5 = 0"))


_SEEDS = "s AS (SELECT id FROM nodes WHERE id IN ('s1', 'c10', 'c25'))"
_BFS = """u AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
w AS (SELECT id, 0 AS depth FROM s UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.id WHERE w.depth < {0}),
m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"""


def _seeds(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("id").isin("s1", "c10", "c25")).select("id")


@query("bfs_depth3", f"WITH RECURSIVE {_G}, {_SEEDS}, {_BFS.format(3)} SELECT id, depth FROM m")
def bfs_depth3(spark: SparkSession, d: str) -> DataFrame:  # G1, J10, U2
    nodes, edges = _graph(spark, d)
    return gr.within(edges, _seeds(nodes), 3)


@query(
    "simple_paths",
    f"""WITH RECURSIVE {_G}, {_SEEDS}, n AS (SELECT id, label || ' ' || id AS name FROM nodes),
p AS (SELECT s.id AS start, s.id AS last, [s.id] AS seen, n.name AS path, 0 AS hops FROM s JOIN n USING (id) UNION ALL
  SELECT p.start, e.target, list_append(p.seen, e.target), p.path || ' -[' || e.relation || ']-> ' || n.name, p.hops + 1 FROM p JOIN edges e ON e.source = p.last JOIN n ON n.id = e.target
  WHERE p.hops < 3 AND NOT list_contains(p.seen, e.target))
SELECT start, hops, path FROM p WHERE hops > 0""",
)
def simple_paths(spark: SparkSession, d: str) -> DataFrame:  # G2, U3
    nodes, edges = _graph(spark, d)
    return gr.simple_paths(edges, nodes, _seeds(nodes), 3)


@query(
    "neighbourhood",
    f"""WITH RECURSIVE {_G}, {_SEEDS}, {_BFS.format(2)} SELECT DISTINCT source, target, relation FROM edges WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m)""",
)
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:  # G3, G4, J11
    nodes, edges = _graph(spark, d)
    return gr.neighbourhood(edges, _seeds(nodes), 2)


_PEND = """pe AS (SELECT 'c' || c_custkey AS source, CASE WHEN c_custkey % 4 = 0 THEN 'PENDING::' || c_name WHEN c_custkey % 4 = 1 THEN 'PENDING::nobody' || c_custkey ELSE 'n' || c_nationkey END AS target, 'CALLS' AS relation FROM customer),
pn AS (SELECT 'c' || c_custkey AS id, c_name AS label FROM customer)"""


@query(
    "pending_edges",
    f"""WITH {_PEND}, l AS (SELECT label, min(id) AS id FROM pn GROUP BY label)
SELECT DISTINCT pe.source, coalesce(l.id, pe.target) AS target, pe.relation FROM pe LEFT JOIN l ON pe.target = 'PENDING::' || l.label WHERE NOT starts_with(pe.target, 'PENDING::') OR l.id IS NOT NULL""",
)
def pending_edges(spark: SparkSession, d: str) -> DataFrame:  # G7, J8
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    target = F.when(key % 4 == 0, F.concat(F.lit(gr.PENDING), "c_name")).when(key % 4 == 1, F.concat(F.lit(gr.PENDING + "nobody"), key.cast("string"))).otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    name = F.concat(F.lit("c"), key.cast("string"))
    edges = c.select(name.alias("source"), target.alias("target"), F.lit("CALLS").alias("relation"))
    return gr.resolve_pending(edges, c.select(name.alias("id"), F.col("c_name").alias("label")))


@query(
    "edge_cascade",
    f"""WITH {_G}, gone AS (SELECT id, label FROM nodes WHERE id IN ('n3', 'n5', 'r1', 'c17', 'c20'))
SELECT e.source, CASE WHEN g.id IS NULL THEN e.target ELSE 'PENDING::' || g.label END AS target, e.relation FROM edges e LEFT JOIN gone g ON g.id = e.target
WHERE e.source NOT IN (SELECT id FROM gone) AND (g.id IS NULL OR e.relation IN ('CALLS', 'INHERITS'))""",
)
def edge_cascade(spark: SparkSession, d: str) -> DataFrame:  # G8
    nodes, edges = _graph(spark, d)
    return gr.drop_nodes(edges, nodes.filter(F.col("id").isin("n3", "n5", "r1", "c17", "c20")))


@query(
    "graph_plan",
    f"""WITH RECURSIVE {_G}, sc AS (SELECT 's1' AS id, 9.5 AS score UNION ALL SELECT 'c10', 7.25 UNION ALL SELECT 'c25', 6.1), s AS (SELECT id FROM sc), {_BFS.format(2)}
SELECT id, score FROM (SELECT id, CAST(score AS DOUBLE) AS score, 0 AS depth FROM sc UNION ALL SELECT id, round((SELECT min(score) FROM sc) * 0.5, 4), depth FROM m WHERE depth > 0) ORDER BY score DESC, depth, id LIMIT 20""",
)
def graph_plan(spark: SparkSession, d: str) -> DataFrame:  # G9
    _, edges = _graph(spark, d)
    seeds = spark.createDataFrame([("s1", 9.5), ("c10", 7.25), ("c25", 6.1)], "id string, score double")
    return gr.expand_seeds(seeds, edges, 2, 20)


@query(
    "code_graph",
    """WITH l AS (SELECT doc_id AS id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), ' +'), lambda x: length(x) > 3) AS w FROM documents),
n AS (SELECT id, 'w_' || coalesce(w[1], 'none') AS a, 'w_' || coalesce(w[2], 'none') AS b, 'w_' || coalesce(w[3], 'none') AS c, 'w_' || coalesce(w[4], 'none') AS d FROM l)
SELECT id AS file_id, unnest(CASE WHEN id % 2 = 0 THEN [
  {'kind': 'class', 'source': a, 'target': '', 'line': 1}, {'kind': 'INHERITS', 'source': a, 'target': 'PENDING::' || b, 'line': 1}, {'kind': 'function', 'source': a || '.' || c, 'target': '', 'line': 2},
  {'kind': 'CONTAINS', 'source': a, 'target': a || '.' || c, 'line': 2}, {'kind': 'CALLS', 'source': a || '.' || c, 'target': 'PENDING::' || d, 'line': 3}, {'kind': 'function', 'source': d, 'target': '', 'line': 5}]
ELSE [{'kind': 'function', 'source': a, 'target': '', 'line': 2}, {'kind': 'class', 'source': b, 'target': '', 'line': 3}] END, recursive := true) FROM n""",
)
def code_graph(spark: SparkSession, d: str) -> DataFrame:  # G5, G6: programs made of each document's words
    docs = table(spark, d, "documents")
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]+", " "), " +"), lambda x: F.length(x) > 3)
    name = lambda i: F.concat(F.lit("w_"), F.coalesce(F.get("w", F.lit(i)), F.lit("none")))
    py = F.concat(F.lit("class "), name(0), F.lit("("), name(1), F.lit("):\n    def "), name(2), F.lit("(self):\n        return "), name(3), F.lit("()\n\ndef "), name(3), F.lit("():\n    pass\n"))
    js = F.concat(F.lit("// head\nexport function "), name(0), F.lit("() {}\nclass "), name(1), F.lit(" {}\n"))
    kind = F.when(F.col("doc_id") % 2 == 0, "py").otherwise("ts")
    return gr.code_graph(docs.withColumn("w", w).select(F.col("doc_id").alias("file_id"), kind.alias("type"), F.when(kind == "py", py).otherwise(js).alias("text")))


@query(
    "sphere_layout",
    """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), y AS (SELECT *, 1 - 2.0 * i / greatest(n - 1, 1) AS yy FROM n)
SELECT doc_id, round(cos(2.399963229728653 * i) * sqrt(greatest(0, 1 - yy * yy)), 5) + 0.0 AS x, round(yy, 5) + 0.0 AS y, round(sin(2.399963229728653 * i) * sqrt(greatest(0, 1 - yy * yy)), 5) + 0.0 AS z FROM y""",
)
def sphere_layout(spark: SparkSession, d: str) -> DataFrame:  # G11, X9
    from corpusloom.operators.tables import numbered

    docs = table(spark, d, "documents").select("doc_id")
    n = docs.count()
    rows = numbered(docs, [F.asc("doc_id")], "rn").withColumn("i", F.col("rn") - 1).withColumn("yy", 1 - 2.0 * F.col("i") / max(n - 1, 1))
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("yy") * F.col("yy")))
    turn = F.lit(2.399963229728653) * F.col("i")
    return rows.select("doc_id", (F.round(F.cos(turn) * r, 5) + 0.0).alias("x"), (F.round("yy", 5) + 0.0).alias("y"), (F.round(F.sin(turn) * r, 5) + 0.0).alias("z"))
