"""A module graph derived from the driver's tables, the same in Spark and in SQL.

``mixed`` has cycles, and edges to a module that is not there; ``dag`` leaves out what closes cycles. The SQL is read by both engines, and both
read all rows of the tables.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.sources.graph import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

CTE = """
nm AS (SELECT n_nationkey AS k, replace(lower(n_name), ' ', '_') AS n, replace(lower(r_name), ' ', '_') AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
trade AS (SELECT f, t, rk FROM (SELECT f, t, row_number() OVER (PARTITION BY f ORDER BY n DESC, t) AS rk FROM
  (SELECT c_nationkey AS f, s_nationkey AS t, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
   WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) x) y),
ty AS (SELECT k, t, rk FROM (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY n DESC, t) AS rk FROM
  (SELECT s_nationkey AS k, lower(p_type) AS t, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, lower(p_type)) x) y),
paths AS (SELECT ':feature:' || n || ':ui' AS path FROM nm UNION SELECT ':feature:' || n || ':data' FROM nm UNION SELECT ':core:' || r FROM nm
  UNION SELECT ':app:' || lower(c_mktsegment) FROM customer UNION SELECT ':lib:' || lower(p_type) FROM part UNION SELECT ':legacy:orphan'),
m AS (SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS module_seq, path FROM paths),
links AS (SELECT DISTINCT ':app:' || lower(c_mktsegment) AS src, ':feature:' || n || ':ui' AS dst, 'implementation' AS configuration FROM customer JOIN nm ON c_nationkey = k
  UNION ALL SELECT ':feature:' || n || ':ui', ':feature:' || n || ':data', 'api' FROM nm
  UNION ALL SELECT ':feature:' || n || ':data', ':core:' || r, 'implementation' FROM nm
  UNION ALL SELECT ':feature:' || a.n || CASE WHEN (rk - 1) % 4 < 2 THEN ':ui' ELSE ':data' END, ':feature:' || b.n || CASE WHEN (rk - 1) % 4 IN (1, 2) THEN ':ui' ELSE ':data' END,
    CASE WHEN (rk - 1) % 4 < 2 THEN 'implementation' WHEN (rk - 1) % 4 = 3 THEN 'compileOnly' WHEN f % 2 = 0 THEN 'implementation' ELSE 'testImplementation' END FROM trade JOIN nm a ON f = a.k JOIN nm b ON t = b.k
  UNION ALL SELECT ':feature:' || n || ':data', ':feature:ghost:ui', 'implementation' FROM nm
  UNION ALL SELECT ':feature:' || n || ':data', ':lib:' || t, CASE WHEN rk = 1 THEN 'commonMainImplementation' ELSE 'api' END FROM ty JOIN nm ON ty.k = nm.k),
mixed AS (SELECT row_number() OVER (ORDER BY src, dst, configuration) - 1 AS edge_seq, src, dst, configuration FROM links),
dag AS (SELECT row_number() OVER (ORDER BY src, dst, configuration) - 1 AS edge_seq, src, dst, configuration FROM links
  WHERE NOT (src LIKE ':feature:%:data' AND dst LIKE ':feature:%') AND NOT (src LIKE ':feature:%:ui' AND dst LIKE ':feature:%:ui' AND src >= dst))
"""

# Fixed values of the fixture: plugin classes by the first segment, or the last for features.
PLUGINS = (
    (":app:%", "com.android.build.gradle.AppPlugin"),
    (":feature:%:ui", "com.android.build.gradle.LibraryPlugin"),
    (":feature:%:data", "org.jetbrains.kotlin.gradle.plugin.KotlinPluginWrapper"),
    (":core:%", "org.jetbrains.kotlin.gradle.plugin.mpp.KotlinMultiplatformPluginWrapper"),
    (":lib:%", "org.gradle.api.plugins.JavaLibraryPlugin"),
)

_held: dict[tuple, Graph] = {}


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def graph(spark: SparkSession, sf_dir: str, kind: str = "mixed") -> Graph:
    """Computed once for each session and folder: some 70 modules and 900 edges, whatever the tables' size."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _held:
        register(spark, sf_dir)
        plugin = F.lit(None).cast("string")
        for like, name in reversed(PLUGINS):
            plugin = F.when(F.col("path").like(like), name).otherwise(plugin)
        p = F.col("path")
        modules = spark.sql(f"WITH {CTE} SELECT * FROM m").select(
            F.lit("g").alias("graph_id"), "module_seq", "path", S.short_name(p).alias("name"), F.array_compact(F.array(plugin)).alias("plugins"), S.path_tags(p).alias("tags"), F.array().cast("array<string>").alias("source_sets"),
            F.when(~p.startswith(":legacy"), F.concat(S.build_dir(p), F.lit("/build.gradle.kts"))).alias("build_file_path"), F.lit(None).cast("int").alias("health_score"),
        ).withColumn("type", S.detect_type(F.col("plugins")))
        note = F.when(F.col("configuration") == "api", F.concat(F.lit("exports "), "dst"))
        edges = spark.sql(f"WITH {CTE} SELECT * FROM {kind}").select(
            F.lit("g").alias("graph_id"), F.col("edge_seq").cast("long").alias("edge_seq"), "src", "dst", "configuration", S.source_set(F.col("configuration")).alias("source_set"), F.lit(None).cast("int").alias("declaration_line"),
            note.alias("reason"), F.lit(None).cast("string").alias("adr_url"),
        )
        _held[key] = Graph(modules, edges).cached()
    return _held[key]
