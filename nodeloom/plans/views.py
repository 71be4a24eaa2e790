"""The driver's tables seen as atoms, points and runs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUTOFF = 6.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def atoms(spark: SparkSession, sf_dir: str, key: str = "l_orderkey") -> DataFrame:
    """(gid, node_id, symbol, x, y, z): the lines of an order or of a supplier."""
    order = ("l_orderkey", *ROW)
    t = table(spark, sf_dir, "lineitem").withColumn("gid", F.col(key))  # named before the window, so that what groups by gid later finds its rows dealt out
    number = F.row_number().over(Window.partitionBy("gid").orderBy(*(c for c in order if c != key))) - 1
    return t.select("gid", number.cast("long").alias("node_id"), F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"), F.col("l_extendedprice").alias("price"))


def atoms_sql(key: str = "l_orderkey") -> str:
    order = ", ".join(c for c in ("l_orderkey", *ROW) if c != key)
    return f"""atoms AS (SELECT {key} AS gid, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS node_id, l_returnflag AS symbol,
    l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, l_extendedprice AS price FROM lineitem)"""


EDGES_SQL = f"""edges AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1 AS edge_id FROM (
    SELECT a.gid, a.node_id AS src, b.node_id AS dst, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
    sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS dist
    FROM atoms a JOIN atoms b ON a.gid = b.gid AND a.node_id <> b.node_id) WHERE dist * dist < {CUTOFF * CUTOFF})"""


#: The same edges from a list of atoms per group: no join that could be planned badly. Wants atoms.
EDGE_LISTS_SQL = f"""groups AS (SELECT gid, list({{n: node_id, s: symbol, x: x, y: y, z: z}}) AS l FROM atoms GROUP BY gid), firsts AS (SELECT gid, l, unnest(l) AS p FROM groups), seconds AS (SELECT gid, p, unnest(l) AS q FROM firsts),
met AS (SELECT gid, p.n AS src, q.n AS dst, p.s AS src_symbol, q.s AS dst_symbol, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM seconds WHERE p.n <> q.n),
near AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM met), edges AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1 AS edge_id FROM near WHERE dist * dist < {CUTOFF * CUTOFF})"""
#: Pairs of edges into one node, from a list of edges per node. Wants edges.
ANGLE_LISTS_SQL = """into_node AS (SELECT gid, dst, list({id: edge_id, n: src, s: src_symbol, c: dst_symbol, x: dx, y: dy, z: dz, d: dist}) AS l FROM edges GROUP BY gid, dst), us AS (SELECT gid, dst, l, unnest(l) AS u FROM into_node), vs AS (SELECT gid, dst, u, unnest(l) AS v FROM us),
angles AS MATERIALIZED (SELECT gid, u.id AS edge_u, v.id AS edge_v, u.s || u.c || v.s AS type_key, acos(greatest(-1, least(1, (u.x * v.x + u.y * v.y + u.z * v.z) / nullif(u.d * v.d, 0)))) AS angle FROM vs WHERE u.id <> v.id)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, x, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


CLOUD_SQL = "cloud AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


def knn_sql(k: int) -> str:
    return f"""{CLOUD_SQL}, knn AS (SELECT src, dst, CAST(rank AS INTEGER) AS rank, dist FROM (
    SELECT a.node_id AS src, b.node_id AS dst, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.node_id ORDER BY list_distance(a.x, b.x), b.node_id) AS rank
    FROM cloud a JOIN cloud b ON a.node_id <> b.node_id) WHERE rank <= {k})"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, epoch, loss_valid, loss_train, seconds): the events of a user as the losses of a run."""
    t = table(spark, sf_dir, "events")
    return t.select(F.col("user_id").alias("run_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("epoch"), F.col("value").alias("loss_valid"), F.pmod(F.col("event_id") * 7919, F.lit(1000)).cast("double").alias("loss_train"), F.pmod("event_id", F.lit(60)).cast("double").alias("seconds"))


RUNS_SQL = """runs AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, value AS loss_valid,
    CAST((event_id * 7919) % 1000 AS DOUBLE) AS loss_train, CAST(event_id % 60 AS DOUBLE) AS seconds FROM events)"""
