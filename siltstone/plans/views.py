"""Adaptors from the driver's tables to the library's schemas: one text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The adaptor views.
TEL = """SELECT CAST(user_id AS STRING) AS deviceId, ts AS timedate,
 CASE WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 'train' WHEN ts < TIMESTAMP '2024-01-26 00:00:00' THEN 'valid' ELSE 'test' END AS period,
 CAST(user_id % 4 AS INT) AS deviceType, CAST(user_id % 3 AS INT) AS x3, value/500.0 AS t1,
 CASE WHEN event_id % 7 <> 0 THEN (value % 100)/100.0 END AS t2, CASE WHEN event_type <> 'error' THEN value/250.0 END AS t5,
 CASE WHEN user_id % 10 <> 3 THEN CAST(event_id % 50 AS DOUBLE)/50 END AS t8,
 CASE WHEN event_type IN ('click','purchase') THEN value/10.0 WHEN event_type = 'view' THEN CAST(0 AS DOUBLE) END AS x1,
 CASE WHEN ts < TIMESTAMP '2024-01-21 00:00:00' AND event_id % 11 <> 0 THEN value/490.0 END AS x2, event_id
FROM events"""
MTEL = """SELECT CAST(l_suppkey AS STRING) AS deviceId, l_shipdate AS timedate,
 CASE WHEN l_shipdate < TIMESTAMP '2001-01-01 00:00:00' THEN 'train' ELSE 'test' END AS period,
 CAST(l_suppkey % 4 AS INT) AS deviceType, CAST(l_linenumber AS INT) AS x3, l_discount*10.0 AS t1, l_quantity/50.0 AS t5,
 CASE WHEN l_linestatus = 'F' THEN l_tax*10.0 END AS t8, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE CAST(0 AS DOUBLE) END AS x1,
 CASE WHEN l_shipdate < TIMESTAMP '2001-01-01 00:00:00' THEN l_extendedprice/100000.0 END AS x2
FROM lineitem"""
DEV = """SELECT CAST(c_custkey AS STRING) AS deviceId, CAST(49 AS DOUBLE) + CAST(c_nationkey AS DOUBLE)/5 AS latitude, CAST(14 AS DOUBLE) + c_acctbal/1000 AS longitude
FROM customer WHERE c_custkey % 9 <> 0"""
SNIP = """SELECT CAST(l_suppkey AS STRING) AS path, l_partkey % 200 + 1 AS start, l_partkey % 200 + 1 + CAST(l_quantity AS BIGINT) AS "end", l_partkey % 200 + 1 + CAST(l_linenumber AS BIGINT) AS anchor,
 l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + CAST(l_quantity AS BIGINT) AS selection, CAST(l_quantity AS BIGINT) + 1 AS size_lines, CAST(l_quantity AS BIGINT) * 17 + 9 AS size_chars FROM lineitem"""
EDGES = """SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name, 'world' FROM region
 UNION ALL SELECT * FROM (VALUES ('d1','world'), ('d2','d1'), ('d3','d1'), ('d4','d2'), ('d4','d3')) AS v(child, parent)"""
DOC = """SELECT doc_id, concat(lang, '/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, text, lang, source FROM documents"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text.replace('"end"', "`end`"), **{t: table(spark, sf_dir, t) for t in tables})


def tel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TEL, "events")


def mtel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MTEL, "lineitem")


def dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DEV, "customer")


def snip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SNIP, "lineitem")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EDGES, "nation", "region")


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DOC, "documents")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, i, v) of the embeddings, i from 0."""
    from pyspark.sql import functions as F

    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "_v")).selectExpr("vec_id", "i", "CAST(_v AS DOUBLE) AS v")


#: The same in DuckDB.
EMB = "SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
CTE = {"tel": TEL, "mtel": MTEL, "dev": DEV, "snip": SNIP, "edges": EDGES, "doc": DOC, "emb": EMB}


def with_views(sql: str, *names: str) -> str:
    """DuckDB text with the named views as leading expressions."""
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
