"""The driver's tables in the shape of records, results and taxonomy, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxospark.functions.codes import family, group
from taxospark.functions.text import content_hash
from taxospark.schemas import FIELDS, ColumnMap, Layout, Source

MODELS = {2: 2, 4: 4, 6: 6}
SOURCES = {
    "ev": Source("ev", "Events", Layout(("event_type", "user_id", "props", "Day"), ColumnMap(0, 1, 2))),
    "ord": Source("ord", "Orders", Layout(("o_orderpriority", "o_custkey", "o_orderstatus", "day"), ColumnMap(0, 1, 2))),
    "prt": Source("prt", "Parts", Layout(("p_brand", "p_size", "p_name", "Type"), ColumnMap(0, 1, 2))),
    "cus": Source("cus", "Customers", Layout(("c_mktsegment", "c_nationkey", "c_name"), ColumnMap(0, 1, 2))),
}
#: Of each dataset: table, its key and the three fields.
SHAPES = {
    "ev": ("events", "event_id", "event_type", "user_id", "props"),
    "ord": ("orders", "o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus"),
    "prt": ("part", "p_partkey", "p_brand", "p_size", "p_name"),
    "cus": ("customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_name"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, key, *fields = SHAPES[name]
    df = table(spark, sf_dir, source)
    cells = {
        "ev": lambda: F.when(F.col("event_id") % 7 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")),
        "ord": lambda: F.date_format("o_orderdate", "yyyy-MM-dd"),
        "prt": lambda: F.col("p_type"),
    }
    extra = F.create_map(F.lit("3"), cells[name]()) if name in cells else F.lit(None).cast("map<string,string>")
    columns = [F.col(c).cast("string").alias(f) for c, f in zip(fields, FIELDS)]
    rows = df.select(F.lit(name).alias("dataset_id"), F.col(key).cast("long").alias("row_index"), *columns, extra.alias("extra_columns"))
    return rows.withColumn("content_hash", content_hash(*(F.col(f) for f in FIELDS)))


def courses(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (dataset(spark, sf_dir, n) for n in names or ("ev", "ord", "prt")))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    two = lambda key: F.lpad((F.col(key) + 1).cast("string"), 2, "0")
    top = region.select(F.lit(2).cast("byte").alias("digit_level"), two("r_regionkey").alias("code"), F.col("r_name").alias("title"), F.lower("r_name").alias("title_short"), F.lit(None).cast("string").alias("description"))
    six = F.concat(two("n_regionkey"), F.lit("."), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
    own = nation.filter("n_nationkey % 5 <> 4").select(F.lit(6).cast("byte").alias("digit_level"), six.alias("code"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("title_short"), F.concat(F.lit("The nation "), F.col("n_name")).alias("description"))
    return top.unionByName(own)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each distinct text of ev, ord and prt, two thirds have a result at every level."""
    first = courses(spark, sf_dir).groupBy("content_hash").agg(F.min("row_index").alias("m")).filter("m % 3 <> 0")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"), F.lit("."), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("six"))
    coded = first.join(F.broadcast(nation), F.col("m") % 25 == F.col("n_nationkey"))  # 25 nations
    other = lambda k: F.concat(F.substring("six", 1, 3), F.lpad(((F.col("m") + k) % 25).cast("string"), 4, "0"))
    probability = (F.col("m") % 1000).cast("double") / F.lit(1000.0).cast("double")
    levels = F.array(*(F.struct(F.lit(level).cast("long").alias("model_id"), code.alias("classification")) for level, code in ((2, family(F.col("six"))), (4, group(F.col("six"))), (6, F.col("six")))))
    return coded.select("content_hash", probability.alias("probability"), *(x for k in range(2, 6) for x in (other(k).alias(f"top{k}_code"), (F.col("m") % 1000 / F.lit(1000.0 * k).cast("double")).alias(f"top{k}_prob"))), F.inline(levels))


SQL = """
WITH ev AS (
    SELECT 'ev' AS dataset_id, event_id AS row_index, event_type AS subject_code, CAST(user_id AS VARCHAR) AS catalog_number, props AS course_title,
        CASE WHEN event_id % 7 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS cell FROM events
), ord AS (
    SELECT 'ord' AS dataset_id, o_orderkey AS row_index, o_orderpriority AS subject_code, CAST(o_custkey AS VARCHAR) AS catalog_number, o_orderstatus AS course_title,
        strftime(o_orderdate, '%Y-%m-%d') AS cell FROM orders
), prt AS (
    SELECT 'prt' AS dataset_id, p_partkey AS row_index, p_brand AS subject_code, CAST(p_size AS VARCHAR) AS catalog_number, p_name AS course_title, p_type AS cell FROM part
), cus AS (
    SELECT 'cus' AS dataset_id, c_custkey AS row_index, c_mktsegment AS subject_code, CAST(c_nationkey AS VARCHAR) AS catalog_number, c_name AS course_title, CAST(NULL AS VARCHAR) AS cell FROM customer
), courses AS (
    SELECT *, sha256(subject_code || ' ' || catalog_number || ' --- ' || course_title) AS content_hash
    FROM (SELECT * FROM ev UNION ALL SELECT * FROM ord UNION ALL SELECT * FROM prt UNION ALL SELECT * FROM cus)
), tax AS (
    SELECT 2 AS digit_level, lpad(CAST(r_regionkey + 1 AS VARCHAR), 2, '0') AS code, r_name AS title, lower(r_name) AS title_short, CAST(NULL AS VARCHAR) AS description FROM region
    UNION ALL SELECT 6, lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), n_name, NULL, 'The nation ' || n_name
    FROM nation WHERE n_nationkey % 5 <> 4
), coded AS (
    SELECT content_hash, m, lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS six, (m % 1000) / 1000.0 AS probability
    FROM (SELECT content_hash, min(row_index) AS m FROM courses WHERE dataset_id <> 'cus' GROUP BY content_hash) JOIN nation ON m % 25 = n_nationkey WHERE m % 3 <> 0
), res AS (
    SELECT content_hash, m, six, CAST(probability AS DOUBLE) AS probability, CAST(model_id AS BIGINT) AS model_id,
        CASE model_id WHEN 2 THEN substr(six, 1, 2) WHEN 4 THEN substr(six, 1, 5) ELSE six END AS classification
    FROM coded CROSS JOIN (VALUES (2), (4), (6)) AS v(model_id)
)
"""
