"""Registered queries, one for each operator or family of them, over the driver's whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxospark.functions import checks, codes, logits, text
from taxospark.operators import derive, evaluate, explore, export, filters, importing, maintenance, profiling, ranking, scoring
from taxospark.operators import taxonomy as tax
from taxospark.operators.shared import shared_path
from taxospark.operators.store import Store
from taxospark.plans import views
from taxospark.plans.views import MODELS, SOURCES
from taxospark.schemas import FIELDS, RESULTS, ColumnMap, DeriveRequest, FilterRow, FilterSpec, Layout, Op, OutputColumn
from taxospark.sources import delimited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL, which stands behind the views' expressions unless it is plain."""

    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql if plain else views.SQL + sql
        return f

    return keep


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- export ---------------------------------------------------------------------------------------------------------

TITLE = "coalesce((SELECT title FROM tax t WHERE digit_level = {level} AND t.code = {code}), (SELECT title FROM tax t WHERE digit_level = 2 AND t.code = substr({code}, 1, 2)))"
SAFE = "CASE WHEN regexp_matches({c}, '^[=+@\\t\\r-]') THEN '''' || {c} ELSE {c} END"
OWN = "subject_code AS c0, catalog_number AS c1, course_title AS c2, cell AS c3"


def _exported(spark: SparkSession, sf: str, name: str, models: list[tuple[int, int]], **how) -> DataFrame:
    _, rows = export.export(views.dataset(spark, sf, name), views.results(spark, sf), views.taxonomy(spark, sf), models, **how)
    return rows


@query(f"""
SELECT {OWN}, r6.classification AS ccm6digit_code, r6.probability AS ccm6digit_prob, coalesce(t6.title, t2.title) AS ccm6digit_title
FROM courses c LEFT JOIN res r6 ON r6.content_hash = c.content_hash AND r6.model_id = 6
LEFT JOIN tax t6 ON t6.digit_level = 6 AND t6.code = r6.classification LEFT JOIN tax t2 ON t2.digit_level = 2 AND t2.code = substr(r6.classification, 1, 2)
WHERE dataset_id = 'ord'
""")
def export_level6(spark: SparkSession, sf: str) -> DataFrame:
    return _exported(spark, sf, "ord", [(6, 6)], layout=SOURCES["ord"].layout)


@query(f"""
SELECT {OWN}, r2.classification AS ccm2digit_code, r2.probability AS ccm2digit_prob, t2.title AS ccm2digit_title,
    r4.classification AS ccm4digit_code, r4.probability AS ccm4digit_prob,
    r6.classification AS ccm6digit_code, r6.probability AS ccm6digit_prob, coalesce(t6.title, t2.title) AS ccm6digit_title
FROM courses c LEFT JOIN res r2 ON r2.content_hash = c.content_hash AND r2.model_id = 2
LEFT JOIN res r4 ON r4.content_hash = c.content_hash AND r4.model_id = 4 LEFT JOIN res r6 ON r6.content_hash = c.content_hash AND r6.model_id = 6
LEFT JOIN tax t6 ON t6.digit_level = 6 AND t6.code = r6.classification LEFT JOIN tax t2 ON t2.digit_level = 2 AND t2.code = r2.classification
WHERE dataset_id = 'ev'
""")
def export_all_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _exported(spark, sf, "ev", sorted(MODELS.items()), layout=SOURCES["ev"].layout)


@query("""
SELECT c0, c1, c2, classification AS ccm2digit_code, probability AS ccm2digit_prob, title AS ccm2digit_title
FROM (SELECT content_hash, arg_min(subject_code, row_index) AS c0, arg_min(catalog_number, row_index) AS c1, arg_min(course_title, row_index) AS c2 FROM courses WHERE dataset_id = 'ev' GROUP BY content_hash) c
LEFT JOIN res ON res.content_hash = c.content_hash AND model_id = 2 LEFT JOIN tax ON digit_level = 2 AND code = classification
""")
def export_unique(spark: SparkSession, sf: str) -> DataFrame:
    return _exported(spark, sf, "ev", [(2, 2)], unique=True)


@query("""
SELECT c0, c1, c2, c3, six AS ccm6digit_code, probability AS ccm6digit_prob, six AS ccm6digit_code1, probability AS ccm6digit_prob1,
""" + ", ".join(f"substr(six, 1, 3) || lpad(CAST((m + {k}) % 25 AS VARCHAR), 4, '0') AS ccm6digit_code{k}, (m % 1000) / CAST({1000 * k} AS DOUBLE) AS ccm6digit_prob{k}" for k in range(2, 6)) + """,
""" + TITLE.format(level=6, code="six") + " AS ccm6digit_title, " + TITLE.format(level=6, code="six") + " AS ccm6digit_title1, " + ", ".join(TITLE.format(level=6, code=f"(substr(six, 1, 3) || lpad(CAST((m + {k}) % 25 AS VARCHAR), 4, '0'))") + f" AS ccm6digit_title{k}" for k in range(2, 6)) + f"""
FROM (SELECT {OWN}, content_hash FROM courses WHERE dataset_id = 'prt') c LEFT JOIN (SELECT * FROM res WHERE model_id = 6) r USING (content_hash)
""")
def export_top5(spark: SparkSession, sf: str) -> DataFrame:
    return _exported(spark, sf, "prt", [(6, 6)], layout=SOURCES["prt"].layout, top=True)


@query("""
SELECT row_index, CASE WHEN row_index % 5 < 4 THEN '''' || substr('=+-@', CAST(row_index % 5 + 1 AS BIGINT), 1) || course_title ELSE course_title END AS cell FROM courses WHERE dataset_id = 'prt'
""")
def export_escaped(spark: SparkSession, sf: str) -> DataFrame:
    first = F.when(F.col("row_index") % 5 < 4, F.substring(F.lit("=+-@"), (F.col("row_index") % 5 + 1).cast("int"), F.lit(1))).otherwise("")
    return views.dataset(spark, sf, "prt").select("row_index", text.formula_safe(F.concat(first, F.col("course_title"))).alias("cell"))


# --- files ----------------------------------------------------------------------------------------------------------


def _part_lines(rows: DataFrame, first: str, line: Column) -> DataFrame:
    """Lines in order of row_index, a header line before those of each task, as text."""
    lines = rows.orderBy("row_index").select(line.alias("line"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    return lines.select(F.when(F.col("i") == F.shiftleft(F.col("p").cast("long"), 33), F.concat(F.lit(first + "\n"), F.col("line"))).otherwise(F.col("line")).alias("value"))


@query("SELECT 'back' AS dataset_id, row_number() OVER (ORDER BY row_index) - 1 AS row_index, subject_code, catalog_number, course_title, ' ' || cell || '  ' AS day, content_hash FROM courses WHERE dataset_id = 'ev'")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The events, quotes and commas in their titles, written as CSV part files and imported from there."""
    rows = views.dataset(spark, sf, "ev").orderBy("row_index")
    names, path = ("sub_pref", "course", "course_title", "Day"), shared_path(spark, "csv")
    export.write_csv(names, rows.select(*FIELDS, F.concat(F.lit(" "), F.element_at("extra_columns", "3"), F.lit("  "))), path)
    found = delimited.headers(spark, path)
    layout = Layout(found, delimited.detect_mapping(found))
    back = importing.imported(delimited.courses(delimited.indexed(delimited.scan(spark, path, len(found))), layout), "back")
    return back.select("dataset_id", "row_index", *FIELDS, F.element_at("extra_columns", "3").alias("day"), "content_hash")


@query("SELECT row_index, course_title || chr(8364) || chr(233) AS windows, course_title || chr(196) || chr(200) AS mac FROM courses WHERE dataset_id = 'prt'")
def csv_legacy(spark: SparkSession, sf: str) -> DataFrame:
    """The parts' names with the bytes 80 and E9 behind them, as either legacy encoding has them."""
    path = shared_path(spark, "csv-legacy")
    rows = views.dataset(spark, sf, "prt").select(F.col("row_index").cast("string").alias("id"), F.concat("course_title", F.lit("\x80\xe9")).alias("name"))
    rows.write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    read = lambda encoding, name: delimited.scan(spark, path, 2, encoding).select(F.col("_c0").cast("long").alias("row_index"), F.col("_c1").alias(name))
    return read(delimited.WINDOWS_1252, "windows").join(read(delimited.MAC_ROMAN, "mac"), "row_index")


@query("SELECT \"row\", fields, n FROM (SELECT row_number() OVER (ORDER BY row_index) + 1 AS \"row\", CASE WHEN row_index % 50 = 7 THEN 4 ELSE 2 END AS fields, row_index, count(CASE WHEN row_index % 50 IN (7, 8) THEN 1 END) OVER () AS n FROM courses WHERE dataset_id = 'cus') WHERE row_index % 50 IN (7, 8) ORDER BY 1 LIMIT 10")
def csv_ragged(spark: SparkSession, sf: str) -> DataFrame:
    """The number of records that have a field too many or too few, and the first of them."""
    path, cut = shared_path(spark, "csv-ragged"), F.col("row_index") % 50
    line = F.concat_ws(",", "subject_code", "catalog_number", F.when(cut == 7, F.concat_ws(",", F.lit("x"), "course_title")).when(cut == 8, None).otherwise(F.col("course_title")))
    _part_lines(views.dataset(spark, sf, "cus"), "segment,nation,name", line).write.text(path)
    n, first = delimited.ragged(delimited.indexed(delimited.scan(spark, path, 3)))
    return first.select("row", "fields", F.lit(n).cast("long").alias("n"))


@query("SELECT 'back' AS dataset_id, row_number() OVER (ORDER BY row_index) - 1 AS row_index, subject_code, catalog_number, '\"' || course_title || chr(13) || chr(10) || 'and, more' || chr(10) || row_index AS course_title, cell AS day FROM courses WHERE dataset_id = 'ev'")
def csv_quoted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The events with line ends of both kinds and quotes in their titles, written as CSV part files and imported into a store, in as many tasks as the files have blocks."""
    rows = views.dataset(spark, sf, "ev").orderBy("row_index")
    names, path = ("sub_pref", "course", "course_title", "Day"), shared_path(spark, "csv-lines")
    title = F.concat(F.lit('"'), "course_title", F.lit("\r\nand, more\n"), F.col("row_index").cast("string"))
    export.write_csv(names, rows.select("subject_code", "catalog_number", title.alias("course_title"), F.element_at("extra_columns", "3")), path)
    store = Store(spark, shared_path(spark, "store"))
    importing.import_csv(spark, store, path, "back", "Back", profile=False)
    return store.courses("back").select("dataset_id", "row_index", *FIELDS, F.element_at("extra_columns", "3").alias("day"))


@query("""
SELECT count(*) AS records, count(CASE WHEN row_index % 40 = 3 THEN 1 END) AS ragged, count(CASE WHEN row_index % 40 <> 3 AND row_index % 25 = 4 THEN 1 END) AS valid,
    count(CASE WHEN row_index % 40 <> 3 AND row_index % 25 = 9 THEN 1 END) AS invalid, 'mixed' AS verdict,
    list_aggregate(list_sort(list(CASE WHEN row_index % 40 = 3 THEN place + 1 END))[1:10], 'sum') AS ragged_rows,
    list_aggregate(list_sort(list(CASE WHEN row_index % 40 <> 3 AND row_index % 25 = 9 THEN place + 1 END))[1:10], 'sum') AS sample_rows
FROM (SELECT row_index, row_number() OVER (ORDER BY row_index) AS place FROM courses WHERE dataset_id = 'ord')
""")
def csv_inspect(spark: SparkSession, sf: str) -> DataFrame:
    """The inspection of a file made of the orders, some of whose records have a field too many, a name in UTF-8 or in a legacy encoding."""
    path, i = shared_path(spark, "csv-inspect"), F.col("row_index")
    foreign = F.when(i % 25 == 4, F.lit("\xc3\xa9")).when(i % 25 == 9, F.lit("\xe9")).otherwise(F.lit(""))
    line = F.concat_ws(",", "subject_code", "catalog_number", F.concat("course_title", F.when(i % 40 == 3, F.lit(",more")).otherwise(foreign)))
    lines = _part_lines(views.dataset(spark, sf, "ord"), "sub_pref,course,course_title", line)
    lines.select(F.encode("value", "ISO-8859-1").cast("string").alias("value")).write.text(path)
    found = delimited.inspect(spark, path)
    row = (found.rows, found.ragged, found.encoding.valid, found.encoding.invalid, found.encoding.verdict, sum(r for r, _ in found.ragged_rows), sum(x[0] for x in found.encoding.samples))
    return spark.createDataFrame([row], "records long, ragged long, valid long, invalid long, verdict string, ragged_rows long, sample_rows long")


@query("SELECT row_index, subject_code, catalog_number, left(repeat(course_title, 500), 8192) AS course_title, left(repeat(cell, 900), 8192) AS day FROM courses WHERE dataset_id = 'prt'")
def csv_long_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The parts with names and types repeated beyond the bytes that a field may have, written as compressed CSV part files and imported into a store."""
    rows, path = views.dataset(spark, sf, "prt").orderBy("row_index"), shared_path(spark, "csv-long")
    export.write_csv(("number", "sub_pref", "course", "course_title", "day"), rows.select("row_index", "subject_code", F.col("catalog_number"), F.repeat("course_title", F.lit(500)), F.repeat(F.element_at("extra_columns", "3"), F.lit(900))), path, compressed=1024)
    store = Store(spark, shared_path(spark, "store"))
    importing.import_csv(spark, store, path, "long", "Long", ColumnMap(1, 2, 3), profile=False)
    return store.courses("long").select(F.element_at("extra_columns", "0").cast("long").alias("row_index"), *FIELDS, F.element_at("extra_columns", "4").alias("day"))


@query("SELECT count(*) AS records, count(CASE WHEN row_index % 6 > 0 THEN 1 END) AS importable, count(CASE WHEN row_index % 6 = 0 THEN 1 END) AS skipped, count(CASE WHEN row_index % 9 = 0 THEN 1 END) AS truncated FROM courses WHERE dataset_id = 'cus'")
def csv_validate(spark: SparkSession, sf: str) -> DataFrame:
    """The dry run of an import of the customers, a sixth of whom have no name and a ninth a comment that is cut."""
    rows, path, i = views.dataset(spark, sf, "cus").orderBy("row_index"), shared_path(spark, "csv-validate"), F.col("row_index")
    name = F.when(i % 6 == 0, F.lit(" ")).otherwise(F.col("course_title"))
    comment = F.when(i % 9 == 0, F.repeat(F.lit("comment "), F.lit(2000))).otherwise(F.lit("short"))
    export.write_csv(("sub_pref", "course", "course_title", "comment"), rows.select("subject_code", F.col("catalog_number"), name, comment), path)
    report = importing.validate(spark, path)
    told = report["profile"]
    return spark.createDataFrame([(told["rows"], told["importable"], told["skipped"], report["truncated_fields"])], "records long, importable long, skipped long, truncated long")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 NOT IN (1, 2, 3, 4)", plain=True)
def panel(spark: SparkSession, sf: str) -> DataFrame:
    """A panel made of the customers: those without a name or with a flag of several courses are left out."""
    path, i = shared_path(spark, "csv-panel"), F.col("c_custkey")
    flag = F.element_at(F.array(F.lit("n"), F.lit(" Y "), F.lit("yes"), F.lit("1"), F.lit("TRUE")), (i % 5 + 1).cast("int"))
    rows = views.table(spark, sf, "customer").select("c_custkey", F.when(i % 7 > 0, F.col("c_name")).alias("c_name"), "c_mktsegment", flag.alias("Multiple Course?"))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return delimited.panel(spark, path, ["c_name", "c_mktsegment"]).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


@query("SELECT CAST(digit_level AS INTEGER) AS digit_level, code, title, title_short, description FROM tax")
def taxonomy_files(spark: SparkSession, sf: str) -> DataFrame:
    """The taxonomy written as its two files and read back."""
    path, tree = shared_path(spark, "csv-taxonomy"), views.taxonomy(spark, sf)
    for level, third in ((2, "title_short"), (6, "description")):
        tree.filter(F.col("digit_level") == level).select("code", "title", third).write.option("header", True).option("escape", '"').csv(f"{path}/{level}")
    return delimited.taxonomy(spark, f"{path}/2", f"{path}/6").withColumn("digit_level", F.col("digit_level").cast("int"))


# --- filters and pages ----------------------------------------------------------------------------------------------


def _filter(name: str, spec: list[FilterRow], where: str, sources: tuple[str, ...] = ("ev",)) -> None:
    among = ", ".join(f"'{s}'" for s in sources)

    @query(f"SELECT dataset_id, row_index, content_hash FROM courses c WHERE dataset_id IN ({among}) AND {where}", name=name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        needs = any(r.field.startswith("code:") for r in spec)
        found = filters.apply(views.courses(spark, sf, *sources), FilterSpec(tuple(spec)), [SOURCES[s] for s in sources], views.results(spark, sf) if needs else None, MODELS)
        return found.select("dataset_id", "row_index", "content_hash")


HAS = "EXISTS (SELECT 1 FROM res r WHERE r.model_id = {level} AND r.content_hash = c.content_hash AND {test})"
_filter("filter_is", [FilterRow("subject_code", Op.IS, (" Click ", "VIEW"))], "subject_code IN ('click', 'view')")
_filter("filter_is_not", [FilterRow("subject_code", Op.IS_NOT, ("click",))], "subject_code <> 'click'")
_filter("filter_contains", [FilterRow("course_title", Op.CONTAINS, ("K\": 1", "%"))], "(contains(lower(course_title), 'k\": 1') OR contains(course_title, '%'))")
_filter("filter_not_contains", [FilterRow("course_title", Op.NOT_CONTAINS, ("9", "_"))], "NOT contains(course_title, '9') AND NOT contains(course_title, '_')")
_filter("filter_starts_with", [FilterRow("catalog_number", Op.STARTS_WITH, ("1", "42"))], "(starts_with(catalog_number, '1') OR starts_with(catalog_number, '42'))")
_filter("filter_empty", [FilterRow("column:day", Op.IS_EMPTY)], "coalesce(cell, '') = ''", ("ev", "ord"))
_filter("filter_not_empty", [FilterRow("column:day", Op.IS_NOT_EMPTY)], "coalesce(cell, '') <> ''", ("ev", "ord"))
_filter("filter_and_or", [FilterRow("subject_code", Op.IS, ("click", "error")), FilterRow("column:day", Op.STARTS_WITH, ("2024-01-0", "2024-01-1"))], "subject_code IN ('click', 'error') AND (starts_with(cell, '2024-01-0') OR starts_with(cell, '2024-01-1'))")
_filter("filter_code_is", [FilterRow("code:6", Op.IS, ("02.0001", "03.0002"))], HAS.format(level=6, test="classification IN ('02.0001', '03.0002')"), ("ord",))
_filter("filter_code_is_not", [FilterRow("code:6", Op.IS_NOT, ("02.0001",))], HAS.format(level=6, test="classification <> '02.0001'"), ("ord",))
_filter("filter_code_prefix", [FilterRow("code:4", Op.STARTS_WITH, ("02", "04.0")), FilterRow("catalog_number", Op.CONTAINS, ("7",))], HAS.format(level=4, test="(starts_with(classification, '02') OR starts_with(classification, '04.0'))") + " AND contains(catalog_number, '7')", ("ev", "prt"))
_filter("filter_source", [FilterRow("source", Op.IS_NOT, ("ev",)), FilterRow("column:day", Op.CONTAINS, ("-05-",))], "dataset_id <> 'ev' AND contains(cell, '-05-')", ("ev", "ord"))


@query("""
, page AS (SELECT * FROM courses WHERE dataset_id = 'ord' AND row_index >= 777 ORDER BY row_index LIMIT 500)
SELECT p.row_index, subject_code, level, classification, probability, coalesce(o.title, CASE WHEN level <> 4 THEN t.title END) AS title,
    CASE WHEN o.title IS NOT NULL THEN o.title_short WHEN level <> 4 THEN t.title_short END AS title_short, o.description,
    CASE WHEN o.title IS NOT NULL THEN level WHEN level <> 4 AND t.title IS NOT NULL THEN 2 ELSE 0 END AS title_level
FROM page p JOIN (SELECT *, CAST(model_id AS INTEGER) AS level FROM res) r USING (content_hash)
LEFT JOIN tax o ON o.digit_level = level AND o.code = classification LEFT JOIN tax t ON t.digit_level = 2 AND t.code = substr(classification, 1, 2)
""")
def page_keyset(spark: SparkSession, sf: str) -> DataFrame:
    page = explore.page(views.dataset(spark, sf, "ord").drop("extra_columns"), 777, 500)
    out = explore.attach(page, views.results(spark, sf), views.taxonomy(spark, sf), MODELS)
    return out.select("row_index", "subject_code", "level", "classification", "probability", "title", "title_short", "description", F.coalesce("title_level", F.lit(0)).cast("int").alias("title_level"))


def _stored(spark: SparkSession, sf: str, *names: str) -> Store:
    """A store with these datasets and the results of all levels, in sorted buckets."""
    store = Store(spark, shared_path(spark, "store"))
    store.write_courses(views.courses(spark, sf, *names))
    found = views.results(spark, sf)
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in RESULTS if f.name not in found.columns]
    store.append_results(found.select("*", *lacking))
    return store


@query(f"SELECT * EXCLUDE (probability) FROM ({SQL['page_keyset']})", plain=True)
def store_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page of page_keyset, from a store's indexed records and bucketed results."""
    out = explore.stored_page(_stored(spark, sf, "ord"), "ord", views.taxonomy(spark, sf), MODELS, 777, 500)
    return out.select("row_index", "subject_code", "level", "classification", "title", "title_short", "description", F.coalesce("title_level", F.lit(0)).cast("int").alias("title_level"))


@query(f"SELECT * EXCLUDE (ccm2digit_prob, ccm4digit_prob, ccm6digit_prob) FROM ({SQL['export_all_levels']})", plain=True)
def store_export(spark: SparkSession, sf: str) -> DataFrame:
    """The export of export_all_levels over a store: each level's results are joined in their buckets."""
    store = _stored(spark, sf, "ev", "ord")
    _, rows = export.export(store.courses("ev"), store.results(), views.taxonomy(spark, sf), sorted(MODELS.items()), layout=SOURCES["ev"].layout)
    return rows.drop("ccm2digit_prob", "ccm4digit_prob", "ccm6digit_prob")


@query("SELECT count(*) AS n FROM courses WHERE dataset_id = 'ord' AND subject_code = '5-LOW'")
def filtered_total(spark: SparkSession, sf: str) -> DataFrame:
    spec = FilterSpec((FilterRow("subject_code", Op.IS, ("5-low",)),))
    return filters.apply(views.dataset(spark, sf, "ord"), spec, [SOURCES["ord"]]).agg(F.count("*").alias("n"))


# --- pickers, coverage, counts --------------------------------------------------------------------------------------


@query("SELECT subject_code AS value, count(*) AS n FROM courses WHERE dataset_id = 'prt' GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def values_subject(spark: SparkSession, sf: str) -> DataFrame:
    return explore.values(views.dataset(spark, sf, "prt"), F.col("subject_code"))


@query("SELECT cell AS value, count(*) AS n FROM courses WHERE dataset_id IN ('ev', 'ord') AND cell <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def values_column(spark: SparkSession, sf: str) -> DataFrame:
    return explore.values(views.courses(spark, sf, "ev", "ord"), filters.column_cell("day", [SOURCES["ev"], SOURCES["ord"]]))


@query("SELECT course_title AS value, count(*) AS n FROM courses WHERE dataset_id = 'prt' AND contains(lower(course_title), 're') GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def values_search(spark: SparkSession, sf: str) -> DataFrame:
    return explore.values(views.dataset(spark, sf, "prt"), F.col("course_title"), "RE")


@query("""
SELECT classification AS value, coalesce(max(o.title), max(t.title)) AS label, count(*) AS n FROM courses JOIN res USING (content_hash)
LEFT JOIN tax o ON o.digit_level = 6 AND o.code = classification LEFT JOIN tax t ON t.digit_level = 2 AND t.code = substr(classification, 1, 2)
WHERE dataset_id = 'ord' AND model_id = 6 GROUP BY 1 HAVING contains(lower(coalesce(max(o.title), max(t.title))), 'a') ORDER BY n DESC, value LIMIT 100
""")
def values_code(spark: SparkSession, sf: str) -> DataFrame:
    return explore.code_values(views.dataset(spark, sf, "ord"), views.results(spark, sf), views.taxonomy(spark, sf), 6, 6, "A")


COVER = "SELECT CAST(model_id AS INTEGER) AS level, count(*) AS classified, (SELECT count(*) FROM courses WHERE dataset_id = '{d}') AS total FROM courses JOIN res USING (content_hash) WHERE dataset_id = '{d}' GROUP BY 1"


@query(COVER.format(d="ev"))
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return explore.coverage(views.dataset(spark, sf, "ev"), views.results(spark, sf), MODELS)


@query(f"SELECT level, CAST(least(99, floor(100.0 * classified / total)) AS INTEGER) AS percent FROM ({COVER.format(d='prt')})")
def coverage_percent(spark: SparkSession, sf: str) -> DataFrame:
    return explore.coverage(views.dataset(spark, sf, "prt"), views.results(spark, sf), MODELS).select("level", explore.percent(F.col("classified"), F.col("total")).alias("percent"))


@query("SELECT (SELECT count(DISTINCT dataset_id) FROM courses WHERE dataset_id <> 'cus') AS datasets, (SELECT count(*) FROM courses WHERE dataset_id <> 'cus') AS courses, (SELECT count(*) FROM res) AS results")
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    all_rows = views.courses(spark, sf)
    return explore.metrics(all_rows.select("dataset_id").distinct(), all_rows, views.results(spark, sf))


# --- scoring --------------------------------------------------------------------------------------------------------

MISS = "SELECT * FROM courses WHERE dataset_id = '{d}' AND content_hash NOT IN (SELECT content_hash FROM res WHERE model_id = 6)"


@query(f"SELECT CAST(v AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS missing_rows, count(DISTINCT content_hash) AS missing_unique FROM ({MISS.format(d='ord')}) CROSS JOIN (VALUES (2), (4), (6)) AS t(v) GROUP BY 1")
def miss_stats(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.miss_stats(views.dataset(spark, sf, "ord"), views.results(spark, sf), MODELS)


@query(f"SELECT content_hash, arg_min(subject_code || ' ' || catalog_number || ' --- ' || course_title, row_index) AS input, min(row_index) AS first_row FROM ({MISS.format(d='ev')}) GROUP BY 1")
def miss_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.misses(views.dataset(spark, sf, "ev"), views.results(spark, sf), 6)


@query(f"""
SELECT done, CAST(total - missing_rows + missing_rows * done // missing_unique AS BIGINT) AS covered
FROM (SELECT count(*) AS missing_rows, count(DISTINCT content_hash) AS missing_unique FROM ({MISS.format(d='ev')})), (SELECT count(*) AS total FROM courses WHERE dataset_id = 'ev'), (SELECT count(*) AS done FROM nation)
""")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.dataset(spark, sf, "ev")
    one = scoring.miss_stats(rows, views.results(spark, sf), {6: 6}).crossJoin(rows.agg(F.count("*").alias("total"))).crossJoin(views.table(spark, sf, "nation").agg(F.count("*").alias("done")))
    return one.select("done", scoring.progress(F.col("total"), F.col("missing_rows"), F.col("missing_unique"), F.col("done")).alias("covered"))


def first_digit() -> scoring.Scorer:
    """A model for tests of the plumbing: 16 logits, the largest that of the first hex digit of the text's SHA-256."""
    import hashlib

    def run(texts):
        return [[1.0 if i == int(hashlib.sha256(t.encode()).hexdigest()[0], 16) else 0.0 for i in range(16)] for t in texts]

    return run


@query("""
SELECT content_hash, lpad(CAST(strpos('0123456789abcdef', substr(content_hash, 1, 1)) - 1 AS VARCHAR), 2, '0') AS classification, round(1 / (1 + 15 * exp(-1)), 6) AS probability
FROM (SELECT DISTINCT content_hash FROM courses WHERE dataset_id = 'prt')
""")
def score_toy(spark: SparkSession, sf: str) -> DataFrame:
    none = views.results(spark, sf).filter("false")
    found = scoring.scored(scoring.misses(views.dataset(spark, sf, "prt"), none, 2), first_digit)
    return scoring.as_results(found, [str(i) for i in range(16)], 2, 2).select("content_hash", "classification", F.round(F.col("probability").cast("double"), 6).alias("probability"))


@query(SQL["score_toy"], plain=True)
def store_score(spark: SparkSession, sf: str) -> DataFrame:
    """The scores of score_toy by a run over a store that was stopped after its first bucket and begun again."""
    store = Store(spark, shared_path(spark, "store"))
    store.write_courses(views.dataset(spark, sf, "prt"))
    store.add_dataset(id="prt", title="Parts", import_state="ready")

    def once(level: int, bucket: int) -> None:
        if bucket == 1:
            raise scoring.Stopped

    model = [(2, 2, [str(i) for i in range(16)], first_digit)]
    scoring.classify(store, "prt", model, buckets=3, before_bucket=once)
    scoring.classify(store, "prt", model)
    return store.results().select("content_hash", "classification", F.round(F.col("probability").cast("double"), 6).alias("probability"))


@query("SELECT count(*) AS compared, count(CASE WHEN row_index % 4 > 0 THEN 1 END) AS matched, CAST(0 AS BIGINT) AS skipped, round(count(CASE WHEN row_index % 4 > 0 THEN 1 END) / count(*), 6) AS rate FROM courses WHERE dataset_id = 'prt'")
def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """A model's codes against labels that are wrong for a fourth of the parts; each distinct text is scored once."""
    rows = views.dataset(spark, sf, "prt")
    told = F.instr(F.lit("0123456789abcdef"), F.substring("content_hash", 1, 1)) - 1
    truth = F.when(F.col("row_index") % 4 == 0, F.lit("77")).otherwise(told.cast("string"))
    found = evaluate.label_agreement(rows.withColumn("truth", truth), "truth", 2, [str(i) for i in range(16)], first_digit)
    return found.withColumn("rate", F.round("rate", 6))


@query("SELECT level, CAST(n AS BIGINT) AS total, CAST(n AS BIGINT) AS covered, CAST(distinct_n AS BIGINT) AS done FROM (SELECT count(*) AS n, count(DISTINCT content_hash) AS distinct_n FROM courses WHERE dataset_id = 'cus') CROSS JOIN (VALUES (2), (6)) AS v(level)")
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    """What the log of a scoring run over the customers says when it is done."""
    store = Store(spark, shared_path(spark, "store"))
    store.write_courses(views.dataset(spark, sf, "cus"))
    store.add_dataset(id="cus", title="Customers", import_state="ready")
    scoring.classify(store, "cus", [(level, level, [str(i) for i in range(16)], first_digit) for level in (2, 6)], buckets=2)
    return scoring.run_progress(store, "cus").drop("rows_per_second")


@query("SELECT id, n AS row_count, 'ready' AS import_state, 'idle' AS classify_state, place FROM (SELECT dataset_id AS id, count(*) AS n FROM courses WHERE dataset_id IN ('prt', 'cus') GROUP BY 1) JOIN (VALUES ('cus', 1), ('prt', 2)) AS v(id, place) USING (id)")
def dataset_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The listing of a store into which the parts, the orders and then the customers were imported, and from which the orders were deleted."""
    store = Store(spark, shared_path(spark, "store"))
    for name in ("prt", "ord", "cus"):
        path = shared_path(spark, "csv-listing")
        export.write_csv(("sub_pref", "course", "course_title"), views.dataset(spark, sf, name).select(*FIELDS), path)
        importing.import_csv(spark, store, path, name, name, profile=False)
    maintenance.delete_dataset(store, "ord")
    listed = [r.asDict() | {"place": i} for i, r in enumerate(store.latest_datasets().collect(), 1)]
    return spark.createDataFrame([(r["id"], r["row_count"], r["import_state"], r["classify_state"], r["place"]) for r in listed], "id string, row_count long, import_state string, classify_state string, place int")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("logits"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings", plain=True)
def logit_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", logits.argmax(F.col("logits")).alias("argmax"))


@query("""
SELECT vec_id, CAST(max(CASE WHEN r = 1 THEN i END) AS INTEGER) AS i1, CAST(max(CASE WHEN r = 2 THEN i END) AS INTEGER) AS i2, CAST(max(CASE WHEN r = 3 THEN i END) AS INTEGER) AS i3, CAST(max(CASE WHEN r = 4 THEN i END) AS INTEGER) AS i4, CAST(max(CASE WHEN r = 5 THEN i END) AS INTEGER) AS i5
FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, i) AS r FROM (SELECT vec_id, unnest(embedding) AS z, unnest(range(len(embedding))) AS i FROM embeddings)) GROUP BY 1
""", plain=True)
def logit_top5(spark: SparkSession, sf: str) -> DataFrame:
    best = logits.top(F.col("logits"))
    return _vectors(spark, sf).select("vec_id", *(best[k]["i"].cast("int").alias(f"i{k + 1}") for k in range(5)))


@query("SELECT vec_id, round(1 / list_sum(list_transform(embedding, lambda z: exp(CAST(z AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 6) AS probability FROM embeddings", plain=True)
def logit_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", F.round(1 / logits.denominator(F.col("logits")), 6).alias("probability"))


@query("""
SELECT n_nationkey, level, CASE level WHEN 2 THEN lpad(CAST(n_nationkey AS VARCHAR), 2, '0') WHEN 4 THEN lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.' || rpad(CAST(n_regionkey AS VARCHAR), 2, '0')
    ELSE lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.' || rpad(CAST(n_regionkey AS VARCHAR), 4, '0') END AS code
FROM nation CROSS JOIN (VALUES (2), (4), (6)) AS t(level)
""", plain=True)
def normalize_codes(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.col("n_nationkey").cast("string"), F.lit("."), F.col("n_regionkey").cast("string"))
    each = views.table(spark, sf, "nation").select("n_nationkey", label.alias("label"), F.explode(F.array(F.lit(2), F.lit(4), F.lit(6))).alias("level"))
    return each.select("n_nationkey", "level", codes.canonical(F.col("label"), F.col("level")).alias("code"))


# --- derived datasets -----------------------------------------------------------------------------------------------

MERGED = DeriveRequest(("ord", "ev"), (OutputColumn("Day", (("ord", 3), ("ev", 3))),), FilterSpec((FilterRow("catalog_number", Op.CONTAINS, ("1", "2", "3")),)), dedupe=("subject_code", "Day"))
MERGED_SQL = """
, merged AS (
    SELECT CASE dataset_id WHEN 'ord' THEN 0 ELSE 1 END AS src_pos, dataset_id, row_index, subject_code, catalog_number, course_title, cell AS day, CASE dataset_id WHEN 'ord' THEN 'Orders' ELSE 'Events' END AS source_title, content_hash
    FROM courses WHERE dataset_id IN ('ord', 'ev') AND regexp_matches(catalog_number, '[123]')
)
"""


def _merged(spark: SparkSession, sf: str) -> tuple[derive.Plan, DataFrame]:
    p = derive.plan(MERGED, SOURCES)
    return p, derive.merged(p, views.courses(spark, sf, "ord", "ev"))


def _flat(rows: DataFrame, *columns: str) -> DataFrame:
    cell = lambda k: F.try_element_at("extra_columns", F.lit(k))
    return rows.select(*columns, *FIELDS, cell("3").alias("day"), cell("4").alias("source_title"), "content_hash")


@query(MERGED_SQL + "SELECT CAST(src_pos AS INTEGER) AS src_pos, row_index, subject_code, catalog_number, course_title, day, source_title, content_hash FROM merged")
def derive_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_merged(spark, sf)[1], "src_pos", "row_index")


@query(MERGED_SQL + "SELECT dataset_id, CAST(min(src_pos) AS INTEGER) AS position, count(*) AS n FROM merged GROUP BY 1")
def derive_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return derive.source_counts(*_merged(spark, sf))


@query(MERGED_SQL + "SELECT CAST(src_pos AS INTEGER) AS src_pos, row_index, subject_code, catalog_number, course_title, day, source_title, content_hash FROM merged ORDER BY src_pos, row_index LIMIT 50")
def derive_preview(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(derive.preview(_merged(spark, sf)[1]), "src_pos", "row_index")


DEDUPED = MERGED_SQL + ", d AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY subject_code, {key} ORDER BY src_pos, row_index) = 1) "


@query(DEDUPED.format(key="day") + "SELECT CAST(src_pos AS INTEGER) AS src_pos, row_index, subject_code, catalog_number, course_title, day, source_title, content_hash FROM d")
def derive_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    p, rows = _merged(spark, sf)
    return _flat(derive.deduped(p, rows), "src_pos", "row_index")


@query(DEDUPED.format(key="dataset_id") + "SELECT CAST(src_pos AS INTEGER) AS src_pos, row_index, subject_code FROM d")
def derive_dedupe_source(spark: SparkSession, sf: str) -> DataFrame:
    p = derive.plan(DeriveRequest(MERGED.sources, MERGED.columns, MERGED.filter, dedupe=("subject_code", "source_dataset")), SOURCES)
    return derive.deduped(p, derive.merged(p, views.courses(spark, sf, "ord", "ev"))).select("src_pos", "row_index", "subject_code")


@query(DEDUPED.format(key="day") + "SELECT 'new' AS dataset_id, row_number() OVER (ORDER BY src_pos, row_index) - 1 AS row_index, subject_code, catalog_number, course_title, day, source_title, content_hash FROM d")
def derive_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(derive.materialized(*_merged(spark, sf), "new"), "dataset_id", "row_index")


@query("""
SELECT 'all' AS dataset_id, row_number() OVER (ORDER BY CASE dataset_id WHEN 'ord' THEN 0 ELSE 1 END, row_index) - 1 AS row_index, subject_code, catalog_number, course_title,
    cell AS day, CASE dataset_id WHEN 'ord' THEN 'Orders' ELSE 'Events' END AS source_title, content_hash
FROM courses WHERE dataset_id IN ('ord', 'ev')
""")
def derive_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = derive.plan(DeriveRequest(MERGED.sources, MERGED.columns), SOURCES)
    return _flat(derive.materialized(p, derive.merged(p, views.courses(spark, sf, "ord", "ev")), "all"), "dataset_id", "row_index")


@query("SELECT row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place, doc_id, text, source FROM documents", plain=True)
def wide_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.numbered(views.table(spark, sf, "documents").select("n_chars", "doc_id", "text", "source"), ["n_chars", "doc_id"], "place").drop("n_chars")


@query("SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, CAST(c_nationkey AS INTEGER) AS position, CAST(c_nationkey AS VARCHAR) AS source_dataset_id, c_name AS source_title, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_nationkey % 2 = 0) AS \"exists\" FROM customer", plain=True)
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    links = views.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("dataset_id"), F.col("c_nationkey").cast("int").alias("position"), F.col("c_nationkey").cast("string").alias("source_dataset_id"), F.col("c_name").alias("source_title"))
    return derive.lineage(links, views.table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("id")))


# --- profiles -------------------------------------------------------------------------------------------------------

# Records that trip the checks: parts, damaged in six ways by row_index; every 11th lacks a field.
DAMAGED_SQL = """
, rec AS (
    SELECT row_index, CASE WHEN row_index % 11 = 0 THEN '' ELSE subject_code END AS subject_code,
        CASE row_index % 6 WHEN 0 THEN catalog_number || '.0' WHEN 1 THEN subject_code || ' ' || catalog_number ELSE catalog_number END AS catalog_number,
        CASE row_index % 6 WHEN 2 THEN catalog_number WHEN 3 THEN course_title || chr(65533) WHEN 4 THEN course_title || '  x' WHEN 5 THEN subject_code || ' ' || catalog_number || course_title ELSE course_title END AS course_title
    FROM courses WHERE dataset_id = 'prt'
), ok AS (SELECT * FROM rec WHERE subject_code <> ''),
hits AS (
    SELECT *, [
        CASE WHEN (length(subject_code) >= 2 AND strlen(catalog_number) > strlen(subject_code) AND starts_with(lower(catalog_number), lower(subject_code))) OR regexp_matches(catalog_number, '^[A-Za-z]{2,}[ -]?[0-9]') THEN 'catalog_has_subject_prefix' END,
        CASE WHEN regexp_matches(subject_code, '[0-9]{2}') THEN 'subject_has_number' END,
        CASE WHEN regexp_matches(catalog_number, '^[0-9]+\\.0+$|^[0-9]+(\\.[0-9]+)?[eE][+-]?[0-9]+$') THEN 'catalog_numeric_coerced' END,
        CASE WHEN NOT regexp_matches(catalog_number, '[0-9]') THEN 'catalog_no_digits' END,
        CASE WHEN regexp_matches(catalog_number, '\\s') THEN 'catalog_has_whitespace' END,
        CASE WHEN length(catalog_number) > 8 THEN 'catalog_too_long' END,
        CASE WHEN length(subject_code) > 8 THEN 'subject_too_long' END,
        CASE WHEN NOT regexp_matches(course_title, '\\p{L}') THEN 'title_no_letters' END,
        CASE WHEN length(course_title) > 100 THEN 'title_too_long' END,
        CASE WHEN starts_with(lower(course_title), lower(subject_code || ' ' || catalog_number)) THEN 'title_repeats_code' END,
        CASE WHEN length(course_title) <= 3 THEN 'title_short' END,
        CASE WHEN length(catalog_number) <= 2 THEN 'catalog_short' END,
        CASE WHEN regexp_matches(subject_code, '\\p{Ll}') THEN 'subject_lowercase' END,
        CASE WHEN regexp_matches(course_title, '\\p{Ll}') THEN 'title_mixed_case' END,
        CASE WHEN contains(subject_code || catalog_number || course_title, chr(65533)) THEN 'encoding_damage' END,
        CASE WHEN regexp_matches(subject_code, '  |[\\t\\r\\n]') OR regexp_matches(catalog_number, '  |[\\t\\r\\n]') OR regexp_matches(course_title, '  |[\\t\\r\\n]') THEN 'inner_whitespace_runs' END
    ] AS codes FROM ok
), fired AS (SELECT row_index, subject_code || ' ' || catalog_number || ' --- ' || course_title AS input, unnest(list_filter(codes, lambda c: c IS NOT NULL)) AS code FROM hits),
lf AS (SELECT row_index, unnest(['subject', 'catalog', 'title']) AS field, unnest([subject_code, catalog_number, course_title]) AS value, subject_code <> '' AS importable FROM rec),
chk AS (SELECT * FROM (VALUES
    (0, 'catalog_has_subject_prefix', 'catalog', 'warning', 0.05),
    (1, 'subject_has_number', 'subject', 'warning', 0.05),
    (2, 'catalog_numeric_coerced', 'catalog', 'warning', 0.01),
    (3, 'catalog_no_digits', 'catalog', 'warning', 0.05),
    (4, 'catalog_has_whitespace', 'catalog', 'warning', 0.05),
    (5, 'catalog_too_long', 'catalog', 'warning', 0.05),
    (6, 'catalog_low_cardinality', 'catalog', 'warning', NULL),
    (7, 'subject_too_long', 'subject', 'warning', 0.05),
    (8, 'subject_high_cardinality', 'subject', 'warning', NULL),
    (9, 'title_no_letters', 'title', 'warning', 0.05),
    (10, 'title_too_long', 'title', 'warning', 0.05),
    (11, 'title_repeats_code', 'title', 'warning', 0.05),
    (12, 'title_short', 'title', 'warning', 0.1),
    (13, 'catalog_short', 'catalog', 'info', 0.05),
    (14, 'subject_lowercase', 'subject', 'info', 0.5),
    (15, 'title_mixed_case', 'title', 'info', 0.5),
    (16, 'encoding_damage', 'row', 'info', 0.0),
    (17, 'inner_whitespace_runs', 'row', 'info', 0.01)
) AS t(position, code, field, severity, threshold)),
counts AS (
    SELECT chk.*, n, CASE WHEN threshold IS NOT NULL THEN (SELECT count(*) FROM fired WHERE fired.code = chk.code)
        WHEN n < 1000 THEN 0 WHEN chk.code = 'catalog_low_cardinality' THEN CASE WHEN k_cat <= 5 THEN k_cat ELSE 0 END ELSE CASE WHEN k_sub > 0.5 * n THEN k_sub ELSE 0 END END AS count
    FROM chk, (SELECT count(*) AS n FROM ok), (SELECT count(DISTINCT value) AS k_cat FROM lf WHERE field = 'catalog' AND value <> ''), (SELECT count(DISTINCT value) AS k_sub FROM lf WHERE field = 'subject' AND value <> '')
)
"""


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    i, (s, c, t) = F.col("row_index") % 6, (F.col(f) for f in FIELDS)
    raw = views.dataset(spark, sf, "prt").select(
        "row_index",
        F.when(F.col("row_index") % 11 == 0, F.lit(" ")).otherwise(s).alias("subject_code"),
        F.when(i == 0, F.concat(c, F.lit(".0"))).when(i == 1, F.concat(s, F.lit(" "), c)).otherwise(c).alias("catalog_number"),
        F.when(i == 2, c).when(i == 3, F.concat(t, F.lit("�"))).when(i == 4, F.concat(t, F.lit("  x "))).when(i == 5, F.concat(s, F.lit(" "), c, t)).otherwise(t).alias("course_title"),
    )
    return profiling.prepared(raw)


@query(DAMAGED_SQL + "SELECT position, code, CAST(count AS BIGINT) AS count FROM counts")
def profile_checks(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.check_counts(_damaged(spark, sf)).select("position", "code", "count")


@query(DAMAGED_SQL + "SELECT code, field, severity, CAST(count AS BIGINT) AS count, round(CASE WHEN threshold IS NULL THEN 0 ELSE count / n END, 6) AS rate FROM counts WHERE count > 0 AND (threshold IS NULL OR count / n >= threshold)")
def profile_findings(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.findings(_damaged(spark, sf)).withColumn("rate", F.round("rate", 6))


@query(DAMAGED_SQL + "SELECT field, CAST(count(CASE WHEN value = '' THEN 1 END) AS BIGINT) AS empty, count(DISTINCT CASE WHEN value <> '' THEN value END) AS \"distinct\", false AS distinct_capped FROM lf GROUP BY 1")
def profile_tally(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.tallies(_damaged(spark, sf))


@query(DAMAGED_SQL + "SELECT field, CAST(rank AS INTEGER) AS rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM (SELECT field, value, count(*) AS n FROM lf WHERE value <> '' GROUP BY 1, 2)) WHERE rank <= 10")
def profile_top_values(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.top_values(_damaged(spark, sf))


LENGTHS_SQL = "SELECT field, CAST(min(len) AS INTEGER) AS len_min, CAST(quantile_disc(len, 0.5) AS INTEGER) AS len_median, CAST(max(len) AS INTEGER) AS len_max FROM (SELECT field, least(length(value), 255) AS len FROM {lf}) GROUP BY 1"


@query(DAMAGED_SQL + LENGTHS_SQL.format(lf="lf WHERE importable"))
def profile_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.lengths(_damaged(spark, sf))


@query("WITH lf AS (SELECT unnest(['subject', 'catalog', 'title']) AS field, unnest([lang, source, text]) AS value FROM documents WHERE length(trim(text)) > 0) " + LENGTHS_SQL.format(lf="lf"), plain=True)
def profile_document_lengths(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("row_index"), F.col("lang").alias("subject_code"), F.col("source").alias("catalog_number"), F.col("text").alias("course_title"))
    return profiling.lengths(profiling.prepared(docs))


SHAPE_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({v}, '[0-9]', '\U0001F600', 'g'), '\\p{{Lu}}', '\U0001F601', 'g'), '\\p{{Ll}}', '\U0001F602', 'g'), '[\\s_]', '\U0001F603', 'g')"


def _shape_sql() -> str:
    out = SHAPE_SQL.format(v="value")
    for mark, kind in zip("\U0001F600\U0001F601\U0001F602\U0001F603", "9Aa_"):
        out = f"replace(regexp_replace({out}, '{mark}{{2,}}', '{kind}' || '+', 'g'), '{mark}', '{kind}')"
    return out


@query(DAMAGED_SQL + f"SELECT field, CAST(rank AS INTEGER) AS rank, shape, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, shape) AS rank FROM (SELECT field, {_shape_sql()} AS shape, count(*) AS n FROM lf WHERE importable GROUP BY 1, 2)) WHERE rank <= 8")
def profile_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.top_shapes(_damaged(spark, sf))


@query(DAMAGED_SQL + "SELECT count(*) AS rows, count(CASE WHEN subject_code <> '' THEN 1 END) AS importable, count(CASE WHEN subject_code = '' THEN 1 END) AS skipped, count(CASE WHEN subject_code = '' THEN 1 END) AS skipped_subject, CAST(0 AS BIGINT) AS skipped_catalog, CAST(0 AS BIGINT) AS skipped_title FROM rec")
def profile_skips(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.skips(_damaged(spark, sf))


@query(DAMAGED_SQL + ", e AS (SELECT * FROM fired UNION ALL SELECT row_index, subject_code || ' ' || catalog_number || ' --- ' || course_title, 'skipped' FROM rec WHERE subject_code = '') SELECT code, CAST(rank AS INTEGER) AS rank, \"row\", input FROM (SELECT code, row_number() OVER (PARTITION BY code ORDER BY row_index) AS rank, row_index + 2 AS \"row\", substr(input, 1, 200) AS input FROM e) WHERE rank <= 10")
def profile_examples(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.examples(_damaged(spark, sf))


@query()
def profile_samples(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.samples(_damaged(spark, sf))


MERGED_LF = "lf AS (SELECT unnest(['subject', 'catalog', 'title']) AS field, unnest([subject_code, catalog_number, course_title]) AS value FROM courses WHERE dataset_id IN ('prt', 'cus'))"


@query(f"""
, {MERGED_LF}, top AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM (SELECT field, value, count(*) AS n FROM lf GROUP BY 1, 2)),
shape AS (SELECT field, least(count(DISTINCT value), {profiling.DISTINCT_CAP}) AS "distinct", CAST(quantile_disc(least(length(value), 255), 0.5) AS BIGINT) AS len_median FROM lf GROUP BY 1)
SELECT field, CAST(rank AS BIGINT) AS rank, value, n, "distinct", len_median FROM top JOIN shape USING (field) WHERE rank <= 10
""")
def profile_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of the stored profile of the parts and customers merged, which is put together from the states of theirs; a profile tells no more than DISTINCT_CAP distinct values."""
    store = Store(spark, shared_path(spark, "store"))
    for name in ("prt", "cus"):
        path = shared_path(spark, f"csv-{name}")
        export.write_csv(("sub_pref", "course", "course_title"), views.dataset(spark, sf, name).orderBy("row_index").select(*FIELDS), path)
        importing.import_csv(spark, store, path, name, name)
    derive.materialize(store, DeriveRequest(("prt", "cus")), "both", "Both")
    told = store.profile("both")
    rows = [(f, r["rank"], r["value"], r["n"], told["columns"][f]["distinct"], told["fields"][f]["len_median"]) for f in told["columns"] for r in told["columns"][f]["top"]]
    return spark.createDataFrame(rows, "field string, rank long, value string, n long, `distinct` long, len_median long")


# --- taxonomy -------------------------------------------------------------------------------------------------------


@query("SELECT CAST(digit_level AS TINYINT) AS digit_level, code, title, title_short, description FROM tax")
def taxonomy_list(spark: SparkSession, sf: str) -> DataFrame:
    return tax.listed(views.taxonomy(spark, sf))


@query("SELECT code, title FROM tax WHERE starts_with(replace(code, '.', ''), '020') AND contains(lower(title) || chr(10) || lower(coalesce(description, '')), 'nation_1') ORDER BY code LIMIT 200")
def taxonomy_search(spark: SparkSession, sf: str) -> DataFrame:
    return tax.search(views.taxonomy(spark, sf), "02.0  NATION_1").select("code", "title")


@query("SELECT '02' AS of, code, title FROM tax WHERE digit_level = 6 AND starts_with(code, '02.') UNION ALL SELECT '03.0002', code, title FROM tax WHERE digit_level = 6 AND starts_with(code, '03.00') AND code <> '03.0002'")
def taxonomy_related(spark: SparkSession, sf: str) -> DataFrame:
    entries = views.taxonomy(spark, sf)
    one = lambda code: tax.related(entries, code).select(F.lit(code).alias("of"), "code", "title")
    return one("02").unionByName(one("03.0002"))


# --- evaluation -----------------------------------------------------------------------------------------------------

# Truth: bare digits without leading zeros, wrong for a fifth and missing for a tenth of the records.
TRUTH_SQL = """
, labelled AS (
    SELECT c.row_index, six AS predicted, CASE WHEN c.row_index % 10 = 9 THEN '' WHEN c.row_index % 5 = 0 THEN '990000' ELSE CAST(CAST(replace(six, '.', '') AS INTEGER) AS VARCHAR) END AS truth
    FROM courses c JOIN coded USING (content_hash) WHERE dataset_id = 'ord'
)
"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.broadcast_back(views.dataset(spark, sf, "ord"), views.results(spark, sf).filter("model_id = 6").select("content_hash", F.col("classification").alias("predicted")))
    digits = F.replace(F.col("predicted"), F.lit("."), F.lit("")).cast("int").cast("string")
    return rows.select("row_index", "predicted", F.when(F.col("row_index") % 10 == 9, "").when(F.col("row_index") % 5 == 0, "990000").otherwise(digits).alias("truth"))


@query(TRUTH_SQL + "SELECT count(CASE WHEN truth <> '' THEN 1 END) AS compared, count(CASE WHEN truth NOT IN ('', '990000') THEN 1 END) AS matched, count(CASE WHEN truth = '' THEN 1 END) AS skipped, round(count(CASE WHEN truth NOT IN ('', '990000') THEN 1 END) / count(CASE WHEN truth <> '' THEN 1 END), 6) AS rate FROM labelled")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.agreement(_labelled(spark, sf), "predicted", "truth", 6).withColumn("rate", F.round("rate", 6))


@query(TRUTH_SQL + "SELECT row_index, predicted, truth, CAST(predicted AS DOUBLE) AS predicted_number, CAST(99 AS DOUBLE) AS truth_number FROM labelled WHERE truth = '990000'")
def disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.disagreements(_labelled(spark, sf), "predicted", "truth", 6)


LI_SQL = "SELECT count(*) AS total, count(DISTINCT content_hash) AS \"distinct\" FROM (SELECT sha256(p_type || ' ' || CAST(p_size AS VARCHAR) || ' --- ' || p_name) AS content_hash FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"SELECT total, \"distinct\", round(1 - \"distinct\" / total, 6) AS ratio FROM ({LI_SQL})", plain=True)
def dedup_ratio(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part").select("p_partkey", text.content_hash(F.col("p_type"), F.col("p_size").cast("string"), F.col("p_name")).alias("content_hash"))
    rows = views.table(spark, sf, "lineitem").select("l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return evaluate.dedup_ratio(rows).select(*long("total", "distinct"), F.round("ratio", 6).alias("ratio"))


FORMS_SQL = """
, forms AS (
    SELECT row_index, unnest([
        ['baseline', s, c, t], ['subject repeated in catalog (`PSYC 4325`)', s, s || ' ' || c, t], ['subject repeated in catalog, no space (`PSYC4325`)', s, s || c, t], ['full code in both subject and catalog', s || ' ' || c, s || ' ' || c, t],
        ['catalog as converted number (`4325.0`)', s, c || '.0', t], ['catalog letters stripped (`4304L` -> `4304`)', s, regexp_replace(c, '[^0-9]', '', 'g'), t], ['catalog missing', s, '', t], ['subject missing', '', c, t],
        ['title missing', s, c, ''], ['title only', '', '', t], ['subject and catalog swapped', c, s, t], ['title in the catalog column', s, t, c], ['catalog is a year (`2024`)', s, '2024', t],
        ['subject lowercased', lower(s), c, t],
        ['title in Title Case', s, c, array_to_string(list_transform(string_split(t, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')],
        ['title lowercased', s, c, lower(t)], ['trailing whitespace kept', s || '  ', c || '   ', t || '    '], ['title prefixed with the code', s, c, s || ' ' || c || ' ' || t]]) AS form
    FROM (SELECT row_index, subject_code AS s, catalog_number AS c, course_title AS t FROM courses WHERE dataset_id = 'prt')
), told AS (
    SELECT row_index, form[1] AS variant, sha256(form[2] || ' ' || form[3] || ' --- ' || form[4]) AS h FROM forms
), p AS (
    SELECT row_index, variant, lpad(CAST(strpos('0123456789abcdef', substr(h, 1, 1)) AS VARCHAR), 2, '0') AS code, strpos('0123456789abcdef', substr(h, 2, 1)) / 16.0 AS prob,
        row_index % 16 + 1 AS truth FROM told
)
"""


@query(FORMS_SQL + """
SELECT p.variant, count(*) AS n, round(avg(CASE WHEN p.code <> b.code THEN 1.0 ELSE 0.0 END), 6) AS flip_rate, round(avg(p.prob), 6) AS mean_prob,
    round(avg(CASE WHEN CAST(p.code AS INTEGER) = p.truth THEN 1.0 ELSE 0.0 END), 6) AS agreement
FROM p JOIN p b ON b.row_index = p.row_index AND b.variant = 'baseline' GROUP BY 1
""")
def sensitivity_flips(spark: SparkSession, sf: str) -> DataFrame:
    forms = evaluate.perturbed(views.dataset(spark, sf, "prt")).withColumn("h", F.sha2("input", 256))
    digit = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring("h", at, 1))
    code, truth = F.lpad(digit(1).cast("string"), 2, "0"), (F.col("row_index") % 16 + 1).cast("string")
    told = forms.select("row_index", "variant", code.alias("code"), (digit(2) / 16.0).alias("prob"), truth.alias("truth"))
    found = evaluate.sensitivity(told, level=2)
    return found.withColumns({c: F.round(c, 6) for c in ("flip_rate", "mean_prob", "agreement")})


@query("""
WITH x AS (SELECT vec_id, unnest(embedding) AS z, unnest(range(len(embedding))) AS i FROM embeddings),
y AS (SELECT vec_id, i, CAST(z AS DOUBLE) AS a, CAST(CASE WHEN vec_id % 3 = 0 THEN -CAST(z AS DOUBLE) ELSE CAST(z AS DOUBLE) + vec_id % 3 * 1e-6 END AS FLOAT) AS b FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, i) AS ra, row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, i) AS rb FROM y),
v AS (
    SELECT vec_id, max(CASE WHEN ra = 1 THEN i END) = max(CASE WHEN rb = 1 THEN i END) AS same, sum(CASE WHEN ra <= 3 AND rb <= 3 THEN 1 ELSE 0 END) = 3 AS same3, max(abs(a - b)) AS most
    FROM r GROUP BY 1
)
SELECT count(*) AS n, round(avg(CAST(same AS INTEGER)), 3) AS argmax_rate, round(avg(CAST(same3 AS INTEGER)), 3) AS top3_rate, round(max(most), 4) AS max_diff,
    avg(CAST(same AS INTEGER)) >= 0.95 AND max(most) <= 1e-3 AS passed FROM v
""", plain=True)
def parity(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.transform("logits", lambda z: F.when(F.col("vec_id") % 3 == 0, -z.cast("double")).otherwise(z.cast("double") + F.col("vec_id") % 3 * F.lit(1e-6)).cast("float"))
    a = _vectors(spark, sf)
    found = evaluate.parity(a, a.select("vec_id", moved.alias("logits")), "vec_id")
    return found.select("n", F.round("argmax_rate", 3).alias("argmax_rate"), F.round("top3_rate", 3).alias("top3_rate"), F.round("max_diff", 4).alias("max_diff"), "passed")


@query("SELECT round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders", plain=True)
def latency(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.latency(views.table(spark, sf, "orders"), "o_totalprice")
    return found.select(F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query()
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.sampled(views.dataset(spark, sf, "ev").drop("extra_columns"), "row_index", 500, 114)


@query("SELECT DISTINCT content_hash FROM courses WHERE dataset_id = 'ord'")
def distinct_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return export.unique_rows(views.dataset(spark, sf, "ord")).select("content_hash")


# --- maintenance ----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(CASE WHEN model_id NOT IN (2, 4) THEN 1 END) AS superseded, count(CASE WHEN content_hash NOT IN (SELECT content_hash FROM courses WHERE dataset_id IN ('ev', 'ord')) THEN 1 END) AS unreferenced FROM res")
def cache_usage(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.cache_usage(views.results(spark, sf), views.courses(spark, sf, "ev", "ord"), [2, 4])


@query("SELECT model_id, content_hash, classification FROM res WHERE model_id IN (2, 4)")
def prune_superseded(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.without_superseded(views.results(spark, sf), [2, 4]).select("model_id", "content_hash", "classification")


@query("SELECT model_id, content_hash, classification FROM res WHERE content_hash IN (SELECT content_hash FROM courses WHERE dataset_id IN ('ev', 'ord'))")
def prune_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.without_unreferenced(views.results(spark, sf), views.courses(spark, sf, "ev", "ord")).select("model_id", "content_hash", "classification")


@query("SELECT count(*) AS rows_a, count(CASE WHEN o_orderkey % 100 <> 0 THEN 1 END) AS rows_b, count(CASE WHEN o_orderkey % 100 = 0 THEN 1 END) AS only_a, CAST(0 AS BIGINT) AS only_b, count(CASE WHEN o_orderkey % 100 = 0 THEN 1 END) = 0 AS equal FROM orders", plain=True)
def tables_equal(spark: SparkSession, sf: str) -> DataFrame:
    a = views.table(spark, sf, "orders")
    return maintenance.tables_equal(a, a.filter("o_orderkey % 100 <> 0"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", plain=True)
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.latest_per(views.table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS place, event_id FROM events", plain=True)
def global_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.numbered(views.table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"], "place").select("place", "event_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
