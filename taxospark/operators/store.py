"""Where datasets and results live: Parquet, records by dataset_id and results by model_id, metadata as small tables.

Nothing that is read is ever changed in place. A small table is a folder of numbered versions, of which the last complete
one counts; records and results are folders of their own, which count once a small table names them. So a writer that is
lost leaves what was there before, and opening a store changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from datetime import datetime
from pathlib import Path
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxospark.operators.profiling import State, stored_state
from taxospark.operators.shared import observed, shared_path
from taxospark.schemas import COURSES, RESULTS, ColumnMap, DeriveRequest, FilterRow, FilterSpec, Layout, Op, OutputColumn, Source, SpecError

DATASETS = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("id", "title", "source_kind", "source_file_id", "import_state", "import_error", "classify_state", "layout", "derivation", "profile")),
        T.StructField("row_count", T.LongType()),
        T.StructField("imported_at", T.TimestampType()),
    ]
)
SOURCES = T.StructType([*(T.StructField(c, T.StringType()) for c in ("dataset_id", "source_dataset_id", "source_title")), T.StructField("position", T.IntegerType())])
#: A dataset's records: the folder of their version, how many there are and the last one's row_index.
VERSIONS = T.StructType([*(T.StructField(c, T.StringType()) for c in ("dataset_id", "version")), *(T.StructField(c, T.LongType()) for c in ("rows", "last"))])
#: A model's results: the folder of their version, its buckets, and how often rows were added to it.
MODELS = T.StructType([T.StructField("model_id", T.LongType()), T.StructField("version", T.StringType()), T.StructField("buckets", T.IntegerType()), T.StructField("appends", T.IntegerType())])
FILES = T.StructType([T.StructField("id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType())])


def layout_text(layout: Layout) -> str:
    return json.dumps({"headers": layout.headers, "mapping": layout.mapping.positions()})


def layout_of(text: str | None) -> Layout | None:
    if not text:
        return None
    told = json.loads(text)
    return Layout(tuple(told["headers"]), ColumnMap(*told["mapping"]))


def request_text(request: DeriveRequest) -> str:
    return json.dumps(asdict(request))


def request_of(text: str) -> DeriveRequest:
    told = json.loads(text)
    rows = tuple(FilterRow(r["field"], Op(r["op"]), tuple(r["values"])) for r in told["filter"]["rows"])
    columns = tuple(OutputColumn(c["name"], tuple((s, at) for s, at in c["origins"])) for c in told["columns"])
    dedupe = None if told["dedupe"] is None else tuple(told["dedupe"])
    return DeriveRequest(tuple(told["sources"]), columns, FilterSpec(rows), tuple(told["names"]), dedupe)


#: What a scoring run of a level lacked when it began, and how many distinct texts it had done at a time.
RUN_LOG = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("run", "dataset_id")),
        T.StructField("level", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in ("total", "missing_rows", "missing_unique", "done")),
        T.StructField("at", T.TimestampType()),
    ]
)
TABLES = {"datasets": DATASETS, "dataset_sources": SOURCES, "source_files": FILES, "course_versions": VERSIONS, "models": MODELS}
#: Versions of a small table that stay for readers who have just looked.
KEPT = 4
#: Seconds after which a lock counts as a lost writer's, and for which a writer of a small table waits for one.
LOCK_AGE, LOCK_WAIT = 3600, 60
#: Rows of results in a bucket, about, buckets at least, and files in a bucket at most before a model's results are laid out anew.
BUCKET_ROWS, LEAST_BUCKETS, MOST_FILES = 250_000, 8, 8
#: Bytes of a row group and rows of a page, by which Parquet's indexes let a reader pass over records.
ROW_GROUP, PAGE_ROWS = 16 << 20, 2000


class Store:
    """A folder with courses/version=*/dataset_id=*, results/<model>/<version>, and the small tables that name what counts.

    Writers of one table take turns by a lock, a file that only one of them can make. What is replaced goes after what
    replaces it is named; `sweep` removes what lost writers left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Of versions that this store wrote: their rows and last row_index.
        self.written: dict[str, tuple[int, int | None]] = {}

    def _at(self, name: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return there, there.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        there, fs = self._at(folder)
        return sorted(e.getPath().getName() for e in fs.listStatus(there)) if fs.exists(there) else []

    def _remove(self, name: str) -> None:
        there, fs = self._at(name)
        fs.delete(there, True)

    def _made(self, there, fs) -> bool:
        """Whether a file was made that wasn't there. On a local disk, where Hadoop looks first and then makes it, in one step."""
        if fs.getUri().getScheme() == "file":
            path = Path(there.toUri().getPath())
            path.parent.mkdir(parents=True, exist_ok=True)
            try:
                path.touch(exist_ok=False)
            except FileExistsError:
                return False
            return True
        try:
            return fs.createNewFile(there)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise

    @contextmanager
    def locked(self, name: str, wait: float = LOCK_WAIT) -> Iterator[None]:
        """Holds a lock; another holder is waited for, and one older than LOCK_AGE is lost. Raises SpecError after the wait."""
        there, fs = self._at(f"locks/{name}")
        until = time.monotonic() + wait
        while not self._made(there, fs):
            try:
                lost = time.time() - fs.getFileStatus(there).getModificationTime() / 1000 > LOCK_AGE
            except Py4JJavaError:  # released meanwhile
                continue
            if lost:
                fs.delete(there, False)
            elif time.monotonic() > until:
                raise SpecError(f"{name} is busy: another writer holds it")
            else:
                time.sleep(0.1)
        try:
            yield
        finally:
            fs.delete(there, False)

    def is_locked(self, name: str) -> bool:
        there, fs = self._at(f"locks/{name}")
        return fs.exists(there)

    def _versions(self, table: str) -> tuple[list[str], list[str]]:
        """All versions of a small table, and the complete ones, in order."""
        found = self._names(table)
        return found, [v for v in found if "_SUCCESS" in self._names(f"{table}/{v}")]

    def _table(self, table: str) -> DataFrame:
        complete = self._versions(table)[1]
        if not complete:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/{complete[-1]}")

    def edit(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Writes a small table's next version, made from the last one; no other writer comes between.

        Where a file system lets two writers have one lock, the later one finds its version taken, and starts again.
        """
        with self.locked(table):
            for again in range(5):
                found, complete = self._versions(table)
                n = int(found[-1]) + 1 if found else 0
                try:
                    change(self._table(table)).coalesce(1).write.parquet(f"{self.path}/{table}/{n:012d}")
                    break
                except AnalysisException as error:
                    if again == 4 or error.getCondition() != "PATH_ALREADY_EXISTS":
                        raise
            for old in found:
                if complete and old < complete[-1] and old not in complete[1 - KEPT :]:
                    self._remove(f"{table}/{old}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """Swaps a small table for rows, which may be made from it."""
        self.edit(table, lambda _: rows)

    def datasets(self) -> DataFrame:
        return self._table("datasets")

    def dataset_sources(self) -> DataFrame:
        return self._table("dataset_sources")

    def source_files(self) -> DataFrame:
        return self._table("source_files")

    def sources(self) -> dict[str, Source]:
        """Every dataset as queries, exports and derivations take it: with its layout as it was stored."""
        rows = self.datasets().select("id", "title", "layout", F.coalesce("import_state", F.lit("ready")).alias("state")).collect()
        return {r["id"]: Source(r["id"], r["title"] or "", layout_of(r["layout"]), r["state"]) for r in rows}

    def derivation(self, dataset_id: str) -> DeriveRequest | None:
        """What a derived dataset was made of; None for an imported or unknown one."""
        row = self.datasets().filter((F.col("id") == dataset_id) & F.col("derivation").isNotNull()).select("derivation").first()
        return request_of(row[0]) if row else None

    def profile(self, dataset_id: str) -> dict | None:
        """The profile that was stored with a dataset's records; None for an unknown one, and one without."""
        row = self.datasets().filter((F.col("id") == dataset_id) & F.col("profile").isNotNull()).select("profile").first()
        return json.loads(row[0]) if row else None

    def profile_folder(self, version: str) -> str:
        """Where the state of the profile of a version's records is."""
        return f"{self.path}/profiles/{version}"

    def profile_state(self, dataset_id: str) -> State | None:
        """The state that a dataset's profile was made from; None where none was stored, or of other records than those that are stored."""
        mine = self._table("course_versions").filter(F.col("dataset_id") == dataset_id).select("version", "rows").first()
        if mine is None or "_SUCCESS" not in self._names(f"profiles/{mine['version']}/marks"):
            return None
        found = stored_state(self.spark, self.profile_folder(mine["version"]))
        return found if found.marks["skips"]["importable"] == mine["rows"] else None

    # --- records ----------------------------------------------------------------------------------------------------

    def courses(self, *ids: str) -> DataFrame:
        """The records of the datasets that are named, or of all."""
        named = self._table("course_versions").filter("rows > 0")
        named = (named.filter(F.col("dataset_id").isin(*ids)) if ids else named).select("dataset_id", "version").collect()
        if not named:
            return self.spark.createDataFrame([], COURSES)
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        schema = T.StructType([*COURSES.fields, T.StructField("version", T.StringType())])
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/courses")
        return read.parquet(*(f"{self.path}/courses/version={r['version']}/dataset_id={escaped(r['dataset_id'])}" for r in named)).select(*COURSES.names)

    def last_row(self, dataset_id: str) -> int | None:
        """The row_index of a dataset's last record; None without records."""
        row = self._table("course_versions").filter(F.col("dataset_id") == dataset_id).agg(F.max("last")).first()
        return row[0]

    def stored(self, version: str) -> DataFrame:
        """The records of a version, whether they count or not."""
        return self.spark.read.schema(COURSES).parquet(f"{self.path}/courses/version={version}").select(*COURSES.names)

    def store_courses(self, rows: DataFrame) -> str:
        """Writes records that don't count yet, and returns their version. Within files they are in order, and indexed by it.

        A version has the records of one dataset or of several, each in a folder of its own.
        """
        version, seen = uuid.uuid4().hex, Observation()
        counted = rows.select(*COURSES.names).observe(seen, F.count("*").alias("rows"), F.max("row_index").alias("last"))
        writer = counted.sortWithinPartitions("dataset_id", "row_index").write.partitionBy("dataset_id")
        writer.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/courses/version={version}")
        told = observed(seen)
        self.written[version] = (told.get("rows", 0), told.get("last"))
        return version

    def discard_courses(self, version: str) -> None:
        """Removes records that don't count."""
        self._remove(f"courses/version={version}")
        self._remove(f"profiles/{version}")

    def name_courses(self, dataset_id: str, version: str | None) -> None:
        """From now on the version's records are the dataset's, in place of any others; None: it has none."""
        named = self._table("course_versions")
        before = [r[0] for r in named.filter(F.col("dataset_id") == dataset_id).select("version").collect()]
        new = self.spark.createDataFrame([(dataset_id, version, *self.written[version])] if version else [], VERSIONS)
        self.edit("course_versions", lambda t: t.filter(F.col("dataset_id") != dataset_id).unionByName(new))
        for old in before:
            if old != version and self._table("course_versions").filter(F.col("version") == old).isEmpty():
                self.discard_courses(old)

    def write_courses(self, rows: DataFrame) -> None:
        """Replaces the datasets that rows belong to; others stay."""
        version = self.store_courses(rows)
        for name, *size in self.stored(version).groupBy("dataset_id").agg(F.count("*"), F.max("row_index")).collect():
            self.written[version] = tuple(size)
            self.name_courses(name, version)

    # --- results ----------------------------------------------------------------------------------------------------

    def _name(self, model_id: int, version: str) -> str:
        return f"taxospark_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{str(model_id).replace('-', 'm')}_{version}"

    def _registered(self, model_id: int, version: str, buckets: int) -> str:
        """The catalog's name for a version of a model's results, a bucketed table over its folder."""
        name = self._name(model_id, version)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESULTS if f.name != "model_id")
        if not self.spark.catalog.tableExists(name):
            folder = f"{self.path}/results/{model_id}/{version}"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (content_hash) SORTED BY (content_hash) INTO {buckets} BUCKETS LOCATION '{folder}'")
        else:
            self.spark.catalog.refreshTable(name)
        return name

    def results(self) -> DataFrame:
        """All models' results. A filter on model_id leaves that model's table, which is bucketed by content_hash, so that joins by it don't shuffle it."""
        found = []
        for r in self._table("models").orderBy("model_id").collect():
            rows = self.spark.table(self._registered(r["model_id"], r["version"], r["buckets"]))
            found.append(rows.select(F.lit(r["model_id"]).cast("long").alias("model_id"), *(c for c in RESULTS.names if c != "model_id")))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], RESULTS)

    def append_results(self, rows: DataFrame, model_id: int | None = None) -> None:
        """Adds results; of one model, if its id is given, without looking at the rows twice. Those of several are made once and written by model first."""
        if model_id is None:
            path = shared_path(self.spark, "results")
            rows.write.partitionBy("model_id").parquet(path)
            rows = self.spark.read.schema(rows.schema).parquet(path)
            sizes = {r["model_id"]: r["n"] for r in rows.groupBy("model_id").agg(F.count("*").alias("n")).collect()}
        else:
            sizes = {model_id: 0}
        for m, n in sorted(sizes.items()):
            with self.locked(f"results-{m}"):
                entry = self._table("models").filter(F.col("model_id") == m).first()
                version, buckets, appends = (entry["version"], entry["buckets"], entry["appends"]) if entry else (uuid.uuid4().hex, self._buckets(n), 0)
                name = self._registered(m, version, buckets)
                self._insert(rows.filter(F.col("model_id") == m), name, buckets)
                self._name_results(m, version, buckets, appends + 1)
                size = self.spark.table(name).count()
                if size > 4 * BUCKET_ROWS * buckets or appends + 1 >= MOST_FILES:
                    self._lay_out(m, self.spark.table(name), self._buckets(size))

    def _buckets(self, size: int) -> int:
        return max(LEAST_BUCKETS, -(-size // BUCKET_ROWS))

    def _insert(self, rows: DataFrame, name: str, buckets: int) -> None:
        own = rows.select(*(c for c in RESULTS.names if c != "model_id"))
        own.repartition(buckets, "content_hash").write.insertInto(name)

    def _name_results(self, model_id: int, version: str | None, buckets: int = 0, appends: int = 0) -> None:
        new = self.spark.createDataFrame([(model_id, version, buckets, appends)] if version else [], MODELS)
        self.edit("models", lambda t: t.filter(F.col("model_id") != model_id).unionByName(new))

    def _lay_out(self, model_id: int, rows: DataFrame, buckets: int) -> None:
        """Writes a model's results anew, a sorted file a bucket; the lock on them is held."""
        old = self._table("models").filter(F.col("model_id") == model_id).first()
        version = uuid.uuid4().hex
        self._insert(rows, self._registered(model_id, version, buckets), buckets)
        self._name_results(model_id, version, buckets, 1)
        for found in self._names(f"results/{model_id}"):
            if found not in (version, old["version"]):  # the last one stays for those who read it just now
                self._forget(model_id, found)

    def _forget(self, model_id: int, version: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(model_id, version)}")
        self._remove(f"results/{model_id}/{version}")

    def rewrite_results(self, model_id: int, rows: DataFrame) -> None:
        """Replaces a model's results by rows, which may be made from them."""
        with self.locked(f"results-{model_id}"):
            entry = self._table("models").filter(F.col("model_id") == model_id).first()
            self._lay_out(model_id, rows, entry["buckets"])

    def drop_results(self, model_id: int) -> None:
        """Removes a model's results; nothing if there are none."""
        with self.locked(f"results-{model_id}"):
            entry = self._table("models").filter(F.col("model_id") == model_id).first()
            if entry:
                self._name_results(model_id, None)
                for version in self._names(f"results/{model_id}"):
                    self._forget(model_id, version)

    # --- entries ----------------------------------------------------------------------------------------------------

    def add_dataset(self, **values) -> None:
        """Adds a dataset's entry, in place of one with its id."""
        row = {f.name: values.get(f.name) for f in DATASETS}
        new = self.spark.createDataFrame([row], DATASETS)
        self.edit("datasets", lambda t: t.filter(F.col("id") != row["id"]).unionByName(new))

    def update_dataset(self, dataset_id: str, **values) -> None:
        """Sets values of a dataset's entry; an unknown dataset is left unknown."""
        mine = F.col("id") == dataset_id
        changed = {c: F.when(mine, (v if isinstance(v, Column) else F.lit(v)).cast(DATASETS[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
        self.edit("datasets", lambda t: t.withColumns(changed))

    def set_sources(self, dataset_id: str, sources: list[Source]) -> None:
        """Replaces what is known of a derived dataset's sources."""
        new = self.spark.createDataFrame([(dataset_id, s.id, s.title, i) for i, s in enumerate(sources)], SOURCES)
        self.edit("dataset_sources", lambda t: t.filter(F.col("dataset_id") != dataset_id).unionByName(new))

    def add_file(self, file_id: str, path: str, size: int) -> None:
        new = self.spark.createDataFrame([(file_id, path, size)], FILES)
        self.edit("source_files", lambda t: t.filter(F.col("id") != file_id).unionByName(new))

    def sweep(self) -> None:
        """Removes locks and folders that lost writers left. Only for when nothing writes to the store."""
        self._remove("locks")
        named = {r[0] for r in self._table("course_versions").select("version").collect()}
        for folder in self._names("courses"):
            if folder.removeprefix("version=") not in named:
                self._remove(f"courses/{folder}")
        for version in self._names("profiles"):
            if version not in named:
                self._remove(f"profiles/{version}")
        kept = {(str(r["model_id"]), r["version"]) for r in self._table("models").collect()}
        for model in self._names("results"):
            for version in self._names(f"results/{model}"):
                if (model, version) not in kept:
                    self._remove(f"results/{model}/{version}")

    def log(self, **entry) -> None:
        """Adds a line to the run log."""
        row = {f.name: entry.get(f.name) for f in RUN_LOG} | {"at": datetime.now()}
        self.spark.createDataFrame([row], RUN_LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/run_log")

    def run_log(self) -> DataFrame:
        if not self._names("run_log"):
            return self.spark.createDataFrame([], RUN_LOG)
        return self.spark.read.schema(RUN_LOG).parquet(f"{self.path}/run_log")

    def latest_datasets(self) -> DataFrame:
        """The datasets, newest first, with defaults where a value is missing."""
        return self.datasets().select(
            "id", "title", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("import_state", F.lit("ready")).alias("import_state"),
            F.coalesce("classify_state", F.lit("idle")).alias("classify_state"), "imported_at",
        ).orderBy(F.desc("imported_at"), "id")


@contextmanager
def replacing(store: Store, entry: dict) -> Iterator[None]:
    """While a dataset is made: its entry's state is importing, and no other writer makes it. If that fails, what was there before stays.

    A dataset that wasn't there before has failed then; one that was is as it was, with the error.
    """
    with store.locked(f"dataset-{hashlib.md5(entry['id'].encode()).hexdigest()}", wait=0):
        before = store.datasets().filter(F.col("id") == entry["id"]).first()
        if before is None:
            store.add_dataset(**entry, import_state="importing")
        else:
            store.update_dataset(entry["id"], import_state="importing")
        try:
            yield
        except Exception as error:
            kept = before is not None and before["import_state"] in (None, "ready")
            store.update_dataset(entry["id"], import_state="ready" if kept else "failed", import_error=str(error)[:1000])
            raise
