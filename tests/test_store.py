"""Stored datasets: layouts read back, states, replacement, derivations with their lineage, and lost drivers."""

import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from taxospark.functions.text import content_hash
from taxospark.operators import derive, evaluate, explore, export, importing, maintenance, profiling, scoring
from taxospark.operators import store as store_module
from taxospark.operators.store import Store
from taxospark.schemas import FIELDS, ColumnMap, DeriveRequest, FilterRow, FilterSpec, Op, OutputColumn, SpecError
from taxospark.sources import delimited
from tests.conftest import rows

ONE = b"note,sub_pref,course,course_title\r\nn0,ECON,101,Micro\r\nn1,MATH,201,Calc\r\nn2,ECON,101,Micro\r\n"
TWO = b"sub_pref,course,course_title,Note\r\nBIOL,1,Cells,m0\r\nECON,101,Micro,m1\r\n"


@pytest.fixture
def store(spark, tmp_path):
    for name, data in (("one.csv", ONE), ("two.csv", TWO)):
        (tmp_path / name).write_bytes(data)
    made = Store(spark, str(tmp_path / "store"))
    for name in ("one", "two"):
        importing.import_csv(spark, made, str(tmp_path / f"{name}.csv"), name, name.title())
    return made


def test_layouts_are_read_back(spark, store, tmp_path):
    found = store.sources()
    assert found["one"].layout.headers == ("note", "sub_pref", "course", "course_title") and found["one"].layout.mapping == ColumnMap(1, 2, 3)
    header, out = export.export(store.courses().filter("dataset_id = 'one'"), store.results(), spark.createDataFrame([], "digit_level byte, code string, title string, title_short string, description string"), [(2, 2)], found["one"].layout)
    assert header[:4] == list(found["one"].layout.headers) and out.select("c0", "c1").first() == ("n0", "ECON")
    # importing again replaces the entry and the records
    assert importing.import_csv(spark, store, str(tmp_path / "two.csv"), "one", "Again") == 2
    assert store.courses().filter("dataset_id = 'one'").count() == 2 and store.datasets().filter("id = 'one'").count() == 1
    assert {r[0] for r in rows(store.source_files(), "id")} == {hashlib.sha256(x).hexdigest() for x in (ONE, TWO)}


def test_a_refused_import_has_failed(spark, store, tmp_path):
    (tmp_path / "bad.csv").write_bytes(ONE + b"n3,ECON\r\n")
    with pytest.raises(SpecError, match="don't have 4 fields"):
        importing.import_csv(spark, store, str(tmp_path / "bad.csv"), "bad", "Bad")
    assert rows(store.datasets().filter("id = 'bad'"), "import_state") == [("failed",)]
    store.update_dataset("one", import_state="importing")
    for refused in (lambda: importing.import_csv(spark, store, str(tmp_path / "one.csv"), "one", "One"), lambda: maintenance.prune_unreferenced(store), lambda: maintenance.prune_superseded(store, [1])):
        with pytest.raises(SpecError, match="busy"):
            refused()
    scoring.sweep(store)
    assert rows(store.datasets().filter("id = 'one'"), "import_state", "import_error") == [("failed", "the import was interrupted")]


def test_a_derivation_is_stored(store):
    request = DeriveRequest(("one", "two"), (OutputColumn("Note", (("one", 0), ("two", 3))),), FilterSpec((FilterRow("subject_code", Op.IS_NOT, ("math",)),)), dedupe=("subject_code", "catalog_number"))
    assert derive.materialize(store, request, "new", "New") == 2
    assert rows(store.courses().filter("dataset_id = 'new'"), "row_index", "subject_code", "extra_columns") == [(0, "ECON", {"3": "n0", "4": "One"}), (1, "BIOL", {"3": "m0", "4": "Two"})]
    assert store.derivation("new") == request and store.derivation("one") is None
    entry = store.datasets().filter("id = 'new'").first()
    assert (entry["import_state"], entry["row_count"], json.loads(entry["profile"])["rows"]) == ("ready", 2, 2)
    told = rows(derive.lineage(store.dataset_sources(), store.datasets()), "position", "source_dataset_id", "source_title", "exists")
    assert told == [(0, "one", "One", True), (1, "two", "Two", True)]
    # a source can't go while what is made of it is being made; afterwards its title stays
    store.update_dataset("new", import_state="importing")
    with pytest.raises(SpecError, match="busy"):
        maintenance.delete_dataset(store, "one")
    store.update_dataset("new", import_state="ready")
    assert maintenance.delete_dataset(store, "one")
    assert (0, "one", "One", False) in rows(derive.lineage(store.dataset_sources(), store.datasets()), "position", "source_dataset_id", "source_title", "exists")
    assert store.source_files().count() == 1
    with pytest.raises(SpecError, match="itself"):
        derive.materialize(store, DeriveRequest(("two",)), "two", "Two")


class Lost(Exception):
    pass


def test_a_lost_driver_leaves_a_whole_table(spark, store, monkeypatch):
    """A writer that is lost before, while or after it writes; stores opened meanwhile see the old table or the new one."""
    before = rows(store.datasets(), "id")

    def lost(t):
        assert rows(Store(spark, store.path).datasets(), "id") == before
        raise Lost

    with pytest.raises(Lost):
        store.edit("datasets", lost)
    assert rows(Store(spark, store.path).datasets(), "id") == before
    # files without the mark of a whole version
    newest = max(os.listdir(f"{store.path}/datasets"))
    half = f"{store.path}/datasets/{int(newest) + 1:012d}"
    store.datasets().filter("id = 'one'").write.parquet(half)
    os.remove(f"{half}/_SUCCESS")
    assert rows(Store(spark, store.path).datasets(), "id") == before
    # the next writer goes past it
    store.update_dataset("one", title="New")
    assert rows(Store(spark, store.path).datasets(), "id", "title") == [("one", "New"), ("two", "Two")]
    for k in range(6):
        store.update_dataset("one", title=f"New {k}")
    assert len(os.listdir(f"{store.path}/datasets")) <= 5 and not os.path.exists(half)


def test_two_writers_take_turns(spark, store):
    other = Store(spark, store.path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: (store if k % 2 else other).add_dataset(id=f"n{k}", title="N"), range(8)))
    assert store.datasets().count() == 10
    with store.locked("datasets"), pytest.raises(SpecError, match="another writer"), other.locked("datasets", wait=0.3):
        pass
    # a lost writer's lock ends by its age
    open(f"{store.path}/locks/datasets", "w").close()
    os.utime(f"{store.path}/locks/datasets", (1, 1))
    other.update_dataset("n0", title="M")
    assert not store.is_locked("datasets")


@pytest.mark.parametrize("name", ["a:b", "50%", "x/y", "k=v", "two words", "é'\"#", "version=1"])
def test_any_id_can_be_replaced_and_deleted(spark, store, tmp_path, name):
    assert importing.import_csv(spark, store, str(tmp_path / "one.csv"), name, "T", profile=False) == 3
    assert importing.import_csv(spark, store, str(tmp_path / "two.csv"), name, "T", profile=False) == 2
    assert rows(store.courses(name), "dataset_id", "subject_code") == [(name, "BIOL"), (name, "ECON")]
    folders = len(os.listdir(f"{store.path}/courses"))
    assert maintenance.delete_dataset(store, name) and store.courses(name).isEmpty() and store.courses().count() == 5
    assert len(os.listdir(f"{store.path}/courses")) == folders - 1


def test_a_reimport_that_fails_leaves_what_was_there(spark, store, tmp_path, monkeypatch):
    old, records = store.datasets().filter("id = 'one'").first(), rows(store.courses("one"))
    (tmp_path / "bad.csv").write_bytes(TWO + b"x,y\r\n")
    with pytest.raises(SpecError, match="don't have"):
        importing.import_csv(spark, store, str(tmp_path / "bad.csv"), "one", "Bad")

    def fails(*_):
        raise OSError("disk")

    monkeypatch.setattr(profiling, "profile", fails)
    with pytest.raises(OSError):
        importing.import_csv(spark, store, str(tmp_path / "two.csv"), "one", "Two")
    monkeypatch.setattr(Store, "store_courses", fails)
    with pytest.raises(OSError):
        derive.materialize(store, DeriveRequest(("two",)), "one", "Two")
    now = store.datasets().filter("id = 'one'").first()
    assert rows(store.courses("one")) == records and len(os.listdir(f"{store.path}/courses")) == 2
    assert (now["layout"], now["title"], now["import_state"], now["row_count"], now["import_error"]) == (old["layout"], "One", "ready", 3, "disk")


def test_times_and_profiles_are_stored(spark, store, tmp_path):
    assert store.profile("one")["rows"] == 3 and store.profile("nope") is None
    assert [r["id"] for r in store.latest_datasets().collect()] == ["two", "one"]
    importing.import_csv(spark, store, str(tmp_path / "one.csv"), "one", "One")
    found = store.latest_datasets().collect()
    assert [r["id"] for r in found] == ["one", "two"] and found[0]["imported_at"] > found[1]["imported_at"]


def test_a_deletion_that_was_cut_off_is_finished(spark, store, monkeypatch):
    def lost(*_):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(Store, "name_courses", lost)
        with pytest.raises(Lost):
            maintenance.delete_dataset(store, "one")
    assert maintenance.incomplete(store) == ["one"] and store.courses("one").count() == 3
    with maintenance.exclusive(store):
        assert maintenance.incomplete(store) == []
        for other in (lambda: maintenance.delete_dataset(store, "two"), lambda: maintenance.prune_unreferenced(store), lambda: maintenance.prune_superseded(store, [1])):
            with pytest.raises(SpecError, match="busy"):
                other()
    assert maintenance.finish_deletions(store) == ["one"] and maintenance.incomplete(store) == []
    assert rows(store.datasets(), "id") == [("two",)] and store.courses("one").isEmpty() and store.source_files().count() == 1


def test_sweeping_removes_what_lost_writers_left(spark, store):
    store.store_courses(store.courses("one"))
    open(f"{store.path}/locks/maintenance", "w").close()
    store.update_dataset("two", import_state="importing")
    assert len(os.listdir(f"{store.path}/courses")) == 3
    scoring.sweep(store)
    assert len(os.listdir(f"{store.path}/courses")) == 2 and not store.is_locked("maintenance")
    assert rows(store.datasets(), "id", "import_state") == [("one", "ready"), ("two", "failed")] and store.courses().count() == 5


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_results_are_joined_in_their_buckets(spark, store, monkeypatch):
    """No exchange stands above a scan of results, whatever the number of levels; the layout changes with their size."""
    for level, model in ((2, 5), (6, 7)):
        scoring.classify(store, "one", [(level, model, ["01", "02"], lambda: lambda texts: [[1.0, 0.0] for _ in texts])], buckets=2)
    tax = spark.createDataFrame([], "digit_level byte, code string, title string, title_short string, description string")
    with_conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    was = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        coded, _ = export.with_codes(store.courses("one").select("row_index", "content_hash"), store.results(), tax, [(2, 5), (6, 7)])
        text = _nodes(coded.select("row_index", "ccm2digit_code", "ccm6digit_code"))
        hashed = [line for line in text.splitlines() if "Exchange hashpartitioning(content_hash" in line]
        assert len(hashed) == 1 and text.count("Bucketed: true") == 2, text
        missing = _nodes(scoring.misses(store.courses("one"), store.results(), 5))
        assert len([line for line in missing.splitlines() if "Exchange hashpartitioning(content_hash" in line]) == 1, missing
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert rows(coded, "ccm2digit_code") == [("01",)] * 3
    # appends until the model is laid out anew, then more rows than its buckets are for
    one = store.results().filter("model_id = 5").limit(1).drop("model_id")
    more = lambda k: one.withColumn("content_hash", F.lit(f"h{k}")).withColumn("model_id", F.lit(5).cast("long")).select("model_id", *one.columns)
    versions = {store._table("models").filter("model_id = 5").first()["version"]}
    for k in range(8):
        store.append_results(more(k))
        versions.add(store._table("models").filter("model_id = 5").first()["version"])
    entry = store._table("models").filter("model_id = 5").first()
    assert len(versions) == 2 and entry["appends"] < store_module.MOST_FILES and store.results().filter("model_id = 5").count() == 10
    monkeypatch.setattr(store_module, "BUCKET_ROWS", 1)
    monkeypatch.setattr(store_module, "LEAST_BUCKETS", 2)
    store.append_results(store.results().filter("model_id = 5").withColumn("content_hash", F.concat("content_hash", F.lit("x"))).unionByName(more(99)).crossJoin(spark.range(3).select(F.col("id").alias("z"))).withColumn("content_hash", F.concat("content_hash", "z")).drop("z"), 5)
    entry = store._table("models").filter("model_id = 5").first()
    assert entry["buckets"] == 43 and store.results().filter("model_id = 5").count() == 43
    assert entry["version"] in os.listdir(f"{store.path}/results/5") and len(os.listdir(f"{store.path}/results/5")) == 2
    # another session finds the same results
    assert Store(spark.newSession(), store.path).results().groupBy("model_id").count().orderBy("model_id").collect()[0]["count"] == 43


def test_pruning_swaps_a_model_whole(spark, store):
    def scores(texts):
        return [[1.0, 0.0] for _ in texts]

    assert scoring.classify(store, "one", [(2, 1, ["1", "2"], lambda: scores)], buckets=4) == 2
    maintenance.delete_dataset(store, "one")
    assert maintenance.prune_unreferenced(store) == 1 and store.results().count() == 1


def test_quoted_line_ends_are_noticed(spark, store, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_bytes(b'sub_pref,course,"course\r\n_title",title\r\nECON,101,"Micro\r\nand more",T\r\nMATH,1,Calc,U\r\n')
    assert delimited.headers(spark, str(path))[2].split() == ["course", "_title"]
    assert importing.import_csv(spark, store, str(path), "lines", "Lines") == 2
    cells = {r[0]: r[1]["2"].split() for r in rows(store.courses().filter("dataset_id = 'lines'"), "subject_code", "extra_columns")}
    assert cells == {"ECON": ["Micro", "and", "more"], "MATH": ["Calc"]}


def test_header_of_a_file_that_fits_no_task(spark, tmp_path):
    path = tmp_path / "sparse.csv"
    path.write_bytes(b"sub_pref,course,course_title\n")
    os.truncate(path, 3 << 30)
    assert delimited.headers(spark, str(path)) == ("sub_pref", "course", "course_title")


def test_a_merge_is_profiled_from_states_alone(spark, store, tmp_path, monkeypatch):
    """Of sources with skipped records, repeated inputs and every kind of hit, merged once and again: as their rows are profiled."""

    def lines(n, shift):
        for i in range(n):
            k = i * 7 + shift
            cells = (f"{'Ec12' if k % 5 else 'MATH'}", f"{k % 40}{'.0' if k % 3 == 0 else ''}{' x' if k % 11 == 0 else ''}", f"{'Title' if k % 2 else 'TITLE'}  {k % 60}" if k % 13 else "")
            yield ",".join((f"n{i}", *cells))

    for name, n, shift in (("a", 700, 0), ("b", 900, 3), ("none", 0, 0)):
        (tmp_path / f"{name}.csv").write_text("\n".join(("note,sub_pref,course,course_title", *lines(n, shift))) + "\n")
        importing.import_csv(spark, store, str(tmp_path / f"{name}.csv"), name, name)
    with monkeypatch.context() as patch:
        patch.setattr(profiling, "state", None)  # no records are profiled
        for made, sources in (("ab", ("a", "b")), ("all", ("none", "ab", "one")), ("nothing", ("none",))):
            derive.materialize(store, DeriveRequest(sources), made, made)
    for made in ("ab", "all", "nothing"):
        plainly = profiling.profile(store.courses(made).select("row_index", *FIELDS))
        assert store.profile(made) == json.loads(json.dumps(plainly))
    told = store.profile("all")
    assert told["rows"] == store.courses("all").count() > 1400 and len(told["findings"]) > 5 and len(told["samples"]) == profiling.SAMPLES
    # rows that are left out, and states of other records than are stored, mean a profile of the rows
    part = DeriveRequest(("a", "b"), filter=FilterSpec((FilterRow("subject_code", Op.IS, ("math",)),)))
    derive.materialize(store, part, "part", "Part")
    assert store.profile("part")["columns"]["subject"]["top"] == [{"rank": 1, "value": "MATH", "n": store.courses("part").count()}]
    importing.import_csv(spark, store, str(tmp_path / "b.csv"), "b", "b", limit=5)
    assert store.profile_state("b") is None and store.profile_state("one").marks["skips"]["rows"] == 3
    folders = len(os.listdir(f"{store.path}/profiles"))
    assert maintenance.delete_dataset(store, "ab") and len(os.listdir(f"{store.path}/profiles")) == folders - 1


def test_samples_against_all_rows(spark):
    df = spark.range(500).select(F.col("id").alias("row_index"), F.lit("S").alias("subject_code"), (F.col("id") % 300).cast("string").alias("catalog_number"), F.lit("Title").alias("course_title"))
    base = profiling.prepared(df)
    keyed = df.select("row_index", F.xxhash64(content_hash(*(F.col(f) for f in FIELDS)), F.lit(42)))
    keys = {r[0]: r[1] for r in keyed.collect()}
    firsts = sorted(range(300), key=lambda i: (keys[i], i))[: profiling.SAMPLES]
    assert [r["row"] for r in profiling.samples(base).collect()] == sorted(i + 2 for i in firsts)
    hashes = {r[0]: r[1] for r in df.select("row_index", F.xxhash64("row_index", F.lit(42))).collect()}
    chosen = sorted(hashes, key=lambda i: (hashes[i], i))[:20]
    assert rows(evaluate.sampled(df, "row_index", 20), "row_index") == sorted(((i,) for i in chosen), key=repr)


def scanned(df):
    """Rows that the scans of a plan gave out, once it has run."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_a_page_reads_little_of_a_stored_dataset(spark, tmp_path, monkeypatch):
    """Pages of 600,000 records with gaps: right at any cursor, and from the groups and pages of files about it."""
    store, n = Store(spark, str(tmp_path / "big")), 600_000
    df = spark.range(n, numPartitions=4).filter("id % 10 <> 3").select(F.lit("d").alias("dataset_id"), F.col("id").alias("row_index"), F.lit("S").alias("subject_code"), (F.col("id") % 1000).cast("string").alias("catalog_number"), F.concat(F.lit("T"), "id").alias("course_title"), F.lit(None).cast("map<string,string>").alias("extra_columns"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    store.write_courses(df)
    assert store._table("course_versions").select("rows", "last").first() == (540_000, 599_999)
    result = df.filter("row_index % 2 = 0").select(F.lit(3).cast("long").alias("model_id"), "content_hash", F.lit("02").alias("classification"), F.lit(0.5).cast("float").alias("probability"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in store_module.RESULTS if f.name not in ("model_id", "content_hash", "classification", "probability")))
    store.append_results(result.select(*store_module.RESULTS.names), 3)
    tax = spark.createDataFrame([(2, "02", "Two", "two", None)], "digit_level byte, code string, title string, title_short string, description string")
    for cursor, limit, keep in ((0, 500, None), (300_000, 500, None), (599_990, 500, None), (700_000, 5, None), (17, 3, None), (100, 40, F.col("catalog_number") == "998"), (0, 500, F.col("catalog_number") == "none")):
        got = rows(explore.stored_page(store, "d", tax, {2: 3}, cursor, limit, keep), "row_index", "classification", "title")
        want = df.filter(F.col("row_index") >= cursor).filter(keep if keep is not None else F.lit(True)).orderBy("row_index").limit(limit).filter("row_index % 2 = 0").select("row_index").collect()
        assert got == sorted(((r[0], "02", "Two") for r in want), key=repr)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        window = explore.between(store.courses("d"), 300_000, 302_000)
        assert window.collect() and 0 < scanned(window) < 0.02 * n
        one = explore.known(store.results(), 3, [r["content_hash"] for r in window.filter("row_index = 300002").collect()])
        assert len(one.collect()) == 1 and scanned(one) <= 300_000 / store_module.LEAST_BUCKETS * 1.2  # one bucket of all
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_a_run_writes_its_log(spark, store):
    """A run that is stopped half way shows what it covered, to another session too."""
    df = spark.range(400).select((F.col("id")).alias("row_index"), F.lit("S").alias("subject_code"), (F.col("id") % 200).cast("string").alias("catalog_number"), F.lit("T").alias("course_title"), F.lit(None).cast("map<string,string>").alias("extra_columns"))
    store.write_courses(importing.imported(df, "run"))
    store.add_dataset(id="run", title="Run", import_state="ready", row_count=400)
    assert scoring.run_progress(store, "run").collect() == []

    def stop(level, bucket):
        if bucket == 2:
            raise scoring.Stopped

    score = lambda: lambda texts: [[1.0, 0.0] for _ in texts]
    done = scoring.classify(store, "run", [(2, 1, ["01", "02"], score)], buckets=4, before_bucket=stop)
    assert 0 < done < 200
    other = Store(spark.newSession(), store.path)
    told = scoring.run_progress(other, "run").collect()
    assert [(r["level"], r["total"], r["covered"], r["done"]) for r in told] == [(2, 400, 2 * done, done)] and told[0]["rows_per_second"] > 0
    assert scoring.classify(store, "run", [(2, 1, ["01", "02"], score), (6, 3, ["01", "02"], score)], buckets=2) == 400 - done
    told = scoring.run_progress(other, "run").collect()
    assert [(r["level"], r["covered"], r["done"]) for r in told] == [(2, 400, 200 - done), (6, 400, 200)]


def test_tables_are_compared_by_digests(spark):
    a = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("a.b"), F.when(F.col("id") % 5 > 0, F.create_map(F.lit("k"), F.col("id"), F.lit("a"), F.lit(1))).alias("m"), F.lit(None).cast("string").alias("_a"))
    a = a.unionByName(a.filter("id < 10"))
    mixed = a.repartition(7).orderBy(F.desc("id"))
    equal = maintenance.tables_equal(a, mixed.select("_a", "m", "`a.b`", "id"))
    assert equal.first() == (5010, 5010, 0, 0, True)
    assert maintenance.multiset_digests(maintenance.hashable(a)).count() <= maintenance.DIGEST_BUCKETS
    # one copy less, one row more, one changed
    other = a.filter("id <> 3").unionByName(a.filter("id = 3").limit(1)).unionByName(a.filter("id = 100"))
    other = other.withColumn("_a", F.when(F.col("id") == 4000, "x"))
    assert maintenance.tables_equal(a, other).first() == (5010, 5010, 2, 2, False)
    assert maintenance.tables_equal(a, a.limit(0)).first() == (5010, 0, 5010, 0, False)
    assert maintenance.tables_equal(a.limit(0), a.limit(0)).first() == (0, 0, 0, 0, True)


def test_results_of_several_models_get_the_buckets_that_their_rows_need_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "BUCKET_ROWS", 10)
    made = Store(spark, str(tmp_path / "buckets"))
    own = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit("02").alias("classification"))
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in store_module.RESULTS if f.name not in ("model_id", *own.columns)]
    made.append_results(own.select("*", *lacking).crossJoin(spark.createDataFrame([(3,), (4,)], "model_id long")))
    assert rows(made._table("models"), "model_id", "buckets", "appends") == [(3, 10, 1), (4, 10, 1)]
    assert rows(made.results().groupBy("model_id").count()) == [(3, 100), (4, 100)]
