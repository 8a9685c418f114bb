"""What the operators of this subpackage share: reading, shared storage, held-out folds and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from taxospark.operators.shared import free_name, shared_path, written

__all__ = ["attach", "fold", "free_name", "hash_bound", "is_fold", "labelled", "labelled_sample", "logistic", "logistic_over", "mapped", "quoted", "shared_path", "table", "with_row", "written"]

#: A key is hot when it holds at least one row in so many; so there are at most as many hot keys, and they can be broadcast.
HOT_ONE_IN = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: Iterable[str]) -> list[str]:
    """Column names as they can be selected whatever they hold, dots too."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def with_row(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """df, or the columns of it that are named, with a column of longs that tells its rows apart, the same whenever df is read.

    Rows of Parquet files are told apart by their file and place in it; the files, which the driver lists for any scan,
    are numbered in the order of their paths. A frame that isn't read from files as it is gets written to some first.
    Columns may have any names, _metadata among them.
    """
    own = quoted(columns or df.columns)
    if not df._jdf.queryExecution().analyzed().children().isEmpty() or not df.inputFiles():
        df = written(df.select(*own), "rows")
    path, file = free_name(df, "_path"), free_name(df, "_file")
    place = df.metadataColumn("_metadata")
    rows = df.select(*own, place["file_path"].alias(path), place["row_index"].alias(name))
    paths = sorted(r[0] for r in df.select(place["file_path"]).distinct().collect())
    files = df.sparkSession.createDataFrame(list(enumerate(paths)), f"{file} long, {path} string")
    number = F.shiftleft(file, 40).bitwiseOR(F.col(name))
    return rows.join(F.broadcast(files), path).select(*own, number.alias(name))


def mapped(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema), whatever names the columns have; run takes and gives columns by their places, which are their names there."""
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, plain).toDF(*schema.names)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def is_fold(doc_id: Column, folds: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with groups, which has one row for each key and that key's number of rows in `size`.

    A key with total / HOT_ONE_IN rows or more goes by broadcast (there can't be more than HOT_ONE_IN such keys), so
    no task gets all rows of a hot key. All others meet in a shuffled join.
    """
    is_hot = F.col(size) * HOT_ONE_IN >= F.lit(total)
    hot = groups.filter(is_hot & (F.col(size) > 1))
    cold = groups.filter(~(is_hot & (F.col(size) > 1)))
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    )


def hash_bound(k: int, n: int) -> int:
    """A bound on xxhash64 that the k smallest hashes of n rows are below, all but surely, and few more rows with them.

    Ranking only rows below it keeps what one task ranks in proportion to k, however many tasks there are.
    """
    return min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, (k + 10 * k**0.5 + 100) / max(1, n))))


def known_labels(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, label), a row for each id outside the held-out fold that has a label 0 or 1, the largest if it has several."""
    known = labels.filter(f"doc_id is not null and {label} in (0, 1)").filter(~is_fold(F.col("doc_id"), folds, held))
    return known.groupBy(F.col("doc_id").cast("long")).agg(F.max(label).alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, text, label, part) of all documents outside the held-out fold that have a label; `part` is the id's fold.

    A document with several labels counts by the largest, and an id that several rows have by the least of their texts.
    """
    part = fold(F.col("doc_id"), folds).cast("int").alias("part")
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("doc_id").isNotNull() & ~is_fold(F.col("doc_id"), folds, held))
    one = texts.join(known_labels(labels, label, folds, held), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return one.select("doc_id", "text", "label", part)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> tuple[DataFrame, float]:
    """(doc_id, text, label, part) of at most `per_class` documents of each of the labels 0 and 1 outside the held-out fold.

    Those with the smallest hash of their id are taken; `part` is the id's fold. A document with several labels counts
    by the largest, and an id that several rows have by the least of their texts, so the bound holds for rows too. The sample's ids, 2 * per_class at most, are broadcast to the documents. Also returns the share of
    label 1 among all such documents.
    """
    spark = docs.sparkSession
    known = known_labels(labels, label, folds, held)
    share, n1, n = known.agg(F.avg("label"), F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    share = share or 0.0
    low = [F.xxhash64("doc_id") <= hash_bound(per_class, size) for size in (n - n1, n1)]
    parts = [known.filter((F.col("label") == x) & low[x]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for x in (0, 1)]
    ids = spark.createDataFrame(parts[0].unionByName(parts[1]).toArrow(), "doc_id long, label int")
    part = fold(F.col("doc_id"), folds).cast("int").alias("part")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    # a row for each id, however many it has
    one = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return one.select("doc_id", "text", "label", part), share


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float, rounds: int) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, from the sums of slope and bend over all rows at given weights."""
    w = np.zeros(size)
    for _ in range(rounds):
        slope, bend = sums(w)
        step = np.linalg.solve(bend + ridge * np.eye(size), slope + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def slope_and_bend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x


def logistic(x: np.ndarray, y: np.ndarray, share: float = 0.5, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, label 1 with `share` of the weight; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y <= 0).sum()))
    return newton(lambda w: slope_and_bend(x, y, weight, w), x.shape[1], ridge, rounds)


def logistic_over(rows: DataFrame, share: float = 0.5, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """As logistic, over the rows (label, x0, x1, ...) of a written table: each round's sums are made in tasks."""
    names = [c for c in rows.columns if c != "label"]
    size = len(names) + 1
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = np.array([(1 - share) / max(1, n.get(0, 0)), share / max(1, n.get(1, 0))])

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, bend = np.zeros(size), np.zeros((size, size))
            for b in batches:
                y = b.column(0).to_numpy()
                x = np.column_stack([*(c.to_numpy() for c in b.columns[1:]), np.ones(len(y))])
                more = slope_and_bend(x, y.astype(float), weights[y], w)
                slope, bend = slope + more[0], bend + more[1]
            yield pa.RecordBatch.from_arrays([pa.array([slope.tobytes()], pa.binary()), pa.array([bend.tobytes()], pa.binary())], ["slope", "bend"])

        parts = rows.select("label", *names).mapInArrow(run, "slope binary, bend binary").toArrow().to_pylist()
        total = lambda c: sum((np.frombuffer(r[c]) for r in parts), np.zeros(size if c == "slope" else size * size))
        return total("slope"), total("bend").reshape(size, size)

    return newton(sums, size, ridge, rounds)
