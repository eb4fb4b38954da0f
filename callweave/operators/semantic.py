"""An embedding learned from the units of an index: units by words, weighted, and
reduced by a randomised singular value decomposition. Axes are scaled by their
singular values, so two texts are near where the same units match both: words of
the same surroundings are, even if no unit has both.

Words are hashed to FEATURES places. A pass over the texts multiplies their matrix's
square with a thin one: a task sums what its units add, as whole numbers, and Spark
adds the tasks' sums by feature. So the result is the same whatever the partitions,
nothing is shuffled but a row a feature a task, and what the driver and each task
hold (FEATURES rows of WIDTH + EXTRA numbers, 10 MB) doesn't grow with the texts.

A null or empty text, or one of words that no unit has, is embedded as zeros."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MODEL

#: Places of words, numbers of a vector, further ones while fitting, and passes.
FEATURES, WIDTH, EXTRA, PASSES = 16384, 64, 16, 3
#: A one in the sums' whole numbers; products are at most one, so 2**39 units fit.
ONE = 1 << 24
#: Words whose products a task holds at once.
CHUNK = 65536


def words(text: Column | str) -> Column:
    """Words in lower case; names in camel case are cut apart, as at underscores."""
    cut = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda w: w != "")


def features(text: Column | str) -> Column:
    """The places of a text's words, with repeats."""
    place = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % FEATURES).cast("int")
    return F.coalesce(F.transform(words(text), place), F.array().cast("array<int>"))


def document_frequency(texts: DataFrame, text: Column | str = "text") -> DataFrame:
    """feature, df: in how many texts a feature is."""
    return texts.select(F.explode(F.array_distinct(features(text))).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))


def _weighed(lists: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature, weight of a batch: logarithm of the count, times idf, each row
    of length 1; in order of row and feature."""
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists), dtype=np.int64), sizes)
    key, tf = np.unique(row * FEATURES + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    row, feature = key // FEATURES, key % FEATURES
    w = np.log1p(tf) * idf[feature]
    return row, feature, w / np.sqrt(np.bincount(row, w * w, minlength=len(lists)))[row]


def _projected(row: np.ndarray, feature: np.ndarray, w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The product of rows (all of them whole) with the basis, for rows that have words."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return np.add.reduceat(w[:, None] * basis[feature], starts)


def _chunks(row: np.ndarray) -> Iterator[slice]:
    """Slices of whole rows, of about CHUNK entries."""
    at = 0
    while at < len(row):
        end = int(np.searchsorted(row, row[min(at + CHUNK, len(row)) - 1], "right"))
        yield slice(at, end)
        at = end


def _square(model, width: int):
    """For mapInArrow: feature and the sums of its row of (transposed texts x texts
    x basis)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = model.value
        sums, met = np.zeros((FEATURES, width), np.int64), np.zeros(FEATURES, bool)
        for batch in batches:
            row, feature, w = _weighed(batch.column("features"), idf)
            for part in _chunks(row):
                r, f, v = row[part], feature[part], w[part]
                each = np.cumsum(np.r_[0, r[1:] != r[:-1]])
                add = np.rint(v[:, None] * _projected(r, f, v, basis)[each] * ONE).astype(np.int64)
                order = np.argsort(f, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(f[order]) != 0])
                own = f[order][starts]
                sums[own] += np.add.reduceat(add[order], starts)
                met[own] = True
        own = np.flatnonzero(met)
        yield pa.record_batch([pa.array(own.astype(np.int32)), *(pa.array(sums[own, k]) for k in range(width))], ["feature", *(f"c{k}" for k in range(width))])

    return run


def fit(texts: DataFrame, text: Column | str = "text", width: int = WIDTH, passes: int = PASSES) -> Model:
    """The model of all texts."""
    spark, wide = texts.sparkSession, width + EXTRA
    n = texts.count()
    df = np.zeros(FEATURES)
    for r in document_frequency(texts, text).collect():  # at most FEATURES rows
        df[r["feature"]] = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = texts.select(features(text).alias("features")).filter(F.size("features") > 0)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((FEATURES, wide)))[0]
    columns = [f"c{k}" for k in range(wide)]
    for left in reversed(range(passes)):
        model = spark.sparkContext.broadcast((idf, basis))
        added = rows.mapInArrow(_square(model, wide), "feature int, " + ", ".join(f"{c} long" for c in columns))
        got = added.groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # at most FEATURES rows
        model.unpersist()
        product = np.zeros((FEATURES, wide))
        if got.num_rows:
            product[got.column("feature").to_numpy()] = np.stack([got.column(c).to_numpy() for c in columns], 1) / ONE
        if left:
            basis = np.linalg.qr(product)[0]
    # The square of the matrix within the basis: its largest axes are the ones sought.
    small = basis.T @ product
    size, axes = np.linalg.eigh((small + small.T) / 2)
    size, axes = size[::-1][:width], axes[:, ::-1][:, :width]
    found = basis @ axes
    found = found * np.sqrt(np.maximum(size, 0) / max(size[0], 1e-9))
    found[:, size <= max(size[0], 0) * 1e-6 + 1e-9] = 0
    found[df == 0] = 0  # what no text has, but for rounding
    # No axis has a direction of its own: the largest number of each is positive.
    sign = np.sign(found[np.abs(found).argmax(0), np.arange(width)])
    return Model(idf, (found * np.where(sign == 0, 1, sign)).astype(np.float32))


class Model:
    """What is learned: a weight and a vector for each feature."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray):
        self.idf, self.basis = idf, basis

    def __call__(self, text: Column | str) -> Column:
        """The embedding of a text, of length 1, or of zeros."""
        idf, basis = self.idf, self.basis

        def embed(lists: pd.Series) -> pd.Series:
            column = pa.array(lists, pa.list_(pa.int32()))
            row, feature, w = _weighed(column, idf)
            out = np.zeros((len(column), basis.shape[1]))
            for part in _chunks(row):
                out[np.unique(row[part])] = _projected(row[part], feature[part], w[part], basis)
            length = np.sqrt((out * out).sum(1, keepdims=True))
            return pd.Series(list((out / np.where(length > 1e-9, length, np.inf)).astype(np.float32)))

        return F.pandas_udf(embed, "array<float>")(features(text))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table of FEATURES rows."""
        table = pa.table({"feature": pa.array(np.arange(FEATURES, dtype=np.int32)), "idf": self.idf, "basis": pa.array(list(self.basis), pa.list_(pa.float32()))})
        return spark.createDataFrame(table, MODEL)

    @classmethod
    def of_rows(cls, rows: DataFrame) -> Model:
        got = rows.orderBy("feature").toArrow()
        return cls(got.column("idf").to_numpy(), np.stack(got.column("basis").to_pylist()).astype(np.float32))
