"""Operator 7: a classifier chain over categories of documents.

The categories are predicted one after the other by linear models (logistic regression); each model also
gets the log-odds of all earlier categories. In training these come from out-of-fold models, so that a
later model learns from predictions as good as those it will get, not from ones fitted to its own rows.

Features are words and character n-grams of words (4 and 5 letters, with the word's ends marked), present
or not; those most associated with a category are kept (``features`` for each category).

Scale: fitting takes a bounded sample of labelled rows (``sample`` of each value of each category, those
of least hash), of which the driver gets the kept features only; the association counts are combined in
Spark. Scoring is row-local: no shuffle, and the model is some hundred weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

_WORD = re.compile(r"[^\W\d_]+")
KEPT_WORDS = 400_000
#: Files of the bounded sample, so that as many tasks count its features.
SAMPLE_FILES = 32


def word_features(word: str) -> set[str]:
    """A word, and the runs of 4 and 5 letters of it with its ends marked."""
    marked = f"^{word}$"
    return {marked, *(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1))}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _counts(categories: int):
    """Features of a task's rows with the rows and positive labels they stand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array([c.to_pylist() for c in batch.columns[1:]], np.int64).T
            for text, y in zip(batch.column(0), labels):
                row = np.append(1, y)
                for f in set().union(*map(word_features, words_of(text.as_py()))):
                    if f in seen:
                        seen[f] += row
                    else:
                        seen[f] = row.copy()
            if len(seen) > KEPT_WORDS:
                yield out(seen)
                seen = {}
        yield out(seen)

    def out(seen: dict[str, np.ndarray]) -> pa.RecordBatch:
        table = np.array(list(seen.values()), np.int64).reshape(-1, categories + 1)
        return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *map(pa.array, table.T)], names=["feature", "n", *(f"y{i}" for i in range(categories))])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 300) -> np.ndarray:
    """Weights and, last, the intercept; by gradient steps with momentum, alike from run to run."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = ahead = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    size = 0.25 * np.linalg.norm(x, 2) ** 2 + penalty if len(x) else 1.0
    for t in range(steps):
        new = ahead - (x.T @ (_sigmoid(x @ ahead) - y) + ridge * ahead) / size
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


@dataclass
class Chain:
    """features: feature -> column; weights: for each category, of the columns, the earlier log-odds, and 1."""

    categories: list[str]
    features: dict[str, int]
    weights: list[np.ndarray]


def log_odds(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Of each category, from the features and the categories before it."""
    done = np.zeros((len(x), 0))
    for w in weights:
        done = np.hstack([done, (np.hstack([x, done]) @ w[:-1] + w[-1])[:, None]])
    return done


def fit_chain(x: np.ndarray, y: np.ndarray, folds: int = 4) -> list[np.ndarray]:
    fold = np.arange(len(x)) % folds
    out, earlier = [], np.zeros((len(x), 0))
    for c in range(y.shape[1]):
        full = np.hstack([x, earlier])
        out.append(fit_logistic(full, y[:, c]))
        held_out = np.zeros(len(x))
        for k in range(folds):
            w = fit_logistic(full[fold != k], y[fold != k, c])
            held_out[fold == k] = full[fold == k] @ w[:-1] + w[-1]
        earlier = np.hstack([earlier, held_out[:, None]])
    return out


def _presence(features: dict[str, int], texts, known: dict[str, tuple[int, ...]]) -> list[list[int]]:
    """The columns of each text's features. known: what words gave so far."""
    out = []
    for text in texts:
        found: set[int] = set()
        for w in words_of(text.as_py()):
            cols = known.get(w)
            if cols is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                cols = known[w] = tuple(features[f] for f in word_features(w) if f in features)
            found.update(cols)
        out.append(sorted(found))
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, object], sample: int = 1000, features: int = 256, folds: int = 4, key: str = "doc_id", text: str = "text") -> Chain:
    """A chain over the categories (name -> boolean column of ``labels``), in their order.

    Rows whose labels are null don't train; a document with several label rows trains once for each, and of
    rows that share an id each trains; ``sample`` bounds the rows of each combination of labels, whatever
    repeats. With no labelled rows, or none positive, every probability is about the rate of the sample (0.5
    if empty)."""
    names = list(categories)
    given = labels.select(F.col(key).cast("long").alias("doc_id"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]).dropna()
    ys = [f"y{i}" for i in range(len(names))]

    def first(df: DataFrame, *order) -> DataFrame:
        """So many rows of each combination of labels."""
        place = F.row_number().over(Window.partitionBy(ys).orderBy(F.xxhash64("doc_id"), "doc_id", *order))
        return df.withColumn("place", place).filter(F.col("place") <= sample).drop("place")

    drawn = F.broadcast(first(given))  # sample * 2**categories rows at most; joined ids may repeat
    rows = first(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(drawn, "doc_id"), F.xxhash64("text"), "text")
    rows = written(rows.repartition(SAMPLE_FILES), "toxicity-rows")  # read several times; labels alone would deal it to few tasks
    kinds = ", ".join(f"{n} bigint" for n in ["n", *ys])
    seen = rows.select("text", *ys).mapInArrow(_counts(len(names)), f"feature string, {kinds}").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ["n", *ys]])
    total = rows.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ys]).first()
    n_rows = total[0]
    kept: dict[str, int] = {}
    for c, positive in zip(ys, total[1:]):
        if 0 < positive < n_rows:
            # Chi-squared of the feature's presence with the category.
            a, n, p, t = F.col(c).cast("double"), F.col("n").cast("double"), float(positive), float(n_rows)
            chi = (a * t - n * p) ** 2 * t / (n * (t - n + 1) * p * (t - p))
            for r in seen.filter("n >= 4").orderBy(chi.desc(), "feature").limit(features).collect():
                kept.setdefault(r.feature, len(kept))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            cols = pa.array(_presence(kept, batch.column(1), known), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), cols, *batch.columns[2:]], names=["doc_id", "cols", *ys])

    train = rows.select("doc_id", "text", *ys).mapInArrow(present, f"doc_id bigint, cols array<int>, {', '.join(f'{y} int' for y in ys)}").collect()
    train.sort(key=lambda r: (hash((r.doc_id * 0x9E3779B1) & 0xFFFFFFFF), r.doc_id, r.cols))  # folds mix the labels
    x, y = np.zeros((len(train), len(kept))), np.array([[r[c] for c in ys] for r in train], float).reshape(-1, len(ys))
    for i, r in enumerate(train):
        x[i, r.cols] = 1
    return Chain(names, kept, fit_chain(x, y, folds))


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Adds p_<category> for each category; a null or empty text has the features of no words."""
    model = docs.sparkSession.sparkContext.broadcast((chain.features, chain.weights))

    @F.pandas_udf("array<double>")
    def odds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, weights = model.value
        known: dict = {}
        for texts in parts:
            some = pa.array(texts.tolist(), pa.string())
            out = []
            for lo in range(0, len(some), 1000):
                found = _presence(features, some[lo : lo + 1000], known)
                x = np.zeros((len(found), len(features)))
                for i, cols in enumerate(found):
                    x[i, cols] = 1
                out += list(_sigmoid(log_odds(x, weights)))
            yield pd.Series(out, dtype=object)

    out = docs.withColumn("p_", odds(text))
    return out.select(*docs.columns, *[F.get("p_", i).alias(f"p_{n}") for i, n in enumerate(chain.categories)])


def fitted(spark: SparkSession, sf_dir: str) -> Chain:
    labels = documents(spark, sf_dir, "labels")
    return fit(documents(spark, sf_dir), labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir).select("doc_id", "text"), fitted(spark, sf_dir))
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))
