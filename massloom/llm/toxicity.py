"""Severity grades of texts by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.staging import stage
from massloom.llm.words import blocks, mix, word_hashes

#: The classifier is fitted on at most about so many labelled rows (chosen by hash of their id).
FIT_ROWS = 20_000
#: Words that become features: those with the highest chi-square against the grades, of those in so many fitted texts at least.
#: LEAST_CHI is what one of a million words reaches by chance.
FEATURES, LEAST_TEXTS, LEAST_CHI = 2000, 5, 28.0
RIDGE, STEPS = 2e-5, 400
_SALTS = (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179), np.uint64(0x3C6EF372FE94F82B))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= j) = logistic(sum of the weights of a text's words - thresholds[j - 1]); weights are shared by all thresholds."""

    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def at_least(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -500, 500)))

    def scores(self, column: pa.Array) -> np.ndarray:
        """Sum of weights of the distinct words of each text of a column without nulls."""
        out = np.zeros(len(column))
        for a, b in blocks(column):
            row, feature = present(column.slice(a, b - a), self.words)
            out[a:b] = np.bincount(row, self.weights[feature], b - a)
        return out


def present(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each distinct word of the vocabulary (sorted hashes) in the rows of a column without nulls."""
    words, rows = word_hashes(column, letters=True)
    if not len(words) or not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == words)
    row = np.searchsorted(rows, hit, "right") - 1
    both = np.unique(row * len(vocabulary) + at[hit])
    return both // len(vocabulary), both % len(vocabulary)


def fit_cumulative(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) that maximise the ridge-penalised likelihood; Adam steps over all rows.

    Thresholds are the first one and the logarithms of the gaps to the next, so they stay in order.
    """
    n = max(1, len(grade))
    share = np.array([(np.sum(grade >= j) + 0.5) / (n + 1) for j in range(1, n_grades)])
    theta = np.log(1 / share - 1)
    steps = np.log(np.maximum(np.diff(theta), 1e-3))
    x = np.concatenate((np.zeros(n_features), theta[:1], steps))
    first, second = np.zeros_like(x), np.zeros_like(x)
    lower_of, upper_of = grade - 1, grade  # thresholds around each grade; none below the first and above the last
    for t in range(1, STEPS + 1):
        w, theta = x[:n_features], np.cumsum(np.concatenate((x[n_features : n_features + 1], np.exp(x[n_features + 1 :]))))
        score = np.bincount(row, w[feature], n)
        edge = np.concatenate((theta, [np.inf]))
        lower = np.where(lower_of >= 0, 1 / (1 + np.exp(np.clip(edge[np.maximum(lower_of, 0)] - score, -500, 500))), 1.0)
        upper = np.where(upper_of < n_grades - 1, 1 / (1 + np.exp(np.clip(edge[np.minimum(upper_of, n_grades - 1)] - score, -500, 500))), 0.0)
        p = np.maximum(lower - upper, 1e-12)
        d_lower, d_upper = lower * (1 - lower) / p, upper * (1 - upper) / p
        slope = (d_upper - d_lower) / n  # of the loss by score
        g_theta = np.bincount(np.maximum(lower_of, 0), np.where(lower_of >= 0, d_lower, 0), n_grades)[: n_grades - 1] - np.bincount(np.minimum(upper_of, n_grades - 1), np.where(upper_of < n_grades - 1, d_upper, 0), n_grades)[: n_grades - 1]
        tail = np.cumsum((g_theta / n)[::-1])[::-1]
        g = np.concatenate((np.bincount(feature, slope[row], n_features) + RIDGE * w, tail[:1], tail[1:] * np.exp(x[n_features + 1 :])))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        x -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return x[:n_features], np.cumsum(np.concatenate((x[n_features : n_features + 1], np.exp(x[n_features + 1 :]))))


def split_by_evidence(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, n_features: int, n_grades: int) -> np.ndarray:
    """Grades from labels that only tell toxic (1) from not (0).

    Grade 0 is not toxic; toxic texts are split at the quantiles of how many distinct words
    they hold that are commoner in toxic texts.
    """
    bad, all_ = np.bincount(feature, toxic[row], n_features), np.bincount(feature, minlength=n_features)
    telling = bad * max(1, len(toxic)) > all_ * max(1, toxic.sum())
    evidence = np.bincount(row, telling[feature], len(toxic))
    cuts = np.quantile(evidence[toxic > 0], np.arange(1, n_grades - 1) / (n_grades - 1)) if toxic.any() else np.zeros(n_grades - 2)
    return np.where(toxic > 0, 1 + (evidence[:, None] > cuts).sum(axis=1), 0)


def fit_severity(docs: DataFrame, grades: DataFrame, n_grades: int, split: bool = False) -> OrdinalModel:
    """Fit docs (doc_id, text) with grades (doc_id, grade from 0 to n_grades - 1) on at most about FIT_ROWS of them.

    With split, the grades are labels 0 and 1 and become n_grades by split_by_evidence.

    Rows with a null id, text or grade are left out; with no rows left, all texts get the
    lowest grade. Only word counts by grade (combined before the shuffle), FEATURES words and
    FIT_ROWS sparse rows reach the driver.
    """
    spark = docs.sparkSession
    known = grades.where("doc_id is not null and grade is not null").select(F.col("doc_id").alias("id"), F.col("grade").cast("int").alias("grade"))
    total = known.count()
    if total > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / total))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("text", "grade")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(0)):
                words, rows = word_hashes(batch.column(0).slice(a, b - a), letters=True)
                found = [np.unique(words[s:e]) for s, e in zip(rows, rows[1:], strict=False)]
                ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                least = [int(sum(int(mix(f ^ salt).min()) >> 2 for salt in _SALTS)) % 2**63 if len(f) else 0 for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(least, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))], ["grade", "signature", "words"])

    # copies and near copies of a text (equal in three minhashes) count once, else their other words would look telling
    sample, _ = stage(texts.mapInArrow(distinct_words, "grade int, signature long, words array<long>").groupBy("signature").agg(F.min(F.struct("grade", "words")).alias("first")).select("first.*"), "severity-sample")
    sizes = dict(sample.groupBy("grade").count().collect())
    n = sum(sizes.values())
    found = sample.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("texts"), *(F.count(F.when(F.col("grade") == j, 1)).alias(f"n{j}") for j in range(n_grades)))
    chi = sum((F.pow(F.col(f"n{j}") - F.col("texts") * (sizes.get(j, 0) / n), 2) / (F.col("texts") * (sizes.get(j, 0) / n)) for j in range(n_grades) if sizes.get(j)), F.lit(0.0)) if n else F.lit(0.0)
    best = found.where(F.col("texts") >= LEAST_TEXTS).select("word", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "word").limit(FEATURES).select("word").toArrow().column(0).to_numpy()
    vocabulary = np.sort(best.view(np.uint64)) if len(best) else np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast(vocabulary)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            flat = np.asarray(words.flatten()).view(np.uint64)
            ends = np.concatenate(([0], np.cumsum(np.asarray(words.value_lengths()))))
            at = np.minimum(np.searchsorted(shared.value, flat), max(len(shared.value) - 1, 0))
            hit = np.flatnonzero(shared.value[at] == flat) if len(shared.value) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, ends).astype(np.int32)), pa.array(at[hit].astype(np.int32)))], ["grade", "features"])

    sample = sample.mapInArrow(sparse, "grade int, features array<int>").toArrow().combine_chunks()
    # in an order of their own, so that rounding doesn't depend on the tasks
    sample = sorted(zip(sample.column("grade").to_pylist(), sample.column("features").to_pylist(), strict=True))
    features = [f for _, f in sample]
    grade = np.array([g for g, _ in sample], np.int64)
    row = np.repeat(np.arange(len(grade)), [len(f) for f in features]).astype(np.int64)
    feature = np.array([x for f in features for x in f], np.int64)
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    if split:
        grade = split_by_evidence(row, feature, grade, len(vocabulary), n_grades)
    weights, thresholds = fit_cumulative(row, feature, grade, len(vocabulary), n_grades)
    return OrdinalModel(vocabulary, weights, thresholds)


def severity(docs: DataFrame, model: OrdinalModel, reject_at: float = 0.5) -> DataFrame:
    """Severity of every row of docs (doc_id, text): doc_id, severity (expected grade), grade (likeliest), toxic.

    toxic: a grade of 1 or more has at least probability reject_at. Whole texts are read;
    null and empty texts have no words and so the base rates. Null and repeated ids come out
    as they went in; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.at_least(shared.value.scores(batch.column(1)))
            each = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= reject_at)], ["doc_id", "severity", "grade", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel, reject_at: float = 0.5) -> DataFrame:
    """docs (with a column text, and any others) without the rows that severity finds toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.at_least(shared.value.scores(batch.column(at).fill_null("")))
            yield batch.filter(pa.array(p[:, 0] < reject_at))

    return docs.mapInArrow(run, docs.schema)
