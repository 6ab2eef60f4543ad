"""Quality scores by positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, held_out, persisted, utf8_list

LETTER, UPPER, DIGIT, SPACE, MARK, SYMBOL, OTHER = range(7)
#: Features of a text, in order; see features().
NAMES = ("upper", "digit", "mark", "symbol", "other", "length", "word_length", "distinct", "top_word", "same_word", "lines", "pairs", "empty")


@cache
def _kinds() -> np.ndarray:
    def kind(c: str) -> int:
        if c.isalpha():
            return UPPER if c.isupper() else LETTER
        return DIGIT if c.isdigit() else SPACE if c.isspace() else MARK if c in ".,;:!?'\"()-¿¡«»’“”" else SYMBOL if c.isascii() else OTHER

    return np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


def features(text: bytes) -> list[float]:
    """Shares of kinds of characters (roots, so that small shares show), and of words: how long, how varied, how repeated."""
    parts = text.split()
    if not parts:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    points = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
    kinds = np.bincount(_kinds()[points], minlength=7)
    n, chars, letters = len(parts), len(points), kinds[LETTER] + kinds[UPPER]
    counts = Counter(parts)
    pairs = len(set(zip(parts, parts[1:]))) / (n - 1) if n > 1 else 1.0
    same = sum(a == b for a, b in zip(parts, parts[1:], strict=False)) / n
    share = lambda x: float(np.sqrt(x / chars))
    return [
        float(np.sqrt(kinds[UPPER] / letters)) if letters else 0.0,
        share(kinds[DIGIT]),
        share(kinds[MARK]),
        share(kinds[SYMBOL]),
        share(kinds[OTHER]),
        float(np.log1p(n)) / 5,
        min(1.0, chars / n / 20),
        len(counts) / n,
        max(counts.values()) / n if n > 20 else 0.0,
        float(np.sqrt(same)),
        float(np.sqrt(min(1.0, text.count(b"\n") / n))),
        pairs,
        0.0,
    ]


def feature_table(docs: DataFrame, keys: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The key columns and `x`, the features of each row's whole text as packed floats."""
    names = list(keys)
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), F.col(text_col).cast("string").alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            x = [np.array(features(t), "<f4").tobytes() for t in utf8_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(x, pa.binary())], [*names, "x"])

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names) + ", x binary"
    return rows.mapInArrow(compute, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, len(NAMES)).astype(np.float64)


class Model:
    """score = 1 / (1 + exp(-(w . (x - mean) / scale + bias)))."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
        self.mean, self.scale, self.w = mean, scale, w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(((x - self.mean) / self.scale), -8, 8) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def passed(table: DataFrame, work) -> np.ndarray:
    """The sum over all rows of work(features, trusted), an array of fixed size, added up in each task; [0] without rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = work(_matrix(batch.column("x")), batch.column("p").to_numpy(zero_copy_only=False).astype(bool))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, np.float64).tobytes()], pa.binary())], ["sum"])

    return sum((np.frombuffer(r[0]) for r in table.mapInArrow(part, "sum binary").collect()), np.zeros(1))


def fit(table: DataFrame, prior: float, steps: int = 80, rate: float = 0.1, decay: float = 1e-2) -> Model:
    """Minimises the non-negative unbiased risk prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]) with logistic loss.

    table: x, and `p`, true for trusted positives; every row counts as unlabelled. Each step is one pass over all rows that
    brings a gradient's sums from each task; nothing is sampled.
    """
    d = len(NAMES)

    sums = passed(table, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if len(sums) == 1 or not sums[1]:
        return Model(np.zeros(d), np.ones(d), np.append(np.zeros(d), np.log(prior / (1 - prior))))
    n_u, n_p, mean = sums[0], sums[1], sums[2 : 2 + d] / sums[0]
    scale = np.sqrt(np.maximum(sums[2 + d :] / n_u - mean * mean, 0))
    scale[scale < 1e-6] = 1.0
    w = np.append(np.zeros(d), np.log(prior / (1 - prior)))
    first, second = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        model = Model(mean, scale, w)

        def gradient(x: np.ndarray, p: np.ndarray, model: Model = model) -> np.ndarray:
            z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
            s = model.score(x)
            lost = -np.log(np.maximum(1 - s, 1e-13))
            # gradients of l(+) are (s - 1) z, of l(-) s z
            return np.concatenate([[lost.sum(), lost[p].sum()], s @ z, s[p] @ z[p], (s[p] - 1) @ z[p]])

        g = passed(table, gradient)
        negative = g[0] / n_u - prior * g[1] / n_p
        g_u, g_n, g_p = g[2 : 3 + d] / n_u, g[3 + d : 4 + 2 * d] / n_p, g[4 + 2 * d :] / n_p
        # below zero the negative risk is raised again instead of lowered further
        slope = prior * g_p + (g_u - prior * g_n if negative >= 0 else -(g_u - prior * g_n) - prior * g_p)
        slope = slope + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, w)


def estimated_prior(table: DataFrame, steps: int, bins: int = 512) -> float:
    """The share of positives among the unlabelled rows of table (x, p).

    Unlabelled text is a mixture, so that whatever texts are chosen, at least prior * (their share among positives) of all text
    is among them: the prior is at most the ratio of the two shares, and meets it where negatives are absent. Texts are chosen
    by the score of a model that another half of the rows gave (by hash of their features), from a fifth of the positives to
    all; the least ratio of each half counts, and both halves are averaged. 0.5 without positives.
    """
    rows, found = table.withColumn("half", F.pmod(F.xxhash64("x"), F.lit(2))), []
    for half in (0, 1):
        model = fit(rows.where(F.col("half") == half), 0.5, steps)

        def histogram(x: np.ndarray, p: np.ndarray, model: Model = model) -> np.ndarray:
            at = np.minimum((model.score(x) * bins).astype(int), bins - 1)
            return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at[p], minlength=bins)])

        held = passed(rows.where(F.col("half") == 1 - half), histogram)
        if len(held) > 1 and held[bins:].any():
            u, p = (np.cumsum(h[::-1]) / h.sum() for h in (held[:bins], held[bins:]))
            found.append(float((u / np.maximum(p, 1e-12))[p >= 0.2].min()))
    return min(0.99, max(0.01, float(np.mean(found)))) if found else 0.5


def trusted(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(label_id, label) of the rows that may be learned from: one for each id, its greatest label."""
    known = labels.select(F.col(id_col).cast("bigint").alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label_id is not null and label in (0, 1)")
    return known.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))


def learn(table: DataFrame, labels: DataFrame, id_col: str, label_col: str, steps: int) -> Model:
    """fit() on the rows (id, x) of table that aren't held out, with the trusted positives and the estimated prior."""
    known = trusted(labels, id_col, label_col)
    train = table.where(~held_out(F.col("id"))).join(known.where("label = 1"), F.col("id") == F.col("label_id"), "left")
    train = persisted(train.select("x", F.col("label_id").isNotNull().alias("p")), "quality-train")
    model = fit(train, estimated_prior(train, max(1, steps // 2)), steps)
    discard(train)
    return model


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, steps: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that quality_scores() predicts as 1: features are computed again where the
    rows are, so that texts are never shuffled."""
    table = persisted(feature_table(docs, {"id": F.col(id_col).cast("bigint")}, text_col), "quality-features")
    model = learn(table, labels, id_col, label_col, steps)
    discard(table)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            if batch.num_rows:
                x = np.array([features(t) for t in utf8_list(batch.column("text"))], "<f4").astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("row")], ["row"]).filter(pa.array(model.score(x) >= threshold))

    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    out = packed.mapInArrow(good, f"row {packed.schema['row'].dataType.simpleString()}")
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, steps: int = 80) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of docs; predicted is 1 from `threshold` on.

    Trusted positives are the texts whose label is 1, unlabelled text is all of docs, both without the held-out rows
    (held_out()); labels of 0 are not used, and a label that an id has twice counts once, as its greatest. The class prior is
    estimated from both (estimated_prior()). Scores see the whole text alone, however long. A null id is never labelled;
    repeated ids keep their rows; null and empty texts have a score of their own, and equal texts equal scores; without trusted
    positives every score is the prior; ids cast to bigint; other columns are not read, whatever their names; an empty table
    gives an empty result.
    """
    table = persisted(feature_table(docs, {"id": F.col(id_col).cast("bigint")}, text_col), "quality-features")
    model = learn(table, labels, id_col, label_col, steps)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(_matrix(batch.column("x"))))], ["id", "score"])

    out = table.mapInArrow(apply, "id bigint, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
