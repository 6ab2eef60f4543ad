"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, held_out, utf8_list

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: bytes) -> np.ndarray:
    """Codes of the 1- to 3-grams of a text's lower-cased words, each word with a border (0) on both sides; empty without a letter."""
    points = np.frombuffer(text.decode().lower().encode("utf-32-le"), "<u4")
    flat = np.zeros(len(points) + 2, np.uint64)
    flat[1:-1] = np.where(_letters()[points], points, 0)
    one, two = flat[:-1], (flat[:-1] << np.uint64(21)) | flat[1:]
    three = (two[:-1] << np.uint64(21)) | flat[2:]
    return np.concatenate([one[one > 0], two[(flat[:-1] > 0) | (flat[1:] > 0)], three[flat[1:-1] > 0]])


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The `most` most frequent codes, most frequent first; equal counts in order of the codes."""
    found, counts = np.unique(codes, return_counts=True)
    if len(found) > most:
        least = np.partition(counts, -most)[-most]
        keep = counts >= least
        found, counts = found[keep], counts[keep]
    return found[np.lexsort((found, -counts))[:most]]


def language_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 400) -> DataFrame:
    """(lang, gram, place): the `most` most frequent n-grams of each language over all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            codes, n = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in by_bytes(batches, "text", 4 << 20):
            own: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), utf8_list(batch.column("text")), strict=True):
                own.setdefault(lang, []).append(grams(text))
            for lang, lists in own.items():
                codes, n = np.unique(np.concatenate(lists), return_counts=True)
                if lang in held:
                    before = held[lang]
                    codes, where = np.unique(np.concatenate([before[0], codes]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([before[1], n])).astype(np.int64)
                held[lang] = (codes, n.astype(np.int64))
                if len(codes) > 1_000_000:
                    yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= most).select("lang", "gram", (F.col("place") - 1).alias("place"))


def predict_language(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 400) -> DataFrame:
    """(id_col, lang_pred, score): the language whose profile is nearest by out-of-place distance to the text's own ranking.

    Each of the text's `most` most frequent n-grams adds the difference of its two ranks, or `most` where the profile lacks
    it. score is 1 - nearest / next nearest distance (1 - nearest / greatest possible with a single profile). Equal distances
    go to the first language in order. Null text, text without a letter, or no profile at all: `und`, 0. The profiles (`most`
    rows for each language) are sent to every task.
    """
    table = profiles.collect()
    langs = sorted({r["lang"] for r in table})
    known = np.unique(np.array([r["gram"] for r in table], np.uint64))
    place = np.full((len(known) + 1, len(langs)), -1, np.int32)
    for r in table:
        place[np.searchsorted(known, np.uint64(r["gram"])), langs.index(r["lang"])] = r["place"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = [nearest(x) for x in utf8_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    def nearest(text: bytes) -> tuple[str, float]:
        own = ranked(grams(text), most)
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(known, own)
        at[known[np.minimum(at, len(known) - 1)] != own] = len(known)
        theirs = place[at]
        off = np.where(theirs < 0, most, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        order = np.argsort(off, kind="stable")
        first, worst = int(off[order[0]]), int(off[order[1]]) if len(langs) > 1 else len(own) * most
        return langs[order[0]], 1 - first / worst if worst else 0.0

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 400) -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row: profiles are learned from the rows that aren't held out and have a
    language, by text and language alone. Texts of any length are ranked whole; equal texts get equal answers; null and repeated
    ids keep their rows; ids cast to bigint; other columns are not read, whatever their names; an empty table gives an empty
    result."""
    profiles = language_profiles(docs.where(~held_out(F.col(id_col))), lang_col, text_col, most)
    out = predict_language(docs, profiles, id_col, text_col, most)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
