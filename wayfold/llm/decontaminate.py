"""Benchmark decontamination by latent semantic retrieval and exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary_tokens import _open
from .common import by_bytes, discard, persisted, utf8_list
from .license_scan import words as ascii_words

#: Terms of the TF-IDF space: words meet in one by hash.
TERMS = 1 << 15
PASSAGE = 32  # most words of a benchmark passage
#: (most words of a passage, words of a window, words between the starts of two windows): every run as long as the passage lies
#: within some window, which has at most a quarter or so of other words
SIZES = ((12, 16, 4), (20, 24, 4), (PASSAGE, 40, 8))
#: Windows start at multiples of this, so that latent vectors are summed over as many words once for all sizes.
STEP = 4
#: Passages for each dimension of the space, at least.
FITTED = 4
#: Items under this many words are looked for by their words, in windows that are a quarter longer than they are.
SHORT = 9


#: A word's mark in a signature of BITS bits, by its term.
BITS = 512
MARKS = np.zeros((BITS, BITS // 64), np.uint64)
MARKS[np.arange(BITS), np.arange(BITS) // 64] = np.uint64(1) << (np.arange(BITS, dtype=np.uint64) % np.uint64(64))


def words(text: bytes) -> list[bytes]:
    """Words of a text without regard to case in any script."""
    return ascii_words(text if text.isascii() else text.decode().lower().encode())


def terms_of(parts: Iterable[bytes], n: int) -> np.ndarray:
    """The terms of n words. A hash costs no more than to look a word up, and most words of a large corpus are new ones."""
    return (np.fromiter(map(xxhash.xxh32_intdigest, parts), np.uint32, n) % TERMS).astype(np.int32)


@dataclass
class Passage:
    item: int
    words: list[bytes]
    #: the item's last sentence, or its last words where that is long: what answers it
    answer: list[bytes]


def passages(item: int, text: str) -> list[Passage]:
    """An item cut into overlapping passages of PASSAGE words at most; without words, none."""
    own = words(text.encode())
    if not own:
        return []
    last = [s for s in text.replace("?", ".").replace("\n", ".").split(".") if words(s.encode())][-1:]
    answer = words(last[0].encode())[-8:] if last else own[-8:]
    size = min(PASSAGE, len(own))
    n = max(1, math.ceil((len(own) - 8) / (PASSAGE - 8))) if len(own) > PASSAGE else 1
    cuts = [round(k * (len(own) - size) / max(1, n - 1)) for k in range(n)]
    return [Passage(item, own[at : at + size], answer) for at in cuts]


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def survey(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n), one pass over all of docs: with each term the number of a task's documents that hold it, at term -1 the number of
    its documents."""
    text = F.col(text_col).cast("string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(TERMS, np.int64), 0
        for batch in by_bytes(batches, "text"):
            for x in utf8_list(batch.column("text")):
                own = set(words(x))
                held[terms_of(own, len(own))] += 1  # once a term, however many of the words meet in it
                n += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *held[at].tolist()], pa.int64())], ["term", "n"])

    return docs.select(text.alias("text")).mapInArrow(count, "term int, n bigint")


def inverse_frequencies(counted: DataFrame) -> np.ndarray:
    """The weight of each of the TERMS terms, from survey()."""
    df, n = np.zeros(TERMS), 0
    for term, k in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
        if term < 0:
            n = k
        else:
            df[term] = k
    return np.log((n + 2) / (df + 1))


def randomised_svd(rows: DataFrame, n_terms: int, rank: int, seed: int = 11, power: int = 1, chunks: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (n_terms x k) and singular values of a sparse matrix given as rows (terms array<int>, weights
    array<float>), greatest first; directions without weight are left out.

    Each pass multiplies the distributed rows with a dense n_terms x k matrix; the tasks' products are summed in `chunks` blocks
    of terms by a shuffle, and orthogonal bases are taken on the driver. All that it holds is n_terms x (rank + 8), whatever
    the rows.
    """
    sc, k = rows.sparkSession.sparkContext, max(1, min(rank + 8, n_terms))
    edges = np.linspace(0, n_terms, chunks + 1).astype(int).tolist()

    def through(dense: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(dense.astype(np.float32))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, out = shared.value, np.zeros((n_terms, k), np.float32)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    terms, weights = batch.column("terms").slice(at, 4096), batch.column("weights").slice(at, 4096)
                    sizes = np.asarray(terms.value_lengths(), np.int64)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    flat, w = np.asarray(terms.flatten(), np.int64), np.asarray(weights.flatten(), np.float32)[:, None]
                    if not len(flat):
                        continue
                    by_row = np.add.reduceat(w * own[flat], np.flatnonzero(np.diff(row, prepend=-1)), axis=0)
                    order = np.argsort(flat, kind="stable")
                    flat, dense_row = flat[order], np.cumsum(np.diff(row, prepend=row[0]) > 0)
                    first = np.flatnonzero(np.diff(flat, prepend=-1))
                    out[flat[first]] += np.add.reduceat(w[order] * by_row[dense_row[order]], first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([out[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["chunk", "sum"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, x in zip(batch.column("chunk").to_pylist(), batch.column("sum").to_pylist(), strict=True):
                    held[c] = held.get(c, 0) + np.frombuffer(x, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["chunk", "sum"])

        schema = "chunk int, sum binary"
        found = {c: x for c, x in rows.mapInArrow(part, schema).repartition(min(chunks, 8), "chunk").mapInArrow(total, schema).collect()}
        shared.destroy()
        if not found:
            return np.zeros((n_terms, k))
        return np.frombuffer(b"".join(found[c] for c in range(chunks)), np.float32).reshape(n_terms, k).astype(np.float64)

    dense = np.random.default_rng(seed).standard_normal((n_terms, k))
    for _ in range(power + 1):
        dense = np.linalg.qr(through(dense))[0]
    # squared singular values of A Q from Q' A' A Q, to turn Q into singular vectors and drop empty directions
    values, turn = np.linalg.eigh(dense.T @ through(dense))
    keep = np.argsort(-values)[: min(rank, k)]
    keep = keep[values[keep] > 1e-6 * max(values.max(), 1e-300)]
    return dense @ turn[:, keep], np.sqrt(values[keep])


def _weights(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, tf = np.unique(ids, return_counts=True)
    w = tf * idf[terms]
    return terms, w / max(1e-12, float(np.sqrt((w * w).sum())))


class Retriever:
    """Finds the windows of a text near a benchmark passage in the latent space, and checks them word by word.

    basis: for each term what one occurrence adds to a latent vector (terms x k, single precision).
    """

    def __init__(self, found: list[Passage], basis: np.ndarray, cosine: float, sure: float, likely: float):
        self.basis, self.cosine, self.sure, self.likely = basis, cosine, sure, likely
        self.sizes, least, held, needs = [], SHORT, [], []
        for most, window, stride in SIZES:
            own = [p for p in found if least <= len(p.words) <= most]
            if own:
                ids = [terms_of(p.words, len(p.words)) for p in own]
                latent = _unit(np.stack([basis[x].sum(axis=0) for x in ids]))
                need = np.array([max(1, math.ceil(min(likely, sure) * len(p.words))) for p in own])
                marks = np.stack([np.bitwise_or.reduce(MARKS[x % BITS], axis=0) for x in ids])
                # each absent mark is an absent word at least, and no more words than these may be absent
                least_marks = np.bitwise_count(marks).sum(axis=1) - (np.array(list(map(len, ids))) - need)
                self.sizes.append((own, latent.T.copy(), marks, least_marks, window, stride, slice(len(held), len(held) + len(own))))
                held += ids
                needs += need.tolist()
            least = most + 1
        self.short, self.short_from = [p for p in found if len(p.words) < SHORT], len(held)
        self.short_needs = [max(1, math.ceil(sure * len(p.words) - 1e-9)) for p in self.short]
        held += [terms_of(p.words, len(p.words)) for p in self.short]
        needs += self.short_needs
        self.short_terms = [np.unique(x) for x in held[self.short_from :]]
        # for each term the passages that hold it, once for each place
        flat = np.concatenate([np.zeros(0, np.int32), *held])
        order = np.argsort(flat, kind="stable")
        self.holders = np.repeat(np.arange(len(held)), list(map(len, held)))[order]
        self.at = np.searchsorted(flat[order], np.arange(TERMS + 1))
        self.needs = np.array(needs, np.int64)

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """Which passages have enough of their words among `ids`: no text without them can hold enough in order."""
        own = np.unique(ids)
        a, n = self.at[own], self.at[own + 1] - self.at[own]
        spots = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.holders[spots], minlength=len(self.needs)) >= self.needs

    def matches(self, text: bytes) -> dict[int, float]:
        """item -> share of a passage's words in order, of the items that a text holds."""
        parts = words(text)
        found: dict[int, float] = {}
        if not parts or not len(self.needs):
            return found
        ids = terms_of(parts, len(parts))
        for lo in range(0, len(parts), 1 << 10):  # slices that overlap by a window and its surroundings
            hi = min(len(parts), lo + (1 << 10) + 2 * PASSAGE)
            possible = self.possible(ids[max(0, lo - PASSAGE) : hi + PASSAGE])
            for j in np.flatnonzero(possible[self.short_from :]).tolist():
                self._check_short(found, parts, ids[lo:hi], lo, j)
            sums = None
            for own, latent, marks, least_marks, window, stride, part in self.sizes:
                which = np.flatnonzero(possible[part])
                if not len(which):
                    continue
                starts = np.arange(0, max(1, hi - lo - window + stride), stride)
                ends = np.minimum(starts + window, hi - lo)
                if sums is None:
                    steps = np.add.reduceat(np.take(self.basis, ids[lo:hi], axis=0, mode="clip"), np.arange(0, hi - lo, STEP), axis=0)
                    sums = np.zeros((len(steps) + 1, self.basis.shape[1]), np.float32)
                    np.cumsum(steps, axis=0, out=sums[1:])
                near = _unit(sums[-(-ends // STEP)] - sums[starts // STEP])
                for block in range(0, len(which), 1024):
                    some = which[block : block + 1024]
                    hits = np.flatnonzero(near @ (latent if len(some) == latent.shape[1] else latent[:, some]) >= self.cosine)
                    if len(hits):
                        rows, cols = np.divmod(hits, len(some))
                        cols = some[cols]
                        # candidates whose region lacks too many of the passage's words go before the word-by-word check
                        some_rows, place = np.unique(rows, return_inverse=True)
                        a, b = np.maximum(0, lo + starts[some_rows] - stride), np.minimum(len(parts), lo + ends[some_rows] + stride)
                        flat = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
                        have = np.bitwise_or.reduceat(np.take(MARKS, ids[flat] % BITS, axis=0, mode="clip"), np.concatenate([[0], np.cumsum(b - a)[:-1]]), axis=0)
                        keep = np.bitwise_count(have[place] & marks[cols]).sum(axis=1) >= least_marks[cols]
                        self._check(found, parts, own, a[place[keep]], b[place[keep]], cols[keep])
        return found

    def _check_short(self, found: dict[int, float], parts: list[bytes], ids: np.ndarray, lo: int, j: int) -> None:
        """Compares a short item with every window that starts at one of its words and holds enough of them."""
        p, need = self.short[j], self.short_needs[j]
        n, window = len(p.words), len(p.words) + -(-len(p.words) // 4)
        at = np.flatnonzero(np.isin(ids, self.short_terms[j]))
        for a in at[np.searchsorted(at, at + window) - np.arange(len(at)) >= need].tolist():
            if found.get(p.item, 0) >= 1:
                return
            held = lcs(p.words, parts[lo + a : lo + a + window])
            if held >= need:
                found[p.item] = max(found.get(p.item, 0.0), held / n)

    def _check(self, found: dict[int, float], parts: list[bytes], own: list[Passage], starts: np.ndarray, ends: np.ndarray, cols: np.ndarray) -> None:
        """Compares regions of the text with passages word by word."""
        for a, b, j in zip(starts.tolist(), ends.tolist(), cols.tolist(), strict=True):
            p = own[j]
            if found.get(p.item, 0) >= 1:
                continue
            region, n = parts[a:b], len(p.words)
            if sum(map(set(region).__contains__, p.words)) < min(self.likely, self.sure) * n:  # no more can stand in order
                continue
            share = lcs(p.words, region) / n
            if share >= self.sure or share >= self.likely and lcs(p.answer, region) >= self.sure * len(p.answer):
                found[p.item] = max(found.get(p.item, 0.0), share)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _load(uri: str) -> list[Passage]:
    fs, base = _open(uri)
    rows = pq.read_table(base, filesystem=fs).sort_by([("item", "ascending"), ("words", "ascending")]).to_pylist()
    return [Passage(r["item"], r["words"].split(b" "), r["answer"].split(b" ")) for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rank: int = 64, cosine: float = 0.48, sure: float = 0.8, likely: float = 0.6) -> DataFrame:
    """docs with two more columns: `bench_items` (sorted ids of the benchmark items whose passages a text holds) and
    `bench_share` (greatest share of a passage's words found in order; 0 without items).

    Document frequencies are counted over all documents. The space is a distributed randomised SVD of rank `rank`, or a FITTED-th
    of the passages where they are few, of the TF-IDF passages of the whole benchmark: what no passage holds adds nothing to a
    window's place in it. Latent coordinates are those of the left singular vectors, in which unlike passages are
    about equally far in every direction. Every window of every text is compared there with the passages of its size, in blocks,
    but for passages that lack too many words in that stretch of the text to pass the check; windows with a cosine of `cosine` or more are checked: a passage is held if `sure` of its words stand in the window
    in order, or `likely` of them and the item's answer. Items under SHORT words have too little weight to be retrieved: every
    window a quarter longer than such an item that has enough of its words is checked, for `sure` of them in order (fewer with the
    answer would be chance in so few words); items without words are never held.
    The benchmark is read by the tasks from a table in the shared folder, never by the driver; texts are never shuffled, and very
    long ones are searched in overlapping slices. Null or empty texts, an empty benchmark, items without id or text: no items.
    Of equally near passages all are checked. Rows, repeated ones too, and other columns of docs stay as they are; columns named
    like the two new ones are replaced; an empty table gives an empty result.
    """
    spark, new = docs.sparkSession, ("bench_items", "bench_share")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            own = [p for i, x in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in passages(i, x)]
            yield pa.RecordBatch.from_arrays([pa.array([p.item for p in own], pa.int64()), pa.array([b" ".join(p.words) for p in own], pa.binary()), pa.array([b" ".join(p.answer) for p in own], pa.binary())], ["item", "words", "answer"])

    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text")).dropna()
    table = persisted(items.mapInArrow(cut, "item bigint, words binary, answer binary").distinct(), "bench-passages")
    kept = [c for c in docs.columns if c not in new]
    n_passages = table.count()
    if not n_passages:
        return docs.select(*(F.col(f"`{c}`") for c in kept), F.array().cast("array<bigint>").alias("bench_items"), F.lit(0.0).alias("bench_share"))
    counted = persisted(survey(docs, text_col), "bench-survey")
    idf = inverse_frequencies(counted)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_weights(terms_of(x, len(x)), idf) for x in (x.split(b" ") for x in batch.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in own], pa.list_(pa.int32())), pa.array([w for _, w in own], pa.list_(pa.float32()))], ["terms", "weights"])

    rows = persisted(table.select("words").mapInArrow(weigh, "terms array<int>, weights array<float>"), "bench-rows")
    # with a rank near the number of rows every fitted row would stand at right angles to all others, its own copies' too
    vectors, values = randomised_svd(rows.coalesce(4), TERMS, max(1, min(rank, n_passages // FITTED)))
    discard(counted)
    discard(rows)
    basis = spark.sparkContext.broadcast((vectors * idf[:, None] / np.maximum(values, 1e-12)).astype(np.float32))
    uri = table._wayfold_path

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        retriever = None
        for batch in by_bytes(batches, "text"):
            retriever = retriever or Retriever(_load(uri), basis.value, cosine, sure, likely)
            hits = [retriever.matches(x) for x in utf8_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([sorted(h) for h in hits], pa.list_(pa.int64())), pa.array([max(h.values(), default=0.0) for h in hits], pa.float64())], ["row", *new])

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(search, f"row {kind}, bench_items array<bigint>, bench_share double")
    return out.select(*(F.col("row")[c].alias(c) for c in kept), *new)
