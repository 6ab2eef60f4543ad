"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units that no piece of the model crosses. Every distinct unit is encoded once, by DataFrame operations: its
substrings of bounded length are exploded, joined with the piece table, grouped by unit and folded with a higher-order
aggregate. The fold is Viterbi's for unigram models. For BPE models, whose encoding no sum of scores gives, it is the merge
order over the same edges: the best-scored edge that joins two neighbouring symbols, leftmost among equals, until none is left.
Over edges sorted by score, that is one pass over a word of border bits for nearly every unit (see one_pass()).
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary_tokens import _open, _put
from .common import by_bytes, discard, fresh_path, persisted, utf8_list

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Units over this many characters (their borders don't fit the bits of one number) are folded by Folder, an exact alternative
#: with the same rules in n log n steps.
LONGEST = 62
#: Characters below this are low: their own pieces are looked up by code point.
LOW = 592


@dataclass
class Model:
    kind: int
    #: (piece, id, score) of pieces that text can match
    pieces: list[tuple[str, int, float]]
    #: id of byte 0, or -1 without byte fallback
    bytes_at: int
    unknown: int
    #: what each id decodes to; a byte's value for byte pieces, "" for control pieces
    surface: list[str | int]
    prefix: bool
    #: a small number for each character that stands beside others in some piece (0: none), and which pairs of them do
    code: np.ndarray = field(default=None, repr=False)
    joins: np.ndarray = field(default=None, repr=False)

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @property
    def unknown_score(self) -> float:
        return min(s for _, _, s in self.pieces) - 10


def load_model(path: str) -> Model:
    """A model file whose normaliser is the identity (others change texts before pieces, which this module does not)."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the identity normaliser and kept white space are handled")
    return model_of(proto)


def model_of(proto) -> Model:
    normal, unknown_kind, control, user_defined, byte = 1, 2, 3, 4, 6
    if any(p.type == user_defined for p in proto.pieces):
        raise ValueError("user-defined pieces, which are cut out before all others, are not handled")
    if any(p.type == normal and len(p.piece) > 31 for p in proto.pieces):
        raise ValueError("pieces of over 31 characters are not handled")
    surface: list[str | int] = []
    for p in proto.pieces:
        surface.append(int(p.piece[3:5], 16) if p.type == byte else "" if p.type == control else proto.trainer_spec.unk_surface if p.type == unknown_kind else p.piece.replace(SPACE, " "))
    bytes_at = next((i for i, p in enumerate(proto.pieces) if p.type == byte), -1)
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == unknown_kind)
    model = Model(proto.trainer_spec.model_type, [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == normal], bytes_at, unknown, surface, proto.normalizer_spec.add_dummy_prefix)
    wide = [p for p, _, _ in model.pieces if len(p) > 1]
    number = {c: i for i, c in enumerate(sorted({c for p in wide for c in p}), 1)}
    model.code = np.zeros(0x110000, np.int32)
    model.code[[ord(c) for c in number]] = list(number.values())
    model.joins = np.zeros((len(number) + 1) ** 2, bool)
    for p in wide:
        for a, b in zip(p, p[1:], strict=False):
            model.joins[number[a] * (len(number) + 1) + number[b]] = True
    return model


def units(model: Model, text: bytes) -> list[str]:
    """The text's units, in order: cut between any two characters that no piece holds side by side, as no encoding joins them."""
    s = text.decode().replace(" ", SPACE)
    if not s:
        return []
    if model.prefix:
        s = SPACE + s
    codes = model.code[np.frombuffer(s.encode("utf-32-le"), "<u4")]
    cuts = np.flatnonzero(~model.joins[codes[:-1] * math.isqrt(len(model.joins)) + codes[1:]]) + 1
    at = [0, *cuts.tolist(), len(s)]
    return [s[a:b] for a, b in zip(at, at[1:], strict=False)]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row however often, and within whatever lambda, use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit_ids(edges: Column, word: Column, model: Model) -> Column:
    """Ids of a unit, given its edges array<struct<start int, len int, id int, score double>> (start from 1), as a fold."""
    key = lambda start, size: start * 32 + size
    table = lambda value, least: F.map_from_entries(F.transform(F.filter(edges, lambda e: e["len"] >= least), lambda e: F.struct(key(e["start"], e["len"]), e[value])))
    size = F.length(word)
    none = F.lit(float("-inf"))

    def merges(scores: Column) -> Column:
        def merge(cuts: Column, _: Column) -> Column:
            gain = F.transform(F.sequence(F.lit(0), F.size(cuts) - 3), lambda i: F.struct((-F.coalesce(F.element_at(scores, key(F.get(cuts, i), F.get(cuts, i + 2) - F.get(cuts, i))), none)).alias("cost"), i.alias("i")))
            joined = lambda best: F.when(best["cost"] == -none, F.concat(cuts, F.array(F.lit(0)))).otherwise(F.concat(F.slice(cuts, F.lit(1), best["i"] + 1), F.slice(cuts, best["i"] + 3, F.size(cuts))))
            # a last cut of 0 says that nothing is left to join
            return F.when((F.size(cuts) < 3) | (F.element_at(cuts, -1) == 0), cuts).otherwise(_let(F.array_min(gain), joined))

        return F.filter(F.aggregate(F.sequence(F.lit(1), size), F.sequence(F.lit(1), size + 1), merge), lambda x: x > 0)

    def paths(_: Column) -> Column:
        def reach(state: Column, end: Column) -> Column:
            # state: (score, length of the last piece) of the best way to each place from 0 on; equal scores: the longer piece
            arriving = F.transform(F.filter(edges, lambda e: e["start"] + e["len"] - 1 == end), lambda e: F.struct((F.get(state, end - e["len"])["score"] + e["score"]).alias("score"), e["len"].alias("len")))
            lone = F.struct((F.get(state, end - 1)["score"] + F.lit(model.unknown_score)).alias("score"), F.lit(1).alias("len"))
            return _let(arriving, lambda ways: F.concat(state, F.array(F.array_max(F.when(F.exists(ways, lambda e: e["len"] == 1), ways).otherwise(F.concat(ways, F.array(lone)))))))

        start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("len")))
        back = lambda best: F.aggregate(F.sequence(F.lit(1), size), F.array(size + 1), lambda cuts, _: F.when(F.get(cuts, F.lit(0)) <= 1, cuts).otherwise(F.concat(F.array(F.get(cuts, F.lit(0)) - F.get(best, F.get(cuts, F.lit(0)) - 1)["len"]), cuts)))
        return _let(F.aggregate(F.sequence(F.lit(1), size), start, reach), back)

    def symbols(cuts: Column, ids: Column) -> Column:
        def symbol(i: Column) -> Column:
            start, stop = F.get(cuts, i), F.get(cuts, i + 1)
            found = F.element_at(ids, key(start, stop - start))
            if model.bytes_at < 0:
                return F.array(F.coalesce(found, F.lit(model.unknown)))
            code = F.hex(F.encode(F.substring(word, start, stop - start), "UTF-8"))
            each = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + model.bytes_at)
            return F.when(found.isNull(), each).otherwise(F.array(found))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), symbol))

    fold = merges if model.kind == BPE else paths
    return _let(table("score", 2), lambda scores: _let(fold(scores), lambda cuts: _let(table("id", 1), lambda ids: symbols(cuts, ids))))


def piece_table(model: Model) -> list[tuple[str, int, float, int]]:
    """(piece, id, score, code) of every piece. The code holds, from its high bits on, the score's rank (0: best), room for
    the place and length of an edge, the id, and whether the piece is late: whether it splits into two symbols one of which
    has no better score, so that it may become possible after its turn by score has passed."""
    scores = {p: s for p, _, s in model.pieces}
    rank = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}

    def late(p: str, s: float) -> bool:
        splits = ((p[:k], p[k:]) for k in range(1, len(p)))
        return any(all(len(x) == 1 or x in scores for x in two) and any(len(x) > 1 and scores[x] <= s for x in two) for two in splits)

    if len(rank) >= 1 << 22 or max(i for _, i, _ in model.pieces) >= 1 << 22:
        raise ValueError("too many pieces")
    return [(p, i, s, rank[s] << 35 | len(p) << 23 | i << 1 | late(p, s)) for p, i, s in model.pieces]


_START, _LEN, _ID = "cast(shiftright(c, 29) & 63 as int)", "cast(shiftright(c, 23) & 63 as int)", "cast(shiftright(c, 1) & 4194303 as int)"
#: An edge from its code: start from 0, len, id, whether late, the bits of its two ends and those of the borders between.
_EDGE = f"struct({_START} as start, {_LEN} as len, {_ID} as id, c & 1 as late, shiftleft(1L, {_START}) | shiftleft(1L, {_START} + {_LEN}) as ends, shiftleft(shiftleft(1L, {_LEN}) - 2, {_START}) as inner)"


def one_pass(edges: str, size: str) -> Column:
    """The borders of a BPE unit's symbols, as bits, from its edges, sorted by code.

    Edges are taken once, best score first, leftmost among equals; one joins if its two ends are borders and one border lies
    between. Bit 63 is set if an edge of a late piece found more than one border between its ends: only then can it become
    possible after its turn, and the unit must be folded by repeated search.
    """
    return F.expr(
        f"aggregate({edges}, shiftrightunsigned(-1L, 63 - {size}), (s, e) -> case when (s & e.ends) <> e.ends or (s & e.inner) = 0 then s "
        "when (s & e.inner & ((s & e.inner) - 1)) = 0 then s & ~e.inner when e.late = 1 then s | shiftleft(1L, 63) else s end)"
    )


def encoded_units(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) of the distinct units in `word`, of LONGEST characters or fewer, by the lattice.

    Units stay where they are while their substrings are exploded, joined with the broadcast piece table (as large as the
    model) and grouped again by unit.
    """
    spark = words.sparkSession
    table = F.broadcast(spark.createDataFrame(piece_table(model), "piece string, id int, score double, code bigint"))
    size = F.length("word")
    starts = words.select("word", size.alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("start"))
    least = F.lit(1)
    if model.kind == BPE:  # low characters by themselves need no edge; one row stays for each unit all the same
        alone = f"start = 1 or ascii(substring(word, start, 1)) >= {LOW}"
        starts, least = starts.where(f"start < size or {alone}"), F.when(F.expr(alone), 1).otherwise(2)
    spans = starts.select("word", "start", F.explode(F.sequence(least, F.least(F.lit(model.longest), F.col("size") - F.col("start") + 1))).alias("len"))
    edges = spans.withColumn("piece", F.substring("word", F.col("start"), F.col("len"))).join(table, "piece", "left")
    edges = edges.where("id is not null or start = 1 and len = 1")
    if model.kind == BPE:
        # the ids of single low characters stand in a constant array by code point, those of others among the edges
        single = {ord(p): i for p, i, _ in model.pieces if len(p) == 1}
        points = F.lit(",".join(str(single.get(c, -1)) for c in range(LOW)))
        kept = f"case when len > 1 or ascii(piece) >= {LOW} then code + shiftleft(cast(start - 1 as bigint), 29) end"
        lattice = edges.groupBy("word").agg(F.collect_list(F.expr(kept)).alias("codes"))
        lattice = lattice.select("word", "codes", size.alias("size"), F.expr(f"transform(sort_array(codes), c -> {_EDGE})").alias("edges")).withColumn("borders", one_pass("edges", "size"))
        joined = "transform(filter(edges, e -> (borders & e.ends) = e.ends and (borders & e.inner) = 0), e -> struct(e.start as start, e.id as id))"
        lone = "transform(filter(sequence(0, size - 1), i -> (shiftright(borders, i) & 3) = 3), i -> struct(i as start, get(points, ascii(substring(word, i + 1, 1))) as id))"
        lattice = lattice.withColumn("points", F.split(points, ",").cast("array<int>"))
        # high characters have null here, and an edge of their own if they have a piece
        lattice = lattice.withColumn("symbols", F.expr(f"if(borders < 0, null, sort_array(concat({joined}, filter({lone}, x -> x.id is not null))))"))
        lattice = lattice.withColumn("found", F.expr("if(size(symbols) = bit_count(borders) - 1, transform(symbols, x -> x.id), null)"))
        known = "filter(sequence(1, size), i -> coalesce(get(points, ascii(substring(word, i, 1))), -1) >= 0)"
        ones = f"transform({known}, i -> struct(i as start, 1 as len, get(points, ascii(substring(word, i, 1))) as id, 0.0D as score))"
        again = F.expr(f"concat(transform(codes, c -> struct({_START} + 1 as start, {_LEN} as len, {_ID} as id, cast(-shiftright(c, 35) as double) as score)), {ones})")
        # late pieces, and bytes of characters without a piece, take the fold by repeated search
        short = lattice.select("word", F.when(F.expr("found is not null and not array_contains(found, -1)"), F.col("found")).otherwise(unit_ids(again, F.col("word"), model)).alias("ids"))
    else:
        lattice = edges.groupBy("word").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("start", "len", "id", "score"))).alias("edges"))
        short = lattice.select("word", unit_ids(F.col("edges"), F.col("word"), model).alias("ids"))

    return short


def folded_units(rows: DataFrame, model: Model) -> DataFrame:
    """rows (word, seg, place) of units over LONGEST characters as (seg, place, ids)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("seg"), batch.column("place"), pa.array([folder.ids(x) for x in batch.column("word").to_pylist()], pa.list_(pa.int32()))], ["seg", "place", "ids"])

    return rows.where(F.length("word") > LONGEST).mapInArrow(fold, "seg bigint, place int, ids array<int>")


class Folder:
    """Encodes single long units with the same rules as the lattice's fold, in n log n (BPE) or n (unigram) steps."""

    def __init__(self, model: Model):
        self.model, self.known = model, {p: (i, s) for p, i, s in model.pieces}

    def ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for piece in self._bpe(unit) if self.model.kind == BPE else self._viterbi(unit):
            if piece in self.known:
                out.append(self.known[piece][0])
            elif self.model.bytes_at >= 0:
                out += [self.model.bytes_at + b for b in piece.encode()]
            else:
                out.append(self.model.unknown)
        return out

    def _bpe(self, unit: str) -> list[str]:
        n = len(unit)
        stop, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b >= 0 and (hit := self.known.get(unit[a : stop[b]])):
                heapq.heappush(heap, (-hit[1], a, stop[a], stop[b]))

        for i in range(n):
            offer(i)
        while heap:
            _, a, mid, end = heapq.heappop(heap)
            if not alive[a] or stop[a] != mid or after[a] < 0 or stop[after[a]] != end:
                continue
            b = after[a]
            alive[b], stop[a], after[a] = False, end, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [unit[i : stop[i]] for i in range(n) if alive[i]]

    def _viterbi(self, unit: str) -> list[str]:
        best = [(0.0, 0)] + [(float("-inf"), 0)] * len(unit)
        for end in range(1, len(unit) + 1):
            for size in range(1, min(self.model.longest, end) + 1):
                hit = self.known.get(unit[end - size : end])
                score = hit[1] if hit else self.model.unknown_score if size == 1 else None
                if score is not None:
                    best[end] = max(best[end], (best[end - size][0] + score, size))
        out, end = [], len(unit)
        while end:
            out.append(unit[end - best[end][1] : end])
            end -= best[end][1]
        return out[::-1]


def frequent_units(rows: DataFrame, model: Model, head: int, sample: int) -> list[tuple[str, bytes]]:
    """(unit, ids as packed integers) of the `head` most frequent units of about `sample` documents, chosen by the hash of their texts."""
    n = rows.count()
    share = min(1.0, sample / max(1, n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in by_bytes(batches, "text", 2 << 20):
            for x in utf8_list(batch.column("text")):
                held.update(units(model, x))
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    some = rows.where(F.pmod(F.col("t"), F.lit(1_000_003)) < int(share * 1_000_003)).select("text")
    counted = some.mapInArrow(count, "word string, n bigint").where(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    top = persisted(counted.orderBy(F.desc("n"), "word").limit(head), "unit-head")
    found = encoded_units(top.select("word"), model).join(top, "word").orderBy(F.desc("n"), "word").select("word", "ids")
    out = [(r[0], np.array(r[1], "<i4").tobytes()) for r in found.toLocalIterator()]
    discard(top)
    return out


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", segment: int = 400_000, head: int = 100_000, sample: int = 20_000, ids: bool = True, check: bool = False) -> DataFrame:
    """(id_col, text_hash, ids array<int>) of every row of docs: the sentencepiece library's ids, without begin and end;
    text_hash is xxhash64 of the text (null: of the empty text). check adds, in the same pass over the ids, n_pieces, ids_crc32
    (unsigned crc32 of them as little-endian unsigned 32-bit integers) and round_trip (whether they decode to the text, by its
    hash); without `ids` the ids themselves are left out.

    Texts are cut in one pass. The `head` most frequent units of about `sample` documents, a bounded list, have numbers that
    all tasks know; it saves shuffling them and changes no result. A task numbers the other units of its documents in segments
    of about `segment` distinct units (a segment ends with the document that reaches it) and writes, to the shared folder, each
    segment's units and the documents as compressed numbers. Distinct units are encoded by the lattice and joined back with the
    segments' units, at most once a segment however frequent; the encodings of a segment, which `segment` bounds, become one
    file of the shared folder, which the tasks that read its documents load. Neither texts nor documents are shuffled. Null and
    empty texts have no ids; ids cast to bigint; null and repeated ids keep their rows; a unit of any length is encoded; an
    empty table gives an empty result. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    top = frequent_units(rows, model, head, sample) if head else []
    size = len(top)
    shared = spark.sparkContext.broadcast(({w: i for i, (w, _) in enumerate(top)}, [x for _, x in top]))
    uri = fresh_path(spark, "unit-segments")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze, part, count = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId(), 0
        names = ["seg", "place", "word", "id", "t", "packed", "tail"]

        known = shared.value[0]

        class Places(dict):
            def __missing__(self, unit: str) -> int:
                if (place := known.get(unit)) is None:
                    place = size + len(fresh)
                    fresh.append(unit)
                self[unit] = place
                return place

        fresh: list[str] = []
        places, held, n = Places(), [], 0

        def segment_rows() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, count
            # frequent units get the small numbers
            order = np.argsort(-np.bincount(np.concatenate([x for _, _, x in held]), minlength=size + len(fresh))[size:], kind="stable")
            rank = np.arange(size + len(fresh), dtype=np.int32)
            rank[size + order] = size + np.arange(len(order), dtype=np.int32)
            seg, words = part << 32 | count, [fresh[i] for i in order.tolist()]
            count += 1
            for at in range(0, len(words), 10_000):
                some = words[at : at + 10_000]
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([seg] * k, pa.int64()), pa.array(range(at, at + k), pa.int32()), pa.array(some, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32())], names)
            for at in range(0, len(held), 1000):
                some = held[at : at + 1000]
                k = len(some)
                # bytes of equal weight side by side: the higher ones are mostly zero
                packed = [squeeze(np.ascontiguousarray(rank[x].astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()) for _, _, x in some]
                yield pa.RecordBatch.from_arrays([pa.array([seg] * k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.string()), pa.array([x for x, _, _ in some], pa.int64()), pa.array([x for _, x, _ in some], pa.int64()), pa.array(packed, pa.binary()), pa.array([len(words)] * k, pa.int32())], names)
            fresh.clear()
            places.clear()
            held, n = [], 0

        for batch in by_bytes(batches, "text", 2 << 20):
            for i, t, x in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), utf8_list(batch.column("text")), strict=True):
                own = units(model, x)
                held.append((i, t, np.fromiter(map(places.__getitem__, own), np.int32, len(own))))
                n += len(own)
                if len(fresh) >= segment or n >= 1 << 23:
                    yield from segment_rows()
        if held:
            yield from segment_rows()

    numbered = persisted(rows.mapInArrow(number, "seg bigint, place int, word string, id bigint, t bigint, packed binary, tail int"), "units")
    named = numbered.where("word is not null").select("word", "seg", "place")
    # one shuffle by unit serves both the distinct units and their way back: all columns are read for either
    dealt = named.where(F.length("word") <= LONGEST).repartition("word")
    distinct = dealt.groupBy("word").agg(F.max("seg").alias("seg"), F.max("place").alias("place")).where("seg >= 0 and place >= 0").select("word")
    coded = dealt.join(encoded_units(distinct, model).hint("merge"), "word").select("seg", "place", "ids").unionByName(folded_units(named, model))
    # ids travel as digits of one width, a third of an array's size
    width = next(k for k in range(1, 8) if 36**k >= len(model.surface))
    code = F.array_join(F.transform("ids", lambda x: F.lpad(F.conv(x.cast("string"), 10, 36), width, "0")), "")
    coded = coded.select("seg", "place", code.alias("code"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(uri)
        fs.create_dir(base, recursive=True)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        lengths: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        before = None

        def put() -> None:
            n = np.concatenate(lengths)
            _put(fs, f"{base}/{before}", lambda f: f.write(squeeze(np.array([len(n)], "<i4").tobytes() + n.tobytes() + np.concatenate(flat).tobytes())))

        for batch in batches:
            segs = np.asarray(batch.column("seg"))
            cuts = [0, *(np.flatnonzero(np.diff(segs)) + 1).tolist(), len(segs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if segs[a] != before and lengths:
                    put()
                    lengths, flat = [], []
                before = int(segs[a])
                codes = batch.column("code").slice(a, b - a)
                lengths.append(np.asarray(pc.binary_length(codes), "<i4") // width)
                digits = np.frombuffer("".join(codes.to_pylist()).encode(), np.uint8).astype(np.int32)
                digits = np.where(digits >= ord("A"), digits - (ord("A") - 10), digits - ord("0")).reshape(-1, width)
                flat.append((digits @ (36 ** np.arange(width - 1, -1, -1, dtype=np.int64))).astype("<i4"))
        if lengths:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["n"])

    coded.repartition("seg").sortWithinPartitions("seg", "place").mapInArrow(store, "n bigint").agg(F.sum("n")).collect()

    schema = ["id bigint", "text_hash bigint"] + ["ids array<int>"] * ids + ["n_pieces bigint", "ids_crc32 bigint", "round_trip boolean"] * check
    names = [x.split()[0] for x in schema]
    surface, prefix = model.surface, model.prefix

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread, frequent = zstandard.ZstdDecompressor().decompress, shared.value[1]
        # what a unit's ids decode to: no run of byte pieces goes on beyond a unit
        text_of = lambda x: decode_ids(surface, False, np.frombuffer(x, "<i4").tolist()).encode()
        frequent_text = [text_of(x) for x in frequent] if check else []
        before, table, back = None, [], []

        def load(seg: int, tail: int) -> list[bytes]:
            if not tail:
                return []
            fs, base = _open(uri)
            with fs.open_input_file(f"{base}/{seg}") as f:
                flat = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(f.read()), "<i4")
            ends = (np.cumsum(flat[1 : tail + 1]) * 4).tolist()
            raw = flat[tail + 1 :].tobytes()
            return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

        for batch in by_bytes(batches, "packed", 1 << 20):
            keys, hashes, lengths, values, sums, same = [], [], [0], [], [], []
            for seg, i, t, packed, tail in zip(*(batch.column(c).to_pylist() for c in ("seg", "id", "t", "packed", "tail")), strict=True):
                if seg != before:
                    own = load(seg, tail)
                    before, table, back = seg, frequent + own, frequent_text + ([text_of(x) for x in own] if check else [])
                raw = np.frombuffer(spread(packed), np.uint8)
                numbers = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel().tolist() if len(raw) else []
                joined = b"".join(map(table.__getitem__, numbers))
                keys.append(i)
                hashes.append(t)
                lengths.append(lengths[-1] + len(joined) // 4)
                if ids:
                    values.append(joined)
                if check:
                    sums.append(zlib.crc32(joined))
                    decoded = b"".join(map(back.__getitem__, numbers))
                    decoded = decoded[1:] if prefix and decoded.startswith(b" ") else decoded
                    same.append(xxhash.xxh64_intdigest(decoded, 42) == t % (1 << 64))
            if not keys:
                continue
            arrays = [pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())]
            if ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.frombuffer(b"".join(values), "<i4"))))
            if check:
                arrays += [pa.array(np.diff(lengths), pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return numbered.where("word is null").select("seg", "id", "t", "packed", "tail").mapInArrow(fill, ", ".join(schema)).withColumnRenamed("id", id_col)


def decode_ids(surface: list[str | int], prefix: bool, ids: list[int]) -> str:
    """The text of a sequence of ids: pieces side by side, runs of byte pieces as UTF-8 (invalid bytes replaced), without the dummy prefix."""
    out: list[str] = []
    run = bytearray()
    for x in map(surface.__getitem__, ids):
        if isinstance(x, int):
            run.append(x)
        else:
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(x)
    if run:
        out.append(run.decode("utf-8", "replace"))
    text = "".join(out)
    return text[1:] if prefix and text.startswith(" ") else text


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """encoded with the decoded text of `ids_col` as `to_col` (replaced if it exists); null for null ids."""
    surface, prefix = model.surface, model.prefix
    kept = [c for c in encoded.columns if c != to_col]

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [None if x is None else decode_ids(surface, prefix, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own, pa.string())], ["row", "decoded"])

    packed = encoded.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(ids_col).cast("array<int>").alias("ids"))
    out = packed.mapInArrow(text, f"row {packed.schema['row'].dataType.simpleString()}, decoded string")
    return out.select(*(F.col("row")[c].alias(c) for c in kept), F.col("decoded").alias(to_col))
