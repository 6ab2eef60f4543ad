"""Alignment of two tokenizers' encodings of the same texts: segments are aligned once and composed to documents."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary_tokens import _open, _put
from .common import by_bytes, discard, fresh_path, persisted, utf8_list

# Unicode's white space, as both tokenizers' rules know it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: An id pair is one number: a * PAIR + b. A segment's place in its block takes so many bits.
PAIR, PLACES = 1 << 31, 28


def _byte_of() -> dict[str, int]:
    """Byte-level entries' characters: printable Latin-1 stands for itself, the other bytes, in order, for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """A byte-level BPE file of the tokenizers library (A) and a sentencepiece model (B), and where texts may be cut for both.

    A text is cut before white space that follows something else. A's splitting rule ends a token there and looks no further
    (checked: byte-level rule without normaliser, and no added token but special ones, which are taken as plain text). B has no
    such rule; `cuts` are the white-space characters that none of its pieces holds behind another character, so that no merge
    reaches over. Where A's rule is another or B normalises texts, `cuts` is empty and texts stay whole.
    """

    def __init__(self, byte_bpe: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        with open(byte_bpe, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of, entries = _byte_of(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if byte_of.keys() >= set(token) else token.encode()
        proto = sentencepiece_model_pb2.ModelProto()
        with open(piece_model, "rb") as f:
            proto.ParseFromString(f.read())
        unknown, control, byte = 2, 3, 6
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == byte else p.piece.replace("▁", " ").encode() for p in proto.pieces]
        white = set(WHITE)
        spelt = [p.piece.replace("▁", " ") for p in proto.pieces if p.type not in (unknown, control, byte)]
        joined = {c for s in spelt for b, c in zip(s, s[1:], strict=False) if c in white and b not in white}
        rule = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and all(x["special"] for x in spec.get("added_tokens", []))
        plain = plain and proto.normalizer_spec.name == "identity" and not proto.normalizer_spec.remove_extra_whitespaces
        self.cuts = "".join(c for c in WHITE if c not in joined) if plain else ""
        other = "".join(c for c in WHITE if c in joined)
        own, out = f"[{re.escape(WHITE)}]+", f"[^{re.escape(WHITE)}]*"
        self.segment = re.compile(own + out + (f"(?:[{re.escape(other)}]{own[:-1]}*{out})*" if other else "")) if self.cuts else None
        # the space in front is part of the segments
        proto.normalizer_spec.add_dummy_prefix = False
        self.b = SentencePieceProcessor(model_proto=proto.SerializeToString())

    def segments(self, text: str) -> list[str]:
        """The segments of a space and the text; each but the first starts with white space that follows another character."""
        spaced = " " + text
        return self.segment.findall(spaced) if self.segment else [spaced]

    @property
    def link(self) -> np.dtype:
        """A link: the two tokens, and which of them ends with it: 0 both (a group ends too), 1 that of A, 2 that of B."""
        size = "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4"
        return np.dtype([("a", size), ("b", size), ("ends", "u1")])

    def aligned(self, segments: list[str]) -> tuple[np.ndarray, list[int]]:
        """(links of all segments, their number for each segment: 0 where the bytes of an encoding differ from the segment's)."""
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        links: list[tuple[int, int, int]] = []
        counts = []
        for s, a, b in zip(segments, encode(segments, add_special_tokens=False), self.b.encode(segments, num_threads=1), strict=True):
            before = len(links)
            self._align(s.encode(), a.ids, b, links)
            counts.append(len(links) - before)
        return np.array(links, self.link), counts

    def _align(self, raw: bytes, a: list[int], b: list[int], links: list[tuple[int, int, int]]) -> None:
        left, right = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(left) != raw or b"".join(right) != raw:
            return
        i = j = 0
        a_end, b_end = len(left[0]), len(right[0])
        while True:  # the two tokens that stand here overlap
            if a_end == b_end:
                links.append((a[i], b[j], 0))
                i, j = i + 1, j + 1
                if i == len(a):
                    return
                a_end, b_end = a_end + len(left[i]), b_end + len(right[j])
            elif a_end < b_end:
                links.append((a[i], b[j], 1))
                i += 1
                a_end += len(left[i])
            else:
                links.append((a[i], b[j], 2))
                j += 1
                b_end += len(right[j])


@functools.lru_cache(1)
def _vocabularies(byte_bpe: str, piece_model: str) -> Vocabularies:
    return Vocabularies(byte_bpe, piece_model)


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, bytes of equal weight side by side: the higher ones are mostly zero."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches (start, length), one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    sizes = np.array([x.nbytes for x in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _spread(packed: bytes, *kinds: str | np.dtype) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(packed)
    ends = np.cumsum(np.frombuffer(raw, "<i8", len(kinds))) + 8 * len(kinds)
    return [np.frombuffer(raw[a:b], kind) for a, b, kind in zip([8 * len(kinds), *ends], ends, kinds, strict=False)]


def _filed(rows: DataFrame, uri: str, kinds: tuple[str, ...]) -> None:
    """Writes rows (block, place, values) as one file a block of the shared folder, in the order of places.

    kinds are the types of place and the values; a last one of "u1*" is of bytes of any length, which take a value for their
    lengths. Rows of a block are packed together before they are shuffled.
    """
    names = [f"c{i}" for i in range(len(kinds))]
    loose = kinds[-1] == "u1*"
    plain = kinds[: -1 if loose else None]

    def arrays(table: pa.Table) -> list[np.ndarray]:
        out = [np.asarray(table.column(n).combine_chunks()).astype(k) for n, k in zip(names, plain, strict=False)]
        if loose:
            own = table.column(names[-1]).combine_chunks()
            out += [np.asarray(pc.binary_length(own), "<i4"), np.frombuffer(b"".join(own.to_pylist()), np.uint8)]
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            blocks = np.asarray(table.column("block").combine_chunks())
            order = np.lexsort((np.asarray(table.column("c0").combine_chunks()), blocks))
            table, blocks = table.take(pa.array(order)), blocks[order]
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            own = [(blocks[a], _squeeze(*arrays(table.slice(a, b - a)))) for a, b in zip(cuts, cuts[1:], strict=False)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], ["block", "packed"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= 1 << 18 or sum(x.nbytes for x in held) >= 32 << 20:
                yield packed()
        if held:
            yield packed()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(uri)
        fs.create_dir(base, recursive=True)
        held: list[bytes] = []
        before = None

        def save() -> None:
            each = [_spread(x, *plain, *(["<i4", "u1"] if loose else [])) for x in held]
            columns = [np.concatenate(x) for x in zip(*each, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            if loose:
                lengths, flat = columns[-2], columns[-1]
                starts = np.cumsum(lengths, dtype=np.int64) - lengths
                columns[-1] = flat[_ragged(starts[order], lengths[order].astype(np.int64))]
            out = [c[order] for c in columns[: -1 if loose else None]] + columns[-1:] * loose
            _put(fs, f"{base}/{before}", lambda f: f.write(_squeeze(*out)))
            held.clear()

        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if held and block != before:
                    save()
                before = block
                held.append(packed)
        if held:
            save()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["n"])

    packed = rows.toDF("block", *names).mapInArrow(pack, "block bigint, packed binary")
    packed.repartition("block").sortWithinPartitions("block").mapInArrow(store, "n bigint").agg(F.sum("n")).collect()


def _load(uri: str, block: int, *kinds: str) -> list[np.ndarray] | None:
    fs, base = _open(uri)
    if not fs.get_file_info(f"{base}/{block}").is_file:
        return None
    with fs.open_input_file(f"{base}/{block}") as f:
        return _spread(f.read(), *kinds)


class _Block:
    """A block's segments: whether each holds, the number of its links, and its pairs by local numbers."""

    def __init__(self, uri: str, block: int, link: np.dtype):
        _, sizes, flat = _load(uri, block, "<i4", "<i4", "u1")
        self.links = np.frombuffer(flat.tobytes(), link)
        self.lengths = sizes.astype(np.int64) // link.itemsize
        self.holds = self.lengths > 0
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pairs, self.numbers = np.unique(self.links["a"].astype(np.int64) * PAIR + self.links["b"], return_inverse=True)

    def total(self, each: np.ndarray) -> np.ndarray:
        """Sums over the links of every segment."""
        sums = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        return sums[self.starts + self.lengths] - sums[self.starts]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Which links are the first of their A token, and of their B token."""
        begins = np.zeros(len(self.links) + 1, bool)
        begins[self.starts[self.holds]] = True
        after = np.concatenate([[0], self.links["ends"][:-1]])[: len(self.links)]
        return begins[:-1] | (after != 2), begins[:-1] | (after != 1)

    def groups(self, step: int = 20_000) -> list[str]:
        """The groups of every segment as text, made for `step` segments at a time."""
        out: list[str] = []
        starts_a, starts_b = self.tokens()
        for at in range(0, len(self.holds), step):
            holds = self.holds[at : at + step]
            low, lengths = int(self.starts[at]), self.lengths[at : at + step]
            own = slice(low, low + int(lengths.sum()))
            links, a, b = self.links[own], starts_a[own], starts_b[own]
            ends = links["ends"] == 0
            group = np.cumsum(ends) - ends
            ids = np.concatenate([links["a"][a], links["b"][b]])
            side = np.concatenate([2 * group[a], 2 * group[b] + 1])
            order = np.argsort(side, kind="stable")
            ids, side = ids[order].tolist(), side[order]
            last = np.append(np.diff(side) != 0, True)[: len(side)]
            closes = np.zeros(int(ends.sum()) + 1, bool)  # groups that end a segment
            closes[group[np.cumsum(lengths)[holds] - 1]] = True
            mark = np.where(~last, 0, np.where(side % 2 == 0, 1, np.where(closes[side // 2], 3, 2))).tolist()
            said = iter("".join([f"{i}{',|;\n'[m]}" for i, m in zip(ids, mark, strict=True)]).split("\n"))
            out += [next(said) if x else "" for x in holds.tolist()]
        return out


def align_tokens(docs: DataFrame, byte_bpe: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", segments: int = 400_000, occurrences: int = 1 << 22) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of docs: a space and the text as tokens of A
    and B, in groups whose borders are where tokens of both end; groups is text, ``a1,a2|b1;a3|b2,b3``.

    n_links: pairs of tokens that share bytes. A pair's count is the number of rows that hold it linked; count_sum adds the
    counts of a text's links, n_best counts the links whose pair is (with others, if equal) the most frequent of its A token.

    Texts are cut to segments that neither vocabulary joins (see Vocabularies) and numbered within blocks of at most `segments`
    distinct ones or `occurrences` (a longer text is a block of its own); blocks and texts stay where they are. Distinct segments
    are encoded and aligned once in the whole corpus and joined back to the blocks that have them, at most one row a block
    however frequent a segment is. What a block needs is one file of the shared folder. Pairs are counted by text within a
    block before they are shuffled. Null and empty texts, and texts whose tokens don't have their bytes, have no tokens: zeros
    and an empty groups text; so do their pairs count for nothing. Null and repeated ids keep their rows, equal rows count as
    many; a segment of any length is aligned; other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _vocabularies(byte_bpe, piece_model)
        part, count = TaskContext.get().partitionId(), 0
        names = ["at", "segment", "id", "packed"]
        places: dict[str, int] = {}
        ids: list = []
        held: list[np.ndarray] = []
        n = 0

        def rows_of_block() -> Iterator[pa.RecordBatch]:
            nonlocal count, n
            block = part << 13 | count
            count += 1
            if count > 1 << 13 or len(places) >> PLACES:
                raise ValueError("a partition has too many blocks, or a text too many segments, to be numbered")
            # frequent segments get the small numbers
            order = np.argsort(-np.bincount(np.concatenate(held), minlength=len(places)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            named = list(places)
            for at in range(0, len(order), 10_000):
                own = [named[i] for i in order[at : at + 10_000].tolist()]
                k = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(range((block << PLACES) + at, (block << PLACES) + at + k), pa.int64()), pa.array(own, pa.string()), pa.nulls(k, id_type), pa.nulls(k, pa.binary())], names)
            for at in range(0, len(held), 1000):
                packed = [_pack(rank[x]) if len(x) else None for x in held[at : at + 1000]]
                k = len(packed)
                yield pa.RecordBatch.from_arrays([pa.array([block << PLACES] * k, pa.int64()), pa.nulls(k, pa.string()), pa.array(ids[at : at + k], id_type), pa.array(packed, pa.binary())], names)
            places.clear()
            ids.clear()
            held.clear()
            n = 0

        id_type = None
        for batch in by_bytes(batches, "text", 2 << 20):
            id_type = batch.column("id").type
            for i, x in zip(batch.column("id").to_pylist(), utf8_list(batch.column("text")), strict=True):
                own = words.segments(x.decode()) if x else []
                ids.append(i)
                held.append(np.fromiter((places.setdefault(s, len(places)) for s in own), np.int32, len(own)))
                n += len(own)
                if len(places) >= segments or n >= occurrences:
                    yield from rows_of_block()
        if held:
            yield from rows_of_block()

    numbered = persisted(rows.mapInArrow(number, f"at bigint, segment string, id {kind}, packed binary"), "segments")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabularies(byte_bpe, piece_model)
        for batch in by_bytes(batches, "segment", 1 << 20):
            if batch.num_rows:
                links, counts = words.aligned(batch.column("segment").to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * links.dtype.itemsize
                found = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(links.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("segment"), found], ["segment", "links"])

    # one shuffle by segment serves the distinct segments and their way back
    dealt = numbered.where("segment is not null").select("segment", "at").repartition("segment")
    distinct = dealt.groupBy("segment").agg(F.max("at").alias("at")).where("at >= 0").select("segment")
    known = distinct.mapInArrow(align, "segment string, links binary")
    block, place = F.shiftright("at", PLACES), F.col("at").bitwiseAND(F.lit((1 << PLACES) - 1)).cast("int")
    at = fresh_path(spark, "aligned-segments")
    _filed(dealt.join(known.hint("merge"), "segment").select(block, place, "links"), at, ("<i4", "u1*"))
    link = _vocabularies(byte_bpe, piece_model).link
    texts = numbered.where("segment is null").select(block.alias("block"), "id", "packed")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own, n = None, None, None

        def found() -> pa.RecordBatch:
            met = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([before] * len(met), pa.int64()), pa.array(own.pairs[met]), pa.array(n[met])], ["block", "pair", "n"])

        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if packed is None:
                    continue
                if block != before:
                    if own:
                        yield found()
                    before, own = block, _Block(at, block, link)
                    n = np.zeros(len(own.pairs), np.int64)
                met = np.unique(_unpack(packed))
                if own.holds[met].all():
                    n[np.unique(own.numbers[_ragged(own.starts[met], own.lengths[met])])] += 1
        if own:
            yield found()

    counted = persisted(texts.mapInArrow(count, "block bigint, pair bigint, n bigint"), "pair-counts")
    sums = counted.groupBy("pair").agg(F.sum("n").alias("count"))
    a_id = F.expr(f"pair div {PAIR}")
    sums = persisted(sums.withColumn("a", a_id), "pairs")
    most = sums.groupBy("a").agg(F.max("count").alias("most"))
    scored = sums.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    info = fresh_path(spark, "pair-files")
    _filed(counted.select("block", "pair").join(scored.hint("merge"), "pair").select("block", "pair", "count", "best"), info, ("<i8", "<i8", "u1"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        before, own, said, each = None, None, [], None

        def load(block: int) -> None:
            nonlocal before, own, said, each
            before, own = block, _Block(at, block, link)
            said = own.groups()
            count, best = np.zeros(len(own.pairs), np.int64), np.zeros(len(own.pairs), np.int64)
            if found := _load(info, block, "<i8", "<i8", "u1"):  # none if no text of the block has tokens
                place = np.searchsorted(own.pairs, found[0])
                count[place], best[place] = found[1:]
            each = np.stack([*map(own.total, (*own.tokens(), own.links["ends"] == 0)), own.lengths, own.total(best[own.numbers]), own.total(count[own.numbers])])

        for batch in by_bytes(batches, "packed", 1 << 20):
            sums, texts, size, done = [], [], 0, 0
            ids = batch.column("id")
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                sums.append(np.zeros(6, np.int64))
                texts.append("")
                if packed is not None:
                    if block != before:
                        load(block)
                    units = _unpack(packed)
                    if own.holds[units].all():
                        sums[-1] = each[:, units].sum(1)
                        texts[-1] = ";".join(map(said.__getitem__, units.tolist()))
                        size += len(texts[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([ids.slice(done, len(texts)), *map(pa.array, np.stack(sums, 1)), pa.array(texts, pa.string())], names)
                    sums, texts, size, done = [], [], 0, done + len(texts)
            if texts:
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(texts)), *map(pa.array, np.stack(sums, 1)), pa.array(texts, pa.string())], names)

    counts = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint"
    out = texts.mapInArrow(compose, f"id {kind}, {counts}, groups string").withColumnRenamed("id", id_col)
    discard(counted)
    discard(sums)
    return out
