"""Line deduplication by pairwise patience alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, persisted, utf8_list

DIGEST = 16  # bytes of a line's hash


def heaviest_rise(pairs: list[tuple[int, int, int]]) -> list[int]:
    """Places of the heaviest chain of pairs (a, b, weight), sorted by b, whose a rises too: patience sorting by weight."""
    ends: list[int] = []  # a of chain ends, rising, with rising weights
    weights: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for i, (a, _, w) in enumerate(pairs):
        at = bisect_left(ends, a)
        total = w + (weights[at - 1] if at else 0)
        before[i] = last[at - 1] if at else -1
        stop = at
        while stop < len(ends) and weights[stop] <= total:
            stop += 1
        if at == len(ends) or ends[at] != a or weights[at] < total:
            ends[at:stop], weights[at:stop], last[at:stop] = [a], [total], [i]
    chain = []
    i = last[-1] if last else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def runs(digests: list[bytes], sizes: list[int], least: int) -> list[tuple[int, int]]:
    """(first, end) of the shortest runs of lines with `least` words or more, from every line on and back from every line.

    Any longer run of consecutive lines is covered by those of them that lie in it.
    """
    found, end, held = set(), 0, 0
    for first in range(len(digests)):
        while held < least and end < len(digests):
            held += sizes[end]
            end += 1
        if held < least:
            break
        found.add((first, end))
        held -= sizes[first]
    first, held = len(digests), 0
    for end in range(len(digests), 0, -1):
        while held < least and first > 0:
            first -= 1
            held += sizes[first]
        if held < least:
            break
        found.add((first, end))
        held -= sizes[end - 1]
    return sorted(found)


def aligned(early: list[bytes], late: list[bytes], weights: list[int]) -> list[tuple[int, int]]:
    """Places (in early, in late) of the lines that patience diff aligns: within each range equal lines at its ends first, then
    the heaviest rising chain of the lines that stand once on both sides, and the same again between those."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(early), 0, len(late))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and early[a] == late[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and early[b - 1] == late[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        there, here = Counter(early[a:b]), Counter(late[c:d])
        place = {x: i for i, x in enumerate(early[a:b], a) if there[x] == 1 and here.get(x) == 1}
        pairs = [(place[x], j, weights[j] + 1) for j, x in enumerate(late[c:d], c) if x in place]
        chain = [pairs[k][:2] for k in heaviest_rise(pairs)]
        found += chain
        for (i, j), (k, m) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            if chain and i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
    return sorted(found)


def deleted_lines(early: list[bytes], late: list[bytes], sizes: list[int], least: int) -> set[int]:
    """Lines of `late` that go, given its pair's earlier document: lines as hashes, sizes the numbers of words in late's.

    Both are aligned; aligned lines that follow each other in both are a block, and blocks of `least` words or more go. What
    is left of late is aligned anew until no block goes, so that moved blocks align too; at last come blocks none of whose
    lines stands once. In the end late holds no run of `least` words that the earlier document has.
    """
    common = set(early) & set(late)
    spots = [i for i, x in enumerate(early) if x in common]
    lines = [early[i] for i in spots]
    gone: set[int] = set()

    def cut(blocks: list[list[int]]) -> bool:
        fresh = [j for block in blocks if sum(sizes[j] for j in block) >= least for j in block]
        gone.update(fresh)
        return bool(fresh)

    while True:
        left = [j for j, x in enumerate(late) if x in common and j not in gone]
        blocks: list[list[int]] = []
        before = (-2, -2)
        for i, j in aligned(lines, [late[j] for j in left], [sizes[j] for j in left]):
            here = (spots[i], left[j])
            if here == (before[0] + 1, before[1] + 1):
                blocks[-1].append(here[1])
            else:
                blocks.append([here[1]])
            before = here
        if not cut(blocks):
            break
    known = {tuple(early[a:b]) for a, b in _stretches(early, late, common, sizes, least)}
    for a, b in runs(late, sizes, least):
        if tuple(late[a:b]) in known:
            gone.update(range(a, b))
    return gone


def _stretches(early: list[bytes], late: list[bytes], common: set[bytes], sizes: list[int], least: int) -> list[tuple[int, int]]:
    """runs() of the earlier document, within stretches of lines that the later one has too."""
    words = dict(zip(late, sizes, strict=True))
    found, at = [], 0
    for i in range(len(early) + 1):
        if i == len(early) or early[i] not in common:
            found += [(at + a, at + b) for a, b in runs(early[at:i], [words[x] for x in early[at:i]], least)]
            at = i + 1
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, block: int = 4096, count_col: str = "removed_lines") -> DataFrame:
    """docs with the lines taken out of `text_col` that stand, in an aligned block of `least` words or more, in an earlier
    document; `count_col` tells how many.

    Documents are ordered by id (null last), then by a hash of their texts. Lines are compared without white space at their
    ends; empty lines don't count and stay. A document is paired with the earliest one that has a line of it of `least` words,
    or a shortest run of consecutive lines with as many (runs()): however many documents share one, it makes one pair for each,
    not a square, and every block that any earlier document shares is covered by runs whose owner is paired. Each pair is
    aligned on all lines that both have; deleted_lines() says what goes, so that more earlier documents never delete less. The
    pairs of an owner are dealt in groups of `block`, one later document at a time in memory.
    Null and empty texts come back as they are; a text all of whose lines go comes back empty, with its count; repeated rows
    (id and text) are one document and are treated alike, so that all of them stay; ids cast to bigint. Texts of any length are
    compared whole. Columns of docs stay as they are (one named like `count_col` is replaced); an empty table gives an empty
    result.
    """
    text = F.col(text_col).cast("string")
    key: Column = F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), F.col("t").alias("t"))
    kind = "struct<no_id:boolean,id:bigint,t:bigint>"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            digests, sizes, raws = [], [], []
            for x in utf8_list(batch.column("text")):
                own = [(k, s) for k, s in enumerate(map(bytes.strip, x.split(b"\n"))) if s]
                digests.append(b"".join(xxhash.xxh3_128_digest(s) for _, s in own))
                sizes.append(np.array([len(s.split()) for _, s in own], "<i4").tobytes())
                raws.append(np.array([k for k, _ in own], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, pa.binary()) for x in (digests, sizes, raws))], ["key", "digests", "sizes", "raws"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).select(key.alias("key"), "text")
    known = persisted(source.mapInArrow(lines, f"key {kind}, digests binary, sizes binary, raws binary").where("length(digests) > 0").dropDuplicates(["key"]), "lines")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "digests", 1 << 20):
            at, found = [], []
            for i, (x, n) in enumerate(zip(batch.column("digests").to_pylist(), batch.column("sizes").to_pylist(), strict=True)):
                own = _split(x)
                some = {x[a * DIGEST : b * DIGEST] for a, b in runs(own, np.frombuffer(n, "<i4").tolist(), least)}
                found += [r if len(r) == DIGEST else xxhash.xxh3_128_digest(r) for r in some]
                at += [i] * len(some)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], ["key", "run"])

    held = known.select("key", "digests", "sizes").mapInArrow(pieces, f"key {kind}, run binary")
    # both sides of these joins grow with the corpus: sorted and merged at every size, never broadcast
    owners = held.groupBy("run").agg(F.min("key").alias("owner"), F.count("*").alias("n")).where("n > 1").select("run", "owner")
    pairs = persisted(held.join(owners.hint("merge"), "run").where("key <> owner").select("key", "owner").distinct(), "line-pairs")
    shares = pairs.groupBy("owner").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    later = pairs.join(shares.hint("merge"), "owner").join(known.hint("merge"), "key")
    later = later.select("owner", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), F.lit(True).alias("late"), "key", "digests", "sizes", "raws")
    early = shares.join(known.select(F.col("key").alias("owner"), "digests").hint("merge"), "owner")
    nothing = F.lit(None)
    early = early.select("owner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("late"), nothing.cast(kind).alias("key"), "digests", nothing.cast("binary").alias("sizes"), nothing.cast("binary").alias("raws"))
    dealt = later.unionByName(early).repartition("owner", "part").sortWithinPartitions("owner", "part", "late")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[bytes] = []
        for batch in by_bytes(batches, "digests", 1 << 20):
            at, found = [], []
            for i, (x, n, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("digests", "sizes", "raws")), strict=True)):
                if n is None:
                    own = _split(x)
                elif gone := deleted_lines(own, _split(x), np.frombuffer(n, "<i4").tolist(), least):
                    at.append(i)
                    found.append(np.frombuffer(raw, "<i4")[sorted(gone)].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(found, pa.list_(pa.int32()))], ["key", "places"])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for places in batch.column("places").to_pylist():
                at = np.concatenate([np.array(x, np.int64) for x in places])
                own = np.zeros(int(at.max()) + 1, bool)
                own[at] = True
                flags.append(own.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("gone_key"), pa.array(flags, pa.list_(pa.bool_()))], ["gone_key", "gone"])

    gone = dealt.mapInArrow(align, f"key {kind}, places array<int>").groupBy(F.col("key").alias("gone_key")).agg(F.collect_list("places").alias("places"))
    gone = persisted(gone.mapInArrow(flag, f"gone_key {kind}, gone array<boolean>"), "lines-gone")
    discard(known)
    discard(pairs)
    # `row` keeps the caller's columns apart from ours, whatever their names
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    out = rows.withColumn("key", key).join(gone.hint("merge"), F.col("key") == F.col("gone_key"), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    fresh = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.filter("gone", lambda x: x)))
    return out.select(*((fresh.alias(c) if c == text_col else F.col("row")[c].alias(c)) for c in docs.columns if c != count_col), count.alias(count_col))


def _split(digests: bytes) -> list[bytes]:
    return [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
