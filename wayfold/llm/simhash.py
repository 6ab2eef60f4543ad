"""SimHash near-duplicates, linked by pigeonring filtering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, components, discard, persisted, utf8_list

SEED = 42
BITS = 64
#: Buckets in which hashed runs are counted to tell common ones from rare ones.
SKETCH = 1 << 18


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """Unsigned XXH64 of every run of `words` words (repeats included); of the whole sequence if it is shorter; none if empty."""
    parts = text.lower().split()  # bytes: A-Z only, and white space is \\x20 and \\x09-\\x0D
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(b" ".join(parts), SEED)] if parts else []
    joined = b" ".join(parts)
    starts = [0, *accumulate(len(x) + 1 for x in parts)]
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[words:])]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bits that are set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    flat = np.asarray(hashes, "<u8")
    for at in range(0, len(flat), 1 << 14):
        ones += np.unpackbits(flat[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(flat), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) of every row: the 64-bit SimHash of its whole text as a signed long; null and wordless texts have 0."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = np.array([fingerprint(shingle_hashes(x, words)) for x in utf8_list(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(prints, "id bigint, fp bigint")


def segments(distance: int, spare: int = 2) -> list[tuple[int, int]]:
    """(lowest bit, width) of distance + spare consecutive segments; a chain of l may differ in l * distance / (distance + spare) bits."""
    n = distance + spare
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def key_sets(distance: int, spare: int = 2) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(segments, starts): the `spare` segments that each key takes, with the chain starts that it serves.

    By the pigeonring principle two fingerprints within `distance` bits have a start all of whose chains keep their budgets: its
    segment agrees, and so do spare - 1 others. Of pairs only those are needed whose second segment lies in the chain that
    differs in too few bits to touch all the others.
    """
    n, reach = distance + spare, (distance + spare) // 2
    found = []
    for chosen in combinations(range(n), spare):
        starts = tuple(s for s in chosen if spare > 2 or any((o - s) % n <= reach for o in chosen if o != s))
        if starts:
            found.append((chosen, starts))
    return found


def ring_keys(fp: Column, distance: int, spare: int = 2) -> Column:
    """Array of keys, one for each of key_sets()."""
    parts, keys = segments(distance, spare), []
    value = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in parts]
    for k, (chosen, _) in enumerate(key_sets(distance, spare)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, 48 // spare).bitwiseOR(value[i])
        keys.append(key)
    return F.array(*keys)


def _within(xor: np.ndarray, starts: tuple[int, ...], distance: int, spare: int = 2) -> np.ndarray:
    """Which differences have, from one of the starts, chains that all keep their budgets, and at most `distance` bits in all."""
    parts = segments(distance, spare)
    n = len(parts)
    passed = np.zeros(len(xor), bool)
    for start in starts:
        left, sums = np.flatnonzero(~passed), None
        for j in range(n):
            at, width = parts[(start + j) % n]
            here = np.bitwise_count((xor[left] >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
            sums = here if sums is None else sums + here
            keep = sums <= (j + 1) * distance // n
            left, sums = left[keep], sums[keep]
        passed[left] = True
    return passed & (np.bitwise_count(xor) <= distance)


def forest(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of the links that near(x, others) tells (a mask over `others`)."""
    found, left = [], np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            if hit.any():
                found += [(x, int(y)) for y in left[hit]]
                queue += left[hit].tolist()
                left = left[~hit]
    return found


def blocks(met: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Rows of the keys that two or more rows share, dealt and sorted by (key, p, q): a key with over `block` rows is cut into
    blocks, each pair of blocks (p, q) is a group of its own, and `own` is a row's block. No pair of rows is lost."""
    often = met.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    rows = met.join(often, key).withColumn("own", F.pmod(F.xxhash64(member), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("own", x).alias("p"), F.greatest("own", x).alias("q")))
    rows = rows.withColumn("pq", F.explode(pairs)).select(*met.columns, "own", "pq.p", "pq.q")
    return rows.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q")


def links(classes: DataFrame, distance: int, block: int = 2048, spare: int = 2) -> DataFrame:
    """(a, b): links between representatives of distinct texts or fingerprints, enough to join whatever differs in `distance`
    bits or fewer in one of its fingerprints.

    classes: (rep, fps array<bigint>). Rows that share a key meet; of a key's group only a spanning forest of the pairs that
    pass is kept, so output stays linear.
    """
    sets = key_sets(distance, spare)
    prints = classes.select("rep", F.posexplode("fps").alias("own_print", "fp"))
    key = F.explode(ring_keys(F.col("fp"), distance, spare))
    keyed = prints.select("rep", "fp", key.alias("key"), "own_print")
    keyed = keyed.select("rep", "fp", F.col("key").bitwiseOR(F.shiftleft(F.col("own_print").cast("long"), 54)).alias("key"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ("key", "p", "q")):
            rep, fp, own = group["rep"], group["fp"].view(np.uint64), group["own"]
            starts, split = sets[(int(group["key"][0]) >> 48) % 64][1], group["p"][0] != group["q"][0]

            def near(x: int, others: np.ndarray) -> np.ndarray:
                hit = _within(fp[others] ^ fp[x], starts, distance, spare)
                return hit & (own[others] != own[x]) if split else hit

            if found := forest(len(rep), near):
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    return blocks(keyed, "key", "fp", block).mapInArrow(join, "a bigint, b bigint").distinct()


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal keys in sorted batches, as arrays by column; holds one batch and one group."""
    held: dict[str, list[np.ndarray]] = {}
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(cols[k][a] for k in keys)
            if last is not None and key != last:
                yield {n: np.concatenate(x) for n, x in held.items()}
                held = {}
            last = key
            for n, x in cols.items():
                held.setdefault(n, []).append(x[a:b])
    if held:
        yield {n: np.concatenate(x) for n, x in held.items()}


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, block: int = 2048, many: int = 1 << 22) -> DataFrame:
    """(id_col, fp, component_id) of every row of docs.

    Texts (null: empty) are lower-cased in A-Z, split at ASCII white space and hashed as runs of `words` words; fingerprints
    link at `distance` differing bits or fewer (4 is the widest for which 64 bits give selective keys; over `many` distinct
    fingerprints keys take three of seven segments instead of two of six, without losing a link), and component_id is
    the smallest id that links reach, the row's own included. Equal fingerprints are one class and never expand into pairs.
    Rows with a null id count as members of their class but never name a component (null if no other row does); ids cast to
    bigint (one that can't fails the job); repeated ids keep their rows, each in its own text's component; other columns are
    not read; texts of any length count whole; an empty table gives an empty result.
    """
    prints = persisted(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    classes = persisted(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-class")
    # a class is named by its fingerprint, never by an id, which rows of other classes may repeat
    named = classes.where("least is not null").select(F.col("fp").alias("rep"), F.array("fp").alias("fps"))
    # keys of two segments have 21 bits; over `many` fingerprints, keys of three have 27 and lose no link either
    found = components(links(named, distance, block, 2 if classes.count() <= many else 3), name="simhash-link")
    roots = persisted(least_ids(classes, found, "fp"), "simhash-root")
    discard(classes)
    return prints.join(roots.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", F.col("group_id").alias("component_id"))


def least_ids(classes: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """(node, group_id) of every class (node, least id): the least id of the classes that components() put together with it."""
    member = classes.select(node, "least").join(found.withColumnRenamed("node", node).hint("merge"), node)
    group = member.groupBy("root").agg(F.min("least").alias("group_id"))
    linked = member.select(node, "root").join(group.hint("merge"), "root").select(node, "group_id")
    return classes.select(node, "least").join(linked.hint("merge"), node, "left").select(node, F.coalesce("group_id", "least").alias("group_id"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def print_limit(bits: int, similarity: float) -> int:
    """Most bits in which SimHash fingerprints of two sets with that Jaccard similarity differ, nine standard deviations over the
    mean: their cosine is 2s / (1 + s) or more, whatever the edit, and a bit differs with the angle's share of a half turn."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(p * bits + 9 * math.sqrt(p * (1 - p) * bits))


def prefix_size(n: int, similarity: float, common: int = 0, missed: float = 1e-12) -> int:
    """How many of a set's n hashes, in the order of rare_first(), are needed to share one with every set that similar; the last
    `common` of them are common ones.

    All but (1 - similarity) * n of its hashes lie in the other set too. One more than these are the exact prefix filter. Within
    the rare and within the common ones the order is by chance, so that fewer do for a miss of probability `missed`: as many
    rare ones as make it unlikely that all are alien, or all the rare ones and as many common ones.
    """
    exact = n - math.ceil(similarity * n - 1e-9) + 1
    if exact <= 1 or n == 0:
        return min(exact, n)
    alien, rare = exact - 1, n - common
    enough = lambda size: math.ceil(math.log(missed) / math.log(alien / size)) if size > alien else exact
    return min(exact, enough(rare), rare + enough(common))


def common_buckets(docs: DataFrame, text_col: str, words: int, often: int) -> np.ndarray:
    """For each of the SKETCH buckets of hashed runs whether it is a common one: over all of docs it has `often` texts more, and
    eight standard deviations, than a bucket has on average.

    Each task counts its texts' distinct runs by bucket, and a group by bucket sums them: SKETCH rows are all that reaches the
    driver. A rare run may share a common one's bucket; as texts agree on what is common, that costs keys, never a pair.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SKETCH, np.int64)
        for batch in by_bytes(batches, "text", 2 << 20):
            flat = [np.unique(np.array(shingle_hashes(x, words), np.uint64)) for x in utf8_list(batch.column("text"))]
            held += np.bincount((np.concatenate(flat) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) if flat else 0
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], ["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SKETCH, np.int64)
    n[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    mean = n.sum() / SKETCH
    return n > mean + 8 * math.sqrt(mean) + often


def rare_first(flat: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted distinct hashes with those of common buckets put last, and how many these are."""
    last = common[(flat % np.uint64(SKETCH)).astype(np.int64)]
    return np.concatenate([flat[~last], flat[last]]), int(last.sum())


def prefix_links(classes: DataFrame, limit: int, block: int) -> DataFrame:
    """(a, b): links between rows (rep, fps array<bigint>, keys array<bigint>) that share a key and whose fingerprints differ in
    `limit` bits or fewer in all; of a key's group only a spanning forest is kept, so output stays linear."""
    keyed = classes.select("rep", "fps", F.explode("keys").alias("key"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ("key", "p", "q")):
            rep, own, split = group["rep"], group["own"], group["p"][0] != group["q"][0]
            fps = np.stack(list(group["fps"])).view(np.uint64)

            def near(x: int, others: np.ndarray) -> np.ndarray:
                hit = np.bitwise_count(fps[others] ^ fps[x]).sum(axis=1, dtype=np.int64) <= limit
                return hit & (own[others] != own[x]) if split else hit

            if found := forest(len(rep), near):
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    return blocks(keyed, "key", "rep", block).mapInArrow(join, "a bigint, b bigint").distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, prints: int = 6, block: int = 512, often: int = 2048) -> DataFrame:
    """(id_col, text_hash, group_id, first) of every row: group_id is the smallest id that links reach, where texts link whose
    runs of `words` words have a Jaccard similarity of `similarity` or more; text_hash is xxhash64 of the row's text; first tells
    the row that stands for its group (its least id, then text_hash; rows equal in both are all first).

    Texts with the same words are one class, which stands for its rows whatever their ids. Texts meet by the prefix filter over
    their hashed runs (prefix_size()), rare runs first: one that about `often` texts or more share is a text's key only where its
    rare runs can't do, so that texts which only have a passage in common don't meet by it; of those that meet, pairs are candidates whose `prints` SimHash fingerprints over the
    same runs differ in print_limit() bits or fewer. Both follow from `similarity` alone, so candidates are as sure for cut or
    appended passages as for scattered words. Candidate groups are then checked exactly: every member with its group's pivot
    first, which settles a group of copies in linear time, then those that the pivot does not hold with all members, in blocks
    of `block`; only links that pass count. Null, empty and wordless texts are one class. Rows with a null id are grouped in the
    same way, but among themselves: their group_id is null, and the least text_hash is first; repeated ids keep their rows, each
    in its own text's group; other columns are not read; texts of any length count whole; an empty table gives an empty result.
    """
    mixes = [np.uint64((0x9E3779B97F4A7C15 * (r + 1)) % (1 << 64)) for r in range(prints)]
    apart = (np.uint64(0), np.uint64(0xA5A5F00DC3C35EED))  # runs of rows without an id are other runs than those of rows with one
    common = common_buckets(docs, text_col, words, often)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            digests, fps, keys = [], [], []
            for x, nameless in zip(utf8_list(batch.column("text")), batch.column("id").is_null().to_pylist(), strict=True):
                digests.append(xxhash.xxh3_128_digest(b" ".join(x.lower().split())) + bytes([nameless]))
                flat = np.unique(np.array(shingle_hashes(x, words), np.uint64))
                fps.append(np.array([fingerprint(_mixed(flat, m)) for m in mixes], np.uint64).view(np.int64))
                ordered, n = rare_first(flat, common)
                keys.append((ordered[: prefix_size(len(flat), similarity, n)] ^ apart[nameless]).view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(digests, pa.binary()), pa.array(fps, kind), pa.array(keys, kind)], ["id", "t", "digest", "fps", "keys"])

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    signed = persisted(own.mapInArrow(sign, "id bigint, t bigint, digest binary, fps array<bigint>, keys array<bigint>"), "near-sign")
    classes = signed.groupBy("digest").agg(F.min(F.struct("id", "t")).alias("row"), F.first("fps").alias("fps"), F.first("keys").alias("keys"))
    # numbers given once and read back ever after: two classes never share one
    classes = persisted(classes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("row").alias("least"), "fps", "keys"), "near-class")
    met = components(prefix_links(classes.select(F.col("node").alias("rep"), "fps", "keys"), print_limit(BITS * prints, similarity), 2048), name="near-link")
    met = persisted(met.join(classes.select("node", "least").hint("merge"), "node"), "near-met")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            marks = [apart[x] for x in batch.column("id").is_null().to_pylist()]
            sets = [(np.unique(np.array(shingle_hashes(x, words), np.uint64)) ^ m).view(np.int64) for x, m in zip(utf8_list(batch.column("text")), marks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["root", "node", "runs"])

    least = met.select("root", "node", F.col("least.id").alias("least_id"), F.col("least.t").alias("least_t")).hint("merge")
    texts = own.join(least, (F.col("t") == F.col("least_t")) & F.col("id").eqNullSafe(F.col("least_id"))).dropDuplicates(["node"])
    sets = persisted(texts.select("root", "node", "id", "text").mapInArrow(runs, "root bigint, node bigint, runs array<bigint>"), "near-runs")
    good = _checked(sets, similarity, block)
    found = components(good, name="near-checked")
    roots = persisted(least_ids(classes, found, "node").join(classes.select("node", "digest").hint("merge"), "node").select("digest", "group_id"), "near-root")
    for x in (classes, met, sets):
        discard(x)
    first = F.col("id").eqNullSafe(F.col("group_id.id")) & (F.col("t") == F.col("group_id.t"))
    out = signed.select("id", "t", "digest").join(roots.hint("merge"), "digest")
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), F.col("group_id.id").alias("group_id"), first.alias("first"))


def _checked(sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): links of similarity or more, enough to join all that link, among the rows (root, node, runs) of each root."""
    sizes = sets.groupBy("root").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = sets.join(sizes.hint("merge"), "root").withColumn("chunk", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pivot = F.col("node") == F.col("root")
    where = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("chunk"))
    dealt = placed.select("root", F.explode(where).alias("p"), pivot.alias("pivot"), "node", "runs")
    dealt = dealt.repartition("root", "p").sortWithinPartitions("root", "p")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ("root", "p")):
            at = int(np.flatnonzero(group["pivot"])[0])
            rest = np.delete(np.arange(len(group["node"])), at)
            if len(rest):
                hit = Inverted(group["runs"]).near(at, rest, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(group["root"][rest]), pa.array(group["node"][rest]), pa.array(hit)], ["root", "node", "held"])

    first = persisted(dealt.mapInArrow(star, "root bigint, node bigint, held boolean"), "near-star")
    left = first.where("not held").groupBy("root").agg(F.count("*").alias("m")).withColumn("far_blocks", F.ceil(F.col("m") / block).cast("int"))
    rows = placed.select("root", "node", "runs", "blocks", "chunk").join(left.select("root", "far_blocks").hint("merge"), "root")
    rows = rows.join(first.where("not held").select("node", F.lit(True).alias("far")).hint("merge"), "node", "left")
    far, mine = F.coalesce("far", F.lit(False)), F.pmod(F.xxhash64("node", F.lit(1)), "far_blocks").cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a far row meets every chunk of its group; every row, in its chunk, meets every block of far rows
    far_places = F.transform(each("blocks"), lambda j: F.struct(mine.alias("p"), j.alias("q"), F.lit(True).alias("is_far")))
    places = F.transform(F.filter(each("far_blocks"), lambda i: ~far | (i != mine)), lambda i: F.struct(i.alias("p"), F.col("chunk").alias("q"), F.lit(False).alias("is_far")))
    pairs = rows.select("root", "node", "runs", "chunk", F.explode(F.when(far, F.concat(far_places, places)).otherwise(places)).alias("at"))
    pairs = pairs.select("root", "at.p", "at.q", "at.is_far", "chunk", "node", "runs").repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ("root", "p", "q")):
            node, is_far, here = group["node"], group["is_far"], group["chunk"] == group["q"][0]
            index = Inverted(group["runs"])

            def near(x: int, others: np.ndarray) -> np.ndarray:
                allowed = (is_far[x] & here[others]) | (is_far[others] & here[x])
                hit = np.zeros(len(others), bool)
                if allowed.any():
                    hit[allowed] = index.near(x, others[allowed], similarity)
                return hit

            if found := forest(len(node), near):
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return first.where("held").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(pairs.mapInArrow(rest, "a bigint, b bigint"))


class Inverted:
    """Which of a group's sets hold each hashed run."""

    def __init__(self, sets):
        self.sets, self.sizes = list(sets), np.array(list(map(len, sets)), np.int64)
        flat, holder = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.holder = flat[order], holder[order]

    def near(self, x: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the others have a Jaccard similarity of `similarity` or more with set x."""
        a, b = np.searchsorted(self.flat, self.sets[x], "left"), np.searchsorted(self.flat, self.sets[x], "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        both = np.bincount(self.holder[at], minlength=len(self.sets))[others]
        return both >= similarity * (self.sizes[others] + self.sizes[x] - both)


def _mixed(flat: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = flat + salt
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
