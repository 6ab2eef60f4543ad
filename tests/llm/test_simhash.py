"""SimHash fingerprints, links and near-duplicate groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from wayfold.llm import simhash


def brute_print(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("spare", [2, 3])
def test_key_sets_miss_no_difference_within_the_distance(spare):
    rnd = random.Random(5)
    parts = simhash.segments(4, spare)
    for _ in range(3000):
        bits = rnd.sample(range(64), rnd.randrange(5))
        x = np.array([sum(1 << b for b in bits)], np.uint64)
        same = {k for k, (at, width) in enumerate(parts) if not int(x[0]) >> at & ((1 << width) - 1)}
        assert any({*chosen} <= same and simhash._within(x, starts, 4, spare)[0] for chosen, starts in simhash.key_sets(4, spare))
    far = np.array([0b11111], np.uint64)
    assert not any(simhash._within(far, starts, 4, spare)[0] for _, starts in simhash.key_sets(4, spare))
    assert len(simhash.key_sets(4, spare)) <= 64


@pytest.mark.parametrize(("block", "many"), [(3, 1 << 22), (2048, 1 << 22), (3, 1)])
def test_components(spark, odd, documents, block, many):
    for docs in (documents, odd, odd.limit(0)):
        rows = docs.select("doc_id", "text").collect()
        prints = [brute_print(r["text"], 4) for r in rows]
        found = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in simhash.simhash_components(docs, block=block, many=many).collect())
        named = sorted({(r["doc_id"], p) for r, p in zip(rows, prints, strict=True) if r["doc_id"] is not None})
        flat = np.array([p for _, p in named], np.uint64)
        linked = [(x, int(y)) for x in range(len(named)) for y in np.flatnonzero(np.bitwise_count(flat ^ flat[x]) <= 4)]
        least = {p: named[root][0] for (_, p), root in zip(named, roots(len(named), linked), strict=True)}
        assert found == sorted((str(r["doc_id"]), p, str(least.get(p))) for r, p in zip(rows, prints, strict=True))


def test_repeated_ids_keep_the_component_of_their_own_text(spark):
    base = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(2, base), (4, base), (4, "quite another text of its own"), (9, "quite another text of its own")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == [(2, 2), (4, 2), (4, 4), (9, 4)]


def planted(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    docs = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randrange(150, 400))]
        docs.append(base)
        for _ in range(rnd.randrange(5)):
            own = list(base)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            docs.append(own)
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("block", [2, 512])
def test_near_groups(spark, odd, block):
    texts = planted(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs, block=block).collect()}
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = roots(len(texts), linked)
    assert sum(found[k] != expected[k] for k in range(len(texts))) <= 0.03 * len(texts)
    # nothing is grouped that exact links don't group
    assert all(expected[k] == expected[found[k]] for k in range(len(texts)))
    # members that a group's pivot does not hold: chains of ever further texts
    chain = [" ".join(f"c{k}" for k in range(9 * i, 9 * i + 120)) for i in range(30)]
    chained = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r["group_id"] for r in simhash.near_duplicate_groups(chained, block=block).collect()} == {0}
    groups = simhash.near_duplicate_groups(odd).collect()
    assert len(groups) == odd.count() and {r["group_id"] for r in groups if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicate_groups(odd.limit(0)).count() == 0


def edited(base, kind, rnd, other):
    """base, a list of words, after an edit that leaves a Jaccard similarity of five-word runs somewhat over 0.8."""
    n = len(base)
    if kind == "cut":
        return base[: -(n * 17 // 100)]
    if kind == "cut in the middle":
        return base[: n // 2] + base[n // 2 + n * 12 // 100 :]
    if kind == "appended":
        return base + other[: n * 20 // 100]
    return [rnd.choice(other) if k % 70 == 7 else w for k, w in enumerate(base)]


@pytest.mark.parametrize("kind", ["cut", "cut in the middle", "appended", "scattered"])
def test_near_groups_hold_every_kind_of_edit(spark, kind):
    rnd = random.Random(kind)
    text = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(80):
        base = text(rnd.choice([30, 60, 200, 900]))
        texts += [base, edited(base, kind, rnd, text(300))]
    texts = [" ".join(x) for x in texts]
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    linked = [(a, a + 1) for a in range(0, len(texts), 2) if len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1])]
    assert len(linked) >= 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    assert [found[k] for k in range(len(texts))] == roots(len(texts), linked)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for n in [1, 2, 4, 5, 9, 10, 33, 100]:
        for _ in range(300):
            u = np.unique(rng.integers(0, 1 << 63, n))
            left = rng.integers(0, len(u), len(u) // 5)  # at most a fifth of the union is in one set only
            x, y = (set(u.tolist()) - {int(u[k]) for k in left[i::2]} for i in (0, 1))
            assert len(x & y) >= 0.8 * len(x | y)
            a, b = (set(sorted(s)[: simhash.prefix_size(len(s), 0.8)]) for s in (x, y))
            assert a & b


@pytest.mark.parametrize("share", [0.02, 0.5, 0.9, 1.0])
def test_prefixes_with_common_runs_meet(share):
    """As many of any two similar sets' hashes as prefix_size() tells, rare ones first, share one, however many are common."""
    rng = np.random.default_rng(5)
    common = rng.random(simhash.SKETCH) < share
    for n in [1, 4, 5, 9, 33, 100, 1000, 4000]:
        for _ in range(40):
            u = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            # the rare ones differ first, as edits do, in no order of their hashes
            order = np.lexsort((rng.random(len(u)), common[(u % np.uint64(simhash.SKETCH)).astype(int)]))
            left = order[: len(u) // 5]
            sets = [np.delete(u, left[i::2]) for i in (0, 1)]
            ordered = [simhash.rare_first(x, common) for x in sets]
            a, b = (set(x[: simhash.prefix_size(len(x), 0.8, k)].tolist()) for x, k in ordered)
            assert a & b
    assert simhash.prefix_size(4000, 0.8) == 18 and simhash.prefix_size(4000, 0.8, 200) <= 20 and simhash.prefix_size(4000, 0.8, 4000) == 18


def test_a_passage_that_many_texts_share_is_no_key(spark):
    """Texts with a passage in common aren't dealt by it, so rows grow with texts, and groups are those of all pairs."""
    rnd = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(12))
    dealt = []
    for n in (200, 800):
        texts = []
        for i in range(n // 2):
            own = [f"w{rnd.randrange(5000)}" for _ in range(60)]
            other = [x if k != 7 else "other" for k, x in enumerate(own)] if i % 2 else [f"w{rnd.randrange(5000)}" for _ in range(60)]
            texts += [f"{' '.join(own)} {passage}", f"{' '.join(other)} {passage}"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        sets = [set(simhash.shingle_hashes(x.encode(), 5)) for x in texts]
        linked = [(a, b) for a in range(n) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        assert len(linked) >= n // 5
        found = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs, often=20).collect()}
        assert [found[k] for k in range(n)] == roots(n, linked)
        common = simhash.common_buckets(docs, "text", 5, 20)
        keys = []
        for k, x in enumerate(sets):
            ordered, last = simhash.rare_first(np.array(sorted(x), np.uint64), common)
            assert last >= 8
            keys += [(k, int(h)) for h in ordered[: simhash.prefix_size(len(ordered), 0.8, last)].view(np.int64)]
        dealt.append(simhash.blocks(spark.createDataFrame(keys, "rep long, key long"), "key", "rep", 20).count())
    assert dealt[1] <= 5 * dealt[0]
