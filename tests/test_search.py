"""Searches in one task and over parts of a network against plain searches over all labels."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import graph, search

STEP, TIERS = 3000, 3


def city(seed, nodes=60, edges=160):
    """Directed keys, turns (some rejected), starts of three requests and one that reaches nothing, targets."""
    rnd = random.Random(seed)
    keys = {}
    for e in range(edges):
        u = rnd.randrange(nodes)
        v = (u + rnd.choice([1, 1, 2, 3, 7])) % nodes
        for way, (a, b) in enumerate(((u, v), (v, u))):
            if way == 0 or rnd.random() < 0.6:
                keys[u * 100 + 2 * e % 100 + way + 100_000 * (2 * e // 100)] = (a, b, rnd.randrange(0, 9) * 500, rnd.randrange(4))
    turns = [(a, b, keys[b][2], keys[b][3], rnd.choice([0] * 6 + [1, 2])) for a in keys for b in keys if keys[a][1] == keys[b][0]]
    seeds = [(r, k, keys[k][2], keys[k][3]) for r, node in ((1, 0), (2, 17), (3, 40)) for k in keys if keys[k][0] == node]
    seeds += [(4, 9_999_999, 700, 1)]
    targets = [(f"t{i % 14}", k, rnd.randrange(keys[k][2] + 1), 0) for i, k in enumerate(rnd.sample(sorted(keys), 18))]
    return turns, seeds, targets


def plain(turns, seeds, request, limit=None):
    after = {}
    for a, b, mm, ms, reject in turns:
        if not reject:
            after.setdefault(a, []).append((b, mm, ms))
    best, heap = {}, [(d, t, -1, k) for r, k, d, t in seeds if r == request and (limit is None or d <= limit)]
    cost = {}
    heapq.heapify(heap)
    while heap:
        d, t, pred, k = heapq.heappop(heap)
        if k in cost and (d, t) > cost[k]:
            continue
        fresh = k not in cost or (d, t) < cost[k]
        cost[k] = (d, t)
        best[k] = min(best.get(k, (d, t, pred)), (d, t, pred))
        if fresh:
            for b, mm, ms in after.get(k, ()):
                if limit is None or d + mm <= limit:
                    heapq.heappush(heap, (d + mm, t + ms, k, b))
    return best


def expected(turns, seeds, targets, request, take, budget):
    best = plain(turns, seeds, request)
    met = {}
    for name, k, mm, ms in targets:
        if k in best:
            d, t, p = best[k]
            met[name] = min(met.get(name, (d - mm, t - ms, p)), (d - mm, t - ms, p))
    low = min((x[0] for x in met.values()), default=None)
    tier, outcome, most = TIERS, "EXHAUSTED", float("inf")
    if low is not None:
        own = [max(1, -(-(met[x][0] - low) // STEP)) for x in met if x in take]
        tier = min([x for x in own if x <= TIERS], default=TIERS)
        most = low + tier * STEP
        outcome = "ACCEPTED" if own and min(own) <= TIERS else "TOLERANCE_SETTLED" if any(x[0] > most for x in best.values()) else "EXHAUSTED"
    inside = sorted((d, t, p, k) for k, (d, t, p) in best.items() if d <= most)
    cut = float("inf")
    if budget is not None and len(inside) > budget:
        outcome, cut, inside = "LIMIT", inside[budget][0], inside[:budget]
    found = {(x, *label, max(1, -(-(label[0] - low) // STEP))) for x, label in met.items() if label[0] <= most and label[0] < cut}
    settled = {k for *_, k in inside}
    count = lambda kinds: sum(1 for a, *_, reject in turns if a in settled and reject in kinds)
    return found, (len(inside), count((0, 1, 2)), count((1,)), count((2,)), outcome)


def frames(spark, turns, seeds, targets):
    return (
        spark.createDataFrame(seeds, "request long, key long, dist_mm long, ms long"),
        spark.createDataFrame(turns, "key long, next_key long, next_mm long, next_ms long, reject int"),
        spark.createDataFrame(targets, "target string, key long, back_mm long, back_ms long"),
    )


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize("small", [10**6, 1])
def test_labels_with_times_ties_and_limits(spark, seed, small):
    turns, seeds, targets = city(seed)
    s, t, _ = frames(spark, turns, seeds, targets)
    for limit in (None, 6000):
        found = graph.shortest_paths(s, t.where("reject = 0"), limit, small=small, **({"part_turns": 150, "requests_a_group": 2} if small == 1 else {}))
        want = {(r, k, *label) for r in (1, 2, 3, 4) for k, label in plain(turns, seeds, r, limit).items()}
        assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize("small", [10**6, 1])
@pytest.mark.parametrize(("seed", "take", "budget"), [(4, {1: {"t3", "t5"}, 2: {"t0"}, 3: {"t9", "t1"}}, None), (5, {1: {"t3"}}, 40), (6, {}, 10)])
def test_targets_tiers_outcomes_and_counts(spark, seed, take, budget, small):
    turns, seeds, targets = city(seed)
    s, t, g = frames(spark, turns, seeds, targets)
    wanted = spark.createDataFrame([(r, x) for r, own in take.items() for x in own], "request long, target string") if take else None
    far = {"part_turns": 150, "wave_mm": 20_000, "requests_a_group": 2} if small == 1 else {}
    got = search.target_search(s, t, g, step_mm=STEP, tiers=TIERS, budget=budget, accepted=wanted, small=small, **far)
    targets_of, audit_of = {}, {r["request"]: tuple(r)[1:] for r in got.audit.collect()}
    for r in got.targets.collect():
        targets_of.setdefault(r["request"], set()).add((r["target"], r["dist_mm"], r["ms"], r["pred"], r["tier"]))
    for r in (1, 2, 3, 4):
        found, audit = expected(turns, seeds, targets, r, take.get(r, ()), budget)
        assert audit_of[r] == audit
        assert targets_of.get(r, set()) == found
    assert len(got.rounds) > 1 if small == 1 else got.rounds == []


@pytest.mark.parametrize(("seed", "take"), [(3, {}), (4, {1: {"t3", "t5"}, 2: {"t0"}, 3: {"t9", "t1"}})])
def test_guided_searches_find_the_same_and_settle_less(spark, seed, take):
    turns, seeds, targets = city(seed)
    s, t, g = frames(spark, turns, seeds, targets)
    wanted = spark.createDataFrame([(r, x) for r, own in take.items() for x in own], "request long, target string") if take else None
    plainly, guided = (search.target_search(s, t, g, step_mm=STEP, tiers=TIERS, accepted=wanted, guided=x) for x in (False, True))
    assert {tuple(r) for r in plainly.targets.collect()} == {tuple(r) for r in guided.targets.collect()}
    a, b = ({r["request"]: r for r in x.audit.collect()} for x in (plainly, guided))
    for r in (1, 2, 3, 4):
        assert b[r]["settled"] <= a[r]["settled"]
        assert (a[r]["outcome"] == "ACCEPTED") == (b[r]["outcome"] == "ACCEPTED")
    assert sum(r["settled"] for r in b.values()) < sum(r["settled"] for r in a.values())


def test_ways_start_and_end_within_edges(spark):
    """A ring of four one-way keys and a spur: places before and behind each other on one key, on the spur, and unreachable ones."""
    ring = [(k, (k + 1) % 4, 1000) for k in range(4)]
    turns = [*((k, n, mm, 0) for k, n, mm in ring), (1, 10, 500, 0), (10, 11, 500, 0)]
    firsts = [(1, 0, 700, 70), (2, 0, 300, 30), (3, 11, 200, 20), (4, 10, 0, 0)]  # request, key, left of it
    goals = [(1, "end", 0, 300, 30), (2, "end", 0, 700, 70), (3, "end", 2, 500, 50), (4, "end", 11, 100, 10)]
    want = {1: (400, 40, [0]), 2: (300 + 3000 + 300, 30 + 300 + 30, [0, 1, 2, 3, 0]), 4: (400, -10, [10, 11])}
    s = spark.createDataFrame(firsts, "request long, key long, dist_mm long, ms long")
    t = spark.createDataFrame([(a, b, mm, mm // 10 if b < 10 else 0) for a, b, mm, _ in turns], "key long, next_key long, next_mm long, next_ms long")
    g = spark.createDataFrame(goals, "request long, target string, key long, back_mm long, back_ms long")
    for small in (10**6, 1):
        far = {"part_turns": 3} if small == 1 else {}
        got = search.target_search(*search.from_places(s, t, g), step_mm=0, tiers=1, ways=True, small=small, **far)
        rows = {r["request"]: (r["dist_mm"], r["ms"], [r["keys"][0] if r["keys"][0] >= 0 else -2 - r["keys"][0], *r["keys"][1:]]) for r in got.targets.collect()}
        assert rows == want


def test_rounds_deal_out_border_labels_only(spark):
    """A long street in eight parts: rounds grow with the borders, and what is dealt out with their number, not with the keys."""
    n = 4000
    ways = spark.range(n).select(F.col("id").alias("key"), (F.col("id") + 1).alias("next_key"), F.lit(1000).alias("next_mm"))
    turns = ways.unionByName(ways.select(F.col("next_key").alias("key"), F.col("key").alias("next_key"), "next_mm"))
    seeds = spark.createDataFrame([(1, 0, 0)], "request long, key long, dist_mm long")
    labels, _, _, rounds = search.far_labels(search.starts(seeds), search.prepared(turns), part_turns=1000, wave_mm=10**9)
    assert labels.agg(F.count("*"), F.max("dist_mm"), F.sum("dist_mm")).first()[:] == (n + 1, n * 1000, 1000 * n * (n + 1) // 2)
    assert len(rounds) <= 12
    assert sum(rounds) <= 24


def test_empty_seeds_turns_and_targets(spark):
    turns, seeds, targets = city(1)
    s, t, g = frames(spark, turns, seeds, targets)
    assert graph.shortest_paths(s.limit(0), t).count() == 0
    assert graph.shortest_paths(s, t.limit(0)).count() == len({(r, k) for r, k, *_ in seeds})
    for small in (10**6, 1):
        got = search.target_search(s, t, g.limit(0), small=small)
        assert got.targets.count() == 0
        assert {r["outcome"] for r in got.audit.collect()} == {"EXHAUSTED"}


@pytest.mark.parametrize("seed", range(6))
def test_requests_solved_together_have_the_labels_of_each_alone(seed):
    """Zero costs, equal ways, times and limits, against relaxing all turns until nothing falls."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(seed)
    rows = [(rnd.randrange(30) * 7, rnd.randrange(30) * 7, rnd.choice((0, 1, 1, 2, 5)), rnd.choice((0, 0, 1, 3)) * (seed % 2), 0) for _ in range(90)]
    net = search.Turns(pa.table(dict(zip(("key", "next_key", "next_mm", "next_ms", "reject"), map(list, zip(*rows, strict=True)), strict=True))))
    seeds = [(r, rnd.choice(net.keys.tolist()), rnd.randrange(3), rnd.randrange(3) * (seed % 2)) for r in range(5) for _ in range(2)]
    limit = (4, 9, search.FAR)[seed % 3]
    want = {}
    for r, k, d, t in seeds:
        want[r, k] = min((d, t, -1), want.get((r, k), (d, t, -1)))
    before = None
    while before != want:
        before = dict(want)
        for (r, k), (d, t, _) in before.items():
            for a, b, mm, ms, _ in rows:
                if a == k and d + mm <= limit:
                    want[r, b] = min((d + mm, t + ms, a), want.get((r, b), (d + mm, t + ms, a)))
    reached = search.Reached(net, 5)
    for _ in range(2):  # the arrays are used again
        r, k, d, t = (np.array(c) for c in zip(*seeds, strict=True))
        cell, *label = reached.labels(r * reached.width + net.place(k), d, t, limit)
        found = {(c // reached.width, int(net.keys[c % reached.width])): x for c, *x in zip(cell.tolist(), *(y.tolist() for y in label), strict=True)}
        assert {x: tuple(y) for x, y in found.items()} == want


@pytest.mark.parametrize("seed", range(4))
def test_searches_together_end_as_each_alone(seed):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(seed)
    rows = [(rnd.randrange(40), rnd.randrange(40), rnd.randrange(5, 9), rnd.randrange(3), rnd.choice((0, 0, 0, 1, 2))) for _ in range(130)]
    net = search.Turns(pa.table(dict(zip(("key", "next_key", "next_mm", "next_ms", "reject"), map(list, zip(*rows, strict=True)), strict=True))))
    on = {}
    for i, k in enumerate(rnd.sample(net.keys.tolist(), 6)):
        on.setdefault(k, []).append((f"t{i % 4}", rnd.randrange(5), rnd.randrange(2), None))
    reached = search.Reached(net, 1)
    for start in net.keys.tolist():
        for step, tiers in ((4, 2), (1000, 1), (0, 1)):
            want, audit = search._solve(net, on, 0, [(9, 1, start)], set(), step, tiers, None, None, False)
            found, own = search._ended(net, on, *reached.labels(net.place(np.array([start])), np.array([9]), np.array([1])), step, tiers)
            assert (sorted(found), own) == (sorted(want), audit)


def test_targets_from_one_search_over_parts_are_those_of_a_search_for_each_request(spark, monkeypatch):
    """Against plain searches, with accepted targets too; a key keeps labels within the bound of its nearest target only."""
    far, given = search.far_labels, []
    monkeypatch.setattr(search, "far_labels", lambda *args, **kw: given.append(far(*args, **kw)) or given[-1])
    turns, seeds, targets = city(5)
    take = [(1, "t3"), (2, "t8"), (3, "t1")]
    s, t, g = frames(spark, turns, seeds, targets)
    found = search.nearest_targets(s, t, g, STEP, TIERS, spark.createDataFrame(take, "request long, target string"), part_turns=120)
    wanted = set()
    for request in (1, 2, 3, 4):
        best, met = plain(turns, seeds, request), {}
        for name, k, mm, _ in targets:
            if k in best:
                met[name] = min(best[k][0] - mm, met.get(name, 1 << 62))
        low = min(met.values(), default=0)
        tiers = {n: max(1, -(-(d - low) // STEP)) for n, d in met.items() if d <= low + STEP * TIERS}
        last = min((tiers[n] for r, n in take if r == request and n in tiers), default=TIERS)
        wanted |= {(request, n, met[n], k) for n, k in tiers.items() if k <= last}
    assert {tuple(r) for r in found.select("request", "target", "dist_mm", "tier").collect()} == wanted and wanted
    labels = given[0][0].groupBy("key").agg((F.max("dist_mm") - F.min("dist_mm")).alias("wide"))
    assert labels.agg(F.max("wide")).first()[0] <= STEP * TIERS


@pytest.mark.parametrize("most", [100_000, 40])
def test_near_searches_read_parts_of_the_network_and_leave_the_rest(spark, most, monkeypatch):
    """Labels within a limit and targets of each request's own, by parts, as against relaxing all turns; those over `most` keys by rounds."""
    turns, seeds, targets = city(4)
    s, t, _ = frames(spark, turns, seeds, targets)
    near, rounds = search.near_parts, []
    monkeypatch.setattr(search, "near_parts", lambda *args, **kw: near(*args, **kw, most=most))
    far = search.far_labels
    monkeypatch.setattr(search, "far_labels", lambda *args, **kw: rounds.append(far(*args, **kw)) or rounds[-1])
    found = graph.shortest_paths(s, t.where("reject = 0"), 9000, small=1, part_turns=100)
    want = {(r, k, *label) for r in (1, 2, 3, 4) for k, label in plain(turns, seeds, r, 9000).items()}
    assert {tuple(r) for r in found.collect()} == want
    assert bool(rounds) == (most == 40)
    own = [(1 + i % 4, f"t{i}", *x[1:]) for i, x in enumerate(targets)] + [(2, "nowhere", 10**7, 0, 0)]
    g = spark.createDataFrame(own, "request long, target string, key long, back_mm long, back_ms long")
    plainly = search.target_search(s, t, g, step_mm=STEP, tiers=TIERS, ways=True).targets
    local = search.target_search(s, t, g, step_mm=STEP, tiers=TIERS, ways=True, local=True, small=1, part_turns=100).targets
    rows = lambda df: {(*(r[c] for c in ("request", "target", "key", "dist_mm", "ms", "pred", "tier")), *r["keys"]) for r in df.collect()}
    assert rows(local) == rows(plainly) and len(rows(local)) > 4


def test_a_place_that_no_way_leads_to_is_told_from_its_side():
    """The whole street isn't searched for a target that only two keys lead to."""
    back = search.Parts("", 0, 1)
    back.held = {k: ({k: [(k - 1, 1, 0)]} if k in (5, 6) else {}) for k in range(10)}
    assert search._cut_off(back, {6}, {9}, 1000) and not search._cut_off(back, {6}, {4}, 1000) and not search._cut_off(back, {6}, {6}, 1000)


def test_requests_without_a_way_are_told_by_regions(spark):
    """Three rings, joined one way: back there is none, though more keys than a search may take lie on either side."""
    n = 1500
    turns = [(c * n + k, c * n + (k + 1) % n, 1000, 0) for c in range(3) for k in range(n)] + [(c * n, c * n + 2990, 1000, 0) for c in range(2)]
    t = spark.createDataFrame(turns, "key long, next_key long, next_mm long, next_ms long")
    s = spark.createDataFrame([(1, 1495, 500, 0), (2, 3010, 500, 0), (3, 1510, 500, 0)], "request long, key long, dist_mm long, ms long")
    g = spark.createDataFrame([(1, "end", 4495, 0, 0), (2, "end", 20, 0, 0), (3, "end", 30, 0, 0)], "request long, target string, key long, back_mm long, back_ms long")
    found, left = search.near_parts(s, t, targets=g, part_turns=400, most=1400, big=100)
    assert [(r["request"], r["dist_mm"]) for r in found.collect()] == [(1, 500 + 22_000)]
    assert left.count() == 0


@pytest.mark.parametrize("seed", [7, 8])
def test_local_searches_with_regions_find_what_plain_ones_do(spark, seed):
    rnd = random.Random(seed)
    turns, seeds, targets = city(seed, nodes=90, edges=150)
    own = [(name, k, mm, ms, r) for name, k, mm, ms in targets for r in (1, 2, 3, 4) if rnd.random() < 0.3]
    s, t, _ = frames(spark, turns, seeds, targets)
    g = spark.createDataFrame(own, "target string, key long, back_mm long, back_ms long, request long")
    got = search.target_search(s, t, g, step_mm=STEP, tiers=TIERS, ways=True, local=True, part_turns=40, big=4).targets.collect()
    found = {}
    for r in got:
        found.setdefault(r["request"], set()).add((r["target"], r["dist_mm"], r["ms"], r["pred"], r["tier"]))
    for r in (1, 2, 3, 4):
        assert found.get(r, set()) == expected(turns, seeds, [x[:4] for x in own if x[4] == r], r, (), None)[0]
    regions, ahead = search.regions(t.where("reject = 0"), 0, 1000, big=4)
    of = {r["key"]: r["region"] for r in regions.collect()}
    legal = [(a, b) for a, b, *_, reject in turns if reject == 0]
    reach = {k: set(plain(turns, [(0, k, 0, 0)], 0)) for k in of}
    assert of and legal
    for a, x in of.items():
        for b, y in of.items():
            assert (b in reach[a]) == bool(ahead[x] >> y & 1)


def test_few_searches_of_a_whole_network_take_a_round_for_each_part(spark):
    """A long street of long turns in four parts: it has hundreds of times 64 mean turns' reach, and each part is one round."""
    n = 20_000
    turns = spark.range(n).select(F.col("id").alias("key"), (F.col("id") + 1).alias("next_key"), F.lit(1000).alias("next_mm"))
    seeds = spark.createDataFrame([(1, 0, 0)], "request long, key long, dist_mm long")
    labels, _, _, counts = search.far_labels(seeds, search.prepared(turns), part_turns=n // 4)
    assert len(counts) <= 5
    assert labels.agg(F.count("*"), F.max("dist_mm")).first() == (n + 1, n * 1000)


@pytest.mark.parametrize("seed", [11, 12])
def test_nearest_targets_by_borders(spark, seed, monkeypatch):
    turns, seeds, targets = city(seed)
    s, t, g = frames(spark, turns, seeds, targets)
    given = []
    far = search.far_labels
    monkeypatch.setattr(search, "far_labels", lambda *a, **k: given.append(far(*a, **k)) or given[-1])
    rows = lambda small: sorted(map(tuple, search.nearest_targets(s, t, g, step_mm=STEP, tiers=TIERS, part_turns=60, small=small).collect()))
    plainly, rounds = rows(10**9), len(given[-1][3])
    assert rows(0) == plainly and plainly
    # the last search stays within parts; keys that lead nowhere there get their labels a round later
    assert len(given[-1][3]) <= 2 < rounds
