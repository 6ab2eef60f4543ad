"""Searches over directed edge keys that end early, report their outcome, and scale beyond what a task can hold.

State is the directed key. A label is (dist_mm, ms, pred): cost is distance, then time, and of equal ways the smaller predecessor
stands (-1 for a start). Three forms give the same rows: a heap for each request over a network that fits a task; over a larger
one, a heap for each request whose answer is near, with the parts of the network that it comes to (see near_parts()), and rounds
over parts for the others (see far_labels()).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators import blocks, graph

FAR = (1 << 63) - 1
_LABEL = "request bigint, key bigint, dist_mm bigint, ms bigint, pred bigint"
_NAMES = ["request", "key", "dist_mm", "ms", "pred"]
# Outcomes: the tolerance beyond the best target was searched through; a tier had an accepted target; there was nothing more to
# search; the budget of settled keys was used up.
SETTLED, ACCEPTED, EXHAUSTED, LIMIT = "TOLERANCE_SETTLED", "ACCEPTED", "EXHAUSTED", "LIMIT"


class Turns:
    """Legal turns as arrays: about 30 bytes a turn, keys by their places in order. Rejected turns are only counted."""

    def __init__(self, table: pa.Table):
        key, after, mm, ms, reject = (np.asarray(table.column(c).combine_chunks()) for c in ("key", "next_key", "next_mm", "next_ms", "reject"))
        self.keys, inverse = np.unique(np.concatenate([key, after]), return_inverse=True)
        source, target = inverse[: len(key)], inverse[len(key) :]
        self.checks = np.bincount(source, minlength=len(self.keys))
        self.banned = np.bincount(source[reject == 1], minlength=len(self.keys))
        self.blocked = np.bincount(source[reject == 2], minlength=len(self.keys))
        legal = np.flatnonzero(reject == 0)
        order = legal[np.argsort(source[legal], kind="stable")]
        self.target, self.mm, self.ms = target[order].astype(np.int32), mm[order], ms[order]
        self.starts = np.searchsorted(source[order], np.arange(len(self.keys) + 1))

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def of(self, place: int) -> zip:
        """(place, mm, ms) of the legal turns from a place; none from those beyond the known keys."""
        a, b = self.starts[place : place + 2] if place < len(self.keys) else (0, 0)
        return zip(self.target[a:b].tolist(), self.mm[a:b].tolist(), self.ms[a:b].tolist(), strict=True)


def prepared(turns: DataFrame) -> DataFrame:
    """turns with all columns of Turns: time and rejection are 0 where there are none."""
    filled = lambda c: F.col(c) if c in turns.columns else F.lit(0)
    return turns.select(*(filled(c).cast("bigint").alias(c) for c in ("key", "next_key", "next_mm", "next_ms")), filled("reject").cast("tinyint").alias("reject"))


def starts(seeds: DataFrame) -> DataFrame:
    ms = F.col("ms") if "ms" in seeds.columns else F.lit(0)
    return seeds.select(*(F.col(c).cast("bigint").alias(c) for c in ("request", "key", "dist_mm")), ms.cast("bigint").alias("ms"))


@dataclass
class Found:
    """targets: (request, target, key, dist_mm, ms, pred, tier and keys, if asked for: all keys of the way in order); audit: (request, settled, checks, banned, blocked, outcome), a row for each
    request; rounds: the label counts of each round, if there were rounds."""

    targets: DataFrame
    audit: DataFrame | None
    rounds: list[int]


def target_search(seeds: DataFrame, turns: DataFrame, targets: DataFrame, step_mm: int = 1_000_000, tiers: int = 5, budget: int | None = None, accepted: DataFrame | None = None, guided: bool = False, ways: bool = False, local: bool = False, small: int = 2_000_000, **far) -> Found:
    """Searches of requests for targets on edges, each ending as soon as its answer is known.

    seeds: request, key, dist_mm, ms if any (way to the end of a first key); turns: key, next_key, next_mm, next_ms and reject if
    any (1 banned, 2 blocked: never used, only counted); targets: target, key, back_mm, back_ms if any: a target lies that much
    before the end of its key, which itself need not be passable; with a column `request` (null: all) it is only that request's.
    A target behind a first key's start isn't met on it (see from_places()). accepted: (request, target) pairs that a caller would take.

    A request's targets cost at most `tiers` * step_mm more than its best one; tier k holds those up to k * step_mm more. After
    each tier, if one of its targets so far is accepted, the search ends (ACCEPTED); otherwise the same frontier goes on, up to
    the last tier (SETTLED) or the end of the network (EXHAUSTED). If a search would settle more than `budget` keys, it ends
    there (LIMIT), and keeps the targets nearer than the first key beyond. settled counts the keys within reach when a search
    ends, checks their turns.

    guided: what is left from every key to its nearest target is found first, by one search against the direction of travel that
    all requests share; a request then goes only where way and rest together stay within its reach, in that order. Targets,
    labels and tiers are the same (a label's predecessors are within reach too); settled, checks and the budget count what such
    a search settles, and it is SETTLED if it left anything out. Networks of over `small` turns are searched in rounds; `far` is for far_labels().

    local: each request has targets of its own, no accepted ones and no budget, ways are wanted, and the audit isn't: then networks
    of any size are searched by near_parts(), where no task holds all targets, and in rounds only for requests without answer there.
    """
    blocks.ship(seeds.sparkSession)
    turns = graph._cut(prepared(turns), "turns")
    own = starts(seeds)
    back = F.col("back_ms") if "back_ms" in targets.columns else F.lit(0)
    whose = F.col("request") if "request" in targets.columns else F.lit(None)
    goals = targets.select(F.col("target").cast("string").alias("target"), *(F.col(c).cast("bigint").alias(c) for c in ("key", "back_mm")), back.cast("bigint").alias("back_ms"), whose.cast("bigint").alias("request"))
    if guided and "request" in targets.columns:
        raise ValueError("a guided search is for targets that all requests share")
    wanted = accepted.select(F.col("request").cast("bigint").alias("request"), F.col("target").cast("string").alias("target")) if accepted is not None else None
    rest = remaining(turns, goals, small, **far) if guided else None
    if local:
        return Found(_local_targets(own, turns, goals, step_mm, tiers, **far), None, [])
    if turns.limit(small + 1).count() > small:
        return _far_targets(own, turns, goals, wanted, step_mm, tiers, budget, ways, **far)
    spark = seeds.sparkSession
    # turns, targets and rests are at most as many rows as `small` allows turns
    shared = spark.sparkContext.broadcast((turns.toArrow(), goals.toArrow(), rest.toArrow() if guided else None))
    schema = "kind int, request bigint, target string, key bigint, dist_mm bigint, ms bigint, pred bigint, tier int, keys array<bigint>, settled bigint, checks bigint, banned bigint, blocked bigint, outcome string"
    kinds = [pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string()]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = on = ahead = None
        for (request,), rows in blocks.sorted_groups(batches, "request"):
            if net is None:
                net, on = Turns(shared.value[0]), _goals(shared.value[1])
                if guided:
                    table = shared.value[2]
                    ahead = np.full(len(net.keys), FAR)
                    ahead[net.place(np.asarray(table.column("key").combine_chunks()))] = np.asarray(table.column("dist_mm").combine_chunks())
            take = {x for own in rows.column("accepted").to_pylist() for x in own or []}
            labels = [tuple(x) for x in zip(*(rows.column(c).to_pylist() for c in ("dist_mm", "ms", "key")), strict=True)]
            found, audit = _solve(net, on, request, labels, take, step_mm, tiers, budget, ahead, ways)
            out = [(0, request, *x, *[None] * 5) for x in found] + [(1, request, *[None] * 7, *audit)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    alike = not guided and budget is None and wanted is None and not ways and "request" not in targets.columns

    def solve_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, on = Turns(shared.value[0]), _goals(shared.value[1])
        # no label lies before a target on its key, so that least labels of keys are least labels of targets
        names, key, back, _, _ = (shared.value[1].column(c).to_pylist() for c in ("target", "key", "back_mm", "back_ms", "request"))
        place, least = net.place(np.array(key, np.int64)), np.full(len(net.keys), FAR)
        np.minimum.at(least, net.target, net.mm)
        plain = all(p < 0 or b <= least[p] for p, b in zip(place.tolist(), back, strict=True))
        reached, size = None, max(1, CELLS // max(1, len(net.keys)))
        for requests, rows in together(batches, lambda: size):
            seeds = list(zip(*(rows.column(c).to_pylist() for c in ("own", "dist_mm", "ms", "key")), strict=True))
            known = net.place(np.asarray(rows.column("key").combine_chunks()))
            odd = {r for (r, d, _, k), p in zip(seeds, known.tolist(), strict=True) if not plain or p < 0 or any(d < mm for _, mm, _, _ in on.get(k, ()))}
            out = []
            for r in odd:
                found, audit = _solve(net, on, requests[r], [x[1:] for x in seeds if x[0] == r], set(), step_mm, tiers, None, None, False)
                out += [(0, requests[r], *x, *[None] * 5) for x in found] + [(1, requests[r], *[None] * 7, *audit)]
            if len(odd) < len(requests):
                reached = reached or Reached(net, size)
                r, d, t = (np.array([x[i] for x in seeds], np.int64) for i in range(3))
                even = ~np.isin(r, list(odd))
                cells, *label = reached.labels(r[even] * reached.width + known[even], d[even], t[even])
                edges = np.searchsorted(cells, np.arange(len(requests) + 1) * reached.width)
                for r in set(range(len(requests))) - odd:
                    own, dist, ms, pred = (x[edges[r] : edges[r + 1]] for x in (cells, *label))
                    found, audit = _ended(net, on, own - r * reached.width, dist, ms, pred, step_mm, tiers)
                    out += [(0, requests[r], *x, *[None] * 5) for x in found] + [(1, requests[r], *[None] * 7, *audit)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    if wanted is None:
        rows = own.withColumn("accepted", F.lit(None).cast("array<string>"))
    else:
        rows = own.join(wanted.groupBy("request").agg(F.collect_set("target").alias("accepted")), "request", "left")
    both = graph._cut(blocks.spread(rows, "request").mapInArrow(solve_together if alike else solve, schema), "target-search")
    columns = ["request", "target", "key", "dist_mm", "ms", "pred", "tier", *["keys"] * ways]
    return Found(both.where("kind = 0").select(columns), both.where("kind = 1").select("request", "settled", "checks", "banned", "blocked", "outcome"), [])


class Reached:
    """Least costs of many requests at once over a network that a task holds: arrays of a cell for each request and key.

    Cells whose cost fell are spread together: first those within a rising bound of distance, of about a mean turn each, so that
    few are spread twice; then times along the turns of least distance; then the smaller predecessors along those of least cost."""

    def __init__(self, net: Turns, requests: int):
        self.net, self.width = net, max(1, len(net.keys))
        self.dist = np.full(requests * self.width, FAR)
        self.mark = np.zeros(len(self.dist), np.int32)
        self.delta = max(1, int(net.mm.mean())) if len(net.mm) else 1

    def once(self, cells: np.ndarray) -> np.ndarray:
        at = np.arange(len(cells), dtype=np.int32)
        self.mark[cells] = at
        return cells[self.mark[cells] == at]

    def turns(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `cells`, turn, cell it leads to) of the legal turns from cells."""
        place = cells % self.width
        a, n = self.net.starts[place], self.net.starts[place + 1] - self.net.starts[place]
        row = np.repeat(np.arange(len(cells)), n)
        turn = np.repeat(a - np.cumsum(n) + n, n) + np.arange(len(row))
        return row, turn, (cells - place)[row] + self.net.target[turn]

    def spread(self, cells: np.ndarray, limit: int) -> np.ndarray:
        row, turn, to = self.turns(cells)
        d = self.dist[cells][row] + self.net.mm[turn]
        keep = (d < self.dist[to]) & (d <= limit)
        to, d = to[keep], d[keep]
        np.minimum.at(self.dist, to, d)
        return self.once(to)

    def distances(self, cells: np.ndarray, d: np.ndarray, limit: int = FAR) -> None:
        """From seeds (cell, distance) to all cells within `limit`."""
        self.dist.fill(FAR)
        np.minimum.at(self.dist, cells, d)
        later, bound = self.once(cells), -1
        while len(later):
            bound = int(self.dist[later].min()) + self.delta
            soon = self.dist[later] <= bound
            near, held = later[soon], [later[~soon]]
            while len(near):
                near = self.spread(near, limit)
                soon = self.dist[near] <= bound
                held.append(near[~soon])
                near = near[soon]
            later = np.concatenate(held)
            later = self.once(later[self.dist[later] > bound])

    def labels(self, cells: np.ndarray, d: np.ndarray, t: np.ndarray, limit: int = FAR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance, time, predecessor's key or -1) of all cells within `limit`, from seeds (cell, distance, time)."""
        self.distances(cells, d, limit)
        net, found = self.net, np.flatnonzero(self.dist < FAR)
        first = d == self.dist[cells]
        cells, t = cells[first], t[first]
        timed = bool(t.any() or net.ms.any())
        time = np.full(len(self.dist) if timed else 1, FAR)
        if timed:
            np.minimum.at(time, cells, t)
            near = self.once(cells)
            while len(near):
                row, turn, to = self.turns(near)
                t_to = time[near][row] + net.ms[turn]
                keep = (self.dist[near][row] + net.mm[turn] == self.dist[to]) & (t_to < time[to])
                to, t_to = to[keep], t_to[keep]
                np.minimum.at(time, to, t_to)
                near = self.once(to)
            first = t == time[cells]
            cells = cells[first]
        pred = np.full(len(self.dist), FAR)
        for at in range(0, len(found), 500_000):
            own = found[at : at + 500_000]
            row, turn, to = self.turns(own)
            keep = self.dist[own][row] + net.mm[turn] == self.dist[to]
            if timed:
                keep &= time[own][row] + net.ms[turn] == time[to]
            np.minimum.at(pred, to[keep], net.keys[own % self.width][row[keep]])
        pred[cells] = -1
        return found, self.dist[found], time[found] if timed else np.zeros(len(found), np.int64), pred[found]


#: Cells of a task's Reached: 28 to 36 bytes each.
CELLS = 4_000_000


def together(batches: Iterator[pa.RecordBatch], most) -> Iterator[tuple[list[int], pa.Table]]:
    """(requests, rows with the column `own`, the place of a row's request among them) of up to most() requests at a time."""
    names, held = [], []
    for (request,), rows in blocks.sorted_groups(batches, "request"):
        held.append(rows.append_column("own", pa.array(np.full(len(rows), len(names)))))
        names.append(request)
        if len(names) >= most():
            yield names, pa.concat_tables(held)
            names, held = [], []
    if names:
        yield names, pa.concat_tables(held)


def near_labels(seeds: DataFrame, turns: DataFrame, limit: int | None) -> DataFrame:
    """Labels of every request over a network that each task holds, some requests at a time, however many there are."""
    blocks.ship(seeds.sparkSession)
    shared = seeds.sparkSession.sparkContext.broadcast(turns.toArrow())
    most = FAR if limit is None else limit

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = reached = None

        def size() -> int:
            nonlocal net
            net = net or Turns(shared.value)
            return max(1, CELLS // max(1, len(net.keys)))

        for requests, rows in together(batches, size):
            reached = reached or Reached(net or Turns(shared.value), size())
            own, key, d, t = (np.asarray(rows.column(c).combine_chunks()) for c in ("own", "key", "dist_mm", "ms"))
            within = d <= most
            own, key, d, t = own[within], key[within], d[within], t[within]
            place = reached.net.place(key)
            known = place >= 0
            # keys without any turn lead nowhere
            alone: dict[tuple[int, int], tuple[int, int]] = {}
            for k, label in zip(zip(own[~known].tolist(), key[~known].tolist(), strict=True), zip(d[~known].tolist(), t[~known].tolist(), strict=True), strict=True):
                alone[k] = min(label, alone.get(k, label))
            names = np.array(requests, np.int64)
            if known.any():
                cell, *label = reached.labels(own[known] * reached.width + place[known], d[known], t[known], most)
                for at in range(0, len(cell), 200_000):
                    r, k = np.divmod(cell[at : at + 200_000], reached.width)
                    columns = [names[r], reached.net.keys[k], *(x[at : at + 200_000] for x in label)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)
            if alone:
                yield _table([(requests[r], k, *label, -1) for (r, k), label in alone.items()]).to_batches()[0]

    return blocks.spread(seeds, "request").mapInArrow(solve, _LABEL)


class Parts:
    """Turns in ranges of keys, each a file of the shared folder that is read when a search comes to it; the last ones are kept."""

    def __init__(self, uri: str, low: int, width: int, most: int = 16):
        self.uri, self.low, self.width, self.most = uri, low, width, most
        self.held: dict[int, dict[int, list[tuple[int, ...]]]] = {}

    def of(self, key: int) -> list[tuple[int, ...]]:
        """(other key, mm, ms) of the turns from a key."""
        part = (key - self.low) // self.width
        own = self.held.get(part)
        return (self.read(part) if own is None else own).get(key, ())

    def read(self, part: int) -> dict[int, list[tuple[int, ...]]]:
        if len(self.held) >= self.most:
            del self.held[next(iter(self.held))]
        own = self.held.setdefault(part, {})
        fs, root = blocks.at(self.uri)
        if fs.get_file_info(f"{root}/{part}").is_file:
            table = blocks.get(self.uri, str(part))
            for key, *turn in zip(*(table.column(c).to_pylist() for c in ("at", "to", "next_mm", "next_ms")), strict=True):
                own.setdefault(key, []).append(tuple(turn))
        return own


def strong(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The strongly connected set of each of n nodes, numbered such that links between sets lead to smaller numbers."""
    order = np.argsort(source, kind="stable")
    to, first = target[order].tolist(), np.searchsorted(source[order], np.arange(n + 1)).tolist()
    found, low, group, held = [-1] * n, [0] * n, [-1] * n, []
    count = groups = 0
    for root in range(n):
        if found[root] >= 0:
            continue
        found[root] = low[root] = count
        count += 1
        held.append(root)
        walk = [(root, first[root])]
        while walk:
            at, i = walk.pop()
            while i < first[at + 1]:
                after = to[i]
                i += 1
                if found[after] < 0:
                    walk.append((at, i))
                    found[after] = low[after] = count
                    count += 1
                    held.append(after)
                    at, i = after, first[after]
                elif group[after] < 0:
                    low[at] = min(low[at], found[after])
            if low[at] == found[at]:
                while group[at] < 0:
                    group[held.pop()] = groups
                groups += 1
            if walk:
                low[walk[-1][0]] = min(low[walk[-1][0]], low[at])
    return np.array(group, np.int64)


def _regions(rows: pa.Table, big: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(nodes in regions, whether each is a set, its region, regions that can be reached from each region as bits) from nodes that
    are sets (kind 0: a, of b keys) and links between nodes (kind 1)."""
    kind, a, b = (np.asarray(rows.column(c).combine_chunks()) for c in ("kind", "a", "b"))
    sized, size, a, b = a[kind == 0], b[kind == 0], a[kind == 1], b[kind == 1]
    for _ in range(64):  # keys of no set that nothing leads to, or that lead nowhere, join nothing
        keep = (np.isin(a, b) | np.isin(a, sized)) & (np.isin(b, a) | np.isin(b, sized))
        if keep.all():
            break
        a, b = a[keep], b[keep]
    names, at = np.unique(np.concatenate([sized, a, b]), return_inverse=True)
    source, target = at[len(sized) : len(sized) + len(a)], at[len(sized) + len(a) :]
    group = strong(len(names), source, target)
    keys = np.ones(len(names), np.int64)
    keys[at[: len(sized)]] = size
    weight = np.bincount(group, keys)
    chosen = np.argsort(-weight, kind="stable")[:most]
    chosen = chosen[weight[chosen] >= big]
    region = np.full(len(weight), -1)
    region[chosen] = np.arange(len(chosen))
    ahead = [1 << r if r >= 0 else 0 for r in region.tolist()]
    order = np.argsort(group[source], kind="stable")
    for x, y in zip(group[source][order].tolist(), group[target][order].tolist(), strict=True):
        ahead[x] |= ahead[y]
    region = region[group]
    inside, is_set = region >= 0, np.isin(names, sized)
    return names[inside], is_set[inside], region[inside], [ahead[x] for x in chosen.tolist()]


def regions(turns: DataFrame, low: int, width: int, big: int = 1000, most: int = 512) -> tuple[DataFrame, list[int]]:
    """(key, region) of the keys of large regions, and as bits which regions can be reached from each.

    A region is a part of a strongly connected set of the network: between its keys there always is a way. Ranges of keys (from
    `low`, `width` each) are searched for such sets by tasks of their own; one task then puts together what is left of the network,
    where each set is one node. Sets of under `big` keys, and beyond the `most` largest, are no regions.
    """
    part = lambda c: F.expr(f"({c} - {low}L) div {width}L")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in blocks.sorted_groups(batches, "part"):
            key, after, inside = (np.asarray(table.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("key", "next_key", "inside"))
            names, at = np.unique(np.concatenate([key, after[inside]]), return_inverse=True)
            group = strong(len(names), at[: len(key)][inside], at[len(key) :])
            least = np.full(len(names), FAR)
            np.minimum.at(least, group, names)
            own = least[group]
            held = np.bincount(group)[group] > 1
            links = np.unique(np.stack([own[at[: len(key)][inside]], own[at[len(key) :]]]), axis=1)
            links = links[:, links[0] != links[1]]
            rows = [(0, names[held], own[held]), (1, *links), (2, own[at[: len(key)][~inside]], after[~inside])]
            for kind, a, b in rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    own = turns.select(part("key").alias("part"), "key", "next_key", (part("key") == part("next_key")).alias("inside"))
    found = graph._cut(blocks.spread(own, "part").mapInArrow(sets, "kind int, a bigint, b bigint"), "key-sets")
    of = found.where("kind = 0").select(F.col("a").alias("key"), F.col("b").alias("set"))
    across = found.where("kind = 2").select("a", F.col("b").alias("key")).join(of, "key", "left").select(F.lit(1).alias("kind"), "a", F.coalesce("set", "key").alias("b")).distinct()
    sizes = of.groupBy("set").agg(F.count("*").alias("n")).select(F.lit(0).alias("kind"), F.col("set").alias("a"), F.col("n").alias("b"))

    layout = ["set", "is_set", "region", "ahead"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            names, is_set, region, ahead = _regions(pa.Table.from_batches(held), big, most)
            for r, bits in enumerate(ahead):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([r], pa.int32()), pa.array([bits.to_bytes(most // 8 + 1, "little")], pa.binary())], layout)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(is_set), pa.array(region, pa.int32()), pa.nulls(len(names), pa.binary())], layout)

    one = sizes.unionByName(found.where("kind = 1")).unionByName(across).repartition(1)
    named = graph._cut(one.mapInArrow(whole, "set bigint, is_set boolean, region int, ahead binary"), "key-regions")
    ahead = [int.from_bytes(x["ahead"], "little") for x in named.where("ahead is not null").orderBy("region").collect()]
    alone = named.where("not is_set").select(F.col("set").alias("key"), "region")
    return of.join(named.where("is_set").select("set", "region"), "set").select("key", "region").unionByName(alone), ahead


class Regions(Parts):
    """The regions of keys, by the same ranges of keys."""

    def of(self, key: int) -> int | None:
        part = (key - self.low) // self.width
        own = self.held.get(part)
        return (self.read(part) if own is None else own).get(key)

    def read(self, part: int) -> dict[int, int]:
        if len(self.held) >= self.most:
            del self.held[next(iter(self.held))]
        own = self.held.setdefault(part, {})
        fs, root = blocks.at(self.uri)
        if fs.get_file_info(f"{root}/{part}").is_file:
            table = blocks.get(self.uri, str(part))
            own.update(zip(table.column("key").to_pylist(), table.column("region").to_pylist(), strict=True))
        return own


def _around(net: Parts, at: Regions, keys: set[int], most: int) -> tuple[set[int], int] | None:
    """(keys, regions as bits) that can be reached from keys without a way through a region; none if these are over `most` keys."""
    seen, open_, bits = set(keys), list(keys), 0
    while open_:
        key = open_.pop()
        region = at.of(key)
        if region is not None:
            bits |= 1 << region
            continue
        for other, *_ in net.of(key):
            if other not in seen:
                if len(seen) >= most:
                    return None
                seen.add(other)
                open_.append(other)
    return seen, bits


def _near(net: Parts, firsts: list[tuple[int, int, int]], limit: int, goals: dict[int, list[tuple[str, int, int]]], beyond: int, most: int, leads=None) -> tuple[dict, dict] | None:
    """(labels of keys, labels of targets) of one request, up to `limit` and to `beyond` more than its best target; none if that
    takes over `most` keys. Keys of which leads(), if given, tells that no way goes on from them to a target are left out."""
    held: dict[int, tuple[int, int, int]] = {}
    met: dict[str, tuple[int, int, int, int]] = {}
    heap: list[tuple[int, int, int]] = []
    done: set[int] = set()
    best = FAR

    def reach(key: int, label: tuple[int, int, int]) -> None:
        nonlocal best
        for target, mm, ms in goals.get(key, ()):
            at = (label[0] - mm, label[1] - ms, label[2], key)
            if label[0] >= mm and (target not in met or at < met[target]):
                met[target] = at
                best = min(best, at[0])
        had = held.get(key)
        if had is None or label < had:
            held[key] = label
            if had is None or label[:2] < had[:2]:
                heapq.heappush(heap, (*label[:2], key))

    for d, t, key in firsts:
        if d <= limit:
            reach(key, (d, t, -1))
    while heap:
        d, t, key = heapq.heappop(heap)
        if key in done or (d, t) > held[key][:2]:
            continue
        if best < FAR and d > best + beyond:
            break
        if len(done) >= most:
            return None
        done.add(key)
        for after, mm, ms in net.of(key):
            if d + mm <= limit and (leads is None or leads(after)):
                reach(after, (d + mm, t + ms, key))
    return held, {x: label for x, label in met.items() if label[0] <= best + beyond}


def _cut_off(back: Parts, ends: set[int], firsts: set[int], most: int) -> bool:
    """Whether no way leads from the first keys to the ends, as far as `most` keys before the ends can tell."""
    seen, open_ = set(ends), list(ends)
    if seen & firsts:
        return False
    while open_:
        for before, *_ in back.of(open_.pop()):
            if before in firsts or len(seen) > most:
                return False
            if before not in seen:
                seen.add(before)
                open_.append(before)
    return True


def near_parts(seeds: DataFrame, turns: DataFrame, limit: int = FAR, targets: DataFrame | None = None, beyond_mm: int = 0, step_mm: int = 0, part_turns: int = 20_000, most: int = 100_000, big: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(found, left): searches that stay near their first keys, however large the network is, and the requests (request) that don't.

    Turns are dealt into files of the shared folder by ranges of keys (so keys should be numbered such that neighbours are close),
    requests into tasks by their first keys; a task reads the files that its requests come to, keeps 16 of them at a time, and
    solves one request after the other by a heap. One that has no answer within `most` keys is left to other forms. So a task
    holds a bounded part of the network and one request's labels, and work grows with what requests settle.

    Without targets found has the labels (request, key, dist_mm, ms, pred) within `limit`; with targets of each request (request,
    target, key, back_mm, back_ms) those up to beyond_mm more than its best one, with tiers and keys as of target_search(). Whether a
    request has a way at all is told first, by the regions() (of `big` keys or more) that its first keys come to and that lead to its
    targets; one without isn't searched through, however large both sides are, and no search enters regions that lead to no target.
    """
    spark = seeds.sparkSession
    blocks.ship(spark)
    base = graph.shared(spark, "near-search")
    stat = turns.agg(F.count("*").alias("n"), F.min(F.least("key", "next_key")).alias("low"), F.max(F.greatest("key", "next_key")).alias("high")).first()
    low, width = stat["low"] or 0, max(1, -(-((stat["high"] or 0) - (stat["low"] or 0) + 1) // max(1, -(-stat["n"] // part_turns))))

    def store(folder: str, at: str, to: str) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for (name,), table in blocks.sorted_groups(batches, "part"):
                blocks.put(f"{base}/{folder}", str(name), table.drop_columns("part"))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        own = turns.select(F.expr(f"({at} - {low}L) div {width}L").alias("part"), F.col(at).alias("at"), F.col(to).alias("to"), "next_mm", "next_ms")
        blocks.spread(own, "part").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()

    store("on", "key", "next_key")
    rows = seeds.groupBy("request").agg(F.min("key").alias("near"), F.array_sort(F.collect_list(F.struct("dist_mm", "ms", "key"))).alias("firsts"))
    ahead: list[int] = []
    if targets is not None:
        store("back", "next_key", "key")
        region_of, ahead = regions(turns, low, width, big)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for (name,), table in blocks.sorted_groups(batches, "part"):
                blocks.put(f"{base}/regions", str(name), table.drop_columns("part"))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        blocks.spread(region_of.withColumn("part", F.expr(f"(key - {low}L) div {width}L")), "part").mapInArrow(keep, "n bigint").agg(F.sum("n")).collect()
        rows = rows.join(targets.groupBy("request").agg(F.collect_list(F.struct("key", "target", "back_mm", "back_ms")).alias("goals")), "request")
    rows = graph._cut(rows, "near-requests")
    aimed = targets is not None
    fields = _LABEL if not aimed else "request bigint, target string, key bigint, dist_mm bigint, ms bigint, pred bigint, tier int, keys array<bigint>"
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    named = [x.split() for x in fields.split(", ")]
    layout = pa.schema([(n, kinds[t]) for n, t in named])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), layout.types, strict=True)], schema=layout)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, back, marks, out = Parts(f"{base}/on", low, width), Parts(f"{base}/back", low, width), Regions(f"{base}/regions", low, width), []
        for given in batches:
            for row in given.to_pylist():
                request, firsts = row["request"], [(x["dist_mm"], x["ms"], x["key"]) for x in row["firsts"]]
                goals: dict[int, list[tuple[str, int, int]]] = {}
                for x in row.get("goals", ()):
                    goals.setdefault(x["key"], []).append((x["target"], x["back_mm"], x["back_ms"]))
                own, leads = {k for *_, k in firsts}, None
                if goals and (before := _around(back, marks, set(goals), most)):
                    after = _around(net, marks, own, most)
                    if after and after[0].isdisjoint(before[0]) and not any(ahead[r] & before[1] for r in range(len(ahead)) if after[1] >> r & 1):
                        continue

                    def leads(key: int, bits: int = before[1]) -> bool:
                        region = marks.of(key)
                        return region is None or ahead[region] & bits != 0

                found = _near(net, firsts, limit, goals, beyond_mm, most, leads)
                if found is None:
                    if not goals or not _cut_off(back, set(goals), own, most):
                        out.append((request, *[None] * (len(named) - 1)))
                elif not aimed:
                    out += [(request, k, *label) for k, label in found[0].items()]
                else:
                    best = min((x[0] for x in found[1].values()), default=0)
                    for target, (d, t, pred, key) in found[1].items():
                        way, at = [key], pred
                        while at != -1:
                            way.append(at)
                            at = found[0][at][2]
                        out.append((request, target, key, d, t, pred, max(1, -(-(d - best) // step_mm)) if step_mm else 1, way[::-1]))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 500))
    both = graph._cut(rows.repartitionByRange(tasks, "near", "request").sortWithinPartitions("near", "request").mapInArrow(solve, fields), "near-found")
    blocks.clear(spark, base)
    return both.where("key is not null"), both.where("key is null").select("request")


def _local_targets(seeds: DataFrame, turns: DataFrame, goals: DataFrame, step: int, tiers: int, **far) -> DataFrame:
    legal = turns.where("reject = 0")
    own = {k: far[k] for k in ("part_turns", "big") if k in far}
    found, left = near_parts(seeds, legal, targets=goals, beyond_mm=step * tiers, step_mm=step, **own)
    if left.isEmpty():
        return found
    far = {k: x for k, x in far.items() if k != "big"}
    rest = _far_targets(seeds.join(left, "request", "left_semi"), legal, goals.join(left, "request", "left_semi"), None, step, tiers, None, True, **far)
    return found.unionByName(rest.targets.select(found.columns))


def within(seeds: DataFrame, turns: DataFrame, limit: int, **far) -> DataFrame:
    """Labels of every request within `limit` over a network of any size: by near_parts(), and by far_labels() for those left."""
    own = {"part_turns": far["part_turns"]} if "part_turns" in far else {}
    found, left = near_parts(seeds, turns, limit, **own)
    if left.isEmpty():
        return found
    return found.unionByName(far_labels(seeds.join(left, "request", "left_semi"), turns, limit, **far)[0])


def remaining(turns: DataFrame, goals: DataFrame, small: int, **far) -> DataFrame:
    """(key, dist_mm): from the end of each key the least way to a target, where there is one."""
    legal = turns.where("reject = 0")
    last = legal.join(goals.groupBy(F.col("key").alias("next_key")).agg(F.max("back_mm").alias("back")), "next_key")
    seeds = last.groupBy("key").agg(F.min(F.col("next_mm") - F.col("back")).alias("dist_mm")).withColumn("request", F.lit(0))
    return graph.shortest_paths(seeds, legal.select(F.col("next_key").alias("key"), F.col("key").alias("next_key"), "next_mm"), small=small, **far).select("key", "dist_mm")


def _goals(table: pa.Table) -> dict[int, list[tuple[str, int, int, int | None]]]:
    on: dict[int, list[tuple[str, int, int, int | None]]] = {}
    for target, key, *rest in zip(*(table.column(c).to_pylist() for c in ("target", "key", "back_mm", "back_ms", "request")), strict=True):
        on.setdefault(key, []).append((target, *rest))
    return on


def _solve(net: Turns, on: dict[int, list[tuple[str, int, int, int | None]]], request: int, labels: list[tuple[int, int, int]], take: set[str], step: int, tiers: int, budget: int | None, ahead: np.ndarray | None, ways: bool) -> tuple[list[tuple], tuple]:
    """One request by a heap: (targets with tiers, counts and outcome). The heap's order is the distance plus what is ahead, if known."""
    met: dict[str, tuple[int, int, int, int]] = {}
    done: dict[int, int] = {}
    heap: list[tuple[int, int, int, int]] = []
    held: dict[int, tuple[int, int, int]] = {}
    best, tier, outcome, cut = FAR, 1, EXHAUSTED, FAR
    # keys without any turn get places beyond the others
    far = list(dict.fromkeys([k for _, _, k in labels] + list(on)))
    known = net.place(np.array(far, np.int64)).tolist()
    places = {k: p if p >= 0 else len(net.keys) + i for i, (k, p) in enumerate(zip(far, known, strict=True))}
    at = {places[k]: goals for k, goals in on.items()}
    if ahead is not None:
        first = [d + int(ahead[places[k]]) for d, _, k in labels if places[k] < len(net.keys) and ahead[places[k]] < FAR]
        first += [d - mm for d, _, k in labels for _, mm, _, _ in on.get(k, ()) if d >= mm]
        horizon = min(first) + tiers * step if first else -1
    omitted = False

    def reach(place: int, d: int, t: int, pred: int, key: int, goals: list[tuple[str, int, int, int | None]] | None) -> None:
        nonlocal best, omitted
        for target, mm, ms, whose in goals or ():
            label = (d - mm, t - ms, pred, key)
            if d >= mm and (whose is None or whose == request) and (target not in met or label < met[target]):
                met[target] = label
                best = min(best, d - mm)
        if (had := held.get(place)) is None or (d, t, pred) < had:
            held[place] = (d, t, pred)
            if had is None or (d, t) < had[:2]:  # another predecessor of the same cost changes nothing further on
                f = d
                if ahead is not None:
                    f = d + int(ahead[place]) if place < len(net.keys) and ahead[place] < FAR else FAR
                    if f > horizon:
                        omitted = True
                        return
                heapq.heappush(heap, (f, t, d, place))

    for d, t, key in sorted(labels):
        reach(places[key], d, t, -1, key, on.get(key))
    while heap:
        f, t, d, place = heap[0]
        if place in done or (d, t) > held[place][:2]:
            heapq.heappop(heap)
            continue
        if best < FAR:
            while f > best + tier * step:
                if any(x in take and label[0] <= best + tier * step for x, label in met.items()):
                    outcome = ACCEPTED
                    break
                if tier == tiers:
                    outcome = SETTLED
                    break
                tier += 1
            if outcome != EXHAUSTED:
                break
        if budget is not None and len(done) >= budget:
            outcome, cut = LIMIT, f
            break
        heapq.heappop(heap)
        done[place] = f
        own = int(net.keys[place]) if place < len(net.keys) else -1
        for after, mm, ms in net.of(place):
            reach(after, d + mm, t + ms, own, int(net.keys[after]), at.get(after))
    if outcome == EXHAUSTED and best < FAR:
        tier = next((k for k in range(1, tiers + 1) if any(x in take and label[0] <= best + k * step for x, label in met.items())), tiers)
        outcome = ACCEPTED if any(x in take and label[0] <= best + tier * step for x, label in met.items()) else SETTLED if omitted else EXHAUSTED
    most = best + tier * step if best < FAR else FAR
    if outcome == ACCEPTED:
        done = {p: x for p, x in done.items() if x <= most}

    def way(pred: int, key: int) -> list[int]:
        back = [key]
        while pred != -1:
            back.append(pred)
            pred = held[places[pred] if pred in places else int(net.place(np.array([pred]))[0])][2]
        return back[::-1]

    near = [(target, *label) for target, label in met.items() if label[0] <= most and label[0] < cut]
    found = [(target, key, d, t, pred, max(1, -(-(d - best) // step)) if step else 1, way(pred, key) if ways else None) for target, d, t, pred, key in near]
    settled = np.array([p for p in done if p < len(net.keys)], np.int64)
    count = lambda x: int(x[settled].sum())
    return sorted(found, key=lambda x: (*x[2:4], x[0])), (len(done), count(net.checks), count(net.banned), count(net.blocked), outcome)


def _ended(net: Turns, on: dict[int, list[tuple[str, int, int, int | None]]], places: np.ndarray, dist: np.ndarray, ms: np.ndarray, pred: np.ndarray, step: int, tiers: int) -> tuple[list[tuple], tuple]:
    """What _solve() tells of a request without budget or accepted targets, from its labels of all keys: places, in order, and costs."""
    goals = np.array(list(on), np.int64)
    at = np.searchsorted(places, spots := net.place(goals))
    there = (spots >= 0) & (at < len(places)) & (places[np.minimum(at, len(places) - 1)] == spots)
    met: dict[str, tuple[int, int, int, int]] = {}
    for key, i in zip(goals[there].tolist(), at[there].tolist(), strict=True):
        for target, mm, t, _ in on[key]:
            label = (int(dist[i]) - mm, int(ms[i]) - t, int(pred[i]), key)
            met[target] = min(label, met.get(target, label))
    best = min((x[0] for x in met.values()), default=FAR)
    most = best + tiers * step if best < FAR else FAR
    done = dist <= most
    settled = places[done]
    found = [(target, key, d, t, p, max(1, -(-(d - best) // step)) if step else 1, None) for target, (d, t, p, key) in met.items() if d <= most]
    count = lambda x: int(x[settled].sum())
    return found, (len(settled), count(net.checks), count(net.banned), count(net.blocked), EXHAUSTED if done.all() else SETTLED)


def far_labels(seeds: DataFrame, turns: DataFrame, limit: int | None = None, part: Column | None = None, part_turns: int = 1_000_000, wave_mm: int | None = None, targets: DataFrame | None = None, enough_mm: int = 0, requests_a_group: int = 32, within_mm: int | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None, list[int]]:
    """(labels, target labels, requests that ended before the network did, label counts of the rounds) over a network in parts, for networks of any size.

    Keys are dealt into parts, by default by even ranges of keys with about part_turns turns each (so keys should be numbered
    such that neighbours are close; else give `part`, a column of `key`). A part's turns are one file of the shared folder, and so
    are the labels of each group of requests in it: they stay where they are, however many rounds there are. A round takes the
    labels that reached a part from others, within a bound of distance, and spreads them in the part by a heap; only labels that
    cross into another part, or lie beyond the bound, are dealt out again. The bound rises by wave_mm (by default 64 mean
    turns; none where at most four requests search the whole network) when no label lies within it, which keeps work that is done
    twice small. Rounds end when no label is left.
    With targets (target, key, back_mm, back_ms) a request is left out of further rounds once all that costs up to enough_mm more
    than its best target is known. A task holds one part's turns and the labels of at most requests_a_group requests in it on
    average. A repeated task reads the same earlier versions of its files and writes the same ones.

    With within_mm a key keeps only labels that cost at most so much more than its least one of any request: all requests of a part
    are then searched together, and nothing spreads where another request is nearer by more than that.
    """
    spark = seeds.sparkSession
    blocks.ship(spark)
    base = graph.shared(spark, "far-search")
    back = 0 if targets is None else targets.agg(F.max("back_mm")).first()[0] or 0
    stat = turns.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max(F.greatest("key", "next_key")).alias("high"), F.avg("next_mm").alias("mean"), F.max("next_mm").alias("longest")).first()
    parts = max(1, -(-stat["n"] // part_turns))
    width = max(1, -(-(stat["high"] - stat["low"] + 1) // parts)) if stat["n"] else 1
    of = part if part is not None else F.floor((F.col("key") - (stat["low"] or 0)) / width).cast("bigint")
    requests = 0 if within_mm is not None else seeds.select("request").distinct().count()
    groups = max(1, -(-requests // requests_a_group))
    # a few searches of the whole network: a round for each part on the way costs less than one for each step of the bound
    whole = requests <= 4 and targets is None and limit is None
    wave = wave_mm or (FAR // 4 if whole else int(64 * (stat["mean"] or 1)) + 1)
    own = lambda df: df.withColumn("part", of)
    goal_rows = None if targets is None else own(targets.select("key", "target", "back_mm", "back_ms", "request"))

    def store(folder: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for (name,), table in blocks.sorted_groups(batches, "part"):
                blocks.put(f"{base}/{folder}", str(name), table.drop_columns("part"))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return run

    blocks.spread(own(turns), "part").mapInArrow(store("turns"), "n bigint").agg(F.sum("n")).collect()
    if goal_rows is not None:
        blocks.spread(goal_rows, "part").mapInArrow(store("goals"), "n bigint").agg(F.sum("n")).collect()

    def table_of(folder: str, name: int) -> pa.Table | None:
        fs, root = blocks.at(f"{base}/{folder}")
        return blocks.get(f"{base}/{folder}", str(name)) if fs.get_file_info(f"{root}/{name}").is_file else None

    def spreading(number: int, bound: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, net, on = None, None, {}
            for (name, group), rows in blocks.sorted_groups(batches, "part", "group"):
                if name != before:
                    table = table_of("turns", name)
                    net = Turns(table) if table else None
                    sources = np.unique(np.asarray(table.column("key").combine_chunks())) if net else np.zeros(0, np.int64)
                    own_keys = dict(zip(sources.tolist(), net.place(sources).tolist() if net else (), strict=True))
                    goals = table_of("goals", name)
                    on, before = _goals(goals) if goals else {}, name
                folder = f"labels/{name}-{group}"
                earlier = [v for v in blocks.versions(base, folder) if v < number]
                labels: dict[int, dict[int, tuple[int, int, int]]] = {}
                least: dict[int, int] = {}  # of each key, where labels have to lie within a bound of it
                if earlier:
                    for r, k, *label in zip(*(blocks.get(base, f"{folder}/{earlier[-1]}").column(c).to_pylist() for c in _NAMES), strict=True):
                        labels.setdefault(r, {})[k] = tuple(label)
                        if within_mm is not None:
                            least[k] = min(label[0], least.get(k, FAR))
                heaps: dict[int | None, list[tuple[int, int, int, int]]] = {}
                met: dict[tuple[int, str], tuple[int, int, int, int]] = {}
                away: dict[tuple[int, int], tuple[int, int, int]] = {}

                def better(r: int, key: int, label: tuple[int, int, int], labels=labels, heaps=heaps, met=met, on=on, least=least) -> None:
                    if within_mm is not None:
                        if label[0] > least.get(key, FAR) + within_mm:
                            return
                        least[key] = min(label[0], least.get(key, FAR))
                    held = labels.setdefault(r, {})
                    had = held.get(key)
                    if had is not None and had <= label:
                        return
                    held[key] = label
                    if had is None or label[:2] < had[:2]:
                        heapq.heappush(heaps.setdefault(r if within_mm is None else None, []), (*label[:2], key, r))
                    for target, mm, ms, whose in on.get(key, ()):
                        at = (label[0] - mm, label[1] - ms, label[2], key)
                        if label[0] >= mm and (whose is None or whose == r) and ((r, target) not in met or at < met[r, target]):
                            met[r, target] = at

                for r, k, *label in zip(*(rows.column(c).to_pylist() for c in _NAMES), strict=True):
                    better(r, k, tuple(label))
                for heap in heaps.values():
                    while heap:
                        d, t, key, r = heapq.heappop(heap)
                        held = labels[r]
                        if (d, t) != held[key][:2] or key not in own_keys or (within_mm is not None and d > least[key] + within_mm):
                            continue
                        for after, mm, ms in net.of(own_keys[key]):
                            k, label = int(net.keys[after]), (d + mm, t + ms, key)
                            if limit is not None and label[0] > limit:
                                continue
                            if k in own_keys and label[0] <= bound:
                                better(r, k, label)
                            elif (k not in held or label < held[k]) and ((r, k) not in away or label < away[r, k]):
                                away[r, k] = label
                flat = [(r, k, *label) for r, own in labels.items() for k, label in own.items() if within_mm is None or label[0] <= least[k] + within_mm]
                blocks.put(base, f"{folder}/{number}", _table(flat))
                for v in earlier[:-1]:  # a repeated task needs the last one
                    blocks.forget(base, f"{folder}/{v}")
                out = [(r, k, *label, None) for (r, k), label in away.items()] + [(r, key, *label, target) for (r, target), (*label, key) in met.items()]
                for i in range(0, len(out), 100_000):
                    yield _table(out[i : i + 100_000], "target").to_batches()[0]

        return run

    fields = f"{_LABEL}, target string"
    first = starts(seeds).withColumn("pred", F.lit(-1).cast("bigint"))
    pending = graph._cut((first if limit is None else first.where(F.col("dist_mm") <= limit)).select(*_NAMES), "far-labels")
    reached = ended = None
    bound, number, counts = -1, 0, []
    least = lambda df, *keys: df.groupBy(*keys).agg(F.min(F.struct("dist_mm", "ms", "pred", *(["key"] if "key" not in keys else []))).alias("b")).select(*keys, "b.*")
    while (low := pending.agg(F.min("dist_mm")).first()[0]) is not None:
        if low > bound:
            bound = low + wave
        number += 1
        due = own(pending.where(F.col("dist_mm") <= bound)).withColumn("group", F.pmod(F.hash("request"), F.lit(groups)))
        counts.append(due.count())
        out = graph._cut(blocks.spread(due, "part", "group").mapInArrow(spreading(number, bound), fields), "far-step")
        left = least(pending.where(F.col("dist_mm") > bound).unionByName(out.where("target is null").select(*_NAMES)), "request", "key")
        if targets is not None:
            now = out.where("target is not null").select("request", "target", "dist_mm", "ms", "pred", "key")
            after = graph._cut(least(now if reached is None else now.unionByName(reached), "request", "target"), "far-targets")
            if reached is not None:
                graph._drop(reached)
            reached = after
            # labels up to the bound are final once none is pending below it, so targets are, up to the longest turn before it
            safe = left.groupBy("request").agg(F.min("dist_mm").alias("next"))
            known = reached.groupBy("request").agg((F.min("dist_mm") + enough_mm).alias("most")).join(safe, "request").where(F.least(F.col("next") - 1, F.lit(bound)) - F.lit(max(stat["longest"] or 0, back)) >= F.col("most"))
            known = graph._cut(known.select("request", F.lit(FAR).alias("dist_mm")), "far-ended")
            ended = known if ended is None else ended.unionByName(known)
            left = left.join(known, "request", "left_anti")
        after = graph._cut(left.select(*_NAMES), "far-labels")
        graph._drop(pending)
        graph._drop(out)
        pending = after

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                yield from blocks.get(base, f"labels/{folder}/{blocks.versions(base, f'labels/{folder}')[-1]}").to_batches(100_000)

    fs, root = blocks.at(f"{base}/labels")
    fs.create_dir(root, recursive=True)
    # a name for each part and group of requests that was met, as many as files were written
    names = [(x.base_name,) for x in fs.get_file_info(blocks.pfs.FileSelector(root))]
    listed = spark.createDataFrame(names, "folder string").repartition(max(1, min(len(names), 1024)), "folder")
    labels = graph._cut(listed.mapInArrow(final, _LABEL), "far-found")
    blocks.clear(spark, base)
    if targets is not None and reached is None:
        reached = spark.createDataFrame([], "request bigint, target string, dist_mm bigint, ms bigint, pred bigint, key bigint")
    return labels, reached, ended, counts


def _border_arcs(turns: DataFrame, seeds: DataFrame, part) -> DataFrame:
    """(request, key, next_key, dist_mm): least ways within parts to the keys of other parts that turns lead to: from each key that
    turns of other parts lead to (request null), and from seeds (request, key, dist_mm; key null)."""
    across = turns.where(part("key") != part("next_key"))
    none = F.lit(None).cast("bigint")
    rows = turns.select(part("key").alias("part"), F.lit(0).alias("kind"), none.alias("request"), "key", "next_key", "next_mm")
    rows = rows.unionByName(across.select(F.col("next_key").alias("key")).distinct().select(part("key").alias("part"), F.lit(1).alias("kind"), none.alias("request"), "key", none.alias("next_key"), F.lit(0).cast("bigint").alias("next_mm")))
    rows = rows.unionByName(seeds.select(part("key").alias("part"), F.lit(2).alias("kind"), "request", "key", none.alias("next_key"), F.col("dist_mm").alias("next_mm")))
    inside = part("next_key") == F.col("part")
    names = ["request", "key", "next_key", "dist_mm"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in blocks.sorted_groups(batches, "part"):
            kind, request, key, after, mm, own = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("kind", "request", "key", "next_key", "next_mm", "inside"))
            turn = kind == 0
            if not turn.any():
                continue
            zero = np.zeros(int(turn.sum()), np.int64)
            net = Turns(pa.table({"key": key[turn], "next_key": after[turn].astype(np.int64), "next_mm": mm[turn], "next_ms": zero, "reject": zero}))
            beyond = np.unique(after[turn & (own == False)].astype(np.int64))  # noqa: E712
            columns = net.place(beyond)
            reached = Reached(net, max(1, CELLS // len(net.keys)))
            size = len(reached.dist) // reached.width
            # a source is an entered key, or all seeds of a request
            source = [(None, int(k), key[[i]], np.zeros(1, np.int64)) for i, k in zip(np.flatnonzero(kind == 1), key[kind == 1], strict=True)]
            for r in np.unique(request[kind == 2].astype(np.int64)):
                mine = (kind == 2) & (request == r)
                source.append((int(r), None, key[mine], mm[mine]))
            for at in range(0, len(source) if len(beyond) else 0, size):
                some = source[at : at + size]
                place = [net.place(k) for *_, k, _ in some]
                cells = np.concatenate([i * reached.width + p[p >= 0] for i, p in enumerate(place)])
                if not len(cells):
                    continue
                reached.distances(cells, np.concatenate([d[p >= 0] for (*_, d), p in zip(some, place, strict=True)]))
                far = reached.dist.reshape(size, reached.width)[: len(some), columns]
                i, j = np.nonzero(far < FAR)
                yield pa.RecordBatch.from_arrays([pa.array([some[x][0] for x in i], pa.int64()), pa.array([some[x][1] for x in i], pa.int64()), pa.array(beyond[j]), pa.array(far[i, j])], names)

    spread = blocks.spread(rows.withColumn("inside", F.coalesce(inside, F.lit(True))), "part")
    return graph._cut(spread.mapInArrow(solve, "request bigint, key bigint, next_key bigint, dist_mm bigint"), "border-arcs")


def _by_borders(ends: DataFrame, turns: DataFrame, count: int, within_mm: int, part_turns: int) -> DataFrame:
    """Labels as of far_labels() with within_mm, without a round for each part on the way: least ways between the borders of every
    part are found for all parts at once, labels of border keys from these alone, and then those within all parts at once."""
    stat = turns.agg(F.min(F.least("key", "next_key")).alias("low"), F.max(F.greatest("key", "next_key")).alias("high")).first()
    width = max(1, -(-(stat["high"] - stat["low"] + 1) // max(1, -(-count // part_turns))))
    part = lambda c: F.expr(f"({c} - {stat['low']}L) div {width}L")
    arcs = _border_arcs(turns, ends, part)
    none = F.lit(0).cast("bigint")
    over = arcs.where("request is null").select("key", "next_key", F.col("dist_mm").alias("next_mm"), none.alias("next_ms"), none.alias("reject"))
    first = arcs.where("request is not null").select("request", F.col("next_key").alias("key"), "dist_mm")
    borders = far_labels(first, over, wave_mm=FAR // 4, within_mm=within_mm)[0]
    all_ = ends.unionByName(borders.select("request", "key", "dist_mm"))
    return far_labels(all_, turns.where(part("key") == part("next_key")), part=part("key"), wave_mm=FAR // 4, within_mm=within_mm)[0]


def nearest_targets(seeds: DataFrame, turns: DataFrame, targets: DataFrame, step_mm: int = 1_000_000, tiers: int = 5, accepted: DataFrame | None = None, part_turns: int = 250_000, small: int = 2_000_000) -> DataFrame:
    """(request, target, dist_mm, tier): what target_search() tells of targets that all requests share, however many requests there are.

    The network is searched once, from the targets against the direction of travel, in parts (far_labels()): of a key only targets
    are kept within `tiers` * step_mm of its nearest one, since the way of a request to a target that counts leads only over such
    keys. Requests then look up their first keys, so that work grows with the network and not with its product with the requests.
    Parts are spread in any order, without a rising bound: a round for each part that the way from the targets leads through. Over
    `small` turns the parts' borders are searched first (_by_borders()), and rounds don't grow with the parts.
    targets: target, key, back_mm, at most the key's length.
    """
    goals = graph._cut(targets.select(F.col("target").cast("string").alias("target"), *(F.col(c).cast("bigint").alias(c) for c in ("key", "back_mm"))), "goals")
    named = graph._cut(goals.select("target").distinct().withColumn("id", F.monotonically_increasing_id()), "goal-names")
    legal = prepared(turns).where("reject = 0")
    legal = graph._cut(legal, "turns")
    last = legal.join(goals.withColumnRenamed("key", "next_key"), "next_key").join(named, "target")
    ends = last.select(F.col("id").alias("request"), "key", (F.col("next_mm") - F.col("back_mm")).alias("dist_mm"))
    # a turn is searched from its end: the cost of a key is that of the way on from its own end
    back = legal.select(F.col("next_key").alias("key"), F.col("key").alias("next_key"), "next_mm", F.lit(0).cast("bigint").alias("next_ms"), "reject")
    count = legal.count()
    if count > small:
        ahead = _by_borders(graph._cut(ends, "goal-ends"), back, count, step_mm * tiers, part_turns)
    else:
        ahead = far_labels(ends, back, part_turns=part_turns, wave_mm=FAR // 4, within_mm=step_mm * tiers)[0]
    first = graph._cut(starts(seeds).select("request", "key", "dist_mm"), "first-keys")
    far = first.join(ahead.select(F.col("request").alias("id"), "key", F.col("dist_mm").alias("rest")), "key").join(named, "id").select("request", "target", (F.col("dist_mm") + F.col("rest")).alias("dist_mm"))
    on = first.join(goals, "key").where("dist_mm >= back_mm").select("request", "target", (F.col("dist_mm") - F.col("back_mm")).alias("dist_mm"))
    met = graph._cut(far.unionByName(on).groupBy("request", "target").agg(F.min("dist_mm").alias("dist_mm")), "met-targets")
    beyond = F.col("dist_mm") - F.col("best")
    tier = F.greatest(F.lit(1), F.ceil(beyond / max(step_mm, 1))).cast("int")
    near = met.join(met.groupBy("request").agg(F.min("dist_mm").alias("best")), "request").where(beyond <= tiers * step_mm).select("request", "target", "dist_mm", tier.alias("tier"))
    if accepted is None:
        return near
    took = near.join(accepted.select("request", "target"), ["request", "target"], "left_semi").groupBy("request").agg(F.min("tier").alias("most"))
    return near.join(took, "request", "left").where(F.col("most").isNull() | (F.col("tier") <= F.col("most"))).drop("most")


def _table(rows: list[tuple], *more: str) -> pa.Table:
    names = [*_NAMES, *more]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.string() if n in more else pa.int64()) for n, c in zip(names, columns, strict=True)})


def _far_targets(seeds: DataFrame, turns: DataFrame, goals: DataFrame, wanted: DataFrame | None, step: int, tiers: int, budget: int | None, ways: bool, **far) -> Found:
    labels, reached, ended, counts = far_labels(seeds, turns.where("reject = 0").drop("reject").withColumn("reject", F.lit(0).cast("tinyint")), targets=goals, enough_mm=step * tiers, **far)
    best = reached.groupBy("request").agg(F.min("dist_mm").alias("best"))
    scored = reached.join(best, "request").withColumn("tier", F.greatest(F.lit(1), F.ceil((F.col("dist_mm") - F.col("best")) / max(step, 1))).cast("int")).where(F.col("tier") <= tiers)
    if wanted is None:
        last = best.select("request", "best", F.lit(tiers).alias("last"), F.lit(False).alias("took"))
    else:
        took = scored.join(wanted, ["request", "target"], "left_semi").groupBy("request").agg(F.min("tier").alias("t"))
        last = best.join(took, "request", "left").select("request", "best", F.coalesce("t", F.lit(tiers)).alias("last"), F.col("t").isNotNull().alias("took"))
    limits = seeds.select("request").distinct().join(last, "request", "left").withColumn("most", F.coalesce(F.col("best") + F.col("last") * step, F.lit(FAR)))
    near = labels.join(limits.select("request", "most"), "request").where(F.col("dist_mm") <= F.col("most"))
    if budget is None:
        cuts = limits.withColumn("cut", F.lit(None).cast("bigint"))
    else:
        from pyspark.sql import Window

        w = Window.partitionBy("request").orderBy("dist_mm")
        each = near.groupBy("request", "dist_mm").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w))
        cuts = limits.join(each.where(F.col("upto") > budget).groupBy("request").agg(F.min("dist_mm").alias("cut")), "request", "left")
    turned = turns.groupBy("key").agg(F.count("*").alias("checks"), F.count_if(F.col("reject") == 1).alias("banned"), F.count_if(F.col("reject") == 2).alias("blocked"))
    if budget is not None:  # of keys at one distance the quicker, then those earlier in order are settled first
        ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("dist_mm", "ms", "pred", "key")))
        near = ranked.where(F.col("place") <= budget)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    sums = near.join(turned, "key", "left").groupBy("request").agg(F.count("*").alias("settled"), n("checks"), n("banned"), n("blocked"))
    ways = labels.select("request", "dist_mm")
    beyond = (ways if ended is None else ways.unionByName(ended)).groupBy("request").agg(F.max("dist_mm").alias("farthest"))
    outcome = F.when(F.col("cut").isNotNull(), LIMIT).when(F.coalesce("took", F.lit(False)), ACCEPTED).when(F.col("best").isNotNull() & (F.col("farthest") > F.col("most")), SETTLED).otherwise(EXHAUSTED)
    audit = cuts.join(sums, "request", "left").join(beyond, "request", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    targets = scored.join(cuts.select("request", "most", "cut"), "request").where((F.col("dist_mm") <= F.col("most")) & (F.col("cut").isNull() | (F.col("dist_mm") < F.col("cut"))))
    targets = targets.select("request", "target", "key", "dist_mm", "ms", "pred", "tier")
    if ways:
        targets = targets.join(ways_to(labels, targets), ["request", "key", "pred"])
    return Found(targets, audit.select("request", *map(zero, ("settled", "checks", "banned", "blocked")), outcome.alias("outcome")), counts)


def ways_to(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """(request, key, pred, keys): all keys of the way to each end (request, key, pred), in order, from labels (request, key, pred).

    Predecessors are followed back for all ends at once, eight keys a round: the table of single steps is doubled thrice.
    """
    none = F.array().cast("array<bigint>")
    steps = labels.select("request", F.col("key").alias("at"), F.when(F.col("pred") != -1, F.array("pred")).otherwise(none).alias("path"), F.col("pred").alias("next"))
    for _ in range(3):
        on = steps.select("request", F.col("at").alias("next"), F.col("path").alias("far"), F.col("next").alias("beyond"))
        steps = steps.join(on, ["request", "next"], "left").select("request", "at", F.concat(F.coalesce("far", none), "path").alias("path"), F.coalesce("beyond", "next").alias("next"))
    steps = graph._cut(steps, "way-steps")
    walk = ends.select("request", "key", "pred").distinct().select("request", "key", "pred", F.when(F.col("pred") != -1, F.array("pred", "key")).otherwise(F.array("key")).alias("keys"), F.col("pred").alias("at"))
    done = None
    while True:
        walk = graph._cut(walk, "way-walk")
        ended = walk.where("at = -1").select("request", "key", "pred", "keys")
        done = ended if done is None else done.unionByName(ended)
        walk = walk.where("at <> -1")
        if walk.isEmpty():
            return done
        walk = walk.join(steps, ["request", "at"]).select("request", "key", "pred", F.concat("path", "keys").alias("keys"), F.col("next").alias("at"))


def from_places(firsts: DataFrame, turns: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, turns, targets) in which requests start within edges: an overlay on the network that all requests share.

    firsts: request, key, dist_mm, ms: from a place on a key's edge to the key's end. What is left of key k from a place is a key of
    its own, -2 - k, with the turns of k: k itself can be driven wholly later, and a target that lies on it before the place is
    met only then. A target after the place is met on the first part too.
    """
    split = lambda c: (F.lit(-2) - F.col(c)).alias(c)
    used = firsts.select("key").distinct()
    seeds = firsts.select("request", split("key"), "dist_mm", "ms")
    rest = [c for c in turns.columns if c != "key"]
    more = turns.join(used, "key", "left_semi").select(split("key"), *rest)
    goals = [c for c in targets.columns if c != "key"]
    return seeds, turns.select("key", *rest).unionByName(more), targets.select("key", *goals).unionByName(targets.join(used, "key", "left_semi").select(split("key"), *goals))


def original(key: Column) -> Column:
    """The directed key of the network that a key of an overlay lies on."""
    return F.when(key < 0, F.lit(-2) - key).otherwise(key)
