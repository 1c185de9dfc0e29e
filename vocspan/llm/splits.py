"""Problem 5: splits with given shares that keep all rows of one recording together.

A component is a recording, whatever file names it is listed under. Components are bundled by identical size and label
profile (the channel with most of their rows), so the optimisation sees counts, not components. In a min-cost flow every
bundle is a node, and its rows flow over the cells (split, profile) to the splits. A split takes its quota of rows for free and
pays for rows beyond it; so does a cell for its quota of the profile, at a lower price, which spreads the channels, and a bundle
for more than its own part in whole components, at the lowest, which spreads the sizes. The flow is rounded to whole
components, the largest ones first and the rest solved again around them, and the members of a bundle are given to splits by
the rank of their hash.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspan.session import cut

_ID = r"([A-Za-z0-9_-]{11})"
_DATE = r"^[\s\p{Z}]*(?:\d{8}|\d{4}-\d{2}-\d{2})"
#: Forms of a name, most telling first: date--id--title, date - id - title with one kind of separator, id--title, [id] or (id) anywhere, an address.
ID_FORMS = (
    rf"{_DATE}--{_ID}--",
    rf"{_DATE}[\s\p{{Z}}]+--[\s\p{{Z}}]+{_ID}[\s\p{{Z}}]+--(?:[\s\p{{Z}}]|$)",
    rf"{_DATE}[\s\p{{Z}}]*[‐-―−|_ ]+[\s\p{{Z}}]*{_ID}[\s\p{{Z}}]*[‐-―−|_ ]+",
    rf"{_DATE}-{_ID}-",
    rf"^[\s\p{{Z}}]*{_ID}--",
    rf"[\[({{<]{_ID}[\])}}>]",
    rf"(?:v=|youtu\.be/|/embed/|/shorts/){_ID}(?:[^A-Za-z0-9_-]|$)",
    rf"{_DATE}--{_ID}[\s\p{{Z}}-]",
    rf"--{_ID}(?=--|\.|$)",
)


#: Words, numbers and words with a number, joined by - and _: what a title may hold. Of random ids about one in 2,000 looks so.
_WORDY = r"^[_-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]*|[0-9]+)(?:[_-]+(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]*|[0-9]+))*[_-]*$|^[_-]+$"


def recording_id(file: Column) -> Column:
    """The 11-character id in a file name by its form alone, one that does not look like words first; NULL when the name has none of the forms."""
    found = [F.regexp_extract_all(file, F.lit(form), F.lit(1)) for form in ID_FORMS]
    first = lambda ids: F.get(ids, F.lit(0))
    return F.coalesce(*[first(F.filter(ids, lambda x: ~x.rlike(_WORDY))) for ids in found], *map(first, found))


#: Eleven characters of an id with one before and one after, cut neither from a longer word nor from a longer number.
_SPOT = r"(?s)^(?:[^A-Za-z0-9][A-Za-z0-9_-]|.[_-])[A-Za-z0-9_-]{9}(?:[A-Za-z0-9_-][^A-Za-z0-9]|[_-].)$"
STRONG, WEAK, REPEATED = 1, 2, 3


def _spread(last: Column, x: Column) -> Column:
    """Spots of one name from left to right that do not overlap."""
    return F.when((F.size(last) == 0) | (F.element_at(last, -1)["at"] + 11 <= x["at"]), F.concat(last, F.array(x))).otherwise(last)


def names_with_ids(rows: DataFrame) -> DataFrame:
    """file, id of every distinct name and every id in it.

    Known are the ids in the place of a form, and eleven characters that do not look like words and stand by themselves in two or
    more names without a form. A name with an id in the place of a form has that one, and others of that kind that stand by
    themselves elsewhere in it. A name without one has the known ids in it from left to right, wherever they stand, glued to a word
    as well. An id that looks like words (engineering) counts only where it stands by itself, in names without a better one.
    """
    names = rows.select("file").filter("file is not null").distinct().select("file", recording_id(F.col("file")).alias("own"))
    names = cut(names.withColumn("strong", ~F.col("own").rlike(_WORDY)))
    spots = names.filter(F.length("file") >= 11).select("file", "own", "strong", F.explode(F.sequence(F.lit(1), F.length("file") - 10)).alias("at"))
    spots = spots.select("*", F.substring("file", F.col("at"), F.lit(11)).alias("id"), F.substring(F.concat(F.lit(" "), "file", F.lit(" ")), F.col("at"), F.lit(13)).rlike(_SPOT).alias("alone"))
    spots = spots.filter(F.col("id").rlike("^[A-Za-z0-9_-]{11}$") & (F.col("alone") | ~F.coalesce("strong", F.lit(False))))
    known = names.filter("own is not null").select(F.col("own").alias("id"), F.when(F.col("strong"), STRONG).otherwise(WEAK).alias("kind"))
    repeated = spots.filter(F.col("own").isNull() & F.col("alone") & ~F.col("id").rlike(_WORDY)).groupBy("id").agg(F.count_distinct("file").alias("n")).filter("n > 1").select("id", F.lit(REPEATED).alias("kind"))
    known = known.unionByName(repeated).groupBy("id").agg(F.min("kind").alias("kind"))
    elsewhere = F.abs(F.col("at") - F.expr("locate(own, file)")) >= 11
    fits = F.when(F.col("strong"), (F.col("kind") == STRONG) & elsewhere).otherwise((F.col("kind") == STRONG) | F.col("alone"))
    loose = spots.join(known, "id").filter(fits).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "id", "kind"))).alias("x"))
    # A better kind goes first; a name has at most as many spots as characters.
    better = F.exists("x", lambda x: x["kind"] != WEAK)
    loose = loose.withColumn("x", F.filter("x", lambda x: (x["kind"] != WEAK) | ~better))
    loose = loose.select("file", F.aggregate("x", F.filter("x", lambda x: F.lit(False)), _spread).alias("x")).select("file", F.transform("x", lambda x: x["id"]).alias("ids"))
    own = names.join(loose, "file", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    ids = F.when(F.col("strong"), F.array_union(F.array("own"), "ids")).when(F.size("ids") > 0, F.col("ids")).otherwise(F.array_compact(F.array("own")))
    return own.select("file", F.explode(ids).alias("id"))


def _roots(links: DataFrame) -> DataFrame:
    """id, root of ids that are linked by names which hold several: least label, passed on and looked up until nothing changes."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        lower = label.join(near, "a").select("a", "root", F.least("root", "m").alias("m"))
        jump = label.select(F.col("a").alias("m"), F.col("root").alias("far"))
        new = cut(lower.join(jump, "m", "left").select("a", "root", F.least("m", F.coalesce("far", "m")).alias("new")))
        if new.filter("new != root").isEmpty():
            return label.select(F.col("a").alias("id"), "root")
        label = new.select("a", F.col("new").alias("root"))


def components(rows: DataFrame) -> DataFrame:
    """file, component of every distinct name, NULL included: the recording it belongs to.

    A name without an id is a recording of its own, and so are all rows without a name.
    """
    ids = cut(names_with_ids(rows))
    first = ids.groupBy("file").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    several = ids.join(first.filter("n > 1").select("file", F.col("id").alias("a")), "file").filter("id != a").select("a", F.col("id").alias("b"))
    named = first.select("file", "id")
    if not several.isEmpty():
        named = named.join(_roots(several), "id", "left").select("file", F.coalesce("root", "id").alias("id"))
    every = rows.select("file").distinct()
    joined = every.join(named.select(F.col("file").alias("__file"), "id"), every["file"] == F.col("__file"), "left")
    return joined.select("file", F.coalesce(F.concat(F.lit("id:"), "id"), F.concat(F.lit("file:"), "file"), F.lit("none")).alias("component"))


def same_recording(rows: DataFrame) -> DataFrame:
    """file_a, file_b: distinct names of one recording, smaller first by code point. Names come together once each, so a
    recording has as many rows here as it has names, not as it has utterances."""
    names = names_with_ids(rows)
    a, b = names.select("id", F.col("file").alias("file_a")), names.select("id", F.col("file").alias("file_b"))
    # Spark compares UTF-8 bytes, whose order is that of code points.
    return a.join(b, "id").filter(F.col("file_a") < F.col("file_b")).select("file_a", "file_b").distinct()


class Flow:
    """Min-cost flow; capacities and costs are whole numbers.

    Primal-dual: potentials from shortest paths, then all that fits along paths of no reduced cost at once, so there are as many
    rounds as different path costs and not as paths.
    """

    def __init__(self, nodes: int) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        e = len(self.to)
        self.to += (b, a)
        self.room += (room, 0)
        self.cost += (cost, -cost)
        self.at[a].append(e)
        self.at[b].append(e + 1)
        return e

    def flow(self, e: int) -> int:
        return self.room[e ^ 1]

    def run(self, source: int, sink: int) -> None:
        level = [0] * len(self.at)
        while self._distances(source, level)[sink] < float("inf"):
            while self._push(source, sink, level):
                pass

    def _distances(self, source: int, level: list[int]) -> list[float]:
        """Shortest paths by reduced cost; the potentials are raised by them."""
        far: list[float] = [float("inf")] * len(self.at)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            for e in self.at[v]:
                if self.room[e] > 0 and (nd := d + self.cost[e] + level[v] - level[self.to[e]]) < far[self.to[e]]:
                    far[self.to[e]] = nd
                    heapq.heappush(heap, (nd, self.to[e]))
        for v, d in enumerate(far):
            if d < float("inf"):
                level[v] += d
        return far

    def _push(self, source: int, sink: int, level: list[int]) -> int:
        """A blocking flow along arcs of no reduced cost, by steps from the source."""
        free = lambda v, e: self.room[e] > 0 and self.cost[e] + level[v] - level[self.to[e]] == 0
        depth = {source: 0}
        queue = [source]
        for v in queue:
            for e in self.at[v]:
                if self.to[e] not in depth and free(v, e):
                    depth[self.to[e]] = depth[v] + 1
                    queue.append(self.to[e])
        if sink not in depth:
            return 0
        tried = dict.fromkeys(depth, 0)
        path: list[int] = []
        v, total = source, 0
        while True:
            if v == sink:
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                total += push
                back = next(i for i, e in enumerate(path) if not self.room[e])
                v = self.to[path[back] ^ 1]
                del path[back:]
            elif tried[v] < len(self.at[v]):
                e = self.at[v][tried[v]]
                if depth.get(self.to[e]) == depth[v] + 1 and free(v, e):
                    path.append(e)
                    v = self.to[e]
                else:
                    tried[v] += 1
            elif path:
                v = self.to[path.pop() ^ 1]
                tried[v] += 1
            else:
                return total


#: Prices of one row beyond the quota of a split, of a profile in a split, and of a bundle in a split.
SPLIT_PRICE, PROFILE_PRICE, BUNDLE_PRICE = 16, 2, 1


def flow_rows(bundles: list[tuple[int, str, int]], quota: dict[str, int]) -> list[dict[str, int]]:
    """Rows of each bundle (size, profile, count) that flow to each split, given the rows each split still has room for.

    source - bundle - cell - split - sink. A bundle's arcs have whole components as their capacity: its part of the quotas for
    free, more at a price, and none for a split whose quota is smaller than one component as long as another has room for it.
    """
    names = sorted(quota)
    profiles = sorted({p for _, p, _ in bundles})
    of_profile: dict[str, int] = defaultdict(int)
    for s, p, c in bundles:
        of_profile[p] += s * c
    room = {k: max(0, quota[k]) for k in names}
    whole = sum(room.values()) or 1
    node = {x: i + 2 for i, x in enumerate([*range(len(bundles)), *((k, p) for k in names for p in profiles), *((k,) for k in names)])}
    flow = Flow(len(node) + 2)
    total = sum(of_profile.values())
    arcs: dict[tuple[int, str], list[int]] = {}
    for k in names:
        flow.add(node[k,], 1, room[k], 0)
        flow.add(node[k,], 1, total, SPLIT_PRICE)
        for p in profiles:
            flow.add(node[k, p], node[k,], round(of_profile[p] * room[k] / whole), 0)
            flow.add(node[k, p], node[k,], total, PROFILE_PRICE)
    for i, (s, p, c) in enumerate(bundles):
        flow.add(0, node[i], s * c, 0)
        fits = [k for k in names if room[k] >= s] or names
        for k in names:
            part = min(c, round(c * room[k] / whole)) if k in fits else 0
            arcs[i, k] = [flow.add(node[i], node[k, p], s * part, 0), flow.add(node[i], node[k, p], s * (c - part), BUNDLE_PRICE if k in fits else SPLIT_PRICE)]
    flow.run(0, 1)
    return [{k: sum(map(flow.flow, arcs[i, k])) for k in names} for i in range(len(bundles))]


#: Components of at least this share of all rows are placed first; there are at most its inverse of them.
LARGE = 0.01


def solve(bundles: list[tuple[int, str, int]], targets: dict[str, float]) -> list[dict[str, int]]:
    """Components of each bundle (size, profile, count) that go to each split.

    The flow gives rows. Large components are rounded first, and the flow is solved again for the others with what is left of the
    quotas. A bundle's rows in a split, divided by its size and rounded down, are its components there; what is left over goes
    singly, largest first, to the split that lacks most. At last components are moved or swapped while the largest deviation shrinks.
    """
    if not bundles:
        return []
    names = sorted(k for k, w in targets.items() if w > 0)
    total = sum(s * c for s, _, c in bundles)
    whole = sum(targets[k] for k in names)
    quota = {k: round(total * targets[k] / whole) for k in names}
    filled = dict.fromkeys(names, 0)
    out: list[dict[str, int]] = [{} for _ in bundles]

    def settle(chosen: list[int]) -> None:
        rows = flow_rows([bundles[i] for i in chosen], {k: quota[k] - filled[k] for k in names})
        rest = []
        for i, flowed in zip(chosen, rows, strict=True):
            s, _, c = bundles[i]
            out[i] = {k: flowed[k] // s for k in names}
            for k in names:
                filled[k] += out[i][k] * s
            rest.append((i, c - sum(out[i].values()), flowed))
        for i, left, flowed in sorted(rest, key=lambda r: (-bundles[r[0]][0], bundles[r[0]][1])):
            s = bundles[i][0]
            for _ in range(left):
                k = max(names, key=lambda k: (min(0, quota[k] - filled[k] - s), flowed[k] % s, k))
                out[i][k] += 1
                filled[k] += s

    large = [i for i, (s, _, _) in enumerate(bundles) if s >= LARGE * total]
    if large:
        # All bundles take part, so that the large ones leave room for the others; only the large ones are rounded.
        rows = flow_rows(bundles, quota)
        for i in sorted(large, key=lambda i: (-bundles[i][0], bundles[i][1])):
            s, _, c = bundles[i]
            out[i] = dict.fromkeys(names, 0)
            for _ in range(c):
                k = max(names, key=lambda k: (min(0, quota[k] - filled[k] - s), rows[i][k] - out[i][k] * s, k))
                out[i][k] += 1
                filled[k] += s
    settle([i for i in range(len(bundles)) if i not in set(large)])
    _improve(bundles, out, filled, quota)
    return out


def _improve(bundles: list[tuple[int, str, int]], out: list[dict[str, int]], filled: dict[str, int], quota: dict[str, int]) -> None:
    """Move one component, or swap two, between an overfull and a lacking split while the largest deviation shrinks, which is a whole number."""
    while True:
        over = max(filled, key=lambda k: filled[k] - quota[k])
        under = min(filled, key=lambda k: filled[k] - quota[k])
        gap = min(filled[over] - quota[over], quota[under] - filled[under])
        if gap <= 0:
            return
        have = {s: i for i, (s, _, _) in enumerate(bundles) if out[i].get(over, 0) > 0}
        back = {0: None} | {s: i for i, (s, _, _) in enumerate(bundles) if out[i].get(under, 0) > 0}
        sizes = sorted(back)
        best, move = gap, None
        for s, i in have.items():
            at = bisect_left(sizes, s - gap)  # the partner whose size brings the exchange closest to the gap
            for t in sizes[max(0, at - 1) : at + 1]:
                if t < s and abs(gap - (s - t)) < best:
                    best, move = abs(gap - (s - t)), (i, back[t])
        if move is None:
            return
        i, j = move
        out[i][over] -= 1
        out[i][under] = out[i].get(under, 0) + 1
        step = bundles[i][0]
        if j is not None:
            out[j][under] -= 1
            out[j][over] = out[j].get(over, 0) + 1
            step -= bundles[j][0]
        filled[over] -= step
        filled[under] += step


#: Channels with at least this share of all rows are profiles of their own, at most its inverse of them; the others share one.
PROFILE_SHARE = 0.001
#: The plan of the bundles is sent to all tasks up to this many rows.
BROADCAST_ROWS = 100_000


def assign_components(rows: DataFrame, targets: DataFrame, seed: str = "2026", named: DataFrame | None = None) -> DataFrame:
    """component, n_rows, profile, split of every recording. named: the result of ``components``, if it is at hand.

    The driver sees bundles, that is sizes and profiles with counts: different sizes of components that add up to n rows number at
    most the root of 2n, so profiles with n rows in all have at most the sum of their roots, and there are at most 1001 profiles.
    With no rows there is no assignment; without targets it is an error.
    """
    want = {r["split_name"]: float(r["target_share"] or 0.0) for r in targets.filter("split_name is not null").collect()}
    if not want or max(want.values()) <= 0:
        raise ValueError("split targets need at least one positive share")
    # Rows are counted per name first: a name with a third of all rows is one row from there on.
    counted = rows.groupBy("file", F.coalesce("channel", F.lit("")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    named = (components(rows) if named is None else named).withColumnRenamed("file", "__file")
    by_channel = counted.join(named, F.col("file").eqNullSafe(F.col("__file"))).groupBy("component", "channel").agg(F.sum("n").alias("n"))
    # The profile is the channel with most rows of the recording.
    sized = by_channel.groupBy("component").agg(F.sum("n").alias("n_rows"), F.max_by("channel", F.struct("n", "channel")).alias("main"))
    sized = cut(sized.withColumn("h", F.xxhash64(F.lit(seed), F.col("component"))))
    total = sized.agg(F.sum("n_rows")).first()[0] or 0
    own = sized.groupBy("main").agg(F.sum("n_rows").alias("n")).filter(F.col("n") >= PROFILE_SHARE * total).select("main", F.col("main").alias("profile"))
    sized = sized.join(F.broadcast(own), "main", "left").select("component", "n_rows", "h", F.coalesce("profile", F.lit("\u2026")).alias("profile"))
    counts = sized.groupBy(F.col("n_rows").alias("bundle"), "profile").agg(F.count(F.lit(1)).alias("c")).collect()
    bundles = sorted((r["bundle"], r["profile"], r["c"]) for r in counts)
    plan = solve(bundles, want)
    bounds = []
    for (size, profile, _), part in zip(bundles, plan, strict=True):
        at = 0
        for name in sorted(part):
            if part[name]:
                bounds.append((size, profile, at, at + part[name], name))
                at += part[name]
    spark = rows.sparkSession
    frame = spark.createDataFrame(pd.DataFrame(bounds, columns=["n_rows", "profile", "lo", "hi", "split"]) if bounds else [], "n_rows long, profile string, lo long, hi long, split string")
    frame = F.broadcast(frame) if len(bounds) <= BROADCAST_ROWS else frame
    # A bundle may hold a third of all recordings: the rank of a hash is found inside hash ranges and carried on.
    ranges = sized.withColumn("slot", F.pmod(F.shiftright("h", 52), F.lit(4096)))
    inside = Window.partitionBy("n_rows", "profile", "slot").orderBy("h", "component")
    slots = ranges.groupBy("n_rows", "profile", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = slots.withColumn("before", F.sum("n").over(Window.partitionBy("n_rows", "profile").orderBy("slot")) - F.col("n")).drop("n")
    ranked = ranges.withColumn("i", F.row_number().over(inside) - 1).join(before, ["n_rows", "profile", "slot"]).withColumn("place", F.col("i") + F.col("before"))
    return ranked.join(frame, ["n_rows", "profile"]).filter((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).select("component", "n_rows", "profile", "split")


def assign_rows(rows: DataFrame, targets: DataFrame, seed: str = "2026") -> DataFrame:
    """source_row, file, new_split of every row; rows with NULL file form one recording, repeated rows stay with theirs."""
    named = cut(components(rows))
    parts = assign_components(rows, targets, seed, named).select("component", F.col("split").alias("new_split"))
    names = named.join(parts, "component").select(F.col("file").alias("__file"), "new_split")
    return rows.select("source_row", "file").join(names, F.col("file").eqNullSafe(F.col("__file"))).select("source_row", "file", "new_split")


def shares(rows: DataFrame, targets: DataFrame, seed: str = "2026") -> DataFrame:
    """new_split, n_components, n_rows, target_share, actual_share of every target."""
    parts = assign_components(rows, targets, seed).groupBy(F.col("split").alias("new_split")).agg(F.count(F.lit(1)).alias("n_components"), F.sum("n_rows").alias("n_rows"))
    want = targets.select(F.col("split_name").alias("new_split"), "target_share")
    joined = want.join(parts, "new_split", "left").fillna(0, ["n_components", "n_rows"])
    return joined.withColumn("actual_share", F.col("n_rows") / F.greatest(F.sum("n_rows").over(Window.partitionBy()), F.lit(1)))
