"""Filling containers of fixed capacity with documents of varying size, none split unless it is larger than one.

Sizes are whole numbers up to the capacity, so an instance is the count of each size: a grouped aggregation of all
documents, no larger than the capacity. On these counts the dominance reduction of Martello and Toth fixes sets of
up to three items that no other choice can beat; what remains goes by best fit, largest first. Both work on whole
counts at once and give runs of equal bins. Documents get their bins by their rank within their size.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scans import BUCKET, carry
from ..session import written
from .tokens import TOKENIZER, sized

#: Parts of a size for ranking.
PARTS = 256

Run = tuple[int, list[tuple[int, int]]]  # how many bins, each with (size, items of that size)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Fix the bins that dominate all others, largest item first; what is left is returned with its counts.

    A bin with item j dominates all bins with j if the other items of any of them can be laid under its items, several
    under one where their sum is no larger. With k the largest item that fits beside j, these are

    * j alone, where nothing fits beside it;
    * j and k, where they fill the bin, where no two others fit, or where no items that fit together beside j, however
      many, sum up to more than k;
    * j, k and m, the largest that fits beside both, where no three others fit and of any two that do the smaller is no
      larger than m (the larger is never larger than k).

    Fixing such a bin leaves the least number of bins what it was. Less items never undo any of these conditions, so as
    many bins as the counts allow are fixed at once; passes are repeated until one fixes nothing.
    """
    left = {s: n for s, n in counts.items() if n}
    runs: list[Run] = []
    changed = True
    while changed:
        changed = False
        sizes = sorted(s for s, n in left.items() if n)
        i = len(sizes) - 1
        while i >= 0:
            s = sizes[i]
            if not left[s]:
                i -= 1
                continue
            content = _dominating(s, sizes, left, capacity - s)
            if content is None:
                i -= 1  # it stays for best fit, or for the next pass; the next smaller may still be reducible
                continue
            need: dict[int, int] = {}
            for x in content:
                need[x] = need.get(x, 0) + 1
            n = min(left[x] // k for x, k in need.items())
            runs.append((n, list(need.items())))
            for x, k in need.items():
                left[x] -= n * k
            changed = True
    return runs, {s: n for s, n in left.items() if n}


def _dominating(s: int, sizes: list[int], left: dict[int, int], room: int) -> list[int] | None:
    """The items of a bin that dominates all bins with an item of size ``s``, None where no such bin is known."""
    free = lambda x: left[x] - (x == s)
    live = [x for x in sizes[: bisect.bisect_right(sizes, room)] if free(x) > 0]
    if not live:
        return [s]
    k = live[-1]
    if k == room:
        return [s, k]
    small: list[int] = []
    for x in live:
        small += [x] * min(free(x), 3 - len(small))
        if len(small) == 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return [s, k]
    if _best_two(live, free, room) > k:
        if len(small) == 3 and sum(small) <= room:
            return None
        beside = [x for x in live if x + k <= room and free(x) > (x == k)]
        if not beside or beside[-1] < _best_smaller(live, free, room):
            return None
        return [s, k, beside[-1]]
    if len(small) == 3 and sum(small) <= room and _best_sum(live, free, room) > k:
        return None
    return [s, k]


def _best_two(live: list[int], free: Callable[[int], int], room: int) -> int:
    """The largest sum of two items that fit the room together."""
    best, a, b = 0, 0, len(live) - 1
    while a <= b:
        if a == b and free(live[a]) < 2:
            break
        x = live[a] + live[b]
        if x <= room:
            best = max(best, x)
            a += 1
        else:
            b -= 1
    return best


def _best_smaller(live: list[int], free: Callable[[int], int], room: int) -> int:
    """Of all two items that fit the room together, the largest that the smaller can be."""
    best = 0
    for i, x in enumerate(live):
        other = x if free(x) > 1 else live[i + 1] if i + 1 < len(live) else None
        if other is not None and x + other <= room:
            best = x
    return best


def _best_sum(live: list[int], free: Callable[[int], int], room: int) -> int:
    """The largest sum of any number of items that fit the room together: bit n stands for the sum n."""
    sums, full = 1, (1 << (room + 1)) - 1
    for x in live:
        n, k = min(free(x), room // x), 1
        while n:
            k = min(k, n)
            sums |= (sums << (k * x)) & full
            n -= k
            k *= 2
        if sums >> room & 1:
            break
    return sums.bit_length() - 1


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit, largest first, on counts: bins of equal room are filled together."""
    rooms: list[int] = []  # ascending
    bins: dict[int, list[Run]] = {}

    def add(room: int, n: int, items: list[tuple[int, int]]) -> None:
        if n:
            if room not in bins:
                bisect.insort(rooms, room)
                bins[room] = []
            bins[room].append((n, items))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                q = capacity // s
                add(capacity - q * s, n // q, [(s, q)])
                if n % q:
                    add(capacity - (n % q) * s, 1, [(s, n % q)])
                n = 0
                continue
            room = rooms[at]
            m, items = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            q = room // s  # best fit stays with a bin as long as it has room
            full = min(m, n // q)
            add(room - q * s, full, [*items, (s, q)])
            n -= full * q
            m -= full
            if m and n:
                add(room - n * s, 1, [*items, (s, n)])
                m, n = m - 1, 0
            add(room, m, items)
    return [r for room in rooms for r in bins[room]]


def fullest_bins(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit by bins: the largest item left, and beside it the items whose sum fills the bin best."""
    left = {s: n for s, n in counts.items() if n}
    runs: list[Run] = []
    while left:
        s = max(left)
        left[s] -= 1
        need = _filling({x: n for x, n in left.items() if n}, capacity - s)
        left[s] += 1
        need[s] = need.get(s, 0) + 1
        n = min(left[x] // k for x, k in need.items())
        runs.append((n, list(need.items())))
        left = {x: m for x, k in left.items() if (m := k - n * need.get(x, 0))}
    return runs


def _filling(left: dict[int, int], room: int) -> dict[int, int]:
    """Items with the largest sum that fits the room, large ones first."""
    sums, full = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for x in sorted((x for x in left if x <= room), reverse=True):
        n, k = min(left[x], room // x), 1
        while n and not sums >> room & 1:
            k = min(k, n)
            steps.append((x, k, sums))
            sums |= (sums << (k * x)) & full
            n -= k
            k *= 2
        if sums >> room & 1:
            break
    at, need = sums.bit_length() - 1, {}
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            need[x] = need.get(x, 0) + k
            at -= k * x
    return need


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """The reduction, then best fit; where that takes more bins than the tokens need, the fullest bins if they are fewer."""
    fixed, rest = reduce_dominated(counts, capacity)
    fitted = best_fit(rest, capacity)
    bins = sum(n for n, _ in fitted)
    if bins > -(-sum(s * n for s, n in rest.items()) // capacity):
        other = fullest_bins(rest, capacity)
        if sum(n for n, _ in other) < bins:
            fitted = other
    return fixed + fitted


def items_of(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """container, capacity, doc_id, part, size: documents as items of each container kind; the parts of a document
    that is larger than a container fill containers, but for the last."""
    kinds = [(r[0], r[1]) for r in containers.where("capacity_tokens > 0").select("container", "capacity_tokens").distinct().collect()]  # a fixed, small table
    each = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(int(c)).cast("bigint").alias("capacity")) for k, c in kinds])
    x = sizes.where("tokens > 0").select("doc_id", "tokens", F.explode(each.cast("array<struct<container: string, capacity: bigint>>")).alias("k")).select("doc_id", "tokens", "k.*")
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / F.col("capacity"))))
    x = x.select("container", "capacity", "doc_id", "tokens", part.alias("part"))
    return x.select("container", "capacity", "doc_id", "part", F.least("capacity", F.col("tokens") - F.col("part") * F.col("capacity")).alias("size"))


def packed(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """container, doc_id, part, tokens, bin_id: every document (or part of one that is too large) in a bin of each
    container kind. Bins are numbered from 0 in each kind; part counts from 0.

    Defined cases: a document without tokens (null or empty text) takes no room and is in no bin (bin_id null, part
    null); repeated doc_ids are items of their own; equal sizes are ranked by doc_id; a container kind without a
    positive capacity holds nothing; an empty table gives no rows; other columns are not read.
    """
    spark: SparkSession = documents.sparkSession
    sizes = written(sized(documents, ["doc_id"], tokenizer), "sizes")
    items = items_of(sizes, containers)
    counts: dict[tuple[str, int], dict[int, int]] = {}
    # No more rows than the capacities.
    for r in items.groupBy("container", "capacity", "size").count().collect():
        counts.setdefault((r["container"], r["capacity"]), {})[r["size"]] = r["count"]
    places: dict[tuple[str, int], list[tuple[int, int, int, int]]] = {}
    for (kind, capacity), c in counts.items():
        at = 0
        rank: dict[int, int] = {}
        for n, content in plan(c, capacity):
            for s, k in content:
                first = rank.get(s, 0)
                places.setdefault((kind, s), []).append((first, first + n * k, k, at))
                rank[s] = first + n * k
            at += n
    ddl = "container string, size bigint, runs array<struct<first: bigint, upto: bigint, each: bigint, bin: bigint>>"
    table = spark.createDataFrame([(k, s, r) for (k, s), r in places.items()], ddl)
    # Rank of an item within its size: by part of the size, then across the parts.
    items = items.withColumn(BUCKET, F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    keys = ["container", "size"]
    within = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy("doc_id", "part")) - 1
    items = carry(items.withColumn("_in", within), keys, {"_before": (F.count("*"), "sum")})
    items = items.withColumn("rank", F.col("_in") + F.col("_before"))
    got = items.join(F.broadcast(table), keys)  # a row a size: bounded by the capacities
    run = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["upto"]))[0]
    got = got.select("container", "doc_id", "part", F.col("size").alias("tokens"), (run["bin"] + F.floor((F.col("rank") - run["first"]) / run["each"])).alias("bin_id"))
    kinds = [r["container"] for r in containers.select("container").distinct().collect()]  # a fixed, small table
    none = sizes.where("tokens = 0").withColumn("container", F.explode(F.array(*[F.lit(k) for k in kinds]).cast("array<string>")))
    none = none.select("container", "doc_id", F.lit(None).cast("bigint").alias("part"), F.col("tokens"), F.lit(None).cast("bigint").alias("bin_id"))
    return got.unionByName(none)


def report(packed_items: DataFrame, containers: DataFrame) -> DataFrame:
    """container, bins, tokens, least_bins, filled: how well each kind is filled; no packing has fewer than least_bins."""
    kinds = F.broadcast(containers.select("container", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct())
    x = packed_items.where("bin_id IS NOT NULL").groupBy("container").agg((F.max("bin_id") + 1).alias("bins"), F.sum("tokens").alias("tokens")).join(kinds, "container")
    return x.select("container", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"))
