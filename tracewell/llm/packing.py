"""Filling windows of fixed capacity with whole documents.

The plan is made on the histogram of lengths (at most ``capacity`` entries, whatever the corpus): repeat counts of
patterns of few documents are fitted to the binned histogram by non-negative least squares and rounded down; what
the rounding leaves over, and the many short documents, go best-fit into the smallest room that holds them. Documents
are then matched to the planned slots by their rank within their length.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the length histogram in the least-squares fit, and documents per pattern at most.
BINS, PATTERN_DOCS = 64, 4
#: Rows ranked together in one task.
RANK_ROWS = 50_000


def patterns(bins: int, docs: int) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``docs`` bin numbers 1..bins that sum to ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, top: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < docs:
            for b in range(min(left, top), 0, -1):
                if b * (docs - len(head)) < left:
                    break
                grow((*head, b), left - b, b)

    grow((), bins, bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients."""
    gram, at_b = a.T @ a, a.T @ b
    step = 1.0 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    x = np.zeros(a.shape[1])
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (gram @ y - at_b), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (copies by length, number of such windows) that hold every item of the histogram, lengths 1..capacity."""
    left = Counter({n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0})
    plan: list[tuple[dict[int, int], int]] = [({capacity: 1}, left.pop(capacity))] if left.get(capacity) else []
    by_bin: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        by_bin[-(-n * BINS // capacity)].append(n)
    pats = patterns(BINS, PATTERN_DOCS)
    counts = np.array([sum(left[n] for n in by_bin[b]) for b in range(1, BINS + 1)], float)
    fit = np.zeros((BINS, len(pats)))
    for p, pat in enumerate(pats):
        for b in pat:
            fit[b - 1, p] += 1
    # a bin whose documents outnumber the rest counts little in the fit: short documents fill gaps later anyway
    weight = np.linspace(0.1, 1.0, BINS)
    repeats = np.floor(nnls(fit * weight[:, None], counts * weight) + 1e-6).astype(int)
    rooms: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    for p in sorted(range(len(pats)), key=lambda p: (len(pats[p]), p)):
        need = Counter(pats[p])
        todo = min([int(repeats[p]), *(sum(left[n] for n in by_bin[b]) // k for b, k in need.items())])
        while todo > 0:
            # one composition of real lengths for as many windows as its scarcest length allows
            take: Counter = Counter()
            for b, k in need.items():
                for _ in range(k):
                    n = max((n for n in by_bin[b] if left[n] > take[n]), key=lambda n: (left[n] // (take[n] + 1), n))
                    take[n] += 1
            times = max(1, min([todo, *(left[n] // k for n, k in take.items())]))
            for n, k in take.items():
                left[n] -= k * times
            rooms[capacity - sum(n * k for n, k in take.items())].append((take, times))
            todo -= times
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        c = left[n]
        while c > 0:
            room = min((r for r in rooms if r >= n and rooms[r]), default=None)
            if room is None:
                each = capacity // n
                full, rest = divmod(c, each)
                if full:
                    rooms[capacity - each * n].append((Counter({n: each}), full))
                if rest:
                    rooms[capacity - rest * n].append((Counter({n: rest}), 1))
                break
            take, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = min(room // n, c)
            used = min(times, c // each)
            rooms[room - each * n].append((take + Counter({n: each}), used))
            if times > used:
                rooms[room].append((take, times - used))
            c -= each * used
    return plan + [(dict(take), times) for same in rooms.values() for take, times in same]


def _items(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, n): a document is split only if larger than the capacity, into full parts and the rest."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(capacity))).cast("int")
    rows = sized.select("doc_id", "n_tokens", F.posexplode(F.array_repeat(F.lit(0), parts)).alias("part", "_z"))
    return rows.select("doc_id", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * F.lit(capacity)).cast("long").alias("n"))


def pack(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, n_tokens, window_id): every document of ``sized`` (doc_id, n_tokens) placed in a window.

    Sums per window never exceed the capacity. Documents without tokens take no room and lie in window 0. Null
    counts are taken as 0; a capacity below 1 is an error; an empty input gives no row. Equal documents are placed
    each for itself.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    spark = sized.sparkSession
    items = _items(sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")), capacity)
    salts = F.lit(1) + F.floor(F.col("c") / RANK_ROWS)
    sizes = items.groupBy("n").agg(F.count("*").alias("c"))
    histogram = {r["n"]: r["c"] for r in sizes.collect()}  # at most capacity + 1 rows
    slots, window, used = [], 0, Counter()
    for take, times in plan_windows(histogram, capacity):
        for n, k in take.items():
            slots.append((n, used[n], used[n] + k * times, k, window))
            used[n] += k * times
        window += times
    if histogram.get(0):
        slots.append((0, 0, histogram[0], histogram[0], 0))
    plan = spark.createDataFrame(slots, "n long, lo long, hi long, per long, base long")
    salted = items.join(F.broadcast(spark.createDataFrame([(n, c) for n, c in histogram.items()], "n long, c long")), "n")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), salts))
    offset = salted.groupBy("n", "salt").agg(F.count("*").alias("m"))
    offset = offset.withColumn("before", F.sum("m").over(Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("n", "salt").orderBy("doc_id", "part")) - 1
    ranked = salted.withColumn("r", rank).join(offset.select("n", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["n", "salt"]).select("doc_id", "part", "n", (F.col("r") + F.col("before")).alias("rank"))
    # slots and documents of a length are put in one order, in blocks of ranks, and each document takes the last slot before it
    block = lambda c: F.floor(c / F.lit(RANK_ROWS))
    slot = plan.select("n", F.col("lo"), F.struct("lo", "per", "base").alias("slot"), F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))).alias("block"))
    slot = slot.select("n", "block", F.greatest("lo", F.col("block") * RANK_ROWS).alias("rank"), F.lit(0).alias("kind"), F.lit(None).cast(sized.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("int").alias("part"), "slot")
    docs = ranked.select("n", block(F.col("rank")).alias("block"), F.col("rank").cast("long").alias("rank"), F.lit(1).alias("kind"), "doc_id", "part", F.lit(None).cast(slot.schema["slot"].dataType).alias("slot"))
    before = Window.partitionBy("n", "block").orderBy("rank", "kind").rowsBetween(Window.unboundedPreceding, 0)
    place = slot.unionByName(docs).withColumn("slot", F.last("slot", True).over(before)).filter("kind = 1")
    return place.select("doc_id", "part", F.col("n").alias("n_tokens"), (F.col("slot.base") + F.floor((F.col("rank") - F.col("slot.lo")) / F.col("slot.per"))).cast("long").alias("window_id"))
