"""Fixed-capacity containers filled by multiway differencing.

Items are dealt by a hash of their key into bins of about ``BIN_TOKENS`` tokens, so that
each task packs a bounded number of items. Within a bin the Karmarkar-Karp differencing
method partitions the items into k windows: the two partial partitions with the largest
imbalance are merged, the fullest windows of one with the emptiest of the other, until
one is left. k starts at the least number of windows that could hold the bin and rises
while a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import checkpoint

#: Tokens that a bin holds on average.
BIN_TOKENS = 1 << 20


def difference(sizes: np.ndarray, k: int) -> list[tuple[int, list[int]]]:
    """Windows ``(sum, members)`` of a k-way differencing partition; empty windows are left out.

    A partial partition is the ascending list of its non-empty windows (sum, tie number, tree of members).
    """
    tick = 0
    heap: list[tuple[int, int, list]] = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, [(s, i, i)]))
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        meet = max(0, len(a) + len(b) - k)
        # of b the fullest first: free windows take the fullest, the rest join a's emptiest in opposing order
        low = a[:meet]
        joined = []
        for (s, _, tree), (s2, _, tree2) in zip(low, b[: meet][::-1], strict=True):
            joined.append((s + s2, tick, (tree, tree2)))
            tick += 1
        rest = b[meet:]
        if len(b) <= 8:
            del a[:meet]
            for x in joined + rest:
                insort(a, x, key=lambda w: w[:2])
        else:
            a = sorted(a[meet:] + joined + rest, key=lambda w: w[:2])
        heapq.heappush(heap, (-(a[-1][0] - (a[0][0] if len(a) == k else 0)), tick, a))
        tick += 1
    out = []
    for s, _, tree in heap[0][2] if heap else []:
        members, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                members.append(x)
        out.append((s, sorted(members)))
    return out


def _rising(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The fewest windows found by raising (and halving back) their count until none exceeds the capacity."""
    least = max(1, -(-int(sizes.sum()) // capacity))

    def attempt(k: int):
        windows = difference(sizes, k)
        return windows if windows[-1][0] <= capacity else None

    lo, step, k = least - 1, 1, least
    while (found := attempt(k)) is None:  # len(sizes) windows always do
        lo, k, step = k, min(k + step, len(sizes)), step * 2
    while k - lo > 1:
        mid = (lo + k) // 2
        better = attempt(mid)
        if better is None:
            lo = mid
        else:
            k, found = mid, better
    return [m for _, m in found]


def pack(sizes: np.ndarray, capacity: int, slack: float = 0.02, rounds: int = 40) -> list[list[int]]:
    """Windows whose sums keep within the capacity. No size may exceed it.

    Differencing spreads the free room evenly, so that a tight count of windows rarely
    holds. Each round therefore differences what is left into the least number of
    windows, keeps those that are full up to ``slack`` of the capacity, and takes the
    rest apart again; the last rest gets as many windows as it needs.
    """
    left, out = np.arange(len(sizes)), []
    for _ in range(rounds):
        if not len(left):
            return out
        windows = difference(sizes[left], max(1, -(-int(sizes[left].sum()) // capacity)))
        if windows[-1][0] <= capacity:
            return out + [left[m].tolist() for _, m in windows]
        sealed = [m for s, m in windows if capacity * (1 - slack) <= s <= capacity]
        if not sealed:
            break
        out += [left[m].tolist() for m in sealed]
        left = np.delete(left, np.concatenate(sealed))
    return out + [left[m].tolist() for m in _rising(sizes[left], capacity)] if len(left) else out


def pack_containers(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id", bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """``capacity_id, container_id, <key>, piece_no, first_token, n_tokens``.

    ``sizes``: key, same (hash of the item), n_tokens; equal rows are one item. An item
    larger than the capacity is cut into full pieces, each alone in a container, and a
    rest that is packed like any other item. Items without tokens take no room and lie in
    some container of their bin. Capacities that are null or below 1 hold nothing.
    """
    items = checkpoint(sizes.groupBy(key, "same").agg(F.max("n_tokens").alias("n")))  # sizes are dear: counted once
    total = items.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // bin_tokens))
    spread = items.withColumn("bin", F.pmod(F.xxhash64(key, "same"), F.lit(bins)))
    caps = F.broadcast(capacities.where("capacity_tokens >= 1").select("capacity_id", F.col("capacity_tokens").cast("bigint").alias("cap")).distinct())  # a handful of container sizes, checked below
    if capacities.count() > 1000:
        raise ValueError("more than 1000 container sizes")
    kind = dict(sizes.dtypes)[key]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "same", key], ascending=[False, True, True], kind="stable")
        cap, n = int(pdf["cap"].iloc[0]), pdf["n"].to_numpy(np.int64)
        full = n // cap
        rest = n - full * cap
        at = np.flatnonzero((rest > 0) | (n == 0))
        rows: list[tuple[int, int, int, int, int]] = []
        box = 0
        for window in pack(rest[at], cap):
            rows += [(box, i, int(full[i]), int(full[i]) * cap, int(rest[i])) for i in at[window].tolist()]
            box += 1
        for i in np.flatnonzero(full).tolist():
            for j in range(int(full[i])):
                rows.append((box, i, j, j * cap, cap))
                box += 1
        out = pd.DataFrame(rows, columns=["box", "i", "piece_no", "first_token", "n_tokens"])
        prefix = f"{pdf['capacity_id'].iloc[0]}-{pdf['bin'].iloc[0]}-"
        out[key] = pdf[key].take(out["i"]).to_numpy()
        out["capacity_id"] = pdf["capacity_id"].iloc[0]
        out["container_id"] = prefix + out["box"].astype(str)
        return out[["capacity_id", "container_id", key, "piece_no", "first_token", "n_tokens"]]

    return (
        spread.crossJoin(caps)  # each item once per container size
        .groupBy("capacity_id", "bin")
        .applyInPandas(one, f"capacity_id int, container_id string, {key} {kind}, piece_no int, first_token bigint, n_tokens bigint")
    )


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per container size: containers, tokens, share of the room that is used, largest load."""
    loads = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("load"))
    return (
        loads.groupBy("capacity_id")
        .agg(F.count("*").alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"))
        .join(capacities.select("capacity_id", "capacity_tokens").distinct(), "capacity_id")
        .select("capacity_id", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("used"))
    )
