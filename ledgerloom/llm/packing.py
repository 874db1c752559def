"""Problem 7: documents into containers of one fixed capacity, by sum-of-squares packing.

Each document goes where the sum over residual gaps of the squared number of open containers with that
gap becomes smallest. Documents are dealt to shards of bounded size by a hash of their key; a shard is
packed on its own. The rule wants sizes in random order, so documents come shuffled, but the small ones last
and largest first: they fill the gaps that are left, and a shard ends with hardly an open container. Where a
shard is too small or its documents too large for that, all come largest first, whichever takes fewer.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokenize import count_tokens

#: Tokens a container holds, and documents packed together at most on average.
CAPACITY = 4096
SHARD_DOCUMENTS = 50_000
#: Documents below this share of the capacity come last.
SMALL = 1 / 16


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item, in order; every size is from 0 to capacity, and 0 takes no room in container 0.

    Moving a container from gap g to g-s changes the sum of squares by 2(N[g-s] - N[g] + 1), with no N at
    gap 0 and no container before the first; the least change wins, then the smallest remaining gap. Only
    gaps that some open container has are looked at.
    """
    counts = np.zeros(capacity + 1, np.int64)  # open containers by residual gap; 0 and capacity do not count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []  # the gaps that occur, ascending
    placed, opened = [], 0
    for s in sizes:
        if s == 0:
            placed.append(0)
            continue
        gap, least = capacity, 2 * int(counts[capacity - s]) + 1 if s < capacity else 0
        fitting = np.array(gaps[bisect_left(gaps, s) :], np.int64)
        if len(fitting):
            change = 2 * (counts[fitting - s] - counts[fitting] + 1)
            if fitting[0] == s:
                change[0] = 1 - 2 * counts[s]  # a full container counts nowhere
            k = int(np.argmin(change))
            if change[k] <= least:
                gap = int(fitting[k])
        if gap == capacity:
            box, opened = opened, opened + 1
        else:
            box = stacks[gap].pop()
            counts[gap] -= 1
            if not counts[gap]:
                del gaps[bisect_left(gaps, gap)]
        left = gap - s
        if 0 < left < capacity:
            if not counts[left]:
                insort(gaps, left)
            counts[left] += 1
            stacks[left].append(box)
        placed.append(box)
    return placed


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """(doc_id, piece INT, n_tokens INT, container STRING): the container of every document or piece.

    A document is split only if it alone exceeds the capacity: into full pieces 0, 1, ... of exactly the
    capacity, each a container of its own, and a last piece that is packed like any other. Null and empty
    texts have 0 tokens and share a container. Repeated rows are packed each. The number of shards follows
    the number of documents (a count of the table's footers, while the plan is built), so a shard's work does
    not grow with the table; rows of one doc_id are dealt by where they are stored, so they may be any number.
    """
    counted = count_tokens(documents, vocabulary)
    shards = max(1, -(-documents.count() // shard_documents))
    sized = counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(shards)).cast("int"))
    # Three times as many partitions as shards, so that few tasks hold two of them.
    sized = sized.repartition(3 * shards, "shard")

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        n = rows.column("n_tokens").to_numpy().astype(np.int64)
        full = np.maximum(n - 1, 0) // capacity
        rest = n - full * capacity
        named = rows.append_column("place", pa.array(np.arange(len(n))))
        order = named.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending"), ("place", "ascending")]).column("place").to_numpy()
        largest_first = order[np.argsort(-rest[order], kind="stable")]
        small = rest[largest_first] < capacity * SMALL
        shuffled = np.concatenate([np.random.default_rng(shard).permutation(largest_first[~small]), largest_first[small]])
        tried = [(pack(rest[o].tolist(), capacity), o) for o in (shuffled, largest_first)]
        boxes, order = min(tried, key=lambda t: max(t[0], default=0))
        full, rest = full[order], rest[order]
        whole = int(full.sum())
        # The last pieces, then the full ones of split documents, each a container of its own.
        take = np.concatenate([order, np.repeat(order, full)])
        piece = np.concatenate([full, np.arange(whole) - np.repeat(np.cumsum(full) - full, full)])
        size = np.concatenate([rest, np.full(whole, capacity)])
        names = [f"{shard}-{b}" for b in boxes] + [f"{shard}-full-{k}" for k in range(whole)]
        return pa.table({"doc_id": rows.column("doc_id").take(pa.array(take)), "piece": pa.array(piece, pa.int32()), "n_tokens": pa.array(size, pa.int32()), "container": pa.array(names, pa.string())})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return sized.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece int, n_tokens int, container string")


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of the containers' room that is filled."""
    by = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    total = F.sum("used")
    return by.agg(F.count(F.lit(1)).alias("containers"), total.alias("tokens"), (total / (F.count(F.lit(1)) * capacity)).alias("filled"), F.max("used").alias("fullest"))
