"""Filling containers of fixed capacity with texts (problem 8).

Karmarkar-Karp multiway differencing: the items of a window begin as partial partitions of their own; the two with the
largest imbalance are merged again and again, the large parts of one on the small parts of the other, until one
near-equal partition into as many containers as the items need at least is left. Where a container still exceeds
the capacity, it is differenced anew together with one that has room (an exact subset sum fills one of them best), and only
if that doesn't help, the number of containers rises by one - at most to what filling one container after the other takes, each best
around the largest item left, or best fit if that takes fewer. At last the roomiest container fills the others, so that room gathers in few.

Items are spread over windows of about ``WINDOW`` by a hash of what they are, so windows are packed in parallel, only sizes
travel, and the containers don't depend on how the table is partitioned or in which order its rows come. As room gathers
in few containers of a window, the items of those that are filled less than ``CLOSED`` are packed once more, many windows
together. A text beyond the capacity, and no other, is cut into full containers and a rest that is packed with the other items.

Defined results
* Null and empty texts have no tokens and are in no container. Rows with equal doc_id are items of their own; rows
  that are equal altogether are told apart by a number, so which of them is which doesn't matter.
* Containers list doc_ids in ascending order, with the first token and the number of tokens of each item.
* A container is named after its least item: doc_id, first token, digest of the text, number among equal rows.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.runtime import cut, map_batches, table

CAPACITY, WINDOW, CLOSED = 2048, 256, 0.985
#: Ranks of a byte-level BPE, one base64 token and its rank a line, at the same path on every executor.
TOKENIZER = os.environ.get("TRACEMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how that tokenizer cuts texts into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Part the items, given by their sizes, into ``k`` near-equal sets of their indexes."""
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        heap.append((-s, i, sums, [[i]] + [[] for _ in range(k - 1)]))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sets = [own[i] + other[k - 1 - i] for i in order]
        made += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made, sums - sums[-1], sets))
    return heap[0][3] if heap else []


def fullest(sizes: list[int], capacity: int) -> list[int]:
    """Indexes of the items whose sum is the largest within the capacity: the sums that can be reached are the bits of a number."""
    reach, mask = [1], (1 << capacity + 1) - 1
    for s in sizes:
        reach.append((reach[-1] | reach[-1] << s) & mask)
    left, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> left & 1:
            chosen.append(i)
            left -= sizes[i]
    return chosen


def one_by_one(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets filled one after the other, each best around the largest item left."""
    left, out = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), []
    while left:
        rest = left[1:]
        out.append([left[0], *(rest[x] for x in fullest([sizes[i] for i in rest], capacity - sizes[left[0]]))])
        taken = set(out[-1])
        left = [i for i in rest if i not in taken]
    return out


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets made by putting each item, the largest first, where it leaves the least room."""
    sets: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, set), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        room, x = rooms.pop(at) if at < len(rooms) else (capacity, len(sets))
        if x == len(sets):
            sets.append([])
        sets[x].append(i)
        bisect.insort(rooms, (room - sizes[i], x))
    return sets


class _Sets:
    """Sets of items with their sums, some of which may exceed the capacity."""

    def __init__(self, sets: list[list[int]], sizes: list[int], capacity: int):
        self.sets, self.sizes, self.capacity = sets, sizes, capacity
        self.sums = [sum(sizes[i] for i in s) for s in sets]

    def again(self, full: int, rest: int) -> bool:
        """Difference two sets anew: one is filled best from the items of both, the other keeps the rest; False if that exceeds the capacity.

        Large items come first, so of equal sums the one of larger items is taken.
        """
        if self.sums[full] + self.sums[rest] > 2 * self.capacity:
            return False
        pool = sorted(self.sets[full] + self.sets[rest], key=lambda i: (self.sizes[i], i))
        chosen = {pool[x] for x in fullest([self.sizes[i] for i in pool], self.capacity)}
        parts = [i for i in pool if i in chosen], [i for i in pool if i not in chosen]
        sums = [sum(self.sizes[i] for i in part) for part in parts]
        if sums[1] > self.capacity:
            return False
        self.sets[full], self.sets[rest] = parts
        self.sums[full], self.sums[rest] = sums
        return True

    def settle(self) -> bool:
        """Bring every set within the capacity, each that exceeds it together with one that has room.

        Where that fails, the roomiest set gives what fills another best, so that room gathers in it, and it is tried again.
        """
        tight: set[int] = set()
        while True:
            order = sorted(range(len(self.sets)), key=lambda x: (self.sums[x], x))
            over = order[-1]
            if self.sums[over] <= self.capacity:
                return True
            if any(self.again(over, x) for x in order[:-1]):
                tight.add(over)
                continue
            taker = next((x for x in order[1:] if self.sums[x] < self.capacity and x not in tight), None)
            if taker is None:
                return False
            self.again(taker, order[0])
            tight.add(taker)

    def gather(self) -> list[list[int]]:
        """Let the roomiest set fill all others best, so that room gathers in few sets and some become empty."""
        giver = min(range(len(self.sets)), key=lambda x: (self.sums[x], x))
        for taker in sorted(range(len(self.sets)), key=lambda x: (-self.sums[x], x)):
            if taker != giver and self.sums[taker] < self.capacity:
                self.again(taker, giver)
                if not self.sets[giver]:
                    giver = min((x for x in range(len(self.sets)) if self.sets[x]), key=lambda x: (self.sums[x], x))
        return [s for s in self.sets if s]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sets of indexes, each within the capacity; no size may exceed it."""
    most = min(one_by_one(sizes, capacity), best_fit(sizes, capacity), key=len)
    for k in range(-(-sum(sizes) // capacity), len(most)):
        state = _Sets(difference(sizes, k), sizes, capacity)
        if state.settle():
            return state.gather()
    return _Sets(most, sizes, capacity).gather() if most else []


#: What tells items apart, in the order in which containers list them.
ITEM = ("doc_id", "first_token", "digest", "n")


def items_of(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, first_token, digest, n, tokens): the items; ``n`` numbers those that are equal altogether, by their count."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows = encoder(tokenizer).encode_ordinary, []
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(encode(t)) if t else 0
            if n:
                digest = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
                rows += [(d, a, digest, min(capacity, n - a)) for a in range(0, n, capacity)]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=["doc_id", "first_token", "digest", "tokens"])

    items = map_batches(documents.select("doc_id", "text").where("text <> ''"), count, "doc_id long, first_token int, digest long, tokens int")
    counted = items.groupBy("doc_id", "first_token", "digest", "tokens").agg(F.count("*").alias("copies"))
    return counted.select("doc_id", "first_token", "digest", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n"), "tokens")


def containers(documents: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, doc_ids, first_tokens, item_tokens, tokens, fill), one row per container."""
    windows = max(1, -(-documents.count() // window))
    items = items_of(documents, capacity, tokenizer).withColumn("window", F.pmod(F.xxhash64(*ITEM), F.lit(windows)))
    lists = {"doc_ids": "doc_id", "first_tokens": "first_token", "digests": "digest", "ns": "n", "item_tokens": "tokens"}
    names = [*lists]
    shape = "doc_ids array<long>, first_tokens array<int>, digests array<long>, ns array<int>, item_tokens array<int>"

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*ITEM])
        columns = [frame[c].tolist() for c in lists.values()]
        columns[0] = [None if pd.isna(d) else int(d) for d in columns[0]]
        sizes = columns[-1]
        loose = [i for i, t in enumerate(sizes) if t < capacity]
        sets = [[i] for i, t in enumerate(sizes) if t >= capacity] + [sorted(loose[x] for x in s) for s in pack([sizes[i] for i in loose], capacity)]
        return pd.DataFrame([tuple([c[x] for x in s] for c in columns) for s in sets], columns=names)

    total = F.aggregate("item_tokens", F.lit(0), lambda a, x: a + x)
    # the packing is work that the few bytes of sizes don't show, so the number of tasks is given
    tasks = max(1, min(windows, max(documents.sparkSession.sparkContext.defaultParallelism, windows // 16)))
    first = cut(items.repartition(tasks, "window").groupBy("window").applyInPandas(fill, shape).withColumn("tokens", total))
    roomy = F.col("tokens") < CLOSED * capacity
    again = max(1, -(-(first.where(roomy).select(F.sum(F.size("doc_ids"))).first()[0] or 0) // window))
    loose = first.where(roomy).select(F.inline(F.arrays_zip(*(F.col(c).alias(one) for c, one in lists.items()))))
    second = loose.withColumn("window", F.pmod(F.xxhash64(*ITEM), F.lit(again))).groupBy("window").applyInPandas(fill, shape).withColumn("tokens", total)
    packed = first.where(~roomy).unionByName(second)
    least = F.concat_ws("-", F.coalesce(F.get("doc_ids", F.lit(0)).cast("string"), F.lit("null")), F.get("first_tokens", F.lit(0)), F.hex(F.get("digests", F.lit(0))), F.get("ns", F.lit(0)))
    return packed.select(least.alias("container"), "doc_ids", "first_tokens", "item_tokens", "tokens", F.round(F.col("tokens") / capacity, 6).alias("fill"))


def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    return containers(table(spark, base, "documents"))
