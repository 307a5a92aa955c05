"""Problem 7: filling containers of fixed capacity with documents.

Method: exact-complement hashing.  A packing depends on sizes alone, so it is planned on the histogram of
sizes, which has at most as many rows as the capacity, however many documents there are.  A container is begun
with the largest size that fits; as soon as one, two or three available sizes add up exactly to the gap that
is left, they close it, under the counts that are available; where no complement exists the largest size that
fits is added (best fit), and a container is closed short only when nothing fits.  A pattern of sizes is used
as often as its counts allow, so each pattern uses up a size.

Documents get their place by rank: within a size they are numbered, and each pattern owns ranges of these
numbers.  The numbering is done in buckets with prefix sums, so a size that a third of all documents have is
numbered by many tasks.

Defined cases: an item larger than the capacity is cut into full pieces, a container each, and a rest that is
packed like any other item; no other item is split.  Items without tokens (null and empty texts) fill no
place: they are laid into the containers in turn, and into a container of their own (number 0) if there are
no others.  Capacities that are null or below 1 give no containers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, rows_by_batch
from .p6_encoding_ids import TOKENIZERS_DIR, token_counts

#: Documents of one size that one task numbers.
BUCKET_ROWS = 200_000


class _Stock:
    """Available sizes: counts, and the lookups for sums of one, two and three of them."""

    def __init__(self, counts: np.ndarray) -> None:
        self.count = counts.copy()
        self.has = counts > 0
        self.sizes = np.flatnonzero(self.has)

    def take(self, sizes: list[int], times: int) -> None:
        for s in sizes:
            self.count[s] -= times
        for s in set(sizes):
            if self.count[s] == 0:
                self.has[s] = False
                self.sizes = self.sizes[self.sizes != s]

    def largest(self, most: int, used: dict[int, int]) -> int:
        """The largest size up to ``most`` that is still there beyond what the pattern uses; 0 if none."""
        k = int(np.searchsorted(self.sizes, most, side="right"))
        while k:
            s = int(self.sizes[k - 1])
            if self.count[s] > used.get(s, 0):
                return s
            k -= 1
        return 0

    def pair(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """Two available sizes that add up to ``gap``, as unequal as can be."""
        a = self.sizes[: np.searchsorted(self.sizes, gap // 2, side="right")]
        for s in a[self.has[gap - a]]:
            s, o = int(s), gap - int(s)
            need = 1 + (s == o)
            if self.count[s] - used.get(s, 0) >= need and self.count[o] - used.get(o, 0) >= 1:
                return [o, s]
        return None

    def complement(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """At most three available sizes that fill ``gap`` exactly."""
        if gap < len(self.has) and self.has[gap] and self.count[gap] > used.get(gap, 0):
            return [gap]
        if (two := self.pair(gap, used)) is not None:
            return two
        firsts = self.sizes[: np.searchsorted(self.sizes, gap - 2, side="right")][::-1]
        for s in firsts:
            s = int(s)
            if 3 * s < gap:
                break  # the largest of three is at least a third
            if self.count[s] <= used.get(s, 0):
                continue
            if (two := self.pair(gap - s, used | {s: used.get(s, 0) + 1})) is not None:
                return [s, *two]
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, sizes) of the patterns that pack ``counts`` (size -> number of items, sizes up to the capacity)."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in counts.items():
        have[s] = n
    have[0] = 0
    stock, patterns = _Stock(have), []
    while len(stock.sizes):
        pattern: list[int] = []
        used: dict[int, int] = {}
        gap = capacity
        while gap:
            closing = stock.complement(gap, used) if pattern or stock.largest(gap, used) == gap else None
            if closing is None:
                s = stock.largest(gap, used)
                if not s:
                    break
                closing = [s]
            for s in closing:
                used[s] = used.get(s, 0) + 1
            pattern += closing
            gap = capacity - sum(pattern)
        times = min(int(stock.count[s]) // n for s, n in used.items())
        stock.take(pattern, times)
        patterns.append((times, pattern))
    return patterns


def places(patterns: list[tuple[int, list[int]]], first: int) -> dict[int, tuple[list[int], list[int]]]:
    """For each size the ranks at which a pattern's range begins and the container of its first item."""
    table: dict[int, tuple[list[int], list[int]]] = {}
    at: dict[int, int] = {}
    container = first
    for times, sizes in patterns:
        for s in sizes:
            begins, containers = table.setdefault(s, ([], []))
            begins.append(at.get(s, 0))
            containers.append(container)
            at[s] = at.get(s, 0) + times
        container += times
    return table


def _numbered(items: DataFrame, buckets: int) -> DataFrame:
    """``items`` with ``rank``: 0, 1, ... within their size, numbered in buckets put together by prefix sums."""
    held = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)))
    inside = held.withColumn("inside", F.row_number().over(W.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no")) - 1)
    sums = held.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(F.col("n_tokens").alias("of_size"), F.col("bucket").alias("of_bucket"), before.alias("base"))
    joined = inside.join(base, (F.col("n_tokens") == F.col("of_size")) & (F.col("bucket") == F.col("of_bucket")))
    return joined.select("doc_id", "piece_no", "start_token", "n_tokens", (F.col("base") + F.col("inside")).alias("rank"))


PLACED = "capacity_name string, capacity_tokens int, container_id bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"


def _packed(sizes: DataFrame, name: str, capacity: int) -> DataFrame:
    """Placement of every item for one capacity; ``sizes`` has doc_id and n_tokens."""
    full = F.floor(F.col("n_tokens") / capacity).cast("bigint")
    rest = F.col("n_tokens") % capacity
    last = F.when((rest == 0) & (full > 0), full - 1).otherwise(full)
    pieces = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    start = F.col("piece_no") * capacity
    items = pieces.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), start.alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - start).alias("n_tokens"))
    histogram = {r["n_tokens"]: r["count"] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    patterns = plan({int(s): int(n) for s, n in histogram.items()}, capacity)
    containers = sum(n for n, _ in patterns)
    table = places(patterns, 1)
    shared = sizes.sparkSession.sparkContext.broadcast(table)  # a few ranges for each size up to the capacity
    buckets = max(1, min(4096, max(histogram.values(), default=0) // BUCKET_ROWS + 1))

    def place(ids: list, numbers: list, starts: list, lengths: list, ranks: list) -> Iterator[tuple]:
        known = shared.value
        for i, k, s, n, rank in zip(ids, numbers, starts, lengths, ranks):
            if n:
                begins, first = known[n]
                j = bisect_right(begins, rank) - 1
                where = first[j] + rank - begins[j]
            else:
                where = rank % containers + 1 if containers else 0
            yield name, capacity, where, i, k, s, n

    return rows_by_batch(_numbered(items, buckets), PLACED, place)


def packing(documents: DataFrame, capacities: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS_DIR) -> DataFrame:
    """Which document, or piece of one, lies in which container of which capacity.

    ``capacities`` is configuration: a row for each capacity, read by the driver.
    """
    wanted = [(r["capacity_name"], r["tokenizer_name"], int(r["capacity_tokens"])) for r in capacities.where("capacity_tokens >= 1 and tokenizer_name is not null").orderBy("capacity_name").collect()]
    sizes = {t: cut(token_counts(documents, id_col, text_col, t, folder)) for t in dict.fromkeys(t for _, t, _ in wanted)}
    parts = [_packed(sizes[t], name, c) for name, t, c in wanted]
    if not parts:
        return documents.sparkSession.createDataFrame([], PLACED)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def waste(packed: DataFrame) -> DataFrame:
    """Containers, tokens, the fewest containers these tokens could fill, and the share of unused space, for each capacity."""
    tokens, containers = F.sum("n_tokens"), F.count_distinct("container_id")
    held = packed.where("n_tokens > 0").groupBy("capacity_name", "capacity_tokens")
    return held.agg(containers.alias("containers"), tokens.alias("tokens"), F.ceil(tokens / F.first("capacity_tokens")).alias("fewest"), F.round(1 - tokens / (containers * F.first("capacity_tokens")), 6).alias("unused"))
