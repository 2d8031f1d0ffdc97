"""Best-fit-decreasing packing of token sequences into windows of fixed length.

Best fit decreasing looks at lengths only, so the whole corpus is packed from
its histogram of piece lengths, which has as many bins as a window has tokens
whatever the corpus's size:

1. Tasks tokenise whole texts and cut them: full windows first, then the rest.
   A piece leaves its task as a short row, never as its ids.
2. The histogram goes to the driver.  Lengths are taken in decreasing order; a
   segment tree indexed by remaining capacity finds the tightest open window.
   Pieces of one length and windows in one state are handled as runs, so the
   result is a bounded list of runs: pieces ranked a to b of length n go, m to a
   window, into windows s onwards at offset o.
3. Each piece is ranked among those of its length (counts of hash buckets plus
   the rank inside one) and looks its run up.

Rows that stand in an order that must survive, such as a mixture's, are packed
group by group (``packed_in_order``): each ``GROUP_DOCS`` consecutive documents
have windows of their own, numbered in a seeded shuffle after those of the group
before.  So windows hold the rows' order to within one group.

Cases: null text is an empty one, which is just its end token; equal ids are
separate documents with separate pieces; pieces of one length are ordered by a
hash of id, start and ids, so that a task that is run again ranks them as before
(pieces alike in all of these are interchangeable); an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.llm.common import byte_sized, narrow, sparing
from lingoscope.llm.sharding import buckets_for, ranked_in_source
from lingoscope.llm.tokens import TOGETHER, bpe
from lingoscope.operators.storage import stored

WINDOW = 4096
END_ID = 2
GROUP_DOCS = 4096  # consecutive documents that are packed together where their order counts


class CapacityTree:
    """How many windows are open at each remaining capacity; finds the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << (window).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs = [deque() for _ in range(window + 1)]

    def add(self, capacity: int, first: int, n: int) -> None:
        self.runs[capacity].append((first, n))
        self._change(capacity, n)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """A run (first window, windows) of at most ``most`` windows with this capacity."""
        first, n = self.runs[capacity].popleft()
        if n > most:
            self.runs[capacity].appendleft((first + most, n - most))
            n = most
        self._change(capacity, -n)
        return first, n

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open window has."""
        node = least + self.leaves
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces in a window, first window, offset) and the number of windows.

    Just what best fit decreasing gives for pieces one by one: a window that has
    taken a piece and could take another is the tightest, so it is filled up first.
    """
    tree, runs, windows = CapacityTree(window), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            fresh = capacity is None
            capacity = window if fresh else capacity
            each = capacity // length
            full = left // each
            if full:
                if fresh:
                    first, n = windows, full
                    windows += n
                else:
                    first, n = tree.take(capacity, full)
                placed, rest = n * each, capacity - each * length
            else:
                if fresh:
                    first, n = windows, 1
                    windows += 1
                else:
                    first, n = tree.take(capacity, 1)
                placed, rest = left, capacity - left * length
            runs.append((length, rank, each, first, window - capacity))
            if rest:
                tree.add(rest, first, n)
            rank += placed
            left -= placed
    return runs, windows


def runs_table(histogram: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """The runs of best fit decreasing as rows of numbers, by length and rank; and the number of windows."""
    runs, windows = best_fit_decreasing(histogram, window)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), windows


def placed(length: np.ndarray, rank: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of pieces from their ranks among those of their length."""
    run = np.zeros(len(length), np.int64)
    for n in np.unique(length):
        low, high = np.searchsorted(runs[:, 0], [n, n + 1])
        here = length == n
        run[here] = low + np.searchsorted(runs[low:high, 1], rank[here], "right") - 1
    _, first_rank, each, first, offset = runs[run].T
    k = rank - first_rank
    return first + k // each, offset + (k % each) * length


def pieces_of(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = (), spare: bool = False) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens) and what ``also`` names (numbers): every text's ids and end token, cut.

    ``spare``: a worker keeps no tokenizer between its tasks, which costs time and saves memory.
    """

    @sparing
    def cut(batches):
        tokenizer = bpe(path)
        for batch in batches:
            rows = ([], [], [], [], [])
            at = 0
            for first, n in byte_sized(batch.column("text"), TOGETHER):
                for ids in tokenizer.ids(batch.column("text").slice(first, n)):
                    full = np.empty(len(ids) + 1, "<u4")
                    full[:-1] = ids
                    full[-1] = END_ID
                    for start in range(0, len(full), window):
                        piece = full[start : start + window]
                        for held, x in zip(rows, (at, start, len(piece), zlib.crc32(piece), len(full))):
                            held.append(x)
                    at += 1
            of = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(of), *(pa.array(r, pa.int64()) for r in rows[1:]), *(batch.column(c).take(of) for c in also)],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", *also],
            )
        if spare:
            del tokenizer
            bpe.cache_clear()

    rows = narrow(docs, id=id_col, text=text_col, **{c: c for c in also})
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + "".join(f", {c} long" for c in also))


def packed(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", seed: int = 29) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    pieces = stored(pieces_of(docs, path, window, id_col, text_col))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    table, _ = runs_table(histogram, window)
    ranked = ranked_in_source(pieces.withColumn("source", F.col("length")), seed, buckets_for(sum(histogram.values())), ("start", "ids_crc32", "doc_tokens"))
    ranked = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    held = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches):
        for batch in batches:
            sequence, offset = placed(batch["length"].to_numpy(), batch["rank"].to_numpy(), held.value)
            yield pd.DataFrame(batch.drop(columns=["rank"])).assign(sequence_id=sequence, offset=offset)

    kind = ranked.schema["id"].dataType.simpleString()
    out = ranked.mapInPandas(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def packed_in_order(docs: DataFrame, path: str, position_col: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", seed: int = 29, group_docs: int = GROUP_DOCS) -> DataFrame:
    """What ``packed`` gives, for rows whose order (``position_col``: 0, 1, ...) the windows' numbers keep, group by group.

    A task holds one group's pieces at a time, as short rows.
    """
    grouped = docs.withColumn("group", F.expr(f"`{position_col}` div {group_docs}")).withColumn("position", F.col(position_col))
    pieces = stored(pieces_of(grouped, path, window, id_col, text_col, also=("group", "position"), spare=True))
    kind = pieces.schema["id"].dataType.simpleString()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["position", "start"], kind="stable", ignore_index=True)
        length = rows["length"].to_numpy()
        runs, windows = runs_table(rows["length"].value_counts().to_dict(), window)
        order = np.random.default_rng([seed, int(rows["group"].iloc[0])])
        # ranks among equal lengths are dealt at random, and so are the numbers of the windows
        shuffled = order.permutation(len(rows))
        rank = np.empty(len(rows), np.int64)
        rank[shuffled] = rows["length"].iloc[shuffled].groupby(rows["length"].iloc[shuffled]).cumcount().to_numpy()
        sequence, offset = placed(length, rank, runs)
        return rows.drop(columns=["position"]).assign(sequence_id=order.permutation(windows)[sequence], offset=offset, windows=windows)

    out = stored(pieces.groupBy("group").applyInPandas(pack, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, group long, sequence_id long, offset long, windows long"))
    # a row for each group
    counts = out.groupBy("group").agg(F.first("windows").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = out.join(starts, "group").withColumn("sequence_id", F.col("sequence_id") + F.col("before"))
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
