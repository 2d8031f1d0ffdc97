"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's rows, in a seeded shuffle, are cut into blocks of ``BLOCK_ROWS``.
Block j (from 1) of a source with weight w is released at slot floor((j - 1) / w)
and due by slot ceil(j / w).  Every slot goes to the released block with the
earliest deadline, so after any number of slots each source has had its share to
within less than one block.  When a source has no blocks left the others go on
at the same ratio to each other: all rows are kept, and the slot from which that
holds is the mixture's horizon (``in_mix`` is false from there on).

Blocks keep their size however large the corpus is, and the driver never handles
them one by one.  Weights are multiples of 1 / ``UNITS``: shares of u units of U
in all give a schedule that repeats itself every U slots, until the first source
ends.  So there is one phase for each source, each with one period of at most
``UNITS`` slots; they are worked out on the driver and broadcast, and tasks find a
block's slot from its phase, the number of whole periods before it, and its place
in the period.

With more than ``MANY`` sources there is one schedule without end: its period has
``SHARE`` slots for each source at least, shared out by largest remainders, so that
weights are as exact as with few.  Slots of sources that have ended stay empty, so the
others go on at their ratio; rows are numbered by counts of stretches of slots.
``mix_position`` has no gaps in either case.

Cases: null is a source of its own; sources without a stated weight get none and
come last; a stated source without rows is left out; rows of one id are told
apart by their other columns, and rows alike in all are interchangeable; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoscope.llm.sharding import buckets_for, ranked_in_source

BLOCK_ROWS = 64
UNITS = 1 << 14
MANY = 32
SHARE = 16
STRETCH = 256  # slots whose rows are numbered together


class Phase(NamedTuple):
    """A stretch of slots in which the same sources take part: source -> units, blocks done before, one period's sources."""

    start: int
    units: dict
    done: dict
    period: list


def period_of(units: dict, order: dict) -> list:
    """The source of each slot of one period: earliest deadline first among released blocks."""
    total = sum(units.values())

    def job(s, j):
        return j * total // units[s], -(-(j + 1) * total // units[s])

    waiting = [(*job(s, 0), order[s], s, 0) for s in units]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, at, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, at, s, j))
        _, at, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < units[s]:
            heapq.heappush(waiting, (*job(s, j + 1), at, s, j + 1))
    return out


def phases(blocks: dict, units: dict) -> list[Phase]:
    """The schedule, phase by phase; a phase ends with the last block of a source.

    ``blocks``: how many each source has; sources without units come last, one by one.
    """
    order = {s: i for i, s in enumerate(sorted(blocks, key=lambda s: (s is None, str(s))))}
    done, start, out = dict.fromkeys(blocks, 0), 0, []
    live = {s: units[s] for s in blocks if blocks[s] and units.get(s, 0) > 0}
    rest = [s for s in sorted(blocks, key=order.get) if blocks[s] and s not in live]
    while live or rest:
        if not live:
            live = {rest.pop(0): 1}
        period = period_of(live, order)
        at: dict = {s: [] for s in live}
        for slot, s in enumerate(period):
            at[s].append(slot)
        last = {s: divmod(blocks[s] - done[s] - 1, live[s]) for s in live}
        ends = {s: q * len(period) + at[s][r] for s, (q, r) in last.items()}
        first = min(ends, key=ends.get)
        out.append(Phase(start, live, dict(done), period))
        whole, part = divmod(ends[first] + 1, len(period))
        for s in live:
            done[s] += whole * live[s] + sum(x < part for x in at[s])
        start += ends[first] + 1
        live = {s: u for s, u in live.items() if s != first}
    return out


def pfair(blocks: dict, weights: dict) -> list[tuple]:
    """(slot, source, block, release, deadline, in_mix) for every block, in order of slots.

    ``weights``: exact fractions that add up to 1.  For schedules that fit in memory.
    """
    whole = lcm(*(Fraction(w).denominator for w in weights.values())) if weights else 1
    plan = phases(blocks, {s: int(Fraction(w) * whole) for s, w in weights.items()})
    total, out = sum(blocks.values()), []
    for k, (start, units, done, period) in enumerate(plan):
        done, size = dict(done), len(period)
        for slot in range(start, plan[k + 1].start if k + 1 < len(plan) else total):
            s = period[(slot - start) % size]
            j = done[s] - plan[k].done[s]
            out.append((slot, s, done[s], start + j * size // units[s], start - (-(j + 1) * size // units[s]), k == 0 and bool(weights.get(s))))
            done[s] += 1
    return out


def units_of(weights: dict) -> dict:
    """Weights as whole units, one at least for each."""
    weights = {s: w for s, w in weights.items() if w > 0}
    most, total = UNITS, sum(weights.values())
    if len(weights) > MANY:
        most = max(UNITS, 1 << (SHARE * len(weights) - 1).bit_length())
        share = {s: w / total * most for s, w in weights.items()}
        out = {s: max(1, int(x)) for s, x in share.items()}
        over = sum(out.values()) - most  # at most one unit for each source, either way
        for s in sorted(share, key=lambda s: out[s] - share[s], reverse=over > 0)[: abs(over)]:
            out[s] -= 1 if over > 0 and out[s] > 1 else -1 if over < 0 else 0
        return out
    return {s: max(1, round(w / total * most)) for s, w in weights.items()}


def _ties(docs: DataFrame, named: list[str], id_col: str, source_col: str) -> tuple[str, ...]:
    """Columns that tell rows of one id apart."""
    return tuple(c for c, f in zip(named, docs.schema.fields) if isinstance(f.dataType, T.AtomicType) and f.name not in (id_col, source_col))


def _endless(base: DataFrame, docs: DataFrame, named: list[str], rows_of: dict, units: dict, block_rows: int, seed: int, id_col: str, source_col: str) -> DataFrame:
    """As ``mixed``, by one period of all sources that have a weight."""
    spark = docs.sparkSession
    order = sorted(rows_of, key=lambda s: (s is None, str(s)))
    blocks = {s: -(-n // block_rows) for s, n in rows_of.items()}
    period = period_of(units, {s: i for i, s in enumerate(order)})
    at: dict = {s: [] for s in units}
    for slot, s in enumerate(period):
        at[s].append(slot)
    last = {s: (blocks[s] - 1) // u * len(period) + at[s][(blocks[s] - 1) % u] for s, u in units.items()}
    start, parts = max(last.values()) + 1, []
    for number, s in enumerate(order):  # those without a weight come one after another
        parts.append((s, number, units.get(s), None if s in units else start, last.get(s)))
        start += 0 if s in units else blocks[s]
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    part = spark.createDataFrame(parts, T.StructType([T.StructField("s", docs.schema[source_col].dataType), *long("number", "units", "alone", "ends")]))
    slots = spark.createDataFrame([(number, k, x) for number, s in enumerate(order) if s in units for k, x in enumerate(at[s])], "number2 long, nth long, at long", verifySchema=False)
    ranked = ranked_in_source(base, seed, buckets_for(sum(rows_of.values())), _ties(docs, named, id_col, source_col)).withColumn("block", F.expr(f"rank div {block_rows}"))
    # Spark picks how these meet by their sizes
    here = ranked.join(part, ranked["source"].eqNullSafe(part["s"]))
    here = here.join(slots, (F.col("number") == F.col("number2")) & (F.expr("block % units") == F.col("nth")), "left")
    size = len(period)
    here = here.withColumn("slot", F.coalesce(F.expr(f"(block div units) * {size} + at"), F.expr("alone + block"))).withColumn("stretch", F.expr(f"slot div {STRETCH}"))
    counts = here.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("stretch").orderBy("slot", "rank")) - 1
    return here.withColumn("inside", inside).join(starts, "stretch").select(
        *[F.col(n).alias(c) for n, c in zip(named, docs.columns)],
        F.col("slot").alias("mix_slot"), F.col("block").alias("mix_block"), F.coalesce(F.expr(f"(block * {size}) div units"), "slot").alias("mix_release"),
        F.coalesce(F.expr(f"((block + 1) * {size} + units - 1) div units"), F.col("slot") + 1).alias("mix_deadline"),
        (F.col("units").isNotNull() & (F.col("slot") <= min(last.values()))).alias("in_mix"), (F.col("begin") + F.col("inside")).alias("mix_position"),
    )


def mixed(docs: DataFrame, weights: dict | None = None, temperature: float = 0.7, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", seed: int = 41) -> DataFrame:
    """All columns of ``docs`` and mix_slot, mix_block, mix_release, mix_deadline, in_mix, mix_position.

    ``mix_position`` numbers the rows without gaps in the mixed order.  Without
    stated weights a source's is its rows ** temperature.
    """
    spark = docs.sparkSession
    named = [f"_c{i}" for i in range(len(docs.columns))]
    base = docs.toDF(*named).withColumns({"id": F.col(named[docs.columns.index(id_col)]), "source": F.col(named[docs.columns.index(source_col)])})
    rows_of = {r["source"]: r["n"] for r in base.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each source
    if weights is None:
        weights = {s: n**temperature for s, n in rows_of.items()}
    units = units_of({s: w for s, w in weights.items() if rows_of.get(s)})
    if len(units) > MANY:
        return _endless(base, docs, named, rows_of, units, block_rows, seed, id_col, source_col)
    plan = phases({s: -(-n // block_rows) for s, n in rows_of.items()}, units)
    # rows that the last blocks of the sources that ended before a phase lack
    lacking, short = 0, []
    for k in range(len(plan)):
        short.append(lacking)
        ended = next((s for s in plan[k].units if k + 1 == len(plan) or s not in plan[k + 1].units), None)
        lacking += -rows_of[ended] % block_rows if ended in rows_of else 0
    kind = docs.schema[source_col].dataType
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    number = {s: i for i, s in enumerate(rows_of)}
    parts = [
        (s, number[s], k, p.start, u, len(p.period), short[k], p.done[s], next((q.done[s] for q in plan[k + 1 :]), 1 << 62), k == 0 and bool(weights.get(s)))
        for k, p in enumerate(plan)
        for s, u in p.units.items()
    ]
    part = spark.createDataFrame(parts, T.StructType([T.StructField("s", kind), *long("number", "phase", "p_start", "units", "period", "short", "first", "end"), T.StructField("in_mix", T.BooleanType())]))
    slots = []
    for k, p in enumerate(plan):
        nth = dict.fromkeys(p.units, 0)
        for at, s in enumerate(p.period):
            slots.append((k, number[s], nth[s], at))
            nth[s] += 1
    slot = spark.createDataFrame(slots, "phase2 int, number2 int, nth int, at int", verifySchema=False)
    # sources times buckets is checked; phases and periods are bounded by the number of sources
    buckets = buckets_for(sum(rows_of.values()))
    ties = _ties(docs, named, id_col, source_col)
    ranked = ranked_in_source(base, seed, buckets, ties, len(rows_of) * buckets <= 1 << 18).withColumn("block", F.expr(f"rank div {block_rows}"))
    here = ranked.join(F.broadcast(part), ranked["source"].eqNullSafe(part["s"]) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("end")))
    here = here.withColumn("j", F.col("block") - F.col("first"))
    here = here.join(F.broadcast(slot), (F.col("phase") == F.col("phase2")) & (F.col("number") == F.col("number2")) & (F.expr("j % units") == F.col("nth")))
    at = F.expr("p_start + (j div units) * period + at")
    return here.select(
        *[F.col(n).alias(c) for n, c in zip(named, docs.columns)],
        at.alias("mix_slot"), F.col("block").alias("mix_block"), F.expr("p_start + (j * period) div units").alias("mix_release"),
        F.expr("p_start + ((j + 1) * period + units - 1) div units").alias("mix_deadline"), "in_mix",
        (at * block_rows - F.col("short") + F.expr(f"rank % {block_rows}")).alias("mix_position"),
    )


def written_in_order(docs: DataFrame, position_col: str) -> DataFrame:
    """``docs``, read from Parquet files, with the place that each row has in them, file after file.

    Files follow each other by the numbers that Spark's writer gave them.
    """
    number = F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as long)")
    at = docs.select(F.struct(*docs.columns).alias("held"), number.alias("number"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("nth"))
    files = at.groupBy("number", "name").agg((F.max("nth") + 1).alias("n"))  # a row for each file
    before = Window.partitionBy(F.lit(0)).orderBy("number", "name").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("name").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = at.join(F.broadcast(starts), at["name"] == starts["of"])
    return placed.select("held.*", (F.col("start") + F.col("nth")).alias(position_col))
