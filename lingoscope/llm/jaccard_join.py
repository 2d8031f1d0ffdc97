"""Near duplicates: n-gram Jaccard join with adaptive multi-match prefixes.

A text is the set of its distinct word shingles.  Two sets x and y of n and m
shingles, n >= m, reach the threshold t only if they share
``a = ceil(t / (1 + t) * (n + m))``.  Let shingles have one order everywhere
(rare ones first, by a hashed frequency table of fixed size).  If x shows its
first p shingles and y its first q, the two prefixes share at least
``min(p - n, q - m) + a``: longer prefixes demand more matches.  One match is
certain from ``p = n - ceil(t n) + 1`` and, as y is the smaller one,
``q = m - ceil(2 t / (1 + t) m) + 1``.  A document lengthens both of its prefixes,
the outer one for larger partners to meet and the inner one for meeting them, by
the same number of shingles as long as the estimated cost of candidates (rows to
look at, texts to verify) falls; that many more matches are then required.

1. One pass over the texts gives each its set's 128-bit digest and size, and the
   frequency table.  Texts with equal sets are one class from here on.  Rows name a
   class by 64 bits folded from its digest; that no two classes share a name is
   checked, and where two do, all are folded in another way.
2. Prefix rows (shingle, set) meet by shingle; shingles that only one set shows
   are dropped.
3. First links: each set is tried against the lowest and highest set of each of
   its shingles, which joins large groups of copies with few pairs.
4. All pairs of sets that are not yet in one component, and share enough shingles
   of the smaller one's inner and the larger one's outer prefix, are verified.
   Pairs inside a component can't change it, so none is made: groups are met as
   (shingle, component), then opened to sets.  A shingle that very many texts
   have comes last in their orders, so it is in hardly any inner prefix.
   A shingle that more than ``MOST_PARTS`` components show (heavily edited copies
   of one text) isn't opened to pairs at all: the sets that show it are dealt to
   the cells of a grid, and each cell compares its sets in memory and returns no
   more than one link for two components.
5. Verification compares the whole texts' sets; a pair's texts come by joins on
   their rows' keys, digests of id and text.  The texts are written once, by
   buckets of that key, so the joins move pairs and never the corpus again.

The result is exact for components at any frequency table, since the table only
orders the shingles.  Hash values are 64 bits for a shingle and 128 for a set.

Cases: null or empty text, or one without words, has no shingles and links with
nothing; fewer words than a shingle make one shingle; equal rows are one class;
rows with equal ids but different texts are verified against the text that bears
the digest; rows without an id link and bridge as others do, but a component of
nothing else has a null id; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.llm.common import least_of_each, byte_sized, narrow, sparing
from lingoscope.llm.shingles import WORDS, linked, mixed, shingle_sets
from lingoscope.operators.graph import connected_components
from lingoscope.operators.storage import bucketed, discard, stored

PERCENT = 75
BUCKETS = 1 << 18  # of the frequency table, which is broadcast
MOST_MATCHES = 32  # how far a prefix may be lengthened
VERIFY_COST = 40.0  # of a candidate's verification, in rows looked at
MOST_PARTS = 128  # components of a shingle that meet as pairs of rows
CELL = 1 << 21  # shingles on a side of a grid's cell, or
CELL_SETS = 256  # sets, as long as that makes few sides
FEW_SIDES = 8
TRIED = 500  # pairs of one set that are verified in one task
MOST_FOLDINGS = 100
UNSEEN = 0.1  # partners expected of a shingle that the table doesn't show to be frequent
PIECE = 1 << 21


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mixed(s, 1).sum().view(np.int64)), int(mixed(s, 2).sum().view(np.int64))


def folded(first: np.ndarray, second: np.ndarray, folding: int) -> np.ndarray:
    """The 64-bit names of sets from the two halves of their digests."""
    with np.errstate(over="ignore"):
        inner = mixed(second.view(np.uint64), folding)
        return mixed(first.view(np.uint64) ^ inner, folding + 1).view(np.int64)


def name_of(s: np.ndarray, folding: int) -> int:
    return int(folded(*(np.array([half], np.int64) for half in _digest(s)), folding)[0])


def named(sets: DataFrame) -> tuple[DataFrame, int]:
    """``sets`` with a ``set_id`` for each digest (first, second), none for two, and the folding that gives it."""
    for folding in range(MOST_FOLDINGS):

        def run(batches, folding=folding):
            for batch in batches:
                ids = folded(batch.column("first").to_numpy(), batch.column("second").to_numpy(), folding)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=[*batch.schema.names, "set_id"])

        out = stored(sets.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in sets.schema)}, set_id long"))
        twice = out.where("n > 0").groupBy("set_id").agg(F.min(F.struct("first", "second")).alias("a"), F.max(F.struct("first", "second")).alias("b"))
        if twice.where("a <> b").isEmpty():
            return out, folding
        discard(out)
    raise RuntimeError(f"{MOST_FOLDINGS} foldings give two sets one name")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key): a row's own key, whether it has an id or not."""
    return narrow(docs, id=id_col, text=text_col).withColumn("key", F.xxhash64("id", "text"))


def keyed_texts(docs: DataFrame, nameless: bool, id_col: str, text_col: str) -> DataFrame:
    """(key, text) of all rows; equal ones without an id (there are some if ``nameless``) once."""
    rows = keyed(docs, id_col, text_col)
    texts = rows.where("id is not null").select("key", "text")
    return texts.union(rows.where("id is null").select("key", "text").distinct()) if nameless else texts


def digests(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, key, n, first, second) for documents, and (bucket, amount) for the frequency table."""

    @sparing
    def run(batches):
        amounts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for start, n in byte_sized(batch.column("text"), PIECE):
                sets = shingle_sets(batch.column("text").slice(start, n), words)
                marks = [_digest(s) for s in sets]
                for s in sets:
                    amounts += np.bincount((s % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) if len(s) > 4096 else 0
                small = [s for s in sets if len(s) <= 4096]
                if small:
                    amounts += np.bincount((np.concatenate(small) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                none = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, n), batch.column("key").slice(start, n), pa.array([len(s) for s in sets], pa.int32()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), none, pa.nulls(n, pa.int64())],
                    names=["id", "key", "n", "first", "second", "bucket", "amount"],
                )
        at = np.flatnonzero(amounts)
        k = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(at, pa.int32()), pa.array(amounts[at], pa.int64())],
            names=["id", "key", "n", "first", "second", "bucket", "amount"],
        )

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return rows.mapInArrow(run, f"id {kind}, key long, n int, first long, second long, bucket int, amount long")


def matches_to_ask(n: int, frequency: np.ndarray, percent: int = PERCENT) -> int:
    """By how much a set lengthens its prefixes, and so how many matches they ask for.

    ``frequency``: estimated partners of its shingles, in order.
    """
    outer, inner = n - -(-percent * n // 100), n - -(-2 * percent * n // (100 + percent))
    most = min(MOST_MATCHES, n - outer)
    if most <= 1:
        return 1
    k = np.arange(1, most + 1)
    sums = np.concatenate([[0.0], np.cumsum(frequency[: outer + most])])
    # sets that share k shingles of a prefix are at most its rows divided by k
    cost = k + sums[outer + k] + VERIFY_COST * sums[inner + k] / k
    return int(k[cost.argmin()])


def prefixes(docs: DataFrame, table: np.ndarray, folding: int, words: int, percent: int, text_col: str) -> DataFrame:
    """Rows (shingle, set_id, inner, sizes): each set's outer prefix, once for each task that has the set.

    ``inner``: whether the shingle is in the inner prefix too; ``sizes`` holds n
    and the matches asked for (see ``opened``) in one number.
    """
    held = docs.sparkSession.sparkContext.broadcast(table)

    @sparing
    def run(batches):
        amounts = held.value
        usual = np.median(amounts)
        estimate = UNSEEN + np.maximum(0.0, amounts - usual - 3 * np.sqrt(usual + 1))
        done: set[int] = set()
        for batch in batches:
            for start, k in byte_sized(batch.column("text"), PIECE):
                out = ([], [], [], [], [])
                for s in shingle_sets(batch.column("text").slice(start, k), words):
                    n = len(s)
                    if not n:
                        continue
                    set_id = name_of(s, folding)
                    if set_id in done:
                        continue
                    if len(done) < 500_000:
                        done.add(set_id)
                    bucket = (s % np.uint64(BUCKETS)).astype(np.int64)
                    order = np.lexsort((s, amounts[bucket]))
                    ask = matches_to_ask(n, estimate[bucket[order]], percent)
                    shown = n - -(-percent * n // 100) + ask
                    out[0].append(s[order[:shown]])
                    out[1].append(np.arange(shown) < n - -(-2 * percent * n // (100 + percent)) + ask)
                    for held_, x in zip(out[2:], (set_id, n * 2**32 + ask, shown)):
                        held_.append(x)
                if out[0]:
                    per = np.array(out[4])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out[0]).view(np.int64)), pa.array(np.repeat(np.array(out[2], np.int64), per)), pa.array(np.concatenate(out[1])), pa.array(np.repeat(np.array(out[3], np.int64), per))],
                        names=["shingle", "set_id", "inner", "sizes"],
                    )

    return narrow(docs, text=text_col).mapInArrow(run, "shingle long, set_id long, inner boolean, sizes long")


def opened(df: DataFrame, sizes: str = "sizes", suffix: str = "") -> DataFrame:
    return df.withColumns({f"n{suffix}": F.shiftright(sizes, 32), f"ask{suffix}": F.col(sizes).bitwiseAND(F.lit(2**32 - 1))}).drop(sizes)


def enough(percent: int) -> str:
    """The rule for a set (n, ask) and a larger one (n2, ask2) that share ``matches`` shingles of their prefixes."""
    outer = f"ask2 - ((n2 * {percent} + 99) div 100)"
    inner = f"ask - ((n * {2 * percent} + {99 + percent}) div {100 + percent})"
    share = f"((n + n2) * {percent} + {99 + percent}) div {100 + percent}"
    return f"n * 100 >= n2 * {percent} and matches >= least({outer}, {inner}) + {share}"


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, folding: int, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose texts' sets are linked."""
    of = classes.select("set_id", "rep")
    # a set that very many are tried against: its pairs are dealt to several tasks, and its text to each of them
    many = pairs.groupBy("a").agg(F.expr(f"cast((count(1) + {TRIED - 1}) div {TRIED} as int)").alias("parts")).where("parts > 1")
    many = F.broadcast(stored(many))  # one row for TRIED pairs at most
    dealt = lambda df: df.join(many, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    heads = dealt(pairs.select("a").distinct()).join(of.toDF("a", "key_a"), "a").join(texts.toDF("key_a", "text_a"), "key_a")
    heads = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text_a")
    with_b = dealt(pairs).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    with_b = with_b.join(of.toDF("b", "key_b"), "b").join(texts.toDF("key_b", "text_b"), "key_b").select("a", "b", "part", "text_b")
    with_both = with_b.join(heads, ["a", "part"]).select("a", "b", "text_a", "text_b")

    @sparing
    def run(batches):
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for start, n in byte_sized(batch.column("text_b"), PIECE):
                right = shingle_sets(batch.column("text_b").slice(start, n), words)
                for i in range(start, start + n):
                    if a[i] not in last:
                        left = shingle_sets(batch.column("text_a").slice(i, 1), words)[0]
                        if name_of(left, folding) != a[i]:
                            continue
                        last = {a[i]: left}
                    other = right[i - start]
                    if name_of(other, folding) == b[i] and linked(last[a[i]], other, percent):
                        keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return with_both.mapInArrow(run, "a long, b long")


def links_in_cell(sets: list[np.ndarray], ids: np.ndarray, parts: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components, at most one for two components.

    ``sides``: sets of one side only meet the other's, unless there is but one.
    """
    lengths = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    opens = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    counts = np.diff(np.append(opens, len(values)))
    posting = np.empty(len(order), np.int64)
    posting[order] = np.repeat(np.arange(len(opens)), counts)
    several = len(np.unique(sides)) > 1
    done, out = set(), []
    at = np.cumsum(lengths) - lengths
    for i in range(len(sets)):
        p = posting[at[i] : at[i] + lengths[i]]
        p = p[counts[p] > 1]
        if not len(p):
            continue
        size = counts[p]
        where = np.repeat(opens[p] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        shared = np.bincount(owner[where], minlength=len(sets))
        ok = (100 * shared >= percent * (lengths + lengths[i] - shared)) & (parts != parts[i]) & (shared > 0)
        if several:
            ok &= sides != sides[i]
        for j in np.flatnonzero(ok).tolist():
            pair = (min(parts[i], parts[j]), max(parts[i], parts[j]))
            if pair not in done:
                done.add(pair)
                out.append((int(ids[i]), int(ids[j])))
    return out


def grid_links(members: DataFrame, classes: DataFrame, texts: DataFrame, folding: int, words: int, percent: int) -> DataFrame:
    """Links (a, b) between the members (low, set_id, n, part) of each ``low``, cell by cell."""
    few = F.least(F.lit(FEW_SIDES), F.ceil(F.count(F.lit(1)) / F.lit(CELL_SETS)))
    blocks = members.groupBy("low").agg(F.greatest(F.ceil(F.sum("n") / F.lit(CELL)), few).cast("int").alias("blocks"))
    rows = members.join(blocks, "low").withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    rows = rows.join(classes.select("set_id", F.col("rep").alias("key")), "set_id").join(texts, "key")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("low", F.least("side", "other").alias("row"), F.greatest("side", "other").alias("column"), "side", "set_id", "part", "text")

    def cell(table: pa.Table) -> pa.Table:
        column = table.column("text").combine_chunks()
        sets = [s for start, n in byte_sized(column, PIECE) for s in shingle_sets(column.slice(start, n), words)]
        ids, parts, sides = (table.column(c).to_numpy() for c in ("set_id", "part", "side"))
        # of rows with one key, those that bear the set
        keep = [k for k, s in enumerate(sets) if len(s) and name_of(s, folding) == ids[k]]
        found = links_in_cell([sets[k] for k in keep], ids[keep], parts[keep], sides[keep], percent) if keep else []
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("low", "row", "column").applyInArrow(cell, "a long, b long")


def labelled(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (of id and text), n (shingles), part (one number for all that links reach) for every row."""
    spark = docs.sparkSession
    first = stored(digests(docs, words, id_col, text_col))
    sets, folding = named(first.where("bucket is null").select("id", "key", "n", "first", "second"))
    table = np.zeros(BUCKETS, np.int64)
    amounts = first.where("bucket is not null").groupBy("bucket").agg(F.sum("amount").alias("amount")).toArrow()  # BUCKETS rows at most
    table[amounts["bucket"].to_numpy()] = amounts["amount"].to_numpy()
    discard(first)
    classes = sets.where("n > 0").groupBy("set_id").agg(F.min("key").alias("rep"))
    texts = bucketed(keyed_texts(docs, not sets.where("id is null").isEmpty(), id_col, text_col), "key")

    shown = prefixes(docs, table, folding, words, percent, text_col)
    shown = shown.repartition("shingle").dropDuplicates(["shingle", "set_id"])
    ends = shown.groupBy("shingle").agg(
        F.min("set_id").alias("low"), F.max("set_id").alias("high"), F.min_by("sizes", "set_id").alias("low_sizes"), F.max_by("sizes", "set_id").alias("high_sizes"),
        F.bool_or("inner").alias("any"),
    )
    # the same columns of `shown` on both sides, so that they share one exchange
    shared = stored(shown.join(ends.where("low <> high and any").drop("any"), "shingle"))

    leads = F.array(F.struct(F.col("low").alias("a"), F.col("low_sizes").alias("sizes2")), F.struct(F.col("high").alias("a"), F.col("high_sizes").alias("sizes2")))
    tried = shared.select("set_id", "sizes", F.inline(leads)).where("set_id <> a")
    tried = tried.groupBy("a", F.col("set_id").alias("b"), "sizes", "sizes2").agg(F.count(F.lit(1)).alias("matches"))
    tried = opened(opened(tried), "sizes2", "2")
    # here a few matches in proportion are asked for: what isn't tried now is met later
    tried = tried.where(f"least(n, n2) * 100 >= greatest(n, n2) * {percent} and matches * 100 >= least(n, n2) * 8").select("a", "b")
    links = stored(verified(tried, classes, texts, folding, words, percent))
    parts = stored(connected_components(links, "a", "b")).toDF("set_id", "part")

    rows = shared.select("shingle", "low", "set_id", "inner", "sizes").join(parts, "set_id", "left").withColumn("part", F.coalesce("part", "set_id"))
    ends = rows.groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.bool_or("inner").alias("any"))
    rows = stored(rows.join(ends.where("p <> q and any").select("shingle"), "shingle"))
    discard(shared)
    spread = rows.select("shingle", "part").distinct().groupBy("shingle").count()
    crowded = stored(spread.where(f"count > {MOST_PARTS}").select("shingle"))
    members = stored(rows.join(crowded, "shingle", "left_semi").select("low", "set_id", F.shiftright("sizes", 32).alias("n"), "part").distinct())
    more = stored(grid_links(members, classes, texts, folding, words, percent)) if not members.isEmpty() else None
    rows_met = rows
    # a pair that shares a crowded shingle has met; any other shares none, so its count is whole without them
    rows = rows.join(crowded, "shingle", "left_anti")
    inner = rows.where("inner").select("shingle", "part", F.col("set_id").alias("a"), "sizes")
    outer = rows.select("shingle", F.col("part").alias("part2"), F.col("set_id").alias("b"), F.col("sizes").alias("sizes2"))
    met = inner.select("shingle", "part").distinct().join(outer.select("shingle", "part2").distinct(), "shingle").where("part <> part2")
    # of a pair the smaller set (of equal ones the one of the smaller id) shows its inner prefix
    smaller = F.struct(F.shiftright("sizes", 32), "a") < F.struct(F.shiftright("sizes2", 32), "b")
    near = F.shiftright("sizes", 32) * 100 >= F.shiftright("sizes2", 32) * percent
    pairs = met.join(inner, ["shingle", "part"]).join(outer, ["shingle", "part2"]).where(smaller & near)
    pairs = pairs.groupBy("a", "b", "sizes", "sizes2").agg(F.count(F.lit(1)).alias("matches"))
    pairs = opened(opened(pairs), "sizes2", "2")
    pairs = stored(pairs.where(enough(percent)).select("a", "b"))
    later = [] if more is None else [more]
    if not pairs.isEmpty():
        later.append(stored(verified(pairs, classes, texts, folding, words, percent)))
    discard(texts, rows_met)
    later = [x for x in later if not x.isEmpty()]
    for x in later:
        links = links.union(x)
    if later:
        parts = stored(connected_components(links, "a", "b")).toDF("set_id", "part")

    return sets.join(parts, "set_id", "left").select("id", "key", "n", F.coalesce("part", "set_id").alias("part"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links) for every row."""
    rows = labelled(docs, words, percent, id_col, text_col)
    lowest = rows.where("n > 0").groupBy("part").agg(F.min("id").alias("lowest"))
    return rows.join(lowest, "part", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each group that links reach one row of ``docs``, with all its columns.

    It is the row of the smallest id (a null id comes last; of different texts under one
    id, a fixed one).  Rows alike in id and text are one: the least in the order of its
    columns stays.  Rows without words are linked with nothing and all stay.
    """
    rows = stored(labelled(docs, id_col=id_col, text_col=text_col, **options))
    lead = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("lead")
    leads = rows.where("n > 0").groupBy("part").agg(lead).select(F.col("lead.id").alias("kept_id"), F.col("lead.key").alias("kept_key"), F.lit(True).alias("one"))
    bare = rows.where("n = 0").select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key")).distinct().withColumn("one", F.lit(False))
    held = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], docs[text_col]).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("held"))
    kept = leads.union(bare)
    met = held.join(kept, held["id"].eqNullSafe(kept["kept_id"]) & (held["key"] == kept["kept_key"])).select("id", "key", "held", "one")
    repeated = rows.where("n > 0").groupBy("id", "key").count().where("count > 1")
    if repeated.isEmpty():
        return met.select("held.*")
    twins = repeated.select(F.col("id").alias("twin_id"), F.col("key").alias("twin_key"))
    same = met["id"].eqNullSafe(twins["twin_id"]) & (met["key"] == twins["twin_key"]) & met["one"]
    return met.join(twins, same, "left_anti").select("held.*").unionByName(least_of_each(met.join(twins, same, "left_semi"), "id", "key"))
