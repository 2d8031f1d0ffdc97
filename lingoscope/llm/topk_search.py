"""Exact top-k inner products by norm-bucketed retrieval.

1. Candidates are ordered by length and cut into cells of similar length; in a
   cell they are cut into buckets again.
2. A bounded head of the longest vectors gives every query a first lower bound
   on its k-th score, the query's threshold.
3. A query is sent to the cells whose longest vector can still reach what it
   needs, and to no others.  A cell's candidates come first in its sorted stream and
   are held; its queries pass by them in batches, so candidates move once.  Where
   there are more than ``QUERY_BLOCK`` queries, blocks of similar needs do so in
   several tasks, and a cell is sent to those that it can serve.
4. For a query q and a bucket whose longest vector has length b, only vectors
   with ``cos(q, v) >= threshold / (|q| b)`` can enter the result: the bucket's
   local cosine threshold.  If it is above 1, the bucket is skipped.  If it is
   low, coordinates prune nothing and the bucket is pruned by length alone
   (``|v| >= threshold / |q|``).  If it is high, the query's largest coordinates
   give intervals in which the candidates' normalised coordinates must lie.
5. What is left is verified by exact products; a query's threshold rises as
   buckets go by, longest first.

Products are taken in float64, which is exact below 2^53; where lengths allow
more, what passes is multiplied again in 64-bit integers.  A pair of vectors whose
product might not fit into 64 bits stops the job with an error.

Every cell returns k rows a query at most, so no task holds all queries or all
candidates, and no row set grows beyond queries x k x cells.  Vectors of one
length (normalised ones, say) are dealt to several cells by a hash of their ids.

Cases: vectors that are null, of another dimension than the most common one (of
equally common ones the largest), or that hold a null or non-finite component
take no part; so do rows with a null id.  Repeated ids are separate candidates,
except that a query never meets rows with its own id.  Zero vectors score 0, and
so do empty ones, where these are the most common.  Empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingoscope.llm.common import narrow
from lingoscope.operators.storage import stored

SCALE = 1024
HEAD = 2048  # longest candidates that set the first thresholds; broadcast, so a fixed bound
QUERY_BLOCK = 1 << 20  # queries that pass by a cell's candidates in one task
CANDIDATE_BLOCK = 65536
MOST_CUTS = 4096  # lengths at which cells are cut; a cell of more rows is dealt to several
PRODUCTS = 4096  # queries that are multiplied at once with a bucket
EXACT = 2.0**52
BUCKET_ROWS = 512
FOCUS = 3  # coordinates that prune a bucket
COORDINATE_FROM = 0.55  # local cosine threshold from which coordinates prune


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """Rows (id, v, norm) that take part; v holds floor(scale * x) as double."""
    v = F.transform("raw", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = narrow(vectors, id=id_col, raw=vector_col).where(F.col("id").isNotNull() & F.col("raw").isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    usual = rows.groupBy(F.size("raw").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    rows = rows.where(F.size("raw") == (usual["dim"] if usual else 0)).select("id", v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _products(vectors: np.ndarray, query: np.ndarray, scores: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer scores; ``scores`` are the products as floats, ``largest`` bounds them."""
    if largest < EXACT:
        return np.rint(scores).astype(np.int64)
    if largest >= 2.0**63:
        raise OverflowError("a score doesn't fit into 64 bits")
    return vectors.astype(np.int64) @ query.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def prepared(block: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Ids, lengths, vectors and unit vectors of a block (columns id, v, norm), longest first."""
    block = block.sort_values(["norm", "id"], ascending=[False, True], kind="stable")
    cid, cn, cv = block["id"].to_numpy(np.int64), block["norm"].to_numpy(), _matrix(block["v"])
    return cid, cn, cv, cv / np.maximum(cn, 1e-300)[:, None]


def search_block(queries: pd.DataFrame, block: tuple[np.ndarray, ...], k: int) -> pd.DataFrame:
    """The k best candidates of a prepared block for each query (columns id, v, norm, bound)."""
    cid, cn, cv, unit = block
    qid, qn, qv = queries["id"].to_numpy(np.int64), queries["norm"].to_numpy(), _matrix(queries["v"])
    found_id = [np.zeros(0, np.int64)] * len(qid)
    found = [np.zeros(0, np.int64)] * len(qid)
    bound = queries["bound"].to_numpy(np.float64).copy()
    slack = 1e-9

    def verify(q: int, scores: np.ndarray, at: np.ndarray, longest: float) -> None:
        """Merges the candidates ``at`` with what the query has; the float scores are off by a rounding error at most."""
        largest = float(qn[q] * longest)
        with np.errstate(invalid="ignore"):
            usable = np.flatnonzero((cid[at] != qid[q]) & (scores >= bound[q] - (0 if largest < EXACT else largest * slack)))
        if not len(usable):
            return
        at = at[usable]
        exact = np.concatenate([found[q], _products(cv[at], qv[q], scores[usable], largest)])
        ids = np.concatenate([found_id[q], cid[at]])
        best = _best(exact, ids, k)
        found[q], found_id[q] = exact[best], ids[best]
        if len(best) == k:
            bound[q] = max(bound[q], float(exact[best[-1]]) * (1 if largest < EXACT else 1 - np.sign(float(exact[best[-1]])) * slack))

    for start in range(0, len(cid), BUCKET_ROWS):
        part = slice(start, min(start + BUCKET_ROWS, len(cid)))
        longest = cn[part.start]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(qn * longest > 0, bound / (qn * longest), np.where(bound > 0, 2.0, -1.0))
        live = np.flatnonzero(~(local > 1 + slack))
        if not len(live):
            continue
        lengths = live[~(local[live] > COORDINATE_FROM)]
        # length pruning: a prefix of the bucket for each query, verified by one product
        for first in range(0, len(lengths), PRODUCTS):
            some = lengths[first : first + PRODUCTS]
            products = qv[some] @ cv[part].T
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(qn[some] > 0, bound[some] / qn[some], -np.inf)
            for row, q in enumerate(some):
                upto = int(np.searchsorted(-cn[part], -(least[row] * (1 - slack)), "right")) if least[row] > 0 else part.stop - start
                verify(q, products[row, :upto], np.arange(start, start + upto), longest)
        for q in live[local[live] > COORDINATE_FROM]:
            unit_q = qv[q] / qn[q]
            focus = np.argsort(-np.abs(unit_q))[:FOCUS]
            t = min(1.0, float(local[q]))
            # |u - q| <= sqrt(2 - 2t) for unit vectors at cosine t or more; coordinate by coordinate it is tighter
            spread = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0.0, 1 - unit_q[focus] ** 2))
            low, high = t * unit_q[focus], unit_q[focus]
            low, high = np.minimum(low, high) - spread - slack, np.maximum(low, high) + spread + slack
            inside = np.all((unit[part][:, focus] >= low) & (unit[part][:, focus] <= high), axis=1)
            inside &= cn[part] * qn[q] >= bound[q] * (1 - slack)
            at = start + np.flatnonzero(inside)
            if len(at):
                verify(q, cv[at] @ qv[q], at, longest)
    sizes = [len(x) for x in found]
    return pd.DataFrame(
        {
            "query_id": np.repeat(qid, sizes),
            "vec_id": np.concatenate(found_id) if sizes else np.zeros(0, np.int64),
            "score": np.concatenate(found) if sizes else np.zeros(0, np.int64),
        }
    )


def meetings(needs: list[float], longest: list[float]) -> tuple[list[tuple], list[tuple]]:
    """(block, first cell, end) and (cell, first block, end): who meets whom.

    ``needs``: the least length that each block's queries ask for; ``longest``:
    the longest vector of each cell.  Both ascend.
    """
    blocks = [(b, int(np.searchsorted(longest, x, "left")), len(longest)) for b, x in enumerate(needs)]
    return blocks, [(c, 0, int(np.searchsorted(needs, x, "right"))) for c, x in enumerate(longest)]


def passing(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k best candidates of its cell for each query that passes by.

    Rows (cell, block, query, id, v, norm, bound) in the order of their first three: a
    cell's candidates are held, then its queries come in batches.
    """
    at, held, block = None, [], None
    for batch in batches:
        keys = batch[["cell", "block", "query"]].to_numpy(np.int64)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else []
        for start, end in zip([0, *ends], ends):
            cell, some = tuple(keys[start, :2]), batch.iloc[start:end]
            if cell != at:
                at, held, block = cell, [], None
            if not keys[start, 2]:
                held.append(some[["id", "v", "norm"]])
            elif held or block is not None:
                if block is None:
                    block, held = prepared(pd.concat(held, ignore_index=True)), []
                yield search_block(some, block, k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows."""
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col, scale)
    queries = rows.where(is_query)
    n_rows = rows.count()
    head = [(r["id"], r["v"], r["norm"]) for r in rows.orderBy(F.desc("norm"), "id").limit(HEAD).collect()]
    dims = spark.sparkContext.broadcast(pd.DataFrame(head, columns=["id", "v", "norm"]))

    def first_bounds(batches):
        top = prepared(dims.value)
        for batch in batches:
            batch["bound"] = -np.inf
            out = search_block(batch, top, k) if len(batch) and len(top[0]) else None
            if out is not None:
                kth = out.groupby("query_id")["score"].agg(lambda s: float(s.min()) * (1 - np.sign(s.min()) * 1e-9) if len(s) >= k else -np.inf)
                batch["bound"] = batch["id"].map(kth).fillna(-np.inf).astype(float)
            yield batch

    bounded = stored(queries.mapInPandas(first_bounds, "id long, v array<double>, norm double, bound double"))
    # the length that a vector needs to enter a query's result; none for a query of length 0
    need = F.when((F.col("norm") > 0) & (F.col("bound") > 0), F.col("bound") / F.col("norm") * (1 - 1e-9)).otherwise(F.lit(0.0))
    bounded = bounded.withColumn("need", need)

    def cut(df: DataFrame, column: str, rows: int, size: int, least: int = 1):
        """Values that cut a column into parts of about ``size`` rows."""
        parts = min(max(-(-rows // size), least), MOST_CUTS)
        return df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 and rows else []

    def dealt(df: DataFrame, column: str, cuts: list[float], size: int, extreme) -> tuple[DataFrame, list[tuple]]:
        """Rows with the number of their part, by the cuts and, inside one that holds too many, by a hash; and (part, extreme value) of each."""
        at = F.lit(cuts).cast("array<double>") if cuts else F.array().cast("array<double>")
        ranged = df.withColumn("range", F.size(F.filter(at, lambda x: x < F.col(column))))
        counts = [(r["range"], r["n"], r["x"]) for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), extreme(column).alias("x")).collect()]  # MOST_CUTS + 1 rows at most
        parts, first = [], {}
        for number, n, x in sorted(counts):
            first[number] = (len(parts), -(-n // size))
            parts.extend([x] * first[number][1])
        table = spark.createDataFrame([(r, a, n) for r, (a, n) in first.items()], "range int, first int, parts int")
        out = ranged.join(F.broadcast(table), "range").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
        return out.drop("range", "first", "parts"), parts

    n_queries = bounded.count()
    left, needs = dealt(bounded, "need", cut(bounded, "need", n_queries, QUERY_BLOCK), QUERY_BLOCK, F.min)
    right, longest = dealt(rows, "norm", cut(rows, "norm", n_rows, CANDIDATE_BLOCK, min(8, n_rows // 4096)), CANDIDATE_BLOCK, F.max)
    blocks, cells = meetings(needs, longest)

    reach = F.lit(longest).cast("array<double>") if longest else F.array().cast("array<double>")
    names = lambda ranges: spark.createDataFrame(ranges, "part int, low int, high int").where("low < high")
    candidates = right.join(F.broadcast(names(cells)), "part").select(
        F.col("part").alias("cell"), F.explode(F.expr("sequence(low, high - 1)")).alias("block"), F.lit(0).alias("query"), "id", "v", "norm", F.lit(None).cast("double").alias("bound")
    )
    # of its block's cells a query meets those from the first that holds a vector as long as it needs
    own = F.greatest("low", F.size(F.filter(reach, lambda x: x < F.col("need"))))
    asked = left.join(F.broadcast(names(blocks)), "part").withColumn("own", own).where("own < high").select(
        F.explode(F.expr("sequence(own, high - 1)")).alias("cell"), F.col("part").alias("block"), F.lit(1).alias("query"), "id", "v", "norm", "bound"
    )
    streams = candidates.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "query")
    found = streams.mapInPandas(lambda batches: passing(batches, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
