"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors lie in blocks of bounded size. In a block every dimension has a list of its vectors sorted by that component; a
query reads its lists from their favourable ends (the top where its own component is positive, the bottom where it is
negative), those that contribute most to the bound first, scores each vector that it meets for the first time, and stops once the bound, its
product with the components where the reading stands, can't reach the k-th score.

Every block of queries first meets one block of vectors. The k-th score from there is carried along to all the others: a block whose bound
is below it at the outset isn't read at all, and elsewhere the reading stops against it. A block of vectors lies in one task, and the
queries, the smaller side, are copied to it; the best of each pair are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burdenframe.plans.workspace import stored

SCALE = 64
K = 20
BLOCK, QUERY_BLOCK = 8192, 512
#: First step of the reading; each further step goes four times as deep.
FIRST_DEPTH = 16
EXACT = 2.0**53
#: A vector that is picked out costs as much as so many in a product with all; an entry that is read, as so many vectors.
COPY_COST, READ_COST = 4, 4


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


class Lists:
    """The sorted lists of a block, as ranks and values from the largest component down."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(-self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, 0)
        self.largest = float(np.abs(self.vectors).max())

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact products: in doubles where all sums are whole numbers below 2**53, else in Python's integers."""
        if self.largest * float(np.abs(query).max()) * len(query) < EXACT:
            return (self.vectors @ query)[at] if COPY_COST * len(at) > len(self.ids) else self.vectors[at] @ query
        q = [int(x) for x in query]
        return np.array([sum(a * int(b) for a, b in zip(q, v)) for v in self.vectors[at]], object)

    def top(self, query: np.ndarray, own: int, k: int = K, first_depth: int = FIRST_DEPTH, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best (id, score) without id ``own``, ties to the smaller id, as far as they reach ``floor``; and how many vectors were scored."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        down = query[used] < 0
        depth, weight = np.zeros(len(used), np.int64), query[used]
        exact = self.largest * float(np.abs(query).max()) * len(query) < EXACT
        seen = self.ids == own
        best, score, scored, step = np.zeros(0, np.int64), np.zeros(0), 0, first_depth
        while True:
            # what each list still promises: its component where the reading stands
            promise = weight * self.values[np.where(down, n - 1 - np.minimum(depth, n - 1), np.minimum(depth, n - 1)), used]
            limit = max(floor, score[-1]) if len(best) == k else floor
            if exact and promise.sum() < limit or len(seen) and seen.all():
                break
            met = np.zeros(n, bool)
            if not exact or not len(used) or depth.max() >= n or READ_COST * step * len(used) >= n - seen.sum():  # the next reading costs more than to score what is left
                met[:] = True
                depth[:] = n
            else:
                gain = promise - weight * self.values[np.where(down, np.maximum(n - 1 - depth - step, 0), np.minimum(depth + step, n - 1)), used]
                for i in np.flatnonzero(gain >= np.median(gain)):
                    to = min(depth[i] + step, n)
                    met[self.order[n - to : n - depth[i], used[i]] if down[i] else self.order[depth[i] : to, used[i]]] = True
                    depth[i] = to
            new = np.flatnonzero(met & ~seen)
            seen |= met
            scored += len(new)
            best = np.concatenate([best, new])
            score = np.concatenate([score, self.scores(new, query)])
            if score.dtype != object and len(score) > 4 * k:  # only what reaches the k-th score is sorted
                reach = score >= np.partition(score, -k)[-k]
                best, score = best[reach], score[reach]
            keep = np.lexsort((best, -score))[:k] if score.dtype != object else sorted(range(len(best)), key=lambda i: (-score[i], best[i]))[:k]
            best, score = best[keep], score[keep]
            step *= 2
        return [(int(self.ids[i]), int(s)) for i, s in zip(best, score) if s >= floor], scored


def _blocks(vectors: DataFrame, n: int) -> DataFrame:
    """One row per dimension count and block: its ids, scaled vectors and floors as bytes."""

    def pack(key, rows):
        ids, floors = rows.column("id").to_numpy(), rows.column("floor").to_numpy()
        flat = rows.column("vector").combine_chunks()
        values = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
        whole = np.floor(SCALE * values.astype(np.float64))
        return pa.table({"dims": [key[0].as_py()], "block": [key[1].as_py()], "ids": [ids.astype("<i8").tobytes()],
                         "data": [whole.astype("<f8").tobytes()], "floors": [floors.astype("<f8").tobytes()]})

    keyed = vectors.select("id", "vector", "floor", F.size("vector").alias("dims"), F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int").alias("block"))
    return keyed.groupBy("dims", "block").applyInArrow(pack, "dims long, block long, ids binary, data binary, floors binary")


LONG = (1 << 63) - 1


def _meet(held: DataFrame, asked: DataFrame, tasks: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the best of every block of vectors for the query blocks that ``asked`` sends to it as ``c``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                vectors = np.frombuffer(row["data"], "<f8").reshape(len(ids), -1)
                if not row["asks"]:  # a block of vectors comes before its queries
                    key, lists = (row["dims"], row["c"]), Lists(ids, vectors)
                elif key == (row["dims"], row["c"]):
                    floors = np.frombuffer(row["floors"], "<f8")
                    out = [(int(i), v, max(-LONG, min(s, LONG))) for i, x, f in zip(ids, vectors, floors) for v, s in lists.top(x, i, k, floor=f)[0]]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])

    columns = ("dims", "c", "asks", "ids", "data", "floors")
    both = held.withColumns({"c": F.col("block"), "asks": F.lit(False)}).select(*columns).union(asked.withColumn("asks", F.lit(True)).select(*columns))
    dealt = both.repartition(tasks, "dims", "c").sortWithinPartitions("dims", "c", "asks")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
           block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` best candidates of every query.

    ``queries`` tells which rows are queries; candidates are all rows but those with the query's id. Components are
    scaled and rounded down to whole numbers. Vectors that are null or empty or hold null or non-finite components, and rows with
    a null id, take no part; vectors are compared with those of as many dimensions. Rows with one id and different vectors are
    candidates of their own, so an id may have several ranks; if they are queries, the ``k`` best of all their products are
    ranked together under the id. Scores beyond 64 bits are ranked as they are in each block and given as the largest (or smallest) long. Rows equal in id and vector count once, as a query if one of them is. An empty table gives an
    empty table; other columns are left out.
    """
    query = F.coalesce(queries, F.lit(False))
    rows = vectors.filter(usable(F.col(f"`{embedding}`"))).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("vector"), query.alias("query"))
    rows = stored(rows.filter("id IS NOT NULL").groupBy("id", "vector").agg(F.max("query").alias("query")), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.col("query").cast("long")).alias("q")).first()
    n, q = -(-sizes.n // block) or 1, -(-(sizes.q or 0) // query_block) or 1
    without = F.lit(float("-inf"))
    held = stored(_blocks(rows.withColumn("floor", without), n), "blocks")
    asking = rows.filter("query").select("id", "vector")
    first = _blocks(asking.withColumn("floor", without), q).withColumn("c", F.col("block") % n)
    found = stored(_meet(held, first, n, k), "first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floors = found.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    # a floor as a double may lie above the score it stands for: the next one below
    floors = floors.withColumn("floor", F.col("floor") - F.abs("floor") * F.lit(2.0**-52))
    if n > 1:
        informed = _blocks(asking.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", without)), q)
        others = informed.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).filter(F.col("c") != F.col("block") % n)
        found = found.union(_meet(held, others, n, k))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
