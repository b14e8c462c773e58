"""Exact top-k inner products with block bounds.

Vectors become integers and lie in blocks of similar ones. A block keeps its forward index (the vectors) and, for each dimension, its largest and
smallest value. For each query, the sum of the largest products that each dimension allows bounds what a block holds. A query first scores its blocks of
the highest bounds; the k-th score found there, shared by all tasks, then decides which other blocks have to be scored. Vectors and queries only
travel to blocks that are scored: where bounds decide nothing (vectors without clusters), these are all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import written

#: Vectors of a block, and bits that may name a block's place.
BLOCK, MOST_BITS = 1_024, 16
#: Block summaries and queries that one task holds at a time; blocks that a query scores first of each tile of summaries.
TILE, QUERIES, SEEDS = 4_096, 1_024, 2


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as bigints."""
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(embedding: Column) -> Column:
    """Neither null nor holding a null or a non-finite component."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(odd, F.lit(False))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats while all partial sums are exact there."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[-1])
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def best_of_block(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one block at or above its floor (ties to the smaller id, its own id left out): query, id, score."""
    s = scores(q, x)
    own = q_ids[:, None] == ids[None, :]
    least = np.where(own, np.iinfo(np.int64).min, s)
    kth = np.partition(least, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(q), np.iinfo(np.int64).min)
    row, column = np.nonzero((s >= np.maximum(kth, floors)[:, None]) & ~own)
    order = np.lexsort((ids[column], -s[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)  # rows are in order: where each one's run starts
    taken = np.arange(len(row)) - first < k
    return q_ids[row[taken]], ids[column[taken]], s[row[taken], column[taken]]


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What each query can reach at most in each block."""
    return scores(np.maximum(q, 0), top) + scores(np.minimum(q, 0), low)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).reshape(len(column), -1)


def _located(rows: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Adds ``block``: vectors that lie on the same sides of the means of the most varied dimensions, cut into parts of about ``BLOCK`` vectors."""
    spread: dict[int, list] = {d: [] for d in sizes}
    for r in (rows.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.stddev_pop("x").alias("sd"), F.avg("x").alias("mean")).collect()):  # a row for each dimension
        spread[r["dim"]].append((-r["sd"], r["at"], r["mean"]))
    side = F.lit(0).cast("long")
    for d, (n, _) in sizes.items():
        bits = min(MOST_BITS, max(0, math.ceil(math.log2(n / BLOCK))))
        for i, (_, at, mean) in enumerate(sorted(spread[d])[:bits]):
            side = side + F.when((F.col("dim") == d) & (F.get("v", at) > mean), 1 << i).otherwise(0)
    rows = rows.withColumn("side", side)
    groups = rows.groupBy("dim", "side").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return (rows.join(F.broadcast(groups), ["dim", "side"])  # at most 2 ** MOST_BITS rows a length of vector
            .withColumn("block", F.col("side") * (1 << 40) + part).drop("side", "parts"))


def search(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024) -> tuple[DataFrame, DataFrame] | None:
    """What ``top_k`` returns, and the pairs (dim, query_id, block) that were scored for it; None if nothing asks."""
    usable_rows = (vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
                   .select("vec_id", quantised(F.col("embedding"), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")))
    sizes = {r["dim"]: (r["n"], r["asking"]) for r in usable_rows.groupBy(F.size("v").alias("dim")).agg(
        F.count("*").alias("n"), F.count_if("asks").alias("asking")).collect() if r["asking"]}  # a row for each length of vector
    if not sizes:
        return None
    per_length = lambda of: F.create_map(*[F.lit(x) for d, s in sizes.items() for x in (d, of(*s))])[F.col("dim")]
    rows = usable_rows.withColumn("dim", F.size("v")).filter(F.col("dim").isin(*sizes))
    data = written(_located(rows, sizes), "vectors")
    q_tile = lambda key: F.pmod(F.xxhash64(key, F.lit(2)), per_length(lambda n, a: -(-a // QUERIES))).cast("int").alias("q_tile")
    asking = data.filter("asks").select("dim", F.col("vec_id").alias("query_id"), q_tile("vec_id"), "v")

    def summary(block: pd.DataFrame) -> pd.DataFrame:
        x = _stacked(block["v"])
        return pd.DataFrame({"dim": [x.shape[1]], "block": block["block"].iloc[:1].to_numpy(), "top": [x.max(0)], "low": [x.min(0)]})

    blocks = written(data.select("dim", "block", "v").groupBy("dim", "block").applyInPandas(summary, "dim int, block long, top array<long>, low array<long>"), "blocks")
    n_tiles = {r["dim"]: -(-r["n"] // TILE) for r in blocks.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    b_tiles = F.create_map(*[F.lit(x) for p in n_tiles.items() for x in p])[F.col("dim")]
    spread_blocks = (blocks.withColumn("b_tile", F.pmod(F.xxhash64("block"), b_tiles).cast("int"))
                     .withColumn("q_tile", F.explode(F.sequence(F.lit(0), per_length(lambda n, a: -(-a // QUERIES)).cast("int") - 1))))
    key = ["dim", "b_tile", "q_tile"]

    def bounded(asked: DataFrame, all_above: bool) -> DataFrame:
        """Pairs of queries and blocks: those of the highest bounds, or all whose bound reaches the query's floor."""

        def pick(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(b):
                return pd.DataFrame({"dim": [], "query_id": [], "block": []}, dtype=np.int64)
            most = bounds(_stacked(q["v"]), _stacked(b["top"]), _stacked(b["low"]))
            if all_above:
                row, column = np.nonzero(most >= q["floor"].to_numpy()[:, None])
            else:
                column = np.argsort(-most, axis=1, kind="stable")[:, :SEEDS]
                row, column = np.repeat(np.arange(len(q)), column.shape[1]), column.ravel()
            return pd.DataFrame({"dim": np.full(len(row), b["dim"].iloc[0]), "query_id": q["query_id"].to_numpy()[row], "block": b["block"].to_numpy()[column]})

        dealt = asked.withColumn("b_tile", F.explode(F.sequence(F.lit(0), b_tiles - 1)))
        found = dealt.groupBy(*key).cogroup(spread_blocks.groupBy(*key)).applyInPandas(pick, "dim int, query_id long, block long")
        return found.distinct()  # rows that share an id ask for the same blocks

    def scored(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
            a, b, s = best_of_block(q["query_id"].to_numpy(), _stacked(q["v"]), q["floor"].to_numpy(), x["vec_id"].to_numpy(), _stacked(x["x"]), k)
            return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

        place = ["dim", "block", "q_tile"]
        wanted = pairs.select("dim", "block", q_tile("query_id")).distinct()
        return (pairs.join(asked, ["dim", "query_id"]).select(*place, "query_id", "v", "floor").groupBy(*place)
                .cogroup(data.select("dim", "block", "vec_id", F.col("v").alias("x")).join(wanted, ["dim", "block"]).groupBy(*place))
                .applyInPandas(meet, "query_id long, vec_id long, score long"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows a query and block
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    none = F.lit(-(1 << 63)).cast("long")
    seeds = written(bounded(asking, False), "seeds")
    first = written(ranked(scored(seeds, asking.withColumn("floor", none))), "first")
    floors = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    asked = written(asking.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", none)), "queries")
    rest = written(bounded(asked, True).join(seeds, ["dim", "query_id", "block"], "left_anti"), "rest")
    return ranked(first.drop("rank").unionByName(scored(rest, asked))), seeds.unionByName(rest)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k largest integer inner products of each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    ``queries`` marks the rows that ask; candidates are all rows but the query's own id. Rows with a null id or an unusable vector
    take no part; vectors of different lengths don't meet; empty vectors score 0. Ids are expected to be unique:
    each row of a repeated id is a candidate, and what they find as queries is ranked together. Products are 64-bit: components beyond about 2**31 / scale wrap.

    Blocks meet queries by equality joins on the block and a part of the queries, so a task holds one block and one part, whatever the input.
    """
    found = search(vectors, queries, k, scale)
    return found[0] if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
