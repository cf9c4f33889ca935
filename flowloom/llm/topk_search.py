"""Exact top-k inner-product search by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch

ROWS, QUERIES, LISTS = 4096, 256, 4
SAFE = 1 << 53


def _blocks(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """vectors (id long, vec) to rows (block, ids, cells, dim): up to `size` vectors each, as floor(scale * x) in doubles.

    Vectors that are null or hold null or non-finite components are left out.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 32

        def out(dim: int) -> pd.DataFrame:
            nonlocal made
            rows = held.pop(dim)
            made += 1
            return pd.DataFrame({"block": [made], "ids": [[i for i, _ in rows]], "cells": [np.stack([v for _, v in rows]).tobytes()], "dim": [dim]})

        for x in batches:
            for i, v in zip(x["id"], x["vec"], strict=True):
                if v is None:
                    continue
                v = np.array(v, np.float64)
                if not np.isfinite(v).all():
                    continue
                rows = held.setdefault(len(v), [])
                rows.append((i, np.floor(scale * v)))
                if len(rows) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return vectors.where("id is not null and vec is not null and not exists(vec, x -> x is null)").mapInPandas(work, "block long, ids array<long>, cells binary, dim int")


def _read(ids: np.ndarray, cells: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.asarray(ids, np.int64)
    return n, np.frombuffer(cells, np.float64).reshape(len(n), dim)


def _partials(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Exact inner products over each of LISTS runs of components: doubles where none can pass 2**53, else Python integers."""
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= SAFE:
        whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object)
        q, c = whole(q), whole(c)
    cuts = np.array_split(np.arange(q.shape[1]), LISTS)
    return [q[:, k] @ c[:, k].T if len(k) else np.zeros((len(q), len(c)), q.dtype) for k in cuts]


def _best(scores: np.ndarray, ids: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest masked scores, ties to smaller ids."""
    at = np.flatnonzero(mask)
    if len(at) > 4 * k and scores.dtype != object:
        cut = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= cut]
    return at[np.lexsort((ids[at], -scores[at]))][:k] if scores.dtype != object else np.array(sorted(at, key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _by_id(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id once, with its highest score."""
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1]))) if len(ids) else order
    return ids[order][starts], np.maximum.reduceat(scores[order], starts) if len(ids) else scores


def _clip(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def _met(queries: DataFrame, rows: DataFrame, spread: int) -> DataFrame:
    """Every block of queries with every block of rows of its dimension; the pairs are dealt evenly by both."""
    count = queries.agg(F.max("number")).first()[0] or 0
    left = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    right = rows.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int"))
    right = right.select("number", "salt", "dim", F.col("ids").alias("row_ids"), F.col("cells").alias("row_cells"))
    return left.join(right, ["number", "salt", "dim"])


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score: each query's k highest, all if there are fewer.

    Components count as floor(scale * x); the score is the inner product in exact
    integers (one beyond 64 bits is set to the nearest long). Ties go to smaller
    ids; a row of the query's own id is no candidate. Rows under one id, queries or
    candidates, count as one with the highest of their scores. Vectors null, of
    another length than the query, or with null or non-finite components, and rows
    without id take no part; is_query is a condition on id_col. Other columns are
    not used; an empty table gives an empty table.

    Components form LISTS lists, whose partial scores sum to the score, and rows
    blocks that hold whole vectors. Phase 1: each block sends its k best entries of
    each list with their scores; the k-th highest sent for a query is a safe cutoff.
    Phase 2: blocks get the cutoff and collect the entries that are at cutoff /
    LISTS or above in some list: no other can reach it. Phase 3: their remaining
    partial scores are added, and of those that reach the cutoff a block's k best are
    ranked with the other blocks'.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
    rows = scratch.save(_blocks(named, ROWS, scale))
    asked = scratch.save(_blocks(named.where("asks").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"), QUERIES, scale))
    # one small row for each block of queries: its number
    numbers = asked.select("block", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("block")).alias("number"))
    asked = scratch.save(asked.join(numbers, "block").drop("block"))
    spread = max(1, -(-4 * spark.sparkContext.defaultParallelism // max(1, asked.count())))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples():
                qi, q = _read(r.ids, r.cells, r.dim)
                ci, c = _read(r.row_ids, r.row_cells, r.dim)
                lists = _partials(q, c)
                total = sum(lists[1:], lists[0])
                out = []
                for i in range(len(qi)):
                    other = ci != qi[i]
                    seen = np.unique(np.concatenate([_best(p[i], ci, other, k) for p in lists])).astype(np.int64)
                    out += [(qi[i], ci[j], _clip(total[i, j])) for j in seen]
                yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples():
                qi, q = _read(r.ids, r.cells, r.dim)
                ci, c = _read(r.row_ids, r.row_cells, r.dim)
                cut = dict(zip(r.cut_ids, r.cuts, strict=True))
                lists = _partials(q, c)
                total = sum(lists[1:], lists[0])
                out = []
                for i in range(len(qi)):
                    least = cut.get(qi[i])
                    enough = ci != qi[i]
                    if least is not None:
                        enough &= np.logical_or.reduce([p[i] * LISTS >= least for p in lists])
                        enough &= total[i] >= least
                    ids, scores = _by_id(ci[enough], total[i, enough])
                    out += [(qi[i], ids[j], _clip(scores[j])) for j in _best(scores, ids, np.ones(len(ids), bool), k)]
                yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    fields = "query_id long, id long, score long"
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    met = _met(asked, rows, spread)
    sent = met.mapInPandas(first, fields).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    cuts = sent.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("query_id", F.col("score").alias("cut"))
    cuts = scratch.save(cuts)
    member = asked.select("number", "dim", F.explode("ids").alias("query_id")).distinct()
    told = member.join(cuts, "query_id").groupBy("number", "dim").agg(F.collect_list("query_id").alias("cut_ids"), F.collect_list("cut").alias("cuts"))
    with_cuts = asked.join(told, ["number", "dim"], "left").withColumn("cut_ids", F.coalesce("cut_ids", F.array().cast("array<long>"))).withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>")))
    found = _met(scratch.save(with_cuts), rows, spread).mapInPandas(second, fields).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
