"""Ranking and picking: global ranks, searches, first rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from .numbering import placed


def scored(candidates: DataFrame, queries: list[str], providers: Column, citations: Column, has_pdf: Column, expanded: Column, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """[F-13, F-14, A-07] candidates with score."""
    sets = F.filter(F.array(*[T.query_terms(F.lit(q)) for q in queries]), lambda t: F.size(t) > 0)
    folded = lambda c: T.fold_case(F.coalesce(F.col(c), F.lit("")))
    cover = lambda c: T.coverage(folded(c), sets)
    return candidates.withColumn("score", T.relevance(cover(title), cover(abstract), providers, citations, F.coalesce(F.col(abstract), F.lit("")) != "", has_pdf, expanded))


def global_rank(rows: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """[W-01, O-01] rows with their place in falling order of a score, ties by a key, from 1."""
    return placed(rows, [], [F.desc(score), F.col(tie)], name)


def top(rows: DataFrame, order: list[Column], n: int, skip: int = 0) -> DataFrame:
    """[O-02, O-03] A page of rows in order."""
    return rows.orderBy(*order).offset(skip).limit(n)


def preferred(rows: DataFrame, key: str, value: str, ranking: list[str], tie: str) -> DataFrame:
    """[O-06, O-07] For each key the row whose value stands first in a ranking; values outside it come last."""
    place = F.coalesce(*[F.when(F.col(value) == v, i) for i, v in enumerate(ranking)], F.lit(len(ranking)))
    first = F.row_number().over(Window.partitionBy(key).orderBy(place, tie))
    return rows.withColumn("n_", first).where("n_ = 1").drop("n_")


def search(docs: DataFrame, needle: str, key: str, text: str = "text", limit: int | None = 20, context: int = 40) -> DataFrame:
    """[O-08] (key, position, snippet): the first place in each text, letters of either case, with what stands around it; in order of key."""
    low = F.position(F.lit(needle.lower()), F.lower(F.col(text)))
    hits = docs.select(key, low.alias("position"), F.col(text).alias("t")).where("position > 0")
    start = F.greatest(F.col("position") - context, F.lit(1))
    length = F.col("position") + len(needle) + context - start
    out = hits.select(key, "position", F.substr("t", start, length).alias("snippet"))
    return out if limit is None else out.orderBy(key).limit(limit)


def one_per_query(ranked: DataFrame, query: str = "query", rank: str = "rank", key: str = "id") -> DataFrame:
    """[W-03] The best row of each query; a row that stands for several queries counts once, for the first of them."""
    best = ranked.withColumn("n_", F.row_number().over(Window.partitionBy(query).orderBy(rank))).where("n_ = 1")
    once = F.row_number().over(Window.partitionBy(key).orderBy(rank, query))
    return best.withColumn("m_", once).where("m_ = 1").drop("n_", "m_")


def representatives(ranked: DataFrame, n: int, query: str = "query", rank: str = "rank", key: str = "id", order: str = "query_ord", most: int = 10_000) -> DataFrame:
    """[W-03] (pick, id, query): for each query in its order the best row not picked before, then the best of all others, n in all; query is null
    for these.

    Queries pick in rounds, all at once: each query without a row proposes the best row that has not refused it, a row keeps the earliest of
    the queries that want it and refuses the others, also one it had kept. What holds in the end is what picking in turn gives. The number of
    jobs follows the rounds, which are as many as the longest chain of refusals, not the queries. ranked (query, order, rank, id).
    """
    rows = ranked.select(F.col(query).alias("query"), F.col(order).alias("turn"), F.col(rank).alias("rank"), F.col(key).alias("id")).distinct()
    wishes = stored(placed(rows, ["query"], [F.col("rank"), F.col("id")]).select("query", "turn", "id", "place"), "wishes")
    asking = wishes.where("place = 1")
    kept = asking.limit(0)
    for _ in range(most):
        best = Window.partitionBy("id").orderBy("turn", "query")
        judged = stored(kept.union(asking).withColumn("n_", F.row_number().over(best)), "judged")
        kept = judged.where("n_ = 1").drop("n_")
        refused = judged.where("n_ > 1").select("query", (F.col("place") + 1).alias("place"))
        asking = stored(wishes.join(refused, ["query", "place"]).select(*wishes.columns), "asking")
        if asking.isEmpty():
            break
    else:
        raise RuntimeError("representatives: no end within the given rounds")
    first = placed(kept, [], [F.col("turn"), F.col("query")], "by").select("id", "query", F.lit(0).alias("fill"), "by")
    rest = rows.groupBy("id").agg(F.min("rank").alias("rank")).join(kept.select("id"), "id", "left_anti")
    fill = placed(rest, [], [F.col("rank"), F.col("id")], "by").select("id", F.lit(None).cast(dict(rows.dtypes)["query"]).alias("query"), F.lit(1).alias("fill"), "by")
    chosen = stored(first.union(fill).orderBy("fill", "by", "id").limit(n), "chosen")
    return placed(chosen, [], [F.col("fill"), F.col("by"), F.col("id")], "pick").select("pick", "id", "query")
