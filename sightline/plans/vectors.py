"""Queries on vectors and retrieval metrics, over sightline.operators.vectors. Queries are the vectors whose id is divisible by 100, or centroids of the few labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.operators import vectors
from sightline.registry import query
from sightline.sources.tables import read

_COS = """list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))))"""
_RANKED = f"""sim AS (SELECT q.vec_id AS q, q.label AS ql, g.vec_id AS g, g.label AS gl, round({_COS.format(a="q.embedding", b="g.embedding")}, 9) AS s FROM embeddings q JOIN embeddings g ON q.vec_id % 100 = 0 AND g.vec_id <> q.vec_id AND q.vec_id % 5 <> g.vec_id % 5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rank FROM sim)"""


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label", "embedding")


def asked(rows: DataFrame) -> DataFrame:
    """The stated queries."""
    return rows.where("vec_id % 100 = 0")


def ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The first k vectors of other cameras (vec_id mod 5) of each query, from blocks: (q, ql, g, gl, s, rank)."""
    e = embeddings(spark, d)
    return vectors.ranked(vectors.compared(asked(e), e, k, 5), k)


def hit_measures(spark: SparkSession, d: str) -> DataFrame:
    """vectors.hit_measures of the queries among vectors of other cameras."""
    e = embeddings(spark, d)
    return vectors.hit_measures(asked(e), e, 5)


@query("W1 W2 W4 P17: cosine top k of each query", f"WITH {_RANKED} SELECT q, g, rank FROM ranked WHERE rank <= 20")
def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d, 20).select("q", "g", "rank")


@query("S20 W1 W4: the same first 20 by an index of cells, which skips those that can't hold any", f"WITH {_RANKED} SELECT q, g, round(s, 6) AS s, rank FROM ranked WHERE rank <= 20")
def indexed_top_k(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    found, _ = vectors.search_index(vectors.build_index(e), asked(e), 20, 5)
    return found.select("q", "g", F.round("s", 6).alias("s"), "rank")


@query(
    "S20: the cells of a vector index: vectors and bounds of each pivot, pivots being the vectors whose id is divisible by 25",
    f"""WITH p AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 25 = 0), s AS (SELECT e.vec_id, p.vec_id AS cell, round({_COS.format(a="e.embedding", b="p.embedding")}, 9) AS s FROM embeddings e, p),
own AS (SELECT vec_id, arg_max(cell, {{'s': s, 'p': -cell}}) AS cell, max(s) AS s FROM s GROUP BY vec_id) SELECT cell, count(*) AS n, round(min(s), 6) AS least, round(max(s), 6) AS most FROM own GROUP BY cell""",
)
def vector_index_cells(spark: SparkSession, d: str) -> DataFrame:
    own = vectors.pivot_cells(embeddings(spark, d), 25)
    return own.groupBy("cell").agg(F.count("*").alias("n"), F.round(F.min("s"), 6).alias("least"), F.round(F.max("s"), 6).alias("most"))


_ALL = f"""sim AS (SELECT q.vec_id AS q, g.vec_id AS g, round({_COS.format(a="q.embedding", b="g.embedding")}, 9) AS s FROM embeddings q JOIN embeddings g ON g.vec_id <> q.vec_id)"""


@query(
    "C20: k-reciprocal reranking: the expanded neighbour sets of all rows, half cosine and half Jaccard similarity, first 20 of each query",
    f"""WITH {_ALL}, near AS (SELECT q AS i, list(g ORDER BY s DESC, g)[1:7] AS near FROM sim GROUP BY q),
theirs AS (SELECT n.i, n.pos, o.near AS other FROM (SELECT i, unnest(near) AS j, generate_subscripts(near, 1) AS pos FROM near) n JOIN near o ON o.i = n.j),
sets AS (SELECT i, list_reduce(list_concat([any_value(own)], list(other ORDER BY pos)), lambda r, n: CASE WHEN 3 * len(list_intersect(r, n)) >= 2 * len(n) THEN list_distinct(list_concat(r, n)) ELSE r END) AS r FROM (SELECT t.*, near.near AS own FROM theirs t JOIN near USING (i)) GROUP BY i),
scored AS (SELECT q, g, s, len(list_intersect(a.r, b.r)) / len(list_distinct(list_concat(a.r, b.r)))::DOUBLE AS jaccard FROM sim JOIN sets a ON a.i = q JOIN sets b ON b.i = g WHERE q % 100 = 0),
r AS (SELECT *, round(0.5::DOUBLE * s + 0.5::DOUBLE * jaccard, 9) AS score FROM scored)
SELECT q, g, round(jaccard, 6) AS jaccard, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, g) AS rank FROM r) WHERE rank <= 20""",
)
def k_reciprocal(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return vectors.reranked(asked(e), e).select("q", "g", F.round("jaccard", 6).alias("jaccard"), F.round("score", 6).alias("score"), "rank")


@query(
    "J22 A33 A34 W19: cross-camera rank-1, rank-5 and mean average precision",
    f"""WITH {_RANKED}, h AS (SELECT *, sum((ql = gl)::INT) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM ranked),
p AS (SELECT q, min(rank) FILTER (ql = gl) AS first, sum(CASE WHEN ql = gl THEN hits / rank::DOUBLE END) / nullif(sum((ql = gl)::INT), 0) AS ap FROM h GROUP BY q)
SELECT round(avg((coalesce(first, 1000000) <= 1)::INT), 6) AS rank1, round(avg((coalesce(first, 1000000) <= 5)::INT), 6) AS rank5, round(avg(coalesce(ap, 0)), 6) AS map FROM p""",
)
def cross_camera_rank(spark: SparkSession, d: str) -> DataFrame:
    p = hit_measures(spark, d).select(F.get("ranks", F.lit(0)).alias("first"), "ap")
    within = lambda k: F.round(F.avg((F.coalesce("first", F.lit(1_000_000)) <= k).cast("int")), 6)
    return p.agg(within(1).alias("rank1"), within(5).alias("rank5"), F.round(F.avg(F.coalesce("ap", F.lit(0.0))), 6).alias("map"))


@query(
    "A31: hit rate, mean reciprocal rank and discounted gain in the first 20",
    f"""WITH {_RANKED}, t AS (SELECT * FROM ranked WHERE rank <= 20), p AS (SELECT q, min(rank) FILTER (ql = gl) AS first, sum((ql = gl)::INT / log2(rank + 1)) AS dcg FROM t GROUP BY q)
SELECT round(avg((first IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(dcg), 6) AS dcg FROM p""",
)
def hit_rate_mrr(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("ql") == F.col("gl")
    p = ranked(spark, d, 20).groupBy("q").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(hit.cast("int") / F.log2(F.col("rank") + 1)).alias("dcg"))
    return p.agg(F.round(F.avg(F.col("first").isNotNull().cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("dcg"), 6).alias("dcg"))


_CENTROIDS = """c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) AS t(i) GROUP BY label, i) GROUP BY label)"""


@query("W21: the three nearest other centroids of each label", f"WITH {_CENTROIDS}, s AS (SELECT a.label, b.label AS other, row_number() OVER (PARTITION BY a.label ORDER BY round({_COS.format(a='a.v', b='b.v')}, 9) DESC, b.label) AS rank FROM c a JOIN c b ON a.label <> b.label) SELECT label, other, rank FROM s WHERE rank <= 3")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    c = centroids(spark, d).select(F.col("label").cast("long").alias("vec_id"), "label", F.col("v").alias("embedding"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "g")).cast("long")
    return vectors.compared(c, c, 3).select(F.col("ql").alias("label"), F.col("gl").alias("other"), rank.alias("rank")).where("rank <= 3")


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """(label, v): the mean vector of each label."""
    mean = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


@query(
    "A36: the least similarity of two members of a label in different cameras, and whether it is below a limit",
    f"""WITH m AS (SELECT a.label, min(round({_COS.format(a='a.embedding', b='b.embedding')}, 9)) AS least FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 5 <> b.vec_id % 5 GROUP BY a.label)
SELECT label, round(least, 6) AS least, coalesce(least < 0.5, false) AS contaminated FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN m USING (label)""",
)
def contamination(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a label's members meet as matrices and give one row each. A label whose members are all in one camera has no pair."""
    e = embeddings(spark, d)
    sizes = e.groupBy("label").agg((F.count("*") / vectors.CELL + 1).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    groups = e.join(sizes, "label").groupBy("label", part.alias("part")).agg(F.collect_list(F.struct("vec_id", "label", "embedding")).alias("vs"))  # about CELL of them

    def work(vs: pa.StructArray, gs: pa.StructArray):
        (qi, ql, a), (gi, _, b) = vectors.unit_rows(vs), vectors.unit_rows(gs)
        s = vectors.similar(a, b)[vectors.allowed_pairs(qi, gi, 5)]
        if len(s):
            yield pa.RecordBatch.from_arrays([pa.array(ql[:1].astype(np.int32)), pa.array([float(s.min())])], names=["label", "s"])

    both = groups.join(groups.select("label", F.col("part").alias("other"), F.col("vs").alias("gs")), "label").where("part <= other").select("vs", "gs")
    least = both.mapInArrow(vectors._each(work), "label int, s double").groupBy("label").agg(F.min("s").alias("m"))
    return sizes.select("label").join(least, "label", "left").select("label", F.round("m", 6).alias("least"), F.coalesce(F.col("m") < 0.5, F.lit(False)).alias("contaminated"))


@query("W3 W20: the set of the seven nearest of each query, among vectors that have a label below five", f"WITH {_RANKED.replace('g.vec_id <> q.vec_id', 'g.label < 5 AND g.vec_id <> q.vec_id')} SELECT q, string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) AS near FROM ranked WHERE rank <= 7 GROUP BY q")
def neighbour_sets(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    s = vectors.ranked(vectors.compared(asked(e), e.where("label < 5"), 7, 5), 7)
    return s.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_set("g")), lambda x: x.cast("string")), ",").alias("near"))
