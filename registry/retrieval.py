"""Dictionary, inverted index, search, ranking and precision / recall."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import registry.base  # noqa: F401
from pixelseek import views
from pixelseek.functions.codebooks import use_checkpoint_folder
from pixelseek.operators import postings as po
from pixelseek.operators import ranking as rk
from pixelseek.operators import relational as rel
from pixelseek.operators import words as wd
from pixelseek.plans import retrieval as jobs
from pixelseek.sources import index_store as st
from registry import r6, register


def _index(spark: SparkSession, sf: str, unique: bool = False) -> DataFrame:
    return jobs.build_index(views.histograms(spark, sf), views.words(spark, sf), unique_ids=unique)


def _search(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries, hits): class prototypes searched in the index; words and queries share one scan."""
    means = views.prototypes(spark, sf)
    words, queries = views.words(spark, sf, means), views.class_queries(spark, sf, means)
    index = jobs.build_index(views.histograms(spark, sf), words)
    return queries, jobs.search_index(queries, words, index)


def _probed(spark: SparkSession, sf: str) -> DataFrame:
    means = views.prototypes(spark, sf)
    words = views.words(spark, sf, means)
    asked = jobs.query_words(views.class_queries(spark, sf, means), words)
    return po.probe(asked, jobs.build_index(views.histograms(spark, sf), words))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    queries, hits = _search(spark, sf)
    return rk.rerank(hits, queries, views.histograms(spark, sf))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    queries, hits = _search(spark, sf)
    return jobs.ranked_hits(
        hits, queries, views.histograms(spark, sf), views.labels(spark, sf), without_self=False
    )


@register("x1_word_distances", "SELECT vec_id, word_id, round(dist, 6) AS dist FROM word_dist", "word_dist")
def x1(spark, sf):
    d = wd.word_distances(views.histograms(spark, sf), views.words(spark, sf))
    return d.select("vec_id", "word_id", r6("dist").alias("dist"))


@register(
    "p2_ragged_words",
    """SELECT h.vec_id, w.word_id, round(sum((h.x - w.x) * (h.x - w.x)), 6) AS dist
       FROM h JOIN words w ON h.i = w.i WHERE w.word_id > 0 GROUP BY h.vec_id, w.word_id""",
    "words",
)
def p2(spark, sf):
    """The word of class 0 is cut to half its length and an empty word is added: both are skipped."""
    words = views.words(spark, sf)
    cut = words.select(
        "word_id", F.when(F.col("word_id") == 0, F.slice("wv", 1, 32)).otherwise(F.col("wv")).alias("wv")
    )
    empty = words.select((F.max("word_id") + 1).cast("int").alias("word_id")).withColumn(
        "wv", F.array().cast("array<double>")
    )
    d = wd.word_distances(views.histograms(spark, sf), cut.unionByName(empty), "l2sq")
    return d.select("vec_id", "word_id", r6("dist").alias("dist"))


@register(
    "g3_distance_range",
    "SELECT vec_id, round(min(dist), 6) AS low, round(max(dist), 6) AS high FROM word_dist GROUP BY vec_id",
    "word_dist",
)
def g3(spark, sf):
    d = wd.word_distances(views.histograms(spark, sf), views.words(spark, sf))
    return d.groupBy("vec_id").agg(r6(F.min("dist")).alias("low"), r6(F.max("dist")).alias("high"))


@register(
    "v5_scaled_distances",
    "SELECT vec_id, word_id, round(weight, 6) AS weight FROM scaled",
    "scaled",
)
def v5(spark, sf):
    d = wd.word_distances(views.histograms(spark, sf), views.words(spark, sf))
    return wd.scaled_distances(d).select("vec_id", "word_id", r6("weight").alias("weight"))


@register("p4_soft_assign", "SELECT vec_id, word_id, round(weight, 6) AS weight FROM postings", "postings")
def p4(spark, sf):
    a = wd.soft_assign(views.histograms(spark, sf), views.words(spark, sf))
    return a.select("vec_id", "word_id", r6("weight").alias("weight"))


@register("i1_build_index", "SELECT word_id, vec_id, round(weight, 6) AS weight FROM postings", "postings")
def i1(spark, sf):
    return _index(spark, sf).select("word_id", "vec_id", r6("weight").alias("weight"))


@register("i1_build_index_large", "SELECT word_id, vec_id, round(weight, 6) AS weight FROM postings", "postings")
def i1_large(spark, sf):
    """The index as with a dictionary too large to ship."""
    index = jobs.build_index(views.histograms(spark, sf), views.words(spark, sf), max_bytes=0)
    return index.select("word_id", "vec_id", r6("weight").alias("weight"))


@register(
    "g1_posting_lists",
    """SELECT p.word_id, (('0x' || left(md5(p.vec_id::VARCHAR), 8))::BIGINT % b.blocks)::INTEGER AS block,
       count(*)::INTEGER AS n_docs, string_agg(p.vec_id::VARCHAR, ' ' ORDER BY p.vec_id) AS docs
       FROM postings p JOIN (SELECT word_id, ceil(count(*) / 100.0)::INTEGER AS blocks FROM postings
       GROUP BY word_id) b ON b.word_id = p.word_id GROUP BY 1, 2""",
    "postings",
)
def g1(spark, sf):
    lists = po.posting_lists(_index(spark, sf), list_docs=100)
    return lists.select(
        "word_id",
        "block",
        F.size("docs").alias("n_docs"),
        F.array_join(F.transform("docs", lambda d: d["vec_id"].cast("string")), " ").alias("docs"),
    )


@register(
    "x2_probe",
    "SELECT q.query_id, q.word_id, p.vec_id FROM query_words q JOIN postings p ON q.word_id = p.word_id",
    "query_words",
    "postings",
)
def x2(spark, sf):
    return _probed(spark, sf)


@register(
    "x2_probe_salted",
    "SELECT q.query_id, q.word_id, p.vec_id FROM query_words q JOIN postings p ON q.word_id = p.word_id",
    "query_words",
    "postings",
)
def x2_salted(spark, sf):
    """The probe with hot words spread over tasks."""
    words = _probed(spark, sf).select("query_id", "word_id").distinct()
    return rel.salted_join(_index(spark, sf).select("word_id", "vec_id"), words, "word_id", "vec_id", hot_rows=50).select(
        "query_id", "word_id", "vec_id"
    )


@register("g2_candidates", "SELECT query_id, vec_id FROM hits", "hits")
def g2(spark, sf):
    return po.candidates(_probed(spark, sf))


@register("u1_distinct_words", "SELECT DISTINCT word_id FROM postings", "postings")
def u1(spark, sf):
    return _index(spark, sf, unique=True).select("word_id").distinct()


@register("i2_search_index", "SELECT query_id, vec_id FROM hits", "hits")
def i2(spark, sf):
    return _search(spark, sf)[1]


def _stored(spark, sf):
    """(folder, query words): an index of the even images, to which the odd ones and some even ones are added."""
    folder = os.path.join(use_checkpoint_folder(spark), f"index-{uuid.uuid4().hex}")
    vectors, words, asked = views.histograms(spark, sf), views.words(spark, sf), views.class_queries(spark, sf)
    for part in ("vec_id % 2 = 0", "vec_id % 2 = 1 OR vec_id % 10 = 4"):
        st.append_postings(jobs.build_index(vectors.where(part), words), folder)
    return folder, jobs.query_words(asked, words)


@register("i2_stored_index", "SELECT query_id, vec_id FROM hits", "hits")
def i2_stored(spark, sf):
    """The same search on an index that was stored and added to."""
    folder, asked = _stored(spark, sf)
    return st.search_store(asked, folder)


@register("i1_merged_index", "SELECT word_id, vec_id, round(weight, 6) AS weight FROM postings", "postings")
def i1_merged(spark, sf):
    """The stored index after its segments were merged."""
    folder, _ = _stored(spark, sf)
    st.merge_segments(spark, folder)
    return st.read_postings(spark, folder).select("word_id", "vec_id", r6("weight").alias("weight"))


@register(
    "p3_nonblank",
    """SELECT word_id, vec_id FROM (SELECT word_id::VARCHAR AS word_id,
       CASE WHEN weight > 0 THEN vec_id::VARCHAR ELSE ' ' END AS vec_id FROM postings)
       WHERE length(trim(vec_id)) > 0""",
    "postings",
)
def p3(spark, sf):
    """Image ids of exact word matches are blanked, then blank ids are dropped."""
    rows = _index(spark, sf, unique=True).select(
        F.col("word_id").cast("string").alias("word_id"),
        F.when(F.col("weight") > 0, F.col("vec_id").cast("string")).otherwise(" ").alias("vec_id"),
    )
    return rel.nonblank(rows, "word_id", "vec_id")


@register(
    "x3_attach_labels",
    """SELECT n.vec_id, n.query_id, q.label AS query_label, h.label AS hit_label
       FROM (SELECT word_id::BIGINT AS query_id, vec_id FROM postings) n
       JOIN labels2 q ON q.vec_id = n.query_id JOIN labels2 h ON h.vec_id = n.vec_id""",
    "postings",
    "labels2",
)
def x3(spark, sf):
    pairs = _index(spark, sf, unique=True).select(F.col("word_id").cast("bigint").alias("query_id"), "vec_id")
    return rel.attach_labels(pairs, views.labels(spark, sf))


@register(
    "s15_shipped_labels",
    "SELECT p.word_id, l.label, count(*) AS n FROM postings p JOIN labels2 l USING (vec_id) GROUP BY 1, 2",
    "postings",
    "labels2",
)
def s15(spark, sf):
    met = rel.join_side(_index(spark, sf, unique=True), views.labels(spark, sf), "vec_id")
    return met.groupBy("word_id", "label").agg(F.count(F.lit(1)).alias("n"))


@register(
    "x4_exact_scores",
    "SELECT query_id, vec_id, round(dist, 6) AS dist FROM scored",
    "scored",
)
def x4(spark, sf):
    return _scored(spark, sf).select("query_id", "vec_id", r6("dist").alias("dist"))


@register(
    "w1_rank_hits",
    "SELECT query_id, rank::INTEGER AS rank, vec_id, round(dist, 6) AS dist FROM ranked",
    "ranked",
)
def w1(spark, sf):
    return rk.top_hits(_scored(spark, sf)).select("query_id", "rank", "vec_id", r6("dist").alias("dist"))


@register(
    "e1_rerank",
    "SELECT query_id, query_label, rank::INTEGER AS rank, vec_id, hit_label, round(dist, 6) AS dist FROM ranked",
    "ranked",
)
def e1(spark, sf):
    return _ranked(spark, sf).select(
        "query_id", "query_label", "rank", "vec_id", "hit_label", r6("dist").alias("dist")
    )


@register(
    "w2_cum_matches",
    "SELECT query_id, rank::INTEGER AS rank, matches::INTEGER AS matches FROM cum",
    "cum",
)
def w2(spark, sf):
    return rk.cum_matches(_ranked(spark, sf)).select("query_id", "rank", "matches")


@register(
    "p10_query_context",
    """SELECT t.query_id, q.label AS query_label, c.tp, c.tn, t.vec_id
       FROM (SELECT word_id::BIGINT AS query_id, vec_id FROM postings) t
       JOIN labels2 q ON q.vec_id = t.query_id,
       (SELECT count(*) FILTER (label = 1) AS tp, count(*) FILTER (label <> 1) AS tn FROM labels2) c""",
    "postings",
    "labels2",
)
def p10(spark, sf):
    pairs = _index(spark, sf, unique=True).select(F.col("word_id").cast("bigint").alias("query_id"), "vec_id")
    return rk.query_context(pairs, views.labels(spark, sf)).select("key.*", "vec_id")


@register("g6_class_counts", "SELECT label, count(*) AS n FROM labels2 GROUP BY label", "labels2")
def g6(spark, sf):
    return rk.class_counts(views.labels(spark, sf))


@register(
    "x7_recall_base",
    """SELECT l.vec_id, l.label, c.n AS class_size FROM labels2 l
       JOIN (SELECT label, count(*) AS n FROM labels2 GROUP BY label) c ON c.label = l.label""",
    "labels2",
)
def x7(spark, sf):
    labels = views.labels(spark, sf)
    sizes = rk.class_counts(labels).withColumnRenamed("n", "class_size")
    return rel.join_side(labels, sizes, "label").select("vec_id", "label", "class_size")


@register(
    "g7_pr_per_query",
    """SELECT query_id, k, query_label, round(precision, 6) AS precision, round(recall, 6) AS recall, vote
       FROM per_query""",
    "per_query",
)
def g7(spark, sf):
    at = rk.at_k(rk.cum_matches(_ranked(spark, sf)), rk.MAX_K, "clamp")
    rows = rk.pr_per_query(at, rk.class_counts(views.labels(spark, sf)))
    return rows.select(
        "query_id", "k", "query_label", r6("precision").alias("precision"), r6("recall").alias("recall"), "vote"
    )


_CURVE = """SELECT k, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
            round(avg(CASE WHEN vote = query_label THEN 1 ELSE 0 END), 6) AS accuracy
            FROM per_query GROUP BY k"""


def _curve(df: DataFrame) -> DataFrame:
    return df.select("k", *[r6(c).alias(c) for c in ("precision", "recall", "accuracy")])


@register("g8_pr_curve", _CURVE, "per_query")
def g8(spark, sf):
    at = rk.at_k(rk.cum_matches(_ranked(spark, sf)), rk.MAX_K, "clamp")
    return _curve(rk.pr_curve(rk.pr_per_query(at, rk.class_counts(views.labels(spark, sf)))))


@register("e2_pr_curve", _CURVE, "per_query")
def e2(spark, sf):
    """Search, exact re-ranking and report with one scan of the vectors."""
    means = views.prototypes(spark, sf)
    curve = jobs.search_report(
        views.class_queries(spark, sf, means),
        views.words(spark, sf, means),
        views.histograms(spark, sf),
        views.labels(spark, sf),
        without_self=False,
    )
    return _curve(curve)


@register("e2_large_dictionary", _CURVE, "per_query")
def e2_large(spark, sf):
    """The report as with a dictionary too large to ship: through the index."""
    means = views.prototypes(spark, sf)
    queries, words = views.class_queries(spark, sf, means), views.words(spark, sf, means)
    vectors, labels = views.histograms(spark, sf), views.labels(spark, sf)
    best = jobs.search_and_rank(queries, words, vectors, rk.MAX_K, without_self=False, max_bytes=0)
    return _curve(jobs.report(best, queries, labels, rk.MAX_K))


@register("e2_pr_of_hits", _CURVE, "per_query")
def e2_hits(spark, sf):
    """The same report from a table of hits."""
    queries, hits = _search(spark, sf)
    return _curve(
        jobs.pr_report(hits, queries, views.histograms(spark, sf), views.labels(spark, sf), without_self=False)
    )


@register(
    "s7_k_grid",
    "SELECT k, n FROM k_grid, (SELECT count(*) AS n FROM embeddings)",
    "k_grid",
)
def s7(spark, sf):
    """The grid beside the number of images that it ranks."""
    size = views.embeddings(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return rk.k_grid(spark).withColumn("n", size.scalar())
