"""Physical plans of the operators that must not shuffle, or only what they keep."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pixelseek import views
from pixelseek.operators import postings as po
from pixelseek.operators import quantizer as pq
from pixelseek.operators import ranking as rk
from pixelseek.operators import words as wd
from pixelseek.plans import quantized as jobs
from tests.oracle import plan

SF_DIR = "/root/testdata/sf0.001"


def test_soft_assignment_is_narrow(spark):
    df = wd.soft_assign(views.histograms(spark, SF_DIR), views.words(spark, SF_DIR))
    assert "Exchange" not in plan(po.postings(df, unique_ids=True))
    assert plan(po.postings(df)).count("Exchange") == 1


def test_encoding_is_narrow_and_reads_two_columns(spark):
    v = views.vectors(spark, SF_DIR)
    centers = jobs.fit_pq(v, 8, 4, max_iter=2)
    text = plan(pq.encode(v, centers))
    assert "Exchange" not in text
    assert re.search(r"ReadSchema: struct<vec_id:bigint,embedding:array<float>>", text)


@pytest.mark.parametrize("k", [10, 5000])
def test_ranking_is_cut_before_the_shuffle(spark, k):
    scored = spark.range(100_000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("vec_id"), F.rand(1).alias("dist"))
    text = plan(rk.top_hits(scored, k))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_search_ships_no_pairs(spark):
    v = views.vectors(spark, SF_DIR)
    centers = jobs.fit_pq(v, 8, 4, max_iter=2)
    asked = v.select(F.col("vec_id").alias("query_id"), "vec")
    text = plan(jobs.search_pq(asked, pq.encode(v, centers), centers, 5))
    assert "Join" not in text and text.count("Exchange") == 1


def test_scoring_shuffles_images_once(spark):
    import registry.imaging
    from registry import QUERIES

    text = plan(QUERIES["c7_score_network"](spark, SF_DIR))
    assert registry.imaging and len(re.findall(r"Exchange hashpartitioning\((?:image_id|vec_id)", text)) <= 1


def test_search_in_blocks_copies_neither_side(spark):
    v = views.vectors(spark, SF_DIR)
    centers = jobs.fit_pq(v, 8, 4, max_iter=2)
    asked = v.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), "vec")
    text = plan(jobs.search_pq(asked, pq.encode(v, centers), centers, 5, max_bytes=1 << 12))
    assert "Generate" not in text and "Join" not in text and text.count("Exchange") == 1 and "Union" not in text


def test_package_reaches_workers_from_any_folder(tmp_path):
    """A session started elsewhere runs an Arrow query."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", "{root}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["p4_soft_assign"](spark, "{SF_DIR}").count())
"""
    env = {k: x for k, x in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows " in done.stdout, done.stderr[-1500:]
