"""Catalogue queries return as much as the operation they stand for."""

import datetime

import pyarrow.parquet as pq
from compare import compare, duck

from weblode.plans.catalog import ORACLES, QUERIES

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def pages_of_one_job(spark, folder):
    """1,000 pages of one job, most of them stored."""
    html = "<html><head><title>t</title></head><body>text</body></html>"
    rows = [(4 * i, f"https://h.example.com/p/{i}", html) for i in range(1000)]
    pq.write_table(spark.createDataFrame(rows, "page_id bigint, url string, html string").toArrow(), folder / "pages.parquet")


def agreed(spark, name, folder):
    """Rows of a query, which must be those of its SQL twin."""
    assert compare(spark, duck(folder), name, QUERIES[name], ORACLES[name], str(folder)) == ""
    return QUERIES[name](spark, str(folder)).collect()


def test_next_batch_is_ten_urls_of_a_job(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), 4 * i if i < 15 else 4 * i + 1, "signup", 1.0, '{"k": 0}') for i in range(22)]
    pq.write_table(spark.createDataFrame(rows, EVENT).toArrow(), tmp_path / "events.parquet")
    got = agreed(spark, "frontier_next_batch", tmp_path)
    assert sorted(r.job_id for r in got) == ["job-0"] * 10 + ["job-1"] * 7


def test_graph_has_the_first_500_pages_of_a_job(spark, tmp_path):
    pages_of_one_job(spark, tmp_path)
    assert len(agreed(spark, "graph_nodes", tmp_path)) == 500


def test_edges_of_the_graph_lead_to_the_same_pages(spark, tmp_path):
    pages_of_one_job(spark, tmp_path)
    nodes = {r.id for r in agreed(spark, "graph_nodes", tmp_path)}
    edges = agreed(spark, "graph_edges", tmp_path)
    assert {r.target for r in edges} <= nodes and len(edges) > 300  # two pages of nine have no parent but themselves
