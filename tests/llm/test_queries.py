import os

import duckdb
import pytest

from tarnweave.llm.oracles import judge_urls_sql
from tarnweave.llm.queries import ORACLES, QUERIES, URL_RULES
from tarnweave.llm.url_filter import LINK, judge_urls, rounds_for

SF = "/root/testdata/sf0.001"


def rows(frame):
    """Column names and rows of a DataFrame or a DuckDB relation, in order."""
    columns = sorted(frame.columns)
    found = frame.select(*columns).collect() if hasattr(frame, "toPandas") else frame.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    return columns, sorted(repr(tuple(r)) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(QUERIES[name](spark, SF)) == rows(con.sql(ORACLES[name]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_a_document(spark, name):
    got = QUERIES[name](spark, SF)
    of = "pages" if name == "op6_html_text" else "documents"
    if name != "op5_decontaminate":  # its rows are pairs
        assert got.count() == spark.read.parquet(f"{SF}/{of}.parquet").count()
    else:
        assert got.columns == ["doc_id", "item_id", "score", "begin", "end"] and got.where("score < 0.4 OR score > 1").count() == 0


def test_links_against_sql(spark):
    link = lambda *hosts: "".join(f"<a class=x href='//{h}/y'>t</a>" for h in hosts)
    data = [(k, f"http://{h}.{t}/{lang}/{k}", link(*[f"{(k * 7 + j) % 12}.org" for j in range(k % 4)])) for k, (h, t, lang) in enumerate((i % 12, "org" if i % 3 else "com", "en" if i % 5 else "es") for i in range(40))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    got = judge_urls(pages, URL_RULES).select("id", "host", "path", "rule", "verdict").withColumnRenamed("id", "page_id")
    assert rows(got) == rows(con.sql(judge_urls_sql(URL_RULES, LINK, rounds_for(0.85, 1e-6)))) and got.select("verdict").distinct().count() == 2
