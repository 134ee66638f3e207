"""The cascade against its SQL, and its order."""

from __future__ import annotations

import duckdb
import pandas as pd

from voxframe.llm import quality

SF = "/root/testdata/sf0.001"
EDGES = [None, "", " \n\t ", "word", "a b c d e " * 40, "x\n\nx\n x\nx\n", "# * $ % & | < >", "ALL CAPS " * 12, "é ß ü " * 10, "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "tab\tvt\x0bff\x0ccr\rnbsp\xa0end " * 3, "w" * 5000 + " tail"]


def compared(spark, docs, frame):
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(quality.ORACLE).df()
    got = quality.report(docs).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = list(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_equals_sql_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    compared(spark, docs, docs.select("doc_id", "text").toPandas())


def test_equals_sql_on_edges(spark):
    docs = spark.createDataFrame([*enumerate(EDGES), (3, EDGES[3])], "doc_id long, text string")
    compared(spark, docs, docs.toPandas())


def test_empty_table_and_clashing_columns(spark):
    assert quality.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    row = quality.judged(spark.createDataFrame([(1, "a b", "mine", 9)], "doc_id long, text string, source string, n_words int")).first()
    assert (row["n_words"], row["source"], row["kept"]) == (2, "mine", False)


def test_every_order_gives_the_same_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    verdicts = {tuple(sorted((r["doc_id"], r["kept"]) for r in quality.judged(docs, trial).collect())) for trial in (quality.rules(), quality.rules()[::-1])}
    assert len(verdicts) == 1


def test_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "Python" not in quality.report(docs)._jdf.queryExecution().toString()


def test_filter_equals_the_verdict_and_makes_each_count_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"] for r in quality.report(docs).collect() if r["kept"]}
    good = quality.passing(docs.withColumn("n_words", quality.F.lit(99)))
    assert {r["doc_id"] for r in good.collect()} == want and {r["n_words"] for r in good.collect()} == {99}
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1 and plan.count("split(") == 2  # words and lines


def test_order_is_stable_and_counts_what_is_left(spark):
    docs = spark.createDataFrame([(k, "# " * 40 if k % 2 else f"plain words of a quiet text about {k} rivers and of the sea") for k in range(60)], "doc_id long, text string")
    orders = {tuple(r.name for r in quality.ordered(docs, trial)) for trial in (quality.rules(), quality.rules()[::-1]) for _ in range(2)}
    assert len(orders) == 1 and next(iter(orders))[0] == "symbols" and next(iter(orders))[-1] == "repeated_words"
    assert [r.name for r in quality.ordered(docs.limit(0), quality.rules())]
