"""Distinct words without a regular expression a row, the same as with one; the set overlap reads texts once."""

from pyspark.sql import functions as F

from ledgerlark import catalog
from ledgerlark.functions.text import words_of
from ledgerlark.functions.words import distinct_words


def test_words_are_those_of_the_expression(spark):
    texts = ["the Bank the", "", None, "...", "a-b_C 9", "İzmir naïve", "bank", "y" * 70_000 + " " + "word " * 300_000, "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    want = {r.id: set(r.w) for r in df.select("id", words_of(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    got = distinct_words(df, "id", "text").collect()
    assert {r.id: set(r.w) for r in got} == want and all(len(r.w) == len(set(r.w)) for r in got)


def test_overlap_reads_texts_once(spark):
    plan = catalog.QUERIES["u06_set_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "parquet" not in plan.lower()
