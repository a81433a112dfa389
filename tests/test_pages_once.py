"""Pages are fetched and parsed once per sync, however many steps look at them."""

from pyspark.sql import functions as F

from larder import model
from larder.operators.upsert import LEDGER, sync_new_pages
from larder.sources.pages import fetched_pages
from tests.test_upsert import as_of

TOKEN = '{"reviews":[],"next_page_token":"more"}'


def _counted(spark, pages):
    """Pages whose bodies count how often they are worked out."""
    calls = spark.sparkContext.accumulator(0)

    def seen(body):
        calls.add(1)
        return body

    return pages.withColumn("body", F.udf(seen).asNondeterministic()("body")), calls


def test_fetched_pages(spark):
    rows = [("a", 0, TOKEN), ("a", 1, "{}"), ("a", 2, TOKEN), ("b", 0, "no JSON")]
    pages, calls = _counted(spark, spark.createDataFrame(rows, "key string, page_index int, body string"))
    got = fetched_pages(pages, "key", 10)
    assert sorted(map(tuple, got.select("key", "page_index", "source_failed").collect())) == [("a", 0, False), ("a", 1, False), ("b", 0, True)]
    assert sorted(r.body for r in got.collect()) == sorted(["{}", TOKEN, "no JSON"])
    assert calls.value == 4


def test_synced_pages(spark):
    places = spark.createDataFrame([("1", "0x1")], "id string, serpapi_data_id string")
    places = model.conform(places, model.PLACES)
    body = '{"reviews":[{"review_id":"r1","rating":5,"user":{"name":"A"}}]}'
    landed, calls = _counted(spark, spark.createDataFrame([("0x1", 0, body)], "target_id string, page_index int, body string"))
    stored, ledger = spark.createDataFrame([], model.EXT_REVIEWS), spark.createDataFrame([], LEDGER)
    done = sync_new_pages(places, landed, stored, ledger, as_of())
    assert [r.status for r in done.outcomes.collect()] == ["imported"]
    assert done.applied.count() == 1
    assert calls.value == 1
