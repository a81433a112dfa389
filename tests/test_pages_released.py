"""Bodies of pages can go once the new table is written; all else of a sync stays readable."""

import os

from larder import model
from larder.operators.upsert import LEDGER, sync_new_pages
from larder.session import cut_lineage
from larder.staging import release
from tests.test_upsert import as_of


def test_pages_are_released_after_the_table(spark):
    places = model.conform(spark.createDataFrame([("1", "0x1")], "id string, serpapi_data_id string"), model.PLACES)
    body = '{"reviews":[{"review_id":"r1","rating":5,"user":{"name":"A"}}]}'
    landed = spark.createDataFrame([("0x1", 0, body)], "target_id string, page_index int, body string")
    done = sync_new_pages(places, landed, spark.createDataFrame([], model.EXT_REVIEWS), spark.createDataFrame([], LEDGER), as_of())
    table = cut_lineage(done.table, "zstd")
    release(done.pages)
    assert not os.path.exists(done.pages._staged_path)
    assert [r.provider_review_id for r in table.collect()] == ["r1"]
    assert [r.status for r in done.outcomes.collect()] == ["imported"]
    assert (done.parsed.count(), done.applied.count(), done.ledger.count()) == (1, 1, 1)
