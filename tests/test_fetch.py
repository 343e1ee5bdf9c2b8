from __future__ import annotations

import gzip
import io
import urllib.error

import pytest
from pyspark.sql import functions as F

from tessera.operators import datastore as ds
from tessera.operators import sampling as sa
from tessera.sources.fetch import Fetcher


class Answer(io.BytesIO):
    pass


def fetcher(answers, slept):
    def opener(request, timeout):
        answer = answers.pop(0)
        if isinstance(answer, int):
            raise urllib.error.HTTPError(request.full_url, answer, "", {}, None)
        if isinstance(answer, Exception):
            raise answer
        return Answer(answer)

    return Fetcher("tests", opener=opener, sleep=slept.append, clock=lambda: 0.0, retries=3)


def test_retries_and_gzip():
    slept: list[float] = []
    f = fetcher([503, urllib.error.URLError("down"), gzip.compress(b"body")], slept)
    assert f.get("http://x/") == b"body"
    assert slept == [1.0, 0.25, 2.25, 0.25]
    assert f.open and fetcher([b"plain"], []).get("http://x/") == b"plain"


@pytest.mark.parametrize("answers", [[404], [500] * 4])
def test_gives_up(answers):
    with pytest.raises(urllib.error.HTTPError):
        fetcher(list(answers), []).get("http://x/")


def test_small_operators(spark):
    sample = spark.createDataFrame([(f"f{i % 4}",) for i in range(20)], "form string")
    assert not sa.needs_refresh(sample).first()[0] and sa.needs_refresh(sample.limit(19)).first()[0] and sa.needs_refresh(sample.withColumn("form", F.lit("x"))).first()[0]
    current = spark.createDataFrame([("e", "tender_offer", "ticker", "ABC"), ("e", "tender_offer", "cusip", None)], "event_id string, event_type string, field_name string, value_text string")
    assert ds.notification_drafts(current).first().payload == '{"event_id":"e","event_type":"tender_offer","fields":{"cusip":null,"ticker":"ABC"}}'
