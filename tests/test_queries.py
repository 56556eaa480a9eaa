"""Every registered query against its SQL twin."""

import os
import re

import pytest
from conftest import DATA

import __spark_entry__ as entry_point
import oracle

FOLDER = os.path.join(DATA, os.environ.get("METROSIFT_TEST_SF", "sf0.01"))
QUERIES, SQL = ({k: v for k, v in found.items() if not re.match(r"op\d+_|pipeline$", k)}
                for found in (entry_point.queries(), entry_point.oracle_sql()))
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(FOLDER)


def test_every_twin_has_a_query():
    assert SQL.keys() <= QUERIES.keys()
    assert QUERIES.keys() - SQL.keys() == {"content_digest", "provenance_ids"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), tables, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_other_queries_give_rows(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()


def test_stream_cap_equals_batch_cap(spark):
    """The stream decides what the watermark has passed; there it agrees with the batch form."""
    columns = ["user_id", "event_id", "accepted"]
    batch = QUERIES["attempt_cap_exact"](spark, FOLDER).select(columns)
    stream = QUERIES["stream_attempts"](spark, FOLDER).select(columns)
    assert stream.exceptAll(batch).isEmpty() and 0 < batch.count() - stream.count() < 20
