import pytest

from tests.oracle import assert_same, connect
from tidelog import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(core.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert_same(core.queries()[name](spark, SF), duck, core.oracle_sql()[name])


def test_damage_in_every_run(spark, duck, monkeypatch):
    monkeypatch.setattr("tidelog.sources.runs.RANGE_BYTES", 1024)  # several runs
    assert_same(core.queries()["kv_store_damaged"](spark, SF), duck, core.oracle_sql()["kv_store_damaged"])


def test_hourly_in_slices(spark, duck, monkeypatch):
    monkeypatch.setattr("tidelog.streaming.ingest.REPLAY_ROWS", 300, raising=False)
    assert_same(core.queries()["kv_stream_hourly"](spark, SF), duck, core.oracle_sql()["kv_stream_hourly"])
    # no result is held by the driver
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("hourly")]
