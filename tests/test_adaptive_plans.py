"""Queries whose joins an adaptive plan turns from sorted into broadcast ones while they run, as on larger tables, against their SQL."""

import glob
import os

import duckdb
import pytest

from turnstile.operators import timeline
from turnstile.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
QUERY_NAMES = ["active_at", "ban_changes", "ban_count", "ban_expiry", "ban_table", "bans_jsonl", "blocklist_delta", "ban_gaps", "ban_timeline", "bans_by_country"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture
def turning(spark):
    """Parts are kept apart; joins are planned as sorted ones, and their sides turn out small enough to broadcast."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_query_equals_sql_when_joins_turn(turning, con, name):
    df, want = QUERIES[name](turning, SF), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def shuffled_rows(spark):
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_bans_and_instants_are_not_shuffled(turning):
    """Bans without an end and instants after them: each meets each, and only they themselves are dealt."""
    turning.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    bans = turning.range(300).selectExpr("concat('10.0.', id % 7, '.', id) AS ip", "'sshd' AS jail", "id AS banned_at", "CAST(NULL AS BIGINT) AS expires_at", "CAST(NULL AS BIGINT) AS ended_at")
    asked = turning.range(300).selectExpr("id AS k", "1000 + id DIV 2 AS t", "map('a', id) AS extra")
    before = shuffled_rows(turning)
    assert timeline.active_at_each(bans, asked).count() == 300 * 300
    assert shuffled_rows(turning) - before < 300 * 300 / 10
