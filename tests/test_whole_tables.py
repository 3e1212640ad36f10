"""Queries without SQL read their whole tables."""

import json

from gridloom import queries

DATA = "/root/testdata/sf0.001"


def test_interp_cubic_of_every_user(spark):
    users = {r.user_id for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().collect()}
    assert {r.user_id for r in queries.QUERIES["interp_cubic"](spark, DATA).select("user_id").collect()} == users


def test_well_log_bundle_has_every_top(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert sum(len(json.loads(r.bundle)["tops"]) for r in queries.QUERIES["well_log_bundle"](spark, DATA).collect()) == events
