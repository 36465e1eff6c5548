"""Streams in any order, and activity by windows."""

import time

from fieldledger.operators import chains
from fieldledger.plans import chains as plans
from fieldledger.plans import views
from fieldledger.schema import CUSTODY
from fieldledger.streaming import events, following
from pyspark.sql import functions as F

from .conftest import DATA


def run(stream, name, at, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def test_any_order_gives_the_verdict_of_the_batch(spark, tmp_path):
    built = plans.forged_chain(spark, DATA).where("memory_id < 'm-000030'").select([f.name for f in events.TABLES["custody_chain"].fields])
    wanted = {tuple(r) for r in chains.verify(built, CUSTODY).collect()}
    assert len({e for _, _, e in wanted}) == 10
    folder = f"{tmp_path}/events"
    # dealt over files by a hash, so that events come long before what they follow
    for part in range(5):
        built.where(F.pmod(F.xxhash64("memory_id", "seq"), F.lit(5)) == part).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", following.PROVIDER)
    stream = following.faults_in_any_order(events.read_events(spark, folder, 1), 25_000)
    query = stream.writeStream.format("memory").queryName("any_order").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="0 seconds").start()
    try:
        deadline = time.time() + 200
        found = set()
        while len(found) < len(wanted) and time.time() < deadline and query.isActive:  # gaps are told when they have been open for long enough
            time.sleep(2)
            found = {tuple(r) for r in spark.table("any_order").collect()}
        assert query.exception() is None and found == wanted
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_activity_by_windows(spark, tmp_path):
    chain = chains.build(views.chain(spark, DATA), CUSTODY).where("memory_id < 'm-000010'").select([f.name for f in events.TABLES["custody_chain"].fields])
    last = chain.agg(F.max("created_at")).first()[0]
    folder = f"{tmp_path}/events"
    chain.coalesce(1).write.parquet(folder)
    run(events.activity(events.read_events(spark, folder), "1 day", "6 hours"), "busy", f"{tmp_path}/at")
    timed = chain.withColumn("at", F.to_timestamp("created_at", events.TS_FORMAT))
    counted = timed.groupBy(F.window("at", "6 hours"), "actor_id", "event_type").agg(F.count("*").alias("n"))
    closed = counted.where(F.col("window.end") <= F.to_timestamp(F.lit(last), events.TS_FORMAT) - F.expr("INTERVAL 1 DAY"))
    assert {str(r) for r in spark.table("busy").collect()} == {str(r) for r in closed.collect()} and closed.count()
