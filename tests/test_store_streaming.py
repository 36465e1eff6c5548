"""Fields on disk, streams over their events, and the library without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

from fieldledger.operators import chains
from fieldledger.plans import views
from fieldledger.schema import CUSTODY
from fieldledger.sources.store import Field
from fieldledger.streaming import events

from .conftest import DATA


def test_commit_is_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/field"
    field = Field(spark, path)
    row = {"actor_id": "a", "display_name": "A", "kind": "HUMAN", "created_at": "t"}
    field.append("actors", row)
    assert field.rows("actors", actor_id="a") == [row] and Field(spark, path).table("actors").count() == 0
    assert field.commit() == 1
    field.append("actors", row | {"actor_id": "b"})
    field.rollback()
    again = Field(spark, path)
    assert again.version == 1 and again.rows("actors") == [row]
    field.append("actors", row | {"actor_id": "c"})
    field.commit()
    again.append("actors", row)
    with pytest.raises(RuntimeError):
        again.commit()


def test_a_stream_that_starts_again_commits_no_batch_twice(spark, tmp_path):
    built = chains.build(views.chain(spark, DATA), CUSTODY).where("memory_id < 'm-000005'").persist()
    folder, path = f"{tmp_path}/events", f"file://{tmp_path}/field"
    built.coalesce(1).write.parquet(folder)
    field = Field(spark, path)
    events.into_field(events.read_events(spark, folder), field, f"{tmp_path}/at").awaitTermination()
    assert field.version == 1 and field.table("custody_chain").count() == built.count()
    again = Field(spark, path)
    assert again.commit_frames(once=(f"{tmp_path}/at", 0), custody_chain=built) == 1  # what a restart would send
    assert again.table("custody_chain").count() == built.count() and chains.verify(again.table("custody_chain"), CUSTODY).isEmpty()
    assert again.commit_frames(once=(f"{tmp_path}/at", 1), custody_chain=built.limit(0)) == 2


def test_streamed_verification_agrees(spark, tmp_path):
    built = chains.build(views.chain(spark, DATA), CUSTODY).where("memory_id < 'm-000020'")
    from pyspark.sql import functions as F

    forged = built.withColumn("reason", F.when((F.col("seq") == 2) & (F.col("memory_id") > "m-000010"), "forged").otherwise(F.col("reason")))
    folder = f"{tmp_path}/events"
    forged.where("seq < 2").coalesce(1).write.parquet(folder)
    forged.where("seq >= 2").coalesce(1).write.mode("append").parquet(folder)
    stream = events.faults(events.read_events(spark, folder))
    query = stream.writeStream.format("memory").queryName("faults").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {tuple(r) for r in spark.table("faults").collect()}
    wanted = {tuple(r) for r in chains.verify(forged, CUSTODY).collect()}
    assert found == wanted and found


def test_imports_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "fieldledger"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    copy = tmp_path / "fieldledger"
    copy.mkdir()
    for part in (root / "fieldledger").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (copy / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recall_topk_exact' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)}, check=True)
