from __future__ import annotations

import io
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageweave.functions.store import Conflict, Versions, put_if_absent, read_text
from pageweave.operators import waves
from pageweave.streaming import ingest

SCHEMA = "event_id long, value double"


def reader():
    def one(name, content):
        if content == b"nothing":
            return pd.DataFrame({"event_id": [], "value": []})
        return pd.read_parquet(io.BytesIO(content))

    return one


def fill(folder, n, start=0):
    folder.mkdir(exist_ok=True)
    for k in range(start, start + n):
        pd.DataFrame({"event_id": [10 * k, 10 * k + 1], "value": [0.5, float(k)]}).to_parquet(folder / f"f{k}.png")


def run(spark, tmp, **more):
    more = {"checkpoint": f"{tmp}/c", "files": 2} | more
    stream = ingest.watch_files(spark, f"{tmp}/in", more.pop("files"))
    return ingest.ingest_once(stream, f"{tmp}/status", more.pop("checkpoint"), ingest.each_file(reader(), SCHEMA), f"{tmp}/out", **more)


def statuses(spark, tmp):
    return {r["filename"]: r["status"] for r in ingest.processed(spark, f"{tmp}/status").collect()}


def test_broken_file_among_good_ones(spark, tmp_path):
    fill(tmp_path / "in", 3)
    (tmp_path / "in" / "broken.JPG").write_bytes(b"no image at all")
    (tmp_path / "in" / "empty.jpeg").write_bytes(b"nothing")
    (tmp_path / "in" / "notes.txt").write_bytes(b"not listed")
    assert ingest.drain(run(spark, tmp_path, files=10))
    got = statuses(spark, tmp_path)
    assert got.pop("broken.JPG").startswith("error: ArrowInvalid")
    assert got.pop("empty.jpeg") == "empty"
    assert got == {f"f{k}.png": "annotated" for k in range(3)}
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 6 and "broken.JPG" not in {r["filename"] for r in out.collect()}


def test_two_writers_on_one_folder(spark, tmp_path):
    """Both run at once from their own checkpoints; a third, later one, finds nothing left."""
    fill(tmp_path / "in", 12)
    runs = [run(spark, tmp_path, checkpoint=f"{tmp_path}/c{w}", claims_path=f"{tmp_path}/claims", writer=f"w{w}") for w in range(2)]
    assert all(ingest.drain(r) for r in runs)
    run(spark, tmp_path, checkpoint=f"{tmp_path}/c3", claims_path=f"{tmp_path}/claims", writer="w3").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["event_id"] for r in out.collect()) == sorted(10 * k + j for k in range(12) for j in (0, 1))
    assert ingest.processed(spark, f"{tmp_path}/status").count() == 12
    taken = ingest.claims(spark, f"{tmp_path}/claims")
    assert taken.count() == 12 and taken.select("filename").distinct().count() == 12


def test_writer_finds_its_claims_again(spark, tmp_path):
    fill(tmp_path / "in", 2)
    own = ingest.hashlib.sha256(b"me").hexdigest()[:16]
    assert ingest.claim_names(spark, f"{tmp_path}/claims", ["f0.png"], "w" + own) == {"f0.png"}
    ingest.claim_names(spark, f"{tmp_path}/claims", ["f1.png"], "somebody else")
    ingest.drain(run(spark, tmp_path, claims_path=f"{tmp_path}/claims", writer="me"))
    assert statuses(spark, tmp_path) == {"f0.png": "annotated"}


@pytest.mark.parametrize(("most", "drained", "files"), [(2, False, 4), (9, True, 7)])
def test_rounds(spark, tmp_path, most, drained, files):
    fill(tmp_path / "in", 7)
    assert ingest.drain(run(spark, tmp_path, max_batches=most)) is drained
    assert len(statuses(spark, tmp_path)) == files
    assert ingest.drain(run(spark, tmp_path))
    assert len(statuses(spark, tmp_path)) == 7 and spark.read.parquet(f"{tmp_path}/out").count() == 14


def test_polling_finds_later_files(spark, tmp_path):
    fill(tmp_path / "in", 1)
    query = run(spark, tmp_path, poll_seconds=0.5)
    try:
        query.processAllAvailable()
        fill(tmp_path / "in", 2, start=1)
        query.processAllAvailable()
        assert len(statuses(spark, tmp_path)) == 3
    finally:
        query.stop()


def test_totals_write_changed_files_only(spark, tmp_path):
    rows = spark.range(100).withColumn("k", F.col("id") % 4)
    for part in range(2):
        rows.filter(f"k div 2 = {part}").repartition("k").write.mode("append").partitionBy("k").parquet(f"{tmp_path}/in")
        stream = ingest.watch_dir(spark, f"{tmp_path}/in", "id long", 1)
        ingest.running_totals(stream, f"{tmp_path}/totals", f"{tmp_path}/c").awaitTermination()
        if not part:
            assert ingest.compact_totals(spark, f"{tmp_path}/totals") == 1
    each = [r["count"] for r in spark.read.parquet(f"{tmp_path}/totals/rounds").groupBy("batch").count().collect()]
    assert each == [1, 1, 1, 1]
    for _ in range(2):
        assert sorted(r["n"] for r in ingest.totals(spark, f"{tmp_path}/totals").collect()) == [25] * 4
        ingest.compact_totals(spark, f"{tmp_path}/totals")


def test_put_if_absent_has_one_winner(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/x")
    found = []
    threads = [threading.Thread(target=lambda k=k: found.append(put_if_absent(spark, f"file://{tmp_path}/x/place", f"writer {k}"))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(found) == 8 and set(found) == {read_text(spark, f"{tmp_path}/x/place")}


def test_versions(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/v", "id long")
    assert store.latest() == 0 and store.read().count() == 0
    assert store.commit(spark.range(3), 0, "three") == 1
    assert store.commit(spark.range(5), 1) == 2
    with pytest.raises(Conflict):
        store.commit(spark.range(9), 1)
    assert store.read().count() == 5 and store.read(1).count() == 3 and store.note(1) == "three"
