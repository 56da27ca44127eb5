import json

from corridora.streaming import reports as stream

NOW = 10**12


def test_ingest_appends_once_and_restamps(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda **k: json.dumps({"from": "a", "to": "b", "feet": 100.0, "flights": 0, "seconds": 50.0, "at": NOW - 5} | k)
    (folder / "1.json").write_text("\n".join([row(), row(at=1), row(seconds=1.0), "{broken"]))
    go = lambda: stream.append_log(stream.cleaned(stream.read_stream(spark, str(folder)), NOW), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    go()
    (folder / "2.json").write_text(row(feet=200.0))
    go()
    rows = spark.read.parquet(f"{tmp_path}/log").collect()
    assert sorted((r.feet, r["at"]) for r in rows) == [(100, NOW - 5), (100, NOW), (200, NOW - 5)]


def test_walks_close(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    rows = [("a", "start", 1_000), ("a", "arrive", 61_000), ("b", "start", 2_000), ("c", "arrive", 5_000)]
    (folder / "1.json").write_text("\n".join(json.dumps({"walk_id": w, "kind": k, "at": t}) for w, k, t in rows))
    (folder / "2.json").write_text(json.dumps({"walk_id": "z", "kind": "start", "at": 20_000_000}))
    events = spark.readStream.schema("walk_id string, kind string, at long").option("maxFilesPerTrigger", 1).json(str(folder))
    q = stream.closed_walks(events).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.walk_id, r.started_at, r.ended_at, r.outcome) for r in spark.table("closed").collect()}
    # the clock of the second file has passed b's hour; z is still open
    assert got == {("a", 1_000, 61_000, "arrived"), ("b", 2_000, None, "expired")}


def test_a_walk_begun_again_or_late_expires_by_its_own_hour(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    files = [
        [("a", "start", 1_000), ("b", "start", 2_000), ("c", "start", 3_000)],
        [("a", "start", 3_000_000), ("c", "arrive", 3_100_000)],
        [("clock", "arrive", 3_900_000)],  # b's hour is over, a's begins later
        [("a", "arrive", 3_950_000)],
        [("clock", "arrive", 90_000_000)],
    ]
    for k, rows in enumerate(files):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"walk_id": w, "kind": kind, "at": t}) for w, kind, t in rows))
        events = spark.readStream.schema("walk_id string, kind string, at long").json(str(folder))
        stream.append_log(stream.closed_walks(events), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted((r.walk_id, r.started_at, r.ended_at, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 3_000_000, 3_950_000, "arrived"), ("b", 2_000, None, "expired"), ("c", 3_000, 3_100_000, "arrived")]
