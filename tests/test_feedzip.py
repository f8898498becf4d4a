"""The archive data source: faults, headers, and a round trip through written archives."""

import zipfile

from wayfold.sources import feedzip


def archive(folder, name, **tables):
    with zipfile.ZipFile(folder / name, "w") as z:
        for table, text in tables.items():
            z.writestr(f"{table}.txt", text)


def test_rows_and_faults(spark, tmp_path):
    archive(tmp_path, "a.zip", trips="﻿route_id, service_id ,trip_id\nr1,s1,t1\n\n,,\nr2,s2\nr3,s3,t3,more\n\"r,4\",\"s\n4\",t4\n")
    archive(tmp_path, "b.zip", trips="route_id,route_id,trip_id\n")
    archive(tmp_path, "c.zip", stops="stop_id\n1\n")
    (tmp_path / "d.zip").write_bytes(b"no archive")
    (tmp_path / "note.txt").write_text("not read")
    rows = feedzip.read(spark, str(tmp_path), "trips", ["trip_id", "service_id", "other"], faults=True).collect()
    got = {(r._feed, r._line, r._fault, r.trip_id, r.service_id, r.other) for r in rows}
    assert got == {
        ("a.zip", 2, None, "t1", "s1", None), ("a.zip", 5, "ragged", None, "s2", None), ("a.zip", 6, "ragged", "t3", "s3", None), ("a.zip", 8, None, "t4", "s\n4", None),
        ("b.zip", 1, "missing_column:service_id", None, None, None), ("b.zip", 1, "repeated_column", None, None, None), ("b.zip", 1, "no_rows", None, None, None),
        ("c.zip", 0, "missing_table", None, None, None), ("d.zip", 0, "unreadable", None, None, None),
    }
    good = feedzip.read(spark, f"{tmp_path}/a.zip,{tmp_path}/c.zip", "trips", ["trip_id"])
    assert sorted((r.trip_id or "") for r in good.collect()) == ["", "t1", "t3", "t4"]


def test_each_archive_is_a_partition_and_batches_are_bounded(spark, tmp_path, monkeypatch):
    for k in range(3):
        archive(tmp_path, f"{k}.zip", stops="stop_id\n" + "".join(f"{k}-{i}\n" for i in range(25)))
    monkeypatch.setattr(feedzip, "BATCH_ROWS", 10)
    reader = feedzip.FeedReader(str(tmp_path), "stops", ["stop_id", "_feed"])
    parts = reader.partitions()
    assert [p.archive[-5:] for p in parts] == ["0.zip", "1.zip", "2.zip"]
    assert [b.num_rows for b in reader.read(parts[0])] == [10, 10, 5]
    assert feedzip.read(spark, str(tmp_path), "stops", ["stop_id"]).count() == 75


def test_written_archives_are_read_again(spark, tmp_path):
    rows = [("x.zip", f"s{i}", 'quo"ted, text' if i % 3 else "") for i in range(50)] + [("y.zip", "é\n", "last")]
    df = spark.createDataFrame(rows, "feed string, stop_id string, stop_name string")
    told = {r.feed: r.rows for r in feedzip.write_archives(df, "feed", "stops", f"file:{tmp_path}/out").collect()}
    assert told == {"x.zip": 50, "y.zip": 1}
    got = feedzip.read(spark, f"file:{tmp_path}/out", "stops", ["stop_id", "stop_name"]).collect()
    assert sorted((r._feed, r.stop_id, r.stop_name) for r in got) == sorted(rows)
