"""The library source: balanced partitions, and a stream of what has changed."""

from __future__ import annotations

import os
import time

import pytest

from lumenframe.sources import library


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "lib"
    for k in range(6):
        (at / "one" / "deep" / f"d{k}" / "x").mkdir(parents=True)
        (at / "one" / "deep" / f"d{k}" / "x" / "a.jpg").write_bytes(b"a" * k)
        (at / "one" / "deep" / f"d{k}" / "b.MP4").write_bytes(b"b")
    for n in range(25):
        (at / "one" / f"{n}.gif").write_bytes(b"GIF89a")
    (at / "one" / ".hidden").mkdir()
    (at / "one" / ".hidden" / "c.jpg").write_bytes(b"c")
    (at / "one" / "pics.photoslibrary").mkdir()
    (at / "one" / "pics.photoslibrary" / "d.jpg").write_bytes(b"d")
    (at / "empty").mkdir()
    return str(at)


WANT = sorted([f"one/deep/d{k}/{f}" for k in range(6) for f in ("x/a.jpg", "b.MP4")] + [f"one/{n}.gif" for n in range(25)])


@pytest.mark.parametrize("splits, files", [(1, 20_000), (4, 10), (5, 20_000), (1000, 1), (1000, 7)])
def test_partitions_hold_each_file_once(root, splits, files):
    reader = library.LibraryReader({"path": root, "splits": str(splits), "files": str(files)})
    parts = reader.partitions()
    assert sorted(r[0] for p in parts for r in reader.read(p)) == WANT
    if splits == 5:  # the one deep folder is split
        assert len([p for p in parts if p.path.startswith("one/deep/")]) == 6
    if files < 10:
        assert max(sum(1 for _ in reader.read(p)) for p in parts) < 25


def test_scan_and_filters(spark, root):
    library.register(spark)
    df = spark.read.format("media_library").option("splits", "3").load(root)
    assert sorted(r["path"] for r in df.collect()) == WANT
    assert sorted(r["path"] for r in df.where("ext = '.mp4'").collect()) == [p for p in WANT if p.endswith("MP4")]


def test_empty_and_missing(spark, root, tmp_path):
    library.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("media_library").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("media_library").load(str(tmp_path / "nowhere")).count()


def test_stream_gives_what_changed(spark, root, tmp_path):
    library.register(spark)
    got = []

    def run():
        got.clear()
        df = spark.readStream.format("media_library").option("settle", "0").option("splits", "4").load(root)
        q = df.writeStream.foreachBatch(lambda b, _: got.extend(r["path"] for r in b.select("path").collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start()
        q.awaitTermination()
        return sorted(got)

    assert run() == WANT
    assert run() == []
    time.sleep(0.05)
    with open(f"{root}/one/3.gif", "ab") as f:
        f.write(b"more")
    with open(f"{root}/empty/new.jpg", "wb") as f:
        f.write(b"n")
    os.rename(f"{root}/one/4.gif", f"{root}/one/moved.gif")
    assert run() == ["empty/new.jpg", "one/3.gif", "one/moved.gif"]
