from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from lumenframe.functions import inventory as I
from lumenframe.functions import measures as M
from lumenframe.operators import caches, library, timeline, validation
from lumenframe.sources import library as source
from lumenframe.sources import state


def video(**x):
    return {"index": 0, "codec_type": "video", "codec_name": "h264", "pix_fmt": "yuv420p"} | x


def audio(**x):
    return {"index": 1, "codec_type": "audio", "codec_name": "aac"} | x


def inventories(spark, cases):
    rows = [(k, json.dumps({"streams": s, **(rest[0] if rest else {})}) if s is not None else "broken") for k, (s, *rest) in cases.items()]
    return state.inventories(spark.createDataFrame(rows, "name string, text string"))


def test_statuses(spark):
    cases = {
        "standard": ([video(), audio()],),
        "silent": ([video(pix_fmt="yuvj420p")],),
        "hevc": ([video(codec_name="hevc"), audio()],),
        "copy-video": ([video(), audio(codec_name="pcm")],),
        "convert vp9": ([video(codec_name="vp9"), audio(codec_name="opus")],),
        "convert 422": ([video(pix_fmt="yuv422p")],),
        "convert none": ([audio()],),
        "convert broken": (None,),
        "convert cover": ([video(disposition={"attached_pic": 1})],),
    }
    df = inventories(spark, cases).select("name", I.stream_status(F.col("inventory")).alias("s"), I.mp4_status(F.col("inventory")).alias("m"))
    got = {r["name"]: (r["s"], r["m"]["status"], r["m"]["reason"]) for r in df.collect()}
    for name, (s, _, _) in got.items():
        assert s == ("standard" if name == "silent" else name.split(" ")[0]), name
    assert got["copy-video"][2] == "audio is pcm, not AAC"
    assert got["convert broken"][2] == "FFmpeg could not read its stream inventory"


def test_risks_features_summary(spark):
    cases = {
        "risky": ([video(), video(index=1), video(index=2, codec_name="bmp", disposition={"attached_pic": 1}), {"index": 3, "codec_type": "subtitle", "codec_name": "ass"}, {"index": 4, "codec_type": "data"}],),
        "rich": ([video(color_range="tv", side_data_list=[{"rotation": "-90"}]), audio(), audio(index=2, tags={"title": "Director Commentary"})], {"chapters": [{"start_time": "0", "end_time": "1"}]}),
        "fine": ([video(codec_name="prores", pix_fmt="yuva444p10le", field_order="tt", avg_frame_rate="24/1", r_frame_rate="30/1", color_transfer="smpte2084")],),
    }
    df = inventories(spark, cases).select("name", I.removal_risks(F.col("inventory")).alias("r"), I.advanced_features(F.col("inventory")).alias("f"), I.preservation_summary(F.col("inventory")).alias("p"))
    got = {r["name"]: r for r in df.collect()}
    assert got["risky"]["r"] == ["1 additional video track(s)", "1 subtitle track(s) (ass)", "1 attached artwork stream(s)", "1 unsupported data stream(s)"]
    assert got["rich"]["p"] == "2 audio tracks (1 commentary), 1 chapter(s), rotation -90 degrees, colour metadata"
    assert got["fine"]["f"] == ["10-bit video", "HDR/dynamic-range metadata", "alpha channel", "interlaced video (tt)", "variable frame rate"]


def verdicts(spark, cases, rules=validation.Rules(), durations=(10.0, 10.0), spans=({}, {})):
    src = inventories(spark, {k: v[0] for k, v in cases.items()}).select("name", F.col("inventory").alias("source"))
    out = inventories(spark, {k: v[1] for k, v in cases.items()}).select("name", F.col("inventory").alias("output"))
    m = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(float(v))))).cast("map<string,double>") if d else F.create_map().cast("map<string,double>")
    df = src.join(out, "name").withColumns({"source_duration": F.lit(durations[0]), "output_duration": F.lit(durations[1]), "source_spans": m(spans[0]), "output_spans": m(spans[1]), "source_starts": m({}), "output_starts": m({})})
    return {r["name"]: (r["ok"], r["reason"]) for r in validation.verify_streams(df, rules).collect()}


def test_validation(spark):
    base = [video(start_time="0", avg_frame_rate="30/1"), audio(duration="10", channels=2, start_time="0", tags={"title": "Main"})]
    change = lambda **x: [base[0], base[1] | x]
    cases = {
        "same": ((base,), (base,)),
        "handler": ((base,), (change(tags={"handler_name": "Main"}),)),
        "dropped": ((base,), ([base[0]],)),
        "short": ((base,), (change(duration="4"),)),
        "channels": ((base,), (change(channels=6),)),
        "drift": ((base,), (change(start_time="0.2"),)),
        "codec": ((base,), ([video(codec_name="vp9"), base[1]],)),
        "rotation": (([video(side_data_list=[{"rotation": "90"}]), base[1]],), ([video(), base[1]],)),
        "colour": (([video(color_space="bt709"), base[1]],), ([video(), base[1]],)),
        "range": (([video(color_range="tv"), base[1]],), ([video(), base[1]],)),
        "chapter": ((base, {"chapters": [{"start_time": "0", "end_time": "5", "tags": {"title": "One"}}]}), (base, {"chapters": [{"start_time": "0", "end_time": "5", "tags": {"title": "Two"}}]})),
        "broken": ((base,), (None,)),
    }
    got = verdicts(spark, cases)
    assert got["same"] == got["handler"] == got["range"] == (True, "ok")
    assert got["dropped"] == (False, "audio track count changed: source 1, output 0")
    assert got["short"][1].startswith("audio track 1 duration changed")
    assert got["channels"][1] == "audio track 1 channel count changed: source 2 vs output 6"
    assert "A/V start offset" in got["drift"][1]
    assert got["codec"][1].startswith("primary output is not h264")
    assert got["rotation"][1] == "video rotation metadata changed"
    assert got["colour"][1] == "video color_space metadata changed: source bt709, output None"
    assert got["chapter"][1] == "chapter 1 title changed"
    assert got["broken"][1] == "could not inventory source and output streams"


def test_recovered_duration(spark):
    base = [video(), audio()]
    case = {"x": ((base,), (base,))}
    assert verdicts(spark, case, durations=(100.0, 21.5), spans=({"0": 21.5, "1": 21.4}, {"0": 21.5, "1": 21.4}))["x"] == (True, "recovered all 21.5s of readable media; the damaged source header claimed 100.0s")
    assert verdicts(spark, case, durations=(100.0, 21.5), spans=({"0": 90.0, "1": 21.4}, {"0": 21.5, "1": 21.4}))["x"] == (False, "duration mismatch: source 100.0s vs output 21.5s")


def test_packets(spark):
    rows = [("v", "0", "0.0", "", "1.0"), ("v", "0", "4.0", "", "1.0"), ("v", "0", "N/A", "9.0", "1.0"), ("v", "0", "", "2.0", "-3"), ("v", "0", "6.0", "", "N/A"), ("v", "1", "1.5", "", "")]
    df = spark.createDataFrame(rows, "path string, stream_index string, pts_time string, dts_time string, duration_time string")
    assert {r["stream_index"]: r["span"] for r in timeline.packet_spans(df).collect()} == {"0": 5.0, "1": 0.0}


def test_library_source(spark, tmp_path):
    for p in ("a.jpg", "_under.jpg", "_dir/c.jpg", ".hidden.jpg", ".secret/x.jpg", "L.photoslibrary/x.jpg", "sub/deep/x.TIFF", "notes.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    webp = b"RIFF1234WEBPVP8X0000" + bytes([0x3E])
    (tmp_path / "w.webp").write_bytes(webp)
    (tmp_path / "static.webp").write_bytes(webp[:-1] + b"\0")
    os.symlink(tmp_path / "a.jpg", tmp_path / "link.jpg")
    source.register(spark)
    files = spark.read.format("media_library").load(str(tmp_path))
    assert {r["path"] for r in library.classify(files).collect()} == {"a.jpg", "_under.jpg", "_dir/c.jpg", "sub/deep/x.TIFF", "w.webp"}
    assert {r["path"] for r in files.where("ext = '.txt'").collect()} == {"notes.txt"}
    flags = files.where("name = 'w.webp'").select(M.webp_flags(F.col("head")).alias("w")).first()["w"]
    assert all(flags)


def test_live_pairs(spark):
    files = library.classify(spark.createDataFrame([(p,) for p in ("a/img_5.JPG", "a/IMG_5.mov", "b/IMG_5.mov", "clip.jpg", "clip.mkv")], "path string"))
    pairs = library.live_pairs(files)
    assert [(r["video"], r["still"]) for r in pairs.collect()] == [("a/IMG_5.mov", "a/img_5.JPG")]
    ids = spark.createDataFrame([("a/img_5.JPG", ""), ("a/IMG_5.mov", "")], "path string, content_id string")
    assert library.verified_pairs(pairs, ids, True).count() == 0
    assert library.verified_pairs(pairs, ids, False).count() == 1
    assert library.protected(pairs).count() == 2


def test_state_files(spark, tmp_path):
    plan = spark.createDataFrame([("a é.jpg", "b.jpg")], "src string, dst string")
    state.write_plan(plan, "/lib", str(tmp_path / ".plan.json"))
    assert [tuple(r) for r in state.read_plan(spark, str(tmp_path / ".plan.json")).collect()] == [("a é.jpg", "b.jpg")]
    (tmp_path / "bad.json").write_text(json.dumps({"root": "/", "renames": [{"from": "a", "to": "../b"}]}))
    try:
        state.read_plan(spark, str(tmp_path / "bad.json")).collect()
        raise AssertionError("escaped")
    except Exception as e:  # noqa: BLE001
        assert "leaves the library" in str(e)
    assert state.settings("# x\n--workers 4\n\n--dry-run\n") == ["--workers", "4", "--dry-run"]
    assert state.read_cache(spark, str(tmp_path / "none")).count() == 0
    assert state.read_journal(spark, str(tmp_path / "none")).count() == 0


def test_recovery(spark):
    ident = "struct<id:string>"
    tx = spark.createDataFrame([(1, "s", "f", "b", "t", ("src",), ("out",))], f"id int, source string, final string, backup string, temporary string, source_identity {ident}, output_identity {ident}")
    for seen, want in (([("f", "x", "out"), ("b", "src", "x")], "finish"), ([("s", "src", "x"), ("t", "x", "out")], "discard"), ([("b", "src", "x")], "restore"), ([("s", "other", "x")], "unresolved"), ([], "unresolved")):
        obs = spark.createDataFrame([(p, (i,), (o,)) for p, i, o in seen], f"path string, identity {ident}, output_identity {ident}")
        got = caches.recovery(tx, obs).collect()
        assert [r["decision"] for r in got] == [want]


def test_measures(spark):
    row = spark.sql("select '1.0d' a, 'N/A' b, '30000/1001' c, '5.1(side)' l, '2020:01:02 03:04:05.6+02:00' d").select(
        M.number(F.col("a")), M.number(F.col("b")), F.round(M.rate(F.col("c")), 3), M.layout(F.col("l")), M.capture_date(F.col("d")),
        M.size_text(F.lit(1536)), M.clock(F.lit(3725.0)), M.clock(F.lit(None).cast("double")), M.required_space(F.lit(10)), M.last_lines(F.lit("a\n\nb\nc\nd"), 3),
        M.progress_text(F.lit("encoding"), F.lit("x"), F.lit(3600.0), F.lit(14400.0), F.lit(0.5)),
    ).first()
    assert tuple(row)[:10] == (None, None, 29.97, "5.1", "2020-01-02 03:04:05", "1.5 KB", "1:02:05", "--:--", 64 << 20, "b | c | d")
    assert "  25%" in row[10] and "0.50x" in row[10] and "ETA 6:00:00" in row[10]


def test_features_look_for_the_picture_once(spark):
    from lumenframe.schemas import INVENTORY

    df = spark.createDataFrame([], f"inv {INVENTORY}").select(I.advanced_features(F.col("inv")).alias("f"))
    assert df._jdf.queryExecution().analyzed().toString().count("filter(inv") == 1


def test_probe_is_read_once(spark):
    df = spark.createDataFrame([], "text string").select(I.normalised(F.col("text")).alias("i"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json(") == 1
