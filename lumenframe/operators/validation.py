"""Whether an output keeps what its source had: one nullable reason per rule, and the first one wins.

All rules are expressions over one row that holds both inventories; tracks are paired by position with
``zip_with``, so nothing is exploded or shuffled.  Packet spans and decoded starts come as maps by stream
index, made by ``timeline``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import inventory as I
from ..functions.measures import av_tolerance, colour, layout, number, rate, turned


@dataclass(frozen=True)
class Rules:
    allow_stream_removal: bool = False
    allow_video_downgrade: bool = False
    preserve_video_codec: bool = False


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _say(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _ints(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda i: i.cast("string")), ", "), F.lit("]"))


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def _first(reasons: Column) -> Column:
    return F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))


def _spans_at(spans: Column, s: Column) -> Column:
    return spans[s["index"].cast("string")]


def _defaults_ok(before: Column, after: Column) -> Column:
    was, now = I.defaults(before), I.defaults(after)
    first = F.when(F.size(before) == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    return (now == was) | (now == F.when(F.size(was) > 0, was).otherwise(first))


def _audio(before: Column, after: Column, n: Column, src: Column, out: Column, starts: Column, starts2: Column, rules: Rules) -> Column:
    """Reason against one audio track, its own rules in order."""
    ignored = ("original",) if rules.allow_stream_removal else ()
    was, now = number(before["duration"]), number(after["duration"])
    track = F.concat(F.lit("audio track "), n.cast("string"), F.lit(" "))
    same = lambda a, b: a.cast("string").eqNullSafe(b.cast("string"))
    layouts = layout(before["channel_layout"]), layout(after["channel_layout"])
    begun = [number(s["start_time"]) for s in (src, before, out, after)]
    offset, offset2 = begun[1] - begun[0], begun[3] - begun[2]
    decoded = [_spans_at(m, s) for m, s in ((starts, src), (starts, before), (starts2, out), (starts2, after))]
    told = decoded[0].isNotNull() & decoded[1].isNotNull() & decoded[2].isNotNull() & decoded[3].isNotNull()
    drift = F.abs(offset - offset2) > av_tolerance(src["avg_frame_rate"])
    real, real2 = F.when(told, decoded[1] - decoded[0]).otherwise(offset), F.when(told, decoded[3] - decoded[2]).otherwise(offset2)
    profile = before["profile"]
    return F.coalesce(
        F.when(~after["codec_name"].eqNullSafe("aac"), _say(track, "output codec is not AAC")),
        F.when(~I.audio_identity(before, ignored).eqNullSafe(I.audio_identity(after, ignored)), _say(track, "language/title/disposition metadata changed")),
        F.when(before["duration"].isNotNull() & (was.isNull() | now.isNull()), _say(track, "duration could not be verified")),
        F.when(F.abs(was - now) > F.greatest(F.lit(0.25), was * 0.02), _say(track, "duration changed: source ", _fixed(was, 2), "s, output ", _fixed(now, 2), "s")),
        *(F.when(before[f].isNotNull() & ~same(before[f], after[f]), _say(track, f"{label} changed: source ", _text(before[f]), " vs output ", _text(after[f]))) for f, label in (("channels", "channel count"), ("sample_rate", "sample rate"))),
        F.when(layouts[0] != layouts[1], _say(track, "channel layout changed: source ", _text(before["channel_layout"]), " vs output ", _text(after["channel_layout"]))),
        F.when(before["codec_name"].eqNullSafe(after["codec_name"]) & (profile != "unknown") & ~profile.eqNullSafe(after["profile"]), _say(track, "codec profile changed: source ", _text(profile), " vs output ", _text(after["profile"]))),
        F.when(drift & (F.abs(real - real2) > av_tolerance(src["avg_frame_rate"])), _say(track, "A/V start offset changed: source ", F.format_string("%+.3f", real), "s vs output ", F.format_string("%+.3f", real2), "s (tolerance ", _fixed(av_tolerance(src["avg_frame_rate"]), 3), "s)")),
    )


def _pairs(before: Column, after: Column) -> Column:
    return F.transform(F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), lambda p, i: F.struct(p["b"].alias("b"), p["a"].alias("a"), (i + 1).alias("n")))


def tracks(source: Column, output: Column) -> dict[str, Column]:
    """The streams of both inventories that the rules look at, by role."""
    return {"videos": I.primary_video(source), "videos2": I.primary_video(output), "audio": I.of_type(source, "audio"), "audio2": I.of_type(output, "audio"), "subs": I.kept_subtitles(source), "subs2": I.of_type(output, "subtitle"), "covers": I.kept_covers(source), "covers2": I.kept_covers(output)}


def verdict(source: Column, output: Column, source_duration: Column, output_duration: Column, spans: Column, spans2: Column, starts: Column, starts2: Column, rules: Rules = Rules(), by_role: dict[str, Column] | None = None) -> Column:
    """struct<ok, reason> for inventories ``source`` and ``output``; durations in seconds; spans and starts as maps from stream index to seconds.

    ``by_role`` gives ``tracks`` as columns, where they are worked out already.
    """
    x = by_role or tracks(source, output)
    videos, videos2, audio, audio2, subs, subs2, covers, covers2 = (x[k] for k in ("videos", "videos2", "audio", "audio2", "subs", "subs2", "covers", "covers2"))
    src, out = x.get("src", F.get(videos, F.lit(0))), x.get("out", F.get(videos2, F.lit(0)))
    chapters, chapters2 = source["chapters"], output["chapters"]

    wanted = F.when(F.size(videos) > 0, 1).otherwise(0) if rules.allow_stream_removal else F.size(videos)
    count = lambda what, a, b: F.when(F.size(a) != F.size(b), _say(f"{what} count changed: source ", _text(F.size(a)), ", output ", _text(F.size(b))))

    late = ~F.coalesce(F.abs(source_duration - output_duration) <= F.greatest(F.lit(1.0), source_duration * 0.02), F.lit(True))
    short = _say("duration mismatch: source ", _fixed(source_duration, 1), "s vs output ", _fixed(output_duration, 1), "s")
    n_paired = F.least(F.size(audio), F.size(audio2))
    paired = F.concat(F.array(F.struct(src.alias("b"), out.alias("a"))), F.transform(F.slice(_pairs(audio, audio2), F.lit(1), n_paired), lambda p: F.struct(p["b"].alias("b"), p["a"].alias("a"))))
    lengths = F.transform(paired, lambda p: F.struct(_spans_at(spans, p["b"]).alias("b"), _spans_at(spans2, p["a"]).alias("a")))
    agree = F.forall(lengths, lambda x: F.coalesce(F.abs(x["b"] - x["a"]) <= F.greatest(F.lit(1.0), x["b"] * 0.02), F.lit(False)))
    recovered = F.array_max(F.transform(lengths, lambda x: x["b"]))
    note = F.when(late, _say("recovered all ", _fixed(recovered, 1), "s of readable media; the damaged source header claimed ", _fixed(source_duration, 1), "s")).otherwise("ok")

    def subtitle(p: Column) -> Column:
        track = F.concat(F.lit("subtitle track "), p["n"].cast("string"), F.lit(" "))
        return F.coalesce(F.when(~p["a"]["codec_name"].eqNullSafe("mov_text"), _say(track, "is not MP4 mov_text")), F.when(~I.subtitle_identity(p["b"]).eqNullSafe(I.subtitle_identity(p["a"])), _say(track, "language/title/disposition metadata changed")))

    def cover(p: Column) -> Column:
        changed = lambda f: F.when(p["b"][f].isNotNull() & ~p["b"][f].eqNullSafe(p["a"][f]), _say("artwork stream ", p["n"].cast("string"), f" {f} changed"))
        return F.coalesce(*map(changed, ("codec_name", "width", "height")))

    def chapter(p: Column) -> Column:
        t, t2 = (F.trim(F.coalesce(p[x]["title"], F.lit(""))) for x in ("b", "a"))
        generic = lambda x: (x == "") | F.lower(x).startswith("chapter")
        delta = [F.abs(number(p["b"][f]) - number(p["a"][f])) for f in ("start_time", "end_time")]
        name = F.concat(F.lit("chapter "), p["n"].cast("string"), F.lit(" "))
        return F.coalesce(F.when((t != t2) & ~generic(t) & ~generic(t2), _say(name, "title changed")), F.when(delta[0].isNull() | delta[1].isNull(), _say(name, "timing could not be verified")), F.when((delta[0] > 0.5) | (delta[1] > 0.5), _say(name, "timing changed")))

    if rules.preserve_video_codec:
        same = src["codec_name"].eqNullSafe(out["codec_name"]) & src["pix_fmt"].eqNullSafe(out["pix_fmt"])
        form = F.when(~same, _say("copied video format changed: source ", _text(src["codec_name"]), "/", _text(src["pix_fmt"]), " vs output ", _text(out["codec_name"]), "/", _text(out["pix_fmt"])))
    else:
        good = out["codec_name"].eqNullSafe("h264") & F.coalesce(out["pix_fmt"].isin(*V.H264_FORMATS), F.lit(False))
        form = F.when(~good, _say("primary output is not h264/8-bit 4:2:0: ", _text(out["codec_name"]), "/", _text(out["pix_fmt"])))
    colours = [F.when(src["color"][f].isNotNull() & ~colour(f, src["color"][f]).eqNullSafe(colour(f, out["color"][f])), _say(f"video {f} metadata changed: source ", _text(src["color"][f]), ", output ", _text(out["color"][f]))) for f in V.COLOR_FIELDS]
    looks = []
    if not rules.allow_video_downgrade:
        for f, label in (("field_order", "field order"), ("sample_aspect_ratio", "sample aspect ratio")):
            told = src[f].isNotNull() & ~src[f].isin("", "unknown", "0:1")
            looks.append(F.when(told & ~src[f].eqNullSafe(out[f]), _say(f"video {label} changed: source ", _text(src[f]), " vs output ", _text(out[f]))))
        r, r2 = rate(src["avg_frame_rate"]), rate(out["avg_frame_rate"])
        looks.append(F.when((r != 0) & (r2 != 0) & (F.abs(r - r2) > F.greatest(F.lit(0.5), r * 0.005)), _say("video average frame rate changed: source ", _fixed(r, 3), " vs output ", _fixed(r2, 3), " (--allow-video-downgrade to permit)")))
        none = F.array().cast("array<string>")
        needed = F.filter(F.coalesce(src["side_data_types"], none), lambda x: I._any_marker(F.lower(x)))
        looks.append(F.when(F.size(F.array_except(needed, F.coalesce(out["side_data_types"], none))) > 0, "video HDR/dynamic-range side data changed"))

    reason = F.coalesce(
        F.when(source.isNull() | output.isNull(), "could not inventory source and output streams"),
        F.when((wanted != 1) | (F.size(videos2) != 1), _say("primary video stream count changed: source ", _text(F.size(videos)), ", output ", _text(F.size(videos2)))),
        F.when(late & ~agree, short),
        count("audio track", audio, audio2),
        F.when(~_defaults_ok(audio, audio2), _say("default audio selection changed: source ", _ints(I.defaults(audio)), ", output ", _ints(I.defaults(audio2)))),
        _first(F.transform(_pairs(audio, audio2), lambda p: _audio(p["b"], p["a"], p["n"], src, out, starts, starts2, rules))),
        count("compatible subtitle track", subs, subs2),
        F.when(~_defaults_ok(subs, subs2), "default subtitle selection changed"),
        _first(F.transform(_pairs(subs, subs2), subtitle)),
        count("compatible artwork", covers, covers2),
        _first(F.transform(_pairs(covers, covers2), cover)),
        count("chapter", chapters, chapters2),
        _first(F.transform(_pairs(chapters, chapters2), chapter)),
        form,
        F.when(~turned(src["rotation"]).eqNullSafe(turned(out["rotation"])), "video rotation metadata changed"),
        *colours,
        *looks,
    )
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, note).alias("reason"))


def verify_streams(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds ok and reason to ``pairs(source, output, source_duration, output_duration, source_spans, output_spans, source_starts, output_starts)``.

    The tracks are columns of a step before, so the many rules that look at them don't each work them out.
    """
    role = lambda k: f"_tracks_{k}"
    df = pairs.withColumns({role(k): c for k, c in tracks(F.col("source"), F.col("output")).items()})
    df = df.withColumns({role("src"): F.get(role("videos"), F.lit(0)), role("out"): F.get(role("videos2"), F.lit(0))})
    by_role = {k: F.col(role(k)) for k in (*tracks(F.col("source"), F.col("output")), "src", "out")}
    v = verdict(*(F.col(c) for c in ("source", "output", "source_duration", "output_duration", "source_spans", "output_spans", "source_starts", "output_starts")), rules, by_role)
    df = df.withColumn("_v", v).withColumn("ok", F.col("_v.ok")).withColumn("reason", F.col("_v.reason"))
    return df.select(*pairs.columns, "ok", "reason")


def output_verdict(returncode: Column, stderr: Column, exists: Column, size: Column, is_video: Column, integrity_ok: Column, integrity_reason: Column, playback_ok: Column, playback_reason: Column) -> Column:
    """struct<ok, reason> of a finished command: exit code, file, size, then for videos decoding and playback."""
    from ..functions.measures import last_lines

    tail = last_lines(stderr, 6)
    reason = F.coalesce(
        F.when(returncode != 0, F.concat(F.lit("converter exited with code "), returncode.cast("string"), F.lit(": "), tail)),
        F.when(~exists, "output file was not created"),
        F.when(size <= 0, "output file is 0 bytes"),
        F.when(is_video & ~integrity_ok, F.concat(F.lit("integrity check failed: "), integrity_reason)),
        F.when(is_video & ~playback_ok, F.concat(F.lit("Apple playback check failed: "), playback_reason)),
    )
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def decoder_health(returncode: Column, stderr: Column) -> Column:
    """struct<ok, reason> of a decoding run.  Two known complaints don't count when it ended well."""
    from ..functions.measures import last_lines

    lines = F.filter(F.split(F.trim(F.coalesce(stderr, F.lit(""))), r"\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    known = lambda x: F.contains(x, F.lit("Referenced QT chapter track not found")) | F.contains(x, F.lit("non monotonically increasing dts to muxer"))
    ok = (returncode == 0) & F.forall(lines, known)
    return F.struct(ok.alias("ok"), F.when(ok, "ok").otherwise(last_lines(stderr, 3)).alias("reason"))


def mp4_health(health_ok: Column, health_reason: Column, playback_ok: Column, playback_reason: Column) -> Column:
    """struct<ok, reason>: decoding first, then playback."""
    reason = F.when(~health_ok, health_reason).when(~playback_ok, F.concat(F.lit("Apple playback: "), playback_reason)).otherwise("ok")
    return F.struct((health_ok & playback_ok).alias("ok"), reason.alias("reason"))


def truncation_explained(reason: Column, stderr: Column) -> Column:
    cut = F.lit(False)
    for m in V.TRUNCATION_MARKERS:
        cut = cut | F.contains(F.coalesce(stderr, F.lit("")), F.lit(m))
    return F.when(F.contains(reason, F.lit("duration mismatch")) & cut, F.concat(F.lit("source file is truncated; missing media cannot be reconstructed ("), reason, F.lit(")"))).otherwise(reason)
