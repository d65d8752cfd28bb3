"""Codec argument vectors as data: array<string> columns, pure functions of the inventory.  Nothing is run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from ..functions import inventory as I


def words(*parts) -> Column:
    return F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def chain(*arrays: Column) -> Column:
    return F.concat(*arrays)



def _none() -> Column:
    return F.array().cast("array<string>")


def _only(cond: Column, args: Column) -> Column:
    return F.when(cond, args).otherwise(_none())


def _text(c: Column) -> Column:
    return c.cast("string")


def _dispositions(s: Column) -> Column:
    marks = F.map_keys(F.map_filter(F.coalesce(s["disposition"], F.create_map().cast("map<string,int>")), lambda k, v: v != 0))
    return F.when(F.size(marks) > 0, F.array_join(marks, "+")).otherwise("0")


def mapping(inv: Column) -> Column:
    """-map and metadata arguments: the picture, then audio, text subtitles and covers, by absolute index."""
    first = I.first_video(inv)["index"]

    def audio(s: Column, i: Column) -> Column:
        n = _text(i)
        title = F.coalesce(I.audio_label(s), F.when(I.is_commentary(s), "Commentary"))
        lang = s["tags"]["language"]
        meta = F.concat(F.lit("-metadata:s:a:"), n)
        return chain(
            words("-map", F.coalesce(F.concat(F.lit("0:"), _text(s["index"])), F.concat(F.lit("0:a:"), n)), F.concat(F.lit("-map_metadata:s:a:"), n), F.concat(F.lit("0:s:a:"), n)),
            _only(F.coalesce(lang != "", F.lit(False)), words(meta, F.concat(F.lit("language="), lang))),
            _only(title.isNotNull(), words(meta, F.concat(F.lit("title="), title), meta, F.concat(F.lit("handler_name="), title))),
            words(F.concat(F.lit("-disposition:a:"), n), _dispositions(s)),
        )

    def subtitle(s: Column, i: Column) -> Column:
        n = _text(i)
        told = [_only(F.coalesce(s["tags"][t] != "", F.lit(False)), words(F.concat(F.lit("-metadata:s:s:"), n), F.concat(F.lit(f"{t}="), s["tags"][t]))) for t in ("language", "title")]
        return chain(words("-map", F.concat(F.lit("0:"), _text(s["index"]))), *told, words(F.concat(F.lit("-disposition:s:"), n), _dispositions(s)))

    def cover(s: Column, i: Column) -> Column:
        return _only(s["index"].isNotNull(), words("-map", F.concat(F.lit("0:"), _text(s["index"])), F.concat(F.lit("-disposition:v:"), _text(i + 1)), "attached_pic"))

    each = lambda streams, f: F.flatten(F.transform(streams, f))
    return chain(words("-map", F.coalesce(F.concat(F.lit("0:"), _text(first)), F.lit("0:v:0"))), each(I.of_type(inv, "audio"), audio), each(I.kept_subtitles(inv), subtitle), each(I.kept_covers(inv), cover))


def kept_codecs(inv: Column) -> Column:
    covers = F.flatten(F.transform(I.kept_covers(inv), lambda s, i: words(F.concat(F.lit("-c:v:"), _text(i + 1)), "copy")))
    return chain(_only(F.size(I.kept_subtitles(inv)) > 0, words("-c:s", "mov_text")), covers)


def colour_arguments(inv: Column) -> Column:
    c = I.first_video(inv)["color"]
    return chain(*(_only(F.coalesce((c[f] != "") & (c[f] != "unknown"), F.lit(False)), words(f"-{o}:v:0", c[f])) for f, o in V.COLOR_OPTIONS.items()))


def video_tag(inv: Column) -> Column:
    return F.when(I.first_video(inv)["codec_name"] == "hevc", "hvc1").otherwise("avc1")


TOLERANT = ("-fflags", "+genpts+discardcorrupt", "-err_detect", "ignore_err")
KEPT = ("-map_metadata", "0", "-map_metadata:s:v:0", "0:s:v:0", "-map_chapters", "0")
CLOSE = ("-brand", "mp42", "-movflags", "+faststart")


def remux(source: Column, target: Column, inv: Column, repair: bool = False) -> Column:
    return chain(
        words("ffmpeg", "-nostdin", "-y", *(TOLERANT if repair else ()), "-noautorotate", "-i", source),
        mapping(inv),
        words(*KEPT, "-c", "copy"),
        kept_codecs(inv),
        colour_arguments(inv),
        words("-tag:v:0", video_tag(inv), "-tag:a", "mp4a", *CLOSE, target),
    )


def encode(source: Column, target: Column, inv: Column, repair: bool = False, copy_video: bool = False) -> Column:
    even = "pad=ceil(iw/2)*2:ceil(ih/2)*2"
    picture = ("-c:v:0", "copy") if copy_video else ("-c:v:0", "libx264", "-preset", "slow", "-crf", "18")
    look = () if copy_video else ("-pix_fmt", "yuv420p", "-vf", f"setpts=N/FRAME_RATE/TB,{even}" if repair else even)
    return chain(
        words("ffmpeg", "-nostdin", "-y", *(TOLERANT if repair else ()), "-noautorotate", "-i", source),
        mapping(inv),
        words(*KEPT, *picture, "-c:a", "aac", "-b:a", "256k"),
        kept_codecs(inv),
        words(*look, *(("-fps_mode", "passthrough") if repair else ())) if look or repair else _none(),
        colour_arguments(inv),
        words("-tag:v:0", video_tag(inv) if copy_video else "avc1", "-tag:a", "mp4a", *CLOSE, target),
    )


def rotate(source: Column, target: Column, inv: Column, copy_video: bool = False) -> Column:
    r = I.first_video(inv)["rotation"]
    angle = F.when(r == F.floor(r), r.cast("bigint").cast("string")).otherwise(r.cast("string"))
    return chain(
        words("ffmpeg", "-nostdin", "-y", "-display_rotation:v:0", angle, "-i", source, "-map", "0:v?", "-map", "0:a?", "-map", "0:s?", *KEPT, "-c", "copy"),
        colour_arguments(inv),
        words("-tag:v:0", video_tag(inv) if copy_video else "avc1", "-tag:a", "mp4a", *CLOSE, target),
    )


def animation(source: Column, target: Column) -> Column:
    return words("ffmpeg", "-nostdin", "-y", "-i", source, "-tag:v:0", "avc1", *CLOSE, "-pix_fmt", "yuv420p", "-c:v", "libx264", "-preset", "slow", "-crf", "18", "-vf", "scale=trunc(iw/2)*2:trunc(ih/2)*2", target)


def photo(source: Column, target: Column) -> Column:
    return words("cwebp", "-lossless", "-metadata", "all", "-preset", "photo", source, "-o", target)


def for_stage(stage: Column, kind: Column, source: Column, target: Column, inv: Column, copy_video: Column) -> Column:
    """The argument vector of a stage of a job."""
    return (
        F.when(stage == "remux", remux(source, target, inv))
        .when(stage == "repair-remux", remux(source, target, inv, repair=True))
        .when(stage == "repair-encode", encode(source, target, inv, repair=True))
        .when(kind.isin("photo", "heic"), photo(source, target))
        .when(kind.isin("gif", "webp"), animation(source, target))
        .when(copy_video, encode(source, target, inv, copy_video=True))
        .otherwise(encode(source, target, inv))
    )


def photo_route(returncode: Column, stderr: Column, ext: Column, has_jpegtran: bool) -> Column:
    """What follows a still's first attempt: direct, sips (GIF), jpegtran, or fail."""
    failed = F.lit(False)
    for m in V.PHOTO_DECODE_MARKERS:
        failed = failed | F.contains(F.coalesce(stderr, F.lit("")), F.lit(m))
    jpeg = ext.isin(".jpg", ".jpeg")
    return F.when(returncode == 0, "direct").when((ext == ".gif") & failed, "sips").when(jpeg & failed, "jpegtran" if has_jpegtran else "fail").otherwise("direct")
