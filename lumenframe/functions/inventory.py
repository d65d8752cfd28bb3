"""What a stream inventory says.  Each function takes the inventory (or a stream) as a Column and gives a Column.

Arrays are walked by higher-order functions inside one row, so none of this shuffles; comparisons use null-safe
equality, as an unknown codec must count as different, not as unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from .. import values as V
from .measures import bound, number, rate_of_parts


def normalised(text: Column) -> Column:
    """An inventory from a probe's JSON; null where it can't be read."""

    def lower_keys(tags: Column) -> Column:
        # the last of equal keys wins
        last = lambda entries: F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
        lowered = F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        return F.map_from_entries(bound(lowered, last))

    def chosen(tags: Column, names: tuple) -> Column:
        return F.coalesce(F.map_filter(tags, lambda k, v: k.isin(*names)), F.create_map().cast("map<string,string>"))

    def stream(s: Column) -> Column:
        tags = F.coalesce(lower_keys(s["tags"]), F.create_map().cast("map<string,string>"))
        return bound(tags, lambda t: with_tags(s, t))

    def with_tags(s: Column, tags: Column) -> Column:
        side = F.coalesce(s["side_data_list"], F.array().cast("array<map<string,string>>"))
        turns = F.filter(F.transform(side, lambda d: number(d["rotation"])), lambda r: r.isNotNull())
        colours = F.map_filter(F.create_map(*(x for f in V.COLOR_FIELDS for x in (F.lit(f), s[f]))), lambda k, v: v.isNotNull())
        kept = F.coalesce(F.map_filter(s["disposition"], lambda k, v: k.isin(*V.DISPOSITIONS)), F.create_map().cast("map<string,int>"))
        types = F.array_sort(F.array_distinct(F.filter(F.transform(side, lambda d: d["side_data_type"]), lambda x: x.isNotNull())))
        simple = ("index", "codec_type", "codec_name", "codec_tag_string", "profile", "start_time", "duration")
        picture = ("width", "height", "pix_fmt", "bits_per_raw_sample", "field_order", "avg_frame_rate", "r_frame_rate", "sample_aspect_ratio")
        return F.struct(
            *(s[n].alias(n) for n in simple),
            chosen(tags, V.IDENTITY_TAGS).alias("tags"),
            kept.alias("disposition"),
            *(s[n].alias(n) for n in picture),
            F.coalesce(F.get(turns, F.lit(0)), number(tags["rotate"])).alias("rotation"),
            colours.alias("color"),
            (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 0).alias("attached_pic"),
            types.alias("side_data_types"),
            *(s[n].alias(n) for n in ("sample_rate", "channels", "channel_layout", "sample_fmt")),
        )

    def chapter(c: Column) -> Column:
        return F.struct(c["start_time"].alias("start_time"), c["end_time"].alias("end_time"), lower_keys(c["tags"])["title"].alias("title"))

    def group(g: Column) -> Column:
        kind = F.coalesce(F.nullif(g["type"], F.lit("")), F.nullif(g["group_type"], F.lit("")), F.lit("unknown"))
        return F.struct(g["index"].alias("index"), g["id"].alias("id"), kind.alias("type"))

    def whole(raw: Column) -> Column:
        return F.struct(
            F.transform(F.coalesce(raw["streams"], F.array().cast(f"array<{S.RAW_STREAM}>")), stream).alias("streams"),
            F.coalesce(F.transform(raw["chapters"], chapter), F.array().cast(f"array<{S.CHAPTER}>")).alias("chapters"),
            F.coalesce(F.transform(raw["stream_groups"], group), F.array().cast(f"array<{S.GROUP}>")).alias("stream_groups"),
        )

    def read(t: Column) -> Column:
        # anything but an object is no inventory
        return F.when(F.get_json_object(t, "$").isNotNull() & F.trim(t).startswith("{"), bound(F.from_json(t, S.RAW_INVENTORY, {"mode": "PERMISSIVE"}), whole))

    return bound(text, read)


def of_type(inv: Column, kind: str) -> Column:
    return F.filter(inv["streams"], lambda s: s["codec_type"].eqNullSafe(kind))


def pictured(s: Column) -> Column:
    return F.coalesce(s["attached_pic"], F.lit(False))


def primary_video(inv: Column) -> Column:
    return F.filter(inv["streams"], lambda s: s["codec_type"].eqNullSafe("video") & ~pictured(s))


def first_video(inv: Column) -> Column:
    return F.get(primary_video(inv), F.lit(0))


def is_artwork(s: Column) -> Column:
    mime = F.lower(F.coalesce(s["tags"]["mimetype"], F.lit("")))
    file = F.lower(F.coalesce(s["tags"]["filename"], F.lit("")))
    ends = file.endswith(V.COVER_SUFFIXES[0])
    for x in V.COVER_SUFFIXES[1:]:
        ends = ends | file.endswith(x)
    return (s["codec_type"].eqNullSafe("video") & pictured(s)) | (s["codec_type"].eqNullSafe("attachment") & (mime.startswith("image/") | ends))


def artwork(inv: Column) -> Column:
    pictures = F.filter(inv["streams"], lambda s: s["codec_type"].eqNullSafe("video") & pictured(s))
    return F.concat(pictures, F.filter(inv["streams"], lambda s: s["codec_type"].eqNullSafe("attachment") & is_artwork(s)))


def kept_subtitle(s: Column) -> Column:
    return s["codec_type"].eqNullSafe("subtitle") & F.coalesce(s["codec_name"].isin(*V.TEXT_SUBTITLES), F.lit(False))


def kept_subtitles(inv: Column) -> Column:
    return F.filter(inv["streams"], kept_subtitle)


def kept_cover(s: Column) -> Column:
    return s["codec_type"].eqNullSafe("video") & pictured(s) & F.coalesce(s["codec_name"].isin(*V.COVER_CODECS), F.lit(False))


def kept_covers(inv: Column) -> Column:
    return F.filter(inv["streams"], kept_cover)


def disposed(s: Column, name: str) -> Column:
    return F.coalesce(s["disposition"][name], F.lit(0)) != 0


def pixel_depth(s: Column) -> Column:
    """Bits a sample: declared, else the first depth that the format's name contains, else 8."""
    fmt = F.coalesce(s["pix_fmt"], F.lit(""))
    named = F.when(fmt == "", None)
    for d in (16, 14, 12, 10, 9):
        named = named.when(F.contains(fmt, F.lit(str(d))), d)
    return F.coalesce(F.nullif(s["bits_per_raw_sample"].try_cast("int"), F.lit(0)), named.otherwise(8))


def _any_marker(text: Column) -> Column:
    out = F.lit(False)
    for m in V.HDR_MARKERS:
        out = out | F.contains(text, F.lit(m))
    return out


def _listed(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def advanced_features(inv: Column) -> Column:
    """Properties of the first picture that an ordinary 8-bit encode may damage, in order."""
    return bound(F.struct(first_video(inv).alias("s"), inv["stream_groups"].alias("groups")), lambda i: bound(_told_of(i["s"], i["groups"]), lambda p: _features(i["s"], p)))


def _told_of(s: Column, groups: Column) -> Column:
    """What several features look at, each computed once."""
    words = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.struct(
        F.lower(F.array_join(F.coalesce(s["side_data_types"], F.array().cast("array<string>")), " ")).alias("side"),
        F.lower(F.array_join(F.transform(groups, lambda g: F.coalesce(g["type"], F.lit(""))), " ")).alias("groups"),
        words(s["pix_fmt"]).alias("fmt"),
        words(s["field_order"]).alias("order"),
        rate_of_parts(s["avg_frame_rate"]).alias("mean"),
        rate_of_parts(s["r_frame_rate"]).alias("nominal"),
        pixel_depth(s).alias("depth"),
    )


def _features(s: Column, p: Column) -> Column:
    side, groups, fmt, order, mean, nominal, depth = (p[n] for n in ("side", "groups", "fmt", "order", "mean", "nominal", "depth"))
    alpha = F.lit(False)
    for x in V.ALPHA_PREFIXES:
        alpha = alpha | fmt.startswith(x)
    varies = F.coalesce((mean != 0) & (nominal != 0) & (F.abs(mean - nominal) > F.greatest(F.lit(0.01), nominal * 0.01)), F.lit(False))
    odd = (mean != 0) & ((mean < 10) | (mean > 120))
    listed = _listed(
        F.when(depth > 8, F.concat(depth.cast("string"), F.lit("-bit video"))),
        F.when(F.coalesce(F.lower(s["color"]["color_transfer"]).isin(*V.HDR_TRANSFERS), F.lit(False)) | _any_marker(side), "HDR/dynamic-range metadata"),
        F.when(F.contains(side, F.lit("lcevc")) | F.contains(groups, F.lit("lcevc")), "LCEVC enhancement layer"),
        F.when(alpha, "alpha channel"),
        F.when(~order.isin("", "unknown", "progressive"), F.concat(F.lit("interlaced video ("), order, F.lit(")"))),
        F.when(varies, "variable frame rate").when(odd, F.format_string("unusual frame rate (%.3f fps)", mean)),
    )
    return F.when(s.isNotNull(), listed).otherwise(F.array().cast("array<string>"))


def is_commentary(s: Column) -> Column:
    text = F.concat_ws(" ", s["tags"]["title"], s["tags"]["name"], s["tags"]["handler_name"])
    return disposed(s, "comment") | F.contains(F.lower(text), F.lit("commentary"))


def audio_label(s: Column) -> Column:
    """The user's name of a track: title, name, or a handler name that isn't boilerplate."""
    handler = F.trim(F.coalesce(s["tags"]["handler_name"], F.lit("")))
    compact = F.regexp_replace(F.lower(handler), r"[^\p{L}\p{N}]", "")
    told = F.when((handler != "") & ~compact.isin(*V.GENERIC_AUDIO_HANDLERS), handler)
    return F.coalesce(F.nullif(s["tags"]["title"], F.lit("")), F.nullif(s["tags"]["name"], F.lit("")), told)


def carries_chapters(s: Column, inv: Column) -> Column:
    return (F.size(inv["chapters"]) > 0) & s["codec_type"].eqNullSafe("data") & s["codec_name"].eqNullSafe("bin_data") & s["codec_tag_string"].eqNullSafe("text")


def _kinds(streams: Column, field: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(streams, lambda s: F.coalesce(s[field], F.lit("unknown"))))), ", ")


def removal_risks(inv: Column) -> Column:
    """What an MP4 could not keep, in order: further pictures, subtitles, covers, other streams, original-language marks, groups."""
    n_video = F.size(primary_video(inv))
    subtitles = F.filter(inv["streams"], lambda s: s["codec_type"].eqNullSafe("subtitle") & ~kept_subtitle(s))
    covers = F.filter(inv["streams"], lambda s: is_artwork(s) & ~kept_cover(s))
    known = ("video", "audio", "subtitle")
    others = F.filter(inv["streams"], lambda s: ~F.coalesce(s["codec_type"].isin(*known), F.lit(False)) & ~carries_chapters(s, inv) & ~is_artwork(s))
    original = F.filter(inv["streams"], lambda s: s["codec_type"].eqNullSafe("audio") & disposed(s, "original"))
    groups = inv["stream_groups"]
    text = lambda n, *rest: F.concat(n.cast("string"), *rest)
    return _listed(
        F.when(n_video > 1, text(n_video - 1, F.lit(" additional video track(s)"))),
        F.when(F.size(subtitles) > 0, text(F.size(subtitles), F.lit(" subtitle track(s) ("), _kinds(subtitles, "codec_name"), F.lit(")"))),
        F.when(F.size(covers) > 0, text(F.size(covers), F.lit(" attached artwork stream(s)"))),
        F.when(F.size(others) > 0, text(F.size(others), F.lit(" unsupported "), _kinds(others, "codec_type"), F.lit(" stream(s)"))),
        F.when(F.size(original) > 0, text(F.size(original), F.lit(" audio track original-language disposition(s)"))),
        F.when(F.size(groups) > 0, text(F.size(groups), F.lit(" unsupported stream group(s) ("), _kinds(groups, "type"), F.lit(")"))),
    )


def preservation_summary(inv: Column) -> Column:
    audio = of_type(inv, "audio")
    comments = F.size(F.filter(audio, is_commentary))
    n = F.size(audio)
    s = first_video(inv)
    whole = (s["rotation"] == F.floor(s["rotation"])) & (F.abs(s["rotation"]) < 1e15)
    rotation = F.when(whole, s["rotation"].cast("bigint").cast("string")).otherwise(s["rotation"].cast("string"))
    count = lambda c, what: F.when(F.size(c) > 0, F.concat(F.size(c).cast("string"), F.lit(f" {what}")))
    tracks = F.concat(n.cast("string"), F.lit(" audio tracks"), F.when(comments > 0, F.concat(F.lit(" ("), comments.cast("string"), F.lit(" commentary)"))).otherwise(""))
    return F.array_join(
        _listed(
            F.when(n > 1, tracks).when(comments > 0, "1 commentary audio track"),
            count(inv["chapters"], "chapter(s)"),
            F.when(s["rotation"].isNotNull(), F.concat(F.lit("rotation "), rotation, F.lit(" degrees"))),
            F.when(F.size(s["color"]) > 0, "colour metadata"),
            count(kept_subtitles(inv), "compatible subtitle track(s)"),
            count(kept_covers(inv), "compatible artwork stream(s)"),
        ),
        ", ",
    )


def _is(s: Column, codec: str, formats: tuple) -> Column:
    return s["codec_name"].eqNullSafe(codec) & F.coalesce(s["pix_fmt"].isin(*formats), F.lit(False))


def _tagged(s: Column, tag: str) -> Column:
    return s["codec_tag_string"].isNull() | (s["codec_tag_string"] == tag)


def stream_status(inv: Column) -> Column:
    """standard, copy-video, hevc or convert, whatever the container."""
    video, audio = primary_video(inv), of_type(inv, "audio")
    h264 = F.forall(video, lambda s: _is(s, "h264", V.H264_FORMATS))
    hevc = F.forall(video, lambda s: _is(s, "hevc", V.HEVC_FORMATS))
    aac = F.forall(audio, lambda s: s["codec_name"].eqNullSafe("aac"))
    return F.when(inv.isNull() | (F.size(video) == 0), "convert").when(~aac & (h264 | hevc), "copy-video").when(~aac, "convert").when(h264, "standard").when(hevc, "hevc").otherwise("convert")


def mp4_status(inv: Column) -> Column:
    """struct<status, reason> of an MP4: standard, hevc or convert."""
    video, audio = primary_video(inv), of_type(inv, "audio")
    every = lambda codec, formats: F.forall(video, lambda s: _is(s, codec, formats))
    aac = F.forall(audio, lambda s: s["codec_name"].eqNullSafe("aac"))
    codecs = F.array_join(F.array_sort(F.array_distinct(F.transform(audio, lambda s: F.coalesce(F.nullif(s["codec_name"], F.lit("")), F.lit("unknown"))))), ", ")
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    pictures = F.array_join(F.transform(video, lambda s: F.concat_ws("/", known(s["codec_name"]), known(s["pix_fmt"]), known(s["codec_tag_string"]))), ", ")
    tagged264 = F.forall(video, lambda s: _tagged(s, "avc1")) & F.forall(audio, lambda s: _tagged(s, "mp4a"))
    tagged265 = F.forall(video, lambda s: _tagged(s, "hvc1"))
    verdict = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    return (
        F.when(inv.isNull(), verdict("convert", "FFmpeg could not read its stream inventory"))
        .when(F.size(video) == 0, verdict("convert", "it has no playable video track"))
        .when(~aac, verdict("convert", F.concat(F.lit("audio is "), codecs, F.lit(", not AAC"))))
        .when(every("h264", V.H264_FORMATS) & tagged264, verdict("standard", "already Apple-compatible"))
        .when(every("hevc", V.HEVC_FORMATS) & tagged265, verdict("hevc", "HEVC is already Apple-native"))
        .when(every("h264", V.H264_FORMATS), verdict("convert", "H.264/AAC tracks need an Apple-compatible MP4 remux"))
        .when(every("hevc", V.HEVC_FORMATS), verdict("convert", "HEVC/AAC tracks need an Apple-compatible hvc1 MP4 remux"))
        .otherwise(verdict("convert", F.concat(F.lit("video is "), pictures, F.lit(", not H.264 8-bit 4:2:0"))))
    )


def language(s: Column) -> Column:
    tag = s["tags"]["language"]
    return F.when(~tag.isin("", "und"), tag)


def audio_identity(s: Column, ignored: tuple = ()) -> Column:
    """A struct of what tells a track from others; maps can't be compared, so names are fixed."""
    title = F.coalesce(audio_label(s), F.when(is_commentary(s), "Commentary"))
    marks = [F.coalesce(s["disposition"][n], F.lit(0)).alias(n) for n in V.COMPARED_DISPOSITIONS if n not in ignored]
    return F.struct(language(s).alias("language"), title.alias("title"), is_commentary(s).alias("commentary"), *marks)


def subtitle_identity(s: Column) -> Column:
    t = F.coalesce(*(F.nullif(s["tags"][n], F.lit("")) for n in ("title", "name", "handler_name")))
    told = F.when(~F.replace(F.lower(t), F.lit(" "), F.lit("")).isin(*V.GENERIC_TEXT_HANDLERS), t)
    return F.struct(language(s).alias("language"), told.alias("title"), disposed(s, "forced").alias("forced"))


def defaults(streams: Column) -> Column:
    """Ordinals of the tracks that are marked default."""
    return F.filter(F.transform(streams, lambda s, i: F.when(disposed(s, "default"), i)), lambda i: i.isNotNull())


def gif_animated(packets: Column) -> Column:
    return F.coalesce(packets.try_cast("int") > 1, F.lit(True))
