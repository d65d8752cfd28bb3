"""What to do with each job, as one row: status, detail, action, stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import inventory as I
from ..functions.measures import required_space, size_text


@dataclass(frozen=True)
class Options:
    reencode_hevc: bool = False
    convert_heic: bool = False
    allow_stream_removal: bool = False
    allow_video_downgrade: bool = False
    keep_originals: bool = False
    only_if_smaller: bool = False
    validate_existing: bool = False
    dry_run: bool = True
    dispose_label: str = "trash original"
    on_mac: bool = False


STATIC_GIF = "photo"


def decide(jobs: DataFrame, o: Options = Options()) -> DataFrame:
    """Adds status (skipped, failed, planned or ready), detail, action, copy_video, stages and final.

    ``jobs(path, kind, inventory, healthy, playback_ok, gif_packets, webp, output, taken, fault, size, free)``: webp is the
    struct of its flags; taken says whether the target exists; fault is a safety fault of the source; free bytes
    of the target's device.  Options are literals, so Catalyst folds the branches they close.
    """
    kind = F.when((F.col("kind") == "gif") & ~I.gif_animated(F.col("gif_packets")), STATIC_GIF).otherwise(F.col("kind"))
    # worked out once, in a step of their own, for the many branches below
    given = jobs.columns
    told = {"mp4": I.mp4_status(F.col("inventory"))["status"], "state": I.stream_status(F.col("inventory")), "risks": I.removal_risks(F.col("inventory")), "looks": I.advanced_features(F.col("inventory")), "kept": I.preservation_summary(F.col("inventory")), "pictures": F.size(I.primary_video(F.col("inventory")))}
    jobs = jobs.withColumns({f"_inventory_{k}": c for k, c in told.items()})
    inv, mp4, state, risks, looks, kept, pictures = F.col("inventory"), *(F.col(f"_inventory_{k}") for k in told)
    moving = kind.isin("mp4", "video")
    healthy = F.coalesce("healthy", F.lit(True))
    plays = F.coalesce("playback_ok", F.lit(True)) if o.validate_existing else F.lit(True)
    standard = (kind == "mp4") & (mp4 == "standard")
    kept_hevc = (kind == "mp4") & (mp4 == "hevc") & F.lit(not o.reencode_hevc)
    repair = standard & ~(healthy & plays)
    remux = moving & ~repair & ((state == "standard") | ((state == "hevc") & F.lit(not o.reencode_hevc)))
    copy = moving & ~repair & ~remux & (state == "copy-video")
    webp = F.col("webp")
    metadata = F.array_compact(F.array(*(F.when(webp[x], x.upper()) for x in ("icc", "exif", "xmp"))))
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    skip = F.coalesce(
        F.when(standard & ~repair, "already standardized and healthy MP4 (h264/8-bit 4:2:0/aac)"),
        F.when(kept_hevc & ~healthy, "damaged HEVC MP4; --reencode-hevc is required to attempt repair"),
        F.when(kept_hevc, "HEVC MP4 (smaller than h264 and Apple-native; --reencode-hevc to convert anyway)"),
        F.when(moving & (inv.isNull() | (pictures == 0)), "stream preflight failed; original kept"),
        F.when(moving & (F.size(risks) > 0) & F.lit(not o.allow_stream_removal), say("stream safety warning: would remove ", F.array_join(risks, "; "), " (--allow-stream-removal to permit)")),
        F.when(moving & (F.size(looks) > 0) & ~remux & ~copy & F.lit(not o.allow_video_downgrade), say("advanced video safety warning: 8-bit h264 conversion would change ", F.array_join(looks, ", "), " (--allow-video-downgrade to permit)")),
        F.when((kind == "webp") & ~F.coalesce(webp["animated"], F.lit(False)), "static WebP (already standardized)"),
        F.when((kind == "webp") & (F.size(metadata) > 0) & F.lit(not o.allow_stream_removal), say("stream safety warning: animated WebP carries ", F.array_join(metadata, "/"), " metadata that MP4 cannot preserve (--allow-stream-removal to permit)")),
        F.when((kind == "webp") & webp["alpha"] & F.lit(not o.allow_video_downgrade), "advanced video safety warning: 8-bit h264 conversion would change WebP alpha transparency (--allow-video-downgrade to permit)"),
        F.when((kind == "heic") & F.lit(not o.convert_heic), "HEIC (already space-efficient; --convert-heic to convert)"),
        F.when((kind == "heic") & F.lit(not o.on_mac), "HEIC conversion requires macOS (sips)"),
    )
    target = F.when(kind.isin("photo", "heic"), ".webp").otherwise(".mp4")
    bare = F.regexp_replace("path", r"(?<=[^./])\.[^./]+\z", "")
    final = F.coalesce("output", F.concat(bare, target))
    if o.keep_originals:
        final = F.when(final == F.col("path"), F.concat(bare, F.when(repair, ".repaired.mp4").otherwise(".standardized.mp4"))).otherwise(final)
    token = F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 8)
    free_name = F.concat(F.regexp_replace(final, r"\.[^./]+\z", ""), F.lit("."), token, F.regexp_extract(final, r"(\.[^./]+)\z", 1))
    final = F.when((final != F.col("path")) & F.coalesce("taken", F.lit(False)), free_name).otherwise(final)
    action = F.when(repair, "repair").when(remux, "remux").when(copy, "convert audio and copy video").otherwise("convert")
    name = F.element_at(F.split(final, "/"), -1)
    plan = say(
        "would ", action if o.keep_originals else say(action, f" and {o.dispose_label}"), " -> ", name,
        F.when(moving & (kept != ""), say("; preserve ", kept)).otherwise(""),
        F.when(moving & (F.size(risks) > 0), say("; explicitly remove ", F.array_join(risks, "; "))).otherwise(""),
    )
    short = F.when(F.col("free") < required_space(F.col("size")), "filesystem safety check failed: not enough free space") if not o.dry_run else F.lit(None).cast("string")
    fault = F.when(F.col("fault").isNotNull(), say("filesystem safety check failed: ", F.col("fault")))
    status = F.when(fault.isNotNull(), "failed").when(skip.isNotNull(), "skipped").when(F.lit(o.dry_run), "planned").when(short.isNotNull(), "failed").otherwise("ready")
    detail = F.coalesce(fault, skip, short, plan if o.dry_run else action)
    out = jobs.withColumns({"status": status, "detail": detail, "action": action, "copy_video": copy, "stages": stages(kind, repair, remux, state), "final": final})
    return out.select(*given, *(c for c in ("status", "detail", "action", "copy_video", "stages", "final") if c not in given))


def stages(kind: Column, repair: Column, remux: Column, state: Column) -> Column:
    """Attempts in order: the first, then a lossless repair where streams allow it, then a tolerant encode for videos."""
    lossless = kind.isin("mp4", "video") & (state == "standard")
    first = F.when(repair & lossless, "repair-remux").when(repair, "repair-encode").when(remux, "remux").otherwise("convert")
    more = F.when(kind.isin("mp4", "video"), F.array_compact(F.array(F.when(lossless, "repair-remux"), F.lit("repair-encode")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(first), more))


def concluded(attempts: DataFrame, o: Options = Options(dry_run=False)) -> DataFrame:
    """The outcome of jobs that ran: ``attempts(path, final, stage, ok, reason, note, unchanged, size, new_size)``.

    note is "ok", or what was salvaged; then the source is kept and the result counts as repaired.
    """
    name = F.element_at(F.split("final", "/"), -1)
    sizes = F.concat(size_text(F.col("size")), F.lit(" -> "), size_text(F.col("new_size")))
    salvaged = F.col("note") != "ok"
    bigger = F.lit(o.only_if_smaller) & (F.col("new_size") >= F.col("size"))
    done = F.when(F.col("stage").startswith("repair-") | salvaged, "repaired").when(F.col("stage") == "remux", "remuxed").otherwise("converted")
    status = F.when(~F.col("ok") | ~F.col("unchanged"), "failed").when(bigger, "skipped").otherwise(done)
    disposed = F.lit("" if o.keep_originals else f", {o.dispose_label}")
    detail = (
        F.when(~F.col("ok"), F.concat(F.lit("validation failed, original kept: "), F.col("reason")))
        .when(~F.col("unchanged"), "source changed during conversion; output discarded and original kept")
        .when(bigger, F.concat(F.lit("output not smaller ("), sizes, F.lit("), original kept")))
        .otherwise(F.concat(F.lit("-> "), name, F.lit(" ("), sizes, F.lit(")"), F.when(salvaged, "").otherwise(disposed), F.when(salvaged, F.concat(F.lit(", "), F.col("note"), F.lit("; damaged original kept"))).otherwise("")))
    )
    saved = F.when(status.isin("repaired", "remuxed", "converted"), F.col("size") - F.col("new_size")).otherwise(0)
    return attempts.select(status.alias("status"), "path", detail.alias("detail"), saved.cast("bigint").alias("bytes_saved"), (salvaged | F.lit(o.keep_originals)).alias("source_kept"))
