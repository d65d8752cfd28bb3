"""Whether the tools at hand can do the work, from what they print.  One row per host, so fleets can be checked at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import version_pair

MINIMUM = (6, 0)
HINT = "install/upgrade with `brew install ffmpeg webp` (or your system package manager)"


def report(hosts: DataFrame, require_video: bool = True, require_photos: bool = True, require_animated_webp: bool = False) -> DataFrame:
    """errors, warnings (arrays) and ok for ``hosts(has_ffmpeg, has_ffprobe, has_cwebp, ffmpeg_version, encoders, help, demuxers, decoders, probed_codecs)``."""
    word = lambda text, w: F.coalesce(F.col(text).rlike(rf"\b{w}\b"), F.lit(False))
    found = F.col("has_ffmpeg") & F.col("has_ffprobe")
    video = F.lit(require_video or require_animated_webp)
    errors = [F.when(video & ~F.col(f"has_{t}"), f"{t} is not on PATH; {HINT}") for t in ("ffmpeg", "ffprobe")]
    errors += [F.when(video & found & ~word("encoders", e), f"FFmpeg is missing the {e} encoder; install a full FFmpeg build with GPL/libx264 support") for e in ("libx264", "aac")]
    errors.append(F.when(video & found & ~F.contains("help", F.lit("-progress")), "FFmpeg lacks -progress support required for conversion feedback"))
    animated = F.coalesce(F.col("demuxers").rlike(r"(?m)^\s*D\s+webp_anim\s"), F.lit(False)) & F.coalesce(F.col("decoders").rlike(r"(?m)^\s*V\S*\s+webp_anim\s"), F.lit(False))
    errors.append(F.when(F.lit(require_animated_webp) & found & ~animated, "FFmpeg lacks native animated WebP decoding/demuxing; upgrade to FFmpeg 9 or newer to convert animated .webp files"))
    errors.append(F.when(video & found & (F.size(F.array_except(F.array(F.lit("h264"), F.lit("aac")), F.col("probed_codecs"))) > 0), "ffprobe JSON stream inventory failed on a generated MP4; install matching ffmpeg and ffprobe builds"))
    errors.append(F.when(F.lit(require_photos) & ~F.col("has_cwebp"), f"cwebp is not on PATH; {HINT}"))
    line = F.get(F.split(F.trim(F.col("ffmpeg_version")), "\n"), F.lit(0))
    v = version_pair(line)
    least = F.struct(F.lit(MINIMUM[0]).alias("major"), F.lit(MINIMUM[1]).alias("minor"))
    shown = F.concat(v["major"].cast("string"), F.lit("."), v["minor"].cast("string"))
    warnings = [
        F.when(video & found & v.isNull(), "could not parse FFmpeg version; capability smoke test will decide"),
        F.when(video & found & (v < least), F.concat(F.lit("FFmpeg "), shown, F.lit(f" is older than the tested minimum {MINIMUM[0]}.{MINIMUM[1]}; {HINT}"))),
        F.when(video & found & ~F.contains("help", F.lit("-display_rotation")), "FFmpeg lacks -display_rotation; rotated re-encodes will fail safely. Upgrade FFmpeg to preserve rotation metadata"),
    ]
    out = hosts.withColumns({"errors": F.array_compact(F.array(*errors)), "warnings": F.array_compact(F.array(*warnings)), "version": line})
    return out.withColumn("ok", F.size("errors") == 0)


def stream_groups(returncode: Column, help_text: Column) -> Column:
    """Whether the probe of a host can list stream groups: its full help names the option."""
    return F.coalesce((returncode == 0) & F.contains(help_text, F.lit("-show_stream_groups")), F.lit(False))
