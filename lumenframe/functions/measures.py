"""Numbers, rates, dates, sizes and clocks as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import values as V


def bound(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` names it; a plain expression would be copied to each place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def number(text: Column) -> Column:
    """A double, or null.  Forms that only Java reads ("1.0d") are no numbers."""
    return F.when(~text.rlike(r"[dDfF]\s*\z"), text.try_cast("double"))


def rate_of_parts(text: Column) -> Column:
    """"30000/1001" as a double; null without a slash or with a zero below it."""
    parts = F.split(text, "/", 2)
    return F.when(F.contains(text, F.lit("/")), F.try_divide(number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))))


def rate(text: Column) -> Column:
    """A rate written as a fraction of whole numbers or as a number."""
    fraction = F.when(text.rlike(r"\A\s*[-+]?\d+/\d+\s*\z"), rate_of_parts(F.trim(text)))
    return F.coalesce(fraction, F.when(~F.contains(text, F.lit("/")), number(text)))


def duration_agrees(source: Column, output: Column) -> Column:
    return F.coalesce(F.abs(source - output) <= F.greatest(F.lit(1.0), source * 0.02), F.lit(True))


def av_tolerance(frame_rate: Column) -> Column:
    r = rate(frame_rate)
    return F.when(r > 0, F.greatest(F.lit(0.05), F.least(F.lit(0.15), F.lit(1.5) / r))).otherwise(0.05)


def turned(rotation: Column) -> Column:
    return F.pmod(rotation, F.lit(360.0))


def colour(field: str, value: Column) -> Column:
    if field != "color_range":
        return value
    return F.when(value.isNull() | value.isin("unknown", "tv", "mpeg", "limited"), "limited").when(value.isin("pc", "jpeg", "full"), "full").otherwise(value)


def layout(value: Column) -> Column:
    v = F.replace(F.lower(value), F.lit(" "), F.lit(""))
    return F.when(value.isNull() | value.isin("", "unknown"), None).when(v.startswith("5.1"), "5.1").otherwise(v)


def capture_date(value: Column) -> Column:
    """A date, with the time where one is whole, in one form; other texts as they are."""
    text = F.trim(F.coalesce(value, F.lit("")))
    day, full = r"\A(\d{4})[:-](\d{2})[:-](\d{2})", r"\A(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
    get = lambda p, k: F.regexp_extract(text, p, k)
    date = F.concat_ws("-", *(get(day, k) for k in (1, 2, 3)))
    time = F.concat_ws(":", *(get(full, k) for k in (4, 5, 6)))
    return F.when(~text.rlike(day), text).when(text.rlike(full), F.concat_ws(" ", date, time)).otherwise(date)


def capture_dates(tags: Column) -> Column:
    """The dates of the strongest tier of tags that has any: original, created, generic."""
    tiers = (
        lambda k: (k == "ExifIFD:DateTimeOriginal") | (k.startswith("XMP-") & k.endswith(":DateTimeOriginal")),
        lambda k: (k == "IPTC:DateCreated") | (k.startswith("XMP-") & k.endswith(":DateCreated")),
        lambda k: k.startswith("XMP-") & k.endswith(":CreateDate"),
    )
    found = [F.array_sort(F.array_distinct(F.filter(F.transform(F.map_values(_keys(tags, t)), capture_date), lambda d: d != ""))) for t in tiers]
    return F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).when(F.size(found[2]) > 0, found[2]).otherwise(F.array().cast("array<string>"))


def _keys(tags: Column, wanted) -> Column:
    return F.map_filter(tags, lambda k, v: wanted(k))


def metadata_kept(source: Column, output: Column, has_tool: bool, ext: Column | None = None, head: Column | None = None, written: Column | None = None) -> Column:
    """Reason why a photo's capture date is lost, or null.  Without the tool: whether an EXIF block vanished."""
    if has_tool:
        return F.when((F.size(source) > 0) & ~F.arrays_overlap(source, output), "capture date metadata not preserved in output")
    block = (ext.isin(".jpg", ".jpeg") & (F.position(F.lit("Exif\0\0").cast("binary"), head) > 0)) | ((ext == ".png") & (F.position(F.lit("eXIf").cast("binary"), head) > 0))
    return F.when(block & (F.position(F.lit("EXIF").cast("binary"), written) == 0), "source EXIF block missing from output WebP")


def size_text(n: Column) -> Column:
    """B whole, then KB, MB, GB with one decimal (half up)."""
    form = lambda unit, k: F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).when(n < 1024**2, form("KB", 1)).when(n < 1024**3, form("MB", 2)).otherwise(form("GB", 3))


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("bigint"), F.pmod(s, F.lit(60))
    short = F.concat_ws(":", two(m), two(r))
    return F.when(seconds.isNull() | (seconds < 0), "--:--").when(h > 0, F.concat_ws(":", h.cast("string"), short)).otherwise(short)


def percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), (current / total * 100).cast("int"))))


def progress_text(action: Column, label: Column, current: Column, total: Column, speed: Column, width: int = 22) -> Column:
    p = percent(current, total)
    filled = F.least(F.lit(width), F.floor(F.lit(width) * p / 100).cast("int"))
    bar = F.rpad(F.concat(F.repeat(F.lit("="), filled), F.when(filled < width, ">").otherwise("")), width, "-")
    shown = F.when(p.isNull(), "  --%").otherwise(F.concat(F.lpad(p.cast("string"), 4, " "), F.lit("%")))
    has = speed.isNotNull() & (speed != 0)
    fast = F.when(has, F.concat(F.lit(" "), F.format_string("%.2f", speed.cast("double")), F.lit("x"))).otherwise("")
    eta = F.when((total != 0) & (speed > 0), F.concat(F.lit(" ETA "), clock(F.greatest(F.lit(0.0), total - current) / speed))).otherwise("")
    named = F.concat(action, F.repeat(F.lit(" "), F.greatest(F.lit(0), 10 - F.length(action))))
    return F.concat(named, F.lit(" "), label, F.lit(" ["), F.coalesce(bar, F.lit("?" * width)), F.lit("] "), shown, F.lit(" "), clock(current), F.lit("/"), clock(total), fast, F.coalesce(eta, F.lit("")))


def speed(value: Column) -> Column:
    return number(F.rtrim(value, F.lit("x")))


def required_space(size: Column) -> Column:
    """Bytes to keep free for a conversion: five quarters of the source, 64 MiB at least."""
    return F.greatest(F.lit(64 * 1024 * 1024).cast("bigint"), F.floor(size * 1.25).cast("bigint"))


def last_lines(text: Column, n: int, none: str = "(no stderr)") -> Column:
    """The last n lines that aren't blank, joined by " | "; ``none`` where there are none."""
    lines = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    kept = F.when(F.size(lines) > n, F.slice(lines, -n, n)).otherwise(lines)
    return F.when(F.size(lines) > 0, F.array_join(kept, " | ")).otherwise(none)


def version_pair(text: Column) -> Column:
    """struct<major, minor> after the word "version", or null."""
    p = r"(?i)\bversion\s+(\d+)\.(\d+)"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).cast("int").alias("major"), F.regexp_extract(text, p, 2).cast("int").alias("minor")))


def webp_flags(head: Column) -> Column:
    """struct<animated, alpha, icc, exif, xmp> of a file's first 21 bytes; all false unless it is an extended WebP."""
    ok = (F.length(head) >= 21) & (F.substring(head, 1, 4) == F.lit("RIFF").cast("binary")) & (F.substring(head, 9, 4) == F.lit("WEBP").cast("binary")) & (F.substring(head, 13, 4) == F.lit("VP8X").cast("binary"))
    flags = F.conv(F.hex(F.substring(head, 21, 1)), 16, 10).cast("int")
    bit = lambda b: F.coalesce(ok & (flags.bitwiseAND(F.lit(b)) != 0), F.lit(False))
    return F.struct(bit(0x02).alias("animated"), bit(0x10).alias("alpha"), bit(0x20).alias("icc"), bit(0x08).alias("exif"), bit(0x04).alias("xmp"))


SAMPLE = 64 * 1024


@F.pandas_udf(StringType())
def sampled_digest(content: pd.Series) -> pd.Series:
    """BLAKE2b-128 over samples of 64 KiB at the start, around the middle and at the end, each after its offset; no built-in has this digest."""
    import hashlib

    def one(data: bytes) -> str | None:
        if data is None:
            return None
        h, n = hashlib.blake2b(digest_size=16), len(data)
        for at in sorted({0, max(0, n // 2 - SAMPLE // 2), max(0, n - SAMPLE)}):
            h.update(at.to_bytes(8, "little"))
            h.update(data[at : at + SAMPLE])
        return h.hexdigest()

    return content.map(one)
