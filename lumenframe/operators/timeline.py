"""Packet and frame timelines: spans and first timestamps per stream.  Partial aggregates, constant memory per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import number


def packet_fields(lines: DataFrame, line: str = "value") -> DataFrame:
    """stream_index, pts_time, dts_time, duration_time of lines like ``stream_index=0|pts_time=1.0``."""
    fields = F.str_to_map(F.col(line), F.lit(r"[\|]"), F.lit("="))
    return lines.select("*", *(fields[n].alias(n) for n in ("stream_index", "pts_time", "dts_time", "duration_time")))


def packet_times(packets: DataFrame) -> DataFrame:
    """Adds start and end.  An empty or missing pts falls to dts; a text that is no number drops the row."""
    start = number(F.coalesce(F.nullif("pts_time", F.lit("")), F.nullif("dts_time", F.lit(""))))
    length = number(F.coalesce(F.nullif("duration_time", F.lit("")), F.lit("0")))
    df = packets.withColumn("start", start).withColumn("_length", length)
    df = df.where("stream_index is not null and stream_index <> '' and start is not null and _length is not null")
    return df.withColumn("end", F.col("start") + F.greatest(F.lit(0.0), F.col("_length"))).drop("_length")


def packet_spans(packets: DataFrame, keys: tuple = ("path", "stream_index")) -> DataFrame:
    """keys, span: seconds from the first start to the last end of a stream."""
    return packet_times(packets).groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("end") - F.min("start")).alias("span"))


def first_starts(frames: DataFrame, keys: tuple = ("path", "stream_index"), order: str = "pos") -> DataFrame:
    """keys, start: the first timestamp of a stream that is a number, in frame order."""
    ts = F.coalesce(number(F.nullif("best_effort_timestamp_time", F.lit(""))), number(F.nullif("pts_time", F.lit(""))))
    return frames.withColumn("_ts", ts).where("_ts is not null and stream_index is not null").groupBy(*keys).agg(F.min_by("_ts", order).alias("start"))
