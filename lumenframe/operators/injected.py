"""Functions of the caller over rows: one bad row becomes a failed outcome and not a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..running import checkpoints


class Cancelled(Exception):
    """Raised by a function whose work was taken back."""


def outcomes(jobs: DataFrame, work: Callable[[dict], tuple[str, str, int]]) -> DataFrame:
    """status, path, detail, bytes_saved of ``work`` (status, detail, bytes saved of a job as a dict) for each row of ``jobs(path, ...)``.

    An exception makes its row "failed", with what it says; ``Cancelled`` makes it "skipped".  Other rows go on.
    The function goes to the workers, a batch of rows at a time.
    """
    checkpoints(jobs.sparkSession)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    status, detail, saved = work(row)
                except Cancelled:
                    status, detail, saved = "skipped", "cancelled; partial output removed, original kept", 0
                except Exception as e:  # noqa: BLE001
                    status, detail, saved = "failed", f"unexpected processing error: {e}", 0
                out.append((status, row["path"], detail, saved))
            yield pd.DataFrame(out, columns=["status", "path", "detail", "bytes_saved"])

    return jobs.mapInPandas(each, S.OUTCOME)


def told(work: Callable, kind: str) -> Callable[..., Column]:
    """``work`` as a function of columns with results of ``kind``: null where a row raises.  For statuses, health and completions that a caller knows."""

    @F.pandas_udf(kind)
    def each(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns, strict=True):
            try:
                out.append(work(*values))
            except Exception:  # noqa: BLE001
                out.append(None)
        return pd.Series(out, dtype=object)

    return each


def open_mp4s(jobs: DataFrame, status: Callable, health: Callable, completed: Callable, standard: tuple, validate: bool) -> DataFrame:
    """``library.open_jobs`` with functions of the path in place of tables: status (string), health and completed (boolean)."""
    checkpoints(jobs.sparkSession)
    path = F.col("path")
    good = F.coalesce(told(status, "string")(path).isin(*standard), F.lit(False))
    if validate:
        good = good & F.coalesce(told(health, "boolean")(path), F.lit(False))
    done = F.coalesce(told(completed, "boolean")(path), F.lit(False))
    return jobs.where(~done & ~((F.col("kind") == "mp4") & good))
