"""File names: what a stem says, how it is cleaned and tagged.  All are Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import values as V

# patterns of names; \z ends the text, where $ would also match before a line break
GUID = r"\A(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9a-fA-F]{32})\z"
PROTECTED = r"(?i)\A(?:" + "|".join(V.CAMERA_PREFIXES) + r")[-_]?E?\d+(?:[-_]\d+)*\z"
UNCLEANED = r"(?i)\A(?:screen ?shot|screenshot|whatsapp)"
DATED = r"\A\d{4}-\d{2}-\d{2}"
COPY_OF = r"(?is)\Acopy of[ _]+(.+)\z"
TAG = r"(?s)\A(.*?) *\[(?:([^\]\s]+) +)?(\d+)\]\z"
TAG_SITE = r"(?s)\A(.*?) *\[([^\]\s]+\.[A-Za-z]{2,})\]\z"
BRACKET = r"\[[^\]]*\]\z"
PAREN = r"(?s)\A(.*?)[ _]*\((\d+)\)\z"
DASH = r"(?s)\A(.*?[^\s\d]) *[-–] *(\d+)\z"
COPY_PAREN = r"(?is)\A(.*?)[ _-]*\(\s*copy\s*(\d+)?\s*\)\z"
COPY_TAIL = r"(?is)\A(.*?)[ _-]+copy(?:[ _-]*(\d+))?\z"
SITE = r"(?i)(?:^|(?<=[-_.\s]))((?:[A-Za-z0-9]+\.)+(?:" + "|".join(V.SITE_ENDS) + r"))(?=\z|[-_\s])"


def is_guid(stem: Column) -> Column:
    return stem.rlike(GUID)


def letter_digit_flips(stem: Column) -> Column:
    """How often letters and digits alternate: runs less one."""
    runs = F.regexp_replace(F.regexp_replace(stem, "[0-9]+", "0"), "[A-Za-z]+", "a")
    return F.length(runs) - 1


def looks_random(stem: Column) -> Column:
    """One token of letters and digits that alternate, as generated names do."""
    digits = F.length(F.regexp_replace(stem, "[^0-9]", ""))
    return stem.rlike(r"\A[A-Za-z0-9]{6,}\z") & ~stem.rlike(PROTECTED) & (digits >= 2) & (F.length(stem) - digits >= 2) & (letter_digit_flips(stem) >= 2)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _number(text: Column) -> Column:
    return text.try_cast("bigint")


_PATTERNS = {"tag": (TAG, 3), "site": (TAG_SITE, None), "paren": (PAREN, 2), "dash": (DASH, 2), "copy_paren": (COPY_PAREN, 2), "copy_tail": (COPY_TAIL, 2)}


def with_parsed(df: DataFrame, stem: str = "stem") -> DataFrame:
    """Adds base, number, is_dup, site, opaque of a stem.

    The form of a name decides in order: a tag with a number, a tag with a site, any other bracket (opaque),
    a number in parentheses, a number after a dash, a copy mark.  A site inside the base is taken out of it.
    Step by step, so that each pattern is matched once a row and the plan stays small.
    """
    prefixed = F.col(stem).rlike(COPY_OF)
    df = df.withColumn("_pre", prefixed).withColumn("_s", F.when(F.col("_pre"), _part(F.col(stem), COPY_OF, 1)).otherwise(F.col(stem)))
    s, pre = F.col("_s"), F.col("_pre")
    form = (
        F.when(s.rlike(TAG), "tag")
        .when(s.rlike(TAG_SITE), "site")
        .when(s.rlike(BRACKET), "opaque")
        .when(s.rlike(PAREN), "paren")
        .when(s.rlike(DASH), "dash")
        .when(~pre & s.rlike(COPY_PAREN), "copy_paren")
        .when(~pre & s.rlike(COPY_TAIL), "copy_tail")
        .otherwise("plain")
    )
    df = df.withColumn("_form", form)
    base, number = F.when(F.col("_form") == "", s), F.when(F.col("_form") == "", F.lit(None).cast("bigint"))
    for name, (pattern, group) in _PATTERNS.items():
        base = base.when(F.col("_form") == name, _part(s, pattern, 1))
        if group:
            number = number.when(F.col("_form") == name, _number(_part(s, pattern, group)))
    tagged = F.when(F.col("_form") == "tag", F.nullif(_part(s, TAG, 2), F.lit(""))).when(F.col("_form") == "site", _part(s, TAG_SITE, 2))
    df = df.withColumns({"_base": base.otherwise(s), "number": number, "_tagged": tagged})
    df = df.withColumn("_found", F.when((F.col("_form") != "opaque") & F.col("_tagged").isNull(), F.nullif(_part(F.col("_base"), SITE, 1), F.lit(""))))
    # only the first place is taken out
    out = F.regexp_replace("_base", r"(?s)\A(.*?)" + SITE.replace("(?i)", "(?i:", 1) + r")(.*)\z", "$1$3")
    return df.withColumns(
        {"base": F.when(F.col("_found").isNotNull(), out).otherwise(F.col("_base")), "is_dup": pre | F.col("_form").isin("copy_paren", "copy_tail"), "site": F.coalesce("_tagged", "_found"), "opaque": F.col("_form") == "opaque"}
    ).drop("_pre", "_s", "_form", "_base", "_tagged", "_found")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    import unicodedata

    some = text[text.notna()]
    return some.map(lambda t: unicodedata.normalize("NFC", t)).reindex(text.index)


def composed(text: Column) -> Column:
    """Composed Unicode form.  Plain ASCII needs no Python: such rows go there as nulls and are passed over."""
    return F.coalesce(_nfc(F.when(~text.rlike(r"\A[\x00-\x7F]*\z"), text)), text)


def with_cleaned(df: DataFrame, base: str = "base", to: str = "cleaned", compose: bool = False) -> DataFrame:
    """Adds a readable title: separators to blanks, words in lower case capitalised but for small words inside.

    ``compose`` first brings the text to composed form, by a Pandas UDF where it isn't ASCII.
    """
    df = df.withColumn("_t", composed(F.col(base)) if compose else F.col(base))
    spaced = F.regexp_replace("_t", r"[_.]+", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[A-Za-z])[-–]|[-–](?=[A-Za-z])", " ")
    spaced = F.btrim(F.regexp_replace(spaced, r"\s+", " "), F.lit(" -–_."))
    df = df.withColumn("_words", F.split(spaced, " "))

    def title(word: Column, i: Column) -> Column:
        plain = (word == F.lower(word)) & (word != F.upper(word))
        capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100_000))
        return F.when(plain & ~((i > 0) & word.isin(*V.SMALL_WORDS)), capital).otherwise(word)

    kept = F.col("_t").rlike(PROTECTED) | F.col("_t").rlike(UNCLEANED)
    return df.withColumn(to, F.when(kept, F.trim("_t")).otherwise(F.array_join(F.transform("_words", title), " "))).drop("_t", "_words")


def tag(site: Column, n: Column, width: Column) -> Column:
    """" [site 07]" in its forms; empty without site and number."""
    digits = n.cast("string")
    padded = F.concat(F.when(F.length(digits) < width, F.repeat(F.lit("0"), width - F.length(digits))).otherwise(""), digits)
    inner = F.concat_ws(" ", F.nullif(site, F.lit("")), padded)
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" ["), inner, F.lit("]")))


def numbered_series(df: DataFrame, keys: list[str], order: str = "name") -> DataFrame:
    """Adds ``seq`` (null: no number) and ``width`` to members with number and is_dup, per series of ``keys``.

    Numbered members count from 1 by number and name, copies go on after them; a copy alone is plain.  Two digits
    from ten on.  Scale: places come from ``row_numbers``, which splits a series however long, and counts from
    partial sums, one row per series.
    """
    from ..operators.order import row_numbers

    cls = F.when(F.col("is_dup"), 2).when(F.col("number").isNotNull(), 1).otherwise(0)
    placed = row_numbers(df.withColumn("_class", cls).withColumn("_number", F.coalesce("number", F.lit(0))), keys, ["_class", "_number", order], "_at")
    counts = placed.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(*(F.count_if(F.col("_class") == k).alias(f"_n{k}") for k in range(3)))
    both = placed.join(counts, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)))
    alone = (F.col("_n0") == 0) & (F.col("_n1") == 0) & (F.col("_n2") == 1)
    last = F.when(alone, 0).otherwise(F.col("_n1") + F.col("_n2"))
    seq = F.when((F.col("_class") > 0) & ~alone, F.col("_at") - F.col("_n0"))
    return both.select(*(F.col(c) for c in df.columns), seq.cast("bigint").alias("seq"), F.when(last >= 10, 2).otherwise(1).alias("width"))


def date_prefixed(stem: Column, date: Column) -> Column:
    return F.when(stem.rlike(DATED), stem).otherwise(F.concat_ws(" ", date, stem))


def media_date(metadata: Column, created: Column, mtime_ns: Column) -> Column:
    """The first capture date there is: of the metadata tool, of the container, of the file (session time zone)."""
    iso = r"\A\d{4}-\d{2}-\d{2}\z"
    file = F.date_format(F.timestamp_micros(F.floor(mtime_ns / 1000).cast("bigint")), "yyyy-MM-dd")
    return F.coalesce(F.when(F.trim(metadata).rlike(iso), F.trim(metadata)), F.when(created.rlike(DATED), F.substring(created, 1, 10)), file)


def unique_name(stem: Column, suffix: Column, key: Column) -> Column:
    """A name with eight hex digits that its key decides (where a random one would differ at each run)."""
    return F.concat(stem, F.lit("."), F.substring(F.sha2(key.cast("binary"), 256), 1, 8), suffix)
