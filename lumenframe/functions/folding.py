"""Full case folding of text, by Unicode's rules as Python knows them."""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Letters that fold to one letter, and those that fold to several."""
    every = {c: c.casefold() for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if c.casefold() != c}
    return {c: f for c, f in every.items() if len(f) == 1}, {c: f for c, f in every.items() if len(f) > 1}


def folded(text: Column) -> Column:
    """``text`` in full case folding: texts that differ by case alone are equal then, as Straße and STRASSE are.  Null stays null.

    ASCII takes the short way.  Else letters that fold to one go by ``translate``, and only texts with one of the about
    hundred that fold to several are looked at letter by letter.
    """
    one, several = foldings()
    plain = F.translate(text, "".join(one), "".join(one.values()))
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    long = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(~text.rlike(r"[^\x00-\x7f]"), F.lower(text)).when(plain.rlike(f"[{''.join(several)}]"), long).otherwise(plain)
