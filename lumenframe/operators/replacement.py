"""The life of a replacement: prepared, committed step by step, rolled back or recovered, and cleaned up.

What happens is a log of events, a row each; an automaton tells the state before and after every event, which events
were out of place, and what recovery would do had the run stopped there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.paths import dir_of, inside, name_of, suffix_of
from .caches import STATES
from .scan import Automaton, folded, traced

PREPARED, STAGED, INSTALLED, DISPOSED = STATES
ABSENT, COMPLETED, ROLLED_BACK, REFUSED = "absent", "completed", "rolled_back", "refused"

#: a source moves to its backup, the output to its final name, the backup goes, then its sidecars, then the record
LIFE = Automaton(
    (ABSENT, *STATES, COMPLETED, ROLLED_BACK, REFUSED),
    {
        **{(s, "prepare"): PREPARED for s in (ABSENT, COMPLETED, ROLLED_BACK, REFUSED)},
        (PREPARED, "refuse"): REFUSED,
        (PREPARED, "stage"): STAGED,
        (STAGED, "install"): INSTALLED,
        (INSTALLED, "dispose"): DISPOSED,
        (DISPOSED, "sidecar"): DISPOSED,
        (DISPOSED, "cleanup"): COMPLETED,
        (STAGED, "roll back"): ROLLED_BACK,
        (INSTALLED, "roll back"): ROLLED_BACK,
        (PREPARED, "recover"): ROLLED_BACK,
        (STAGED, "recover"): ROLLED_BACK,
        (INSTALLED, "recover"): COMPLETED,
        (DISPOSED, "recover"): COMPLETED,
    },
)


def decision_in(state: Column) -> Column:
    """What recovery does with a replacement that stopped in ``state``: finish, discard or restore; null where nothing is left to do."""
    return F.when(state == PREPARED, "discard").when(state == STAGED, "restore").when(state.isin(INSTALLED, DISPOSED), "finish")


def history(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds before, after, legal, fault and decision to ``log(..., event)``: see ``traced``; fault names an event out of place."""
    t = traced(log, LIFE, keys, order)
    fault = F.when(~F.col("legal"), F.concat(F.coalesce("event", F.lit("nothing")), F.lit(" in "), F.col("before")))
    return t.withColumns({"fault": fault, "decision": decision_in(F.col("after"))})


def standing(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, state, events, illegal, decision: how each replacement stands at the end of its log."""
    return folded(traced(log, LIFE, keys, order), keys, order).withColumn("decision", decision_in(F.col("state")))


def _same(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in ("d", "i", "s", "m"):
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def prepared(requests: DataFrame) -> DataFrame:
    """Adds directory, backup and problem to ``requests(id, root, source, final, temporary, identity, expected)``; problem is null where a replacement can begin.

    ``identity`` is the source's now, ``expected`` (may be null) the one that was validated; both structs.  The directory is beside the source and
    named by the id, so a plan repeats.
    """
    here = dir_of(F.col("source"))
    directory = F.concat(here, F.when(here == "", "").otherwise("/"), F.lit(V.TRANSACTION), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 32))
    problem = (
        F.when(~inside(F.col("source"), F.col("root")), F.concat(F.lit("source escapes transaction root: "), F.col("source")))
        .when((here != dir_of(F.col("final"))) | (here != dir_of(F.col("temporary"))), "source, temporary output, and final output must share a directory")
        .when(F.col("expected").isNotNull() & ~_same("identity", "expected"), "source changed before transaction preparation")
    )
    return requests.withColumns({"directory": directory, "backup": F.concat(directory, F.lit("/"), name_of(F.col("source"))), "problem": problem})


def manifest_problem() -> Column:
    """The first rule that a row of a manifest (manifest, version, root, source, final, temporary, backup, sidecars, disposal_root) breaks; null for a sound one."""
    directory, here = dir_of(F.col("manifest")), dir_of(F.col("source"))
    local = F.startswith(name_of(directory), F.lit(V.TRANSACTION)) & (dir_of(directory) == here) & (dir_of(F.col("backup")) == directory) & (name_of(F.col("backup")) == name_of(F.col("source")))
    aside = lambda s: (dir_of(s) != here) | ~F.lower(suffix_of(name_of(s))).isin(*V.SIDECAR)
    return (
        F.when(F.coalesce(F.col("version") != 1, F.lit(True)), F.concat(F.lit("unsupported transaction version in "), F.col("manifest")))
        .when(~F.coalesce(inside(F.col("source"), F.col("root")), F.lit(False)), "transaction source escapes its root")
        .when(~F.coalesce(local, F.lit(False)), "transaction backup is not local to its source")
        .when(F.coalesce((dir_of(F.col("final")) != here) | (dir_of(F.col("temporary")) != here), F.lit(True)), "transaction output paths are not local to their source")
        .when(F.exists(F.coalesce("sidecars", F.array().cast("array<string>")), aside), "transaction contains an invalid sidecar path")
        .when(F.col("disposal_root") != F.col("root"), "transaction disposal root does not match its source root")
    )


def committed(transactions: DataFrame, observed: DataFrame) -> DataFrame:
    """id, seq, event, detail: the events of committing each of ``transactions(id, source, final, temporary, source_identity, output_identity, disposable, sidecars)``.

    ``observed(path, identity, output_identity)`` has a row per existing file.  A source or an output that changed, or a file that
    appeared under the final name, refuses the commit.  ``disposable`` false: the original can't be disposed of, and what was done is rolled back.
    Each of ``sidecars`` that exists goes, in order, before the record does.  Three left joins on path, and one on existing sidecars, all by shuffle: files and
    transactions grow alike, and what Spark expects of exploded rows is far too little to choose a broadcast by.
    """
    t = transactions
    for place in ("source", "final", "temporary"):
        seen = observed.select(F.col("path").alias(place), F.col("identity").alias(f"_{place}_id"), F.col("output_identity").alias(f"_{place}_out"), F.lit(True).alias(f"_{place}"))
        t = t.join(seen.hint("shuffle_merge"), place, "left")
    there = lambda p: F.coalesce(F.col(f"_{p}"), F.lit(False))
    refusal = (
        F.when(~(there("source") & F.col("_source_id").eqNullSafe(F.col("source_identity"))), "source changed before transaction commit")
        .when(~(there("temporary") & F.col("_temporary_out").eqNullSafe(F.col("output_identity"))), "validated output changed before transaction commit")
        .when((F.col("final") != F.col("source")) & there("final"), F.concat(F.lit("output appeared during conversion: "), name_of(F.col("final"))))
    )
    t = t.withColumn("_refusal", refusal)
    aside = transactions.select("id", F.posexplode("sidecars").alias("_n", "path")).join(observed.select("path").hint("shuffle_merge"), "path", "left_semi")
    aside = aside.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_n", "path"))).alias("_aside"))  # a few per file
    t = t.join(aside.hint("shuffle_merge"), "id", "left")
    step = lambda event, detail=None: F.struct(F.lit(event).alias("event"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    none = F.array().cast("array<struct<_n:int,path:string>>")
    gone = F.transform(F.coalesce("_aside", none), lambda s: step("sidecar", s["path"]))
    done = F.concat(F.array(step("prepare"), step("stage"), step("install"), step("dispose")), gone, F.array(step("cleanup")))
    undone = F.array(step("prepare"), step("stage"), step("install"), step("roll back", F.lit("could not dispose of original")))
    events = F.when(F.col("_refusal").isNotNull(), F.array(step("prepare"), step("refuse", F.col("_refusal")))).when(~F.col("disposable"), undone).otherwise(done)
    return t.select("id", F.posexplode(events).alias("seq", "e")).select("id", "seq", "e.event", "e.detail")


def sidecars_left(log: DataFrame, sidecars: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, path) of ``sidecars(keys, path)`` that the current replacement of their key hasn't disposed of yet.

    ``log(keys, order, event, detail)``: the sidecars of earlier replacements, before the last ``prepare`` that was in place, don't count.
    """
    t = history(log, keys, order).where("legal")
    begun = t.where("event = 'prepare'").groupBy(*keys).agg(F.max(F.struct(*order)).alias("_begun"))
    gone = t.where("event = 'sidecar'").select(*keys, F.struct(*order).alias("_place"), F.col("detail").alias("path"))
    gone = gone.join(begun, keys).where("_place > _begun").select(*keys, "path").distinct()
    return sidecars.join(gone, [*keys, "path"], "left_anti")
