"""Registered queries over the driver's tables, each with the SQL that DuckDB answers alike.

The tables hold no media, so each query first makes media-shaped columns from a table by plain expressions (the
adapter), the same in both languages, and then applies operators of this package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .functions import inventory as I
from .functions import measures as M
from .functions import names as N
from .functions import paths as P
from .operators import caches, library, renames, timeline, validation
from .plans import capabilities, commands, decision

_FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    """Registers a function (spark, table reader) under its name."""

    def add(f: Callable) -> Callable:
        _FOUND[f.__name__] = (lambda spark, sf_dir: f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")), sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _FOUND.items() if v[1]}


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---------------------------------------------------------------- names

_STEM = "replace(p_name, ' ', '_') || ' (' || p_partkey || ')'"


@query(
    """
    with p as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as n, count(*) over (partition by p_name) as c from part),
    w as (select *, string_split(p_name, ' ') as words from p)
    select p_partkey, p_name || ' (' || p_partkey || ')' as stem,
      array_to_string(list_transform(words, lambda x: upper(x[1]) || x[2:]), ' ') || ' [' || case when c >= 10 and n < 10 then '0' else '' end || n || ']' as final
    from w
    """
)
def name_series(spark, t):
    """Numbered series closed up: stems "red_bolt (17)" become "Red Bolt [02]"."""
    df = t("part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" ("), _s("p_partkey"), F.lit(")")).alias("name"), F.concat("p_name", F.lit(" ("), _s("p_partkey"), F.lit(")")).alias("stem"))
    df = N.with_cleaned(N.with_parsed(df, "name"))
    df = N.numbered_series(df, ["cleaned"])
    return df.select("p_partkey", "stem", F.concat("cleaned", N.tag(F.col("site"), F.col("seq"), F.col("width"))).alias("final"))


_FORMS = """
    case p_partkey % 9
      when 0 then b || ' (' || k || ')' when 1 then b || ' [' || k || ']' when 2 then b || ' - ' || k when 3 then 'Copy of ' || b
      when 4 then b || ' copy ' || k when 5 then b || ' [Example.com ' || k || ']' when 6 then b || ' [ue73up]'
      when 7 then b || '-Example.com-' || k else b || ' (copy)' end
"""


def _forms() -> Column:
    b, k = F.replace("p_name", F.lit(" "), F.lit("_")), _s("p_partkey")
    parts = [(b, " (", k, ")"), (b, " [", k, "]"), (b, " - ", k), ("Copy of ", b), (b, " copy ", k), (b, " [Example.com ", k, "]"), (b, " [ue73up]"), (b, "-Example.com-", k), (b, " (copy)")]
    out = F.lit(None).cast("string")
    for i, p in enumerate(parts):
        out = F.when(F.col("p_partkey") % 9 == i, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))).otherwise(out)
    return out


@query(
    f"""
    with f as (select p_partkey, {_FORMS} as stem from (select *, replace(p_name, ' ', '_') as b, cast(p_partkey as varchar) as k from part)),
    a as (select *, regexp_matches(stem, '(?i)^copy of[ _]+.+$') as pre, case when regexp_matches(stem, '(?i)^copy of[ _]+.+$') then regexp_extract(stem, '(?i)^copy of[ _]+(.+)$', 1) else stem end as s from f),
    b as (select *, case
        when regexp_matches(s, '^.*? *\\[(?:[^\\]\\s]+ +)?\\d+\\]$') then 'tag'
        when regexp_matches(s, '^.*? *\\[[^\\]\\s]+\\.[A-Za-z]{{2,}}\\]$') then 'site'
        when regexp_matches(s, '\\[[^\\]]*\\]$') then 'opaque'
        when regexp_matches(s, '^.*?[ _]*\\(\\d+\\)$') then 'paren'
        when regexp_matches(s, '^.*?[^\\s\\d] *[-–] *\\d+$') then 'dash'
        when not pre and regexp_matches(s, '(?i)^.*?[ _-]*\\(\\s*copy\\s*\\d*\\s*\\)$') then 'cparen'
        when not pre and regexp_matches(s, '(?i)^.*?[ _-]+copy(?:[ _-]*\\d+)?$') then 'ctail' else 'plain' end as form from a),
    c as (select *, case form
        when 'tag' then regexp_extract(s, '^(.*?) *\\[(?:([^\\]\\s]+) +)?(\\d+)\\]$', 1) when 'paren' then regexp_extract(s, '^(.*?)[ _]*\\((\\d+)\\)$', 1)
        when 'dash' then regexp_extract(s, '^(.*?[^\\s\\d]) *[-–] *(\\d+)$', 1) when 'cparen' then regexp_extract(s, '(?i)^(.*?)[ _-]*\\(\\s*copy\\s*(\\d+)?\\s*\\)$', 1)
        when 'ctail' then regexp_extract(s, '(?i)^(.*?)[ _-]+copy(?:[ _-]*(\\d+))?$', 1) else s end as b0,
      try_cast(case form when 'tag' then regexp_extract(s, '(\\d+)\\]$', 1) when 'paren' then regexp_extract(s, '\\((\\d+)\\)$', 1) when 'dash' then regexp_extract(s, '(\\d+)$', 1)
        when 'ctail' then regexp_extract(s, '(?i)copy(?:[ _-]*(\\d+))?$', 1) end as bigint) as number,
      case form when 'tag' then nullif(regexp_extract(s, '\\[(?:([^\\]\\s]+) +)?\\d+\\]$', 1), '') end as tagged from b),
    d as (select *, case when form <> 'opaque' and tagged is null then nullif(regexp_extract(b0, '(?i)(?:^|[-_.\\s])((?:[a-z0-9]+\\.)+(?:com|net|org|io))(?:$|[-_\\s])', 1), '') end as found from c)
    select p_partkey, stem, case when found is not null then replace(b0, found, '') else b0 end as base, number, pre or form in ('cparen', 'ctail') as is_dup, coalesce(tagged, found) as site, form = 'opaque' as opaque from d
    """
)
def name_parse(spark, t):
    """Stems in nine forms, taken apart."""
    return t("part").select("p_partkey", _forms().alias("stem")).transform(N.with_parsed).select("p_partkey", "stem", "base", "number", "is_dup", "site", "opaque")


@query(
    """
    with b as (select p_partkey, case p_partkey % 5 when 0 then replace(p_name, ' ', '_') when 1 then replace(p_name, ' ', '.') when 2 then replace(p_name, ' ', '-') || '-of_the-' || p_partkey when 3 then 'IMG_' || p_partkey else 'McDonald  ' || upper(p_name) || ' -' end as base from part),
    c as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(base, '[_.]+', ' ', 'g'), '([A-Za-z])[-–]', '\\1 ', 'g'), '[-–]([A-Za-z])', ' \\1', 'g'), '\\s+', ' ', 'g'), ' -–_.') as spaced from b)
    select p_partkey, base, case when base like 'IMG%' then base else array_to_string(list_transform(string_split(spaced, ' '), lambda x, i:
      case when x = lower(x) and x <> upper(x) and not (i > 1 and x in ('of', 'the', 'a', 'in', 'on')) then upper(x[1]) || x[2:] else x end), ' ') end as cleaned from c
    """
)
def name_clean(spark, t):
    """Titles from bases with separators, protected names and mixed case."""
    n, k = F.col("p_name"), _s("p_partkey")
    sep = lambda s: F.replace(n, F.lit(" "), F.lit(s))
    m = F.col("p_partkey") % 5
    base = F.when(m == 0, sep("_")).when(m == 1, sep(".")).when(m == 2, F.concat(sep("-"), F.lit("-of_the-"), k)).when(m == 3, F.concat(F.lit("IMG_"), k)).otherwise(F.concat(F.lit("McDonald  "), F.upper(n), F.lit(" -")))
    return N.with_cleaned(t("part").select("p_partkey", base.alias("base")), compose=True)


@query(
    """
    with h as (select p_partkey, case when p_partkey % 10 = 9 then md5(cast(p_partkey as varchar)) else substr(md5(cast(p_partkey as varchar)), 1, 6) end as token from part)
    select p_partkey, token, length(token) = 32 as guid,
      length(regexp_replace(token, '[^0-9]', '', 'g')) >= 2 and length(regexp_replace(token, '[0-9]', '', 'g')) >= 2
      and length(regexp_replace(regexp_replace(token, '[0-9]+', '0', 'g'), '[a-z]+', 'a', 'g')) - 1 >= 2 as random from h
    """
)
def random_token(spark, t):
    """Which tokens look generated."""
    h = F.md5(_s("p_partkey").cast("binary"))
    df = t("part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 9, h).otherwise(F.substring(h, 1, 6)).alias("token"))
    return df.select("p_partkey", "token", N.is_guid(F.col("token")).alias("guid"), N.looks_random(F.col("token")).alias("random"))


@query(
    """
    with m as (select p_partkey, p_brand, p_name, p_size % 7 = 0 as dup, case when p_size % 7 = 0 or p_size % 5 = 0 then null else p_partkey end as number from part),
    c as (select *, case when dup then 2 when number is not null then 1 else 0 end as cls from m),
    w as (select *, row_number() over (partition by p_brand, p_name order by cls, coalesce(number, 0), p_partkey) as pos,
      sum(case when cls = 0 then 1 else 0 end) over (partition by p_brand, p_name) as n0, sum(case when cls = 1 then 1 else 0 end) over (partition by p_brand, p_name) as n1, sum(case when cls = 2 then 1 else 0 end) over (partition by p_brand, p_name) as n2 from c)
    select p_partkey, cast(case when cls > 0 and not (n0 = 0 and n1 = 0 and n2 = 1) then pos - n0 end as bigint) as seq,
      cast(case when n1 + n2 >= 10 and not (n0 = 0 and n1 = 0 and n2 = 1) then 2 else 1 end as integer) as width from w
    """
)
def copy_series(spark, t):
    """Series with copies: copies count on after numbered members, a lone copy becomes plain."""
    dup = F.col("p_size") % 7 == 0
    df = t("part").select("p_partkey", "p_brand", "p_name", dup.alias("is_dup"), F.when(~dup & (F.col("p_size") % 5 != 0), F.col("p_partkey")).alias("number"), F.col("p_partkey").alias("name"))
    return N.numbered_series(df, ["p_brand", "p_name"]).select("p_partkey", "seq", "width")


@query(
    """
    with p as (select *, p_brand || '/' || replace(p_name, ' ', '_') || ' (' || p_partkey || ')' as b, row_number() over (partition by p_brand, p_name order by p_partkey) as n, count(*) over (partition by p_brand, p_name) as c from part),
    f as (select *, p_brand || '/' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || ' [' || case when c >= 10 and n < 10 then '0' else '' end || n || ']' as new from p)
    select b || '.JPG' as src, new || '.jpg' as dst from f
    union all select b || '.mov', new || '.mov' from f where p_partkey % 4 = 0
    union all select b || '.XMP', new || '.xmp' from f where p_partkey % 5 = 0
    """
)
def rename_plan(spark, t):
    """A whole plan: series per folder, .mov halves and sidecars that follow their stills."""
    b = F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" ("), _s("p_partkey"), F.lit(")"))
    k = F.col("p_partkey")
    names = F.array_compact(F.array(F.concat(b, F.lit(".JPG")), F.when(k % 4 == 0, F.concat(b, F.lit(".mov"))), F.when(k % 5 == 0, F.concat(b, F.lit(".XMP")))))
    return renames.plan_files(t("part").select(F.explode(names).alias("path")))


@query(
    """
    with d as (select distinct p_brand as path from part union select distinct p_brand || '/' || lower(p_type) || '_box' from part)
    select path as src, case when contains(path, '/') then split_part(path, '/', 1) || '/' else '' end || upper(n[1]) || replace(n[2:], '_', ' ')[1:-4] || 'Box' as dst, cast(2 as integer) as depth
    from (select *, split_part(path, '/', 2) as n from d where contains(path, '/'))
    """
)
def folder_plan(spark, t):
    """Folder names, deepest first."""
    p = t("part")
    f = p.select(F.col("p_brand").alias("path")).union(p.select(F.concat("p_brand", F.lit("/"), F.lower("p_type"), F.lit("_box")))).distinct()
    return renames.plan_folders(f)


@query(
    """
    with pending as (select distinct p_brand as src from part union select distinct p_brand || '/' || p_type from part where p_size % 2 = 0 union select distinct p_type from part)
    select a.src, exists (select 1 from pending b where b.src <> a.src and starts_with(b.src, a.src || '/')) as blocked from pending a
    """
)
def ancestor_pending(spark, t):
    """Folders that wait for a rename inside them."""
    p = t("part")
    inner = p.select(F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("/"), "p_type")).alias("src")).where("src is not null")
    pending = p.select(F.col("p_brand").alias("src")).union(inner).union(p.select(F.col("p_type").alias("src"))).distinct()
    return renames.blocked_by_descendants(pending).select("src", "blocked")



@query(
    """
    with recursive f as (select p_partkey as k from part where p_partkey % 10 <> 3),
    p as (select p_partkey as k from part where p_partkey % 10 not in (3, 7)),
    s as (
      select p.k, cast(0 as integer) as round from p left join f on f.k = p.k + 1 where f.k is null
      union all select p.k, s.round + 1 from s join p on p.k + 1 = s.k)
    select 'd/n' || k as src, 'd/n' || (k + 1) as dst, round from s
    """
)
def rename_fixpoint(spark, t):
    """Applying a plan with chains of targets, to its fixpoint: a chain goes from its free end, one that ends at a file that stays doesn't."""
    from .running import checkpoints

    checkpoints(spark)
    part = t("part").select("p_partkey")
    named = lambda k: F.concat(F.lit("d/n"), _s(k))
    plan = part.where("p_partkey % 10 not in (3, 7)").select(named(F.col("p_partkey")).alias("src"), named(F.col("p_partkey") + 1).alias("dst"))
    done, _, renamed, skipped = renames.applied(plan, part.where("p_partkey % 10 <> 3").select(named(F.col("p_partkey")).alias("path")))
    return done.select("src", "dst", "round")



@query(
    """
    with b as (select o_custkey % 50 as batch_id, o_orderkey as seq, 'a' || o_orderkey as src, 'b' || o_orderkey as dst from orders)
    select dst as "from", src as "to", seq, seq % 2 = 0 as done from b where batch_id = (select max(batch_id) from b)
    """
)
def undo_batch(spark, t):
    """The last batch taken back, newest step first."""
    b = t("orders").select((F.col("o_custkey") % 50).alias("batch_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("a"), _s("o_orderkey")).alias("src"), F.concat(F.lit("b"), _s("o_orderkey")).alias("dst"))
    steps, _ = renames.undo(b, b.where("seq % 2 = 0").select(F.col("dst").alias("path")))
    return steps



# ---------------------------------------------------------------- library

_EXTS = ".jpg .PNG .heic .gif .mkv .MOV .mp4 .txt .xmp .tiff".split()


@query(
    """
    with f as (select page_id, case when page_id % 17 = 0 then '.hidden/' when page_id % 19 = 0 then 'Lib.photoslibrary/' else 'lib/' end || 'p' || page_id || ['.jpg', '.PNG', '.heic', '.gif', '.mkv', '.MOV', '.mp4', '.txt', '.xmp', '.tiff'][page_id % 10 + 1] as path from pages),
    e as (select *, lower(regexp_extract(path, '(\\.[^.]+)$', 1)) as ext from f where page_id % 17 <> 0 and page_id % 19 <> 0),
    k as (select *, case ext when '.jpg' then 'photo' when '.png' then 'photo' when '.tiff' then 'photo' when '.heic' then 'heic' when '.gif' then 'gif' when '.mkv' then 'video' when '.mov' then 'video' when '.mp4' then 'mp4' end as kind from e)
    select path, kind, regexp_replace(path, '\\.[^.]+$', '') || case when kind in ('photo', 'heic') then '.webp' else '.mp4' end as output from k where kind is not null
    """
)
def classify_kind(spark, t):
    """Media files of a listing, their kinds and intended outputs; hidden and bundle folders pruned."""
    k = F.col("page_id")
    folder = F.when(k % 17 == 0, ".hidden/").when(k % 19 == 0, "Lib.photoslibrary/").otherwise("lib/")
    path = F.concat(folder, F.lit("p"), _s(k), F.element_at(F.array(*map(F.lit, _EXTS)), (k % 10 + 1).cast("int")))
    jobs = library.classify(t("pages").select(path.alias("path")))
    return jobs.select("path", "kind", P.intended_output(F.col("kind"), F.col("path"), F.lit(None).cast("string")).alias("output"))


def _shelf(t) -> DataFrame:
    video = F.col("p_size") % 3 == 0
    return library.classify(t("part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.when(video, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))), F.when(video, ".mov").otherwise(F.concat(F.lit(""), F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise(".png")))).alias("path"))).dropDuplicates(["path"])


_SHELF = """
    f as (select distinct p_brand as dir, p_size % 3 = 0 as video, case when p_size % 3 = 0 then upper(replace(p_name, ' ', '_')) else replace(p_name, ' ', '_') end as stem, case when p_size % 3 = 0 then '.mov' when p_partkey % 2 = 0 then '.jpg' else '.png' end as ext from part),
    s as (select dir, lower(stem) as l, min(stem || ext) as still from f where not video group by all),
    pairs as (select f.dir || '/' || stem || ext as video, f.dir || '/' || still as still, f.dir from f join s on f.dir = s.dir and lower(stem) = l where video)
"""


@query(f"with {_SHELF} select * from pairs")
def live_pairs(spark, t):
    """Each .mov with the first still of its folder and stem."""
    return library.live_pairs(_shelf(t))


@query(
    f"""
    with {_SHELF}, ids as (select dir || '/' || stem || ext as path, case when length(stem) % 3 = 0 then '' else lower(stem) end as id from f),
    good as (select p.* from pairs p join ids a on a.path = video join ids b on b.path = still where a.id <> '' and a.id = b.id),
    halves as (select video as path from good union select still from good)
    select dir || '/' || stem || ext as path from f where dir || '/' || stem || ext not in (select path from halves)
    """
)
def protected_anti(spark, t):
    """Files that belong to no verified pair."""
    files = _shelf(t)
    ids = files.select("path", F.when(F.length("stem") % 3 == 0, "").otherwise(F.lower("stem")).alias("content_id"))
    pairs = library.verified_pairs(library.live_pairs(files), ids, has_tool=True)
    return library.without(files, library.protected(pairs)).select("path")


@query(
    """
    with j as (select o_orderkey, 'd' || o_custkey % 300 || '/clip' || o_custkey % 7 || case when o_orderkey % 3 = 0 then '.mov' when o_orderkey % 3 = 1 then '.mkv' else '.avi' end as path from orders),
    u as (select path, min(o_orderkey) as k from j group by path),
    o as (select *, regexp_replace(path, '\\.[^./]+$', '') as base from u),
    r as (select *, row_number() over (partition by base order by k, path) as n from o)
    select path, base || case when n > 1 or (base like '%/clip0') then '.' || substr(sha256(path), 1, 8) else '' end || '.mp4' as output from r
    """
)
def collision_rank(spark, t):
    """Outputs that two jobs, or a job and a file, would share get distinct names."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ext = F.when(k % 3 == 0, ".mov").when(k % 3 == 1, ".mkv").otherwise(".avi")
    j = t("orders").select(k.alias("k"), F.concat(F.lit("d"), _s(c % 300), F.lit("/clip"), _s(c % 7), ext).alias("path"))
    jobs = j.groupBy("path").agg(F.min("k").alias("k")).withColumn("kind", F.lit("video"))
    taken = jobs.where(F.col("path").rlike(r"/clip0\.")).select(F.regexp_replace("path", r"\.[^./]+\z", ".mp4").alias("path"))
    return library.with_outputs(jobs, taken, "k").select("path", "output")


@query(
    """
    with j as (select p_partkey, 'm/' || p_partkey || '.jpg' as path from part),
    s as (select 'm/' || p_partkey || case p_partkey % 3 when 0 then '.xmp' when 1 then '.jpg.AAE' else '.doc' end as path from part)
    select j.path, s.path as sidecar from j join s on s.path in ('m/' || p_partkey || '.xmp', 'm/' || p_partkey || '.jpg.AAE')
    """
)
def sidecar_files(spark, t):
    """Sidecars that exist beside a job."""
    k = F.col("p_partkey")
    jobs = P.with_path_parts(t("part").select(F.concat(F.lit("m/"), _s(k), F.lit(".jpg")).alias("path")))
    files = t("part").select(F.concat(F.lit("m/"), _s(k), F.when(k % 3 == 0, ".xmp").when(k % 3 == 1, ".jpg.AAE").otherwise(".doc")).alias("path"))
    return library.sidecars(jobs, files)


@query(
    """
    select page_id, case when page_id % 7 = 0 then false when page_id % 2 = 0 then true when page_id % 3 <> 0 then true else page_id % 5 = 0 end as open from pages
    """
)
def open_mp4s(spark, t):
    """Which jobs still need work: not completed, and no MP4 that is standard and healthy."""
    k = F.col("page_id")
    jobs = t("pages").select(k, _s(k).alias("path"), F.when(k % 2 == 1, "mp4").otherwise("video").alias("kind"))
    status = jobs.select("path", F.when(k % 3 == 0, "standard").otherwise("convert").alias("status"), (k % 5 != 0).alias("healthy"))
    done = jobs.where("page_id % 7 = 0")
    left = library.open_jobs(jobs, status, done, ("standard", "hevc"), validate=True).select("path", F.lit(True).alias("open"))
    return jobs.join(left, "path", "left").select("page_id", F.coalesce("open", F.lit(False)).alias("open"))



_STATUS = "case o_orderkey % 7 when 0 then 'converted' when 1 then 'remuxed' when 2 then 'skipped' when 3 then 'failed' when 4 then 'converted' else 'skipped' end"


def _outcomes(t) -> DataFrame:
    k = F.col("o_orderkey") % 7
    st = F.when(k.isin(0, 4), "converted").when(k == 1, "remuxed").when(k == 3, "failed").otherwise("skipped")
    return t("orders").select(st.alias("status"), _s("o_orderkey").alias("path"), F.lit("").alias("detail"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes_saved"))


@query(
    f"""
    with o as (select {_STATUS} as status, cast(round(o_totalprice * 100) as bigint) as b from orders),
    d as (select unnest(['converted', 'remuxed', 'repaired', 'skipped', 'failed', 'planned']) as status)
    select d.status, cast(count(o.status) as bigint) as n, cast(coalesce(sum(b), 0) as bigint) as bytes_saved from d left join o on d.status = o.status group by d.status
    """
)
def outcome_tally(spark, t):
    """Outcomes by status, zeros included."""
    return library.tally(_outcomes(t))


@query(
    f"""
    with o as (select {_STATUS} as status, cast(round(o_totalprice * 100) as bigint) as b from orders),
    c as (select count(*) filter (status = 'converted') as c, count(*) filter (status = 'remuxed') as m, count(*) filter (status = 'skipped') as s, count(*) filter (status = 'failed') as f, cast(round(sum(b) * 10 / 1048576.0) as bigint) as tenths from o)
    select 'done: ' || c || ' converted, ' || m || ' remuxed, ' || s || ' skipped, ' || f || ' failed, ' || tenths // 10 || '.' || tenths % 10 || ' MB saved' as line from c
    """
)
def summary_line(spark, t):
    """The closing line of a run."""
    return library.summary_line(library.tally(_outcomes(t)))


@query(
    """
    with recursive r as (select event_id, user_id, greatest(67108864, cast(floor(cast(round(value * 1000000) as bigint) * (1 + event_id % 7) * 1.25) as bigint)) as required, row_number() over (partition by user_id order by event_id) as n from events),
    s as (
      select n, user_id, event_id, required, cast(0 as bigint) as reserved, case when required <= 1000000000 then 'admit' else 'fail' end as decision, case when required <= 1000000000 then required else 0 end as held from r where n = 1
      union all select r.n, r.user_id, r.event_id, r.required, s.held, case when s.held + r.required <= 1000000000 then 'admit' when s.held > 0 then 'wait' else 'fail' end, s.held + case when s.held + r.required <= 1000000000 then r.required else 0 end
        from s join r on r.user_id = s.user_id and r.n = s.n + 1)
    select event_id, user_id, required, reserved, decision from s
    """
)
def space_admission(spark, t):
    """Which conversions a device has room for, in order; only admitted ones hold space."""
    size = F.round(F.col("value") * 1_000_000).cast("long") * (1 + F.col("event_id") % 7)
    e = t("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("device"), F.lit(1_000_000_000).cast("long").alias("free"), size.alias("source_size"))
    return library.admitted(e).select(F.col("seq").alias("event_id"), F.col("device").alias("user_id"), "required", "reserved", "decision")



@query(
    """
    select p_partkey, case when p_size % 5 = 0 then 'source is a symbolic link' when p_size % 7 = 0 then 'source is not a regular file' when p_size % 3 = 0 then 'source has multiple hard links' end as fault,
      starts_with('/lib/' || p_brand, '/lib/Brand#1') and ('/lib/' || p_brand = '/lib/Brand#1' or starts_with('/lib/' || p_brand, '/lib/Brand#1/')) as inside from part
    """
)
def snapshot_safety(spark, t):
    """Why files can't be sources, and containment in a root."""
    s = F.col("p_size")
    df = library.snapshot_faults(t("part").withColumns({"is_symlink": s % 5 == 0, "is_file": s % 7 != 0, "nlink": F.when(s % 3 == 0, 2).otherwise(1), "readable": F.lit(True)}))
    return df.select("p_partkey", "fault", P.inside(F.concat(F.lit("/lib/"), "p_brand"), F.lit("/lib/Brand#1")).alias("inside"))


@query("select event_type, 'x' || substr(sha256(event_type), 1, 8) as token, cast(count(*) as bigint) as n from events group by 1")
def event_kinds(spark, t):
    """Unique-name tokens of keys, with counts."""
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.replace(N.unique_name(F.lit("x"), F.lit(""), F.col("event_type")), F.lit("."), F.lit("")).alias("token"), "n")


# ---------------------------------------------------------------- timelines


def _packets(t) -> DataFrame:
    ts = F.expr("unix_micros(cast(ts as timestamp))") / 1_000_000
    e = F.col("event_id")
    return t("events").select(_s(F.col("user_id") % 50).alias("path"), e.alias("pos"), _s(F.col("user_id") % 3).alias("stream_index"), F.when(e % 11 == 0, "N/A").when(e % 13 == 0, "").otherwise(ts.cast("decimal(20,6)").cast("string")).alias("pts_time"), ts.cast("decimal(20,6)").cast("string").alias("dts_time"), F.when(e % 17 == 0, "-5").otherwise(_s("value")).alias("duration_time"))


_PACKETS = """
    p as (select cast(user_id % 50 as varchar) as path, cast(user_id % 3 as varchar) as stream_index, event_id, epoch_us(ts) / 1000000.0 as start, case when event_id % 17 = 0 then 0 else value end as dur from events where event_id % 11 <> 0)
"""


@query(f"with {_PACKETS} select path, stream_index, greatest(0, round(max(start + greatest(0, dur)) - min(start), 3)) as span from p group by all")
def packet_spans(spark, t):
    """Seconds from the first start to the last end, per stream."""
    return timeline.packet_spans(_packets(t)).withColumn("span", F.round("span", 3))


@query(f"with {_PACKETS} select path, stream_index, round(arg_min(start, event_id), 3) as start from p where event_id % 13 <> 0 group by all")
def first_starts(spark, t):
    """The first readable timestamp of each stream."""
    f = _packets(t).select("path", "pos", "stream_index", F.lit("").alias("best_effort_timestamp_time"), "pts_time")
    return timeline.first_starts(f).withColumn("start", F.round("start", 3))


@query(
    """
    with e as (select user_id, event_id, cast(round(value * 1000) as bigint) as us from events)
    select cast(user_id as varchar) as key, event_id * 4 + 3 as pos, us / 1000000.0 as current, case when event_id % 5 = 0 then null else cast(event_id % 7 as double) end as speed from e
    """
)
def progress_fold(spark, t):
    """The state of each converter at each progress line."""
    e = t("events").select(_s("user_id").alias("key"), "event_id", F.round(F.col("value") * 1000).cast("long").alias("us"))
    parts = F.array(F.concat(F.lit("out_time_us="), _s("us")), F.concat(F.lit("speed="), F.when(F.col("event_id") % 5 == 0, "N/A").otherwise(F.concat(_s(F.col("event_id") % 7), F.lit("x")))), F.lit("noise"), F.lit("progress=continue"))
    lines = e.select("key", "event_id", F.posexplode(parts).alias("i", "value")).select("key", (F.col("event_id") * 4 + F.col("i")).alias("pos"), "value")
    from .streaming.progress import progress_events

    return progress_events(lines)


@query(f"with {_PACKETS} select path, stream_index, greatest(0, round(max(start + greatest(0, dur)) - min(start), 3)) as span from p group by all")
def packet_stream(spark, t):
    """The same spans from a stream of packet files, run until nothing is left."""
    from .running import streamed
    from .streaming.progress import packet_spans as spans

    return streamed(spark, _packets(t), spans, "complete").withColumn("span", F.round("span", 3))


@query(
    """
    with recursive u as (select cast(user_id as varchar) as key, epoch_us(ts) / 1000000.0 as moment, greatest(0, value) as current, cast(greatest(0, least(100, trunc(value / 100.0 * 100))) as integer) as percent, row_number() over (partition by user_id order by ts, greatest(0, value), event_id) as n from events),
    s as (
      select key, n, moment, current, percent, true as told, moment as since, percent - percent % 10 as step from u where n = 1
      union all select key, n, moment, current, percent, told, case when told then moment else since end, case when told then percent - percent % 10 else step end
        from (select u.key, u.n, u.moment, u.current, u.percent, u.percent >= s.step + 10 or u.moment - s.since >= 60 as told, s.since, s.step from s join u on u.key = s.key and u.n = s.n + 1))
    select key, moment as "at", percent, current from s where told
    """
)
def progress_heartbeat(spark, t):
    """Lines worth printing: ten percent further or a minute later, from a stream of updates."""
    from .running import streamed
    from .streaming.progress import heartbeats

    u = t("events").select(_s("user_id").alias("key"), (F.expr("unix_micros(cast(ts as timestamp))") / 1_000_000).alias("at"), F.col("value").alias("current"), F.lit(100.0).alias("total"))
    return streamed(spark, u, heartbeats, "append")


# ---------------------------------------------------------------- inventories


def _stream(**given) -> Column:
    """A stream struct with the given fields; others null."""
    kinds = dict(x.split(":", 1) for x in S.STREAM[7:-1].replace("map<string,string>", "map<string;string>").replace("map<string,int>", "map<string;int>").split(","))
    return F.struct(*((given.get(k, F.lit(None)) if isinstance(given.get(k), Column) else F.lit(given.get(k))).cast(v.replace(";", ",")).alias(k) for k, v in kinds.items()))


def _tags(**given) -> Column:
    keys = [x for k, v in given.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*keys), lambda k, v: v.isNotNull()) if keys else F.create_map().cast("map<string,string>")


def _inventory(streams: Column, chapters: Column | None = None) -> Column:
    return F.struct(streams.alias("streams"), (chapters if chapters is not None else F.array().cast(f"array<{S.CHAPTER}>")).alias("chapters"), F.array().cast(f"array<{S.GROUP}>").alias("stream_groups"))


def _talks(t) -> DataFrame:
    """An inventory per conversation: turns as streams, by turn."""
    turn, role = F.col("turn"), F.col("role")
    kind = F.when(turn == 0, "video").when(role == "assistant", "audio").when(turn % 4 == 2, "subtitle").otherwise("audio")
    codec = F.when(kind == "video", F.when(F.col("conv_id") % 5 == 0, "vp9").when(F.col("conv_id") % 3 == 0, "hevc").otherwise("h264")).when(kind == "audio", F.when((F.col("conv_id") % 7 == 0) & (turn == 1), "ac3").otherwise("aac")).otherwise(F.when(F.length("text") % 2 == 0, "subrip").otherwise("ass"))
    s = _stream(index=turn.cast("int"), codec_type=kind, codec_name=codec, pix_fmt=F.when(kind == "video", "yuv420p"), tags=_tags(), disposition=F.create_map(F.lit("default"), (turn % 3 == 1).cast("int")), color=_tags(), attached_pic=F.lit(False))
    rows = t("conversations").where("turn is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), "role")
    return rows.select("conv_id", "turn", s.alias("s")).groupBy("conv_id").agg(F.array_sort(F.collect_list("s"), lambda a, b: a["index"] - b["index"]).alias("streams")).select("conv_id", _inventory(F.col("streams")).alias("inv"))


_TALKS = """
    s as (select conv_id, turn, case when turn = 0 then 'video' when role = 'assistant' then 'audio' when turn % 4 = 2 then 'subtitle' else 'audio' end as kind, length(coalesce(text, '')) as n from conversations where turn is not null),
    c as (select *, case kind when 'video' then case when conv_id % 5 = 0 then 'vp9' when conv_id % 3 = 0 then 'hevc' else 'h264' end when 'audio' then case when conv_id % 7 = 0 and turn = 1 then 'ac3' else 'aac' end else case when n % 2 = 0 then 'subrip' else 'ass' end end as codec from s)
"""


@query(
    f"""
    with {_TALKS}, a as (select conv_id, count(*) filter (kind = 'video') as v, bool_and(codec = 'h264') filter (kind = 'video') as h264, bool_and(codec = 'hevc') filter (kind = 'video') as hevc, coalesce(bool_and(codec = 'aac') filter (kind = 'audio'), true) as aac from c group by conv_id)
    select conv_id, case when v = 0 then 'convert' when not aac and (h264 or hevc) then 'copy-video' when not aac then 'convert' when h264 then 'standard' when hevc then 'hevc' else 'convert' end as status from a
    """
)
def stream_status(spark, t):
    """Whether streams are standard, whatever their container."""
    return _talks(t).select("conv_id", I.stream_status(F.col("inv")).alias("status"))


@query(
    f"""
    with {_TALKS}, a as (select conv_id, count(*) filter (kind = 'video') as v, bool_and(codec = 'h264') filter (kind = 'video') as h264, bool_and(codec = 'hevc') filter (kind = 'video') as hevc, coalesce(bool_and(codec = 'aac') filter (kind = 'audio'), true) as aac, string_agg(distinct codec, ', ' order by codec) filter (kind = 'audio') as codecs from c group by conv_id)
    select conv_id, case when v = 0 then 'convert' when not aac then 'convert' when h264 then 'standard' when hevc then 'hevc' else 'convert' end as status,
      case when v = 0 then 'it has no playable video track' when not aac then 'audio is ' || codecs || ', not AAC' when h264 then 'already Apple-compatible' when hevc then 'HEVC is already Apple-native' else 'video is vp9/yuv420p/unknown, not H.264 8-bit 4:2:0' end as reason from a
    """
)
def mp4_status(spark, t):
    """Whether MP4s are standard, and why not."""
    return _talks(t).select("conv_id", I.mp4_status(F.col("inv")).alias("m")).select("conv_id", "m.*")


@query(
    f"""
    with {_TALKS}, a as (select conv_id, count(*) filter (kind = 'video') as v, count(*) filter (kind = 'subtitle' and codec = 'ass') as s from c group by conv_id)
    select conv_id, case when v > 1 then (v - 1) || ' additional video track(s)' else '' end || case when v > 1 and s > 0 then '; ' else '' end || case when s > 0 then s || ' subtitle track(s) (ass)' else '' end as risks from a
    """
)
def removal_risks(spark, t):
    """What a conversion would drop."""
    return _talks(t).select("conv_id", F.array_join(I.removal_risks(F.col("inv")), "; ").alias("risks"))


@query(
    f"""
    with {_TALKS}, a as (select conv_id, count(*) filter (kind = 'audio') as n, count(*) filter (kind = 'subtitle' and codec = 'subrip') as s from c group by conv_id)
    select conv_id, case when n > 1 then n || ' audio tracks' else '' end || case when n > 1 and s > 0 then ', ' else '' end || case when s > 0 then s || ' compatible subtitle track(s)' else '' end as summary from a
    """
)
def preservation_summary(spark, t):
    """What a conversion keeps."""
    return _talks(t).select("conv_id", I.preservation_summary(F.col("inv")).alias("summary"))


@query(
    f"""
    with {_TALKS}, o as (select *, row_number() over (partition by conv_id, kind order by turn) - 1 as pos from c where kind = 'audio')
    select conv_id, coalesce(string_agg(cast(pos as varchar), ',' order by pos) filter (turn % 3 = 1), '') as defaults from o group by conv_id
    """
)
def default_tracks(spark, t):
    """Ordinals of the audio tracks that play by default."""
    df = _talks(t).where(F.size(I.of_type(F.col("inv"), "audio")) > 0)
    return df.select("conv_id", F.array_join(F.transform(I.defaults(I.of_type(F.col("inv"), "audio")), lambda i: i.cast("string")), ",").alias("defaults"))


def _films(t) -> DataFrame:
    """Source and output inventories of a picture and an audio track per order."""
    k = F.col("o_orderkey")
    video = lambda **x: _stream(index=0, codec_type="video", codec_name="h264", pix_fmt="yuv420p", tags=_tags(), disposition=F.create_map().cast("map<string,int>"), attached_pic=F.lit(False), avg_frame_rate="30/1", start_time="0", **x)
    audio = lambda **x: _stream(index=1, codec_type="audio", disposition=F.create_map().cast("map<string,int>"), color=_tags(), attached_pic=F.lit(False), sample_rate="48000", **x)
    src = F.array(video(rotation=F.when(k % 13 == 0, 90.0), color=_tags(color_range=F.lit("tv"))), audio(codec_name="pcm", tags=_tags(title=F.lit("Main")), duration="100.0", channels=2, start_time="0"))
    after = audio(codec_name=F.when(k % 11 == 0, "mp3").otherwise("aac"), tags=_tags(handler_name=F.when(k % 17 == 0, "Other").otherwise("Main")), duration=F.when(k % 7 == 0, "97.5").when(k % 19 == 0, "N/A").otherwise("99.0"), channels=F.when(k % 5 == 0, 6).otherwise(2), start_time=F.when(k % 3 == 0, "0.06").otherwise("0.01"))
    out = F.array(video(rotation=F.when(k % 26 == 0, 450.0), color=_tags(color_range=F.when(k % 23 == 0, "pc"))), after)
    empty = F.create_map().cast("map<string,double>")
    return t("orders").select("o_orderkey", _inventory(src).alias("source"), F.when(k % 29 != 0, _inventory(F.when(k % 31 == 0, F.slice(out, 1, 1)).otherwise(out))).alias("output"), F.lit(100.0).alias("source_duration"), F.when(k % 37 == 0, 90.0).otherwise(100.5).alias("output_duration"), empty.alias("source_spans"), empty.alias("output_spans"), empty.alias("source_starts"), empty.alias("output_starts"))


@query(
    """
    select o_orderkey, coalesce(r, 'ok') as reason, r is null as ok from (select o_orderkey, case
      when o_orderkey % 29 = 0 then 'could not inventory source and output streams'
      when o_orderkey % 37 = 0 then 'duration mismatch: source 100.0s vs output 90.0s'
      when o_orderkey % 31 = 0 then 'audio track count changed: source 1, output 0'
      when o_orderkey % 11 = 0 then 'audio track 1 output codec is not AAC'
      when o_orderkey % 17 = 0 then 'audio track 1 language/title/disposition metadata changed'
      when o_orderkey % 7 <> 0 and o_orderkey % 19 = 0 then 'audio track 1 duration could not be verified'
      when o_orderkey % 7 = 0 then 'audio track 1 duration changed: source 100.00s, output 97.50s'
      when o_orderkey % 5 = 0 then 'audio track 1 channel count changed: source 2 vs output 6'
      when o_orderkey % 3 = 0 then 'audio track 1 A/V start offset changed: source +0.000s vs output +0.060s (tolerance 0.050s)'
      when o_orderkey % 13 = 0 and o_orderkey % 26 <> 0 then 'video rotation metadata changed'
      when o_orderkey % 23 = 0 then 'video color_range metadata changed: source tv, output pc' end as r from orders)
    """
)
def ordinal_verify(spark, t):
    """Outputs against their sources, the first broken promise named."""
    return validation.verify_streams(_films(t)).select("o_orderkey", "reason", "ok")


@query(
    """
    with f as (select o_orderkey, case when o_orderkey % 5 = 0 then 'yuv422p10le' when o_orderkey % 5 = 1 then 'yuva420p' else 'yuv420p' end as fmt, case when o_orderkey % 3 = 0 then 'tt' else 'progressive' end as field,
      case o_orderkey % 4 when 0 then '25/1' when 1 then '5/1' else '30/1' end as mean, case when o_orderkey % 7 = 0 then '60/1' when o_orderkey % 4 = 0 then '25/1' when o_orderkey % 4 = 1 then '5/1' else '30/1' end as nominal, o_orderkey % 11 = 0 as hdr from orders)
    select o_orderkey, array_to_string(list_filter([case when fmt = 'yuv422p10le' then '10-bit video' end, case when hdr then 'HDR/dynamic-range metadata' end, case when fmt = 'yuva420p' then 'alpha channel' end,
      case when field = 'tt' then 'interlaced video (tt)' end, case when o_orderkey % 7 = 0 then 'variable frame rate' when mean = '5/1' then 'unusual frame rate (5.000 fps)' end], lambda x: x is not null), ', ') as features from f
    """
)
def advanced_features(spark, t):
    """Pictures that an ordinary encode may damage."""
    k = F.col("o_orderkey")
    mean = F.when(k % 4 == 0, "25/1").when(k % 4 == 1, "5/1").otherwise("30/1")
    v = _stream(index=0, codec_type="video", codec_name="h264", pix_fmt=F.when(k % 5 == 0, "yuv422p10le").when(k % 5 == 1, "yuva420p").otherwise("yuv420p"), field_order=F.when(k % 3 == 0, "tt").otherwise("progressive"), avg_frame_rate=mean, r_frame_rate=F.when(k % 7 == 0, "60/1").otherwise(mean), color=_tags(color_transfer=F.when(k % 11 == 0, "smpte2084")), tags=_tags(), attached_pic=F.lit(False))
    return t("orders").select("o_orderkey", F.array_join(I.advanced_features(_inventory(F.array(v))), ", ").alias("features"))


@query(
    """
    select o_orderkey, 'ffmpeg -nostdin -y -noautorotate -i in.mkv -map 0:0 -map 0:1 -map_metadata:s:a:0 0:s:a:0 -metadata:s:a:0 title=Main -metadata:s:a:0 handler_name=Main -disposition:a:0 0 -map_metadata 0 -map_metadata:s:v:0 0:s:v:0 -map_chapters 0 -c copy -color_range:v:0 tv -tag:v:0 avc1 -tag:a mp4a -brand mp42 -movflags +faststart out.mp4' as remux,
      cast(case when o_orderkey % 2 = 0 then 55 else 41 end as integer) as words from orders
    """
)
def command_vectors(spark, t):
    """Argument vectors of a remux, and their length for a tolerant encode."""
    f = _films(t)
    k = F.col("o_orderkey")
    remux = F.array_join(commands.remux(F.lit("in.mkv"), F.lit("out.mp4"), F.col("source")), " ")
    n = F.when(k % 2 == 0, F.size(commands.encode(F.lit("a"), F.lit("b"), F.col("source"), repair=True))).otherwise(F.size(commands.encode(F.lit("a"), F.lit("b"), F.col("source"), copy_video=True)))
    return f.select("o_orderkey", remux.alias("remux"), n.alias("words"))


@query(
    """
    select o_orderkey, case when k = 4 then 'skipped' when k = 0 then 'skipped' when k = 1 then 'skipped' else 'planned' end as status, case k
      when 0 then 'HEIC (already space-efficient; --convert-heic to convert)' when 1 then 'static WebP (already standardized)' when 2 then 'would convert and trash original -> clip.webp'
      when 3 then 'would convert audio and copy video and trash original -> clip.mp4; preserve ' || case when o_orderkey % 13 = 0 then 'rotation 90 degrees, ' else '' end || 'colour metadata' else 'stream preflight failed; original kept' end as detail,
      case k when 3 then 'convert,repair-encode' when 4 then 'convert,repair-encode' else 'convert' end as stages
    from (select o_orderkey, o_orderkey % 5 as k from orders)
    """
)
def job_decisions(spark, t):
    """What would be done with each job, and in which stages."""
    k = F.col("o_orderkey") % 5
    kind = F.when(k == 0, "heic").when(k == 1, "webp").when(k == 2, "photo").otherwise("video")
    flags = F.struct(*(F.lit(False).alias(x) for x in ("animated", "alpha", "icc", "exif", "xmp")))
    film = _films(t).select("o_orderkey", F.when((k == 3), F.col("source")).alias("inventory"))
    none = F.lit(None)
    jobs = film.withColumns({"path": F.concat(F.lit("lib/clip"), F.when(k == 2, ".jpg").otherwise(".mkv")), "kind": kind, "healthy": F.lit(True), "playback_ok": F.lit(True), "gif_packets": none.cast("string"), "webp": flags, "output": none.cast("string"), "taken": F.lit(False), "fault": none.cast("string"), "size": F.lit(1000), "free": F.lit(10**9)})
    return decision.decide(jobs).select("o_orderkey", "status", "detail", F.array_join("stages", ",").alias("stages"))


@query(
    """
    select o_orderkey, case when k = 0 then 'failed' when k = 1 then 'failed' when k = 2 then 'skipped' when k = 3 then 'repaired' when k = 4 then 'remuxed' when k = 5 then 'repaired' else 'converted' end as status,
      cast(case when k in (3, 4, 5, 6) then 1024 * 100 - n else 0 end as bigint) as bytes_saved, k = 5 as source_kept
    from (select o_orderkey, o_orderkey % 7 as k, case when o_orderkey % 7 = 2 then 204800 else o_orderkey % 1000 end as n from orders)
    """
)
def job_outcomes(spark, t):
    """What became of jobs that ran."""
    k = F.col("o_orderkey") % 7
    a = t("orders").select("o_orderkey", _s("o_orderkey").alias("path"), F.lit("lib/x.mp4").alias("final"), F.when(k == 3, "repair-remux").when(k == 4, "remux").otherwise("convert").alias("stage"), (k != 0).alias("ok"), F.lit("bad").alias("reason"), F.when(k == 5, "recovered").otherwise("ok").alias("note"), (k != 1).alias("unchanged"), F.lit(102400).alias("size"), F.when(k == 2, 204800).otherwise(F.col("o_orderkey") % 1000).alias("new_size"))
    out = decision.concluded(a, decision.Options(dry_run=False, only_if_smaller=True))
    return out.select(F.col("path").cast("long").alias("o_orderkey"), "status", "bytes_saved", "source_kept")


@query(
    """
    select o_orderkey, b & 2 <> 0 and o_orderkey % 9 <> 0 as animated, b & 16 <> 0 and o_orderkey % 9 <> 0 as alpha, b & 32 <> 0 and o_orderkey % 9 <> 0 as icc, b & 8 <> 0 and o_orderkey % 9 <> 0 as exif, b & 4 <> 0 and o_orderkey % 9 <> 0 as xmp
    from (select o_orderkey, o_orderkey % 64 as b from orders)
    """
)
def webp_headers(spark, t):
    """Flags of WebP headers."""
    k = F.col("o_orderkey")
    head = F.concat(F.when(k % 9 == 0, F.lit("RIFX")).otherwise(F.lit("RIFF")).cast("binary"), F.lit("1234WEBPVP8X0000").cast("binary"), F.unhex(F.lpad(F.hex(k % 64), 2, "0")))
    return t("orders").select("o_orderkey", M.webp_flags(head).alias("w")).select("o_orderkey", "w.*")


# ---------------------------------------------------------------- measures


@query(
    """
    select l_orderkey, l_linenumber, l_extendedprice as src, l_extendedprice * (1 - l_discount / 2) as out, abs(l_extendedprice - l_extendedprice * (1 - l_discount / 2)) <= greatest(1.0, l_extendedprice * 0.02) as agrees from lineitem
    """
)
def duration_check(spark, t):
    """Durations within a second or two percent."""
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("src"), (F.col("l_extendedprice") * (1 - F.col("l_discount") / 2)).alias("out"))
    return df.withColumn("agrees", M.duration_agrees(F.col("src"), F.col("out")))


@query(
    """
    select l_orderkey, l_linenumber, l_quantity, round(case when l_linenumber = 1 then 0.05 else greatest(0.05, least(0.15, 1.5 / (cast(l_quantity as integer) / 2.0))) end, 9) as tolerance,
      (cast(l_quantity as double) * -90) - 360 * floor((cast(l_quantity as double) * -90) / 360) as turned from lineitem
    """
)
def av_tolerance(spark, t):
    """A frame's worth of drift, and rotations within a turn."""
    rate = F.when(F.col("l_linenumber") == 1, "0/0").otherwise(F.concat(_s(F.col("l_quantity").cast("int")), F.lit("/2")))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(M.av_tolerance(rate), 9).alias("tolerance"), M.turned(F.col("l_quantity") * -90).alias("turned"))


@query(
    """
    select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30' when 1 then strftime(o_orderdate, '%Y-%m-%d') when 2 then strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30' else 'undated ' || o_orderkey end as date,
      case when o_orderkey % 4 = 3 then [] when o_orderkey % 5 = 0 then [strftime(o_orderdate, '%Y-%m-%d')] else ['2001-01-01'] end as dates from orders
    """
)
def capture_dates(spark, t):
    """Capture dates in one form, and the strongest tier of a photo's tags."""
    k, d = F.col("o_orderkey"), lambda f: F.date_format("o_orderdate", f)
    text = F.when(k % 4 == 0, F.concat(d("yyyy:MM:dd"), F.lit(" 10:20:30.5+02:00"))).when(k % 4 == 1, d("yyyy-MM-dd")).when(k % 4 == 2, F.concat(F.lit("  "), d("yyyy-MM-dd"), F.lit("T10:20:30Z"))).otherwise(F.concat(F.lit("undated "), _s(k)))
    tags = F.map_filter(F.create_map(F.lit("ExifIFD:DateTimeOriginal"), F.when(k % 5 == 0, d("yyyy:MM:dd")), F.lit("XMP-photoshop:DateCreated"), F.lit("2001:01:01"), F.lit("Composite:DateTimeOriginal"), F.lit("1999:01:01")), lambda n, v: v.isNotNull() & (k % 4 != 3))
    return t("orders").select("o_orderkey", M.capture_date(text).alias("date"), M.capture_dates(tags).alias("dates"))


@query(
    """
    with l as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as lines from documents)
    select doc_id, case when len(lines) = 0 then '(no stderr)' else array_to_string(lines[greatest(1, len(lines) - 2):], ' | ') end as tail from l
    """
)
def tail_lines(spark, t):
    """The last three lines of a text that aren't blank."""
    return t("documents").select("doc_id", M.last_lines(F.col("text"), 3).alias("tail"))


@query(
    """
    select o_orderkey, case when s >= 3600 then s // 3600 || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') else lpad(cast(s // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') end as clock,
      cast(least(100, floor(s / cast(10000 as double) * 100)) as integer) as percent from (select o_orderkey, o_orderkey * 7 % 12000 as s from orders)
    """
)
def progress_clock(spark, t):
    """Clocks and percentages of progress."""
    s = F.col("o_orderkey") * 7 % 12000
    return t("orders").select("o_orderkey", M.clock(s.cast("double")).alias("clock"), M.percent(s, F.lit(10000)).alias("percent"))


@query(
    """
    select o_orderkey, case when p is null then null else cast(p as integer) end as percent, 'encoding   x [' || case when p = 100 then repeat('=', 22) else rpad(repeat('=', cast(22 * p // 100 as integer)) || '>', 22, '-') end || '] ' || lpad(cast(p as varchar), 4, ' ') || '% ' || lpad(cast(s // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') || '/16:40 2.00x ETA '
      || lpad(cast((1000 - s) // 2 // 60 as varchar), 2, '0') || ':' || lpad(cast((1000 - s) // 2 % 60 as varchar), 2, '0') as line from (select o_orderkey, o_orderkey % 1001 as s, cast(floor((o_orderkey % 1001) / cast(1000 as double) * 100) as bigint) as p from orders)
    """
)
def progress_lines(spark, t):
    """Progress lines as a terminal shows them."""
    s = (F.col("o_orderkey") % 1001).cast("double")
    return t("orders").select("o_orderkey", M.percent(s, F.lit(1000.0)).alias("percent"), M.progress_text(F.lit("encoding"), F.lit("x"), s, F.lit(1000.0), F.lit(2.0)).alias("line"))


@query("select o_orderkey, case when n < 1024 then n || ' B' when n < 1048576 then n // 1024 || '.' || n % 1024 * 10 // 1024 || ' KB' else n // 1048576 || '.0 MB' end as size from (select o_orderkey, case o_orderkey % 3 when 0 then o_orderkey % 1024 when 1 then (o_orderkey % 1000 + 1) * 1024 + 512 else (o_orderkey % 900 + 1) * 1048576 end as n from orders)")
def size_labels(spark, t):
    """Sizes for people."""
    k = F.col("o_orderkey")
    n = F.when(k % 3 == 0, k % 1024).when(k % 3 == 1, (k % 1000 + 1) * 1024 + 512).otherwise((k % 900 + 1) * 1048576)
    return t("orders").select("o_orderkey", M.size_text(n).alias("size"))


@query(
    """
    select s_suppkey, case when k = 0 then 'could not parse FFmpeg version; capability smoke test will decide' when k = 1 then 'FFmpeg 5.1 is older than the tested minimum 6.0; install/upgrade with `brew install ffmpeg webp` (or your system package manager)' else '' end as warnings,
      case when k = 2 then 'FFmpeg is missing the libx264 encoder; install a full FFmpeg build with GPL/libx264 support' when k = 3 then 'cwebp is not on PATH; install/upgrade with `brew install ffmpeg webp` (or your system package manager)' else '' end as errors, k not in (2, 3) as ok from (select s_suppkey, s_suppkey % 5 as k from supplier)
    """
)
def tool_report(spark, t):
    """Tools of many hosts, judged at once."""
    k = F.col("s_suppkey") % 5
    hosts = t("supplier").select("s_suppkey", F.lit(True).alias("has_ffmpeg"), F.lit(True).alias("has_ffprobe"), (k != 3).alias("has_cwebp"), F.when(k == 0, "ffmpeg N-1").when(k == 1, "ffmpeg version 5.1.2").otherwise("ffmpeg version 7.0").alias("ffmpeg_version"), F.when(k == 2, " V aac ").otherwise(" V libx264 \n A aac ").alias("encoders"), F.lit("-progress -display_rotation").alias("help"), F.lit("").alias("demuxers"), F.lit("").alias("decoders"), F.array(F.lit("aac"), F.lit("h264")).alias("probed_codecs"))
    out = capabilities.report(hosts)
    return out.select("s_suppkey", F.array_join("warnings", ";").alias("warnings"), F.array_join("errors", ";").alias("errors"), "ok")


@query()
def sample_digest(spark, t):
    """Sampled BLAKE2b digests of texts; no SQL engine here has this hash."""
    return t("documents").select("doc_id", M.sampled_digest(F.col("text").cast("binary")).alias("digest"))


@query(
    """
    select c_custkey, '--' || lower(c_mktsegment) as flag, cast(c_nationkey as varchar) as value from customer where c_custkey % 3 <> 0 and c_custkey % 5 <> 0
    """
)
def settings_rows(spark, t):
    """Settings lines: comments and blanks dropped, values split once."""
    from .sources.state import settings_rows as rows

    k = F.col("c_custkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("# "), "c_mktsegment")).when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" --"), F.lower("c_mktsegment"), F.lit("  "), _s("c_nationkey")))
    df = t("customer").select("c_custkey", line.alias("value"))
    out = rows(df.select(F.concat(F.col("value"), F.lit(" @"), _s(k)).alias("value")).where(F.trim(F.regexp_replace("value", r"@\d+", "")) != ""))
    return out.select(F.regexp_extract("value", r"@(\d+)", 1).cast("long").alias("c_custkey"), "flag", F.trim(F.regexp_replace("value", r"@\d+", "")).alias("value"))


@query(
    """
    with recursive m as (select p_partkey, p_name as base, row_number() over (partition by p_name order by lpad(cast(p_partkey as varchar), 8, '0')) as k from part),
    gone as (select distinct p_name as base, unnest(case when p_name like 'red%' then [1, 3, 4, 9] when p_name like 'blue%' then [2, 5] else [6] end) as n from part),
    free as (
      select base, cast(0 as bigint) as k, cast(0 as bigint) as n from (select distinct base from m)
      union all select f.base, case when g.n is null then f.k + 1 else f.k end, f.n + 1 from (select base, k, n from free) f left join gone g on g.base = f.base and g.n = f.n + 1
        where f.k < (select max(k) from m x where x.base = f.base)),
    place as (select base, k, min(n) as n from free where k > 0 group by base, k)
    select p_partkey, m.base || case when n = 1 then '' else ' ' || n end || '.jpg' as target from m join place on place.base = m.base and place.k = m.k
    """
)
def disposal_names(spark, t):
    """Names in a trash folder: the first numbers that are free, gaps between existing ones first."""
    from .sources.state import disposal_names as names

    moves = t("part").select("p_partkey", F.lpad(_s("p_partkey"), 8, "0").alias("path"), F.col("p_name").alias("stem"), F.lit(".jpg").alias("suffix"))
    n = F.col("p_name")
    ends = F.when(n.like("red%"), F.array(*map(F.lit, ("", " 3", " 4", " 9")))).when(n.like("blue%"), F.array(F.lit(" 2"), F.lit(" 5"))).otherwise(F.array(F.lit(" 6"), F.lit(" 07"), F.lit(" x")))
    have = t("part").select("p_name", F.explode(ends).alias("end")).select(F.concat("p_name", "end", F.lit(".jpg")).alias("name")).distinct()
    return names(moves, have).select("p_partkey", "target")



# ---------------------------------------------------------------- state


@query(
    """
    select o_orderkey, case when o_orderkey % 4 <> 0 and o_orderkey % 9 <> 0 then 'v' || o_orderkey end as value, o_orderkey % 4 <> 0 and o_orderkey % 9 <> 0 as hit from orders
    """
)
def cache_lookup(spark, t):
    """Cached values of files whose identity is unchanged."""
    k = F.col("o_orderkey")
    ident = {"m": k * 10, "c": k * 11, "s": F.round(F.col("o_totalprice") * 100).cast("long"), "i": k, "d": F.lit(1).cast("long")}
    files = t("orders").select(_s(k).alias("path"), k, *(v.alias(n) for n, v in ident.items()))
    old = t("orders").where("o_orderkey % 4 <> 0").select(F.lit("probe").alias("kind"), _s(k).alias("path"), F.when(k % 9 == 0, k).otherwise(k * 10).alias("m"), *(v.alias(n) for n, v in ident.items() if n != "m"), F.concat(F.lit("v"), _s(k)).alias("value"))
    return caches.lookup(files, old, "probe").select("o_orderkey", "value", "hit")


@query("select cast(o_orderkey as varchar) as path, case when o_orderkey % 3 = 0 then 'new' else 'old' end as value from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def cache_upsert(spark, t):
    """A cache with new rows in place of old ones."""
    k = F.col("o_orderkey")
    row = lambda w, v: t("orders").where(w).select(F.lit("health").alias("kind"), _s(k).alias("path"), F.lit(v).alias("value"))
    return caches.upserted(row("o_orderkey % 2 = 0", "old"), row("o_orderkey % 3 = 0", "new")).select("path", "value")


@query("select cast(o_orderkey as varchar) as path from orders where not (o_orderkey % 2 = 0 and (o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 or o_orderkey = 0))")
def completed_anti(spark, t):
    """Sources that no valid completion covers."""
    k = F.col("o_orderkey")
    ident = lambda x: F.struct(x.alias("s"), (x + 1).alias("m"))
    src = t("orders").select(_s(k).alias("path"), ident(k).alias("identity"))
    done = t("orders").where("o_orderkey % 2 = 0").select(_s(k).alias("source"), ident(F.when(k % 5 == 0, -k).otherwise(k)).alias("source_identity"), F.concat(F.lit("o"), _s(k)).alias("output"), ident(k * 2).alias("output_identity"))
    files = t("orders").select(F.concat(F.lit("o"), _s(k)).alias("path"), ident(F.when(k % 7 == 0, k).otherwise(k * 2)).alias("identity"))
    return library.without(src, caches.completed(src, done, files)).select("path")


@query(
    """
    with j as (select o_orderkey, o_orderkey % 3 in (0, 1) and (o_orderkey % 4 <> 0 or o_orderkey = 0) as unfinished from orders)
    select o_orderkey, unfinished, row_number() over (order by unfinished desc, o_orderkey) as ord from j
    """
)
def resume_order(spark, t):
    """Jobs in the order of a resumed run: unfinished ones first."""
    from .operators.order import row_numbers

    k = F.col("o_orderkey")
    jobs = t("orders").select("o_orderkey", _s(k).alias("path"), (k * 3).alias("size"), (k * 5).alias("mtime_ns"))
    journal = t("orders").select(_s(k).alias("path"), F.when(k % 4 == 0, k).otherwise(k * 3).alias("size"), (k * 5).alias("mtime_ns"), F.when(k % 3 == 0, "running").when(k % 3 == 1, "queued").otherwise("done").alias("status"))
    return row_numbers(library.resumed(jobs, journal).select("o_orderkey", "unfinished"), [], [F.desc("unfinished"), F.col("o_orderkey")], "ord")



@query(
    """
    select o_orderkey, case when k in (0, 1) then 'finish' when k = 2 then 'discard' when k = 3 then 'restore' else 'unresolved' end as decision, k in (2) as drop_temporary from (select o_orderkey, o_orderkey % 6 as k from orders)
    """
)
def recovery_decision(spark, t):
    """What to do with interrupted replacements."""
    k = F.col("o_orderkey")
    m, key = k % 6, _s(k)
    ident = lambda what: F.struct(F.concat(F.lit(what), key).alias("id"))
    place = lambda p: F.concat(F.lit(f"{p}/"), key)
    tx = t("orders").select("o_orderkey", key.alias("id"), *(place(p).alias(p) for p in ("source", "final", "backup", "temporary")), ident("src").alias("source_identity"), ident("out").alias("output_identity"))
    # 0: output in place, backup there; 1: output in place, backup gone; 2: nothing moved yet; 3: original only as backup; 4, 5: neither
    seen = F.array_compact(F.array(
        F.when(m.isin(0, 1), F.struct(place("final").alias("path"), ident("x").alias("identity"), ident("out").alias("output_identity"))),
        F.when(m.isin(0, 3), F.struct(place("backup").alias("path"), ident("src").alias("identity"), ident("x").alias("output_identity"))),
        F.when(m == 2, F.struct(place("source").alias("path"), ident("src").alias("identity"), ident("x").alias("output_identity"))),
        F.when(m == 2, F.struct(place("temporary").alias("path"), ident("x").alias("identity"), ident("out").alias("output_identity"))),
        F.when(m == 4, F.struct(place("source").alias("path"), ident("y").alias("identity"), ident("x").alias("output_identity"))),
    ))
    observed = t("orders").select(F.explode(seen).alias("o")).select("o.*")
    return caches.recovery(tx, observed).select("o_orderkey", "decision", "drop_temporary")


# ---------------------------------------------------------------- readers, checks and rules


def _probe_text() -> Column:
    """A probe's JSON for each order: a picture with side data, tags in mixed case, a track, a chapter and a group."""
    k = _s("o_orderkey")
    n = F.col("o_orderkey")
    turn = F.when(n % 4 == 0, '{"side_data_type": "Display Matrix", "rotation": -90}, {"side_data_type": "DOVI configuration record"}').otherwise('{"side_data_type": "CPB properties"}')
    video = F.concat(F.lit('{"index": 0, "codec_type": "video", "codec_name": "h264", "width": 1920, "pix_fmt": "yuv420p", "color_range": "tv", "disposition": {"default": 1, "attached_pic": '), F.when(n % 5 == 0, "1").otherwise("0"), F.lit(', "unknown_mark": 1}, "tags": {"ROTATE": "180", "Title": "Film '), k, F.lit('", "encoder": "x"}, "side_data_list": ['), turn, F.lit("]}"))
    audio = F.concat(F.lit(', {"index": 1, "codec_type": "audio", "codec_name": "aac", "channels": '), _s(n % 6 + 1), F.lit(', "sample_rate": "48000", "tags": {"language": "eng", "LANGUAGE": "deu"}}'))
    chapter = F.concat(F.lit('{"start_time": "0.0", "end_time": "'), k, F.lit('.5", "tags": {"TITLE": "Part '), k, F.lit('"}}'))
    group = F.when(n % 2 == 0, '{"index": 0, "id": "0x1", "type": "Tile Grid"}').otherwise('{"index": 0, "id": "0x2", "type": "", "group_type": "IAMF"}')
    whole = F.concat(F.lit('{"streams": ['), video, F.when(n % 3 > 0, audio).otherwise(""), F.lit('], "chapters": ['), chapter, F.lit('], "stream_groups": ['), group, F.lit("]}"))
    return F.when(n % 17 == 0, F.lit("{broken")).when(n % 19 == 0, F.lit("[1]")).otherwise(whole)


@query(
    """
    select o_orderkey, ok, case when ok then cast(case when o_orderkey % 3 > 0 then 2 else 1 end as integer) end as streams, case when ok then 'Film ' || o_orderkey end as title, case when ok then ['title'] end as tags,
      cast(case when ok then case when o_orderkey % 4 = 0 then -90.0 else 180.0 end end as double) as rotation, case when ok then o_orderkey % 5 = 0 end as cover, case when ok then ['default'] end as marks,
      case when ok then case when o_orderkey % 4 = 0 then ['DOVI configuration record', 'Display Matrix'] else ['CPB properties'] end end as side, case when ok and o_orderkey % 3 > 0 then 'deu' end as language,
      case when ok and o_orderkey % 3 > 0 then cast(o_orderkey % 6 + 1 as integer) end as channels, case when ok then 'Part ' || o_orderkey || ' to ' || o_orderkey || '.5' end as chapter, case when ok then case when o_orderkey % 2 = 0 then 'Tile Grid' else 'IAMF' end end as grouped,
      cast(case when ok and o_orderkey % 5 = 0 then 1 when ok then 0 end as integer) as covers
    from (select o_orderkey, o_orderkey % 17 <> 0 and o_orderkey % 19 <> 0 and o_orderkey % 23 <> 0 as ok from orders)
    """
)
def probe_inventory(spark, t):
    """Inventories from what a probe prints; none where it failed or can't be read."""
    from .sources.state import inventories

    raw = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 23 == 0, 1).otherwise(0).alias("returncode"), _probe_text().alias("text"))
    i = F.col("inventory")
    first, second, chapter = F.get(i["streams"], F.lit(0)), F.get(i["streams"], F.lit(1)), F.get(i["chapters"], F.lit(0))
    return inventories(raw).select(
        "o_orderkey", i.isNotNull().alias("ok"), F.when(i.isNotNull(), F.size(i["streams"])).alias("streams"), first["tags"]["title"].alias("title"), F.array_sort(F.map_keys(first["tags"])).alias("tags"), first["rotation"].alias("rotation"), first["attached_pic"].alias("cover"),
        F.array_sort(F.map_keys(first["disposition"])).alias("marks"), first["side_data_types"].alias("side"), second["tags"]["language"].alias("language"), second["channels"].alias("channels"),
        F.concat(chapter["title"], F.lit(" to "), chapter["end_time"]).alias("chapter"), F.get(i["stream_groups"], F.lit(0))["type"].alias("grouped"), F.when(i.isNotNull(), F.size(I.artwork(i))).alias("covers"),
    )


@query("select o_orderkey, cast(case o_orderkey % 5 when 0 then null when 1 then null when 2 then null else o_orderkey + 0.25 end as double) as duration, not (o_orderkey % 7 = 0 or o_orderkey % 7 = 1) as animated from orders")
def media_duration(spark, t):
    """Durations of containers, and whether GIFs are animated, from a probe's texts."""
    from .sources.state import duration

    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "{").when(k % 5 == 1, '{"format": {}}').when(k % 5 == 2, '{"format": {"duration": "N/A"}}').otherwise(F.concat(F.lit('{"format": {"duration": "'), _s(k), F.lit('.25"}}')))
    packets = F.when(k % 7 == 0, "1").when(k % 7 == 1, "0").when(k % 7 == 2, "N/A").otherwise(_s(k % 7))
    return duration(t("orders").select("o_orderkey", text.alias("text"), packets.alias("packets"))).select("o_orderkey", "duration", I.gif_animated(F.col("packets")).alias("animated"))


@query(f"with {_PACKETS} select path, stream_index, greatest(0, round(max(start + greatest(0, dur)) - min(start), 3)) as span from p group by all")
def packet_reader(spark, t):
    """The same spans from packet lines as a probe prints them, written as text and read back."""
    import uuid

    from .running import checkpoints
    from .sources.state import packet_lines

    p = _packets(t)
    fields = [F.concat(F.lit(f"{n}="), F.col(n)) for n in ("stream_index", "pts_time", "dts_time", "duration_time")]
    at = f"{checkpoints(spark)}/packets/{uuid.uuid4().hex}"
    p.select(F.concat(F.lit("f"), "path").alias("file"), F.concat_ws("|", *fields).alias("value")).write.partitionBy("file").text(at)
    lines = packet_lines(spark, at, r"file=f(\d+)/[^/]+\z")
    return timeline.packet_spans(lines).withColumn("span", F.round("span", 3))


@query("select user_id % 40 as path, cast(user_id % 3 as varchar) as stream_index, arg_min(case when event_id % 2 = 0 then event_id / 8.0 else event_id / 4.0 end, event_id) as start from events where event_id % 11 <> 0 group by 1, 2")
def decoded_starts(spark, t):
    """First decoded timestamps, read from a decoder's JSON."""
    from .sources.state import decoded_frames

    e = F.col("event_id")
    frame = F.concat(F.lit('{"stream_index": '), _s(F.col("user_id") % 3), F.lit(', "best_effort_timestamp_time": "'), F.when(e % 11 == 0, "N/A").when(e % 2 == 0, _s(e / 8)).otherwise(""), F.lit('", "pts_time": "'), F.when(e % 11 == 0, "").otherwise(_s(e / 4)), F.lit('"}'))
    rows = t("events").select((F.col("user_id") % 40).alias("path"), e, frame.alias("f")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("event_id", "f"))).alias("fs"))
    raw = rows.select("path", F.concat(F.lit('{"frames": ['), F.array_join(F.transform("fs", lambda x: x["f"]), ", "), F.lit("]}")).alias("text"))
    return timeline.first_starts(decoded_frames(raw)).select("path", "stream_index", "start")


@query(
    """
    select o_orderkey, k > 4 as ok, case k when 0 then 'converter exited with code 1: a |  b | ' || o_orderkey when 1 then 'output file was not created' when 2 then 'output file is 0 bytes' when 3 then 'integrity check failed: torn' when 4 then 'Apple playback check failed: mute' else 'ok' end as reason,
      k in (5, 6, 7) as decodes, case when k = 0 then 'a |  b | ' || o_orderkey when k = 8 then 'Input file is truncated' when k in (1, 2, 3) then '(no stderr)' when k = 4 then 'x |  y' when k in (5, 6, 7) then 'ok' else 'z' end as health,
      k not in (3, 4) as plain, case when k = 3 then 'torn' when k = 4 then 'Apple playback: mute' else 'ok' end as mp4,
      case when k = 8 then 'source file is truncated; missing media cannot be reconstructed (duration mismatch: x)' when k = 9 then 'duration mismatch: x' else 'other' end as explained
    from (select o_orderkey, o_orderkey % 10 as k from orders)
    """
)
def output_checks(spark, t):
    """Finished commands, decoding runs and existing MP4s judged; a truncated source explained."""
    n = F.col("o_orderkey")
    k = n % 10
    text = F.when(k == 0, F.concat(F.lit("a\n\n b\n"), _s(n))).when(k == 8, "Input file is truncated").when(k.isin(1, 2, 3), "").when(k == 4, "x\n y").when(k == 6, "Referenced QT chapter track not found\n").when(k == 7, "Application provided invalid, non monotonically increasing dts to muxer in stream 0").when(k == 5, " \n").otherwise("z")
    code = F.when(k.isin(0, 1, 2, 3, 4), 1).otherwise(0)
    done = validation.output_verdict(F.when(k == 0, 1).otherwise(0), text, k != 1, F.when(k == 2, 0).otherwise(9), F.lit(True), k != 3, F.lit("torn"), k != 4, F.lit("mute"))
    health = validation.decoder_health(code, text)
    mp4 = validation.mp4_health(k != 3, F.lit("torn"), k != 4, F.lit("mute"))
    said = validation.truncation_explained(F.when(k >= 8, "duration mismatch: x").otherwise("other"), text)
    return t("orders").select("o_orderkey", done.alias("a"), health.alias("b"), mp4.alias("c"), said.alias("explained")).select("o_orderkey", "a.ok", "a.reason", F.col("b.ok").alias("decodes"), F.col("b.reason").alias("health"), F.col("c.ok").alias("plain"), F.col("c.reason").alias("mp4"), "explained")


@query(
    """
    select o_orderkey, case when o_orderkey % 3 = 0 then 'capture date metadata not preserved in output' end as dated, case when o_orderkey % 4 = 0 and o_orderkey % 5 <> 0 then 'source EXIF block missing from output WebP' end as block,
      case when o_orderkey % 3 = 0 then '2019-05-06' when o_orderkey % 3 = 1 then strftime(o_orderdate, '%Y-%m-%d') else '2001-09-09' end as date,
      case when o_orderkey % 6 = 0 then 'direct' when o_orderkey % 6 = 1 then 'sips' when o_orderkey % 6 = 2 then 'jpegtran' when o_orderkey % 6 = 3 then 'direct' when o_orderkey % 6 = 4 then 'direct' else 'direct' end as route,
      case when o_orderkey % 6 = 2 then 'fail' when o_orderkey % 6 = 1 then 'sips' else 'direct' end as bare
    from orders
    """
)
def photo_checks(spark, t):
    """Lost capture dates and EXIF blocks, media dates, and what follows a photo's first attempt."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    kept = M.metadata_kept(F.array(day), F.when(k % 3 == 0, F.array(F.lit("1900-01-01"))).otherwise(F.array(F.lit("x"), day)), True)
    head = F.when(k % 8 == 0, F.lit("..Exif\0\0")).otherwise(F.lit("..eXIf..")).cast("binary")
    ext = F.when(k % 8 == 0, ".jpg").when(k % 4 == 0, ".png").otherwise(".tiff")
    block = M.metadata_kept(F.array(day), F.array(day), False, ext, head, F.when(k % 5 == 0, "..EXIF").otherwise("....").cast("binary"))
    date = N.media_date(F.when(k % 3 == 0, " 2019-05-06 ").otherwise("2019"), F.when(k % 3 == 1, F.concat(day, F.lit("T01:02:03Z"))).otherwise(""), F.lit(1_000_000_000 * 10**9))
    text, suffix = F.when(k % 6 == 3, "fine").otherwise(F.lit(_BROKEN)), F.when(k % 6 == 1, ".gif").when(k % 6 == 2, ".jpeg").when(k % 6 == 3, ".jpg").otherwise(".png")
    routes = [commands.photo_route(F.when(k % 6 == 0, 0).otherwise(1), text, suffix, x).alias(n) for n, x in (("route", True), ("bare", False))]
    return t("orders").select("o_orderkey", kept.alias("dated"), block.alias("block"), date.alias("date"), *routes)


from .values import PHOTO_DECODE_MARKERS as _MARKERS  # noqa: E402

_BROKEN = _MARKERS[0]


@query("select p_brand, bool_or(k in (0, 1, 3, 4)) as video, bool_or(k in (2, 5)) as photos, bool_or(k = 5) as heic, bool_or(k = 4) as animated_webp, count(*) filter (s) as resumed, count(*) as candidates from (select p_brand, p_partkey % 7 as k, p_partkey % 3 = 0 as s from part) group by p_brand")
def tool_needs(spark, t):
    """Which tools the jobs of each brand need, and how many of them a former run left."""
    k = F.col("p_partkey") % 7
    kind = F.when(k == 0, "video").when(k == 1, "mp4").when(k == 2, "photo").when(k == 3, "gif").when(k == 4, "webp").when(k == 5, "heic").otherwise("other")
    jobs = t("part").select("p_brand", kind.alias("kind"), (F.col("p_partkey") % 3 == 0).alias("unfinished"))
    out = library.requirements(jobs, True, ("p_brand",)).join(library.resumed_count(jobs, ("p_brand",)), "p_brand")
    return out.join(library.requirements(jobs.where("kind = 'heic'"), True, ("p_brand",)).select("p_brand", F.col("photos").alias("heic")), "p_brand", "left").withColumn("heic", F.coalesce("heic", F.lit(False)))


@query(
    """
    with f as (select distinct p_brand as a, replace(p_type, ' ', '/') as b, p_partkey as k from part),
    p as (select case when k % 5 = 0 then k || '.jpg' when k % 5 = 1 then a || '/' || k || '.jpg' else a || '/' || b || '/' || k || '.jpg' end as path from f),
    d as (select path, string_split(path, '/') as s from p),
    up as (select distinct array_to_string(s[1:n], '/') as folder from d, range(1, 9) r(n) where n < len(s))
    select folder, (select count(*) from p where starts_with(p.path, folder || '/')) as files from up
    """
)
def folder_walk(spark, t):
    """All folders that hold a file at any depth, and how many files each holds."""
    from .functions.paths import ancestors

    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, F.concat(_s(k), F.lit(".jpg"))).when(k % 5 == 1, F.concat("p_brand", F.lit("/"), _s(k), F.lit(".jpg"))).otherwise(F.concat("p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), _s(k), F.lit(".jpg")))
    files = t("part").select(path.alias("path"))
    inner = files.where(F.contains("path", F.lit("/"))).select(F.explode(ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))
    return renames.folders_of(files).select(F.col("path").alias("folder")).join(inner, "folder")


@query(
    """
    with f as (select p_partkey as k, case when p_partkey % 3 = 0 then 'b' when p_partkey % 3 = 1 then 'a/z' else '' end as dir, lpad(cast(p_partkey * 7 % 1000 as varchar), 4, '0') || '_' || p_partkey as name from part)
    select k, row_number() over (order by dir, name) as n from f
    """
)
def walk_order(spark, t):
    """Files numbered as a walk meets them."""
    from .operators.order import row_numbers

    k = F.col("p_partkey")
    dir_ = F.when(k % 3 == 0, "b").when(k % 3 == 1, "a/z").otherwise("")
    f = t("part").select(k.alias("k"), dir_.alias("dir"), F.concat(F.lpad(_s(k * 7 % 1000), 4, "0"), F.lit("_"), _s(k)).alias("name"))
    return row_numbers(f, [], library.walk(), "n").select("k", "n")


@query(
    """
    select o_orderkey, 'ffmpeg -nostdin -y -i in.gif -tag:v:0 avc1 -brand mp42 -movflags +faststart -pix_fmt yuv420p -c:v libx264 -preset slow -crf 18 -vf scale=trunc(iw/2)*2:trunc(ih/2)*2 out.mp4' as animation, 'cwebp -lossless -metadata all -preset photo in.png -o ' || o_orderkey || '.webp' as photo,
      'ffmpeg -nostdin -y -display_rotation:v:0 ' || case when o_orderkey % 13 = 0 then '90' else '0' end || ' -i' as rotate,
      case o_orderkey % 4 when 0 then 'cwebp' else 'ffmpeg' end as tool, o_orderkey % 4 = 2 as tolerant, o_orderkey % 4 in (1, 2) as copied
    from orders
    """
)
def stage_commands(spark, t):
    """Argument vectors of animations, photos and rotations, and of the stage a job is in."""
    k = F.col("o_orderkey")
    line = lambda c: F.array_join(c, " ")
    rotated = F.array_join(F.slice(commands.rotate(F.lit("a"), F.lit("b"), F.col("turned")), 1, 6), " ")
    stage, kind = F.when(k % 4 == 1, "remux").when(k % 4 == 2, "repair-remux").otherwise("convert"), F.when(k % 4 == 0, "photo").otherwise("video")
    of = commands.for_stage(stage, kind, F.lit("a"), F.lit("b"), F.col("source"), F.lit(False))
    films = _films(t).withColumn("turned", F.when(k % 13 == 0, F.col("source")).otherwise(_inventory(F.transform(F.col("source")["streams"], lambda s: s.withField("rotation", F.lit(0.0))))))
    return films.select("o_orderkey", line(commands.animation(F.lit("in.gif"), F.lit("out.mp4"))).alias("animation"), line(commands.photo(F.lit("in.png"), F.concat(_s(k), F.lit(".webp")))).alias("photo"), rotated.alias("rotate"), F.get(of, F.lit(0)).alias("tool"), F.array_contains(of, "-err_detect").alias("tolerant"), F.array_contains(of, "copy").alias("copied"))


@query("select count(*) filter (k in (0, 1)) as completed, count(*) filter (k in (2, 3)) as rolled_back, count(*) filter (k in (4, 5)) as unresolved, 'source_staged output_installed original_disposed' as chain from (select o_orderkey % 6 as k from orders)")
def recovery_counts(spark, t):
    """How interrupted replacements ended, and the states a replacement goes through."""
    found = caches.recovery_report(recovery_decision(spark, t))
    state, chain = F.lit(caches.STATES[0]), []
    for _ in range(len(caches.STATES) - 1):
        state = caches.next_state(state)
        chain.append(state)
    return found.select("*", F.concat_ws(" ", *chain).alias("chain"))


def _shared(spark, what: str) -> str:
    import uuid

    from .running import checkpoints

    return f"{checkpoints(spark)}/{what}/{uuid.uuid4().hex}"


@query("select cast(o_orderkey as varchar) as path, case when o_orderkey % 2 = 0 then 'new' else 'old' end || o_orderkey as value from orders")
def cache_table(spark, t):
    """A cache written, read, renewed in half its rows, and read again; an absent one is empty."""
    from .sources.state import read_cache, write_cache

    at, k = _shared(spark, "cache"), F.col("o_orderkey")
    ident = F.struct(*(k.alias(c) for c in caches.IDENTITY))
    rows = lambda df, v: df.select(F.lit("probe").alias("kind"), _s(k).alias("path"), ident.alias("identity"), F.lit(None).cast("string").alias("f"), F.concat(F.lit(v), _s(k)).alias("value"))
    write_cache(read_cache(spark, at).unionByName(rows(t("orders"), "old")), at)
    write_cache(caches.upserted(read_cache(spark, at), rows(t("orders").where("o_orderkey % 2 = 0"), "new")), at)
    write_cache(rows(t("orders").limit(0), "x"), at, dirty=False)
    return read_cache(spark, at).select("path", "value")


@query("select cast(1 + p_partkey % 2 as bigint) as batch_id, row_number() over (partition by p_partkey % 2 order by 'a' || p_partkey) - 1 as seq, 'a' || p_partkey as src, 'b' || p_partkey as dst from part")
def batch_table(spark, t):
    """Applied renames recorded in two batches, numbered in order; nothing is recorded of none."""
    from .sources.state import read_batches, record_batch

    at = _shared(spark, "batches")
    rows = t("part").select("p_partkey", F.concat(F.lit("a"), _s("p_partkey")).alias("src"), F.concat(F.lit("b"), _s("p_partkey")).alias("dst"))
    record_batch(rows.where("p_partkey % 2 = 0"), at, "then")
    record_batch(rows.limit(0), at, "never")
    record_batch(rows.where("p_partkey % 2 = 1"), at, "now")
    return read_batches(spark, at).select("batch_id", "seq", "src", "dst")


@query(
    """
    with l as (select user_id, event_id, ['queued', 'running', 'converted', 'failed'][event_id % 4 + 1] as status from events)
    select cast(user_id as varchar) as path, max(event_id) as at, case when arg_max(status, event_id) in ('queued', 'running') then 'interrupted' else arg_max(status, event_id) end as status from l group by 1
    """
)
def journal_stream(spark, t):
    """The latest state of each file from a stream of changes kept batch by batch, of a run that didn't finish."""
    from .streaming.progress import journal, write_journal

    at, e = _shared(spark, "journal"), F.col("event_id")
    status = F.when(e % 4 == 0, "queued").when(e % 4 == 1, "running").when(e % 4 == 2, "converted").otherwise("failed")
    rows = t("events").select(_s("user_id").alias("path"), status.alias("status"), F.lit("").alias("detail"), e.alias("at"))
    rows.repartition(3).write.parquet(f"{at}/in")
    q = write_journal(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), f"{at}/table", f"{at}/state", "0 seconds")
    q.processAllAvailable()
    q.stop()
    return journal(spark, f"{at}/table", finished=False).select("path", "at", "status")


@query(progress_fold_sql := oracle_sql()["progress_fold"])
def progress_stream(spark, t):
    """The state of each converter at each progress line, from a stream of lines."""
    from .running import streamed
    from .streaming.progress import progress_stream as fold

    e = t("events").select(_s("user_id").alias("key"), "event_id", F.round(F.col("value") * 1000).cast("long").alias("us"))
    parts = F.array(F.concat(F.lit("out_time_us="), _s("us")), F.concat(F.lit("speed="), F.when(F.col("event_id") % 5 == 0, "N/A").otherwise(F.concat(_s(F.col("event_id") % 7), F.lit("x")))), F.lit("noise"), F.lit("progress=continue"))
    lines = e.select("key", "event_id", F.posexplode(parts).alias("i", "value")).select("key", (F.col("event_id") * 4 + F.col("i")).alias("pos"), "value")
    return streamed(spark, lines, fold, "append")


@query(
    """
    select case when o_orderkey % 5 = 0 then 'failed' when o_orderkey % 5 = 1 then 'skipped' else 'converted' end as status, cast(o_orderkey as varchar) as path,
      case when o_orderkey % 5 = 0 then 'unexpected processing error: bad ' || o_orderkey when o_orderkey % 5 = 1 then 'cancelled; partial output removed, original kept' else 'fine' end as detail, cast(case when o_orderkey % 5 < 2 then 0 else o_orderkey end as bigint) as bytes_saved
    from orders
    """
)
def guarded_jobs(spark, t):
    """A caller's function over all jobs: rows that raise fail alone."""
    from .operators.injected import Cancelled, outcomes

    def work(row: dict) -> tuple[str, str, int]:
        if row["n"] % 5 == 0:
            raise ValueError(f"bad {row['n']}")
        if row["n"] % 5 == 1:
            raise Cancelled
        return "converted", "fine", row["n"]

    return outcomes(t("orders").select(_s("o_orderkey").alias("path"), F.col("o_orderkey").alias("n")), work)


@query("select o_orderkey, not (o_orderkey % 7 = 0) and not (o_orderkey % 2 = 0 and o_orderkey % 3 = 0 and o_orderkey % 5 <> 0) as open from orders")
def injected_status(spark, t):
    """Open jobs by a caller's functions of the path; a function that raises tells nothing."""
    from .operators.injected import open_mp4s

    def status(path: str) -> str:
        return {0: "standard", 1: "convert"}[int(path) % 3]

    k = F.col("o_orderkey")
    jobs = t("orders").select(k, _s(k).alias("path"), F.when(k % 2 == 0, "mp4").otherwise("video").alias("kind"))
    left = open_mp4s(jobs, status, lambda p: int(p) % 5 != 0, lambda p: int(p) % 7 == 0, ("standard",), validate=True).select(k, F.lit(True).alias("open"))
    return jobs.select(k).join(left, "o_orderkey", "left").select("o_orderkey", F.coalesce("open", F.lit(False)).alias("open"))


@query("select s_suppkey, s_suppkey % 4 = 0 as groups from supplier")
def group_support(spark, t):
    """Which hosts' probes list stream groups."""
    k = F.col("s_suppkey")
    said = F.when(k % 4 < 2, "-show_streams\n-show_stream_groups  show groups").otherwise("-show_streams")
    return t("supplier").select("s_suppkey", capabilities.stream_groups(F.when(k % 4 == 1, 1).otherwise(0), said).alias("groups"))


@query(
    """
    with p as (select *, row_number() over (partition by p_brand, p_name order by p_partkey) as n, count(*) over (partition by p_brand, p_name) as c, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as title from part),
    f as (select p_partkey as k, lower(replace(p_brand, '#', '_')) || '/' || replace(p_name, ' ', '_') || ' (' || p_partkey || ').jpg' as src, lower(replace(p_brand, '#', '_')) || '/' || case when p_partkey % 2 = 0 then '2020-01-02 ' else '' end || title || ' [' || case when c >= 10 and n < 10 then '0' else '' end || n || '].jpg' as dst, lower(replace(p_brand, '#', '_')) as dir from p)
    select 1 as phase, src, dst from f union all select distinct 2, dir, upper(dir[1]) || replace(dir[2:], '_', ' ') from f
    """
)
def whole_plan(spark, t):
    """File plan with dates, then folder plan, told apart by their phase."""
    k = F.col("p_partkey")
    path = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" ("), _s(k), F.lit(").jpg"))
    files = t("part").select(k, path.alias("path"))
    return renames.plan_all(files, files.where("p_partkey % 2 = 0").select("path", F.lit("2020-01-02").alias("date")))


def _works(t) -> DataFrame:
    """Source and output of a film per order with covers, subtitles and chapters; each rest of the order's number breaks one promise."""
    n = F.col("o_orderkey")
    k = n % 24
    none, marks = _tags(), F.create_map().cast("map<string,int>")
    default = lambda yes: F.create_map(F.lit("default"), F.when(yes, 1).otherwise(0))
    picture = lambda **x: _stream(**({"index": 0, "codec_type": "video", "codec_name": "h264", "pix_fmt": "yuv420p", "tags": none, "disposition": marks, "color": none, "attached_pic": F.lit(False), "avg_frame_rate": "30/1", "start_time": "0", "field_order": "progressive", "sample_aspect_ratio": "1:1"} | x))
    sound = lambda i, on, **x: _stream(index=i, codec_type="audio", codec_name="aac", tags=none, disposition=default(on), color=none, attached_pic=F.lit(False), sample_rate="48000", channels=2, start_time="0", **x)
    words = lambda codec, on, lang: _stream(index=3, codec_type="subtitle", codec_name=codec, tags=_tags(language=lang), disposition=default(on), color=none, attached_pic=F.lit(False))
    cover = lambda codec, width: _stream(index=4, codec_type="video", codec_name=codec, width=width, height=10, tags=none, disposition=F.create_map(F.lit("attached_pic"), F.lit(1)), color=none, attached_pic=F.lit(True))
    many = lambda *items: F.filter(F.array(*items), lambda s: s["index"] >= 0)
    unless = lambda s, gone: s.withField("index", F.when(gone, -1).otherwise(s["index"]))
    two = unless(picture(index=5), k != 0)
    src = many(picture(side_data_types=F.array(F.lit("Mastering display metadata")), field_order=F.when(k == 15, "tt").otherwise("progressive")), sound(1, F.lit(True)), sound(2, F.lit(False)), words("subrip", F.lit(True), F.lit("eng")), cover("png", F.lit(20)), two)
    side = F.when(k == 18, F.array().cast("array<string>")).otherwise(F.array(F.lit("Mastering display metadata")))
    out = many(
        picture(side_data_types=side, pix_fmt=F.when(k == 14, "yuv444p").otherwise("yuv420p"), sample_aspect_ratio=F.when(k == 16, "4:3").otherwise("1:1"), avg_frame_rate=F.when(k == 17, "25/1").otherwise("30/1")),
        sound(1, k != 4), sound(2, k == 4), unless(words(F.when(k == 7, "subrip").otherwise("mov_text"), k != 6, F.when(k == 8, "fra").otherwise("eng")), k == 5), unless(cover(F.when(k == 10, "mjpeg").otherwise("png"), F.when(k == 11, 21).otherwise(20)), k == 9),
    )
    chapter = lambda title, start, end: F.struct(start.alias("start_time"), end.alias("end_time"), title.alias("title"))
    text = lambda s: F.lit(s).cast("string")
    before = F.array(chapter(text("Intro"), text("0"), text("50")), chapter(text("Chapter 2"), text("50"), text("100")))
    after = F.array(chapter(F.when(k == 13, "Outro").otherwise("Intro"), F.when(k == 19, "0.75").otherwise("0"), F.when(k == 20, text(None)).otherwise("50")), chapter(text("Part two"), text("50"), text("100.5")))
    spans = lambda a: F.create_map(*(x for i in range(3) for x in (F.lit(str(i)), a)))
    return t("orders").select(
        "o_orderkey", _inventory(src, before).alias("source"), _inventory(out, F.when(k == 12, F.slice(after, 1, 1)).otherwise(after)).alias("output"), F.lit(100.0).alias("source_duration"), F.when(k.isin(1, 2, 3), 80.0).otherwise(100.0).alias("output_duration"),
        spans(F.when(k == 3, F.lit(None).cast("double")).otherwise(80.0)).alias("source_spans"), spans(F.when(k == 2, 60.0).otherwise(80.5)).alias("output_spans"), F.create_map().cast("map<string,double>").alias("source_starts"), F.create_map().cast("map<string,double>").alias("output_starts"),
    )


@query(
    """
    select o_orderkey, r is null or r like 'recovered%' as ok, coalesce(r, 'ok') as reason from (select o_orderkey, case o_orderkey % 24
      when 0 then 'primary video stream count changed: source 2, output 1'
      when 1 then 'recovered all 80.0s of readable media; the damaged source header claimed 100.0s'
      when 2 then 'duration mismatch: source 100.0s vs output 80.0s' when 3 then 'duration mismatch: source 100.0s vs output 80.0s'
      when 4 then 'default audio selection changed: source [0], output [1]'
      when 5 then 'compatible subtitle track count changed: source 1, output 0' when 6 then 'default subtitle selection changed'
      when 7 then 'subtitle track 1 is not MP4 mov_text' when 8 then 'subtitle track 1 language/title/disposition metadata changed'
      when 9 then 'compatible artwork count changed: source 1, output 0' when 10 then 'artwork stream 1 codec_name changed' when 11 then 'artwork stream 1 width changed'
      when 12 then 'chapter count changed: source 2, output 1' when 13 then 'chapter 1 title changed'
      when 14 then 'primary output is not h264/8-bit 4:2:0: h264/yuv444p'
      when 15 then 'video field order changed: source tt vs output progressive' when 16 then 'video sample aspect ratio changed: source 1:1 vs output 4:3'
      when 17 then 'video average frame rate changed: source 30.000 vs output 25.000 (--allow-video-downgrade to permit)' when 18 then 'video HDR/dynamic-range side data changed'
      when 19 then 'chapter 1 timing changed' when 20 then 'chapter 1 timing could not be verified' end as r from orders)
    """
)
def promise_rules(spark, t):
    """The other promises of an output: pictures, recovered lengths, default tracks, subtitles, artwork, chapters, format, looks."""
    return validation.verify_streams(_works(t)).select("o_orderkey", "ok", "reason")


@query("select 'd/' || p_name || ' ' || p_partkey as src, 'd/é ' || upper(p_name) || ' ' || p_partkey as dst from part")
def plan_file(spark, t):
    """A rename plan written as JSON lines in the shared folder, and read back."""
    from .sources.state import load_plan, save_plan

    k = _s("p_partkey")
    at = _shared(spark, "plans")
    save_plan(t("part").select(F.concat(F.lit("d/"), "p_name", F.lit(" "), k).alias("src"), F.concat(F.lit("d/é "), F.upper("p_name"), F.lit(" "), k).alias("dst")), "/lib", at)
    return load_plan(spark, at)


@query("select 'lib/' || c_custkey as path, 'video' as kind, c_custkey * 3 as size, c_custkey * 5 as mtime_ns, ['queued', 'running', 'done'][c_custkey % 3 + 1] as status, case when c_custkey % 2 = 0 then c_mktsegment end as detail, 'then' as updated_at from customer")
def journal_file(spark, t):
    """A run's journal written as JSON lines, and read back as rows."""
    from .sources.state import load_journal, save_journal

    k = F.col("c_custkey")
    status = F.when(k % 3 == 0, "queued").when(k % 3 == 1, "running").otherwise("done")
    rows = t("customer").select(F.concat(F.lit("lib/"), _s(k)).alias("path"), F.lit("video").alias("kind"), (k * 3).alias("size"), (k * 5).alias("mtime_ns"), status.alias("status"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("detail"), F.lit("then").alias("updated_at"))
    at = _shared(spark, "journals")
    save_journal(rows, at, "first", "then", None, False)
    return load_journal(spark, at)


@query(
    """
    select cast(n_nationkey as bigint) as k, case when n_nationkey % 5 <> 0 then 'prepared' end as state, n_nationkey % 5 in (2, 3, 4) as valid, row_number() over (order by lpad(cast(n_nationkey as varchar), 2, '0')) as n from nation where n_nationkey % 7 <> 6
    """
)
def manifest_rows(spark, t):
    """Manifests of interrupted replacements, in order of their folders; damaged ones and paths outside the root are marked."""
    from .operators.order import row_numbers
    from .sources.state import find_manifests

    at, k = _shared(spark, "manifests"), F.col("n_nationkey")
    source = F.when(k % 5 == 1, "/library/a").otherwise(F.concat(F.lit("/lib/"), _s(k)))
    whole = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("prepared").alias("state"), F.lit("/lib").alias("root"), source.alias("source"), F.lit("/lib/x").alias("final"), F.lit("/lib/t").alias("temporary"), F.lit("/lib").alias("backup")))
    texts = t("nation").where(k % 7 != 6).select(F.when(k % 5 == 0, "{").otherwise(whole).alias("value"), F.lpad(_s(k), 2, "0").alias("at"))
    texts.write.partitionBy("at").text(at)  # a folder each
    rows = find_manifests(spark, at, "part-*")
    return row_numbers(rows.select(F.regexp_extract("manifest", r"/at=(\d+)/[^/]+\z", 1).cast("long").alias("k"), "state", "valid", "manifest"), [], ["manifest"], "n").select("k", "state", "valid", "n")


# ---------------------------------------------------------------- logs, runs and chains

_STEPS = "prepare stage install dispose sidecar cleanup".split()
_ODD = ["roll back", "recover", "refuse", "stage", "cleanup", "burn"]


def _moved(state: str, event: str = "event") -> str:
    """SQL of the state after ``event`` in ``state``."""
    return f"""case when {event} = 'prepare' and {state} in ('absent', 'completed', 'rolled_back', 'refused') then 'prepared' when {event} = 'refuse' and {state} = 'prepared' then 'refused'
      when {event} = 'stage' and {state} = 'prepared' then 'source_staged' when {event} = 'install' and {state} = 'source_staged' then 'output_installed' when {event} = 'dispose' and {state} = 'output_installed' then 'original_disposed'
      when {event} = 'cleanup' and {state} = 'original_disposed' then 'completed' when {event} = 'roll back' and {state} in ('source_staged', 'output_installed') then 'rolled_back'
      when {event} = 'recover' and {state} in ('prepared', 'source_staged') then 'rolled_back' when {event} = 'recover' and {state} in ('output_installed', 'original_disposed') then 'completed' else {state} end"""


_DECIDED = "case after when 'prepared' then 'discard' when 'source_staged' then 'restore' when 'output_installed' then 'finish' when 'original_disposed' then 'finish' end"

_LIVES = f"""recursive e as (
  select l_orderkey as k, l_linenumber as n, l_partkey as p, l_suppkey as u, l_extendedprice as x, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i,
    case when l_partkey % 11 = 0 then null when l_partkey % 5 = 0 then {_ODD!r}[cast(l_suppkey % 6 as integer) + 1] else {_STEPS!r}[cast((l_linenumber - 1) % 6 as integer) + 1] end as event from lineitem),
s as (
  select k, n, p, u, x, i, event, 'absent' as before, {_moved("'absent'")} as after from e where i = 1
  union all select e.k, e.n, e.p, e.u, e.x, e.i, e.event, s.after, {_moved("s.after", "e.event")} from s join e on e.k = s.k and e.i = s.i + 1),
told as (select *, before <> after or coalesce(event = 'sidecar' and before = 'original_disposed', false) as legal from s)"""


def _lives(t) -> DataFrame:
    """An event per line of an order: the steps of a commit, some out of place, unknown or null."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    pick = lambda names, at: F.element_at(F.array(*(F.lit(x) for x in names)), (at + 1).cast("int"))
    event = F.when(p % 11 == 0, F.lit(None).cast("string")).when(p % 5 == 0, pick(_ODD, F.col("l_suppkey") % 6)).otherwise(pick(_STEPS, (n - 1) % 6))
    return t("lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), p.alias("p"), F.col("l_suppkey").alias("u"), F.col("l_extendedprice").alias("x"), event.alias("event"))


@query(f"with {_LIVES} select k, n, p, u, x, before, after, case when not legal then coalesce(event, 'nothing') || ' in ' || before end as fault, {_DECIDED} as decision from told")
def replacement_log(spark, t):
    """The state of a replacement before and after every event of its log, events out of place, and what recovery would do there."""
    from .operators import replacement

    return replacement.history(_lives(t), ["k"], ["n", "p", "u", "x"]).select("k", "n", "p", "u", "x", "before", "after", "fault", "decision")


@query(f"with {_LIVES} select k, arg_max(after, i) as state, count(*) as events, cast(count(*) filter (not legal) as bigint) as illegal, max({_DECIDED}) filter (i = c) as decision from (select *, count(*) over (partition by k) as c from told) group by k")
def replacement_states(spark, t):
    """How each replacement stands at the end of its log."""
    from .operators import replacement

    return replacement.standing(_lives(t), ["k"], ["n", "p", "u", "x"]).select("k", "state", "events", "illegal", "decision")


@query(
    """
    with e as (
      select o_orderkey as id, case when r = 0 then ['prepare|', 'refuse|source changed before transaction commit'] when r = 1 then ['prepare|', 'refuse|validated output changed before transaction commit']
        when r = 2 then ['prepare|', 'refuse|output appeared during conversion: ' || o_orderkey || '.mp4'] when r = 3 then ['prepare|', 'stage|', 'install|', 'roll back|could not dispose of original']
        else list_concat(['prepare|', 'stage|', 'install|', 'dispose|'], case when o_orderkey % 2 = 0 then ['sidecar|lib/' || o_orderkey || '.xmp'] else [] end, case when o_orderkey % 3 = 0 then ['sidecar|lib/' || o_orderkey || '.aae'] else [] end, ['cleanup|']) end as events
      from (select o_orderkey, o_orderkey % 7 as r from orders)),
    u as (select id, unnest(events) as e, generate_subscripts(events, 1) - 1 as seq from e)
    select id, cast(seq as integer) as seq, split_part(e, '|', 1) as event, nullif(split_part(e, '|', 2), '') as detail,
      case split_part(e, '|', 1) when 'prepare' then 'prepared' when 'refuse' then 'refused' when 'stage' then 'source_staged' when 'install' then 'output_installed' when 'dispose' then 'original_disposed' when 'sidecar' then 'original_disposed' when 'roll back' then 'rolled_back' else 'completed' end as after
    from u
    """
)
def replacement_commits(spark, t):
    """The events of committing each replacement, with refusals, roll backs and sidecars, and the state after each."""
    from .operators import replacement

    k = F.col("o_orderkey")
    at = lambda end: F.concat(F.lit("lib/"), _s(k), F.lit(end))
    o = t("orders").select(k.alias("id"), at(".mov").alias("source"), at(".mp4").alias("final"), at(".tmp").alias("temporary"), k.alias("source_identity"), (k + 1).alias("output_identity"), (k % 7 != 3).alias("disposable"), F.array(at(".xmp"), at(".aae")).alias("sidecars"))
    one = lambda end, identity, output: F.struct(at(end).alias("path"), identity.alias("identity"), output.alias("output_identity"))
    files = F.array(
        F.when(k == k, one(".mov", F.when(k % 7 == 0, -1).otherwise(k), k)),
        F.when(k % 7 != 1, one(".tmp", k * 0 - 3, k + 1)), F.when(k % 7 == 2, one(".mp4", k, k)), F.when(k % 2 == 0, one(".xmp", k, k)), F.when(k % 3 == 0, one(".aae", k, k)),
    )
    observed = t("orders").select(F.explode(files).alias("f")).where("f is not null").select("f.*")
    return replacement.history(replacement.committed(o, observed), ["id"], ["seq"]).select("id", "seq", "event", "detail", "after")


@query(
    """
    select o_orderkey as id, case o_orderkey % 8 when 0 then 'unsupported transaction version in lib/.replacing-' || o_orderkey || '/manifest.json' when 1 then 'transaction source escapes its root' when 2 then 'transaction backup is not local to its source'
      when 3 then 'transaction output paths are not local to their source' when 4 then 'transaction contains an invalid sidecar path' when 5 then 'transaction disposal root does not match its source root' end as problem from orders
    """
)
def manifest_rules(spark, t):
    """Which rule a manifest breaks first: version, root, backup, outputs, sidecars, disposal."""
    from .operators import replacement

    k = F.col("o_orderkey")
    r = k % 8
    directory = F.concat(F.lit("lib/.replacing-"), _s(k))
    m = t("orders").select(
        k.alias("id"), F.concat(directory, F.lit("/manifest.json")).alias("manifest"), F.when(r == 0, 2).otherwise(1).alias("version"), F.when(r == 1, "music").otherwise("lib").alias("root"), F.lit("lib/a.mov").alias("source"),
        F.when(r == 3, "lib/b/a.mp4").otherwise("lib/a.mp4").alias("final"), F.lit("lib/a.tmp").alias("temporary"), F.concat(directory, F.when(r == 2, "/b.mov").otherwise("/a.mov")).alias("backup"),
        F.array(F.lit("lib/a.AAE"), F.when(r == 4, "lib/a.jpg").otherwise("lib/a.xmp")).alias("sidecars"), F.when(r == 5, "music").when(r == 6, "lib").alias("disposal_root"),
    )
    return m.select("id", replacement.manifest_problem().alias("problem"))


@query(
    f"""
    with {_LIVES},
    begun as (select k, max(i) as b from told where legal and event = 'prepare' group by k),
    gone as (select distinct k, 'lib/' || (n % 3 + 1) || '.xmp' as path from told join begun using (k) where legal and event = 'sidecar' and i > b),
    every as (select k, 'lib/' || i || '.xmp' as path from (select distinct l_orderkey as k from lineitem), (select unnest([1, 2, 3]) as i) v)
    select k, path from every anti join gone using (k, path)
    """
)
def sidecars_left(spark, t):
    """Sidecars that the current replacement of each order still has to dispose of."""
    from .operators import replacement

    log = _lives(t).withColumn("detail", F.concat(F.lit("lib/"), _s(F.col("n") % 3 + 1), F.lit(".xmp")))
    every = t("lineitem").select(F.col("l_orderkey").alias("k")).distinct().select("k", F.explode(F.array(*(F.lit(f"lib/{i}.xmp") for i in (1, 2, 3)))).alias("path"))
    return replacement.sidecars_left(log, every, ["k"], ["n", "p", "u", "x"])


@query(
    """
    with e as (select cast(user_id as varchar) as key, event_id, cast(round(value * 1000) as bigint) as us from events),
    r as (select *, count(*) filter (event_id % 7 = 0) over (partition by key order by event_id rows between unbounded preceding and 1 preceding) as run from e)
    select key, event_id * 4 + 3 as pos, cast(coalesce(run, 0) as bigint) as run,
      coalesce(last_value(case when event_id % 3 <> 0 then us / 1000000.0 end ignore nulls) over w, 0.0) as current,
      nullif(last_value(case when event_id % 10 = 0 then -1.0 when event_id % 2 = 0 then cast(event_id % 9 as double) end ignore nulls) over w, -1.0) as speed
    from r window w as (partition by key, coalesce(run, 0) order by event_id rows between unbounded preceding and current row)
    """
)
def progress_runs(spark, t):
    """The state of each converter at each progress line, with several runs per key: each begins anew."""
    from .streaming.progress import progress_runs as runs

    return runs(_progress_lines(t))


def _progress_lines(t) -> DataFrame:
    e = t("events").select(_s("user_id").alias("key"), "event_id", F.round(F.col("value") * 1000).cast("long").alias("us"))
    n = F.col("event_id")
    time = F.when(n % 3 == 0, "out_time_us=N/A").when(n % 3 == 1, F.concat(F.lit("out_time_us="), _s("us"))).otherwise(F.concat(F.lit("out_time_ms="), _s("us")))
    fast = F.when(n % 10 == 0, "speed=N/A").when(n % 2 == 0, F.concat(F.lit("speed="), _s(n % 9), F.lit("x"))).otherwise("frame=7")
    parts = F.array(time, fast, F.lit("noise"), F.when(n % 7 == 0, "progress=end").otherwise("progress=continue"))
    return e.select("key", "event_id", F.posexplode(parts).alias("i", "value")).select("key", (F.col("event_id") * 4 + F.col("i")).alias("pos"), "value")


_CHAINS = """
    recursive f as (select p_partkey as k from part), p as (
      select 'd/n' || lpad(cast(k as varchar), 9, '0') as src, case when k % 97 <> 0 then 'd/n' || lpad(cast(k + 1 as varchar), 9, '0') when k % 194 = 0 and k > 96 then 'd/n' || lpad(cast(k - 96 as varchar), 9, '0') when k % 388 = 97 then 'd/kept' else 'd/free' || k end as dst from f
      union all select 'e/x' || lpad(cast(k as varchar), 9, '0'), 'd/n' || lpad(cast(k as varchar), 9, '0') from f where k % 5 = 0),
    """


@query(
    f"""
    with {_CHAINS}
    ranked as (select p.src, p.dst, q.src is not null as waits, row_number() over (partition by p.dst order by coalesce(p.src < q.src, false), p.src) as place from p left join p q on q.src = p.dst),
    w as (select src, dst, waits from ranked where place = 1),
    s as (select src, 0 as round from w where not waits and dst <> 'd/kept' and dst not in (select 'd/n' || lpad(cast(k as varchar), 9, '0') from f) union all select w.src, s.round + 1 from s join w on w.dst = s.src)
    select p.src, p.dst, s.round is not null as moved, cast(s.round as integer) as round from p left join s on s.src = p.src
    """
)
def rename_chains(spark, t):
    """Chains of renames, rings, taken targets and targets that several want."""
    from .operators.chains import settled

    k = F.col("p_partkey")
    d = lambda n: F.concat(F.lit("d/n"), F.lpad(_s(n), 9, "0"))
    e = F.concat(F.lit("e/x"), F.lpad(_s(k), 9, "0"))
    to = F.when(k % 97 != 0, d(k + 1)).when((k % 194 == 0) & (k > 96), d(k - 96)).when(k % 388 == 97, "d/kept").otherwise(F.concat(F.lit("d/free"), _s(k)))
    plan = t("part").select(d(k).alias("src"), to.alias("dst")).unionByName(t("part").where(k % 5 == 0).select(e.alias("src"), d(k).alias("dst")))
    taken = plan.select(F.col("src").alias("path")).unionByName(spark.range(1).select(F.lit("d/kept").alias("path")))
    return settled(plan, taken).select("src", "dst", (F.col("act") == "move").alias("moved"), "round")


@query(
    """
    with p as (select *, lower(replace(p_brand, '#', '_')) as brand, p_size % 4 as size, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as title from part),
    f as (select *, row_number() over (partition by brand, size, p_partkey % 3, p_name order by p_partkey) as n, count(*) over (partition by brand, size, p_partkey % 3, p_name) as c from p),
    blocked as (select min(brand) as brand from p)
    select case when brand = (select brand from blocked) then brand else upper(brand[1]) || replace(brand[2:], '_', ' ') end || '/Size ' || size || '/Box ' || p_partkey % 3 || '/' || title || ' [' || case when c >= 10 and n < 10 then '0' else '' end || n || '].jpg' as path from f union all select upper(brand[1]) || replace(brand[2:], '_', ' ') || '/Notes.txt' from blocked
    """
)
def phases_applied(spark, t):
    """Where every file is after the file phase and the folder phase, three folders deep; one folder's new name is taken."""
    from .running import kept

    k = F.col("p_partkey")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    path = F.concat(brand, F.lit("/size_"), _s(F.col("p_size") % 4), F.lit("/box_"), _s(k % 3), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" ("), _s(k), F.lit(").jpg"))
    files = t("part").select(k, path.alias("path"))
    low = t("part").agg(F.min(brand).alias("b"))
    other = low.select(F.concat(F.upper(F.substring("b", 1, 1)), F.replace(F.substring("b", 2, 1000), F.lit("_"), F.lit(" ")), F.lit("/Notes.txt")).alias("path"))
    # a listing is a table, not worked out anew at each step
    listed = kept(files.select("path").unionByName(other).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"))
    return renames.apply_all(renames.plan_all(listed), listed)[0]


@query(
    """
    with p as (select p_partkey as k, 'f' || lpad(cast(p_partkey // 4 as varchar), 9, '0') as g, p_partkey // 4 % 4 as form, p_partkey % 4 as i from part)
    select k, g || case form
      when 0 then ['', ' 2', ' 2 2', ' 2 3'][i + 1] when 1 then [' 2', '', ' 3', ' 4'][i + 1] when 2 then ['', ' 2', ' 3', ' 2 2'][i + 1] else ['', ' 2', ' 2 2', ' 2 2 2'][i + 1] end || '.jpg' as target
    from p
    """
)
def claimed_names(spark, t):
    """Names in a trash folder that moves of several base names claim: whoever comes first gets one, the other goes on."""
    from .sources.state import disposal_names as names

    k = F.col("p_partkey")
    group, form, i = F.floor(k / 4), F.floor(k / 4) % 4, (k % 4).cast("int")
    # forms: a, a, a 2, a 2; a 2, a, a, a; a, a 2, a, a 2; a, a, a 2, a 2 2
    ends = F.when(form == 0, F.array(*map(F.lit, ("", "", " 2", " 2")))).when(form == 1, F.array(*map(F.lit, (" 2", "", "", "")))).when(form == 2, F.array(*map(F.lit, ("", " 2", "", " 2")))).otherwise(F.array(*map(F.lit, ("", "", " 2", " 2 2"))))
    moves = t("part").select(k.alias("k"), F.lpad(_s(k), 9, "0").alias("path"), F.concat(F.lit("f"), F.lpad(_s(group), 9, "0"), F.get(ends, i)).alias("stem"), F.lit(".jpg").alias("suffix"))
    return names(moves, spark.createDataFrame([], "name string")).select("k", "target")


# ---------------------------------------------------------------- lives of keys, merged tables, folding


@query(
    """
    with recursive e as (select cast(user_id as varchar) as key, epoch_us(ts) / 1000000.0 as moment, event_id, value,
        case when event_id % 9 in (0, 4) then 'start' when event_id % 23 = 1 then 'finish' when event_id % 29 = 2 then 'clear' when event_id % 31 = 3 then 'noise' else 'update' end as action,
        case when event_id % 2 = 0 then 100.0 when event_id % 5 = 0 then 0.0 end as total from events),
    u as (select *, row_number() over (partition by key order by moment, event_id) as n from e where action <> 'noise'),
    s as (
      select key, cast(0 as bigint) as n, false as live, cast(0 as double) as since, -10 as step, cast(null as double) as total, false as told, cast(0 as double) as moment, cast(null as integer) as percent, cast(0 as double) as current from (select distinct key from u)
      union all select key, n, action in ('start', 'update') and (live or action = 'start'), case when action = 'start' or told then moment else since end,
          case when action = 'start' then -10 when told and percent is not null then percent - percent % 10 else step end, case when action = 'start' then given else total end, told, moment, percent, current
        from (select *, action = 'update' and live and (coalesce(percent >= step + 10, false) or moment - since >= 60) as told
          from (select u.key, u.n, u.action, u.moment, u.total as given, s.live, s.since, s.step, s.total, greatest(0, u.value) as current,
              case when s.total > 0 then cast(greatest(0, least(100, trunc(greatest(0, u.value) / s.total * 100))) as integer) end as percent from s join u on u.key = s.key and u.n = s.n + 1)))
    select key, moment as "at", percent, current from s where told
    """
)
def progress_lifetimes(spark, t):
    """Lines worth printing of files that start, finish and are cleared, from a stream of events; what belongs to none is silent."""
    from .running import rocksdb, streamed
    from .streaming.progress import lifetimes

    e = F.col("event_id")
    action = F.when((e % 9).isin(0, 4), "start").when(e % 23 == 1, "finish").when(e % 29 == 2, "clear").when(e % 31 == 3, "noise").otherwise("update")
    total = F.when(e % 2 == 0, 100.0).when(e % 5 == 0, 0.0)
    events = t("events").select(_s("user_id").alias("key"), e.alias("pos"), (F.expr("unix_micros(cast(ts as timestamp))") / 1_000_000).alias("at"), action.alias("action"), F.col("value").alias("current"), total.alias("total"))
    with rocksdb(spark):
        return streamed(spark, events, lifetimes, "append")


@query(
    """
    with l as (select l_orderkey, l_linenumber % 4 as batch, max(l_linestatus || l_returnflag || l_linenumber) as status, max((l_orderkey * 7 + l_linenumber * 5) % 13) as moment from lineitem group by all)
    select 'lib/' || l_orderkey as path, arg_max(status, moment * 4 + batch) as status, max(moment) as "at", count(*) as batches from l group by l_orderkey
    """
)
def merged_runs(spark, t):
    """The latest state of each file in a table merged batch by batch, one of them put in twice; read again after later steps."""
    from .sources import runs

    at, n = _shared(spark, "merged"), F.col("l_linenumber")
    status = F.concat("l_linestatus", "l_returnflag", _s(n))
    rows = t("lineitem").select(F.concat(F.lit("lib/"), _s("l_orderkey")).alias("path"), status.alias("status"), ((F.col("l_orderkey") * 7 + n * 5) % 13).alias("at"), (n % 4).alias("batch"))
    rows = rows.groupBy("path", "batch").agg(F.max("status").alias("status"), F.max("at").alias("at"))
    for k in (0, 1, 1, 2, 3):
        runs.merge(rows.where(F.col("batch") == k).select("path", "status", "at"), at, ["path"], "at", k)
    now = runs.read(spark, at, ["path"], "at")
    return now.select("path", "status", "at").join(rows.groupBy("path").agg(F.count("*").alias("batches")), "path")


_FOLDS = [("Straße", "STRASSE"), ("ﬁsh", "FISH"), ("Ὀδυσσεύς", "ὈΔΥΣΣΕΎΣ"), ("Ünal", "üNAL"), ("plain", "PLAIN")]


@query(
    """
    with p as (select p_partkey, ['strasse', 'fish', 'ὀδυσσεύσ', 'ünal', 'plain'][p_partkey % 5 + 1] || ' ' || lower(p_brand) as key from part)
    select p_partkey, key, row_number() over (partition by key order by p_partkey) as seq, case when count(*) over (partition by key) >= 10 then 2 else 1 end as width from p
    """
)
def folded_series(spark, t):
    """Numbered series whose names differ by case alone, in letters that fold to several, too."""
    from .functions.folding import folded

    k, word = F.col("p_partkey"), F.lit(None).cast("string")
    for n, pair in enumerate(_FOLDS):
        word = F.when(k % 5 == n, F.when(F.floor(k / 5) % 2 == 0, pair[0]).otherwise(pair[1])).otherwise(word)
    df = t("part").select(k, folded(F.concat(word, F.lit(" "), F.col("p_brand"))).alias("key"), k.alias("number"), F.lit(False).alias("is_dup"), k.alias("name"))
    return N.numbered_series(df, ["key"]).select("p_partkey", "key", "seq", "width")
