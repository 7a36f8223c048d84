"""Registered queries over the derived variant tables and the SQL that checks them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import exprs as X
from locusframe.operators.concat import concat
from locusframe.operators.frame import VcfFrame, split_lines
from locusframe.operators.merge import MergeOptions, merge
from locusframe.operators.regions import coalesced, record_end, semi_join
from locusframe.operators.view import ViewOptions, view
from locusframe.plans import fixtures as fx
from locusframe.header import VcfHeader, union
from locusframe.sources.writer import inflated_lines, packed, write_parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None, *ctes: tuple[str, str]) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = fx.duck(*ctes) + "\n" + sql


def _pos() -> Column:
    return F.col("pos_raw").cast("long").alias("pos")


# --- view: filters over sites ----------------------------------------------------------------------------------------------------

_SITE = ("chrom", "pos", "id", "ref", "alt", "qual", "filter")
_SQL_SITE = "select chrom, pos, id, ref, alt, qual, filter from sites where "
_MASK = """list_sum(list_distinct(list_transform(string_split(alt, ','), lambda a: case when a in ('', '.') then 16 when a = '*' or a[1] = '<' then 8
  when length(a) <> length(ref) then 2 when a = ref then 16 when len(list_filter(range(1, length(ref) + 1), lambda i: substr(a, i, 1) <> substr(ref, i, 1))) = 1 then 1 else 4 end)))"""


def _viewed(options: ViewOptions) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(fx.sites_frame(fx.tables(spark, sf_dir)), options).df.select("chrom", _pos(), *_SITE[2:])

    return run


for _name, _options, _where in (
    ("view_types_snps", ViewOptions(types="snps", min_alleles=2, max_alleles=2, filters="PASS"), f"({_MASK}) & 1 <> 0 and n_alt = 1 and filter = 'PASS'"),
    ("view_types_indels", ViewOptions(types="indels"), f"({_MASK}) & 2 <> 0"),
    ("view_exclude_snps", ViewOptions(exclude_types="snps"), f"({_MASK}) & 1 = 0"),
    ("view_types_other_ref", ViewOptions(types="other,ref"), f"({_MASK}) & 24 <> 0"),
    ("view_min_max_alleles", ViewOptions(min_alleles=1, max_alleles=2), "n_alt + 1 between 1 and 2"),
    ("view_filter_pass", ViewOptions(filters="PASS"), "filter = 'PASS'"),
    ("view_filter_multi", ViewOptions(filters="q10,."), "list_has_any(string_split(filter, ';'), ['q10', '.'])"),
    ("view_qual_bounds", ViewOptions(min_qual=200.0, max_qual=700.0), "qual <> '.' and cast(nullif(qual, '.') as double) between 200 and 700"),
    ("view_qual_max_only", ViewOptions(max_qual=300.0), "qual = '.' or cast(nullif(qual, '.') as double) <= 300"),
    ("view_ids", ViewOptions(ids="rs1,rs2,rs77,rs199,."), "id in ('rs1', 'rs2', 'rs77', 'rs199', '.')"),
    ("view_region_interval", ViewOptions(regions="chr1:150-400,chr2:-300,chr3:700-"), "(chrom = 'chr1' and pos <= 400 and pos + length(ref) - 1 >= 150) or (chrom = 'chr2' and pos <= 300) or (chrom = 'chr3' and pos + length(ref) - 1 >= 700)"),
):
    _add(_name, _viewed(_options), _SQL_SITE + _where)


def _site_query(column: Callable[[], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.tables(spark, sf_dir)["sites"].select("k", column())

    return run


_add("site_type_mask", _site_query(lambda: X.site_types(F.col("ref"), F.col("alt")).alias("mask")), f"select k, cast({_MASK} as int) as mask from sites")
_add("count_alts", _site_query(lambda: X.count_alts(F.col("alt")).alias("n")), "select k, cast(n_alt as int) as n from sites")
_add("qual_double", _site_query(lambda: X.double(F.col("qual")).alias("q")), "select k, try_cast(nullif(qual, '.') as double) as q from sites")


def _intervals(t: dict[str, DataFrame]) -> DataFrame:
    return t["sites"].filter("k % 50 = 0").select(F.col("chrom").alias("r_chrom"), (F.col("pos") - 5).alias("r_start"), (F.col("pos") + 25).alias("r_end"))


def _region_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.tables(spark, sf_dir)
    df = t["sites"].withColumn("end", record_end(F.col("pos"), F.col("ref")))
    return semi_join(df, _intervals(t)).select(*_SITE)


_add("view_region_semi_join", _region_semi_join, _SQL_SITE + "exists (select 1 from sites r where r.k % 50 = 0 and r.chrom = sites.chrom and sites.pos <= r.pos + 25 and sites.pos + length(sites.ref) - 1 >= r.pos - 5)")
_add(
    "region_coalesce",
    lambda spark, sf_dir: coalesced(fx.tables(spark, sf_dir)["sites"].filter("k % 3 <> 1 or k % 7 < 4").select(F.col("chrom").alias("r_chrom"), F.col("pos").alias("r_start"), (F.col("pos") + F.col("k") % 23).alias("r_end"))),
    "select r_chrom, min(r_start) as r_start, max(r_end) as r_end from i group by r_chrom, island",
    ("r", "select chrom as r_chrom, pos as r_start, pos + k % 23 as r_end from sites where k % 3 <> 1 or k % 7 < 4"),
    ("n", "select *, max(r_end) over (partition by r_chrom order by r_start, r_end rows between unbounded preceding and 1 preceding) as before from r"),
    ("i", "select *, sum(case when before is null or r_start > before + 1 then 1 else 0 end) over (partition by r_chrom order by r_start, r_end rows unbounded preceding) as island from n"),
)

# --- view: genotypes -------------------------------------------------------------------------------------------------------------


def _genotypes(options: ViewOptions, *columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(fx.cohort_frame(fx.tables(spark, sf_dir)), options).df.select("chrom", _pos(), *columns)

    return run


def _columns_sql(samples: str, order: str) -> str:
    return f"select s.chrom, s.pos, string_agg(t.col, chr(9) order by {order}) as samples_raw from txt t join sites s using (k) where t.s in ({samples}) group by s.k, s.chrom, s.pos"


_add("view_samples_subset", _genotypes(ViewOptions(samples="S1,S4,S6"), "samples_raw"), _columns_sql("1, 4, 6", "t.s"))
_add("view_samples_exclude", _genotypes(ViewOptions(samples="^S0,S7"), "samples_raw"), _columns_sql("1, 2, 3, 4, 5, 6", "t.s"))
_add("view_samples_reorder", _genotypes(ViewOptions(samples="S7,S6,S5,S4,S3,S2,S1,S0"), "samples_raw", "info"), "select *, 'DP=' || cast(k % 50 as varchar(9)) as info from (" + _columns_sql("0, 1, 2, 3, 4, 5, 6, 7", "t.s desc") + ") join (select k, chrom, pos from sites) using (chrom, pos)")
ORACLES["view_samples_reorder"] = ORACLES["view_samples_reorder"].replace("select *, 'DP='", "select chrom, pos, samples_raw, 'DP='")
_COUNTS = ("c", "select k, sum(case when missing then 0 else 2 end) as an, sum(case when missing then 0 else cast(a = 1 as int) + cast(b = 1 as int) end) as ac1, sum(case when missing then 0 else cast(a = 2 as int) + cast(b = 2 as int) end) as ac2 from gts where s in ({0}) group by k")
_AC = "case n_alt when 0 then '' when 1 then cast(ac1 as varchar) else cast(ac1 as varchar) || ',' || cast(ac2 as varchar) end"
_add("view_acan_subset", _genotypes(ViewOptions(samples="S0,S2,S3"), "info"), f"select chrom, pos, 'DP=' || cast(k % 50 as varchar) || ';AC=' || {_AC} || ';AN=' || cast(an as varchar) as info from sites join c using (k)", (_COUNTS[0], _COUNTS[1].format("0, 2, 3")))
_add("view_min_ac", _genotypes(ViewOptions(min_ac=6), "alt"), "select chrom, pos, alt from sites join c using (k) where greatest(case when n_alt >= 1 then ac1 else 0 end, case when n_alt = 2 then ac2 else 0 end) >= 6", (_COUNTS[0], _COUNTS[1].format("0, 1, 2, 3, 4, 5, 6, 7")))
_add("view_drop_genotypes", _genotypes(ViewOptions(drop_genotypes=True, types="snps"), "id", "ref", "alt", "qual", "filter", "info", "format"), f"select chrom, pos, id, ref, alt, qual, filter, 'DP=' || cast(k % 50 as varchar) as info, cast(null as varchar) as format from sites where ({_MASK}) & 1 <> 0")


def _info_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.tables(spark, sf_dir)["sites"].withColumn("info", F.expr("case when k % 3 = 0 then '.' when k % 3 = 1 then 'AC=1;DB;DP=' || k else 'AN=5' end"))
    return s.select("k", X.rewrite_info(F.col("info"), {"AC": F.col("n_alt").cast("string"), "AN": F.lit(None).cast("string")}).alias("info"))


_add("view_info_rewrite", _info_rewrite, "select k, 'AC=' || cast(n_alt as varchar) || case when k % 3 = 1 then ';DB;DP=' || cast(k as varchar) else '' end as info from sites")


def _gt_query(columns: Callable[[], list[Column]]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.tables(spark, sf_dir)["txt"].select("k", "s", *columns())

    return run


_add("gt_parse", _gt_query(lambda: [X.gt_alleles(F.col("gt"))[i].cast("long").alias(name) for i, name in enumerate("ab")]), "select k, s, case when missing then null else a end as a, case when missing then null else b end as b from gts")
_add("gt_phase", _gt_query(lambda: [X.phased(F.col("gt")).alias("phased")]), "select k, s, phased and not missing as phased from gts")
_add("subfield", _gt_query(lambda: [X.subfield(F.col("col"), F.lit(2)).alias("dp"), X.subfield(F.col("col"), F.lit(9)).alias("none")]), "select k, s, case when missing then '.' else cast(b0 + 10 as varchar) end as dp, '' as none from gts")

# --- concat ----------------------------------------------------------------------------------------------------------------------


def _concat_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.sites_frame(fx.tables(spark, sf_dir))
    return concat([view(f, ViewOptions(regions=f"chr{i}")) for i in (1, 2, 3)]).df.groupBy("file_idx", "chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(_pos()).alias("total"))


_add("concat_contigs", _concat_contigs, "select cast(k % 3 as int) as file_idx, chrom, count(*) as n, cast(sum(pos) as bigint) as total from sites group by all")


def _concat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.cohort_frame(fx.tables(spark, sf_dir))
    parts = [view(f, ViewOptions(regions=f"chr{i}")) for i in (2, 1, 3)]
    return concat(parts).df.select("chrom", _pos(), "id", "ref", "alt", "qual", "filter", "samples_raw")


_add("concat_roundtrip", _concat_roundtrip, "select s.chrom, s.pos, s.id, s.ref, s.alt, s.qual, s.filter, x.samples_raw from sites s join (" + _columns_sql("0, 1, 2, 3, 4, 5, 6, 7", "t.s") + ") x using (chrom, pos)")

# --- merge -----------------------------------------------------------------------------------------------------------------------

# Records of the cohorts: what differs by cohort, and each cohort's sample columns.
_RECS = ("rec", """select s.*, c.c, s.k % 50 + c.c as dp, case when (s.k + c.c) % 4 = 0 then '.' else cast(s.k % 9 + c.c as varchar) end as xa,
  case when c.c = 1 and s.id <> '.' and s.k % 2 = 0 then 'x' || cast(s.k as varchar) else '' end as more_id,
  case when c.c = 1 and s.qual <> '.' and s.k % 2 = 0 then s.qual || '.5' else s.qual end as q, case when c.c = 1 and s.k % 4 = 0 then 'q20' else s.filter end as fl,
  c.c = 1 and s.k % 7 = 0 and s.k % 20 < 12 as other, substr('GTAC', cast(1 + s.k % 4 as int), 1) as other_alt
from sites s, (select unnest(range(0, 3)) as c) c where (s.k + c.c) % 6 <> 0""")  # fmt: skip
_TWO = ("two", "select k, bool_or(c = 0) as in0, bool_or(c = 1) as in1, bool_or(other) as other, any_value(chrom) as chrom, any_value(pos) as pos, any_value(ref) as ref, any_value(alt) as alt, any_value(other_alt) as other_alt from rec where c < 2 group by k")
_NO_ACAN = MergeOptions(no_update=True, check_sorted=False)


def _merged(options: MergeOptions, columns: tuple[str, ...], **frames: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return merge(fx.merge_frames(fx.tables(spark, sf_dir), **frames), options).df.select("chrom", "pos", *columns)

    return run


def _uniform_sql(gap: str, to_ref: bool) -> str:
    there = "(g.k + g.s % 3) % 6 <> 0"
    an = f"sum(case when {there} then case when g.missing then 0 else 2 end else {2 if to_ref else 0} end)"
    ac = lambda i: f"sum(case when {there} and not g.missing then cast(g.a = {i} as int) + cast(g.b = {i} as int) else 0 end)"
    return f"""select s.chrom, s.pos, 'DP=' || cast(i.dp as varchar) || case when s.n_alt = 1 then ';XA=' || i.xa else '' end || ';AN=' || cast(x.an as varchar) || ';AC=' ||
  case s.n_alt when 0 then '' when 1 then cast(ac1 as varchar) else cast(ac1 as varchar) || ',' || cast(ac2 as varchar) end as info, 'GT:AD' as format, x.samples_raw
from sites s join (select k, sum(dp) as dp, coalesce(min(case when xa <> '.' then c || ' ' || xa end), '. .')[3:] as xa from rec group by k) i using (k)
join (select g.k, {an} as an, {ac(1)} as ac1, {ac(2)} as ac2, string_agg(case when {there} then regexp_replace(g.col, ':[^:]*$', '') else '{gap}' end, chr(9) order by g.s % 3, g.s) as samples_raw
  from txt g group by g.k) x using (k)"""


_U = ("info", "format", "samples_raw")
_plain = {"same_format": True, "disagree": False, "rounds": False}
_add("merge_outer_uniform", _merged(MergeOptions(check_sorted=False), _U, **_plain), _uniform_sql("./.:.", False), _RECS)
_add("merge_missing_to_ref", _merged(MergeOptions(check_sorted=False, missing_to_ref=True), _U, **_plain), _uniform_sql("0/0:.", True), _RECS)
_add("merge_rounds", _merged(MergeOptions("none", no_update=True), ("ref", "alt", "round"), disagree=False, rounds=True), "select distinct chrom, pos, ref, alt, cast(1 as int) as round from rec union all select chrom, pos, ref, substr('ACGT', cast(1 + k % 4 as int), 1) || 'TT', 2 from sites where k % 13 = 0 and k % 6 <> 0 and k <> -1", _RECS)
# a repeat comes first at its position where cohort 0 alone repeats: rounds are by input, so the repeat is always the second round

_both = {"cohorts": 2, "same_format": True, "rounds": False}
_ALT2 = "case when other and in0 then alt || ',' || other_alt when other then other_alt else alt end"
for _mode in ("none", "snps", "indels", "both", "all"):
    _one = f"select chrom, pos, ref, {_ALT2} as alt from two"
    _split = "select chrom, pos, ref, case when other and not in0 then other_alt else alt end as alt from two union all select chrom, pos, ref, other_alt from two where other and in0"
    _add(f"merge_modes_{_mode}", _merged(MergeOptions(_mode, no_update=True, check_sorted=False), ("ref", "alt"), **_both), _split if _mode in ("none", "indels") else _one, _RECS, _TWO)
_add("merge_alt_union", _merged(_NO_ACAN, ("alt",), **_both), f"select chrom, pos, {_ALT2} as alt from two", _RECS, _TWO)
# GT:AD of cohort 0 gains a slot where the ALTs differ; cohort 1's allele 1 becomes allele 2 there, and its AD value moves with it
_REMAP = """select x.k, string_agg(case when (x.k + x.s % 3) % 6 = 0 then './.:.' when not (t.other and t.in0) then old when x.missing then './.:' || case when x.s % 3 = 0 then '.,.,.' else '.,.,.' end
  when x.s % 3 = 0 then old || ',.' else replace(x.gt, '1', '2') || ':' || string_split(string_split(old, ':')[2], ',')[1] || ',.,' || string_split(string_split(old, ':')[2], ',')[2] end, chr(9) order by x.s % 3, x.s) as samples_raw
from (select *, regexp_replace(col, ':[^:]*$', '') as old from txt where s % 3 < 2) x join two t using (k) group by x.k"""
_add("merge_gt_remap", lambda spark, sf_dir: _remapped(spark, sf_dir, 0), f"select t.chrom, t.pos, {_ALT2} as alt, array_to_string(list_transform(string_split(samples_raw, chr(9)), lambda v: string_split(v, ':')[1]), ' ') as part from two t join m using (k)", _RECS, _TWO, ("m", _REMAP))
_add("merge_ad_remap", lambda spark, sf_dir: _remapped(spark, sf_dir, 1), f"select t.chrom, t.pos, {_ALT2} as alt, array_to_string(list_transform(string_split(samples_raw, chr(9)), lambda v: string_split(v, ':')[2]), ' ') as part from two t join m using (k)", _RECS, _TWO, ("m", _REMAP))


def _remapped(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    df = merge(fx.merge_frames(fx.tables(spark, sf_dir), **_both), _NO_ACAN).df
    return df.select("chrom", "pos", "alt", F.array_join(F.transform(F.split("samples_raw", "\t"), lambda v: X.subfield(v, F.lit(part))), " ").alias("part"))


def _info_value(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = MergeOptions(no_update=True, check_sorted=False, info_rules=f"DP:{method}")
        df = merge(fx.merge_frames(fx.tables(spark, sf_dir), cohorts=2, same_format=True, disagree=False, rounds=False), options).df
        return df.select("chrom", "pos", F.regexp_extract("info", "DP=([^;]*)", 1).alias("dp"))

    return run


for _method, _value in (("sum", "cast(sum(dp) as varchar)"), ("avg", "case when count(*) = 2 then cast(min(dp) as varchar) || '.5' else cast(min(dp) as varchar) end"), ("min", "cast(min(dp) as varchar)"), ("max", "cast(max(dp) as varchar)"), ("join", "string_agg(cast(dp as varchar), ',' order by c)"), ("first", "cast(min(dp) as varchar)")):
    _add(f"merge_info_{_method}", _info_value(_method), f"select chrom, pos, {_value} as dp from rec where c < 2 group by k, chrom, pos", _RECS)


def _slot_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = merge(fx.merge_frames(fx.tables(spark, sf_dir), **_plain), _NO_ACAN).df
    return df.filter(F.col("info").contains("XA=")).select("chrom", "pos", F.regexp_extract("info", "XA=([^;]*)", 1).alias("xa"))


_add("merge_slot_fill", _slot_fill, "select chrom, pos, coalesce(min(case when xa <> '.' then c || ' ' || xa end), '. .')[3:] as xa from rec where n_alt = 1 group by k, chrom, pos", _RECS)
_add("merge_qual_max", _merged(_NO_ACAN, ("qual",), **_plain), "select chrom, pos, case when bool_and(q = '.') then '.' else max_by(q, coalesce(try_cast(nullif(q, '.') as double), -1)) end as qual from rec group by k, chrom, pos", _RECS)
_add("merge_id_union", _merged(_NO_ACAN, ("id",), **_plain), "select chrom, pos, case when id = '.' then '.' when bool_or(more_id <> '') and bool_or(c = 0) then id || ';' || max(more_id) when bool_or(more_id <> '') then max(more_id) || ';' || id else id end as id from rec group by k, chrom, pos, id", _RECS)
_add("merge_filter_union", _merged(_NO_ACAN, ("filter",), **_plain), """select chrom, pos, coalesce(string_agg(f, ';' order by o) filter (f not in ('PASS', '.')), case when bool_or(f = 'PASS') then 'PASS' else '.' end) as filter
from (select k, chrom, pos, f, min(c * 10 + i) as o from (select k, chrom, pos, c, unnest(string_split(fl, ';')) as f, unnest(range(0, len(string_split(fl, ';')))) as i from rec) group by all) group by k, chrom, pos""", _RECS)  # fmt: skip
_add("merge_format_union", _merged(_NO_ACAN, ("format",), disagree=False, rounds=False), "select chrom, pos, case when bool_and(c = 0) then 'GT:AD' else 'GT:AD:DP' end as format from rec group by k, chrom, pos", _RECS)


def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = merge(fx.merge_frames(fx.tables(spark, sf_dir), cohorts=2, same_format=True), MergeOptions("none", no_update=True))
    turn = F.row_number().over(Window.partitionBy("chrom").orderBy(*m.order))
    return m.df.select("chrom", "pos", "alt", turn.cast("long").alias("ordinal"))


_add(
    "merge_order", _order, "select chrom, pos, alt, row_number() over (partition by chrom order by pos, round, cls, f) as ordinal from o", _RECS, _TWO,
    ("o", f"""select chrom, pos, ref, case when other and not in0 then other_alt else alt end as alt, 1 as round, 0 as f, 0 as cls from two
  union all select chrom, pos, ref, other_alt, 1, 1, 0 from two where other and in0
  union all select chrom, pos, ref, substr('ACGT', cast(1 + k % 4 as int), 1) || 'TT', 2, 0, 1 from sites where k % 13 = 0 and k % 6 <> 0"""),
)

# --- files -----------------------------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; one of this machine's only where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="locusframe-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.cohort_frame(fx.tables(spark, sf_dir))
    path = scratch(spark, "vcf")
    write_parts(f, path)
    back = split_lines(spark.read.option("lineSep", "\n").text(f"{path}/part-*"))
    return VcfFrame(f.header, back).df.select("chrom", _pos(), "id", "ref", "alt", "qual", "filter", "info", "format", "samples_raw")


_add("vcf_text_roundtrip", _text_roundtrip, "select s.chrom, s.pos, s.id, s.ref, s.alt, s.qual, s.filter, 'DP=' || cast(s.k % 50 as varchar) as info, 'GT:AD:DP' as format, x.samples_raw from sites s join (" + _columns_sql("0, 1, 2, 3, 4, 5, 6, 7", "t.s") + ") x using (chrom, pos)")


def _bgzf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as BGZF blocks and back, partition by partition."""
    f = fx.cohort_frame(fx.tables(spark, sf_dir))
    back = split_lines(inflated_lines(packed(f.lines().select("value"), 6)))
    return VcfFrame(f.header, back).df.select("chrom", _pos(), "id", "ref", "alt", "qual", "filter", "info", "format", "samples_raw")


_add("bgzf_roundtrip", _bgzf_roundtrip)
ORACLES["bgzf_roundtrip"] = ORACLES["vcf_text_roundtrip"]


def _header_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta lines of one header a region and nation: all regions declare a contig each, nations repeat their region's."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # a header is a file's, on the driver
    heads = [VcfHeader([f"##source={r['n_nationkey'] % 4}", f"##contig=<ID=r{r['n_regionkey']},length={r['n_nationkey']}>"]) for r in rows]
    return spark.createDataFrame(list(enumerate(union(heads).meta)), "ordinal long, line string")


_add(
    "header_union", _header_union, "select cast(row_number() over (order by o, p) - 1 as bigint) as ordinal, line from (select -1 as o, 0 as p, '##fileformat=VCFv4.2' as line union all select min(n_nationkey), 0, '##source=' || cast(n_nationkey % 4 as varchar) from nation group by n_nationkey % 4 "
    "union all select min(n_nationkey), 1, '##contig=<ID=r' || cast(n_regionkey as varchar) || ',length=' || cast(min(n_nationkey) as varchar) || '>' from nation group by n_regionkey)",
)
