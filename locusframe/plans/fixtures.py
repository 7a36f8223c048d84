"""Variant tables derived from part and lineitem, by the same SQL in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.header import VcfHeader
from locusframe.operators.frame import VcfFrame

SAMPLES = 8
_FRAC = "cast(1 + k % 4 as int)"
SITES = f"""
select k, 'chr' || cast(1 + k % 3 as varchar(9)) as chrom, 100 + 10 * cast(floor(k / 3) as bigint) as pos,
  case when k % 5 = 0 then '.' else 'rs' || cast(k as varchar(9)) end as id,
  substr('ACGT', {_FRAC}, 1) || case when k % 20 in (15, 16) then 'T' when k % 20 = 17 then 'AC' else '' end as ref,
  case when k % 20 < 12 then substr('CGTA', {_FRAC}, 1) when k % 20 = 12 then substr('CGTA', {_FRAC}, 1) || ',' || substr('GTAC', {_FRAC}, 1)
    when k % 20 in (13, 14) then substr('ACGT', {_FRAC}, 1) || 'GG' when k % 20 in (15, 16) then substr('ACGT', {_FRAC}, 1)
    when k % 20 = 17 then 'GT' when k % 20 = 18 then '<DEL>' else '.' end as alt,
  case when k % 20 = 12 then 2 when k % 20 = 19 then 0 else 1 end as n_alt,
  case when k % 9 = 0 then '.' else cast(p_size * 20 as varchar(9)) end as qual,
  case when k % 10 = 3 then 'LowQual' when k % 10 = 7 then 'q10;LowQual' when k % 10 = 9 then '.' else 'PASS' end as filter
from (select cast(p_partkey as bigint) as k, p_size from part)
"""
# one row per site and sample; a sample without line items is missing
GTS = f"""
select s.k, s.n_alt, n.s, coalesce(g.b0, 0) as b0, g.a0 is null or g.b0 % 11 = 0 as missing, coalesce(g.a0, 0) % 2 = 0 as phased,
  coalesce(g.a0, 0) % (s.n_alt + 1) as a, coalesce(g.b0, 0) % (s.n_alt + 1) as b
from (select *, 0 as one from sites) s
join (select 0 as one, cast(id as bigint) as s from numbers) n on s.one = n.one
left join (select cast(l_partkey as bigint) as k, cast(l_suppkey as bigint) % {SAMPLES} as s, min(cast(l_linenumber as bigint)) as a0, min(cast(l_quantity as bigint)) as b0
  from lineitem group by 1, 2) g on g.k = s.k and g.s = n.s
"""
# genotype text and the sample column GT:AD:DP
TEXT = """
select k, s, n_alt, a, b, missing, phased, b0,
  case when missing then './.' else cast(a as varchar(9)) || case when phased then '|' else '/' end || cast(b as varchar(9)) end as gt,
  case when missing then './.:.:.' else cast(a as varchar(9)) || case when phased then '|' else '/' end || cast(b as varchar(9)) || ':' ||
    cast(cast(floor((b0 + 10) / 2) as bigint) as varchar(9)) || case when n_alt >= 1 then ',' || cast(b0 as varchar(9)) else '' end || case when n_alt = 2 then ',1' else '' end ||
    ':' || cast(b0 + 10 as varchar(9)) end as col
from gts
"""


def duck(*more: tuple[str, str]) -> str:
    """The WITH clause of these tables and more (name, SQL) for DuckDB."""
    ctes = [("numbers", "select unnest(range(0, 8)) as id"), ("sites", SITES), ("gts", GTS), ("txt", TEXT), *more]
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in ctes)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem")}
    out["numbers"] = spark.range(SAMPLES)
    for name, sql in (("sites", SITES), ("gts", GTS), ("txt", TEXT)):
        text = sql
        for t in out:
            for word in ("from", "join"):
                for end in (" ", ")", "\n"):
                    text = text.replace(f"{word} {t}{end}", f"{word} {{{t}}}{end}")
        out[name] = spark.sql(text, **{t: d for t, d in out.items() if f"{{{t}}}" in text})
    return out


def header(samples: int = SAMPLES, contigs: int = 3) -> VcfHeader:
    meta = ["##fileformat=VCFv4.2", *(f"##contig=<ID=chr{i + 1}>" for i in range(contigs))]
    meta += [f'##INFO=<ID={k},Number={n},Type=Integer,Description="">' for k, n in (("AC", "A"), ("AN", "1"), ("DP", "1"), ("XA", "A"))]
    meta += [f'##FORMAT=<ID={k},Number={n},Type=String,Description="">' for k, n in (("GT", "1"), ("AD", "R"), ("DP", "1"))]
    return VcfHeader(meta, [f"S{i}" for i in range(samples)], True)


def sites_frame(t: dict[str, DataFrame]) -> VcfFrame:
    """Sites without genotypes; INFO holds DP, the sum of the digits that k and qual give."""
    df = t["sites"].select(F.lit(0).alias("file_idx"), F.lit(0).cast("long").alias("block"), F.col("k").alias("mid"), "chrom", F.col("pos").cast("string").alias("pos_raw"), "id", "ref", "alt", "qual", "filter", F.concat(F.lit("DP="), (F.col("k") % 50).cast("string")).alias("info"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("samples_raw"), F.lit(8).alias("n_cols"))
    h = header(0)
    h.has_format = False
    return VcfFrame(h, df)


def cohort_frame(t: dict[str, DataFrame]) -> VcfFrame:
    """Sites with all samples, FORMAT GT:AD:DP."""
    cols = t["txt"].groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s", "col"))).alias("c")).select("k", F.array_join(F.transform("c", lambda x: x["col"]), "\t").alias("samples_raw"))
    f = sites_frame(t)
    df = f.df.drop("samples_raw", "format").join(cols, f.df["mid"] == cols["k"]).drop("k").withColumns({"format": F.lit("GT:AD:DP"), "n_cols": F.lit(9 + SAMPLES)})
    return VcfFrame(header(), df)


def merge_frames(t: dict[str, DataFrame], cohorts: int = 3, same_format: bool = False, disagree: bool = True, rounds: bool = True) -> list[VcfFrame]:
    """Cohort c has the samples s % 3 = c and the sites (k + c) % 6 <> 0. Cohort 0 has FORMAT GT:AD, others GT:AD:DP (unless same_format);
    cohort 1 has another ALT at some sites; cohort 0 repeats some sites with a longer ALT."""
    out = []
    for c in range(cohorts):
        fmt = "GT:AD" if c == 0 or same_format else "GT:AD:DP"
        txt = t["txt"].filter(F.col("s") % 3 == c)
        col = F.col("col") if fmt == "GT:AD:DP" else F.regexp_replace("col", ":[^:]*$", "")
        cols = txt.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s", col.alias("col")))).alias("c")).select("k", F.array_join(F.transform("c", lambda x: x["col"]), "\t").alias("samples_raw"))
        s = t["sites"].filter((F.col("k") + c) % 6 != 0)
        alt = F.col("alt")
        if c == 1 and disagree:
            alt = F.when((F.col("k") % 7 == 0) & (F.col("k") % 20 < 12), F.expr("substr('GTAC', cast(1 + k % 4 as int), 1)")).otherwise(alt)
        s = s.withColumns({"alt": alt, "turn": F.lit(0)})
        if c == 1:
            s = s.withColumns({"id": F.expr("case when id <> '.' and k % 2 = 0 then 'x' || k || ';' || id else id end"), "qual": F.expr("case when qual <> '.' and k % 2 = 0 then qual || '.5' else qual end"), "filter": F.expr("case when k % 4 = 0 then 'q20' else filter end")})
        if c == 0 and rounds:
            again = s.filter("k % 13 = 0").withColumns({"alt": F.concat(F.expr("substr('ACGT', cast(1 + k % 4 as int), 1)"), F.lit("TT")), "turn": F.lit(1)})
            s = s.unionByName(again)
        info = F.concat(F.lit("DP="), (F.col("k") % 50 + c).cast("string"), F.when(F.col("n_alt") == 1, F.concat(F.lit(";XA="), F.when((F.col("k") + c) % 4 == 0, ".").otherwise((F.col("k") % 9 + c).cast("string")))).otherwise(""))
        df = s.join(cols, "k").select(F.lit(c).alias("file_idx"), F.lit(0).cast("long").alias("block"), (F.col("k") * 2 + F.col("turn")).cast("long").alias("mid"), "chrom", F.col("pos").cast("string").alias("pos_raw"), "id", "ref", "alt", "qual", "filter", info.alias("info"), F.lit(fmt).alias("format"), "samples_raw", F.lit(9 + (SAMPLES - c + 2) // 3).alias("n_cols"))
        h = header(0)
        h.samples, h.has_format = [f"S{x}" for x in range(SAMPLES) if x % 3 == c], True
        # a file is sorted by contig and position, the repeat after its site
        df = df.withColumn("mid", F.concat(F.substring("chrom", 4, 1), F.lpad("mid", 12, "0")).cast("long"))
        out.append(VcfFrame(h, df))
    return out
