"""view: filters and projections of one variant table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions import exprs as X
from locusframe.header import VcfError
from locusframe.operators.frame import VcfFrame, well_formed
from locusframe.operators.regions import Regions, overlapping, record_end


@dataclass
class ViewOptions:
    samples: str | None = None  # names, or ^names
    samples_file: str | None = None
    regions: str | None = None
    regions_file: str | None = None
    types: str | None = None
    exclude_types: str | None = None
    filters: str | None = None
    ids: str | None = None
    ids_file: str | None = None
    min_alleles: int | None = None
    max_alleles: int | None = None
    min_qual: float | None = None
    max_qual: float | None = None
    min_ac: int | None = None
    drop_genotypes: bool = False
    no_update: bool = False
    strict_stop: bool = False  # drop whatever follows the first record past all regions, as a sorted scan would

    def idle(self) -> bool:
        return self == ViewOptions(no_update=self.no_update, strict_stop=self.strict_stop)


def _words(path: str) -> list[str]:
    """The first word of each line that isn't blank or a comment."""
    with open(path, encoding="utf-8") as f:
        return [x.split()[0] for x in f if x.strip() and not x.startswith("#")]


def _selected(frame: VcfFrame, o: ViewOptions) -> list[int] | None:
    if o.samples is not None and o.samples_file is not None:
        raise VcfError("samples and samples_file exclude each other")
    if o.samples_file is not None:
        inverse, path = o.samples_file.startswith("^"), o.samples_file.removeprefix("^")
        return frame.header.select("^" * inverse + ",".join(_words(path)))
    return None if o.samples is None else frame.header.select(o.samples)


def _regions(o: ViewOptions) -> Regions | None:
    if o.regions is not None and o.regions_file is not None:
        raise VcfError("regions and regions_file exclude each other")
    if o.regions_file is not None:
        with open(o.regions_file, encoding="utf-8") as f:
            return Regions.read(f.readlines())
    return None if o.regions is None else Regions.parse(o.regions)


def _ids(o: ViewOptions) -> list[str] | None:
    if o.ids is not None and o.ids_file is not None:
        raise VcfError("ids and ids_file exclude each other")
    return _words(o.ids_file) if o.ids_file is not None else None if o.ids is None else [x for x in o.ids.split(",") if x]


def qual_within(qual: Column, least: float | None, most: float | None) -> Column:
    """A missing QUAL fails a lower bound and passes an upper one alone; NaN passes both."""
    q, ok = X.double(qual), F.lit(True)
    if least is not None:
        ok = ok & q.isNotNull() & (F.isnan(q) | (q >= least))
    if most is not None:
        ok = ok & (q.isNull() | F.isnan(q) | (q <= most))
    return ok


def view(frame: VcfFrame, options: ViewOptions | None = None) -> VcfFrame:
    """Filters run from cheap to costly; those on genotypes come last. Without any option all lines pass as they are."""
    o = options or ViewOptions()
    header, df = frame.header, frame.df
    picked, regions, ids = _selected(frame, o), _regions(o), _ids(o)
    if o.idle():
        return frame
    if frame.raw:
        df = well_formed(df)
    col = F.col
    if regions is not None:
        p = frame.pos()
        df = df.withColumns({"pos": p, "end": record_end(p, col("ref"))})
        last = regions.last(header.contigs) if o.strict_stop else None
        if last is not None:
            df = _before_past(df, frame, last, header.contigs)
        df = overlapping(df, regions).drop("pos", "end")
    if ids is not None:
        df = _with_ids(df, ids)
    if o.types is not None:
        df = df.filter(X.site_types(col("ref"), col("alt")).bitwiseAND(F.lit(X.parse_types(o.types))) != 0)
    if o.exclude_types is not None:
        df = df.filter(X.site_types(col("ref"), col("alt")).bitwiseAND(F.lit(X.parse_types(o.exclude_types))) == 0)
    if o.min_alleles is not None:
        df = df.filter(X.count_alts(col("alt")) + 1 >= o.min_alleles)
    if o.max_alleles is not None:
        df = df.filter(X.count_alts(col("alt")) + 1 <= o.max_alleles)
    if o.min_qual is not None or o.max_qual is not None:
        df = df.filter(qual_within(col("qual"), o.min_qual, o.max_qual))
    if o.filters is not None:
        df = df.filter(F.arrays_overlap(F.split("filter", ";"), F.array(*[F.lit(x) for x in o.filters.split(",")])))

    keep = list(range(len(header.samples))) if picked is None else picked
    update = not o.no_update and not o.drop_genotypes and picked is not None and len(keep) != len(header.samples)
    split = F.split("samples_raw", "\t")
    if update or o.min_ac is not None:
        chosen = split if picked is None else F.filter(F.transform(_indices(keep), lambda i: F.get(split, i)), lambda s: s.isNotNull())
        has_gt = X.gt_index(col("format")).isNotNull()
        alleles = F.when(col("samples_raw").isNull(), F.array().cast("array<int>")).otherwise(X.called(chosen, X.gt_index(col("format"))))
        df = df.withColumn("__alleles", F.when(has_gt, alleles))
        df = df.withColumn("__ac", F.when(has_gt, X.allele_counts(col("__alleles"), X.count_alts(col("alt")))))
        if o.min_ac is not None:
            df = df.filter(~has_gt | (F.coalesce(F.array_max("__ac"), F.lit(0)) >= o.min_ac))
        if update:
            new = X.rewrite_info(col("info"), {"AC": F.array_join("__ac", ","), "AN": F.size("__alleles").cast("string")})
            df = df.withColumn("info", F.when(has_gt, new).otherwise(col("info")))
        df = df.drop("__alleles", "__ac")
    header = header.copy()
    if update:
        header.ensure("INFO", "AC")
        header.ensure("INFO", "AN")
    if picked is not None:
        header.samples = [header.samples[i] for i in keep]
        cols = F.array_join(F.transform(_indices(keep), lambda i: F.coalesce(F.get(split, i), F.lit("."))), "\t") if keep else F.lit(None).cast("string")
        df = df.withColumn("samples_raw", F.when(col("format").isNotNull(), cols if not keep else F.when(col("samples_raw").isNull(), F.lit("\t".join(["."] * len(keep)))).otherwise(cols)))
    if o.drop_genotypes:
        header.samples, header.has_format = [], False
        df = df.withColumns({"format": F.lit(None).cast("string"), "samples_raw": F.lit(None).cast("string")})
    return VcfFrame(header, df, False, frame.order)


def _indices(keep: list[int]) -> Column:
    return F.array(*[F.lit(i) for i in keep]) if keep else F.array().cast("array<int>")


def _with_ids(df, ids: list[str]):  # noqa: ANN001, ANN202
    """Rows with one of the ids among the parts of their ID."""
    if len(ids) <= 1000:
        return df.filter(F.arrays_overlap(F.split("id", ";"), F.array(*[F.lit(x) for x in ids]).cast("array<string>")))
    table = df.sparkSession.createDataFrame([(x,) for x in set(ids)], "__id string")
    one = df.filter(~F.col("id").contains(";")).join(F.broadcast(table) if len(ids) <= 1_000_000 else table, F.col("id") == F.col("__id"), "left_semi")
    several = df.filter(F.col("id").contains(";")).withColumn("__row", F.struct(*df.columns)).withColumn("__part", F.explode(F.array_distinct(F.split("id", ";"))))
    found = several.join(table, F.col("__part") == F.col("__id"), "left_semi").groupBy("file_idx", "block", "mid").agg(F.first("__row").alias("__row"))
    return one.unionByName(found.select("__row.*"))


def _before_past(df, frame: VcfFrame, last: tuple[int, int], contigs: list[str]):  # noqa: ANN001, ANN202
    """Rows ahead of the first that lies past all regions, file by file."""
    rank = F.array_position(F.array(*[F.lit(c) for c in contigs]), F.col("chrom")) - 1
    past = (rank > last[0]) | ((rank == last[0]) & (F.col("pos") > last[1]))
    first = df.filter(past).groupBy("file_idx").agg(F.min(F.struct("block", "mid")).alias("__stop"))
    t = df.join(F.broadcast(first), "file_idx", "left")  # a row a file
    return t.filter(F.col("__stop").isNull() | (F.struct("block", "mid") < F.col("__stop"))).drop("__stop")
