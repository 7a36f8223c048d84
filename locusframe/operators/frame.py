"""The variant table: a header and a DataFrame of raw columns.

Columns: file_idx int, block long, mid long (together the order of lines), chrom, pos_raw, id, ref, alt, qual, filter, info, format,
samples_raw (all strings; format and samples_raw null where a record has none) and n_cols. A frame that was read keeps the raw line in
`value`, which costs nothing unless it is used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.header import VcfHeader

ORDER = ("file_idx", "block", "mid")
TEXT = ("chrom", "pos_raw", "id", "ref", "alt", "qual", "filter", "info", "format", "samples_raw")


@dataclass
class VcfFrame:
    header: VcfHeader
    df: DataFrame
    raw: bool = False  # lines pass as they are, malformed ones too
    order: tuple[str, ...] = ORDER

    def pos(self) -> Column:
        return F.coalesce(_uint(F.col("pos_raw")), F.lit(0))

    def lines(self) -> DataFrame:
        """The order columns and `value`, the text of each record."""
        value = F.col("value") if self.raw else line()
        return self.df.select(*self.order, value.alias("value"))


def line() -> Column:
    """A record's text from its columns."""
    return F.concat_ws("\t", *[F.col(c) for c in TEXT])


def _uint(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))


def split_lines(lines: DataFrame) -> DataFrame:
    """Raw columns of `value`. The samples stay one string."""
    parts = lines.withColumn("__p", F.split("value", "\t", 10))
    at = lambda i: F.get(F.col("__p"), F.lit(i))
    cols = {c: at(i) for i, c in enumerate(TEXT)}
    return parts.withColumns(cols | {"n_cols": F.when(F.col("value") == "", 0).otherwise(F.size(F.split("value", "\t")))}).drop("__p")


def well_formed(df: DataFrame) -> DataFrame:
    """Records: not empty, not a comment, eight columns at least."""
    return df.filter(~F.col("value").startswith("#") & F.col("info").isNotNull())
