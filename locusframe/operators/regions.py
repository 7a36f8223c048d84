"""Regions: parsing, coalescing, and overlap as a predicate or a semi-join."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.header import VcfError

END = (1 << 63) - 1
_AS_LITERALS = 32  # intervals up to which a predicate is written out
_BROADCAST = 1_000_000  # intervals up to which the list is sent to every executor
_COORD = re.compile(r"[0-9]+")


def _coordinate(text: str, what: str) -> int:
    digits = text.replace(",", "")
    if not _COORD.fullmatch(digits):
        raise VcfError(f"bad coordinate in '{what}'")
    return min(int(digits), END)


@dataclass
class Regions:
    """Sorted, disjoint, 1-based inclusive intervals by contig."""

    by: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[str, int, int]]) -> Regions:
        out = cls()
        for chrom, start, end in items:
            out.by.setdefault(chrom, []).append((start, end))
        for chrom, ivs in out.by.items():
            merged: list[tuple[int, int]] = []
            for start, end in sorted(ivs):
                if merged and start <= merged[-1][1] + 1:
                    merged[-1] = merged[-1][0], max(merged[-1][1], end)
                else:
                    merged.append((start, end))
            out.by[chrom] = merged
        return out

    @classmethod
    def parse(cls, spec: str) -> Regions:
        """`c`, `c:p`, `c:a-b`, `c:a-`, `c:-b`, comma-separated. The last colon splits, so a contig's name can hold colons only if a
        position follows; a comma always separates items."""
        items = []
        for item in filter(None, spec.split(",")):
            chrom, colon, rest = item.rpartition(":")
            if not colon:
                items.append((item, 1, END))
                continue
            a, dash, b = rest.partition("-")
            if not dash:
                items.append((chrom, *[_coordinate(a, item)] * 2))
            else:
                items.append((chrom, _coordinate(a, item) if a or not b else 1, _coordinate(b, item) if b else END))
        return cls.of(items)

    @classmethod
    def read(cls, lines: list[str]) -> Regions:
        """Lines of contig, contig and position, or contig, first and last position, tab-separated; blank and # lines don't count."""
        items = []
        for line in (x.rstrip() for x in lines):
            if not line or line.startswith("#"):
                continue
            f = line.split("\t")
            items.append((f[0], 1, END) if len(f) == 1 else (f[0], _coordinate(f[1], line), _coordinate(f[min(len(f) - 1, 2)], line)))
        return cls.of(items)

    def __len__(self) -> int:
        return sum(map(len, self.by.values()))

    def last(self, contigs: list[str]) -> tuple[int, int] | None:
        """The furthest (contig rank, position) that any region reaches, if all their contigs are declared."""
        rank = {c: i for i, c in enumerate(contigs)}
        if not self.by or any(c not in rank for c in self.by):
            return None
        return max((rank[c], ivs[-1][1]) for c, ivs in self.by.items())


def record_end(pos: Column, ref: Column) -> Column:
    return pos + F.greatest(F.octet_length(ref), F.lit(1)) - 1


def overlapping(df: DataFrame, regions: Regions, chrom: str = "chrom", pos: str = "pos", end: str = "end") -> DataFrame:
    """Rows whose [pos, end] overlaps a region of their contig."""
    c, p, e = F.col(chrom), F.col(pos), F.col(end)
    if not len(regions):
        return df.filter(F.lit(False))
    if len(regions) <= _AS_LITERALS:
        hit = None
        for name, ivs in regions.by.items():
            for a, b in ivs:
                one = (c == name) & (e >= a) & (p <= b) if (a, b) != (1, END) else (c == name)
                hit = one if hit is None else hit | one
        return df.filter(hit)
    rows = [(name, a, b) for name, ivs in regions.by.items() for a, b in ivs]
    table = df.sparkSession.createDataFrame(rows, "r_chrom string, r_start long, r_end long")
    return semi_join(df, F.broadcast(table) if len(rows) <= _BROADCAST else table, chrom, pos, end)


def semi_join(df: DataFrame, table: DataFrame, chrom: str = "chrom", pos: str = "pos", end: str = "end") -> DataFrame:
    """Rows of df that overlap a row (r_chrom, r_start, r_end) of the table."""
    on = (F.col(chrom) == F.col("r_chrom")) & (F.col(pos) <= F.col("r_end")) & (F.col(end) >= F.col("r_start"))
    return df.join(table, on, "left_semi")


def coalesced(table: DataFrame) -> DataFrame:
    """Merged intervals of a large table (r_chrom, r_start, r_end): gaps and islands, contig by contig."""
    order = Window.partitionBy("r_chrom").orderBy("r_start", "r_end")
    before = F.max("r_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = table.withColumn("__new", F.when(before.isNull() | (F.col("r_start") > before + 1), 1).otherwise(0))
    t = t.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("r_chrom", "__island").agg(F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end")).drop("__island")
