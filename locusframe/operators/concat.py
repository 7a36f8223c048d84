"""concat: ordered union of tables that hold the same samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from locusframe.header import VcfError, union
from locusframe.operators.frame import VcfFrame


def concat(frames: list[VcfFrame]) -> VcfFrame:
    """All records, frame after frame, in their own order; blank lines go, comment lines in bodies stay. Sample lists have to be equal."""
    if not frames:
        raise VcfError("there is nothing to concatenate")
    samples = frames[0].header.samples
    for i, f in enumerate(frames[1:], 2):
        if f.header.samples != samples:
            raise VcfError(f"input {i} has other samples than the first; merge joins different samples")
    header = union([f.header for f in frames])
    header.samples = list(samples)
    raw = all(f.raw for f in frames)
    cols = [c for c in frames[0].df.columns if all(c in f.df.columns for f in frames)]
    parts = [f.df.select(*cols).withColumn("file_idx", F.lit(i)) for i, f in enumerate(frames)]
    df = reduce(lambda a, b: a.unionByName(b), parts)
    return VcfFrame(header, df.filter(F.col("value") != "") if raw else df, raw, frames[0].order)
