"""Streams: a directory that VCF text files of one header arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.header import VcfHeader
from locusframe.operators.frame import VcfFrame, split_lines
from locusframe.operators.view import ViewOptions, view


def view_stream(spark: SparkSession, path: str, header: VcfHeader, options: ViewOptions | None = None) -> DataFrame:
    """The records of files as they arrive, viewed; stateless, so any output mode but complete will do."""
    t = spark.readStream.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    t = t.filter(~F.col("value").startswith("#")).withColumns({"file_idx": F.lit(0), "block": F.lit(0).cast("long"), "mid": F.lit(0).cast("long")})
    return view(VcfFrame(header, split_lines(t), True), options or ViewOptions(min_alleles=1)).df
