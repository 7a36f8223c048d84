"""Command line: python -m locusframe.cli view|concat|merge ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from locusframe.header import VcfError
from locusframe.operators.concat import concat
from locusframe.operators.merge import DEFAULT_RULES, MODES, MergeOptions, merge
from locusframe.operators.view import ViewOptions, view
from locusframe.sources.reader import file_list, read_vcf
from locusframe.sources.writer import check_codec, concat_bytes, output_kind, write_vcf


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusframe", add_help=True)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, many: bool) -> argparse.ArgumentParser:
        c = sub.add_parser(name, add_help=False)
        c.add_argument("--help", action="help")
        c.add_argument("inputs", nargs="*" if many else "?", default=None if many else "-")
        c.add_argument("-o", "--output")
        c.add_argument("-O", "--output-type")
        c.add_argument("-l", "--compression-level", type=int, default=6)
        c.add_argument("--codec", default="lib")
        c.add_argument("--threads", type=int, default=0)
        if many:
            c.add_argument("-F", "--file-list")
        return c

    v = command("view", False)
    v.add_argument("-h", "--header-only", action="store_true")
    v.add_argument("-H", "--no-header", action="store_true")
    for short, name in (("-s", "samples"), ("-S", "samples-file"), ("-v", "types"), ("-V", "exclude-types"), ("-f", "apply-filters")):
        v.add_argument(short, f"--{name}")
    for names in (("-r", "-t", "--regions", "--targets"), ("-R", "-T", "--regions-file", "--targets-file")):
        v.add_argument(*names)
    v.add_argument("--ids")
    v.add_argument("--ids-file")
    v.add_argument("-m", "--min-alleles", type=int)
    v.add_argument("-M", "--max-alleles", type=int)
    v.add_argument("--min-qual", type=float)
    v.add_argument("--max-qual", type=float)
    v.add_argument("--min-ac", type=int)
    v.add_argument("-G", "--drop-genotypes", action="store_true")
    v.add_argument("-I", "--no-update", action="store_true")
    c = command("concat", True)
    c.add_argument("-n", "--naive", action="store_true")
    m = command("merge", True)
    m.add_argument("-m", "--merge", choices=MODES, default="both")
    m.add_argument("-0", "--missing-to-ref", action="store_true")
    m.add_argument("-I", "--no-update", action="store_true")
    m.add_argument("--force-samples", action="store_true")
    m.add_argument("--info-rules", default=DEFAULT_RULES)
    return p


def run(argv: list[str], spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    check_codec(a.codec, a.compression_level)
    kind = output_kind(a.output_type, a.output)
    spark = spark or SparkSession.builder.master(f"local[{a.threads or '*'}]").appName("locusframe").config("spark.ui.enabled", "false").getOrCreate()
    level = max(1, a.compression_level)
    if a.command == "view":
        frame = view(read_vcf(spark, a.inputs), ViewOptions(a.samples, a.samples_file, a.regions, a.regions_file, a.types, a.exclude_types, a.apply_filters, a.ids, a.ids_file, a.min_alleles, a.max_alleles, a.min_qual, a.max_qual, a.min_ac, a.drop_genotypes, a.no_update))
        write_vcf(frame, a.output, kind, level, header=not a.no_header, header_only=a.header_only)
        return
    paths = file_list(a.inputs or [], a.file_list)
    if a.command == "concat" and a.naive:
        concat_bytes(spark, paths, a.output or "/dev/stdout")
        return
    frames = [read_vcf(spark, p, i) for i, p in enumerate(paths)]
    frame = concat(frames) if a.command == "concat" else merge(frames, MergeOptions(a.merge, a.missing_to_ref, a.no_update, a.force_samples, a.info_rules))
    write_vcf(frame, a.output, kind, level)


def main() -> int:
    try:
        run(sys.argv[1:])
    except (VcfError, OSError) as e:
        print(f"locusframe: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
