"""merge: tables of different samples at the same sites become one table of all samples.

The join is one grouping: records are tagged with their input, ranked by contig, numbered among the records of their input at their
position (the r-th record of one input meets the r-th of the others), and gathered by (rank, position, round). Numbering and gathering
use one shuffle by (rank, position). A site has at most one record an input, so the arrays are as long as there are inputs.

Where all records of a site have the same REF, ALT and FORMAT, and each its full set of samples, the merged record is built from
expressions alone and the samples stay the strings that they were; INFO goes through a narrow Arrow function (it never sees
samples). All other sites go through `Site`, a function of one site.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import exprs as X
from locusframe.header import VcfError, joined_samples, union
from locusframe.operators.frame import VcfFrame, well_formed

METHODS = ("sum", "avg", "min", "max", "join", "first")
MODES = ("snps", "indels", "both", "all", "none")
DEFAULT_RULES = "DP:sum,DP4:sum"
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity|nan)", re.I)
_INT = re.compile(r"[+-]?\d+")


def parse_rules(spec: str) -> dict[str, str]:
    """Method by INFO key of `K:method,...`; `-` is none."""
    out = {}
    for item in [] if spec == "-" else filter(None, spec.split(",")):
        key, colon, method = item.rpartition(":")
        if not colon or not key or method not in METHODS:
            raise VcfError(f"bad INFO rule '{item}'")
        out[key] = method
    return out


@dataclass
class MergeOptions:
    mode: str = "both"
    missing_to_ref: bool = False
    no_update: bool = False
    force_samples: bool = False
    info_rules: str = DEFAULT_RULES
    check_sorted: bool = True

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise VcfError(f"unknown merge mode '{self.mode}'")


def rendered(v: float) -> str:
    """Whole numbers as such, others with up to six decimals of their exact value."""
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "inf" if v > 0 else "-inf"
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.6f}".rstrip("0").rstrip(".")


def _fold(values: list[str], method: str) -> str:
    """One place of several records' values."""
    there = [v for v in values if v not in (".", "")]
    if not there:
        return "."
    if all(_INT.fullmatch(v) for v in there):
        n = [int(v) for v in there]
        if method == "avg":
            return rendered(sum(n) / len(n))
        return str({"sum": sum(n), "min": min(n), "max": max(n)}.get(method, n[0]))
    x = [float(v) for v in there if _FLOAT.fullmatch(v)]
    if not x:
        return there[0]
    some = [v for v in x if v == v]
    least, most = (min(some), max(some)) if some else (float("inf"), float("-inf"))
    return rendered({"sum": sum(x), "avg": sum(x) / len(x), "min": least, "max": most}.get(method, x[0]))


def _columns(values: list[str]) -> list[list[str]]:
    """By place, the values of those records that have it."""
    split = [v.split(",") for v in values]
    return [[s[i] for s in split if i < len(s)] for i in range(max(map(len, split)))]


def fold(values: list[str], method: str) -> str:
    return ",".join(values) if method == "join" else ",".join(_fold(c, method) for c in _columns(values))


def fill_slots(values: list[str]) -> str:
    """Each place from the first record that has it."""
    return ",".join(next((v for v in c if v not in (".", "")), ".") for c in _columns(values))


def reindexed(value: str, to: list[int], n: int, offset: int) -> str:
    """A list by allele (offset 0) or by ALT (offset 1), moved to new allele numbers."""
    slots = ["."] * n
    for i, v in enumerate(value.split(","), offset):
        if i < len(to) and 0 <= to[i] - offset < n:
            slots[to[i] - offset] = v
    return ",".join(slots)


def renumbered(gt: str, to: list[int]) -> str:
    """A genotype with new allele numbers, its separators kept; what isn't a known allele is a dot."""

    def one(a: str) -> str:
        tail = re.search(r"\d*$", a)[0]  # whatever isn't a digit starts anew
        return str(to[int(tail)]) if tail and int(tail) < len(to) else "."

    return "".join(x if x in "/|" and x else one(x) for x in re.split(r"([/|])", gt))


def merged_info(infos: list[str], numbers: dict[str, str], rules: dict[str, str], skip: frozenset[str], maps: list[list[int] | None], n_alt: int) -> str:
    """INFO of several records. maps[i] is None where record i keeps its allele numbers."""
    first: dict[str, str | None] = {}
    more: dict[str, list[str]] = {}
    for info, to in zip(infos, maps, strict=True):
        for item in [] if info in (".", "") else filter(None, info.split(";")):
            key, eq, value = item.partition("=")
            kind = numbers.get(key)
            if key in skip or (to is not None and kind == "G"):
                continue
            if eq and to is not None and kind in ("A", "R"):
                value = reindexed(value, to, n_alt + (kind == "R"), int(kind == "A"))
            if key not in first:
                first[key], more[key] = (value if eq else None), []
            elif eq and (key in rules or kind in ("A", "R")):
                more[key].append(value)
    out = []
    for key, value in first.items():
        if value is not None and more[key]:
            value = fold([value, *more[key]], rules[key]) if key in rules else fill_slots([value, *more[key]])
        out.append(key if value is None else f"{key}={value}")
    return ";".join(out) or "."


def _class(ref: str, alt: str) -> str:
    """snp, indel or other."""
    kinds = set()
    for a in [] if alt in (".", "") else alt.split(","):
        if re.fullmatch(r"[ACGTNacgtn]+", a) and re.fullmatch(r"[ACGTNacgtn]*", ref):
            if len(a) != len(ref):
                kinds.add("indel")
            elif a != ref and sum(x != y for x, y in zip(a, ref, strict=True)) == 1:
                kinds.add("snp")
    return "indel" if "indel" in kinds else "snp" if "snp" in kinds else "other"


def _alts(alt: str) -> list[str]:
    return [] if alt in (".", "") else alt.split(",")


def groups(records: list[dict], mode: str) -> list[tuple[int, list[int]]]:
    """Which records of a site make one output record, and its rank among them; in output order."""
    forced = {"all": {("snp", "snp"), ("snp", "indel"), ("snp", "other"), ("indel", "snp"), ("indel", "indel"), ("indel", "other"), ("other", "snp"), ("other", "indel"), ("other", "other")}, "none": set(), "snps": {("snp", "snp")}, "indels": {("indel", "indel")}, "both": {("snp", "snp"), ("indel", "indel")}}[mode]
    order = ("indel", "snp", "other") if mode == "indels" else ("snp", "indel", "other")
    left, out = list(range(len(records))), []
    while left:
        head = records[left[0]]
        alts, kind, own, rest = _alts(head["alt"]), _class(head["ref"], head["alt"]), [left[0]], []
        for i in left[1:]:
            r = records[i]
            theirs, their_kind = _alts(r["alt"]), _class(r["ref"], r["alt"])
            novel = sum(a not in alts for a in theirs)
            if r["ref"] != head["ref"] or not (novel == 0 or len(theirs) >= len(alts) + novel or (kind, their_kind) in forced):
                rest.append(i)
                continue
            alts += [a for a in dict.fromkeys(theirs) if a not in alts]
            kind = their_kind if kind == "other" else kind
            own.append(i)
        out.append((order.index(kind), own))
        left = rest
    return sorted(out, key=lambda x: x[0])


@dataclass
class Site:
    """Builds merged records of one site."""

    counts: list[int]  # samples of each input
    info: dict[str, str]
    format: dict[str, str]
    rules: dict[str, str]
    mode: str
    to_ref: bool
    update: bool
    skip: frozenset[str] = field(default=frozenset())

    def build(self, records: list[dict]) -> Iterator[dict]:
        """records: by input, each with file_idx and its raw columns."""
        for rank, own in groups(records, self.mode):
            yield self.merged([records[i] for i in own]) | {"class_rank": rank, "first_file": records[own[0]]["file_idx"]}

    def merged(self, ms: list[dict]) -> dict:
        formats = [m["format"] for m in ms]
        uniform = all(m["alt"] == ms[0]["alt"] and (m["format"] or "") == (ms[0]["format"] or "") for m in ms)
        alts: list[str] = _alts(ms[0]["alt"]) if uniform else []
        maps: list[list[int]] = []
        for m in ms:
            to = [0]
            for a in _alts(m["alt"]):
                if a not in alts:
                    alts.append(a)
                to.append(alts.index(a) + 1)
            maps.append(to)
        same = [uniform or to == list(range(len(alts) + 1)) for to in maps]
        if uniform:
            keys = (formats[0] or "").split(":") if formats[0] else []
        else:
            all_keys = [k for f in formats if f is not None for k in f.split(":")]
            rest = list(dict.fromkeys(k for k in all_keys if k != "GT"))
            keys = (["GT"] if "GT" in all_keys or not rest else []) + rest
        places = [{k: (f or "").split(":").index(k) for k in keys if f is not None and k in f.split(":")} for f in formats]
        samples = [(m["samples_raw"].split("\t") if m["samples_raw"] is not None else [])[: self.counts[m["file_idx"]]] for m in ms]
        ploidy = self._ploidy(samples, places)
        ac, an = [0] * len(alts), 0
        if self.update:
            for s, at, to, keep in zip(samples, places, maps, same, strict=True):
                for field_ in s if "GT" in at else []:
                    for a in re.findall(r"\d+", _part(field_, at["GT"])):
                        new = int(a) if keep else to[int(a)] if int(a) < len(to) else 0
                        an += 1
                        if 0 < new <= len(alts):
                            ac[new - 1] += 1
            if self.to_ref:
                an += max(0, sum(self.counts) - sum(self.counts[m["file_idx"]] for m in ms)) * ploidy
        info = merged_info([m["info"] for m in ms], self.info, self.rules, self.skip, [None if k else to for k, to in zip(same, maps, strict=True)], len(alts))
        if self.update:
            info = ("" if info == "." else info + ";") + f"AN={an};AC={','.join(map(str, ac))}"
        by = {m["file_idx"]: i for i, m in enumerate(ms)}
        gap = ":".join("/".join(["0" if self.to_ref else "."] * ploidy) if k == "GT" else "." for k in keys)
        out: list[str] = []
        for f, n in enumerate(self.counts):
            if f not in by:
                out += [gap] * n
                continue
            i = by[f]
            verbatim = same[i] and formats[i] is not None and (uniform or formats[i].split(":") == keys)
            have = samples[i] + ["."] * (n - len(samples[i]))
            if formats[i] is None and uniform:
                out += [gap or "."] * n
            else:
                out += have if verbatim else [self._sample(s, keys, places[i], maps[i], same[i], len(alts), ploidy) for s in have]
        total = sum(self.counts)
        return {
            "chrom": ms[0]["chrom"], "pos_raw": ms[0]["pos_raw"], "id": merged_ids([m["id"] for m in ms]), "ref": ms[0]["ref"], "alt": ms[0]["alt"] if uniform else ",".join(alts) or ".",
            "qual": merged_qual([m["qual"] for m in ms]), "filter": merged_filter([m["filter"] for m in ms]), "info": info,
            "format": ":".join(keys) if total else None, "samples_raw": "\t".join(out) if total else None,
        }

    @staticmethod
    def _ploidy(samples: list[list[str]], places: list[dict[str, int]]) -> int:
        for s, at in zip(samples, places, strict=True):
            for field_ in s if "GT" in at else []:
                gt = _part(field_, at["GT"])
                if gt != ".":
                    return len(re.findall(r"[/|]", gt)) + 1
        return 2

    def _sample(self, s: str, keys: list[str], at: dict[str, int], to: list[int], same: bool, n_alt: int, ploidy: int) -> str:
        out = []
        for k in keys:
            if k not in at:
                out.append("/".join(["."] * ploidy) if k == "GT" else ".")
                continue
            v, kind = _part(s, at[k]), self.format.get(k)
            if same:
                out.append(v)
            elif k == "GT":
                out.append(renumbered(v, to))
            else:
                out.append(reindexed(v, to, n_alt + (kind == "R"), int(kind == "A")) if kind in ("A", "R") else "." if kind == "G" else v)
        return ":".join(out)


def _part(sample: str, i: int) -> str:
    parts = sample.split(":")
    return parts[i] if i < len(parts) else ""


def merged_ids(ids: list[str]) -> str:
    return ";".join(dict.fromkeys(p for x in ids if x != "." for p in x.split(";") if p)) or "."


def merged_qual(quals: list[str]) -> str:
    best, raw = None, "."
    for q in quals:
        if _FLOAT.fullmatch(q) and (best is None or float(q) > best):
            best, raw = float(q), q
    return raw


def merged_filter(filters: list[str]) -> str:
    parts = [p for x in filters for p in x.split(";")]
    return ";".join(dict.fromkeys(p for p in parts if p not in ("PASS", ".", ""))) or ("PASS" if "PASS" in parts else ".")


# --- plans ---------------------------------------------------------------------------------------------------------------------


def contig_ranks(df: DataFrame, contigs: list[str]) -> list[str]:
    """All contigs in output order: declared ones, then others as inputs come to them. Only runs of contigs reach the driver (a row an
    input and contig)."""
    declared = F.array(*[F.lit(c) for c in contigs]).cast("array<string>")
    if not df.filter(~F.array_contains(declared, F.col("chrom"))).limit(1).count():
        return contigs
    round_ = F.row_number().over(Window.partitionBy("file_idx", "chrom", "pos").orderBy("block", "mid"))
    runs = df.select("file_idx", "chrom", "pos", "block", "mid", round_.alias("round")).groupBy("file_idx", "chrom").agg(F.min(F.struct("block", "mid")).alias("first"), F.max(F.struct("pos", "round")).alias("last"))
    by: dict[int, list] = {}
    for r in runs.orderBy("file_idx", "first").collect():
        by.setdefault(r["file_idx"], []).append((r["chrom"], tuple(r["last"])))
    ranks = {c: i for i, c in enumerate(contigs)}
    heap: list = []

    def reach(f: int, i: int) -> None:
        """Input f comes to its i-th contig."""
        if i < len(by[f]):
            chrom, last = by[f][i]
            heapq.heappush(heap, (ranks.setdefault(chrom, len(ranks)), *last, f, i))

    for f in sorted(by):
        reach(f, 0)
    while heap:
        *_, f, i = heapq.heappop(heap)
        reach(f, i + 1)
    return sorted(ranks, key=ranks.__getitem__)


def require_sorted(df: DataFrame) -> None:
    """Raises if (rank, pos) ever falls within an input. Blocks are checked on their own, and then where they meet."""
    key = F.struct("rank", "pos")
    inner = Window.partitionBy("file_idx", "block").orderBy("mid")
    t = df.select("file_idx", "block", "mid", "chrom", "pos", key.alias("key"), (key < F.lag(key).over(inner)).alias("falls"))
    bad = t.filter("falls").select("file_idx", "chrom", "pos").limit(1)
    ends = df.groupBy("file_idx", "block").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    meet = ends.withColumn("falls", F.col("lo") < F.lag("hi").over(Window.partitionBy("file_idx").orderBy("block"))).filter("falls")
    found = bad.collect() or meet.select("file_idx", F.lit("a block's start").alias("chrom"), F.col("lo.pos").alias("pos")).limit(1).collect()
    if found:
        raise VcfError(f"input {found[0]['file_idx'] + 1} is not coordinate-sorted at {found[0]['chrom']}:{found[0]['pos']}")


def _union_array(col: str, skip: tuple[str, ...]) -> Column:
    """Distinct parts of a column over the members, in first-seen order."""
    return F.filter(F.array_distinct(F.flatten(F.transform("m", lambda x: F.split(x[col], ";")))), lambda p: ~p.isin(*skip))


def _uniform(site: DataFrame, counts: list[int], plan: Site) -> DataFrame:
    """Merged records of sites whose members are alike."""
    total = sum(counts)
    fmt = F.col("m")[0]["format"]
    at, n_alt = X.gt_index(fmt), X.count_alts(F.col("m")[0]["alt"])
    ids, filters = _union_array("id", (".", "")), _union_array("filter", (".", "", "PASS"))
    quals = F.transform("m", lambda x: F.struct(X.double(x["qual"]).alias("q"), x["qual"].alias("raw")))
    nothing = F.struct(F.lit(None).cast("double").alias("q"), F.lit(".").alias("raw"))
    qual = F.aggregate(quals, nothing, lambda a, x: F.when(x.q.isNotNull() & (a.q.isNull() | (x.q > a.q) & ~F.isnan(x.q)), x).otherwise(a))["raw"]
    columns = F.flatten(F.transform("m", lambda x: F.split(x["samples_raw"], "\t")))
    site = site.withColumns({"fmt": fmt, "n_alt": n_alt})
    first_gt = F.filter(F.transform(columns, lambda s: X.subfield(s, at)), lambda g: g != ".")
    ploidy = F.coalesce(F.when(at.isNotNull(), X.let(first_gt, lambda g: F.size(F.split(F.get(g, F.lit(0)), r"[/|]")))), F.lit(2))
    site = site.withColumn("ploidy", F.when(ploidy < 1, 2).otherwise(ploidy)) if total else site.withColumn("ploidy", F.lit(2))
    out = {
        "chrom": F.col("m")[0]["chrom"], "pos_raw": F.col("m")[0]["pos_raw"], "id": F.when(F.size(ids) == 0, ".").otherwise(F.array_join(ids, ";")),
        "ref": F.col("m")[0]["ref"], "alt": F.col("m")[0]["alt"], "qual": qual,
        "filter": F.when(F.size(filters) > 0, F.array_join(filters, ";")).when(F.exists("m", lambda x: F.array_contains(F.split(x["filter"], ";"), "PASS")), "PASS").otherwise("."),
    }
    if plan.update:
        called = F.coalesce(X.called(columns, at), F.array().cast("array<int>")) if total else F.array().cast("array<int>")
        site = site.withColumn("called", called)
        covered = F.aggregate("m", F.lit(0), lambda s, x: s + F.get(F.array(*[F.lit(n) for n in counts]), x["file_idx"]))
        an = F.size("called") + ((F.lit(total) - covered) * F.col("ploidy") if plan.to_ref else F.lit(0))
        tail = F.concat(F.lit("AN="), an.cast("string"), F.lit(";AC="), F.array_join(X.allele_counts(F.col("called"), F.col("n_alt")), ","))
    site = site.withColumn("merged_info", _info_function(plan)(F.transform("m", lambda x: x["info"]), F.col("n_alt")))
    out["info"] = F.when(F.col("merged_info") == ".", tail).otherwise(F.concat("merged_info", F.lit(";"), tail)) if plan.update else F.col("merged_info")
    if total:
        gap = X.missing_sample(F.col("fmt"), F.col("ploidy"), plan.to_ref)
        own = lambda f: F.get(F.filter("m", lambda x: x["file_idx"] == f), F.lit(0))["samples_raw"]
        parts = [F.coalesce(own(f), F.array_join(F.array_repeat(gap, n), "\t")) for f, n in enumerate(counts) if n]
        out |= {"format": F.col("fmt"), "samples_raw": F.concat_ws("\t", *parts)}
    else:
        out |= {"format": F.lit(None).cast("string"), "samples_raw": F.lit(None).cast("string")}
    kind = F.coalesce(F.aggregate(F.transform(X.alts(F.col("m")[0]["alt"]), lambda a: X.allele_type(F.col("m")[0]["ref"], a)), F.lit(0), lambda s, x: s.bitwiseOR(x)), F.lit(0))
    snp, indel = (1, 0) if plan.mode == "indels" else (0, 1)
    rank = F.when(kind.bitwiseAND(F.lit(X.INDEL)) != 0, indel).when(kind.bitwiseAND(F.lit(X.SNP)) != 0, snp).otherwise(2)
    return site.select("rank", "pos", "round", rank.alias("class_rank"), F.col("m")[0]["file_idx"].alias("first_file"), *[v.alias(k) for k, v in out.items()])


def _info_function(plan: Site):  # noqa: ANN202
    numbers, rules, skip = plan.info, plan.rules, plan.skip

    @F.arrow_udf("string")
    def info(infos: pa.Array, n_alt: pa.Array) -> pa.Array:
        return pa.array([merged_info(x, numbers, rules, skip, [None] * len(x), n) for x, n in zip(infos.to_pylist(), n_alt.to_pylist(), strict=True)], pa.string())

    return info


_OUT = "rank int, pos long, round int, class_rank int, first_file int, chrom string, pos_raw string, id string, ref string, alt string, qual string, filter string, info string, format string, samples_raw string"


def _general(site: DataFrame, plan: Site) -> DataFrame:
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key in b.to_pylist():
                for r in plan.build(key["m"]):
                    rows.append({k: key[k] if k in ("rank", "pos", "round") else r[k] for k in names})
            if rows:
                kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 10]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names=names)

    return site.select("rank", "pos", "round", "m").mapInArrow(run, _OUT)


def merge(frames: list[VcfFrame], options: MergeOptions | None = None, force_general: bool = False) -> VcfFrame:
    """The merged table. Its order columns are rank, pos, round, class_rank, first_file."""
    o = options or MergeOptions()
    if len(frames) < 2:
        raise VcfError("merge takes two inputs or more")
    headers = [f.header for f in frames]
    samples = joined_samples(headers, o.force_samples)
    counts = [len(h.samples) for h in headers]
    declared = any(k in h.numbers("INFO") for h in headers for k in ("AC", "AN"))
    update = declared and not o.no_update
    header = union(headers)
    header.samples, header.has_format = samples, bool(samples)
    header.ensure("FORMAT", "GT")
    if update:
        header.ensure("INFO", "AC")
        header.ensure("INFO", "AN")
    plan = Site(counts, header.numbers("INFO"), header.numbers("FORMAT"), parse_rules(o.info_rules), o.mode, o.missing_to_ref, update, frozenset(("AC", "AN")) if update else frozenset())

    cols = ("chrom", "pos_raw", "id", "ref", "alt", "qual", "filter", "info", "format", "samples_raw", "block", "mid")
    parts = [(well_formed(f.df) if f.raw else f.df).select(*cols).withColumn("file_idx", F.lit(i)) for i, f in enumerate(frames)]
    recs = reduce(lambda a, b: a.unionByName(b), parts)
    recs = recs.withColumn("pos", F.when(F.col("pos_raw").rlike("^[0-9]+$"), F.col("pos_raw").try_cast("long")))
    if o.check_sorted:
        bad = recs.filter("pos is null").select("pos_raw").limit(1).collect()
        if bad:
            raise VcfError(f"bad POS '{bad[0][0]}'")
    order = contig_ranks(recs, header.contigs)
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)]) if order else F.lit(None)
    recs = recs.withColumn("rank", F.try_element_at(ranks, F.col("chrom")).cast("int") if order else F.lit(0))
    if o.check_sorted:
        require_sorted(recs)
    turn = Window.partitionBy("rank", "pos", "file_idx").orderBy("block", "mid")
    recs = recs.repartition("rank", "pos").withColumn("round", F.row_number().over(turn))
    member = F.struct("file_idx", *cols[:10])
    site = recs.groupBy("rank", "pos", "round").agg(F.array_sort(F.collect_list(member)).alias("m"))
    head = F.col("m")[0]
    width = F.array(*[F.lit(n) for n in counts])
    alike = F.forall("m", lambda x: (x["ref"] == head["ref"]) & (x["alt"] == head["alt"]) & x["format"].isNotNull() & (x["format"] == head["format"]) & x["samples_raw"].isNotNull() & (F.size(F.split(x["samples_raw"], "\t")) == F.get(width, x["file_idx"])))
    if not sum(counts):
        alike = F.lit(False)
    if force_general:
        df = _general(site, plan)
    else:
        site = site.withColumn("alike", alike)
        df = _uniform(site.filter("alike"), counts, plan).unionByName(_general(site.filter("not alike"), plan))
    return VcfFrame(header, df, False, ("rank", "pos", "round", "class_rank", "first_file"))

