"""Column functions over raw VCF text. Values stay text; they are decoded where they are used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.header import VcfError

SNP, INDEL, MNP, OTHER, REF = 1, 2, 4, 8, 16
TYPE_NAMES = {"snp": SNP, "snps": SNP, "indel": INDEL, "indels": INDEL, "mnp": MNP, "mnps": MNP, "other": OTHER, "ref": REF}
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_types(spec: str) -> int:
    mask = 0
    for name in filter(None, spec.split(",")):
        if name not in TYPE_NAMES:
            raise VcfError(f"unknown variant type '{name}'")
        mask |= TYPE_NAMES[name]
    return mask


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def uint(c: Column) -> Column:
    """Digits as a long, anything else null."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))


def double(c: Column) -> Column:
    """A decimal number, infinity or NaN as a double; anything else null (no white space, no type suffix)."""
    word = F.lower(F.regexp_replace(c, r"^[+-]", ""))
    special = F.when(word == "nan", F.lit(float("nan"))).when(word.isin("inf", "infinity"), F.when(c.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.when(c.rlike(_NUMBER), c.try_cast("double")).otherwise(special)


def alts(alt: Column) -> Column:
    return F.when(alt.isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(alt, ","))


def count_alts(alt: Column) -> Column:
    return F.when(alt.isin(".", ""), F.lit(0)).otherwise(F.size(F.split(alt, ",")))


def allele_type(ref: Column, alt: Column) -> Column:
    """One of SNP, INDEL, MNP, OTHER, REF."""
    plain = r"^[ACGTNacgtn]*$"
    upper_equal = alt == ref
    mismatches = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(ref), F.lit(1))), lambda i: F.substring(ref, i, F.lit(1)) != F.substring(alt, i, F.lit(1))))
    return (
        F.when(alt.isin("", "."), REF).when((alt == "*") | alt.rlike(r"^<|[\[\]]"), OTHER).when(~alt.rlike(plain) | ~ref.rlike(plain), OTHER)
        .when(upper_equal, REF).when(F.length(ref) != F.length(alt), INDEL).when(mismatches == 1, SNP).otherwise(MNP)
    )


def site_types(ref: Column, alt: Column) -> Column:
    """OR of the types of all ALTs; no ALT is REF."""
    each = F.transform(F.split(alt, ","), lambda a: allele_type(ref, a))
    return F.when(alt.isin(".", ""), REF).otherwise(F.aggregate(each, F.lit(0), lambda s, x: s.bitwiseOR(x)))


def gt_index(fmt: Column) -> Column:
    """0-based place of GT among a FORMAT's keys, null if it has none."""
    at = F.array_position(F.split(fmt, ":"), "GT")
    return F.when(at > 0, (at - 1).cast("int"))


def subfield(sample: Column, n: Column) -> Column:
    return F.coalesce(F.get(F.split(sample, ":"), n), F.lit(""))


def gt_alleles(gt: Column) -> Column:
    """Allele numbers of a genotype of any ploidy; null for a missing one."""
    return F.transform(F.split(gt, r"[/|]"), lambda a: F.when(a.rlike("^[0-9]+$"), a.try_cast("int")))


def phased(gt: Column) -> Column:
    return gt.contains("|")


def called(samples: Column, gt_at: Column) -> Column:
    """All called allele numbers of an array of sample columns."""
    return F.filter(F.flatten(F.transform(samples, lambda s: gt_alleles(subfield(s, gt_at)))), lambda a: a.isNotNull())


def allele_counts(alleles: Column, n_alt: Column) -> Column:
    """How often each ALT number is among the alleles."""
    return F.when(n_alt == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n_alt, F.lit(1))), lambda i: F.size(F.filter(alleles, lambda a: a == i))))


def rewrite_info(info: Column, updates: dict[str, Column]) -> Column:
    """INFO with keys set in their place, new ones appended, those with a null value dropped; nothing left gives a dot."""
    parts = F.when(info.isin(".", ""), F.array().cast("array<string>")).otherwise(F.filter(F.split(info, ";"), lambda p: p != ""))
    key = lambda p: F.substring_index(p, "=", 1)

    def set_(p: Column) -> Column:
        out = None
        for k, v in updates.items():
            value = F.concat(F.lit(k + "="), v)
            out = F.when(key(p) == k, value) if out is None else out.when(key(p) == k, value)
        return out.otherwise(p)

    def absent(k: str) -> Column:
        return ~F.exists(parts, lambda p: key(p) == k)

    kept = F.filter(F.transform(parts, set_), lambda p: p.isNotNull())
    more = F.filter(F.array(*[F.when(absent(k), F.concat(F.lit(k + "="), v)) for k, v in updates.items()]), lambda p: p.isNotNull())
    return let(F.concat(kept, more), lambda a: F.when(F.size(a) == 0, F.lit(".")).otherwise(F.array_join(a, ";")))


def missing_sample(fmt: Column, ploidy: Column, to_ref: bool = False) -> Column:
    """A sample column without data for a FORMAT."""
    gt = F.array_join(F.array_repeat(F.lit("0" if to_ref else "."), ploidy), "/")
    return F.array_join(F.transform(F.split(fmt, ":"), lambda k: F.when(k == "GT", gt).otherwise(F.lit("."))), ":")
