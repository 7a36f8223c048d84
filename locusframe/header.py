"""VCF headers: small, on the driver. Meta lines stay as they are; only ID and Number are read."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")
DEFAULT_FORMAT = "##fileformat=VCFv4.2"
# Fixed declarations, added where a result needs them.
DECLARED = {
    ("INFO", "AC"): '##INFO=<ID=AC,Number=A,Type=Integer,Description="Allele count in genotypes">',
    ("INFO", "AN"): '##INFO=<ID=AN,Number=1,Type=Integer,Description="Total number of alleles in called genotypes">',
    ("FORMAT", "GT"): '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
}
_PAIR = re.compile(r'([^=,>]*)=(?:"((?:\\.|[^"\\])*)"?|([^,>]*))')


class VcfError(ValueError):
    """Input or options that can't be processed."""


def attributes(body: str) -> Iterable[tuple[str, str]]:
    """Key and value pairs of what follows `<` in a structured meta line; commas and brackets in quotes belong to the value."""
    at = 0
    while m := _PAIR.match(body, at):
        yield m[1], m[2] if m[2] is not None else m[3]
        at = m.end()
        if body[at : at + 1] != ",":
            return
        at += 1


def attr(body: str, key: str) -> str | None:
    return next((v for k, v in attributes(body) if k == key), None)


def structured(line: str) -> tuple[str, str] | None:
    """(KEY, what follows `<`) of a line `##KEY=<...`."""
    key, eq, rest = line[2:].partition("=")
    return (key, rest[1:]) if line[:2] == "##" and eq and rest[:1] == "<" else None


def meta_key(line: str) -> tuple[str, str]:
    """What makes a meta line the same as another: its key and ID, else all of it."""
    s = structured(line)
    ident = s and attr(s[1], "ID")
    return (s[0], ident) if s and ident is not None else ("", line)


def number(text: str | None) -> str:
    """A, R, G, a count, or '.' for whatever else."""
    return text if text in ("A", "R", "G") or (text or "").isdigit() else "."


@dataclass
class VcfHeader:
    meta: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)
    has_format: bool = False

    @classmethod
    def parse(cls, lines: Iterable[str]) -> VcfHeader:
        """Reads up to the #CHROM line; lines come without their line ends."""
        h = cls()
        for line in lines:
            if not line:
                continue
            if line.startswith("##"):
                h.meta.append(line)
            elif line.startswith("#CHROM"):
                cols = line.split("\t")
                h.has_format = len(cols) > 8 and cols[8] == "FORMAT"
                h.samples = cols[9:]
                return h
            else:
                raise VcfError("a record precedes the #CHROM line")
        raise VcfError("there is no #CHROM line")

    def _declared(self, kind: str) -> Iterable[tuple[str, str]]:
        for line in self.meta:
            s = structured(line)
            if s and s[0] == kind and (ident := attr(s[1], "ID")) is not None:
                yield ident, s[1]

    @property
    def contigs(self) -> list[str]:
        return list(dict.fromkeys(c for c, _ in self._declared("contig")))

    def numbers(self, kind: str) -> dict[str, str]:
        """Number by ID of the INFO or FORMAT declarations; the last declaration holds."""
        return {k: number(attr(body, "Number")) for k, body in self._declared(kind)}

    def ensure(self, kind: str, ident: str) -> None:
        if all(k != ident for k, _ in self._declared(kind)):
            self.meta.append(DECLARED[kind, ident])

    def copy(self, samples: list[str] | None = None) -> VcfHeader:
        return VcfHeader(list(self.meta), list(self.samples if samples is None else samples), self.has_format)

    def text(self, drop_genotypes: bool = False) -> str:
        """All header lines, each with its line end. Only the first ##fileformat line is kept."""
        seen, out = False, []
        for line in self.meta:
            if line.startswith("##fileformat="):
                if seen:
                    continue
                seen = True
            out.append(line)
        cols = ["#" + FIXED[0], *FIXED[1:]]
        if not drop_genotypes and (self.samples or self.has_format):
            cols += ["FORMAT", *self.samples]
        return "\n".join([*out, "\t".join(cols)]) + "\n"

    def select(self, spec: str) -> list[int]:
        """Sample columns of a list of names, in its order; `^` takes all others, in the header's order. Of equal names the last counts."""
        inverse, body = spec.startswith("^"), spec.removeprefix("^")
        at = {s: i for i, s in enumerate(self.samples)}
        names = [n for n in body.split(",") if n]
        for n in names:
            if n not in at:
                raise VcfError(f"sample '{n}' is not present in the header")
        picked = [at[n] for n in names]
        return [i for i in range(len(self.samples)) if i not in set(picked)] if inverse else picked


def union(headers: list[VcfHeader]) -> VcfHeader:
    """Meta lines of several headers: the first of each key and ID, one ##fileformat at the top. Samples aren't joined."""
    out, seen, version = VcfHeader(), set(), None
    for h in headers:
        for line in h.meta:
            if line.startswith("##fileformat="):
                version = version or line
            elif (k := meta_key(line)) not in seen:
                seen.add(k)
                out.meta.append(line)
        out.has_format |= h.has_format
    out.meta.insert(0, version or DEFAULT_FORMAT)
    return out


def joined_samples(headers: list[VcfHeader], force: bool = False) -> list[str]:
    """Samples of all inputs, one after the other. A repeated name is an error, or with force gets its 1-based input number as prefix."""
    out: list[str] = []
    seen: set[str] = set()
    for i, h in enumerate(headers, 1):
        for s in h.samples:
            if s in seen and not force:
                raise VcfError(f"duplicate sample '{s}' in input {i}; force_samples renames it")
            name = f"{i}:{s}" if s in seen else s
            seen.add(name)
            out.append(name)
    return out
