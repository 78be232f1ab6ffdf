"""Site grammars: a spacer of fixed length followed by an IUPAC pattern."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import ADMITS, IUPAC, IUPAC_COMPLEMENT


def complement_pattern(pattern: str) -> str:
    """The reverse complement of an IUPAC pattern."""
    table = dict(zip(IUPAC, IUPAC_COMPLEMENT, strict=True))
    return "".join(table[c] for c in reversed(pattern.upper()))


def as_regex(pattern: str) -> str:
    """Character classes for a pattern; an ambiguous base of a text never matches, even under N."""
    parts, i = [], 0
    while i < len(pattern):
        j = i
        while j < len(pattern) and pattern[j] == pattern[i]:
            j += 1
        bases = ADMITS[pattern[i].upper()]
        one = bases if len(bases) == 1 else f"[{bases}]"
        parts.append(one + (f"{{{j - i}}}" if j - i > 1 else ""))
        i = j
    return "".join(parts)


@dataclass(frozen=True)
class Grammar:
    """A named site shape: `spacer` free bases, then `pam` at their 3' end."""

    name: str
    spacer: int
    pam: str
    side: str = "3prime"

    def __post_init__(self):
        if self.side != "3prime":
            raise ValueError("only patterns at the 3' end can be scanned")
        if self.spacer < 1 or not self.pam or set(self.pam.upper()) - set(ADMITS):
            raise ValueError(f"not a site grammar: {self.spacer} bases and {self.pam!r}")

    @property
    def length(self) -> int:
        return self.spacer + len(self.pam)

    @property
    def tag(self) -> str:
        return f"{self.name}_{self.pam}_{self.spacer}".lower()

    @property
    def label(self) -> str:
        return f"{self.name} ({self.spacer} + {self.pam})"

    @property
    def plus(self) -> str:
        """Regular expression of a site on the plus strand."""
        return as_regex("N" * self.spacer + self.pam)

    @property
    def minus(self) -> str:
        """Regular expression, on the plus strand, of a site on the minus strand."""
        return as_regex(complement_pattern(self.pam) + "N" * self.spacer)

    def anchors(self) -> list[tuple[str, int]]:
        """Maximal literal stretches of the pattern with their offset, the longest first, then the leftmost."""
        found, start = [], None
        for i, c in enumerate(self.pam + "N"):
            literal = len(ADMITS[c]) == 1
            if literal and start is None:
                start = i
            elif not literal and start is not None:
                found.append((self.pam[start:i], self.spacer + start))
                start = None
        return sorted(found, key=lambda x: (-len(x[0]), x[1]))

    def matches(self, pam: Column) -> Column:
        return pam.rlike(f"^{as_regex(self.pam)}$")

    def cut_site(self, start: Column, end: Column, strand: Column) -> Column:
        """1-based cut position of a site with 1-based inclusive start and end."""
        p = len(self.pam)
        return F.when(strand == "+", end - p - 2).otherwise(start + p + 1)

    def cut_offset_in_frame(self, start0: Column, strand: Column) -> Column:
        """0-based cut position as the codon maps count it: one base on from cut_site on the minus strand."""
        p = len(self.pam)
        return F.when(strand == "+", start0 + self.spacer - 3).otherwise(start0 + p + 2)

    def cut_offset_in_hit(self, start0: Column, strand: Column) -> Column:
        """0-based cut position as hit annotation counts it: two bases on from cut_site on the minus strand."""
        p = len(self.pam)
        return F.when(strand == "+", start0 + self.spacer - 3).otherwise(start0 + p + 3)


GRAMMARS = {g.name: g for g in (Grammar("spcas9", 20, "NGG"), Grammar("sacas9", 21, "NNGRRT"), Grammar("sacas9_relaxed", 21, "NNGRRN"))}


def grammar(name: str, pam: str | None = None, spacer: int | None = None) -> Grammar:
    """A known grammar, with another pattern or spacer length if given; an unknown name is an error."""
    if name not in GRAMMARS:
        raise KeyError(f"no grammar {name!r}; known: {', '.join(sorted(GRAMMARS))}")
    changes = {k: v for k, v in (("pam", pam), ("spacer", spacer)) if v is not None}
    return replace(GRAMMARS[name], **changes)


def pam_class(pam: Column, place: int, base: str, strict: str, relaxed: str) -> Column:
    """The class of a PAM found by a relaxed pattern: strict if its base at `place` (1-based) is the one that the strict pattern asks for."""
    return F.when(F.substring(pam, place, 1) == base, strict).otherwise(relaxed)
