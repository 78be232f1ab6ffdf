"""Column functions on sequences (strings over A, C, G, T and N).  All but from_text() and translate_codons() are built-in expressions: no Python runs on rows."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC nucleotide codes, their complements and the bases that each admits.
IUPAC = "ACGTUNRYSWKMBDHV"
IUPAC_COMPLEMENT = "TGCAANYRSWMKVHDB"
ADMITS = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "N": "ACGT", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
# Fixed value: the standard genetic code, codons in the order T, C, A, G of each position.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODON = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


_SIGNS = bytes.maketrans((string.ascii_lowercase + string.ascii_uppercase).encode() + bytes(range(0xC0, 0x100)), b"ACGT" * 6 + b"AC" + b"ACGT" * 6 + b"AC" + b"N" * 0x40)
_NO_SIGNS = bytes(b for b in range(0xC0) if not chr(b).isascii() or not chr(b).isalpha())  # the rest of ASCII, and bytes inside a sign


_SOME = 256


def _bases(text: pa.Array) -> pa.Array:
    """By `_SOME` texts at a time, so that a batch is held twice and not several times."""
    out = [pa.array([], pa.string())]
    for i in range(0, len(text), _SOME):
        each = text.slice(i, _SOME).cast(pa.binary()).to_pylist()
        out.append(pa.array([t if t is None else t.translate(_SIGNS, _NO_SIGNS) for t in each], pa.binary()).cast(pa.string()))
    return pa.concat_arrays(out)


def from_text(text: Column) -> Column:
    """A text as a sequence: ASCII letters go round A, C, G, T, other ASCII signs go, anything else is N.

    By one table of bytes: built-in expressions take a regular expression, a lookup and a string for each sign.
    """
    return F.arrow_udf(_bases, "string")(text)


def revcomp(seq: Column) -> Column:
    """The reverse complement over all IUPAC codes, in either case."""
    return F.reverse(F.translate(seq, IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower()))


def count_of(seq: Column, chars: str) -> Column:
    return F.length(seq) - F.length(F.regexp_replace(seq, f"[{chars}]+", ""))


def gc_fraction(seq: Column) -> Column:
    """(G + C) / length; 0 for an empty sequence."""
    return F.when(F.length(seq) == 0, 0.0).otherwise(count_of(F.upper(seq), "GC") / F.length(seq))


def max_homopolymer_run(seq: Column) -> Column:
    """The longest run of one base; 0 for an empty sequence."""
    found = F.regexp_extract_all(seq, F.lit("(A+|C+|G+|T+|N+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: F.length(x))), F.lit(0))


def has_polyt(seq: Column, run: int = 4) -> Column:
    return F.contains(F.upper(seq), F.lit("T" * run))


def is_concrete(seq: Column) -> Column:
    """Only A, C, G, T."""
    return seq.rlike("^[ACGT]*$")


def ambiguous_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[ACGT]+", ""))


def ambiguous_fraction(seq: Column) -> Column:
    """Share of bases other than A, C, G, T, to 8 places; 1 for an empty sequence."""
    return F.when(F.length(seq) == 0, 1.0).otherwise(F.round(ambiguous_count(seq) / F.length(seq), 8))


def hamming_positions(a: Column, b: Column, length: int) -> Column:
    """1-based positions where a and b differ; N differs from everything, itself included."""
    one = lambda s, i: F.substring(s, i, F.lit(1))
    return F.filter(F.sequence(F.lit(1), F.lit(length)), lambda i: (one(a, i) != one(b, i)) | (one(a, i) == "N"))


_BASE = np.full(256, 4, np.uint8)
_BASE[[*b"TCAG"]] = range(4)
_AMINO = np.full(125, ord("X"), np.uint8)
for _codon, _acid in CODON.items():
    _AMINO[sum("TCAG".index(b) * 5 ** (2 - i) for i, b in enumerate(_codon))] = ord(_acid)


def _amino_acids(cds: pa.Array) -> pa.Array:
    """The amino acids of a column of sequences, read as one array of bytes."""
    cds = pa.concat_arrays([pa.array(cds).cast(pa.large_string()).fill_null("")])
    ends = np.frombuffer(cds.buffers()[1], np.int64)[: len(cds) + 1] if len(cds) else np.zeros(1, np.int64)
    raw = np.frombuffer(cds.buffers()[2] or b"", np.uint8)[: ends[-1]]
    if len(raw) and raw.max() > 127:  # a sign of several bytes counts as one
        lead = raw & 0xC0 != 0x80
        ends, raw = np.concatenate(([0], np.cumsum(lead)))[ends], raw[lead]
    whole = np.diff(ends) // 3
    out = np.concatenate(([0], np.cumsum(whole)))
    at = np.arange(out[-1]) * 3 + np.repeat(ends[:-1] - 3 * out[:-1], whole)
    base = _BASE[raw]
    told = _AMINO[base[at].astype(np.intp) * 25 + base[at + 1] * 5 + base[at + 2]]
    return pa.LargeStringArray.from_buffers(len(cds), pa.py_buffer(out.astype(np.int64)), pa.py_buffer(told)).cast(pa.string())


def translate_codons(cds: Column) -> Column:
    """Amino acids of whole codons; X for an unknown codon, * for a stop.

    By batches of bytes: a built-in expression for each codon walks from the start of the string to its place, which grows with the square of the length.
    """
    return F.arrow_udf(_amino_acids, "string")(cds)


def mash_identity(jaccard: Column, k: int) -> Column:
    """1 + ln(2j / (1 + j)) / k, held to [0, 1]."""
    return F.when(jaccard <= 0, 0.0).when(jaccard >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 + F.log(2 * jaccard / (1 + jaccard)) / k))


def gtf_attribute(attributes: Column, key: str) -> Column:
    """The quoted value of a key, or an empty string."""
    return F.regexp_extract(attributes, key + ' "([^"]*)"', 1)


def normalised_digest(text: Column) -> Column:
    """SHA-256 with line ends as \\n."""
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n").cast("binary"), 256)


def year_of(dirty: Column) -> Column:
    """The first year 18xx-20xx in a text, or null."""
    return F.nullif(F.regexp_extract(dirty, r"(1[89]\d{2}|20\d{2})", 1), F.lit("")).cast("int")


def scientific(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}e", x)


def footprints(spelled: Column, start: Column, end: Column) -> Column:
    """Sorted distinct 0-based half-open spans of "s-e(strand);..." ; malformed pieces are skipped, none falls back to start and end."""
    pieces = F.regexp_extract_all(F.coalesce(spelled, F.lit("")), F.lit(r"(\d+-\d+)\([+-]\)"), F.lit(1))
    spans = F.transform(pieces, lambda p: F.struct((F.split(p, "-")[0].cast("int") - 1).alias("start"), F.split(p, "-")[1].cast("int").alias("end")))
    own = F.array(F.struct((start - 1).cast("int").alias("start"), end.cast("int").alias("end")))
    return F.when(F.size(spans) > 0, F.array_sort(F.array_distinct(spans))).otherwise(own)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank, else an empty string."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def base_codes(seq: Column) -> Column:
    """A sequence as digits: A, C, G, T in either case are 0 to 3, any other character is 4."""
    return F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgtN", "012301234")


def bases_of(codes: Column) -> Column:
    """The sequence that base_codes() tells: 4 is N."""
    return F.translate(codes, "01234", "ACGTN")


def revcomp_codes(codes: Column) -> Column:
    """The codes of the reverse complement; 4 stays 4."""
    return F.reverse(F.translate(codes, "0123", "3210"))


def country_of(place: Column) -> Column:
    """The text before the first colon, trimmed, or null where that is blank."""
    return F.nullif(F.trim(F.split(place, ":")[0]), F.lit(""))
