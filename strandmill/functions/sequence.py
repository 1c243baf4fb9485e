"""Expressions on peptide and DNA text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue letters, codon table by base order TCAG.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
CODON_BASES = "TCAG"
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def clean_sequence(seq: Column) -> Column:
    """Upper case, everything but the 20 residue letters dropped; null stays null."""
    return F.regexp_replace(F.upper(seq), f"[^{RESIDUES}]", "")


def is_header(line: Column) -> Column:
    """True for FASTA header lines: the first character that isn't blank is '>'."""
    return F.coalesce(line.rlike(r"^[\s\p{Z}]*>"), F.lit(False))


def strip_chars(seq: Column, chars: str) -> Column:
    """Characters of a set dropped at both ends; no characters, no change."""
    return F.btrim(seq, F.lit(chars)) if chars else seq


def centre_pad(seq: Column, width: int = 20, pad: str = "J", *, overlong_as_reference: bool = False) -> Column:
    """Pad on both sides, the odd character on the right. Longer sequences stay as they are.

    With overlong_as_reference one of odd excess gets one more pad character, which is what the original arithmetic does.
    """
    missing = F.lit(width) - F.length(seq)
    odd = F.pmod(missing, F.lit(2))
    half = ((missing - odd) / 2).cast("int")
    padded = F.concat(F.repeat(F.lit(pad), half), seq, F.repeat(F.lit(pad), (half + odd).cast("int")))
    overlong = F.concat(seq, F.when(odd == 1, F.lit(pad)).otherwise("")) if overlong_as_reference else seq
    return F.when(missing >= 0, padded).otherwise(overlong)


def right_repad(seq: Column, width: int, pad: str = "J") -> Column:
    """All pad characters dropped, then added at the end up to width; longer rests aren't cut."""
    bare = F.replace(seq, F.lit(pad), F.lit(""))
    return F.concat(bare, F.repeat(F.lit(pad), F.greatest(F.lit(width) - F.length(bare), F.lit(0))))


def window_bounds(seq: Column, width: int = 40, shown: int = 20) -> tuple[Column, Column]:
    """Lower and upper offset at which a shown-wide window over a padded sequence still holds all residues."""
    missing = F.lit(width) - F.length(seq)
    left, right = F.floor(missing / 2).cast("int"), F.ceil(missing / 2).cast("int")
    return F.lit(width) - left - F.lit(shown), right


def one_hot(seq: Column, width: int = 40, alphabet: str = RESIDUES, pad: str = "J") -> Column:
    """array<float> of len(alphabet) * width, residue by residue; pad characters are zeros, other symbols raise an error. Longer sequences have as many places as residues."""
    missing = F.lit(width) - F.length(seq)
    padded = F.concat(F.repeat(F.lit(pad), F.floor(missing / 2).cast("int")), seq, F.repeat(F.lit(pad), F.ceil(missing / 2).cast("int")))
    checked = F.when(padded.rlike(f"^[{alphabet}{pad}]*$"), padded).otherwise(F.raise_error(F.concat(F.lit("symbol outside the alphabet in "), seq)))
    letters = F.split(checked, "")
    same = lambda r: lambda x: (x == F.lit(r)).cast("float")
    return F.flatten(F.array(*[F.transform(letters, same(r)) for r in alphabet]))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of equally long strings; null for unequal lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x)))


def hamming_share(a: Column, b: Column) -> Column:
    """Mismatches as a share of the length."""
    return hamming(a, b) / F.length(a)


def shift_distance(a: Column, b: Column) -> Column:
    """Least edit distance of the shorter string to an equally long window of the longer."""
    long, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    starts = F.sequence(F.lit(0), F.length(long) - F.length(short))
    return F.array_min(F.transform(starts, lambda i: F.levenshtein(F.substring(long, i + 1, F.length(short)), short)))


def translate_codons(dna: Column) -> Column:
    """Peptide of the first reading frame by the standard code; codons with other letters give X, a rest of one or two bases is left out."""
    codons = [a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES]
    table = F.create_map(*[x for codon, residue in zip(codons, CODON_RESIDUES) for x in (F.lit(codon), F.lit(residue))])
    n = F.floor(F.length(dna) / 3).cast("int")
    residues = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(table, F.substring(F.upper(dna), i * 3 + 1, 3)), F.lit("X")))
    return F.when(n > 0, F.array_join(residues, "")).when(n == 0, "")


def is_valid_cdr(dna: Column, ending: int = 6) -> Column:
    """Whole codons, and more than the ending."""
    return (F.pmod(F.length(dna), F.lit(3)) == 0) & (F.length(dna) > ending)


def argmax_label(scores: Column) -> Column:
    """Place of the first greatest entry, from 0; null for null or empty arrays."""
    return F.when(F.size(scores) > 0, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def kmers(seq: Column, k: int) -> Column:
    """Distinct windows of k letters."""
    n = F.length(seq) - k
    return F.when(n >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(seq, i + 1, k)))).otherwise(F.array().cast("array<string>"))
