"""Mismatch counts of equally long sequences by bit planes: a few XORs in generated code instead of a loop over letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*-._"
OTHER = "@"
BITS = 5
CHUNK = 63  # letters in one signed 64-bit word


def plane_names(max_len: int) -> list[str]:
    return [f"plane_{c}_{b}" for c in range(-(-max(max_len, 1) // CHUNK)) for b in range(BITS)]


def bit_planes(seq: Column, max_len: int) -> list[Column]:
    """Columns plane_<chunk>_<bit> of a sequence of at most max_len characters: bit b of each letter's place in the alphabet.

    Letter case does not matter; stop, gap and the like are letters of their own, what is left counts as one further letter.
    """
    letters = F.regexp_replace(F.upper(seq), "[^A-Z*._-]", OTHER)
    out = []
    for name in plane_names(max_len):
        _, chunk, bit = name.split("_")
        digits = "".join(str((i >> int(bit)) & 1) for i in range(1, len(LETTERS) + 1))
        piece = F.substring(letters, int(chunk) * CHUNK + 1, CHUNK)
        out.append(F.coalesce(F.conv(F.translate(piece, LETTERS + OTHER, digits + "1"), 2, 10).cast("bigint"), F.lit(0)).alias(name))
    return out


def mismatches(left: str, right: str, max_len: int) -> Column:
    """Number of positions at which the sequences behind left.plane_* and right.plane_* differ; for equal lengths only."""
    names = plane_names(max_len)
    chunks = [names[i : i + BITS] for i in range(0, len(names), BITS)]
    return reduce(lambda a, b: a + b, (F.bit_count(_any_bit(left, right, c)) for c in chunks))


def _any_bit(left: str, right: str, names: list[str]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.col(f"{left}.{n}").bitwiseXOR(F.col(f"{right}.{n}")) for n in names))
