"""The same expressions for spark.sql: SQL functions that Spark inlines into the plan, no Python behind them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandmill.functions.sequence import CODON_BASES, CODON_RESIDUES, RESIDUES

_CODONS = ", ".join(f"'{a}{b}{c}', '{r}'" for (a, b, c), r in zip(((a, b, c) for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES), CODON_RESIDUES))

FUNCTIONS = {
    "clean_sequence(s STRING) RETURNS STRING": f"regexp_replace(upper(s), '[^{RESIDUES}]', '')",
    "hamming(a STRING, b STRING) RETURNS INT": "CASE WHEN length(a) = length(b) THEN CASE WHEN length(a) = 0 THEN 0 ELSE size(filter(zip_with(split(a, ''), split(b, ''), (x, y) -> x <> y), d -> d)) END END",
    "shift_distance(a STRING, b STRING) RETURNS INT": """array_min(transform(sequence(0, abs(length(a) - length(b))),
        i -> levenshtein(substring(if(length(a) >= length(b), a, b), i + 1, least(length(a), length(b))), if(length(a) >= length(b), b, a))))""",
    "centre_pad(s STRING, width INT, pad STRING) RETURNS STRING": "CASE WHEN length(s) >= width THEN s ELSE concat(repeat(pad, (width - length(s)) div 2), s, repeat(pad, width - length(s) - (width - length(s)) div 2)) END",
    "translate_codons(s STRING) RETURNS STRING": f"CASE WHEN length(s) < 3 THEN '' ELSE array_join(transform(sequence(0, length(s) div 3 - 1), i -> coalesce(try_element_at(map({_CODONS}), substring(upper(s), i * 3 + 1, 3)), 'X')), '') END",
}
TABLES = {"kmers(s STRING, k INT) RETURNS TABLE (pos INT, kmer STRING)": "SELECT i, substring(s, i, k) FROM (SELECT explode(CASE WHEN length(s) >= k THEN sequence(1, length(s) - k + 1) ELSE array() END) AS i)"}


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for head, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
