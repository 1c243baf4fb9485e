from pyspark.sql import functions as F

from strandmill.functions import sql
from strandmill.operators import parsing


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT hamming('ACGT', 'AGGA') h, hamming('A', 'AB') n, shift_distance('TTC', 'AATTCGG') s, centre_pad('ARD', 20, 'J') p, translate_codons('ATGTAGC') t, clean_sequence(' ar-*dj') c").first()
    assert tuple(r) == (2, None, 0, "JJJJJJJJARDJJJJJJJJJ", "M*", "ARD")
    assert {tuple(x) for x in spark.sql("SELECT k.pos, k.kmer FROM kmers('ARDY', 3) k").collect()} == {(1, "ARD"), (2, "RDY")}


def test_primer_match(spark):
    r = spark.range(1).select(parsing.matches_primer(F.lit("ACGTT"), "AGGTA").alias("a"), parsing.matches_primer(F.lit("ACG"), "AGGTA").alias("b"), parsing.matches_primer(F.lit("TTTTT"), "AGGCA").alias("c")).first()
    assert tuple(r) == (True, False, False)
