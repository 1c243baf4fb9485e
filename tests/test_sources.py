import gzip


from strandmill.sources import readers, writers
from strandmill.streaming.counts import streaming_counts


def test_fastq(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    with gzip.open(tmp_path / "deep" / "R1_L1.fastq.gz", "wt") as f:
        f.write("@a#1:x more\nACGT\n+\nIIII\n@b\nGG\n+\nII\n@cut\nAC\n")
    got = {tuple(r) for r in readers.read_fastq(spark, str(tmp_path)).collect()}
    assert got == {("R1", "a_1_x", "ACGT", "IIII"), ("R1", "b", "GG", "II")}
    records = [(f"r{i}", "ACGT" * (i % 7 + 1)) for i in range(3000)]
    (tmp_path / "R2_x.fastq").write_text("".join(f"@{n} z\n{s}\n+\n{'@' * len(s)}\n" for n, s in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {(r["read_id"], r["seq"]) for r in readers.read_fastq(spark, str(tmp_path)).where("sample = 'R2'").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == set(records)


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "R2_x.fa").write_text(">s1 a > b\nACG\nTT\n>s2\n\n>s3\r\nGG\r\n")
    got = {tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "R2_x.fa")).collect()}
    assert got == {("R2", "s1", "ACGTT"), ("R2", "s3", "GG")}
    writers.write_fasta(readers.read_fasta(spark, str(tmp_path / "R2_x.fa")), str(tmp_path / "out"))
    back = {(r["read_id"], r["seq"]) for r in readers.read_fasta(spark, str(tmp_path / "out"), glob="part*").collect()}
    assert back == {("s1", "ACGTT"), ("s3", "GG")}


def test_targets_and_columns(spark, tmp_path):
    (tmp_path / "data.tsv").write_text("ARDY\tx\nARDV\ty\n")
    (tmp_path / "data.target").write_text("1 0\n0 1\n")
    got = {tuple(map(str, r)) for r in readers.read_targets(spark, str(tmp_path)).collect()}
    assert got == {("0", "ARDY", "[1.0, 0.0]"), ("1", "ARDV", "[0.0, 1.0]")}
    assert {tuple(r) for r in readers.read_columns(spark, str(tmp_path / "data.tsv"), ["a", "b", "c"]).collect()} == {("ARDY", "x", None), ("ARDV", "y", None)}
    (tmp_path / "heads").mkdir()
    for f in ("a", "b"):
        (tmp_path / "heads" / f).write_text("k v\nk v\n1 2\n")  # a data line that reads like the header stays
    assert [tuple(r) for r in readers.read_columns(spark, str(tmp_path / "heads"), ["k", "v"], skip=1).orderBy("k").collect()] == [("1", "2")] * 2 + [("k", "v")] * 2


def test_hits_settings(spark, tmp_path):
    (tmp_path / "h").write_text("r1\tp\t100\t12\t0\t0\t1\t12\t5\t16\t1e-5\t24\n")
    assert readers.read_hits(spark, str(tmp_path / "h")).first()["send"] == 16
    (tmp_path / "s").write_text("R2\tR1\n\nR3 R2\n")
    assert readers.read_settings(str(tmp_path / "s")) == [("R2", "R1"), ("R3", "R2")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 1.0)], "id int, part string, x double")
    writers.write_parts(df, str(tmp_path / "p"))
    writers.write_tsv(df, str(tmp_path / "t"), order=["x"])
    writers.write_assignments(df.withColumnRenamed("part", "group"), str(tmp_path / "a"))
    writers.write_run(spark, str(tmp_path / "r"), "clust", c=2)
    assert spark.read.csv(str(tmp_path / "p"), sep="\t", header=True).count() == 2
    assert spark.read.json(str(tmp_path / "r")).first()["command"] == "clust"


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([("a",), ("a ",), (None,), ("b",)], "seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string").parquet(str(tmp_path / "in"))
    q = streaming_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts_seen").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from counts_seen").collect()} == {("a", 2), ("b", 1)}
