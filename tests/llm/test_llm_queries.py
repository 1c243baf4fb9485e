import pytest

from strandmill.llm import oracles, queries, tokens

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(agrees, name):
    rows = agrees(queries.queries()[name], SQL.get(name))
    assert rows or name in SQL


def rows_of(spark, name):
    from conftest import DATA

    if not DATA.exists():
        pytest.skip("no test tables here")
    return queries.queries()[name](spark, str(DATA)), lambda t: queries.table(spark, str(DATA), t)


def test_splits_have_every_row_once(spark):
    got, table = rows_of(spark, "p4_splits")
    assert sorted(r[0] for r in got.select("row_id").collect()) == sorted(r[0] for r in table("cluster_partition").select("row_id").distinct().collect())
    assert {r[0] for r in got.select("split").distinct().collect()} == {"train", "valid", "test"}


def test_ids_are_those_of_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    got, table = rows_of(spark, "p7_ids")
    with open(tokens.VOCABULARY, "rb") as f:
        other = tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=tokens.read_ranks(f.read()), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in table("documents").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {i: other.encode_ordinary(t) if t else [] for i, t in texts.items()}


def test_uses_and_shares(spark):
    uses, table = rows_of(spark, "p8_uses")
    caps = {r["source"].strip().lower().replace("_", "-"): r["max_repeats"] for r in table("mix_targets").collect()}
    rows = uses.collect()
    assert rows and all(0 < r["uses"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    shares, _ = rows_of(spark, "p8_shares")
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == set(caps) and sum(r["actual_share"] for r in got.values()) == pytest.approx(1)
    for s, r in got.items():
        assert r["used_tokens"] == sum(u["n_tokens"] * u["uses"] for u in rows if u["source"] == s)


def test_items_are_gone_from_redacted_texts(spark):
    found, table = rows_of(spark, "p9_found")
    assert {r[0] for r in found.select("pii_type").distinct().collect()} == {"email", "phone", "id_number", "address", "name"}
    redacted, _ = rows_of(spark, "p9_redacted")
    docs = {r["doc_id"]: r["text"] for r in table("documents").collect()}
    marks = {r["pii_type"]: r["placeholder"] for r in table("pii_types").collect()}
    got = {r["doc_id"]: r for r in redacted.collect()}
    assert set(got) == set(docs) and all((got[i]["text"] is None) == (t is None) for i, t in docs.items())
    for r in found.collect():
        assert marks[r["pii_type"]] in got[r["doc_id"]]["text"]
