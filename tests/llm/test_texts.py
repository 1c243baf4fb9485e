import random

import pytest
from pyspark.sql import functions as F

from strandmill.llm import mixing, personal, tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(tokens.read_ranks(f.read()))


@pytest.fixture(scope="module")
def other(encoder):
    return tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=encoder.ranks, special_tokens={})


def test_encoding_equals_the_library(encoder, other):
    rng = random.Random(1)
    texts = ["", " ", "\n\n  x", "It's 3.50€ — naïve ①½²!", "日本語 テキスト", "<|endoftext|>", "a" * 3000, "=" * 500, "\x00\x1c\x85​", "é̈ \U0001f469‍\U0001f52c"]
    texts += ["".join(rng.choices("abAB'stve 09\n\t.,_-éßñ①²日本ー‍\x85　", k=40)) for _ in range(1500)]
    for text in texts:
        ids = list(encoder.encode(text))
        assert ids == other.encode_ordinary(text)
        assert encoder.decode(ids) == text and encoder.count(text) == len(ids)


def test_memory_of_pieces_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 50)
    fresh = tokens.Encoder(encoder.ranks)
    for i in range(500):
        list(fresh.encode(f"zq{i}xj"))
    assert len(fresh) <= 51


def test_token_ids(spark, other):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "x y " * 20_000), (1, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokens.token_ids(df).collect())
    assert got == sorted((i, other.encode_ordinary(t) if t else []) for i, t in rows)
    assert tokens.token_ids(df.limit(0)).count() == 0


# ---- 8: mixing ---------------------------------------------------------------------------------------------------


def test_budgets():
    assert mixing.budgets({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}) == {"a": 100, "b": 100}
    got = mixing.budgets({"a": 1000, "b": 10, "c": 500}, {"a": 0.4, "b": 0.2, "c": 0.4}, {"a": 1, "b": 3, "c": 2}, total=600)
    assert got["b"] == 30 and got["a"] == pytest.approx(285) and sum(got.values()) == pytest.approx(600)
    assert mixing.budgets({}, {"a": 1.0}, {"a": 2}) == {"a": 0.0}


def test_mixture(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(5, 40))), "Big_Source" if i % 3 else " big-source ") for i in range(600)]
    rows += [(1000 + i, " ".join(word() for _ in range(12)), "small") for i in range(20)]
    rows += [(2000 + i, rows[0][1], "small") for i in range(40)]  # copies of a text of the other source
    rows += [(3000, None, "small"), (3001, "", "small"), (3002, "some text", None), (3003, "some text too", "elsewhere")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("key", F.lit(1)).withColumn("slice", F.lit("s"))
    targets = spark.createDataFrame([("big-source", 0.5, 1), ("Small", 0.5, 3), ("none", 0.2, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    total = 3000.0
    mix = mixing.Mixture(docs, targets, total=total)
    uses = {r["doc_id"]: r for r in mix.uses().collect()}
    assert all(r["uses"] <= (3 if r["source"] == "small" else 1) for r in uses.values())
    assert not any(2000 <= i < 2040 or i >= 3000 for i in uses)
    report = {r["source"]: r for r in mix.report().collect()}
    assert set(report) == {"big-source", "small", "none"} and report["none"]["used_tokens"] == 0
    for s in ("big-source", "small"):
        r = report[s]
        assert r["used_tokens"] <= r["budget"] and r["used_tokens"] > r["budget"] - 400
        assert r["used_tokens"] == sum(u["n_tokens"] * u["uses"] for u in uses.values() if u["source"] == s)
    again = {r["doc_id"]: r["uses"] for r in mixing.Mixture(docs.repartition(7), targets, total=total).uses().collect()}
    assert again == {i: r["uses"] for i, r in uses.items()}
    assert mixing.Mixture(docs.limit(0), targets).report().count() == 3


def test_small_source_runs_whole_epochs(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of the small one", "s") for i in range(10)] + [(100 + i, f"a text of the other {i}", "t") for i in range(10)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("s", 0.5, 5), ("t", 0.5, 5)], "source string, target_share double, max_repeats int")
    sizes = mixing.Mixture(docs, targets).sizes
    uses = [r["uses"] for r in mixing.Mixture(docs, targets, total=sizes["s"][0] * 5.0).uses().where("source = 's'").collect()]
    assert len(uses) == 10 and set(uses) == {2, 3}


# ---- 9: personal information -------------------------------------------------------------------------------------

NAMES = [("Mark", "given"), ("June", "given"), ("Zoë", "given"), ("Grünhagel", "family"), ("Honteville", "family"), ("Varnholt", "family"), (None, "given")]


def items(text):
    return [(kind, text[a:b]) for a, b, kind in personal.Finder([n for n in NAMES if n[0]]).spans(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("write to a.b+c@lists.site.test.", [("email", "a.b+c@lists.site.test")]),
        ("mailto:a@b.test or <c@d.example>", [("email", "a@b.test"), ("email", "c@d.example")]),
        ("x.y (at) post (dot) site (dot) test, and q AT site DOT example now", [("email", "x.y (at) post (dot) site (dot) test"), ("email", "q AT site DOT example")]),
        ("x[at]site.test", [("email", "x[at]site.test")]),
        ("a dot is at the end; look AT noon", []),
        ("tag build@23 and @lab_team", []),
        ("Message-ID: <a.b@c.example>\r\nReferences: <d@e.test>\r\n <f@g.test>\r\nFrom: h@i.test", [("email", "h@i.test")]),
        ('<img src="cid:img1@part.test">', []),
        ("fax +44 (0)20 7946 0654 or 07700 900440", [("phone", "+44 (0)20 7946 0654"), ("phone", "07700 900440")]),
        ("tel:+1-617-555-0144, (206) 555 0180; 030 / 23125-123. 01.99.00.16.67", [("phone", "+1-617-555-0144"), ("phone", "(206) 555 0180"), ("phone", "030 / 23125-123"), ("phone", "01.99.00.16.67")]),
        ("2024-05-17, 10.16.14.33, 1201-1288, PO-92875/3, 62,993 lines", []),
        ("six one seven five five five oh one four four", [("phone", "six one seven five five five oh one four four")]),
        ("tax id 923-07-0894, DNI 60216467L, QQ 52 76 13 C, 41 567 887 870", [("id_number", "923-07-0894"), ("id_number", "60216467L"), ("id_number", "QQ 52 76 13 C"), ("id_number", "41 567 887 870")]),
        ("with ESMTP id 28F4C5DD; LT59-7105K", []),
        ("at 97b Ostrel Lane, 28243 X", [("address", "97b Ostrel Lane")]),
        ("185 bis rue du Almendral, T", [("address", "185 bis rue du Almendral")]),
        ("Rua das Cerisaie, 210, Saint; Calle Vignes 59; Birkenaustr. 228b", [("address", "Rua das Cerisaie, 210"), ("address", "Calle Vignes 59"), ("address", "Birkenaustr. 228b")]),
        ("lane 16 looks weak; the way 3 went", []),
        ("MARK GRÜNHAGEL, Honteville, June and Zoë B. Varnholt", [("name", "MARK GRÜNHAGEL"), ("name", "Honteville, June"), ("name", "Zoë B. Varnholt")]),
        ("mark the end of june; Varnholt Ltd, june.varnholt@x.test", [("email", "june.varnholt@x.test")]),
        ("Die\n> > June\n> > Varnholt", [("name", "June\n> > Varnholt")]),
        ("June\n\nVarnholt", []),
        ("Ｊune Varnholt und mаrk@site.test", [("name", "Ｊune Varnholt"), ("email", "mаrk@site.test")]),
        ("reach me at john (at) mail (dot) org", [("email", "john (at) mail (dot) org")]),
        ("write x (at) y (dot) org; we host it at example.org", [("email", "x (at) y (dot) org")]),
        ("look at mail.org, ask q (at) z (dot) org", [("email", "q (at) z (dot) org")]),
        ("call me at 555-123-4567, or x (at) y (dot) org or at jane@example.org; June Varnholt at home", [("phone", "555-123-4567"), ("email", "x (at) y (dot) org"), ("email", "jane@example.org"), ("name", "June Varnholt")]),
        ("jane AT example.org but LOOK AT MAIL.ORG; bob@mail (dot) org", [("email", "jane AT example.org"), ("email", "bob@mail (dot) org")]),
        ("l" * 400 + "@site.test", [("email", "l" * 400 + "@site.test")]),
        ("12 Upper Very Long Named Saint Bartholomew Street", [("address", "12 Upper Very Long Named Saint Bartholomew Street")]),
        ("in 12 Upper, Long Street", []),
        ("555 one two three 4567; five, five, five, one, two, three, four, five, six, seven", [("phone", "555 one two three 4567"), ("phone", "five, five, five, one, two, three, four, five, six, seven")]),
        ("passport no. X 1234567; NIE X1234567L; order no. 12345678Z; file 123.456.789-09, CPF 123.456.789-09", [("id_number", "X 1234567"), ("id_number", "X1234567L"), ("id_number", "123.456.789-09")]),
        ("June Varnholt Logistics, June Varnholt & Sons, June Varnholt Cold Store Ltd", []),
        ("Regards,\nJune Varnholt\nStores\n\nso June\nVarnholt\nStores it is", [("name", "June Varnholt")]),
        ("soft =\nbreak June =\nVarnholt", [("name", "June =\nVarnholt")]),
        ("", []),
    ],
)
def test_items(text, want):
    assert items(text) == want


#: Texts written after the patterns, with other organisations, phrases and forms than the test tables have.
UNSEEN = [
    ("Hi team, please loop in June Varnholt from accounting; her cell is (415) 555-0132.", ["name June Varnholt", "phone (415) 555-0132"]),
    ("Mark Honteville Architects won the tender, so Mark Honteville is happy.", ["name Mark Honteville"]),
    ("Invoice 2023-00417 from Varnholt Brothers, due 12/05/2024, total 4.310,55 EUR", []),
    ("my address: 1600 Amber Hollow Road, Apt 4", ["address 1600 Amber Hollow Road"]),
    ("Ich wohne in der Kastanienallee 17, Tel. 0221 4710 815, Steuer-ID 12 345 678 901.", ["address Kastanienallee 17", "phone 0221 4710 815", "id_number 12 345 678 901"]),
    ("Mon numéro fiscal est le 30 23 217 600 053 et j'habite 8 rue des Lilas.", ["id_number 30 23 217 600 053", "address 8 rue des Lilas"]),
    ("Escríbeme a lucia.perez@correo.example o llama al +34 912 345 678.", ["email lucia.perez@correo.example", "phone +34 912 345 678"]),
    ("DNI: 53127788K, Calle Mayor 14", ["id_number 53127788K", "address Calle Mayor 14"]),
    ("O meu CPF é 529.982.247-25 e o e-mail ana (arroba) casa (ponto) example", ["id_number 529.982.247-25", "email ana (arroba) casa (ponto) example"]),
    ("The build 20240517.3 failed on node-17 at 10:42:07; see ticket 48812213.", []),
    ("Coordinates 51.5074 -0.1278, sensor 8812-99, batch XK1234567", []),
    ("her SSN was 219-09-9999 on the W-2", ["id_number 219-09-9999"]),
    ("Passport number 533401172 expires in May.", ["id_number 533401172"]),
    ("VARNHOLT, Mark", ["name VARNHOLT, Mark"]),
    ("Honteville, Zoë (interim) signed; Zoë K. Honteville countersigned", ["name Honteville, Zoë", "name Zoë K. Honteville"]),
    ("Ping june_v at post dot example if the pager is silent", ["email june_v at post dot example"]),
    ("We met at noon at the lab dot matrix printer", []),
    ("contact: sales@firm.example, +1 212 555 0188", ["email sales@firm.example", "phone +1 212 555 0188"]),
    ("Fax 030/1234567, Büro Lange Straße 99", ["phone 030/1234567", "address Lange Straße 99"]),
    ("Grünhagel und Söhne liefern; Mark Grünhagel nicht", ["name Mark Grünhagel"]),
    ("Dr. Zoë Varnholt (she/her), 22 Baker Close", ["name Zoë Varnholt", "address 22 Baker Close"]),
    ("NI number QQ123456C, born 1980-02-30", ["id_number QQ123456C"]),
    ("SKU AB1234567, serial no. C12345678", []),
    ("Git commit 9fceb02 by june@host.example touched 3 files", ["email june@host.example"]),
    ("Mark Varnholt Foundation grants", []),
    ("Zoë Grünhagel & Partner lädt ein", []),
    ("Kontakt: Mark Grünhagel, Am Ring 5", ["name Mark Grünhagel", "address Am Ring 5"]),
    ("Call 020 7946 0018 or 07911 123456 after six", ["phone 020 7946 0018", "phone 07911 123456"]),
    ("zero one six three five five five oh one two three is the hotline", ["phone zero one six three five five five oh one two three"]),
    ("one two three testing", []),
    ("Numéro de sécurité sociale : 2 85 05 78 006 084 36", ["id_number 2 85 05 78 006 084 36"]),
    ("habito en Avenida de la Constitución 3 y mi pasaporte es AAB123456", ["address Avenida de la Constitución 3", "id_number AAB123456"]),
]


def test_unseen_texts():
    """Recall and precision on texts that the patterns were not written for: 0.9 at least."""
    hit = found = true = 0
    for text, want in UNSEEN:
        got = [f"{kind} {item}" for kind, item in items(text)]
        hit, found, true = hit + len(set(got) & set(want)), found + len(got), true + len(want)
    print("recall", hit / true, "precision", hit / found)
    assert hit / true >= 0.9 and hit / found >= 0.9


def test_base64_holds_nothing():
    block = "\n".join(["A" * 30 + "+16175550144" + "B" * 34] * 3)
    assert items(f"head\n\n{block}\n\nJune Varnholt") == [("name", "June Varnholt")]


def test_tables(spark):
    docs = spark.createDataFrame([(1, "Mail a@b.test, a@b.test. June Varnholt!"), (2, None), (3, ""), (4, "x " * 100_000 + "c@d.test"), (1, "Mail a@b.test, a@b.test. June Varnholt!")], "doc_id bigint, text string").withColumn("found", F.lit("?"))
    names = spark.createDataFrame(NAMES, "name_part string, part_kind string")
    got = sorted(tuple(r) for r in personal.personal_items(docs, names).collect())
    assert got == [(1, "email", "abtest"), (1, "name", "junevarnholt"), (4, "email", "cdtest")]
    types = spark.createDataFrame([("email", "[EMAIL]"), ("name", "[NAME]"), ("phone", None)], "pii_type string, placeholder string")
    red = {r["doc_id"]: (r["text"], r["n_items"]) for r in personal.redacted(docs, names, types).collect()}
    assert red[1] == ("Mail [EMAIL], [EMAIL]. [NAME]!", 3) and red[2] == (None, 0) and red[3] == ("", 0)
    assert red[4][0].endswith("[EMAIL]") and len(red[4][0]) == 200_007
    assert personal.personal_items(docs.limit(0), names).count() == 0 and personal.personal_items(docs, names.limit(0)).where("pii_type = 'name'").count() == 0
