"""Column functions on small literal inputs."""

import json

from pyspark.sql import functions as F

from paperlane.functions import jsonrepair as J
from paperlane.functions import text as T
from paperlane.functions import values as V
from paperlane.operators import candidates, catalog, dialogue, fraud, policy, prep, rules
from paperlane.sources import files
from paperlane.streaming import ingest


def one(spark, column, **values):
    d = spark.range(1)
    for k, v in values.items():
        d = d.withColumn(k, v if hasattr(v, "_jc") else F.lit(v))
    return d.select(column.alias("x")).first().x


def signal(spark, key, text):
    return one(spark, T.builtin_signal(key, T.prepared(F.col("t"))), t=text)


def test_signals(spark):
    assert signal(spark, "iban_present", "Betaling naar NL91ABNA0417164300") == 1
    assert signal(spark, "iban_present", "Geen IBAN hier") == 0
    assert signal(spark, "date_count", "01-02-2024\n03-04-2024\n05-06-2024") == 3
    assert signal(spark, "amount_count", "€1.234,56\n500,00\n€25,00") == 3
    rows = "01-02-2024 €5,00\n02-02-2024 €6,00\n03-02-2024 7,00\n€9,00"
    assert signal(spark, "date_amount_row_count", rows) == 3
    assert signal(spark, "line_count", "a\n\n b\n   \nc") == 3
    assert signal(spark, "token_count", "een twee  drie\nvier vijf zes zeven") == 7
    assert signal(spark, "nothing_known", "x") == 0


def test_user_signals(spark):
    assert one(spark, T.keyword_signal(F.col("t"), ["FACTUUR", "iban"], "any"), t="Een factuur") is True
    assert one(spark, T.keyword_signal(F.col("t"), ["factuur", "iban"], "all"), t="Een factuur") is False
    assert one(spark, T.keyword_signal(F.col("t"), [], "all"), t="x") is False
    assert one(spark, T.regex_signal(F.col("t"), [r"^b\d+$", "("]), t="a\nB12") is True
    assert one(spark, T.regex_signal(F.col("t"), ["("]), t="(") is False


def test_policy(spark):
    p = policy.parse({"requirements": [{"signal": "n", "op": ">=", "value": 3}], "exclusions": [{"signal": "x", "op": "==", "value": 1}]})
    d = spark.createDataFrame([(1, {"n": 3.0}), (2, {"n": 2.0, "x": 1.0})], "doc_id long, signals map<string, double>")
    got = {r.doc_id: (r.is_eligible, r.failed, r.triggered) for r in policy.eligibility(d, {"t": p}).collect()}
    assert got[1] == (True, [], [])
    assert got[2] == (False, ["n >= 3 (werkelijk: 2)"], ["x == 1 (werkelijk: 1)"])
    assert policy.parse("{") == policy.DEFAULT and policy.parse(None) == policy.DEFAULT
    assert policy.problems({"requirements": [{"signal": "a", "op": "~", "value": 1}], "acceptance": {"trained_model": {"min_margin": 2}}})


def test_iban_and_numbers(spark):
    ok = ["NL91ABNA0417164300", "DE89370400440532013000", "GB29NWBK60161331926819", "FR7630006000011234567890189", "nl91 abna 0417 1643 00"]
    bad = ["INVALID123456", "NL91ABNA0417164301", "XX12345678901234567890", ""]
    assert [one(spark, V.iban_valid(F.col("v")), v=x) for x in ok + bad] == [True] * 5 + [False] * 4
    assert one(spark, V.number(F.col("v")), v="1.500") == "1500" and one(spark, V.number(F.col("v")), v="1.5") == "1.5"
    assert one(spark, V.iso_date(F.col("v")), v="31-02-2024") is None
    assert one(spark, V.first_amount(F.col("v")), v="1.234,56") == 1.234 and one(spark, V.rule_amount(F.col("v")), v="3.5") == 35


def check_value(spark, kind, value, evidence="", unit=None, pattern=None):
    d = spark.createDataFrame([(value, evidence, pattern)], "v string, e string, p string")
    r = V.checked(d, F.lit(kind), F.col("v"), F.col("e"), F.lit(unit).cast("string"), F.array(F.lit("A"), F.lit("B")), 2025, F.col("p")).first()
    return (r.check_reason is None, r.check_reason, r.check_normalized)


def test_validate(spark):
    assert check_value(spark, "string", "INV-12", pattern=r"^inv-\d+$") == (True, None, "INV-12")
    assert check_value(spark, "string", "factuur", pattern=r"^inv-\d+$")[1] == "regex_mismatch"
    assert check_value(spark, "year", "98", pattern="x")[1] == "year_must_be_four_digits"
    assert check_value(spark, "year", "1998", "gebouwd in 1998") == (True, None, "1998")
    assert check_value(spark, "year", "01-02-1998")[1] == "year_value_looks_like_date"
    assert check_value(spark, "year", "1998", "datum 1998")[1] == "year_evidence_has_date_label"
    assert check_value(spark, "year", "2999")[1] == "year_out_of_range"
    assert check_value(spark, "area", "120", "oppervlakte 120") == (True, None, "120")
    assert check_value(spark, "area", "120", "getal 120", "m²") == (True, None, "120")
    assert check_value(spark, "area", "120", "getal 120")[1] == "area_missing_unit_or_context"
    assert check_value(spark, "enum", "a")[0] and check_value(spark, "enum", "C")[1] == "enum_value_not_allowed"
    assert check_value(spark, "boolean", "ja") == (True, None, "true") and check_value(spark, "boolean", "wel")[1] == "boolean_not_explicit"
    assert check_value(spark, "string", "onbekend")[1] == "empty_or_placeholder_value"


def test_rules(spark):
    t = [rules.parse_hints("ing", "kw: ing\nkw: bank\nre:NL\\d{2}INGB\nnot:factuur\nsaldo"), rules.parse_hints("factuur", "kw:factuur\nbtw")]
    assert (t[0].required, t[0].vetoes, t[0].optional) == (["ing", "bank"], ["factuur"], ["saldo"])
    assert one(spark, rules.strong(F.col("t"), t), t="ING Bank afschrift") == "ing"
    assert one(spark, rules.strong(F.col("t"), t), t="ING Bank factuur") == "factuur"
    assert one(spark, rules.deterministic(F.col("t"), t), t="niets") is None
    assert one(spark, rules.evidence_supported(F.col("e"), F.col("t")), e='"Totaal bedrag"', t="Het totaal  bedrag is") is True
    assert one(spark, rules.evidence_supported(F.col("e"), F.col("t")), e="heel iets anders", t="Het totaal bedrag") is False


def test_fraud(spark):
    s = F.array(F.struct(F.lit("a").alias("name"), F.lit("MEDIUM").alias("risk_level"), F.lit(0.84).alias("confidence"), F.lit("").alias("category")))
    assert abs(one(spark, fraud.score(F.col("s")), s=s) - 50.4) < 1e-9
    assert one(spark, fraud.level(F.col("s"), F.lit(50.4)), s=s) == "HIGH"
    assert one(spark, fraud.anomaly(F.col("t")), t="test word " * 100) > 0.39
    assert one(spark, fraud.anomaly(F.col("t")), t="") == 1.0
    m = one(spark, fraud.semantic(F.lit("invoice"), F.lit("contract"), F.lit(0.84), F.lit(0.16)))
    assert (m.risk_level, m.confidence) == ("MEDIUM", 0.84)


def test_chunks():
    t = "".join(f"zin {i}. " for i in range(900))
    spans = prep.chunk_spans(t)
    assert spans[0][0] == 0 and all(e - s <= 2500 for s, e in spans) and spans[-1][1] == len(t)
    assert all(b[0] == a[1] - 300 for a, b in zip(spans, spans[1:])) and prep.chunk_spans("kort") == [(0, 4)]


def test_catalog(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a")], "id long, sha256 string")
    assert {r.id: r.duplicate_of for r in catalog.duplicate_of(d).collect()} == {1: 2, 2: 1, 3: None, 4: None, 5: 1}
    old = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "key string, v int, builtin boolean")
    new = spark.createDataFrame([("a", 9), ("b", None), ("c", 3)], "key string, v int")
    assert {r.key: r.v for r in catalog.upsert(old, new, ["key"], "builtin").collect()} == {"a": 1, "b": 2, "c": 3}


def test_json_repair():
    load = lambda t: json.loads(J.repair(t))
    assert load('```json\n{"a": 1}\n```') == {"a": 1}
    assert load('{"data": {"x": "half') == {"data": {"x": "half"}}
    assert load('{"a": [1, 2, {"b": true') == {"a": [1, 2, {"b": True}]}
    assert load('tekst {"a": 1,} tekst') == {"a": 1}
    assert load('{"data": {"a": null}, "evidence": {"a": [1]}} {"data": {"a": "v"}, "evidence": {"a": [2]}}') == {"data": {"a": "v"}, "evidence": {"a": [1, 2]}}
    assert J.repair("niets") is None and J.objects('{"a": "}"} {') == ['{"a": "}"}']


def test_dialogue_and_files(spark):
    m = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A"), (2, 0, "system", "S")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(x.role, x.text) for x in r.messages] for r in dialogue.merged_roles(m).collect()}
    assert got == {1: [("user", "S\n\nU"), ("assistant", "A")], 2: [("user", "S")]}
    assert one(spark, dialogue.tokens(F.lit(350), F.lit(2))) == 156
    assert one(spark, files.safe_name(F.col("n")), n="../a/b<c>.pdf") == "b_c_.pdf"
    assert one(spark, ingest.progress(F.lit("extracting_text"), F.lit(0), F.lit(2))) == 27


def test_resolver(spark):
    rows = [(1, "bouwjaar", "Bouwjaar", "number", v, v, None, e, None, c, 90.0, t, r, c) for v, e, c, t, r in (("", "x", 0, "exact_label", "background"), ("1975", "Bouwjaar 1975", 3, "exact_label", "primary"), ("1980", "iets 1980", 1, "ambiguous", "unknown"))]
    d = spark.createDataFrame(rows, "doc_id long, field_key string, label string, field_type string, value string, normalized_value string, unit string, evidence string, enum_values array<string>, chunk_index int, confidence double, evidence_type string, record_role string, ord long")
    r = candidates.resolve(d, 2025).first()
    assert (r.value, r.n_valid, r.n_rejected) == ("1975", 2, 1)


def test_stream_equals_batch(spark, tmp_path):
    jobs = spark.createDataFrame([(i % 7, f"2024-01-01 00:00:{i:02d}") for i in range(30)], "id long, at string").withColumn("at", F.to_timestamp("at"))
    jobs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(ingest.read_queue(spark, str(tmp_path / "in"), "id long, at timestamp"), "id", "at")
    gone = lambda: spark.createDataFrame([(3,)], "id long")
    ingest.run_jobs(stream, lambda b: b.withColumn("status", F.lit("done")), gone, "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [0, 1, 2, 4, 5, 6]


def test_norm_text(spark, tmp_path):
    """Whole texts by NFKD, as the reference does: the double acute, a ligature, full width, far beyond 200 characters."""
    from paperlane.plans import more

    rows = [(1, "Ő\ufb01 Ａb é ß"), (2, "x" * 300 + "É"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.letters) for r in more.norm_text(spark, str(tmp_path)).collect()}
    assert got == {1: (9, 6), 2: (301, 301), 3: (None, None), 4: (0, 0)}
