"""Chunk scores and selection on worked cases."""

import contextlib
import io

from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperlane.functions import text as T
from paperlane.operators import candidates as C
from paperlane.operators import relevance as L
from paperlane.operators import rules as R

FIELDS = [L.Field("bouwjaar", "Bouwjaar", "number"), L.Field("oppervlakte", "Oppervlakte (m2)", "number"), L.Field("status", "Status", "enum", ("open", "dicht")), L.Field("ref", "Referentie", "string", (), r"INV-\d+")]
ROWS = [
    (1, 0, "Bouwjaar: 1998, volgens opgave van de eigenaar. Oppervlakte 120 m2, aldus de makelaar."),
    (1, 1, "Het bouwjaar is niet bekend, uitleg volgt in een latere bijlage van dit stuk."),
    (1, 2, "INV-123 zonder naam erbij en zonder verdere woorden die ertoe doen hier"),
    (1, 3, "Status: open. " + "x " * 30),
    (1, 4, "kort"),
    (2, 0, "niets te zien hier, alleen wat tekst die nergens over gaat en ophoudt"),
    (2, 1, ""),
]


def chunks(spark):
    return spark.createDataFrame(ROWS, "doc_id long, part int, chunk string")


def test_scores(spark):
    got = {(r.doc_id, r.part): r for r in L.scored(chunks(spark), FIELDS, 2025).collect()}
    # Two labels with values: 100 + 50 + 120 each, 150 for the cluster, 20 for several fields.
    assert got[1, 0].score == 710 and [(m.field, m.label_score, m.value_score) for m in got[1, 0].matches] == [("bouwjaar", 150, 120), ("oppervlakte", 150, 120)]
    assert got[1, 0].matches[1].places == [48, 64]
    # A label that is only explained: 100 + 50 + 20 - 60.
    assert got[1, 1].score == 110
    assert got[1, 2].score == 5 and got[1, 2].matches[0].regex_only
    assert got[1, 3].score == 270 and got[1, 4].score == -20 and got[2, 1].score == -20
    many = spark.createDataFrame([(1, 0, " ".join(map(str, range(25)))), (1, 1, "disclaimer " * 9)], "doc_id long, part int, chunk string")
    assert [r.score for r in L.scored(many, FIELDS, 2025).orderBy("part").collect()] == [-80, -50]


def test_select(spark):
    pick = lambda n: {(r.doc_id, r.part): r.reason for r in L.select(chunks(spark), FIELDS, 2025, budget=n).collect()}
    assert pick(900) == {
        (1, 0): "best_for_field:bouwjaar", (1, 2): "regex_fallback_for_field:ref", (1, 3): "best_for_field:status",
        (1, 4): "context_neighbor", (2, 0): "fill_budget_by_score", (2, 1): "context_neighbor",
    }
    # A chunk that only explains is no neighbour, and what goes over the budget goes last by score.
    assert pick(200) == {(1, 0): "best_for_field:bouwjaar", (1, 3): "best_for_field:status", (2, 0): "fallback_no_concrete_chunk", (2, 1): "context_neighbor"}
    only = spark.createDataFrame([(3, 0, "Bouwjaar onbekend, zie de andere stukken die later volgen in het dossier")], "doc_id long, part int, chunk string")
    assert [r.reason for r in L.select(only, FIELDS, 2025, budget=100).collect()] == ["label_only_fallback_for_field:bouwjaar"]
    assert L.select(only.limit(0), FIELDS, 2025).count() == 0


def test_near_values(spark):
    near = lambda text, f: spark.createDataFrame([(text,)], "t string").select(L.near_values(F.col("t"), F.lit(0), f, 2025)).first()[0]
    assert near("Status: Dicht, of toch open", FIELDS[2]) == ["open", "dicht"]
    assert near("Akkoord: ja, later NEE", L.Field("akkoord", "Akkoord", "boolean")) == ["ja", "NEE"]
    assert near("Naam: Jan de Vries; oud", L.Field("naam", "Naam")) == ["Jan de Vries"]
    assert near("Bouwjaar 1998, 12, 3000", FIELDS[0]) == ["1998"]
    assert near("Aantal 1.500 en 12,5", L.Field("aantal", "Aantal", "number")) == ["1500", "12.5"]
    assert near("datum 12", L.Field("dag", "Dag", "date")) == []


def test_rejected_candidates(spark):
    row = lambda value, evidence, kind="exact_label", chunk=0, ord_=0, conf=90.0: (1, "ref", "Referentie", "string", value, value, None, evidence, None, chunk, conf, kind, "primary", ord_, r"^INV-\d+$")
    rows = [row("INV-1", "Referentie: INV-1"), row("INV-2", "staat INV-2", "semantic", 1, 1, 10.0), row("factuur", "Referentie: factuur", ord_=2), row("INV-3", "elders", ord_=3)]
    schema = "doc_id long, field_key string, label string, field_type string, value string, normalized_value string, unit string, evidence string, enum_values array<string>, chunk_index int, confidence double, evidence_type string, record_role string, ord long, regex string"
    r = C.resolve(spark.createDataFrame(rows, schema), 2025).first()
    assert (r.value, r.score, r.n_valid, r.n_rejected) == ("INV-1", 213.0, 2, 2)
    assert [(x.value, x.reason) for x in r.rejected] == [("INV-2", None), ("factuur", "regex_mismatch"), ("INV-3", "value_not_in_evidence")]
    r = C.resolve(spark.createDataFrame(rows[1:], schema), 2025).first()
    assert r.value is None and [x.value for x in r.rejected] == ["INV-2", "factuur", "INV-3"]


def plan(d) -> str:
    with contextlib.redirect_stdout(out := io.StringIO()):
        d.explain("extended")
    return out.getvalue().split("== Physical Plan ==")[1]


def test_filters_work_nothing_out_again(spark):
    """A filter on a result is not moved below the columns that it reads (fx_candidate_score, fx_same_line)."""
    for name in ("fx_candidate_score", "fx_same_line"):
        assert "Filter " not in plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))


def test_same_line(spark):
    fields = [L.Field("aantal", "Aantal", "number"), L.Field("naam", "Naam")]
    rows = [(1, "Aantal: 1.500 Naam: een twee drie vier vijf zes"), (2, "naam - een  twee drie vier vijf zes zeven AANTAL: veel"), (3, "Naam: : ;"), (4, None), (5, "Naam: Aantal: 7")]
    got = L.same_line(spark.createDataFrame(rows, "id int, t string"), fields, 2025).collect()
    assert sorted((r.id, r.field, r.value) for r in got) == [(1, "aantal", "1500"), (1, "naam", "een twee drie vier vijf zes"), (5, "aantal", "7")]


def test_places(spark):
    at = lambda text, labels: spark.createDataFrame([(text,)], "t string").select(L.places(F.col("t"), L.place_pattern(labels))).first()[0]
    assert at("Part part \U0001f600PART, Parts", ["Part", "part"]) == [0, 5, 11]
    # A control character is no place.
    assert at("a\x01b Part", ["Part"]) == [4]
    assert at("bouw jaar bouw", ["bouw", "bouw jaar"]) == [0, 10] and at("niets", ["Part"]) == []


def test_chunk_scores_read_a_chunk_once(spark):
    """What several points need is worked out once: each name's places are sought in one expression of the plan (fx_chunk_score, fx_chunk_select)."""
    d = L.scored(chunks(spark), [L.Field("ref", "Referentie")], 2025)
    assert plan(d).lower().count("breferentie") == 1


def test_prompts_read_a_chunk_once(spark):
    """The normal form of a chunk is not made again for each field (fx_prompt_pack), nor its labels' places sought again (fx_clip)."""
    d = chunks(spark).withColumn("page", F.lit(0))
    fields = [L.Field(k, k) for k in ("aantal", "naam", "straat", "plaats")]
    made = lambda n: plan(L.pack_prompt(d, fields[:n], 2025)).count("THEN translate(")
    assert made(2) == made(4)
    assert plan(L.clipped(d, [L.Field("iban", "IBAN", "iban")], 2025)).lower().count("biban") == 1


def test_normal_form_of_rare_signs(spark):
    signs = ["€ 5 ½", "“Straße” – £3 …", "ａｂｃ é", "\U0001d54f\u0301 ﬁ €", "abc•d"]
    got = spark.createDataFrame([(s,) for s in signs], "t string").select("t", T.search_text(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [T.plain(r.t) for r in got]


def test_best_type_is_worked_out_once(spark):
    """Each type's score is made once (cls_deterministic); a shared best has no winner."""
    types = [R.parse_hints("a", "kw:woord\nre:x\\d"), R.parse_hints("b", "kw:ander"), R.parse_hints("c", "iets")]
    d = spark.createDataFrame([(1, "Woord en ander"), (2, "woord X1 ander"), (3, "IETS"), (4, "niets van dit al"), (5, None), (6, "leeg")], "id int, t string").select("id", R.deterministic(F.col("t"), types).alias("slug"))
    assert {r.id: r.slug for r in d.collect()} == {1: None, 2: "a", 3: "c", 4: "c", 5: None, 6: None}
    assert plan(d).count("woord") == 1
