"""Stored results and states: artifacts, reports, models and what they fall back to, requests for documents, jobs and keys."""

from pyspark.sql import functions as F

from paperlane.operators import access
from paperlane.operators import artifacts as A
from paperlane.operators import bayes as B
from paperlane.sources import files as S
from paperlane.streaming import ingest as I

ART = "doc_id long, kind string, body string"
ROWS = [
    (1, "validation", '{"errors": ["invalid_iban:iban", "missing_verified_required_field:datum", "missing_verified_required_field:naam", "missing_verified_required_field:soort"]}'),
    (1, "verified", '{"datum": {"verified": false}, "soort": {"verified": true}}'),
    (1, "result", '{"iban": "NL1", "datum": "1-1-2024", "soort": "x", "extra": {"a": [1]}}'),
    (2, "validation", '{"errors": ["invalid_iban:iban"]}'),  # never verified
    (2, "result", '{"iban": "NL1"}'),
    (3, "validation", '{"errors": ["invalid_iban:iban"]}'),
    (3, "verified", "{}"),
    (3, "result", '{"iban": "NL'),  # broken
    (4, "validation", "{}"),
    (4, "verified", "{}"),
    (4, "result", "{}"),
    (5, "validation", '{"errors": ["invalid_iban:iban"]}'),  # no result at all
    (5, "verified", "{}"),
    (6, "validation", '["invalid_iban:iban"]'),
    (6, "verified", "{}"),
    (7, "validation", None),
    (7, "verified", "{}"),
    (8, "result", '{"datum": null}'),
    (8, "validation", '{"errors": ["missing_verified_required_field:datum"]}'),
    (8, "verified", '{"datum": "odd"}'),
    (None, "verified", "{}"),
    (9, "risk", "{}"),
]


def test_findings(spark):
    rows = spark.createDataFrame([*ROWS, ROWS[0]], ART)
    got = {r.doc_id: (r.ready, r.invalid_ibans, r.unverified, [s.name for s in r.signals]) for r in A.metadata_findings(rows).collect()}
    nothing = (False, [], [], [])
    both = ["invalid_iban", "missing_verified_required_fields"]
    assert got == {
        1: (True, ["iban"], ["datum"], both),
        2: nothing,
        3: nothing,
        4: nothing,
        5: (False, ["iban"], [], both[:1]),
        6: nothing,
        7: nothing,
        8: (True, [], ["datum"], both[1:]),
        None: nothing,
    }
    assert A.metadata_findings(rows.limit(0)).count() == 0


def test_reports(spark):
    docs = [(1, 1.0, '["s"]'), (2, 2.0, '["s", {"a": 1}]'), (3, None, "[]"), (4, 4.0, None), (5, 5.0, "[broken"), (6, 6.0, '["s"]'), (None, 7.0, '["s"]')]
    kept = [
        (1, "fraud", '{"risk_score": 30.5, "signals": [{"name": "x"}, {"name": "y"}]}'),
        (1, "risk", '{"risk_score": 9}'),
        (2, "fraud", '{"risk_sc'),
        (6, "fraud", None),
        (6, "risk", '{"risk_score": 60}'),
    ]
    d = spark.createDataFrame(docs, "doc_id long, risk_score double, signals_json string")
    got = {r.doc_id: (r.origin, r.risk_score, r.n_signals) for r in A.stored_reports(d, spark.createDataFrame(kept, ART)).collect()}
    assert got == {1: ("cache", 30.5, 2), 2: ("database", 2.0, 2), 3: ("database", 0.0, 0), 4: (None, None, 0), 5: (None, None, 0), 6: ("artifact", 60.0, 0), None: ("database", 7.0, 1)}
    assert A.stored_reports(d.limit(0), spark.createDataFrame([], ART)).count() == 0


def test_artifacts_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, ART)
    A.write_artifacts(rows, f"{tmp_path}/a")
    same = lambda d: sorted(map(repr, d.select("doc_id", "kind", "body").collect()))
    assert same(A.read_artifacts(spark, f"{tmp_path}/a")) == same(rows)
    # A second run of one stage replaces that stage's artifacts only.
    A.write_artifacts(spark.createDataFrame([(9, "risk", '{"risk_score": 1}')], ART), f"{tmp_path}/a")
    got = A.read_artifacts(spark, f"{tmp_path}/a")
    assert [r.body for r in got.where("kind = 'risk'").collect()] == ['{"risk_score": 1}']
    assert same(got.where("kind <> 'risk'")) == same(rows.where("kind <> 'risk'"))


def test_text_files(spark, tmp_path):
    (tmp_path / "een.txt").write_text("regel één\nregel twee\n", encoding="utf-8")
    (tmp_path / "twee.txt").write_bytes(b"v\xc3\xb3\xc3\xb3r\xff na")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in S.text_files(spark, str(tmp_path)).collect()}
    assert got == {"een.txt": "regel één\nregel twee\n", "twee.txt": "vóór na"}
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"\xe2\x82")), (4, bytearray("\ufffd€".encode()))], "id int, content binary")
    assert {r.id: r.text for r in odd.select("id", S.decoded(odd["content"]).alias("text")).collect()} == {1: None, 2: "", 3: "", 4: "\ufffd€"}


def test_models_looked_up(spark):
    models = spark.createDataFrame([("a", 3), ("b", 0), ("default", 2)], "model string, labels long")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "default")], "id long, source string")
    look = lambda m: {r.id: r.model for r in B.looked_up(asked, m, "source").collect()}
    assert look(models) == {1: "a", 2: None, 3: "default", 4: "default", 5: "default"}
    assert look(models.where("model <> 'default'")) == {1: "a", 2: None, 3: None, 4: None, 5: None}
    assert set(look(models.limit(0)).values()) == {None}


def test_requests_for_documents(spark):
    docs = [(k, "done", 100, "done", None, "slip", 7) for k in range(1, 7)] + [(7, "error", 10, "x", "kapot", None, 7), (None, "done", 100, "done", None, "slip", 7)]
    d = spark.createDataFrame(docs, "doc_id long, status string, progress int, stage string, error_message string, doc_type_slug string, action int")
    asked = [
        (1, 1, "reprocess", 5),
        (2, 2, "analyse", 5),
        (3, 2, "cancel", 6),
        (4, 3, "cancel", 6),
        (5, 3, "reprocess", 6),  # the same time, the greater id
        (6, 4, "cancel", 9),
        (7, 5, "odd", 9),
        (8, None, "cancel", 9),
        (9, 99, "cancel", 9),
        (10, 7, "reprocess", 1),
        (10, 7, "reprocess", 1),
    ]
    r = spark.createDataFrame(asked, "request_id long, doc_id long, action string, at long")
    got = {x.doc_id: tuple(x)[1:6] + (x.queued,) for x in I.after_requests(d, r).collect()}
    same = ("done", 100, "done", None, "slip", False)
    assert got == {
        1: ("queued", 0, None, None, "slip", True),
        2: ("error", 0, None, I.CANCELLED, None, False),
        3: ("queued", 0, None, None, "slip", True),
        4: ("error", 100, "done", I.CANCELLED, "slip", False),
        5: same,
        6: same,
        7: ("queued", 0, None, None, None, True),
        None: same,
    }
    assert I.after_requests(d, r).columns == [*d.columns, "queued"] and I.after_requests(d.limit(0), r).count() == 0


def test_jobs(spark):
    jobs = [(1, None, "processing", "u"), (2, "x" * 2000, "processing", "u"), (3, "stuk", "done", None), (4, "stuk", None, ""), (5, None, None, "u"), (None, "", None, "u")]
    d = spark.createDataFrame(jobs, "doc_id long, failure string, status string, callback_url string")
    gone = spark.createDataFrame([(5,), (5,), (None,)], "doc_id long")
    got = {r.doc_id: (r.status, r.error_message, r.event, r.calls_back) for r in I.finished(d, gone).collect()}
    assert got == {1: ("done", None, "result", True), 2: ("error", "x" * 1000, "error", True), 3: ("done", None, "error", False), 4: ("error", "stuk", "error", False), None: ("error", "", "error", True)}


def test_keys(spark):
    keys = spark.createDataFrame([(4, 40, "a", True, None), (3, 30, "a", True, 200), (1, 10, "a", False, None), (5, 50, "b", True, 100), (6, 60, "c", None, None), (7, 70, None, True, None)], "key_id long, user_id long, s string, is_active boolean, expires_at long")
    keys = keys.withColumn("secret_hash", F.sha2("s", 256)).drop("s")
    shown = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "d"), (1, "a")], "user_id long, secret string")
    look = lambda at: sorted(map(str, ((r.user_id, r.key_id, r.owner) for r in access.checked_keys(shown, keys, F.lit(at)).collect())))
    assert look(100) == sorted(map(str, [(1, 3, 30), (1, 3, 30), (2, None, None), (3, None, None), (4, None, None), (5, None, None)]))
    assert look(200)[0] == "(1, 4, 40)" and "(2, 5, 50)" in look(99)
