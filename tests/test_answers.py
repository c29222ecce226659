"""Models' answers, calls, evidence, clips and office files on worked cases and against plain versions."""

import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlane.functions import answers as A
from paperlane.functions import jsonrepair as J
from paperlane.functions import text as T
from paperlane.operators import candidates as C
from paperlane.operators import decisions
from paperlane.operators import models as M
from paperlane.operators import relevance as L
from paperlane.sources import files, office


def test_merge():
    assert J.merge([]) is None
    assert J.merge([{"data": {"a": None, "b": 0}}, {"data": {"a": 1, "b": 2, "c": ""}}, {"data": {"a": 3}}]) == {"data": {"a": 1, "b": 2, "c": ""}}
    assert J.merge([{"evidence": {"a": [1], "b": "x"}}, {"evidence": {"a": [2], "b": [3], "c": None, "d": []}}]) == {"evidence": {"a": [1, 2], "b": "x"}}
    assert J.merge([{"data": []}, {"evidence": None}]) == {"data": [], "evidence": None}
    assert J.merge([{"evidence": {}}, {"data": {}}]) == {"data": {}, "evidence": {}}
    assert J.merge([{"x": 1}, {"x": 2, "y": 3}]) == {"x": 2, "y": 3} and J.merge([{"x": 1}, {"y": 2}, {"z": 3}]) == {"x": 1}
    assert J.all_objects('a {"x": 1,} b {"y": "}"} c {"z": ') == [{"x": 1}, {"y": "}"}]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None), ("", None), ("geen", None), ('{"a": 1}', {"a": 1}), ("[1]", [1]), ('zie {"a": "}"} en {"b": 2}', {"a": "}"}),
        ('- x {"a" 1} {"data": {"k": 1}} {"data": {"k": 1, "l": 2}}', {"data": {"k": 1, "l": 2}}),
        ('{"data": {"k": 1', {"data": {"k": 1}}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}),
    ],
)
def test_parse(text, want):
    assert A.parse(text) == want


def test_finished():
    assert A.finished({"data": {"a": "null", "b": "NULL", "c": 1}}) == {"data": {"a": None, "b": None, "c": 1}, "evidence": {}}
    assert A.finished({"data": {"a": 1, "evidence": "null"}}) == {"data": {"a": 1}, "evidence": {}}
    assert A.finished({"data": {"a": 1, "evidence": {"a": []}}, "evidence": {}}) == {"data": {"a": 1, "evidence": {"a": []}}, "evidence": {}}
    items = [{"quote": "is X1"}, {"quote": "x"}, "los", {"quote": "anders"}]
    assert A.finished({"data": {"n": None, "a": "x1", "b": "is x1 en x"}, "evidence": items})["evidence"] == {"n": [], "a": items[:2], "b": []}
    assert A.finished([1]) == [1]


def test_schema():
    f = [L.Field("a", "A", "number", required=True), L.Field("b", "B", "enum", ("x",)), L.Field("d", "D", "date"), L.Field("energylabel", "E")]
    s = A.schema_of(f)
    data = s["properties"]["data"]
    assert data["required"] == ["a"] and data["properties"] == {"a": {"type": "number", "description": "A"}, "b": {"type": "string", "description": "B", "enum": ["x"]}, "d": {"type": "string", "description": "D", "format": "date"}, "energylabel": {"type": "string", "description": "E"}}
    assert A.schema_error({"data": {}, "evidence": {}}, s) is None and A.schema_error({"data": {}}, s) == "missing:evidence" and A.schema_error({"data": [], "evidence": {}}, s) == "type:data"
    assert A.schema_error({"a": True}, data) is None and A.schema_error({"a": None}, data) == "type:a" and A.schema_error("a", data) == "no_object"
    c = A.candidate_schema(f)["properties"]["candidates"]
    assert c["required"] == ["a", "b", "d", "energielabel"] and len(c["properties"]["a"]["items"]["required"]) == 8
    assert A.schema_error({"x": None}, {"properties": {"x": {"type": ["string", "null"]}}}) is None


def test_candidates(spark):
    assert A.candidates_in({"candidates": {"k": {"value": 5, "confidence": "veel"}}}, ["k"]) == [{"field_key": "k", "value": "5", "normalized_value": None, "unit": None, "evidence": "", "confidence": 0.0, "evidence_type": "ambiguous", "record_role": "unknown"}]
    assert [c["evidence"] for c in A.candidates_in({"data": {"a": 1, "b": "x", "c": "N/A", "d": "y"}, "evidence": {"a": {"quote": "q"}, "b": ["r"], "d": []}}, list("abcd"))] == ["q", "r", "y"]
    assert A.candidates_in(None, ["a"]) == A.candidates_in({"candidates": {"a": None}}, ["a"]) == []
    rows = [(1, 0, 'x {"candidates": {"k": ["NL12"]}}', "Rekening\nNummer: NL12\nSaldo 5"), (1, 1, None, "c"), (2, 0, '{"candidates": {"k": [{"value": "7", "evidence": "los"}]}}', None)]
    got = C.from_answers(spark.createDataFrame(rows, "doc_id long, chunk_index int, answer string, chunk string"), ["k"]).collect()
    assert {(r.doc_id, r.value, r.evidence) for r in got} == {(1, "NL12", "NL12"), (2, "7", "los")}


def test_verified(spark):
    pages = spark.createDataFrame([(1, 0, "Totaal € 12.500 en 7"), (1, 1, "Jan  de\nVries 12500"), (1, 2, "JAN DE VRIES"), (1, 3, None)], "doc_id long, page int, text string")
    ask = [("12500", None), ("12.500", None), ("jan de vries", None), ("Jan de Vries", None), ("7", None), ("1,5", None), (None, None), ("weg", (0, 0, 6)), ("laat", (0, 30, 31)), ("elders", (9, 0, 1)), ("9 9", None)]
    rows = [(1, v, *(s or (None,) * 3)) for v, s in ask]
    got = {r.value: (r.method, r.page, r.snippet) for r in C.verified(pages, spark.createDataFrame(rows, "doc_id long, value string, page int, start int, end int")).collect()}
    assert got == {
        # The first page decides: there the number stands with its point, on the next as it is.
        "12500": ("auto_found_number_format", 0, "12.500"), "12.500": ("auto_found", 0, "12.500"), "jan de vries": ("auto_found_normalized", 1, "jan de vries"), "Jan de Vries": ("auto_found_normalized", 1, "Jan de Vries"),
        "7": ("auto_found", 0, "7"), "1,5": ("auto_found_number_format", 0, "2"), None: ("none", None, None), "weg": ("evidence", 0, "Totaal"), "laat": ("none", None, None), "elders": ("none", None, None), "9 9": ("none", None, None),
    }


def test_fixed_pages(spark):
    pages = spark.createDataFrame([(1, 0, "Naam Jansen woont hier"), (1, 1, "Adres Dorpsstraat twaalf"), (1, 2, "adres DORPSSTRAAT twaalf en meer")], "doc_id long, page int, text string")
    ask = [("Adres Dorpsstraat", 2, 2), ("adres dorpsstraat", 0, 1), ("Dorpsstraat ligt adres twaalf", 0, 1), ("geheel iets anders dan dit", 0, 0), ("Adres", 0, 0), ("Jansen  hier", None, 0), ("!!!!!!!!!", 1, 1), (None, 1, 1)]
    rows = [(1, p, q, k) for k, (q, p, _) in enumerate(ask)] + [(2, 5, "zonder bladzijden", 99)]
    got = {r.k: r.page for r in C.fixed_pages(pages, spark.createDataFrame(rows, "doc_id long, page int, quote string, k int")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(ask)} | {99: 5}


FIELDS = [L.Field("bouwjaar", "Bouwjaar", "number"), L.Field("oppervlakte", "Oppervlakte (m2)", "number"), L.Field("soort", "Soort", "enum", ("7", "8")), L.Field("ref", "Kenmerk", "string", (), r"^9\d")]


def _clip(text: str, fields, year: int, most: int) -> str:
    """The clip as a loop over one text. Its numbers are checked by kind as far as the texts below need."""
    text = text.strip()
    if len(text) <= min(3500, most):
        return text
    spots = set()
    for f in fields:
        for p in L.place_pattern([f.label, f.key, T.plain(re.sub(r"\([^)]*\)", " ", f.label))]):
            spots |= {m.start() for m in re.finditer(p.removeprefix("(?i)"), text, re.I)}
    spots = sorted(spots)
    if not spots:
        return text[:most].rstrip()
    windows = []
    for p in spots:
        a, b = max(0, p - 1500), min(len(text), p + 800)
        if windows and a <= windows[-1][1]:
            windows[-1] = (windows[-1][0], max(b, windows[-1][1]))
        else:
            windows.append((a, b))

    def sound(f, n, norm):
        if f.key == "bouwjaar":
            return bool(re.fullmatch(r"\d{4}", n)) and 1600 <= int(n) <= year + 1
        if f.key == "oppervlakte":
            return len(re.sub(r"\D", "", n)) < 7 and ("m2" in norm or "oppervlakte" in norm)
        return n in f.enum_values if f.enum_values else bool(re.search(f.regex, n))

    def score(a, b):
        t = text[a:b]
        norm = T.plain(t)
        numbers = re.findall(r"\b\d+(?:[.,]\d+)?\b", t)[:20]
        named = [f for f in fields if any(x in norm for x in L.terms_of(f))]
        concrete = sum(any(sound(f, n, norm) for n in numbers) for f in named)
        rows = sum(len(x.split()) >= 3 and bool(re.search(r"\d", x)) for x in t.split("\n"))
        return 10 * len(named) + 25 * concrete + 8 * rows - (40 if not concrete and re.search(r"\b(is|betekent|uitleg)\b", norm) else 0)

    a, b = max(windows, key=lambda w: (score(*w), -w[0]))
    if b - a > most:
        p = max((p for p in spots if a <= p <= b), key=lambda p: (score(max(a, p - 1500), min(b, p + 800)), -p))
        a = max(0, p - min(1500, max(200, most // 2)))
        b = min(len(text), a + most)
        a = max(0, b - most)
    return text[a:b].strip()


def test_clipped(spark):
    rng = random.Random(8)
    some = ["bouwjaar 1998", "Bouwjaar is onbekend, uitleg volgt", "de oppervlakte", "Oppervlakte m2: 120", "Soort: 7", "kenmerk 91", "regel met 12 woorden", "bouwjaar", "\n", "\n\n"]
    rows = [(0, None), (1, ""), (2, "kort bouwjaar"), (3, " " + "x" * 5000 + " "), (4, "a " * 1200 + "bouwjaar 1990 " + "b " * 4000)]
    for k in range(5, 40):
        parts = []
        for _ in range(rng.randint(2, 12)):
            parts += ["w " * rng.choice([3, 50, 700, 1500]), rng.choice(some)]
        rows.append((k, " ".join(parts)))
    for most in (900, 2200):
        got = {r.doc_id: r.chunk for r in L.clipped(spark.createDataFrame(rows, "doc_id long, chunk string"), FIELDS, 2025, most).collect()}
        assert all(got[k] == _clip(t or "", FIELDS, 2025, most) for k, t in rows)
        assert sum(len(got[k]) < len(t or "") for k, t in rows) > 20
    assert L.clipped(spark.createDataFrame(rows, "doc_id long, chunk string"), [], 2025).where("doc_id = 3").first().chunk == "x" * 2200


def test_packed(spark):
    text = lambda n: f"Bouwjaar 1998 {'w ' * (n // 2)}"
    rows = [(1, 0, 0, text(1000)), (1, 1, 3, text(6000)), (1, 2, 4, text(900)), (1, 3, None, "kort"), (2, 0, 0, text(9000)), (3, 0, 0, None)]
    got = {r.doc_id: r for r in L.pack_prompt(spark.createDataFrame(rows, "doc_id long, part int, page int, chunk string"), FIELDS, 2025).collect()}
    assert [(t.part, t.reason) for t in got[1].told] == [(0, "included"), (1, "included"), (2, "included"), (3, "included")] and got[1].told[1].included <= 1800
    assert got[1].prompt.startswith("[chunk 1, page 1, fields: bouwjaar]\nBouwjaar 1998") and got[1].prompt.endswith("[chunk 4, page 1, fields: unknown]\nkort")
    assert len(got[1].prompt) <= 4200 and got[2].told[0].included <= 3000 and got[3].prompt == "[chunk 1, page 1, fields: unknown]\n"
    got = L.pack_prompt(spark.createDataFrame([(1, k, 0, text(3000)) for k in range(4)], "doc_id long, part int, page int, chunk string"), FIELDS, 2025).first()
    # The second is clipped to what surrounds its label, the others do not fit even so.
    assert [(t.reason, t.included) for t in got.told] == [("included", 3013), ("included", 799), *[("dropped_prompt_budget", 0)] * 2]


class _Script:
    """Answers in turn; errors are raised."""

    def __init__(self, *steps):
        self.steps, self.asked = list(steps), []

    def __call__(self, messages, most):
        self.asked.append(most)
        x = self.steps.pop(0)
        if isinstance(x, Exception):
            raise x
        return x


def test_caller():
    call = lambda *steps, **how: M.Caller(s := _Script(*steps), pause=0, **how).ask([("user", "x")], 900, 10) + (s.asked,)
    long = M.Refused(400, "maximum context length is 512 tokens and your request has 400 input tokens")
    assert call("ja") == ("ja", None, 1, 900, [900])
    assert call(TimeoutError(), ConnectionError(), "ja") == ("ja", None, 3, 900, [900] * 3)
    assert call(TimeoutError(), TimeoutError(), TimeoutError())[:3] == (None, "timeout", 3) and call(*[ConnectionError()] * 3)[:3] == (None, "connection", 3)
    assert call(M.Refused(404))[:3] == (None, "status 404", 1) and call(M.Refused(400, "anders"))[:3] == (None, "status 400", 1) and call(*[M.Refused(503)] * 3)[:3] == (None, "status 503", 3)
    assert call(long, "ja") == ("ja", None, 2, 62, [900, 62]) and call(long, long, long)[:3] == (None, "status 400", 3)
    c = M.Caller(_Script(long, "ja", "ja"), pause=0)
    assert c.ask([], 900, 10)[3] == 62 and c.ask([], 900, 300)[3] == 162


def test_ask(spark):
    def client():
        return lambda messages, most: f"{len(messages)} {messages[-1][1]} {most}"

    rows = [(1, [("system", "a" * 35), ("user", "vraag")]), (2, []), (3, None), (4, [("user", None)])]
    d = spark.createDataFrame(rows, "id long, messages array<struct<role: string, text: string>>")
    for together, most in ((1, 2048), (3, 2048)):
        got = {r.id: r for r in M.ask(d, client, together=together).collect()}
        assert got[1].answer == f"2 vraag {most}" and got[2].error == got[3].error == "no messages" and got[4].answer == f"1  {most}"
    assert M.ask(d.limit(0), client).columns == ["id", "messages", "answer", "error", "attempts", "most_tokens"]


def test_sentence_evidence(spark):
    texts = spark.createDataFrame([(1, "kort\nDe koper is mevrouw Jansen uit Delft\nDe verkoper is de heer Bakker\n" + "x" * 301), (2, "niets"), (3, None)], "doc_id long, text string")
    values = [(1, "koper", "De koper", "mevrouw Jansen"), (1, "prijs", "Prijs", "500"), (1, "leeg", "Leeg", None), (2, "a", "A", "b"), (3, "a", None, "b"), (4, "a", "A", "b")]
    got = {(r.doc_id, r.field): (r.snippet, r.score) for r in M.sentence_evidence(texts, spark.createDataFrame(values, "doc_id long, field string, label string, value string"), M.words_encoder).collect()}
    snippet, score = got.pop((1, "koper"))
    assert snippet == "De koper is mevrouw Jansen uit Delft" and abs(score - 4 / np.sqrt(4 * 7)) < 1e-6
    assert len(got) == 5 and set(got.values()) == {(None, None)}


def test_plain_words(spark):
    def client():
        return lambda messages, most: {"a": '"Uitleg."', "b": "```\nTwee.\n```"}.get(re.search(r"Signaal: (\w+)", messages[-1][1])[1], " ")

    s = spark.createDataFrame([(1, n, f"d{n}", "HIGH", 0.5, ["e"], "c", "r") for n in ("a", "b", "x", "ela_manipulation_detected")], "doc_id long, name string, description string, risk_level string, confidence double, evidence array<string>, category string, recommendation string")
    got = {r.name: r for r in M.in_plain_words(s, spark.createDataFrame([], "doc_id long, text string"), client).collect()}
    assert (got["a"].description, got["a"].original_description, got["a"].category, got["a"].recommendation) == ("Uitleg.", "da", None, None)
    assert got["b"].description == "Twee." and got["x"].description == "dx" and got["x"].category == "c" and got["ela_manipulation_detected"].original_description is None


def test_records(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    some = lambda *x: [F.lit(v).cast(k) for v, k in zip(x, ("string", "double", "double", "string", "string"), strict=True)]
    assert one(decisions.model_record(*some("a", 0.5, 0.85, None, None)))[:5] == ("below_threshold", "a", 0.5, 0.85, "Confidence 0.50 < threshold 0.85")
    assert one(decisions.model_record(*some("a", 0.9, 0.85, "not: x", "e")))[:5] == ("rejected", "a", 0.9, 0.85, "not: x")
    assert one(decisions.model_record(*some("a", 0.9, None, None, None)))[:5] == ("accepted", "a", 0.9, None, None)
    assert one(decisions.model_record(*some(None, 0.9, 0.85, None, "stuk")))[:5] == ("failed", None, None, 0.85, "stuk")
    assert one(decisions.model_record(*some(None, None, None, None, None)))[0] == "no_result"
    assert [one(decisions.margin(F.from_json(F.lit(t), "map<string, double>"))) for t in ('{"a": 0.9, "b": 0.25}', '{"a": 0.9, "b": null}', "{}")] == [0.65, 0.0, None]


def test_office(spark):
    text = "Eén\ttab\n\n<&> \"twee\"\rdrie  spaties \U0001f600"
    assert office.docx_text(office.docx_bytes(text)) == text + "\n" and office.docx_text(office.docx_bytes("a\x01b")) == "ab\n"
    rows = [["Naam", None, "x"], [1, 2.5, True], [], [None, None, None, "<&>"], [-3, 1e20, False]]
    got = office.xlsx_text(office.xlsx_bytes({"Blad 1": rows, 'B & "c"': []}))
    assert got == 'Sheet: Blad 1\nNaam\t\tx\t\n1\t2.5\tTrue\t\n\t\t\t\n\t\t\t<&>\n-3\t1e+20\tFalse\t\n\nSheet: B & "c"\n\n'
    data = [(1, office.docx_bytes("a")), (2, b"no archive"), (3, None), (4, office.xlsx_bytes({"s": [[1]]}))]
    d = spark.createDataFrame([(i, bytearray(x) if x else None) for i, x in data], "id long, content binary").select("id", office.docx("content").alias("d"), office.xlsx("content").alias("x"))
    got = {r.id: (r.d.text, r.x.text) for r in d.collect()}
    assert got == {1: ("a\n", None), 2: (None, None), 3: (None, None), 4: (None, "Sheet: s\n1\n\n")}


def test_office_parts():
    """What other programs write: shared strings, left-out rows and cells, links, breaks, tables."""
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = office._archive({
        "xl/workbook.xml": f'<workbook {s} xmlns:r="{r}"><sheets><sheet name="A" sheetId="1" r:id="rId9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Target="/xl/worksheets/x.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>een</t></si><si><r><t>tw</t></r><r><t>ee</t></r></si></sst>",
        "xl/worksheets/x.xml": f'<worksheet {s}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2" t="str"><f>x</f><v>f</v></c></row><row r="4"><c r="A4" t="s"><v>0</v></c><c r="B4"><v>7.0</v></c></row></sheetData></worksheet>',
    })
    empty, wide = "\t" * 26 + "\n", "\ttwee" + "\t" * 25 + "f\n"
    assert office.xlsx_text(book) == "Sheet: A\n" + empty + wide + empty + "een\t7.0" + "\t" * 25 + "\n\n"
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = office._archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:r><w:t>a</w:t><w:br/><w:t>b</w:t><w:br w:type="page"/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cel</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:document>'})
    assert office.docx_text(doc) == "a\nblink\n\n"


def test_office_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.DOCX").write_bytes(office.docx_bytes("tekst"))
    (tmp_path / "y.xlsx").write_bytes(office.xlsx_bytes({"s": [["v"]]}))
    (tmp_path / "z.docx").write_bytes(b"no archive")
    got = {r.path.rpartition("/")[2]: (r.pages and [tuple(p) for p in r.pages], r.error) for r in office.office_files(spark, str(tmp_path)).collect()}
    assert got == {"x.DOCX": ([(0, "docx", "tekst\n")], None), "y.xlsx": ([(0, "xlsx", "Sheet: s\nv\n\n")], None), "z.docx": (None, "BadZipFile")}
    got = {r.filename: r.reason for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"x.DOCX": None, "y.xlsx": None, "z.docx": None}


def test_unicode(spark):
    """Search text by tables is the plain version's, for all of the first plane and mixtures."""
    rng = random.Random(1)
    rows = [f"a{chr(i)}B" for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    rows += ["".join(chr(rng.choice([65, 97, 233, 0x301, 0x2126, 0xFB01, 0x1D400, 0x1F600, 32, 48, 0x3000, 0xFF21, 0x33A1])) for _ in range(20)) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.search_text(F.col("t")).alias("x")).collect()
    assert all(r.x == T.plain(r.t) for r in got)
    forms = spark.createDataFrame([("ﬁ Å é",), (None,)], "t string")
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert [r.x for r in forms.select(T.unicode_form(F.col("t"), form).alias("x")).collect()] == [unicodedata.normalize(form, "ﬁ Å é"), None]
    assert spark.range(1).select(T.slug(F.lit("Ｆａｃｔｕｕｒ ②_nr")).alias("x")).first().x == "factuur-2-nr"
    assert spark.range(1).select(files.safe_name(F.lit("map/ﬁle ①.pdf")).alias("x")).first().x == "file 1.pdf"


def test_answers_as_columns(spark):
    d = spark.createDataFrame([('x {"data": {"a": "null"}, "evidence": [{"quote": "q"}]}',), (None,), ("niets",)], "t string")
    got = d.select(A.finished_json(F.col("t")).alias("f"), A.checked(F.col("t"), {"required": []}).alias("c")).collect()
    assert json.loads(got[0].f) == {"data": {"a": None}, "evidence": {"a": []}} and got[1].f is None and got[2].f is None and got[1].c == "no_object"


def test_requests_of_equal_text_fail_alike(spark, tmp_path):
    """Messages of one worker with the same text each time out where nothing is asked again (llm_batch)."""
    import __spark_entry__ as entry

    rows = [(k, 0, "user", "zeven.." if k % 2 else "een antwoord") for k in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = lambda name: {(r.conv_id % 2, r.n, r.error, r.attempts) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert got("llm_batch") == {(0, 12, None, 1), (1, None, "timeout", 1)}
    assert got("llm_request") == {(0, 12, None, 1), (1, 7, None, 2)}


def test_parts_of_many_files_are_packed_once():
    """Archives are what zipfile reads, with parts short and long, and what all workbooks have is packed once (src_xlsx)."""
    import io
    import zipfile

    from paperlane.sources import office

    office.xlsx_bytes({"x": [], "leeg": []})
    before = office._short.cache_info().misses
    b = office.xlsx_bytes({"Blad é": [("a", None, True, 2.5), ("\r", 3)], "leeg": []})
    assert office._short.cache_info().misses - before == 2  # the sheet and the workbook
    assert office.xlsx_text(b) == "Sheet: Blad é\na\t\tTrue\t2.5\n\r\t3\t\t\n\nSheet: leeg\n\n"
    long = "é" * 5000
    with zipfile.ZipFile(io.BytesIO(office._archive({"né.xml": long, "b": ""}))) as z:
        assert z.testzip() is None and z.namelist() == ["né.xml", "b"] and z.read("né.xml").decode() == long and z.read("b") == b""
    assert office._column("AB12") == 28 and office._column("") == 0 and office._column("a1") == 0
