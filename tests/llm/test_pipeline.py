"""The pipeline, stage by stage, against plain versions on a small table."""

import hashlib
import os

import brute
import public_tokenizers

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_stages(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, held = docs.columns, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        held.append(P.settle(stage(spark, held[-1], FOLDER), f"test-{k}"))
        assert k == 4 or held[-1].columns == columns
    rows = [{(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()} for d in held[:5]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    lost = [labels.get(i) for i, _ in rows[0] - rows[1]]
    assert rows[1] <= rows[0] and lost.count(1) <= 0.03 * list(labels.values()).count(1)
    # One of each group of exact copies stays, and what goes is similar to something that stays or went.
    assert rows[2] <= rows[1] and {t for _, t in rows[2]} and len({t for _, t in rows[2]}) == len(rows[2])
    for _, t in rows[1] - rows[2]:
        assert max(similar(t, u) for i, u in rows[1] if u != t or (i, u) in rows[2]) >= 0.8
    texts = [t for _, t in sorted(rows[2])]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(texts[i], texts[j]) >= 0.8]
    assert not pairs
    want = {i: (n, gone, sha) for i, n, gone, sha in brute.substring(sorted(rows[2]))}
    got = {i: t for i, t in rows[3]}
    before = dict(rows[2])
    for i, (n, gone, sha) in want.items():
        if gone == n:
            assert i not in got
        elif gone:
            assert hashlib.sha256(got[i].encode()).hexdigest() == sha
        else:
            assert got[i] == before[i]
    assert rows[4] <= rows[3]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = {r.doc_id: r.text for r in held[4].select("doc_id", "text").collect()}
    for r in held[5].collect():
        ids = t.encode(mixed[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)


def test_run(spark):
    import corpus_pipeline as P

    assert P.run(spark, FOLDER).count() > 0 and P.ORACLE_SQL is None and len(P.STAGES) == 5


def test_odd_tables(spark):
    """Null, empty, repeated and tied rows, more columns with clashing names, and an empty table go through all stages."""
    import corpus_pipeline as P

    words = " ".join(f"word{i} and the" for i in range(60))
    rows = [(None, None, None, None, None, 1, "a"), (1, "", "en", "s", 0, 2, "b"), (None, words, "en", "s", 9, 3, "c"), (2, words, "en", "s", 9, 4, "d"), (2, words, "en", "s", 9, 4, "d"), (3, words + " tail", None, None, 9, 5, "e"), (4, "x " * 9000, "en", "t", 9, 6, "f"), (4, "y z", "en", "t", 9, 7, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, evidence string")
    for table in (docs, docs.limit(0)):
        held, names = table, table.columns
        for k, (name, stage) in enumerate(P.STAGES):
            held = P.settle(stage(spark, held, FOLDER), f"odd-{k}")
            assert k == 4 or held.columns == names, name
        got = held.collect()
        assert bool(got) == bool(table.count())
    kept = P.settle(P.near_dedup_stage(spark, P.quality_stage(spark, docs, FOLDER), FOLDER), "odd").collect()
    # Of the two equal texts and their near copy one stays, of the texts without words one.
    assert sum(1 for r in kept if r.text and r.text.startswith("word0")) == 1 and sum(1 for r in kept if not r.text) == 1
    assert {(r.kept, r.evidence) for r in kept} <= {(r[5], r[6]) for r in rows}
