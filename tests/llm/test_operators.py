"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import functools
import hashlib
import os
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from oracle import check
from pyspark.sql import functions as F

from paperlane.llm import bpe, components, counts, fixity, html, lattice, mixing, quality, queries, rules, simhash, substring

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
random.seed(5)
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(f"p{i}" for i in range(60))


def _text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


@functools.cache
def texts():
    """(id, text): odd cases first."""
    base = [_text(random.randint(1, 150)) for _ in range(40)]
    out = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "a b"), (6, "A b"), (None, "null id " + PASSAGE), (7, _text(6000) + "\n" + PASSAGE + "\x0b" + _text(50)), (8, PASSAGE), (9, PASSAGE), (9, PASSAGE), (9, "same id, other text " + _text(40)), (-5, "below zero " + PASSAGE + " end")]
    out += [(100 + i, t) for i, t in enumerate(base)]
    out += [(200 + i, t) for i, t in enumerate(base[:8])]
    out += [(300 + i, t.replace("w1", "x1", 1)) for i, t in enumerate(base)]
    return out + [(400 + i, f"{_text(30)} {PASSAGE[: 120 + 40 * i]} {_text(30)}") for i in range(5)] + [(500, "loop " * 200), (501, "é ß 日本 🙂 " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, k, "clash") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, ref string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def same(a, b):
    key = lambda r: tuple((x is None, x if x is not None else 0) if not isinstance(x, str) else (False, x) for x in r)
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def test_substring(docs):
    assert same(substring.removal_digest(docs).collect(), brute.substring(texts()))


def test_substring_texts(docs):
    got = {r.n: r for r in substring.remove_repeats(docs).collect()}
    want = brute.substring(texts())
    for n, (_, t) in enumerate(texts()):
        lost = want[n][2]
        assert got[n].ref == "clash" and (got[n].text == t if not lost else hashlib.sha256(got[n].text.encode()).hexdigest() == want[n][3])


def test_simhash(docs):
    d = simhash.near_duplicates(docs)
    assert same(d.select("doc_id", simhash.hexadecimal(F.col("fp")), "component_id").collect(), brute.simhash(texts()))


def test_simhash_shards():
    """Links inside radius 3 connect as brute force says, and no pair on a block or a deep key is missed."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(12)})
    part = brute.grouped(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3])
    at = {v: i for i, v in enumerate(values)}
    ours = brute.grouped(len(values), [(at[a], at[b]) for a, b in simhash.shard_links(values)])
    assert len({*zip(part, ours, strict=True)}) == len(set(part)) == len(set(ours))


def test_simhash_crowded(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 3)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(30)})
    d = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    at = {int(np.uint64(v).view(np.int64)): i for i, v in enumerate(values)}
    ours = brute.grouped(len(values), [(at[r.a], at[r.b]) for r in simhash.links(d).collect()])
    part = brute.grouped(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3])
    assert len({*zip(part, ours, strict=True)}) == len(set(part)) == len(set(ours))


def test_similar_documents(spark):
    """Five-word shingles: copies with few changed words are found, others are left alone."""
    rows, near = [], 0
    for i in range(30):
        w = _text(200).split()
        rows.append((i, " ".join(w)))
        v = list(w)
        for k in random.sample(range(200), 2):
            v[k] = "changed"
        rows.append((1000 + i, " ".join(v)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = sum(got[1000 + i] == i for i in range(30))
    assert near >= 28 and all(got[i] == i for i in range(30))


def _jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in ((t or "").encode().lower().split() for t in (a, b)))
    return len(a & b) / len(a | b) if a | b else 1.0


def _worn(text, n):
    w = text.split()
    for k in random.sample(range(len(w)), n):
        w[k] = f"x{random.random()}"
    return " ".join(w)


def test_similar_threshold(spark):
    """Around 0.8, the groups are those of brute force: no pair at 0.8 is missed, none below is linked."""
    rows = [None, "", "a b c d", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h j", "A b  c d"]
    for n in (40, 120, 400):
        for _ in range(12):
            t = _text(n)
            rows += [t, _worn(t, max(1, n // 60)), _worn(t, max(1, n // 40)), _worn(t, n // 30), t + " " + _text(n // 4), " ".join(t.split()[: round(0.8 * n) + 1])]
    rows = list(enumerate(rows))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if _jaccard(rows[i][1], rows[j][1]) >= 0.8]
    near = [_jaccard(rows[i][1], rows[j][1]) for i in range(len(rows)) for j in range(i)]
    assert sum(0.8 <= x < 0.82 for x in near) >= 5 and sum(0.75 <= x < 0.8 for x in near) >= 5
    part = brute.grouped(len(rows), links)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({(p, got[i]) for i, p in enumerate(part)}) == len(set(part)) == len(set(got.values()))


def test_masks_bound_the_difference():
    """Two sets differ in at least as many members as their masks, whole or folded, in bits."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 400, 3000):
        x = rng.integers(0, 2**48, n)
        y = np.unique(np.concatenate([x[: n * 9 // 10], rng.integers(0, 2**48, n // 8 + 1)]))
        x = np.unique(x)
        apart = len(np.setxor1d(x, y))
        a, b = simhash.mask(x), simhash.mask(y)
        whole = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
        short = int(np.bitwise_count((simhash.folded_mask(a) ^ simhash.folded_mask(b)).view(np.uint64)).sum())
        assert short <= whole <= apart and (apart - whole) % 2 == 0
        part = np.bincount(np.concatenate([x, y]).astype(np.int64) % 256, minlength=256) & 1
        assert short == part.sum()


def test_similar_crowded(spark):
    """A group of near copies with unlike fingerprints takes comparisons in proportion to its rows, not to their square."""
    import glob

    from paperlane.llm.shared import scratch_dir

    base = _text(300)
    rows = [(i, _worn(base, 3)) for i in range(400)] + [(1000 + i, _text(60)) for i in range(50)]
    before = set(glob.glob(f"{scratch_dir(spark)}/similar-*"))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0} and all(got[1000 + i] == 1000 + i for i in range(50))
    pairs = [spark.read.parquet(f).count() for f in set(glob.glob(f"{scratch_dir(spark)}/similar-*")) - before if "similar-rest" in f or "similar-tried" in f]
    assert len(pairs) == 2 and sum(pairs) <= 40 * 400


def test_similar_star(spark):
    """Copies that are near one text and not near each other are linked through that text, without a comparison of all their pairs."""
    import glob

    from paperlane.llm.shared import scratch_dir

    base = _text(300)
    rows = [(0, base)] + [(i, _worn(base, 4 + i % 2)) for i in range(1, 400)] + [(1000 + i, _text(60)) for i in range(50)]
    assert max(_jaccard(rows[i][1], rows[i + 1][1]) for i in range(1, 20)) < 0.8
    before = set(glob.glob(f"{scratch_dir(spark)}/similar-*"))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0} and all(got[1000 + i] == 1000 + i for i in range(50))
    pairs = [spark.read.parquet(f).count() for f in set(glob.glob(f"{scratch_dir(spark)}/similar-*")) - before if "similar-rest" in f or "similar-tried" in f]
    assert len(pairs) == 2 and sum(pairs) <= 10 * 400, pairs


def test_keep_first_rows(spark):
    """Null and repeated ids: one row of each group stays, and every row that is no copy."""
    t = [_text(80) for _ in range(9)]
    rows = [(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (5, t[4]), (5, t[5]), (2, t[5]), (6, t[4]), (None, t[6]), (9, t[6]), (None, t[7]), (None, t[7]), (8, t[8]), (8, t[8])]
    kept = sorted(tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).fillna(-1).collect())
    assert kept == sorted([(-1, t[0]), (-1, t[1]), (7, t[2]), (7, t[3]), (5, t[4]), (2, t[5]), (9, t[6]), (-1, t[7]), (8, t[8])])


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 160)) and len(got) == 111


def test_bpe(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, x in texts():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert same(bpe.encode(docs, path, ("n_tokens", "ids_sha256", "decoded_sha256")).collect(), want)


def test_bpe_chunks():
    odd = "abcXYZ  \n\t\x0b\x1c\x85\xa0.,!?-éßñ日本🙂́İΣσςＡﬁ012'ste<|endoftext|>"
    some = ["".join(random.choice(odd) for _ in range(random.randint(0, 400))) for _ in range(500)] + ["x" * 3000, "<|endoftext|> A<|STARTOFTEXT|>", "Ḣḣ H̱ ẖ X,\n y."]
    for units in (False, True):
        e = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), 4, units)
        assert e.encode(some) == e.plain(some)
        assert e.counts["encoded_joins"] > 500 and not e.counts["grown_joins"]
    assert all(b"".join(p for _, p in bpe.pieces(s.encode(), 4)) == s.encode() for s in some)


def test_bpe_reuse():
    """A passage shared by texts is encoded once, and each join with the words beside it once."""
    e = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), 6)
    shared = _text(2000)
    e.encode([shared])
    first = dict(e.counts)
    assert first["cores"] >= first["encoded_cores"] > 50
    some = [f"{_text(3)} {shared} {_text(3)}" for _ in range(20)]
    assert e.encode(some) == e.plain(some)
    assert e.counts["cores"] - first["cores"] >= 20 * (first["cores"] - 3)
    assert e.counts["encoded_cores"] - first["encoded_cores"] <= 20 * 3 and e.counts["encoded_joins"] - first["encoded_joins"] <= 20 * 4


def test_bpe_words_together():
    """New words go to the library many at a time, with the results that they have alone, those without tokens and those with the sign between them too."""

    class Counted(bpe.ChunkEncoder):
        given = 0

        def plain(self, texts):
            self.given += len(texts)
            return super().plain(texts)

    e = Counted(public_tokenizers.path("word_bpe_49k.json"))
    words = [f"w{random.random()}" for _ in range(3000)]
    text = " ".join(words)
    before = e.given
    got = e.encode([text])
    assert e.given - before < len(words) / 4 and got == e.plain([text])
    odd = [*words[:100], "\x85", "a\x01b", "\x01", *words[100:200], "\xa0", "n't...", "<|endoftext|>", "ÉA"]
    for some in (odd, odd[::-1], ["\x85"], ["\x01"], []):
        assert e._apart(some) == [x for w in some for x in e.plain([w])]
        assert e.encode([" ".join(some)]) == e.plain([" ".join(some)])
    for s in (b"", b".", b"Ab.", b"ab. ", b"A1. b, C\xc3\xa9, d.\te..  f.,\n"):
        import re

        assert bpe.folded(s) == re.sub(rb"([a-z])([.,])(?=[\t-\r ])", rb"\1 \2", s.lower())


def test_bpe_joins_grow():
    """With an encoder that carries over blanks, joins grow until they agree with the whole text."""
    import re

    class Pairs(bpe.ChunkEncoder):
        def plain(self, texts):
            found = [re.findall(r"new york|\S+", t) for t in texts]
            return [(len(f), " ".join(str(sum(map(ord, x))) for x in f), " ".join(f)) for f in found]

    e = Pairs(public_tokenizers.path("word_bpe_49k.json"), 3, True)
    some = [" ".join(random.choice(("new", "york", "old", "city", "a")) for _ in range(60)) for _ in range(40)]
    assert e.encode(some) == e.plain(some)
    assert e.counts["grown_joins"] > 20


def test_counts(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in texts()]
    assert same(counts.count_tokens(docs, path).collect(), want)


def test_transducer():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), counts.Transducer(path, most=2000)
    letters = "abcdefghij     \n\t.,▁éß日🙂\x000123AB<s>"
    held = list(m.score)
    some = ["".join(random.choice(letters) for _ in range(random.randint(0, 300))) for _ in range(600)] + ["".join(random.choice(held).replace("▁", " ") for _ in range(12)) for _ in range(600)] + ["a" * 5000, " " * 99, "\n" * 9, "ab" * 900]
    for s in some:
        n = len(sp.encode(s))
        assert m.count(s) == n and m.count(s, 7) == n and m.count(s, 64) == n


def test_chunk_maps():
    """A chunk's map gives what reading it gives, from any entry, and maps compose in any grouping."""
    m = counts.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    letters = "abcde     \n▁éß日".replace(" ", counts.MARK)
    some = ["".join(random.choice(letters) for _ in range(random.randint(1, 9))) for _ in range(400)]
    for i in range(0, 390, 6):
        parts = some[i : i + 6]
        whole = m.read(counts.Entry(m.start, None), "".join(parts))
        entry, total = counts.Entry(m.start, None), 0
        for p in parts:
            x = m.map(p)
            entry, n = m.read(entry, p)
            total += n
            assert not x.returns or entry == x.exit
        assert whole == (entry, total)
        maps = [m.map(p) for p in parts]
        left = functools.reduce(m.compose, maps)
        for x in (left, m.scan(maps), m.compose(maps[0], m.scan(maps[1:]))):
            assert m.read(counts.Entry(m.start, None), x.head)[1] + x.tokens == total


@functools.cache
def vectors():
    rng = np.random.default_rng(3)
    out = [(1, None), (2, []), (3, [0.0] * 16), (4, [1.0, None] + [0.0] * 14), (5, [float("nan")] + [1.0] * 15), (6, [float("inf")] + [1.0] * 15), (7, [1.0, 2.0])]
    for c in range(12):
        m = rng.standard_normal(16)
        out += [(100 * (c + 1) + k, (m + 0.12 * rng.standard_normal(16)).tolist()) for k in range(8)]
    return out + [(None, out[-1][1]), (5000, out[-1][1]), (5000, out[-1][1]), (5001, [2 * x for x in out[-1][1]])]


def test_lattice(spark):
    d = spark.createDataFrame([(i, v, 0) for i, v in vectors()], "vec_id long, embedding array<double>, cell int")
    got = lattice.near_duplicates(d).collect()
    want = brute.cosine(vectors())
    assert len(got) == len(want)
    assert sum(r.n_links for r in got) >= 0.9 * sum(w[1] for w in want)
    assert same([(r.vec_id, r.component_id) for r in got], [(w[0], w[2]) for w in want])


def test_lattice_bands(spark):
    """Of pairs right at the threshold and just above it, nearly all are found in each band, and none below it."""
    rng = np.random.default_rng(8)
    bands, n, d = (0.9499, 0.95, 0.955, 0.96, 0.97, 0.99), 1000, 64
    rows = []
    for b, c in enumerate(bands):
        x = rng.standard_normal((n, d))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = rng.standard_normal((n, d))
        y -= (x * y).sum(axis=1)[:, None] * x
        y /= np.linalg.norm(y, axis=1)[:, None]
        y = (c + 1e-9) * x + np.sqrt(1 - (c + 1e-9) ** 2) * y
        rows += [(2 * (b * n + k) + o, v.tolist()) for k in range(n) for o, v in enumerate((x[k], 3 * y[k]))]
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = [sum(got[2 * (b * n + k)] for k in range(n)) / n for b in range(len(bands))]
    assert found[0] == 0 and min(found[1:]) >= 0.98, found


def test_lattice_tiles(spark, monkeypatch):
    """A crowded cell dealt out as tiles gives the same links."""
    monkeypatch.setattr(lattice, "TILE", 10)
    rng = np.random.default_rng(4)
    m = rng.standard_normal(16)
    rows = [(k, (m + 0.02 * rng.standard_normal(16)).tolist()) for k in range(60)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_e8():
    x = np.random.default_rng(0).standard_normal((500, 8)) * 2
    p, d = lattice.e8_points(x)
    assert (p.sum(axis=2) % 4 == 0).all() and ((p % 2).min(axis=2) == (p % 2).max(axis=2)).all() and (np.diff(d, axis=1) >= 0).all() and (d[:, 0] <= 1 + 1e-9).all()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    check(queries.queries()[name], queries.oracle_sql()[name], spark, FOLDER)


def test_mix(spark):
    rows = [(i, "a " * (1 + i % 13), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(7, None, "s0"), (7, "a b", "s0"), (None, "x", "zero"), (900, "", "void")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    per = {}
    for r in got:
        t = per.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(abs(a - b) <= 13 for a, b in per.values())
    assert abs(sum(b for _, b in per.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert got == mixing.mix(d).collect() or sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))
    copies = mixing.repeat_documents(d).groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda x: x != ""))).alias("n")).collect()
    assert {r.source: r.n for r in copies if r.n} == {k: v[0] for k, v in per.items() if v[0]}


def test_mix_chances(spark):
    """Chances differ by document, short ones having the better, and add up to the words that are missing; samples follow them."""
    sizes = [(f"s{i % 3}", 1 + (i * i) % (40 if i % 3 else 4000), (i * 0.6180339887) % 1) for i in range(3000)]
    d = spark.createDataFrame(sizes, "source string, size long, u double")
    per = {r.source: r for r in mixing.plan(d).collect()}
    taken = {(r.source, r.u): r.copies - r.whole for r in mixing.copies(mixing.plan(d), d).collect()}
    for s, r in per.items():
        own = [(size, u, r.pis[size.bit_length()]) for x, size, u in sizes if x == s]
        assert abs(sum(size * pi for size, _, pi in own) - r.rest) < 1e-6 * max(1, r.rest)
        assert r.rest == 0 or len(set(r.pis.values())) > 3 and sorted(r.pis.values(), reverse=True) == [r.pis[k] for k in sorted(r.pis)]
        for k, pi in r.pis.items():
            some = [taken[s, u] for size, u, _ in own if size.bit_length() == k]
            assert len(some) < 100 or abs(np.mean(some) - pi) < 0.12


def test_rules_on_odd_texts(docs):
    got = {r.n: r for r in rules.judge(docs).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert all(r.ref == "clash" for r in got.values())
    loop = next(r for r in got.values() if r.doc_id == 500)
    assert (loop.n_words, loop.n_repeat_words, loop.base_failed) == (200, 200, True)


def test_html():
    page = """<html><head><title>T</title></head><body><header class="site-header"><a href=/>Home</a> My Site</header><div id="cookie-notice">We use cookies.</div><aside>Popular: <a>one</a></aside>
    <article><h1>Real &amp; title</h1><p>First paragraph with <a href=x>a link</a> and
    text &lt;ok&gt;.<div class="ad">Buy now!</div><p>Short.<form><label>Email</label></form><section class="comments"><p>A very long reader comment that goes on and on and is not content.</p></section></article><footer>&copy; x</footer>"""
    assert html.main_text(page) == "Real & title First paragraph with a link and text <ok>. Short."
    assert [html.main_text(x) for x in (None, "", "<script>x</script>", "<p></p>")] == [""] * 4
    long_ = "<article>" + "<p>word</p>" * 5000 + "</article>"
    assert html.main_text(long_) == " ".join(["word"] * 5000)


def test_html_names():
    """A listed word in a longer name does not make boilerplate; a name made of such words does."""
    long_ = "This is a paragraph of the article that goes on for a while, as paragraphs do, and ends in a full stop."
    for name in ("story-sharing-economy", "main-menu-of-restaurant"):
        for page in (f'<article><div class="{name}"><p>{long_}</div></article>', f'<div id="{name}"><p>{long_}</p></div>'):
            assert html.main_text(page) == long_
    for name in ("cookie-notice", "ad", "ad-slot", "reader-comments", "newsletter_signup", "relatedPosts", "comment-list"):
        assert html.main_text(f'<article><p>{long_}</p><div class="{name}"><p>{long_}</p></div></article>') == long_


def test_html_cut_decides():
    """On pages whose mark-up tells nothing, the cut changes labels and is right more often than the classifier alone."""
    rng, right, alone, flipped, n = random.Random(4), 0, 0, 0, 0
    for _ in range(150):
        body = [(True, f"<p>{' '.join(rng.choices(WORDS, k=rng.choice((2, 3, 25, 40, 60))))}{rng.choice(('.', '', '.'))}</p>") for _ in range(rng.randint(6, 14))]
        menu = [(False, f"<li><a href=/x>{' '.join(rng.choices(WORDS, k=rng.randint(1, 3)))}</a></li>") for _ in range(rng.randint(3, 8))]
        foot = [(False, f"<p>{' '.join(rng.choices(WORDS, k=rng.randint(2, 5)))}</p>") for _ in range(rng.randint(1, 3))]
        page = f"<div><ul>{''.join(t for _, t in menu)}</ul></div><div><div>{''.join(t for _, t in body)}</div></div><div><div>{''.join(t for _, t in foot)}</div></div>"
        want = [k for k, _ in (*menu, *body, *foot)]
        found, parent = html.blocks(page)
        odds = html.log_odds(found)
        cut, unary = html.content_side(html.prices(odds), html.edges(found, parent)), (odds > 0).tolist()
        n += len(want)
        flipped += sum(a != b for a, b in zip(cut, unary, strict=True))
        right += sum(a == b for a, b in zip(cut, want, strict=True))
        alone += sum(a == b for a, b in zip(unary, want, strict=True))
    assert flipped >= 0.02 * n and right > alone and right >= 0.95 * n, (right / n, alone / n, flipped / n)


def test_html_time_is_linear():
    import time

    for page in ("<div>" * 100_000 + "x" + "</p>" * 100_000, '<a b="' * 50_000, "<" * 200_000, "<p" * 100_000, "<div>" * 20_000 + "<p>a b c.</p>" * 5000, "<script>" * 50_000, "<!--" * 50_000):
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 5


def test_cut_is_minimal():
    """The cut's cost is the least over all labellings."""
    for _ in range(60):
        n = random.randint(1, 7)
        price = [(random.randint(0, 9), random.randint(0, 9)) for _ in range(n)]
        smooth = [(a, b, random.randint(0, 6)) for a in range(n) for b in range(a) if random.random() < 0.5]
        cost = lambda s: sum(p[1] if x else p[0] for p, x in zip(price, s, strict=True)) + sum(c for a, b, c in smooth if s[a] != s[b])  # noqa: E731, B023
        assert cost(html.content_side(price, smooth)) == min(cost([m >> i & 1 for i in range(n)]) for m in range(2**n))


def test_html_pages(spark):
    """The pages' articles, which are marked as such."""
    import re
    from html import unescape

    d = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(d).collect()}
    for r in d.collect():
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        assert got[r.page_id] == " ".join(unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_quality_held_out(spark):
    """Accuracy on labels that did not train; a tenth of the full table, as a smaller one has a dozen bad documents only."""
    folder = FOLDER.replace("sf0.001", "sf0.1")
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.classify(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.3


def some_labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")


def test_quality_odd_tables(spark, empty):
    d = spark.createDataFrame([(1, None, None, None, 0), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = some_labels(spark)
    same_rows = lambda k: k.columns == d.columns and sorted(map(str, k.collect())) == sorted(map(str, d.collect()))
    assert same_rows(quality.keep_good(d, none))
    odd = d.withColumns({"kept": F.lit(7), "n_words": F.lit(9), "evidence": F.lit("e"), "p_good": F.lit(2), "bins": F.lit(1), "fold": F.lit(5)})
    assert {(r.kept, r.n_words, r.evidence, r.p_good, r.bins, r.fold) for r in quality.keep_good(odd, some_labels(spark)).collect()} == {(7, 9, "e", 2, 1, 5)}
    assert all(0 < r.p_good < 1 for r in quality.classify(d, some).collect())
    assert quality.classify(empty, some).count() == 0


def test_fixity_tampering(spark):
    """Each replica has its own offsets: what lies behind a lost or grown record is sound, though it moved."""
    rows = [(f, f"r{f}-{k}", 100 + k % 7, f"d{f}-{k}") for f in range(5) for k in range(700)]
    schema = "file long, rid string, length long, digest string"
    other = [(f, r, n + (r == "r3-9"), "bad" if r in ("r1-699", "r3-9") else d) for f, r, n, d in rows if r not in ("r2-5", "r4-0")] + [(9, "new", 1, "x"), (0, "r0-5b", 1, "y")]
    lay = lambda t: fixity.with_offsets(spark.createDataFrame(t, schema).withColumn("k", F.regexp_extract("rid", "-([0-9]+)", 1).try_cast("int")), ["k", "rid"]).drop("k")
    got = fixity.audit(lay(rows), lay(other)).collect()
    assert {(r.rid, r.status) for r in got} == {("r1-699", "changed"), ("r3-9", "changed"), ("r2-5", "lost"), ("r4-0", "lost"), ("new", "extra"), ("r0-5b", "extra")}
    assert {r.rid: r.length_b - r.length_a for r in got if r.status == "changed"} == {"r1-699": 0, "r3-9": 1}
    assert fixity.audit(lay(rows), lay(rows)).count() == 0 and fixity.audit(lay(rows).limit(0), lay(rows).limit(0)).count() == 0


def test_fixity_descends(spark):
    """Below the root only what lies under mismatching nodes is looked at."""
    rows = [(f, f"r{f}-{k}", 10, f"d{f}-{k}") for f in range(8) for k in range(500)]
    a = fixity.with_offsets(spark.createDataFrame(rows, "file long, rid string, length long, digest string"), ["rid"])
    b = a.withColumn("digest", F.when(F.col("rid") == "r3-77", "bad").otherwise(F.col("digest")))
    x, y = ([t.cache() for t in fixity.tree(fixity.ranged(d))] for d in (a, b))
    bad = [fixity._differ(p, q).count() for p, q in zip(x, y, strict=True)]
    assert bad == [1, 1, 1] and x[0].count() > 100 and x[1].count() > 8


def test_warc_files(spark, tmp_path):
    """Archives written, worn and read back: a flipped byte, a lost record, a grown one and a cut end are found."""
    import gzip

    ours, theirs = tmp_path / "a", tmp_path / "b"
    ours.mkdir()
    theirs.mkdir()
    rows = [(k // 20, f"<urn:uuid:{k:04d}>", f"http://x/{k}" if k % 5 else None, None if k == 3 else f"body {k} é " * (k % 9)) for k in range(60)]
    assert fixity.write_warc(spark.createDataFrame(rows, "file long, rid string, url string, body string"), str(ours)).count() == 3
    leaves = fixity.read_warc(spark, str(ours))
    assert leaves.count() == 60 and {r.rid for r in leaves.collect()} == {r[1] for r in rows}
    data = {f: (ours / f"{f}.warc").read_bytes() for f in range(3)}
    at = {r.rid: (r.offset, r.length) for r in leaves.collect()}
    lo, n = at["<urn:uuid:0004>"]
    cut = data[0][:lo] + data[0][lo + n :]
    grown = data[1].replace(b"body 25 ", b"body 25 more ", 1).replace(b"Content-Length: 77\r\n", b"Content-Length: 77\r\n")
    for f, x in enumerate((cut, grown, data[2][:-30])):
        (theirs / f"{f}.warc").write_bytes(x)
    got = {r.rid: r.status for r in fixity.audit(leaves, fixity.read_warc(spark, str(theirs))).collect()}
    assert got["<urn:uuid:0004>"] == "lost" and got["<urn:uuid:0059>"] == "changed" and "changed" in got.get("<urn:uuid:0025>", "")
    assert not {r for r in got if r.startswith("<") and int(r[10:14]) not in (4, 25, 26, 59)}
    packed = tmp_path / "c"
    packed.mkdir()
    for f in range(3):
        (packed / f"{f}.warc.gz").write_bytes(b"".join(gzip.compress(data[f][o : o + n]) for r, (o, n) in sorted(at.items(), key=lambda x: x[1]) if int(r[10:14]) // 20 == f))
    assert fixity.audit(leaves.drop("length").withColumn("length", F.lit(0)), fixity.read_warc(spark, str(packed)).drop("length").withColumn("length", F.lit(0))).count() == 0


def test_empty_tables(spark, empty):
    path = public_tokenizers.path
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for d in (substring.removal_digest(empty), substring.remove_repeats(empty), simhash.near_duplicates(empty), simhash.keep_first(empty), bpe.encode(empty, path("word_bpe_49k.json")), counts.count_tokens(empty, path("piece_bpe_32k.model")), mixing.mix(empty), mixing.repeat_documents(empty), rules.judge(empty), html.extract(pages), fixity.audit_pages(pages), lattice.near_duplicates(vecs)):
        assert d.count() == 0


def test_nulls_in_pages(spark):
    pages = spark.createDataFrame([(None, None, None), (None, "u", "<p>x</p>"), (1, None, "<article>A b.</article>"), (1, None, "<article>A b.</article>")], "page_id long, url string, html string")
    assert sorted(r.text for r in html.extract(pages).collect()) == ["", "", "A b.", "A b."]
    rows = [(None, None, None), (None, None, None), (None, "u", "<p>x</p>")] + [(k, None if k % 3 else f"u{k}", "<p>é</p>" * 20) for k in range(2000)] + [(7, None, "again")] * 3
    got = fixity.audit_pages(spark.createDataFrame(rows, pages.schema)).collect()
    assert 3 <= len(got) <= 40 and {r.status for r in got} == {"changed", "lost"} and all(r.length_b == r.length_a - 1 or r.digest_b is None or r.length_a == r.length_b for r in got)
