"""Each operator against brute force, a library, an exact round trip or held-out accuracy, with the edge cases of its docstring."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.llm import bpe, components, entry, exact_dedup, fingerprint, jaccard_join, language_id, packing, quality, substring_dedup, token_counts, warc
from loomline.session import new_path, table

from ..conftest import SMALL
from . import helpers

DDL = "doc_id long, text string"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows, parts=3):
    """Text columns beside others whose names clash with those the operators make."""
    return spark.createDataFrame(rows, DDL).repartition(parts).withColumns({"ident": F.lit("x"), "kind": F.lit(1), "sid": F.lit("s"), "text_sha256": F.lit("y"), "n_tokens": F.lit(0)})


def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(open(MULTI, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(MULTI, "rb").read()), special_tokens={})


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_equals_sql(name, same):
    same(entry.QUERIES[name], entry.ORACLES[name])


def test_every_query_survives_nulls_and_empty_tables(spark, tmp_path):
    """Nulls in every column, repeated rows and extra columns, then tables without rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (5, None, None, None, None), (5, "a b", "en", "s", 3), (5, "a b", "en", "s", 3)], docs.schema)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(10)
    bad = spark.createDataFrame([(None, None, None), (3, None, ""), (3, None, "")], pages.schema)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    tables = {"documents": docs.unionByName(odd).withColumn("extra", F.lit(1)), "pages": pages.unionByName(bad).withColumn("kind", F.lit(1)), "labels": labels.unionByName(spark.createDataFrame([(None, None, None)], labels.schema))}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/odd/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    for name, query in entry.QUERIES.items():
        n = query(spark, f"{tmp_path}/odd").count()
        rows = tables["pages" if name.startswith(("op6", "op7")) else "documents"].count()
        assert n >= rows if name.startswith("op4") else n == rows or name.startswith("op8"), name
        assert query(spark, f"{tmp_path}/none").count() == 0, name


# 1


def test_bpe_equals_the_library(encoder, tiktoken_encoding):
    r, tokens = random.Random(1), list(encoder.ranks)
    for _ in range(3000):
        text = b"".join(r.choice(tokens) for _ in range(r.randint(1, 6))).decode("utf-8", "replace")
        assert encoder.encode(text).tolist() == tiktoken_encoding.encode_ordinary(text)
    for _ in range(2000):
        text = "".join(r.choice("ab  \n\t'sré1!　字") for _ in range(r.randint(0, 50)))
        assert encoder.encode(text).tolist() == tiktoken_encoding.encode_ordinary(text)
    assert b"".join(encoder.segments("ab cd " * 40_000)) == np.array(tiktoken_encoding.encode_ordinary("ab cd " * 40_000), "<u4").tobytes()


def test_appends_and_edits_are_exact_and_local(encoder, tiktoken_encoding):
    r = random.Random(2)
    letters = lambda n: "".join(r.choice("abé 's1!\n ") for _ in range(n))
    for _ in range(400):
        held = bpe.EncodedText(encoder, letters(r.randint(0, 60)))
        for _ in range(3):
            at = r.randint(0, len(held.text))
            held.edit(at, min(len(held.text), at + r.randint(0, 9)), letters(r.randint(0, 8)))
            held.append(letters(2))
            assert held.ids() == tiktoken_encoding.encode_ordinary(held.text)
    held = bpe.EncodedText(encoder, "some words here " * 500)
    before = held.work
    held.edit(4000, 4001, "X")
    assert held.work - before < 100


def test_round_trip_rows(spark, encoder):
    rows = [(1, "hello wörld"), (2, None), (2, ""), (None, "x" * 3000)]
    got = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip(frame(spark, rows), MULTI, public_tokenizers.PATTERN).collect()}
    text = "hello wörld"
    ids = encoder.encode(text)
    r = got[1, len(ids)]
    assert r.ids_sha256 == hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[2, 0].decoded_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == 3
    coded = bpe.encode(frame(spark, rows), MULTI, public_tokenizers.PATTERN)
    assert {bytes(r.data) for r in bpe.decode(coded, MULTI, public_tokenizers.PATTERN).collect()} == {(t or "").encode() for _, t in rows}


# 2


def test_quality_on_held_out_ratings(spark):
    docs, graded = table(spark, "/root/testdata/sf0.1", "documents"), quality.grade(table(spark, "/root/testdata/sf0.1", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    model = quality.train(docs, graded.where(half == 0))
    rows = quality.score(docs, model).join(graded.where(half == 1), "doc_id").groupBy("grade", "selected").count().collect()
    n = {(r["grade"], r.selected): r["count"] for r in rows}
    assert n[2, True] / (n[2, True] + n.get((2, False), 0)) > 0.99
    assert (n.get((0, False), 0) + n[1, False]) / sum(v for (g, _), v in n.items() if g < 2) > 0.85
    assert model.thresholds[0] < model.thresholds[1]


def test_the_fit_follows_the_gradient():
    rng = np.random.default_rng(2)
    owner, column, grades = rng.integers(0, 30, 200), rng.integers(0, 12, 200), rng.integers(0, 3, 30)
    w, raw = rng.normal(size=12), np.array([-0.3, 0.2])
    plain = 0.0
    for i in range(30):
        score = sum(w[c] for o, c in zip(owner, column) if o == i)
        below = [0.0, *(1 / (1 + np.exp(score - t)) for t in (raw[0], raw[0] + np.exp(raw[1]))), 1.0]
        plain += np.log(below[grades[i] + 1] - below[grades[i]]) / 30
    value, slope = quality.likelihood(w, raw, column, owner, grades, 0.01)
    assert abs(value - plain + 0.005 * (w * w).sum()) < 1e-9
    for k in range(14):
        step = 1e-6 * (np.arange(14) == k)
        up, down = (quality.likelihood(w + s * step[:12], raw + s * step[12:], column, owner, grades, 0.01)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - slope[k]) < 1e-6


def test_the_fit_reaches_an_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(np.where(rng.random(40) < 0.5, np.arange(40), 0)).astype(np.uint32) for _ in range(3000)]
    weights = np.where(np.arange(40) < 8, rng.normal(size=40) * 2, 0)
    grades = np.array([int((s := weights[r].sum() + rng.logistic()) > -1) + int(s > 1) for r in rows])
    model = quality.fit(rows, grades, ridge=1e-3, steps=2000, rate=0.02)
    owner = np.repeat(np.arange(3000), [len(r) for r in rows])
    place = {int(x): i for i, x in enumerate(model.indices)}
    used = np.array([int(x) in place for r in rows for x in r])
    column = np.array([place[int(x)] for r in rows for x in r if int(x) in place])
    raw = np.array([model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])])
    assert len(place) > 3 and np.abs(quality.likelihood(model.weights, raw, column, owner[used], grades, 1e-3)[1]).max() < 2e-3


def test_the_sample_is_bounded_by_features_too(spark):
    docs = frame(spark, [(k, f"good{k} words here" if k % 3 else "bad words") for k in range(60)])
    graded = spark.createDataFrame([(k, 2 if k % 3 else 0) for k in range(60)], "doc_id long, grade int")
    assert quality.train(docs, graded, listed=3).fitted is False and quality.train(docs, graded).fitted


def test_quality_without_ratings_keeps_all(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.score(docs, model).where("selected").count() == 2 and quality.select(docs, model).columns == docs.columns


# 3


def test_edit_distance_and_fingerprints():
    r = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 70))) for _ in range(2))
        assert plain(a, b) == fingerprint.edit_distance(a, b)
    texts = [bytes(r.choice(b"abcdef ") for _ in range(r.randint(0, 9000))) for _ in range(40)]
    prints = fingerprint.fingerprints(texts)
    assert prints == [fingerprint.fingerprints([t])[0] for t in texts]
    size, fingerprint.SLICE = fingerprint.SLICE, 777
    try:
        assert prints == fingerprint.fingerprints(texts)
    finally:
        fingerprint.SLICE = size
    long = texts[0] * 3 + texts[1] + texts[2]
    assert fingerprint.likeness(*fingerprint.fingerprints([long, long[:-300] + b"x" * 300])) > 0.6
    assert fingerprint.likeness(*fingerprint.fingerprints([texts[3] + texts[4], texts[5] + texts[6]])) < 0.3
    assert fingerprint.fingerprints([b""]) == ["4::"] and fingerprint.likeness("4::", "4::") == 1.0


def plain_fingerprint(data):
    """Byte by byte, from the definition."""
    mask = (1 << 64) - 1

    def mix(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * factor & mask
        return x ^ (x >> 33)

    table = [mix((b + 1) * fingerprint.MULTIPLIER & mask) >> 32 for b in range(256)]
    bits = 2
    while (1 << bits) * 64 < len(data):
        bits += 1

    def signature(bits):
        out, value, power, length = "", 0, 1, 0
        for i in range(len(data)):
            value, power, length = (value + (data[i] + 1) * power) & mask, power * fingerprint.MULTIPLIER & mask, length + 1
            rolled = 0
            for k in range(fingerprint.WINDOW):
                x = table[data[i - k]] if i >= k else table[0]
                rolled ^= (x << 3 * k | x >> (32 - 3 * k)) & 0xFFFFFFFF
            ends = rolled & ((1 << bits) - 1) == (1 << bits) - 1 and len(out) < fingerprint.MOST - 1
            if ends or i == len(data) - 1:
                out += fingerprint.LETTERS[mix((value + length) & mask) >> 58]
                value, power, length = 0, 1, 0
        return out

    return f"{1 << bits}:{signature(bits)}:{signature(bits + 1)}"


def test_fingerprints_byte_by_byte():
    r = random.Random(33)
    texts = [b"", b"a", b"abcdef", b"abcdefg", b"a" * 20_000, b"*Z" * 9000, "漢字 text ".encode() * 40]
    texts += [bytes(r.choice(b"abcdef gh\n") for _ in range(r.randint(0, 5000))) for _ in range(30)]
    assert fingerprint.fingerprints(texts) == [plain_fingerprint(t) for t in texts]
    assert max(len(x) for x in fingerprint.fingerprints([bytes([b]) * 70_000 for b in range(256)])) < 2 * fingerprint.MOST + 10


def test_neighbours_of_rows_without_ids(spark):
    rows = [(None, f"text {k} " * 30) for k in range(60)] + [(4, "same"), (4, "other"), (4, None)]
    got = fingerprint.edit_probe(frame(spark, rows, 6)).collect()
    order = sorted(rows, key=lambda x: (-(x[0] if x[0] is not None else -1), x[1] or ""))
    want = []
    for (i, own), (_, following) in zip(order, order[1:] + order[:1]):
        own, half = own or "", len(own or "") // 2
        want.append((i or 0, hashlib.sha256((own[: len(own) - half] + (following or "")[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.edited_sha256) for r in got) == sorted(want)


def test_edited_texts(spark):
    r = random.Random(4)
    rows = [(7 * i % 101, "".join(r.choice("abé ") for _ in range(r.randint(0, 300)))) for i in range(101)]
    got = {x.doc_id: x for x in fingerprint.edit_probe(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for (i, own), (j, following) in zip(order, order[1:] + order[:1]):
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(own)
        assert got[i].fingerprint == fingerprint.fingerprints([own.encode()])[0] and got[i].edited_fingerprint == fingerprint.fingerprints([edited.encode()])[0]
        assert got[i].near_next == fingerprint.likeness(got[i].fingerprint, got[j].fingerprint) and 0 <= got[i].near_edited <= 1


# 4


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    odd = "J̌ İ ok ' s <|endoftext|> x<|ENDOFTEXT|>y <|endoftext|><|startoftext|>z <|endo ftext|> <|EndOfText|> \u0130<|endoftext|>̌"
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, odd), (-3, "plain words " * 120_000 + odd)], DDL))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = packing.pack(docs, WORD).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids, at = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0


def test_word_encoder_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, encoder, r = Tokenizer.from_file(WORD), packing.WordEncoder(open(WORD, "rb").read()), random.Random(44)
    texts = ["".join(r.choice("abZé 's1!\n<|endoftext|>漢İ\u030cß \x00\x1fǅ²½") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [a + b for a in ("don't", "a's", "x'", "I've", "l'été", "naïve.", "1a", "é²", "<|endoftext|>") for b in ("", ".", "'", "2", "²", "|>", "…", "'s")] + ["plain w " * 150_000, "", " "]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode_many(texts) == want and encoder.encode_column(pa.array(texts)) == want
    assert encoder.encode_column(pa.array(texts).slice(5, 90)) == want[5:95] and encoder.encode_column(pa.array([], pa.string())) == []


def test_hilbert_visits_neighbours():
    cells = np.array([(a, b) for a in range(16) for b in range(16)])
    keys = packing.hilbert(cells, 4)
    assert sorted(keys.tolist()) == list(range(256))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# 5


def test_exact_dedup_against_brute_force(spark):
    rows = helpers.corpus(5)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert got == helpers.exact(rows)
    kept = exact_dedup.exact_dedup(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in helpers.exact(rows).values()} and kept.columns[:2] == ["doc_id", "text"]


def test_exact_dedup_of_repeated_keys(spark):
    rows = [(1, "a b"), (1, "ab"), (1, "a b"), (2, "c"), (None, "c"), (3, "c")]
    groups = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert sum(r.kept for r in groups) == 2 and {r.keep_id for r in groups} == {1, 2}
    assert sorted((r.doc_id, r.text) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()) == [(1, "a b"), (2, "c")]


def test_exact_dedup_with_few_buckets_and_clashing_names(spark):
    rows = helpers.corpus(6)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(frame(spark, rows), prefix=3, buckets=2).collect()}
    assert got == helpers.exact(rows)
    twice = [(1, "a b"), (1, "ab "), (1, " ab"), (2, "c"), (2, "c"), (3, None), (3, ""), (4, " ")]
    df = frame(spark, twice).withColumns({x: F.lit("mine") for x in ("_sha", "_size", "_first", "own_id", "own_sha", "own_size", "own_rank", "head", "bucket")})
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r._sha, r.own_rank) for r in kept.collect()) == [(1, " ab", "mine", "mine"), (2, "c", "mine", "mine"), (4, " ", "mine", "mine")]


def test_exact_dedup_beside_a_unique_text_of_the_same_key(spark):
    rows = [(5, "a text of its own"), (5, "b c"), (3, "b c"), (None, "another of its own"), (None, "bc"), (None, "only here")]
    want = [(3, "b c"), (5, "a text of its own"), (None, "another of its own"), (None, "only here")]
    assert sorted((r.doc_id or 99, r.text) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()) == sorted((k or 99, t) for k, t in want)


# 6


def test_language_of_pages(spark):
    pages, docs = table(spark, "/root/testdata/sf0.01", "pages"), table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.identify(pages, docs).collect()
    assert len(rows) == pages.count() and {r.language for r in rows} <= {"en", "de", "fr", "es"}
    assert sum(r.language == r.declared for r in rows) / len(rows) > 0.9 and all(0 < r.probability <= 1 for r in rows)
    lone = spark.createDataFrame([(1, "https://u@A.B.example.ORG:80/x", '<HTML lang=de-AT><script>the and of</script>'), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in language_id.identify(lone, docs).collect()}
    assert (got[1].host, got[1].suffix, got[1].declared) == ("a.b.example.org", "org", "de") and got[2].host == ""


def test_evidence_is_fused_as_by_hand(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    model = language_id.TextModel(language_id.gram_counts(docs))
    rows = [(r.page_id, r.url, r.html or "") for r in pages.collect()]
    p = np.array([model.posterior(language_id.visible(h)) for _, _, h in rows])
    names = [(*language_id.host_parts(u), language_id.declared(h)) for _, u, h in rows]
    total = p.sum(0)
    shares = (total + 1) / (len(rows) + p.shape[1])
    want = {}
    for k, (host, domain, suffix, said) in enumerate(names):
        others = lambda at, value: [j for j, x in enumerate(names) if x[at] == value and j != k]
        d, h = others(1, domain), others(0, host)
        prior_d = (p[d].sum(0) + 5 * shares) / (len(d) + 5)
        prior = (p[h].sum(0) + 5 * prior_d) / (len(h) + 5)
        seen = [(p[[j for j, x in enumerate(names) if x[at] == value]].sum(0) + 0.1) / (total + 1) for at, value in ((3, said), (2, suffix))]
        score = np.log(p[k]) + np.log(np.maximum(prior, 1e-9)) + np.log(seen[0]) + np.log(seen[1])
        weight = np.exp(score - score.max())
        want[rows[k][0]] = model.languages[int(score.argmax())], 1 / weight.sum()
    for r in language_id.identify(pages, docs).collect():
        assert r.language == want[r.page_id][0] and abs(r.probability - want[r.page_id][1]) < 1e-6


def test_markup_is_taken_off_in_linear_time():
    import time

    shown = lambda page: language_id.visible(page).split()
    assert shown('a<b c="d">e<script x>no</SCRIPT >f<!-- no <style> -->g<STYLE>no</style><template>no</template>h &amp; i') == ["a", "e", "f", "g", "h", "&", "i"]
    assert shown("a<script>b c<style>no</style>d") == ["a", "b", "c", "d"] and shown("a < b") == ["a", "<", "b"] and shown("<!--a<p>b-->c") == ["c"]
    assert language_id.declared("<html class=x><HTML\n lang='PT-br'>") == "pt" and language_id.declared("<htmlx lang=de>") == ""
    started = time.perf_counter()
    for part in ("<script>", "<!--", "<", "<html ", "</script", "<script></style>", "<!-- > <"):
        language_id.visible(part * 200_000)
        language_id.declared(part * 200_000)
    assert time.perf_counter() - started < 20


def test_rare_declarations_and_suffixes_have_their_own_evidence(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    known = {lang: docs.where(F.col("lang") == lang).orderBy(F.desc("n_chars")).first().text[:2000] for lang in ("en", "de", "fr")}
    page = lambda k, said, end, text: (k, f"https://h{k}.d{k}.{end}/", f'<html lang="{said}"><p>{text}</p></html>')
    rows = [page(k, "en", "com", known["en"]) for k in range(5000)]
    rows += [page(5000 + k, said, end, known[lang]) for k, (said, end, lang) in enumerate([("xa", "xa", "de")] * 4 + [("xb", "xb", "fr")] * 4)]
    rows += [page(6000, "xa", "xa", ""), page(6001, "xb", "xb", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    assert len(got) == len(rows) and (got[6000].language, got[6001].language) == ("de", "fr")


def test_whole_runs_of_letters_are_scored(spark):
    docs = spark.createDataFrame([(1, "漢字" * 20 + "仮名" * 40, "xa"), (2, "漢字" * 20 + "文章" * 40, "xb")], "doc_id long, text string, lang string")
    model = language_id.TextModel(language_id.gram_counts(docs))
    for name, tail in (("xa", "仮名"), ("xb", "文章")):
        p = model.posterior("漢字" * 20 + tail * 40)
        assert model.languages[int(np.argmax(p))] == name and p.max() > 0.9


def test_every_language_of_the_sample_is_kept(spark, monkeypatch):
    word = lambda k: "".join(chr(97 + k // d % 26) for d in (1, 26)) * 3
    rows = [(k, f"{word(k)} " * (100 - k), f"l{k:02}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for grams in (60_000, 200):
        monkeypatch.setattr(language_id, "GRAMS", grams)
        found = language_id.gram_counts(docs)
        model = language_id.TextModel(found)
        assert len(found) <= grams and model.languages == [lang for _, _, lang in rows]
    monkeypatch.setattr(language_id, "GRAMS", 60_000)
    model = language_id.TextModel(language_id.gram_counts(docs))
    assert all(model.languages[int(np.argmax(model.posterior(text)))] == lang for _, text, lang in rows)


def test_text_model_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.TextModel(language_id.gram_counts(docs.where("doc_id % 2 = 0")))
    held = docs.where("doc_id % 2 = 1").select("text", "lang").collect()
    right = sum(model.languages[int(np.argmax(model.posterior(r.text)))] == r.lang for r in held)
    assert right / len(held) > 0.97


# 7


def test_archive_gives_back_every_record(spark):
    pages = table(spark, SMALL, "pages").select("page_id", "url", "html")
    extra = spark.createDataFrame([(9001, "http://a b\r\nc", "é" * 200), (9002, None, "é" * 200), (9003, "u", None), (9004, "u", "x" * 99), (9005, "u", "x" * 99), (None, "u", "é" * 200)], "page_id long, url string, html string")
    whole = pages.unionByName(extra)
    index = warc.write(whole, new_path(spark, "archive"))
    got = {r.page_id: r for r in warc.read(index).collect()}
    assert len(got) == whole.count()
    assert (got[9002].record_type, got[9002].refers_to, got[9002].payload_bytes) == ("revisit", 9001, 400) and got[None].refers_to == 9001
    assert got[9005].record_type == "response" and got[9003].payload_bytes == 0
    again = warc.write(spark.createDataFrame([(1, "u", "a" * 200), (1, "u", "b" * 200), (2, "u", "b" * 200), (1, "u", "a" * 200)], "page_id long, url string, html string"), new_path(spark, "archive"))
    rows = again.collect()
    assert len({r.record_id for r in rows}) == 3 and len({(r.bundle, r.frame, r.offset) for r in rows}) == 4
    for r in rows:
        reader = warc.Reader(r.bundle)
        assert reader.record(r.frame, r.offset)[0]["WARC-Record-ID"] == r.record_id
        reader.close()
    headers, payload = warc.lookup(index, [9001])[9001]
    assert payload == ("é" * 200).encode() and headers["WARC-Type"] == "response" and headers["WARC-Target-URI"] == "http://abc"


# 8


def test_histogram_answers_every_limit(spark):
    r = random.Random(8)
    lengths = [r.choice((0, 3, 5, 1030, r.randint(0, 5000))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in lengths], "n_tokens long")
    sums = token_counts.suffix_sums(token_counts.histogram(df)).cache()
    for row in sums.collect():
        assert row.docs_at_least == sum(x >= row.length for x in lengths) and row.tokens_at_least == sum(x for x in lengths if x >= row.length)
        assert row.truncated_tokens == sum(min(x, row.length) for x in lengths) and abs(row.docs_share - sum(x <= row.length for x in lengths) / 400) < 1e-9
    for limit in (0, 4, 1031, 9999):
        row = token_counts.truncated(sums, limit).first()
        assert (row.n_tokens, row.kept_tokens, row.cut_docs) == (sum(lengths), sum(min(x, limit) for x in lengths), sum(x > limit for x in lengths))
    assert token_counts.quantile(sums, 0.5).first().length == sorted(lengths)[199] and token_counts.quantile(sums, 1.0).first().length == max(lengths)
    none = token_counts.suffix_sums(token_counts.histogram(df.limit(0)))
    assert tuple(token_counts.truncated(none, 5).first()) == (0, 0, 0, 0) and token_counts.quantile(none, 0.5).first().length is None


def test_suffix_sums_of_the_library_s_lengths(spark, tiktoken_encoding):
    docs = table(spark, SMALL, "documents")
    lengths = [len(tiktoken_encoding.encode_ordinary(r.text or "")) for r in docs.collect()]
    got = {r.length: r for r in entry.op8_token_counts(spark, SMALL).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.truncated_tokens, r.total_docs, r.total_tokens) == (sum(min(x, n) for x in lengths), len(lengths), sum(lengths))


# 9


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, seed):
    rows = helpers.corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows, 5)).collect()}
    assert got == helpers.substring(rows) and sum(x[1] for x in got.values()) > 1000


def test_substring_dedup_keeps_columns(spark):
    rows = helpers.corpus(3, families=1)
    df = frame(spark, rows).withColumn("n_chars", F.length("text"))
    out = substring_dedup.deduplicate(df)
    assert out.columns == df.columns and out.count() == df.count()
    want = helpers.substring(rows)
    for r in out.collect():
        if want[r.doc_id][1]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text)


def test_substring_dedup_with_clashing_names(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = frame(spark, [(1, passage), (2, f"x {passage} y")]).withColumns({x: F.lit(x) for x in ("_i", "_m", "_ident", "_mark", "_kept", "of_ident", "of_mark", "of_kept", "kept", "mark")})
    got = {r.doc_id: r for r in substring_dedup.deduplicate(df).collect()}
    assert got[2].text == "x y" and all(r._i == "_i" and r.of_mark == "of_mark" and r.kept == "kept" for r in got.values())


def test_substring_dedup_of_long_texts_in_many_flushes(spark, monkeypatch):
    """Texts over a segment, and tasks that deal out several times."""
    monkeypatch.setattr(substring_dedup, "HELD", 3000)
    r = random.Random(9)
    words = [f"word{i:05}" for i in range(9000)]
    long = [r.choice(words) for _ in range(130_000)]
    rows = [(k, " ".join(x)) for k, x in enumerate([long, [*long[5000:90_000], "z"], [*words[:40], *long[100_000:100_049]], long[-70:] * 3])]
    assert len(rows[0][1]) > 1 << 20
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.remove_repeats(frame(spark, rows, 2)).collect()}
    assert got == helpers.substring(rows)


def test_jaccard_join_of_long_texts_in_many_flushes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HELD", 3000)
    r = random.Random(10)
    words = [f"word{i:05}" for i in range(9000)]
    long = [r.choice(words) for _ in range(130_000)]
    rows = [(k, " ".join(x)) for k, x in enumerate([long, long[:110_000], long[:60_000], long[:65_000], words[:300], [*words[:290], "x"]])]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(frame(spark, rows, 2)).collect()}
    assert got == helpers.jaccard(rows) and got[1][1] == 0 and got[3][1] == 2


@pytest.mark.parametrize("repeated", [None, 7])
def test_substring_dedup_of_rows_of_one_id_in_one_task(spark, repeated):
    passage = " ".join(f"p{i}" for i in range(60))
    first = [(3, f"a {passage} b"), *((k, "short") for k in (4, 5, 6))]
    later = [(repeated, f"c{k} {passage} d{k}") for k in range(4)]
    in_two = lambda rows: spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), DDL)
    df = in_two(first + later)
    assert [len(x) for x in df.rdd.glom().collect()] == [4, 4]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).where("n_words > 1").collect())
    assert got == sorted([(3, 62, 0)] + [(repeated or 0, 62, 60)] * 4)
    assert {r.n_removed for r in substring_dedup.remove_repeats(in_two(later)).collect()} == {0}


def test_cover_has_every_difference():
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# 10


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_against_brute_force(spark, seed):
    rows = helpers.corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, rows, 5)).collect()}
    assert got == helpers.jaccard(rows)


@pytest.mark.parametrize(("block", "heavy"), [(4, 1 << 20), (4, 0), (2048, 0)])
def test_jaccard_join_in_small_blocks_and_rounds_with_spread_boxes(spark, block, heavy):
    rows = helpers.corpus(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(frame(spark, rows, 5), block=block, heavy=heavy, hot=5).collect()}
    assert got == helpers.jaccard(rows)


def test_partners_within_reach():
    r = random.Random(10)
    for _ in range(300):
        members = sorted((r.randint(0, 2), r.randint(1, 40), r.randint(0, 8)) for _ in range(r.randint(0, 12)))
        box, n, place = (np.array([m[k] for m in members], np.int64) for k in range(3))
        far = jaccard_join.reach(n, place)
        fits = lambda i, j: i != j and box[i] == box[j] and n[j] <= far[i] and n[i] <= far[j]
        who, partner, alive = jaccard_join._partners(box, n, far)
        assert all(fits(i, j) for i, j in zip(who, partner)) and set(who) <= set(np.flatnonzero(alive))
        assert {i for i in range(len(box)) if any(fits(i, j) for j in range(len(box)))} <= set(np.flatnonzero(alive))


def found_in_boxes(sets, n_buckets):
    """What all buckets find; sets: (name, size, hashes in the sets' order)."""
    held = jaccard_join._Entries()
    for name, size, hashes in sets:
        held.add(name, size, np.array(hashes, np.uint64), np.zeros(len(hashes), np.uint8))
    dealt = pa.Table.from_batches([held.dealt(n_buckets, jaccard_join.HOT_LEVEL)])
    return [row for k in range(dealt.num_rows) for row in jaccard_join._boxes(dealt.slice(k, 1)).to_pylist()]


def test_sets_that_go_on_alike_are_found_where_they_begin_to():
    rng = np.random.default_rng(13)
    shared = rng.integers(1, 1 << 63, 100, np.uint64) * np.uint64(2)
    own = rng.integers(1, 1 << 63, 5, np.uint64) * np.uint64(2)
    for members in (2, 5):
        sets = [(bytes([k]) * jaccard_join.NAME, 700, [own[k], *shared]) for k in range(members)]
        for n_buckets in (1, 16, 256):
            rows = found_in_boxes(sets, n_buckets)
            assert len(rows) == (1 if members == 2 else members) and {r["kind"] for r in rows} == {2 if members == 2 else 1}
            assert all(r["reach"] == jaccard_join.reach(700, 1) == r["other"] and r["a"] != r["b"] for r in rows)


@pytest.mark.parametrize("seed", range(20))
def test_boxes_hold_every_pair_within_reach(seed):
    r = random.Random(seed)
    universe = [r.getrandbits(64) for _ in range(40)]
    sets = []
    for k in range(25):
        base = r.choice(sets)[2] if sets and r.random() < 0.7 else []
        order = sorted({x for x in base if r.random() < 0.9} | set(r.sample(universe, r.randint(1, 5))), key=universe.index)[:12]
        sets.append((bytes([k]) * jaccard_join.NAME, r.randint(40, 60), order))
    want = set()
    for i, (a, m, x) in enumerate(sets):
        for b, n, y in sets[:i]:
            if (both := set(x) & set(y)) and (g := min(both, key=universe.index)) is not None and n <= jaccard_join.reach(m, x.index(g)) and m <= jaccard_join.reach(n, y.index(g)):
                want.add((b, a))
    rows = found_in_boxes(sets, 7)
    together = {(x["a"], x["b"]) for x in rows if x["kind"] == 2}
    size = {a: n for a, n, _ in sets}
    boxes = {}
    for x in rows:
        if x["kind"] == 1:
            boxes.setdefault(x["gid"], []).append((x["a"], x["reach"]))
    for box in boxes.values():
        together |= {(a, b) for a, far in box for b, back in box if a < b and size[b] <= far and size[a] <= back}
    assert want and want <= together


def test_points_bound_the_overlap():
    rng = np.random.default_rng(12)
    for n, m in ((1, 1), (100, 120), (2000, 2600), (2040, 2060), (9000, 7000)):
        common = rng.integers(0, 1 << 63, min(n, m) // 8, np.uint64) * np.uint64(2)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k - len(common), np.uint64) * np.uint64(2)])) for k in (n, m)]
        x, y = (jaccard_join.counts_of(jaccard_join.point(s)) for s in sets)
        shared = len(np.intersect1d(*sets))
        assert shared <= jaccard_join.overlap_bound(x, y) <= min(n, m) and (x.sum(), y.sum()) == (n, m)
        assert n < 100 or jaccard_join.overlap_bound(x, y) < jaccard_join.needed(n, m)


def test_reach_is_the_bound_of_the_minima():
    for n in range(1, 60):
        for place in range(n // 4 + 1):
            for other in range(1, 90):
                assert (other <= jaccard_join.reach(n, place)) == (n - place >= jaccard_join.needed(n, other))


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (5, base + " x"), (5, "quite another text with words of its own"), (None, base + " y")]
    kept = jaccard_join.one_of_each(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, base), (5, "quite another text with words of its own")])


def test_one_of_each_without_ids_and_with_clashing_names(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, base + " x"), (None, base + " y"), (None, "on its own"), (None, None), (7, "another on its own")]
    df = frame(spark, rows).withColumns({x: F.lit(1) for x in ("gone_id", "gone_mark", "mark", "component_id", "_gone", "_mark", "n", "label")})
    kept = jaccard_join.one_of_each(df)
    got = kept.collect()
    assert kept.columns == df.columns and len(got) == 4 and all(r.gone_id == 1 and r._mark == 1 for r in got)
    assert sum((r.text or "").startswith(base) for r in got) == 1


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 1)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[200 + i] for i in range(50)} == {100}


# The pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as p

    docs, columns = table(spark, SMALL, "documents"), None
    kept = p.STAGES[0][1](spark, docs, SMALL)
    assert kept.columns == docs.columns and 0.5 < kept.count() / docs.count() < 1
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = p.STAGES[1][1](spark, kept, SMALL)
    alive = {k for k, _ in helpers.exact(rows).values()}
    rows = [r for r in rows if r[0] in alive]
    assert sorted((r.doc_id, r.text) for r in one.collect()) == sorted(rows)
    two = p.STAGES[2][1](spark, one, SMALL)
    near = helpers.jaccard(rows)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    assert sorted((r.doc_id, r.text) for r in two.collect()) == sorted(rows)
    three = p.STAGES[3][1](spark, two, SMALL)
    want = helpers.substring(rows)
    texts = {r.doc_id: r.text for r in three.collect()}
    assert three.columns == docs.columns and set(texts) == {r[0] for r in rows}
    assert all(" ".join(helpers.WORDS.findall(t)) and hashlib.sha256(" ".join(helpers.WORDS.findall(t)).encode()).hexdigest() == want[i][2] for i, t in texts.items() if t.strip())
    packed = p.STAGES[4][1](spark, three, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)
    assert p.run(spark, SMALL).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30), spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, None, None, None, None), (5, "a b", "en", "s", 3), (5, "a b", "en", "s", 3)], docs.schema)
    for name, part in (("odd", docs.unionByName(odd).withColumn("kind", F.lit(1))), ("none", docs.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert p.run(spark, f"{tmp_path}/odd").count() > 20
    assert p.run(spark, f"{tmp_path}/none").count() == 0
