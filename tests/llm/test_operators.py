"""The training-data operators against brute force, round trips and held-out accuracy."""

import itertools
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreforge.llm import lang, leak, minhash, neardup, pack, repeat, runs, setjoin, split, vectors

# --- 1: splitting ---


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\r\té🧠", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_cut_loses_nothing_and_keeps_limits(text, limit, overlap):
    pieces = split.cut(text, limit, overlap)
    body = text.strip(split.BLANKS)
    assert "".join(text[f:e] for _, e, f in pieces) == body
    assert all(0 < e - s <= limit and 0 <= f - s <= overlap for s, e, f in pieces)
    assert (len(pieces) > 1) == (len(body) > limit)


@pytest.mark.parametrize("limit,overlap", [(n, k) for n in (1, 2, 3, 4, 5, 6, 8, 10, 20, 50) for k in {0, 1, n // 2, n - 2, n - 1} if 0 <= k < n])
def test_cut_ends_for_every_limit(limit, overlap):
    r = random.Random(limit * 100 + overlap)
    for alphabet in ("ab .\n", "a\r\n", "e\u0301", "a\u200d\ufe0f", "ab"):
        for size in (0, 1, limit, limit + 1, 3 * limit, 150):
            text = "".join(r.choice(alphabet) for _ in range(size))
            pieces = split.cut(text, limit, overlap)
            assert "".join(text[f:e] for _, e, f in pieces) == text.strip(split.BLANKS)
            assert all(0 < e - s <= limit and 0 <= f - s <= overlap and f < e for s, e, f in pieces)


def test_cut_prefers_strong_boundaries():
    text = ("A sentence of some words. " * 20).strip() + "\n\n" + ("Another sentence here. " * 25).strip()
    (_, end, _), (start, _, fresh) = split.cut(text, 1000, 100)
    assert text[:end].endswith("\n\n") and fresh == end and text[start:].startswith("A sentence")
    assert [e - s for s, e, _ in split.cut("x" * 2500, 1000, 100)] == [900, 900, 900]
    with pytest.raises(ValueError):
        split.cut("x", 10, 10)


def test_pieces(spark):
    rows = [("t", 1, "word " * 500, "x"), ("t", 2, None, "x"), ("t", 3, " \r\n", "x"), ("t", 4, "  short ", "x"), ("t", 1, "word " * 500, "x")]
    df = spark.createDataFrame(rows, "table_name string, row_id long, text string, start string")
    got = split.pieces(df).collect()
    assert {r["row_id"] for r in got} == {1, 4} and [r["text"] for r in got if r["row_id"] == 4] == ["short"]
    one = sorted((r["ord"], r["text"], r["overlap"]) for r in got if r["row_id"] == 1)[::2]
    assert "".join(t[o:] for _, t, o in one) == ("word " * 500).strip() and all(len(t) <= 1000 for _, t, _ in one)
    assert split.pieces(df.limit(0)).count() == 0


# --- 2: similar sets ---


def test_similar_sets(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["hot"]
    rows = [(i, r.sample(words[:-1], r.randint(3, 8)) + ["hot"] * r.randint(0, 1)) for i in range(150)]
    rows += [(1000 + i, rows[i][1][1:] + [f"n{i}"]) for i in range(60)] + [(2000 + i, [*reversed(rows[i][1]), rows[i][1][0]]) for i in range(20)]
    rows += [(3000, None), (3001, []), (3002, [None, "a"]), (3003, [f"big{k}" for k in range(300)]), (3004, [f"big{k}" for k in range(20, 300)]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "id long, items array<string>, n string")
    sets = {i: frozenset(x for x in s if x) for i, s in rows if s and len({x for x in s if x}) >= 3}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    members, reps = setjoin.classes(df, least=3)
    pairs = setjoin.similar_pairs(reps, 0.6)
    got = {(x["id_a"], x["id_b"]) for x in runs.expand_pairs(pairs, members).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    links = {x["id"]: x["links"] for x in runs.links_per_id(pairs, members).collect()}
    assert links == {i: sum(i in p for p in got) for i in sets}
    left, right = df.filter("id < 1000"), df.filter("id >= 1000")
    cross = {(x["id_left"], x["id_right"]) for x in setjoin.similar_between(left, right, 0.6, least=3).collect()}
    assert cross <= {p for p in want if p[0] < 1000 <= p[1]} and len(cross) >= 0.97 * len({p for p in want if p[0] < 1000 <= p[1]})
    empty = setjoin.classes(df.limit(0))
    assert setjoin.similar_pairs(empty[1], 0.6).count() == 0


def test_hot_groups_are_split_without_losing_pairs(spark, monkeypatch):
    df = spark.range(90).select(F.when(F.col("id") < 60, 1).otherwise(F.col("id") % 4 + 2).cast("long").alias("key"), "id", F.array(F.lit(0)).alias("payload"))
    every = lambda b: runs.lags(b)
    keys = {r["id"]: r["key"] for r in df.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if keys[a] == keys[b]}
    spread = runs.split_hot(df, df, hot_rows=20, block=7, share=1)
    assert spread.groupBy("key").count().agg(F.max("count")).first()[0] < 40
    same = lambda r: r
    for limit in (20, 2, 1000):
        assert {tuple(r) for r in runs.pairs_in_runs(df, same, every, hot_rows=limit, share=2).collect()} == want
    deep = runs.pairs_in_runs(df, same, every, hot_rows=20, share=1, deeper=F.col("id") % 2)
    assert {tuple(r) for r in deep.collect()} == {(a, b) for a, b in want if keys[a] != 1 or a % 2 == b % 2}
    monkeypatch.setattr(runs, "LISTED", 0)
    assert {tuple(r) for r in runs.pairs_in_runs(df, same, every, hot_rows=20, share=1).collect()} == want


def test_large_neighbourhoods_are_deepened():
    key = np.array([1] * 6 + [2] * 3)
    rest = np.array([0, 0, 1, 1 << 20, 1 << 20, 2 << 20, 0, 5, 9], np.int64)
    assert setjoin.neighbourhoods(key, rest, 2, small=9).tolist() == [0] * 6 + [1] * 3
    assert setjoin.neighbourhoods(key, rest, 2, small=3).tolist() == [0, 0, 0, 1, 1, 2, 3, 3, 3]
    assert setjoin.neighbourhoods(key, rest, 2, small=2).tolist() == [0, 0, 1, 2, 2, 3, 4, 5, 6]
    assert setjoin.neighbourhoods(key, rest, 0, small=1).tolist() == [0] * 6 + [1] * 3


def test_minhash_estimates_similarity():
    a, b = minhash.seeds(400)
    x, y = np.arange(0, 300), np.arange(100, 400)
    s = minhash.signatures(np.concatenate([x, y]), np.array([0, 300, 600, 600]), a, b)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.08 and (s[2] == minhash.EMPTY).all()


# --- 3: vectors ---


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 64))
    vs = [(i, v) for i, v in enumerate(base)]
    vs += [(1000 + i, base[i % 40] + rng.standard_normal(64) * rng.uniform(0.05, 0.4)) for i in range(200)]
    vs += [(2000 + i, base[7]) for i in range(9)] + [(3000, np.zeros(64)), (3001, np.full(64, np.nan)), (3002, base[0][:16])]
    rows = [(i, [float(x) for x in v]) for i, v in vs] + [(3003, None), (5, [float(x) for x in base[5]])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and len(v) == 64 and np.isfinite(v).all() and any(v)}
    ids = sorted(ok)
    m = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    cos = m @ m.T
    np.fill_diagonal(cos, -2)

    def best(k, floor):
        return {(ids[a], ids[b]) for a in range(len(ids)) for b in sorted(range(len(ids)), key=lambda b: (-round(cos[a, b], 9), ids[b]))[:k] if cos[a, b] >= floor}

    want = best(5, 0.9)
    got = {(r["id"], r["neighbour"]) for r in vectors.top_close(df).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got) <= len(want) * 1.02
    assert all(cos[ids.index(a), ids.index(b)] >= 0.9 - 1e-6 for a, b in got)
    near = {(r["id"], r["neighbour"]) for r in vectors.nearest(df.filter("id % 50 = 0"), df).collect()}
    want = {p for p in best(5, -2) if p[0] % 50 == 0}
    assert len(near & want) >= 0.9 * len(want) and {a for a, _ in near} == {a for a, _ in want}
    assert vectors.top_close(df.limit(0)).count() == 0 and vectors.nearest(df.limit(0), df.limit(0)).count() == 0


# --- 4: near-duplicates ---


def test_near_duplicates(spark):
    r = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    texts = [(i, " ".join(r.choices(words, k=r.randint(20, 80)))) for i in range(120)]

    def edit(t):
        w = t.split()
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = [r.choice(words)]
        return " ".join(w)

    texts += [(1000 + i, edit(texts[i % 60][1])) for i in range(120)] + [(2000 + i, texts[3][1].upper() + "!") for i in range(5)]
    texts += [(3000, None), (3001, ""), (3002, "too short"), (3003, "the same " * 3000), (7, texts[7][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "id long, text string, shingles int")
    sh = {}
    for i, t in texts:
        w = leak._WORD.findall((t or "").lower())
        if len(w) >= 10:
            sh[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = {(a, b) for a, b in itertools.combinations(sorted(sh), 2) if len(sh[a] & sh[b]) >= 0.5 * len(sh[a] | sh[b])}
    members, pairs = neardup.near_duplicates(df, size=3, threshold=0.5)
    got = {(x["id_a"], x["id_b"]) for x in runs.expand_pairs(pairs, members).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    top = {i: i for i in sh}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in sorted(got):
        x, y = sorted((find(a), find(b)))
        top[y] = x
    assert {x["id"]: x["group_id"] for x in neardup.groups(members, pairs).collect()} == {i: find(i) for i in sh}
    assert neardup.near_duplicates(df.limit(0))[1].count() == 0


def test_short_texts_keep_their_rows(spark, tmp_path):
    from loreforge.llm import queries

    six, nine = "copy of only six words here", "one two three four five six seven eight nine"
    rows = [(1, six), (2, six.upper()), (3, nine), (4, nine), (5, "two words"), (6, "Two words."), (7, "two other"), (8, ""), (9, ""), (10, None), (11, None), (12, " ".join(f"w{i}" for i in range(30))), (13, "!?")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["id"]: (x["class_id"], x["copies"], x["links"]) for x in queries.p4_documents(spark, str(tmp_path)).collect()}
    twice = {i: (c, 2, 1) for i, c in ((1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (8, 8), (9, 8))}
    assert got == twice | {i: (i, 1, 0) for i in (7, 10, 11, 12, 13)}
    les = spark.createDataFrame([*rows, (14, rows[11][1])], "id long, content string")
    les.selectExpr("*", "timestamp'2026-01-01' AS updated_at", "timestamp'2026-01-01' AS loaded_at").write.parquet(f"{tmp_path}/lessons.parquet")
    assert {tuple(x) for x in queries.p4_groups(spark, str(tmp_path)).collect()} == {(i, i) for i, _ in rows} | {(14, 12)}


# --- 7: languages ---


def test_languages_on_held_out_lessons(spark, data):
    from loreforge.llm import queries

    sf = data.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{sf}/lessons.parquet").select("id", F.col("content").alias("text"))
    labels = lang.latest_labels(spark.read.parquet(f"{sf}/lesson_labels.parquet"))
    even, odd = labels.filter("id % 2 = 0"), labels.filter("id % 2 = 1 and lang in ('en', 'pl', 'de', 'fr', 'es')")
    model = lang.train(lang.training_sample(rows, even))
    got = lang.document_languages(rows, model).join(odd, "id").filter(F.size("languages") == 1)
    right = got.filter(F.col("lang") == F.element_at("languages", 1)).count()
    assert right >= 0.85 * got.count() > 50  # a tenth of the labels are wrong by design
    assert queries.p7_segments(spark, data).filter("whole and lang is null").count() <= 2


def test_language_segments_and_mixtures(spark):
    model = lang.train([])
    de, en = "Der Hund und die Katze sind nicht mit dem Ball auf der Wiese.", "The dog and the cat are not with the ball on the meadow."
    texts = [de, f"{en} {de}", None, "", "`cmd x`\n| a | b |", f"- {en}\n- {en}"]
    spans, doc, score, post, pi, _ = lang.infer(model, texts)
    n = lang.whole_sentences(spans, doc, score, post, len(texts))
    assert [[lang.LANGS[k] for k in np.flatnonzero(r)] for r in n] == [["de"], ["en", "de"], [], [], [], ["en"]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, main string")
    out = {r["id"]: r for r in lang.document_languages(df, model).collect()}
    assert out[0]["main"] == "de" and out[2]["main"] is None and out[2]["confidence"] is None and out[1]["languages"] == ["en", "de"]
    assert lang.document_languages(df.limit(0), model).count() == 0 and lang.segment_languages(df, model).count() >= 5
    label = spark.createDataFrame([("EN_gb",), ("Polish",), ("und",), (None,), ("it",), (" deu ",)], "l string")
    assert [r[0] for r in label.select(lang.label_language(F.col("l"))).collect()] == ["en", "pl", None, None, "other", "de"]


# --- 8: packing ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_bin_completion(sizes):
    boxes = pack.complete(sizes, 30)
    assert sorted(i for b in boxes for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 30 for b in boxes)
    assert -(-sum(sizes) // 30) <= len(boxes) <= len(pack.best_fit(sizes, 30))


def test_bin_completion_beats_best_fit():
    sizes = [6, 5, 5, 4, 4, 3, 3]  # best fit decreasing needs four containers of ten
    assert len(pack.complete(sizes, 10)) == 3


def test_pack(spark):
    r = random.Random(2)
    rows = [(i, r.randint(0, 700)) for i in range(900)] + [(1000, 5000), (1001, 2048), (1002, None), (None, 5), (3, 1)]
    got = pack.pack(spark.createDataFrame(rows, "id long, tokens long"), 1024, 300).collect()
    by, size = {}, {}
    for x in got:
        size[x["id"]] = size.get(x["id"], 0) + x["tokens"]
        if x["container"] is not None:
            by.setdefault(x["container"], []).append((x["start"], x["start"] + x["tokens"]))
    want = {}
    for i, t in rows:
        if i is not None:
            want[i] = max(want.get(i, 0), t or 0)
    assert size == want
    for spots in by.values():
        spots.sort()
        assert spots[0][0] == 0 and spots[-1][1] <= 1024 and all(a[1] == b[0] for a, b in itertools.pairwise(spots))
    assert len(by) <= 1.02 * sum(want.values()) / 1024 + 3
    assert pack.pack(spark.createDataFrame([], "id long, tokens long")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "some words here", None), (2, None, 7), (3, "", None)], "id long, text string, n_tokens int")
    got = {r["id"]: r["tokens"] for r in pack.count_tokens(df).collect()}
    assert got[1] == 3 and got[2] == 0 and got[3] == 0
    assert {r["id"]: r["tokens"] for r in pack.count_tokens(df, None).collect()} == {1: 4, 2: 7, 3: 0}


def test_tokens_that_cannot_be_counted(spark, data, tmp_path, monkeypatch):
    from loreforge.llm import queries

    df = spark.createDataFrame([(1, "some words here", 7)], "id long, text string, n_tokens int")
    none, short = str(tmp_path / "none.tiktoken"), str(tmp_path / "short.tiktoken")
    with open(pack.TOKENIZER, "rb") as f:
        (tmp_path / "short.tiktoken").write_bytes(b"".join(f.readlines()[:1000]))
    for path, error in ((none, FileNotFoundError), (short, ValueError)):
        with pytest.raises(error):
            pack.count_tokens(df, path)
    assert pack.at_hand(none) is None and pack.at_hand(short) == short
    assert queries.p8_fill(spark, data).first()["counted"] is True
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    with pytest.raises(ImportError):
        pack.count_tokens(df)
    got = queries.p8_containers(spark, data).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.some("counted").alias("counted"))
    assert {(r["doc_id"], r["tokens"], r["counted"]) for r in got.collect()} == {(r["doc_id"], r["tokens"], False) for r in queries.p8_whole(spark, data).collect()}
    assert queries.p8_fill(spark, data).first()["counted"] is False


def test_containers_of_many_texts():
    sizes = [12, 11, 9, 9, 5, 5, 4, 4]
    assert len(pack.best_fit(sizes, 30)) > len(pack.complete(sizes, 30)) == 2
    assert max(map(len, pack.complete(sizes, 30))) > 4


# --- 9: leaks ---


def test_leaks(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)] + ["Größe", "ﬁne", "x_y"]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(r.randint(3, 50)))) for i in range(40)] + [(90, None), (91, ""), (3, "w1")]
    docs = []
    for d in range(200):
        body, p = say(40), items[d % 40][1].split()
        if d % 4 == 1:
            k = r.randrange(max(1, len(p) - 12))
            body[10:10] = p[k : k + r.randint(8, 16)]
        elif d % 4 == 2:
            body[10:10] = [w if r.random() > 0.1 else "zzz" for w in p]
        elif d % 4 == 3:
            half = len(p) // 2
            body = p[half:] + body + p[:half]
        docs.append((d, " ".join(body).upper() if d % 3 == 0 else ", ".join(body)))
    docs += [(900, None), (901, ""), (5, docs[5][1])]
    want = set()
    for i, p in {i: p for i, p in items if p and (i != 3 or p != "w1")}.items():
        w = leak.words(p)
        g4, g12 = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in (4, 12))
        for d, t in docs:
            v = leak.words(t)
            h4, h12 = ({tuple(v[k : k + n]) for k in range(len(v) - n + 1)} for n in (4, 12))
            if g12 & h12 or (g4 and len(g4 & h4) >= 0.5 * len(g4)):
                want.add((d, i))
    D, I = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(i, p, "x") for i, p in items], "item_id long, passage string, id string")  # noqa: E741
    assert {tuple(x) for x in leak.leaked(D, I).collect()} == want and len(want) > 80
    assert leak.overlaps(D.limit(0), I).count() == 0 and leak.overlaps(D, I.limit(0)).count() == 0


def _leak_truth(docs, items):
    want = set()
    for i, p in items:
        w = leak.words(p)
        g4, g12 = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in (4, 12))
        for d, t in docs:
            v = leak.words(t)
            h4, h12 = ({tuple(v[k : k + n]) for k in range(len(v) - n + 1)} for n in (4, 12))
            if g12 & h12 or (g4 and len(g4 & h4) >= 0.5 * len(g4)):
                want.add((d, i))
    return want


def test_leaks_in_short_fragments(spark):
    """Passages cut into pieces of four and five words, whole or partly, in any order, and passages that repeat themselves."""
    r = random.Random(14)
    words = [f"w{i}" for i in range(90)]
    items = [(i, " ".join(r.choices(words[: 12 if i % 5 == 0 else 90], k=r.choice((5, 12, 17, 40, 60))))) for i in range(30)]
    docs = []
    for i, p in items:
        w = p.split()
        for size in (4, 5, 6):
            for kept in (0.3, 0.5, 0.55, 0.97):
                bits = [w[k : k + size] for k in range(len(w) - size + 1)]
                bits = r.sample(bits, round(kept * len(bits)))
                docs.append((len(docs), " ".join(x for b in bits for x in [*b, f"x{r.random()}"])))
    want = _leak_truth(docs, items)
    D, I = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item_id long, passage string")  # noqa: E741
    assert {tuple(x) for x in leak.leaked(D, I).collect()} == want and 100 < len(want) < len(docs)


def test_words_without_marks():
    text = "Łódź a\u0301b e\u0323\u0302 ﬁne x_y 12³ \u0915\u094d\u0937"
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    assert leak.words(text) == leak._WORD.findall(plain.lower())


def test_leak_index_in_slices(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"p{i}x{k}" for k in range(20))) for i in range(9)], "item_id long, passage string")
    docs = items.select(F.col("item_id").alias("id"), F.concat(F.lit("before "), "passage").alias("text"))
    monkeypatch.setattr(leak, "SLICE", 200)
    assert {tuple(x) for x in leak.leaked(docs, items).collect()} == {(i, i) for i in range(9)}


def test_tolerant_overlap():
    one = lambda n: np.array([n])
    a = np.arange(1, 31, dtype=np.uint64)
    tol = lambda x, y, diag: leak._tolerant(x, one(0), one(len(x)), y, one(0), one(len(y)), one(diag)).tolist()
    b = a.copy()
    b[[8, 16]] = 99
    assert tol(a, b, 0) == [30] and tol(a, b[5:], 5) == [25] and tol(a[5:], b, -5) == [25] and tol(a, b, 40) == [0]
    b[17] = 98
    assert tol(a, b, 0) == [16]
    b[0] = 97
    assert tol(a, b, 0) == [15]
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    assert leak._tolerant(x, np.array([0, 30]), np.array([30, 30]), y, np.array([0, 30]), np.array([30, 30]), np.array([0, 0])).tolist() == [15, 15]


# --- 10: repetition ---


def _share(text):
    return repeat.repeated_share(repeat.WORDS.findall(text.lower()))


def test_repetition(spark):
    r = random.Random(6)
    say = lambda n: " ".join(r.choice("alpha beta gamma delta pool cache queue row table index mail port file".split()) + str(r.randint(1, 999)) for _ in range(n))
    rows = [(i, say(200)) for i in range(20)] + [(100 + i, f"{say(40)} " * (2 + i % 5)) for i in range(20)] + [(200, None), (201, ""), (202, "spam " * 200_000), (203, "a b c"), (4, "x")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "id long, text string, runs int")
    want = {i for i, t in rows if t and (n := _share(t))[0] >= 40 and n[1] >= 0.3}
    assert {x["id"] for x in repeat.repetitive(df).collect()} == want and 202 in want
    bands = {x["id"]: x for x in repeat.bands(df, exact=None).collect()}
    assert bands[200]["band"] == "empty" and bands[201]["runs"] == 0 and bands[4]["bytes"] > 1 and bands[202]["band"] == "repetitive"
    assert repeat.bands(df.limit(0)).count() == 0


def test_repeats_in_texts_that_hardly_compress(spark):
    r = random.Random(11)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(n))
    rows = [(k, f"{(a := say(35 * k))} {say(30 * k)} {a.upper() if k % 2 else a}") for k in (1, 3, 5, 10, 25, 60)]
    df = spark.createDataFrame([*rows, (99, say(400))], "id long, text string")
    assert all(_share(t)[1] >= 0.3 for _, t in rows)
    bands = {x["id"]: x["band"] for x in repeat.bands(df).collect()}
    assert bands.pop(99) in ("plain", "incompressible") and set(bands.values()) == {"repetitive"}
    assert {x["id"] for x in repeat.repetitive(df).collect()} == {k for k, _ in rows}


def _repeating(r, n, kind):
    """About ``n`` random words with many repeated runs of five, in stretches as hard to compress as possible."""
    new = lambda k: [f"{r.getrandbits(40):x}" for _ in range(k)]
    w = new(max(10, n // 4))
    while len(w) < n:
        if kind == "single":  # runs of five that stand alone
            k = r.randrange(len(w) - 5)
            w += w[k : k + 5] + new(1)
        elif kind == "chained":  # each run of five continues the last one, but comes from another place
            k = r.randrange(len(w) - 9)
            a = w[k : k + 5]
            w += a + new(3) + a[1:] + new(1) + a[2:] + new(1) + a
        elif kind == "long":
            k = r.randrange(len(w) // 2)
            w += w[k : k + n // 5] + new(n // 20)
        else:  # few different words
            w += [w[r.randrange(2)] for _ in range(8)] + new(2)
    return w


@pytest.mark.parametrize("kind", ["single", "chained", "long", "few"])
def test_no_repetitive_text_is_above_its_limit(kind):
    r, ratio, of, seen = random.Random(kind), repeat._compressor(), repeat.Hashes(), 0
    for n in (44, 60, 90, 150, 300, 700, 2_000, 6_000, 40_000):
        for _ in range(12 if n < 5_000 else 2):
            w = _repeating(r, n, kind)
            share = repeat.repeated_share(w)[1]
            for cut in (0.05, 0.1, 0.15, 0.2, 0.3, 0.5):
                if share >= cut:
                    seen += 1
                    assert ratio(repeat.stream(w, of).tobytes()) <= repeat.limit(len(w), cut)
    assert seen > 50


def test_far_repeats_of_a_long_text():
    block = [f"{i:x}{i * 7919 % 10007}" for i in range(500_000)]
    data, ratio = repeat.stream(block, repeat.Hashes()).tobytes(), repeat._compressor()
    assert len(data) > 1 << 20 and ratio(data) > 0.95 and ratio(data + data) < 0.6
