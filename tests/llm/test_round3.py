"""Phrase mining, whitening and top-k search against brute force, on small tables with awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickwork.llm import near_dedup, phrases, topk, whitening

VECTORS = "vec_id long, embedding array<float>, rank string, label int"


# 11 phrases


def mined(rows, top, least):
    """Every language's phrases by plain counting."""
    low, counts, totals, out = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}, Counter(), set()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in (1, 2, 3, 4):
                c.update(zip(*[w[i:] for i in range(n)]))
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        left = []
        for p, a in often.items():
            if p in held and 100 * held[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, lr, r, totals[lang], -s) for i, (s, a, p, lr, r) in enumerate(sorted(left)[:top])}
    return out


def corpus(seed, size):
    """Few words, so that phrases repeat; ideographs, A-Z and letters beyond, runs of one word, awkward spaces."""
    rng, words = random.Random(seed), ["New", "york", "city", "hall", "of", "the", "É", "日本", "a", "a", "a", "\x00b", "x\x85y", "\xa0"]
    out = [(None, "und a a a a a"), ("und", "a a a"), ("en", None), ("en", ""), (None, None), ("de", " \t\n.,"), ("en", "word " * 3000), ("xx", "new york city hall")]
    for _ in range(size):
        parts = [rng.choice(words) for _ in range(rng.randint(1, 30))]
        out.append((rng.choice(["en", "en", "de", None]), "".join(p + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", "\r"]) for p in parts)))
    return out + [("en", "of the New York city hall, of the")] * 40


@pytest.mark.parametrize("top,least", [(5, 2), (2000, 30), (40, 3), (1, 1)])
def test_phrases(spark, top, least, monkeypatch):
    monkeypatch.setattr(phrases, "BUFFER_WORDS", 700)
    rows = corpus(top, 150)
    docs = spark.createDataFrame([(i, t, g, 1) for i, (g, t) in enumerate(rows)], "n long, text string, lang string, score int").repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, top, least).collect()}
    assert got == mined(rows, top, least)


def test_texts_are_cut_alike_in_any_slices():
    for _, text in corpus(9, 60):
        whole = [w for part in phrases._pieces(text or "") for w in part]
        for size in (1, 7, 64):
            assert [w for part in phrases._pieces(text or "", size) for w in part] == whole


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0


def test_no_extension_passes_its_bound(spark):
    """The bound by which prefixes are left unexpanded holds for every phrase that starts with them."""
    rows = corpus(3, 200)
    c = Counter()
    for _, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text or ""):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3, 4):
                c.update(zip(*[w[i:] for i in range(n)]))
    for p, a in c.items():
        for n in range(2, len(p)):
            score = min(2_000_000 * a // (c[p[:k]] + c[p[k:]]) for k in range(1, len(p)))
            assert score <= 2_000_000 * c[p[:n]] // (c[p[:1]] + c[p[:n]])


# 12 whitening


def vectors(rng, n, d):
    base = rng.standard_normal((n, d)) * np.linspace(0.3, 0.05, d)
    rows = [(i, [float(x) for x in v], "clash", 1) for i, v in enumerate(base.astype(np.float32))]
    bad = [(n, None, None, None), (n + 1, [None] * d, "x", 1), (n + 2, [math.nan] * d, "x", 1), (n + 3, [math.inf] + [0.0] * (d - 1), "x", 1), (n + 4, [], "x", 1)]
    return [*rows, *bad, rows[0], (None, rows[1][1], "x", 1)]


@pytest.mark.parametrize("d", [5, 20, 40])
def test_whitening(spark, d):
    rows = vectors(np.random.default_rng(d), 300, d)
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    fit = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in r[1]] for r in fit])
    n, k = len(fit), min(d, 8)
    assert len(out) == n * k and {r["n"] for r in out} == {n} and {r["component"] for r in out} == set(range(1, k + 1))
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1][:k], c @ u[:, ::-1][:, :k] / np.sqrt(e[::-1][:k])
    deviation = ((n * x - x.sum(0)) ** 2).sum(1)
    for j in range(k):
        of = {r["vec_id"]: r for r in out if r["component"] == j + 1}
        got = np.array([of[r[0]]["whitened"] for r in fit])
        assert min(np.abs(got - w[:, j]).max(), np.abs(got + w[:, j]).max()) < 1e-8
        assert [int(of[r[0]]["deviation"]) for r in fit] == deviation.tolist()
        assert abs(of[0]["explained"] / (e[j] / np.trace(c.T @ c / n)) - 1) < 1e-9
    assert out[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in out}) == 1


def test_whitening_without_variance(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()

    assert run([]) == [] and run([(1, None, "x", 1)]) == []
    assert run([(i, [0.5] * 30, "x", 1) for i in range(4)]) == []
    line = run([(i, [i / 8] * 30, "x", 1) for i in range(4)])  # rank one: one component
    assert {r["component"] for r in line} == {1} and abs(sum(r["whitened"] ** 2 for r in line) / 4 - 1) < 1e-9
    uneven = run([(1, [0.5, 0.25], "x", 1), (2, [0.25, 0.5], "x", 1), (3, [0.1], "x", 1)])
    assert {r["vec_id"] for r in uneven} == {1, 2}


def test_deviations_beyond_a_long():
    y = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert whitening._deviations(y) == [1 << 81, 25]
    assert whitening._spread(np.array([[1 << 51]]), 1 << 20, np.array([5], dtype=object)).tolist() == [[(1 << 71) - 5]]


# 13 top-k


def nearest(rows, k):
    fit = [(i, r[0], [math.floor(256 * float(x)) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = Counter()
    for i, q, x in fit:
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), v is None, v or 0) for j, v, y in fit if j != i)[:k]
            out.update((q, n + 1, None if none else v, -s) for n, (s, none, v) in enumerate(scored))
    return out


@pytest.mark.parametrize("block", [4, 64])
def test_topk(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 12))
    made = np.concatenate([centres[i % 6] + 0.1 * rng.standard_normal((1, 12)) for i in range(500)]).astype(np.float32)
    rows = [(i - 60, [float(x) for x in v], "clash", 1) for i, v in enumerate(made)] + vectors(rng, 60, 12) + [(700, [0.5], "short", 1), (750, [-1e5] * 12, "far", 1)]
    rows += [(i, rows[3][1], "copy", 1) for i in range(900, 960)]
    out = topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 50 == 0, 5, block_size=block, chunk_blocks=3, batch_size=3)
    assert Counter(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == nearest(rows, 5)


def test_topk_of_little(spark):
    def run(rows):
        return sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).collect())

    assert run([]) == [] and run([(1, [0.5], "x", 1)]) == [] and run([(50, [0.5], "x", 1)]) == [] and run([(None, None, None, None)]) == []
    assert run([(50, [0.5], "x", 1), (None, [1.0], "x", 1)]) == [(50, 1, None, 128 * 256)]


def test_topk_sends_queries_in_parts(spark, monkeypatch):
    """No join or copy carries vectors: queries go to all chunks a part of bounded size at a time, and the result is that of all pairs."""
    rng, plans, real = np.random.default_rng(2), [], topk.stored

    def kept(df, label, *more):
        plans.extend([df._jdf.queryExecution().optimizedPlan().toString()] if label == "found" else [])
        return real(df, label, *more)

    monkeypatch.setattr(topk, "stored", kept)
    monkeypatch.setattr(topk, "PASS_BYTES", 6 * (4 * 12 + 16 + 24 * 5), raising=False)
    rows = [(i, [float(x) for x in v], "", 1) for i, v in enumerate(rng.standard_normal((1000, 12)).astype(np.float32))]
    out = topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 50 == 0, 5, block_size=8, chunk_blocks=4, batch_size=3)
    assert Counter(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == nearest(rows, 5)
    assert len(plans) > 2 and not any("Join" in p or "Generate" in p for p in plans)


def test_blocks_below_the_kth_score_are_not_read():
    """A chunk is left once no block's bound reaches the kth score."""
    vectors = np.concatenate([np.full((64, 4), 9 - i, np.int32) for i in range(9)])
    bounds = np.array([[4 * (9 - i) for i in range(9)]])
    read, plain = [], topk._times

    def spy(a, b):
        read.append(len(b))
        return plain(a, b)

    topk._times = spy
    try:
        ids = np.arange(len(vectors))
        found = topk.search_chunk(np.array([-1]), np.ones((1, 4), np.int32), np.array([36]), ids, ids, vectors, bounds, 5)
    finally:
        topk._times = plain
    assert len(read) == 1 and found[0][1].tolist() == [36] * 5 and found[0][2].tolist() == [0, 1, 2, 3, 4]


def test_similar_is_the_edit_distance():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = rng.integers(0, int(rng.choice([4, 40, 400])), int(rng.integers(1, 60))).astype(np.uint32)
        b = list(a)
        for _ in range(int(rng.integers(0, 1 + len(a) // 3))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = [int(rng.integers(0, 400))] * int(rng.integers(0, 2))
        b = np.array(b, np.uint32)
        longest = max(len(a), len(b))
        exact = near_dedup.distance_within(a.tolist(), b.tolist(), longest)
        assert near_dedup.similar(a, b) == (exact <= 0.2 * longest + 1e-9)


def test_near_duplicates_count_rows_and_links(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    near = [*words[:20], "other", *words[21:]]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(near)), (4, "alone"), (5, None), (6, None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    found, links = near_dedup.near_duplicates(spark.read.parquet(path))
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"]) for r in found.collect()}
    assert got == {1: (1, 3, 1), 2: (1, 3, 1), 3: (1, 3, 1), 4: (4, 1, 0), 5: (5, 1, 0), 6: (6, 1, 0)}
    assert links.count() == 1


def test_total_counter_holds_few_pieces(monkeypatch):
    """A worker's table of pieces stays within its bound, and what has left it counts as before."""
    import public_tokenizers

    from wickwork.llm import token_counts

    monkeypatch.setattr(token_counts, "TOTAL_WORDS", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, rng = token_counts.TotalCounter(path), random.Random(5)
    prefixes = token_counts.prefix_counter(path)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdeé'1", k=rng.randint(1, 4))) for _ in range(25)) + " the the end"
        assert small.total(text) == sum(x - 256 * (x > 127) for x in prefixes.changes(text))
        assert len(small) + len(small.old) <= 20
    assert not hasattr(small.rules, "found")  # prefixes alone need it


def test_common_grams_are_no_rows(spark):
    """Grams that more texts share than a small group holds are flagged once a text; the pairs among such texts are found all the same."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = [word() for _ in range(60)]
    rests = [[word() for _ in range(30)] for _ in range(160)]
    copies = [[word() if k % 3 == 0 else w for k, w in enumerate(r)] for r in rests[:5]]
    texts = [" ".join(passage + r) for r in rests] + [" ".join(passage + c) for c in copies]
    docs = spark.createDataFrame(list(enumerate(texts)), "_rid long, text string")
    table = near_dedup.stored(near_dedup.sketched(docs), "sketch").withColumnRenamed("rid", "node")
    search = near_dedup._Search(table.select("node", "n_words", "bag"), table.select("node", "words"), 0.8)
    rows = search.rare_grams(table.select("node"), 2).collect()
    assert sorted(r["node"] for r in rows if r["value"] is None) == list(range(165))
    assert sum(r["value"] is not None for r in rows) < 165 * 3
    classes, _ = near_dedup.near_duplicates(docs.withColumnRenamed("_rid", "doc_id"))
    found = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert all(found[160 + k] == found[k] for k in range(5))


def test_members_of_large_groups_are_handed_on_once(spark, monkeypatch):
    """Members of groups that are settled pair by pair are rows; of larger groups only the nodes are handed on, each once, and their pairs are found."""
    rng, seen, real = random.Random(4), {"members": [], "mixed": [], "crowded": []}, near_dedup.stored
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = [word() for _ in range(60)]
    rests = [[word() for _ in range(30)] for _ in range(160)]
    texts = [passage + r for r in rests] + [passage + [word() if k % 3 == 0 else w for k, w in enumerate(r)] for r in rests[:5]]

    def kept(df, label, *more):
        out = real(df, label, *more)
        if label in seen:
            seen[label].append(out.collect())
        return out

    monkeypatch.setattr(near_dedup, "stored", kept)
    classes, _ = near_dedup.near_duplicates(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string"))
    found = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert all(found[160 + k] == found[k] for k in range(5)) and len(set(found.values())) == 160
    large = {r["node"] for r in seen["members"][0] if r["n"] > near_dedup.SMALL}
    assert len(large) > near_dedup.SMALL and sorted(r["node"] for r in seen["crowded"][0]) == sorted(large)
    assert all(r["n"] <= near_dedup.SMALL for rows in seen["mixed"] for r in rows)
