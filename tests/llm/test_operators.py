"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wickwork.llm import common, components, langid, licenses, media, mixing, near_dedup, packing, quality, sharding, token_counts, warc, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "The quick brown fox jumps over the lazy dog and then runs far away from the noisy town into the dark green forest where nobody ever finds it again today"


def awkward(extra=()):
    """Nulls in any column, empty and repeated rows, equal texts, a long text."""
    rows = [
        (1, BASE, "en", "a", 5), (2, BASE, "en", "a", 5), (2, BASE, "en", "a", 5), (3, BASE.upper() + "!", "en", None, 5), (4, "", "en", "b", 0), (5, None, None, None, None), (None, "some text here", "en", "b", 1),
        (None, None, "de", "b", 1), (6, "   \n\t ", "en", "c", 1), (7, "!!! ??? ###", "en", "c", 1), (8, "word " * 30_000, "en", "c", 1), (9, "日本語 テキスト 😀", "ja", "c", 1), (10, BASE.replace("fox", "cat"), "en", "a", 1),
    ]
    return [*rows, *extra]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(awkward(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# 1 token counts


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_every_prefix_has_the_library_count():
    count, counter = tokenizer(), token_counts.prefix_counter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", "'s", "'re", "'ll", "'", "é", "日本", "12", "_", "...", "\t", "\xa0", "\x85", "I", "²", "µ", "😀", "<|endoftext|>", " the", "ing"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        table = counter.changes(text)
        assert len(table) == len(text)
        assert [token_counts.count_at(table, k) for k in range(len(text) + 1)] == [count(text[:k]) for k in range(len(text) + 1)]


def test_token_counts(docs, none):
    count, path = tokenizer(), public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts.prefix_tokens(docs.withColumn("n_tokens", F.lit("clash")), path, 20)
    for r in out.collect():
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), count(text), count(text) > 20)
        assert count(text[: r["cut"]]) <= 20 and (r["cut"] == len(text) or count(text[: r["cut"] + 1]) > 20 or len(text) < 1000)
    assert token_counts.prefix_tokens(none, path).count() == 0


# 2 sharding


def test_sharding(spark, docs, none):
    out = sharding.shard_uniform(docs.withColumn("shard", F.lit("clash")), 4)
    rows = out.collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [3, 3, 3, 4]
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert sharding.shard_uniform(none, 4).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_hypergeometric_draws(spark):
    """Frequencies over many uniforms match the exact probabilities."""
    n, k, d, size = 30, 12, 9, 4000
    draws = spark.range(size).select(sharding.hypergeometric(F.lit(n), F.lit(k), F.lit(d), (F.col("id") + 0.5) / size).alias("x"))
    seen = {r["x"]: r["count"] for r in draws.groupBy("x").count().collect()}
    for x in range(0, 10):
        p = math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d)
        assert abs(seen.get(x, 0) - size * p) <= 2


def test_matrix_margins_and_uniformity(spark):
    df = spark.range(0, 6000, 1, 5).select(F.col("id").alias("doc_id"))
    rows = sharding.shard_uniform(df, 7, seed=3, block_rows=500).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts.values()) <= {857, 858} and sum(counts.values()) == 6000
    # chi-square over shard by tenth of the input, 54 degrees of freedom
    cells = Counter((r["shard"], r["doc_id"] // 600) for r in rows)
    chi = sum((cells[s, t] - 6000 / 70) ** 2 / (6000 / 70) for s in range(7) for t in range(10))
    assert 20 < chi < 100


# 3 near-duplicates


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment():
    rng = random.Random(4)
    for _ in range(500):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() > 0.15]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 3))
        d, most = edit_distance(a, b), rng.randint(0, 6)
        assert near_dedup.distance_within(a, b, most) == (d if d <= most else None)


def classes(rows):
    found = {}
    for r in rows:
        found.setdefault(r["class_id"], []).append(r["doc_id"])
    return found


def test_awkward_near_duplicates(docs, none):
    out, _ = near_dedup.near_duplicates(docs.select("doc_id", "text", F.lit(1).alias("class_id")))
    rows = out.collect()
    assert len(rows) == 13
    assert {1, 2, 3, 10} == set(classes(rows)[1]) and len(classes(rows)[1]) == 5
    assert sorted(x for x in classes(rows)[4]) == [4] and sorted(classes(rows)[6]) == [6] and sorted(classes(rows)[7]) == [7]
    out, links = near_dedup.near_duplicates(none)
    assert out.count() == 0 and links.count() == 0
    assert near_dedup.one_of_each(docs).count() == 9


def test_near_duplicates_match_brute_force(real):
    rows, _ = near_dedup.near_duplicates(real.select("doc_id", "text"))
    got = {r["doc_id"]: r["class_id"] for r in rows.collect()}
    words = {r["doc_id"]: near_dedup.words_of(r["text"]) for r in real.collect()}
    top = {i: i for i in words}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(words)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            longest = max(len(words[i]), len(words[j]))
            if abs(len(words[i]) - len(words[j])) <= 0.2 * longest and near_dedup.similar(near_dedup.word_hashes(" ".join(words[i])), near_dedup.word_hashes(" ".join(words[j]))):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    assert got == {i: root(i) for i in ids}


def test_a_chain_and_a_shared_passage(spark, tmp_path):
    """Texts linked only through a third one are one class; texts that share a passage are not."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    new = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    a = new(200)
    b = a[:170] + new(30)
    c = new(30) + b[30:]
    passage = new(60)
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), *[(10 + k, " ".join(new(100) + passage + new(100))) for k in range(60)]]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = classes(near_dedup.near_duplicates(spark.read.parquet(path))[0].collect())
    assert sorted(got[1]) == [1, 2, 3] and all(got[10 + k] == [10 + k] for k in range(60))


def test_a_star_whose_hub_comes_last_is_one_class(spark, tmp_path):
    """Variants are similar to the hub alone, and the hub has the largest id and row, so it heads no bucket."""
    rng = random.Random(5)
    hub = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(300):
        at = set(rng.sample(range(4), 2)) | {4 + x for x in rng.sample(range(96), 12)}
        rows.append((k, " ".join(f"v{k}x{i}" if i in at else w for i, w in enumerate(hub))))
    rows.append((1000, " ".join(hub)))
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got, words = near_dedup.near_duplicates(spark.read.parquet(path))[0].collect(), {i: near_dedup.word_hashes(x) for i, x in rows}
    meets = {i for i, w in words.items() if (near_dedup.sketch(near_dedup.kmers(w)) == near_dedup.sketch(near_dedup.kmers(words[1000]))).any()}
    assert len(meets) > 50 and {r["class_id"] for r in got if r["doc_id"] in meets} == {min(meets)}


@pytest.mark.parametrize(("changed", "unrelated"), [(12, 240), (35, 240), (38, 240), (38, 0)])
def test_near_copies_among_texts_that_share_a_passage(spark, tmp_path, changed, unrelated):
    """Half of every text is one passage, so its k-mers fill crowded groups; 60 texts have a near copy there, and each is found."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = rng.choices(vocabulary, k=100)
    rows = []
    for k in range(60 + unrelated):
        own = rng.choices(vocabulary, k=100)
        rows.append((k, own[:50] + passage + own[50:]))
        if k < 60:
            copy = list(rows[-1][1])
            for at in rng.sample([*range(50), *range(150, 200)], changed):
                copy[at] = rng.choice(vocabulary)
            rows.append((1000 + k, copy))
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string").write.parquet(path)
    found = classes(near_dedup.near_duplicates(spark.read.parquet(path))[0].collect())
    assert all(sorted(found[k]) == [k, 1000 + k] for k in range(60)) and all(len(found[k]) == 1 for k in range(60, 60 + unrelated))


def test_similar_texts_have_a_rare_gram_in_common():
    """The prefix filter loses no similar pair, whatever the counts of grams are."""
    rng = random.Random(10)
    counts = np.random.default_rng(11).integers(2, 9, 1 << near_dedup.BIN_BITS)
    met = 0
    for _ in range(2000):
        a = [rng.randrange(40) for _ in range(rng.randint(2, 60))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5 + 1)):
            kind, at = rng.randrange(3), rng.randrange(len(b))
            b[at : at + (kind < 2)] = [rng.randrange(40)] * (kind > 0)
            b = b or [0]
        if edit_distance(a, b) > int(0.2 * max(len(a), len(b)) + 1e-9):
            continue
        met += 1
        for k in near_dedup.GRAMS:
            x, y = (near_dedup.rarest(near_dedup.occurrences(near_dedup.kmers(np.array(w, np.uint64) + np.uint64(7), k)), len(w), k, counts) for w in (a, b))
            assert set(x.tolist()) & set(y.tolist())
    assert met > 800


def test_grams_of_one_component_make_no_rows(spark, tmp_path):
    """What only members of one component share joins nothing; similar texts of two components have a row in common."""
    rng, rows = random.Random(12), []
    new = lambda n: [rng.randrange(1 << 32) for _ in range(n)]
    one, two = new(60), new(60)
    for node, label, words in [*((k, 0, one + new(5)) for k in range(40)), (999, 999, two + new(5)), (2999, 2999, new(5) + two)]:
        rows.append((node, label, len(words), bytearray(np.array(words, np.uint32).tobytes())))
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "node long, label long, n_words long, words binary").write.parquet(path)
    table = spark.read.parquet(path)
    search = near_dedup._Search(table.select("node", "n_words"), table.select("node", "words"), near_dedup.SIMILARITY)
    found = search.rare_grams(table.select("node", "label"), 2).collect()
    values = {node: {r["value"] for r in found if r["node"] == node} for node in {r["node"] for r in found}}
    assert set(values) == {999, 2999} and values[999] & values[2999]


def test_two_common_texts_are_left_to_the_next_round(spark, tmp_path):
    """Pairs of two texts that both have a common gram meet again elsewhere; pairs with one of them are made here."""
    words = np.arange(40, dtype=np.uint32)
    counts = bytearray(near_dedup.bag(words).astype(np.uint16).tobytes())
    nodes = spark.createDataFrame([(k, 40, counts) for k in range(5)], "node long, n_words long, bag binary")
    values = spark.createDataFrame([(k, v, k > 1) for v, ks in ((7, range(5)), (8, (2, 3, 4))) for k in ks], "node long, value long, common boolean")
    search = near_dedup._Search(nodes, None, near_dedup.SIMILARITY)
    members = near_dedup.grouped(values)
    assert {r["value"] for r in members.collect()} == {7}
    pairs = {tuple(r) for r in search.small_pairs(search.mixed(members, 1)).collect()}
    assert pairs == {(a, b) for a in (0, 1) for b in range(a + 1, 5)}


def test_similar_short_texts_always_have_a_value_in_common():
    """Every two short texts that are similar meet, whatever was edited."""
    rng = random.Random(9)
    met = 0
    for _ in range(3000):
        a = [rng.randrange(1 << 60) for _ in range(rng.randint(4, 30))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 5))):
            kind, at = rng.randrange(3), rng.randrange(len(b))
            b[at : at + (kind < 2)] = [rng.randrange(1 << 60)] * (kind > 0)
        longest = max(len(a), len(b))
        if a != b and len(b) <= 30 and edit_distance(a, b) <= int(0.2 * longest + 1e-9):
            met += 1
            assert set(near_dedup.short_values(a)) & set(near_dedup.short_values(b))
    assert met > 1000


def test_rows_keep_their_numbers_when_the_cluster_changes(spark, tmp_path):
    """Scans with different splits, as after a lost executor, give the same row numbers and the same classes and mix."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, f"text number {k % 40} " * 30, "s") for k in range(400)], "doc_id long, text string, source string").repartition(3).write.parquet(path)
    seen = []
    for cores in ("2", "16"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        docs = spark.read.parquet(path)
        seen.append((sorted(map(tuple, common.with_row_id(docs.select("doc_id")).collect())), sorted(r[0] for r in near_dedup.one_of_each(docs).select("doc_id").collect())))
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert seen[0] == seen[1] and len(seen[0][1]) == 40
    rows = docs.withColumn("size", F.lit(90).cast("long"))
    numbered = common.with_row_id(rows)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    first = {r[0] for r in numbered.select("_rid").collect()}
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16")
    assert first == {r[0] for r in numbered.select("_rid").collect()}
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_one_of_each_keeps_columns_of_any_name(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, BASE, "mine", 5, "n"), (2, BASE, "yours", 6, "w")], "doc_id long, text string, rid string, n_words long, words string").coalesce(1).write.parquet(path)
    assert [tuple(r) for r in near_dedup.one_of_each(spark.read.parquet(path)).collect()] == [(1, BASE, "mine", 5, "n")]
    ids = spark.createDataFrame([("b", BASE), ("a", BASE + " now")], "doc_id string, text string")
    assert {(r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(ids)[0].collect()} == {("a", "a"), ("b", "a")}


def test_rows_are_found_by_ids_bitmaps_or_a_join_alike(spark, monkeypatch):
    """Ids around zero, at the ends of bitmaps and far apart; a null is in no set of ids."""
    numbers = [*range(-40_000, 70_000, 7), *range(-3, 4), 32_767, 32_768, 32_769, -32_768, 1 << 40, (1 << 40) + 32_768, (1 << 62) + 1]
    numbers = sorted(set(numbers))
    rows = spark.createDataFrame([(x, "t") for x in [*numbers, None]], "node long, text string")
    wanted = {x for x in numbers if x % 3 == 0 or abs(x) < 3}
    ids = spark.createDataFrame([(x,) for x in wanted], "node long")
    for most_ids, most_maps, plan in ((300_000, 8_192, "BroadcastHashJoin"), (10, 8_192, "bitmap"), (10, 2, "Exchange hashpartitioning")):
        monkeypatch.setattr(common, "BROADCAST_IDS", most_ids)
        monkeypatch.setattr(common, "BROADCAST_BITMAPS", most_maps)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found = common.among(rows, ids, "node")
            assert plan in found._jdf.queryExecution().executedPlan().toString()
            assert found.columns == ["node", "text"] and sorted(r["node"] for r in found.collect()) == sorted(wanted)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_ids_beside_nulls_stay_exact(spark, tmp_path):
    big, path = 2**62 + 1, str(tmp_path / "t")
    spark.createDataFrame([(big, BASE), (big + 1, BASE), (None, BASE)], "doc_id long, text string").coalesce(1).write.parquet(path)
    rows = near_dedup.near_duplicates(spark.read.parquet(path))[0].collect()
    assert {(r["doc_id"], r["class_id"]) for r in rows} == {(big, big), (big + 1, big), (None, big)}
    html = "x" * 2000
    out = warc.archive_round_trip(spark.createDataFrame([(big, "u", html), (big + 1, "u", html), (None, "u", html)], "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["refers_to"]) for r in out} == {(big, big + 1), (big + 1, None), (None, big + 1)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 300), (7, 7)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 1 for k in range(1, 41)) and found[300] == 100


# 4 WARC

PAGES = "page_id long, url string, html string, payload_bytes string"


def test_archives(spark, tmp_path):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/ b", big, "x"), (2, None, big, "x"), (3, "u", "small", "x"), (4, "u", "small", "x"), (5, "u", None, None), (None, "u", big, "x"), (6, "u", "", "x"), (2, "u", big, "x"), (7, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40, "x")]
    out = warc.archive_round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == 9
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, h, _ in rows:
        revisit = h == big and i != 2
        want[i, len((h or "").encode()), sha(h), "revisit" if revisit else "response", 2 if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_normalised_archive_members_stand_alone(spark, tmp_path):
    pages = warc.with_originals(spark.createDataFrame([(k, "u", f"page {k} " * (k * 50)) for k in range(20)], "page_id long, url string, html string"))
    first, second = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    done = warc.normalise(warc.write_monolithic(pages, first), first, second)
    seen = []
    for r in done.collect():
        data, index = open(r["path"], "rb").read(), [tuple(map(int, x.split())) for x in open(r["path"][:-8] + ".idx")]
        assert len(index) == r["records"] and sum(n for _, n in index) == len(data)
        for at, n in index:
            fields, block = warc.parse(zlib.decompress(data[at : at + n], wbits=31))
            seen.append((int(fields["x-page-id"]), block.decode()))
    assert sorted(seen) == [(k, f"page {k} " * (k * 50)) for k in range(20)]
    assert len(warc.read_archives(done, second).collect()) == 20


# 5 WebP


def test_images_round_trip(docs, none):
    rows = media.text_images(docs.withColumn("feature", F.lit("clash"))).collect()
    for r in rows:
        raw = (r["text"] or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(r["pixels"]) == padded and webp.decode(bytes(r["media"]))[2].tobytes() == padded
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-32:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    assert media.text_images(none).count() == 0


class Stream(webp.Writer):
    """Writes streams with features that the encoder does not use."""

    def simple(self, *symbols):
        self.put(1, 1)
        self.put(len(symbols) - 1, 1)
        self.put(1, 1)
        for s in symbols:
            self.put(s, 8)

    def lengths(self, sizes, alphabet):
        """A normal code; its lengths written one by one with a code-length code of 4 bits each for 0 to 15."""
        self.put(0, 1)
        self.put(15, 4)
        for k in webp.LENGTH_ORDER:
            self.put(0 if k > 15 else 4, 3)
        self.put(0, 1)
        for s in range(alphabet):
            n = sizes.get(s, 0)
            self.put(int(f"{n:04b}"[::-1], 2), 4)

    def code(self, sizes, symbol):
        """Bits of a symbol in the canonical code of these sizes."""
        value, last = 0, 0
        for s, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
            value <<= n - last
            if s == symbol:
                self.put(int(f"{value:0{n}b}"[::-1], 2), n)
                return
            value, last = value + 1, n
        raise KeyError(symbol)

    def head(self, width, height):
        self.put(0x2F, 8)
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(1, 1)
        self.put(0, 3)

    def plain(self, pixels, main):
        """An entropy-coded image (rows of alpha, red, green, blue) with 8-bit codes and no cache."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        full = {s: 8 for s in range(256)}
        for alphabet in (280, 256, 256, 256):
            self.lengths(full, alphabet)
        self.simple(0)
        for a, r, g, b in pixels:
            for x in (g, r, b, a):
                self.put(int(f"{x:08b}"[::-1], 2), 8)

    def file(self):
        return webp.container(self.done())


def noise(n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (n, 4)).astype(np.uint8)


def test_prefix_codes_back_references_and_cache():
    place = lambda p: (0x1E35A7BD * (p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]) & 0xFFFFFFFF) >> 30
    second = next(g for g in range(11, 99) if place((255, 7, g, 9)) != place((255, 7, 10, 9)))  # two colours with cache places of their own
    w = Stream()
    w.head(4, 3)
    w.put(0, 1)
    w.put(1, 1)
    w.put(2, 4)  # a cache of 4 colours
    w.put(0, 1)
    green = {10: 2, second: 2, 256: 3, 258: 3, 280 + 0: 4, 280 + 1: 4, 280 + 2: 4, 280 + 3: 4}
    w.lengths(green, 284)
    w.simple(7)
    w.simple(9)
    w.simple(255)
    distance = {0: 1, 4: 2, 9: 2}
    w.lengths(distance, 40)
    a, b = (255, 7, 10, 9), (255, 7, second, 9)
    w.code(green, 10)  # a
    w.code(green, second)  # b
    w.code(green, 280 + place(a))  # a from the cache
    w.code(green, 258)  # length 3
    w.code(distance, 4)  # distance code 5 or 6
    w.put(0, 1)  # 5: the pixel two rows above is outside; dist = 0 + 2 * 4 = 8 would be too far, so use it later
    with pytest.raises(ValueError):
        webp.decode(w.file())
    w = Stream()
    w.head(4, 3)
    w.put(0, 1)
    w.put(1, 1)
    w.put(2, 4)
    w.put(0, 1)
    w.lengths(green, 284)
    w.simple(7)
    w.simple(9)
    w.simple(255)
    w.lengths(distance, 40)
    w.code(green, 10)
    w.code(green, second)
    w.code(green, 280 + place(a))
    w.code(green, second)
    w.code(green, 258)  # three pixels from one row above (distance code 1)
    w.code(distance, 0)
    w.code(green, 280 + place(b))
    w.code(green, 258)  # three pixels; symbol 9 carries 3 extra bits: 24 + 1 .. 32, beyond 120 it would be linear
    w.code(distance, 4)
    w.put(0, 1)  # distance code 5: two rows above
    w.code(green, 256)  # one pixel from above
    w.code(distance, 0)
    width, height, pixels = webp.decode(w.file())
    want = [a, b, a, b, a, b, a, b, a, b, a, b]
    assert (width, height) == (4, 3) and [tuple(p) for p in pixels.tolist()] == want


def test_subtract_green_and_cross_colour():
    image = noise(12)
    factors = noise(1, 5)
    moved = webp._cross(image, np.array([[factors[0]]]), 2, 4, -1)
    subtracted = moved.copy()
    subtracted[:, 1] -= moved[:, 2]
    subtracted[:, 3] -= moved[:, 2]
    w = Stream()
    w.head(4, 3)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(0, 3)
    w.plain(factors.tolist(), False)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(0, 1)
    w.plain(subtracted.tolist(), True)
    assert (webp.decode(w.file())[2] == image).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height, image = 5, 4, noise(20, mode).tolist()
    modes = np.full((1, 2), mode, np.uint8)
    rest = [[(x - p) & 255 for x, p in zip(image[k], webp.predictions(image, modes, 2, width, k))] for k in range(20)]
    w = Stream()
    w.head(width, height)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(0, 3)
    w.plain([(255, 0, mode, 0)] * 2, False)
    w.put(0, 1)
    w.plain(rest, True)
    assert webp.decode(w.file())[2].tolist() == image


@pytest.mark.parametrize("colours", [2, 3, 9, 40])
def test_palettes(colours):
    table, width, height = noise(colours, colours), 7, 3
    index = np.random.default_rng(colours).integers(0, colours, width * height)
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each, packed = 8 >> bits, []
    for row in index.reshape(height, width):
        for k in range(0, width, 1 << bits):
            packed.append((255, 0, int(sum(int(v) << (each * j) for j, v in enumerate(row[k : k + (1 << bits)]))), 0))
    w = Stream()
    w.head(width, height)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(colours - 1, 8)
    w.plain(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).tolist(), False)
    w.put(0, 1)
    w.plain(packed, True)
    assert (webp.decode(w.file())[2] == table[index]).all()


def test_meta_prefix_image():
    """Two groups of codes, one for each half of the rows."""
    w = Stream()
    w.head(4, 8)
    w.put(0, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(0, 3)  # tiles of 4 x 4
    w.plain([(255, 0, 0, 0), (255, 0, 1, 0)], False)
    for g in (3, 200):
        w.simple(g)
        w.simple(1)
        w.simple(2)
        w.simple(255)
        w.simple(0)
    pixels = webp.decode(w.file())[2]
    assert set(map(tuple, pixels[:16].tolist())) == {(255, 1, 3, 2)} and set(map(tuple, pixels[16:].tolist())) == {(255, 1, 200, 2)}


def test_high_images_get_wider():
    data = b"ab" * (576 * 9000)
    width, height, pixels = webp.decode(media.to_image(data))
    assert width == 288 and pixels.tobytes()[: len(data)] == data


# 6 license scans


def scan(text):
    words = re.findall(licenses.WORD, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places, labels = [], set()
    for label, phrase in licenses.BASE.items():
        p = phrase.split()
        hits = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, docs, none, real):
    more = [(20, "Licensed UNDER the MIT license, under the mit license.", None, None, 1), (21, "CC BY-NC cc by nc", None, None, 1), (22, "under the MİT license", None, None, 1), (20, "apache license version 2", None, None, 1), (23, "cc by", None, None, 1)]
    table = docs.union(spark.createDataFrame(more, DOCS)).union(real)
    rows, _ = licenses.scan_licenses(table.withColumn("labels", F.lit("clash")))
    want = Counter((r["doc_id"], *scan(r["text"])) for r in table.collect())
    found = rows.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in found)
    assert licenses.scan_licenses(none)[0].count() == 0
    assert not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().executedPlan().toString())


def test_license_text_with_inserted_words(spark):
    text = licenses.TEMPLATES["bsd"].replace("source and", "source (or code) and")
    rows, spans = licenses.scan_licenses(spark.createDataFrame([(1, "x y " + text), (2, "use in source and binary forms")], "doc_id long, text string"))
    assert {r["doc_id"]: r["labels"] for r in rows.collect()} == {1: "bsd", 2: ""}
    span = spans.first()
    assert span["start"] == 2 and span["end"] == 2 + len(text.replace("(or", "or").split()) - 1


# 7 mixing


def fill(sizes):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, closed, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in closed)
        whole = sum(weight[s] for s in names if s not in closed)
        target = {s: 3 * sizes[s] if s in closed else left * weight[s] / whole for s in names}
        above = {s for s in names if s not in closed and target[s] > 3 * sizes[s]}
        if not above:
            return target
        closed |= above


def test_mixing(spark, docs, none, real):
    for table in (docs, docs.union(real)):
        sized = table.withColumn("size", mixing.word_count("text")).withColumn("taken", F.lit("clash"))
        rows = mixing.fair_queue(sized).collect()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += r["size"]
            assert r["size"] == len(re.findall(mixing.WORD, r["text"] or "")) and r["taken"] <= 3 * r["size"]
        targets = fill(sizes)
        assert all(r["target"] == pytest.approx(targets[r["source"]]) for r in rows)
        total = sum(sizes.values())
        taken = Counter()
        for r in rows:
            taken[r["source"]] += r["taken"]
        largest = {s: max(r["size"] for r in rows if r["source"] == s) for s in sizes}
        assert sum(taken.values()) <= total
        assert all(abs(taken[s] - targets[s]) <= largest[s] + max(largest.values()) for s in sizes)
    assert mixing.fair_queue(none.withColumn("size", F.lit(0))).count() == 0
    assert mixing.mixed_documents(docs.withColumn("n", mixing.word_count("text")), "n").count() == sum(r["copies"] for r in mixing.fair_queue(docs.withColumn("n", mixing.word_count("text")), "n").collect())


def test_mix_is_cut_in_order_of_virtual_finish_time(spark):
    rows = [(k, "ab"[k % 2], 1 + k % 5) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = {r["doc_id"]: r["taken"] for r in mixing.fair_queue(table).collect()}
    total = sum(r[2] for r in rows)
    own = {s: sum(r[2] for r in rows if r[1] == s) for s in "ab"}
    target = fill(own)
    queue, want = [], Counter()
    for s in "ab":
        line = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, n) for i, x, n in rows if x == s)
        upto = 0
        for _, i, n in line:
            upto += n
            queue += [((e * own[s] + upto) / target[s], s, i, n) for e in range(3)]
    used = 0
    for _, _, i, n in sorted(queue):
        used += n
        if used > total:
            break
        want[i] += n
    assert out == {i: want[i] for i, _, _ in rows}


# 8 quality rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_measures(spark, docs, none, real):
    rows = quality.with_measures(docs.union(real).withColumn("n_words", F.lit("clash"))).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
    assert quality.with_measures(none).count() == 0


def test_binomial_tail():
    for n, p in ((1, 0.3), (20, 0.05), (50, 0.5)):
        for k in range(n + 1):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality.binomial_tail(k, n, p) == pytest.approx(exact, abs=1e-12)


def test_cutoffs_hold_the_risk(spark):
    """Good documents have few symbols: the cutoff found rejects junk and, of the good ones, no more than permitted."""
    rng = random.Random(3)
    rows = []
    for k in range(12000):
        good = k % 3 > 0
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" + ("#" if not good or rng.random() < 0.02 else "") for _ in range(25)]
        rows.append((k, " ".join(words), "en" if k % 2 else None, int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = table.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    judged = quality.judge(table.drop("quality"), labels).join(table.select("doc_id", "quality"), "doc_id").collect()
    good = [r for r in judged if r["quality"] == 1]
    bad = [r for r in judged if r["quality"] == 0]
    assert sum(not r["kept"] for r in good) <= quality.ALPHA * len(good)
    assert sum(not r["kept"] for r in bad) > 0.9 * len(bad)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.judge(table.drop("quality").limit(50), none).collect())


def test_strata_without_a_test_of_their_own_have_no_cutoff(spark):
    """A small language and an unlabelled one, whose words are long, beside many labels of short words."""
    words = lambda k, n: " ".join(f"{'x' * n}{k}y{i}" for i in range(12))
    rows = [(k, words(k, 2), "en") for k in range(9000)] + [(10_000 + k, words(k, 70), "zh" if k < 1 else "th") for k in range(40)] + [(20_000, words(0, 70), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = table.where("lang <> 'th'").select("doc_id", F.lit(1).alias("quality"))
    # labels of many other languages, each too few for a test, share one pool in no case
    more = spark.createDataFrame([(30_000 + k, words(k, 2), f"l{k % 40}") for k in range(4000)], "doc_id long, text string, lang string")
    judged = quality.judge(table.union(more), labels.union(more.select("doc_id", F.lit(1)))).where("doc_id >= 10000").collect()
    assert len(judged) == 4041 and all(r["kept"] for r in judged)


# 9 packing


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(6)
    for _ in range(60):
        tops = sorted(rng.sample(range(1, 40), rng.randint(1, 7)))
        counts = [rng.randint(1, 9) for _ in tops]
        buckets = rng.randint(1, 4)
        cost = lambda ends: sum(n * (min(e for e in ends if e >= t) - t) for t, n in zip(tops, counts))  # noqa: B023, E731
        best = min(cost([*c, tops[-1]]) for k in range(min(buckets, len(tops))) for c in combinations(tops[:-1], k))
        ends = packing.best_boundaries(tops, counts, [t * n for t, n in zip(tops, counts)], buckets)
        assert len(ends) <= buckets and cost(ends) == best


def test_token_totals_are_those_of_the_library(spark):
    count, counter = tokenizer(), token_counts.total_counter(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [" ", "  ", "\n", "\t", "\u3000", "'s", "'re", "don't", "<|endoftext|>", "\xe9", "\u65e5\u672c", "\xbd", "12", "a", "Word", "___", "#!", "\x85"]
    draw = random.Random(3)
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(3000)] + ["", "a" * 50_000, " " * 3000 + "x"]
    assert [counter.total(x) for x in texts] == [count(x) for x in texts]
    some = spark.createDataFrame([(1, None, 7), (2, "", 8), (3, "two words", 9)], "doc_id long, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_totals(some, public_tokenizers.path("byte_bpe_50k.json")).collect()} == {1: 0, 2: 0, 3: count("two words")}


def test_packing(spark, docs, none, real):
    table = docs.union(real).withColumn("n", mixing.word_count("text")).withColumn("batch", F.lit("clash"))
    rows = packing.pack(table, "n", buckets=5, batch_tokens=3000).collect()
    assert len(rows) == table.count() and len({r["bucket"] for r in rows}) <= 5
    batches = {}
    for r in rows:
        assert r["padding"] == r["bucket"] - r["n"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["place"])
    for (bucket, _), places in batches.items():
        assert sorted(places) == list(range(len(places)))
        assert len(places) == 1 or bucket * len(places) <= 3000 or bucket == 0
    per = Counter(b for b, _ in batches)
    assert all({k for x, k in batches if x == b} == set(range(n)) for b, n in per.items())
    assert packing.pack(none.withColumn("n", F.lit(1)), "n").count() == 0


def test_batches_keep_their_budget_in_tokens(spark, tmp_path):
    from wickwork.llm import queries

    texts = {k: "".join(chr(0x4E00 + (k * 37 + i * 11) % 5000) for i in range(300)) for k in range(120)}
    spark.createDataFrame([*texts.items(), (500, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens, batches = tokenizer(), {}
    for r in queries.op9_packing(spark, str(tmp_path)).collect():
        batches.setdefault((r["bucket"], r["batch"]), []).append(tokens(texts.get(r["doc_id"], "")))
    assert sum(map(len, batches.values())) == 121
    assert all(len(b) == 1 or sum(b) <= packing.BATCH_TOKENS for b in batches.values())


def test_boundaries_of_many_lengths_match_the_plain_recurrence():
    """Lengths up to 20,000: the divided search gives the padding of the recurrence that tries every cut."""
    rng = np.random.default_rng(3)
    tops = np.sort(rng.choice(np.arange(1, 20_001), 1500, replace=False))
    counts = rng.integers(1, 50, len(tops))
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * tops)])
    best = np.full(len(tops) + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    for _ in range(7):
        best = np.array([best[0], *[min(best[j], (best[:j] + tops[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])).min()) for j in range(1, len(tops) + 1)]])
    ends = packing.best_boundaries(tops.tolist(), counts.tolist(), (counts * tops).tolist(), 7)
    padding = sum(int(n) * (min(e for e in ends if e >= t) - int(t)) for t, n in zip(tops, counts))
    assert len(ends) <= 7 and ends[-1] == tops[-1] and padding == best[-1]


# 10 language identification


def test_probabilities_sum_to_one():
    """For each context, the model's probabilities of all characters of the alphabet, and of one unseen, fill the mass."""
    bag = Counter("the cat sat on the mat that the rat ate".split())
    counts = langid._ngrams("xx", bag)
    for c in ("gram", "context", "suffix"):
        counts[c] = counts[c].to_numpy().view(np.uint64)
    model = langid.fit(counts)
    alphabet = sorted(set("".join(bag)))
    for context in ("th", "a", "zz"):
        one = {c: model.word_bits([context + c])[0, 0] for c in alphabet}
        whole = model.word_bits([context])[0, 0]
        assert all(b > 0 for b in one.values()) and whole > 0
    # a direct Kneser-Ney estimate of p(t | blank) from the same counts
    blank_t = 2 ** -(model.logp[1] * 1.0)
    assert (blank_t > 0).all()
    total = sum(np.exp2(model.logp[0][:, 0]))
    assert 0.5 < total <= 1 + 1e-6  # the rest belongs to characters never seen


def test_language_accuracy_and_awkward_texts(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table.where(~langid.held_out()), docs_per_language=60)
    out = langid.identify(table.where(langid.held_out()).withColumn("score", F.lit("clash")), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) >= 0.97
    assert sum(r["rejected"] for r in out) / len(out) <= 0.02
    odd = langid.identify(docs, model).collect()
    for r in odd:
        none_left = not re.search(r"[^\W\d_]", r["text"] or "")
        assert (r["lang_pred"] == "und") == none_left and 0 <= r["score"] <= 1
        assert r["rejected"] or not none_left
    assert langid.identify(none, model).count() == 0
    assert langid.train(none) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_foreign_text_is_rejected(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table, docs_per_language=60)
    rng = random.Random(1)
    strange = spark.createDataFrame([(" ".join("".join(rng.choice("qxzvkjw") for _ in range(7)) for _ in range(80)),)], "text string")
    assert langid.identify(strange, model).first()["rejected"]


def test_words_are_scored_alike_alone_and_together():
    bag = Counter("eins zwei drei vier".split())
    counts = langid._ngrams("de", bag)
    for c in ("gram", "context", "suffix"):
        counts[c] = counts[c].to_numpy().view(np.uint64)
    model = langid.fit(counts)
    together = model.word_bits(["eins", "zwei", "xyz"])
    alone = np.concatenate([model.word_bits([w]) for w in ("eins", "zwei", "xyz")])
    assert np.allclose(together, alone, atol=1e-4)
    assert isinstance(counts, pd.DataFrame)


def test_numerals_are_no_letters(spark):
    assert langid.words_of("½ ² Ⅷ") == [] and langid.words_of("Ab½c d2e Ⅷx") == ["ab", "c", "d", "e", "x"]
    docs = spark.createDataFrame([(k, f"plain words of a text number {chr(97 + k % 20)}", "en") for k in range(40)], "doc_id long, text string, lang string")
    found = langid.identify(spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "words of a text")], "doc_id long, text string"), langid.train(docs)).collect()
    assert [(r["lang_pred"], r["score"] == 0) for r in sorted(found)] == [("und", True), ("en", False)]


def test_probabilities_match_plain_kneser_ney():
    """Word bits against a recursion over strings."""
    from functools import cache

    texts = {"a": "the cat sat on the mat and the rat ran at that", "b": "der hund und die katze sind im haus und der garten"}
    counts = pd.concat([langid._ngrams(lang, Counter(langid.words_of(x))) for lang, x in texts.items()])
    counts = counts.groupby(["lang", "n", "gram"], as_index=False).agg({"context": "first", "suffix": "first", "seen": "sum"})
    for c in ("gram", "context", "suffix"):
        counts[c] = counts[c].to_numpy().view(np.uint64)
    model = langid.fit(counts)
    for lang, text in texts.items():
        grams = {n: Counter() for n in range(1, langid.ORDER + 1)}
        for w in langid.words_of(text):
            run = f" {w} "
            for end in range(1, len(run)):
                for n in range(1, min(langid.ORDER, end + 1) + 1):
                    grams[n][run[end - n + 1 : end + 1]] += 1
        weigh = {n: {g: (k if n == langid.ORDER else max(1, sum(x.endswith(g) for x in grams[n + 1]))) for g, k in bag.items()} for n, bag in grams.items()}

        @cache
        def chance(gram):
            n = len(gram)
            if n == 0:
                return 1 / langid.UNSEEN_CHARS
            beside = [k for g, k in weigh[n].items() if g[:-1] == gram[:-1]]
            if not beside:
                return chance(gram[1:])
            total = sum(beside)
            return max(weigh[n].get(gram, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(beside) / total * chance(gram[1:])

        words = ["the", "rat", "hund", "zebra", "qqq", "sathaus", "é"]
        bits = model.word_bits(words)[:, model.languages.index(lang)]
        for w, got in zip(words, bits):
            run = f" {w} "
            want = -sum(math.log2(chance(run[max(0, end - langid.ORDER + 1) : end + 1])) for end in range(1, len(run)))
            assert abs(got - want) < 1e-3, (lang, w)


def test_many_languages(spark):
    """Every label is learned, however many there are."""
    rng = random.Random(2)
    letters = [chr(0x4E00 + k) for k in range(4000)]
    rows = []
    for k in range(70):
        own = ["".join(rng.choices(letters[50 * k : 50 * k + 50], k=4)) for _ in range(40)]
        rows += [(100 * k + j, " ".join(rng.choices(own, k=30)), f"l{k}") for j in range(22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 70
    assert langid.identify(docs, model).where("lang_pred <> lang or rejected").count() == 0


def test_samples_for_fitting_and_calibration_share_no_text(spark):
    docs = spark.createDataFrame([(k, f"text {k % 300}", ["en", "de", None][k % 3]) for k in range(900)], "doc_id long, text string, lang string")
    fit, rest = ({r["text"] for r in langid._sample(docs, "lang", c, 600).collect()} for c in (False, True))
    assert fit and rest and not fit & rest
    moved = docs.withColumn("doc_id", F.col("doc_id") * 7 + 1)
    assert {r["text"] for r in langid._sample(moved, "lang", False, 600).collect()} == fit


def test_encoder_uses_the_format():
    """Round trips of images that call for each feature, all smaller than the pixels."""
    rng = np.random.default_rng(5)
    slope = np.cumsum(rng.integers(0, 3, (64 * 64, 4)), axis=0).astype(np.uint8)
    few = noise(40, 2)[rng.integers(0, 40, 4096)]
    two = noise(2, 3)[rng.integers(0, 2, 4096)]
    words = [noise(9, k) for k in range(30)]
    lines = np.concatenate([words[k] for k in rng.integers(0, 30, 500)])[:4096]
    near = noise(700, 8)[np.minimum(rng.zipf(1.3, 4096), 700) - 1]
    grey = np.repeat(rng.normal(120, 25, (4096, 1)).astype(np.uint8), 4, axis=1) + rng.integers(0, 2, (4096, 4)).astype(np.uint8)
    for image in (slope, few, two, lines, near, grey):
        data = webp.encode(np.ascontiguousarray(image), 64)
        assert (webp.decode(data)[2] == image).all() and len(data) < image.size * 0.8
    assert len(webp.encode(np.ascontiguousarray(two), 64)) < 1000 and len(webp.encode(np.ascontiguousarray(lines), 64)) < lines.size / 4
    for n in (1, 2, 3, 5, 144, 288):
        for values in (1, 2, 3, 256):
            image = rng.integers(0, values, (n, 4)).astype(np.uint8)
            assert (webp.decode(webp.encode(image, n))[2] == image).all()


def test_queue_carries_columns_of_any_name(spark):
    rows = spark.createDataFrame([(k, "s", 10, "own", 7) for k in range(5)], "doc_id long, source string, size long, source_no string, weight int")
    got = mixing.fair_queue(rows).collect()
    assert {(r["source_no"], r["weight"], r["taken"]) for r in got} == {("own", 7, 10)}
    mixed = mixing.mixed_documents(rows)
    assert mixed.columns == rows.columns and mixed.count() == 5
    assert mixing.mixed_documents(rows.limit(0)).count() == 0
