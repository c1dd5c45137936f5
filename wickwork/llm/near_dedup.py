"""Near-duplicates by Order MinHash, candidates verified by banded alignment.

Texts are compared as sequences of lower-cased words (runs of letters and digits). A sketch samples, for each of SKETCHES hash
functions, the PICKED smallest of the text's occurrence-labelled 5-word k-mers and keeps them in text order, so equal values
speak for a small edit distance and not just for shared words. Texts of SHORT words or fewer have further values, by which every two of them that are
similar meet for certain. Two texts are linked if their edit similarity, 1 - distance / longer length in words, is at least 0.8; classes are the connected components.

Texts with equal words are one node. Texts with an equal value are a group, and no pair of a group is left open for its size:

1. every member is aligned with the smallest one, its head, as long as both are in different components;
2. a group of at most SMALL members that still holds several components is settled pair by pair, by lengths, words in common and alignment;
3. members of larger ones, crowded by a passage that they share, meet again by their rarest grams: d edits destroy at most k * d grams of k words, so two similar
   texts have one in common among the k * d + k + 1 that are rarest among all members (prefix filter); grams that only one component has count as rarest, but join nothing.
   First k is 2, then 1 for what is crowded still. Two texts that both have a common gram are left to the next round or step. No similar pair of different components is lost;
4. what shares only common words even so is dealt into blocks by length and by a hash, and every two members of blocks near in length are settled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import among, drop_stored, shared_dir, stored, with_row_id
from wickwork.llm.components import EDGES_A_TASK, components

KMER, PICKED, SKETCHES, SIMILARITY = 5, 2, 48, 0.8
#: Words of a text for which further values make the search complete; up to the first number they come from deleted words, beyond from segments.
DELETED, SHORT = 14, 30
#: Members of a group that is settled pair by pair, and words of a gram in the rounds for crowded groups.
SMALL, GRAMS = 128, (2, 1)
#: Least and most bits of the bins in which grams are counted to order them, and bins for each gram in between.
BIN_BITS, MOST_BITS, BINS_A_GRAM = 20, 24, 8
#: Texts and words that a block of a mixed bucket should hold, and the bins in which words are counted to rule pairs out, in groups and in blocks.
BLOCK, BLOCK_WORDS, BINS, BLOCK_BINS = 512, 1_000_000, 64, 1024
#: Edits that the first band of an alignment allows.
BAND = 16
#: Pairs that a task aligns.
PAIRS_A_TASK = 1_000
#: Words that a task cuts into grams.
WORDS_A_TASK = 32_768
#: Word hashes that a worker keeps.
MEMO_WORDS = 100_000
#: Rows of labels, lengths or tried pairs that are broadcast at most, so that small rounds need no shuffle.
BROADCAST_ROWS = 50_000
_WORD = re.compile(r"[^\W_]+")
_MEMO: dict[str, int] = {}
_FACTORS = np.random.default_rng(20).integers(1 << 62, size=(2, SKETCHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    if len(_MEMO) > MEMO_WORDS:
        _MEMO.clear()
    memo, words = _MEMO, words_of(text)
    for w in words:
        if w not in memo:
            memo[w] = xxh3_64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def kmers(words: np.ndarray, length: int = KMER) -> np.ndarray:
    """Hash of the k-mer at each place; a shorter text is one k-mer as a whole."""
    size = min(length, len(words))
    h = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ words[k : len(words) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


def occurrences(h: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with the k-th occurrence of one told apart from the others."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if not new.all():
        place = np.arange(len(h))
        h = h.copy()
        with np.errstate(over="ignore"):
            h[order] += (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return h


def rarest(h: np.ndarray, n_words: int, length: int, counts: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The labelled grams h (of `length` words) among which a similar text has one too, by how often their bins occur; those that no other text can have are left out.

    A similar text of m words has n_words - m + k * d(m) grams less in common than n_words has, for d(m) edits allowed; for every m that is at most k * d(n_words) + k.
    """
    return rarest_below(h, n_words, length, counts, 255, least)[0]


def rarest_below(h: np.ndarray, n_words: int, length: int, counts: np.ndarray, crowd: int, least: float = SIMILARITY) -> tuple[np.ndarray, bool]:
    """rarest() without the grams of bins that occur more than `crowd` times, and whether there were any: two such texts must meet in another way."""
    often = counts[h >> np.uint64(64 - (len(counts).bit_length() - 1))]
    first = np.lexsort((h, often))[: length * (int((1 - least) * n_words + 1e-9) + 1) + 1]
    common = often[first] > crowd
    return np.unique(h[first[(often[first] > 1) & ~common]]).view(np.int64), bool(common.any())


def steps_of(n: float) -> int:
    """The byte that stands for a count: exact below 128, then four steps for each doubling."""
    return int(n) if n < 128 else min(255, int(np.log2(n / 128) * 4) + 128)


def sketch(h: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """The values of a text from its k-mers in order, one a hash function. No k-mers: no values."""
    if not len(h):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = occurrences(h)
        mixed = (h[None, :] ^ _FACTORS[0][:sketches, None]) * _FACTORS[1][:sketches, None]
        mixed ^= mixed >> np.uint64(31)
        row = np.arange(sketches)
        first = mixed.argmin(axis=1)
        low = mixed[row, first]
        if len(h) == 1:
            return low.view(np.int64)
        mixed[row, first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = mixed.argmin(axis=1)
        early, late = np.minimum(first, second), np.maximum(first, second)
        value = (h[early] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[late] >> np.uint64(7)) ^ (h[late] << np.uint64(57))
        value = (value ^ (value >> np.uint64(29)) ^ row.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return value.view(np.int64)


def short_values(words: list[int], least: float = SIMILARITY) -> list[int]:
    """Values of a text of at most SHORT words: similar texts of such lengths have one in common, whatever was edited.

    Let the longer of two texts have L words, and let d edits be allowed. Up to DELETED words, both contain the same sequence of L - d words, so values are those
    of all sequences left after deleting words. Beyond, one of d + 1 even segments of the longer text stands untouched in the shorter one, with at most i
    edits before it if it is segment i, and at most d - i after it; values are those of all its possible places.
    """
    n = len(words)
    allowed = lambda size: int((1 - least) * size + 1e-9)
    found: set[int] = set()
    if n > SHORT or not allowed(min(SHORT, int(n / least + 1e-9))):
        return []
    if n <= DELETED:
        for gone in range(allowed(n) + 1):
            found.update(hash((0, *rest)) for rest in combinations(words, n - gone))
    for size in range(max(n, DELETED + 1), min(SHORT, int(n / least + 1e-9)) + 1):
        d = allowed(size)
        at = 0
        for i in range(d + 1):
            length = size // (d + 1) + (i >= d + 1 - size % (d + 1))
            low = max(0, at - i, at + n - size - (d - i))
            high = min(n - length, at + i, at + n - size + d - i)
            found.update(hash((size, i, *words[p : p + length])) for p in range(low, high + 1))
            at += length
    return list(found)


def bag(words: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Words counted in bins: the sum of the smaller counts bounds the words that two texts have in common."""
    return np.bincount(words % bins, minlength=bins)


def pair_bag(words: np.ndarray, bins: int = BLOCK_BINS) -> np.ndarray:
    """Pairs of neighbouring words counted in bins."""
    wide = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        return bag((wide[:-1] * np.uint64(0x9E3779B97F4A7C15) + wide[1:]) % np.uint64((1 << 61) - 1), bins)


def distance_in_band(a: list[int], b: list[int], k: int) -> int | None:
    """Edit distance of a and b, which is at most k shorter, if it is at most k.

    Column by column of the alignment, the 2k + 1 cells around the diagonal are the bits of one number each: vp and vn tell where the distance grows or falls from
    one cell to the next below, zero where it stays along a diagonal. Cells outside the band count as far, and no alignment of at most k edits leaves it.
    """
    n, m = len(a), len(b)
    last = 1 << 2 * k
    full = (last << 1) - 1
    seen: dict[int, tuple[int, int]] = {}  # the cells of a word in the band, as of a column
    for i, w in enumerate(a[:k], 1):
        seen[w] = (0, seen.get(w, (0, 0))[1] | 1 << (i + k))
    vp, vn, goal, distance = full ^ ((1 << k) - 1), 0, 1 << (k + n - m), n - m
    for j, w in enumerate(b, 1):
        if j + k <= n:
            at, cells = seen.get(a[j + k - 1], (j, 0))
            seen[a[j + k - 1]] = (j, cells >> (j - at) | last)
        at, cells = seen.get(w, (j, 0))
        same = cells >> (j - at)
        zero = ((((same & vp) + vp) ^ vp) | same | vn) & full
        if not zero & goal:
            distance += 1
            if distance > k:
                return None
        grows, falls, below = vn | (full ^ (zero | vp)), zero & vp, zero >> 1
        vp, vn = falls | (full ^ (below | grows)), below & grows
    return distance


def distance_within(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance of two sequences if it is at most `most`: banded alignment, in bands that grow from BAND to the width that `most` needs."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return None
    first = 0
    while first < m and a[first] == b[first]:
        first += 1
    while m > first and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b, k = a[first:n], b[first:m], BAND
    while True:
        k = min(k, most)
        found = distance_in_band(a, b, k) if n - m <= k else None
        if found is not None or k == most:
            return found
        k *= 4


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two word sequences have at least this edit similarity. Words and pairs of neighbours in common bound the distance from below and settle most pairs: an edit costs one word, two pairs."""
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.tolist(), b.tolist()
    common = Counter(x) & Counter(y)
    if longest - sum(common.values()) > most:
        return False
    common = Counter(zip(x, x[1:])) & Counter(zip(y, y[1:]))
    if longest - 1 - sum(common.values()) > 2 * most:
        return False
    return distance_within(x, y, most) is not None


def links_across(pdf: pd.DataFrame, least: float) -> list[tuple[int, int]]:
    """Links (a, b) between texts of different components in two blocks i <= j of a bucket, in one block if they are the same.

    Rows: i, j, block, node, label, n_words, words. Two texts are aligned unless lengths, words or pairs of neighbours in common, bounded from above
    by counts in bins, rule a link out. The likeliest come first, and what is linked by then is one component.
    """
    i, j = (int(pdf[c].iloc[0]) for c in ("i", "j"))
    node, label, size, block = (pdf[c].to_numpy() for c in ("node", "label", "n_words", "block"))
    words = [np.frombuffer(x, np.uint32) for x in pdf["words"]]
    bags = np.stack([np.minimum(bag(w, BLOCK_BINS), 0xFFFF) for w in words]).astype(np.uint16)
    pairs = np.stack([np.minimum(pair_bag(w), 0xFFFF) for w in words]).astype(np.uint16)
    others = np.flatnonzero(block == j)
    found = []
    for p in np.flatnonzero(block == i):
        q = others[others > p] if i == j else others
        q = q[label[q] != label[p]]
        longest = np.maximum(size[q], size[p])
        most = ((1 - least) * longest + 1e-9).astype(np.int64)
        near = np.abs(size[q] - size[p]) <= most
        q, longest, most = q[near], longest[near], most[near]
        common = np.minimum(bags[q], bags[p]).sum(axis=1, dtype=np.int64)
        likely = longest - common <= most
        q, longest, most, share = q[likely], longest[likely], most[likely], common[likely] / longest[likely]
        likely = longest - 1 - np.minimum(pairs[q], pairs[p]).sum(axis=1, dtype=np.int64) <= 2 * most  # an edit costs two pairs
        q, share = q[likely], share[likely]
        found.append((np.full(len(q), p), q, share))
    if not found:
        return []
    left, right, share = (np.concatenate(x) for x in zip(*found))
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x] = top.get(top[x], top[x])
        return x

    links = []
    for k in np.argsort(-share, kind="stable"):
        p, q = left[k], right[k]
        x, y = root(int(label[p])), root(int(label[q]))
        if x != y and similar(words[p], words[q], least):
            top[max(x, y)] = min(x, y)
            links.append((int(min(node[p], node[q])), int(max(node[p], node[q]))))
    return links


def likely_pairs(node: np.ndarray, label: np.ndarray, size: np.ndarray, bags: np.ndarray, common: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (smaller node, larger node) of different labels in a small group that neither lengths nor words in common rule out. Two that are both `common` meet again elsewhere."""
    p, q = np.triu_indices(len(node), 1)
    open_ = (label[p] != label[q]) & ~(common[p] & common[q])
    p, q = p[open_], q[open_]
    longest = np.maximum(size[p], size[q])
    most = ((1 - least) * longest + 1e-9).astype(np.int64)
    near = np.abs(size[p] - size[q]) <= most
    p, q, longest, most = p[near], q[near], longest[near], most[near]
    near = longest - np.minimum(bags[p], bags[q]).sum(axis=1, dtype=np.int64) <= most
    return [(int(min(x, y)), int(max(x, y))) for x, y in zip(node[p[near]], node[q[near]])]


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """(rid, digest, values, n_words, bag, words) of every row of docs (_rid, text) that has a text. words are 32-bit hashes, the rest is made of 64-bit ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for pdf in batches:
            rows = []
            for rid, x in zip(pdf["_rid"], pdf["text"]):
                h = word_hashes(x)
                low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                values = sketch(kmers(h))
                if 0 < len(h) <= SHORT:
                    values = np.concatenate([values, np.array(short_values(h.tolist()), np.int64)])
                counts = np.minimum(bag(low), 0xFFFF).astype(np.uint16).tobytes()
                rows.append((rid, xxh3_128_digest(h.tobytes() if len(h) else b"raw:" + x.encode()), values, len(h), counts, low.tobytes()))
            yield pd.DataFrame(rows, columns=["rid", "digest", "values", "n_words", "bag", "words"])

    given = docs.where(F.col(text).isNotNull()).select("_rid", F.col(text).alias("text"))
    return given.mapInPandas(run, "rid long, digest binary, values array<long>, n_words long, bag binary, words binary")


class _Search:
    """The tables of one run: nodes (node, n_words, bag), their words (node, words), links and tried pairs so far, and the labels of linked nodes."""

    def __init__(self, nodes: DataFrame, words: DataFrame, least: float):
        self.nodes, self.words, self.least, self.labels = nodes, words, least, None
        self.links: list[DataFrame] = []
        self.tried: list[DataFrame] = []
        self.open_tables: list[DataFrame] = []

    def labelled(self, rows: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
        if self.labels is None:
            return rows.withColumn(label, F.col(node))
        known = few(self.labels.select(F.col("node").alias(node), F.col("label").alias("_l")))
        return rows.join(known, node, "left").withColumn(label, F.coalesce("_l", node)).drop("_l")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that were not tried before."""
        open_ = self.labelled(self.labelled(pairs, "a", "la"), "b", "lb").where("la <> lb").select("a", "b")
        for done in self.tried:
            open_ = open_.join(few(done), ["a", "b"], "left_anti")
        return open_

    def with_words(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ..) with the words of both, wa and wb. Few ids are broadcast, so the words of other nodes stay where they are."""
        words = stored(among(self.words, pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"), "node"), "words")
        left = pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
        out = left.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
        out.words_at = words
        return out

    def verify(self, pairs: DataFrame) -> None:
        """Align the pairs (a, b) that are apart, keep those that are similar as links, and merge components."""
        least = self.least

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ok = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in zip(pdf["wa"], pdf["wb"])]
                yield pdf.loc[ok, ["a", "b"]]

        size = lambda side: few(self.nodes.select(F.col("node").alias(side), F.col("n_words").alias(f"n{side}")))
        open_ = stored(self.apart(pairs).join(size("a"), "a").join(size("b"), "b"), "pairs")
        likely = open_.where(F.least("na", "nb") >= F.greatest("na", "nb") * (least - 1e-9)).select("a", "b")
        likely = likely.repartition(max(2, likely.count() // PAIRS_A_TASK), "a", "b")  # ids are few bytes, alignments are the work
        both = self.with_words(likely)
        links = stored(both.select("a", "b", "wa", "wb").mapInPandas(run, "a long, b long"), "links")
        drop_stored(both.words_at)
        self.tried.append(open_.select("a", "b"))
        self.add(links)
        self.open_tables.append(open_)

    def add(self, links: DataFrame) -> None:
        self.links.append(links)
        if self.labels is None or links.limit(1).count():
            self.labels = _relabel(self.labels, links)

    def several(self, members: DataFrame) -> DataFrame:
        """Members (value, node, head, n, label) of the groups that have several components; of groups with the same members one is kept."""
        rows = self.labelled(members)
        mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
        groups = rows.groupBy("value", "n").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), mark(1).alias("m1"), mark(2).alias("m2")).where("lo < hi")
        one = groups.groupBy("n", "m1", "m2").agg(F.min("value").alias("value")).select("value")
        return rows.join(one, "value", "left_semi")

    def mixed(self, members: DataFrame, more_than: int = 2) -> DataFrame:
        """Members of the groups of more than that and at most SMALL members that have several components, stored."""
        return stored(self.several(members.where((F.col("n") > more_than) & (F.col("n") <= SMALL))), "mixed")

    def crowded(self, members: DataFrame) -> DataFrame:
        """(node, label) of the members of larger groups that have several components, each once, stored. Only the nodes count from here, so the members are no rows of a table."""
        return stored(self.several(members.where(F.col("n") > SMALL)).select("node", "label").distinct(), "crowded")

    def small_pairs(self, members: DataFrame) -> DataFrame:
        """Likely pairs (a, b) inside groups of at most SMALL members; if members have the column `common`, two of those are left to the next round, where they meet for certain."""
        least = self.least

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pairs = set()
                for node, label, size, bags, common in zip(pdf["node"], pdf["label"], pdf["n_words"], pdf["bag"], pdf["common"]):
                    pairs.update(likely_pairs(node, label, size, np.frombuffer(b"".join(bags), np.uint16).reshape(-1, BINS), np.asarray(common, bool), least))
                yield pd.DataFrame(list(pairs), columns=["a", "b"], dtype="int64")

        common = F.col("common") if "common" in members.columns else F.lit(False).alias("common")
        rows = members.where(F.col("n") <= SMALL).select("value", "node", "label", common).join(self.nodes.select("node", "n_words", "bag"), "node")
        held = rows.groupBy("value").agg(F.collect_list(F.struct("node", "label", "n_words", "bag", "common")).alias("x"))
        return held.select("x.node", "x.label", "x.n_words", "x.bag", "x.common").mapInPandas(run, "a long, b long").distinct()

    def rare_grams(self, nodes: DataFrame, length: int) -> DataFrame:
        """(node, value, common), stored: the rarest grams of `length` words of each of the nodes (node; label, if it is known), enough that similar ones of different labels have one in common.

        How often grams occur among the nodes is counted in bins, a byte a bin and some BINS_A_GRAM bins a gram up to a fixed number; only bins that several labels share reach the driver. Grams
        that one label has alone count once and come first: they take places among the rarest, as any order of all grams will do, and are no rows, as they join no components. Grams of
        one bin are ordered by their hashes, so the order is the same for all texts. A gram too common for a group that is settled pair by pair is no row of its own: the node has then one row
        whose value is null and is `common` in all its rows, and two such nodes must meet otherwise. So each text has at most a row for every gram that a few others share.
        """
        nodes = nodes if "label" in nodes.columns else self.labelled(nodes)
        words, least = stored(among(self.words, nodes.select("node"), "node").join(nodes, "node"), "words"), self.least
        total = words.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 4
        dealt = words.repartition(max(1, total // WORDS_A_TASK))  # about even in words
        bits = min(MOST_BITS, max(BIN_BITS, (total * BINS_A_GRAM).bit_length()))
        grams = lambda x: occurrences(kmers(np.frombuffer(x, np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), length))
        crowd = steps_of(SMALL + 4 * total / (1 << bits))  # where bins hold several grams, that many occurrences are usual

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    own = [grams(x) for x in pdf["words"]]
                    bin_, label = (np.concatenate(own) >> np.uint64(64 - bits)).astype(np.int32), np.repeat(pdf["label"].to_numpy(), [len(x) for x in own])
                    order = np.lexsort((label, bin_))
                    bin_, label = bin_[order], label[order]
                    first, last = np.flatnonzero(np.diff(bin_, prepend=-1)), np.flatnonzero(np.diff(bin_, append=-1))
                    yield pd.DataFrame({"bin": bin_[first], "n": last - first + 1, "lo": label[first], "hi": label[last]})

        n = F.sum("n")  # exact below 128, then four steps for each doubling, so that a count fits a byte
        step = F.when(n < 128, n).otherwise(F.least(F.lit(255), F.floor(F.log2(n / 128) * 4) + 128)).cast("short")
        bins = dealt.select("label", "words").mapInPandas(count, "bin int, n long, lo long, hi long").groupBy("bin").agg(step.alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        counted = bins.where("lo < hi").select("bin", "n").toArrow()
        counts = np.ones(1 << bits, np.uint8)
        counts[counted["bin"].to_numpy()] = counted["n"].to_numpy()
        shared = words.sparkSession.sparkContext.broadcast(counts)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                nodes_, values, flags = [], [], []
                for node, x in zip(pdf["node"], pdf["words"]):
                    own, common = rarest_below(grams(x), len(x) // 4, length, shared.value, crowd, least)
                    nodes_ += [node] * (len(own) + common)
                    values += own.tolist() + [None] * common
                    flags += [common] * (len(own) + common)
                yield pd.DataFrame({"node": pd.Series(nodes_, dtype="int64"), "value": pd.Series(values, dtype="Int64"), "common": pd.Series(flags, dtype="bool")})

        found = stored(dealt.select("node", "words").mapInPandas(run, "node long, value long, common boolean"), "values")
        shared.destroy()
        drop_stored(words)
        return found


def few(rows: DataFrame) -> DataFrame:
    """A stored table as one side of a join: broadcast if it has few rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def grouped(values: DataFrame) -> DataFrame:
    """Members (value, node, head, n) of the groups of two or more nodes with an equal value, stored. values: (node, value) without repeats; if they have the column `common`, groups of such nodes alone are left out."""
    groups = values.groupBy("value").agg(F.min("node").alias("head"), F.count("*").alias("n"), F.bool_and("common" if "common" in values.columns else F.lit(False)).alias("later")).where("n > 1 and not later")
    return stored(values.join(groups.drop("later"), "value"), "members")


def _across(inside: DataFrame, nodes: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Links between components of crowded groups, stored. inside: node, label, value. Each two blocks whose lengths can be similar meet in one task."""
    size = F.col("n_words")
    length = F.floor(F.log(size) / F.log(F.lit(1.01 / least))).cast("int")  # similar texts are at most one class apart
    sized = inside.join(nodes.select("node", "n_words"), "node").withColumn("length", length)
    rows_of = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_WORDS) / F.max("n_words"))))
    dealt = sized.groupBy("value", "length").agg(F.ceil(F.count("*") / rows_of).alias("salts"))
    block = (F.col("length").cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("salts"))).alias("block")
    placed = stored(sized.join(dealt, ["value", "length"]).select("value", "length", block, "node", "label"), "placed")
    blocks = placed.groupBy("value", "length", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    side = lambda name, shift: blocks.select("value", (F.col("length") + shift).alias("length"), F.col("block").alias(name), F.col("lo").alias(f"lo{name}"), F.col("hi").alias(f"hi{name}"))
    meet = lambda shift: side("i", shift).join(side("j", 0), ["value", "length"])
    several = F.least("loi", "loj") < F.greatest("hii", "hij")
    both = stored(meet(0).where("i <= j").union(meet(1)).where(several).select("value", "i", "j"), "meet")
    seats = both.select("*", F.col("i").alias("block")).union(both.where("i < j").select("*", F.col("j").alias("block")))
    seated = seats.join(placed.drop("length"), ["value", "block"]).join(nodes.select("node", "n_words"), "node").join(among(words, placed.select("node").distinct(), "node"), "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_across(pdf, least), columns=["a", "b"], dtype="int64")

    links = stored(seated.groupBy("value", "i", "j").applyInPandas(run, "a long, b long").distinct(), "links")
    drop_stored(placed, both)
    return links


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after adding links (a, b) between nodes, stored; the labels before are deleted."""
    count = links.count()
    if labels is None:
        return components(links, count)
    at = lambda side: few(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")))
    tasks = max(2, labels.count() // EDGES_A_TASK)
    joined = links.join(at("a"), "a", "left").coalesce(tasks).join(at("b"), "b", "left").coalesce(tasks)
    merged = components(joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), count)
    old = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = stored(old.coalesce(tasks).union(merged.join(labels, "node", "left_anti").coalesce(tasks)), "labels")
    drop_stored(labels, merged)
    return out


def find_links(nodes: DataFrame, words: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(links, labels) of nodes (node, values, n_words, bag) and their words (node, words): links a, b; labels of the nodes that have a link."""
    search = _Search(nodes, words, least)
    members = grouped(nodes.select("node", F.explode(F.array_distinct("values")).alias("value")))
    nearest = members.groupBy("node").agg(F.min("head").alias("a")).where("a < node").select("a", F.col("node").alias("b"))
    search.verify(nearest)
    search.verify(members.where("head < node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    mixed = search.mixed(members)
    search.verify(search.small_pairs(mixed))
    crowded = search.crowded(members)
    drop_stored(members, mixed)
    for length in GRAMS:
        if length * (1 - least) > 0.5 or not crowded.limit(1).count():  # so many edits may destroy all grams of a short text
            continue
        values = search.rare_grams(crowded, length)
        members = grouped(values.where("value is not null"))
        mixed = search.mixed(members, 1)
        search.verify(search.small_pairs(mixed))
        inside, common = search.crowded(members), search.labelled(values.where("value is null").select("node"))
        drop_stored(crowded)
        crowded = stored(inside.union(common.select("node", "label")).distinct(), "crowded")
        drop_stored(values, members, mixed, inside)
    if crowded.limit(1).count():
        search.add(_across(crowded.withColumn("value", F.lit(0)), nodes, words, least))
    drop_stored(crowded)
    found = search.links[0]
    for more in search.links[1:]:
        found = found.union(more)
    out = stored(found.distinct(), "found")
    drop_stored(*search.links, *search.open_tables)
    return out, search.labels


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: rid, doc_id, class_rid, class_id, class_size, n_links of every row; links: a, b (rids of aligned nodes).

    class_size counts the rows of the class. n_links counts the other texts to which the row's text was aligned and found similar; two texts that were in one class before
    they could be aligned are not aligned any more, so links span the classes and are not all similar pairs. Equal texts have equal counts and no link between them.
    class_id is the smallest doc_id of the class and class_rid the smallest row id, where rid is the column _rid of docs if there is one, which must be a long
    without repeats, and else numbers the stored rows. Null texts are classes of their own. Texts with equal words, empty texts, and texts without a word but otherwise equal
    are in one class. Null doc_ids count as larger than any other; repeated rows are duplicates. An empty table gives empty results. Other columns are not used.
    """
    shared_dir(docs.sparkSession)
    ided = docs if "_rid" in docs.columns else with_row_id(docs)
    table = stored(sketched(ided, text), "sketch")
    ids = ided.where(F.col(text).isNotNull()).select(F.col("_rid").alias("rid"), "doc_id")
    known = table.select("rid", "digest").join(ids, "rid")
    heads = stored(known.groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "heads")
    every = table.withColumnRenamed("rid", "node")
    nodes = stored(among(every.select("node", "values", "n_words", "bag"), heads.select("node"), "node"), "nodes")
    links, labels = find_links(nodes, every.select("node", "words"), least)
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = heads.join(labels, "node", "left").join(ends, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.min("node").alias("class_rid"), F.sum("copies").alias("class_size"))
    names = stored(named.join(first, "label").select("digest", "class_rid", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")), "names")
    rows = known.join(names, "digest").select("rid", "doc_id", "class_rid", "class_id", "class_size", "n_links")
    alone = ided.where(F.col(text).isNull()).select(F.col("_rid").alias("rid"), "doc_id", F.col("_rid").alias("class_rid"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    result = stored(rows.unionByName(alone), "classes")
    drop_stored(table, heads, nodes, names)
    return result, links


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The first stored row of each class; a null text is a class of its own. All columns are kept, and texts are not moved; names that start with _ are reserved."""
    ided = with_row_id(docs)
    rows, _ = near_duplicates(ided, least)
    keep = rows.where("rid = class_rid").select(F.col("rid").alias("_rid"))
    return among(ided, keep, "_rid").select(*docs.columns)
