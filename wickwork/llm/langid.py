"""Language identification by interpolated Kneser-Ney character language models.

One model a language, all on character n-grams inside words (a word starts after a blank). Models
are sorted arrays of n-gram hashes with log probabilities and back-off weights; a text goes to the
language with the lowest cross-entropy a character. Texts that no model explains as well as it
explains nearly all of its own calibration texts, which are no part of the texts it was fitted on, are rejected.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
#: Documents of a language that its model is fitted on, and as many again for calibration (expected numbers; taken by a hash of the text).
SAMPLE_DOCS = 600
#: Share of the hash's range that is for fitting, the rest is for calibration; languages with fewer labelled documents than this are all for fitting.
FIT_RANGE, LEAST_SPLIT = 0.75, 20
#: Discount of the Kneser-Ney estimates; probability mass of characters never seen is spread over this many.
DISCOUNT, UNSEEN_CHARS = 0.75, 4096
#: Share of a language's own calibration texts that may be rejected, and the room added to the threshold.
REJECTED_SHARE, ROOM_BITS = 0.001, 0.5
MEMO_WORDS = 300_000
_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    words = _WORD.findall(text.lower())
    return words if all(map(str.isalpha, words)) else _LETTERS.findall(text.lower())  # numerals such as one half are no letters


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a blank, all characters of the words and the blank after each: word number, position, and the hash of the n-gram of each order that ends there.

    Positions count from 1 inside a word, its final blank included; the first blank has 0 and word -1. An n-gram that would
    reach before the blank that precedes its word has hash 0 in that order.
    """
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts, index = np.flatnonzero(codes == 32), np.arange(len(codes))
    word = np.searchsorted(starts, index, "left") - 1
    at = np.where(word < 0, 0, index - starts[word])
    out, h = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            moved = np.concatenate([np.zeros(n - 1, np.uint64), codes[: len(codes) - n + 1]])
            h = (h ^ ((moved + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            out.append(np.where(at >= n - 1, h, 0))
    return word, at, out


@dataclass
class Model:
    """Sorted n-gram hashes by order, each with a row of log2 probabilities and of log2 back-off weights by language."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    limits: np.ndarray | None = None

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word, its final blank included: a row a word, a column a language."""
        word, at, grams = hashes(words)
        size = len(word)
        total = np.zeros((size, len(self.languages)), np.float32)
        open_ = np.arange(1, size)
        for n in range(ORDER, 0, -1):
            keys, here = self.keys[n - 1], open_[grams[n - 1][open_] != 0]
            found = np.zeros(size, bool)
            if len(keys) and len(here):
                k = np.minimum(np.searchsorted(keys, grams[n - 1][here]), len(keys) - 1)
                hit = keys[k] == grams[n - 1][here]
                total[here[hit]] += self.logp[n - 1][k[hit]]
                found[here[hit]] = True
            open_ = open_[~found[open_]]
            if n > 1 and len(open_) and len(self.keys[n - 2]):  # the weight belongs to the context, the n-gram that ends one character before
                lower = open_[at[open_] >= n - 1]
                context = grams[n - 2][lower - 1]
                k = np.minimum(np.searchsorted(self.keys[n - 2], context), len(self.keys[n - 2]) - 1)
                seen = (self.keys[n - 2][k] == context) & (context != 0)
                total[lower[seen]] += self.backoff[n - 2][k[seen]]
        total[open_] += self.unseen
        bits = np.zeros((len(words), len(self.languages)))
        np.add.at(bits, word[1:], -total[1:])
        return bits


def fit(counts: pd.DataFrame) -> Model:
    """counts: lang, n, gram (hash), context (hash of its first n - 1 characters), suffix (of its last n - 1), seen.

    The highest order uses counts, lower orders use the number of different characters before the n-gram. A gram
    that some language lacks gets that language's backed-off value, so one search serves all languages.
    """
    languages = sorted(counts["lang"].unique())
    keys, logp, backoff = [], [], []
    lower: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in range(1, ORDER + 1):
        rows = counts[counts["n"] == n]
        names = np.sort(rows["gram"].unique())
        p = np.zeros((len(names), len(languages)))
        first = rows.drop_duplicates("gram").set_index("gram").loc[names]
        context, suffix = first["context"].to_numpy(), first["suffix"].to_numpy()
        ctx_keys, ctx_at = np.unique(context, return_inverse=True)
        weight = np.ones((len(ctx_keys), len(languages)))
        for j, lang in enumerate(languages):
            c = np.zeros(len(names))
            if n == ORDER:
                own = rows[rows["lang"] == lang]
                c[np.searchsorted(names, own["gram"].to_numpy())] = own["seen"].to_numpy()
            else:
                above = counts[(counts["n"] == n + 1) & (counts["lang"] == lang)].groupby("suffix").size()
                at = np.searchsorted(names, above.index.to_numpy())
                ok = at < len(names)
                at, vals, idx = at[ok], above.to_numpy()[ok], above.index.to_numpy()[ok]
                same = names[at] == idx
                c[at[same]] = vals[same]
                own = rows[rows["lang"] == lang]
                k = np.searchsorted(names, own["gram"].to_numpy())
                c[k] = np.maximum(c[k], 1)  # word-initial grams have nothing before them
            total = np.bincount(ctx_at, c, len(ctx_keys))
            kinds = np.bincount(ctx_at, c > 0, len(ctx_keys))
            weight[:, j] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            if n == 1:
                rest = np.full(len(names), 1 / UNSEEN_CHARS)
                unseen = np.log2(weight[0] / UNSEEN_CHARS).astype(np.float32)
            else:
                low_keys, low_p = lower[n - 1]
                rest = low_p[np.searchsorted(low_keys, suffix), j]
            p[:, j] = np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[ctx_at] + weight[ctx_at, j] * rest
        lower[n] = (names, p)
        keys.append(names)
        logp.append(np.log2(p).astype(np.float32))
        if n > 1:  # weights of the contexts of this order stand beside the grams one order below
            w = np.zeros((len(keys[n - 2]), len(languages)), np.float32)
            at = np.minimum(np.searchsorted(keys[n - 2], ctx_keys), len(keys[n - 2]) - 1)
            same = keys[n - 2][at] == ctx_keys
            w[at[same]] = np.log2(weight[same])
            backoff.append(w)
    backoff.append(np.zeros((len(keys[-1]), len(languages)), np.float32))
    return Model(languages, keys, logp, backoff, unseen)


class Scorer:
    """Cross-entropies of texts; bits of words already met are kept up to a bound."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.table = np.zeros((1024, len(model.languages) + 1))

    def learn(self, words: list[str]) -> None:
        at = len(self.memo)
        if at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((at + len(words), self.table.shape[1]))])
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            self.table[at + i : at + i + len(part), :-1] = self.model.word_bits(part)
        self.table[at : at + len(words), -1] = [len(w) + 1 for w in words]
        self.memo.update(zip(words, range(at, at + len(words))))

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by language, and the characters counted; texts without a letter have 0."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        bags = [Counter(words_of(x)) if x else Counter() for x in texts]
        self.learn(list(set().union(*bags).difference(self.memo)))
        total = np.zeros((len(bags), self.table.shape[1]))
        row = self.memo.__getitem__
        for i, bag in enumerate(bags):
            if bag:
                total[i] = np.fromiter(bag.values(), float, len(bag)) @ self.table[np.fromiter(map(row, bag), np.int64, len(bag))]
        chars = total[:, -1]
        return total[:, :-1] / np.maximum(chars, 1)[:, None], chars


def length_class(chars: np.ndarray) -> np.ndarray:
    """Classes of text length for calibration: short texts vary more."""
    return np.clip(np.log2(np.maximum(chars, 1)).astype(int), 3, 12) - 3


def _sample(docs: DataFrame, label: str, calibrate: bool, docs_per_language: int) -> DataFrame:
    """About docs_per_language labelled rows of every language, by a hash of the text alone. Rows for fitting and for calibration never share a text."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    bounds = []
    for lang, n in known.groupBy(label).count().collect():  # one row a language
        split = FIT_RANGE if n >= LEAST_SPLIT else 1.0
        width = min(1 - split if calibrate else split, docs_per_language / n)
        bounds += [F.lit(lang), F.array(F.lit(split * calibrate), F.lit(split * calibrate + width))]
    if not bounds:
        return known.select(F.col(label).alias("lang"), "text")
    at = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "text"), 11) / float(1 << 53)
    bound = F.element_at(F.create_map(*bounds), F.col(label))
    return known.where((at >= bound[0]) & (at < bound[1])).select(F.col(label).alias("lang"), "text")


def train(docs: DataFrame, label: str = "lang", docs_per_language: int = SAMPLE_DOCS) -> Model | None:
    """Fit on a bounded sample of labelled rows and calibrate on another; None if there are none.

    Every label value is a language. n-grams are counted on the executors and summed by Spark. The table that reaches the driver is bounded
    by docs_per_language whole texts of each language. doc_id and other columns are not used. The limit of a language and length class is the larger of
    that of all calibration texts of the class and that of the language's own; without calibration texts nothing but texts without a letter is rejected.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                bag: Counter = Counter()
                for x in texts:
                    bag.update(words_of(x))
                if bag:
                    yield _ngrams(lang, bag)

    counted = _sample(docs, label, False, docs_per_language).mapInPandas(count, "lang string, n int, gram long, context long, suffix long, seen long")
    counts = counted.groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("seen").alias("seen")).toPandas()
    if counts.empty:
        return None
    for c in ("gram", "context", "suffix"):
        counts[c] = counts[c].to_numpy().view(np.uint64)
    model = fit(counts)

    def entropies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            bits, chars = scorer.texts(pdf["text"])
            keep = chars > 0
            yield pd.DataFrame({"lang": pdf["lang"][keep], "c": length_class(chars)[keep], "bits": bits.min(axis=1)[keep]})

    model.limits = limits_of(_sample(docs, label, True, docs_per_language).mapInPandas(entropies, "lang string, c int, bits double").toPandas(), model.languages)
    return model


def limits_of(found: pd.DataFrame, languages: list[str]) -> np.ndarray:
    """Largest cross-entropy that is kept, by language and length class, from calibration texts (lang, c, bits)."""
    high = lambda rows: float(rows["bits"].quantile(1 - REJECTED_SHARE))
    if not len(found):
        return np.full((len(languages), 10), math.inf)
    limits = np.full((len(languages), 10), high(found) + 2 * ROOM_BITS)
    for c, rows in found.groupby("c"):
        more = ROOM_BITS + (1.0 if c < 3 else 0.0)
        limits[:, int(c)] = max(high(found), high(rows)) + more
        for lang, own in rows.groupby("lang"):
            if lang in languages:
                j = languages.index(lang)
                limits[j, int(c)] = max(limits[j, int(c)], high(own) + more)
    return limits


def _ngrams(lang: str, bag: Counter) -> pd.DataFrame:
    words = list(bag)
    times = np.fromiter(bag.values(), np.int64, len(bag))
    word, at, grams = hashes(words)
    before = [np.concatenate([np.zeros(1, np.uint64), g[:-1]]) for g in grams]
    out = []
    for n in range(1, ORDER + 1):
        g = grams[n - 1]
        ok = (g != 0) & (at > 0)
        context = before[n - 2][ok] if n > 1 else np.zeros(ok.sum(), np.uint64)
        suffix = grams[n - 2][ok] if n > 1 else np.zeros(ok.sum(), np.uint64)
        frame = pd.DataFrame({"gram": g[ok].view(np.int64), "context": context.view(np.int64), "suffix": suffix.view(np.int64), "seen": times[word[ok]]})
        frame = frame.groupby("gram", as_index=False).agg({"context": "first", "suffix": "first", "seen": "sum"})
        frame.insert(0, "n", np.int32(n))
        out.append(frame)
    done = pd.concat(out)
    done.insert(0, "lang", lang)
    return done


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected to each row; whole texts, row by row.

    A null text or one without a letter gets `und`, score 0 and is rejected; so does every text when there is no model.
    Else lang_pred is the language of the lowest cross-entropy (the first in order on a tie), score its share against
    the others at that cross-entropy difference over at most 64 characters, and rejected whether the
    cross-entropy passes the calibrated limit of its language and length class. Other columns are carried; columns with the added names are replaced.
    """
    base = docs.drop("lang_pred", "score", "rejected")

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model) if model else None
        for texts in batches:
            if scorer is None:
                yield pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "rejected": True})
                continue
            parts = []
            for i in range(0, len(texts), 256):
                bits, chars = scorer.texts(texts.iloc[i : i + 256])
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(bits)), best]
                odds = np.exp2(-(bits - low[:, None]) * np.minimum(chars, 64)[:, None]).sum(axis=1)
                none = chars == 0
                names = np.array([*model.languages, "und"], dtype=object)[np.where(none, len(model.languages), best)]
                parts.append(pd.DataFrame({"lang_pred": names, "score": np.where(none, 0.0, 1 / odds), "rejected": none | (low > model.limits[best, length_class(chars)])}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": pd.Series(dtype=str), "score": pd.Series(dtype=float), "rejected": pd.Series(dtype=bool)})

    solved = base.withColumn("_s", solve(F.col(text)))
    return solved.select(*base.columns, "_s.lang_pred", "_s.score", "_s.rejected")


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of doc_id as text leaves 2 on division by 4 (a null id is learned from like id '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
