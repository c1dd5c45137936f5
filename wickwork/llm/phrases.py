"""Phrase collocation mining: best-first branch-and-bound growth of phrases of up to four words.

A phrase grows to the right, one word at a time. No extension of a prefix with count a and first word's count f can score above 2a / (f + a) (in SCALE / 2 units): it occurs at most a
times, and the cut behind the first word alone keeps it below that. So prefixes are the frontier, ordered by this bound. Each round lowers every unsettled language's level to
the score of a later bigram, expands all prefixes whose bound reaches the level, counts what may drop a candidate, and settles the language once enough survivors reach the level.

Counts come from passes over the texts. A task counts what passes bit sets of a fixed size (sieves) that hold the hashes of expandable phrases; whatever a sieve lets through by
chance is counted exactly and dropped later, so sieves save work and change no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.llm.common import stored

#: Words of the longest phrase; scores are floor(SCALE * a / (l + r)).
LONGEST, SCALE = 4, 2_000_000
#: Bits of a sieve (8 MB each); a task holds five at most.
SIEVE_BITS = 26
#: Words that a task counts at a time, and bytes of text that it cuts into words at a time.
BUFFER_WORDS, SLICE_BYTES = 2_500_000, 1 << 20
#: The first level is the score of the bigram at this multiple of the wanted number; every further round doubles it.
FIRST_LEVEL = 1.5

_STOPS = b".,;:!?\n\x0b\x0c\r"
_TO_SPACE = bytes.maketrans(_STOPS + b"\t", b"\n" * len(_STOPS) + b" ")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and that word's."""
    h = (a ^ (a >> np.uint64(29))) * _MIX[0] + b
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    return h ^ (h >> np.uint64(27))


class _Words(dict):
    """Numbers for the words of one language, given on first sight; all languages of a buffer share the lists."""

    def __init__(self, code: int, words: list, codes: list):
        self.code, self.words, self.codes = code, words, codes
        self[b"."] = -1

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.codes.append(self.code)
        return n


def _pieces(text: str, slice_bytes: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Words of a text in slices; b"." stands between pieces."""
    raw = text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= slice_bytes else max(raw.rfind(b" ", at, at + slice_bytes), raw.rfind(b"\n", at, at + slice_bytes)) + 1
        if end <= at:  # one word longer than a slice
            after = [x for x in (raw.find(b" ", at), raw.find(b"\n", at)) if x >= 0]
            end = min(after) + 1 if after else len(raw)
        yield raw[at:end].replace(b"\n", b" . ").split()
        at = end


class _Buffer:
    """Words of many texts as numbers, -1 between pieces."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.codes, self.by_lang, self.parts, self.size = [], [], {}, [], 0

    def add(self, lang: str, tokens: list[bytes]) -> None:
        known = self.by_lang.get(lang)
        if known is None:
            known = self.by_lang[lang] = _Words(len(self.by_lang), self.words, self.codes)
        self.parts.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)

    def hashes(self) -> np.ndarray:
        """Hash of every word in its language, and a last one for what is no word."""
        seeds, digest = [_seed(x) for x in self.by_lang], xxhash.xxh64_intdigest
        return np.array([*(digest(w, seeds[c]) for w, c in zip(self.words, self.codes)), 0], np.uint64)

    def langs(self, numbers: np.ndarray) -> pa.Array:
        """Languages of the words with these numbers."""
        return pa.array(list(self.by_lang), pa.string()).take(pa.array(np.array(self.codes, np.int64)[numbers]))

    def stop(self) -> None:
        self.parts.append(np.array([-1]))

    def numbers(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)

    def restart(self, lang: str, numbers: np.ndarray) -> None:
        """Begin anew inside a text whose last LONGEST - 1 words are still needed as the start of phrases."""
        tail = [b"." if x < 0 else self.words[x] for x in numbers[-(LONGEST - 1) :]]
        self.clear()
        self.add(lang, tail)


def _passes(sieve: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a sieve lets through; a missing one holds nothing."""
    if sieve is None:
        return np.zeros(len(hashes), bool)
    bit = hashes >> np.uint64(64 - SIEVE_BITS)
    return (sieve[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(docs: DataFrame, schema: str, buffer_rows) -> DataFrame:
    """One pass over the texts: buffer_rows(buffer, numbers, already) yields batches for one buffer, of which the first `already` words were in the buffer before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, already = _Buffer(), 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for tokens in _pieces(text.as_py() or ""):
                    buffer.add(lang, tokens)
                    if buffer.size >= BUFFER_WORDS:
                        numbers = buffer.numbers()
                        yield from buffer_rows(buffer, numbers, already)
                        buffer.restart(lang, numbers)
                        already = buffer.size
                buffer.stop()
        if buffer.size:
            yield from buffer_rows(buffer, buffer.numbers(), already)

    return docs.select("lang", "text").mapInArrow(run, schema)


def _word_rows(buffer: _Buffer, numbers: np.ndarray, already: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of single words; a null phrase counts all words of its language."""
    new = numbers[already:]
    counts = np.bincount(new[new >= 0], minlength=len(buffer.words))
    totals = np.bincount(np.array(buffer.codes, np.int64), counts, len(buffer.by_lang)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(buffer.by_lang), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(totals)], ["lang", "phrase", "f"])
    seen = np.flatnonzero(counts)
    words = pa.array([buffer.words[i] for i in seen], pa.binary()).cast(pa.string())
    yield pa.RecordBatch.from_arrays([buffer.langs(seen), words, pa.array(counts[seen])], ["lang", "phrase", "f"])


def _windows(numbers: np.ndarray, already: int, size: int) -> np.ndarray:
    """Starts of all windows of size words inside one piece that end in a new word."""
    broken = np.concatenate([[0], np.cumsum(numbers < 0)])
    starts = np.arange(max(0, already - size + 1), max(0, len(numbers) - size + 1))
    return starts[broken[starts + size] == broken[starts]]


def _hash_rows(frequent):
    """(h, f): counts of hashes of pairs of two frequent words."""

    def rows(buffer: _Buffer, numbers: np.ndarray, already: int) -> Iterator[pa.RecordBatch]:
        by_word = buffer.hashes()
        often = np.append(_passes(frequent.value, by_word[:-1]), False)
        starts = _windows(numbers, already, 2)
        a, b = numbers[starts], numbers[starts + 1]
        both = often[a] & often[b]
        h, f = np.unique(_joined(by_word[a[both]], by_word[b[both]]).view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(f)], ["h", "f"])

    return rows


def _phrase_rows(size: int, wanted):
    """(lang, phrase, f): counts of the windows of this size that wanted(hashes) marks; hashes(i, j) gives the hash of words i to j of all windows that are left."""

    def rows(buffer: _Buffer, numbers: np.ndarray, already: int) -> Iterator[pa.RecordBatch]:
        by_word = buffer.hashes()
        starts = wanted(_Hashes(numbers, by_word, _windows(numbers, already, size)))
        # equal windows, exactly: pairs of numbers are renumbered, then joined with the next word
        code, width = numbers[starts], len(buffer.words)
        for i in range(1, size):
            _, code = np.unique(code * width + numbers[starts + i], return_inverse=True)
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        at = starts[first]
        words = [[buffer.words[x] for x in numbers[at + i]] for i in range(size)]
        phrases = pa.array([b" ".join(p) for p in zip(*words)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([buffer.langs(numbers[at]), phrases, pa.array(counts)], ["lang", "phrase", "f"])

    return rows


class _Hashes:
    """Windows of which a chain of sieves leaves fewer and fewer."""

    def __init__(self, numbers: np.ndarray, by_word: np.ndarray, starts: np.ndarray):
        self.numbers, self.by_word, self.starts = numbers, by_word, starts

    def of(self, first: int, last: int) -> np.ndarray:
        h = self.by_word[self.numbers[self.starts + first]]
        for i in range(first + 1, last + 1):
            h = _joined(h, self.by_word[self.numbers[self.starts + i]])
        return h

    def keep(self, mask: np.ndarray) -> None:
        self.starts = self.starts[mask]


def _sieve(phrases: DataFrame):
    """Broadcast bit set of the hashes of (lang, phrase), of a fixed size; None if there is no phrase."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made = np.zeros(b.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                h = [np.uint64(xxhash.xxh64_intdigest(w, _seed(lang))) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")]
                made[i] = h[0]
                for w in h[1:]:
                    made[i : i + 1] = _joined(made[i : i + 1], np.array([w]))
            yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64))], ["h"])

    return _hash_sieve(phrases.select("lang", "phrase").mapInArrow(bits, "h long"))


def _hash_sieve(hashes: DataFrame):
    """Broadcast bit set of a column h of hashes; the driver takes at most 2^SIEVE_BITS / 32 numbers, whatever the rows."""
    bit = F.shiftrightunsigned("h", 64 - SIEVE_BITS)
    cells = hashes.groupBy(F.shiftright(bit, 5).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - SIEVE_BITS}) & 31 as int))")).alias("bits"))
    table = cells.toArrow()
    sieve = np.zeros(1 << (SIEVE_BITS - 5), np.uint32)
    sieve[table["cell"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    return hashes.sparkSession.sparkContext.broadcast(sieve.view(np.uint8) if table.num_rows else None)


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, first): the lowest-scoring cut of every phrase all of whose parts are counted; first is the first word's count."""
    words = F.split("phrase", " ", -1)
    parts = phrases.select("lang", "phrase", F.col("f").alias("a"), words.alias("_w")).select("*", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("k"))
    parts = parts.select("lang", "phrase", "a", "k", (F.size("_w") - 1).alias("cuts"), F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("_left"), F.array_join(F.slice("_w", F.col("k") + 1, F.size("_w")), " ").alias("_right"))
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    cut = parts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    score = F.expr(f"cast({SCALE} * cast(a as decimal(20,0)) as decimal(30,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("b")
    out = cut.groupBy("lang", "phrase", "a", "cuts").agg(best, F.count("*").alias("found"), F.max(F.when(F.col("k") == 1, F.col("l"))).alias("first")).where("found = cuts")
    return out.select("lang", "phrase", "a", "b.l", "b.r", "b.score", "first")


def _bound() -> F.Column:
    """No phrase that starts with this one and is longer scores more."""
    return F.expr(f"cast({SCALE} * cast(a as decimal(20,0)) as decimal(30,0)) div (cast(first as decimal(20,0)) + cast(a as decimal(20,0)))").cast("long")


def _not_inside(scored: DataFrame, longer: DataFrame) -> DataFrame:
    """Candidates that are not dropped. A longer candidate that holds one is no more frequent than one that is a word longer and holds it, so those alone decide."""
    w = F.split("phrase", " ", -1)
    inner = F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))
    holds = longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_held"))
    joined = scored.join(holds, ["lang", "phrase"], "left")
    return joined.where(F.expr("_held is null or 100 * cast(_held as decimal(20,0)) < 80 * cast(a as decimal(20,0))")).drop("_held")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` surviving phrases of two to four words that occur `least` times, by score, count and phrase (UTF-8 bytes).

    Texts are lower-cased in A-Z, cut at .,;:!? and line breaks, then at spaces and tabs. score is floor(SCALE * a / (l + r)) at the cut that scores lowest (ties: the first), exact at any size.
    A phrase that stands inside a longer one with 0.8 of its count is dropped. Null and empty texts have no words; a null lang counts as "und". Ties in score and count are put in order by the
    phrase, of which there is one row a language. Repeated rows count as often as they stand. A table without a phrase that is frequent enough gives an empty result; columns other
    than text and lang are left out, whatever their names. Very long texts are cut into words in slices.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text"))
    counted = "lang string, phrase string, f long"
    words = stored(_counted(texts, counted, _word_rows).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    totals, one = words.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n")), words.where(F.col("phrase").isNotNull())
    often = _sieve(one)
    pairs = _counted(texts, "h long, f long", _hash_rows(often)).groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    likely = _hash_sieve(pairs)

    def likely_pairs(h: _Hashes) -> np.ndarray:
        for i in (0, 1):
            h.keep(_passes(often.value, h.of(i, i)))
        h.keep(_passes(likely.value, h.of(0, 1)))
        return h.starts

    two = stored(_frequent(_counted(texts, counted, _phrase_rows(2, likely_pairs)), least), "pairs")
    frequent_two = _sieve(two)
    scored_two = stored(_scored(two, one), "scored").withColumn("bound", _bound())

    level, done = int(top * FIRST_LEVEL), None
    unsettled = scored_two.select("lang").distinct()
    while True:
        levels = scored_two.join(unsettled, "lang", "left_semi").withColumn("_no", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))).where(F.col("_no") <= level)
        levels = stored(levels.groupBy("lang").agg(F.when(F.max("_no") < level, 0).otherwise(F.min("score")).cast("long").alias("level")), "levels")
        found = stored(_survivors(texts, levels, one, two, scored_two, frequent_two, least), "survivors")
        counts = found.groupBy("lang").count()
        settled = stored(levels.join(counts, "lang", "left").where((F.col("level") == 0) | (F.col("count") >= top)).select("lang"), "settled")
        new = found.join(settled, "lang", "left_semi")
        done = new if done is None else done.unionByName(new)
        unsettled = stored(levels.select("lang").join(settled, "lang", "left_anti"), "unsettled")
        if not unsettled.limit(1).count():
            break
        level *= 2
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = done.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _survivors(texts: DataFrame, levels: DataFrame, one: DataFrame, two: DataFrame, scored_two: DataFrame, frequent_two, least: int) -> DataFrame:
    """All surviving candidates that score their language's level or more. Prefixes whose bound reaches it are expanded; so is what may hold such a candidate."""
    at_level = lambda df: df.join(levels, "lang")
    texts, counted = texts.join(levels.select("lang"), "lang", "left_semi"), "lang string, phrase string, f long"
    open_two, good_two = at_level(scored_two).where("bound >= level"), at_level(scored_two).where("score >= level")
    grow_two, hold_two = _sieve(open_two), _sieve(good_two)

    def triples(h: _Hashes) -> np.ndarray:
        for i in (0, 1):
            h.keep(_passes(frequent_two.value, h.of(i, i + 1)))
        h.keep(_passes(grow_two.value, h.of(0, 1)) | _passes(hold_two.value, h.of(1, 2)))
        return h.starts

    three = stored(_frequent(_counted(texts, counted, _phrase_rows(3, triples)), least), "triples")
    scored_three = stored(_scored(three, one.unionByName(two)), "scored").withColumn("bound", _bound())
    open_three, good_three = at_level(scored_three).where("bound >= level"), at_level(scored_three).where("score >= level")
    grow_three, hold_three = _sieve(open_three), _sieve(good_three)
    # the last three words of a grown triple's extension need a count too: they start with the triple's last two
    rest = _sieve(open_three.select("lang", F.concat_ws(" ", F.slice(F.split("phrase", " ", -1), F.lit(2), F.lit(2))).alias("phrase")).distinct())

    def rests(h: _Hashes) -> np.ndarray:
        for i in (0, 1):
            h.keep(_passes(frequent_two.value, h.of(i, i + 1)))
        h.keep(_passes(rest.value, h.of(0, 1)) & ~(_passes(grow_two.value, h.of(0, 1)) | _passes(hold_two.value, h.of(1, 2))))
        return h.starts

    def fours(h: _Hashes) -> np.ndarray:
        for i in (0, 1, 2):
            h.keep(_passes(frequent_two.value, h.of(i, i + 1)))
        h.keep(_passes(grow_three.value, h.of(0, 2)) | _passes(hold_three.value, h.of(1, 3)))
        return h.starts

    def both(buffer: _Buffer, numbers: np.ndarray, already: int) -> Iterator[pa.RecordBatch]:
        yield from _phrase_rows(3, rests)(buffer, numbers, already)
        yield from _phrase_rows(4, fours)(buffer, numbers, already)

    last = stored(_frequent(_counted(texts, counted, both), least), "fours")
    is_four = F.size(F.split("phrase", " ", -1)) == LONGEST
    four, more_three = last.where(is_four), last.where(~is_four)
    counts = one.unionByName(two).unionByName(three).unionByName(more_three)
    scored_four = _scored(four, counts)
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    short = scored_two.select(columns).unionByName(scored_three.select(columns))
    longer = three.unionByName(more_three).unionByName(four)
    kept = _not_inside(at_level(short).where("score >= level").select(columns), longer)
    return kept.unionByName(at_level(scored_four).where("score >= level").select(columns))
