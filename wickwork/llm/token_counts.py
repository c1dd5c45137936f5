"""Exact token counts at every prefix of a text, by prefix dynamic programming.

For a byte-pair encoder the encoding of a prefix is fixed by its last token: token t may end a prefix
iff the prefix before it ends in a token u and the encoder leaves the pair (u, t) unmerged. One pass
over a word therefore gives the last token, and with it the exact count, of each of its prefixes.
Counts are kept as one signed byte a character, the change of the count; their running sum answers
how many tokens a prefix has and where a text must be cut for a token budget, without encoding again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the table of words already solved; it is emptied when full, which bounds a worker's memory.
MEMO_WORDS = 1_000_000
#: Entries of the table of words whose tokens are only added up; workers keep it between tasks, beside what other stages have left.
TOTAL_WORDS = 200_000
#: Characters for which the quick pattern below cuts as the exact one does.
_ODD = re.compile("[^\x00-\x1b\x20-\x7e¡-©«-±´¶-¸»¿-ſ‐-‧€]")
_QUICK = re.compile(r"\s*(?:(?<! )'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d+|(?:[^\s\w]|_)+)|\s+")


def _exact_patterns():
    import regex

    return regex.compile(r"\p{White_Space}*(?:(?<! )'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}+|[^\p{White_Space}\p{L}\p{N}]+)|\p{White_Space}+"), regex.compile(r"^\p{White_Space}+")


class Rules:
    """What both counters need of a tokenizer's file: its model, the letters of bytes, how texts are cut, and added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: prefix counts are for byte-level BPE files without normaliser or added spaces")
        self.model = Tokenizer.from_file(path).model
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.exact, self.leading = _exact_patterns()
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split


class PrefixCounter(Rules, dict):
    """word piece -> bytes of count changes, one a character, solved on first use."""

    def __init__(self, path: str):
        super().__init__(path)
        from ahocorasick import Automaton

        back = {c: b for b, c in self.letters.items()}
        self.tokens: dict[bytes, str] = {}
        for t in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
            if all(c in back for c in t):
                self.tokens[bytes(back[c] for c in t)] = t
        self.number = {t: k for k, t in enumerate(self.tokens.values())}
        self.texts = list(self.number)
        self.pairs: dict[int, bool] = {}
        self.found = Automaton()
        for t, k in self.number.items():
            self.found.add_word(t, (k, len(t)))
        self.found.make_automaton()

    def stays(self, u: int, t: int) -> bool:
        """Whether the encoder leaves tokens u and t apart."""
        both = self.texts[u] + self.texts[t]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        apart = both not in self.number and [x.value for x in self.model.tokenize(both)] == [self.texts[u], self.texts[t]]
        self.pairs[u << 20 | t] = apart
        return apart

    def by_byte(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of a piece that the encoder takes as a whole."""
        last, counts = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        pairs = self.pairs
        for i, (t, n) in self.found.iter(piece.decode("latin-1").translate(self.letters)):
            if last[i + 1] >= 0:
                continue
            at = i + 1 - n
            u = last[at]
            if at:
                apart = pairs.get(u << 20 | t)
                if apart is None:
                    apart = self.stays(u, t)
                if not apart:
                    continue
            last[i + 1], counts[i + 1] = t, counts[at] + 1
        if -1 in last[1:]:
            raise AssertionError("a prefix without an encoding")
        return counts

    def by_char(self, piece: str) -> list[int]:
        """Counts of the prefixes that end with a character, without the empty one."""
        counts = self.by_byte(piece.encode())
        if len(counts) == len(piece) + 1:
            return counts[1:]
        at, out = 0, []
        for c in piece:
            at += len(c.encode())
            out.append(counts[at])
        return out

    def __missing__(self, chunk: str) -> bytes:
        word = self.leading.sub("", chunk)
        space = chunk[: len(chunk) - len(word)]
        counts = self.by_char(space) if space else []
        if word:
            before, lead = 0, ""
            if space:
                if space[-1] == " ":
                    before, lead = (counts[-2] if len(space) > 1 else 0), " "
                else:
                    before = (self.by_char(space[:-1])[-1] if len(space) > 1 else 0) + self.by_char(space[-1])[-1]
            tail = self.by_char(lead + word)[len(lead) :]
            if not lead and len(word) > 2 and word[0] == "'" and word[1:] in ("re", "ve", "ll"):
                tail[1] = self.by_char("'")[-1] + self.by_char(word[1])[-1]  # not yet a contraction
            counts = counts + [before + x for x in tail]
        changes = [b - a for a, b in zip([0, *counts], counts)]
        if min(changes) < -128 or max(changes) > 127:
            raise OverflowError("a count changes by more than a signed byte at one character")
        if len(self) >= MEMO_WORDS:
            self.clear()
        out = self[chunk] = bytes([x & 255 for x in changes])
        return out

    def plain(self, text: str) -> bytes:
        pieces = (self.exact if _ODD.search(text) else _QUICK).findall(text)
        return b"".join(map(self.__getitem__, pieces))

    def changes(self, text: str) -> bytes:
        """The count's change at each character; the running sum is the exact count of each prefix.

        An added token's string is one token once it is complete; until then it is ordinary text.
        """
        if not any(x in text for x in self.added):
            return self.plain(text)
        out = []
        for part in self.split_added(text):
            if part not in self.added:
                head = part
                continue
            open_end = self.plain(head + part[:-1])
            out.append(open_end)
            change = 1 - int(np.frombuffer(open_end, np.int8)[len(head) :].sum(dtype=np.int64))
            out.append(np.int8(change).tobytes())
            head = ""
        return b"".join(out) + self.plain(head)


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


class TotalCounter(dict):
    """word piece -> its tokens, encoded on first use: for whole texts whose prefixes do not matter.

    It holds at most TOTAL_WORDS pieces; when it is full, those met since the last time stay, so frequent pieces are not encoded again.
    """

    def __init__(self, path: str):
        super().__init__()
        self.rules, self.old = Rules(path), {}

    def __missing__(self, chunk: str) -> int:
        rules, total = self.rules, self.old.get(chunk)
        if len(self) >= TOTAL_WORDS // 2:
            self.old = dict(self)
            self.clear()
        if total is not None:
            self[chunk] = total
            return total
        word = rules.leading.sub("", chunk)
        space = chunk[: len(chunk) - len(word)]
        if space and word:  # the last blank goes with the word, other white space stands alone
            parts = (space[:-1], " " + word) if space[-1] == " " else (space[:-1], space[-1], word)
        else:
            parts = (chunk,)
        total = sum(len(rules.model.tokenize(x.encode().decode("latin-1").translate(rules.letters))) for x in parts if x)
        self[chunk] = total
        return total

    def plain(self, text: str) -> int:
        pieces = (self.rules.exact if _ODD.search(text) else _QUICK).findall(text)
        return sum(map(self.__getitem__, pieces))

    def total(self, text: str) -> int:
        if not any(x in text for x in self.rules.added):
            return self.plain(text)
        return sum(1 if part in self.rules.added else self.plain(part) for part in self.rules.split_added(text))


@lru_cache(maxsize=2)
def total_counter(path: str) -> TotalCounter:
    return TotalCounter(path)


def count_at(changes: bytes, chars: int) -> int:
    """Tokens of the first `chars` characters."""
    return int(np.frombuffer(changes, np.int8)[:chars].sum(dtype=np.int64))


def cut_for_budget(changes: bytes, budget: int) -> int:
    """The longest prefix, in characters, that has at most `budget` tokens."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_tokens(docs: DataFrame, tokenizer: str, budget: int = 1024, keep_table: bool = True, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit, cut (characters that fit the budget) and prefix_changes to each row.

    tokenizer: path of a byte-level BPE file of the tokenizers library. Whole texts are counted; a null text counts
    as empty, with no tokens. Rows are handled one by one: ties, repeated rows and an empty table need no
    care. Input columns with the added names are replaced; other columns are carried unchanged. With
    keep_table the table of all prefixes is returned (one byte a character), else only the answers read from it.
    """
    added = ["n_bytes", "n_tokens", "over_limit", "cut", *["prefix_changes"] * keep_table]
    base = docs.drop("n_bytes", "n_tokens", "over_limit", "cut", "prefix_changes")
    kinds = "n_tokens long, cut long, prefix_changes binary" if keep_table else "n_tokens long, cut long"

    @F.pandas_udf(kinds)
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = prefix_counter(tokenizer)
        for texts in batches:
            n, cut, tables = [], [], []
            for x in texts:
                table = counter.changes(x) if x else b""
                total = int(np.frombuffer(table, np.int8).sum(dtype=np.int64))
                n.append(total)
                cut.append(len(table) if total <= budget and len(table) <= budget else cut_for_budget(table, budget))
                if keep_table:
                    tables.append(table)
            out = pd.DataFrame({"n_tokens": n, "cut": cut})
            if keep_table:
                out["prefix_changes"] = tables
            yield out

    solved = base.withColumn("_s", solve(F.col(text))).withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    return solved.withColumns({k: F.col(f"_s.{k}") for k in ("n_tokens", "cut", *["prefix_changes"] * keep_table)} | {"over_limit": F.col("_s.n_tokens") > budget}).select(*base.columns, *added)


def token_totals(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Adds n_tokens alone, equal to that of prefix_tokens, for half of its work where many words are new.

    Whole texts are counted; a null text has no tokens. A column n_tokens is replaced, other columns are carried unchanged; repeated rows and empty tables need no care.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = total_counter(tokenizer)
        for texts in batches:
            yield pd.Series([counter.total(x) if x else 0 for x in texts], dtype="int64")

    return docs.withColumn("n_tokens", count(F.col(text)))
