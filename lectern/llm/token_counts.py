"""Exact token counts of every prefix by dynamic programming (operator 7).

The tokenizer drops white space and never merges across it, so a text's prefix table is
made of its words' tables.  Inside a word a table is filled from left to right: a byte-pair
encoding ends in exactly one token that its own merges leave apart from the last token of
what stands before it, so the count of a prefix is one more than the count before that
token.  The whole table is stored; truncation and budget questions are read from it, and
no text or prefix is encoded again.
"""

from __future__ import annotations

import bisect
import functools
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from lectern.llm.common import map_arrow

#: Words whose tables a worker remembers, in two generations of so many each.
WORDS = 300_000
LIMIT = 2048
#: White space of the tokenizer's pattern; str.split() knows four controls more.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")
#: Characters that lower-case one for one and are in normal form, and the tokenizer's pattern
#: over them; words with others are cut by the tokenizer's own library.
SIMPLE = re.compile("[!-~À-ÖØ-öø-į]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-į]+|[0-9]|[^a-zß-öø-į0-9]+")
END = "</w>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for
    themselves, the others from code point 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class Pairs:
    """Which tokens may stand side by side.

    While two neighbours are merged up from their symbols, the inner edge of each is one
    after another of the tokens on that edge of its merge tree.  They stay apart if no
    merge joins two edges that are there at the same time.
    """

    NEVER = 1 << 60

    def __init__(self, merges: list, most: int = 3_000_000):
        made = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {m: i for i, m in enumerate(made)}
        self.tree = {a + b: (a, b, i) for i, (a, b) in enumerate(made)}
        self.known: dict[int, bool] = {}
        self.most = most
        self.edges: tuple[dict, dict] = ({}, {})

    def edge(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """(token, rank it was made at, rank it was used up at) along one edge."""
        got = self.edges[side].get(token)
        if got is None:
            got, used, at = [], self.NEVER, token
            while at in self.tree:
                parts = self.tree[at]
                got.append((at, parts[2], used))
                used, at = parts[2], parts[side]
            got.append((at, -1, used))
            self.edges[side][token] = got
        return got

    def fit(self, key: int, before: str, token: str) -> bool:
        """Whether `token` may follow `before`; key: a number of the two."""
        known = self.known.get(key)
        if known is None:
            known, rank = True, self.rank
            for x, made_x, used_x in self.edge(before, 1):
                for y, made_y, used_y in self.edge(token, 0):
                    r = rank.get((x, y))
                    # of equal merges the leftmost comes first
                    if r is not None and made_x <= r < used_x and made_y <= r <= used_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = known
        return known


class WordTables:
    """Prefix tables of white-space words, remembered in two generations of `most` words."""

    def __init__(self, path: str, most: int = WORDS):
        self.tok, self.most = load(path), most
        self.known: dict[str, bytes | tuple] = {}
        self.older: dict[str, bytes | tuple] = {}
        spec = json.loads(self.tok.to_str())
        vocab = spec["model"]["vocab"]
        self.pairs = Pairs(spec["model"]["merges"])
        # every token at its place: (length, number, as an inner token, as a final one)
        import ahocorasick

        self.found = ahocorasick.Automaton()
        names = {t.removesuffix(END) if t != END else t for t in vocab}
        for n, t in enumerate(sorted(names), 1):
            self.found.add_word(t, (len(t), n, t if t in vocab else None, t + END if t + END in vocab else None))
        self.found.make_automaton()
        self.pieces: dict[str, list[int]] = {}
        self.letters = byte_letters()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)")

    def piece(self, text: str) -> list[int]:
        """Token counts of text[:1], text[:2], ... of one piece in its normal form."""
        got = self.pieces.get(text)
        if got is None:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            got = self.pieces[text] = self._piece(text)
        return list(got)

    def _piece(self, text: str) -> list[int]:
        raw = text.encode()
        s = "".join(map(self.letters.__getitem__, raw))
        ends = range(1, len(s) + 1) if len(raw) == len(text) else np.cumsum([len(c.encode()) for c in text]).tolist()
        ends = set(ends)
        fit, known = self.pairs.fit, self.pairs.known
        # the last token of each prefix that goes on, its number, and the prefix's tokens
        last, number, count, out = [""] * (len(s) + 1), [0] * (len(s) + 1), [0] * (len(s) + 1), []
        inside = whole = 0  # prefixes settled so far
        for end, (size, n, inner, final) in self.found.iter(s):
            i, j = end + 1, end + 1 - size
            if inner is not None and inside < i:
                key = number[j] << 32 | n
                if not j or (known.get(key) or key not in known and fit(key, last[j], inner)):
                    last[i], number[i], count[i], inside = inner, n, count[j] + 1, i
            if final is not None and whole < i and i in ends:
                key = number[j] << 32 | n | 1 << 31
                if not j or (known.get(key) or key not in known and fit(key, last[j], final)):
                    out.append(count[j] + 1)
                    whole = i
        return out

    def normal(self, text: str) -> list[int]:
        """Counts of the prefixes of a text whose normal form has its characters one for one."""
        out, total = [], 0
        for part in PIECES.findall(text) if SIMPLE.fullmatch(text) else (text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)):
            own = self.piece(part)
            if part[0] == "'" and len(part) == 3 and part[1].isalpha():
                # a cut inside such an ending leaves its sign and a letter, each alone
                own[1] = own[0] + self.piece(part[1])[0]
            out += [total + n for n in own]
            total += own[-1]
        return out

    def plain(self, word: str) -> list[int]:
        """Counts of the prefixes of a word without special strings."""
        if SIMPLE.fullmatch(word):
            return self.normal(word.lower())
        normal = self.tok.normalizer.normalize_str
        whole = normal(word)
        if len(whole) == len(word) and all(normal(c) == d for c, d in zip(word, whole)):
            return self.normal(whole)
        # characters that join or part in the normal form: each prefix has a form of its own
        return [(self.normal(normal(word[:i])) or [0])[-1] for i in range(1, len(word) + 1)]

    def make(self, word: str) -> list[int]:
        out, total, at = [], 0, 0
        for m in self.special.finditer(word):
            before = self.plain(word[at : m.end() - 1])  # a special string cut short is plain text
            out += [total + n for n in before]
            total += before[m.start() - at - 1] if m.start() > at else 0
            total += 1
            out.append(total)
            at = m.end()
        return out + [total + n for n in self.plain(word[at:])] if at < len(word) else out

    def table(self, word: str) -> bytes | tuple:
        """Token counts of word[:1], word[:2], ..., word."""
        got = self.known.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                got = self.make(word)
                got = bytes(got) if max(got) < 256 else tuple(got)
            if len(self.known) >= self.most:
                self.older, self.known = self.known, {}
            self.known[word] = got
        return got

    def prefix_table(self, text: str) -> "PrefixCounts":
        return PrefixCounts(self, text)


@functools.cache
def word_tables(path: str) -> WordTables:
    """One for each worker process, so that its words are known to later tasks too."""
    return WordTables(path)


class PrefixCounts:
    """Token count of text[:i] for every i of one text: its words' tables, and the sums of
    their ends."""

    def __init__(self, words: WordTables, text: str):
        self.text = text
        own = SPACE.split(text) if ODD.search(text) else text.split()
        known = words.known
        try:
            self.tables = [known[w] for w in own if w]
        except KeyError:
            self.tables = [words.table(w) for w in own if w]
        self.total = [0]
        n = 0
        for t in self.tables:
            n += t[-1]
            self.total.append(n)

    @functools.cached_property
    def starts(self) -> list[int]:
        out, at = [], 0
        for m in SPACE.finditer(self.text):
            if m.start() > at:
                out.append(at)
            at = m.end()
        return out + [at] if at < len(self.text) else out

    def at(self, i: int) -> int:
        """Tokens of text[:i]."""
        k = bisect.bisect_left(self.starts, i) - 1  # the word that the cut is in or after
        if k < 0:
            return 0
        own = self.tables[k]
        return self.total[k] + own[min(i - self.starts[k], len(own)) - 1]

    def all(self) -> np.ndarray:
        """The count at every prefix, 0 to len(text)."""
        out = np.zeros(len(self.text) + 1, np.int64)
        for start, own, before in zip(self.starts, self.tables, self.total):
            end = start + len(own)
            out[start + 1 : end + 1] = np.array(list(own)) + before
            out[end + 1 :] = out[end]
        return out

    def longest(self, budget: int) -> int:
        """The largest i such that text[:i] has at most `budget` tokens."""
        k = bisect.bisect_right(self.total, budget) - 1  # whole words that fit
        if k >= len(self.tables):
            return len(self.text)
        left = budget - self.total[k]
        return self.starts[k] + max((i for i, n in enumerate(self.tables[k], 1) if n <= left), default=0)


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, read from its prefix table's end.

    A null text counts as empty: no bytes, no tokens.  Rows that repeat and null keys stay
    as they are; other columns are not read.  Texts of any length are counted whole.
    """
    kind = documents.schema[key].dataType.simpleString()

    def make():
        words = word_tables(path)

        def one(batch):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [words.prefix_table(t).total[-1] for t in texts]
            return {
                "doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens, "over_limit": [n > limit for n in tokens],
            }

        return one

    return map_arrow(documents.select(key, text), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", make)


def truncation_points(documents: DataFrame, path: str, budgets: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, budget, n_chars): the longest prefix of each text within each token budget,
    read from the prefix tables.  Null texts count as empty."""
    kind = documents.schema[key].dataType.simpleString()

    def make():
        words = word_tables(path)

        def one(batch):
            out = {"doc_id": [], "budget": [], "n_chars": []}
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = words.prefix_table(t or "")
                for budget in budgets:
                    for name, v in zip(out, (doc, budget, table.longest(budget))):
                        out[name].append(v)
            return out

        return one

    return map_arrow(documents.select(key, text), f"doc_id {kind}, budget long, n_chars long", make)
