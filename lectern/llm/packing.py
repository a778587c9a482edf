"""Best-fit packing by swap-based local search (operator 8).

Texts are tokenised and cut into pieces once.  Pieces are dealt into groups by a hash of
their key and filled into bins as they come.  Local search then does the packing: the
emptiest bin gives its pieces away; a piece moves to the fullest bin that holds it, or is
exchanged for one piece or for two of another underfull bin, where that raises the sum of
squared fills, until bins are empty.  The bins that a group could not fill go on, piece by
piece, to fewer and fewer groups.
"""

from __future__ import annotations

import functools
import re
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable, map_arrow

LENGTH = 2048
END_ID = 0
#: Pieces in a group, about.
GROUP = 6000
#: Of a group's bins, one in so many (the emptiest underfull ones) goes on to the next round,
#: where there are a PASS_ON-th of the groups; of small groups at least PASS_LEAST bins.
PASS_ON, PASS_LEAST = 4, 30
#: Characters of which both libraries are known to think alike; a text with any other goes
#: to the tokenizer's own library.  So does one with a long run of white space, over which
#: the faster library's pattern steps back once for each character.
_BLANKS = re.compile(r"\s{500}")
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027\\u20ac]")
#: How byte-level BPE cuts a text before merging (a fixed value of this kind of tokenizer).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary is the tokenizer file's.  Where its merges come in the order of its ids,
    plain texts are merged by a faster library with the same vocabulary and the same result.
    """

    def __init__(self, path: str):
        import json

        from lectern.llm.token_counts import byte_letters, load

        self.tok, self.fast = load(path), None
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        spec = json.loads(self.tok.to_str())
        vocab, merges, letters = spec["model"]["vocab"], spec["model"]["merges"], {c: b for b, c in byte_letters().items()}
        merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in merges]
        in_order = merged == list(range(len(vocab) - len(merges), len(vocab)))
        if in_order and spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("fast", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def text(self, text: str) -> bytes:
        if self.fast is None or _PLAIN.search(text) or _BLANKS.search(text) or any(s in text for s in self.special):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        return np.array(ids, "<u4").tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def cut(total: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but, maybe, the first."""
    first = total % length or length
    return [(0, min(first, total))] + [(s, length) for s in range(first, total, length)]


def pieces(documents: DataFrame, path: str, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; null texts are empty ones."""
    kind = documents.schema[key].dataType.simpleString()

    def make():
        enc = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()

        def one(batch):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.text(text or "") + end
                for i, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    rows.append((doc, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows)))

        return one

    return map_arrow(documents.select(key, "text"), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", make)


def next_fit(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Bins of positions as they come: where a piece does not fit, a new bin begins."""
    bins, room = [], 0
    for i, n in enumerate(sizes):
        if n > room:
            bins.append([])
            room = length
        bins[-1].append(i)
        room -= n
    return bins


class Receivers:
    """Underfull bins by the room they have, so that a piece's place is looked up by bits:
    bit s of `ones[r]` (`twos[r]`) is set where a bin of room r has a piece (two pieces) of size s."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.bins: dict[int, dict[int, tuple[int, int]]] = {}
        self.ones: dict[int, int] = {}
        self.twos: dict[int, int] = {}
        self.rooms = 0

    def add(self, b: int, pieces: list[int], room: int) -> None:
        one = two = 0
        for i in pieces:
            two |= one << self.sizes[i]
            one |= 1 << self.sizes[i]
        self.bins.setdefault(room, {})[b] = one, two
        self.ones[room] = self.ones.get(room, 0) | one
        self.twos[room] = self.twos.get(room, 0) | two
        self.rooms |= 1 << room

    def remove(self, b: int, room: int) -> None:
        here = self.bins[room]
        del here[b]
        one = two = 0
        for x, y in here.values():
            one |= x
            two |= y
        self.ones[room], self.twos[room] = one, two
        if not here:
            self.rooms ^= 1 << room
            del self.bins[room], self.ones[room], self.twos[room]

    def roomy(self, n: int) -> int | None:
        """The fullest bin that holds a piece of size n."""
        found = self.rooms >> n
        return next(iter(self.bins[n + (found & -found).bit_length() - 1])) if found else None

    def swap(self, n: int, pairs: bool) -> tuple[int, int] | None:
        """(bin, size) of what a piece of size n can be exchanged for: a size under n that
        leaves room for it.  What leaves least room, and of equals what gives most away."""
        best, found = (1, 0), None
        for room, mask in (self.twos if pairs else self.ones).items():
            low = n - room  # at least this size has to go
            here = (mask >> low if low > 0 else mask << -low) & ((1 << room) - 1)
            if here:
                rest = (here & -here).bit_length() - 1
                if (-rest, room) > best or found is None:
                    best, found = (-rest, room), (room, low + rest)
        if found is None:
            return None
        room, size = found
        return next(b for b, masks in self.bins[room].items() if masks[pairs] >> size & 1), size


def _of_size(pieces: list[int], sizes: list[int], size: int, pairs: bool) -> tuple[int, ...]:
    """One piece of a size, or two of that size together."""
    if not pairs:
        return (next(i for i in pieces if sizes[i] == size),)
    seen: dict[int, int] = {}
    for i in pieces:
        if size - sizes[i] in seen:
            return seen[size - sizes[i]], i
        seen[sizes[i]] = i
    raise AssertionError("no such pair")


def improve(bins: list[list[int]], sizes: list[int], length: int = LENGTH, counts: dict | None = None) -> list[list[int]]:
    """Empty the emptiest underfull bins into the others, while there are more than the
    pieces need; counts: of the moves and exchanges made.

    Receivers are at least as full as the giver, so every move and every exchange of a
    piece for something smaller raises the sum of squared fills, and the giver's fill
    falls: a giver is done after at most `length` of them.  A giver that can give nothing
    stays as a receiver of the others.
    """
    counts = {} if counts is None else counts
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    left, least = len(bins), -(-sum(fill) // length)
    others = Receivers(sizes)
    under = [b for b in range(len(bins)) if fill[b] < length]
    for b in under:
        others.add(b, bins[b], length - fill[b])

    def give(giver: int, own: tuple[int, ...], b: int, out: tuple[int, ...]) -> None:
        others.remove(b, length - fill[b])
        bins[giver] = [j for j in bins[giver] if j not in own] + [*out]
        bins[b] = [j for j in bins[b] if j not in out] + [*own]
        step = sum(sizes[j] for j in own) - sum(sizes[j] for j in out)
        fill[giver] -= step
        fill[b] += step
        if fill[b] < length:
            others.add(b, bins[b], length - fill[b])
        kind = "moved" if not out else ("one for one", "two for one", "two for two")[len(own) + len(out) - 2]
        counts[kind] = counts.get(kind, 0) + 1

    def exchange(giver: int) -> bool:
        ones = [(i,) for i in sorted(bins[giver], key=lambda i: -sizes[i])]
        pairs = [(i, j) for i, j in combinations(bins[giver], 2) if sizes[i] + sizes[j] <= length]
        for mine, two in ((ones, False), (ones, True), (pairs, False), (pairs, True)):
            tried = set()
            for own in mine:
                n = sum(sizes[i] for i in own)
                if n in tried:
                    continue
                tried.add(n)
                got = others.swap(n, two)
                if got and fill[got[0]] + n - got[1] > fill[giver]:
                    give(giver, own, got[0], _of_size(bins[got[0]], sizes, got[1], two))
                    return True
        return False

    def empty(giver: int) -> bool:
        others.remove(giver, length - fill[giver])
        moved = True
        while bins[giver] and moved:
            moved = False
            for i in sorted(bins[giver], key=lambda i: -sizes[i]):
                if (b := others.roomy(sizes[i])) is not None and fill[b] >= fill[giver]:
                    give(giver, (i,), b, ())
                    moved = True
            moved = moved or exchange(giver)
        if bins[giver]:
            others.add(giver, bins[giver], length - fill[giver])
        return not bins[giver]

    before = None
    while before != counts and left > least:  # what one giver could not give may fit after another's exchanges
        before = dict(counts)
        for giver in sorted((b for b in under if bins[b] and fill[b] < length), key=lambda b: fill[b]):
            if fill[giver] < length and empty(giver):  # a bin that received may be full by now
                left -= 1
                if left <= least:
                    break
    return [b for b in bins if b]


def _pack_groups(rows: DataFrame, length: int, last: bool) -> DataFrame:
    """Rows dealt by g: one row per piece with its bin (named by the bin's first row), its
    offset and whether the bin goes on."""

    def pack(pdf):
        pdf = pdf.sort_values("row", ignore_index=True)
        sizes = pdf["length"].tolist()
        bins = improve(next_fit(sizes, length), sizes, length)
        fills = [sum(sizes[i] for i in b) for b in bins]
        under = sorted((x for x in range(len(bins)) if fills[x] < length), key=lambda x: fills[x])
        on = set() if last else set(under[: max(PASS_LEAST, -(-len(bins) // PASS_ON))])
        number, offset, more, row = [0] * len(sizes), [0] * len(sizes), [False] * len(sizes), pdf["row"].tolist()
        for x, b in enumerate(bins):
            at = 0
            for i in b:
                number[i], offset[i], more[i] = row[b[0]], at, x in on
                at += sizes[i]
        return pdf.assign(sequence_id=number, offset=offset, more=more)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", sequence_id long, offset long, more boolean"
    return rows.groupBy("g").applyInPandas(pack, schema)


def pack(documents: DataFrame, path: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Every row is packed: null and empty texts give the end id alone, repeated rows and
    repeated or null keys are rows of their own, and texts longer than a sequence are cut.
    An empty table gives none.  Other columns are not read.
    """
    made = durable(pieces(documents, path, length).withColumn("row", F.monotonically_increasing_id()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = made.filter(F.col("length") == length).select(*names, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.filter(F.col("length") < length).select(*names, "row")
    n = rest.count()
    groups = max(1, -(-n // group))
    packed, level = [whole], 0
    while True:
        dealt = rest.select("*", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).alias("g"))
        done = durable(_pack_groups(dealt, length, groups == 1))
        packed.append(done.filter("not more").select(*names, "sequence_id", "offset"))
        if groups == 1:
            out = packed[0]
            for x in packed[1:]:
                out = out.union(x)
            return out
        rest = done.filter("more").select(*names, "row")
        groups, level = -(-groups // PASS_ON), level + 1
