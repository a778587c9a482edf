"""Benchmark decontamination by a broadcast set of normalised windows (operator 5)."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow
from lectern.session import run_arrow

WINDOW = 13
#: Benchmark text in one broadcast, in bytes; a larger benchmark is searched block by block.
BLOCK_BYTES = 16_000_000
#: Everything in ASCII but letters and digits becomes a space and A-Z become a-z.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The windows of a block of items: word numbers, hashes by length, and the items of each window."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], list] = defaultdict(list)
        for item, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                self.owners[tuple(own[i : i + size])].append(item)
        self.owners = {k: sorted(set(v), key=str) for k, v in self.owners.items()}
        self.by_size = {
            n: np.unique(self.hashes(np.array([k for k in self.owners if len(k) == n], np.uint64)))
            for n in sorted({len(k) for k in self.owners})
        }

    @staticmethod
    def hashes(windows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(windows), np.uint64)
        for col in windows.T:
            h = h * np.uint64(0x9E3779B97F4A7C15) + col
        return h

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items that own the windows that occur."""
        get = self.ids.get
        own = np.array([get(w, 0) for w in words], np.uint64)
        hit, items = np.zeros(len(own), bool), set()
        for n, known in self.by_size.items():
            if len(own) < n:
                break
            # a window needs n known words in a row
            runs = np.concatenate([[0], np.cumsum(own == 0)])
            starts = np.flatnonzero(runs[n:] == runs[:-n])
            if not len(starts):
                continue
            windows = np.stack([own[starts + i] for i in range(n)], 1)
            h = self.hashes(windows)
            at = np.searchsorted(known, h)
            for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h):
                if owners := self.owners.get(tuple(windows[i].tolist())):  # the words themselves decide
                    items.update(owners)
                    hit[starts[i] : starts[i] + n] = True
        return hit, items


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """The benchmark in blocks of about `most` bytes, each collected alone."""
    rows = benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // most) or 1
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def _each(shared: list):
    """The broadcast blocks in turn; of several, a worker holds one at a time."""
    for w in shared:
        yield w.value
        if len(shared) > 1 and hasattr(w, "_value"):
            del w._value


def _search(shared: list, texts: list) -> list[tuple[np.ndarray, set]]:
    """Hit words and items of each text over all blocks."""
    out = [(np.zeros(len(words_of(t)), bool), set()) for t in texts]
    for w in _each(shared):
        for (hit, items), t in zip(out, texts):
            h, found = w.find(words_of(t))
            hit |= h
            items |= found
    return out


def _spans(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of hit words, alternating."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row.

    spans: word positions, start and end in turn, that benchmark windows cover.  Null and
    empty texts have no words and are not contaminated; an empty benchmark hits nothing;
    null items are no windows' owners.  An item that repeats counts once.  Rows that repeat
    are judged each.  One block (the usual case) needs no shuffle.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    sc = documents.sparkSession.sparkContext

    def row(doc, n, hit_spans, items):
        n_hit = sum(hit_spans[1::2]) - sum(hit_spans[::2])
        names = ",".join(sorted(map(str, items)))
        return doc, n, n_hit, len(items), hashlib.sha256(names.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n, hit_spans

    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>"
    shared = [sc.broadcast(Windows([(i, t) for i, t in b if i is not None], window)) for b in blocks(benchmark, block_bytes)]

    def make():
        def one(batch):
            found = _search(shared, batch.column(1).to_pylist())
            return dict(zip(names, zip(*(row(doc, len(hit), _spans(hit), items) for doc, (hit, items) in zip(batch.column(0).to_pylist(), found)))))

        return one

    return map_arrow(documents.select("doc_id", "text"), schema, make)


def remove(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Drop contaminated documents; cut the hit words out of the others; keep all columns.

    Text without a hit is unchanged to the byte.  n_chars, where there is such a column,
    follows a text that was cut.
    """
    import re

    from pyspark.sql.pandas.types import to_arrow_schema

    sc = documents.sparkSession.sparkContext
    shared = [sc.broadcast(Windows([(i, t) for i, t in b if i is not None], window)) for b in blocks(benchmark)]
    names, arrow = documents.columns, to_arrow_schema(documents.schema)
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def clean(text, hit):
        """The text without hit words, or None for a contaminated one."""
        n = int(hit.sum())
        if not n:
            return text
        if 20 * n >= len(hit):
            return None
        raw = text.encode()
        places = [m.span() for m in word.finditer(raw.lower())]
        out, at, spans = [], 0, _spans(hit)
        for a, b in zip(spans[::2], spans[1::2]):
            out.append(raw[at : places[a][0]])
            at = places[b - 1][1]
        return b"".join([*out, raw[at:]]).decode()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            before = batch.column(names.index("text")).to_pylist()
            after = [clean(t, hit) for t, (hit, _) in zip(before, _search(shared, before))]
            keep = [a is not None or b is None for a, b in zip(after, before)]
            columns = {n: c for n, c in zip(names, batch.columns)}
            columns["text"] = pa.array(after, arrow.field("text").type)
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(a) if a is not None and a != b else n for a, b, n in zip(after, before, old)], arrow.field("n_chars").type)
            whole = pa.RecordBatch.from_arrays([columns[n].cast(f.type) for n, f in zip(names, arrow)], schema=arrow)
            yield whole.filter(pa.array(keep, pa.bool_()))

    return run_arrow(documents, run, documents.schema)
