"""SimHash near-duplicates by deletion variants (operator 3).

Two 64-bit fingerprints at 3 bits or fewer have, of their two 32-bit halves, one that
differs in at most one bit.  Each half is indexed under its 32 one-wildcard variants (the
half with one bit deleted), an equality shuffle brings equal variants together, and the
whole fingerprints are verified.  A variant shared by very many fingerprints is not
compared in one place: it is cut again by the variants of the other half's own halves, and
once more by theirs, which bounds a group by the bits that are left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable, map_arrow
from lectern.llm.components import connected_components
from lectern.session import run_arrow

BITS = 3
SHINGLE = 3
#: Fingerprints compared in one group; larger groups are cut further.
GROUP = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # both for ASCII alone, as asked for
    if not words:
        return 0
    n = len(words) - shingle + 1
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), 42)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 65536):  # a long text's bits are counted piece by piece
        h = np.array([xxh64_intdigest(whole[i:j], 42) for i, j in zip(starts[a : a + 65536], ends[a : a + 65536])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        def one(batch):
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "fp": np.array(fps, np.uint64).view(np.int64)}

        return one

    return map_arrow(documents.select("doc_id", "text"), f"doc_id {kind}, fp long", make)


def variants(fp: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the one-wildcard variants of the two halves of the `width` bits from
    `low` on.  A key holds the half without its deleted bit, the bit's number and the side."""
    half = width // 2
    rows, keys = [], []
    for side in (0, 1):
        seg = (fp >> np.uint64(low + side * half)) & np.uint64((1 << half) - 1)
        for i in range(half):
            rows.append(np.arange(len(fp)))
            keys.append((seg & ~np.uint64(1 << i)) | np.uint64((i << 33) | (side << 39)))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _allowed(x: np.ndarray, g1: int, k: int) -> np.ndarray:
    """Which differences x link in a group: k bits or fewer, and where the deleted bit is
    equal, only the group of bit 0 answers, so that a pair is found once a half."""
    near = np.bitwise_count(x) <= k
    bit = (g1 >> 33) & 63
    return near if not bit else near & ((x >> np.uint64(32 * ((g1 >> 39) & 1) + bit)) & np.uint64(1) != 0)


def _forest(fp: np.ndarray, g1: int, k: int) -> np.ndarray:
    """Pairs of positions that connect what is linked inside a group: a search over the
    members not yet reached, so that near copies give a forest and not all their pairs."""
    left = np.arange(1, len(fp))
    start, edges = [0], []
    while len(left):
        if not start:
            start, left = [int(left[0])], left[1:]
            continue
        i = start.pop()
        near = _allowed(fp[left] ^ fp[i], g1, k)
        if near.any():
            found = left[near].tolist()
            edges += [(i, j) for j in found]
            start += found
            left = left[~near]
    return np.array(edges, np.int64).reshape(-1, 2)


class _Groups:
    """Reads (g1, g2, fp) sorted by group and compares group by group; holds one group of
    at most `most` rows, and passes the rows of a larger one on."""

    def __init__(self, k: int, most: int):
        self.k, self.most = k, most
        self.rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        self.large = None

    def read(self, new: list[np.ndarray], last: bool = False):
        """(a, b) edges and the (g1, g2, fp) rows passed on."""
        g1, g2, fp = (np.concatenate(x) for x in zip(self.rest, new))
        edge = np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1
        cuts = np.concatenate([[0], edge, [len(g1)]]) if len(g1) else np.zeros(1, np.int64)
        stop = len(cuts) - 1 - (not last and len(g1) > 0)
        sizes = np.diff(cuts)[:stop]
        over = np.zeros(len(g1), bool)
        if self.large is not None and len(g1) and (g1[0], g2[0]) == self.large:
            over[: cuts[1]] = True
        pairs = cuts[:stop][sizes == 2]
        pairs = pairs[~over[pairs]]
        x, bit = fp[pairs] ^ fp[pairs + 1], (g1[pairs] >> 33) & 63
        at = (32 * ((g1[pairs] >> 39) & 1) + bit).astype(np.uint64)
        near = pairs[(np.bitwise_count(x) <= self.k) & ((bit == 0) | ((x >> at) & np.uint64(1) != 0))]
        a, b = [fp[near]], [fp[near + 1]]
        for s, n in zip(cuts[:stop][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if over[s] or n > self.most:
                over[s : s + n] = True
                continue
            e = _forest(fp[s : s + n], int(g1[s]), self.k)
            a.append(fp[s + e[:, 0]]), b.append(fp[s + e[:, 1]])
        self.large = None
        tail = slice(cuts[stop], len(g1))
        if len(g1) - cuts[stop] > self.most or (len(g1) > cuts[stop] and over[cuts[stop]]):
            over[tail] = True
            self.large = (g1[-1], g2[-1])
            tail = slice(len(g1), len(g1))
        self.rest = [g1[tail], g2[tail], fp[tail]]
        return np.concatenate(a), np.concatenate(b), g1[over], g2[over], fp[over]


def _compare(rows: DataFrame, k: int, most: int) -> DataFrame:
    """Rows (g1, g2, fp) to edges (a, b); rows of groups over `most` come back as
    (a = fp, b null, g1, g2)."""

    def run(batches):
        import pyarrow as pa

        groups, none = _Groups(k, most), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

        def out(a, b, g1, g2, fp):
            if len(a) + len(fp):
                pad = np.zeros(len(a), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([a, fp]).view(np.int64)),
                    pa.array(np.concatenate([b, fp]).view(np.int64), mask=np.arange(len(a) + len(fp)) >= len(a)),
                    pa.array(np.concatenate([pad, g1])), pa.array(np.concatenate([pad, g2])),
                ], names=["a", "b", "g1", "g2"])

        for batch in batches:
            yield from out(*groups.read([*(batch.column(i).to_numpy() for i in (0, 1)), batch.column(2).to_numpy().view(np.uint64)]))
        yield from out(*groups.read(none, last=True))

    dealt = rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "fp")
    return run_arrow(dealt, run, "a long, b long, g1 long, g2 long")


def _expand(rows: DataFrame, level: int) -> DataFrame:
    """The rows of one level: (g1, g2, fp).  Level 0 keys a half of the 64 bits; level 1
    adds a half of the other 32 bits, level 2 a half of the 16 bits that are then left."""

    def make():
        def one(batch):
            g1, g2, fp = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            if level == 0:
                r, key = variants(fp, 0, 64)
                return {"g1": key, "g2": np.zeros(len(r), np.int64), "fp": fp[r].view(np.int64)}
            # the bits still free follow from the sides chosen before, which the keys hold
            low = np.where((g1 >> 39) & 1 == 0, 32, 0)
            if level == 2:
                low = np.where((g2 >> 39) & 1 == 0, low + 16, low)
            out = [[], [], []]
            for base in np.unique(low).tolist():
                pick = np.flatnonzero(low == base)
                r, key = variants(fp[pick], base, 32 >> (level - 1))
                r = pick[r]
                # level 2 writes its 8 bits, wildcard and side beside those of level 1
                both = key if level == 1 else g2[r] | (key & 0xFF) << 16 | ((key >> 33) & 0x7F) << 40
                out[0].append(g1[r]), out[1].append(both), out[2].append(fp[r].view(np.int64))
            return dict(zip(("g1", "g2", "fp"), map(np.concatenate, out)))

        return one

    return map_arrow(rows, "g1 long, g2 long, fp long", make)


def links(distinct: DataFrame, k: int = BITS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between fingerprints that connect exactly what links at k bits or fewer."""
    assert k <= 3, "two halves and one wildcard reach 3 bits"
    edges, rows = None, distinct.select(F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"), "fp")
    for level in range(3):
        last = level == 2
        # after three cuts a group has at most 2 ** (8 + 3) members, whatever the input
        done = durable(_compare(_expand(rows, level), k, 1 << 62 if last else group))
        found = done.filter("b is not null").select("a", "b")
        edges = found if edges is None else edges.union(found)
        rows = done.filter("b is null").select("g1", "g2", F.col("a").alias("fp"))
        if last or rows.isEmpty():
            return edges
    return edges


def near_duplicates(documents: DataFrame, k: int = BITS, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id: the smallest doc_id reachable over links, the row's own included.  Texts
    without words (null, empty, blank) have fingerprint zero and link like any other.  A
    text of fewer words than a shingle is one shingle.  Equal fingerprints are one node, so
    copies are never paired; repeated rows get equal results; a null doc_id is never the
    smallest.  Other columns are not read.
    """
    fps = durable(fingerprints(documents, shingle))
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(nodes, k, group))
    named = durable(nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    full = named.join(lowest, "root").select(F.col("fp").alias("own"), "component_id")
    return fps.join(full, fps.fp == full.own).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, k: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of documents, all columns, whose doc_id is their component's smallest; of
    rows that repeat a doc_id and a text, one.  Unlike texts under one doc_id all stay where
    one of them does.  Rows without a doc_id cannot be named and all stay."""
    keep = near_duplicates(documents, k, shingle).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
    unnamed = documents.filter(documents.doc_id.isNull())
    return documents.join(keep, documents.doc_id == keep.kept_id, "left_semi").dropDuplicates(["doc_id", "text"]).union(unnamed)
