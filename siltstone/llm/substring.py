"""Removal of repeated substrings by prefix-partitioned suffix trees (operator 1).

Suffixes start at words. Only suffixes that share a prefix can share a long repeat, so

1. a sparse set of suffixes is taken: of the ``PREFIX``-word prefixes in every window, the one of least
   hash (its anchor). Equal windows have equal anchors at equal places, so no
   repeat is lost, and about one suffix in eight is shipped;
2. a count over all prefixes drops those that occur once: their subtrees are leaves. Those that occur more than ``HEAVY``
   times are lengthened from ``PREFIX`` words to ``window`` words, counted from the window's start: their suffixes
   are dealt by that longer prefix;
3. the other suffixes, with the words around that any window at their anchor covers, are dealt by prefix, and a task takes
   its prefixes one after the other, as many at a time as fit in ``CHUNK_BYTES``;
4. for these it builds the tree (``Subtree``): suffixes sorted by the words after their anchor, and by those before it, with the
   longest common prefix of neighbours. A window is a node of both, ``window`` words deep together; if the node is
   internal (two leaves or more) it is a repeat, and all its leaves but the first (least doc_id, then start) are
   removed. Neighbouring windows of a document make one run, which is a maximal repeat.

A prefix that a third of all rows share doesn't fill one group: within a batch, a
window that occurs earlier in the batch is settled at once, and only first occurrences
are shipped (a partial aggregation), so a group gets at most one a batch and window. Lengthened prefixes come sorted, and a task
holds only their first leaf.

Null text has no words; shorter texts than the window keep all words. Rows that repeat doc_id and text are one document and get the
same result each; rows that repeat a doc_id with another text are documents of their own, in order of a
64-bit hash. A null doc_id comes after all others. Columns other than doc_id and text are passed through unread by
``remove_repeats`` and left out by the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

WINDOW, PREFIX = 20, 6
#: Bytes of text for which there is one task, and bytes of suffixes whose tree is built at once.
GROUP_BYTES, CHUNK_BYTES = 24 << 20, 2 << 20
#: A prefix that occurs more often is lengthened; so many at most are (8 MB of hashes that every task reads), the most frequent ones.
HEAVY, HEAVY_MOST = 4096, 1 << 20
#: Odd multipliers of the rolling hashes.
_Q1, _Q2, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_NULL_ID = (1 << 63) - 1


def _rolled(h: np.ndarray, length: int, q: int) -> np.ndarray:
    """Hashes of every ``length`` consecutive values (those that overrun the end are undefined), by doubling."""
    with np.errstate(over="ignore"):
        out, size, done, done_size = h, 1, None, 0
        while True:
            if length & size:
                if done is None:
                    done = out.copy()
                else:
                    done[: len(h) - done_size] += out[done_size:] * np.uint64(pow(q, done_size, 1 << 64))
                done_size += size
            if 2 * size > length:
                return done
            nxt = out.copy()
            nxt[: len(h) - size] += out[size:] * np.uint64(pow(q, size, 1 << 64))
            out, size = nxt, 2 * size


class _Batch:
    """The words of many texts in one array, and the anchor of every window."""

    def __init__(self, texts: list[str | None], window: int) -> None:
        split = [(t or "").encode("utf-8").split() for t in texts]
        self.n = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.cumsum(self.n) - self.n
        self.words = list(chain.from_iterable(split))
        total = len(self.words)
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, total)
        self.doc = np.repeat(np.arange(len(split)), self.n)
        self.place = np.arange(total) - self.first[self.doc]
        valid = self.n[self.doc] - self.place >= window
        self.windows = np.flatnonzero(valid)
        with np.errstate(over="ignore"):
            self.prefix = _rolled(self.hash, PREFIX, _Q1) * np.uint64(_MIX) if total else self.hash
            self.prefix = self.prefix ^ (self.prefix >> np.uint64(32))
        if not len(self.windows):
            self.anchor = self.windows
            return
        # the place of the least prefix (leftmost, if equal) in every stretch of window - PREFIX + 1, by doubling
        span, p = window - PREFIX + 1, self.prefix
        at, size = np.arange(total), 1

        def lesser(a: np.ndarray, shift: int) -> np.ndarray:
            b = np.concatenate([a[shift:], a[len(a) - shift :]]) if shift < len(a) else a
            return np.where(p[b] < p[a], b, a)

        while 2 * size <= span:
            at, size = lesser(at, size), 2 * size
        if size < span:
            at = lesser(at, span - size)
        self.anchor = at[self.windows]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, the greatest long if null), th (hash of the text, to tell rows of one doc_id apart), text, and rest (all other columns)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text", F.struct(*others, F.lit(0).alias("_")).alias("rest"))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs in which the first key grows by one and the others stay."""
    step = (np.diff(keys[0]) != 1) if len(keys[0]) > 1 else np.zeros(0, bool)
    for k in keys[1:]:
        step |= np.diff(k) != 0
    cut = np.flatnonzero(step)
    return np.r_[0, cut + 1], np.r_[cut, len(keys[0]) - 1]


def _listed(doc: np.ndarray, th: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """One list of places for each (doc, th) of rows in that order."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[new], th[new], pa.ListArray.from_arrays(pa.array(np.r_[new, len(doc)].astype(np.int32)), pa.array(place.astype(np.int32)))


def counted_anchors(texts: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """(doc, th, places, heavy, n): the anchors whose prefix occurs more than once in all texts, and (heavy, n) each prefix of more than ``HEAVY``."""

    many = HEAVY
    names = ["h", "doc", "th", "place", "n", "places"]
    found = ["doc", "th", "places", "heavy", "n"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch.column(2).to_pylist(), window)
            at = np.unique(b.anchor)
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # of a prefix that the batch has twice or more one goes to its group, with their number; the others are settled, as one list a document
            _, first, of, n = np.unique(b.prefix[at], return_index=True, return_inverse=True, return_counts=True)
            own = n[of] == 1
            own[first] = True
            ship, rest = at[own], at[~own]
            d = b.doc[ship]
            yield pa.RecordBatch.from_arrays([_long(b.prefix[ship]), _long(doc[d]), _long(th[d]), pa.array(b.place[ship].astype(np.int32)), pa.array(n[of][own].astype(np.int32)), pa.nulls(len(ship), pa.list_(pa.int32()))], names=names)
            if len(rest):
                d, t, places = _listed(b.doc[rest], b.doc[rest], b.place[rest])
                with np.errstate(over="ignore"):
                    key = (doc[d].astype(np.uint64) + np.uint64(1)) * np.uint64(_Q1)
                zero = pa.array(np.zeros(len(d), np.int32))
                yield pa.RecordBatch.from_arrays([_long(key), _long(doc[d]), _long(th[d]), zero, zero, places], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(*columns) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=found)

        parts = []
        for b in batches:
            settled = b.filter(pa.compute.equal(b.column(4), 0))
            if k := settled.num_rows:
                yield out(settled.column(1), settled.column(2), settled.column(5), pa.nulls(k), pa.nulls(k))
            b = b.filter(pa.compute.greater(b.column(4), 0))
            parts.append(tuple(b.column(k).to_numpy() for k in range(5)))
        if not parts:
            return
        h, doc, th, place, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
        total = np.add.reduceat(n[order].astype(np.int64), new) if len(new) else new
        again = order[np.repeat(total > 1, np.diff(np.r_[new, len(s)]))]
        heavy = np.flatnonzero(total > many)
        if k := len(heavy):
            yield out(pa.nulls(k), pa.nulls(k), pa.nulls(k, pa.list_(pa.int32())), s[new[heavy]], total[heavy])
        doc, th, place = doc[again], th[again], place[again]
        order = np.lexsort((place, th, doc))
        doc, th, places = _listed(doc[order], th[order], place[order])
        for k in range(0, len(doc), 5000):
            part = places.slice(k, 5000)
            yield out(doc[k : k + 5000], th[k : k + 5000], part, pa.nulls(len(part)), pa.nulls(len(part)))

    sent = texts.select("doc", "th", "text").mapInArrow(emit, "h long, doc long, th long, place int, n int, places array<int>")
    return sent.repartition(groups, "h").mapInArrow(count, "doc long, th long, places array<int>, heavy long, n long")


def heavy_prefixes(counted: DataFrame) -> np.ndarray:
    """The hashes of the prefixes that are lengthened, in order: ``HEAVY_MOST`` at most."""
    rows = counted.where("heavy is not null").select("heavy", "n")
    above = rows.agg(*(F.count_if(F.col("n") > (HEAVY << k)) for k in range(40))).first()
    k = next(i for i, n in enumerate(above) if n <= HEAVY_MOST)
    return np.array(sorted(r[0] for r in rows.where(F.col("n") > (HEAVY << k)).select("heavy").collect()), np.int64)


def repeat_suffixes(flagged: DataFrame, heavy: np.ndarray, window: int = WINDOW) -> DataFrame:
    """From (doc, th, text, places): suffixes at repeated anchors (h, doc, th, start, end, anchor, span) and windows that repeat
    within a batch (span null; start and end of the run of windows). anchor is the anchor's place in the span, and -1 if the
    prefix is lengthened: then the span is one window and h its hash."""
    shared = flagged.sparkSession.sparkContext.broadcast(heavy)  # 8 MB at most
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for batch in batches:
            b = _Batch(batch.column(2).to_pylist(), window)
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            hot = np.zeros(len(b.words), bool)
            per = np.diff(lists.offsets.to_numpy())
            hot[np.repeat(b.first, per) + lists.flatten().to_numpy()] = True
            keep = hot[b.anchor] if len(b.windows) else np.zeros(0, bool)
            w, anchor = b.windows[keep], b.anchor[keep]
            if not len(w):
                continue
            h1, h2 = _rolled(b.hash, window, _Q1)[w], _rolled(b.hash, window, _Q2)[w]
            rank = np.empty(len(doc), np.int64)
            rank[np.lexsort((th, doc))] = np.arange(len(doc))
            r, place = rank[b.doc[w]], b.place[w]
            order = np.lexsort((place, r, h2, h1))
            a1, a2 = h1[order], h2[order]
            later = np.zeros(len(order), bool)
            later[order[1:]] = (a1[1:] == a1[:-1]) & (a2[1:] == a2[:-1])
            rows: list[tuple] = []
            if (gone := w[later]).size:
                for i, j in zip(*_runs(gone, b.doc[gone]), strict=True):
                    d = b.doc[gone[i]]
                    rows.append((0, int(doc[d]), int(th[d]), int(b.place[gone[i]]), int(b.place[gone[j]]) + 1, 0, None))
            if (live := w[~later]).size:
                at, key = anchor[~later], h1[~later].view(np.int64)
                words, prefix = b.words, b.prefix.view(np.int64)
                long = np.isin(prefix[at], heavy)
                for s, k in zip(live[long].tolist(), key[long].tolist(), strict=True):
                    d = b.doc[s]
                    rows.append((k, int(doc[d]), int(th[d]), int(b.place[s]), int(b.place[s]) + 1, -1, b" ".join(words[s : s + window])))
                live, at = live[~long], at[~long]
                for i, j in zip(*_runs(live, at), strict=True) if live.size else ():
                    d, s, e = b.doc[live[i]], int(live[i]), int(live[j])
                    rows.append((int(prefix[at[i]]), int(doc[d]), int(th[d]), int(b.place[s]), int(b.place[e]) + 1, int(at[i]) - s, b" ".join(words[s : e + window])))
            for k in range(0, len(rows), 20000):
                cols = list(zip(*rows[k : k + 20000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["h", "doc", "th", "start", "end", "anchor", "span"])

    return flagged.mapInArrow(run, "h long, doc long, th long, start int, end int, anchor int, span binary")


class Subtree:
    """The tree of some suffixes: ``spans`` are words with one space between them, ``anchor`` the word at which each suffix starts.

    A node of depth t is a stretch of leaves, in the order of their words, whose neighbours share t words.
    """

    def __init__(self, spans: list[bytes], anchor: np.ndarray, window: int) -> None:
        self.window, self.anchor = window, anchor
        words = b" ".join(spans).split(b" ")
        self.length = np.fromiter((s.count(b" ") + 1 for s in spans), np.int64, len(spans))
        ids = pd.factorize(np.array(words, object))[0].astype(np.int32)
        at = np.cumsum(self.length) - self.length + anchor
        self.after = self._nodes(ids, at, 1, self.length - anchor)
        self.before = self._nodes(ids, at - 1, -1, anchor)

    def _nodes(self, ids: np.ndarray, at: np.ndarray, step: int, known: np.ndarray) -> np.ndarray:
        """(leaves x depths 0 to window): the node of every depth that each leaf is under; below its known words a leaf is of no use."""
        depth = np.arange(self.window)
        table = np.where(depth < known[:, None], ids[np.clip(at[:, None] + step * depth, 0, len(ids) - 1)], -1)
        order = np.lexsort(table.T[::-1])
        differ = table[order[1:]] != table[order[:-1]]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), self.window)  # the longest common prefix of neighbours
        node = np.zeros((len(at), self.window + 1), np.int32)
        node[order[1:]] = np.cumsum(shared[:, None] < np.arange(self.window + 1), axis=0)
        return node

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, first word within its span, node) of all windows: equal nodes are equal words."""
        many = self.length - self.window + 1
        leaf = np.repeat(np.arange(len(many)), many)
        j = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        left = self.anchor[leaf] - j
        n = len(many) + 1
        return leaf, j, (left * n + self.after[leaf, self.window - left]) * n + self.before[leaf, left]


def subtree_repeats(doc: np.ndarray, th: np.ndarray, start: np.ndarray, anchor: np.ndarray, spans: list[bytes], window: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """(doc, th, first window, last + 1) of all leaves under deep internal nodes but the first of each, for whole prefixes' suffixes."""
    known: dict[tuple, int] = {}
    of = np.fromiter((known.setdefault(s, len(known)) for s in zip(spans, anchor.tolist(), strict=True)), np.int64, len(spans))
    unique = [s for s, _ in known]
    # the first occurrence of equal spans stands for all; the others repeat it wholly
    order = np.lexsort((start, th, doc, of))
    first = order[np.r_[True, np.diff(of[order]) != 0]]
    tree = Subtree(unique, anchor[first], window)
    for i in np.flatnonzero(first[of] != np.arange(len(of))).tolist():
        yield int(doc[i]), int(th[i]), int(start[i]), int(start[i] + tree.length[of[i]] - window + 1)
    u, j, node = tree.windows()
    f = first[u]
    d, t, p = doc[f], th[f], start[f] + j
    order = np.lexsort((p, t, d, node))
    later = np.zeros(len(order), bool)
    later[order[1:]] = node[order[1:]] == node[order[:-1]]
    gone = np.flatnonzero(later)
    if gone.size:
        for a, b in zip(*_runs(p[gone], u[gone]), strict=True):
            a, b = gone[a], gone[b]
            yield int(d[a]), int(t[a]), int(p[a]), int(p[b]) + 1


def group_repeats(suffixes: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """(doc, th, start, end): runs of windows whose words also start earlier."""
    names, kinds, most = ["doc", "th", "start", "end"], (pa.int64(), pa.int64(), pa.int32(), pa.int32()), CHUNK_BYTES

    def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), 20000):
            cols = list(zip(*rows[k : k + 20000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, at, leaves = 0, None, set()

        def solve(part: pa.Table) -> Iterator[pa.RecordBatch]:
            doc, th, start, anchor = (part.column(k).to_numpy().astype(np.int64) for k in ("doc", "th", "start", "anchor"))
            yield from batches_of(list(subtree_repeats(doc, th, start, anchor, part.column("span").to_pylist(), window)))

        for batch in batches:
            settled = batch.filter(pa.compute.is_null(batch.column("span")))
            if settled.num_rows:
                yield settled.select(names)
            # windows of lengthened prefixes come in order: whatever isn't the first of its words goes
            single = batch.filter(pa.compute.equal(batch.column("anchor"), -1))
            gone = []
            for h, doc, th, start, span in zip(*(single.column(k).to_pylist() for k in ("h", "doc", "th", "start", "span")), strict=True):
                if h != at:
                    at, leaves = h, set()
                if span in leaves:
                    gone.append((doc, th, start, start + 1))
                else:
                    leaves.add(span)
            yield from batches_of(gone)
            part = batch.filter(pa.compute.and_(pa.compute.is_valid(batch.column("span")), pa.compute.greater_equal(batch.column("anchor"), 0)))
            if not part.num_rows:
                continue
            held.append(part)
            size += pa.compute.sum(pa.compute.binary_length(part.column("span"))).as_py()
            if size > most:
                whole = pa.Table.from_batches(held)
                h = whole.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # prefixes come in order; the last one may go on
                if cut:
                    yield from solve(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                size = sum(pa.compute.sum(pa.compute.binary_length(x.column("span"))).as_py() for x in held)
        if held:
            yield from solve(pa.Table.from_batches(held))

    # settled rows have no prefix; they're dealt by document
    key = F.when(F.col("span").isNull(), F.xxhash64("doc", "start")).otherwise(F.col("h"))
    return suffixes.repartition(groups, key).sortWithinPartitions("h", "doc", "th", "start").mapInArrow(run, "doc long, th long, start int, end int")


def kept_words(text: str | None, runs: list[tuple[int, int]], window: int = WINDOW) -> tuple[int, list[str]]:
    """The number of words, and those that no removed window covers."""
    words = (text or "").encode("utf-8").split()
    gone = np.zeros(len(words) + 1, np.int64)
    for s, e in runs:
        gone[s] += 1
        gone[min(len(words), e - 1 + window)] -= 1
    covered = np.cumsum(gone)[: len(words)] > 0
    return len(words), [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def repeat_runs(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc, th, text and rest, dealt by doc and th) and (doc, th, runs) for texts of which words go.

    Both joins with the texts use the same columns, so the texts are dealt once. Of rows that repeat doc_id and text one is
    searched.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    keyed = _keyed(docs)
    per = keyed.groupBy("doc", "th").agg(F.count("*").alias("n"), F.first(F.octet_length("text")).alias("bytes"))
    size, repeated = per.agg(F.sum("bytes"), F.count_if(F.col("n") > 1)).first()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // GROUP_BYTES))
    dealt = keyed.repartition(groups, "doc", "th")
    texts, placed = keyed, dealt
    if repeated:
        again = common.sized(common.materialize(per.where("n > 1").select("doc", "th"), "again"))
        one = keyed.join(again, ["doc", "th"], "left_semi").groupBy("doc", "th").agg(F.first("text").alias("text"), F.first("rest").alias("rest"))
        texts = keyed.join(again, ["doc", "th"], "left_anti").unionByName(one)
        placed = texts.repartition(groups, "doc", "th")
    counted = common.materialize(counted_anchors(texts, groups, window), "anchors")
    anchors = counted.where("heavy is null").groupBy("doc", "th").agg(F.flatten(F.collect_list("places")).alias("places"))
    flagged = placed.join(anchors, ["doc", "th"]).select("doc", "th", "text", "places", "rest")
    runs = group_repeats(repeat_suffixes(flagged, heavy_prefixes(counted), window), groups, window)
    return dealt, runs.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def op1_substring(spark, sf_dir: str, window: int = WINDOW) -> DataFrame:
    dealt, runs = repeat_runs(common.table(spark, sf_dir, "documents").select("doc_id", "text"), window)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total, kept = kept_words(text, [(x["start"], x["end"]) for x in gone or ()], window)
                n.append(total)
                removed.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            ids = batch.column(0).to_numpy()
            doc = pa.array(ids, pa.int64(), mask=ids == _NULL_ID)
            yield pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return dealt.join(runs, ["doc", "th"], "left").select("doc", "text", "runs", "rest").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def without_runs(text: str, runs: list[tuple[int, int]], window: int = WINDOW) -> str:
    """A text without its removed words and the space after each; all else stays as it is."""
    raw = text.encode("utf-8")
    starts = [m.start() for m in _WORDS.finditer(raw)]
    gone = np.zeros(len(starts) + 1, np.int64)
    for s, e in runs:
        gone[s] += 1
        gone[min(len(starts), e - 1 + window)] -= 1
    covered = (np.cumsum(gone)[: len(starts)] > 0).tolist()
    stops = [*starts[1:], len(raw)]
    return b"".join(raw[a:b] for a, b, c in zip(starts, stops, covered, strict=True) if not c).decode("utf-8").rstrip(" \t\n\v\f\r")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words of repeated windows taken out of ``text`` (n_chars follows, if there is such a column)."""
    dealt, runs = repeat_runs(docs, window)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = [], batch.column(0).to_numpy()
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts.append(without_runs(text, [(x["start"], x["end"]) for x in gone], window) if gone else text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == _NULL_ID), pa.array(texts, pa.string()), batch.column(3)], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("rest", batch.schema.field(3).type)]))

    joined = dealt.join(runs, ["doc", "th"], "left").select("doc", "text", "runs", "rest")
    out = joined.mapInArrow(run, StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("rest", dealt.schema["rest"].dataType)]))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    return out.select(*(own[c] if c in own else F.col(f"rest.`{c}`") for c in columns))


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM d),
x AS (SELECT doc_id, p, array_to_string(w[p:p+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM x),
g AS (SELECT DISTINCT doc_id, p + i AS q FROM r, range(0, 20) AS s(i) WHERE n > 1),
l AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM w),
k AS (SELECT l.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY l.q) AS s FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.q = g.q GROUP BY l.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
