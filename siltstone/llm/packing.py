"""Bulk-synchronous best-fit packing of token sequences (operator 10).

Documents are cut into pieces of at most ``capacity`` tokens. Then, in rounds, all
open gaps and all unplaced pieces meet in order of size: a sweep from the largest size
down gives each piece the smallest free gap that holds it (its successor), where
pieces of one size compete the one of lower rank wins, every gap takes one piece a
round, and the gaps shrink before the next round. When no gap holds any piece, as many
sequences open as the rest needs at least, ceil(tokens / capacity).

Sizes are whole numbers up to ``capacity``, so a sorted run of equal pieces or gaps is
(size, count): the sweep goes over at most ``capacity`` runs of pieces and the runs of
gaps, however many rows there are. Only those counts reach the driver. The rows stay
distributed: a range sort numbers the pieces of each size (a size that a third of all
pieces share is split over tasks), and each finds the segment (size, ranks, sequences)
that the sweeps gave to its rank by binary search.

Null text counts as empty: it has only the end token. Rows with equal or null doc_id are
separate documents. An empty table gives an empty table. Columns other than
doc_id and text aren't read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import _ASCII_SPACE, _CONTROL

CAPACITY, END = 4096, 1
#: Entries of a worker's cache of encoded chunks; it is emptied when full.
CACHE_WORDS = 400_000

#: Marks of words that have occurred, by hash (a clash only keeps a word early).
_SEEN = (1 << 22) - 1

_STOP = re.compile(r"(?<=[^\W_])([.,])(?=\s|$)")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Ids:
    """Ids of texts as little-endian unsigned 32-bit numbers, by the tokenizers library.

    A text is normalized as a whole and cut at white space and before a comma or full stop that ends a
    word; these chunks are looked up in a cache. The pieces (as the tokenizer's own pattern splits them) of chunks that
    aren't there go to the library together, and the ids that end a piece part them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import normalizers, pre_tokenizers

        self.path, self.tokenizer = path, None
        # the same model for pieces, which are normalized and split already
        self.model = self._load()
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split)
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + len(spec["added_tokens"]) + 2, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.chunks: dict[str, bytes] = {}
        self.seen = bytearray(_SEEN + 1)

    def _load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def _whole(self, text: str) -> bytes:
        self.tokenizer = self.tokenizer or self._load()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunks(self, text: str) -> list[str] | None:
        """None where a text must go to the library as it is (special tokens, letters that change again)."""
        if "<|" in text:
            return None
        if text.isascii():
            plain = text.lower()
        else:
            plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if not unicodedata.is_normalized("NFC", plain):
                return None
        plain = _STOP.sub(r" \1", plain)
        return _ASCII_SPACE.split(plain) if _CONTROL.search(plain) else plain.split()

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(pieces), 2000):
            some = pieces[k : k + 2000]
            ids = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            else:
                out += map(self._whole, some)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts."""
        texts = [t or "" for t in texts]
        split = [self._chunks(t) for t in texts]
        chunks, seen = self.chunks, self.seen
        new = [c for c in set().union(*filter(None, split)) if c not in chunks]
        mixed = {c: self.pattern.findall(c) for c in new if not c.isalpha() and len(c) != 1}
        simple = {c for c in new if c not in mixed and c}
        simple.update(p for ps in mixed.values() for p in ps if p not in chunks)
        simple = list(simple)
        chunks.update(zip(simple, self._encode_pieces(simple), strict=True))
        get = chunks.__getitem__
        joined = {c: b"".join(map(get, ps)) for c, ps in mixed.items() if ps != [c]}
        chunks.update(joined)
        chunks[""] = b""
        out = [self._whole(t) if cs is None else b"".join(map(get, cs)) for t, cs in zip(texts, split, strict=True)]
        # what occurs for the first time mostly never does again: only from the second batch on it is kept
        for keys in (simple, joined):
            for k in keys:
                i = hash(k) & _SEEN
                if not seen[i]:
                    seen[i] = 1
                    chunks.pop(k, None)
        if len(chunks) > CACHE_WORDS:
            chunks.clear()
        return out


@lru_cache(1)
def _ids(path: str) -> _Ids:
    """One for each worker process, so that its next task finds the words of the last."""
    return _Ids(path)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32.

    White space never joins two tokens of this tokenizer, so a word's ids don't depend on
    its neighbours and are kept for the next time that it occurs.
    """
    common.small_batches(docs.sparkSession)
    path, end, step = path or common.tokenizer_path(), np.array([END], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1).to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def best_fit_segments(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, pieces, first sequence, offset): pieces of a size, by rank, go to consecutive sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    rank = np.zeros(capacity + 1, np.int64)
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of gap: (first sequence, sequences)
    out: list[tuple[int, int, int, int, int]] = []
    sizes = np.arange(capacity + 1)
    opened = 0

    def open_new(n: int) -> None:
        nonlocal opened
        if n:
            gaps.setdefault(capacity, []).append((opened, n))
            opened += n

    open_new(int(left[capacity // 2 + 1 :].sum()))
    while left.any():
        after: dict[int, list[tuple[int, int]]] = {}
        stack: list[tuple[int, int, int]] = []
        matched = False
        for size in sorted({*gaps, *map(int, np.flatnonzero(left))}, reverse=True):
            stack += [(size, first, n) for first, n in gaps.pop(size, ())]
            while left[size] and stack:
                gap, first, n = stack.pop()
                took = min(int(left[size]), n)
                out.append((size, int(rank[size]), took, first, capacity - gap))
                rank[size] += took
                left[size] -= took
                if gap > size:
                    after.setdefault(gap - size, []).append((first, took))
                if n > took:
                    stack.append((gap, first + took, n - took))
                matched = True
        for gap, first, n in stack:
            after.setdefault(gap, []).append((first, n))
        gaps = after
        if not matched:
            open_new(-(-int((left * sizes).sum()) // capacity))
    return out


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length long, 1 to ``capacity``, and any other columns) with sequence_id and offset."""
    spark = pieces.sparkSession
    keys = [c for c in ("doc_id", "piece") if c in pieces.columns]
    ranked = common.with_global_rank(pieces, ["length", *keys], "length")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    segments = np.array(sorted(best_fit_segments(counts, capacity)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(segments)  # bounded by the capacity, not by the rows
    names = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = shared.value
        at_rank = seg[:, 0] * (1 << 48) + seg[:, 1]
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(at_rank, size * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(seg[at, 3] + rank - seg[at, 1]), pa.array(seg[at, 4])],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.select(*names, "_rank").mapInArrow(run, schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    pieces = common.materialize(token_pieces(common.table(spark, sf_dir, "documents")), "pieces")
    return best_fit_pack(pieces)
