"""Byte-level BPE with a segment tree over the ranks of adjacent pairs (operator 5).

The leaves hold, for each position, the rank of merging the symbol there with its
successor; every inner node holds the least (rank, position) below it. So the root is
the leftmost pair of lowest rank. A merge changes three leaves, each in a logarithmic
number of steps, until the root says that no pair can be merged: n symbols take
O(n log n), also where a text is a single word of many thousand letters.

Null text is taken as empty; an empty text has no tokens. Repeated rows each give
a row. Columns other than ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Entries of each generation of a worker's caches of encoded words and pieces.
CACHE_WORDS = 200_000

_CONTROL = regex.compile("[\x1c-\x1f]")
_ASCII_SPACE = regex.compile("[\t-\r ]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones stand for themselves, the rest get letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


def merge_symbols(symbols: list[int], pairs: dict[int, tuple[int, int]], width: int) -> list[int]:
    """Merge until no adjacent pair is in ``pairs`` ({left * width + right: (rank, merged)})."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n:
        size *= 2
    none = 1 << 60
    tree = [none] * (2 * size)
    symbols = [*symbols]
    get = pairs.get
    for i in range(n - 1):
        p = get(symbols[i] * width + symbols[i + 1])
        if p:
            tree[size + i] = p[0] * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    if tree[1] == none:
        return symbols
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                return
            tree[k] = a
            k >>= 1

    while (top := tree[1]) != none:
        i = top % size
        j = after[i]
        symbols[i] = left = get(symbols[i] * width + symbols[j])[1]
        symbols[j] = -1
        after[i] = k = after[j]
        put(j, none)
        p = None
        if k < n:
            before[k] = i
            p = get(left * width + symbols[k])
        put(i, p[0] * size + i if p else none)
        if (h := before[i]) >= 0:
            p = get(symbols[h] * width + left)
            put(h, p[0] * size + h if p else none)
    return [s for s in symbols if s >= 0]


class Encoder:
    """Encodes and decodes by a tokenizers vocabulary file of the kind "BPE with word ends"."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.width = len(vocab) + len(self.special)
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.pairs = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.pairs.setdefault(vocab[a] * self.width + vocab[b], (rank, vocab[a + b]))
        self.token = {str(i): t for t, i in vocab.items()} | {str(i): t for t, i in self.special.items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache, self.piece_cache = common.Recent(self.encode_word, CACHE_WORDS), common.Recent(self._piece, CACHE_WORDS)

    def _piece(self, piece: str) -> str:
        raw = piece.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return " ".join(map(str, merge_symbols(symbols, self.pairs, self.width)))

    def encode_word(self, word: str) -> str:
        """Decimal ids of a text without ASCII white space (which never joins two tokens)."""
        out: list[str] = []
        for part in self.specials.split(word) if self.specials and "<|" in word else (word,):
            if part in self.special:
                out.append(str(self.special[part]))
                continue
            part = unicodedata.normalize("NFC", part)
            # letter by letter where lower() would look at the neighbours (final sigma)
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            out += map(self.piece_cache.__getitem__, self.pieces.findall(part))
        return " ".join(out)

    def encode(self, text: str | None) -> str:
        """The decimal ids of a whole text, joined by one space."""
        if not text:
            return ""
        words = _ASCII_SPACE.split(text) if _CONTROL.search(text) else text.split()
        cache = self.cache
        cache.age()
        self.piece_cache.age()
        ids = " ".join(map(cache.__getitem__, words))
        return " ".join(ids.split()) if "  " in ids or ids[:1] == " " or ids[-1:] == " " else ids

    def decode(self, ids: str) -> str:
        """The tokens of decimal ids joined by one space, as a tokenizer without a decoder has it."""
        return " ".join(map(self.token.__getitem__, ids.split(" "))) if ids else ""


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for each worker process, so that its next task finds the words of the last."""
    return Encoder(path)


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (decimal, space-joined) digest and the decoded text's digest, n_tokens."""
    common.small_batches(docs.sparkSession)
    path = path or common.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_round_trip(common.table(spark, sf_dir, "documents"))
