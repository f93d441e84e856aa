"""Language identification by cross-parsing entropy (operator 4).

From the whole texts of a sample of labelled rows, each language gets an index of all substrings. A text is
cross-parsed with every index: each phrase is the longest match of the index's
text from there on. The phrases times the logarithm of the learned text's length are the text's
cost in bits, so the language needing fewest normalised phrases wins.

An index is the Burrows-Wheeler transform of the reversed learned text, which finds the same phrases as a suffix
automaton of the text at about 12 bytes a letter for 62 symbols, where the automaton's table took some 500. The
state of a parse is the interval of suffixes that begin with the phrase so far; a letter more is two counts. Whole
arrays of text parts advance together. Texts are
cut into parts of ``PART`` letters for this; all of a text is parsed, and each part begins a phrase, for
every language alike.

A text that is null, empty or has no letter is ``und`` with score 0; so is every text when
nothing is labelled. Equal costs go to the language first in order. Repeated rows each give a row. Null labels and
null ids are not learned from. Columns other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The learned sample: about so many rows of a language, each with its whole text.
SAMPLE_TEXTS = 200
#: Letters that have a symbol of their own; all others share one.
ALPHABET = 60
PART = 256


def held_out() -> Column:
    """True where crc32(doc_id as text) mod 4 is 2 (false for a null doc_id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The places of a text's suffixes in their order, by prefix doubling; the last symbol must be its only least one."""
    n, k = len(text), 1
    rank = text.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (max(n, 256) + 2) + after
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        if new[-1] == n - 1:
            return order
        rank[order] = new
        k *= 2


class Substrings:
    """All substrings of a text of symbols below ``letters``: how often each occurs, found letter by letter from its start."""

    def __init__(self, text: np.ndarray, letters: int) -> None:
        # reversed, and a least symbol at its end
        back = np.r_[text[::-1].astype(np.int64) + 1, 0]
        bwt = back[suffix_order(back) - 1] - 1
        #: Suffixes that begin with a letter: from[c] to from[c + 1].
        self.start = np.r_[1, 1 + np.cumsum(np.bincount(text, minlength=letters))].astype(np.int32)
        self.blocks = len(bwt) // 64 + 1
        here = np.flatnonzero(bwt >= 0)
        cell = bwt[here] * self.blocks + here // 64
        #: For each letter and 64 places: where the letter stands in them, and the suffixes before what they add.
        self.bits = np.zeros(letters * self.blocks, np.uint64)
        np.bitwise_or.at(self.bits, cell, np.uint64(1) << (here % 64).astype(np.uint64))
        held = np.bincount(cell, minlength=letters * self.blocks).reshape(letters, self.blocks)
        self.before = (np.cumsum(held, axis=1) - held + self.start[:-1, None]).astype(np.int32).reshape(-1)

    def longer(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The end of an interval after its phrase goes on with letter ``c``."""
        cell = c * self.blocks + (at >> 6)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[cell] + np.bitwise_count(self.bits[cell] & low)


class Parser:
    """Symbols: 0 for all that isn't a letter (runs count once), 1 for letters without their own symbol, then ``letters``; the last stands for none."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        seen = Counter()
        for t in samples.values():
            seen.update(c for c in t.lower() if c.isalpha() and ord(c) < 65536)
        letters = sorted(sorted(seen), key=lambda c: -seen[c])[:ALPHABET]
        self.symbol = np.zeros(65536, np.uint8)
        self.symbol[[i for i in range(65536) if chr(i).isalpha()]] = 1
        for i, c in enumerate(sorted(letters)):
            self.symbol[ord(c)] = i + 2
        self.none = len(letters) + 2
        codes = {k: self.encode(t)[0] for k, t in samples.items()}
        self.indexes = [Substrings(codes[k], self.none) for k in self.languages]
        self.bits = np.array([math.log2(max(2, len(codes[k]))) for k in self.languages])

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a text, and whether it has a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = self.symbol[np.minimum(points, 65535)]
        if points.size and points.max() > 65535:
            far = np.flatnonzero(points > 65535)
            codes[far] = [int(chr(p).isalpha()) for p in points[far]]
        return codes[(codes != 0) | np.r_[True, codes[:-1] != 0]] if codes.size else codes, bool(codes.any())

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts x languages): phrases of the cross-parsing of each text."""
        parts = np.array([-(-len(t) // PART) for t in texts])
        of = np.repeat(np.arange(len(texts)), parts)
        grid = np.full((int(parts.sum()), PART), self.none, np.uint8)
        row = 0
        for t, n in zip(texts, parts.tolist(), strict=True):
            full = len(t) // PART
            grid[row : row + full] = t[: full * PART].reshape(full, PART)
            if n > full:
                grid[row + full, : len(t) - full * PART] = t[full * PART :]
            row += n
        # long parts first, so that the short ones can be left out of later steps
        used = (grid != self.none).sum(axis=1)
        order = np.argsort(-used, kind="stable")
        steps = np.ascontiguousarray(grid[order].T)
        alive = np.searchsorted(-used[order], -np.arange(PART), "left")
        out = np.zeros((len(texts), len(self.indexes)), np.int64)
        for k, index in enumerate(self.indexes):
            # an empty interval has no longer phrase: whatever follows begins one
            low, high = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
            count = np.zeros(len(order), np.int64)
            for i in range(PART):
                n = alive[i]
                if not n:
                    break
                c = steps[i, :n].astype(np.int32)
                a, b = index.longer(c, low[:n]), index.longer(c, high[:n])
                begins = a >= b
                count[:n] += begins
                low[:n] = np.where(begins, index.start[c], a)
                high[:n] = np.where(begins, index.start[c + 1], b)
            out[:, k] = np.bincount(of[order], count, len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        encoded = [self.encode(t or "") for t in texts]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if self.languages and (at := [i for i, (_, letters) in enumerate(encoded) if letters]):
            cost = self.phrases([encoded[i][0] for i in at]) * self.bits * math.log(2)
            best = cost.argmin(axis=1)
            weight = 1 / np.exp(-np.minimum(700, cost - cost.min(axis=1, keepdims=True))).sum(axis=1)
            for i, b, s in zip(at, best.tolist(), weight.tolist(), strict=True):
                lang[i], score[i] = self.languages[b], s
        return lang, score


def learned_samples(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> dict[str, str]:
    """About ``texts`` whole texts of each language, chosen by a hash, as one string each."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, texts / n))))) if counts else None
    if share is None:
        return {}
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    rows = chosen.select("lang", F.col("text").alias("t")).orderBy("lang", F.xxhash64("t")).collect()
    out: dict[str, list[str]] = {}
    for lang, t in rows:
        out.setdefault(lang, []).append(t or "")
    return {k: "\n".join(v) for k, v in out.items() if any(c.isalpha() for t in v for c in t)}


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(parser)  # about 12 bytes a learned letter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, Parser(learned_samples(docs)))
