"""Near-duplicate groups by SimHash fingerprints and BK-trees (operator 6).

Equal fingerprints are one class, of which one row goes on. Two fingerprints that
differ in at most ``radius`` of 64 bits agree wholly on at least ``blocks - radius`` of
``blocks`` bit blocks, so each choice of that many blocks is a table, and each value there
is a shard: every link lies within some shard. A shard's fingerprints form a BK-tree,
where the children of a node are keyed by their Hamming distance to it; a search within
``radius`` of a query that is d from the node only follows the keys d - radius to
d + radius. Building and searching go together, node by node, for all queries of a
shard at once. A shard gives its links as a spanning forest (fewer links than
fingerprints), never as pairs. Shards that are larger than ``SHARD_ROWS`` are cut into
parts, and each pair of parts is a shard of its own.

The trees are shipped to their queries by shard key and not broadcast: a broadcast
of all trees would grow with the corpus. ``blocks`` grows with the number of fingerprints,
which keeps shards small at the least cost.

Null and empty texts and texts without a word have fingerprint zero and are linked like any
other. Rows that repeat a doc_id each keep their own fingerprint. A null doc_id never becomes a component_id unless its whole
component has no other. Columns other than doc_id and text aren't read; near_duplicates_removed keeps
all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: What near_duplicates_removed takes: words of a shingle, bits, and the similarity that is checked.
STAGE_SHINGLE, STAGE_RADIUS, STAGE_SIMILARITY = 5, 4, 0.8
#: Keys of a text in near_duplicates_removed, and least hashes in each: texts of similarity 0.8 share a key with probability 0.988, of 0.5 with 0.09.
BANDS, BAND_ROWS = 24, 8
#: A shard of more fingerprints than this is cut into parts.
SHARD_ROWS = 50_000
#: Sub-trees of at most this many fingerprints are compared at once.
LEAF = 48
#: The texts of a component, and their bytes, that one task settles among themselves in a round; also what a part of the rest holds.
FIRST_TEXTS, FIRST_BYTES = 512, 4 << 20

#: Odd factors, each of which orders hashes anew; a mixing constant.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = 0xD6E8FEB86659FD93

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of a whole text, repeats included (uint64)."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], "<u8")
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")


def fingerprint_of(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of all shingles of a whole text."""
    return fingerprint_of(shingle_hashes(text, shingle))


def bands_of(h: np.ndarray) -> np.ndarray:
    """``BANDS`` keys (int64) of a set of hashes: two sets share one with probability 1 - (1 - s^BAND_ROWS)^BANDS, s their similarity."""
    with np.errstate(over="ignore"):
        least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
        for k in range(0, len(h), 4096):
            np.minimum(least, (h[None, k : k + 4096] * _FACTORS[:, None]).min(axis=1), out=least)
        keys = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, BAND_ROWS).T:
            keys = (keys ^ row) * np.uint64(_MIX)
            keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bk_forest(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of distinct uint64 ``values`` the place of its group's first member, linked within ``radius``.

    A sub-tree whose nodes and queries are one group already is passed over, so a dense cloud of fingerprints costs
    about one comparison each, not one for each pair.
    """
    n = len(values)
    group = np.arange(n)

    def link(places: np.ndarray) -> None:
        """Make one group of the groups of some places: a pass over the shard for each link that joins two groups, n - 1 at most."""
        found = np.unique(group[places])
        if len(found) > 1:
            group[np.isin(group, found)] = found[0]

    todo = [(np.arange(n), np.arange(n))]  # (nodes of a sub-tree, queries that may reach it)
    while todo:
        nodes, queries = todo.pop()
        if not len(queries):
            continue
        own = group[nodes[0]]
        if (group[nodes] == own).all() and (group[queries] == own).all():
            continue  # whatever is found here is linked already
        if len(nodes) <= LEAF:
            for k in range(0, len(queries), 4096):
                q = queries[k : k + 4096]
                near = np.bitwise_count(values[nodes][:, None] ^ values[q][None, :]) <= radius
                near &= group[nodes][:, None] != group[q][None, :]
                for i in np.flatnonzero(near.any(axis=1)):
                    link(np.append(q[near[i]], nodes[i]))
            continue
        root, rest = nodes[0], nodes[1:]
        to_query = np.bitwise_count(values[queries] ^ values[root]).astype(np.int16)
        link(np.append(queries[to_query <= radius], root))
        key = np.bitwise_count(values[rest] ^ values[root])
        for k in np.unique(key):
            todo.append((rest[key == k], queries[np.abs(to_query - np.int16(k)) <= radius]))
    return group


def _blocks_for(n: int, radius: int) -> int:
    """The number of blocks that costs least: each table ships every row (1 us) and compares it within its shard (2 ns each).

    Keys have ten bits at least, so that a few million fingerprints and few are dealt alike."""

    def bits(blocks: int) -> float:
        return 64 * (blocks - radius) / blocks

    def cost(blocks: int) -> float:
        return comb(blocks, radius) * (1e-6 + 2e-9 * n / 2 ** bits(blocks))

    return min((b for b in range(radius + 1, radius + 7) if bits(b) >= 10), key=cost)


def shard_links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: a spanning forest of every shard."""
    spark = distinct.sparkSession
    blocks = _blocks_for(n, radius)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for t, m in enumerate(masks)))
    rows = distinct.select("fp", F.inline(tables))
    # sizes of shards that must be cut; few, as each has at least SHARD_ROWS rows
    big = rows.groupBy("t", "v").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS).select("t", "v", F.ceil(F.col("n") / F.lit(SHARD_ROWS // 2)).cast("int").alias("parts"))
    rows = rows.join(big, ["t", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # part i is in the shards (i, j) of every j, least first
    pairs = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j)))
    rows = rows.select("fp", F.xxhash64("t", "v").alias("s"), "t", "v", F.explode(pairs).alias("p"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(count, "t", "v", "p").sortWithinPartitions("t", "v", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            fp = frame["fp"].to_numpy(np.int64)
            new = np.flatnonzero(np.r_[True, (np.diff(frame["t"]) != 0) | (np.diff(frame["v"]) != 0) | (np.diff(frame["p"]) != 0)])
            for a, b in zip(new, np.r_[new[1:], len(fp)], strict=True):
                if b - a > 1:
                    own = fp[a:b]
                    root = bk_forest(own.view(np.uint64), radius)
                    moved = np.flatnonzero(root != np.arange(len(own)))
                    if len(moved):
                        out.append(pd.DataFrame({"a": own[moved], "b": own[root[moved]]}))
            return pd.concat(out) if out else pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})

        for batch in batches:
            held.append(batch.to_pandas())
            frame = pd.concat(held, ignore_index=True)
            last = frame.iloc[-1]
            same = (frame["t"] == last["t"]) & (frame["v"] == last["v"]) & (frame["p"] == last["p"])
            whole = frame[~same]
            held = [frame[same]]
            if len(whole):
                yield pa.RecordBatch.from_pandas(solve(whole), preserve_index=False)
        if held:
            yield pa.RecordBatch.from_pandas(solve(held[0]), preserve_index=False)

    return rows.select("fp", "t", "v", "p").mapInArrow(run, "a long, b long")


def band_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of ``texts`` (fp, bands) that share a key: each is linked to the least of its key."""
    keys = texts.select("fp", F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least != most").select("key", "least")
    return keys.join(least, "key").where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def roots_of(prints: DataFrame, radius: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``prints`` (fp); root is a fingerprint of the same component.

    ``more`` has further links (a, b) between fingerprints."""
    classes = common.materialize(prints.select("fp").distinct(), "classes")
    links = shard_links(classes, classes.count(), radius)
    roots = connected_components(links if more is None else links.unionAll(more))
    # only members of linked classes have a root of their own table; other classes are their own component
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicate_classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: one row per row of ``docs``."""
    prints = common.materialize(fingerprints(docs, shingle), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = roots_of(prints, radius).join(least, "fp")
    # the least id is taken per class first, so a class of a third of all rows is one row here
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(component, "fp").select("doc_id", "fp", "component_id")


def shingles_of(text: str | None, shingle: int = STAGE_SHINGLE) -> set:
    """The set of a text's word shingles."""
    w = (text or "").encode("utf-8").translate(_LOWER).split()
    return {b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def _jaccard(x: set, y: set, least: float = 0.0) -> float:
    """Jaccard similarity of two sets (1 if both are empty); 0 where their sizes alone say that it is below ``least``."""
    if not x and not y:
        return 1.0
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def similarity(a: str | None, b: str | None, shingle: int = STAGE_SHINGLE) -> float:
    """Jaccard similarity of two texts' sets of word shingles (1 if neither has one)."""
    return _jaccard(shingles_of(a, shingle), shingles_of(b, shingle))


def _compared(rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """root, doc, th, near of ``rows`` (root, part, kept, doc, th, text): whether a text is similar to a text that stays.

    Within each (root, part) the texts marked ``kept`` (true: stays for sure) come first, the others in order of
    (doc, th). A text with a null mark that is near none of those before it stays, and later ones are compared
    with it too; one marked false is only compared with the kept ones. A task holds the shingles of the texts that stay.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("root", "part", F.when(F.col("kept"), 0).when(F.col("kept").isNull(), 1).otherwise(2).alias("mark"), "doc", "th", "text")
    rows = rows.repartition(count, "root", "part").sortWithinPartitions("root", "part", "mark", "doc", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stay = None, []
        for batch in batches:
            roots, parts, marks = (batch.column(i).to_pylist() for i in range(3))
            near = []
            for root, part, mark, text in zip(roots, parts, marks, batch.column(5).to_pylist(), strict=True):
                if (root, part) != group:
                    group, stay = (root, part), []
                own = shingles_of(text, shingle)
                near.append(mark > 0 and any(_jaccard(own, x, least) >= least for x in stay))
                if mark == 0 or (mark == 1 and not near[-1]):
                    stay.append(own)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(near, pa.bool_())], names=["root", "doc", "th", "near"])
            yield out.filter(pa.array([m != 0 for m in marks], pa.bool_()))

    return rows.mapInArrow(run, "root long, doc long, th long, near boolean")


def near_texts(members: DataFrame, shingle: int, least: float) -> list[DataFrame]:
    """(doc, th) of the texts that are similar to one that stays, in tables; members: root, doc, th, text, written already.

    In order of (doc, th) a text of a component stays unless it is ``least`` similar to one that stays already. Each
    round settles the first texts of every component among themselves (all of them, unless they are more than
    ``FIRST_TEXTS`` or ``FIRST_BYTES``) and compares the rest, in parts, with those of them that stay; the rest that is near none
    is the next round's.
    """
    out = []
    here = ["root", "doc", "th"]
    while True:
        sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
        sizes = common.materialize(sizes, "sizes")
        large = sizes.where((F.col("n") > FIRST_TEXTS) | (F.col("bytes") > FIRST_BYTES)).withColumn("parts", F.ceil(F.greatest(F.col("n") / FIRST_TEXTS, F.col("bytes") / FIRST_BYTES)).cast("int"))
        if large.isEmpty():
            last = _compared(members.select(*here, "text", F.lit(0).alias("part"), F.lit(None).cast("boolean").alias("kept")), shingle, least)
            return [*out, common.materialize(last.where("near").select("doc", "th"), "near")]
        order = Window.partitionBy("root").orderBy("doc", "th")
        ranked = members.join(common.sized(large.select("root")), "root", "left_semi").select(*here, F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
        ranked = ranked.withColumn("k", F.row_number().over(order)).withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        cut = ranked.where((F.col("k") <= FIRST_TEXTS) & ((F.col("before") < FIRST_BYTES) | (F.col("k") == 1))).groupBy("root").agg(F.max(F.struct("doc", "th")).alias("cut"))
        cut = common.materialize(cut.join(large, "root").select("root", "cut", "parts"), "cuts")
        # components that are settled whole have no cut
        marked = members.join(common.sized(cut), "root", "left").withColumn("first", F.coalesce(F.struct("doc", "th") <= F.col("cut"), F.lit(True)))
        first = marked.where("first").select(*here, "text", F.lit(0).alias("part"), F.lit(None).cast("boolean").alias("kept"))
        settled = common.materialize(_compared(first, shingle, least), "settled")
        out.append(settled.where("near").select("doc", "th"))
        rest = marked.where("not first").select(*here, "text", F.pmod(F.xxhash64("doc", "th"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("kept"))
        stay = marked.where("first and cut is not null").join(settled.where("not near").select(*here), here, "left_semi")
        stay = stay.select(*here, "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("kept"))
        judged = common.materialize(_compared(stay.unionByName(rest), shingle, least), "judged")
        out.append(judged.where("near").select("doc", "th"))
        members = common.materialize(members.join(judged.where("not near").select(*here), here, "left_semi"), "members")


def near_duplicates_removed(docs: DataFrame, shingle: int = STAGE_SHINGLE, radius: int = STAGE_RADIUS, least: float = STAGE_SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of equal or near-equal texts, with all columns.

    Fingerprints within ``radius`` bits and texts that share one of ``BANDS`` keys make groups: 64 bits alone don't tell texts
    of similarity 0.8 (some ten bits apart) from others at a radius that stays cheap. In order of doc_id (null ids last, then by a hash of the text) a row stays unless its
    shingles are at least ``least`` similar to those of a text of its group that stays already, so no two texts of a group that
    stay are as similar as that. Of equal texts one row stays, whichever way.
    """
    key = [F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_doc"), F.xxhash64("text").alias("_th")]
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, shingle) for t in batch.column(2).to_pylist()]
            fp = np.fromiter(map(fingerprint_of, hashes), np.uint64, batch.num_rows)
            bands = np.concatenate([bands_of(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * BANDS), pa.array(bands))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64)), lists], names=["doc", "th", "fp", "bands"])

    prints = common.materialize(docs.select(*key, "text").mapInArrow(run, "doc long, th long, fp long, bands array<long>"), "prints")
    # equal texts have equal keys, so each text's are dealt once
    links = band_links(prints.dropDuplicates(["fp", "th"]).select("fp", "bands"))
    prints = prints.select("doc", "th", "fp")
    texts = prints.groupBy("fp", "th").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    texts = common.materialize(texts.join(roots_of(prints, radius, links), "fp"), "texts")
    several = texts.groupBy("root").agg(F.count("*").alias("texts")).where("texts > 1").select("root")
    pairs = common.materialize(texts.join(several, "root").select("root", F.col("doc").alias("_doc"), F.col("th").alias("_th")), "pairs")
    members = docs.select(*key, "text").join(common.sized(pairs), ["_doc", "_th"]).dropDuplicates(["_doc", "_th"])
    members = common.materialize(members.select("root", F.col("_doc").alias("doc"), F.col("_th").alias("th"), "text"), "members")
    # of each text the rows of other ids go; of a near text all rows do
    gone = prints.join(texts.where("n > 1").select("fp", "th", F.col("doc").alias("first")), ["fp", "th"]).where("doc != first").select("doc", "th")
    for near in near_texts(members, shingle, least):
        gone = gone.unionAll(near)
    gone = common.materialize(gone.distinct().select(F.col("doc").alias("_doc"), F.col("th").alias("_th")), "gone")
    columns = docs.columns
    rest = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), *key).join(common.sized(gone), ["_doc", "_th"], "left_anti")
    again = prints.groupBy("doc", "th").count().where("count > 1").select(F.col("doc").alias("_doc"), F.col("th").alias("_th"))
    if not again.isEmpty():  # a row that is repeated wholly has the key of the row that stays
        rest = rest.dropDuplicates(["_doc", "_th"])
    return rest.select(*(F.col(f"_row.`{c}`").alias(c) for c in columns))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicate_classes(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
