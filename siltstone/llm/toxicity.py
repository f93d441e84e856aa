"""Toxicity scores by weak supervision (operator 3).

Many voters (words and word beginnings of a lexicon, and patterns) mark a text or abstain. Two thirds of the labelled sample choose
the lexicon and give first rates: how often each voter marks toxic and clean texts. A generative label model takes it from
there without labels: expectation-maximization over the votes of all rows of the sample, in which voters whose marks go together beyond
what the class explains share their weight. The labels never enter a posterior. The posteriors are the labels on which a linear
classifier over words and word beginnings is trained; the logit at which it answers 1 is the one that parts the
sample's own labels best. All texts are scored with the classifier.

What is fitted sees at most ``SAMPLE_ROWS`` labelled rows, none of them held out. Scores use the text alone. Null and
empty texts get the score of a text without features. Without labels of both kinds every score is 0. Repeated rows each give a row; of
documents or labels that repeat a doc_id the least text or label is learned from. Columns other than
doc_id and text (and labels' doc_id and toxic) aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language import held_out

#: Bounds of the labelled sample, of its features, and of the lexicon.
SAMPLE_ROWS, FEATURES, LEXICON, MIN_Z, MIN_TEXTS = 12_000, 6000, 300, 7.0, 8
#: Letters of a word beginning; texts' worth of trust in a voter's first rates.
BEGINNINGS, TRUST = (4, 5, 6), 20.0
#: Share of texts from which on a voter counts as one that marks often.
OFTEN = 0.05
#: A voter that marks nearly all texts of a class is one of few words for the other: its silence is told by their marks.
MOSTLY = 0.9
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """The lower-case words of a text, and with a star the beginnings of its longer words."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) > n}


def patterns(text: str | None) -> list[bool]:
    """Marks of the pattern voters: shouting, exclamations in a row, second person with an exclamation."""
    t = text or ""
    letters = sum(map(str.isalpha, t))
    return [letters > 20 and sum(map(str.isupper, t)) > 0.6 * letters, "!!" in t, bool(re.search(r"\b(?:you|your)\b[^.?!]{0,40}!", t, re.I))]


def label_model(votes: np.ndarray, on_toxic: np.ndarray, on_clean: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, dict]:
    """Posteriors of toxic for each row of ``votes`` (rows x voters, 0 or 1) from the votes alone, and what was estimated.

    ``on_toxic``, ``on_clean`` and ``prior`` are first guesses of how often voters mark texts of each class, and of its share;
    the rates keep near theirs by the weight of ``TRUST`` texts.
    """
    first = np.clip(on_toxic, 1e-3, 1 - 1e-3), np.clip(on_clean, 1e-4, 1 - 1e-3)
    on_toxic, on_clean = first
    often = (votes.mean(axis=0) >= OFTEN) & (votes.mean(axis=0) <= 1 - OFTEN)
    often &= np.maximum(on_toxic, on_clean) < MOSTLY
    post, weight, model = np.full(len(votes), prior), np.ones(votes.shape[1]), {}
    for _ in range(rounds):
        # a voter that seldom marks abstains where it doesn't; the silence of others speaks too
        silent = often * weight * np.log((1 - on_toxic) / (1 - on_clean))
        logit = np.log(prior / (1 - prior)) + silent.sum() + votes @ (weight * np.log(on_toxic / on_clean) - silent)
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        moved, post = np.abs(new - post).max(initial=0), new
        model = {"prior": prior, "on_toxic": on_toxic, "on_clean": on_clean, "weight": weight}
        if moved < 1e-4:
            break
        prior = float(np.clip(post.mean(), 1e-3, 0.5))
        on_toxic = (post @ votes + TRUST * first[0]) / (post.sum() + TRUST)
        on_clean = ((1 - post) @ votes + TRUST * first[1]) / ((1 - post).sum() + TRUST)
        # correlation of two voters given the class: what is left of their product without the class's rates
        rest = votes - (post[:, None] * on_toxic + (1 - post)[:, None] * on_clean)
        scale = np.sqrt(np.maximum((rest**2).mean(axis=0), 1e-9))
        correlation = np.clip((rest.T @ rest) / len(votes) / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(correlation, 1)
        correlation[correlation < 0.1] = 0
        weight = 1 / np.maximum(1, correlation.sum(axis=0))
    return post, model


def fit_linear(rows: list[np.ndarray], target: np.ndarray, width: int, steps: int = 1200, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows by gradient steps with momentum (Adam)."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(width + 1), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    n = max(1, len(rows))
    for step in range(1, steps + 1):
        logit = np.bincount(of, w[at], len(rows)) + w[width]
        miss = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - target) / n
        grad = np.bincount(at, miss[of], width + 1) + l2 * w
        grad[width] = miss.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    b = float(w[width])
    return w[:width], b


def cut_between(logit: np.ndarray, toxic: np.ndarray) -> float:
    """The logit that parts the two classes with fewest errors, in the middle of its range."""
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], toxic[order]
    errors = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    return float((x[max(0, k - 1)] + x[min(len(x) - 1, k)]) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled rows that aren't held out, as (doc_id, f, p, toxic), chosen by a hash of doc_id."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(F.col("toxic").cast("int")).alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(features(t)) for t in texts], pa.list_(pa.string())), pa.array([patterns(t) for t in texts], pa.list_(pa.bool_())), batch.column(2)],
                names=["doc_id", "f", "p", "toxic"],
            )

    # the broadcast side has at most `rows` rows; of an id that documents repeat the least text is learned from
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    return common.materialize(found.mapInArrow(run, "doc_id long, f array<string>, p array<boolean>, toxic int"), "sample")


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float | None) -> None:
        self.weights, self.bias = {k: v for k, v in weights.items() if k[-1] != "*"}, bias
        self.begins = {n: {k[:-1]: v for k, v in weights.items() if k[-1] == "*" and len(k) == n + 1} for n in BEGINNINGS}

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        get = self.weights.get
        words = set(_WORD.findall((text or "").lower()))
        logit = self.bias + sum(filter(None, map(get, words)))
        for n, weights in self.begins.items():
            logit += sum(filter(None, map(weights.get, {w[:n] for w in words if len(w) > n})))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, logit)))))


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Lexicon, label model and classifier, from the labelled sample."""
    sample = labelled_sample(docs, labels).withColumn("choosing", F.pmod(F.xxhash64("doc_id", F.lit("voters")), F.lit(3)) < 2)
    choosing = sample.where("choosing")
    total, toxic = choosing.agg(F.count("*"), F.sum("toxic")).first()
    if not total or not toxic or toxic == total:
        return Scorer({}, None)
    # how many toxic and clean texts have each feature; the most telling stay
    seen = choosing.select(F.explode("f").alias("f"), "toxic").groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c"))
    seen = seen.where(F.col("a") + F.col("c") >= MIN_TEXTS)
    # two-proportion z: how sure it is that toxic texts have the feature more often
    both = (F.col("a") + F.col("c")) / F.lit(float(total))
    z = (F.col("a") / F.lit(float(toxic)) - F.col("c") / F.lit(float(total - toxic))) / F.sqrt(both * (1 - both) * F.lit(1 / toxic + 1 / (total - toxic)) + 1e-12)
    known = [(r[0], r[1]) for r in seen.select("f", z.alias("z")).where(F.col("z") > MIN_Z).orderBy(F.desc(F.abs("z")), "f").limit(FEATURES).collect()]
    place = {f: i for i, (f, _) in enumerate(known)}
    lexicon = [f for f, _ in known][:LEXICON]
    voter = {f: i for i, f in enumerate(lexicon)}
    wanted = docs.sparkSession.createDataFrame([(f,) for f in place], "f string")
    small = sample.withColumn("_r", F.monotonically_increasing_id()).select("_r", "doc_id", "p", "toxic", "choosing", F.explode_outer("f").alias("f"))
    small = small.join(F.broadcast(wanted.withColumn("known", F.lit(True))), "f", "left").groupBy("_r").agg(F.first("p").alias("p"), F.first("toxic").alias("toxic"), F.first("choosing").alias("choosing"), F.collect_list(F.when(F.col("known"), F.col("f"))).alias("f"), F.first("doc_id").alias("doc_id"))
    rows = small.orderBy("doc_id").collect()  # at most SAMPLE_ROWS rows of at most FEATURES words
    votes = np.zeros((len(rows), len(lexicon) + 4))
    for i, r in enumerate(rows):
        votes[i, [voter[f] for f in r["f"] if f in voter]] = 1
        votes[i, len(lexicon) : -1] = r["p"]
    votes[:, -1] = ~votes[:, : len(lexicon)].any(axis=1)  # one voter marks texts without a word of the lexicon
    label = np.array([r["toxic"] for r in rows])
    of = lambda k: votes[np.array([r["choosing"] for r in rows]) & (label == k)].mean(axis=0)
    post, _ = label_model(votes, of(1), of(0), toxic / total)
    sparse = [np.array([place[f] for f in r["f"]], np.int64) for r in rows]
    weights, bias = fit_linear(sparse, post, len(place))
    # the score is THRESHOLD where the classifier parts the sample's labels best
    logit = np.array([weights[x].sum() for x in sparse]) + bias
    bias += np.log(THRESHOLD / (1 - THRESHOLD)) - cut_between(logit, label.astype(float))
    return Scorer({f: float(weights[i]) for f, i in place.items() if weights[i]}, bias)


def toxicity(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([shared.value.score(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, common.table(spark, sf_dir, "labels")))
