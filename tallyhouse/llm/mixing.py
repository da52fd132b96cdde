"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives each document a posterior over domains; a document
belongs to every domain in that proportion. Nonnegative rates r (expected copies per document) are then
fitted so that the expected domain totals, sum of r * tokens * posterior, match the targets in the least-squares
sense. The fit is projected gradient from r = 1, in the metric that weighs each document by its tokens:

    r <- max(0, r - p . step),   step = (G + ridge)^-1 (totals(r) - targets),   G = sum of tokens * p p' where r > 0

where p is the posterior. It ends within `TOLERANCE`; after `ITERATIONS` steps without that, the best rates so far are
taken, a warning is given, and the wanted and reached shares in the report show the gap. Targets are as given,
but a domain without mass cannot be reached by any rate: its target goes to the others in proportion. One step is one number per domain, so a document's rate is a function of the list of
steps taken so far: an iteration is one aggregate over the documents, and no rate is ever stored or collected.

Copies are whole: the rate rounded up or down at random in proportion to its fraction, by a hash of the id and the
text, so that the copies of one text are rounded apart. Rows that are equal in both are told apart by their place in
the input as it is read.

The default domains are `clean`, `low` and `toxic` by the columns of `labels`. Cases: null and empty texts have no
tokens, so they do not move the totals, and a posterior like any other text; a document without a known posterior
takes the shares of the labelled table; domains without mass, as those without a labelled row, get no step; an empty table gives no
row; repeated rows are separate documents with the same rate; other columns pass through in `mix`.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.arrays import blocks, word_hashes
from tallyhouse.llm.common import cut, own
from tallyhouse.llm.features import style_and_words
from tallyhouse.llm.quality_knn import sample_features

DOMAINS = ("clean", "low", "toxic")
#: wanted share of each domain's tokens; the total stays what it is
TARGETS = {"clean": 0.9, "low": 0.07, "toxic": 0.03}
LABELLED_PER_DOMAIN = 700
KEPT_FEATURES = 512
ITERATIONS = 60
TOLERANCE = 1e-4
#: relative to each domain's own weight, so that rare domains move as fast as the others
RIDGE = 1e-6
#: share of the tokens below which a domain has no mass
NO_MASS = 1e-9


def domain_of(labels: DataFrame) -> Column:
    """clean: good and not toxic; toxic: toxic; low: the rest. Null if a label is missing."""
    quality, toxic = labels["quality"], labels["toxic"]
    return F.when(quality.isNull() | toxic.isNull(), F.lit(None)).when(toxic == 1, F.lit(2)).when(quality == 1, F.lit(0)).otherwise(F.lit(1))


@dataclass(frozen=True)
class Classifier:
    """Softmax over the kept features."""

    kept: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.odds(style_and_words(data, offsets, self.kept))

    def odds(self, features: np.ndarray) -> np.ndarray:
        logits = (features / self.scale) @ self.weights + self.bias
        logits -= logits.max(1, keepdims=True)
        odds = np.exp(logits.astype(np.float64))
        return odds / odds.sum(1, keepdims=True)


@dataclass(frozen=True)
class Sample:
    """The features that are not 0 of a number of texts; only some columns at a time are written out."""

    rows: np.ndarray
    at: np.ndarray
    values: np.ndarray
    count: int
    width: int

    def columns(self, wanted: np.ndarray) -> np.ndarray:
        """(texts, wanted) of the sorted positions `wanted`."""
        place = np.searchsorted(wanted, self.at)
        hit = place < len(wanted)
        hit[hit] = wanted[place[hit]] == self.at[hit]
        out = np.zeros((self.count, len(wanted)), np.float32)
        out[self.rows[hit], place[hit]] = self.values[hit]
        return out


def fit_softmax(sample: Sample, domains: np.ndarray, shares: np.ndarray, count: int) -> Classifier:
    """Class-balanced fit on the most telling features, moved to the shares of the labelled table."""
    target = np.eye(count)[domains]
    sizes = target.sum(0)
    means, spread = np.zeros((count, sample.width)), np.zeros(sample.width, np.float32)
    for first in range(0, sample.width, KEPT_FEATURES):
        part = np.arange(first, min(first + KEPT_FEATURES, sample.width))
        features = sample.columns(part)
        means[:, part] = (target.T @ features) / np.maximum(sizes, 1)[:, None]
        spread[part] = features.std(0) + 1e-3
    telling = np.abs(means - means[sizes > 0].mean(0))[sizes > 0].max(0) / spread
    kept = np.sort(np.argsort(-telling, kind="stable")[:KEPT_FEATURES])
    scale = spread[kept]
    x = (sample.columns(kept) / scale).astype(np.float32)
    per_row = (1 / np.maximum(sizes, 1))[domains][:, None] / max((sizes > 0).sum(), 1)
    weights, bias = np.zeros((x.shape[1], count)), np.zeros(count)
    speed_w, speed_b = np.zeros_like(weights), np.zeros(count)
    energy = per_row[:, 0] @ (x.astype(np.float64) ** 2).sum(1)
    # rows without any telling feature (a single one, or empty texts) leave the shares of the table alone
    step = 2.0 / energy if energy > 0 else 0.0
    for _ in range(250):
        logits = x @ weights + bias
        logits -= logits.max(1, keepdims=True)
        odds = np.exp(logits)
        error = (odds / odds.sum(1, keepdims=True) - target) * per_row
        speed_w = 0.95 * speed_w - step * (x.T @ error + 1e-3 * weights)
        speed_b = 0.95 * speed_b - step * error.sum(0)
        weights, bias = weights + speed_w, bias + speed_b
    # from equal weights to the shares found; a domain without a row is not predicted
    bias = np.where(sizes > 0, bias + np.log(np.maximum(shares, 1e-9)), -50.0)
    return Classifier(kept, scale, weights, bias)


def fit_classifier(docs: DataFrame, labels: DataFrame, per_domain: int = LABELLED_PER_DOMAIN) -> Classifier:
    """Fitted on at most `per_domain` labelled documents of each domain; the shares are those of all labelled documents."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), domain_of(labels).alias("domain")).dropna()
    known = cut(known.join(docs.select(docs["doc_id"].cast("long").alias("doc_id")), "doc_id", "left_semi"))
    counted = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(counted.values())
    shares = np.array([counted.get(k, 0) / total if total else 1 / len(DOMAINS) for k in range(len(DOMAINS))])
    chosen = []
    for k in range(len(DOMAINS)):
        chosen += known.filter(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain).collect()
    found = sample_features(docs, [r.doc_id for r in chosen], style_and_words) if chosen else {}
    chosen = [r for r in chosen if r.doc_id in found]
    if not chosen:
        return Classifier(np.zeros(0, np.int64), np.ones(0), np.zeros((0, len(DOMAINS))), np.log(np.maximum(shares, 1e-9)))
    width = style_and_words(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    at, values = zip(*[found[r.doc_id] for r in chosen], strict=True)
    rows = np.repeat(np.arange(len(chosen)), [len(a) for a in at])
    sample = Sample(rows, np.concatenate(at), np.concatenate(values), len(chosen), width)
    return fit_softmax(sample, np.array([r.domain for r in chosen]), shares, len(DOMAINS))


def memberships(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The columns of `docs` other than `_text`, with the number of words `_tokens` and the posteriors `_p` of `_text`."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "_text"]).alias("_row"), "_text")
    out = T.StructType([packed.schema["_row"], T.StructField("_tokens", T.LongType()), T.StructField("_p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, found = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(DOMAINS)))
            for first, past, data, offsets in blocks(batch.column(1), 1 << 19):
                _, owners = word_hashes(data, offsets)
                tokens[first:past] = np.bincount(owners, minlength=past - first)
                found[first:past] = shared.value.posteriors(data, offsets)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, found.size + 1, len(DOMAINS)), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), lists], names=["_row", "_tokens", "_p"])

    return packed.mapInArrow(run, out).select("_row.*", "_tokens", "_p")


def rate(steps: list[np.ndarray], p: Column) -> Column:
    """The rate after the given steps: one fold over a short list of constants."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])
    moved = lambda r, step: F.greatest(F.lit(0.0), r - F.aggregate(
        F.zip_with(p, step, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(taken, F.lit(1.0), moved)


@dataclass(frozen=True)
class Fit:
    """The gradient steps, and the shares asked for and reached by the rates."""

    steps: list[np.ndarray]
    wanted: np.ndarray
    reached: np.ndarray


def wanted_shares(natural: np.ndarray, targets: dict[str, float]) -> np.ndarray:
    """The targets as shares; those of domains without mass go to the others."""
    wanted = np.array([targets[name] for name in DOMAINS], np.float64)
    held = np.where(natural > NO_MASS, wanted, 0)
    if held.sum() == 0:
        return natural
    return held / held.sum()


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, iterations: int = ITERATIONS) -> Fit:
    """`members` has `_tokens` and `_p`, and is read once per iteration."""
    d = len(DOMAINS)
    p, tokens = F.col("_p"), F.col("_tokens").cast("double")

    def measure(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Domain totals at the rates after `steps`, and G."""
        mass = tokens * F.col("_r")
        active = F.when(F.col("_r") > 0, tokens).otherwise(0.0)
        sums = [F.sum(mass * p[i]) for i in range(d)] + [F.sum(active * p[i] * p[j]) for i in range(d) for j in range(d)]
        row = members.select("_tokens", "_p", rate(steps, p).alias("_r")).agg(*[F.coalesce(v, F.lit(0.0)) for v in sums]).first()
        return np.array(row[:d]), np.array(row[d:]).reshape(d, d)

    totals, gram = measure([])
    size = totals.sum()
    if size == 0:
        return Fit([], np.zeros(d), np.zeros(d))
    shares = totals / size
    wanted, open_domains = wanted_shares(shares, targets), np.flatnonzero(shares > NO_MASS)
    steps, best = [], (np.abs(shares - wanted).max(), 0, shares)
    while best[0] > TOLERANCE and len(steps) < iterations:
        gram = gram[np.ix_(open_domains, open_domains)] / size
        step = np.zeros(d)
        step[open_domains] = np.linalg.solve(
            gram + RIDGE * np.diag(np.maximum(np.diag(gram), NO_MASS)), (shares - wanted)[open_domains])
        steps.append(step)
        totals, gram = measure(steps)
        shares = totals / size
        best = min(best, (np.abs(shares - wanted).max(), len(steps), shares), key=lambda found: found[0])
    if best[0] > TOLERANCE:
        warnings.warn(f"mixing targets not met: wanted {wanted.tolist()}, reached {best[2].tolist()}", stacklevel=2)
    return Fit(steps[: best[1]], wanted, best[2])


def _rows(docs: DataFrame, kept: Column) -> DataFrame:
    """`_own`, the number `_chance` in [0, 1) that rounds the row's rate, and `_text`."""
    rows = docs.select(kept.alias("_own"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_text"),
                       docs["doc_id"].cast("long").alias("_id"), F.monotonically_increasing_id().alias("_place"))
    rows = rows.select("_own", "_text", "_place", F.xxhash64(F.col("_id").isNull(), "_id", "_text", F.lit(3)).alias("_hash"))
    again = cut(rows.groupBy("_hash").count().filter("count > 1").select("_hash", F.lit(True).alias("_again")))
    salt = F.lit(0).cast("long")
    if not again.isEmpty():
        rows = rows.join(again, "_hash", "left")
        salt = F.when(F.col("_again"), F.col("_place")).otherwise(salt)
    chance = F.pmod(F.xxhash64("_hash", salt), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.select("_own", chance.alias("_chance"), "_text")


def _with_copies(members: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    found = members.withColumn("_rate", rate(steps, F.col("_p")))
    up = (F.col("_chance") < F.col("_rate") - F.floor("_rate")).cast("long")
    return found.withColumn("_copies", (F.floor("_rate") + up).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents' own columns, each row as often as its copies say."""
    classifier = fit_classifier(docs, labels)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    small = memberships(docs.select(text.alias("_text")), classifier)
    fit = fit_rates(cut(small), targets)
    rows = _rows(docs, F.struct(*[own(docs, c) for c in docs.columns]))
    found = _with_copies(memberships(rows, classifier), fit.steps).filter("_copies > 0")
    return found.select(F.explode(F.array_repeat("_own", F.col("_copies").cast("int"))).alias("_own")).select("_own.*")


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, tokens, one posterior per domain, rate and copies of every document; wanted and reached share of each domain."""
    rows = _rows(docs, docs["doc_id"].cast("long")).withColumnRenamed("_own", "doc_id")
    members = cut(memberships(rows, fit_classifier(docs, labels)))
    fit = fit_rates(members, targets)
    found = _with_copies(members, fit.steps)
    shares = [F.lit(float(values[k])).alias(f"{kind}_{name}") for kind, values in (("wanted", fit.wanted), ("reached", fit.reached))
              for k, name in enumerate(DOMAINS)]
    return found.select("doc_id", F.col("_tokens").alias("n_tokens"),
                        *[F.col("_p")[k].alias(f"p_{name}") for k, name in enumerate(DOMAINS)],
                        F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), *shares)
