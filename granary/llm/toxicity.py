"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

Both are complete models of a word after the word before it. They back off from a pair of words to its last word, and
from a word to counts that both classes share. As usual with Kneser-Ney, an expression counts the contexts that it
occurs in and not how often it does, and a document adds one context at most: a passage that many copies repeat counts
once. All counts of the sample enter, and each distribution sums to one.

The models are tied: an expression has discounted counts of its own in each class if a likelihood-ratio test tells the
classes apart (`LEAST_EVIDENCE`). The words that are tied are one class of words by their longest stem (first letters)
that has counts of its own, or else all the rest; within such a class both models share one distribution, which cancels
when they are compared. So the expressions that are told apart are all that a worker needs.

A document's score compares its log-likelihoods under both models, divided by its number of words, and is turned into
a probability by isotonic regression on labelled rows that no count came from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import discard, held_out, staged

#: Labelled rows of each class that are learned from, about; beyond that a sample by hash of the id is taken.
LEARN_ROWS = 4_000
#: Likelihood-ratio statistic from which the classes keep their own counts of an expression.
LEAST_EVIDENCE = 25.0
#: One in so many sampled rows is left out of the counts and calibrates the scores.
FOLDS = 4
DISCOUNT = 0.75
#: Lengths of stems; a word has those that are shorter than itself.
STEMS = (7, 6, 5, 4)
#: Distinct words that a worker remembers.
SEEN_LIMIT = 200_000

find_words = re.compile(r"[^\W_]+").findall


def words(text: str) -> list[str]:
    return find_words(text.lower())


def evidence(a: Column, m: Column, b: Column, n: Column) -> Column:
    """Likelihood-ratio statistic of a out of m against b out of n."""
    rate = (a + b) / (m + n)

    def part(x: Column, of: Column, p: Column) -> Column:
        return F.when(x > 0, x * F.log(x / (of * p))).otherwise(0.0)

    return 2 * (part(a, m, rate) + part(m - a, m, 1 - rate) + part(b, n, rate) + part(n - b, n, 1 - rate))


@dataclass
class Model:
    """Log-likelihood ratios, toxic to ordinary, and the curve from their mean to a probability.

    `single`, `stem`: of words with counts of their own, and of words by their stem; `other`: of all other words;
    `pair`: of a word after another; `after`: what is added to the ratio of any other word after a word.
    """

    single: dict[str, float] = field(default_factory=dict)
    stem: dict[str, float] = field(default_factory=dict)
    pair: dict[tuple[str, str], float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    curve: tuple[list[float], list[float]] = ([0.0], [0.0])
    prior: float = 0.0

    def __post_init__(self):
        self.seen: set[str] = set()
        self.telling: dict[str, float] = {}  # words seen that are more than other words

    def alone(self, w: str) -> float | None:
        """The ratio of a word by itself; none for one of the rest."""
        x = self.single.get(w)
        return next((self.stem[w[:n]] for n in STEMS if len(w) > n and w[:n] in self.stem), None) if x is None else x

    def _meet(self, new: set[str]) -> None:
        if len(self.seen) + len(new) > SEEN_LIMIT:
            self.seen.clear()
            self.telling.clear()
        self.seen |= new
        for w in new:
            x = self.alone(w)
            if x is not None or w in self.after:
                self.telling[w] = self.other if x is None else x

    def ratio(self, text: str) -> float | None:
        """Toxic minus ordinary log-likelihood per word; none for a text without words."""
        found = words(text)
        if not found:
            return None
        alone = set(found)
        if len(self.seen) + len(alone) > SEEN_LIMIT:
            self._meet(alone)
        elif new := alone - self.seen:
            self._meet(new)
        if self.telling.keys().isdisjoint(alone):
            return self.other
        total, shift, before = 0.0, None, ""
        get, pair, after, other = self.telling.get, self.pair.get, self.after.get, self.other
        for w in found:
            x = get(w)
            if shift is not None:
                both = pair((before, w))
                total += both if both is not None else shift + (other if x is None else x)
            else:
                total += other if x is None else x
            shift, before = (None if x is None else after(w)), w
        return total / len(found)

    def score(self, text: str) -> float:
        """The probability of label 1. A text without words gets the share of toxic rows."""
        x = self.ratio(text)
        if x is None:
            return self.prior
        return 0.998 * float(np.interp(x, *self.curve)) + 0.002 / (1 + math.exp(-max(-50.0, min(50.0, 4 * x))))


def tied_models(own: dict[str, tuple[int, int]], totals: tuple[int, int], types: tuple[int, int], pairs: list[tuple]) -> Model:
    """The ratios of both models from their counts.

    `own`: contexts in the toxic and the ordinary class of each word, and of each class of words (a stem and `~`), with
    counts of its own; `totals`: those of all words; `types`: how many of the other words each class has. `pairs`: head,
    tail, contexts of the pair in both classes, contexts and number of all pairs with the head in both, and the tail's
    contexts in all. Both totals must be above zero.
    """
    both, seen = sum(totals), [types[c] + sum(1 for x in own.values() if x[c]) for c in (0, 1)]
    rest = tuple(totals[c] - sum(x[c] for x in own.values()) for c in (0, 1))

    def chance(n: tuple[int, int], c: int, discount: float = DISCOUNT) -> float:
        """Of a word or class of words: its discounted contexts, and its part, by the shared counts, of all that was discounted."""
        return (max(n[c] - discount, 0) + DISCOUNT * seen[c] * sum(n) / both) / totals[c]

    p = {u: (chance(n, 0), chance(n, 1)) for u, n in own.items()}
    p[""] = tuple(max(chance(rest, c, DISCOUNT * types[c]), 1e-12) for c in (0, 1))

    def part_of(w: str) -> str:
        return w if w in own else next((f"{w[:n]}~" for n in STEMS if len(w) > n and f"{w[:n]}~" in own), "")

    heads: dict[str, list] = {}
    for row in pairs:
        heads.setdefault(row[0], []).append(row)
    follow: dict[tuple[str, str], float] = {}
    after: dict[str, float] = {}
    for head, rows in heads.items():
        given, backed = [0.0, 0.0], [0.0, 0.0]
        for _, tail, a, b, m, n, s, t, alone in rows:
            unit, chances = part_of(tail), []
            for c, (x, of, gave) in enumerate(((a, m, s), (b, n, t))):
                back = p[unit][c] * (1 if unit == tail else alone / max(sum(own.get(unit, rest)), 1))
                chances.append((max(x - DISCOUNT, 0) + DISCOUNT * gave * back) / of if of else back)
                given[c] += chances[c]
                backed[c] += back
            follow[head, tail] = math.log(max(chances[0], 1e-12) / max(chances[1], 1e-12))
        left = [max(1 - given[c], 1e-12) / max(1 - backed[c], 1e-12) for c in (0, 1)]
        after[head] = math.log(left[0] / left[1])
    ratio = {u: math.log(max(x[0], 1e-12) / max(x[1], 1e-12)) for u, x in p.items()}
    other = ratio.pop("")
    return Model({u: x for u, x in ratio.items() if not u.endswith("~")}, {u[:-1]: x for u, x in ratio.items() if u.endswith("~")}, follow, after, other)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[float], list[float]]:
    """The rising step curve nearest to y over x, as points for linear interpolation."""
    weight = np.ones(len(x)) if weight is None else weight
    at, first = np.unique(x, return_inverse=True)
    n = np.bincount(first, weights=weight)
    mean = np.bincount(first, weights=y * weight) / n
    blocks: list[list[float]] = []  # value, weight, from, to
    for value, weight, place in zip(mean, n, at):
        blocks.append([value, weight, place, place])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, to = blocks.pop()
            last = blocks[-1]
            last[:] = [(last[0] * last[1] + v * w) / (last[1] + w), last[1] + w, last[2], to]
    points = [(p, b[0]) for b in blocks for p in dict.fromkeys((b[2], b[3]))]
    return [p for p, _ in points], [v for _, v in points]


def learn(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS) -> Model:
    """Fits the models on about `learn_rows` labelled rows of each class that are not held out.

    `docs`: doc_id, text; `labels`: doc_id, toxic. Rows with a null id, text or label are left out; of several labels
    of an id the largest counts, and rows equal in text and label are one. Without labelled rows, or with one class
    only, scores are the share of toxic rows.
    """
    usable = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out())
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}  # two rows at most
    prior = count.get(1, 0) / max(sum(count.values()), 1)
    if len(count) < 2:
        return Model(curve=([0.0], [prior]), prior=prior)
    share = {c: min(1.0, learn_rows / n) for c, n in count.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = usable.filter(draw < F.when(F.col("toxic") == 1, math.ceil(share[1] * (1 << 20))).otherwise(math.ceil(share[0] * (1 << 20))))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")  # about learn_rows ids of each class
    fold = (F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(FOLDS)) == 0).alias("apart")
    rows = staged(rows.select("toxic", "text", fold).distinct(), "labelled", small=True)
    a, b = F.col("a"), F.col("b")
    # one shuffle by expression serves both the distinct contexts and their number
    met = contexts(rows.filter("not apart")).repartition("unit").groupBy("unit", "context", "toxic").agg(F.lit(1).alias("once"))
    counted = staged(met.groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "units")
    sort = F.when(F.instr("unit", " ") > 0, "pair").when(F.col("unit").endswith("~"), "stem").otherwise("word")
    units = counted.withColumn("sort", sort)
    single = units.filter("sort = 'word'")
    m, n = single.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not m or not n:
        return Model(curve=([0.0], [prior]), prior=prior)
    told = F.broadcast(units.filter("sort <> 'pair'").filter(evidence(a, F.lit(m), b, F.lit(n)) >= LEAST_EVIDENCE).select("unit"))  # bounded by the sample
    named = single.join(told.select(F.col("unit").alias("w0")), F.col("unit") == F.col("w0"), "left")
    for k, size in enumerate(STEMS, 1):
        own = F.when(F.length("unit") > size, F.concat(F.substring("unit", 1, size), F.lit("~")))
        named = named.join(told.select(F.col("unit").alias(f"w{k}")), own == F.col(f"w{k}"), "left")
    named = named.withColumn("own", F.coalesce(*(f"w{k}" for k in range(len(STEMS) + 1))))
    own = {r["own"]: (r["a"], r["b"]) for r in named.filter("own is not null").groupBy("own").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    two = units.filter("sort = 'pair'").withColumn("head", F.substring_index("unit", " ", 1)).withColumn("tail", F.substring_index("unit", " ", -1))
    types = named.filter("own is null").agg(F.count(F.when(a > 0, 1)), F.count(F.when(b > 0, 1))).first()
    heads = two.groupBy("head").agg(F.sum("a").alias("m"), F.sum("b").alias("n"), F.count(F.when(a > 0, 1)).alias("s"), F.count(F.when(b > 0, 1)).alias("t"))
    tails = single.select(F.col("unit").alias("tail"), (a + b).alias("alone"))
    # a head of one class only tells nothing of its pairs beyond what the word itself does
    two = two.join(heads.filter("m > 0 and n > 0"), "head").filter(evidence(a, F.col("m"), b, F.col("n")) >= LEAST_EVIDENCE).join(tails, "tail")
    model = tied_models(own, (m, n), tuple(types), sorted(tuple(r) for r in two.select("head", "tail", "a", "b", "m", "n", "s", "t", "alone").collect()))
    known = [r for r in ratios(rows, model).collect() if r["x"] is not None]  # about learn_rows rows of each class
    apart = [r for r in known if r["apart"]]
    apart = apart if len({r["toxic"] for r in apart}) == 2 else known  # too few rows for a fold with both classes
    x, y = np.array([r["x"] for r in apart]), np.array([r["toxic"] for r in apart], float)
    model.curve, model.prior = isotonic(x, y, np.where(y == 1, 1 / share[1], 1 / share[0])), prior
    discard(rows, counted)
    return model


def contexts(rows: DataFrame) -> DataFrame:
    """unit, context, toxic: for each expression of a labelled text, a hash of the word before its first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in bpe.sliced(batch, "text"):
                units, before, toxic = [], [], []
                for c, text in zip(part.column("toxic").to_pylist(), texts):
                    found = words(text)
                    first: dict[str, str] = {}
                    h = u = ""
                    for w in found:
                        if w not in first:
                            first[w] = h
                            for n in STEMS:
                                if len(w) > n:
                                    first.setdefault(w[:n] + "~", h)
                        if h:
                            first.setdefault(f"{h} {w}", u)
                        u, h = h, w
                    units += first
                    before += first.values()
                    toxic += [c] * len(first)
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(before, pa.string()), pa.array(toxic, pa.int32())], ["unit", "before", "toxic"])

    return rows.select("toxic", "text").mapInArrow(run, "unit string, before string, toxic int").select("unit", F.hash("before").alias("context"), "toxic")


def ratios(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([shared.value.ratio(t or "") for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("apart"), x], ["toxic", "apart", "x"])

    return rows.select("toxic", "apart", "text").mapInArrow(run, "toxic int, apart boolean, x double")


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all of them, if none are named) with the score in `into`, which replaces a column
    of that name. Whole texts are scored; null counts as empty; equal texts score alike; no rows give no rows."""
    docs = docs.drop(into)
    kept = keep or docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in bpe.sliced(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([model.score(t) for t in texts], pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)
