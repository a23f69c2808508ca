"""Language identification by a linear-chain conditional random field over the words of a text.

Every word has a language. Its evidence are hashed features: character n-grams with the word's ends marked, longer
affixes, and membership in lexicons of words typical of a language. Learned transitions between neighbours let
code-switched text change its language where the words do. Forward-backward gives each word's probabilities, and a
text has the language that its words have most of.

All words of a slice of texts are one chain that starts anew at each text. The chain is cut into runs that advance
together: products of the runs' transfer matrices link them, so the sums are exact however long a text is.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import held_out

#: Documents of each language that are learned from, about, sampled by hash of the id.
LEARN_ROWS = 300
#: Characters of each of them: a longer text gives a run of so many from a place drawn by hash.
LEARN_CHARS = 20_000
#: Words of the training chains for each language.
LEARN_WORDS = 100_000
#: Languages that are learned, the most frequent first.
LANGUAGES = 256
CHAIN = 64
LEAST_STEPS = 60
SIZE = 1 << 18
LEXICON = 300
UNKNOWN = "und"

#: Numerals are word characters, but no letters.
NUMERALS = "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if chr(c).isnumeric() and unicodedata.category(chr(c))[0] == "N" and not chr(c).isdecimal())
find_words = re.compile(r"[^\W\d_]+").findall
NUMERAL_SET = frozenset(re.sub(r"\\(.)", r"\1", NUMERALS))
find_letters = re.compile(rf"[^\W\d_{NUMERALS}]+").findall
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words(text: str) -> list[str]:
    """Runs of letters (Unicode category L)."""
    text = text.lower()
    # the class with all numerals is slow, and few texts have any
    return find_letters(text) if not text.isascii() and not NUMERAL_SET.isdisjoint(text) else find_words(text)


def hashed(columns: list[np.ndarray], order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]), order * 0x2545F491 + 1, np.uint64)
        for c, m in zip(columns, MIX):
            h = (h ^ c.astype(np.uint64)) * m
            h ^= h >> np.uint64(29)
    return (h % np.uint64(SIZE)).astype(np.int64)


def features(unique: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word: the word's place in `unique`, and the feature."""
    marked = "".join(f"\x02{w}\x03" for w in unique)
    chars = np.frombuffer(marked.encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(unique)), [len(w) + 2 for w in unique])
    places, found = [], []
    for order in (2, 3, 4):
        if len(chars) < order:
            continue
        first, last = owner[: len(owner) - order + 1], owner[order - 1 :]
        inside = first == last
        if order == 4:  # only those at an end of the word: affixes
            inside &= (chars[: len(inside)] == 2) | (chars[order - 1 :] == 3)
        at = np.flatnonzero(inside)
        places.append(first[at])
        found.append(hashed([chars[at + i] for i in range(order)], order))
    return np.concatenate(places), np.concatenate(found)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature, language
    lexicon: dict[str, int]  # word -> row of `typical`
    typical: np.ndarray  # (languages + 1, language): what membership in a language's lexicon says
    change: np.ndarray  # log transition
    start: np.ndarray  # log start

    def emissions(self, unique: list[str]) -> np.ndarray:
        places, found = features(unique)
        out = np.stack([np.bincount(places, self.weights[found, k], len(unique)) for k in range(len(self.languages))], 1)
        return out + self.typical[[self.lexicon.get(w, -1) for w in unique]]

    def label(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """The language of each text, the share of its words' probability that it has, and how clear its words are: the
        mean probability of each word's own language; (und, 0, 0) without a letter."""
        found = [words(t) for t in texts]
        lengths = np.array([len(x) for x in found])
        if not lengths.sum() or not self.languages:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        codes, unique = pd.factorize(np.array([w for x in found for w in x], object))
        marginal = forward_backward(self.emissions(list(unique))[codes], self.change, self.start, lengths[lengths > 0])
        with_words = np.flatnonzero(lengths)
        begins = np.concatenate(([0], np.cumsum(lengths[with_words])[:-1]))
        mean = np.add.reduceat(marginal, begins, axis=0) / lengths[with_words, None]
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        clear = np.add.reduceat(marginal.max(1), begins) / lengths[with_words]
        for i, row, c in zip(with_words.tolist(), mean, clear.tolist()):
            k = int(row.argmax())
            out[i] = self.languages[k], float(min(1.0, row[k])), min(1.0, c)
        return out

    def tag(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a text with its language and probability."""
        found = words(text)
        if not found:
            return []
        p = forward_backward(self.emissions(found), self.change, self.start, np.array([len(found)]))
        return [(w, self.languages[int(r.argmax())], float(r.max())) for w, r in zip(found, p)]


def forward_backward(scores: np.ndarray, change: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marginals of every word; `scores` are the words of chains of `lengths`, one after the other."""
    n, k = scores.shape
    steps = max(1, int(np.sqrt(n)))
    runs = -(-n // steps)
    e = np.ones((runs * steps, k))
    e[:n] = np.exp(scores - scores.max(1, keepdims=True))
    e = np.maximum(e, 1e-30).reshape(runs, steps, k)
    begins = np.concatenate(([0], np.cumsum(lengths)))  # what fills the last run begins a chain of its own
    new: list[list[int]] = [[] for _ in range(steps)]
    for b in begins[begins < runs * steps].tolist():
        new[b % steps].append(b // steps)
    move, first = np.exp(change), np.exp(start)

    def advance(held: np.ndarray, t: int) -> np.ndarray:
        """Rows of weights before step t (any leading axes) to weights at step t."""
        out = held @ move
        if new[t]:
            out[new[t]] = held[new[t]].sum(-1, keepdims=True) * first
        return out

    product = np.broadcast_to(np.eye(k), (runs, k, k)).copy()
    for t in range(steps):
        product = advance(product, t) * e[:, t, None, :]
        product /= product.sum((1, 2), keepdims=True)
    enter, leave = np.ones((runs, k)) / k, np.ones((runs, k))
    for r in range(1, runs):
        x = enter[r - 1] @ product[r - 1]
        enter[r] = x / x.sum()
    for r in range(runs - 1, 0, -1):
        x = product[r] @ leave[r]
        leave[r - 1] = x / x.sum()
    alpha = np.empty((runs, steps, k))
    held = enter
    for t in range(steps):
        held = advance(held, t) * e[:, t]
        held /= held.sum(1, keepdims=True)
        alpha[:, t] = held
    held = leave
    for t in range(steps - 1, -1, -1):
        alpha[:, t] *= held
        x = e[:, t] * held
        held = x @ move.T
        if new[t]:
            held[new[t]] = (x[new[t]] * first).sum(1, keepdims=True)
        held /= held.sum(1, keepdims=True)
    out = alpha.reshape(runs * steps, k)[:n]
    return out / out.sum(1, keepdims=True)


def chains(texts: list[tuple[str, str]], seed: int, learn_words: int) -> tuple[list[str], np.ndarray]:
    """Words and languages of training chains: runs of words from documents of changing languages, CHAIN words each."""
    rng = np.random.default_rng(seed)
    pools: dict[str, list[str]] = {}
    order = rng.permutation(len(texts))
    for i in order.tolist():
        pools.setdefault(texts[i][0], []).extend(words(texts[i][1]))
    pools = {k: v for k, v in sorted(pools.items()) if v}
    names, seen, labels = list(pools), [], []
    room = min(learn_words * len(names), max(64 * CHAIN * len(names), sum(map(len, pools.values()))))
    while len(seen) < room:
        k = int(rng.integers(len(names)))
        pool, n = pools[names[k]], int(rng.integers(4, 120))
        at = int(rng.integers(max(1, len(pool) - n)))
        part = pool[at : at + n]
        seen += part
        labels += [k] * len(part)
    whole = len(seen) // CHAIN * CHAIN
    return seen[:whole], np.array(labels[:whole], np.int64)


def fit(texts: list[tuple[str, str]], passes: int = 3, rate: float = 0.3, seed: int = 7, learn_words: int = LEARN_WORDS) -> Model:
    """Fits the field to (language, text) pairs by adaptive gradient steps on the conditional likelihood of chains of
    about `learn_words` words for each language."""
    languages = sorted({k for k, t in texts if words(t)})
    size = len(languages)
    empty = Model(languages, np.zeros((SIZE, size)), {}, np.zeros((size + 1, size)), np.zeros((size, size)), np.zeros(size))
    if size < 2:
        return empty
    seen, labels = chains(texts, seed, learn_words)
    codes, unique = pd.factorize(np.array(seen, object))
    counts = np.zeros((len(unique), size))
    np.add.at(counts, (codes, labels), 1)
    rates = (counts + 0.1) / (counts.sum(0) + 0.1 * len(unique))
    lexicon: dict[str, int] = {}
    for k in range(size):  # words that occur often and mostly in one language
        lead = counts[:, k] * np.log(rates[:, k] / np.delete(rates, k, 1).max(1))
        for w in np.argsort(-lead)[:LEXICON].tolist():
            if lead[w] > 0:
                lexicon.setdefault(unique[w], k)
    model = Model(languages, empty.weights, lexicon, empty.typical, empty.change, empty.start)
    places, found = features(list(unique))
    begin = np.searchsorted(order := places[sort := np.argsort(places, kind="stable")], np.arange(len(unique) + 1))
    found, member = found[sort], np.array([lexicon.get(w, size) for w in unique])
    del order
    rng, batch = np.random.default_rng(seed), 256
    passes = max(passes, -(-LEAST_STEPS * batch // max(len(seen) // CHAIN, batch)))
    squares = [np.full(x.shape, 1e-2) for x in (model.weights, model.typical, model.change, model.start)]
    codes, labels = codes.reshape(-1, CHAIN), labels.reshape(-1, CHAIN)
    for _ in range(passes):
        for rows in np.array_split(p := rng.permutation(len(codes)), max(1, len(p) // batch)):
            used, local = np.unique(codes[rows], return_inverse=True)
            spans = [np.arange(begin[u], begin[u + 1]) for u in used]
            place, feature = np.repeat(np.arange(len(used)), [len(s) for s in spans]), found[np.concatenate(spans)]
            scores = np.stack([np.bincount(place, model.weights[feature, k], len(used)) for k in range(size)], 1) + model.typical[member[used]]
            local = local.reshape(len(rows), CHAIN)
            error, moves, starts = gradient(scores[local], labels[rows], model.change, model.start)
            by_word = np.stack([np.bincount(local.ravel(), error[..., k].ravel(), len(used)) for k in range(size)], 1)
            touched, back = np.unique(feature, return_inverse=True)
            by_feature = np.stack([np.bincount(back, by_word[place, k], len(touched)) for k in range(size)], 1)
            by_lexicon = np.stack([np.bincount(member[used], by_word[:, k], size + 1) for k in range(size)], 1)
            by_lexicon[size] = 0
            for value, square, at, g in ((model.weights, squares[0], touched, by_feature), (model.typical, squares[1], slice(None), by_lexicon), (model.change, squares[2], slice(None), moves), (model.start, squares[3], slice(None), starts)):
                g = g / len(rows)
                square[at] += g * g
                value[at] += rate * g / np.sqrt(square[at])
    return model


def gradient(scores: np.ndarray, labels: np.ndarray, change: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood of chains of equal length: by word and language, by transition, by start."""
    n, steps, k = scores.shape
    e = np.maximum(np.exp(scores - scores.max(2, keepdims=True)), 1e-30)
    move, first = np.exp(change), np.exp(start)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    held = first * e[:, 0]
    for t in range(steps):
        if t:
            held = (held @ move) * e[:, t]
        held /= held.sum(1, keepdims=True)
        alpha[:, t] = held
    held = np.ones((n, k))
    for t in range(steps - 1, -1, -1):
        beta[:, t] = held
        held = (e[:, t] * held) @ move.T
        held /= held.sum(1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(2, keepdims=True)
    both = alpha[:, :-1, :, None] * move * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    both /= both.sum((2, 3), keepdims=True)
    truth = np.eye(k)[labels]
    moves = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:]) - both.sum((0, 1))
    return truth - marginal, moves, (truth[:, 0] - marginal[:, 0]).sum(0)


def learn(docs: DataFrame, learn_rows: int = LEARN_ROWS, learn_chars: int = LEARN_CHARS, learn_words: int = LEARN_WORDS, languages: int = LANGUAGES) -> Model:
    """Fits on about `learn_rows` documents of each language that are not held out and have a text and a language.

    The driver gets `learn_chars` characters of each at most: a longer text gives a run from a place drawn by hash. Of
    more languages than `languages` the most frequent are learned, and the field is fitted to `learn_words` words for
    each. Rows that are equal in language and text count once among those drawn.
    """
    usable = docs.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null").filter(~held_out())
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 20))
    sample = usable.join(F.broadcast(counts), "lang").filter(draw < F.lit(float(learn_rows << 20)) / F.col("n"))  # a row per language
    spare = F.greatest(F.length("text") - learn_chars, F.lit(0)) + 1
    run = F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(12), "text"), spare) + 1).cast("int"), F.lit(learn_chars))
    return fit(sorted({(r["lang"], r["text"]) for r in sample.select("lang", run.alias("text")).collect()}), learn_words=learn_words)


def identify(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, ...] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all of them, if none are named) with what `Model.label` says of whole texts in
    `into`: the language, its share, and, if a third column is named, how clear the words are.

    Texts that are null, empty or without a letter are `und` with score 0. Equal texts get the same language. Columns
    that are named like the results are replaced; no rows give no rows.
    """
    docs = docs.drop(*into)
    kept = keep or docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, k) for n, k in zip(into, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in bpe.sliced(batch, text):
                found = model.label(texts)
                told = [pa.array(x, k) for x, k in zip(zip(*found), (pa.string(), pa.float64(), pa.float64()))][: len(into)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *told], schema.names)

    return docs.mapInArrow(run, schema)
