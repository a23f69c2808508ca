"""Toxicity and language: held-out accuracy, forward-backward by brute force, edge cases."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import language, toxicity
from granary.llm.queries import op2_toxicity, op10_language_id

FOLDER = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, " %% &"), (4, "You idiot"), (4, "You idiot"), (None, "no key"), (5, "the worthless scum " * 30_000), (6, "the and of in " * 50)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(k, t, "x", 0, "en") for k, t in EDGE], "doc_id long, text string, score string, toxic int, lang_pred string")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_toxicity_of_held_out_documents(spark, tables):
    got = op2_toxicity(spark, FOLDER).join(tables[1], "doc_id").filter("held_out").collect()
    hits = [r for r in got if r.toxic == 1]
    clean = [r for r in got if r.toxic == 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted for r in clean]) < 0.03 and np.mean([r.predicted for r in hits]) > 0.6  # some labels are noise


def test_toxicity_edge_cases(spark, tables, edge):
    model = toxicity.learn(*tables)
    rows = {r.doc_id: r.score for r in toxicity.score(edge, model).collect()}
    assert rows[4] >= 0.3 and rows[5] >= 0.3 and rows[6] < 0.3
    assert rows[1] == rows[2] == rows[3] == pytest.approx(model.prior) and model.prior < 0.3
    assert toxicity.score(edge.limit(0), model).count() == 0
    none = toxicity.learn(tables[0], tables[1].limit(0))
    assert {r.score for r in toxicity.score(edge.filter("doc_id = 1"), none).collect()} == {0.0}


def test_labels_of_held_out_rows_are_not_used(spark, tables):
    docs, labels = tables
    from granary.llm.common import held_out

    wrong = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, labels).single == toxicity.learn(docs, wrong).single


def test_isotonic():
    x, v = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, v).tolist() == [0, 0.5, 0.5, 1]


def test_language_of_held_out_documents(spark, tables):
    got = op10_language_id(spark, FOLDER).join(tables[0].select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(tables, edge):
    model = language.learn(tables[0])
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(edge, model).collect()}
    assert rows[1] == rows[2] == rows[3] == ("und", 0.0) and rows[6][0] == "en" and rows[5][0] in model.languages
    assert language.identify(edge, model).columns.count("score") == 1
    assert language.identify(edge.limit(0), model).count() == 0
    none = language.learn(tables[0].limit(0))
    assert {r.lang_pred for r in language.identify(edge, none).collect()} == {"und"}


def test_code_switched_words_keep_their_language(tables):
    model = language.learn(tables[0])
    parts = {r.lang: " ".join(language.words(r.text)[:30]) for r in tables[0].filter("lang in ('en', 'de') and length(text) > 800").collect()}
    tags = model.tag(f"{parts['en']} {parts['de']}")
    assert np.mean([t[1] == "en" for t in tags[:30]]) > 0.9 and np.mean([t[1] == "de" for t in tags[30:]]) > 0.9


@pytest.mark.parametrize("lengths", [[1], [3], [2, 1, 4], [5, 3]])
def test_forward_backward_by_brute_force(lengths):
    rng = np.random.default_rng(1)
    k, n = 3, sum(lengths)
    scores, change, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    want, at = np.zeros((n, k)), 0
    for length in lengths:
        total = 0.0
        part = np.zeros((length, k))
        for path in itertools.product(range(k), repeat=length):
            w = np.exp(start[path[0]] + sum(scores[at + i, p] for i, p in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, p in enumerate(path):
                part[i, p] += w
        want[at : at + length] = part / total
        at += length
    assert np.allclose(language.forward_backward(scores, change, start, np.array(lengths)), want)


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    scores, labels = rng.normal(size=(2, 4, 3)), rng.integers(0, 3, (2, 4))
    change, start = rng.normal(size=(3, 3)), rng.normal(size=3)

    def likelihood(change):
        total = 0.0
        for s, y in zip(scores, labels):
            weight = lambda p: start[p[0]] + sum(s[i, q] for i, q in enumerate(p)) + sum(change[a, b] for a, b in zip(p, p[1:]))
            total += weight(y) - np.log(sum(np.exp(weight(p)) for p in itertools.product(range(3), repeat=4)))
        return total

    _, moves, _ = language.gradient(scores, labels, change, start)
    for i, j in itertools.product(range(3), range(3)):
        step = np.zeros((3, 3))
        step[i, j] = 1e-5
        assert moves[i, j] == pytest.approx((likelihood(change + step) - likelihood(change - step)) / 2e-5, abs=1e-4)


def test_fit_without_much(spark):
    assert language.fit([]).languages == []
    assert language.fit([("en", "only one language here")]).label(["a word", ""]) == [("en", 1.0, 1.0), ("und", 0.0, 0.0)]
    random.seed(1)
    model = language.fit([("a", " ".join(random.choice(["aba", "abba"]) for _ in range(80))), ("b", " ".join(random.choice(["zyz", "zzy"]) for _ in range(80)))])
    assert [x for x, *_ in model.label(["aba abba", "zyz zzy zyz"])] == ["a", "b"]


def tied_by_hand(a_of, own, pairs, unit_of):
    """Both models' chances of every word, alone and after every head, summed up from the definition."""
    total = [sum(n[c] for n in a_of.values()) for c in (0, 1)]
    members = defaultdict(lambda: [0, 0])
    for w, n in a_of.items():
        for c in (0, 1):
            members[unit_of(w)][c] += n[c]
    shared = {w: sum(n) / sum(members[unit_of(w)]) for w, n in a_of.items()}
    d = toxicity.DISCOUNT
    alone, after = ({}, {}), {}
    for c in (0, 1):
        others = sum(1 for w, n in a_of.items() if not unit_of(w) and n[c])
        gave = d * (others + sum(1 for u, n in members.items() if u and n[c]))
        for w in a_of:
            u = unit_of(w)
            own_part = max(members[u][c] - (d if u else d * others), 0)
            alone[c][w] = (own_part + gave * sum(members[u]) / sum(total)) / total[c] * shared[w]
    for h in {p[0] for p in pairs}:
        here = {t: v for x, t, *v in pairs if x == h}
        for c in (0, 1):
            p = {t: (max(v[c] - d, 0) + d * v[4 + c] * alone[c][t]) / v[2 + c] for t, v in here.items()}
            left = (1 - sum(p.values())) / (1 - sum(alone[c][t] for t in here))
            after[h, c] = {w: p.get(w, left * alone[c][w]) for w in a_of}
    return alone, after


def test_both_models_sum_to_one():
    rng = random.Random(3)
    words = [f"{stem}{i}" for stem in ("badwo", "plain", "thing") for i in range(12)]
    a_of = {w: (rng.randrange(0, 9), rng.randrange(0, 20)) for w in words}
    own = {"plain3": a_of["plain3"], "thing1": a_of["thing1"]}
    stem = [w for w in words if w.startswith("badwo")]
    own["badwo~"] = tuple(sum(a_of[w][c] for w in stem) for c in (0, 1))
    unit = lambda w: w if w in own else "badwo~" if w in stem else ""
    pairs = [("thing1", "plain3", 4, 1, 9, 12, 4, 8, sum(a_of["plain3"])), ("thing1", "badwo2", 3, 0, 9, 12, 4, 8, sum(a_of["badwo2"])), ("plain5", "thing7", 0, 6, 2, 15, 2, 5, sum(a_of["thing7"]))]
    alone, after = tied_by_hand(a_of, own, pairs, unit)
    for p in (*alone, *after.values()):
        assert sum(p.values()) == pytest.approx(1) and min(p[w] for w, n in a_of.items() if sum(n)) > 0
    types = tuple(sum(1 for w, n in a_of.items() if not unit(w) and n[c]) for c in (0, 1))
    model = toxicity.tied_models(own, tuple(sum(n[c] for n in a_of.values()) for c in (0, 1)), types, pairs)
    for h, w in itertools.product(words, words):
        first, second = (math.log(alone[0][x] / alone[1][x]) if sum(a_of[x]) else None for x in (h, w))
        if first is None or second is None:
            continue
        if (h, 0) in after:
            second = math.log(after[h, 0][w] / after[h, 1][w])
        assert model.ratio(f"{h} {w}") == pytest.approx((first + second) / 2)


def test_learned_counts_by_brute_force(spark, tables):
    from granary.llm.common import held_out

    docs, labels = tables
    model = toxicity.learn(docs, labels)
    fold = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(toxicity.FOLDS)) == 0
    rows = docs.filter("text is not null").join(labels.filter(~held_out()), "doc_id").select("text", "toxic", fold.alias("apart")).distinct().collect()
    met = set()
    for r in rows:
        if r.apart:
            continue
        found, first = toxicity.words(r.text), {}
        for i, w in enumerate(found):
            before = found[i - 1] if i else ""
            for u in [w, *(w[:n] + "~" for n in toxicity.STEMS if len(w) > n)]:
                first.setdefault(u, before)
            if i:
                first.setdefault(f"{before} {w}", found[i - 2] if i > 1 else "")
        met |= {(u, c, r.toxic) for u, c in first.items()}
    count = Counter((u, t) for u, _, t in met)
    units = {u: (count[u, 1], count[u, 0]) for u, _ in count}
    single = {u: n for u, n in units.items() if " " not in u and not u.endswith("~")}
    total = [sum(n[c] for n in single.values()) for c in (0, 1)]

    def told(a, m, b, n):
        rate = (a + b) / (m + n)
        part = lambda x, of, p: x * math.log(x / (of * p)) if x > 0 else 0
        return 2 * (part(a, m, rate) + part(m - a, m, 1 - rate) + part(b, n, rate) + part(n - b, n, 1 - rate)) >= toxicity.LEAST_EVIDENCE

    kept = {u for u, (a, b) in units.items() if " " not in u and told(a, total[0], b, total[1])}
    unit = lambda w: next((u for u in [w, *(w[:n] + "~" for n in toxicity.STEMS if len(w) > n)] if u in kept), "")
    own = defaultdict(lambda: (0, 0))
    for w, n in single.items():
        if unit(w):
            own[unit(w)] = tuple(x + y for x, y in zip(own[unit(w)], n))
    heads, kinds = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for u, n in units.items():
        if " " in u:
            for c in (0, 1):
                heads[u.split()[0]][c] += n[c]
                kinds[u.split()[0]][c] += n[c] > 0
    types = tuple(sum(1 for w, n in single.items() if not unit(w) and n[c]) for c in (0, 1))
    pairs = [(*u.split(), *n, *heads[u.split()[0]], *kinds[u.split()[0]], sum(single[u.split()[1]])) for u, n in units.items() if " " in u and all(heads[u.split()[0]]) and told(n[0], heads[u.split()[0]][0], n[1], heads[u.split()[0]][1])]
    want = toxicity.tied_models(dict(own), tuple(total), types, sorted(pairs))
    assert model.single == pytest.approx(want.single) and model.stem == pytest.approx(want.stem) and model.pair == pytest.approx(want.pair) and model.after == pytest.approx(want.after)
    assert len(model.single) >= 5


def test_languages_by_brute_force(tables):
    model = language.learn(tables[0])

    def emission(word):
        chars = [2, *map(ord, word), 3]
        out = np.array(model.typical[model.lexicon.get(word, -1)])
        for order in (2, 3, 4):
            for i in range(len(chars) - order + 1):
                if order < 4 or i == 0 or i == len(chars) - order:
                    out = out + model.weights[language.hashed([np.array([c], np.uint32) for c in chars[i : i + order]], order)[0]]
        return out

    k = len(model.languages)
    for text in ("the and of in", "der 12 die und", "x", "Öl, the schön él ½"):
        found = [w for w in "".join(c if __import__("unicodedata").category(c)[0] == "L" else " " for c in text.lower()).split()]
        scores, marginal = [emission(w) for w in found], np.zeros((len(found), k))
        for path in itertools.product(range(k), repeat=len(found)):
            w = math.exp(model.start[path[0]] + sum(s[p] for s, p in zip(scores, path)) + sum(model.change[a, b] for a, b in zip(path, path[1:])))
            for i, p in enumerate(path):
                marginal[i, p] += w
        mean = (marginal / marginal.sum(1, keepdims=True)).mean(0)
        name, share, _ = model.label([text])[0]
        assert name == model.languages[int(mean.argmax())] and share == pytest.approx(mean.max())


def test_numerals_are_no_letters():
    assert language.words("½ ② Ⅷ x² 一 ٣ ª_b") == ["x", "一", "ª", "b"]
    model = language.fit([("a", "aba abba " * 40), ("b", "zyz zzy " * 40)])
    assert model.label(["½ ②", "12 Ⅷ"]) == [("und", 0.0, 0.0)] * 2


def test_sample_of_languages_is_bounded(spark):
    rows = [(i, f"lang{i % 5} word{i} " * 400, f"l{i % 5}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, learn_rows=5, learn_chars=50, learn_words=500, languages=3)
    assert len(model.languages) == 3
