"""Jaccard join, nearest neighbours and BM25 against brute force; components."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from granary.llm import ann, jaccard, topk
from granary.llm.common import staged
from granary.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def words(n, seed):
    random.seed(seed)
    return [random.choice("abcdefghij") + str(random.randrange(900)) for _ in range(n)]


def corpus():
    """Copies, near copies of one text, shorter texts, and the edge cases."""
    base = words(120, 1)
    out = [" ".join(base)] * 3
    for i in range(70):
        w = list(base)
        for j in random.sample(range(120), 1 + i % 4):
            w[j] = f"x{i}y{j}"
        out.append(" ".join(w))
    out += [" ".join(words(60, 100 + i)) for i in range(40)]
    out += [None, "", "  \n", "one two", "one  TWO", "one two three"]
    return out


def brute(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    links = [[j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([root[i], *(root[j] for j in near)])
            if low != root[i]:
                root[i], changed = low, True
    return [len(x) for x in links], root


@pytest.mark.parametrize("block, grams, large", [(256, 1 << 20, 16), (16, 1 << 20, 16), (16, 1 << 20, 0), (256, 1000, 16), (256, 1000, 2)])
def test_join_by_brute_force(spark, monkeypatch, block, grams, large):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(jaccard, "LARGE", large)
    texts = corpus()
    df = staged(spark.createDataFrame([(i, t, i, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, node long, gram_set string, root int").repartition(3), "corpus")
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.join(df).collect()}
    links, root = brute(texts)
    assert got == {i: (links[i], root[i]) for i in range(len(texts))}
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == set(root) and jaccard.keep_one(df).columns == df.columns


def test_join_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "lone text of a few words"), (2, None)]
    df = staged(spark.createDataFrame(rows, "doc_id long, text string"), "edge")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df).collect())
    assert got == Counter({(1, 1, 2): 2, (None, 1, 2): 1, (None, None, 0): 1, (2, 2, 0): 1})
    assert jaccard.join(df.limit(0)).count() == 0
    # a row without a key stays where its class has no other
    assert sorted((r.doc_id or 0, r.text) for r in jaccard.keep_one(df).collect() if r.text) == [(0, "lone text of a few words"), (1, "a b c d e f")]


def test_one_row_of_each_class_stays(spark):
    a, b = " ".join(words(40, 1)), " ".join(words(40, 2))
    rows = [(1, a, 2), (5, a, 1), (5, b, 1), (7, b + " more", 1), (None, b, 1), (None, "x " + a, 1), (8, a, 0), (1, a, 1), (9, None, 1), (9, None, 1), (None, "", 1), (None, "\u2003", 1)]
    df = staged(spark.createDataFrame(rows, "doc_id long, text string, n int"), "classes")
    got = Counter(tuple(r) for r in jaccard.keep_one(df).collect())
    assert got == Counter([(1, a, 1), (5, b, 1), (9, None, 1), (9, None, 1), (None, "", 1), (None, "\u2003", 1)])


def test_join_of_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    df = staged(spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string"), "long")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_both_ways_of_verifying_agree():
    sets = [np.unique(np.random.default_rng(i % 5).integers(0, 60, 40, np.uint64)) for i in range(30)]
    all_ = np.arange(30)
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (jaccard.common_grams(sets, all_, all_) == np.array(want)).all()


def test_bands_reach_the_recall():
    for rows in (3, 5, 8):
        b = jaccard.bands_for(0.8, 0.999, rows)
        assert (1 - 0.8**rows) ** b <= 0.001 < (1 - 0.8**rows) ** (b - 1)


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    root = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in range(len(links)):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root


def test_neighbours_recall(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.search(df, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in range(0, len(rows), 10):
        near = x @ x[i]
        near[i] = -9
        want = np.argsort(-near)[:5].tolist()
        found = sorted(got[i])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(s == pytest.approx(near[j]) for _, j, s in found)
        hits += len({j for _, j, _ in found} & set(want))
    assert hits / (len(rows) // 10 * 5) >= 0.9


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 0.0]), (None, [1.0, 1.0]), (8, [1.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, 50).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 1.0), (0, 3): (50, 0.0), (50, 1): (0, 0.0), (50, 2): (1, 0.0), (50, 3): (2, 0.0)}
    assert ann.search(df.limit(0), 50).count() == 0
    assert ann.search(df.filter("vec_id = 0"), 50).count() == 0


def test_every_row_of_a_repeated_id_and_of_any_length_is_searched(spark):
    rng = np.random.default_rng(3)
    rows = [(i if i % 3 else 50, rng.normal(size=4 if i % 5 else 7)) for i in range(1, 301)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, 50, k=300).collect():
        got.setdefault((r.query_id, r.query_row), []).append((r["rank"], r.vec_id, r.score))
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    asked = sorted(((i, len(v), v.tolist()) for i, v in rows if i % 50 == 0))
    numbers = Counter()
    assert len(got) == len(asked) > 100
    for i, n, v in asked:
        numbers[i] += 1
        want = sorted((-cosine(np.array(v), x), j) for j, x in rows if len(x) == n and x.tolist() != v)
        found = sorted(got[i, numbers[i]])
        assert [r for r, _, _ in found] == list(range(1, len(want) + 1))
        assert [j for _, j, _ in found] == [j for _, j in want] and [s for _, _, s in found] == pytest.approx([-s for s, _ in want])


def test_chi_square():
    assert ann.chi_square(ann.quantile(0.95, 16), 16) == pytest.approx(0.95)
    assert ann.quantile(0.95, 16) == pytest.approx(26.2962, abs=1e-3)


def bm25(docs, query, k):
    bags = [Counter(topk.find_words((t or "").lower())) for _, t in docs]
    n, mean = len(docs), sum(sum(b.values()) for b in bags) / len(docs)
    out = []
    for (i, _), bag in zip(docs, bags):
        score = 0.0
        for w in set(topk.find_words((query or "").lower())):
            if w in bag:
                df = sum(1 for b in bags if w in b)
                score += math.log1p((n - df + 0.5) / (df + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
        if score > 0:
            out.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("size, block", [(4096, 64), (40, 4)])
def test_topk_by_brute_force(spark, monkeypatch, size, block):
    monkeypatch.setattr(topk, "SHARD", size)
    monkeypatch.setattr(topk, "BLOCK", block)
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(120)]
    texts = [" ".join(random.choices(vocabulary, [1 / (i + 1) for i in range(120)], k=random.randrange(1, 60))) for _ in range(180)]
    docs = [*enumerate(texts), (200, texts[0]), (300, None), (400, ""), (500, "nothing shared!")]
    df = staged(spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, rank int, score double").repartition(3), "bm25")
    index = topk.index  # its tasks read the sizes above from here
    monkeypatch.setattr(topk, "index", lambda *a: spark.createDataFrame([tuple(topk.build([i for i, _ in docs[at : at + size]], [topk.term_counts([t or "" for _, t in docs[at : at + size]])]).values()) for at in range(0, len(docs), size)], topk.SCHEMA) if size == 40 else index(*a))
    got = {}
    for r in topk.search(df, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for i, t in docs:
        if i % 20 == 0:
            want = bm25(docs, t, 10)
            assert [d for d, _ in got.get(i, [])] == [d for d, _ in want]
            assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want])


def test_topk_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b"), (100, "a b"), (100, "a c"), (1, "b")], "doc_id long, text string")
    got = [(r.query_id, r["rank"], r.doc_id) for r in topk.search(df, 100).orderBy("rank").collect()]
    asked = {}
    for r in topk.search(df, 100).collect():
        asked.setdefault(r.query_row, []).append((r["rank"], r.doc_id))
    want = [bm25([(100, "a b"), (100, "a c"), (1, "b")], t, 10) for t in ("a b", "a c")]
    assert sorted([d for _, d in sorted(x)] for x in asked.values()) == sorted([d for d, _ in w] for w in want) and len(got) == sum(map(len, want))
    assert topk.search(df.limit(0), 100).count() == 0


def test_topk_ties_and_very_long_texts(spark):
    long = " ".join(f"l{i % 5000}" for i in range(300_000))
    docs = [(i, "same words here") for i in range(300, 100, -1)] + [(400, long), (401, long + " same"), (500, None)]
    df = staged(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "ties")
    got = {}
    for r in topk.search(df, 100).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {200: list(range(101, 111)), 300: list(range(101, 111)), 400: [400, 401]}


def test_wand_skips_what_can_not_count(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = random.Random(5)
    texts = [" ".join([*(f"t{n}w{rng.randrange(60)}" for _ in range(30)), *(rng.choice(["the", "and"]) for _ in range(8))]) for n in range(20) for _ in range(100)]
    order = rng.sample(range(len(texts)), len(texts))
    docs = [(i, texts[i]) for i in order]
    parts = [topk.term_counts([t for _, t in docs])]
    mean = parts[0][3].mean()
    shard = topk.Shard(topk.build([i for i, _ in docs], parts), mean)
    held = Counter(w for _, t in docs for w in set(t.split()))
    ask = [0, 500, 1999]
    found = [topk.term_counts([texts[i]])[1] for i in ask]
    names = {topk.xxhash.xxh64_intdigest(w): n for w, n in held.items()}
    weights = [np.array([math.log1p((len(docs) - names[int(h)] + 0.5) / (names[int(h)] + 0.5)) for h in x]) for x in found]
    q = topk.Queries(np.arange(3), np.array(ask), np.concatenate(found), np.concatenate(weights), np.cumsum([0, *map(len, found)]), np.zeros(3), 5)
    shard.search(q)
    for at, i in enumerate(ask):
        assert q.found[at].tolist() == [d for d, _ in bm25(docs, texts[i], 5)]
    assert 0 < shard.read < 0.7 * shard.all


def test_topk_sums_few_scores_in_double_precision(monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, [1 / (i + 9) for i in range(3000)], k=rng.randrange(20, 120))) for _ in range(1500)]
    texts[700:720] = texts[:20]  # ties
    parts = [topk.term_counts(texts)]
    shard = topk.Shard(topk.build(list(range(1500)), parts), parts[0][3].mean())
    owner, term, times, lengths = parts[0]
    held = Counter(term.tolist())
    weight = np.array([math.log1p((1500 - held[t] + 0.5) / (held[t] + 0.5)) for t in term.tolist()])
    gain = times * 2.2 / (times + 1.2 * (0.25 + 0.75 * lengths[owner] / lengths.mean()))
    dense = np.zeros((1500, len(held)))
    number = np.unique(term, return_inverse=True)[1]
    dense[owner, number] = gain
    ask = np.zeros((300, len(held)))
    mine = owner < 300
    ask[owner[mine], number[mine]] = weight[mine]
    q = topk.Queries(np.arange(300), np.arange(300), term[mine], weight[mine], np.searchsorted(owner, np.arange(301)), np.zeros(300), 10)
    looked, exact = [], shard._exact
    monkeypatch.setattr(shard, "_exact", lambda who, *a: looked.append(len(who)) or exact(who, *a))
    shard.search(q)
    want = np.round(ask @ dense.T, 9)
    for i in range(300):
        best = np.lexsort((np.arange(1500), -want[i]))[:10]
        assert q.found[i].tolist() == best.tolist() and q.best[i].tolist() == pytest.approx(want[i][best].tolist(), abs=2e-9)
    assert sum(looked) < 0.02 * want.size and shard.rows.dtype == np.float32
    looked.clear()
    q.floor = want.max(1) + 1
    shard.search(q)
    assert sum(looked) == 0
