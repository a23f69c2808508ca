"""Exact top-k search by BM25: an inverted index per shard, searched by block-max WAND.

Every shard of documents has an inverted index of its own. Its documents lie in an order in which similar ones are
neighbours, in blocks of BLOCK documents. Short lists have about one posting in a block that they touch, so their largest
score there is the posting itself: they are read once, and what they add to each document is the exact bound of theirs
for a block. Long lists know the largest score of each of their blocks. A query moves over the blocks; its pivot is the
next block where what the short lists have there and the long ones' largest scores of all could reach the k-th best
score found so far, and it skips all blocks before that. At the pivot the long lists' largest scores in the block are
added: only if these reach the threshold as well are their postings of the block read. Many queries move together, and
several blocks of theirs are multiplied at once, in single precision with a bound on its error; the few documents that
may count by that are then summed in double precision.

Document frequencies, the number of documents and their mean length are those of all shards, so scores of different
shards compare, and merging the shards' best k is exact.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import _paths, discard, scratch, staged

K1, B = 1.2, 0.75
#: Documents, and characters, in a shard at most, but for what one slice of texts holds.
SHARD, SHARD_CHARS = 4096, 20_000_000
BLOCK = 128
#: Terms of the queries that a pass over the shards answers, about, and queries that move together.
PASS_TERMS = 2 << 20
TOGETHER = 256
#: Blocks that are scored together, and postings of short lists that are added together.
SPAN = 8
PORTION = 1 << 18
#: Common terms by which documents are put in order, and into so many parts, each in the order of lengths.
LEADING = 64
PARTS = 16
#: A list of more than this part of a shard's documents is long: its blocks are rows of scores.
COMMON = 1 / 24

find_words = re.compile(r"[^\W_]+").findall
SCHEMA = "ids binary, lengths binary, terms binary, ends binary, posts binary, times binary, n long, words long"
TYPES = {"ids": "<i8", "lengths": "<i8", "terms": "<u8", "ends": "<i8", "posts": "<i4", "times": "<i4"}
HITS = "number long, query_id long, doc_id long, score double"


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) with the number of times, and each text's number of words. Terms are 64-bit hashes."""
    found = [find_words(t.lower()) for t in texts]
    lengths = np.array([len(x) for x in found], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), lengths
    codes, unique = pd.factorize(np.array([w for x in found for w in x], object))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in unique), np.uint64, len(unique))
    both, times = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(unique) + codes, return_counts=True)
    return both // len(unique), hashes[both % len(unique)], times, lengths


def similar_order(term: np.ndarray, owner: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Documents by their part in the main direction of the commonest terms (numbered from 0), so that those of one
    language come together, and among these by length, so that a block's largest scores are near to all of its scores."""
    n, count = len(lengths), np.bincount(term)
    lead = np.argsort(-count, kind="stable")[:LEADING]
    slot = np.full(len(count), -1)
    slot[lead] = np.arange(len(lead))
    mark = slot[term] >= 0
    small = np.zeros((len(lead), n))
    small[slot[term[mark]], owner[mark]] = times[mark] / (times[mark] + K1)
    small -= small.mean(1, keepdims=True)
    x = np.cos(np.arange(n))
    for _ in range(4 if len(lead) else 0):
        x = small.T @ (small @ x)
        x /= np.linalg.norm(x) or 1
    part = np.empty(n, np.int64)
    part[np.argsort(x, kind="stable")] = np.arange(n) * PARTS // max(n, 1)
    return np.lexsort((lengths, part))


def build(ids: list, parts: list[tuple]) -> dict:
    """The index of a shard from the term counts of runs of its documents."""
    first = np.cumsum([0, *(len(p[3]) for p in parts)])
    owner = np.concatenate([p[0] + at for p, at in zip(parts, first)])
    term, times, lengths = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    number, terms = pd.factorize(term, sort=True)
    order = similar_order(number, owner, times, lengths)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    both = number * max(len(ids), 1) + place[owner]  # documents in their order within a term
    by = np.argsort(both)
    ends = np.cumsum(np.append(0, np.bincount(number, minlength=len(terms))))
    columns = {"ids": np.array(ids, "<i8")[order], "lengths": lengths[order], "terms": terms, "ends": ends, "posts": place[owner[by]], "times": times[by]}
    return {k: v.astype(TYPES[k]).tobytes() for k, v in columns.items()} | {"n": len(ids), "words": int(lengths.sum())}


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per shard; shards are made within tasks, without a shuffle, from the counts of one slice of texts after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0
        for batch in batches:
            for part, texts in bpe.sliced(batch, "_text"):
                chars = sum(map(len, texts))
                if ids and (len(ids) + len(texts) > SHARD or size + chars > SHARD_CHARS):
                    yield pa.RecordBatch.from_pylist([build(ids, parts)], schema)
                    ids, parts, size = [], [], 0
                ids += part.column(0).to_pylist()
                parts.append(term_counts(texts))
                size += chars
        if ids:
            yield pa.RecordBatch.from_pylist([build(ids, parts)], schema)

    schema = pa.schema([(c.split()[0], pa.binary() if "binary" in c else pa.int64()) for c in SCHEMA.split(", ")])
    return docs.select(docs[key].cast("long").alias("_id"), docs[text].alias("_text")).filter("_id is not null").mapInArrow(run, SCHEMA)


def frequencies(shards: DataFrame) -> DataFrame:
    """term (the hash as a long) and n, the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends")):
                held = np.frombuffer(terms.as_buffer(), "<i8"), np.diff(np.frombuffer(ends.as_buffer(), "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["term", "n"])

    return shards.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def asked_terms(asked: DataFrame) -> DataFrame:
    """number, query_id and term: the distinct terms of each query's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in bpe.sliced(batch, "text"):
                owner, term, _, _ = term_counts(texts)
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("number").take(at), part.column("query_id").take(at), pa.array(term.view(np.int64))], ["number", "query_id", "term"])

    return asked.select("number", "query_id", "text").mapInArrow(run, "number long, query_id long, term long")


class Queries:
    """A block of queries: their terms one query after the other, with the weights of the terms, and the best found."""

    def __init__(self, numbers: np.ndarray, names: np.ndarray, terms: np.ndarray, weights: np.ndarray, ends: np.ndarray, floor: np.ndarray, k: int):
        self.numbers, self.names, self.weights, self.floor = numbers, names, weights, floor
        # each term is looked up once, in order, which is several times faster than where it comes
        self.terms, self.term = np.unique(terms, return_inverse=True)
        self.term = self.term.astype(np.int32)
        self.owner = np.repeat(np.arange(len(numbers), dtype=np.int32), np.diff(ends))
        self.best = np.zeros((len(numbers), k))
        self.found = np.full((len(numbers), k), -1, np.int64)

    def least(self) -> np.ndarray:
        """The score that a document must reach; nothing below `floor` is wanted."""
        return np.maximum(np.maximum(self.floor, np.where(self.found[:, -1] >= 0, self.best[:, -1], 0)) - 1e-7, 1e-12)

    def offer(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Puts documents into the best of the queries `who`, one for each, worst last; ties go to the smaller id."""
        k, mine = self.best.shape[1], np.unique(who)
        held = self.found[mine] >= 0
        at = np.concatenate([np.repeat(mine, held.sum(1)), who])
        score = np.concatenate([self.best[mine][held], np.round(score, 9)])
        ids = np.concatenate([self.found[mine][held], ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = (rank < k) & (score > 0)
        self.best[at[keep], rank[keep]] = score[keep]
        self.found[at[keep], rank[keep]] = ids[keep]


class Shard:
    """A shard's index, opened for search. Scores are those of a term of weight one."""

    def __init__(self, row: dict, mean: float):
        held = {k: np.frombuffer(row[k], t) for k, t in TYPES.items()}
        self.ids, self.n, self.terms, self.ends = held["ids"], row["n"], held["terms"], held["ends"]
        self.blocks = -(-self.n // BLOCK)
        length = K1 * (1 - B + B * held["lengths"] / mean) if mean else np.full(self.n, K1)
        self.posts, times = held["posts"], held["times"].astype(float)
        gain = times * (K1 + 1) / (times + length[self.posts])
        del times
        count = np.diff(self.ends)
        self.gain = gain.astype(np.float32)
        self.top = np.maximum.reduceat(gain, self.ends[:-1]) if len(count) else np.zeros(0)
        # long lists have a posting nearly everywhere and lie as rows, block after block, which many queries read at once
        common = np.flatnonzero(count > max(BLOCK / 2, self.n * COMMON))
        self.row = np.full(len(count), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        span = np.repeat(self.ends[common] - np.cumsum(count[common]) + count[common], count[common]) + np.arange(count[common].sum())
        self.rows[np.repeat(np.arange(len(common)), count[common]), self.posts[span]] = gain[span]
        self.row_most = self.rows.reshape(len(common), self.blocks, BLOCK).max(2)
        self.row_count = (self.rows.reshape(len(common), self.blocks, BLOCK) > 0).sum(2)
        # the postings document by document; 16 bits are sorted several times faster
        by = np.argsort(self.posts.astype(np.uint16) if self.n < 1 << 16 else self.posts, kind="stable")
        self.held, self.held_gain = np.repeat(np.arange(len(count), dtype=np.int32), count)[by], gain[by]
        self.held_ends = np.searchsorted(self.posts[by], np.arange(self.n + 1))
        self.weight = np.zeros(len(count))  # of one query's terms at a time
        self.read = self.all = 0  # postings of the queries' lists that were read, and all of them

    def search(self, q: Queries) -> None:
        """Finds this shard's documents that belong into the queries' best."""
        place = np.searchsorted(self.terms, q.terms)
        place[place == len(self.terms)] = 0
        place = np.where(self.terms[place] == q.terms, place, -1)[q.term] if len(self.terms) else np.full(len(q.term), -1)
        here = np.flatnonzero(place >= 0)
        slot, owner, weight = place[here], q.owner[here], q.weights[here]
        if not len(slot):
            return
        m, k, count = len(q.numbers), q.best.shape[1], self.ends[slot + 1] - self.ends[slot]
        self.all += int(count.sum())
        # queries whose lists' largest scores do not reach their thresholds have nothing to find here
        mine = (np.bincount(owner, weight * self.top[slot], m) >= q.least())[owner]
        if not mine.all():
            slot, owner, weight, count = slot[mine], owner[mine], weight[mine], count[mine]
        begin, row = np.searchsorted(owner, np.arange(m + 1)), self.row[slot]
        far = row >= 0
        cols, col = np.unique(row[far], return_inverse=True)
        asks = np.zeros((m, len(cols)), np.float32)
        asks[owner[far], col] = weight[far]
        rows = self.rows[cols]
        # what a 32-bit sum of so many positive products may lack or exceed, as a part of it, with room to spare
        sure = 1 + (np.diff(begin) + 32) * 2.0**-23
        begun = asks @ self.row_most[cols].max(1, initial=0) * sure  # what the long lists could add anywhere
        at_most = asks @ self.row_most[cols] * sure[:, None]  # and in each block
        near = self._short(owner[~far], slot[~far], weight[~far], count[~far], m)
        near_most = near.reshape(m, self.blocks, BLOCK).max(2) * sure[:, None]
        # the short lists alone are a lower bound, from which a query that has no threshold yet takes one
        floor = np.zeros(m)
        new = np.flatnonzero(q.least() <= 1e-12)
        if k <= self.n and len(new):
            floor[new] = np.partition(near[new, : self.n], -k, axis=1)[:, -k] / sure[new] - 1e-7
        hits = []
        for b in range(0, self.blocks, SPAN):
            least = np.maximum(q.least(), floor)
            # the pivot: the next block where the long lists' largest scores and what the short ones have there would do
            pivot = begun[:, None] + near_most[:, b : b + SPAN] >= least[:, None]
            go = pivot & (at_most[:, b : b + SPAN] + near_most[:, b : b + SPAN] >= least[:, None])
            who = np.flatnonzero(go.any(1))
            if not len(who):
                continue
            first, last = b + int(go.any(0).argmax()), b + go.shape[1] - int(go.any(0)[::-1].argmax())
            docs = slice(first * BLOCK, min(last * BLOCK, self.n))
            some = slice(None) if len(who) == m else who
            score = asks[some] @ rows[:, docs]
            score += near[some, docs]
            self.read += int(((asks[some] > 0) @ self.row_count[cols, first:last].sum(1)).sum())
            least = least[who] / sure[who]
            hit = score >= least[:, None].astype(np.float32)
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
            if len(many):
                most = np.partition(score[many], -k, axis=1)[:, -k] / sure[who[many]] ** 2 - 1e-7
                floor[who[many]] = np.maximum(floor[who[many]], most)
                hit[many] = score[many] >= np.maximum(most, least[many])[:, None].astype(np.float32)
            at, doc = np.nonzero(hit)
            hits.append((who[at], doc + docs.start, score[at, doc]))
        if not sum(len(x[0]) for x in hits):
            return
        at, doc, score = (np.concatenate(x) for x in zip(*hits))
        order = np.lexsort((-score, at))
        at, doc, score = at[order], doc[order], score[order]
        # what k others surely exceed needs no closer look
        last = np.searchsorted(at, at) + k - 1
        kth = np.minimum(last, len(at) - 1)
        keep = (at[kth] != at) | (last >= len(at)) | (score >= score[kth] / sure[at] ** 2 - 1e-7)
        at, doc = at[keep], doc[keep]
        q.offer(at, self._exact(at, doc, begin, slot, weight), self.ids[doc])

    def _short(self, owner: np.ndarray, slot: np.ndarray, weight: np.ndarray, count: np.ndarray, m: int) -> np.ndarray:
        """What the short lists add to each document for each of the `m` queries, PORTION postings together or a query's."""
        width = self.blocks * BLOCK
        near = np.zeros((m, width), np.float32)
        total, edge = np.concatenate([[0], np.cumsum(count)]), np.searchsorted(owner, np.arange(m + 1))
        self.read += int(total[-1])
        start, weight, i = self.ends[slot] - total[:-1], weight.astype(np.float32), 0
        while i < m:
            j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + PORTION, "right")) - 1)
            lo, hi = edge[i], edge[j]
            at = np.repeat(start[lo:hi], count[lo:hi])
            at += np.arange(total[lo], total[hi])
            value = np.repeat(weight[lo:hi], count[lo:hi])
            value *= self.gain.take(at, mode="clip")  # which is faster, and all are in range
            place = np.repeat((owner[lo:hi] - i).astype(np.int64) * width, count[lo:hi])
            place += self.posts.take(at, mode="clip")
            np.add.at(near[i:j].reshape(-1), place, value)
            i = j
        return near

    def _exact(self, who: np.ndarray, doc: np.ndarray, begin: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The scores of documents for queries, one for each, in double precision; `who` is in order. They are summed over
        a document's terms by their hashes, so copies have the same score in every shard."""
        out, edge = np.empty(len(who)), np.append(np.flatnonzero(np.diff(who, prepend=-1)), len(who))
        for lo, hi in zip(edge[:-1], edge[1:]):
            mine = slice(begin[who[lo]], begin[who[lo] + 1])
            self.weight[slot[mine]] = weight[mine]
            for i in range(lo, hi):
                held = slice(self.held_ends[doc[i]], self.held_ends[doc[i] + 1])
                out[i] = self.weight[self.held[held]] @ self.held_gain[held]
            self.weight[slot[mine]] = 0
        return out


def stored(folder: str) -> Iterator[pa.Table]:
    """The files of a written table, one after the other, as any executor reads them from the shared folder."""
    store, base = fs.FileSystem.from_uri(folder)
    for found in sorted(store.get_file_info(fs.FileSelector(base, allow_not_found=True)), key=lambda x: x.path):
        if found.is_file and found.path.endswith(".parquet"):
            yield pq.read_table(found.path, filesystem=store, partitioning=None)


def opened(folder: str, floors: str | None, k: int) -> list[Queries]:
    """The queries of a pass in blocks of TOGETHER."""
    least: dict[int, float] = {}
    for part in stored(floors) if floors else ():
        least.update(zip(part.column("number").to_pylist(), part.column("least").to_pylist()))
    parts = []
    for part in stored(folder):
        held = part.combine_chunks()
        terms, weights = (pa.concat_arrays(held.column(c).chunks) if held.num_rows else pa.array([], pa.list_(t)) for c, t in (("terms", pa.int64()), ("weights", pa.float64())))
        parts.append((held.column("number").to_numpy(), held.column("query_id").to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), weights.flatten().to_numpy()))
    if not sum(len(p[0]) for p in parts):
        return []
    numbers, names, size, terms, weights = (np.concatenate(x) for x in zip(*parts))
    del parts
    ends = np.concatenate([[0], np.cumsum(size)])
    # queries of one language ask for the same long lists, so they come together, as documents do; any order is right
    some, often = np.unique(terms[:: max(1, len(terms) >> 17)], return_counts=True)
    lead = np.sort(some[np.argsort(-often, kind="stable")[:LEADING]])
    at = np.flatnonzero(np.isin(terms, lead))
    order = similar_order(np.searchsorted(lead, terms[at]), np.searchsorted(ends, at, "right") - 1, np.ones(len(at)), size)
    out = []
    for i in range(0, len(order), TOGETHER):
        mine = order[i : i + TOGETHER]
        of = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in mine])
        out.append(Queries(numbers[mine], names[mine], terms[of].view(np.uint64), weights[of], np.cumsum([0, *size[mine]]), np.array([least.get(n, 0.0) for n in numbers[mine].tolist()]), k))
    return out


def searcher(folder: str, floors: str | None, mean: float, k: int):
    """Answers a pass's queries on the shards of a task; each shard's best are the next one's thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = None
        for batch in batches:
            for i in range(batch.num_rows):
                queries = opened(folder, floors, k) if queries is None else queries
                shard = Shard({c: batch.column(c)[i].as_py() for c in batch.schema.names}, mean)
                for q in queries:
                    shard.search(q)
                del shard  # before the next one is opened
        for q in queries or ():
            at, r = np.nonzero((q.found >= 0) & (q.best >= q.floor[:, None] - 1e-7))
            columns = q.numbers[at], q.names[at], q.found[at, r], q.best[at, r]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["number", "query_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, every: int, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The `k` best documents for each document whose id `every` divides: query_id, rank, doc_id, score, query_row.

    A query is the set of words of a whole text (lower-cased, letters and digits); all documents are searched, the
    query's own among them. Scores are BM25 with k1 1.2 and b 0.75, rounded to 9 decimals; ties go to the smaller id.
    Only documents that share a word with the query have a rank, so null and empty texts have none. Rows with a null
    id take no part; each row of a repeated id is searched and asks, and `query_row` tells such queries apart. No rows
    give no rows.

    Nothing of the queries goes through the driver: they are written in passes of about PASS_TERMS terms, which every
    task reads from the shared folder; a pass reads the index once.
    """
    # a row has megabytes: small row groups keep the writer's and the readers' buffers small
    shards = staged(index(docs, key, text), "shards", **{"parquet.block.size": "8388608", "parquet.enable.dictionary": "false"})
    n, words, held = shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1))).first()
    mean = words / n if n else 0.0
    first = F.pmod(F.xxhash64("ids"), F.lit(max(1, math.isqrt(held)))) == 0  # about the root of their number
    asked = docs.select(F.col(key).cast("long").alias("query_id"), F.col(text).alias("text")).filter(F.col("query_id") % every == 0)
    terms = staged(asked_terms(asked.withColumn("number", F.monotonically_increasing_id())), "terms")
    passes = max(1, -(-terms.count() // PASS_TERMS))
    weight = F.log1p((F.lit(float(n)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = terms.join(frequencies(shards), "term").select("number", "query_id", F.struct("term", weight.alias("weight")).alias("both"))
    # a query's terms are no more than its text's words
    whole = weighed.groupBy("number", "query_id").agg(F.collect_list("both").alias("both"))
    whole = whole.select("number", "query_id", F.col("both.term").alias("terms"), F.col("both.weight").alias("weights"), F.pmod(F.xxhash64("number"), F.lit(passes)).alias("pass"))
    folder = scratch(docs.sparkSession, "queries")
    whole.hint("rebalance").write.partitionBy("pass").parquet(folder)
    found = None
    for i in range(passes):
        mine = f"{folder}/pass={i}"
        early = staged(shards.filter(first).mapInArrow(searcher(mine, None, mean, k), HITS), "hits", small=True)
        # what the first shards' k-th best scores already say, no other shard need beat again
        best = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
        least = early.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("number", F.col("score").alias("least"))
        least = staged(least, "floors", small=True)
        late = staged(shards.filter(~first).mapInArrow(searcher(mine, _paths[least], mean, k), HITS), "hits", small=True)
        discard(least)
        part = early.unionAll(late)
        found = part if found is None else found.unionAll(part)
    discard(shards, terms)
    best = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "score", F.col("number").alias("query_row"))
