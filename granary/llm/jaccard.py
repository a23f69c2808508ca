"""N-gram Jaccard join by MinHash banding.

Documents are sets of word n-grams. Documents with the same set are one class from the start; only one of each class
goes on. Bands of MinHash values put sets that are likely to be similar into a bucket, by a shuffle on the bands'
hashes. Buckets are not expanded into pairs: each set is tied to its bucket's first, which gives clusters that hold
every pair of a bucket. A cluster, or each bucket of a cluster that is too large for that, is cut into blocks of bounded
size, and each pair of blocks is one group that verifies the pairs which share a band on their full sets and returns a
row per set: how many it is linked to, and one of those that it hangs together with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import discard, fresh, staged
from .components import components

#: Sets in a block, about, and n-grams of its sets, unless one set alone has more.
BLOCK = 256
BLOCK_GRAMS = 1 << 20
#: Blocks beyond which a cluster is verified bucket by bucket.
LARGE = 16
COLUMNS = 4096
#: More n-grams than this at once are hashed in parts.
PART = 1 << 14


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of `rows` values so that a pair at the threshold shares one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, (1 << 64) - 1, n, np.uint64) | np.uint64(1)


def ngram_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams. Words are lower-cased and end at white space; a
    text of fewer than `size` words is one n-gram, and one without words has none."""
    found = [t.lower().split() for t in texts]
    lengths = [len(x) for x in found]
    codes, unique = pd.factorize(np.array([w for x in found for w in x], object))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in unique), np.uint64, len(unique))[codes] if len(codes) else np.zeros(0, np.uint64)
    factors, out, at = multipliers(size, 5), [], 0
    with np.errstate(over="ignore"):
        for n in lengths:
            h = hashes[at : at + n]
            at += n
            if not n:
                out.append(h)
            elif n < size:
                out.append(mixed((h * factors[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
            else:
                total = np.zeros(n - size + 1, np.uint64)
                for i, f in enumerate(factors):
                    total += h[i : n - size + 1 + i] * f
                out.append(np.unique(mixed(total)))
    return out


def band_hashes(grams: np.ndarray, bands: int, rows: int, seed: int = 3) -> np.ndarray:
    """The hash of each band of `rows` MinHash values."""
    factors, adds = multipliers(bands * rows, seed), multipliers(bands * rows, seed + 1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        step = max(1, PART // (bands * rows) * 8)
        for at in range(0, len(grams), step):
            np.minimum(least, (grams[at : at + step, None] * factors + adds).min(0), out=least)
        weights = multipliers(rows, seed + 2)
        return mixed((least.reshape(bands, rows) * weights).sum(1, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """key, digest (of the text), gram_set (digest of the set, null without words), n_grams, bands."""
    schema = T.StructType([docs.schema[key], T.StructField("digest", T.StringType()), T.StructField("gram_set", T.BinaryType()), T.StructField("n_grams", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in bpe.sliced(batch, "_text"):
                sets = ngram_sets(texts, size)
                names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                hashes = [band_hashes(s, bands, rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], schema.names)

    return docs.select(docs[key], F.md5(F.coalesce(docs[text], F.lit(""))).alias("_digest"), docs[text].alias("_text")).mapInArrow(run, schema)


def common_grams(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each set of `left` has in common with each of `right` (places in `sets`)."""
    both = np.unique(np.concatenate([left, right]))
    place = {int(x): i for i, x in enumerate(both)}
    rows, columns = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both]), np.concatenate([sets[i] for i in both])
    _, columns, times = np.unique(columns, return_inverse=True, return_counts=True)
    again = times[columns] > 1  # an n-gram of one set alone is in no intersection
    rows, columns = rows[again], columns[again]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    _, columns = np.unique(columns, return_inverse=True)
    a, b = np.array([place[int(i)] for i in left]), np.array([place[int(i)] for i in right])
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(columns.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(columns, [at, at + COLUMNS])
        held = np.zeros((len(both), COLUMNS), np.float32)
        held[rows[lo:hi], columns[lo:hi] - at] = 1
        out += held[a] @ held[b].T
    return out


def links_of(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, band: int = -1) -> np.ndarray:
    """Which sets of `left` are linked to which of `right`: they share a band, and their Jaccard similarity is enough.
    With `band`, it must be the first that they share, so that a pair counts in one bucket only."""
    earlier = np.zeros((len(left), len(right)), bool)
    for k in range(bands.shape[1] if band < 0 else band):
        earlier |= bands[left, k][:, None] == bands[right, k][None, :]
    close = earlier if band < 0 else (bands[left, band][:, None] == bands[right, band][None, :]) & ~earlier
    close &= left[:, None] != right[None, :]
    sizes = np.array([len(s) for s in sets])
    low, high = np.minimum(sizes[left][:, None], sizes[right][None, :]), np.maximum(sizes[left][:, None], sizes[right][None, :])
    close &= low >= threshold * high - 1e-9  # sets of such different sizes can't be similar
    i, j = np.nonzero(close)
    if len(i) <= 4 * (len(left) + len(right)):
        shared = np.array([len(np.intersect1d(sets[left[x]], sets[right[y]], assume_unique=True)) for x, y in zip(i, j)], float)
    else:
        shared = common_grams(sets, left, right)[i, j].astype(float)
    enough = shared >= threshold * (sizes[left[i]] + sizes[right[j]] - shared) - 1e-9
    close[i, j] = enough
    return close


def verify(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One pair of blocks: for every linked set its linked documents and sets here, and the smallest set that it hangs together with."""
    sets = [np.asarray(x, np.int64).view(np.uint64) for x in group["grams"]]
    bands = np.array([np.asarray(x, np.int64) for x in group["bands"]])
    node, copies, block = group["node"].to_numpy(), group["copies"].to_numpy(), group["block"].to_numpy()
    low, high, band = (int(group[c].iloc[0]) for c in ("low", "high", "band"))
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    docs, others, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.arange(len(node))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if len(left) and len(right):
        close = links_of(sets, bands, left, right, threshold, band)
        docs[left] += close @ copies[right]
        others[left] += close.sum(1)
        if low != high:
            docs[right] += close.T @ copies[left]
            others[right] += close.sum(0)
        for i, row in enumerate(close):
            for j in np.flatnonzero(row):
                a, b = sorted((top(left[i]), top(right[j])), key=lambda x: node[x])
                root[b] = a
    linked = np.flatnonzero(others)
    return pd.DataFrame({"node": node[linked], "docs": docs[linked], "others": others[linked], "first": [node[top(x)] for x in linked]}).astype("int64")


def join(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, class_id, n_links, n_set_links.

    Two documents are linked if the sets of their word n-grams have a Jaccard similarity of `threshold` or more.
    `n_links` counts a document's links to other documents, copies included, and `n_set_links` those to other sets of
    n-grams. Documents that links lead between are a class; `class_id` is its smallest key. Links hold for hashes of 64
    bits of n-grams; a pair at the threshold is found with probability `recall`, and more similar ones all but surely.

    Null and empty texts, or texts of white space, link to nothing, not to each other, and are classes of their own.
    Texts shorter than an n-gram are one n-gram. A null key is kept but names no class unless no other key is in it;
    repeated rows are copies of each other. No rows give no rows; other columns are ignored.
    """
    signed, told = linked(docs, key, **options)
    zero = F.lit(0).cast("long")
    # documents without words match no set, so they need no join that would send them all to one task
    found = signed.filter(F.col("gram_set").isNotNull()).join(told, "gram_set").select(
        key,
        F.coalesce(F.col("first")["key"], key).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("docs", zero), zero).alias("n_links"),
        F.coalesce("others", zero).alias("n_set_links"),
    )
    lone = signed.filter(F.col("gram_set").isNull()).select(key, F.col(key).alias("class_id"), zero.alias("n_links"), zero.alias("n_set_links"))
    return found.unionAll(lone)


def linked(docs: DataFrame, key: str, text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """The signature of every document, and for every set of n-grams its copies, its links to other documents (`docs`)
    and sets (`others`), and the first document of its class: key, or null if no key is in it, and digest of the text."""
    bands = bands_for(threshold, recall, rows)
    signed = signatures(docs, key, text, size, bands, rows).withColumn("node", F.monotonically_increasing_id())
    signed = staged(signed, "signatures", small=True)
    sets = signed.filter(F.col("gram_set").isNotNull()).groupBy("gram_set").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "digest")).alias("first"))
    sets = staged(sets, "sets")
    ones = staged(signed.join(sets.select("node", "copies"), "node"), "ones")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    spread = ones.select("node", "n_grams", F.posexplode("bands").alias("band", "hash"))
    heads = spread.groupBy("band", "hash").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"), blocks).filter("n > 1")
    ties = spread.join(heads, ["band", "hash"]).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    clusters = components(ties)
    sizes = clusters.join(ones.select("node", "n_grams"), "node").groupBy("root").agg(blocks)
    dealt = staged(clusters.join(sizes, "root"), "dealt")
    # the groups in which a node meets others: its cluster's pairs of blocks, or those of its buckets
    small = dealt.filter(F.col("blocks") <= LARGE).select("node", F.col("root").alias("group"), F.lit(-1).alias("band"), "blocks")
    buckets = spread.drop("n_grams").join(dealt.filter(F.col("blocks") > LARGE).select("node"), "node").join(heads, ["band", "hash"])
    large = buckets.select("node", F.xxhash64("band", "hash").alias("group"), "band", "blocks")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    places = small.unionAll(large).withColumn("block", block)
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct("group", "band", "block", F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    visits = places.groupBy("node").agg(F.flatten(F.collect_list(meets)).alias("visits"))
    wanted = ones.join(visits, "node").select(F.col(key).alias("_key"), F.col("digest").alias("_digest"), "node", "copies", "bands", "visits")
    texts = docs.select(docs[key].alias("_own"), F.md5(F.coalesce(docs[text], F.lit(""))).alias("_of"), docs[text].alias("_text"))
    held = texts.join(wanted, (F.col("_of") == F.col("_digest")) & F.col("_own").eqNullSafe(F.col("_key")))
    full = grams_of(held, size).dropDuplicates(["node"])
    paired = full.select("node", "copies", "bands", "grams", F.explode("visits").alias("visit")).select("node", "copies", "bands", "grams", "visit.*")
    checked = paired.groupBy("group", "band", "low", "high").applyInPandas(lambda g: verify(g, threshold), "node long, docs long, others long, first long")
    checked = staged(checked, "checked")
    links = checked.groupBy("node").agg(F.sum("docs").alias("docs"), F.sum("others").alias("others"))
    classes = components(checked.select(F.col("node").alias("a"), F.col("first").alias("b")))
    named = sets.join(classes, "node").groupBy("root").agg(F.min("first").alias("class_first"))
    known = links.join(classes, "node").join(named, "root").select("node", "docs", "others", "class_first")
    told = staged(sets.join(known, "node", "left").select("gram_set", "copies", "docs", "others", F.coalesce("class_first", "first").alias("first")), "told")
    discard(sets, ones, dealt, checked)
    return signed, told


def grams_of(held: DataFrame, size: int) -> DataFrame:
    """`held` without its text and keys, with `grams`, the hashes of the text's n-grams."""
    names = ["node", "copies", "bands", "visits"]
    schema = T.StructType([held.schema[n] for n in names] + [T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in bpe.sliced(batch, "_text"):
                sets = [s.view(np.int64) for s in ngram_sets(texts, size)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(sets, pa.list_(pa.int64()))], schema.names)

    return held.select(*names, "_text").mapInArrow(run, schema)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of `docs` for each class of near copies: that with the smallest key, and of those the smallest by the
    digest of its text. Rows equal in both are told apart by their other columns, of which the smallest stay.

    A row without a key stays only where its class has no key. Rows without words are copies of nothing and all stay.
    """
    mark, blank = fresh(docs, "mark", "blank")
    signed, told = linked(docs, key, text, **options)

    def marked(of: Column, digest: Column) -> Column:
        return F.concat(digest, F.coalesce(F.concat(F.lit("="), of.cast("string")), F.lit("-")))

    first = staged(told.select(marked(F.col("first")["key"], F.col("first")["digest"]).alias(mark)).distinct(), "first")
    lone = signed.filter(F.col("gram_set").isNull()).select(marked(F.col(key), F.col("digest")).alias(mark)).distinct()
    held = docs.withColumn(mark, marked(F.col(key), F.md5(F.coalesce(F.col(text), F.lit("")))))
    nothing = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""  # may be very many, and need no join
    full = held.filter(~nothing)
    order = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    # both joins read one shuffle of the documents, by which the rows of a mark are already together
    once = full.join(first, mark, "left_semi").groupBy(mark).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias(blank)).select(f"{blank}.*")
    odd = full.join(lone, mark, "left_semi").select(*docs.columns)
    return once.unionByName(odd).unionByName(docs.filter(nothing))
