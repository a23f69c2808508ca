"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits into one sequence. The program asks for the fewest sequences that
cover every length as often as it occurs. Its size depends on the capacity alone, as it sees only the histogram of
lengths, so the driver solves it for any number of documents: multiplicative weights give each length a price, a
knapsack dynamic program finds the dearest configuration under these prices, and lengths that it covers get cheaper.
The averaged solution is rounded down to whole sequences; what that leaves is placed by best fit decreasing, again on
counts of lengths. Pieces then look up their place by length and rank within the length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import fresh, staged

#: Rows that share a length and a salt, about; their ranks are counted in one task.
RANK_GROUP = 20_000


@dataclass(frozen=True)
class Segment:
    """Pieces of `length` with ranks first..last-1 lie side by side, `each` to a sequence, from `sequence` on at `offset`."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def dearest(prices: np.ndarray, capacity: int) -> Counter:
    """The configuration of the highest price that fits into `capacity`; prices[l] is the price of length l."""
    best, chosen = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        worth = prices[1 : room + 1] + best[room - 1 :: -1][:room]
        k = int(worth.argmax())
        best[room], chosen[room] = worth[k], k + 1
    out, room = Counter(), capacity
    while room:
        length = int(chosen[room])
        if prices[length] > 0:
            out[length] += 1
        room -= length
    return out


def fractional(counts: np.ndarray, capacity: int, rounds: int, step: float) -> list[tuple[Counter, float]]:
    """Configurations and how often each is used, covering no length more often than it occurs."""
    lengths = np.flatnonzero(counts)
    weight, covered, used = np.ones(len(lengths)), np.zeros(len(lengths)), []
    place = {int(x): i for i, x in enumerate(lengths)}
    for _ in range(rounds if len(lengths) else 0):
        prices = np.zeros(capacity + 1)
        prices[lengths] = weight / counts[lengths]
        config = dearest(prices, capacity)
        for length in config:  # never more of a length than there is
            config[length] = min(config[length], int(counts[length]))
        share = min(counts[x] / n for x, n in config.items())
        for x, n in config.items():
            covered[place[x]] += share * n / counts[x]
            weight[place[x]] *= (1 - step) ** (share * n / counts[x])
        used.append((config, share))
        weight /= weight.max()
    most = covered.max() if used else 1
    return [(config, share / most) for config, share in used]


def best_fit(counts: Counter, capacity: int) -> Counter:
    """Best fit decreasing on counts: bins that hold the same lengths are one group."""
    bins: dict[int, Counter] = {}  # room left -> contents -> number of bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = min((room for room in bins if room >= length), default=None)
            if fits is None:
                each = min(left, capacity // length)
                n = left // each
                bins.setdefault(capacity - each * length, Counter())[((length, each),)] += n
                left -= n * each
                continue
            held, n = bins[fits].popitem()
            each = min(fits // length, left)
            n_used = min(n, left // each)
            if n > n_used:
                bins[fits][held] = n - n_used
            if not bins[fits]:
                del bins[fits]
            bins.setdefault(fits - each * length, Counter())[(*held, (length, each))] += n_used
            left -= n_used * each
    out: Counter = Counter()
    for group in bins.values():
        for held, n in group.items():
            total: Counter = Counter()
            for length, each in held:
                total[length] += each
            out[tuple(sorted(total.items(), reverse=True))] += n
    return out


def plan(histogram: dict[int, int], capacity: int, rounds: int = 400, step: float = 0.25) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations, each as (length, copies) pairs, and the number of sequences made by each; every piece has its place."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into {capacity}")
        counts[length] = n
    made: Counter = Counter()
    if counts[capacity]:
        made[((capacity, 1),)] = int(counts[capacity])
    left = counts.copy()
    left[capacity] = 0
    merged: Counter = Counter()
    for config, share in fractional(left, capacity, rounds, step):
        merged[tuple(sorted(config.items(), reverse=True))] += share
    for config, share in sorted(merged.items(), key=lambda x: (-x[1], x[0])):
        whole = min(int(share), *(int(left[x]) // n for x, n in config))
        if whole:
            made[config] += whole
            for x, n in config:
                left[x] -= whole * n
    made.update(best_fit(Counter({int(x): int(left[x]) for x in np.flatnonzero(left)}), capacity))
    return sorted(made.items(), reverse=True)


def segments(made: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[Segment]:
    """The places that a plan gives to ranks."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for config, n in made:
        offset = 0
        for length, each in config:
            out.append(Segment(length, rank[length], rank[length] + n * each, sequence, each, offset))
            rank[length] += n * each
            offset += length * each
        sequence += n
    return sorted(out, key=lambda s: (s.length, s.first))


def tokenize(docs: DataFrame, tokenizer: str, pattern: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32, salt, and `ids` where asked for.

    A document's ids end with `end_id`; a null or empty text is that id alone. One of over `capacity` ids is cut into
    pieces of `capacity`, the first of which takes what is left over.
    """
    fields = [docs.schema[key]] + [T.StructField(n, k) for n, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("salt", T.LongType()))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = bpe.file_encoder(tokenizer, pattern), 0
        for batch in batches:
            for part, texts in bpe.sliced(batch, "_text"):
                owner, pieces, starts, ids = [], [], [], []
                for i, raw in enumerate(encoder.encode(texts)):
                    raw += end
                    n = len(raw) // 4
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(i)
                        pieces.append(k)
                        starts.append(a)
                        ids.append(raw[4 * a : 4 * b])
                salt = (np.arange(row, row + len(ids), dtype=np.int64) * 2654435761) & 0x7FFFFFFF
                row += len(ids)
                columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(salt)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, schema.names)

    return docs.select(docs[key], docs[text].alias("_text")).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int, length: str = "length", salt: str = "salt", order: list[str] | None = None) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`. `pieces` must be a written table, as it is read twice.

    Ranks within a length are counted by length and salt, so that a length that many pieces share is dealt to many
    tasks; an empty table gives an empty result, and repeated rows get places of their own. Nulls in `order` columns
    sort first.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    salts = max(32, -(-total // RANK_GROUP))
    group, rank, before, n = fresh(pieces, "group", "rank", "before", "n")
    dealt = pieces.withColumn(group, F.pmod(F.col(salt), F.lit(salts)))
    sizes = dealt.groupBy(length, group).agg(F.count(F.lit(1)).alias(n))
    histogram = {int(r[0]): int(r[1]) for r in sizes.groupBy(length).agg(F.sum(n)).collect()}  # at most `capacity` rows
    found = segments(plan(histogram, capacity))
    reach = np.int64(1) << 40
    starts = np.array([s.length * reach + s.first for s in found], np.int64)
    table = np.array([(s.first, s.sequence, s.each, s.offset) for s in found], np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((starts, table))  # bounded by the capacity and the rounds
    earlier = Window.partitionBy(length).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(length, group, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy(length, group).orderBy(*(order or [c for c in pieces.columns if c != "ids"]))
    ranked = dealt.withColumn(rank, F.row_number().over(within)).join(offsets, [length, group])
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, table = shared.value
        for batch in batches:
            size, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "_rank"))
            first, sequence, each, offset = table[np.searchsorted(starts, size * reach + number, "right") - 1].T
            at = number - first
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence + at // each), pa.array(offset + at % each * size)], schema.names)

    return ranked.select(*names, (F.col(before) + F.col(rank) - 1).cast("long").alias("_rank")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequence and offset: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id; a null key is kept; equal rows are packed each; no rows give no rows; other
    columns are ignored. With `keep_ids` the pieces carry their ids for `sequences`.
    """
    pieces = staged(tokenize(docs, tokenizer, pattern, capacity, end_id, key, keep_ids=keep_ids), "pieces", small=not keep_ids)
    return place(pieces, capacity, order=["salt", key, "piece"]).drop("salt")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (array of int) of each sequence, from pieces that carry `ids`; a sequence is one capacity at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    schema = "sequence_id long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int32) for x in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return parts.mapInArrow(run, schema)
