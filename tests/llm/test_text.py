"""BPE, packing, sharding."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import bpe, packing, sharding
from granary.llm.common import staged

RANKS, TOKENIZER, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
LONG = "words and more words, " * 20_000
EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "short"), (4, "short"), (None, "no key"), (5, LONG), (6, "é世界🙂 <|endoftext|> it's 12³"), (7, "\u0558 odd \U0003e25a letters")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, a repeated row, and columns named like results, as a table on disk."""
    rows = [(k, t, 1, 2.0, "x", True) for k, t in EDGE]
    return staged(spark.createDataFrame(rows, "doc_id long, text string, shard int, slot double, sequence_id string, rank boolean").repartition(3), "edge")


@pytest.fixture(scope="module")
def known():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_codes_like_the_known_library(known, text):
    for coder in (bpe.rank_coder(RANKS, PATTERN)[0], bpe.file_encoder(TOKENIZER, PATTERN)):
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == known.encode_ordinary(text)
    encoder, decoder = bpe.rank_coder(RANKS, PATTERN)
    ids, spans = bpe.token_spans(encoder, text)
    assert ids == known.encode_ordinary(text) and decoder.decode(ids) == text.encode()
    assert all(a < b for a, b in spans) and (not text or (spans[0][0], max(b for _, b in spans)) == (0, len(text)))


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    texts = ["a b<|endoftext|>c", "<|endoftext|>", "é世界🙂 <|endoftext|> it's 12³", "<|endoftext|><|endoftext|> \n", "<|endoftext|", "plain"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 275, 50256, 66]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.file_encoder(TOKENIZER, PATTERN).encode(texts)] == want
    docs = staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "added")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs, TOKENIZER, PATTERN).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(want)}


def test_encode_and_decode(spark, edge, known):
    held = bpe.encode(edge, RANKS, PATTERN, ["doc_id"], spans=True)
    back = bpe.decode(held, RANKS, PATTERN, ["doc_id"])
    want = Counter((k, (t or "").encode()) for k, t in EDGE)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == want
    digests = {r.doc_id: r for r in bpe.round_trip_digests(edge, RANKS, PATTERN).collect()}
    assert digests[5].n_tokens == len(known.encode_ordinary(LONG)) and digests[1].n_tokens == digests[2].n_tokens == 0
    assert bpe.round_trip_digests(edge.limit(0), RANKS, PATTERN).count() == 0


def check_places(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pack(edge, known):
    packed = packing.pack(edge, TOKENIZER, PATTERN, keep_ids=True)
    rows = packed.collect()
    check_places(rows, 1024)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len(pieces[4]) == 2 and {r.piece for r in pieces[4]} == {0} and len(pieces[None]) == 1
    ids = known.encode_ordinary(LONG) + [2]
    cut = sorted(pieces[5], key=lambda r: r.piece)
    assert [r.length for r in cut[1:]] == [1024] * (len(cut) - 1) and sum(r.length for r in cut) == len(ids)
    for r in cut:
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert [r.length for r in pieces[1] + pieces[2]] == [1, 1]
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in cut:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]
    assert packing.pack(edge.limit(0), TOKENIZER, PATTERN).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=12))
def test_plan_places_every_piece_once(histogram):
    made = packing.plan(histogram, 40, rounds=30)
    used = Counter()
    for config, n in made:
        assert sum(x * k for x, k in config) <= 40
        for x, k in config:
            used[x] += k * n
    assert used == Counter(histogram)
    ranks = {}
    for s in packing.segments(made):
        assert s.first == ranks.get(s.length, 0)
        ranks[s.length] = s.last
    assert ranks == histogram


def test_plan_is_near_the_bound():
    random.seed(3)
    histogram = Counter(min(1024, int(random.lognormvariate(5.5, 1)) + 1) for _ in range(20_000))
    made = packing.plan(histogram, 1024)
    bound = -(-sum(x * n for x, n in histogram.items()) // 1024)
    assert sum(n for _, n in made) <= bound * 1.003 + 1


def test_dearest_configuration_is_best():
    prices = np.zeros(31)
    prices[[7, 11, 13]] = 3.0, 5.2, 6.1
    config = packing.dearest(prices, 30)
    best = max(3.0 * a + 5.2 * b + 6.1 * c for a in range(5) for b in range(3) for c in range(3) if 7 * a + 11 * b + 13 * c <= 30)
    assert sum(prices[x] * n for x, n in config.items()) == pytest.approx(best)


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shard(edge, shards):
    rows = sharding.shard(edge, shards).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(EDGE)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min([*counts.values(), *[0] * (len(counts) < shards)]) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert sharding.shard(edge, shards).columns.count("shard") == 1
    assert sharding.shard(edge.limit(0), shards).count() == 0


def test_shard_is_random_and_repeatable(spark):
    df = staged(spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text"), "range")
    one, again, other = ({r.doc_id: (r.shard, r.slot) for r in sharding.shard(df, 8, seed=s).collect()} for s in (1, 1, 2))
    assert one == again != other
    spread = Counter((d % 2, s) for d, (s, _) in one.items())
    assert all(200 < n < 300 for n in spread.values())


def test_write_shards(spark, tmp_path):
    df = staged(spark.range(100).selectExpr("id as doc_id", "'t' as text"), "range")
    sharding.write_shards(df, f"file://{tmp_path}/s", 5)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.groupBy("shard").count().filter("count = 20").count() == 5
    assert back.agg(F.count_distinct("doc_id")).first()[0] == 100


def test_digests_of_the_query_like_the_known_library(spark, known):
    from granary.llm.queries import op4_byte_bpe

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op4_byte_bpe(spark, folder).collect()}
    hexed = lambda data: hashlib.sha256(data).hexdigest()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = known.encode_ordinary(r.text or "")
        assert got.pop(r.doc_id) == (len(ids), hexed(" ".join(map(str, ids)).encode()), hexed((r.text or "").encode()))
    assert not got


def test_law_of_the_sharding_query(spark):
    from granary.llm.queries import SHARDS, op1_sharding

    folder = "/root/testdata/sf0.01"
    got = op1_sharding(spark, folder).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()} and len(got) == len(texts)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(SHARDS)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, n in counts.items() for i in range(n))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
