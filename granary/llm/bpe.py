"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A byte-level tokenizer spells every byte as one character; this module builds that byte-to-character table, turns a
rank file into a vocabulary and merges, and hands both to the library. Decoding goes the other way by a table from id
to bytes, so a character whose bytes fall into several tokens comes back whole.

Every distinct match of the splitting pattern is encoded by the library once and remembered (at most MEMO_LIMIT
matches in a worker), because words repeat far more often than they are new.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMO_LIMIT = 300_000
#: Texts are taken from an Arrow batch in slices of at most so many characters, which bounds what a worker holds.
SLICE_CHARS = 1_000_000
#: The pattern of byte-level BPE, for which plain texts have a quicker equal.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that every Unicode version in use puts into the same class of the pattern.
PLAIN = [*range(0x558), *range(0x2010, 0x2028), 0x20AC]
odd = re.compile("[^" + re.escape("".join(map(chr, PLAIN))) + "]").search


def plain_pattern() -> re.Pattern:
    """BYTE_LEVEL over PLAIN code points, with its classes spelled out."""
    kind = {c: unicodedata.category(c)[0] for c in map(chr, PLAIN)}
    letter, number = (re.escape("".join(c for c, k in kind.items() if k == name)) for name in "LN")
    space = re.escape("\t\n\x0b\x0c\r \x85\xa0")
    spelled = BYTE_LEVEL.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(spelled.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = [""] * 256
    for b in prints:
        table[b] = chr(b)
    for extra, b in enumerate(b for b in range(256) if not table[b]):
        table[b] = chr(0x100 + extra)
    return table


#: From a byte, as the character of its number, to the character that stands for it.
CHARACTERS = dict(enumerate(byte_characters()))
SPACE = CHARACTERS[ord(" ")]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the library that merges as the ranks say: the pair whose joined bytes rank lowest goes first."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    spelled = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        halves = [(token[:i], token[i:]) for i in range(1, len(token))]
        halves = [(a, b) for a, b in halves if a in ranks and b in ranks]
        merges += [(spelled[a], spelled[b]) for a, b in sorted(halves, key=lambda h: (ranks[h[0]], ranks[h[1]]))]
    out = Tokenizer(models.BPE({spelled[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    out.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class Encoder:
    """Encodes texts to ids, kept as little-endian unsigned 32-bit bytes.

    Matches of plain texts are found here; texts with a character outside PLAIN, or with one of the tokenizer's added
    tokens, the library splits and encodes whole.
    """

    def __init__(self, tokenizer, pattern: str):
        if pattern != BYTE_LEVEL:
            raise ValueError("matches are found for the pattern of byte-level BPE only")
        self.tokenizer, self.find = tokenizer, plain_pattern().findall
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Encodes matches not seen yet; a match is split no further, so the library's model alone says its tokens."""
        memo, tokens_of = self.memo, self.tokenizer.model.tokenize
        if len(memo) + len(pieces) > MEMO_LIMIT:  # short matches recur most
            kept = {p: ids for p, ids in memo.items() if len(p) < 8}
            memo.clear()
            if len(kept) + len(pieces) <= MEMO_LIMIT:
                memo.update(kept)
        for p in pieces:
            if p.isascii() and p.lstrip(" ").isalnum():  # only the space before a word has another character
                spelled = p.replace(" ", SPACE)
            else:
                spelled = p.encode().decode("latin-1").translate(CHARACTERS)
            ids = [t.id for t in tokens_of(spelled)]
            memo[p] = pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) if (t.isascii() or not odd(t)) and not any(a in t for a in self.added) else None for t in texts]
        wanted = set().union(*(p for p in found if p))
        new = wanted.difference(self.memo)
        if new:
            self._learn(new if len(self.memo) + len(new) <= MEMO_LIMIT else wanted)
        get = self.memo.__getitem__
        out = [b"".join(map(get, p)) if p is not None else b"" for p in found]
        for i, p in enumerate(found):
            if p is None:
                out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


class Decoder:
    """Turns ids back into bytes by the reversed byte table."""

    def __init__(self, tokenizer):
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.table: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.table[i] = bytes(back[c] for c in token)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


_kept: dict[tuple, tuple] = {}


def rank_coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """The coder of a rank file, built once in a worker."""
    if ("ranks", path, pattern) not in _kept:
        tokenizer = tokenizer_of_ranks(read_ranks(path), pattern)
        _kept["ranks", path, pattern] = Encoder(tokenizer, pattern), Decoder(tokenizer)
    return _kept["ranks", path, pattern]


def file_encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a tokenizer file whose splitting pattern is `pattern`; its added tokens keep their ids wherever a text spells them."""
    if ("file", path, pattern) not in _kept:
        from tokenizers import Tokenizer

        _kept["file", path, pattern] = (Encoder(Tokenizer.from_file(path), pattern),)
    return _kept["file", path, pattern][0]


def sliced(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of at most SLICE_CHARS characters (or one row), with their texts; null is the empty text."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        held = np.searchsorted(np.cumsum(lengths[at:]), SLICE_CHARS, "right")
        part = batch.slice(at, max(1, int(held)))
        yield part, [x or "" for x in part.column(text).to_pylist()]
        at += part.num_rows


def token_spans(coder: Encoder, text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Ids and the span of characters of each; tokens that share a split character share its span."""
    ids, spans = [], []
    for spelled, (start, end) in coder.tokenizer.pre_tokenizer.pre_tokenize_str(text):
        owner = [start + i for i, c in enumerate(text[start:end]) for _ in c.encode()]  # the character that each byte is of
        at = 0
        for token in coder.tokenizer.model.tokenize(spelled):
            n = len(token.value)  # a character stands for a byte
            ids.append(token.id)
            spans.append((owner[at], owner[at + n - 1] + 1))
            at += n
    return ids, spans


def encode(docs: DataFrame, ranks: str, pattern: str, keep: list[str], text: str = "text", spans: bool = False) -> DataFrame:
    """`keep` columns of `docs` with `ids` (array of int), and with `spans` their character spans where asked for.

    Null texts count as empty and give no ids. Repeated rows stay repeated; other columns are ignored.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("spans", span)] * spans
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = rank_coder(ranks, pattern)
        for batch in batches:
            for part, texts in sliced(batch, "_text"):
                columns = [part.column(c) for c in keep]
                if spans:
                    both = [token_spans(coder, t) for t in texts]
                    columns += [pa.array([x for x, _ in both], pa.list_(pa.int32()))]
                    columns += [pa.array([[{"start": a, "end": b} for a, b in y] for _, y in both], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                else:
                    got = coder.encode(texts)
                    ends = np.cumsum([0, *(len(x) // 4 for x in got)])
                    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """`keep` columns with `bytes`, the bytes that the ids stand for; null ids give none."""
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coder = rank_coder(ranks, pattern)
        for batch in batches:
            back = [coder.decode(x or ()) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(back, pa.binary())], schema.names)

    return encoded.select(*keep, encoded[ids].alias("_ids")).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its id count, the SHA-256 of its ids in decimal joined by spaces, and that of the decoded bytes.

    Encodes and decodes a slice at a time, so that no ids leave the worker. A null or empty text has no ids, and both
    digests are those of the empty string.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = rank_coder(ranks, pattern)
        decimal = [str(i) for i in range(len(decoder.table))]
        for batch in batches:
            for part, texts in sliced(batch, "_text"):
                count, first, second = [], [], []
                for ids in encoder.encode(texts):
                    numbers = np.frombuffer(ids, "<u4").tolist()
                    count.append(len(numbers))
                    first.append(hashlib.sha256(" ".join(map(decimal.__getitem__, numbers)).encode()).hexdigest())
                    second.append(hashlib.sha256(decoder.decode(numbers)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(first), pa.array(second)], schema.names)

    return docs.select(docs[key], docs[text].alias("_text")).mapInArrow(run, schema)
