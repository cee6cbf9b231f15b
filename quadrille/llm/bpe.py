"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

Of every prefix of a piece (a match of the split pattern) exactly one token can be the last of the prefix's encoding.
PrefixEncoder stores that token for each prefix: a token t that ends a prefix fits if the merges of its own bytes give
t alone and if the merges of the bytes of (the last token before t, t) give just these two. An append only adds
prefixes; an edit keeps all prefixes before it. Walking back from the end reads off the ids, which are those of the
merges by lowest rank. A piece that is itself a token is that token, as in the library whose ids these are.

Null text: as an empty one (no ids). Any text decodes to its own UTF-8 bytes. Repeated rows each get their own result;
extra columns are ignored; whole texts are read, pieces of any length are encoded in time linear in their length.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import map_rows, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bounds of what a worker remembers: pieces with their ids, pairs with their verdict, last tokens of prefixes.
KNOWN_PIECES, KNOWN_PAIRS, KNOWN_PREFIXES, KNOWN_LENGTH = 300_000, 500_000, 500_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: merge the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
    none, get = 1 << 60, ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


class Vocabulary:
    """Ranks, the bytes of each id, and remembered verdicts on tokens and pairs."""

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.bytes[i] = b
        #: Every ending of a token: the token that it is, or -1.
        self.endings = {b[i:]: -1 for b in self.ranks for i in range(len(b))} | self.ranks
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[bytes, int] = {}

    def fits(self, before: int, token: int) -> bool:
        """Whether `token` can follow `before` (-1: nothing) in an encoding."""
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        own = self.bytes[token]
        ok = self.pairs.get((-1, token))
        if ok is None:
            ok = self.pairs[-1, token] = merged(own, self.ranks) == [token]
        if ok and before >= 0:
            ok = merged(self.bytes[before] + own, self.ranks) == [before, token]
        self.pairs[before, token] = ok
        return ok

    def last(self, piece: bytes, end: int, before: list[int]) -> int:
        """The last token of piece[:end]; before: the last tokens of all shorter prefixes."""
        endings, pairs = self.endings.get, self.pairs.get
        for start in range(end - 1, -1, -1):
            token = endings(piece[start:end])
            if token is None:
                break
            if token >= 0:
                ok = pairs((before[start], token))
                if ok or ok is None and self.fits(before[start], token):
                    return token
        raise ValueError("a byte has no token")

    def short(self, piece: bytes) -> list[int]:
        """The ids of a short piece; what is known of its prefixes, from any piece, is used again."""
        known, last = self.prefixes, [-1]
        if len(known) >= KNOWN_PREFIXES:
            known.clear()
        for end in range(1, len(piece) + 1):
            token = known.get(piece[:end])
            if token is None:
                token = known[piece[:end]] = self.last(piece, end, last)
            last.append(token)
        return walked(last, self.bytes)


def walked(last: list[int], of: list[bytes]) -> list[int]:
    """Ids read off from the end."""
    out, at = [], len(last) - 1
    while at:
        out.append(last[at])
        at -= len(of[last[at]])
    return out[::-1]


class PrefixEncoder:
    """The last token of every prefix of a growing or edited piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b"") -> None:
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> PrefixEncoder:
        piece = self.piece + more
        for end in range(len(self.piece) + 1, len(piece) + 1):
            self.last.append(self.vocabulary.last(piece, end, self.last))
        self.piece = piece
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixEncoder:
        """Replaces piece[start:end]; only prefixes beyond start are encoded anew."""
        rest = self.piece[end:]
        self.piece, self.last = self.piece[:start], self.last[: start + 1]
        return self.append(new + rest)

    def ids(self) -> list[int]:
        return walked(self.last, self.vocabulary.bytes)


class Codec:
    """Encodes and decodes whole texts; remembers the ids of short pieces."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        raw = piece.encode("utf-8", "replace")
        one = self.vocabulary.ranks.get(raw)
        short = len(raw) <= KNOWN_LENGTH
        ids = [one] if one is not None else self.vocabulary.short(raw) if short else PrefixEncoder(self.vocabulary, raw).ids()
        out = struct.pack(f"<{len(ids)}I", *ids)
        if short:
            if len(self.known) >= KNOWN_PIECES:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        get = self.known.get
        return np.frombuffer(b"".join([get(p) or self.piece(p) for p in self.split(text)]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}  # one for each worker


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, carry: list[str], path: str, with_ids: bool = True) -> DataFrame:
    """The columns `carry`, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def work(batch):
        own, n, coded, decoded, every = codec(path), [], [], [], []
        for text in batch.column("__text").to_pylist():
            ids = own.encode(text or "")
            n.append(len(ids))
            coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            if with_ids:
                every.append(ids.astype(np.int32).tolist())
        made = {**{c: batch.column(c) for c in carry}, "n_tokens": n, "ids_sha256": coded, "decoded_sha256": decoded}
        return made | ({"ids": every} if with_ids else {})

    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return map_rows(docs.select(*carry, F.col("text").alias("__text")), f"{types}, {extra}", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode(docs, ["doc_id"], public_tokenizers.path(RANKS), with_ids=False)
