"""Best-fit packing of documents into sequences of a fixed number of tokens, after Martello-Toth reduction.

A document is its ids, then id END; only longer ones are cut, into pieces of the capacity of which the first may be
shorter. Which pieces share a sequence depends on their lengths alone, so the instance is the count of pieces of each
length: at most `capacity` numbers, whatever the input. plan() goes through the lengths from the largest and
permanently fixes a piece with the partner that dominates every other choice (none fits; the partner fills the rest
exactly; no second partner can join; no pair or triple that fits outweighs the partner), as long as one does. What is
left is packed best-fit, longest first. Equal pieces are handled together, so time doesn't grow with the input. The
plan's intervals map the rank of a piece among those of its length to a sequence and an offset; ranks are counted
within hashed blocks of a length, so a length that a third of all pieces have is not gathered in one task, and neither are
rows that repeat one id and text (or lack an id): a number drawn when the pieces are written deals them, too.

Null text: as an empty one, a sequence part of one id. No documents: no rows. Repeated rows are packed each; ties between
pieces of a length go by id, piece, checksum and that number, and where these tie, too, the rows are the same. Extra columns
are ignored. Texts are read whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm.bpe import load_ranks
from quadrille.llm.common import map_rows, stored, table

CAPACITY, END = 2048, 0
#: The tokenizer, and the same vocabulary as ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Rows of one length that are ranked together.
RANKED = 1000
#: Texts of these characters only, without special tokens, give the same ids by either library (see the tests).
PLAIN = regex.compile(r"[\x00-\x7e\xa1-ɏ]*+")
SPECIAL = "<|"

_encoders: dict[str, tuple] = {}


def encoder(json_path: str, ranks_path: str | None):
    """text -> ids by the tokenizer file; plain texts by the same vocabulary's ranks, which is several times faster."""
    key = f"{json_path}\0{ranks_path}"
    if key not in _encoders:
        slow, fast = Tokenizer.from_file(json_path), None
        if ranks_path:
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        _encoders[key] = (slow, fast)
    slow, fast = _encoders[key]

    def encode(text: str) -> np.ndarray:
        if fast and PLAIN.fullmatch(text) and SPECIAL not in text:
            return np.array(fast.encode_ordinary(text), "<u4")
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece."""

    def work(batch):
        encode = encoder(json_path, ranks_path)
        out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.append(encode(text or ""), np.array([end], "<u4")).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            starts = [0, *range(first, len(ids), capacity)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                own = ids[a:b]
                for n, v in zip(out, (doc_id, k, a, b - a, zlib.crc32(own.tobytes()), own.astype(np.int32).tolist() if with_ids else None), strict=True):
                    out[n].append(v)
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_rows(docs.select("doc_id", "text"), schema, work)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, pieces of that length in each, offset) for the counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, rows, sequences = np.zeros_like(left), [], 0

    def put(length: int, at: int, bins: int, each: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + bins * each, at, each, offset))
        used[length] += bins * each
        left[length] -= bins * each

    for w in range(capacity, 0, -1):  # the reduction
        while left[w]:
            fix = dominating(left, w, capacity)
            if fix is None:
                break
            bins = int(left[w]) if not fix else int(left[w]) // 2 if fix == w else int(min(left[w], left[fix]))
            put(w, sequences, bins, 1, 0)
            if fix:
                put(fix, sequences, bins, 1, w)
            sequences += bins

    open_bins: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, sequences)

    def leave(room: int, at: int, bins: int) -> None:
        if bins:
            open_bins.setdefault(room, []).append((at, bins))

    for w in range(capacity, 0, -1):  # best fit, longest first
        for room in sorted(r for r in open_bins if r >= w):
            groups, each = open_bins.pop(room), room // w
            while groups:
                at, bins = groups.pop()
                full = int(min(bins, left[w] // each))
                if full:
                    put(w, at, full, each, capacity - room)
                    leave(room - each * w, at, full)
                if full < bins and left[w]:  # fewer than `each` are left: they share one sequence
                    some = int(left[w])
                    put(w, at + full, 1, some, capacity - room)
                    leave(room - some * w, at + full, 1)
                    full += 1
                leave(room, at + full, bins - full)
            if not left[w]:
                break
        if left[w]:
            each = capacity // w
            full, some = divmod(int(left[w]), each)
            if full:
                put(w, sequences, full, each, 0)
                leave(capacity - each * w, sequences, full)
            if some:
                put(w, sequences + full, 1, some, 0)
                leave(capacity - some * w, sequences + full, 1)
            sequences += full + bool(some)
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def dominating(left: np.ndarray, w: int, capacity: int) -> int | None:
    """0 if no other piece fits beside one of length w; the length of the partner that dominates; None if none does."""
    room = capacity - w
    others = np.flatnonzero(left[: room + 1])
    if w <= room and left[w] == 1:
        others = others[others != w]
    if not len(others):
        return 0
    partner = int(others[-1])
    if partner == room:
        return partner
    small = others[:3].tolist()
    small = sorted(x for s in small for x in [s] * int(min(left[s] - (s == w), 3)))[:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return partner
    if len(small) > 2 and sum(small) <= room:
        return None
    mates = np.searchsorted(others, room - others, "right") - 1  # the largest that fits beside each, counts aside
    best = int((others + others[mates])[mates >= 0].max(initial=0))
    return partner if best <= partner else None


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (length and ids_crc32 among the columns) with sequence_id and offset."""
    made = stored(made.withColumn("__deal", (F.rand(7) * (1 << 31)).cast("int")), "pieces")  # written, so a lost task can't draw again
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity`
    rows = plan(counts, capacity)
    blocks = F.lit([max(1, -(-counts.get(n, 0) // RANKED)) for n in range(capacity + 1)])
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "__deal"), blocks[F.col("length").cast("int")])
    made = made.withColumn("__block", block)
    ahead = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = made.groupBy("length", "__block").count().select("length", "__block", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32", "__deal")
    ranked = made.withColumn("__rank", F.row_number().over(within) - 1).join(before, ["length", "__block"])
    ranked = ranked.withColumn("__rank", (F.col("__rank") + F.col("__before")).cast("long")).drop("__block", "__before", "__deal")
    base = capacity + 1
    starts = rows[:, 0] * (1 << 44) + rows[:, 1]
    carry = [c for c in ranked.columns if c != "__rank"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*carry).schema)

    def work(batch):
        length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
        assert not len(length) or length.max() < base
        own = rows[np.searchsorted(starts, length * (1 << 44) + rank, "right") - 1]
        k = rank - own[:, 1]
        return {**{c: batch.column(c) for c in carry}, "sequence_id": own[:, 3] + k // own[:, 4], "offset": own[:, 5] + k % own[:, 4] * length}

    return map_rows(ranked, f"{types}, sequence_id long, offset long", work)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the sequences themselves, from packed pieces with their ids (at most the capacity in each)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
