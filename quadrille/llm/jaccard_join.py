"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two documents link when
100 * intersection >= 80 * union. The result is exact up to hash collisions and holds the components of all links.

1. Each text's set gets a 64-bit signature; equal sets are one row of the incidence from here on. Each task also counts
   the shingles in BUCKETS buckets; the summed counts, of fixed size, order the columns from rare to common.
2. Of n columns of a row only the first n - ceil(0.8 n) + 1 in that order are kept: two linked rows meet in one of
   them (the size-derived prefix bound). Columns with one row are dropped; columns of crowded buckets are dealt in
   several blocks, so none gathers in a task.
3. Stars: in each column, rows are paired with one pivot (the row with the largest part of its kept columns shared,
   that is the original of a group of copies; another in later rounds), the pairs that share too little are left out,
   the rest compared exactly, and the links merged into components. This makes no more pairs than there are entries.
4. Product: for the columns that still hold rows of several components, overlap counts of all pairs across components
   are accumulated (for columns where many pairs meet, by products of two blocks of rows that yield no pair but those
   that pass), pairs below their size-derived bound are discarded, and the rest compared exactly. Pairs within a
   component can't change the components and are not made here.
5. Links: every link lies inside a component, so the whole sets of each component are multiplied block by block, and each
   row's links are summed; no pair is written. This work grows with the square of a component's different sets.

Null text, empty text: n_shingles 0, linked with nothing. Fewer than five words: the sequence is the one shingle.
Rows without an id link like others, but never name a component: one of only such rows has a null component_id. Repeated
rows, equal texts: one component, each a link of the others. Ties: pivots of equal share by their signature. No documents: no
rows. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import discard, small_batches, stored, table
from quadrille.llm.components import components

WORDS, PERCENT = 5, 80
BUCKET_BITS, CHUNK = 19, 8192
#: Rounds of stars before the product, and the pairs for each entry at which the product starts at once.
STAR_ROUNDS, STAR_ENOUGH = 3, 2.0
#: Of the columns a pair could share, the part that a star pair must share with its pivot to be compared.
STAR_SHARE = 0.25
#: Pairs above which a column is multiplied in blocks, rows of a block, columns multiplied at a time.
HEAVY, BLOCK, COLUMNS = 20_000, 1024, 2048
#: Rows, and shingles for each of them, of a block whose links are counted.
LINK_BLOCK, LINK_SIZE = 512, 1000
#: Bits of the filter that says whose sets a comparison needs, at most.
FILTER_BITS = 26
MASK = (1 << 63) - 1
#: Stands for a null id where texts are looked up.
NO_ID = -(1 << 63)
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER, LOWER)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes (63 bits) of the text's distinct shingles."""
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return np.zeros(0, np.int64)
    n = max(len(words) - WORDS + 1, 1)
    codes = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    h = np.full(n, min(len(words), WORDS), np.uint64)
    for i in range(min(WORDS, len(words))):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def signature(own: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def bucket(h: np.ndarray) -> np.ndarray:
    return h >> (63 - BUCKET_BITS)


def chunked(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for k in range(0, len(counts), CHUNK):
        if counts[k : k + CHUNK].any():
            yield k // CHUNK, counts[k : k + CHUNK].tobytes()


def summed(rows: DataFrame, length: int, bits: bool = False) -> np.ndarray:
    """chunk, part: the sum (bits: the union) of the tasks' arrays. Of fixed length, whatever the input.

    Each task adds up what it reads, one array for each chunk, before and after the shuffle; no group is held."""
    kind = np.uint8 if bits else np.int64
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.binary())])

    def add(sent: type):
        def run(batches):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, x in zip(batch.column("chunk").to_pylist(), batch.column("part"), strict=True):
                    part = np.frombuffer(x.as_buffer(), sent)
                    total = totals.setdefault(k, np.zeros(CHUNK, kind))
                    np.bitwise_or(total, part, out=total) if bits else np.add(total, part, out=total)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], schema=schema)

        return run

    once = rows.select("chunk", "part").mapInArrow(add(kind if bits else np.int32), "chunk int, part binary")
    out = np.zeros(length, kind)
    for r in once.repartition("chunk").mapInArrow(add(kind), "chunk int, part binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["part"]), kind)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, sid, other: size and signature of each set; and rows with chunk, part: counts of the buckets."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("other", pa.int64()), ("chunk", pa.int32()), ("part", pa.binary())])

    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                np.add.at(counts, bucket(own), 1)
                a, b = signature(own)
                n.append(len(own)), first.append(a), second.append(b)
            size = len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(first), pa.array(second), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], schema=schema)
        parts = list(chunked(counts))
        empty = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([empty] * 4 + [pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, sid long, other long, chunk int, part binary")


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """sid, n, and the kept columns of each set as key and block (-1 where the column's bucket isn't crowded)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(counts)  # 2 ** BUCKET_BITS numbers
    crowded = 2 * int(counts.mean()) + 10_000
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int32()))])

    def run(batches):
        known: set[int] = set()  # signatures that this task has sent; bounded
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                if not len(own):
                    continue
                sid = signature(own)[0]
                if sid in known:
                    continue
                if len(known) < 1_000_000:
                    known.add(sid)
                size, p = sent.value[bucket(own)], prefix_length(len(own))
                kept = np.lexsort((own, size))[:p]
                parts = size[kept] // crowded + 1
                rows.append((sid, len(own), own[kept], np.where(parts > 1, (sid & MASK) % parts, -1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    made = docs.mapInArrow(run, "sid long, n long, keys array<long>, blocks array<int>")
    return made.select("sid", "n", F.explode(F.arrays_zip("keys", "blocks")).alias("e")).select(
        "sid", F.col("n").cast("int").alias("n"), F.col("e.keys").alias("key"), F.col("e.blocks").alias("block"))


def shared_entries(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """sid, n, key: the kept entries of columns that hold several rows (of crowded columns, all)."""
    w = Window.partitionBy("key", "block")
    rows = prefixes(docs, counts).withColumn("lo", F.min("sid").over(w)).withColumn("hi", F.max("sid").over(w))
    return rows.where((F.col("lo") != F.col("hi")) | (F.col("block") >= 0)).dropDuplicates(["key", "block", "sid"]).select("sid", "n", "key")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, own: the whole sets of the wanted rows (sid, doc_id; NO_ID for null). A filter of bounded size, made by the tasks, says
    which texts to hash again; the join removes what it lets through in error."""
    spark = docs.sparkSession
    n = wanted.count()
    bits = min(FILTER_BITS, max(16, (16 * n).bit_length()))

    def mark(batches):
        flags = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            flags[place(batch.column("doc_id").to_numpy(), bits)] = 1
        packed = np.packbits(flags)
        parts = list(chunked(packed))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["chunk", "part"])

    flags = summed(wanted.select("doc_id").mapInArrow(mark, "chunk int, part binary"), max(CHUNK, (1 << bits) // 8), bits=True)
    sent = spark.sparkContext.broadcast(flags)  # 8 MB at most
    schema = pa.schema([("sid", pa.int64()), ("doc_id", pa.int64()), ("own", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID)
            at = place(ids.to_numpy(), bits)
            hit = np.flatnonzero((sent.value[at >> 3] >> (7 - (at & 7))) & 1)
            texts, rows = batch.column("text"), []
            for i in hit.tolist():
                own = shingles(texts[i].as_py())
                if len(own):
                    rows.append((signature(own)[0], ids[i].as_py(), own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    made = docs.mapInArrow(run, "sid long, doc_id long, own binary")
    return made.join(wanted, ["sid", "doc_id"], "left_semi").dropDuplicates(["sid"])


def place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def compared(docs: DataFrame, pairs: DataFrame, first: DataFrame) -> DataFrame:
    """a, b: the pairs whose whole sets link."""
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    sets = stored(sets_of(docs, stored(wanted.join(first, "sid").select("sid", "doc_id"), "wanted")), "sets")
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("own").alias("x")), "a").join(
        sets.select(F.col("sid").alias("b"), F.col("own").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "found")
    discard(sets)
    return found


def close_in_size(a: str, b: str) -> F.Column:
    small, large = F.least(a, b), F.greatest(a, b)
    return small * 100 >= large * PERCENT


def kept_columns(n: str) -> F.Column:
    return F.col(n) - F.expr(f"({PERCENT} * {n} + 99) div 100") + 1


def star_pairs(entries: DataFrame, number: int) -> DataFrame:
    """a, b: rows and the pivots they share enough columns with, across components. entries: sid, n, key, comp, part."""
    order = F.col("part") if number == 0 else F.xxhash64("sid", F.lit(number)).cast("double")
    pivot = entries.groupBy("key").agg(F.max_by(F.struct("sid", "n", "comp"), F.struct(order, "sid")).alias("p"),
                                       F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    # stored: a join of two tables, which adaptive execution can split where one column holds very many rows
    pivot = stored(pivot.select("key", F.col("p.sid").alias("b"), F.col("p.n").alias("m"), F.col("p.comp").alias("to")), "pivots")
    pairs = entries.join(pivot, "key")
    pairs = pairs.where((F.col("comp") != F.col("to")) & close_in_size("n", "m"))
    pairs = pairs.groupBy(F.col("sid").alias("a"), "b", "n", "m").count()
    return pairs.where(F.col("count") >= STAR_SHARE * F.least(kept_columns("n"), kept_columns("m"))).select("a", "b")


def still_open(count, n, m):
    """Whether a pair of sizes n and m that shares `count` kept columns can link; for columns and for arrays.

    All that the pair shares up to the end of one's kept columns is counted; beyond it, that one has at most
    ceil(0.8 n) - 1 columns left. A link shares 80 / 180 of both sizes together."""
    large = F.greatest(n, m) if isinstance(n, F.Column) else np.maximum(n, m)
    up = F.ceil if isinstance(n, F.Column) else np.ceil
    return count + up(large * PERCENT / 100) - 1 >= (n + m) * PERCENT / (100 + PERCENT) - 1e-6


def product_pairs(entries: DataFrame) -> DataFrame:
    """a, b: all pairs of rows of different components whose overlap in the kept columns leaves the bound open.

    Columns that few pairs meet in are multiplied by a join on the column, the others block by block."""
    per = entries.groupBy("key", "comp").count().groupBy("key").agg(
        F.sum("count").alias("f"), F.max_by("comp", F.struct("count", "comp")).alias("main"), F.max("count").alias("of_main"))
    per = stored(per.withColumn("rest", F.col("f") - F.col("of_main")).where("rest > 0"), "columns")
    crowded = F.col("rest") * F.col("f") > HEAVY
    left = entries.join(per.where(~crowded).select("key"), "key", "left_semi").select("key", "sid", "n", "comp")
    right = left.select("key", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("comp").alias("to"))
    pairs = left.join(right, "key").where((F.col("sid") < F.col("b")) & (F.col("comp") != F.col("to")) & close_in_size("n", "m"))
    pairs = pairs.groupBy(F.col("sid").alias("a"), "b", "n", "m").count()
    pairs = pairs.where(still_open(F.col("count"), F.col("n"), F.col("m"))).select("a", "b")
    return pairs.union(blocked_pairs(entries, per.where(crowded))).distinct()


def blocked_pairs(entries: DataFrame, per: DataFrame) -> DataFrame:
    """The pairs of the columns in `per` by products of blocks of rows, with all shared columns of these rows.

    The rows outside a column's largest component are dealt in blocks, each multiplied with each block of the largest
    component and each block of its own kind; a task holds two blocks of about BLOCK rows."""
    rows = entries.select("key", "sid", "n", "comp").join(per.select("key", "main", "of_main", "rest"), "key")
    rest = F.col("comp") != F.col("main")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("sid"), F.when(rest, parts("rest")).otherwise(parts("of_main"))).cast("int")
    every = lambda c: F.sequence(F.lit(0), parts(c) - 1)
    spot = lambda i, j, kind, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"), F.lit(side).alias("side"))
    to_main = F.transform(every("of_main"), lambda j: spot(F.col("block"), j, 0, 0))
    as_left = F.transform(F.filter(every("rest"), lambda j: j >= F.col("block")), lambda j: spot(F.col("block"), j, 1, 0))
    as_right = F.transform(F.filter(every("rest"), lambda j: j <= F.col("block")), lambda j: spot(j, F.col("block"), 1, 1))
    from_main = F.transform(every("rest"), lambda i: spot(i, F.col("block"), 0, 1))
    spots = F.when(rest, F.concat(to_main, as_left, as_right)).otherwise(from_main)
    keys = entries.join(rows.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    dealt = rows.withColumn("block", block).select("key", "sid", "n", "comp", F.explode(spots).alias("s"))
    dealt = dealt.select("key", "sid", "n", "comp", "s.*").join(keys, "sid")

    def product(frame):
        x, y = (frame[frame["side"] == k] for k in (0, 1))
        a, b = [], []
        if len(x) and len(y):
            own = [np.concatenate(f["keys"].to_list()).astype(np.int64) for f in (x, y)]
            at = [np.repeat(np.arange(len(f)), f["keys"].map(len)) for f in (x, y)]
            both = np.intersect1d(*own)
            count = np.zeros((len(x), len(y)), np.float32)
            for k in range(0, len(both), COLUMNS):
                part, ones = both[k : k + COLUMNS], []
                for f, keys, row in zip((x, y), own, at, strict=True):
                    place = np.minimum(np.searchsorted(part, keys), len(part) - 1)
                    hit = part[place] == keys
                    one = np.zeros((len(f), len(part)), np.float32)
                    one[row[hit], place[hit]] = 1
                    ones.append(one)
                count += ones[0] @ ones[1].T
            n, m = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None]
            keep = still_open(count, n, m) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT)
            keep &= x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None]
            i, j = np.nonzero(keep)
            u, v = x["sid"].to_numpy()[i], y["sid"].to_numpy()[j]
            a, b = np.minimum(u, v), np.maximum(u, v)
        return type(frame)({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.groupBy("key", "i", "j", "kind").applyInPandas(product, "a long, b long")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows doc_id, n, sid, other, chunk, part, and sid, root, component_id of their sets; root: a signature, one for each
    component."""
    small_batches(docs.sparkSession)
    made = stored(signed(docs), "signed")
    rows = made.where("chunk is null")
    clash = rows.groupBy("sid").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi")
    if not clash.isEmpty():
        raise RuntimeError("two different sets have the same 64-bit signature")
    counts = summed(made.where("chunk is not null").select("chunk", "part"), 1 << BUCKET_BITS)
    named = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    first = named.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    bare = stored(shared_entries(docs, counts), "entries")
    shared = bare.groupBy("sid", "n").agg(F.count("*").alias("k")).select("sid", (F.col("k") / kept_columns("n")).alias("part"))
    entries = stored(bare.join(shared, "sid"), "entries")
    discard(bare)
    links, roots = None, None
    for number in range(STAR_ROUNDS + 1):
        labelled = entries.withColumn("comp", F.col("sid"))
        if roots is not None:
            labelled = entries.join(roots, entries["sid"] == roots["id"], "left").withColumn("comp", F.coalesce("root", "sid")).drop("id", "root")
        labelled = stored(labelled, "labelled")
        per = labelled.groupBy("key", "comp").count().groupBy("key").agg(F.sum("count").alias("f"), F.sum(F.col("count") * F.col("count")).alias("g"))
        total = per.agg(F.sum((F.col("f").cast("double") * F.col("f") - F.col("g")) / 2).alias("pairs"), F.sum("f").alias("entries")).first()
        if not total["pairs"]:
            break
        last = number == STAR_ROUNDS or number and total["pairs"] <= STAR_ENOUGH * total["entries"]
        found = compared(docs, product_pairs(labelled) if last else star_pairs(labelled, number), first)
        discard(labelled)
        links = found if links is None else links.union(found)
        roots = components(links)
        if last:
            break
    if roots is None:
        roots = rows.select(F.col("sid").alias("id"), F.col("sid").alias("root")).limit(0)
    names = stored(named.join(roots, named["sid"] == roots["id"], "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root")), "named")
    least = stored(names.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # stored: see star_pairs
    found = stored(names.join(least, "root").select("sid", "root", "component_id"), "names")
    for t in (names, least, entries):
        discard(t)
    return rows, found


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return told(*grouped(docs.select("doc_id", "text"))).select("doc_id", "n_shingles", "component_id")


def told(rows: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, sid of every row."""
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), "sid")
    full = own.where("n_shingles > 0").join(names.select("sid", "component_id"), "sid", "left").select("doc_id", "n_shingles", "component_id", "sid")
    return full.union(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "sid"))


def links_between(left, right) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows (sid, n, copies, own) of two blocks of one component: the documents each links with in the other."""
    own = [[np.frombuffer(x, np.int64) for x in f["own"]] for f in (left, right)]
    at = [np.repeat(np.arange(len(x)), [len(k) for k in x]) for x in own]
    keys = [np.concatenate(x) for x in own]
    both = np.intersect1d(*keys)
    count = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(both), COLUMNS):
        part, ones = both[k : k + COLUMNS], []
        for x, key, row in zip(own, keys, at, strict=True):
            place = np.minimum(np.searchsorted(part, key), len(part) - 1)
            hit = part[place] == key
            one = np.zeros((len(x), len(part)), np.float32)
            one[row[hit], place[hit]] = 1
            ones.append(one)
        count += ones[0] @ ones[1].T
    shared = count.astype(np.int64)
    total = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None] - shared
    link = (100 * shared >= PERCENT * total) & (left["sid"].to_numpy()[:, None] != right["sid"].to_numpy()[None])
    return link @ right["copies"].to_numpy(), left["copies"].to_numpy() @ link


def links_of_sets(docs: DataFrame, rows: DataFrame, names: DataFrame) -> DataFrame:
    """sid, links: of each set in a component of several, the documents with other sets that it links with.

    The sets of a component are dealt in blocks, and a task holds two of them; small components share tasks."""
    ids = rows.where("n > 0").groupBy("sid").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    size = names.groupBy("root").agg(F.count("*").alias("c")).where("c > 1").select("root")
    grouped_names = names.join(stored(size, "several"), "root", "left_semi").select("sid", "root")
    members = stored(ids.join(grouped_names, "sid"), "members")
    size = members.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("of"))
    parts = F.greatest(F.ceil(F.col("c") / LINK_BLOCK), F.ceil(F.col("of") / (LINK_BLOCK * LINK_SIZE))).cast("int")
    members = stored(members.join(stored(size.select("root", parts.alias("parts")), "sizes"), "root"), "members")
    held = members.agg(F.count("*").alias("c"), F.sum("n").alias("of")).first()
    bundles = max(1, held["c"] // LINK_BLOCK, (held["of"] or 0) // (LINK_BLOCK * LINK_SIZE))
    sets = stored(sets_of(docs, members.select("sid", "doc_id")), "sets")
    block = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    spot = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_left = F.transform(F.filter(every, lambda j: j >= F.col("block")), lambda j: spot(F.col("block"), j, 0))
    as_right = F.transform(F.filter(every, lambda j: j <= F.col("block")), lambda i: spot(i, F.col("block"), 1))
    small = F.col("parts") == 1
    bundle = F.when(small, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root"))
    spots = F.when(small, F.array(spot(F.lit(0), F.lit(0), -1))).otherwise(F.concat(as_left, as_right))
    dealt = members.join(sets.select("sid", "own"), "sid").withColumn("block", block).withColumn("bundle", bundle)
    dealt = dealt.select("root", "sid", "n", "copies", "own", "bundle", small.alias("small"), F.explode(spots).alias("s")).select("*", "s.*").drop("s")

    def product(frame):
        sids, links = [], []
        for _, own in frame.groupby("root", sort=False):
            x, y = (own, own) if own["side"].iloc[0] < 0 else (own[own["side"] == k] for k in (0, 1))
            if len(x) and len(y):
                of_left, of_right = links_between(x, y)
                sids.append(x["sid"].to_numpy()), links.append(of_left)
                if own["i"].iloc[0] != own["j"].iloc[0]:
                    sids.append(y["sid"].to_numpy()), links.append(of_right)
        both = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (sids, links))
        return type(frame)(dict(zip(("sid", "links"), both, strict=True)))

    return dealt.groupBy("small", "bundle", "i", "j").applyInPandas(product, "sid long, links long").groupBy("sid").agg(F.sum("links").alias("links"))


def with_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: the number of other documents that a document links with, those of an
    equal set, too. Half the sum is the number of links of the join."""
    docs = docs.select("doc_id", "text")
    rows, names = grouped(docs)
    copies = rows.where("n > 0").groupBy("sid").agg(F.count("*").alias("copies"))
    degree = copies.join(links_of_sets(docs, rows, names), "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = told(rows, names).join(stored(degree, "degree"), "sid", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


#: Ids to remove up to this number are broadcast (8 bytes each), more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, without those whose component has a smaller id. Of rows with the same id all
    stay or all go; rows without an id stay."""
    out = stored(linked(docs).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    gone = F.broadcast(out) if out.count() <= BROADCAST_ROWS else out
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_links(table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle, then the closure of the links: for tables of some thousand documents.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM l),
s AS (SELECT doc_id, unnest(g) AS g FROM l),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
k AS (SELECT a AS doc_id, count(*) AS k FROM u GROUP BY a),
r AS (SELECT doc_id, doc_id AS at FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.at)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.at) AS component_id, coalesce(any_value(k.k), 0)::BIGINT AS n_links
FROM n JOIN r USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY n.doc_id
"""
