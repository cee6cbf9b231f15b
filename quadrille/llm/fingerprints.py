"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words between white space, weighted by how often they occur; of words of more than LONG_BYTES bytes,
as in scripts that write no blanks, it is all runs of GRAM characters. Sample k takes from each
term, by hashing it with k, r and c from Gamma(2, 1) and beta from (0, 1); t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta) - r. The term with the least ln a and its t are the sample, so two texts agree in it with a
probability equal to their generalised Jaccard similarity (the standard deviation of the likeness is 0.09 at most). ln a, in fixed point, and a 32-bit hash of (term, t) are
packed into one number: a fingerprint is SAMPLES minima of numbers, which Spark aggregates before it moves anything.

The next document of a text is found by a range partitioning of the ids; only its first characters move to it.
Null text: as an empty one, whose only term is the empty word. Repeated ids are ordered by a hash of their text; rows that
repeat both are one document in the order and each get its row. A null id comes first. A single document is its own
next one. Extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import stored, table

SAMPLES = 32
#: Bytes above which a word has runs of characters as terms, and their length.
LONG_BYTES, GRAM = 64, 5
#: White space, besides the blank, that ends a word.
WHITE = "\n\t\r\u3000"
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Characters of a partition, so that its terms are counted in memory; partitions at most.
CHARACTERS, PARTITIONS = 4_000_000, 100_000


def unit(h: F.Column, shift: int, bits: int) -> F.Column:
    """A number inside (0, 1) from some bits of a hash."""
    mask = (1 << bits) - 1
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(mask)) + F.lit(0.5)) / F.lit(float(mask + 1))


def sample(term: F.Column, log_weight: F.Column, k: int) -> F.Column:
    """ln a in fixed point above a hash of (term, t)."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(unit(one, 0, 21) * unit(one, 21, 21))
    beta = unit(one, 42, 21)
    log_c = F.log(-F.log(unit(two, 0, 31) * unit(two, 31, 31)))
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t - beta) - r
    fixed = F.greatest(F.least(((log_a + 64.0) * float(1 << 24)).cast("long"), F.lit((1 << 31) - 1)), F.lit(0))
    return F.shiftleft(fixed, 32).bitwiseOR(F.xxhash64(one, t).bitwiseAND(F.lit((1 << 32) - 1)))


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, and c_print for each of the (at most two) text columns c. texts should be partitioned by the keys: then
    nothing moves. The lowest bit of a term's hash says which column it is from."""
    def words(c: str) -> F.Column:
        text = F.col(c)
        for white in WHITE:
            text = F.replace(text, F.lit(white), F.lit(" "))
        split = F.split(text, " ")
        long = F.exists(split, lambda w: F.octet_length(w) > LONG_BYTES)
        grams = F.transform(split, lambda w: F.when(F.octet_length(w) > LONG_BYTES, F.regexp_extract_all(w, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))).otherwise(F.array(w)))
        return F.when(long, F.flatten(grams)).otherwise(split)

    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("version"), words(c).alias("words")) for i, c in enumerate(columns)]))
    rows = texts.select(*keys, each.alias("e")).select(*keys, "e.version", F.explode("e.words").alias("word"))
    term = F.xxhash64("word").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("version"))
    terms = rows.select(*keys, term.alias("term")).groupBy(*keys, "term").count()
    terms = terms.select(*keys, F.col("term").bitwiseAND(F.lit(1)).alias("version"), F.col("term").bitwiseAND(F.lit(-2)).alias("term"),
                         F.log(F.col("count").cast("double")).alias("weight"))
    parts = terms.groupBy(*keys, "version").agg(*[F.min(sample(F.col("term"), F.col("weight"), k)).alias(f"s{k}") for k in range(SAMPLES)])
    low = lambda k: F.col(f"s{k}").bitwiseAND(F.lit((1 << 32) - 1))
    parts = parts.select(*keys, "version", F.array(*[low(k) for k in range(SAMPLES)]).alias("print"))
    pick = lambda i: F.max(F.when(F.col("version") == i, F.col("print")))
    return parts.groupBy(*keys).agg(*[pick(i).alias(f"{c}_print") for i, c in enumerate(columns)])


def likeness(a: str, b: str) -> F.Column:
    """The part of samples in which two fingerprints agree."""
    agree = sum(F.when(F.col(a)[k] == F.col(b)[k], 1).otherwise(0) for k in range(SAMPLES))
    return agree / F.lit(float(SAMPLES))


def shown(c: str) -> F.Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.col(c)[k])), 8, "0") for k in range(SAMPLES)])


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("at"), F.xxhash64(text).alias("of"), text.alias("text"))


def followers(keys: DataFrame) -> DataFrame:
    """at, of, next_at, next_of: each document's next one in order, the first after the last. Sorted in ranges; the
    ranges' first rows, one for each partition, link them."""
    dealt = stored(keys.repartitionByRange("at", "of").withColumn("range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("range").orderBy("at", "of")
    dealt = dealt.withColumn("follower", F.lead(F.struct("at", "of")).over(own))
    firsts = dealt.groupBy("range").agg(F.min(F.struct("at", "of")).alias("first"))
    every = Window.orderBy("range")  # one row for each partition
    ring = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(every), F.first("first").over(ring)).alias("first"))
    linked = dealt.join(firsts, "range").withColumn("n", F.coalesce("follower", "first"))
    return linked.select("at", "of", "n_chars", "copies", F.col("n.at").alias("next_at"), F.col("n.of").alias("next_of"))


def edited(docs: DataFrame) -> DataFrame:
    """at, of, n_chars, copies, next_at, next_of, text, edited: a row for each document in the order,
    partitioned by at and of. Texts move once, what the edit takes from them once more."""
    rows = keyed(docs)
    keys = rows.groupBy("at", "of").agg(F.max(F.char_length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    order = stored(followers(keys), "order")
    size = order.agg(F.sum("n_chars").alias("n"), F.max("copies").alias("copies")).first()
    rows = rows.repartition(min(PARTITIONS, max(1, -(-(size["n"] or 0) // CHARACTERS))), "at", "of")
    if (size["copies"] or 1) > 1:
        rows = rows.groupBy("at", "of").agg(F.first("text").alias("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    asked = order.select(F.col("next_at").alias("at"), F.col("next_of").alias("of"), F.col("at").alias("for_at"), F.col("of").alias("for_of"), quarter.alias("wanted"))
    given = rows.join(asked, ["at", "of"]).select(
        F.col("for_at").alias("at"), F.col("for_of").alias("of"), F.substring("text", F.lit(1), F.col("wanted")).alias("given"))
    whole = rows.join(order, ["at", "of"]).join(given, ["at", "of"])
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    return whole.select("at", "of", "n_chars", "copies", "next_at", "next_of", "text", F.concat(kept, "given").alias("edited"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited(docs)
    prints = fingerprints(rows, ["at", "of"], ["text", "edited"])
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("text", "edited")
    prints = stored(rows.join(prints, ["at", "of"]), "prints")
    following = prints.select(F.col("at").alias("next_at"), F.col("of").alias("next_of"), F.col("text_print").alias("next_print"))
    both = prints.join(following, ["next_at", "next_of"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return both.select(
        F.nullif("at", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", shown("text_print").alias("fingerprint"), shown("edited_print").alias("edited_fingerprint"),
        likeness("text_print", "edited_print").alias("near_edited"), likeness("text_print", "next_print").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
