"""Toxicity by a factorization machine over hashed terms.

Terms: words, their first four and five characters, and such beginnings that two different words of the text share, each
hashed to 32 bits. Fit: at most FIT_ROWS labelled rows that aren't held out (the first in order of a hash of doc_id, whatever
the order of the rows; near copies among them count once). The machine gets the terms whose document frequency differs most
between the two labels (TERMS at most, by LEAST_Z standard deviations at least), and those of pairs that are toxic together
more often than either alone (PAIRS at most, by PAIR_Z; of the PAIR_TERMS terms that most toxic rows hold), so that two words
that are harmless alone can count. Each has a weight and FACTORS factors, so pairs such as an insult with a mention of a group
count beyond their sum. The score is the sigmoid of the machine's output.

Null and empty texts hold no term and get the score of the bias. Without labels of both kinds (empty tables, too) every score is
0. No documents: no rows. Ids with contradicting labels are left out of the fit, repeated ids count once. Terms of equal weight:
the smaller hash first. Repeated rows each get their own result; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import fold, labelled, map_rows, table

FIT_ROWS = 12_000
TERMS, FACTORS = 512, 8
LEAST_Z = 4.0
#: Pairs: how many, how clear, of how many terms, which stand in so many toxic rows at least.
PAIRS, PAIR_Z, PAIR_TERMS, PAIR_ROWS = 64, 6.0, 1000, 8
STARTS = (4, 5)
TOXIC = 0.7
KNOWN = 200_000
WORD = re.compile(r"\w+")


def code(term: str) -> int:
    return crc32(term.encode("utf-8", "replace"))


def terms(word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The hashed terms of one word, and those that count if two words of a text have them."""
    starts = [word[:n] for n in STARTS if len(word) > n]
    return (code(word), *[code(f"{s}~") for s in starts]), tuple(code(f"{s}~2") for s in starts)


def terms_of(text: str) -> np.ndarray:
    """The sorted hashed terms of a text."""
    found, twice = set(), Counter()
    for w in set(WORD.findall(text.lower())):
        one, two = terms(w)
        found.update(one)
        twice.update(two)
    return np.array(sorted(found | {c for c, n in twice.items() if n > 1}), np.uint32)


def output(x: np.ndarray, model: dict) -> np.ndarray:
    s = x @ model["v"]
    return model["b"] + x @ model["w"] + 0.5 * ((s * s).sum(1) - (x @ (model["v"] ** 2)).sum(1))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05, l2: float = 5e-5) -> dict:
    """Full-batch Adam on the logistic loss."""
    rng = np.random.default_rng(7)
    p = {"b": np.array(np.log(y.mean() / (1 - y.mean()))), "w": np.zeros(x.shape[1]), "v": rng.normal(0, 0.02, (x.shape[1], FACTORS))}
    m, q = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        e = (1 / (1 + np.exp(-np.clip(output(x, p), -40, 40))) - y) / len(y)
        g = {"b": e.sum(), "w": x.T @ e + l2 * p["w"], "v": x.T @ ((x @ p["v"]) * e[:, None]) - (x.T @ e)[:, None] * p["v"] + l2 * p["v"]}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            q[k] = 0.999 * q[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (np.sqrt(1 - 0.999**t) / (1 - 0.9**t)) * m[k] / (np.sqrt(q[k]) + 1e-9)
    return p


def deviation(n: np.ndarray, hit: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """By how many standard deviations more of n rows are toxic than a share of them."""
    return (hit - n * share) / np.sqrt(n * share * (1 - share) + 1)


def dense(at: np.ndarray, row: np.ndarray, picked: np.ndarray, every: int, rows: int, kind: type) -> np.ndarray:
    """Rows by picked terms, 1 where the row holds the term."""
    where = np.full(every, -1)
    where[picked] = np.arange(len(picked))
    x = np.zeros((rows, len(picked)), kind)
    told = where[at] >= 0
    x[row[told], where[at][told]] = 1
    return x


def chosen(at: np.ndarray, row: np.ndarray, y: np.ndarray, every: int) -> np.ndarray:
    """The terms (places 0 to every - 1) that the machine gets. Entry k: term at[k] stands in row row[k]."""
    n, hit = np.bincount(at, minlength=every), np.bincount(at, y[row], minlength=every)
    share, rate = y.mean(), hit / np.maximum(n, 1)
    z = np.abs(deviation(n, hit, share))
    single = np.argsort(-z, kind="stable")[:TERMS]
    single = single[z[single] >= LEAST_Z]
    often = np.flatnonzero((hit >= PAIR_ROWS) & (2 * n <= len(y)) & (rate < 0.8))
    often = often[np.argsort(-hit[often], kind="stable")][:PAIR_TERMS]
    x = dense(at, row, often, every, len(y), np.float32)
    together, toxic = x.T @ x, x[y > 0].T @ x[y > 0]
    alone = np.maximum(share, np.maximum(rate[often][:, None], rate[often][None]))
    gain = np.triu(deviation(together, toxic, alone), 1)
    i, j = np.nonzero(gain >= PAIR_Z)
    best = np.argsort(-gain[i, j], kind="stable")[:PAIRS]
    return np.unique(np.concatenate([single, often[i[best]], often[j[best]]]))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> dict | None:
    """{term: place}, bias, weights and factors; None without labels of both kinds."""
    learn = labels.where(F.coalesce(fold(), F.lit(1)) != 1)

    def distinct(batch):
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "codes": [terms_of(t).tobytes() for t in batch.column("text").to_pylist()]}

    got = map_rows(labelled(docs, learn, "toxic", most), "doc_id long, y int, codes binary", distinct).collect()  # at most `most` rows
    return learned([(np.frombuffer(bytes(r["codes"]), np.uint32), r["y"]) for r in sorted(got, key=lambda r: r["doc_id"])])


def learned(rows: list[tuple[np.ndarray, int]]) -> dict | None:
    """The model of rows (terms, label). Rows of one label whose two least mixed terms are the same count once."""
    once = {}
    for codes, y in rows:
        mixed = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
        once.setdefault((y, *np.sort(mixed)[:2].tolist()), (codes, y))
    codes, y = [c for c, _ in once.values()], np.array([y for _, y in once.values()], float)
    if len(set(y.tolist())) < 2:
        return None
    every, at = np.unique(np.concatenate(codes), return_inverse=True)
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    best = chosen(at, row, y, len(every))
    x = dense(at, row, best, len(every), len(y), float)
    return {"place": {int(every[k]): i for i, k in enumerate(best)}, **train(x, y)}


def score(docs: DataFrame, model: dict | None, carry: list[str]) -> DataFrame:
    """The columns `carry`, score, predicted."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    known: dict[str, tuple] = {}  # of each Python worker; bounded

    def places(word: str) -> tuple:
        if len(known) >= KNOWN:
            known.clear()
        found = known[word] = tuple(tuple(model["place"][c] for c in part if c in model["place"]) for part in terms(word))
        return found

    def work(batch):
        texts = batch.column("__text").to_pylist()
        if model is None:
            made = np.zeros(len(texts))
        else:
            x = np.zeros((len(texts), len(model["place"])))
            for i, t in enumerate(texts):
                seen = set()
                for w in set(WORD.findall(t.lower())) if t else ():
                    one, two = known.get(w) or places(w)
                    for k in one:
                        x[i, k] = 1
                    for k in two:
                        if k in seen:
                            x[i, k] = 1
                        seen.add(k)
            made = 1 / (1 + np.exp(-np.clip(output(x, model), -40, 40)))
        return {**{c: batch.column(c) for c in carry}, "score": made.tolist(), "predicted": [int(s >= TOXIC) for s in made]}

    return map_rows(docs.select(*carry, F.col("text").alias("__text")), f"{types}, score double, predicted int", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", (F.coalesce(fold(), F.lit(0)) == 1).alias("held_out"), "score", "predicted")
