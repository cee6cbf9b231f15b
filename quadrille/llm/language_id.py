"""Language ID by nearest centroid: TF-IDF n-gram vectors against several centroids for each language.

Fit: about FIT_ROWS rows that have a language, LEAST_ROWS for each language at least, picked by a hash of id and text, whatever
the order of the rows (a repeated row counts once); more than MOST_LANGS languages stop the fit with an error; byte 2- and 3-grams of the
lower-cased text are hashed into DIM cells of at most MOST_TIMES each, weighted by log tf and idf and scaled to length 1; spherical k-means
gives up to CENTROIDS centroids for each language. A text gets the language of the centroid with the largest
cosine; it is rejected if that cosine is less than what nearly all rows of a centroid reach that it was not fitted on:
centroids of one half of a language's rows are compared with pieces of the other half, and the floor is the QUANTILE of
their cosines by length, since short texts reach less. A language of fewer than LEAST_HELD rows rejects nothing.

Nulls and texts without a letter: `und`, score 0, rejected. Empty fit set: every row `und`, none rejected by accepted(). No
documents: no rows. Ties: the language first in alphabetic order. Repeated rows each get their own result; extra columns are ignored. Long texts are
read whole, in blocks.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import fold, map_rows, small_batches, table

DIM = 2048
FIT_ROWS = 4000
CENTROIDS = 4
#: Rows for each language, languages, and what a cell counts, in fits and scores.
LEAST_ROWS, MOST_LANGS, MOST_TIMES = 8, 4000, 65_535
#: The part of clean held-out pieces below the floor; the lengths (bytes) of pieces; rows below which there is no floor.
QUANTILE, LENGTHS, LEAST_HELD = 0.02, (4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096), 20
BLOCK = 1 << 20
LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Counts of the hashed byte 2- and 3-grams of a whole text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.zeros(DIM, np.int64)
    for at in range(0, max(len(raw) - 1, 0), BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        two = b[:-1] * np.uint32(256) + b[1:]
        three = two[:-1] * np.uint32(256) + b[2:]
        two = two[:BLOCK]  # a pair that starts in the next block counts there
        out += np.bincount((two * np.uint32(2654435761)) >> np.uint32(21), minlength=DIM)
        out += np.bincount(((three + np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> np.uint32(21), minlength=DIM)
    return np.minimum(out, MOST_TIMES)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the rows farthest from those taken so far."""
    taken = [x.mean(0)]
    while len(taken) < min(k, len(x)):
        taken.append(x[np.argmin(np.max(x @ np.array(taken).T, axis=1))])
    c = np.array(taken)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def floors(starts: list[bytes], own: np.ndarray, idf: np.ndarray) -> list[float]:
    """The floor of one language at each of LENGTHS. starts: the first bytes of its rows, own: their weighted grams."""
    half = np.array([crc32(s[:64]) & 1 for s in starts], bool)  # copies stay on one side
    if half.all() or not half.any():
        return [0.0] * len(LENGTHS)
    fits, out = [centroids(own[half == side], CENTROIDS) for side in (True, False)], []
    for n in LENGTHS:
        pieces = [(int(side), grams(s[:n].decode("utf-8", "ignore"))) for s, side in zip(starts, half, strict=True) if len(s) >= n]
        if len(pieces) < LEAST_HELD:
            out.append(out[-1] if out else 0.0)
            continue
        x, side = weighted(np.array([g for _, g in pieces]), idf), np.array([k for k, _ in pieces], bool)
        reached = np.where(side, np.max(x @ fits[1].T, axis=1), np.max(x @ fits[0].T, axis=1))
        out.append(float(np.quantile(reached, QUANTILE)))
    return out


def fit(rows: DataFrame, most: int = FIT_ROWS) -> dict:
    """rows: doc_id, text, lang. The model: idf, centroids, their languages, the least cosines that count, by length."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if not per:
        return {"langs": []}
    if len(per) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: lang is no language")
    share = max(LEAST_ROWS, most / len(per))
    keep = F.create_map(*[F.lit(v) for k, n in per.items() for v in (k, min(1.0, share / n))])
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    picked = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < keep[F.col("lang")] * (1 << 20)).dropDuplicates(["lang", "h"])

    def count(batch):
        texts = batch.column("text").to_pylist()
        return {"lang": batch.column("lang"), "counts": [grams(t).astype(np.uint16).tobytes() for t in texts],
                "start": [t[: LENGTHS[-1]].encode("utf-8", "replace")[: LENGTHS[-1]] for t in texts]}

    got = map_rows(picked, "lang string, counts binary, start binary", count).collect()  # the languages' shares, give or take chance
    if not got:
        return {"langs": []}
    got = sorted((r["lang"], bytes(r["counts"]), bytes(r["start"])) for r in got)
    counts = np.array([np.frombuffer(c, np.uint16) for _, c, _ in got])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x, langs = weighted(counts, idf), np.array([n for n, _, _ in got])
    names, parts, least = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        c = centroids(own, CENTROIDS)
        floor = floors([s for n, _, s in got if n == lang], own, idf)
        names += [lang] * len(c)
        least += [floor] * len(c)
        parts.append(c)
    return {"langs": names, "least": least, "centroids": np.concatenate(parts).astype(np.float32), "idf": idf}


def judged(texts: list[str | None], model: dict) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and rejection of each text."""
    lang, score, out = [], [], []
    for text in texts:
        if text is None or not model["langs"] or not LETTER.search(text):
            lang.append("und"), score.append(0.0), out.append(True)
            continue
        sims = model["centroids"] @ weighted(grams(text)[None], model["idf"])[0]
        best = int(np.argmax(sims))
        lang.append(model["langs"][best])
        score.append(float(min(1.0, max(0.0, sims[best]))))
        size = np.log(len(text.encode("utf-8", "replace")))
        out.append(bool(sims[best] < np.interp(size, np.log(LENGTHS), model["least"][best])))
    return lang, score, out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""

    def work(batch):
        lang, score, out = judged(batch.column("text").to_pylist(), model)
        return {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score, "rejected": out}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double, rejected boolean", work)


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows, with all their columns, that aren't rejected. Without a fit set nothing can be told apart: all rows."""
    if not model["langs"]:
        return docs
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([not x for x in judged(texts.tolist(), model)[2]], dtype=bool)

    return docs.where(keep("text"))


def fit_fold(docs: DataFrame) -> dict:
    """Fit on the rows that aren't held out."""
    return fit(docs.where(F.coalesce(fold(), F.lit(1)) != 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit_fold(docs)).select(
        "doc_id", (F.coalesce(fold(), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score", "rejected")
