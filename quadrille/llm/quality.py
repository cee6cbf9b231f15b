"""Quality rules: base counts, and calibrated logistic regression over hashed word and character n-grams.

Fit: at most FIT_ROWS labelled rows (the first in order of a hash of doc_id, whatever the order of the rows; a repeated
id counts once); each gives counts of word 1- and 2-grams and character 3- and 4-grams hashed into WORD_DIM and CHAR_DIM
cells of at most MOST_TIMES each, as log counts scaled to length 1 for each part. Three quarters train the weights, the rest the two numbers of Platt's sigmoid. Scored in Arrow batches:
a document is kept if it passes the base rules and its probability of quality 1 is KEEP or more.

Null and empty text: no words, all counts 0, base_failed, not kept. Without labels of both kinds (empty tables, too) the base
rules alone decide. No documents: no rows. Repeated rows each get their own result; a probability of just KEEP is kept;
extra columns are ignored (accepted() keeps them); texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import labelled, map_rows, small_batches, table

WORD_DIM, CHAR_DIM = 2048, 2048
FIT_ROWS = 3000
#: What a cell counts at most, in fits and scores.
MOST_TIMES = 65_535
KEEP = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
BLOCK = 1 << 20
WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes], codes: np.ndarray) -> int:
    """Words inside windows of five that occur twice or more. Equal codes only point at windows; words decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    near = np.zeros(n, bool)
    near[order[1:][same]] = True
    near[order[:-1][same]] = True
    at = np.flatnonzero(near)
    seen = Counter(tuple(words[i : i + WINDOW]) for i in at)
    starts = np.array([i for i in at if seen[tuple(words[i : i + WINDOW])] > 1], np.int64)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def word_codes(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    words = raw.split()  # splits bytes at \x20 and \x09-\x0D, nothing else
    return words, np.fromiter(map(crc32, words), np.uint64, len(words))


def base(text: str | None) -> tuple[tuple[int, int, int, int, int], bytes, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the text's bytes, the words' codes."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words, codes = word_codes(raw)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    counts = (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
              len(lines) - len(set(lines)), repeated_words(words, codes))
    return counts, raw, codes


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def features(raw: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed word and character n-grams."""
    shift = np.uint64(64 - 11)
    one = (codes * np.uint64(0x9E3779B97F4A7C15)) >> shift
    two = ((codes[:-1] * np.uint64(31) + codes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift
    word = np.bincount(one.astype(np.int64), minlength=WORD_DIM) + np.bincount(two.astype(np.int64), minlength=WORD_DIM)
    char = np.zeros(CHAR_DIM, np.int64)
    whole = np.frombuffer(raw, np.uint8)
    for at in range(0, max(len(whole) - 2, 0), BLOCK):
        b = whole[at : at + BLOCK + 3].astype(np.uint32)
        three = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        four = (three[:-1] << np.uint32(8)) | b[3:]
        three = three[:BLOCK]
        char += np.bincount((three * np.uint32(2654435761)) >> np.uint32(21), minlength=CHAR_DIM)
        char += np.bincount(((four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> np.uint32(21), minlength=CHAR_DIM)
    return np.minimum(word, MOST_TIMES), np.minimum(char, MOST_TIMES)


def scaled(word: np.ndarray, char: np.ndarray) -> np.ndarray:
    parts = [np.log1p(p.astype(np.float32)) for p in (word, char)]
    return np.concatenate([p / np.maximum(np.linalg.norm(p, axis=-1, keepdims=True), 1e-9) for p in parts], axis=-1)


def logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 250, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam; each class counts as its share."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g, gb = x.T @ (p - y) / len(y) + l2 * w, float((p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = float(np.sqrt(1 - 0.999**t) / (1 - 0.9**t))  # a numpy scalar would widen the arrays
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (vb**0.5 + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> dict | None:
    """Weights, bias and the two numbers of Platt's sigmoid; None without labels of both kinds."""
    def count(batch):
        made = []
        for t in batch.column("text").to_pylist():
            raw = t.encode("utf-8", "replace")
            made.append(np.concatenate(features(raw, word_codes(raw)[1])).astype(np.uint16).tobytes())
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "counts": made}

    got = map_rows(labelled(docs, labels, "quality", most), "doc_id long, y int, counts binary", count).collect()  # at most `most` rows
    got = sorted((r["doc_id"], r["y"], bytes(r["counts"])) for r in got)
    y = np.array([r[1] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    counts = np.array([np.frombuffer(r[2], np.uint16) for r in got])
    x = scaled(counts[:, :WORD_DIM], counts[:, WORD_DIM:])
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2:
        held[:] = False
    w, b = logistic(x[~held], y[~held], 1e-5)
    check = held if held.any() else ~held
    z = (x[check] @ w + b)[:, None].astype(np.float32)
    spread = float(np.abs(z).mean()) or 1.0
    slope, start = logistic(z / spread, y[check], 1e-3, 400, 0.1)
    return {"w": w, "b": b, "slope": float(slope[0]) / spread, "start": start}


def judged(texts: list[str | None], model: dict | None) -> tuple[list, list[bool], list[bool], list[float | None]]:
    """Base counts, base_failed, kept and the probability of quality 1 of each text."""
    rows, failed, probability = [], [], []
    for text in texts:
        counts, raw, codes = base(text)
        rows.append(counts)
        failed.append(base_failed(counts[0], counts[4]))
        if model is None or not len(codes):
            probability.append(None)
            continue
        z = float(scaled(*features(raw, codes)) @ model["w"] + model["b"])
        probability.append(float(1 / (1 + np.exp(-np.clip(model["slope"] * z + model["start"], -50, 50)))))
    kept = [not f and (p is None or p >= KEEP) for f, p in zip(failed, probability, strict=True)]
    return rows, failed, kept, probability


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, probability."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batch):
        rows, failed, kept, probability = judged(batch.column("text").to_pylist(), model)
        columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
        return {"doc_id": batch.column("doc_id"), **columns, "base_failed": failed, "kept": kept, "probability": probability}

    extra = ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, probability double"
    return map_rows(docs.select("doc_id", "text"), f"doc_id long, {extra}", work)


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The kept rows, with all their columns."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series(judged(texts.tolist(), model)[2], dtype=bool)

    return docs.where(keep("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
