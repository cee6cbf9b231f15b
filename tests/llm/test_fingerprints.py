"""Fingerprints against a sampler on lists, and their likeness against the generalised Jaccard similarity."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import xxhash

from quadrille.llm import fingerprints


def terms(text):
    out = []
    for w in "".join(" " if c in fingerprints.WHITE else c for c in text).split(" "):
        long = len(w.encode()) > fingerprints.LONG_BYTES
        out += [w[i : i + fingerprints.GRAM] for i in range(len(w) - fingerprints.GRAM + 1)] if long else [w]
    return Counter(out)


def xx(*values):
    """Spark's xxhash64 of longs and strings: each value is hashed with the hash before it as seed."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(4 if isinstance(v, Int) else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Int(int):
    """A 32-bit integer."""


def unit(h, shift, bits):
    return (((h % (1 << 64)) >> shift & (1 << bits) - 1) + 0.5) / (1 << bits)


def brute(text):
    """The samples of a text by their definition: low halves of the least (ln a, hash) of all terms."""
    out = []
    weights = {xx(w) & ~1: n for w, n in terms(text).items()}
    for k in range(fingerprints.SAMPLES):
        found = []
        for term, n in weights.items():
            one, two = xx(term, Int(2 * k)), xx(term, Int(2 * k + 1))
            r, beta = -math.log(unit(one, 0, 21) * unit(one, 21, 21)), unit(one, 42, 21)
            t = math.floor(math.log(n) / r + beta)
            log_a = math.log(-math.log(unit(two, 0, 31) * unit(two, 31, 31))) - r * (t - beta) - r
            found.append((max(min(int((log_a + 64.0) * (1 << 24)), (1 << 31) - 1), 0), xx(one, t) & (1 << 32) - 1))
        out.append(min(found)[1])
    return "".join(f"{x:08x}" for x in out)


def test_fingerprints(spark):
    random.seed(4)
    words = [f"w{i}" for i in range(500)]
    docs = [(i, " ".join(random.choices(words, k=400))) for i in range(60)] + [(60, None), (61, ""), (62, "same text"), (63, "same text"), (63, "same text"), (None, "ab")]
    script = "".join(chr(0x4E00 + random.randrange(2000)) for _ in range(1200))
    docs += [(70, script), (71, script[:1150]), (72, "a\tb\tc\nd " * 50), (73, "x" * 4000)]
    got = fingerprints.compared(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, at int")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in docs)
    order = sorted({(i if i is not None else -1, t or "") for i, t in docs})
    by = {r["doc_id"] if r["doc_id"] is not None else -1: r for r in got}
    errors, equal = [], 0
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert (by[i]["n_chars"], by[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for name, other in (("near_edited", edited), ("near_next", nxt)):
            a, b = terms(t), terms(other)
            errors.append(by[i][name] - sum((a & b).values()) / sum((a | b).values()))
        if i < 8 or i > 59:  # the samples, number by number; logarithms may differ in the last bit
            for name, own in (("fingerprint", t), ("edited_fingerprint", edited)):
                told, made = by[i][name], brute(own)
                equal += sum(told[8 * n : 8 * n + 8] != made[8 * n : 8 * n + 8] for n in range(fingerprints.SAMPLES))
    assert equal <= 2
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09 and max(map(abs, errors)) < 0.35
    assert by[62]["fingerprint"] == by[63]["fingerprint"] and by[62]["near_next"] == 1.0 and by[60]["fingerprint"] == by[61]["fingerprint"]
    assert by[70]["near_next"] > 0.75 and by[70]["near_edited"] > 0.4  # texts without blanks


def test_no_documents(spark):
    assert fingerprints.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0
