"""One-permutation MinHash against a plain version, and its estimates against the true similarity."""

import random
import re
from hashlib import sha256

import pytest
import xxhash

from glosspark.llm import minhash

SCHEMA = "doc_id long, text string, k string, h long, n int, bits string, copies int, idx int, edited string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def integers(*values):
    """XXH64 of 4-byte and 8-byte integers one after another."""
    seed = 42
    for v, size in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 8 * size) - 1).to_bytes(size, "little"), seed)
    return signed(seed)


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)][: len(words)]


def fingerprint(text):
    grams = shingles(text)
    if not grams:
        return ""
    bins = {}
    for g in grams:
        h = signed(chain([xxhash.xxh64_intdigest(w.encode(), 42) for w in g]))
        b = (h >> 56) + 128
        if h & minhash.LOW != minhash.LOW:
            bins[b] = min(bins.get(b, h), h)
    out = []
    for i in range(256):
        places = [i, *(integers((i, 4), (a, 4)) % 256 for a in range(minhash.ATTEMPTS))]
        at = next((p for p in places if p in bins), None)
        if at is None:
            at = min(bins, key=lambda b: (integers((i, 4), (b - 128, 8)), bins[b]))
        out.append(bins[at] & 255)
    return bytes(out).hex()


def near(a, b):
    if not a or not b:
        return float(a == b)
    e = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 512, 2)) / 256
    return max(0.0, (e - 1 / 256) / (1 - 1 / 256))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)), len(r[1] or "")))
    out = []
    for r, following in zip(order, order[1:] + order[:1]):
        text, other = r[1] or "", following[1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        f, g = fingerprint(text), fingerprint(new)
        out.append((r[0], len(text), sha256(new.encode()).hexdigest(), f, g, round(near(f, g), 9), round(near(f, fingerprint(other)), 9), following[0]))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "b", 3, 4, "e") for r in rows], SCHEMA)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.next_doc_id) for r in df.collect()), key=repr)


def words(rng, n, k=400):
    return " ".join(f"W{rng.randint(0, k)}" + rng.choice(["", "", "é", "É", "\t", "\n", " "]) for _ in range(n))


def test_report(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 500), words(rng, rng.choice([1, 2, 4, 5, 6, 10, 40, 300]))) for _ in range(120)]
    rows += [(None, "a b"), (None, None), (None, "a b"), (7, ""), (8, None), (9, " \n\t"), (3, "same text"), (3, "same text"), (3, "same text"), (4, "same text"), (11, "🙂 漢字 é " * 30), (12, words(rng, 30_000, 10**6))]
    assert got(minhash.report(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_sizes(spark, n):
    rows = [(i, f"one two three four five six {i}") for i in range(n)]
    assert got(minhash.report(table(spark, rows))) == brute(rows)


def test_estimates(spark):
    """The mean error over pairs of known similarity is small: the correction is free of bias."""
    rng = random.Random(5)
    rows, true = [], []
    for i in range(150):
        base = [f"x{rng.random()}" for _ in range(rng.choice([60, 200, 800]))]
        cut = rng.randint(0, len(base))
        other = base[:cut] + [f"y{rng.random()}" for _ in range(len(base) - cut)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        a, b = (set(shingles(t)) for _, t in rows[-2:])
        true.append(len(a & b) / len(a | b))
    found = {r.doc_id: r.near_next for r in minhash.report(table(spark, rows)).collect()}
    error = [found[2 * i] - t for i, t in enumerate(true)]
    assert abs(sum(error) / len(error)) < 0.015 and max(map(abs, error)) < 0.2


def test_plan_is_native(spark):
    plan = minhash.report(table(spark, [(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
