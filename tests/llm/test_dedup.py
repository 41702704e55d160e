"""Suffix-array, SimHash and line dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import xxhash

from glosspark.llm import components, lines, sais, simhash, suffix


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 40, 300):
        for _ in range(30):
            a = np.append(rng.integers(1, rng.integers(2, 6), n), 0).astype(np.int64)
            sa, s = sais.suffix_array(a, int(a.max()) + 1), a.tolist()
            want = sorted(range(len(s)), key=lambda i: s[i:])
            assert sa.tolist() == want
            lcp = sais.permuted_lcp(a, sa)
            for x, y in zip(want, want[1:]):
                k = 0
                while s[x + k] == s[y + k]:
                    k += 1
                assert lcp[y] == k


def test_repeated_windows():
    rng = np.random.default_rng(5)
    for _ in range(15):
        base = rng.integers(97, 97 + rng.integers(1, 26), 3000).astype(np.uint8).tobytes()
        texts = set()
        for _ in range(40):
            i = rng.integers(0, 2000)
            x = bytearray(base[i : i + rng.integers(380, 736)])
            if rng.random() < 0.7:
                x[rng.integers(0, len(x))] = 33
            texts.add(bytes(x))
        texts = list(texts)
        got = suffix.repeated_windows(np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8))
        c = collections.Counter(x[i : i + 400] for x in texts for i in range(len(x) - 399))
        assert got.tolist() == [c[x[i : i + 400]] > 1 for x in texts for i in range(len(x) - 399)]


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    c = collections.Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for b in raw:
        covered = bytearray(len(b))
        for i in range(len(b) - 399):
            if c[b[i : i + 400]] > 1:
                covered[i : i + 400] = b"\1" * 400
        runs = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        yield len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, y in zip(b, covered) if not y)).hexdigest()


def texts_with_repeats():
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefg é\n") for _ in range(n))
    passage, doc = noise(900), noise(2500)
    out = [noise(700) + passage + noise(300) for _ in range(6)] + [doc, doc, doc[:1200] + "#" + doc[1200:], passage * 2]
    return out + [None, "", "a" * 3000, "a" * 399, "x" * 400, "ab" * 700, noise(50), noise(90) + "Is it. " * 300 + noise(90), "Is it. " * 120 + noise(500)]


def test_suffix_dedup(spark):
    texts = texts_with_repeats()
    df = spark.createDataFrame([(i if i % 4 else None, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_spans string").repartition(3)
    want = collections.Counter(brute(texts))
    got = collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df).collect())
    assert got == want
    left = suffix.strip(df)
    assert left.columns == df.columns and left.count() == len(texts)
    assert suffix.dedup(df.filter("false")).count() == 0


def test_hot_anchors(spark):
    texts = texts_with_repeats()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_key = {bytes(r.key): r.spans for r in suffix.repeated_spans(df, hot=2).collect()}
    for t, (_, removed, *_rest) in zip(texts, brute(texts)):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for x in by_key.get(hashlib.md5(raw).digest(), []):
            covered[x.s : x.e] = b"\1" * (x.e - x.s)
        assert sum(covered) == removed


def first_kept(texts, length):
    """Each text without the bytes of windows that have an equal one in a text of smaller MD5, or before in the same text."""
    raw = {hashlib.md5((t or "").encode()).digest(): (t or "").encode() for t in texts}
    seen, out = set(), {}
    for key in sorted(raw):
        b, covered = raw[key], bytearray(len(raw[key]))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        out[b] = bytes(x for x, y in zip(b, covered) if not y).decode("utf-8", "ignore")
    return [None if t is None else out[t.encode()] for t in texts]


def test_first_occurrence_stays(spark):
    texts = texts_with_repeats()
    docs = [(i, t, "kept", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string, key int").repartition(3)
    for length in (200, 400):
        got = {r.doc_id: r.text for r in suffix.strip(df, length=length, first=True).collect()}
        assert [got[i] for i in range(len(texts))] == first_kept(texts, length)


def test_hot_anchors_first(spark, monkeypatch):
    texts = texts_with_repeats()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", ("text", 2, 400, False))
    got = {r.doc_id: r.text for r in suffix.strip(df, length=200, first=True).collect()}
    assert [got[i] for i in range(len(texts))] == first_kept(texts, 200)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_documents(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("ABcd é") for _ in range(rng.randint(0, 80))) for _ in range(30)]
    texts = base + [b + " tail" for b in base] + base[:5] + [None, "", "one", "One", "two words"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [fingerprint(t) for t in texts]
    want = roots(fps)
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == want[i]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_covering_loses_no_link(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for flips in (1, 2, 3, 4, 3):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), flips)))
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.fp: r.root for r in simhash.classes(df).collect()}
    want = roots(values)
    classes = collections.defaultdict(set)
    for v, w in zip(signed, want):
        classes[w].add(found.get(v, v))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lines(spark):
    long_ = " ".join(f"w{i}" for i in range(20))
    docs = [(3, f"x\n{long_}\ny"), (1, f"{long_.upper()}  \nshort"), (2, f"é\n\t{long_}\n{long_}"), (None, long_), (4, None), (5, "short\nshort")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.start, r.stop, r.first_doc_id, r.first_start, r.copies) for r in lines.repeated_units(df, unit="line").collect()}
    n = len(long_)
    assert got == {(3, 2, 2 + n, 1, 0, 5), (2, 4, 4 + n, 1, 0, 5), (2, 5 + n, 5 + 2 * n, 1, 0, 5), (None, 0, n, 1, 0, 5)}
    more = df.selectExpr("doc_id", "text", "doc_id AS id", "text AS h", "1 AS spans", "2 AS row")
    for unit in ("line", "mixed"):
        left = lines.strip(more, unit=unit)
        assert left.columns == more.columns
        assert {r.doc_id: r.text for r in left.collect()} == {3: "x\ny", 1: docs[1][1], 2: "é\n\t", None: "", 4: None, 5: "short\nshort"}
    paragraphs = spark.createDataFrame([(1, "a b\nc\n \nd"), (2, "x\n\na B c")], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.stop) for r in lines.repeated_units(paragraphs, unit="paragraph", min_words=3).collect()] == [(2, 3, 8)]
    assert lines.repeated_units(df.filter("false")).count() == 0


def pieces_by_hand(docs, least):
    """Removed runs of pieces, by a scan in order of the ids."""
    seen, out = set(), set()
    for doc_id, text in docs:
        run, last, words = [], None, []
        units = []
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
            w = re.sub(rb"[A-Z]", lambda x: x[0].lower(), m[0])
            if last is None or hashlib.md5(words[-1]).hexdigest() < lines.CUT:
                units.append([[], m.start(), 0])
            units[-1][0].append(w)
            units[-1][2] = m.end()
            last = m
            words.append(w)
        for u in [*units, None]:
            if u and tuple(u[0]) in seen:
                run.append(u)
                continue
            if sum(len(x[0]) for x in run) >= least:
                out.add((doc_id, run[0][1], run[-1][2]))
            run = []
            if u:
                seen.add(tuple(u[0]))
    return out


def test_pieces(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice(["the", "Of", "é", "wort", "x1", "lang", "and"]) + str(rng.choice(["", rng.randrange(40)])) + rng.choice([" ", "  ", " ", "\n", "\t"]) for _ in range(n))
    passage = noise(60)
    texts = [noise(rng.randrange(80)) + (passage if k % 3 == 0 else "") + noise(rng.randrange(30)) for k in range(24)] + ["", None, passage * 2, "the " * 9000]
    docs = list(enumerate(texts))
    got = {(r.doc_id, r.start, r.stop) for r in lines.repeated_units(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), unit="piece").collect()}
    assert got == pieces_by_hand(docs, lines.MIN_WORDS) and len(got) >= 8
