"""The source audit against plain counting."""

import collections
import random
import re

import pytest

from glosspark.llm import divergence
from glosspark.llm.tries import Trie

SCHEMA = "doc_id long, text string, lang string, source string, a int, term string, value long, groups string, ps string"


def brute(rows, least, top):
    occurs, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang].add(source)
        occurs[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    order = lambda x: (-x[1], x[0].encode())
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = {s: sum(occurs[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (occurs[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in sources}
        whole = sum(total.values())
        q = {t: 1 + 10**9 * (sum(occurs[lang, s][t] for s in sources) + 5) // (whole + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted(((x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in sources if x != s), key=order)
            terms = sorted(((t, p[s][t] - q[t]) for t in kept if occurs[lang, s][t] and p[s][t] > q[t]), key=order)[:top]
            out |= {(lang, s, part, item, v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (item, v) in enumerate(found, 1)}
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "a", "ab", "abc", "abd", "é", "éa", "漢字", "bé", "zz", "x1y", "don't", "🙂", "Ä", "ä"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["s1", "s2", "", None, "é", "z"])
        bias = rng.choice(words) if source != "hot" else "the"
        yield i, rng.choice(["", None, " ", "12 34"]) if i % 40 == 0 else " ".join(rng.choices([*words, bias, bias, bias], k=rng.randint(1, 30))), rng.choice(["en", "en", "en", "de", "", None]), source


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "g", "p") for r in rows], SCHEMA)


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("cells", [divergence.CELLS, 50])
def test_audit(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)  # tries that leave the task again and again
    rows = list(corpus(900, 1))
    rows += [rows[5], rows[5], (9000, "lone words " * 3, "xx", "only"), (9001, "nothing kept", "yy", "a"), (9002, None, "yy", "b"), (9003, "Word " * 50_000, "en", "long")]
    want = brute(rows, 30, 50)
    assert got(divergence.audit(table(spark, rows).repartition(7))) == want
    assert any(x[2] == "term" for x in want) and any(x[5] > 3 for x in want)


def test_salted(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 0)
    rows = list(corpus(400, 2))
    assert got(divergence.audit(table(spark, rows), 5, 7)) == brute(rows, 5, 7)


def test_empty(spark):
    assert divergence.audit(table(spark, [(1, "a", "b", "c")]).filter("false")).count() == 0


def test_tries():
    rng = random.Random(3)
    terms = ["".join(rng.choices("abé漢", k=rng.randint(1, 6))).encode() for _ in range(3000)]
    whole, parts = Trie(), [Trie() for _ in range(3)]
    for i, t in enumerate(terms):
        whole.add(t, 1, {f"s{i % 4}": 2})
        parts[i % 3].add(t, 1, {f"s{i % 4}": 2})
    for p in parts[1:]:
        parts[0].merge(p)
    want = collections.Counter(terms)
    assert [(t, n) for t, n, _ in whole.leaves()] == sorted(want.items())
    assert list(whole.leaves()) == list(parts[0].leaves()) and all(sum(c.values()) == 2 * n for _, n, c in whole.leaves())


def test_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    raw = "aaa bbbbbbbb é漢é漢é漢 c".encode()
    assert [t for found in divergence.pieces(raw, 0, len(raw)) for t in found] == raw.split()
