"""Quality rules, mixing, tokens, media and the pipeline."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from glosspark.llm import flac, mixing, pieces, rules


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, marked = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            marked |= {i, i + 1, i + 2}
    rows = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(rows) - len(set(rows)), len(marked)


def test_rules(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("the of and house Water, river. goes to a is".split()) + rng.choice(["", "s", "ing"]) for _ in range(n))
    texts = [prose(150) for _ in range(30)] + ["#$% " * 120, None, "", "a b c a b c", " \n\n x\nx\nx ", "one two", "é ü " * 60]
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, 9) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n = base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert not got[31].kept and not got[32].kept
    assert rules.judge(df.filter("false")).count() == 0


def test_distance(spark):
    row = spark.createDataFrame([([1, 1, 0], [1, 1, 0], [0, 0, 5])], "a array<bigint>, b array<bigint>, c array<bigint>").select(rules.distance("a", "b").alias("x"), rules.distance("a", "c").alias("y")).first()
    assert row.x == 0 and abs(row.y - 1) < 1e-12


def test_mixing(spark):
    rng = random.Random(9)
    docs = [(i, "w " * rng.randint(0, 40), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(600)] + [(700, None, None), (701, "a b", None), (701, "a b", None), (None, "x y z", "s1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").split()) and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6 * total
    weight = dict(zip(sorted(s for s in by if s) + [None], [5, 2, 1] * 3))
    free = []
    for s, own in by.items():
        size = sum(r.size for r in own)
        assert own[0].source_size == size and own[0].target <= 2 * size + 1e-9
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(3, 0.02 * own[0].target)
        if own[0].target < 2 * size - 1e-9:
            free.append(own[0].target / weight[s])
    assert not free or max(free) - min(free) < 1e-6 * max(free)
    key = lambda rs: sorted((str(r.doc_id), str(r.text), r.taken) for r in rs)
    assert key(mixing.mix(df.repartition(5)).collect()) == key(rows)
    assert mixing.repeat_copies(df).count() == sum(r.copies for r in rows)
    assert mixing.mix(df.filter("false")).count() == 0


def model_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


def test_tokens(spark):
    path = model_path()
    model = pieces.load(path)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "▁", "é", "漢", "🙂", "\x00", "<s>", "</s>", "<0x0A>", "ing", ".", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)] + [None, "", " ", "word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = {r.doc_id: r for r in pieces.encode_documents(df, path).collect()}
    short = {r.doc_id: r for r in pieces.encode_digests(df, path).collect()}
    for i, t in enumerate(texts):
        ids = model.library.encode(t or "", add_bos=True, add_eos=True)
        assert full[i].ids == ids and full[i].decoded == model.library.decode(ids)
        assert short[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and short[i].n_tokens == len(ids)
        raw = (t or "").encode()
        assert (full[i].ends[-1] if full[i].ends else 0) == len(raw) and full[i].ends == sorted(full[i].ends)
        if len(raw) < 1000 and ids[1:-1]:
            normal, source = pieces.normalise(t or "", model.rules)
            assert [int(source[e]) for e in np.cumsum(model.widths[ids[1:-1]])] == full[i].ends and len(normal) == model.widths[ids[1:-1]].sum()


def trie(entries):
    """A character map over single-byte chains, laid out sparsely: one block of 256 units per node."""
    nodes, values, texts = {b"": 0}, {}, b""
    for key, to in entries.items():
        for k in range(1, len(key) + 1):
            nodes.setdefault(key[:k], len(nodes))
        values[key] = len(texts)
        texts += to + b"\0"
    units = np.zeros((len(nodes) + 1) * 512 + 512, np.uint32)
    place = {b"": 0}
    base = lambda n: (nodes[n] + 1) * 512
    for prefix in sorted(nodes, key=len):
        at = place[prefix]
        label = prefix[-1] if prefix else 0
        offset = at ^ base(prefix)
        units[at] = (offset << 10 if offset < 1 << 21 else 0) | (1 << 8 if prefix in values else 0) | label
        if prefix in values:
            units[base(prefix)] = values[prefix] | 1 << 31
        for child in nodes:
            if len(child) == len(prefix) + 1 and child.startswith(prefix):
                place[child] = base(prefix) ^ child[-1]
    return len(units.tobytes()).to_bytes(4, "little") + units.tobytes() + texts


def test_compiled_character_map():
    table = pieces.CharsMap.parse(trie({b"ab": b"X", b"abc": b"YZ", "é".encode(): b"e", b"\t": b" "}))
    normal, source = pieces.normalise("abcd abé\t!", pieces.Rules(table))
    assert normal.decode() == "▁YZd▁Xe▁!" and source.tolist() == [0, 0, 0, 0, 0, 3, 4, 4, 4, 5, 7, 9, 9, 9, 10, 11]
    normal, source = pieces.normalise("  a  b ", pieces.Rules(table, remove_extra=True))
    assert normal.decode() == "▁a▁b" and source[0] == 2 and source[-1] == 7


def test_flac_streams():
    rng = np.random.default_rng(1)
    rows = [b"", b"a", b"a" * 5000, rng.integers(0, 256, 3333).astype(np.uint8).tobytes(), bytes(np.clip(128 + 100 * np.sin(np.arange(5000) / 5), 0, 255).astype(np.uint8)), bytes((np.cumsum(rng.integers(-3, 4, 9000)) % 256).astype(np.uint8)), "hällo wörld ".encode() * 300]
    offsets, payload = flac.padded(np.cumsum([0, *map(len, rows)]), np.frombuffer(b"".join(rows), np.uint8))
    kinds = set()
    for lpc in (None, ((1961, -1000), 10), ((7, -5), 2)):
        streams = flac.encode_streams(offsets, payload, lpc)
        blocks = flac.decode_streams(streams)
        assert blocks.ok.all() and ((blocks.pcm + 128).astype(np.uint8) == payload).all()
        bare = []
        for s in streams:
            at, total, digest, seek = flac.open_stream(s)
            assert digest and len(seek) == -(-total // flac.BLOCK)
            kinds |= {s[at + b + flac.read_header(s, at + b)[0]] >> 1 for b, _ in seek}
            bare.append(s[:4] + bytes([0x80]) + s[5:42] + s[at:])
        again = flac.decode_streams(bare)
        assert again.ok.all() and (again.pcm == blocks.pcm).all()
    assert {0, 1, 8, 33} <= kinds  # constant, verbatim, fixed and quantised predictors were met
    broken = bytearray(streams[5])
    broken[-40] ^= 1
    assert flac.decode_streams([bytes(broken)]).ok.tolist().count(False) == 1
    with pytest.raises(ValueError):
        flac.decode_streams([b"RIFF" + bytes(60)])


def test_media(spark):
    texts = ["", None, "abc", "abc", "é" * 1000, "z" * 64, "y" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in flac.media_report(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2][1:] == got[3][1:]
    blocks = flac.pcm_blocks(flac.with_media(df).drop("text")).filter("doc_id = 4 AND first_sample >= 1024").collect()
    assert [b.first_sample for b in blocks] == [1024] and all(b.crc_ok for b in blocks)
    assert flac.media_report(df.filter("false")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert docs.columns == columns or name == "tokens"
    assert counts[0] > counts[1] >= counts[2] == counts[3] and counts[4] == counts[5]
    assert corpus_pipeline.run(spark, sf).count() == counts[5]
