"""Reading in byte ranges against reading files whole."""

import random

import pytest
from pyspark.sql import functions as F

from glosspark.sources import split, tagged


@pytest.fixture()
def ranges(spark):
    """Ranges of a few dozen bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "40b")
    yield
    for n, b in zip(names, before):
        spark.conf.set(n, b)


def folder(tmp_path, seed, end="\n"):
    rng = random.Random(seed)
    at = tmp_path / "files"
    at.mkdir()
    for k in range(4):
        rows = [rng.choice(["", " ", "\t ", "a", "  b c", "dd e ", "é" * 30, "x" * 100, "(S (A b)", ")", "f  "]) for _ in range(rng.choice([0, 1, 30, 120]))]
        (at / f"f{k}").write_text(end.join(rows) + rng.choice(["", end, end * 3]), newline="")
    return str(at)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n"), (4, "\n")])
def test_lines_and_blocks(spark, ranges, tmp_path, seed, end):
    path = folder(tmp_path, seed, end)
    rows = split.lines(spark, path)
    assert rows.select("file", "split").distinct().count() > 4
    whole = tagged.whole(spark, path)
    keep = lambda df: {(r.file.rsplit("/", 1)[1], r.line, r.text) for r in df.collect() if r.text}
    assert keep(rows) == keep(tagged.lines(whole))
    pick = lambda df: {(r.file.rsplit("/", 1)[1], r.block, r.text.replace("\r", "")) for r in df.collect()}
    assert pick(split.blocks(rows)) == pick(tagged.blocks(whole))


def test_running_and_line_before(spark, ranges, tmp_path):
    (tmp_path / "a").mkdir()
    values = [random.Random(5).randint(-3, 9) for _ in range(200)]
    (tmp_path / "a" / "x").write_text("".join(f"{v}\n" for v in values))
    rows = split.lines(spark, str(tmp_path / "a"))
    number = F.col("text").cast("int")
    got = split.line_before(split.running(split.running(rows, number, "s"), F.when(number > 5, number), "m", "max"), number, "p").orderBy("line").collect()
    for i, r in enumerate(got):
        seen = [v for v in values[: i + 1] if v > 5]
        assert (r.line, r.s, r.m, r.p) == (i, sum(values[: i + 1]), max(seen) if seen else None, values[i - 1] if i else None)


def test_readers(spark, ranges, tmp_path):
    rng = random.Random(6)
    sents = [[(f"w{rng.randint(0, 99)}", rng.choice("NV")) for _ in range(rng.randint(1, 6))] for _ in range(80)]
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    conll = put("conll", "\n\n".join("\n".join(f"{i}\t{w}\t_\t{t}\t_\t_\t{i - 1}\tdep" for i, (w, t) in enumerate(s, 1)) for s in sents))
    assert {(r.sent, r.idx, r.form, r.label, r["head"]) for r in tagged.read_conll(spark, conll).collect()} == {(k, i, w, t, i - 1) for k, s in enumerate(sents) for i, (w, t) in enumerate(s, 1)}
    slash = put("slash", "\n".join(" ".join(f"{w}/{t}" for w, t in s) for s in sents) + "\n")
    assert {(r.sent, r.idx, r.form, r.label) for r in tagged.read_slashtags(spark, slash).collect()} == {(k, i, w, t) for k, s in enumerate(sents) for i, (w, t) in enumerate(s, 1)}
    trees = put("trees", "\n".join("(S\n  " + "\n  ".join(f"({t} {w})" for w, t in s) + ")" for s in sents))
    assert {(r.tree_no, r.tree) for r in tagged.read_trees(spark, trees).collect()} == {(k, "(S " + " ".join(f"({t} {w})" for w, t in s) + ")") for k, s in enumerate(sents)}
    records = put("records", "\n\n".join(f"doc_id={k} 1 2 L G\nline=1 tag=L:é{s[0][0]}\nline=2 tag=G: g" for k, s in enumerate(sents)) + "\n")
    got = {(r.doc_id, r.tag, r.text) for r in tagged.read_records(spark, records, encoding="UTF-8").collect()}
    assert got == {(str(k), t, x) for k, s in enumerate(sents) for t, x in (("L", f"é{s[0][0]}"), ("G", " g"))}
    (tmp_path / "latin").write_bytes("doc_id=1 1 2 L\nline=1 tag=L:café\n".encode("iso-8859-1"))
    assert [r.text for r in tagged.read_records(spark, str(tmp_path / "latin")).collect()] == ["café"]
    pairs = put("pairs", "".join(f"# Sentence pair ({k}) source length 1\nx y\nNULL ({{ }}) x ({{ {k} 2 }})\n" for k in range(1, 60)))
    assert {(r.pair, r.src, r.tgt) for r in tagged.read_a3(spark, pairs).collect()} == {(k, 1, t) for k in range(1, 60) for t in (k, 2)}
