"""Cleaners, judgments, tokenizers, the line layer and words."""

import random

from pyspark.sql import functions as F

from glosspark.functions import text as T
from glosspark.functions.stem import stem
from glosspark.operators import lines, words


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_cleaners_keep_columns(spark):
    line = "   (iv) Moruta        kelada-ma=n.         (2) *Moruta kelada=n."
    assert one(spark, line, T.clean_lang) == line[:-1].replace("(iv)", "    ").replace("(2)", "   ") + " "
    quoted = "         `We sold an old boat.'              `We sold one of the old boats.'"
    assert len(one(spark, quoted, T.clean_trans)) == len(quoted)
    line = "  (7)     Ella siempre     (*le) dice [x todo bien]"
    assert one(spark, line, T.clean_lang) == line.replace("(7)", "   ").translate(str.maketrans("()[]", "    "))
    assert one(spark, "Luis     2PL . DAT   1SG . F . ACC   past. HAB .2 SG", T.clean_gloss) == "Luis     2PL.DAT   1SG.F.ACC   past.HAB.2SG"
    assert one(spark, "they hope to leave the old harbour", T.hyphenate_infinitive) == "they hope to-leave the old harbour"


def test_common_indent(spark):
    got = spark.createDataFrame([(["    a", "      b", "     c"],)], "x array<string>").select(T.common_indent(F.col("x")).alias("y")).first().y
    assert got == ["a", "  b", " c"]


def test_judgments(spark):
    cases = {"      *'Sold every   boat, he did'": "*", " ?Nobody say so": "?", "  who knows?": None, "?*      b.  Tolu": "?*", "fine": None}
    for text, want in cases.items():
        assert one(spark, text, T.judgment) == want, text
    assert one(spark, "   '*Sold every", T.unjudged) == "   ' Sold every"


def test_tokens(spark):
    assert one(spark, "don't pay $3.50, é-x", T.sentence_tokens) == ["don't", "pay", "$3.50", ",", "é", "-x"]
    assert one(spark, "read.1sg-DEF=3fsg (x)", T.morphs) == ["read", "1sg", "DEF", "3fsg", "x"]
    assert [tuple(t) for t in one(spark, "a/b/N c/V", T.tagged)] == [("a/b", "N"), ("c", "V")]
    assert one(spark, "a/N b/V", T.untag) == "a b"
    assert [tuple(t) for t in one(spark, " ab  ab c", lambda x: T.with_offsets(x, T.words(x)))] == [("ab", 1, 3, 1), ("ab", 5, 7, 2), ("c", 8, 9, 3)]
    assert [tuple(t) for t in one(spark, "w1[0:2]+w4[2:3],p1", T.parse_reference)] == [("w1", 0, 2), ("w4", 2, 3), ("p1", None, None)]
    assert one(spark, "A:b#c d/e", T.gram_form) == "a-b-cd"


def test_columns(spark):
    row = spark.createDataFrame([("Katumaro bo     pelinda-si=o", "take.3pl.MAS    baskets IND")], "a string, b string")
    got = row.select(T.strict_columns("a", "b").alias("p")).first().p
    assert {tuple(p) for p in got} == {(1, 1), (2, 1), (3, 2), (3, 3)}


def test_stems():
    for word, want in {"kicks": "kick", "kicked": "kick", "happily": "happili", "running": "run", "hoping": "hope", "national": "nation", "flies": "fli", "dying": "die", "is": "is"}.items():
        assert stem(word) == want, word


def test_line_layer(spark):
    raw = spark.createDataFrame(
        [("i", 1, "r1", "L+CN", "  1. ab"), ("i", 2, "r2", "L+SEG", "-cd ef"), ("i", 3, "r3", "G", "   x-y z"), ("i", 4, "r4", "T", "  'It is.'"), ("i", 5, "r5", "M", None)],
        "igt_id string, ord int, item_id string, tag string, text string",
    )
    clean = {r.tag: r for r in lines.clean_lines(raw).collect()}
    assert clean["L"].text == "  1. ab-cd ef" and clean["L"].sources == ["r1", "r2"] and set(clean) == {"L", "G", "T", "M"}
    normal = lines.normal_lines(lines.clean_lines(raw))
    got = {r.tag: r.text for r in normal.collect()}
    assert set(got) == {"L", "G", "T"} and got["G"].strip() == "x-y z"
    tokens = words.words(normal)
    assert {(r.tier, r.tok) for r in tokens.collect()} >= {("gw", "x-y"), ("gw", "z"), ("tw", "It"), ("w", "ef")}
    line = {t: got[t] for t in got}
    for r in tokens.collect():
        assert line[{"w": "L", "gw": "G", "tw": "T"}[r.tier]][r.start : r.stop] == r.tok
    for r in words.morphs(tokens).filter("tier = 'g'").collect():
        assert line["G"][r.start : r.stop] == r.tok


def test_merge_lines(spark):
    """Words dealt out over lines, each in its own columns, come together again; a word that would cover another is left out."""
    rng = random.Random(7)
    rows = []
    for _ in range(50):
        want, own = "", [""] * 3
        for _ in range(rng.randint(1, 9)):
            word, k = "".join(rng.choices("abcé", k=rng.randint(1, 6))), rng.randrange(3)
            want += " " * rng.randint(1, 3)
            own[k] = own[k].ljust(len(want)) + word
            want += word
        rows.append((own, want))
    df = spark.createDataFrame([(i, lines_) for i, (lines_, _) in enumerate(rows)], "i int, x array<string>")
    got = {r.i: r.y for r in df.select("i", lines.merge_lines(F.col("x")).alias("y")).collect()}
    assert all(got[i].rstrip() == want for i, (_, want) in enumerate(rows))
    assert spark.createDataFrame([(["aa  bb", " xx cc"],)], "x array<string>").select(lines.merge_lines(F.col("x")).alias("y")).first().y == "aa  bb"
