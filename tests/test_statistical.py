"""Statistical alignment of tiers, preferred layers, and the full enrichment."""

import collections

import pytest

from glosspark.operators import align, features, tiers
from glosspark.plans import enrich, statistical

NULL = "NULL"
SENTENCES = {1: ("the red Box", "die rote Kiste"), 2: ("the box", "die Kiste"), 3: ("red", "rote"), 4: ("a  red box", "eine rote Kiste"), 5: ("alone", ""), 6: ("the", "die")}


def tokens(spark, side):
    rows = [(k, i, w) for k, both in SENTENCES.items() for i, w in enumerate(both[side].split(), 1)]
    return spark.createDataFrame(rows, "igt_id long, idx int, tok string")


def model1(pairs, rounds):
    """Links of every target word to its best source word under Model 1."""
    t = collections.defaultdict(lambda: 1.0)
    for _ in range(rounds):
        counts, total = collections.Counter(), collections.Counter()
        for es, fs in pairs.values():
            for f in fs:
                z = sum(t[e, f] for e in [NULL, *es])
                for e in [NULL, *es]:
                    counts[e, f] += t[e, f] / z
                    total[e] += t[e, f] / z
        t = collections.defaultdict(float, {k: c / total[k[0]] for k, c in counts.items()})
    out = set()
    for k, (es, fs) in pairs.items():
        for j, f in enumerate(fs, 1):
            i = max(range(len(es) + 1), key=lambda i: (round(t[[NULL, *es][i], f], 9), -i))
            if i and isinstance(k, int):
                out.add((k, i, j))
    return out


@pytest.mark.parametrize("symmetrize", [None, "intersection", "union", "grow_diag_final", "refined"])
def test_model1_both_ways(spark, symmetrize):
    pairs = {k: (a.lower().split(), b.lower().split()) for k, (a, b) in SENTENCES.items() if a and b}
    more = {"x1": (["box"], ["kiste"]), "x2": (["box"], ["kiste"])}
    extra = spark.createDataFrame([("Box", "Kiste"), ("box", "kiste")], "src_tok string, tgt_tok string")
    there = model1(pairs | more, 5)
    back = {(k, j, i) for k, i, j in model1({k: (f, e) for k, (e, f) in (pairs | more).items()}, 5)}
    got = {tuple(r) for r in statistical.aligned(tokens(spark, 0), tokens(spark, 1), ["igt_id"], "ibm1", symmetrize, extra).collect()}
    if symmetrize is None:
        assert got == there
    elif symmetrize == "intersection":
        assert got == there & back
    elif symmetrize == "union":
        assert got == there | back
    else:
        a, b = (spark.createDataFrame(sorted(x), "igt_id long, src int, tgt int") for x in (there, back))
        combine = {**align.SYMMETRIZERS, "refined": align.refined}[symmetrize]
        assert got == {tuple(r) for r in combine(a, b, ["igt_id"]).collect()}


def test_other_methods_and_stored_tables(spark, tmp_path):
    src, tgt = tokens(spark, 0), tokens(spark, 1)
    for method in ("hmm", "diagonal"):
        assert {(1, 2, 2), (4, 2, 2), (3, 1, 1)} <= {tuple(r) for r in statistical.aligned(src, tgt, ["igt_id"], method, "union").collect()}
    folders = (str(tmp_path / "there"), str(tmp_path / "back"))
    seen = statistical.train_stored(src, tgt, ["igt_id"], folders, iterations=2)
    assert all(len(x) == 2 for x in seen)
    got = {tuple(r) for r in statistical.aligned(src, tgt, ["igt_id"], "fertility", "intersection", stored=folders).collect()}
    assert {(2, 2, 2), (3, 1, 1), (6, 1, 1)} <= got
    with pytest.raises(ValueError):
        statistical.aligned(src, tgt, ["igt_id"], "no such")
    with pytest.raises(ValueError):
        statistical.aligned(src, tgt, ["igt_id"], "ibm1", "no such")


def test_parallel_lines(spark, tmp_path):
    (tmp_path / "a").write_text("x y\n\nz \n")
    (tmp_path / "b").write_text("p\nq\nr s\n")
    a, b = statistical.parallel_lines(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert {tuple(r) for r in a.collect()} == {(0, 1, "x"), (0, 2, "y"), (2, 1, "z")}
    assert {tuple(r) for r in b.collect()} == {(0, 1, "p"), (1, 1, "q"), (2, 1, "r"), (2, 2, "s")}


def test_preferred(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "b", 3), (3, "c", 4), (4, "a", 5), (4, "a", 6)]
    layers = spark.createDataFrame(rows, "igt_id long, method string, v int")
    pick = lambda order: {(r.igt_id, r.v) for r in statistical.preferred(layers, order, ["igt_id"]).collect()}
    assert pick(["b", "a"]) == {(1, 2), (2, 3), (4, 5), (4, 6)}
    assert pick(["a", "b", "c"]) == {(1, 1), (2, 3), (3, 4), (4, 5), (4, 6)}


RAW = [
    (1, 1, "r1", "L", "koira juoksee kotiin"), (1, 2, "r2", "G", "dog run.3SG home"), (1, 3, "r3", "T", "The dog runs home."),
    (2, 1, "r1", "L", "kissa nukkuu"), (2, 2, "r2", "G", "cat sleep"), (2, 3, "r3", "T", "Somebody dreams"),
    (3, 1, "r1", "L", "yksin"), (3, 3, "r3", "T", "Alone"),
]


def raw(spark):
    return spark.createDataFrame(RAW, "igt_id long, ord int, item_id string, tag string, text string")


def test_enrich_full(spark):
    tags = spark.createDataFrame([(1, 2, "NOUN"), (1, 3, "VERB")], "igt_id long, idx int, label string")
    phrases = spark.createDataFrame([(1, "(S (NP (DT The) (NN dog)) (VP (VB runs) (RB home)))")], "igt_id long, tree string")
    parses = spark.createDataFrame([(1, "det(dog-2, The-1)\nnsubj(runs-3, dog-2)\nroot(ROOT-0, runs-3)\nadvmod(runs-3, home-4)")], "igt_id long, edges string")
    out = enrich.enrich_full(raw(spark), ["heur"], tags=tags, phrases=phrases, dependencies=parses)
    links = {(r.igt_id, r.src, r.tgt) for r in out["trans_lang"].collect()}
    assert links == {(1, 2, 1), (1, 3, 2), (1, 4, 3)}
    assert {(r.idx, r.label) for r in out["lang_tag"].collect()} == {(1, "NOUN"), (2, "VERB")}
    words = out["token"].filter("tier = 'w'").selectExpr("igt_id", "idx", "'w' || idx AS item_id", "tok")
    back = tiers.brackets(tiers.phrase_nodes(out["lang_ps"], words, ["igt_id"]), ["igt_id"]).collect()
    assert [(r.igt_id, r.tree) for r in back] == [(1, "(S (NP (NN koira)) (VP (VB juoksee) (RB kotiin)))")]
    assert out["trans_ps"].filter("alignment IS NOT NULL").count() == 4  # the cleaner has taken the full stop
    assert {(r.dep, r["head"], r.text) for r in out["lang_ds"].collect()} == {("w1", "w2", "nsubj"), ("w2", None, "root"), ("w3", "w2", "advmod")}
    assert {(r.dep, r["head"], r.text) for r in out["trans_ds"].collect()} == {("tw1", "tw2", "det"), ("tw2", "tw3", "nsubj"), ("tw3", None, "root"), ("tw4", "tw3", "advmod")}


def test_methods_fall_back_by_instance(spark):
    out = enrich.enrich_full(raw(spark), ["heur", "ibm1"], symmetrize="union", augment=True)
    methods = collections.defaultdict(set)
    for r in out["trans_gloss"].collect():
        methods[r.igt_id].add(r.method)
    assert methods == {1: {"heur"}, 2: {"ibm1"}}  # the second has no word in common, the third no gloss
    assert {r.method for r in out["gloss_trans"].filter("igt_id = 1").collect()} == {"heur", "ibm1"}


def test_unknown_words(spark):
    tags = spark.createDataFrame([(1, 2, "NOUN")], "igt_id long, idx int, label string")

    def lang(unknown, **more):
        out = enrich.enrich_full(raw(spark), ["heur"], tags=tags, unknown=unknown, **more)
        return {(r.igt_id, r.idx): r.label for r in out["lang_tag"].collect()}

    assert lang("skip") == {(1, 1): "NOUN"}
    assert lang("keep") == {(1, 1): "NOUN", (1, 2): "UNK", (1, 3): "UNK", (2, 1): "UNK", (2, 2): "UNK"}
    assert lang("noun")[2, 2] == "NOUN"
    known = [(i, "sleep", "**NONE**", "**NONE**", "VERB") for i in range(20)] + [(i, "home", "**NONE**", "**NONE**", "ADV") for i in range(20)] + [(i, "cat", "**NONE**", "**NONE**", "NOUN") for i in range(20)]
    taught = spark.createDataFrame(known, "idx long, tok string, prev string, next string, label string")
    model = features.train(features.gram_features(taught, ["idx"]))
    got = lang("classify", model=model)
    assert got[1, 1] == "NOUN" and got[2, 1] == "NOUN" and got[2, 2] == "VERB" and got[1, 3] == "ADV"
    with pytest.raises(ValueError):
        lang("guess")
