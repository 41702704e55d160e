"""Trees, readers and writers, EM, corpus operators, streaming."""

from pyspark.sql import functions as F

from glosspark.operators import corpus, em, features, trees
from glosspark.sources import igt_xml, tagged
from glosspark.streaming import lines as stream

SENTENCE = "(S (NP (DT a) (NN dog)) (VP (VBZ sees) (NP (JJ old) (NN trees))))"
WORDS = "perro ve arboles viejos".split()
PAIRS = [(2, 1), (3, 2), (4, 4), (5, 3)]


def test_project_phrases(spark):
    want = "(S (NP (NN perro)) (VP (VBZ ve) (NP (NN arboles) (JJ viejos))))"
    assert trees.project_phrases(SENTENCE, WORDS, PAIRS) == want
    rows = spark.createDataFrame([("i", SENTENCE, WORDS, [(s, t) for s, t in PAIRS]), ("none", SENTENCE, WORDS, [])], "igt_id string, tree string, words array<string>, pairs array<struct<src:int,tgt:int>>")
    assert [tuple(r) for r in trees.project_phrase_table(rows).collect()] == [("i", want)]
    n = trees.nodes(rows.filter("igt_id = 'i'"))
    assert n.filter("leaf_idx IS NOT NULL").count() == 5
    assert {(r.rule, r.n) for r in trees.productions(n).filter("rule LIKE 'NP%'").collect()} == {("NP -> DT NN", 1), ("NP -> JJ NN", 1)}


def test_project_dependencies():
    edges = trees.parse_dependencies("root(ROOT-0, sees-3)\ndet(dog-2, a-1)\nnsubj(sees-3, dog-2)\namod(trees-5, old-4)\ndobj(sees-3, trees-5)")
    got = trees.project_dependencies(edges, WORDS, PAIRS)
    assert {(d, h) for d, h, *_ in got} == {(2, 0), (1, 2), (3, 2), (4, 3)}
    assert trees.conll(got).splitlines()[1].split("\t")[6:8] == ["0", "root"]
    more = trees.project_dependencies(edges, "perro ve los arboles viejos".split(), [(2, 1), (3, 2), (4, 5), (5, 4)])
    assert sorted(d for d, *_ in more) == [1, 2, 3, 4, 5] and [h for d, h, *_ in more].count(0) == 1
    assert trees.parse_dependencies("(ROOT[0] (a[2] (b[1])))") == [(2, 0, "", "a"), (1, 2, "", "b")]


def test_depths(spark):
    e = spark.createDataFrame([(1, 2, 0), (1, 1, 2), (1, 3, 1), (1, 3, 2)], "k int, dep int, head int")
    assert {(r.dep, r.depth) for r in trees.depths(e, ["k"]).collect()} == {(2, 1), (1, 2), (3, 2)}


def test_tagged_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a/N b/c/V\n\nd/X\n")
    got = [tuple(r) for r in tagged.read_slashtags(spark, str(tmp_path / "s.txt")).orderBy("sent", "idx").select("idx", "form", "label").collect()]
    assert got == [(1, "a", "N"), (2, "b/c", "V"), (1, "d", "X")]
    (tmp_path / "c.conll").write_text("1\tNina\tNina\tN\tN\tz\t2\tsb\t_\t_\n2\trent\trennen\tV\tV\tx\t0\tROOT\t_\t_\n\n1\thi\thi\tI\tI\t_\t0\tROOT\t_\t_")
    rows = tagged.read_conll(spark, str(tmp_path / "c.conll"))
    assert rows.count() == 3 and {(r.idx, r.head) for r in rows.collect()} == {(1, 2), (2, 0), (1, 0)}
    tokens = rows.select("sent", "idx", "form", "label")
    tagged.write_slashtags(tokens, str(tmp_path / "out"), ["sent"])
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {"Nina/N rent/V", "hi/I"}
    (tmp_path / "t.mrg").write_text("( (S (NP (N x))\n  (V y)) )\n( (S (V z)) )\n")
    assert [r.tree for r in tagged.read_trees(spark, str(tmp_path / "t.mrg")).orderBy("tree_no").collect()] == ["(S (NP (N x)) (V y))", "(S (V z))"]
    (tmp_path / "m.txt").write_text("word-dog suf-g N\nx V\n\nword-a D\n")
    assert [(r.form, r.label) for r in tagged.read_simpletagger(spark, str(tmp_path / "m.txt")).orderBy("sent", "idx").collect()] == [("dog", "N"), ("**NONE**", "V"), ("a", "D")]


def test_records(spark, tmp_path):
    text = "doc_id=12 1 3 L G T\nlanguage: x (deu)\nline=1 tag=L:  ich bin\nline=2 tag=G+CN: I am\nline=3 tag=T: 'I am'\n\ndoc_id=13 4 4 L\nline=4 tag=L: nur\n"
    (tmp_path / "r.txt").write_text(text)
    rows = tagged.read_records(spark, str(tmp_path / "r.txt"), encoding="UTF-8")
    assert [(r.ord, r.tag, r.text) for r in rows.filter("doc_id = '12'").orderBy("ord").collect()] == [(1, "L", "  ich bin"), (2, "G+CN", " I am"), (3, "T", " 'I am'")]
    assert tagged.read_records(spark, str(tmp_path / "r.txt"), encoding="UTF-8", limit=1).select("igt_id").distinct().count() == 1
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text(text)
    q = stream.clean_stream(stream.record_stream(spark, str(tmp_path / "s"))).writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned").count() == 4


def test_xml(spark, tmp_path):
    doc = """<?xml version="1.0"?><corpus><!-- c --><igt id="i1" doc-id="58" line-range="1 2"><metadata><meta type="x"/></metadata>
    <tier id="r" type="odin" state="raw"><item id="r1" line="1" tag="L">  Mo-ta <!-- cut --> rel</item><item id="r2" line="2" tag="G">we bread</item></tier>
    <tier id="a" type="bilingual-alignments"><item id="a1" source="t1" target="g1,g2"/></tier><tier id="e" type="words"/></igt></corpus>"""
    (tmp_path / "x.xml").write_text(doc)
    igt = igt_xml.load(spark, str(tmp_path / "x.xml"))
    items = igt_xml.items(igt)
    assert [(r.tag, r.text) for r in igt_xml.lines(items, "raw").orderBy("ord").collect()] == [("L", "  Mo-ta  rel"), ("G", "we bread")]
    assert {(r.source, r.target) for r in igt_xml.pairs(items).collect()} == {("t1", "g1"), ("t1", "g2")}
    assert igt_xml.tiers(igt).count() == 3 and igt_xml.instances(igt).first().doc_id == "58"
    igt_xml.write(igt, str(tmp_path / "out"))
    assert igt_xml.items(igt_xml.load(spark, str(tmp_path / "out"))).count() == 3


def toy(spark):
    text = [("das haus", "the house"), ("das buch", "the book"), ("ein buch", "a book")]
    rows = [(k, s, i, w) for k, p in enumerate(text) for s, t in zip("fe", p) for i, w in enumerate(t.split(), 1)]
    return spark.createDataFrame(rows, "pair int, side string, idx int, tok string")


def test_em(spark):
    b = toy(spark)
    t1 = em.ibm1(b, 8)
    best = {r.e: r.f for r in t1.filter("e <> 'NULL'").groupBy("e").agg(F.max_by("f", "t").alias("f")).collect()}
    assert best["house"] == "haus" and best["a"] == "ein" and best["book"] == "buch"
    assert em.perplexity(b, t1) < em.perplexity(b, em.ibm1(b, 1))
    assert (0, 2, 2) in {tuple(r) for r in em.viterbi1(b, t1).collect()}
    table, jumps = em.hmm(b, t1, 2)
    path = {tuple(r) for r in em.viterbi_hmm(b, table, jumps).collect()}
    assert {(0, 1, 1), (0, 2, 2), (2, 2, 2)} <= path and abs(sum(jumps) - 1) < 0.01
    assert (0, 1, 1) in {tuple(r) for r in em.diagonal(b, 5).collect()}


def test_corpus_operators(spark):
    sizes = spark.createDataFrame([(i, 1 + i % 3) for i in range(40)], "ord int, n int")
    got = [(r.ord, r.part) for r in corpus.split(sizes, ["ord"]).orderBy("ord").collect()]
    total, run, want = sum(1 + i % 3 for i in range(40)), 0, []
    for i in range(40):
        run += 1 + i % 3
        want.append((i, "train" if run < round(0.8 * total) else "dev" if run < round(0.9 * total) else "test"))
    assert got == want
    taken = spark.createDataFrame([(["tw-pos"],), ([],), (["tw-pos", "tw-pos_b"],)], "x array<string>")
    assert [r.y for r in taken.select(corpus.fresh_tier_id(F.lit("tw-pos"), F.col("x")).alias("y")).collect()] == ["tw-pos_b", "tw-pos", "tw-pos_c"]


def test_classifier(spark):
    rows = [(1, i, w, t) for i, (w, t) in enumerate([("runs", "V"), ("dog", "N"), ("jumps", "V"), ("log", "N"), ("sings", "V"), ("fog", "N")] * 4, 1)]
    tokens = features.context(spark.createDataFrame(rows, "k int, idx int, tok string, label string"), ["k"])
    feats = features.gram_features(tokens, ["k"], prev_gram=False, next_gram=False)
    model = features.train(feats)
    new = features.gram_features(features.context(spark.createDataFrame([(2, 1, "rings"), (2, 2, "cog"), (2, 3, "."), (2, 4, "")], "k int, idx int, tok string"), ["k"]), ["k"], prev_gram=False, next_gram=False)
    assert [r.label for r in features.classify(model, new).orderBy("idx").collect()] == ["V", "N", "PUNC", "UNK"]
    assert features.training_lines(feats.limit(1)).first().value.startswith("V\tgram-suffix-3-uns:1")


def test_annotation_xml(spark, tmp_path):
    from glosspark.sources import annotation_xml as ax

    (tmp_path / "a.xaml").write_text(
        """<r xmlns="u"><Igt><TextTier Name="_t1" TierType="L-x" Text="ab cd"/><TextTier Name="_t2" TierType="T" Text="go"/>
        <SegTier Name="_s1" SourceTier="{x:Reference _t1}"><SegPart Name="_w1" FromChar="0" ToChar="2"/><SegPart Name="_w2" FromChar="3" ToChar="5"/></SegTier>
        <SegTier Name="_s2" SourceTier="{x:Reference _t2}"><SegPart Name="_v1" FromChar="0" ToChar="2"/></SegTier>
        <AlignmentTier><AlignPart Source="{x:Reference _v1}"><Reference>_w2</Reference></AlignPart></AlignmentTier>
        <PosTagTier><TagPart Source="{x:Reference _w1}" Text="N"/></PosTagTier></Igt></r>"""
    )
    e = ax.load(spark, str(tmp_path / "a.xaml"))
    assert {(r.tag, r.tok) for r in ax.words(e).collect()} == {("L", "ab"), ("L", "cd"), ("T", "go")}
    assert [(r.src, r.tgt) for r in ax.pairs(e).collect()] == [(2, 1)]
    assert [(r.idx, r.label) for r in ax.tags(e).collect()] == [(1, "N")]


def test_search_and_reports(spark):
    from glosspark.operators import search
    from glosspark.plans import reports
    from glosspark.plans.enrich import enrich

    items = spark.createDataFrame([("i", "w1", "words", "p1[0:2]", 1), ("i", "w2", "words", "p1[3:5]", 2), ("i", "m1", "morphemes", "w1", 3)], "igt_id string, item_id string, tier_type string, segmentation string, ord int")
    assert [r.item_id for r in search.find_all(items, search.where(segmentation="p1")).orderBy("ord").collect()] == ["w1", "w2"]
    assert search.find_first(items, search.where(type="words"), ["ord"]).first().item_id == "w1"
    links = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a")], "k int, item string, target string")
    assert search.follow(links, ["k"]).count() == 9
    raw = spark.createDataFrame([("i", 1, "r1", "L", "Hunde bell-en"), ("i", 2, "r2", "G", "dogs bark-3PL"), ("i", 3, "r3", "T", "Dogs bark"), ("j", 1, "r1", "L+CR", "x")], "igt_id string, ord int, item_id string, tag string, text string")
    tags = spark.createDataFrame([("i", 1, "NOUN"), ("i", 2, "VERB")], "igt_id string, idx int, label string")
    layers = enrich(raw, tags)
    assert {(r.idx, r.label) for r in layers["lang_tag"].collect()} == {(1, "NOUN"), (2, "VERB")}
    assert {(r.src, r.tgt) for r in layers["gloss_morph"].collect()} == {(1, 1), (2, 2), (3, 3)}
    stats = reports.corpus_statistics(raw, layers["token"]).first()
    assert (stats.instances, stats.corrupt, stats.lang_tokens, stats.trans_types) == (2, 1, 3, 2)
    assert "Hunde/NOUN bell-en/VERB" in {r.value for r in reports.tagger_corpus(layers).collect()}
    assert reports.classifier_lines(layers["morph"].filter("tier = 'g'"), layers["gloss_tag"]).count() == 3
    gold = layers["trans_gloss"].select("igt_id", F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    tier = lambda t: layers["token"].filter(F.col("tier") == t)
    grid = {r.method: r.aer for r in reports.alignment_grid(tier("gw"), tier("tw"), gold, ["igt_id"], reports.ABLATION[:2]).collect()}
    assert set(grid) <= {"exact", "stem", "gram", "all", "all_multi"} and all(0 <= v <= 1 for v in grid.values())
