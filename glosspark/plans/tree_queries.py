"""Queries of trees as tiers, of statistical alignment and of the full enrichment.

The phrase trees are those of conversation turns: each line that has words is a phrase, and the rest of the turn stands beside it. The dependencies
are those of an order's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.operators import align, chart, fertility, spanning, tagger, tier_lists, tiers
from glosspark.plans import catalogue as C
from glosspark.plans import enrich, subsets

query, table = C.query, C.table
TURN = ["conv_id", "turn"]

_LINE_WORDS = r"""
l AS (SELECT conv_id, turn, k, regexp_extract_all(line, '[^\x20\x09-\x0D()]+') AS ws FROM (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations))),
p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS k, ws FROM l WHERE len(ws) > 0),
n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n, sum(len(ws)) OVER (PARTITION BY conv_id, turn) AS words, sum(len(ws)) OVER (PARTITION BY conv_id, turn ORDER BY k) - len(ws) AS before FROM p)"""


def turn_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-branching trees ``(S (L (W2 ab) ..) (S ..))`` of the lines that have words, a word's label holding its length modulo 5, beside the list of the words as items.

    Brackets separate words. Lines are gathered as text, which takes less of a shuffle than lists of their words.
    """
    lines = table(spark, sf_dir, "conversations").select(*TURN, F.posexplode(F.split("text", "\n")).alias("k", "line")).groupBy(*TURN).agg(F.collect_list(F.struct("k", "line")).alias("lines"))
    found = lambda x: F.struct(x["k"], F.regexp_extract_all(x["line"], F.lit(r"[^\x20\x09-\x0D()]+"), 0).alias("ws"))
    lines = lines.select(*TURN, F.filter(F.transform(F.sort_array(F.transform("lines", found)), lambda x: x["ws"]), lambda ws: F.size(ws) > 0).alias("lines")).filter("size(lines) > 0")
    word = lambda w: F.concat(F.lit("(W"), (F.length(w) % 5).cast("string"), F.lit(" "), w, F.lit(")"))
    one = F.transform("lines", lambda ws: F.concat(F.lit("(S (L "), F.array_join(F.transform(ws, word), " "), F.lit(")")))
    item = lambda w, i: F.struct((i + 1).alias("idx"), F.concat(F.lit("w"), (i + 1).cast("string")).alias("item_id"), w.alias("tok"))
    return lines.select(*TURN, F.concat(F.array_join(one, " "), F.repeat(F.lit(")"), F.size("lines"))).alias("tree"), F.transform(F.flatten("lines"), item).alias("words"))


_PHRASES = f"""WITH {_LINE_WORDS}
SELECT conv_id, turn, (before + i)::INT AS idx, 'ps' || (before + i) AS item_id, 'W' || length(ws[i]) % 5 AS text, 'w' || (before + i) AS alignment, NULL AS children FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM n)
UNION ALL SELECT conv_id, turn, (words + 2 * k - 1)::INT, 'ps' || (words + 2 * k - 1), 'S', NULL, 'ps' || (words + 2 * k) || CASE WHEN k < n THEN ' ps' || (words + 2 * k + 1) ELSE '' END FROM n
UNION ALL SELECT conv_id, turn, (words + 2 * k)::INT, 'ps' || (words + 2 * k), 'L', NULL, array_to_string(list_transform(range(1, len(ws) + 1), lambda i: 'ps' || (before + i)), ' ') FROM n"""


@query(_PHRASES)
def phrase_tier_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees as the items of a phrase-structure tier."""
    return turn_trees(spark, sf_dir).select(*TURN, tier_lists.tree_items(F.col("tree"), F.col("words"), tiers.PHRASES).alias("items")).select(*TURN, F.inline("items"))


@query(f"WITH {_LINE_WORDS} SELECT conv_id, turn, string_agg('(S (L ' || array_to_string(list_transform(ws, lambda w: '(W' || length(w) % 5 || ' ' || w || ')'), ' ') || ')', ' ' ORDER BY k) || repeat(')', max(n)::INT) AS tree FROM n GROUP BY conv_id, turn")
def phrase_tier_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees to tier items, read back and written as brackets."""
    return turn_trees(spark, sf_dir).select(*TURN, tier_lists.reread(F.col("tree"), F.col("words"), tiers.PHRASES).alias("tree")).filter("tree IS NOT NULL")


_HUNG = "e AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS dep, l_linenumber // 2 AS head FROM lineitem), r(k, dep, head, path) AS (SELECT k, dep, head, [dep] FROM e WHERE head = 0 UNION ALL SELECT e.k, e.dep, e.head, list_append(path, e.dep) FROM r JOIN e ON e.k = r.k AND e.head = r.dep)"


def order_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges of an order's lines, line n under line n div 2, and the lines as words."""
    edges = C._edges(spark, sf_dir).distinct().withColumn("type", F.concat(F.lit("t"), (F.col("dep") % 3).cast("string")))
    return edges, edges.select("k", F.col("dep").alias("idx"), F.concat(F.lit("w"), F.col("dep").cast("string")).alias("item_id"), F.concat(F.lit("line"), F.col("dep").cast("string")).alias("tok"))


@query(f"WITH RECURSIVE {_HUNG} SELECT k, row_number() OVER (PARTITION BY k ORDER BY path)::INT AS idx, 'ds' || row_number() OVER (PARTITION BY k ORDER BY path) AS item_id, 't' || dep % 3 AS text, 'w' || dep AS dep, CASE WHEN head > 0 THEN 'w' || head END AS head FROM r")
def dependency_tier_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that hang from the root as the items of a dependency tier."""
    edges, words = order_edges(spark, sf_dir)
    return tiers.dependency_items(edges, words, ["k"]).drop("tier_id")


@query(f"WITH RECURSIVE {_HUNG} SELECT k, dep, head, 't' || dep % 3 AS type, 'line' || dep AS word, CASE WHEN dep % 2 = 0 THEN 'E' END AS pos FROM r")
def dependency_tier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to tier items and back, with tags for every other word."""
    edges, words = order_edges(spark, sf_dir)
    return tiers.dependency_edges(tiers.dependency_items(edges, words, ["k"]), words, ["k"], words.filter("idx % 2 = 0").select("k", "idx", F.lit("E").alias("label")))


@query(f"WITH RECURSIVE {_HUNG} SELECT k, dep, head FROM e WHERE (k, dep) NOT IN (SELECT k, dep FROM r)")
def loose_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.loose_edges(order_edges(spark, sf_dir)[0], ["k"]).select("k", "dep", "head")


_NEAR = f"{C._BITEXT}, {C._A1}, x AS (SELECT s.conv_id, s.turn, s.idx, a.src AS near FROM s LEFT JOIN (SELECT DISTINCT conv_id, turn, src FROM a1) a ON a.conv_id = s.conv_id AND a.turn = s.turn AND a.src = s.idx), y AS (SELECT *, max(near) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, min(near) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM x)"


@query(f'WITH {_NEAR} SELECT conv_id, turn, idx, l AS "left", r AS "right" FROM y WHERE near IS NULL')
def nearest_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = C.bitext(spark, sf_dir)
    return tiers.nearest_aligned(s, align.matched(s, t, C.PAIR).select(*C.PAIR, F.col("src").alias("idx")), C.PAIR)


@query(f"WITH {_NEAR}, e AS (SELECT conv_id, turn, idx AS d, idx // 2 AS h FROM x WHERE near IS NOT NULL), z AS (SELECT y.conv_id, y.turn, idx, arg_min(d, (abs(idx - h) + abs(idx - d), h, d)) AS head FROM y JOIN e ON e.conv_id = y.conv_id AND e.turn = y.turn AND ((h < idx AND idx < d) OR (d < idx AND idx < h)) WHERE near IS NULL AND l IS NOT NULL AND r IS NOT NULL GROUP BY ALL) SELECT conv_id, turn, idx AS dep, coalesce(l, r) AS head FROM y WHERE near IS NULL AND (l IS NULL OR r IS NULL) AND coalesce(l, r) IS NOT NULL UNION ALL SELECT * FROM z")
def attached_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where words that have no partner hang in a tree whose aligned word n hangs under word n div 2."""
    s, t = C.bitext(spark, sf_dir)
    covered = align.matched(s, t, C.PAIR).select(*C.PAIR, F.col("src").alias("idx")).distinct()
    return tiers.attached(covered.select(*C.PAIR, F.col("idx").alias("dep"), F.floor(F.col("idx") / 2).cast("int").alias("head")), s, covered, C.PAIR)


# --- the full enrichment -----------------------------------------------------------------------------------------------


def glossed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw lines of parts as instances of three language and gloss words, and tags of their translation words.

    ``ringa smallo economyi`` / ``economy small-ring ring`` / ``ring economy small.`` for a part named "small ring" of type ECONOMY.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("igt_id"), F.split("p_name", " ").alias("n"), F.lower("p_type").alias("t"))
    a, b = F.get("n", F.lit(0)), F.get("n", F.lit(1))
    text = {"L": F.concat(b, F.lit("a "), a, F.lit("o "), "t", F.lit("i")), "G": F.concat("t", F.lit(" "), a, F.lit("-"), b, F.lit(" "), b), "T": F.concat(b, F.lit(" "), "t", F.lit(" "), a, F.lit("."))}
    rows = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("ord"), F.lit(f"r{k + 1}").alias("item_id"), F.lit(tag).alias("tag"), x.alias("text")) for k, (tag, x) in enumerate(text.items())))).alias("x")
    labels = F.explode(F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(x).alias("label")) for i, x in ((1, "NOUN"), (3, "ADJ"))))).alias("x")
    return part.select("igt_id", rows).select("igt_id", "x.*"), part.select("igt_id", labels).select("igt_id", "x.*")


def _layers(out: dict[str, DataFrame]) -> DataFrame:
    none = F.lit(None)
    links = [out[k].select("igt_id", F.lit(k).alias("layer"), F.col("src").cast("int").alias("src"), F.col("tgt").cast("int").alias("tgt"), none.cast("string").alias("label")) for k in ("gloss_lang", "gloss_trans", "trans_gloss", "trans_lang")]
    tags = [out[k].select("igt_id", F.lit(k).alias("layer"), none.cast("int").alias("src"), F.col("idx").cast("int").alias("tgt"), "label") for k in ("gloss_tag", "lang_tag")]
    rows = [*links, *tags]
    for more in rows[1:]:
        rows[0] = rows[0].unionByName(more)
    return rows[0]


_LAYERS = """WITH p AS (SELECT p_partkey AS igt_id FROM part),
f(layer, src, tgt, label) AS (VALUES ('gloss_lang', 1, 1, NULL), ('gloss_lang', 2, 2, NULL), ('gloss_lang', 3, 3, NULL), ('gloss_trans', 1, 2, NULL), ('gloss_trans', 2, 3, NULL), ('gloss_trans', 3, 1, NULL),
  ('trans_gloss', 2, 1, NULL), ('trans_gloss', 3, 2, NULL), ('trans_gloss', 1, 2, NULL), ('trans_lang', 2, 1, NULL), ('trans_lang', 3, 2, NULL), ('trans_lang', 1, 2, NULL), ('gloss_tag', NULL, 2, 'NOUN'), ('lang_tag', NULL, 2, 'NOUN') %s)
SELECT igt_id, layer, src, tgt, label FROM p, f"""


@query(_LAYERS % "")
def enrich_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic alignment, and tags projected to gloss and language words; untagged words are skipped."""
    raw, tags = glossed(spark, sf_dir)
    return _layers(enrich.enrich_full(raw, ["heur"], tags=tags))


@query(_LAYERS % ", ('lang_tag', NULL, 1, 'UNK'), ('lang_tag', NULL, 3, 'UNK')")
def enrich_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, unknown words kept as UNK."""
    raw, tags = glossed(spark, sf_dir)
    return _layers(enrich.enrich_full(raw, ["heur"], tags=tags, unknown="keep"))


@query(_LAYERS % ", ('lang_tag', NULL, 1, 'NOUN'), ('lang_tag', NULL, 3, 'NOUN')")
def enrich_noun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, unknown words called nouns."""
    raw, tags = glossed(spark, sf_dir)
    return _layers(enrich.enrich_full(raw, ["heur"], tags=tags, unknown="noun"))


@query()
def enrich_statistical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of an HMM intersected, heuristic links where that gives an instance none."""
    raw, tags = glossed(spark, sf_dir)
    out = enrich.enrich_full(raw, ["hmm", "heur"], tags=tags, augment=True)
    return _layers(out)


@query()
def fertility_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the fertility model after Model 1 and the HMM, on part names and types as in ``hmm_viterbi``."""
    b = C._em_bitext(spark, sf_dir)
    return fertility.viterbi(b, fertility.train(b)[0]).filter("src > 0")



# --- taggers and parsers -----------------------------------------------------------------------------------------------


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(igt_id, idx, tok, label): a part's name and type, as an adjective, a noun and a type; some types are adjectives elsewhere."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("igt_id"), F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("ws"))
    return part.select("igt_id", F.posexplode("ws").alias("i", "tok")).select("igt_id", (F.col("i") + 1).alias("idx"), "tok", F.get(F.array(*map(F.lit, "ANT")), F.col("i")).alias("label"))


@query("SELECT p_partkey AS igt_id, unnest([1, 2, 3])::INT AS idx, unnest(['A', 'N', 'T']) AS label FROM part")
def crf_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts tagged by a random field that was taught on every other one."""
    tokens = part_tokens(spark, sf_dir)
    model = tagger.train(tokens.filter("igt_id % 2 = 0"), ["igt_id"], 8)
    return tagger.tag(tokens.drop("label"), ["igt_id"], model).select("igt_id", F.col("idx").cast("int").alias("idx"), "label")


@query("SELECT p_partkey AS igt_id, '(S (A ' || string_split(p_name, ' ')[1] || ') (N ' || string_split(p_name, ' ')[2] || ') (T ' || lower(p_type) || '))' AS tree FROM part")
def chart_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts parsed by the grammar of every other one's trees."""
    words = part_tokens(spark, sf_dir).groupBy("igt_id").agg(F.sort_array(F.collect_list(F.struct("idx", "tok", "label"))).alias("ws"))
    trees = words.select("igt_id", F.concat(F.lit("(S "), F.array_join(F.transform("ws", lambda w: F.concat(F.lit("("), w["label"], F.lit(" "), w["tok"], F.lit(")"))), " "), F.lit(")")).alias("tree"))
    rules, lexicon = chart.grammar(tiers.parsed(trees.filter("igt_id % 2 = 0"), ["igt_id"]), ["igt_id"])
    return chart.parse(words.select("igt_id", F.transform("ws", lambda w: w["tok"]).alias("words")), rules, lexicon).select("igt_id", "tree")


_ARCS = "e AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS dep FROM lineitem), a AS (SELECT e.k, e.dep, h.dep AS head FROM e JOIN e h ON h.k = e.k AND h.dep < e.dep UNION ALL SELECT k, dep, 0 FROM e)"


@query(f"WITH {_ARCS} SELECT k, dep, arg_max(head, ((dep * 7 + head * 13) % 11, -head)) AS head, max((dep * 7 + head * 13) % 11)::DOUBLE AS score FROM a GROUP BY k, dep")
def spanning_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best trees over an order's lines, each with arcs from all lines before it and the root."""
    lines = C._edges(spark, sf_dir).select("k", "dep").distinct()
    before = lines.join(lines.select("k", F.col("dep").alias("head")), "k").filter("head < dep").unionByName(lines.withColumn("head", F.lit(0)))
    arcs = before.select("k", F.col("dep").cast("int").alias("dep"), F.col("head").cast("int").alias("head")).withColumn("score", ((F.col("dep") * 7 + F.col("head") * 13) % 11).cast("double"))
    return spanning.best_trees(arcs, ["k"])


# --- subsets -----------------------------------------------------------------------------------------------------------


def _uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' lines, some without a translation, with an empty gloss, or with a longer language line."""
    raw, _ = glossed(spark, sf_dir)
    raw = raw.filter("NOT (igt_id % 5 = 0 AND tag = 'T')")
    text = F.when((F.col("igt_id") % 7 == 0) & (F.col("tag") == "G"), "  ").when((F.col("igt_id") % 3 == 0) & (F.col("tag") == "L"), F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    return raw.select("igt_id", "ord", "tag", text.alias("text"))


@query("SELECT p_partkey AS igt_id, unnest([1, 2, 3])::INT AS ord, unnest(['L', 'G', 'T']) AS tag FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AND p_size > 10")
def filter_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with all lines, as many gloss as language words, and a tag."""
    tags = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("igt_id"))
    return subsets.filtered(_uneven(spark, sf_dir), gloss_tags=tags, even=True).select("igt_id", "ord", "tag")


@query("WITH n AS (SELECT p_partkey AS igt_id, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 3 END AS n FROM part), r AS (SELECT igt_id, sum(n) OVER (ORDER BY igt_id) AS upto, sum(n) OVER () AS total FROM n) SELECT igt_id, CASE WHEN upto < round_even(0.5 * total, 0) THEN 'train' WHEN upto < round_even(0.75 * total, 0) THEN 'dev' ELSE 'test' END AS part FROM r")
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances dealt out by words of their language lines."""
    return subsets.split(_uneven(spark, sf_dir), 0.5, 0.25).select("igt_id", "part").distinct()
