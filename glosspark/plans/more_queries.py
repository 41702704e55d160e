"""Queries of the operators, readers and writers that the first catalogue leaves out.

Parts stand in for annotated instances: brand, type and name of a part make its language, gloss and translation line. Readers are
run on files that the writers have just made in the shared folder, and have to give back what went in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.functions import text as T
from glosspark.operators import align, corpus, counts, em, lines, project, search, words
from glosspark.plans import catalogue as C
from glosspark.plans import reports
from glosspark.session import shared_folder
from glosspark.sources import igt_xml, tagged

query, table, W = C.query, C.table, C.W

_N = "n AS (SELECT p_partkey AS igt_id, 1 AS ord, 'L' AS tag, replace(p_brand, '#', '-') || ' ' || p_name AS text FROM part UNION ALL SELECT p_partkey, 2, 'G', p_type || '.' || p_brand || ' ' || replace(p_name, ' ', '-') FROM part UNION ALL SELECT p_partkey, 3, 'T', p_name || ', ' || p_type || '.' FROM part)"
_WORDS = f"{_N}, w AS (SELECT *, stop - length(tok) AS start FROM (SELECT igt_id, CASE tag WHEN 'L' THEN 'w' ELSE 'gw' END AS tier, i::INT AS idx, ws[i] AS tok, (list_sum(list_transform(ws[1:i], lambda x: length(x) + 1)) - 1)::INT AS stop FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, string_split(text, ' ') AS ws FROM n WHERE tag <> 'T'))))"
_MORPHS = f"{_WORDS}, m AS (SELECT igt_id, CASE tier WHEN 'w' THEN 'm' ELSE 'g' END AS tier, row_number() OVER (PARTITION BY igt_id, tier ORDER BY idx, j)::INT AS idx, idx AS word_idx, ps[j] AS tok, len(ps) = 1 AS whole, b - length(ps[j]) AS a, b, start FROM (SELECT *, (list_sum(list_transform(ps[1:j], lambda x: length(x) + 1)) - 1)::INT AS b FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM (SELECT *, regexp_split_to_array(tok, '[-.:/()=]') AS ps FROM w))))"


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal lines (igt_id, ord, tag, text, judgment) of parts."""
    part = table(spark, sf_dir, "part")
    text = {
        "L": F.concat(F.translate("p_brand", "#", "-"), F.lit(" "), F.col("p_name")),
        "G": F.concat("p_type", F.lit("."), "p_brand", F.lit(" "), F.translate("p_name", " ", "-")),
        "T": F.concat("p_name", F.lit(", "), "p_type", F.lit(".")),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("ord"), F.lit(t).alias("tag"), x.alias("text")) for k, (t, x) in enumerate(text.items())))).alias("x")
    return part.select(F.col("p_partkey").alias("igt_id"), rows).select("igt_id", "x.*", F.lit(None).cast("string").alias("judgment"))


def written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A folder of text files with the column ``value`` of ``rows``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    rows.select("value").write.option("lineSep", "\n").text(path)
    return path


# --- lines -------------------------------------------------------------------------------------------------------------


@query(f"WITH {C._LINES}, {C._TAGGED} SELECT igt_id, string_split(tag, '+')[1] AS tag, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.ambiguous(C._raw_lines(spark, sf_dir))


@query(f"WITH {C._LINES}, {C._TAGGED} SELECT igt_id, count(*) FILTER (tag = 'T+DB') AS double_column, count(*) FILTER (tag = 'L+CN') AS continued FROM r GROUP BY 1")
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = C._raw_lines(spark, sf_dir)
    return raw.groupBy("igt_id").agg(F.count_if(lines.has_label(F.col("tag"), "DB")).alias("double_column"), F.count_if(lines.has_label(F.col("tag"), "CN")).alias("continued"))


@query(f"WITH {C._LINES}, {C._TAGGED} SELECT igt_id, ord, tag, CASE WHEN igt_id % 3 = 0 THEN 'new ' || text ELSE text END AS text FROM r WHERE igt_id % 3 <> 0 OR ord = 1")
def replace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = C._raw_lines(spark, sf_dir).select("igt_id", "ord", "tag", "text")
    return lines.replace_lines(raw, raw.filter("igt_id % 3 = 0 AND ord = 1").withColumn("text", F.concat(F.lit("new "), "text")))


@query(f"WITH {_N} SELECT igt_id, CASE tag WHEN 'L' THEN 'p' ELSE 't' END AS tier, CASE tag WHEN 'L' THEN 'p1' ELSE 't1' END AS item_id, text, CASE tag WHEN 'T' THEN 'p1' END AS aligned FROM n WHERE tag <> 'G'")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.phrases(normal(spark, sf_dir)).drop("judgment")


# --- words, morphs, references -----------------------------------------------------------------------------------------


@query(rf"WITH {_WORDS} SELECT igt_id, tier, idx, tok, start, stop FROM w UNION ALL SELECT igt_id, 'tw', i, ws[i], NULL, NULL FROM (SELECT igt_id, ws, unnest(range(1, len(ws) + 1))::INT AS i FROM (SELECT igt_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_'']+|\$[\p{{Nd}}.]+|{W}') AS ws FROM n WHERE tag = 'T'))")
def word_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all three lines; offsets of language and gloss words."""
    own = F.col("tier") != "tw"
    return words.words(normal(spark, sf_dir)).select("igt_id", "tier", "idx", "tok", F.when(own, F.col("start")).alias("start"), F.when(own, F.col("stop")).alias("stop"))


@query(f"WITH {_MORPHS} SELECT igt_id, tier, idx, word_idx, tok, start + a AS start, start + b AS stop FROM m")
def morph_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.morphs(words.words(normal(spark, sf_dir))).select("igt_id", "tier", "idx", "word_idx", "tok", "start", "stop")


@query(f"WITH {_MORPHS} SELECT igt_id, tier, idx, CASE WHEN whole THEN 'w' || word_idx ELSE 'w' || word_idx || '[' || a || ':' || b || ']' END AS ref FROM m")
def morph_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.morph_references(words.morphs(words.words(normal(spark, sf_dir))), "w").select("igt_id", "tier", "idx", "ref")


@query(f"WITH {_MORPHS}, g AS (SELECT m.*, lead(m.start + a) OVER (PARTITION BY m.igt_id ORDER BY idx) AS nxt FROM m WHERE tier = 'g') SELECT igt_id, idx, substring(text, start + b + 1, nxt - start - b) AS gap FROM g JOIN n USING (igt_id) WHERE tag = 'G'")
def morph_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normal(spark, sf_dir)
    return words.gaps(words.morphs(words.words(n)).filter("tier = 'g'"), n, "G").select("igt_id", "idx", "gap")


@query(f"WITH {_MORPHS} SELECT igt_id, idx, word_idx AS outer_idx FROM m WHERE tier = 'm'")
def containing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words.words(normal(spark, sf_dir))
    return words.containing(words.morphs(w).filter("tier = 'm'"), w.filter("tier = 'w'"), ["igt_id"])


@query(f"WITH {_WORDS}, i AS (SELECT igt_id, idx, tok FROM w WHERE tier = 'w') SELECT igt_id, 'x' AS ref_from, 0 AS part, 'w1' AS item_id, substring(tok, 2, 3) AS value FROM i WHERE idx = 1 UNION ALL SELECT igt_id, 'x', 1, 'w2', tok FROM i WHERE idx = 2 UNION ALL SELECT igt_id, 'y', 0, 'w9', (SELECT tok FROM i j WHERE j.igt_id = i.igt_id AND j.idx = 9) FROM i WHERE idx = 1")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words.words(normal(spark, sf_dir)).filter("tier = 'w'")
    items = w.select("igt_id", F.concat(F.lit("w"), F.col("idx").cast("string")).alias("item_id"), F.col("tok").alias("value"))
    refs = w.filter("idx = 1").select("igt_id", F.explode(F.array(F.struct(F.lit("x").alias("ref_from"), F.lit("w1[1:4]+w2").alias("expr")), F.struct(F.lit("y").alias("ref_from"), F.lit("w9").alias("expr")))).alias("r")).select("igt_id", "r.*")
    return words.resolve(refs, items).select("igt_id", "ref_from", "part", "item_id", "value")


_TREE = "e AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS dep, l_linenumber // 2 AS head FROM lineitem)"


@query(f"WITH RECURSIVE {_TREE}, c AS (SELECT k, dep AS item, head AS target FROM e WHERE head > 0 UNION SELECT c.k, c.item, e.head FROM c JOIN e ON e.k = c.k AND e.dep = c.target WHERE e.head > 0) SELECT * FROM c")
def followed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = C._edges(spark, sf_dir).filter("head > 0").select("k", F.col("dep").alias("item"), F.col("head").alias("target"))
    return search.follow(links, ["k"])


@query(f"WITH RECURSIVE {_TREE}, c AS (SELECT k, dep, dep AS now FROM e UNION SELECT c.k, c.dep, e.head FROM c JOIN e ON e.k = c.k AND e.dep = c.now JOIN e h ON h.k = e.k AND h.dep = e.head) SELECT k AS igt_id, dep AS item_id, min(now) AS line_id FROM c GROUP BY 1, 2")
def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C._edges(spark, sf_dir).distinct()
    e = e.join(e.select("k", F.col("dep").alias("head"), F.lit(True).alias("there")), ["k", "head"], "left")  # a line without its head is a root
    return words.line_of(e.select(F.col("k").alias("igt_id"), F.col("dep").alias("item_id"), F.when(F.col("there"), F.col("head")).alias("parent")))


# --- search, filters, ids, provenance ----------------------------------------------------------------------------------

_ITEMS = "i AS (SELECT p_partkey % 50 AS igt_id, p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN 'tw-pos_b' ELSE 'w' || p_partkey END AS item_id, p_type AS tier_type, 'w' || (p_partkey + 1) || CASE WHEN p_size % 2 = 0 THEN '[0:3]' ELSE ',w7' END AS content FROM part)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    name = lambda x: F.concat(F.lit("w"), x.cast("string"))
    return table(spark, sf_dir, "part").select((key % 50).alias("igt_id"), key.alias("ord"), F.when(size % 3 == 0, "tw-pos_b").otherwise(name(key)).alias("item_id"), F.col("p_type").alias("tier_type"), F.concat(name(key + 1), F.when(size % 2 == 0, "[0:3]").otherwise(",w7")).alias("content"))


@query(rf"WITH {_ITEMS} SELECT regexp_replace(regexp_replace(item_id, '_[a-z]$', ''), '\d+$', '') AS base, count(*) AS n FROM i GROUP BY 1")
def id_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).groupBy(search.id_base(F.col("item_id")).alias("base")).agg(F.count("*").alias("n"))


@query(f"WITH {_ITEMS} SELECT igt_id, ord, item_id FROM i WHERE tier_type = 'ECONOMY' AND item_id LIKE 'w%'")
def find_all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_all(_items(spark, sf_dir), search.where(type="ECONOMY", base="w")).select("igt_id", "ord", "item_id")


@query(f"WITH {_ITEMS} SELECT igt_id, min(ord) AS ord, arg_min(item_id, ord) AS item_id FROM i WHERE tier_type = 'SMALL' GROUP BY igt_id")
def find_first_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_first(_items(spark, sf_dir), search.where(attributes={"tier_type": "SMALL"}), ["ord"]).select("igt_id", "ord", "item_id")


@query(f"WITH {_ITEMS} SELECT igt_id, ord FROM i WHERE content LIKE '%,w7' OR content LIKE 'w7[%' OR content LIKE 'w7,%'")
def items_referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_all(_items(spark, sf_dir), search.where(content="w7")).select("igt_id", "ord")


@query(f"WITH {C._BITEXT}, n AS (SELECT conv_id, turn, (SELECT count(*) FROM s WHERE s.conv_id = b.conv_id AND s.turn = b.turn) AS a, (SELECT count(*) FROM t WHERE t.conv_id = b.conv_id AND t.turn = b.turn) AS c FROM b) SELECT conv_id, turn FROM n WHERE a = c AND a > 0")
def one_to_one_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = C.bitext(spark, sf_dir)
    key = F.struct("conv_id", "turn").alias("k")
    tokens = s.select(key, F.lit("w").alias("tier")).unionByName(t.select(key, F.lit("gw").alias("tier")))
    return corpus.require_one_to_one(tokens.select("k").distinct(), tokens, "w", "gw", "k").select("k.conv_id", "k.turn")


@query("SELECT DISTINCT o_orderkey AS igt_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def require_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("igt_id"), F.col("l_returnflag").alias("tier"))
    return corpus.require_tags(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("igt_id")).distinct(), tags, "R")


@query("SELECT event_id FROM events WHERE coalesce(value > 10 AND event_type <> 'error', false)")
def kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keep(table(spark, sf_dir, "events"), (F.col("value") > 10) & (F.col("event_type") != "error")).select("event_id")


@query("SELECT event_type AS method, count(*) AS n FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'error') GROUP BY 1")
def without_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"))
    return corpus.without_methods(rows, ["click", "error"]).groupBy("method").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_type, 'w' || row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS item_id FROM part")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.item_ids(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.lit("w"), ["p_type"], ["p_partkey"])


_TIERS = "['" + "', '".join(corpus.TIER_ORDER) + "']"


@query(f"SELECT p_partkey, coalesce(nullif(list_position({_TIERS}, CASE p_size % 4 WHEN 0 THEN 'w' WHEN 1 THEN 'g' WHEN 2 THEN 'tw-pos' ELSE 'other' END), 0), {len(corpus.TIER_ORDER) + 1})::INT AS rank FROM part")
def tier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    name = F.when(size == 0, "w").when(size == 1, "g").when(size == 2, "tw-pos").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", corpus.tier_rank(name).cast("int").alias("rank"))


@query("SELECT p_type, CASE WHEN NOT list_contains(b, 'x') THEN 'x' WHEN NOT list_contains(b, 'x_b') THEN 'x_b' ELSE 'x_c' END AS fresh FROM (SELECT p_type, list(DISTINCT CASE p_size % 7 WHEN 0 THEN 'x' WHEN 1 THEN 'x_b' ELSE 'y' END) AS b FROM part GROUP BY 1)")
def fresh_tier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 7 == 0, "x").when(F.col("p_size") % 7 == 1, "x_b").otherwise("y")
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.collect_set(name).alias("taken")).select("p_type", corpus.fresh_tier_id(F.lit("x"), F.col("taken")).alias("fresh"))


@query("SELECT event_id, 'projected' AS method, event_type AS kept, NULL::VARCHAR AS gone FROM events")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One meta replaced, one kept, one dropped."""
    attrs = F.create_map(F.lit("method"), F.lit("old"))
    metas = F.array(*(F.struct(F.lit(k).alias("type"), attrs.alias("attrs"), F.col("event_type").alias("text")) for k in ("source", "other", "date")))
    rows = table(spark, sf_dir, "events").select("event_id", corpus.drop_meta(corpus.set_meta(metas, "source", {"method": "projected"}, F.col("event_type")), "date").alias("m"))
    return rows.select("event_id", corpus.find_meta(F.col("m"), "source")["attrs"]["method"].alias("method"), corpus.find_meta(F.col("m"), "other")["text"].alias("kept"), corpus.find_meta(F.col("m"), "date")["text"].alias("gone"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", corpus.timestamp_text(F.col("ts")).alias("stamp"))


@query("SELECT p_partkey, p_size % 2 = 0 AND (p_size % 3 = 0 OR p_size % 5 = 0) AS word_level FROM part")
def word_level_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    tiers = table(spark, sf_dir, "part").select("p_partkey", F.when(size % 2 == 0, "glosses").otherwise("words").alias("tier_type"), F.when(size % 3 == 0, "word").alias("token_type"), F.when(size % 5 == 0, "words").alias("aligned_type"))
    return corpus.word_level(tiers).select("p_partkey", "word_level")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT 100")
def random_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit is the operator itself."""
    return corpus.random_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 100, 5)


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= round_even(0.3 * count(*) OVER (), 0)")
def first_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_share(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["doc_id"], 0.3).select("doc_id")


@query(rf"SELECT conv_id, turn, len(list_distinct(w)) AS types, list_filter(range(0, len(w)), lambda i: w[i + 1] = w[1])::VARCHAR AS at FROM (SELECT conv_id, turn, regexp_extract_all(text, '{W}') AS w FROM conversations)")
def list_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words("text").alias("w"))
    at = F.concat(F.lit("["), F.array_join(corpus.positions(F.col("w"), F.get("w", F.lit(0))).cast("array<string>"), ", "), F.lit("]"))
    return w.select("conv_id", "turn", F.size(corpus.distinct_in_order(F.col("w"))).alias("types"), at.alias("at"))


# --- texts -------------------------------------------------------------------------------------------------------------


@query(r"SELECT event_id, regexp_replace(event_type || '...' || event_type || '. . .', '\.[ \t\n\r\f\v]*\.[ \t\n\r\f\v]*\.', '', 'g') AS e, regexp_replace('to ' || event_type, '(?i)to[ \t\n\r\f\v]+([^ \t\n\r\f\v]+)', 'to-\1', 'g') AS i, event_type || '-pl-x' AS g, replace(event_type || chr(1), chr(1), ' ') AS x FROM events")
def gloss_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses, hyphenated infinitives, fixed grams, valid characters."""
    t = F.col("event_type")
    dots = F.concat(t, F.lit("..."), t, F.lit(". . ."))
    return table(spark, sf_dir, "events").select("event_id", T.ellipses(dots).alias("e"), T.hyphenate_infinitive(F.concat(F.lit("to "), t)).alias("i"), T.fix_gram(F.concat(t, F.lit(":pl #x"))).alias("g"), T.valid_xml(F.concat(t, F.lit("\x01"))).alias("x"))


@query(r"SELECT p_partkey, p_name || ' end ' AS x FROM part")
def external_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.external_punctuation(F.concat(F.regexp_replace("p_name", " ", ", "), F.lit(" end!?"))).alias("x"))


@query("SELECT p_partkey, p_name AS words, replace(p_name, ' ', '/N ') || '/N' AS tags FROM part")
def slash_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.translate("p_name", " ", "\t"), F.lit("/N"))
    line = F.regexp_replace(line, "\t", "/N ")
    return table(spark, sf_dir, "part").select("p_partkey", T.untag(line).alias("words"), T.slashtags(T.tagged(line)).alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN true ELSE lower(p_type) = split_part(p_name, ' ', 1) END AS same FROM part")
def compared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal in lower case, or not equal at all."""
    a, first = F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.split_part("p_name", F.lit(" "), F.lit(1))
    b = F.when(F.col("p_size") % 3 == 0, a).when(F.col("p_size") % 3 == 1, first).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.same_word(a, b, stem=False).alias("same"))


# --- alignments and tags -----------------------------------------------------------------------------------------------


@query(f"WITH {C._BITEXT}, {C._A1} SELECT conv_id, turn, src, string_agg(tgt::VARCHAR, ',' ORDER BY tgt) AS tgts FROM (SELECT * FROM a1 UNION SELECT conv_id, turn, src, 0 FROM a1) WHERE tgt > 0 GROUP BY 1, 2, 3")
def alignment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.align_exact(spark, sf_dir)
    both = align.union(a, a.withColumn("tgt", F.lit(0)), C.PAIR)
    return align.targets_of(align.nonzero(both), C.PAIR).select(*C.PAIR, "src", F.array_join(F.col("tgts").cast("array<string>"), ",").alias("tgts"))


@query(f"WITH {C._BITEXT}, {C._A1} SELECT conv_id, turn, idx FROM s WHERE (conv_id, turn, idx) NOT IN (SELECT conv_id, turn, src FROM a1)")
def unaligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = C.bitext(spark, sf_dir)
    return align.unaligned(s, align.matched(s, t, C.PAIR), "src", C.PAIR).select(*C.PAIR, "idx")


@query(f"WITH {C._BITEXT}, {C._A1}, g AS (SELECT * FROM a1 WHERE src % 2 = 0) SELECT 'exact' AS method, (SELECT count(*) FROM g) AS matches, count(*) AS test, (SELECT count(*) FROM g) AS gold, round(1 - 2 * (SELECT count(*) FROM g) / (count(*) + (SELECT count(*) FROM g)), 8) AS aer FROM a1")
def alignment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = C.bitext(spark, sf_dir)
    gold = align.matched(s, t, C.PAIR).filter("src % 2 = 0")
    return reports.alignment_grid(s, t, gold, C.PAIR, [{"name": "exact", "stem": False, "gram": False}]).select("method", "matches", "test", "gold", F.round("aer", 8).alias("aer"))


_TAGS_S = C._TAGS


@query(f"WITH {C._BITEXT}, {_TAGS_S} SELECT s.conv_id, s.turn, s.idx, coalesce(label, 'UNK') AS label FROM s LEFT JOIN g USING (conv_id, turn, idx)")
def tag_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = C.bitext(spark, sf_dir)
    return project.sequence(s, C._tags(s), C.PAIR).select(*C.PAIR, "idx", "label")


@query("SELECT event_id, user_id % 3 AS tier, 'm' AS method, CASE WHEN user_id % 3 = 0 THEN 'new' ELSE event_type END AS label FROM events")
def replaced_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("tier"), F.lit("m").alias("method"), F.col("event_type").alias("label"))
    return project.upsert(rows, rows.filter("tier = 0").withColumn("label", F.lit("new")), ["event_id"])


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'PRT' WHEN 1 THEN 'CONJ' WHEN 2 THEN 'PRON' WHEN 3 THEN 'DET' ELSE p_type END AS label FROM part")
def overridden_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    gloss = F.get(F.array(*map(F.lit, ("foc", "and", "dem.sg", "the", "dog"))), F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", project.override_gloss(gloss, F.col("p_type")).alias("label"))


# --- reports -----------------------------------------------------------------------------------------------------------


@query(rf"WITH {_WORDS}, x AS (SELECT tier, lower(tok) AS tok FROM w UNION ALL SELECT 'tw', lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_'']+|\$[\p{{Nd}}.]+|{W}'))) FROM n WHERE tag = 'T') SELECT (SELECT count(DISTINCT igt_id) FROM n) AS instances, 0 AS corrupt, 0 AS two_column, count(*) FILTER (tier = 'w') AS lang_tokens, count(DISTINCT tok) FILTER (tier = 'w') AS lang_types, count(*) FILTER (tier = 'gw') AS gloss_tokens, count(DISTINCT tok) FILTER (tier = 'gw') AS gloss_types, count(*) FILTER (tier = 'tw') AS trans_tokens, count(DISTINCT tok) FILTER (tier = 'tw') AS trans_types FROM x")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normal(spark, sf_dir)
    return reports.corpus_statistics(n, words.words(n))


@query(f"WITH {_MORPHS}, g AS (SELECT igt_id, idx, CASE length(tok) % 2 WHEN 0 THEN 'NOUN' ELSE 'VERB' END AS label FROM w WHERE tier = 'gw') SELECT 'word' AS kind, lower(tok) AS word, label AS tag, count(*) AS n FROM w JOIN g USING (igt_id, idx) WHERE tier = 'gw' GROUP BY ALL UNION ALL SELECT 'gram', lower(tok), label, count(*) FROM m JOIN g ON g.igt_id = m.igt_id AND g.idx = m.word_idx WHERE tier = 'g' GROUP BY ALL")
def gloss_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words.words(normal(spark, sf_dir))
    gw, grams = w.filter("tier = 'gw'"), words.morphs(w).filter("tier = 'g'")
    tags = gw.select("igt_id", "idx", F.when(F.length("tok") % 2 == 0, "NOUN").otherwise("VERB").alias("label"))
    by_word, by_gram = reports.gloss_tag_counts(grams, gw, tags)
    return by_word.withColumn("kind", F.lit("word")).unionByName(by_gram.withColumn("kind", F.lit("gram")))


@query(f"WITH {_WORDS}, p(value) AS (VALUES ('./PUNC'), (',/PUNC'), ('!/PUNC'), ('?/PUNC'), (';/PUNC'), (':/PUNC')) SELECT value, count(*) AS n FROM (SELECT string_agg(replace(tok, '#', '') || '/' || upper(left(tok, 1)), ' ' ORDER BY idx) AS value FROM w WHERE tier = 'gw' GROUP BY igt_id UNION ALL SELECT value FROM p) GROUP BY value")
def tagger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    gw = words.words(normal(spark, sf_dir)).filter("tier = 'gw'")
    out = reports.tagger_lines(gw.select("igt_id", "idx", "tok"), gw.select("igt_id", "idx", F.upper(F.left("tok", F.lit(1))).alias("label")))
    return out.groupBy("value").agg(F.count("*").alias("n"))


@query(C._unrolled(5).rsplit(" SELECT ", 1)[0] + ", l AS (SELECT pair, sum(ne) AS l FROM e GROUP BY pair), q AS (SELECT pair, f, nf, sum(ne * t) AS p FROM c JOIN t5 USING (e, f) GROUP BY ALL) SELECT 'model 1' AS model, round(pow(2, -sum(nf * log2(p / l)) / sum(nf)), 6) AS perplexity FROM q JOIN l USING (pair)")
def ibm1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = C._em_bitext(spark, sf_dir)
    return spark.createDataFrame([("model 1", round(em.perplexity(b, em.ibm1(b, 5)), 6))], "model string, perplexity double")


# --- writers read back -------------------------------------------------------------------------------------------------


@query(f"WITH {_WORDS} SELECT tok AS form, upper(left(tok, 1)) AS label, count(*) AS n FROM w WHERE tier = 'w' GROUP BY ALL")
def slashtags_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words.words(normal(spark, sf_dir)).filter("tier = 'w'")
    path = f"{shared_folder(spark)}/slashtags-{uuid.uuid4()}"
    tagged.write_slashtags(w.select("igt_id", "idx", F.col("tok").alias("form"), F.upper(F.left("tok", F.lit(1))).alias("label")), path, ["igt_id"])
    return tagged.read_slashtags(spark, path).groupBy("form", "label").agg(F.count("*").alias("n"))


@query(f"WITH {_WORDS} SELECT '**NONE**' AS form, upper(left(tok, 1)) AS label, idx, count(*) AS n FROM w WHERE tier = 'w' GROUP BY ALL")
def tag_lines_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word TAG`` lines are read as features and label; a feature without the word prefix gives no form."""
    w = words.words(normal(spark, sf_dir)).filter("tier = 'w'")
    path = f"{shared_folder(spark)}/tags-{uuid.uuid4()}"
    tagged.write_tag_lines(w.select("igt_id", "idx", F.col("tok").alias("form"), F.upper(F.left("tok", F.lit(1))).alias("label")), path, ["igt_id"])
    return tagged.read_simpletagger(spark, path).groupBy("form", "label", "idx").agg(F.count("*").alias("n"))


_DEP = "d AS (SELECT k, dep, min(head) AS head, 'w' || dep AS word FROM (SELECT l_orderkey AS k, l_linenumber AS dep, l_linenumber // 2 AS head FROM lineitem) GROUP BY k, dep)"


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._edges(spark, sf_dir).select("k", "dep", "head", F.lit("dep").alias("type"), F.concat(F.lit("w"), F.col("dep").cast("string")).alias("word")).distinct()


@query(f"WITH {_DEP} SELECT dep AS idx, word AS form, head, CASE head WHEN 0 THEN 'root' ELSE 'dep' END AS deprel, count(*) AS n FROM d GROUP BY ALL")
def conll_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, tagged.conll_lines(_dependencies(spark, sf_dir), ["k"]), "conll")
    return tagged.read_conll(spark, path).groupBy("idx", "form", "head", "deprel").agg(F.count("*").alias("n"))


@query(f"WITH {_DEP} SELECT d.k, d.dep, 'dep(' || coalesce(h.word, 'ROOT') || '-' || d.head || ', ' || d.word || '-' || d.dep || ')' AS value FROM d LEFT JOIN d h ON h.k = d.k AND h.dep = d.head")
def stanford_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged.stanford_lines(_dependencies(spark, sf_dir), ["k"])


@query(f"WITH {_N} SELECT igt_id AS doc_id, ord, tag, text, 10 * igt_id + ord AS line_no FROM n")
def records_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).select(F.col("igt_id").alias("doc_id"), F.lit(1).alias("start"), F.lit(3).alias("stop"), "ord", (10 * F.col("igt_id") + F.col("ord")).alias("line_no"), "tag", "text")
    out = tagged.read_records(spark, written(spark, tagged.record_lines(rows), "records"))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ord", "tag", "text", F.col("line_no").cast("bigint").alias("line_no"))


@query(f"WITH {_N} SELECT tag, ord, text, count(*) AS n FROM n GROUP BY ALL")
def blocks_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = normal(spark, sf_dir).groupBy("igt_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n"), F.lit("\n")).alias("value"))
    return tagged.read_blocks(spark, written(spark, one, "blocks")).groupBy("tag", "ord", "text").agg(F.count("*").alias("n"))


@query(f"WITH {C._BITEXT}, {C._A1} SELECT src, tgt, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, src, tgt FROM a1) GROUP BY ALL")
def a3_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as aligner output, in as many files as there are tasks, and merged by pair number."""
    a = align.targets_of(C.align_exact(spark, sf_dir), C.PAIR)
    sets = F.transform(F.sort_array(F.collect_list(F.struct("src", "tgts"))), lambda x: x)
    one = a.groupBy(*C.PAIR).agg(sets.alias("x"))
    at = lambda i: F.get(F.filter("x", lambda p: p["src"] == i), F.lit(0))["tgts"]
    word = F.transform(F.sequence(F.lit(1), F.element_at("x", -1)["src"]), lambda i: F.concat(F.lit("w ({ "), F.array_join(F.coalesce(at(i), F.array().cast("array<int>")).cast("array<string>"), " "), F.lit(" })")))
    value = F.concat(F.format_string("# Sentence pair (%d) source length 1 target length 1 alignment score : 1\nw\nNULL ({ }) ", F.col("conv_id") * 1000 + F.col("turn")), F.array_join(word, " "))
    return tagged.read_a3(spark, written(spark, one.select(value.alias("value")), "a3")).groupBy("src", "tgt").agg(F.count("*").alias("n"))


@query(f"WITH {_WORDS}, v AS (SELECT tok, row_number() OVER (ORDER BY min((igt_id, idx))) + 1 AS id, count(*) AS n FROM w WHERE tier = 'w' GROUP BY tok) SELECT id::INT AS id, tok, n FROM v")
def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = counts.vocabulary(words.words(normal(spark, sf_dir)).filter("tier = 'w'"), ["igt_id", "idx"])
    return tagged.read_vocabulary(spark, written(spark, v.select(F.concat_ws(" ", F.col("id").cast("string"), "tok", F.col("n").cast("string")).alias("value")), "vocabulary"))


@query("SELECT DISTINCT n_name AS fine, replace(r_name, ' ', '_') AS coarse FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT LIKE '% %'")
def tag_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_name NOT LIKE '% %'")
    return tagged.read_tag_map(spark, written(spark, n.select(F.concat_ws("  ", "n_name", F.translate("r_name", " ", "_")).alias("value")), "tagmap"))


@query("SELECT DISTINCT r_name AS tag, n_name AS word FROM nation JOIN region ON n_regionkey = r_regionkey")
def prototypes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy("r_name").agg(F.array_sort(F.collect_set("n_name")).alias("w")).select(F.concat_ws("\t", F.array("r_name"), "w").alias("value"))
    return tagged.read_prototypes(spark, written(spark, rows, "prototypes"))


@query("SELECT '(S (A ' || p_type || ') (B ' || replace(p_name, ' ', '_') || '))' AS tree, count(*) AS n FROM part GROUP BY ALL")
def trees_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees over two lines each, with the outer brackets of treebank files."""
    value = F.concat(F.lit("( (S (A "), "p_type", F.lit(")\n   (B "), F.translate("p_name", " ", "_"), F.lit(")))"))
    return tagged.read_trees(spark, written(spark, table(spark, sf_dir, "part").select(value.alias("value")), "trees")).groupBy("tree").agg(F.count("*").alias("n"))


@query(f"WITH {_N} SELECT igt_id::VARCHAR AS igt_id, ord, tag, text FROM n")
def xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances written as XML, a file a task, and read again."""
    one = normal(spark, sf_dir).groupBy("igt_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "tag", "text"))), lambda x: F.format_string('<item id="r%d" tag="%s">%s</item>', x["ord"], x["tag"], x["text"])), "").alias("x"))
    igt = igt_xml.parse(one.select(F.concat(F.lit('<igt id="'), F.col("igt_id").cast("string"), F.lit('"><tier id="r" type="odin" state="raw">'), "x", F.lit("</tier></igt>")).alias("value")))
    path = f"{shared_folder(spark)}/xml-{uuid.uuid4()}"
    igt_xml.write(igt, path)
    return igt_xml.lines(igt_xml.items(igt_xml.load(spark, path)), "raw").select("igt_id", "ord", "tag", "text")


@query(f"WITH {_WORDS}, v AS (SELECT tok, row_number() OVER (ORDER BY min((igt_id, tier, idx))) + 1 AS id FROM w GROUP BY tok), i AS (SELECT igt_id, tier, string_agg(id::VARCHAR, ' ' ORDER BY idx) AS ids FROM w JOIN v USING (tok) GROUP BY ALL) SELECT a.igt_id, '1' || chr(10) || a.ids || chr(10) || b.ids AS value FROM i a JOIN i b USING (igt_id) WHERE a.tier = 'w' AND b.tier = 'gw'")
def coded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words.words(normal(spark, sf_dir)).filter("tier <> 'tw'")
    coded = w.join(counts.vocabulary(w, ["igt_id", "tier", "idx"]).select("tok", "id"), "tok")
    return tagged.coded_pairs(coded.filter("tier = 'w'"), coded.filter("tier = 'gw'"), ["igt_id"])


@query(f"WITH {_WORDS}, x AS (SELECT igt_id, tier, string_agg(lower(tok), ' ' ORDER BY idx) AS v FROM w GROUP BY ALL) SELECT 0 AS part, a.v AS e, b.v AS f, count(*) AS n FROM x a JOIN x b USING (igt_id) WHERE a.tier = 'w' AND b.tier = 'gw' GROUP BY ALL UNION ALL SELECT 1, n_name, r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def bitext_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words.words(normal(spark, sf_dir))
    extra = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("e"), F.col("r_name").alias("f"))
    return tagged.bitext(w.filter("tier = 'w'"), w.filter("tier = 'gw'"), extra, ["igt_id"]).groupBy("part", "e", "f").agg(F.count("*").alias("n"))
