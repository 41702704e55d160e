"""The registered queries over the driver's tables and their DuckDB equivalents.

The tables stand in for annotated instances: documents for lines, consecutive turns of a conversation for a bitext, a user's events
for a tag sequence, two labels for gold and prediction, nation to region for a tag map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.functions import text as T
from glosspark.operators import align, corpus, counts, em, evaluate, features, lines, project, trees, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PAIR = ["conv_id", "turn"]
W = r"[^ \t\n\r\f\v]+"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- tokens and counts -------------------------------------------------------------------------------------------------


@query(rf"SELECT lang, count(*) AS tokens, count(DISTINCT w) AS types FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM documents) GROUP BY lang")
def tok_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased tokens and types of each language: a word count first, so that no token is shuffled twice."""
    docs = table(spark, sf_dir, "documents")
    by_word = docs.select("lang", F.explode(counts.pattern_tokens(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    return by_word.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query(rf"SELECT lang, count(*) AS n, count(DISTINCT t) AS types FROM (SELECT lang, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_'']+|\$[\p{{Nd}}.]+|{W}')) AS t FROM documents) GROUP BY lang")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(T.sentence_tokens("text")).alias("t"))
    return rows.groupBy("lang", "t").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("types"))


@query(r"SELECT lang, count(*) AS n, count(DISTINCT t) AS types FROM (SELECT lang, unnest(regexp_extract_all(text, '[^ \t\n\r\f\v\-.:/()=]+')) AS t FROM documents) GROUP BY lang")
def morph_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(T.morphs("text")).alias("t"))
    return rows.groupBy("lang", "t").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("types"))


@query(rf"""
WITH p AS (SELECT item_id, regexp_extract_all(text, '{W}') AS w, regexp_split_to_array(text, '{W}') AS g FROM benchmark),
u AS (SELECT item_id, unnest(w) AS tok, generate_subscripts(w, 1) AS idx, w, g FROM p)
SELECT item_id, idx::INT AS idx, tok, (list_sum(list_transform(g[1:idx], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:idx - 1], lambda x: length(x))), 0))::INT AS start FROM u""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").withColumn("w", T.words("text"))
    return rows.select("item_id", F.explode(T.with_offsets("text", F.col("w"))).alias("t")).select("item_id", F.col("t.idx").cast("int").alias("idx"), F.col("t.tok").alias("tok"), F.col("t.start").cast("int").alias("start"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type")
def two_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(table(spark, sf_dir, "part"), "p_brand", "p_type")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    return counts.count(part.filter("p_size < 25"), "p_brand", "p_type"), counts.count(part.filter("p_size >= 25"), "p_brand", "p_type")


@query("SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY p_brand, p_type")
def combined_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.combine(*_halves(spark, sf_dir))


_PART = "c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type)"


@query(f"WITH {_PART} SELECT p_brand, p_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM c) WHERE rank <= 3")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.top_n(two_level_counts(spark, sf_dir), "p_brand", "p_type", 3)


@query(f"WITH {_PART} SELECT p_brand, p_type, n FROM c WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.most_frequent(two_level_counts(spark, sf_dir), "p_brand", "p_type", 1).select("p_brand", "p_type", "n")


@query("WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, n, sum(n) OVER (PARTITION BY l_returnflag)::BIGINT AS total, round(n / sum(n) OVER (PARTITION BY l_returnflag), 8) AS inner_share, round(sum(n) OVER (PARTITION BY l_returnflag) / sum(n) OVER (), 8) AS outer_share FROM c")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.marginals(counts.count(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus")
    return out.withColumn("inner_share", F.round("inner_share", 8)).withColumn("outer_share", F.round("outer_share", 8))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round((n + 0.5) / (sum(n) OVER () + 0.5 * count(*) OVER ()), 8) AS p FROM c")
def smoothed_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.smoothed(counts.count(table(spark, sf_dir, "events"), "event_type"), 0.5).withColumn("p", F.round("p", 8))


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("label"), (F.col("user_id") % 97).cast("string").alias("form"))


@query("""
WITH e AS (SELECT ts, event_id, event_type AS label, (user_id % 97)::VARCHAR AS form FROM events),
f AS (SELECT label, count(*) AS types FROM (SELECT form, arg_min(label, (ts, event_id)) AS label FROM e GROUP BY form) GROUP BY label),
t AS (SELECT label, count(*) AS tokens FROM e GROUP BY label)
SELECT label, tokens, coalesce(types, 0) AS types, round(100.0 * tokens / sum(tokens) OVER (), 6) AS token_share, round(100.0 * coalesce(types, 0) / sum(coalesce(types, 0)) OVER (), 6) AS type_share FROM t LEFT JOIN f USING (label)""")
def pos_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.tag_statistics(_sequence(spark, sf_dir), ["ts", "event_id"])
    return out.select("label", "tokens", "types", F.round("token_share", 6).alias("token_share"), F.round("type_share", 6).alias("type_share"))


@query(f"WITH {_PART}, k AS (SELECT p_brand FROM c GROUP BY p_brand HAVING sum(n) >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM c WHERE p_brand IN (SELECT p_brand FROM k)) SELECT p_brand, p_type, round(n / sum(n) OVER (PARTITION BY p_brand), 8) AS p FROM r WHERE rn <= 2")
def constraints_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.constraints(two_level_counts(spark, sf_dir), "p_brand", "p_type").withColumn("p", F.round("p", 8))


@query(f"WITH {_PART}, b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1) SELECT p_type, p_brand, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rank FROM b WHERE n > 1) WHERE rank <= 2")
def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.prototypes(two_level_counts(spark, sf_dir), "p_brand", "p_type", 2).select("p_type", "p_brand", "n", "rank")


@query(f"WITH {_PART}, t AS (SELECT *, sum(n) OVER (PARTITION BY p_type) AS t FROM c) SELECT p_brand, p_type FROM t, range(n) WHERE t >= 10")
def counted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.repeated_rows(two_level_counts(spark, sf_dir), "p_type", 10)


@query(rf"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS tok, generate_subscripts(regexp_extract_all(lower(text), '{W}'), 1) AS i, item_id FROM benchmark) SELECT tok, row_number() OVER (ORDER BY min((item_id, i))) + 1 AS id, count(*) AS n FROM w GROUP BY tok")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(counts.pattern_tokens(F.col("text"))).alias("i", "tok"))
    out = counts.vocabulary(rows, ["item_id", "i"])
    return out.select("tok", F.col("id").cast("bigint").alias("id"), "n")


# --- lines -------------------------------------------------------------------------------------------------------------

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM documents)"
_BLANK = "array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '{re}'), list_concat(list_transform(regexp_extract_all({x}, '{re}'), lambda m: repeat(' ', length(m)::BIGINT)), [''])), lambda z: z[1] || z[2]), '')"


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)


def _blank(x: str, pattern: str) -> str:
    return _BLANK.format(x=x, re=pattern.replace("'", "''"))


def _chain(start: str, *steps: Callable[[str], str]) -> str:
    """CTE columns so that no expression is written out twice."""
    out, name = "", start
    for k, step in enumerate(steps):
        out += f", x{k} AS (SELECT doc_id, i, {step('v')} AS v FROM {name})"
        name = f"x{k}"
    return f"WITH {_LINES}, start AS (SELECT doc_id, i, line AS v FROM l){out} SELECT doc_id, i, v FROM {name}"


_WS = r"[ \t\n\r\f\v]"
_NUMBERING = [lambda v: _blank(v, r"\((?:[ivx]+|[a-z]|[1-9.]+[a-z]?)\)"), lambda v: _blank(v, rf"^{_WS}*(?:[a-z]|[ivx]+)\."), lambda v: _blank(v, rf"^{_WS}*[0-9]+")]
_QUOTES = [lambda v: _blank(v, rf"""^{_WS}*['"`\[(]+"""), lambda v: _blank(v, rf"""['"`\]).]+{_WS}*$""")]


@query(_chain("start", *_NUMBERING, *_QUOTES, lambda v: f"translate({v}, '[]()', '    ')"))
def clean_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lines(spark, sf_dir).select("doc_id", "i", T.clean_lang("line").alias("v"))


def _sub(pattern: str, to: str) -> Callable[[str], str]:
    return lambda v: f"regexp_replace({v}, '{pattern}', '{to}', 'g')"


def _rejoin(letter: str, right: bool) -> Callable[[str], str]:
    return _sub(rf"{_WS}({letter}){_WS}+({W})", r" \1\2") if right else _sub(rf"({W}){_WS}+({letter}){_WS}", r"\1\2 ")


@query(_chain("start", lambda v: f"translate({v}, '.?!,Â', '     ')", *_QUOTES, lambda v: f"translate({v}, '#*?', '   ')", _rejoin("t", True), _rejoin("h", False), _rejoin("e", False), *_NUMBERING))
def clean_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lines(spark, sf_dir).select("doc_id", "i", T.clean_trans("line").alias("v"))


_LET = r"[\p{L}\p{N}_]"


# without lookahead: all joins, then those that overlapped one before
_JOINED = [_sub(rf"({_LET}){before}([.\-]){after}({_LET})", r"\1\2\3") for before, after in ((f"{_WS}*", f"{_WS}*"), ("", f"{_WS}+"), (f"{_WS}+", f"{_WS}*"))]


def _grams() -> list[Callable[[str], str]]:
    return [_sub(f"(?i){g[:k]}{_WS}+{g[k:]}", g) for g in T.GRAMS for k in range(1, len(g))]


@query(_chain("start", *_JOINED, *_grams(), _rejoin("t", True), _rejoin("h", False), lambda v: _blank(v, "[.?!,Â]+$"), lambda v: f"translate({v}, '#', ' ')"))
def clean_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lines(spark, sf_dir).select("doc_id", "i", T.clean_gloss("line").alias("v"))


def _marked(x: Column) -> Column:
    """Some lines with a judgment mark, as sources have them."""
    return F.when(F.length(x) % 3 == 0, F.concat(F.lit(" *"), x)).when(F.length(x) % 3 == 1, F.concat(F.lit("'?"), x)).otherwise(x)


@query(rf"""
WITH {_LINES}, m AS (SELECT doc_id, i, CASE length(line) % 3 WHEN 0 THEN ' *' || line WHEN 1 THEN '''?' || line ELSE line END AS m FROM l),
u AS (SELECT *, regexp_extract(m, '^([ \t\n\r\f\v''"`]*)([?*])', 2) AS j, regexp_replace(m, '^([ \t\n\r\f\v''"`]*)([?*])', '\1 ') AS v FROM m)
SELECT doc_id, i, v, nullif(j || CASE WHEN contains(v, '*') THEN '*' ELSE '' END, '') AS judgment FROM u""")
def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_lines(spark, sf_dir).withColumn("m", _marked(F.col("line")))
    return rows.select("doc_id", "i", T.unjudged("m").alias("v"), T.judgment("m").alias("judgment"))


@query(rf"WITH {_LINES}, n AS (SELECT *, min(length(regexp_extract(line, '^{_WS}*'))) OVER (PARTITION BY doc_id) AS k FROM l) SELECT doc_id, i, line[k + 1:] AS v FROM n")
def common_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.common_indent(F.split("text", "\n")).alias("x"))
    return rows.select("doc_id", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i") + 1)


_TAGGED = "r AS (SELECT doc_id AS igt_id, i AS ord, doc_id::VARCHAR || '.' || i AS item_id, ['L','G','T','L+CN','T+DB'][(i - 1) % 5 + 1] AS tag, line AS text FROM l)"


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.get(F.array(*map(F.lit, ("L", "G", "T", "L+CN", "T+DB"))), (F.col("i") - 1) % 5)
    return _doc_lines(spark, sf_dir).select(F.col("doc_id").alias("igt_id"), F.col("i").alias("ord"), F.concat_ws(".", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("item_id"), tag.alias("tag"), F.col("line").alias("text"))


@query(f"WITH {_LINES}, {_TAGGED} SELECT igt_id, min(ord) AS ord, CASE WHEN count(*) = 1 THEN any_value(tag) ELSE tag[1] END AS tag, string_agg(text, '' ORDER BY ord) AS text, string_agg(item_id, ',' ORDER BY ord) AS sources FROM (SELECT *, string_split(tag, '+')[1] AS p FROM r) GROUP BY igt_id, p, tag[1]")
def line_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.clean_lines(_raw_lines(spark, sf_dir))
    return out.select("igt_id", "ord", "tag", "text", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_LINES}, {_TAGGED} SELECT igt_id, count(*) AS n FROM (SELECT DISTINCT igt_id FROM r WHERE tag = 'G' INTERSECT SELECT DISTINCT igt_id FROM r WHERE tag LIKE 'T%') JOIN r USING (igt_id) GROUP BY igt_id")
def require_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_lines(spark, sf_dir)
    kept = corpus.require_lines(raw.select("igt_id").distinct(), raw, ["G", "T"])
    return raw.join(kept, "igt_id", "left_semi").groupBy("igt_id").agg(F.count("*").alias("n"))


# --- bitext ------------------------------------------------------------------------------------------------------------

_BITEXT = rf"""b AS (SELECT a.conv_id, a.turn, a.text AS s, c.text AS t FROM conversations a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1 WHERE a.role = 'user' AND c.role = 'assistant'),
s AS (SELECT conv_id, turn, unnest(w) AS tok, generate_subscripts(w, 1)::INT AS idx FROM (SELECT conv_id, turn, regexp_extract_all(s, '{W}') AS w FROM b)),
t AS (SELECT conv_id, turn, unnest(w) AS tok, generate_subscripts(w, 1)::INT AS idx FROM (SELECT conv_id, turn, regexp_extract_all(t, '{W}') AS w FROM b))"""


def _matched(name: str, form: str) -> str:
    side = "SELECT conv_id, turn, idx, {f} AS f, row_number() OVER (PARTITION BY conv_id, turn, {f} ORDER BY idx) AS rn FROM {x}"
    return f"{name} AS (SELECT conv_id, turn, x.idx AS src, y.idx AS tgt FROM ({side.format(f=form, x='s')}) x JOIN ({side.format(f=form, x='t')}) y USING (conv_id, turn, f, rn))"


_A1, _A2 = _matched("a1", "lower(tok)"), _matched("a2", "left(lower(tok), 3)")
_ALN = f"WITH {_BITEXT}, {_A1}, {_A2}"
_CORE = "core AS (SELECT * FROM a1 INTERSECT SELECT * FROM a2), uni AS (SELECT * FROM a1 UNION SELECT * FROM a2)"
_OPEN = "({x}.conv_id, {x}.turn, {x}.src) NOT IN (SELECT conv_id, turn, src FROM {y}) OR ({x}.conv_id, {x}.turn, {x}.tgt) NOT IN (SELECT conv_id, turn, tgt FROM {y})"
_GROWN = f"""{_CORE}, near AS (SELECT DISTINCT conv_id, turn, src + dx AS src, tgt + dy AS tgt FROM core, (VALUES (-1,0),(0,-1),(1,0),(0,1),(-1,-1),(-1,1),(1,-1),(1,1)) d(dx, dy)),
gd AS (SELECT * FROM core UNION SELECT n.* FROM (SELECT * FROM near INTERSECT SELECT * FROM uni) n WHERE {_OPEN.format(x="n", y="core")})"""


def bitext(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens of user turns and of the assistant turns that follow them."""
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("s"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    both = a.join(b, PAIR)
    side = lambda x: both.select(*PAIR, F.posexplode(T.words(x)).alias("i", "tok")).select(*PAIR, (F.col("i") + 1).cast("int").alias("idx"), "tok")
    return side("s"), side("t")


def _prefix(x: Column) -> Column:
    return F.left(F.lower(x), F.lit(3))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, t = bitext(spark, sf_dir)
    return align.matched(s, t, PAIR), align.matched(s, t, PAIR, _prefix)


@query(f"WITH {_BITEXT}, {_A1} SELECT * FROM a1")
def align_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.matched(*bitext(spark, sf_dir), PAIR)


@query(f"WITH {_BITEXT}, {_A1}, r AS (SELECT * FROM s WHERE (conv_id, turn, idx) NOT IN (SELECT conv_id, turn, src FROM a1)) SELECT * FROM a1 UNION SELECT r.conv_id, r.turn, r.idx AS src, t.idx AS tgt FROM r JOIN t ON r.conv_id = t.conv_id AND r.turn = t.turn AND lower(r.tok) = lower(t.tok)")
def align_exact_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.matched(*bitext(spark, sf_dir), PAIR, multi=True)


@query()
def align_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.heuristic(*bitext(spark, sf_dir), PAIR, gram=False)


@query()
def align_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.heuristic(*bitext(spark, sf_dir), PAIR)


@query(f"{_ALN}, {_CORE} SELECT * FROM core")
def sym_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.intersection(*_two(spark, sf_dir), PAIR)


@query(f"{_ALN}, {_CORE} SELECT * FROM uni")
def sym_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.union(*_two(spark, sf_dir), PAIR)


@query(f"{_ALN} SELECT * FROM a2 EXCEPT SELECT * FROM a1")
def sym_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return align.difference(b, a, PAIR)


@query(f"{_ALN}, {_GROWN} SELECT * FROM gd")
def sym_grow_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.grow_diag(*_two(spark, sf_dir), PAIR)


@query(f"{_ALN}, {_GROWN}, f1 AS (SELECT * FROM gd UNION SELECT a.* FROM a1 a WHERE {_OPEN.format(x='a', y='gd')}) SELECT * FROM f1 UNION SELECT a.* FROM a2 a WHERE {_OPEN.format(x='a', y='f1')}")
def sym_grow_diag_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.grow_diag_final(*_two(spark, sf_dir), PAIR)


@query()
def sym_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.refined(*_two(spark, sf_dir), PAIR)


@query(f"{_ALN} SELECT DISTINCT x.conv_id, x.turn, x.src, y.src AS tgt FROM a1 x JOIN a2 y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.tgt = y.tgt")
def align_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return align.compose(a, align.flip(b, PAIR), PAIR)


@query(f"WITH {_BITEXT}, {_A1} SELECT * FROM a1 UNION ALL SELECT conv_id, turn, idx, 0 FROM s WHERE (conv_id, turn, idx) NOT IN (SELECT conv_id, turn, src FROM a1) UNION ALL SELECT conv_id, turn, 0, idx FROM t WHERE (conv_id, turn, idx) NOT IN (SELECT conv_id, turn, tgt FROM a1)")
def align_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = bitext(spark, sf_dir)
    return align.with_nulls(align.matched(s, t, PAIR), s, t, PAIR)


@query(f"WITH {_BITEXT}, {_A2} SELECT a.conv_id, a.turn, src, tgt, s.tok AS src_tok, t.tok AS tgt_tok FROM a2 a JOIN s ON s.conv_id = a.conv_id AND s.turn = a.turn AND s.idx = src JOIN t ON t.conv_id = a.conv_id AND t.turn = a.turn AND t.idx = tgt")
def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = bitext(spark, sf_dir)
    return align.word_pairs(align.matched(s, t, PAIR, _prefix), s, t, PAIR)


@query(f"WITH {_BITEXT}, {_A1} SELECT conv_id, turn, string_agg(src || ':' || tgt, ' ' ORDER BY src, tgt) AS alignment FROM a1 GROUP BY conv_id, turn")
def align_serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.serialize(align_exact(spark, sf_dir), PAIR)


@query(f"{_ALN}, m AS (SELECT 'exact' AS method, * FROM a1 UNION ALL SELECT 'prefix', * FROM a2), gold AS (SELECT * FROM a1 WHERE src % 2 = 0), g AS (SELECT count(*) AS gold FROM gold), n AS (SELECT method, count(*) AS test, count(o.src) AS matches FROM m LEFT JOIN gold o USING (conv_id, turn, src, tgt) GROUP BY ROLLUP(method)) SELECT coalesce(method, 'all') AS method, matches, test, gold * CASE WHEN method IS NULL THEN 2 ELSE 1 END AS gold, round(1 - 2 * matches / (test + gold * CASE WHEN method IS NULL THEN 2 ELSE 1 END), 8) AS aer, round(matches / test, 8) AS \"precision\" FROM n, g")
def aer_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    gold = a.filter("src % 2 = 0")
    test = a.withColumn("method", F.lit("exact")).unionByName(b.withColumn("method", F.lit("prefix")))
    n = evaluate.alignment_counts(gold, test, PAIR, ["method"]).crossJoin(F.broadcast(gold.agg(F.count("*").alias("gold"))))  # one row
    pooled = n.agg(F.sum("test").alias("test"), F.sum("matches").alias("matches"), F.sum("gold").alias("gold")).withColumn("method", F.lit("all"))
    out = evaluate.alignment_scores(n.unionByName(pooled))
    return out.select("method", "matches", "test", "gold", F.round("aer", 8).alias("aer"), F.round("precision", 8).alias("precision"))


@query(f"WITH {_BITEXT}, v AS (SELECT tok, row_number() OVER (ORDER BY min((conv_id, turn, idx))) + 1 AS id FROM s GROUP BY tok), u AS (SELECT tok, row_number() OVER (ORDER BY min((conv_id, turn, idx))) + 1 AS id FROM t GROUP BY tok), e AS (SELECT DISTINCT conv_id, turn, id FROM s JOIN v USING (tok)), f AS (SELECT DISTINCT conv_id, turn, id FROM t JOIN u USING (tok)) SELECT DISTINCT e.id::BIGINT AS src_id, f.id::BIGINT AS tgt_id FROM e JOIN f USING (conv_id, turn) UNION SELECT DISTINCT 0, id FROM f")
def cooc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-occurring ids of all words of both sides."""
    coded = [side.join(counts.vocabulary(side, [*PAIR, "idx"]), "tok").select(*PAIR, "id") for side in bitext(spark, sf_dir)]
    out = counts.cooccurrence(*coded, PAIR)
    return out.select(F.col("src_id").cast("bigint").alias("src_id"), F.col("tgt_id").cast("bigint").alias("tgt_id"))


_TAGS = "g AS (SELECT conv_id, turn, idx, CASE length(tok) % 5 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'DET' WHEN 3 THEN 'FOREIGN' END AS label FROM s)"
_ORDER = "['" + "', '".join(project.PRECEDENCE) + "']"


def _tags(tokens: DataFrame) -> DataFrame:
    label = F.when(F.length("tok") % 5 == 0, "NOUN").when(F.length("tok") % 5 == 1, "VERB").when(F.length("tok") % 5 == 2, "DET").when(F.length("tok") % 5 == 3, "FOREIGN")
    return tokens.select(*PAIR, "idx", label.alias("label")).filter("label IS NOT NULL")


@query(f"WITH {_BITEXT}, {_A2}, {_TAGS}, m AS (SELECT DISTINCT x.conv_id, x.turn, x.src, y.tgt FROM a2 x JOIN a2 y ON x.conv_id = y.conv_id AND x.turn = y.turn AND abs(x.tgt - y.tgt) <= 1), j AS (SELECT m.conv_id, m.turn, tgt, src, label, nullif(list_position({_ORDER}, label), 0) AS r FROM m JOIN g ON g.conv_id = m.conv_id AND g.turn = m.turn AND g.idx = m.src WHERE label IS NOT NULL), k AS (SELECT conv_id, turn, tgt, arg_min((label, r), src) AS f, arg_min(label, (r, src)) FILTER (r IS NOT NULL) AS best FROM j GROUP BY ALL) SELECT conv_id, turn, tgt AS idx, CASE WHEN f[2] IS NULL THEN f[1] ELSE best END AS label FROM k")
def project_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = bitext(spark, sf_dir)
    a = align.matched(s, t, PAIR, _prefix)
    near = a.select(*PAIR, F.explode(F.sequence(F.col("tgt") - 1, F.col("tgt") + 1)).alias("tgt"), "src").join(a.select(*PAIR, "tgt"), [*PAIR, "tgt"], "left_semi").select(*PAIR, "src", "tgt").distinct()
    return project.by_precedence(near, _tags(s), PAIR)


@query(f"WITH {_BITEXT}, {_A1}, {_TAGS} SELECT a.conv_id, a.turn, tgt AS idx, coalesce(label, 'UNK') AS label FROM a1 a JOIN g ON g.conv_id = a.conv_id AND g.turn = a.turn AND g.idx = src")
def gloss_to_lang_unk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = bitext(spark, sf_dir)
    return project.across(align.matched(s, t, PAIR), _tags(s), PAIR, "UNK")


@query(f"WITH {_BITEXT} SELECT conv_id, turn FROM (SELECT conv_id, turn, count(*) AS n FROM s GROUP BY ALL) JOIN (SELECT conv_id, turn, count(*) AS n FROM t GROUP BY ALL) USING (conv_id, turn, n)")
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = bitext(spark, sf_dir)
    return align.positional(s, t, PAIR).select(*PAIR).distinct()


@query(rf"""
WITH o AS (SELECT item_id, w, g, text FROM (SELECT item_id, text, regexp_extract_all(text, '{W}') AS w, regexp_split_to_array(text, '{W}') AS g FROM benchmark)),
p AS (SELECT item_id, unnest(w) AS tok, generate_subscripts(w, 1)::INT AS idx, w, g FROM o),
q AS (SELECT item_id, idx, tok, list_sum(list_transform(g[1:idx], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:idx - 1], lambda x: length(x))), 0) AS a FROM p),
r AS (SELECT item_id, idx, a, a + length(tok) AS b FROM q)
SELECT x.item_id, x.idx AS src, y.idx AS tgt FROM r x JOIN r y ON y.item_id = x.item_id + 1 AND ((x.a >= y.a AND x.b <= y.b) OR (y.a >= x.a AND y.b <= x.b))""")
def columnar_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("below"))
    return b.join(nxt, "item_id").select("item_id", F.explode(T.strict_columns("text", "below")).alias("p")).select("item_id", F.col("p.src").cast("int").alias("src"), F.col("p.tgt").cast("int").alias("tgt"))


@query("WITH o AS (SELECT l_orderkey AS k, list({'s': l_linenumber::INT, 'e': (l_linenumber + l_quantity)::INT}) AS x FROM lineitem GROUP BY 1) SELECT count(*) FILTER (len(list_filter(x, lambda b: len(list_filter(x, lambda a, i: i % 2 = 1 AND b.s >= a.s AND b.e <= a.e)) = 0)) = 0) AS n FROM (SELECT k, list_sort(x) AS x FROM o)")
def span_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("s"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("e"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(spans.alias("x"))
    every_other = F.filter("x", lambda a, i: i % 2 == 0)
    return rows.agg(F.count_if(T.span_contains(every_other, F.col("x"))).alias("n"))


# --- evaluation --------------------------------------------------------------------------------------------------------

_M = "m AS (SELECT gold, pred, count(*) AS n FROM (SELECT quality::VARCHAR AS gold, toxic::VARCHAR AS pred FROM labels) GROUP BY ALL)"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("pred")))


@query(f"WITH {_M} SELECT * FROM m")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query(f"WITH {_M} SELECT sum(CASE WHEN gold = pred THEN n ELSE 0 END)::BIGINT AS matches, sum(n)::BIGINT AS total, round(100 * sum(CASE WHEN gold = pred THEN n ELSE 0 END) / sum(n), 8) AS accuracy FROM m")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_matrix(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 8))


@query(f"WITH {_M}, g AS (SELECT gold AS tag, sum(n) AS gold FROM m GROUP BY 1), p AS (SELECT pred AS tag, sum(n) AS pred FROM m GROUP BY 1), h AS (SELECT gold AS tag, n AS hit FROM m WHERE gold = pred), a AS (SELECT tag, coalesce(gold, 0)::BIGINT AS gold, coalesce(pred, 0)::BIGINT AS pred, coalesce(hit, 0)::BIGINT AS hit FROM g FULL JOIN p USING (tag) LEFT JOIN h USING (tag)), b AS (SELECT *, coalesce(100 * hit / nullif(pred, 0), 0) AS pr, coalesce(100 * hit / nullif(gold, 0), 0) AS re FROM a) SELECT tag, gold, pred, hit, round(pr, 6) AS \"precision\", round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS fmeasure FROM b")
def tag_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.by_tag(_matrix(spark, sf_dir))
    return out.select("tag", "gold", "pred", "hit", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "fmeasure")))


@query(f"WITH {_M} SELECT pred, gold AS mapped FROM m QUALIFY row_number() OVER (PARTITION BY pred ORDER BY n DESC, gold) = 1")
def n_to_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.many_to_one(_matrix(spark, sf_dir))


@query("SELECT quality::VARCHAR AS gold, count(*) FILTER (toxic = 0)::BIGINT AS \"0\", count(*) FILTER (toxic = 1)::BIGINT AS \"1\", count(*)::BIGINT AS total FROM labels GROUP BY 1")
def error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_matrix(_matrix(spark, sf_dir), ["0", "1"])


@query("WITH g AS (SELECT l_orderkey AS k, l_linenumber AS idx, l_returnflag AS label FROM lineitem), p AS (SELECT k, idx, list(label) AS ls FROM (SELECT DISTINCT l_orderkey AS k, greatest(l_linenumber - 1, 1) AS idx, l_returnflag AS label FROM lineitem) GROUP BY ALL) SELECT sum(list_contains(ls, label)::INT)::BIGINT AS matches, count(*) AS compared FROM g JOIN p USING (k, idx)")
def liberal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("label"))
    return evaluate.liberal(rows, rows.withColumn("idx", F.greatest(F.col("idx") - 1, F.lit(1))), ["k"])


# --- corpus operators --------------------------------------------------------------------------------------------------

_SIZES = "z AS (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(items, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query(f"WITH {_SIZES}, u AS (SELECT *, sum(n) OVER (ORDER BY o_orderkey) AS upto, sum(n) OVER () AS t FROM z) SELECT o_orderkey, CASE WHEN upto < round_even(0.8::DOUBLE * t, 0) THEN 'train' WHEN upto < round_even(0.9::DOUBLE * t, 0) THEN 'dev' ELSE 'test' END AS part FROM u")
def split_train_dev_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split(_sizes(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "part")


@query("WITH d AS (SELECT (row_number() OVER (ORDER BY doc_id) + 49) // 50 * 50 AS size, n_chars FROM documents), s AS (SELECT size, count(*) AS n, sum(n_chars) AS c FROM d GROUP BY size) SELECT size::INT AS size, (sum(n) OVER (ORDER BY size))::BIGINT AS sentences, (sum(c) OVER (ORDER BY size))::BIGINT AS chars FROM s")
def data_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50 documents up to all of them, the last partial step included."""
    return corpus.whole_curve(table(spark, sf_dir, "documents"), ["doc_id"], 50, "n_chars").withColumnRenamed("total", "chars")


@query("SELECT event_id, event_type AS label, lag(event_type, 1, '**NONE**') OVER w AS prev, lead(event_type, 1, '**NONE**') OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequence(spark, sf_dir).withColumn("idx", F.struct("ts", "event_id"))
    return features.context(rows, ["user_id"], "label").select("event_id", "label", "prev", "next")


@query("SELECT c_custkey, lower(c_mktsegment) AS form, right(lower(c_mktsegment), 3) AS s3, right(lower(c_mktsegment), 1) AS s1, left(lower(c_mktsegment), 3) AS p3, left(lower(c_mktsegment), 2) AS p2 FROM customer")
def affix_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = T.gram_form("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", form.alias("form"), F.right(form, F.lit(3)).alias("s3"), F.right(form, F.lit(1)).alias("s1"), F.left(form, F.lit(3)).alias("p3"), F.left(form, F.lit(2)).alias("p2"))


@query("WITH c AS (SELECT event_type AS tag, (user_id % 97)::VARCHAR AS word, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS rn FROM c) SELECT word, string_agg(tag, ',' ORDER BY rn) AS tags FROM d WHERE rn <= 2 GROUP BY word")
def dict_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counts.count(_sequence(spark, sf_dir), "form", "label").select(F.col("form").alias("word"), F.col("label").alias("tag"), "n")
    return features.dictionary(c).select("word", F.array_join("tags", ",").alias("tags"))


@query("WITH e AS (SELECT event_id, user_id, lower(event_type) AS form, lag(event_type, 1, '**NONE**') OVER w AS p, lead(event_type, 1, '**NONE**') OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, concat_ws(chr(9), 'X', 'gram-suffix-3-' || right(form, 3) || ':1', 'gram-suffix-2-' || right(form, 2) || ':1', 'gram-suffix-1-' || right(form, 1) || ':1', 'gram-prefix-3-' || left(form, 3) || ':1', 'gram-prefix-2-' || left(form, 2) || ':1', 'gram-prefix-1-' || left(form, 1) || ':1', 'prev-gram-' || CASE WHEN p = '**NONE**' THEN p ELSE lower(p) END || ':1', 'next-gram-' || CASE WHEN n = '**NONE**' THEN n ELSE lower(n) END || ':1', form || ':1') AS value FROM e")
def svmlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequence(spark, sf_dir).withColumn("idx", F.struct("ts", "event_id")).withColumn("tok", F.col("label"))
    rows = features.context(rows.drop("label"), ["user_id"]).drop("idx").withColumnRenamed("event_id", "idx")
    out = features.gram_features(rows, ["user_id"]).withColumn("label", F.lit("X"))
    return out.select(F.col("idx").alias("event_id"), F.concat_ws("\t", F.col("label"), F.array_join(F.transform("features", lambda f: F.concat(f, F.lit(":1"))), "\t")).alias("value"))


@query("SELECT c_custkey AS idx, coalesce(r_name, n_name) AS label FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
def tagmap_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").filter("r_regionkey < 3")
    tagmap = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("fine"), F.col("r_name").alias("coarse"))
    tags = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("idx"), F.col("n_name").alias("label"))
    return project.mapped(tags, tagmap)


@query("SELECT doc_id, lang, source FROM documents WHERE source < 'src5' UNION ALL SELECT doc_id, lang, source FROM documents WHERE source >= 'src5'")
def union_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return corpus.concatenate(docs.filter("source < 'src5'"), docs.filter("source >= 'src5'"))


@query("SELECT l_partkey AS p FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def intersect_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("p")).intersect(items.filter("l_returnflag = 'R'").select("l_partkey"))


@query("SELECT p_partkey AS p FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def minus_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("p"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")).subtract(items)


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), l AS (SELECT DISTINCT lang FROM c) SELECT l.lang, c.source, sum(n)::BIGINT AS n FROM l JOIN c ON l.lang <> c.lang GROUP BY ALL")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.leave_one_out(counts.count(table(spark, sf_dir, "documents"), "lang", "source"), "lang")


@query("SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) * 8 / count(*) OVER ())::INT AS chunk FROM documents")
def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 8).select("doc_id", "chunk")


# --- trees and models --------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT l_orderkey AS k, l_linenumber AS dep, l_linenumber // 2 AS head FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("dep"), F.floor(F.col("l_linenumber") / 2).cast("int").alias("head"))


@query(f"WITH RECURSIVE {_EDGES}, d AS (SELECT k, dep, 1 AS depth FROM e WHERE head = 0 UNION SELECT e.k, e.dep, depth + 1 FROM d JOIN e ON e.k = d.k AND e.head = d.dep) SELECT k, dep, min(depth)::INT AS depth FROM d GROUP BY k, dep")
def dep_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.depths(_edges(spark, sf_dir), ["k"])


@query(f"WITH {_EDGES}, n AS (SELECT k, dep, head, min(l_linestatus) AS label FROM e JOIN lineitem ON l_orderkey = k AND l_linenumber = dep GROUP BY ALL), c AS (SELECT p.k, p.label AS lhs, string_agg(c.label, ' ' ORDER BY c.dep) AS rhs FROM n p JOIN n c ON c.k = p.k AND c.head = p.dep GROUP BY p.k, p.dep, p.label) SELECT lhs || ' -> ' || rhs AS rule, count(*) AS n FROM c GROUP BY 1")
def cfg_productions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("l_linestatus"))
    nodes = items.select(F.col("l_orderkey").alias("igt_id"), F.col("l_linenumber").alias("node_id"), F.floor(F.col("l_linenumber") / 2).cast("int").alias("parent_id"), F.col("l_linenumber").alias("ord"), F.col("l_linestatus").alias("label"), F.lit(None).cast("int").alias("leaf_idx"))
    return trees.productions(nodes)


def _em_bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against types: one short sentence pair per part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair"), T.words("p_name").alias("e"), T.words("p_type").alias("f"))
    side = lambda s: part.select("pair", F.lit(s).alias("side"), F.posexplode(s).alias("i", "tok")).select("pair", "side", (F.col("i") + 1).cast("int").alias("idx"), "tok")
    return side("e").unionByName(side("f"))


def _unrolled(iterations: int) -> str:
    sql = rf"""WITH p AS (SELECT p_partkey AS pair, regexp_extract_all(p_name, '{W}') AS es, regexp_extract_all(p_type, '{W}') AS fs FROM part),
e AS (SELECT pair, e, count(*) AS ne FROM (SELECT pair, unnest(list_append(es, 'NULL')) AS e FROM p) GROUP BY ALL), f AS (SELECT pair, f, count(*) AS nf FROM (SELECT pair, unnest(fs) AS f FROM p) GROUP BY ALL),
c AS (SELECT pair, e, f, ne, nf FROM e JOIN f USING (pair)), t0 AS (SELECT DISTINCT e, f, 1.0::DOUBLE AS t FROM c)"""
    for k in range(iterations):
        sql += f""", s{k} AS (SELECT c.*, t, sum(ne * t) OVER (PARTITION BY pair, f) AS z FROM c JOIN t{k} USING (e, f)), g{k} AS (SELECT e, f, sum(nf * ne * t / z) AS c FROM s{k} GROUP BY ALL), t{k + 1} AS (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS t FROM g{k})"""
    return f"{sql} SELECT e, f, round(t, 6) AS t FROM t{iterations}"


@query(_unrolled(5))
def ibm1_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    return em.ibm1(_em_bitext(spark, sf_dir), 5).select("e", "f", F.round("t", 6).alias("t"))


@query()
def hmm_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _em_bitext(spark, sf_dir)
    table_, jumps = em.hmm(b, em.ibm1(b))
    return em.viterbi_hmm(b, table_, jumps)


@query()
def diagonal_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return em.diagonal(_em_bitext(spark, sf_dir))


@query()
def enrich_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and morphs of the normal lines of line-tagged documents."""
    normal = lines.normal_lines(lines.clean_lines(_raw_lines(spark, sf_dir)))
    tokens = words.words(normal)
    return tokens.select("igt_id", "tier", "idx", "tok").unionByName(words.morphs(tokens).select("igt_id", "tier", "idx", "tok"))
