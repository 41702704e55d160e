"""Readers and writers of line-structured corpora: tagged text, CoNLL, bitext, aligner files, instance records.

Readers take files in byte ranges (``split``), so that one large file is many tasks, and put lines and blocks together across ranges;
``whole``, ``blocks`` and ``lines`` are for texts that are in a column already. Nothing reads a file on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.functions import text as T
from glosspark.sources import split


def whole(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """(file, value) of every file under a path."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    if encoding.upper() == "UTF-8":
        return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = raw.option("pathGlobFilter", glob) if glob else raw
    return raw.load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("value"))


def blocks(files: DataFrame, pattern: str = r"\r?\n[ \t]*\r?\n\s*") -> DataFrame:
    """(file, block, text): parts between blank lines, in order."""
    parts = files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"^(?:[ \t]*\r?\n)+|\s+$", ""), pattern)).alias("block", "text"))
    return parts.filter(F.trim("text") != "")


def lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


def read_slashtags(spark: SparkSession, path: str, delimiter: str = "/") -> DataFrame:
    """(file, sent, idx, form, label), a sentence per line; the last delimiter splits a token."""
    rows = split.lines(spark, path).select("file", F.col("line").cast("int").alias("sent"), F.posexplode(T.tagged("text", delimiter)).alias("i", "t"))
    return rows.select("file", "sent", (F.col("i") + 1).alias("idx"), "t.form", "t.label")


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, idx, form, lemma, label, fine, feats, head, deprel); the last sentence needs no blank line behind it."""
    rows = split.blocks(split.lines(spark, path)).select("file", F.col("block").alias("sent"), F.explode(F.split("text", r"\r?\n")).alias("row"))
    c = F.split("row", r"[\t ]+")
    at = lambda i: F.get(c, F.lit(i))
    return rows.filter(F.trim("row") != "").select("file", "sent", at(0).cast("int").alias("idx"), at(1).alias("form"), at(2).alias("lemma"), at(3).alias("label"), at(4).alias("fine"), at(5).alias("feats"), F.try_to_number(at(6), F.lit("999999")).cast("int").alias("head"), at(7).alias("deprel"))


def read_simpletagger(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, idx, form, label, features): features then label on a line, blank line between sentences."""
    rows = split.blocks(split.lines(spark, path)).select("file", F.col("block").alias("sent"), F.posexplode(F.split("text", r"\r?\n")).alias("i", "row"))
    parts = F.split(F.trim("row"), r"\s+")
    rows = rows.select("file", "sent", (F.col("i") + 1).alias("idx"), parts.alias("p"))
    feats = F.slice("p", F.lit(1), F.size("p") - 1)
    word = F.get(F.filter(feats, lambda f: f.startswith("word-")), F.lit(0))
    return rows.select("file", "sent", "idx", F.coalesce(F.substring(word, 6, 1 << 20), F.lit("**NONE**")).alias("form"), F.element_at("p", -1).alias("label"), feats.alias("features"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(file, tree_no, tree): bracketed trees, however many lines they take: a tree ends where its brackets balance."""
    delta = F.length(F.regexp_replace("text", r"[^(]", "")) - F.length(F.regexp_replace("text", r"[^)]", ""))
    rows = split.running(split.lines(spark, path), delta, "open")
    closed = (F.col("open") == 0).cast("int")
    trees = split.running(rows, closed, "tree_no").withColumn("tree_no", F.col("tree_no") - closed)
    trees = trees.filter(F.trim("text") != "").groupBy("file", "tree_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: F.trim(x["text"])), " ").alias("tree"))
    return trees.withColumn("tree", F.regexp_replace("tree", r"^\(\s*(\(.*\))\s*\)$", "$1"))


def read_parallel(spark: SparkSession, src: str, tgt: str, aln: str | None = None) -> DataFrame:
    """(line, src, tgt[, aln]) of parallel files joined on their line number."""
    read = lambda p, name: split.lines(spark, p).select(F.col("line").cast("int").alias("line"), F.col("text").alias(name))
    out = read(src, "src").join(read(tgt, "tgt"), "line")
    out = out.join(read(aln, "aln"), "line") if aln else out
    return out.filter((F.trim("src") != "") | (F.trim("tgt") != ""))


def morph_triples(aln: Column) -> Column:
    """``morph:gloss:tgt[,tgt]`` tokens as (morph, gloss, tgt)."""
    one = F.transform(T.words(aln), lambda t: F.split(t, ":"))
    each = F.transform(one, lambda p: F.transform(F.split(F.get(p, F.lit(2)), ","), lambda x: F.struct(F.get(p, F.lit(0)).cast("int").alias("morph"), F.get(p, F.lit(1)).cast("int").alias("gloss"), x.cast("int").alias("tgt"))))
    return F.flatten(each)


def gold_pairs(aln: Column) -> Column:
    """``(g, t), (g, t), ...`` as (src, tgt)."""
    return F.transform(F.regexp_extract_all(aln, F.lit(r"\((\d+),\s*(\d+)\)"), 0), lambda p: F.struct(F.regexp_extract(p, r"\((\d+)", 1).cast("int").alias("src"), F.regexp_extract(p, r",\s*(\d+)", 1).cast("int").alias("tgt")))


def read_a3(spark: SparkSession, path: str) -> DataFrame:
    """(pair, src, tgt) of aligner output in any number of part files; source 0 is NULL."""
    from glosspark.operators.align import from_a3

    number = F.when(F.col("text").startswith("#"), F.try_to_number(F.regexp_extract("text", r"pair \((\d+)\)", 1), F.lit("999999999")).cast("int"))
    rows = split.running(split.lines(spark, path), number, "pair", "max")
    return rows.filter(F.contains("text", F.lit("({"))).select("pair", F.explode(from_a3(F.col("text"))).alias("p")).select("pair", "p.src", "p.tgt")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, tok, n) of ``id word count`` lines."""
    p = F.split("value", " ")
    return spark.read.text(path).select(F.get(p, F.lit(0)).cast("int").alias("id"), F.get(p, F.lit(1)).alias("tok"), F.get(p, F.lit(2)).cast("bigint").alias("n"))


def read_tag_map(spark: SparkSession, path: str) -> DataFrame:
    """(fine, coarse) of two white-space separated columns."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(p, F.lit(0)).alias("fine"), F.get(p, F.lit(1)).alias("coarse"))


def read_prototypes(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t")
    return spark.read.text(path).select(F.get(p, F.lit(0)).alias("tag"), F.explode(F.slice(p, F.lit(2), F.size(p))).alias("word"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Plain instances: blocks of 3 lines (L, G, T) or 4 (native script first); others come back with a null tag. (igt_id, ord, tag, text)."""
    rows = split.blocks(split.lines(spark, path))
    p = F.split("text", r"\r?\n")
    tags = F.when(F.size(p) == 3, F.array(*map(F.lit, ("L", "G", "T")))).when(F.size(p) == 4, F.array(*map(F.lit, ("L+FR", "L", "G", "T"))))
    rows = rows.select(F.concat_ws(":", "file", "block").alias("igt_id"), F.posexplode(p).alias("i", "text"), tags.alias("tags"))
    return rows.select("igt_id", (F.col("i") + 1).alias("ord"), F.get("tags", F.col("i")).alias("tag"), "text")


def parse_records(texts: DataFrame) -> DataFrame:
    """Instance records in ``texts(value)``: ``doc_id=D start stop tags`` and ``line=N tag=T:text`` lines, ended by a blank line.

    (igt_id, doc_id, start, stop, lang, ord, line_no, tag, text).
    """
    rec = texts.select(F.explode(F.split(F.regexp_replace("value", r"\r\n", "\n"), r"\n\s*\n")).alias("rec")).filter(F.contains("rec", F.lit("doc_id=")))
    head = r"doc_id=(\S+)\s(\d+)\s(\d+)\s?(.*)"
    line = F.lit(r"line=(\d+)\stag=([^:\s]+):([^\n]*)")
    parts = F.arrays_zip(F.regexp_extract_all("rec", line, 1).alias("n"), F.regexp_extract_all("rec", line, 2).alias("t"), F.regexp_extract_all("rec", line, 3).alias("x"))
    lang = F.coalesce(F.nullif(F.regexp_extract("rec", r"gold_lang_code:?\s*(\S+)", 1), F.lit("")), F.nullif(F.regexp_extract("rec", r"stage3_lang_chosen:?\s*.*\((\S+)\)", 1), F.lit("")))
    out = rec.select(F.regexp_extract("rec", head, 1).alias("doc_id"), F.regexp_extract("rec", head, 2).cast("int").alias("start"), F.regexp_extract("rec", head, 3).cast("int").alias("stop"), lang.alias("lang"), F.posexplode(parts).alias("i", "p"))
    return out.select(F.concat_ws("-", F.col("doc_id"), F.col("start").cast("string"), F.col("stop").cast("string")).alias("igt_id"), "doc_id", "start", "stop", "lang", (F.col("i") + 1).alias("ord"), F.col("p.n").cast("int").alias("line_no"), F.col("p.t").alias("tag"), F.col("p.x").alias("text"))


def read_records(spark: SparkSession, path: str, lang: str | None = None, limit: int | None = None, encoding: str = "ISO-8859-1", glob: str | None = None) -> DataFrame:
    """Records of every file below ``path``, of one language if given, at most ``limit`` of them in id order."""
    rows = parse_records(split.blocks(split.lines(spark, path, encoding, glob)).select(F.col("text").alias("value")))
    rows = rows.filter(F.col("lang") == lang) if lang else rows
    if limit is not None:
        rows = rows.join(rows.select("igt_id").distinct().orderBy("igt_id").limit(limit), "igt_id", "left_semi")
    return rows


def sentence_lines(tokens: DataFrame, keys: list[str], form: Column) -> DataFrame:
    """One line per sentence from tokens (``idx``)."""
    return tokens.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("idx"), form.alias("x")))), lambda t: t["x"]), " ").alias("value"))


def write_slashtags(tokens: DataFrame, path: str, keys: list[str], delimiter: str = "/", lowercase: bool = False) -> None:
    form = F.lower("form") if lowercase else F.col("form")
    sentence_lines(tokens, keys, F.concat(form, F.lit(delimiter), F.col("label"))).select("value").write.text(path)


def write_raw(tokens: DataFrame, path: str, keys: list[str]) -> None:
    sentence_lines(tokens, keys, F.col("form")).select("value").write.text(path)


def write_tag_lines(tokens: DataFrame, path: str, keys: list[str]) -> None:
    """``word TAG`` per line, a blank line behind each sentence."""
    rows = tokens.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "form", "label"))), lambda t: F.concat_ws(" ", t["form"], t["label"])), "\n"), F.lit("\n")).alias("value"))
    rows.select("value").write.text(path)


def record_lines(records: DataFrame) -> DataFrame:
    """Record text of ``(doc_id, start, stop, ord, line_no, tag, text)``: a header with all tags, then a line each, ended by a blank line."""
    one = records.groupBy("doc_id", "start", "stop").agg(F.sort_array(F.collect_list(F.struct("ord", "line_no", "tag", "text"))).alias("l"))
    head = F.format_string("doc_id=%s %d %d %s", F.col("doc_id").cast("string"), "start", "stop", F.array_join(F.transform("l", lambda x: x["tag"]), " "))
    rows = F.transform("l", lambda x: F.format_string("line=%d tag=%s:%s", x["line_no"], x["tag"], x["text"]))
    return one.select("doc_id", "start", "stop", F.concat(head, F.lit("\n"), F.array_join(rows, "\n"), F.lit("\n")).alias("value"))


def conll_lines(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Ten-column sentences from ``(key.., dep, head, type, word)``: one row a word, the smallest head of several, ``root`` under 0."""
    one = edges.groupBy(*keys, "dep").agg(F.min_by(F.struct("head", "type", "word"), "head").alias("e"))
    row = F.concat_ws("\t", F.col("dep").cast("string"), F.col("e.word"), *(F.lit("_"),) * 4, F.col("e.head").cast("string"), F.when(F.col("e.head") == 0, "root").otherwise(F.coalesce(F.nullif(F.col("e.type"), F.lit("")), F.lit("_"))), F.lit("_"), F.lit("_"))
    return one.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dep", row.alias("r")))), lambda t: t["r"]), "\n"), F.lit("\n")).alias("value"))


def stanford_lines(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``type(head-i, dep-j)`` per edge."""
    words = edges.select(*keys, F.col("dep").alias("head"), F.col("word").alias("head_word")).distinct()
    j = edges.join(words, [*keys, "head"], "left")
    return j.select(*keys, "dep", F.format_string("%s(%s-%d, %s-%d)", F.coalesce(F.nullif("type", F.lit("")), F.lit("dep")), F.coalesce("head_word", F.lit("ROOT")), F.col("head"), F.col("word"), F.col("dep")).alias("value"))


def coded_pairs(src: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """Integer-coded sentence pairs of tokens with vocabulary ids: three lines a pair (count, source ids, target ids)."""
    ids = lambda t, name: sentence_lines(t, keys, F.col("id").cast("string")).withColumnRenamed("value", name)
    return ids(src, "s").join(ids(tgt, "t"), keys).select(*keys, F.concat_ws("\n", F.lit("1"), "s", "t").alias("value"))


def bitext(src: DataFrame, tgt: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """(ord, e, f) lines for an aligner: sentence pairs in key order, then the word pairs ``extra(e, f)``."""
    text = lambda t, name: sentence_lines(t, keys, F.lower("tok")).withColumnRenamed("value", name)
    main = text(src, "e").join(text(tgt, "f"), keys).select(F.lit(0).alias("part"), F.concat_ws(":", *keys).alias("key"), "e", "f")
    return main.unionByName(extra.select(F.lit(1).alias("part"), F.concat_ws(":", "e", "f").alias("key"), "e", "f"))
