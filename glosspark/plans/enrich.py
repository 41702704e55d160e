"""The enrichment plan: raw lines to words, morphs, alignments and projected tags.

Layers are lazy; the token, morph and alignment tables, which many layers read, are written once to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.operators import align, features, lines, project, tiers, trees, words
from glosspark.plans import statistical
from glosspark.session import cut, wide

KEYS = ["igt_id"]


def layers(raw: DataFrame) -> dict[str, DataFrame]:
    """The layers that need no alignment of the translation."""
    clean = lines.clean_lines(raw)
    normal = lines.normal_lines(clean)
    tokens = cut(words.words(normal))
    subwords = cut(words.morphs(tokens))
    tier = lambda t, name: t.filter(F.col("tier") == name)
    gaps = words.gaps(tier(subwords, "g"), normal, "G")
    return {
        "clean": clean,
        "normal": normal,
        "token": tokens,
        "morph": subwords,
        "gloss_lang": align.positional(tier(tokens, "gw"), tier(tokens, "w"), KEYS),
        "gloss_morph": align.morph_align(gaps, tier(subwords, "m"), KEYS),
    }


def enrich(raw: DataFrame, tags: DataFrame | None = None, method: str = "heur") -> dict[str, DataFrame]:
    """All layers of ``raw(igt_id, ord, item_id, tag, text)``.

    ``tags(igt_id, idx, label)`` are tags of translation words; they are projected to gloss and language words. Each missing
    input is an absent layer; an instance that lacks a line lacks only what needs it.
    """
    out = layers(raw)
    tokens, subwords, gloss_lang = out["token"], out["morph"], out["gloss_lang"]
    tier = lambda t, name: t.filter(F.col("tier") == name)
    by_morph = align.heuristic(tier(subwords, "g"), tier(tokens, "tw"), KEYS)
    word_of = tier(subwords, "g").select("igt_id", F.col("idx").alias("src"), "word_idx")
    trans_gloss = by_morph.join(wide(word_of), [*KEYS, "src"]).select("igt_id", F.col("tgt").alias("src"), F.col("word_idx").alias("tgt")).distinct()
    out["trans_gloss"] = trans_gloss.withColumn("method", F.lit(method))
    out["trans_lang"] = align.compose(trans_gloss, gloss_lang, KEYS)
    if tags is not None:
        out["gloss_tag"] = project.by_precedence(trans_gloss, tags, KEYS)
        out["lang_tag"] = project.across(gloss_lang, out["gloss_tag"], KEYS)
    return out


def through_glosses(gloss_links: DataFrame, glosses: DataFrame) -> DataFrame:
    """Translation words with gloss words, from links (src gloss, tgt translation word, method) and the word of each gloss."""
    word_of = glosses.select(*KEYS, F.col("idx").alias("src"), "word_idx")
    return gloss_links.join(wide(word_of), [*KEYS, "src"]).select(*KEYS, F.col("tgt").alias("src"), F.col("word_idx").alias("tgt"), "method").distinct()


def unknown_tags(words_of: DataFrame, known: DataFrame, model, posdict: DataFrame | None = None) -> DataFrame:
    """Tags of the words that ``known`` lacks, by a classifier of gloss features: ``(igt_id, idx, label)``."""
    rows = features.gram_features(features.context(words_of.select(*KEYS, "idx", "tok"), KEYS), KEYS, posdict)
    lone = rows.join(wide(known.select(*KEYS, "idx")), [*KEYS, "idx"], "left_anti")
    return features.classify(model, lone).select(*KEYS, "idx", "label")


def projected_tags(trans_gloss: DataFrame, gloss_lang: DataFrame, tags: DataFrame, glosses: DataFrame, unknown: str = "skip", model=None, posdict: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tags of gloss words and of language words.

    ``unknown`` says what becomes of a gloss word without a tag: ``skip``, ``keep`` (the tag UNK), ``noun``, or ``classify`` by ``model``.
    """
    gloss = project.by_precedence(trans_gloss, tags, KEYS)
    if unknown == "classify":
        gloss = cut(gloss.unionByName(unknown_tags(glosses, gloss, model, posdict)))
    elif unknown not in ("skip", "keep", "noun"):
        raise ValueError(f"unknown handling {unknown}: skip, keep, noun or classify")
    return gloss, project.across(gloss_lang, gloss, KEYS, {"keep": "UNK", "noun": "NOUN"}.get(unknown))


def enrich_full(
    raw: DataFrame, aligners: list[str] = ("heur",), symmetrize: str | None = "intersection", augment: bool = False, tags: DataFrame | None = None, unknown: str = "skip", model=None,
    posdict: DataFrame | None = None, phrases: DataFrame | None = None, dependencies: DataFrame | None = None, iterations: int = 5, stored: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All layers, with a choice of aligners and with projected tags and trees.

    ``aligners`` are ``heur`` and those of ``statistical.METHODS``, the preferred first: an instance takes the links of the first that gives
    it any. ``augment`` teaches the statistical ones the heuristic's word pairs too. ``phrases(igt_id, tree)`` and
    ``dependencies(igt_id, edges)`` are parses of translation lines; their tiers and the projected ones are layers as well.
    """
    out = layers(raw)
    out["gloss_lang"] = cut(out["gloss_lang"])  # read by itself, for trans_lang and for tags
    tokens, subwords = out["token"], out["morph"]
    tier = lambda t, name: t.filter(F.col("tier") == name)
    glosses, translation, gloss_words, language = tier(subwords, "g"), tier(tokens, "tw"), tier(tokens, "gw"), tier(tokens, "w")
    found = None
    heuristic = cut(align.heuristic(glosses, translation, KEYS)) if "heur" in aligners or augment else None
    for name in aligners:
        if name == "heur":
            links = heuristic
        else:
            extra = align.word_pairs(heuristic, glosses, translation, KEYS).select("src_tok", "tgt_tok") if augment else None
            links = cut(statistical.aligned(glosses, translation, KEYS, name, symmetrize, extra, iterations, stored if name == "fertility" else None))
        links = links.select(*KEYS, "src", "tgt").withColumn("method", F.lit(name))
        found = links if found is None else found.unionByName(links)
    out["gloss_trans"] = found
    chosen = cut(through_glosses(statistical.preferred(found, list(aligners), KEYS), glosses))
    out["trans_gloss"] = chosen
    out["trans_lang"] = cut(align.compose(chosen, out["gloss_lang"], KEYS))
    if tags is not None:
        out["gloss_tag"], out["lang_tag"] = projected_tags(chosen, out["gloss_lang"], tags, gloss_words, unknown, model, posdict)
    if phrases is not None or dependencies is not None:
        named = lambda t, name: t.select(*KEYS, "idx", "tok", F.concat(F.lit(name), F.col("idx").cast("string")).alias("item_id"))
        own, theirs = named(translation, "tw"), named(language, "w")
        text = theirs.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "tok"))), lambda x: x["tok"]).alias("words"))
        pairs = out["trans_lang"].groupBy(*KEYS).agg(F.sort_array(F.collect_set(F.struct("src", "tgt"))).alias("pairs"))
        target = text.join(wide(pairs), KEYS)
        if phrases is not None:
            out["trans_ps"] = tiers.phrase_items(tiers.parsed(phrases, KEYS), own, KEYS)
            trees_of = trees.project_phrase_table(phrases.join(wide(target), KEYS))
            out["lang_ps"] = tiers.phrase_items(tiers.parsed(cut(trees_of), KEYS), theirs, KEYS)
        if dependencies is not None:
            edges = dependencies.select(*KEYS, F.explode(F.regexp_extract_all("edges", F.lit(r"[\w:.]+\(\S+-\d+, \S+-\d+\)"), 0)).alias("x"))
            edges = edges.select(*KEYS, F.regexp_extract("x", r", \S+-(\d+)\)$", 1).cast("int").alias("dep"), F.regexp_extract("x", r"\(\S+-(\d+), ", 1).cast("int").alias("head"), F.regexp_extract("x", r"^([\w:.]+)\(", 1).alias("type"))
            out["trans_ds"] = tiers.dependency_items(edges, own, KEYS)
            out["lang_ds"] = tiers.dependency_items(cut(trees.project_dependency_table(dependencies.join(wide(target), KEYS))), theirs, KEYS)
    return out
