"""Terminology: matching in text, languages, conflicts, votes, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import text as T

#: Term tables up to this many rows are broadcast to the texts; larger ones are shuffled.
BROADCAST_TERMS = 20_000
_RUN = r"([\p{IsLatin}\p{N}_]+)"


def _runs(col: Column) -> Column:
    """Whole runs of Latin letters, digits and underscores, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(_RUN), 1))


def _bigrams(col: Column) -> Column:
    """Pairs of neighbouring characters, in lower case."""
    return F.array_distinct(T.ngrams(T.characters(F.lower(col)), 2, ""))


def match_terms(texts: DataFrame, terms: DataFrame, id_cols: list[str], text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id_cols, source and terms' other columns: each term that occurs in each text, once.

    Ends that are Latin letters, digits or underscores need a word boundary, others do not; case does not count; style tags
    and formula placeholders are out of the way first. Every run of such characters inside a term is a whole run in a text
    that holds the term, so texts and terms meet on the term's longest run; terms without a run meet on their first pair of
    characters, or their only character. A term that is one run needs no more; the others are checked at their boundaries.
    Terms are broadcast up to BROADCAST_TERMS rows, else both sides are shuffled by the key, texts only for terms of several runs.
    Rows of texts that are the same each have their terms; terms that are the same count as one in the shuffled form.
    """
    longest = lambda a: F.get(F.array_sort(a, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)), F.lit(0))
    spec = terms.withColumn("__term", F.lower(T.glossary_text(F.col(source_col)))).where(F.col("__term") != "")
    spec = spec.withColumn("__runs", _runs(F.col("__term")))
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    body = texts.select(*id_cols, T.glossary_text(F.col(text_col)).alias("__text"))
    kinds = [(spec.where("size(__runs) > 0").withColumn("__key", longest(F.col("__runs"))), _runs(F.col("__text")))]
    bare = spec.where("size(__runs) = 0")
    if not bare.where("length(__term) > 1").isEmpty():
        kinds.append((bare.where("length(__term) > 1").withColumn("__key", F.substring("__term", 1, 2)), _bigrams(F.col("__text"))))
    if not bare.where("length(__term) = 1").isEmpty():
        kinds.append((bare.where("length(__term) = 1").withColumn("__key", F.col("__term")), F.array_distinct(T.characters(F.lower("__text")))))
    word = r"[\p{IsLatin}\p{N}_]"
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("__term"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.when(F.col("__term").rlike(f"^{word}"), f"(?<!{word})").otherwise(""), quoted, F.when(F.col("__term").rlike(f"{word}$"), f"(?!{word})").otherwise(""))
    rest = [c for c in terms.columns if c not in id_cols]
    inside = F.contains(F.lower("__text"), F.col("__term")) & F.regexp_like(F.lower("__text"), pattern)
    out = None
    for known, keys in kinds:
        known = known.select(*rest, "__term", "__key")
        alone = F.col("__term") == F.col("__key")
        if small:  # one pass over the texts, which are never copied
            hit = body.select(*id_cols, "__text", F.explode(keys).alias("__key")).join(F.broadcast(known), "__key").where(alone | inside).select(*id_cols, *rest)
        else:  # only ids and keys are shuffled; the texts come back for the few terms that need more than their key
            told = body.select(*id_cols, F.xxhash64("__text").alias("__hash"), F.explode(keys).alias("__key"))
            met = told.join(known, "__key")
            asked = met.where(~alone).select(*(F.col(c).alias(f"__id_{c}") for c in id_cols), F.col("__hash").alias("__asked"), *rest, "__term").distinct()
            same = F.xxhash64("__text") == F.col("__asked")
            for c in id_cols:
                same = same & F.col(c).eqNullSafe(F.col(f"__id_{c}"))
            hit = met.where(alone).select(*id_cols, *rest).unionByName(body.join(asked, same).where(inside).select(*id_cols, *rest))
        out = hit if out is None else out.unionByName(hit)
    return out


def normalize_terms(terms: DataFrame, *more: str) -> DataFrame:
    """Terms with trimmed sides and the keys of their identity; blank sides are no terms. seq keeps the order of rows."""
    out = terms.select(F.trim("source").alias("source"), F.trim("target").alias("target"), T.lang_key(F.coalesce("tgt_lng", F.lit(""))).alias("tgt_lng"), "seq", *more)
    return out.where("source <> '' and target <> ''").withColumn("term_key", T.term_key(F.col("source")))


def terms_for_language(terms: DataFrame, lang: str) -> DataFrame:
    """Terms of the language or of none; of one term, the language's own wins, then the first. Longest first is order_terms."""
    wanted = T.lang_key(F.lit(lang))
    own = normalize_terms(terms).where((F.col("tgt_lng") == "") | (F.col("tgt_lng") == wanted))
    nth = F.row_number().over(Window.partitionBy("term_key").orderBy((F.col("tgt_lng") == "").cast("int"), "seq"))
    return own.withColumn("nth", nth).where("nth = 1").drop("nth")


def order_terms(terms: DataFrame, source: str = "source") -> DataFrame:
    return terms.orderBy(F.length(source).desc(), F.lower(source))


def term_conflicts(terms: DataFrame) -> DataFrame:
    """(term_key, tgt_lng, targets, rows): terms that one language has with more than one target. Repeats are none."""
    keyed = normalize_terms(terms).groupBy("term_key", "tgt_lng", "target").agg(F.min("seq").alias("seq"))
    grouped = keyed.groupBy("term_key", "tgt_lng").agg(F.array_sort(F.collect_list(F.struct("seq", "target"))).alias("found"))
    return grouped.where(F.size("found") > 1).select("term_key", "tgt_lng", F.col("found.target").alias("targets"), F.col("found.seq").alias("rows"))


def merge_term_sources(manual: DataFrame, auto: DataFrame) -> DataFrame:
    """All manual terms, and automatic ones that no manual term names."""
    keyed = lambda df: df.withColumn("term_key", T.term_key(F.col("source")))
    return keyed(manual).unionByName(keyed(auto).join(keyed(manual).select("term_key").distinct(), "term_key", "left_anti"), allowMissingColumns=True)


def vote_targets(pairs: DataFrame, source: str = "source", target: str = "target", seq: str = "seq") -> DataFrame:
    """(source, target, votes): per source its most frequent target, the first seen of several."""
    counted = pairs.groupBy(source, target).agg(F.count("*").alias("votes"), F.min(seq).alias("first"))
    return counted.groupBy(source).agg(F.max_by(target, F.struct("votes", -F.col("first"))).alias(target), F.max("votes").alias("votes"))


def build_ranked_dictionary(words: DataFrame, limit: int = 50_000) -> DataFrame:
    """(word, rank, translation): usable headwords by the better of their two ranks, one per word whatever its case.

    words: word, translation, bnc, frq. A rank counts if positive.
    """
    positive = lambda c: F.when(F.col(c).cast("long") > 0, F.col(c).cast("long"))
    ranked = words.withColumn("rank", F.least(positive("bnc"), positive("frq"))).where(F.col("rank").isNotNull() & F.col("word").rlike(r"^[A-Za-z][A-Za-z' -]*$") & (F.trim("translation") != ""))
    best = ranked.groupBy(F.lower("word").alias("key")).agg(F.min_by(F.struct("word", "translation", "rank"), F.struct("rank", "word")).alias("e"))
    return best.select("e.word", "e.rank", "e.translation").orderBy("rank", "word").limit(limit)


def lookup_dictionary(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """words with the entry of the first candidate that the dictionary has (entry_word, position); null without one.

    Up to three words and 100 characters are looked up. dictionary: entry_word and others, entry_word unique in lower case.
    """
    asked = words.select(word).distinct().where((F.length(word) <= 100) & (T.word_count(F.col(word)).between(1, 3)))
    tried = asked.select(word, F.posexplode(T.word_candidates(F.col(word))).alias("position", "candidate"))
    known = dictionary.withColumn("candidate", F.lower("entry_word"))
    best = tried.join(known, "candidate").groupBy(word).agg(F.min_by(F.struct("entry_word", "position"), "position").alias("e"))
    return words.join(best.select(word, "e.entry_word", "e.position"), word, "left")


def source_counts(terms: DataFrame) -> DataFrame:
    """Per term of merged packs: which sources have it, how many rows, and whether their targets agree."""
    return terms.groupBy(T.term_key(F.col("source")).alias("term_key")).agg(
        F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.count("*").alias("entries"), F.count_distinct("target").alias("targets"), (F.count_distinct("target") > 1).alias("conflict")
    )


def pack_status(catalog: DataFrame, installed: DataFrame) -> DataFrame:
    """(id, status, versions): per pack of the catalog whether its newest version is installed; versions newest first."""
    newest = catalog.select("id", "version", F.transform(F.split("version", r"\."), lambda x: x.cast("int")).alias("parts"))
    listed = newest.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("parts", "version")), False), lambda x: x["version"]).alias("versions"))
    have = installed.groupBy("id").agg(F.array_sort(F.collect_set("version")).alias("installed"))
    status = F.when(F.array_contains("installed", F.col("versions")[0]), "installed").when(F.size("installed") > 0, "update_available").otherwise("not_downloaded")
    return listed.join(have, "id", "left").select("id", status.alias("status"), "versions")
