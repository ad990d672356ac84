"""Keywords and terms of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.functions import lexicons
from colloq.operators.runs import mark_runs


def candidate_words(df: DataFrame, keys: list[str], text: str, patterns: tuple[str, ...] = lexicons.KEYWORD_PATTERNS) -> DataFrame:
    """Each match of each pattern: the keys and ``word``. A null text has none."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for p in patterns]))
    return df.select(*keys, F.explode(found).alias("word"))


def without_words(df: DataFrame, column: str, words: list[str], *, as_written: bool = True) -> DataFrame:
    """Rows whose word is in no list: as it is (if ``as_written``) or in lower case. The list is part of the plan."""
    low = F.lower(F.col(column)).isin(words)
    return df.filter(~(low | F.col(column).isin(words)) if as_written else ~low)


def keyword_score(count: Column, word: Column) -> Column:
    """Occurrences times 1 plus a tenth for each of at most ten characters."""
    return F.round(count * (F.lit(1.0) + F.lit(0.1) * F.least(F.length(word), F.lit(10))), 3)


def top(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group in ``order``, numbered from 1 as ``rank``. A filter on the rank lets
    Spark keep no more than that many rows of a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= max(0, most))


def keyword_counts(df: DataFrame, keys: list[str], text: str, stopwords: list[str] | None = None) -> DataFrame:
    """The keys, ``word``, ``n`` and ``score`` of every keyword of the group's texts.

    Counts are combined before the shuffle. Equal texts count as often as they occur; null texts and texts without a
    candidate give no row.
    """
    stop = lexicons.KEYWORD_STOPWORDS if stopwords is None else stopwords
    words = without_words(candidate_words(df, keys, text), "word", stop)
    counts = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return counts.withColumn("score", keyword_score(F.col("n"), F.col("word")))


def keywords(df: DataFrame, keys: list[str], text: str, most: int = 15, stopwords: list[str] | None = None) -> DataFrame:
    """The ``most`` keywords of each group by score, then word; ``rank`` from 1."""
    return top(keyword_counts(df, keys, text, stopwords), keys, [F.desc("score"), F.asc("word")], most)


def terms(df: DataFrame, keys: list[str], text: str, most: int = 20, extra_stopwords: list[str] | None = None) -> DataFrame:
    """Terms by the keyword rule: the ``most`` keywords, of which words without content are then left out (so fewer may remain)."""
    stop = lexicons.TERM_STOPWORDS + lexicons.FILLERS + [w.strip().lower() for w in extra_stopwords or [] if w.strip()]
    return without_words(keywords(df, keys, text, most), "word", stop, as_written=False)


def compound_terms(tokens: DataFrame, keys: list[str], order: str, most: int = 20, extra_stopwords: list[str] | None = None) -> DataFrame:
    """Terms from tokens (``surface``, ``part_of_speech``, ``base_form``) in ``order`` (a number, unique in the group):
    runs of nouns become one term.

    A noun is a token whose tag begins with the noun tag and whose second tag isn't among those left out. The score is
    the count times 1 plus 0.08 for each of at most 12 characters, times 1.25 where the term's last run had two tokens
    or more. One-character terms and words without content are dropped. Result: the keys, ``word``, ``score``, ``rank``.
    """
    tags = F.split(F.col("part_of_speech"), ",")
    noun = (tags[0] == lexicons.NOUN) & ~F.coalesce(F.get(tags, F.lit(1)), F.lit("")).isin(list(lexicons.NOUN_SUBTYPES_LEFT_OUT))
    base = F.when(F.col("base_form").isNotNull() & ~F.col("base_form").isin("", "*"), F.col("base_form")).otherwise(F.col("surface"))
    rows = tokens.select(*keys, order, F.when(noun, F.lit("n")).otherwise(F.lit("x")).alias("__kind"), base.alias("base"), F.floor(F.col(order) / F.lit(1000)).alias("__stretch"))
    rows = mark_runs(rows, keys, "__stretch", [order], "__kind").filter("__kind = 'n'")
    runs = rows.groupBy(*keys, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "base"))), lambda x: x["base"]), "").alias("word"), F.count("*").alias("tokens"))
    runs = runs.withColumn("word", F.when(F.col("word").rlike(r"^[\x00-\x7f]*$"), F.lower("word")).otherwise(F.col("word"))).filter(F.length("word") > 1)
    stop = lexicons.TERM_STOPWORDS + lexicons.FILLERS + [w.strip().lower() for w in extra_stopwords or [] if w.strip()]
    counts = without_words(runs, "word", stop, as_written=False).groupBy(*keys, "word").agg(F.count("*").alias("n"), F.max_by("tokens", "run").alias("tokens"))
    score = F.col("n") * (F.lit(1.0) + F.least(F.length("word"), F.lit(12)) * F.lit(0.08))
    counts = counts.select(*keys, "word", F.when(F.col("tokens") >= 2, score * 1.25).otherwise(score).alias("score"))
    return top(counts, keys, [F.desc("score"), F.asc("word")], most)
