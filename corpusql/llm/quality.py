"""Quality rules as a short-circuit cascade, all in DataFrame functions.

Every rule is a predicate that rejects a text. Their verdict does not depend on their order,
but their price does: each rule is timed on a sample and its rejections there are counted,
and rules run in order of rejections per second, so that cheap and telling rules spare the
others. One CASE expression stops at the first rule that rejects.
"""

from __future__ import annotations

import statistics
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the rules are timed on; they pass through the driver.
SAMPLE_ROWS = 500
#: Longer texts are judged like all others, but no rule is timed on them; so at most 16 MB pass.
SAMPLE_BYTES = 32_768
#: Copies of the sample that a rule is timed over, and how often.
COPIES = 8
TURNS = 3
#: Seconds below which prices are noise.
LEAST_PRICE = 0.002

_BLANK = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
RUN = 5


def bare(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def words_of(trimmed: Column) -> Column:
    """Words of a text without white space at its ends."""
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"{_BLANK}+")
    )


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: bare(line) != "")


def _from(array: Column, place: int) -> Column:
    return F.slice(array, place, 1 << 30)


# The functions below look at no column from inside a lambda: an optimizer that moves a filter
# on a measure down to the scan then repeats work, but never once for each element.


def run_hashes(words: Column) -> Column:
    """A 64-bit hash of every run of five words: of pairs, of pairs of pairs, and the fifth."""
    mix = lambda a, b: F.xxhash64(a, b)
    twos = F.zip_with(words, _from(words, 2), mix)
    fours = F.zip_with(twos, _from(twos, 3), mix)
    fives = F.zip_with(fours, _from(words, RUN), mix)
    return F.slice(fives, 1, F.greatest(F.size(words) - (RUN - 1), F.lit(0)))


def again(ordered: Column) -> Column:
    """Places, in order, of the hashes that occur twice or more in (hash, place) by hash."""
    pairs = F.zip_with(
        ordered, _from(ordered, 2),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def spread(places: Column) -> Column:
    """Words that runs starting at these (sorted) places cover together."""
    steps = F.zip_with(
        places, _from(places, 2), lambda a, b: F.least(F.coalesce(b - a, F.lit(RUN)), F.lit(RUN))
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, as longs.

    Null texts have no words. Columns of these names are replaced. Sorting happens only in
    texts in which some run of words occurs twice.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.array().cast("array<struct<h:bigint,i:int>>")
    return (
        docs.withColumn("_bare", bare(text))
        .withColumn("_words", words_of(F.col("_bare"))).drop("_bare")
        .withColumn("_lines", lines_of(text))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", n_symbols(text))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", run_hashes(F.col("_words"))).drop("_words", "_lines")
        .withColumn(
            "_ordered",
            F.when(F.size("_hashes") == F.size(F.array_distinct("_hashes")), plain).otherwise(
                F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            ),
        )
        .withColumn("_places", again(F.col("_ordered")))
        .withColumn("n_repeat_words", spread(F.col("_places")))
        .drop("_hashes", "_ordered", "_places")
    )


@dataclass(frozen=True)
class Rule:
    name: str
    #: Rejects a text where it is true; null does not reject.
    rejects: Column


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> list[Rule]:
    """Rules over the measures and the text, on texts that pass the base."""
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    n = F.col("n_words")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("repeated lines", 10 * F.col("n_dup_lines") > 3 * F.size(F.split(text, "\n"))),
        Rule("few letters", 2 * letters < F.col("word_chars")),
        Rule("capitals", 2 * capitals > letters),
    ]


def order_rules(df: DataFrame, candidates: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, measured on at most ``sample_rows`` rows of ``df``.

    Rows that fail the base, if ``df`` says so, take no part: the rules never see them. A rule is
    timed over the rows ``COPIES`` times, in turns with the others and with a rule that does nothing;
    its price is the median of ``TURNS`` times over that of the rule that does nothing.
    """
    sample = df.limit(sample_rows)
    if "base_failed" in df.columns:
        sample = sample.where(~F.col("base_failed"))
    sample = sample.persist()
    idle = Rule("idle", F.lit(None).cast("boolean"))
    times: list[list[float]] = [[] for _ in range(len(candidates) + 1)]
    try:
        counts = sample.select(
            [F.count_if(r.rejects).alias(str(i)) for i, r in enumerate(candidates)]
        ).first()
        # Texts that differ in every copy: nothing worked out for one serves another.
        copies = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).withColumn(
            "text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.col("_copy").cast("string"))
        ).persist()
        copies.count()
        for _ in range(TURNS):
            for spent, rule in zip(times, [*candidates, idle]):
                start = time.perf_counter()
                copies.select(F.count_if(rule.rejects)).first()
                spent.append(time.perf_counter() - start)
        copies.unpersist()
    finally:
        sample.unpersist()
    *prices, nothing = (statistics.median(spent) for spent in times)
    worth = [counts[i] / max(price - nothing, LEAST_PRICE) for i, price in enumerate(prices)]
    order = sorted(range(len(candidates)), key=lambda i: (-worth[i], i))
    return [candidates[i] for i in order]


def cascade(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in ordered:
        out = out.when(rule.rejects, F.lit(rule.name))
    return out


def judged(docs: DataFrame, candidates: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the measures, base_failed, rejected_by (null if kept) and kept.

    Null texts are judged as empty ones, which fail the base; rows that repeat are judged each.
    Columns of the result's names are replaced, all others stay.
    """
    measured = with_measures(docs).withColumn("base_failed", base_failed())
    candidates = rules() if candidates is None else candidates
    # Collecting reads only as many partitions as it needs; a limited table would take its
    # rows from each of them.
    brief = F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES
    texts = docs.select("text").where(brief).limit(SAMPLE_ROWS).collect()
    few = docs.sparkSession.createDataFrame(texts, "text string")
    few = with_measures(few).withColumn("base_failed", base_failed())
    ordered = order_rules(few, candidates)
    base = F.when(F.col("base_failed"), F.lit("base"))
    return measured.withColumn("rejected_by", F.coalesce(base, cascade(ordered))).withColumn(
        "kept", F.col("rejected_by").isNull()
    )


def quality_digests(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


#: DuckDB: the same measures and rules, with runs compared as texts.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), run AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), again AS (
  SELECT r, unnest(range(i, i + 5)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM run)
  WHERE n > 1
), rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM again GROUP BY r),
m AS (
  SELECT doc_id, text, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS capitals
  FROM w LEFT JOIN rep USING (r)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
            OR 2 * letters < word_chars OR 2 * capitals > letters) AS kept
FROM b
"""
