"""Phrase collocations by set-oriented mining over occurrence relations.

The relation of length k says which phrase of k words starts at which place of which piece. It
is kept sorted by piece and place, in lots of about ``LOT`` words of one language: a lot is one
row with the phrase numbers of its places in order (a mark between pieces) and a dictionary of
the phrases it holds with their counts. The step from k to k + 1 is

* group-count: the dictionaries of all lots are added up, phrase by phrase;
* semi-join: phrases below the support leave the relation. A lot gets back which entries of its
  dictionary are frequent, so what is shuffled are distinct phrases of lots, not occurrences;
* merge-join: the sorted relation meets itself at the next place of the same piece. Two
  frequent phrases of k words that overlap in k - 1 give an occurrence of k + 1 words.

Each relation is a table in the shared folder, and the one before it is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import discard, work_table

SUPPORT = 10
LENGTH = 3
LIMIT = 2000
#: A candidate goes if a longer one that holds it has this share of its occurrences, in percent.
ABSORBED = 50
SCALE = 1_000_000
UNKNOWN = "und"
#: Words of one language that a lot holds before it is closed (at the end of a text).
LOT = 2_000_000

#: What ends a piece; each becomes the first of them, which so can be no part of a word.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + bytes(range(65, 91)), _ENDS[:1] * len(_ENDS) + bytes(range(97, 123)))
_END = _ENDS[:1]

_LOTS = "lot long, lang string, size long, total long, places binary, words array<string>, counts array<long>"
_LONGER = "lot long, lang string, size long, places binary, lefts array<long>, rights array<long>, counts array<long>"


def _shut(places: np.ndarray) -> bytes:
    return pa.compress(places.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _opened(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * size, codec="zstd", asbytes=True), "<i4")


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The relation of single words, from (lang, text)."""
    schema = pa.schema([
        ("lot", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("total", pa.int64()),
        ("places", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
    ])
    lot = TaskContext.get().partitionId() << 32
    held: dict[str, tuple[dict[bytes, int], list[int]]] = {}
    size = 0

    def shut() -> Iterator[pa.RecordBatch]:
        nonlocal lot, size
        for lang, (known, places) in held.items():
            at = np.array(places, "i4")
            counts = np.bincount(at, minlength=len(known))
            counts[0] = 0  # the mark between pieces
            row = [[lot], [lang], [len(at)], [int(counts.sum())], [_shut(at)],
                   [[w.decode() for w in known]], [counts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)
            lot += 1
        held.clear()
        size = 0

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            known, places = held.setdefault(UNKNOWN if lang is None else lang, ({_END: 0}, []))
            number = known.setdefault
            before = len(places)
            words = (text.as_py() or b"").translate(_TABLE).replace(_END, b" . ").split()
            places += [number(w, len(known)) for w in words]
            places.append(0)
            size += len(places) - before
            if size >= LOT:
                yield from shut()
    yield from shut()


def _extended(keep: bool) -> Callable:
    """The relation of phrases one word longer, from (lot, lang, size, places, numbers, ids).

    ``numbers`` are the frequent entries of the lot's dictionary and ``ids`` their phrases. The
    last relation is only counted: its places are not kept.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, lang, size, places, numbers, ids in zip(*batch.columns):
                at = _opened(places.as_py(), size.as_py())
                numbers, ids = numbers.values.to_numpy(), ids.values.to_numpy()
                place_of = np.full(max(at.max(initial=0), numbers.max(initial=0)) + 1, -1, "i8")
                place_of[numbers] = np.arange(len(numbers))
                kept = place_of[at]  # -1: the mark, and what is not frequent
                both = (kept[:-1] >= 0) & (kept[1:] >= 0)
                found, number, counts = np.unique(
                    (kept[:-1] << 32 | kept[1:])[both], return_inverse=True, return_counts=True
                )
                now = np.zeros(len(kept) if keep else 0, "i4")
                if keep:
                    now[:-1][both] = number + 1
                row = [
                    [lot.as_py()], [lang.as_py()], [len(now)], [_shut(now)], [ids[found >> 32]],
                    [ids[found & 0xFFFFFFFF]], [counts],
                ]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(row, kinds)],
                    ["lot", "lang", "size", "places", "lefts", "rights", "counts"],
                )

    return job


def _entries(relation: DataFrame, keys: list[str], first: int) -> DataFrame:
    """The dictionaries of a relation, an entry a row; ``number`` is how the places name it."""
    zipped = F.arrays_zip(*(F.col(k) for k in keys), "counts")
    lang = ["lang"] if keys == ["words"] else []  # ids of phrases imply their language
    return relation.select("lot", *lang, F.posexplode(zipped).alias("at", "e")).select(
        "lot", *lang, (F.col("at") + first).alias("number"),
        *(F.col(f"e.{k}").alias(k[:-1]) for k in keys), F.col("e.counts").alias("n"),
    ).where("n > 0")


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, length: int = LENGTH
) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1 to ``length`` words, a table for each length, and words by language.

    Phrases: id, lang, phrase, last (its last word), f, heads and tails (counts of the first
    1, 2, ... words and of what follows them), and for two words and more left and right (the
    ids of the phrases one word shorter). The second result has lang and n.
    """
    source = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    relation = work_table(source.mapInArrow(_lots, _LOTS), "occurrences")
    totals = work_table(relation.groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    keys, first, found = ["words"], 0, []
    for k in range(1, length + 1):
        own = [*(["lang"] if k == 1 else []), *(key[:-1] for key in keys)]
        entries = _entries(relation, keys, first)
        if k == length:
            counted = entries.groupBy(*own).agg(F.sum("n").alias("f")).where(F.col("f") >= support)
            phrases = counted.withColumn("id", F.monotonically_increasing_id())
            found.append(_named(phrases, found[-1] if found else None))
            break
        # One exchange counts phrases, numbers them (a phrase is known by its first entry) and
        # says which entries of which lot stay.
        same = Window.partitionBy(*own)
        kept = work_table(
            entries.withColumn("entry", F.monotonically_increasing_id())
            .withColumn("f", F.sum("n").over(same)).withColumn("id", F.min("entry").over(same))
            .where(F.col("f") >= support).drop("n"), "frequent",
        )
        found.append(_named(kept.where("entry = id").select("id", *own, "f"), found[-1] if found else None))
        mine = kept.groupBy("lot").agg(F.collect_list(F.struct("number", "id")).alias("kept"))
        longer = work_table(
            relation.select("lot", "lang", "size", "places").join(mine, "lot")
            .select("lot", "lang", "size", "places", "kept.number", "kept.id")
            .mapInArrow(_extended(k + 1 < length), _LONGER), "occurrences",
        )
        discard(relation, kept)
        relation, keys, first = longer, ["lefts", "rights"], 1
    discard(relation)
    return found, totals


def _named(phrases: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """Words, heads and tails of phrases, from those of the phrases one word shorter."""
    if shorter is None:
        none = F.array().cast("array<long>")
        named = phrases.select(
            "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
            none.alias("heads"), none.alias("tails"),
        )
    else:
        side = lambda name: shorter.select(
            F.col("id").alias(name),
            *(F.col(c).alias(f"{name}_{c}") for c in ("lang", "phrase", "last", "f", "heads", "tails")),
        )
        named = phrases.join(side("left"), "left").join(side("right"), "right").select(
            "id", F.col("left_lang").alias("lang"), F.concat("left_phrase", F.lit(" "), "right_last").alias("phrase"),
            F.col("right_last").alias("last"), "f",
            F.concat("left_heads", F.array("left_f")).alias("heads"),
            F.concat(F.array("right_f"), "right_tails").alias("tails"), "left", "right",
        )
    return work_table(named, "phrases")


def collocations(
    docs: DataFrame, support: int = SUPPORT, length: int = LENGTH, absorbed: int = ABSORBED
) -> DataFrame:
    """All phrases of 2 to ``length`` words that no longer one absorbs: lang, phrase, a, l, r, score.

    Texts are cut into pieces and words as the query's contract says (A-Z small, pieces end at
    ``. , ; : ! ?`` and line ends, words at blanks and tabs). Null texts have no words, a null
    lang is ``und``, repeated rows count again, an empty table gives no rows; only lang and text
    are read. Scores are exact: products are decimals of 38 digits.
    """
    found, _ = frequent_phrases(docs, support, length)
    return _scored(found, absorbed)


def _scored(found: list[DataFrame], absorbed: int) -> DataFrame:
    out = None
    for k, phrases in enumerate(found[1:], 1):
        if k + 1 < len(found):
            # Frequent phrases inside longer ones: what is one word longer decides, as every
            # phrase between the two occurs at least as often as the longer one.
            longer = found[k + 1].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("longest"))
            longer = longer.groupBy("id").agg(F.max("longest").alias("longest"))
            phrases = phrases.join(longer, "id", "left").where(
                F.col("longest").isNull() | (100 * F.col("longest") < absorbed * F.col("f"))
            )
        cuts = F.expr(
            f"array_min(transform(arrays_zip(heads, tails), (x, i) -> struct("
            f"(cast({SCALE} as decimal(38, 0)) * f * f) div (cast(x.heads as decimal(38, 0)) * x.tails) as score,"
            f" i as i, x.heads as l, x.tails as r)))"
        )
        rows = phrases.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("cut")).select(
            "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
        )
        out = rows if out is None else out.union(rows)
    return out


def best_collocations(docs: DataFrame, limit: int = LIMIT, **options) -> DataFrame:
    """The ``limit`` best of each language: lang, rank, phrase, a, l, r, n, score.

    By score and occurrences, largest first, then by the phrase's bytes. Each task hands on
    ``limit`` rows of a language at most.
    """
    options = {"support": SUPPORT, "length": LENGTH, "absorbed": ABSORBED} | options
    found, totals = frequent_phrases(docs, options["support"], options["length"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = _scored(found, options["absorbed"]).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = (
        rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
        .where(F.col("rank") <= limit)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .where(F.col("rank") <= limit)
    )
    return few.join(totals, "lang").select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"
    )


#: The same rows in SQL.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS doc, COALESCE(lang, 'und') AS lang,
         regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?\x0A-\x0D]') AS parts
  FROM documents
), cut AS (
  SELECT lang, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda x: x <> '') AS words
  FROM (SELECT lang, unnest(parts) AS part FROM pieces)
), runs AS (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS pos
  FROM cut, (SELECT unnest([1, 2, 3]) AS k) WHERE len(words) >= k
), counted AS (
  SELECT lang, k, array_to_string(words[pos : pos + k - 1], ' ') AS phrase, COUNT(*) AS f
  FROM runs GROUP BY 1, 2, 3
), total AS (
  SELECT lang, SUM(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY 1
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f FROM counted WHERE f >= 10 AND k > 1
), inside AS (
  SELECT lang, f, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase
  FROM candidates WHERE k = 3
), longest AS (
  SELECT lang, phrase, MAX(f) AS longer FROM inside GROUP BY 1, 2
), cuts AS (
  SELECT c.lang, c.phrase, c.f, array_to_string(words[1:i], ' ') AS head, array_to_string(words[i + 1 : k], ' ') AS tail, i
  FROM candidates c, (SELECT unnest([1, 2]) AS i) LEFT JOIN longest l ON l.lang = c.lang AND l.phrase = c.phrase
  WHERE i < k AND (longer IS NULL OR 100 * longer < 50 * c.f)
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, i,
         (1000000::HUGEINT * c.f * c.f) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail
), chosen AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM chosen JOIN total USING (lang)
QUALIFY rank <= 2000
"""

__all__ = ["best_collocations", "collocations", "frequent_phrases"]
