"""Line dedup by a log-template tree.

Parsing has fixed depth: a line goes by its number of words and then by its leading words
(words with a digit are variable fields from the start), which names a leaf. In a leaf, a
line joins the template it agrees with most if enough words agree place by place, and places
that differ become variable; otherwise it opens a template. Templates that recur in many
documents are dropped from all documents but the one of smallest id.

A template cannot recur more than its leaf, so leaves are counted first, by partial sums, and
only distinct lines of frequent leaves are parsed. A leaf with many distinct lines is parsed
in blocks of about ``BLOCK_LINES``, and then the blocks' templates are parsed once more
together. A template of which hardly a word is constant says nothing: its lines are compared
as they stand, digits and all. So are lines of a few words, where a variable place would be
most of the line; each of them is a leaf of its own. Repeats of a line are folded before they meet, so a line in a third of all
documents is one line to its leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.llm.common import written

DEPTH = 3
SIMILARITY = 0.7
MIN_DOCS = 10
#: Lines of fewer words have no variable places.
MIN_WORDS = 5
#: A template drops lines only if this share of its words is constant. Lines that agree word by
#: word never fall below it (``SIMILARITY`` with variable places at one half), masked ones do.
CONSTANT = 0.4
BLOCK_LINES = 2_000
VARIABLE = "<*>"
DIGITS = frozenset("0123456789")


def masked(line: str) -> list[str]:
    """Words of a line, those with a digit made variable."""
    words = line.split()
    if DIGITS.isdisjoint(line):
        return words
    return [w if DIGITS.isdisjoint(w) else VARIABLE for w in words]


def _sign(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def keys(words: list[str]) -> tuple[int, int]:
    """Hashes of the leaf and of the masked line."""
    lead = " ".join([str(len(words)), *words[:DEPTH]])
    return _sign(lead), _sign(" ".join(words))


def judged(line: str, min_words: int) -> tuple[list[str], int, int, int] | None:
    """Words, leaf, key and key as it stands of a line; None for what has no word.

    Short lines are words as they stand; they need a letter, so that rules, braces and
    single numbers stay.
    """
    words = line.split()
    if not words:
        return None
    raw = _sign(" ".join(words))
    if len(words) < min_words:
        if not any(c.isalpha() for c in line):
            return None
        return words, raw, raw, raw
    words = masked(line)
    return words, *keys(words), raw


def _line_rows(min_words: int) -> Callable:
    """(leaf, line, raw, doc) once for each document, and whether leaf and line are new there."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                leaves: set[int] = set()
                lines: set[int] = set()
                raws: set[int] = set()
                for line in set((text.as_py() or "").split("\n")):
                    if (found := judged(line, min_words)) and found[3] not in raws:
                        _, leaf, key, raw = found
                        rows.append((leaf, key, raw, doc, int(leaf not in leaves), int(key not in lines)))
                        leaves.add(leaf)
                        lines.add(key)
                        raws.add(raw)
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["leaf", "line", "raw", "doc", "opens", "fresh"]
            )

    return job


def _wanted_lines(min_words: int) -> Callable:
    """Masked texts of the lines asked for, from the documents they are asked of."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, wanted in zip(batch.column("text"), batch.column("_wanted")):
                if wanted.is_valid:
                    left = set(wanted.values.to_pylist())
                    for line in (text.as_py() or "").split("\n"):
                        if (parts := judged(line, min_words)) and parts[2] in left:
                            left.discard(parts[2])
                            found.append((parts[2], " ".join(parts[0])))
            columns = list(zip(*found)) if found else [[], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["line", "words"]
            )

    return job


def parse(lines: list[list[str]], similarity: float) -> tuple[list[int], list[list[str]]]:
    """The template of each line, in order, and the templates; all lines have one length."""
    codes: dict[str, int] = {VARIABLE: -1}
    rows = [np.array([codes.setdefault(w, len(codes)) for w in line]) for line in lines]
    heads = np.zeros((16, len(rows[0]) if rows else 0), "i8")
    count, member = 0, []
    for row in rows:
        best = -1
        if count:
            same = ((heads[:count] == row) & (row >= 0)).sum(axis=1)
            # A variable place agrees with anything, half as well as a word.
            score = (same + 0.5 * ((heads[:count] < 0) | (row < 0)).sum(axis=1)) / len(row)
            at = int(np.argmax(score))
            if score[at] >= similarity:
                best = at
        if best < 0:
            if count == len(heads):
                heads = np.concatenate([heads, np.zeros_like(heads)])
            heads[count] = row
            best, count = count, count + 1
        else:
            heads[best][heads[best] != row] = -1
        member.append(best)
    words = {i: w for w, i in codes.items()}
    return member, [[words[i] for i in head] for head in heads[:count].tolist()]


def _parse_group(similarity: float) -> Callable:
    def job(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["docs", "line"], ascending=[False, True])
        member, heads = parse([w.split(" ") for w in rows["words"]], similarity)
        names = [" ".join(h) for h in heads]
        return pd.DataFrame({
            "leaf": rows["leaf"], "line": rows["line"], "docs": rows["docs"],
            "template": [names[m] for m in member],
        })

    return job


def templates(
    docs: DataFrame, by_doc: DataFrame, min_docs: int, min_words: int, similarity: float
) -> tuple[DataFrame, DataFrame]:
    """Lines (line, raw, doc) of frequent leaves, and the template of each such line.

    ``constant`` says whether enough of the template's words are.
    """
    rows = written(
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_line_rows(min_words), "leaf long, line long, raw long, doc long, opens long, fresh long"),
        "lines",
    )
    frequent = rows.groupBy("leaf").agg(F.sum("opens").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    lines = rows.join(frequent, "leaf", "left_semi")
    distinct = written(
        lines.groupBy("leaf", "line").agg(F.sum("fresh").alias("docs"), F.min("doc").alias("source")), "distinct"
    )
    wanted = distinct.groupBy("source").agg(F.collect_list("line").alias("_wanted"))
    texts = (
        by_doc.join(wanted.withColumnRenamed("source", "_doc").hint("shuffle_hash"), "_doc", "left")
        .mapInArrow(_wanted_lines(min_words), "line long, words string").dropDuplicates(["line"])
    )
    sizes = distinct.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_LINES).alias("blocks"))
    placed = distinct.join(texts, "line").join(sizes, "leaf").withColumn(
        "block", F.pmod(F.xxhash64("line"), F.col("blocks"))
    )
    kind = "leaf long, line long, docs long, template string"
    first = written(
        placed.select("leaf", "block", "line", "docs", "words", "blocks").groupBy("leaf", "block")
        .applyInPandas(_parse_group(similarity), kind), "templates",
    )
    # Blocks of one leaf may have opened the same template; parse the templates once more.
    heads = first.groupBy("leaf", "template").agg(F.sum("docs").alias("docs")).select(
        "leaf", F.xxhash64("template").alias("line"), "docs", F.col("template").alias("words")
    )
    merged = heads.groupBy("leaf").applyInPandas(_parse_group(similarity), kind)
    words = F.split("shown", " ", -1)
    constant = F.size(F.filter(words, lambda w: w != VARIABLE)) >= CONSTANT * F.size(words)
    named = first.select("leaf", "line", F.xxhash64("template").alias("head")).join(
        merged.select("leaf", F.col("line").alias("head"), F.xxhash64("leaf", "template").alias("template"), F.col("template").alias("shown")),
        ["leaf", "head"],
    ).select("line", "template", "shown", constant.alias("constant"))
    return lines.select("line", "raw", "doc"), named


def _kept_rows(names: list[str], min_words: int) -> Callable:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for doc, text, gone in zip(*(batch.column(n) for n in ("doc_id", "text", "_gone"))):
                text = text.as_py()
                lines = (text or "").split("\n")
                kept = lines
                if gone.is_valid and doc.is_valid:
                    drop = set(gone.values.to_pylist())
                    kept = [
                        x for x in lines
                        if not (found := judged(x, min_words)) or drop.isdisjoint(found[2:])
                    ]
                texts.append(text if len(kept) == len(lines) else "\n".join(kept))
                total.append(len(lines) if text is not None else 0)
                dropped.append(len(lines) - len(kept))
            made = {"kept_text": pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int64()),
                    "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names if n not in made} | made)

    return job


def without_recurring_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines end at line feeds. A line is dropped if its template occurs in ``min_docs`` documents
    or more, unless the document is the template's first by doc_id. Lines of fewer than
    ``min_words`` words, and lines whose template has too few constant words, count as they
    stand instead of by template; short lines without a letter stay. Null texts stay null. Rows without a doc_id keep their lines and are not counted;
    rows that share a doc_id are one document. All columns stay; the three names are replaced.
    """
    names = docs.columns
    by_doc = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).repartition("_doc")
    lines, named = templates(docs, by_doc, min_docs, min_words, similarity)
    own = lines.join(named.select("line", "template", "constant"), "line").select(
        "doc", F.when(F.col("constant"), F.col("template")).otherwise(F.xxhash64("raw", F.lit("raw"))).alias("template"),
        F.when(F.col("constant"), F.col("line")).otherwise(F.col("raw")).alias("line"),
    )
    recurring = (
        own.select("template", "doc").distinct().groupBy("template")
        .agg(F.count("*").alias("n"), F.min("doc").alias("first")).where(F.col("n") >= min_docs)
    )
    gone = (
        own.join(recurring, "template").where("doc > first").groupBy("doc")
        .agg(F.collect_set("line").alias("_gone")).withColumnRenamed("doc", "_doc")
    )
    fields = [f for f in docs.schema.fields if f.name not in ("kept_text", "n_lines", "n_dropped")]
    schema = T.StructType(fields).add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long")
    return (
        by_doc.join(gone.hint("shuffle_hash"), "_doc", "left")
        .select(*names, "_doc", "_gone").mapInArrow(_kept_rows(names, min_words), schema)
    )


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: its lines, those dropped, and the digest of the text kept (null: empty)."""
    return without_recurring_lines(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )
