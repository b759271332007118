"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is the product of its letters'
vectors, each rolled by its place (binding keeps order), and a text or a language is the sum
of its n-grams (bundling). A text's language is the prototype at the smallest angle.

Bundling is a sum, so a prototype needs only how often each n-gram occurs in a language:
tasks count n-grams, Spark adds the counts up, and the bound vectors are made once at the
end. Vectors are never shipped: they follow from the seed. The prototypes are one vector for
each language, which is what goes back to the tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import fold

DIMENSIONS = 512
GRAM = 3
SEED = 7
#: Letters up to here have a code of their own; all others share ``SHARED`` more codes.
OWN, SHARED = 0x250, 432
CODES = OWN + SHARED
UNKNOWN = "und"
#: Letters coded at a time, which bounds memory for very long texts.
BLOCK = 1 << 16
#: Counts folded at a time in learning; texts looked at together, and n-grams kept, after it.
FOLD = 400_000
TEXTS = 200
CACHED = 30_000


def _letter_codes() -> np.ndarray:
    """Code of every character: its small letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, "i4")
    for c in range(OWN):
        # A small form of two characters (İ) counts as its first.
        low = ord(chr(c).lower()[0])
        if chr(c).isalpha():
            table[c] = low if low < OWN else OWN + low % SHARED
    rest = np.arange(OWN, 0x110000)
    table[OWN:] = OWN + rest % SHARED
    return table


class Space:
    """Codes, n-grams and their vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions = dimensions
        rng = np.random.default_rng(seed)
        letters = rng.choice(np.array([-1, 1], "i1"), (CODES, dimensions))
        self.rolled = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        self.table = _letter_codes()
        self.upper: dict[int, int] = {}

    def _far_codes(self, far: np.ndarray) -> np.ndarray:
        """Codes of characters beyond the table's own range."""
        out = np.zeros(len(far), "i4")
        for c in np.unique(far).tolist():
            code = self.upper.get(c)
            if code is None:
                low = chr(c).lower()
                is_letter = unicodedata.category(chr(c))[0] == "L"
                code = self.upper[c] = OWN + ord(low[0]) % SHARED if is_letter else 0
            out[far == c] = code
        return out

    def grams(self, text: str) -> np.ndarray:
        """Distinct n-grams of a text and their counts, as (gram, count) columns.

        Anything between letters counts as one gap; a text begins and ends with a gap.
        """
        found, held = [], np.zeros(1, "i8")
        letters = False
        for at in range(0, len(text), BLOCK):
            chars = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "replace"), "<u4")
            codes = self.table[chars]
            far = chars >= OWN
            if far.any():
                codes[far] = self._far_codes(chars[far])
            letters = letters or bool(codes.any())
            codes = np.concatenate([held, codes.astype("i8")])
            stays = np.ones(len(codes), bool)
            stays[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
            codes = codes[stays]
            if at + BLOCK >= len(text) and codes[-1]:
                codes = np.append(codes, 0)
            gram = np.zeros(max(0, len(codes) - GRAM + 1), "i8")
            for k in range(GRAM):
                gram = gram * CODES + codes[k : k + len(gram)]
            found.append(gram)
            held = codes[-(GRAM - 1) :]
        if not letters:
            return np.zeros((0, 2), "i8")
        return np.stack(np.unique(np.concatenate(found), return_counts=True), axis=1)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams, as rows."""
        out = np.ones((len(grams), self.dimensions), "i1")
        for k in range(GRAM):
            out *= self.rolled[k][(grams // CODES ** (GRAM - 1 - k)) % CODES]
        return out

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimensions, "f8")
        for at in range(0, len(grams), 4096):
            out += counts[at : at + 4096] @ self.vectors(grams[at : at + 4096]).astype("f8")
        return out


class Vectors:
    """Bound vectors of the n-grams met so far, ``CACHED`` at most between lots of texts."""

    def __init__(self, space: Space):
        self.space = space
        self.known = np.zeros(0, "i8")
        self.rows = np.zeros((0, space.dimensions), "f4")

    def learn(self, grams: list[np.ndarray]) -> None:
        """Makes the n-grams of a lot of texts known, all at once."""
        wanted = np.unique(np.concatenate([g[:, 0] for g in grams]))
        fresh = np.setdiff1d(wanted, self.known, assume_unique=True)
        if not len(fresh):
            return
        if len(self.known) + len(fresh) > CACHED:
            self.known, self.rows, fresh = self.known[:0], self.rows[:0], wanted
        order = np.argsort(np.concatenate([self.known, fresh]), kind="stable")
        self.rows = np.concatenate([self.rows, self.space.vectors(fresh).astype("f4")])[order]
        self.known = np.concatenate([self.known, fresh])[order]

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, grams[:, 0])
        out = np.zeros(self.space.dimensions)
        for k in range(0, len(at), 4096):
            out += grams[k : k + 4096, 1].astype("f4") @ self.rows[at[k : k + 4096]]
        return out


def profiles(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, as unit rows, from columns ``text`` and ``lang``.

    Reads every row. What comes to the driver is one vector for each language: n-gram counts
    are folded in the tasks, added up by Spark and bundled by groups of n-grams. Languages
    are few; each is bundled in parts of about 4096 n-grams.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def folded(parts: list[np.ndarray]) -> np.ndarray:
            rows = np.concatenate(parts)
            grams, at = np.unique(rows[:, 0], return_inverse=True)
            return np.stack([grams, np.bincount(at, rows[:, 1], len(grams)).astype("i8")], axis=1)

        def out() -> pa.RecordBatch:
            parts = {lang: folded(p) for lang, p in held.items()}
            rows = np.concatenate([np.zeros((0, 2), "i8"), *parts.values()])
            langs = [lang for lang, p in parts.items() for _ in range(len(p))]
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(rows[:, 0]), pa.array(rows[:, 1])],
                ["lang", "gram", "n"],
            )

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                grams = space.grams(text.as_py() or "")
                held.setdefault(lang, []).append(grams)
                size += len(grams)
                if size > FOLD:
                    held = {name: [folded(p)] for name, p in held.items()}
                    size = sum(len(p[0]) for p in held.values())
                    if size > FOLD // 2:
                        yield out()
                        held, size = {}, 0
        yield out()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(), {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            grams, counts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in set(langs.tolist()):
                own = langs == lang
                part = space.bundle(grams[own], counts[own].astype("f8"))
                sums[lang] = sums.get(lang, 0) + part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            ["lang", "part"],
        )

    rows = (
        labelled.where("lang IS NOT NULL").select("text", "lang")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .mapInArrow(bundle, "lang string, part array<double>")
        .select("lang", F.posexplode("part").alias("i", "x"))
        .groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        .orderBy("lang").collect()
    )
    if not rows:
        return [], np.zeros((0, DIMENSIONS))
    vectors = np.array([[p["x"] for p in r["v"]] for r in rows])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    known = norms[:, 0] > 0
    return [r["lang"] for r, k in zip(rows, known) if k], vectors[known] / norms[known]


def identified(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the column ``text`` alone.

    ``score`` is the cosine with the prototype, 0 where it is negative. Texts that are null
    or have no letters, and all texts if nothing was learned, get ``und`` and 0. Equal
    cosines go to the first language by name. The two names are replaced, other columns stay.
    """
    transposed = np.ascontiguousarray(prototypes.T) if len(langs) else None

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        space = Space()
        vectors = Vectors(space)
        for series in texts:
            out: list[tuple[str, float]] = []
            for at in range(0, len(series), TEXTS):
                few = series.iloc[at : at + TEXTS]
                grams = [
                    space.grams(t) if t and transposed is not None else np.zeros((0, 2), "i8") for t in few
                ]
                vectors.learn(grams)
                for g in grams:
                    if not len(g):
                        out.append((UNKNOWN, 0.0))
                        continue
                    bundle = vectors.bundle(g)
                    norm = np.linalg.norm(bundle)
                    cosines = bundle @ transposed / norm if norm else np.zeros(len(langs))
                    best = int(np.argmax(cosines))
                    out.append((langs[best], float(min(1.0, max(0.0, cosines[best])))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    # Not deterministic, as far as the optimizer knows: else a filter on the result copies the
    # call below itself, and every text is looked at twice.
    made = docs.withColumn("_found", predict.asNondeterministic()("text"))
    return made.withColumn("lang_pred", F.col("_found.lang_pred")).withColumn(
        "score", F.col("_found.score")
    ).drop("_found")


def held_out() -> Column:
    """Held out is crc32 of the id, as text, modulo 4 equal to 2; rows without an id are not."""
    return F.coalesce(fold(F.col("doc_id")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Profiles of all rows with an id and a language that are not held out."""
    return profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang"))


#: Lengths of the pieces of learning texts that limits are taken from, as powers of two.
PIECES = (4, 13)
#: Cosines are counted in so many cells from 0 to 1.
CELLS = 10_000
#: A limit is this share of this quantile, from so many pieces of a length at least.
LIMIT_SHARE, LIMIT_QUANTILE, LIMIT_PIECES = 0.5, 0.05, 50


def length_class(text: Column) -> Column:
    """Binary logarithm, cut down, of about how many n-grams a text has; null without a text."""
    return F.floor(F.log2(F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"\P{L}+", " ")))))


def limits(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> list[tuple[int, float]]:
    """(length class, cosine) in order: below it, texts of the class and up are in no known language.

    Half the cosine that all but 5 % of learning texts cut to that length have with their own
    language. Lengths with few pieces, and those below the shortest, are left to the next
    shorter one or to the caller. Every learning row is cut and scored; cosines are counted, so
    the 5 % end at a number of four digits, the same on every run.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = F.array(*(F.lit(1 << k) for k in range(PIECES[0], PIECES[1] + 1)))
    pieces = rows.select("lang", "text", F.explode(sizes).alias("n")).where(F.length("text") >= F.col("n")).select(
        "lang", F.expr("substring(text, 1, n)").alias("text")
    )
    right = identified(pieces, langs, prototypes).where(F.col("lang") == F.col("lang_pred"))
    cells = (
        right.groupBy(length_class(F.col("text")).alias("size"), F.floor(F.col("score") * CELLS).alias("cell"))
        .agg(F.count("*").alias("n"))
    )
    upward = Window.partitionBy("size").orderBy("cell")
    found = (
        cells.withColumn("upto", F.sum("n").over(upward))
        .withColumn("all", F.sum("n").over(Window.partitionBy("size")))
        .where((F.col("all") >= LIMIT_PIECES) & (F.col("upto") >= LIMIT_QUANTILE * F.col("all")))
        .groupBy("size").agg(F.min("cell").alias("cell")).orderBy("size").collect()
    )
    return [(r["size"], LIMIT_SHARE * r["cell"] / CELLS) for r in found]


def language_of(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from rows not held out."""
    langs, prototypes = learn(docs)
    return identified(docs.select("doc_id", "text"), langs, prototypes).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score"
    )
