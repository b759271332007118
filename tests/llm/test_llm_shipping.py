"""Executors need no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent

SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession, functions as F
from corpusql.llm import bpe, html_extract, language_id, line_dedup, packing, simhash, substring_dedup, toxicity, vptree

spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
docs = spark.createDataFrame([(1, "a b c d e f", "en"), (2, "a b c d e f", "en")], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
pages = spark.createDataFrame([(1, "http://a.b/", "<p>x")], "page_id long, url string, html string")
vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
assert bpe.token_digests(docs).count() == bpe.decoded(bpe.encoded(docs)).count() == 2
assert substring_dedup.repeat_digests(docs).count() == 2
assert vptree.nearest(vectors).count() == 1
assert language_id.language_of(docs).count() == 2
assert line_dedup.line_digests(docs).count() == 2
assert packing.packed(docs).count() == 2
assert html_extract.page_digests(pages).first()["text"] == "x"
assert toxicity.toxicity_digests(docs, labels).count() == 2
assert simhash.one_of_each(docs).count() == 1
print("shipped")
"""


def test_functions_travel_by_value(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400,
    )
    assert "shipped" in done.stdout, done.stderr[-2000:]
