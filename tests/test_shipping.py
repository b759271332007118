"""Executors need no copy of the package: functions travel by value."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession, functions as F
from corpusql.functions.hooks import batch_embed, batch_generate
from corpusql.functions.scoring import bleu
from corpusql.operators.retrieval import vector_topk

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([(1, "s", "a b", "a b", [1.0, 2.0])],
                           "question_id int, schema_name string, question string, prompt string, "
                           "embedding array<double>")
assert df.select(bleu(F.col("question"), F.col("prompt"))).first()[0] > 0
assert batch_generate(df, lambda q, p: q + p).first()["response"] == "a ba b"
assert batch_embed(df, "question", lambda t: t.map(lambda s: [1.0])).first()["embedding"] == [1.0]
assert vector_topk(df, df.withColumn("table_name", F.lit("t"))).first()["rank"] == 1
print("shipped")
"""


def test_functions_travel_by_value(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=240,
    )
    assert "shipped" in done.stdout, done.stderr[-2000:]
