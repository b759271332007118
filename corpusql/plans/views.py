"""Question/SQL shaped views over the given tables.

The SQL runs unchanged in Spark and in DuckDB, so every query on a view has the
same input in both.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators.ranking import row_numbers

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEW_TABLES = {
    "v_pairs": "orders",
    "v_eval": "orders",
    "v_responses": "orders",
    "v_query_log": "events",
    "v_feedback": "events",
    "v_attempts": "lineitem",
    "v_registry": "embeddings",
    "v_questions": "embeddings",
    "v_turns": "conversations",
}

VIEWS = {
    "v_pairs": r"""
SELECT o_orderkey AS pair_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'ecommerce' WHEN 1 THEN 'saas_analytics'
       WHEN 2 THEN 'healthcare' WHEN 3 THEN 'fintech' ELSE 'hr_system' END AS schema_name,
  CASE WHEN floor(o_orderkey / 5) % 20 < 5 THEN 'simple'
       WHEN floor(o_orderkey / 5) % 20 < 12 THEN 'moderate'
       WHEN floor(o_orderkey / 5) % 20 < 17 THEN 'complex'
       ELSE 'highly_complex' END AS complexity,
  CASE WHEN o_orderkey % 89 = 0 THEN '' ELSE
    CASE o_custkey % 6
      WHEN 0 THEN 'How many orders did customer ' || CAST(o_custkey AS STRING) || ' place?'
      WHEN 1 THEN 'List all accounts with priority ' || o_orderpriority
      WHEN 2 THEN 'Show the latest orders with status ' || o_orderstatus
      WHEN 3 THEN 'What is the average order value?'
      WHEN 4 THEN 'Find all customers above the mean spend'
      ELSE 'Total number of orders per day' END END AS question,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Step 1: pick the table. Step 2: filter.' END AS chain_of_thought,
  CASE WHEN o_orderkey % 97 = 0 THEN ''
       WHEN o_orderkey % 83 = 0 THEN 'SELECT STRFTIME (o_orderdate) FROM orders;'
       WHEN o_orderkey % 79 = 0 THEN 'SELECT julianday(o_orderdate) FROM orders'
       ELSE CASE o_custkey % 14
      WHEN 0 THEN 'SELECT count(*) FROM orders WHERE o_custkey = ' || CAST(o_custkey AS STRING) || ';'
      WHEN 1 THEN 'SELECT date_trunc(''day'', o_orderdate) AS d, count(*) FROM orders GROUP BY 1'
      WHEN 2 THEN 'WITH t AS (SELECT o_custkey, sum(o_totalprice) s FROM orders GROUP BY 1) SELECT * FROM t'
      WHEN 3 THEN 'SELECT a.x FROM ( WITH u AS (SELECT 1 AS x) SELECT x FROM u) a'
      WHEN 4 THEN 'SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) FROM orders LIMIT 5'
      WHEN 5 THEN 'SELECT props->>''k'' FROM events'
      WHEN 6 THEN 'SELECT count(*) FILTER (WHERE event_type = ''error'') FROM events'
      WHEN 7 THEN 'SELECT string_agg(p_name, '','') FROM part WHERE p_name ILIKE ''%a%'''
      WHEN 8 THEN 'SELECT extract(year FROM o_orderdate), coalesce(nullif(o_orderstatus, ''P''), ''x'') FROM orders'
      WHEN 9 THEN 'SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY value) FROM events'
      WHEN 10 THEN 'SELECT * FROM events WHERE ts > now() - INTERVAL ''1 month'' '
      WHEN 11 THEN 'SELECT array_agg(o_orderkey) FROM orders GROUP BY o_custkey'
      WHEN 12 THEN 'SELECT * FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)'
      ELSE 'SELECT c_name FROM customer ORDER BY c_acctbal DESC LIMIT 10;' END END AS sql,
  o_orderdate AS generated_at
FROM orders
""",
    "v_eval": r"""
SELECT o_orderkey AS pair_id, o_orderkey + 1 AS step,
  CASE o_orderkey % 5 WHEN 0 THEN 'ecommerce' WHEN 1 THEN 'saas_analytics'
       WHEN 2 THEN 'healthcare' WHEN 3 THEN 'fintech' ELSE 'hr_system' END AS schema_name,
  CASE WHEN floor(o_orderkey / 5) % 20 < 5 THEN 'simple'
       WHEN floor(o_orderkey / 5) % 20 < 12 THEN 'moderate'
       WHEN floor(o_orderkey / 5) % 20 < 17 THEN 'complex'
       ELSE 'highly_complex' END AS complexity,
  CAST(o_custkey % 1000 AS DOUBLE) / 1000 AS bleu,
  o_orderkey % 11 <> 0 AS valid,
  o_orderkey % 11 <> 0 AND o_custkey % 7 <> 0 AS exec_success,
  o_orderkey % 11 <> 0 AND o_custkey % 7 <> 0 AND o_custkey % 3 = 0 AS exec_match,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Invalid SQL syntax'
       WHEN o_custkey % 7 = 0 THEN 'relation "t' || CAST(o_custkey % 4 AS STRING) || '" does not exist' END AS error
FROM orders
""",
    "v_responses": r"""
SELECT o_orderkey AS pair_id,
  CASE o_orderkey % 5
    WHEN 0 THEN 'First I count rows.' || chr(10) || '```sql' || chr(10) || 'SELECT count(*) FROM orders WHERE o_custkey = ' || CAST(o_custkey AS STRING) || ';' || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 1 THEN '```SQL ' || 'SELECT 1' || ' ``` and ```sql SELECT 2 ```'
    WHEN 2 THEN 'The answer:' || chr(10) || 'select o_custkey' || chr(10) || 'from orders' || chr(10) || 'That is all.'
    WHEN 3 THEN '  I do not know.  '
    ELSE '```json' || chr(10) || '[{"question": "q' || CAST(o_custkey AS STRING) || '", "chain_of_thought": "Step 1", "sql": "SELECT 1;"}, {"question": "", "sql": "SELECT 2"}]' || chr(10) || '```' END AS response
FROM orders
""",
    "v_query_log": r"""
SELECT event_id AS query_id, 'schema_' || CAST(user_id % 5 AS STRING) AS schema_name,
  event_type AS question, 'postgresql' AS dialect,
  CASE event_type WHEN 'error' THEN FALSE WHEN 'signup' THEN NULL ELSE TRUE END AS execution_success,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN repeat('relation missing ', 40)
       WHEN event_type = 'error' THEN '' END AS execution_error,
  CAST(event_id % 3 AS INT) AS correction_attempts,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS row_count,
  value AS latency_ms, 'mock' AS inference_mode, ts AS created_at
FROM events
""",
    "v_feedback": r"""
SELECT event_id AS feedback_id, CAST(floor(event_id / 3) * 2 AS BIGINT) + CASE WHEN event_id % 50 = 0 THEN 100000000 ELSE 0 END AS query_id,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN -1 WHEN 'purchase' THEN 0 ELSE 5 END AS feedback,
  ts AS submitted_at
FROM events
""",
    "v_attempts": r"""
SELECT l_orderkey AS query_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS attempt,
  'SELECT ' || CAST(l_partkey AS STRING) AS sql,
  l_returnflag <> 'R' AS success,
  CASE WHEN l_returnflag = 'R' THEN 'relation p' || CAST(l_partkey % 5 AS STRING) || ' does not exist' END AS error,
  l_shipdate AS attempted_at
FROM lineitem
""",
    "v_registry": r"""
SELECT vec_id, 'schema_' || CAST(label % 4 AS STRING) AS schema_name, 'table_' || CAST(vec_id AS STRING) AS table_name,
  '  CREATE TABLE table_' || CAST(vec_id AS STRING) || ' (id INTEGER, status STRING); CREATE INDEX i ON table_' || CAST(vec_id AS STRING) || ' (id);  ' AS ddl,
  CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN '' ELSE 'Rows about topic ' || CAST(label AS STRING) END AS description,
  embedding
FROM embeddings
""",
    "v_questions": r"""
SELECT vec_id AS question_id, 'schema_' || CAST(label % 5 AS STRING) AS schema_name,
  'Question ' || CAST(vec_id AS STRING) AS question, embedding
FROM embeddings
""",
    "v_turns": r"""
SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""",
}


class Inputs:
    """Tables and views of one folder; each is read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        if name == "v_attempts":
            return self._attempts()
        self.register(VIEW_TABLES[name])
        return self.spark.sql(VIEWS[name])

    def register(self, *tables: str) -> None:
        for table in tables:
            self(table).createOrReplaceTempView(table)

    def _attempts(self) -> DataFrame:
        """``v_attempts`` with its numbering safe for an order with very many lines."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        coarse = F.struct("l_linenumber", F.floor(F.col("l_partkey") / 1000))
        numbered = row_numbers(
            self("lineitem"), ["l_orderkey"], [F.col(c) for c in order], coarse
        )
        failed = F.col("l_returnflag") == "R"
        return numbered.select(
            F.col("l_orderkey").alias("query_id"),
            (F.col("rn") - 1).cast("int").alias("attempt"),
            F.concat(F.lit("SELECT "), F.col("l_partkey").cast("string")).alias("sql"),
            (~failed).alias("success"),
            F.when(
                failed,
                F.concat(
                    F.lit("relation p"), (F.col("l_partkey") % 5).cast("string"),
                    F.lit(" does not exist"),
                ),
            ).alias("error"),
            F.col("l_shipdate").alias("attempted_at"),
        )


def with_views(sql: str, names: Iterable[str]) -> str:
    """Oracle SQL with the views it reads put before it."""
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in names)
    if not ctes:
        return sql
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes}, {body[4:]}"
    return f"WITH {ctes} {body}"
