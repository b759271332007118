"""Named queries for the SQL a corpus asks of the engine under it.

Where a join feeds an aggregate, the many-rows side is folded by its join key
first, so that a key with a third of all rows is a handful of rows by the time
it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.operators import ranking, scan
from corpusql.plans.registry import named
from corpusql.plans.views import Inputs

ORDERS_NOW = "2001-08-01 00:00:00"


def _ntz(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


# --- predicates ---------------------------------------------------------------


@named("sql_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def _(t: Inputs) -> DataFrame:
    return t("part").where(F.col("p_name").ilike("%RED%")).select("p_partkey", "p_name")


@named(
    "sql_boolean_filter",
    "SELECT pair_id, schema_name FROM v_eval WHERE exec_success = true AND NOT exec_match",
)
def _(t: Inputs) -> DataFrame:
    rows = t("v_eval").where(F.col("exec_success") & ~F.col("exec_match"))
    return rows.select("pair_id", "schema_name")


@named(
    "sql_timestamp_filter",
    f"""SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate >= date_trunc('month', TIMESTAMP '{ORDERS_NOW}' - INTERVAL '1 month')
      AND o_orderdate < date_trunc('month', TIMESTAMP '{ORDERS_NOW}')""",
)
def _(t: Inputs) -> DataFrame:
    # The bounds are literals, so they fold and reach the parquet scan. Its column
    # has no time zone, and neither have they.
    month = F.date_trunc("month", _ntz(ORDERS_NOW)).cast("timestamp_ntz")
    before = F.date_trunc("month", _ntz(ORDERS_NOW) - F.expr("INTERVAL 1 MONTH"))
    when = F.col("o_orderdate")
    rows = t("orders").where((when >= before.cast("timestamp_ntz")) & (when < month))
    return rows.select("o_orderkey", "o_orderdate")


def _latest_order(t: Inputs) -> DataFrame:
    last = t("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    customer = t("customer").select("c_custkey", "c_mktsegment")
    return customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")


@named(
    "sql_null_predicate",
    """WITH last AS (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1)
    SELECT c_custkey, last_order FROM customer LEFT JOIN last ON o_custkey = c_custkey
    WHERE last_order IS NULL
      OR (c_mktsegment IS NOT NULL AND last_order < TIMESTAMP '2000-07-01 00:00:00')""",
)
def _(t: Inputs) -> DataFrame:
    last = F.col("last_order")
    stale = F.col("c_mktsegment").isNotNull() & (last < _ntz("2000-07-01 00:00:00"))
    return _latest_order(t).where(last.isNull() | stale).select("c_custkey", "last_order")


@named("sql_not_equal", "SELECT p_partkey, p_brand FROM part WHERE p_brand != 'Brand#1'")
def _(t: Inputs) -> DataFrame:
    return t("part").where(F.col("p_brand") != "Brand#1").select("p_partkey", "p_brand")


@named(
    "sql_cte",
    """WITH per_customer AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, n FROM per_customer WHERE n > 5""",
)
def _(t: Inputs) -> DataFrame:
    per_customer = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per_customer.where(F.col("n") > 5)


@named(
    "sql_multi_cte",
    """WITH paid AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'),
      rich AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 500)
    SELECT count(*) AS n, round(avg(c_acctbal), 6) AS average_balance
    FROM rich JOIN paid ON c_custkey = o_custkey""",
)
def _(t: Inputs) -> DataFrame:
    paid = (
        t("orders").where(F.col("o_orderstatus") == "P")
        .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    )
    rich = t("customer").where(F.col("c_acctbal") > 500).select("c_custkey", "c_acctbal")
    joined = rich.join(paid, F.col("c_custkey") == F.col("o_custkey"))
    total = F.sum("k")
    return joined.agg(
        total.alias("n"), F.round(F.sum(F.col("c_acctbal") * F.col("k")) / total, 6)
        .alias("average_balance"),
    )


# --- joins --------------------------------------------------------------------


@named(
    "join_inner",
    """SELECT c_mktsegment, count(*) AS orders, round(avg(o_totalprice), 6) AS avg_order_value,
      round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    spent = (
        t("orders").where(F.col("o_orderstatus") == "F").groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    )
    joined = t("customer").select("c_custkey", "c_mktsegment").join(
        spent, F.col("c_custkey") == F.col("o_custkey")
    )
    return joined.groupBy("c_mktsegment").agg(
        F.sum("n").alias("orders"),
        F.round(F.sum("s") / F.sum("n"), 6).alias("avg_order_value"),
        F.round(F.sum("s"), 2).alias("total"),
    )


@named(
    "join_three_way",
    """SELECT c_mktsegment, l_returnflag, count(*) AS n FROM customer
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderpriority ILIKE '%urgent%' GROUP BY 1, 2 ORDER BY n DESC""",
)
def _(t: Inputs) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    urgent = t("orders").where(F.col("o_orderpriority").ilike("%urgent%"))
    per_customer = (
        urgent.select("o_orderkey", "o_custkey")
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_returnflag").agg(F.sum("n").alias("n"))
    )
    joined = t("customer").select("c_custkey", "c_mktsegment").join(
        per_customer, F.col("c_custkey") == F.col("o_custkey")
    )
    return (
        joined.groupBy("c_mktsegment", "l_returnflag").agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "c_mktsegment", "l_returnflag")
    )


@named(
    "join_left",
    """SELECT c_custkey, c_name, coalesce(n, 0) AS orders FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
      ON o_custkey = c_custkey""",
)
def _(t: Inputs) -> DataFrame:
    pending = (
        t("orders").where(F.col("o_orderstatus") == "P")
        .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    )
    joined = t("customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("orders"))


@named(
    "join_self",
    """SELECT e.o_orderkey, coalesce(m.o_orderpriority, 'No Manager') AS manager
    FROM orders e LEFT JOIN orders m
      ON m.o_orderkey = nullif(e.o_orderkey, 0) // 10 AND m.o_orderstatus <> 'F'""",
)
def _(t: Inputs) -> DataFrame:
    # Ten reports per manager; a manager's key is unique, so rows do not multiply.
    reports = t("orders").select("o_orderkey", F.expr("nullif(o_orderkey, 0) div 10").alias("boss"))
    bosses = t("orders").where(F.col("o_orderstatus") != "F").select(
        F.col("o_orderkey").alias("boss"), "o_orderpriority"
    )
    joined = reports.join(bosses, "boss", "left")
    return joined.select(
        "o_orderkey", F.coalesce("o_orderpriority", F.lit("No Manager")).alias("manager")
    )


@named(
    "join_anti",
    """SELECT c_custkey, c_name FROM customer LEFT JOIN orders
      ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-06-01 00:00:00'
    WHERE o_orderkey IS NULL""",
)
def _(t: Inputs) -> DataFrame:
    # Keys are folded first; the anti join needs each only once.
    recent = t("orders").where(F.col("o_orderdate") >= _ntz("2001-06-01 00:00:00"))
    buyers = recent.select("o_custkey").distinct()
    return t("customer").join(
        buyers, F.col("c_custkey") == F.col("o_custkey"), "left_anti"
    ).select("c_custkey", "c_name")


@named(
    "join_equi_theta",
    """SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS amount
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate +
      INTERVAL '60 days' GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    # Lines of one order and day fold together before they meet the order.
    days = t("lineitem").groupBy("l_orderkey", "l_shipdate").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s")
    )
    orders = t("orders").select("o_orderkey", "o_orderdate")
    in_time = F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    joined = orders.join(days, (F.col("l_orderkey") == F.col("o_orderkey")) & in_time)
    return joined.groupBy("o_orderkey").agg(
        F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("amount")
    )


@named(
    "scalar_subquery",
    """SELECT c_custkey, c_acctbal FROM customer
    WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)""",
)
def _(t: Inputs) -> DataFrame:
    mean = t("customer").agg(F.avg("c_acctbal")).scalar()
    return t("customer").where(F.col("c_acctbal") > mean).select("c_custkey", "c_acctbal")


@named(
    "semi_subquery",
    """SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def _(t: Inputs) -> DataFrame:
    pending = t("orders").where(F.col("o_orderstatus") == "P").select("o_custkey").distinct()
    return t("customer").join(
        pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi"
    ).select("c_custkey", "c_name")


# --- aggregates ---------------------------------------------------------------


@named(
    "sql_count_group",
    """SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) AS n FROM orders
    GROUP BY 1 ORDER BY 1 DESC""",
)
def _(t: Inputs) -> DataFrame:
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")
    return t("orders").groupBy(day).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("day").desc_nulls_first()
    )


@named(
    "sql_sum_avg_max",
    """SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 8) AS mean,
      max(o_orderdate) AS last_order FROM orders GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.round(F.avg("o_totalprice"), 8).alias("mean"),
        F.max("o_orderdate").alias("last_order"),
    )


@named(
    "sql_having",
    """SELECT o_custkey, count(*) AS order_count FROM orders GROUP BY 1
    HAVING count(*) > 12 AND min(o_totalprice) > 1000""",
)
def _(t: Inputs) -> DataFrame:
    grouped = t("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("order_count"), F.min("o_totalprice").alias("least")
    )
    return grouped.where((F.col("order_count") > 12) & (F.col("least") > 1000)).drop("least")


@named(
    "sql_distinct",
    """WITH m AS (SELECT avg(o_totalprice) AS mean FROM orders)
    SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE o_totalprice > (SELECT mean FROM m)""",
)
def _(t: Inputs) -> DataFrame:
    mean = t("orders").agg(F.avg("o_totalprice")).scalar()
    above = t("orders").where(F.col("o_totalprice") > mean).select("o_custkey").distinct()
    joined = t("customer").join(above, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("c_custkey", "c_name").distinct()


@named(
    "sql_agg_filter",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors,
      round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS spent FROM events
    GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    t.register("events")
    return t.spark.sql(
        """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors,
          round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS spent
        FROM events GROUP BY user_id"""
    )


def _user_kinds(t: Inputs) -> DataFrame:
    """Each user's kinds of event (signup as null) and how often: repeats travel as counts."""
    kind = F.nullif("event_type", F.lit("signup"))
    return t("events").select("user_id", kind.alias("kind")).groupBy("user_id", "kind").agg(
        F.count(F.lit(1)).cast("int").alias("n")
    )


def _repeated(runs):
    """All values of (kind, n) runs, in order."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["kind"], r["n"])))


@named(
    "sql_array_agg",
    """SELECT user_id, array_to_string(list_transform(
        array_agg(kind ORDER BY kind NULLS LAST), lambda k: coalesce(k, '<null>')), ',') AS kinds,
      len(array_agg(kind)) AS n
    FROM (SELECT user_id, nullif(event_type, 'signup') AS kind FROM events) GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    # Boxed, because collecting drops bare nulls; array_sort puts null last.
    boxed = F.array_sort(
        F.collect_list(F.struct(F.col("kind").isNull().alias("last"), F.col("kind"), F.col("n")))
    )
    grouped = _user_kinds(t).groupBy("user_id").agg(boxed.alias("runs"))
    return grouped.select("user_id", _repeated(F.col("runs")).alias("kinds")).select(
        "user_id",
        F.array_join("kinds", ",", "<null>").alias("kinds"),
        F.size("kinds").cast("bigint").alias("n"),
    )


@named(
    "sql_string_agg",
    """SELECT user_id, string_agg(kind, ', ' ORDER BY kind DESC) AS kinds
    FROM (SELECT user_id, nullif(event_type, 'signup') AS kind FROM events) GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    runs = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))), asc=False)
    grouped = _user_kinds(t).groupBy("user_id").agg(runs.alias("runs"))
    return grouped.select(
        "user_id", F.when(F.size("runs") > 0, F.array_join(_repeated(F.col("runs")), ", ")).alias("kinds")
    )


_FRACTIONS = {"median": 0.5, "p90": 0.9}


@named(
    "sql_percentile",
    " UNION ALL ".join(
        f"""SELECT event_type, '{name}' AS name, round(quantile_cont(value, {p}), 6) AS cont,
          quantile_disc(value, {p}) AS disc FROM events GROUP BY 1"""
        for name, p in _FRACTIONS.items()
    ),
)
def _(t: Inputs) -> DataFrame:
    exact = ranking.exact_percentiles(t("events"), ["event_type"], "value", _FRACTIONS)
    return exact.withColumn("cont", F.round("cont", 6))


# --- windows ------------------------------------------------------------------


@named(
    "win_row_number",
    """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderdate, o_orderkey) AS rn FROM orders""",
)
def _(t: Inputs) -> DataFrame:
    rows = scan.scanned(
        t("orders").select("o_orderkey", "o_custkey", "o_orderdate"),
        ["o_custkey"],
        [F.col("o_orderdate"), F.col("o_orderkey")],
    )
    return rows.select("o_orderkey", "o_custkey", F.col("row_number").alias("rn"))


@named(
    "win_lag_lead",
    """SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice) OVER w AS next
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def _(t: Inputs) -> DataFrame:
    rows = scan.scanned(
        t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"),
        ["o_custkey"],
        [F.col("o_orderdate"), F.col("o_orderkey")],
        value="o_totalprice",
    )
    return rows.select("o_orderkey", "prev", "next")


@named(
    "win_rank",
    """SELECT p_partkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)""",
)
def _(t: Inputs) -> DataFrame:
    rows = scan.scanned(
        t("part").select("p_partkey", "p_brand", "p_size"),
        ["p_brand"],
        [F.col("p_size").desc()],
        F.col("p_size"),
    )
    return rows.select("p_partkey", "rank", "dense_rank")


@named(
    "sql_topk",
    """SELECT p_name, CAST(sum(l_quantity) AS DOUBLE) AS total_quantity FROM lineitem
    JOIN part ON l_partkey = p_partkey WHERE p_brand != 'Brand#1'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def _(t: Inputs) -> DataFrame:
    sold = t("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    named_parts = t("part").where(F.col("p_brand") != "Brand#1").select("p_partkey", "p_name")
    joined = named_parts.join(sold, F.col("l_partkey") == F.col("p_partkey"))
    return (
        joined.groupBy("p_name").agg(F.sum("q").cast("double").alias("total_quantity"))
        .orderBy(F.col("total_quantity").desc_nulls_first(), "p_name").limit(5)
    )


@named(
    "sql_order_limit",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100""",
)
def _(t: Inputs) -> DataFrame:
    rows = t("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return rows.orderBy(F.col("o_orderdate").desc_nulls_first(), "o_orderkey").limit(100)


# --- scalar functions ---------------------------------------------------------


@named(
    "fn_date_trunc",
    """SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day,
      date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM orders""",
)
def _(t: Inputs) -> DataFrame:
    unit = lambda u: F.date_trunc(u, "o_orderdate").cast("timestamp_ntz").alias(u)
    return t("orders").select("o_orderkey", unit("day"), unit("month"))


@named(
    "fn_extract",
    f"""SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS year,
      CAST(extract(quarter FROM o_orderdate) AS INT) AS quarter,
      CAST(date_part('day', TIMESTAMP '{ORDERS_NOW}' - o_orderdate) AS INT) AS age_days
    FROM orders""",
)
def _(t: Inputs) -> DataFrame:
    age = F.extract(F.lit("DAY"), _ntz(ORDERS_NOW) - F.col("o_orderdate"))
    return t("orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("year"),
        F.quarter("o_orderdate").alias("quarter"),
        age.cast("int").alias("age_days"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """EXTRACT(EPOCH FROM end - start); Spark's EXTRACT has no such field."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000)


@named(
    "fn_extract_epoch",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      round(epoch(l_shipdate - o_orderdate) / 3600, 6) AS hours
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t: Inputs) -> DataFrame:
    lines = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    orders = t("orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    hours = seconds_between(F.col("o_orderdate"), F.col("l_shipdate")) / 3600
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.round(hours, 6).alias("hours"),
    )


@named(
    "fn_interval",
    """SELECT o_orderkey, o_orderdate - INTERVAL '1 month' AS month_before,
      o_orderdate + INTERVAL '90 minutes' AS later FROM orders""",
)
def _(t: Inputs) -> DataFrame:
    when = F.col("o_orderdate")
    return t("orders").select(
        "o_orderkey",
        (when - F.expr("INTERVAL 1 MONTH")).alias("month_before"),
        (when + F.expr("INTERVAL 90 MINUTES")).alias("later"),
    )


@named(
    "fn_coalesce_nullif",
    """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'open') AS status,
      nullif(o_orderpriority, '1-URGENT') AS priority FROM orders""",
)
def _(t: Inputs) -> DataFrame:
    return t("orders").select(
        "o_orderkey",
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("open")).alias("status"),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"),
    )


@named(
    "fn_json",
    """SELECT event_id, CAST(props -> '$.k' AS VARCHAR) AS k_json,
      CAST(json_object('t', event_type) -> '$.t' AS VARCHAR) AS t_json,
      json_object('t', event_type) ->> '$.t' AS t,
      CAST(props ->> '$.k' AS INT) AS k, props ->> '$.missing' AS missing FROM events""",
)
def _(t: Inputs) -> DataFrame:
    member = lambda key: F.get_json_object("props", f"$.{key}")

    def as_json(text, key):
        """The member as JSON: texts keep their quotes."""
        return F.to_json(F.variant_get(F.parse_json(text), f"$.{key}", "variant"))

    return t("events").select(
        "event_id", as_json("props", "k").alias("k_json"),
        as_json(F.to_json(F.struct(F.col("event_type").alias("t"))), "t").alias("t_json"),
        F.get_json_object(F.to_json(F.struct(F.col("event_type").alias("t"))), "$.t").alias("t"),
        member("k").cast("int").alias("k"),
        member("missing").alias("missing"),
    )


@named(
    "fn_case_fold",
    """SELECT pair_id, upper(question) AS up, lower(sql) AS down, trim(sql) AS trimmed
    FROM v_pairs""",
)
def _(t: Inputs) -> DataFrame:
    return t("v_pairs").select(
        "pair_id", F.upper("question").alias("up"), F.lower("sql").alias("down"),
        F.trim("sql").alias("trimmed"),
    )


@named(
    "fn_round",
    """SELECT query_id, round(latency_ms, 1) AS latency_1, round(latency_ms / 7, 4) AS latency_4
    FROM v_query_log""",
)
def _(t: Inputs) -> DataFrame:
    return t("v_query_log").select(
        "query_id", F.round("latency_ms", 1).alias("latency_1"),
        F.round(F.col("latency_ms") / 7, 4).alias("latency_4"),
    )
