"""Column functions over SQL text, model responses and questions.

Everything here is a built-in Spark expression, so the functions work alike in
batch and streaming plans and stay out of Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: they decide results, so they are stated as they must be ----

# White space as Python's str.strip() and \s understand it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# Functions of another dialect that make a pair unusable (lower-cased text).
FOREIGN_DIALECT_PATTERNS = (
    rf"strftime{WS}*\(",
    rf"datetime{WS}*\({WS}*['\"]now",
    rf"date{WS}*\({WS}*['\"]now",
    rf"julianday{WS}*\(",
    rf"typeof{WS}*\(",
)

# Feature name -> text looked for in the upper-cased SQL. The blanks count.
SQL_FEATURES = {
    "DATE_TRUNC": "DATE_TRUNC",
    "EXTRACT": "EXTRACT(",
    "ILIKE": " ILIKE ",
    "Window Function": " OVER (",
    "CTE": " WITH ",
    "JSONB": "->",
    "ARRAY_AGG": "ARRAY_AGG",
    "STRING_AGG": "STRING_AGG",
    "COALESCE": "COALESCE",
    "NULLIF": "NULLIF",
    "FILTER": ") FILTER (",
    "PERCENTILE": "PERCENTILE_",
    "INTERVAL": " INTERVAL ",
}

# Keyword router: words that pick a template, first list first.
AGGREGATE_WORDS = ("how many", "count", "total number")
LIST_WORDS = ("list", "show", "get all", "find all")
TEMPLATE_SQL = {
    "default": (
        "SELECT COUNT(*) as total_count\n"
        "FROM users\n"
        "WHERE created_at >= DATE_TRUNC('month', NOW() - INTERVAL '1 month')\n"
        "  AND created_at < DATE_TRUNC('month', NOW());"
    ),
    "list": "SELECT *\nFROM users\nORDER BY created_at DESC\nLIMIT 100;",
    "aggregate": (
        "SELECT \n"
        "    DATE_TRUNC('day', created_at) as date,\n"
        "    COUNT(*) as count\n"
        "FROM orders\n"
        "GROUP BY DATE_TRUNC('day', created_at)\n"
        "ORDER BY date DESC;"
    ),
}

STATEMENT_WORDS = "SELECT|INSERT|UPDATE|DELETE|WITH|CREATE"
EMPTY_SQL_MESSAGE = "Empty or unparseable SQL"
FENCE = "```"

# --- patterns built from them -------------------------------------------------

# A visible character; one that is not a closing semicolon.
_INK = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
_INK_BEFORE_END = r"[^;\s\x0b\x1c-\x1f\x85\p{Z}]|;[^;]"
_FOREIGN = "|".join(FOREIGN_DIALECT_PATTERNS)
_SQL_BLOCK = rf"(?isu)```sql{WS}*(.*?){WS}*```"
_BEFORE_BLOCK = r"(?isu)\A(.*?)```sql"
# From the start of the first line that holds a statement word to the end.
_FROM_STATEMENT = (
    rf"(?iu)(?:\A|\n)((?:[^\n]*?[^\p{{L}}\p{{N}}_\n])?(?:{STATEMENT_WORDS})"
    rf"(?:[^\p{{L}}\p{{N}}_](?s:.*))?)\z"
)
_FIRST_LINE = r"\A[^\n]*(?:\n|\z)"
_CLOSING_FENCE_LINE = r"(?:\A|\n)[\t\x0b\x0c\r\x1c-\x1f\x85\p{Z}]*```\z"


def strip_ws(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_semicolons(text: Column) -> Column:
    return F.rtrim(text, F.lit(";"))


def is_missing(text: Column) -> Column:
    """Null, empty or nothing but white space; never null itself."""
    return ~F.coalesce(text.rlike(_INK), F.lit(False))


def is_valid_syntax(sql: Column) -> Column:
    """Something is left once trailing semicolons are gone.

    The parser behind this rule does not validate, so only blank text fails.
    """
    return F.coalesce(sql.rlike(_INK_BEFORE_END), F.lit(False))


def executor_syntax_error(sql: Column) -> Column:
    """The executor's variant: semicolons stay, so ``;`` alone passes. Null if fine."""
    return F.when(is_missing(sql), F.lit(EMPTY_SQL_MESSAGE))


def is_target_dialect(sql: Column) -> Column:
    return ~F.coalesce(F.lower(sql).rlike(_FOREIGN), F.lit(False))


def limit_guard(sql: Column, n: int) -> Column:
    """Cap a bare SELECT that says nothing about a limit."""
    body = strip_semicolons(sql)
    bare = F.upper(strip_ws(body)).startswith("SELECT") & ~F.upper(body).contains("LIMIT")
    return F.when(bare, F.concat(body, F.lit(f" LIMIT {int(n)}"))).otherwise(body)


def sanitize_sql(sql: Column) -> Column:
    """Unwrap a fenced block, drop trailing semicolons, trim."""
    text = strip_ws(sql)
    body = F.regexp_replace(F.regexp_replace(text, _FIRST_LINE, ""), _CLOSING_FENCE_LINE, "")
    unfenced = F.when(text.startswith(FENCE), body).otherwise(text)
    return strip_ws(strip_semicolons(unfenced))


def extract_sql(response: Column) -> Column:
    """A model response as ``struct<sql, explanation>``."""
    statement = F.regexp_extract(response, _FROM_STATEMENT, 1)
    return (
        F.when(
            response.rlike(_SQL_BLOCK),
            F.struct(
                strip_ws(F.regexp_extract(response, _SQL_BLOCK, 1)).alias("sql"),
                strip_ws(F.regexp_extract(response, _BEFORE_BLOCK, 1)).alias("explanation"),
            ),
        )
        .when(
            F.length(statement) > 0,
            F.struct(strip_ws(statement).alias("sql"), response.alias("explanation")),
        )
        .when(
            response.isNotNull(),
            F.struct(strip_ws(response).alias("sql"), F.lit("").alias("explanation")),
        )
    )


def json_array_text(response: Column) -> Column:
    """The text from the first ``[`` to the last ``]``, fences removed; empty if none."""
    text = strip_ws(response)
    closing = rf"(?md)```{WS}*$"
    tagged = F.regexp_replace(F.regexp_replace(text, rf"```json{WS}*", ""), closing, "")
    plain = F.regexp_replace(F.regexp_replace(text, rf"```{WORD}*{WS}*", ""), closing, "")
    unfenced = (
        F.when(text.contains("```json"), tagged).when(text.contains(FENCE), plain).otherwise(text)
    )
    return F.regexp_extract(unfenced, r"(?s)\[.*\]", 0)


def has_feature(sql: Column, feature: str) -> Column:
    return F.coalesce(F.upper(sql).contains(SQL_FEATURES[feature]), F.lit(False))


def feature_flags(sql: Column) -> Column:
    """Names of the features a query uses, in the fixed order."""
    return F.array_compact(
        F.array(*[F.when(has_feature(sql, name), F.lit(name)) for name in SQL_FEATURES])
    )


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def route_question(question: Column) -> Column:
    """Template id for a question, by keyword."""
    text = F.lower(question)
    return (
        F.when(_mentions(text, AGGREGATE_WORDS), F.lit("aggregate"))
        .when(_mentions(text, LIST_WORDS), F.lit("list"))
        .otherwise(F.lit("default"))
    )


def template_sql(template: Column) -> Column:
    """SQL of a template id."""
    return (
        F.when(template == "aggregate", F.lit(TEMPLATE_SQL["aggregate"]))
        .when(template == "list", F.lit(TEMPLATE_SQL["list"]))
        .otherwise(F.lit(TEMPLATE_SQL["default"]))
    )
