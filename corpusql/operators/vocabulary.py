"""A dictionary of tokens with dense ids, and token lists written as ids.

Ids follow frequency: 0 pads, 1 stands for tokens that are too rare, and from 2 on the most
frequent comes first, equal ones by their bytes. Counting folds in the tasks; the numbers come
from one ordered scan in even ranges, so no task holds the dictionary.

Lists look up the head of the dictionary, which a bound on its tokens and their bytes keeps small
enough to send to the tasks, and only what is left of them is joined with the tail. No token of the
tail is frequent, but for those too long for the head, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.operators.scan import scanned

PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2
#: Tokens seen less often are unknown.
MIN_COUNT = 2
#: The head has at most so many tokens of so many bytes: 5 MB.
HEAD_TOKENS, HEAD_BYTES = 20_000, 256


def token_dictionary(lists: DataFrame, column: str, min_count: int = MIN_COUNT) -> DataFrame:
    """token, n and id of the tokens in the lists of ``column`` that occur ``min_count`` times or more.

    Null lists and null tokens count nothing; repeated rows count again. No row gives no token.
    """
    counts = (
        lists.select(F.explode(F.col(f"`{column}`")).alias("token")).where("token IS NOT NULL")
        .groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    )
    numbered = scanned(counts, [], [F.col("n").desc(), F.col("token")])
    return numbered.select("token", "n", (F.col("row_number") + (FIRST_ID - 1)).alias("id"))


def encoded(
    df: DataFrame, column: str, dictionary: DataFrame, into: str, head_tokens: int = HEAD_TOKENS
) -> DataFrame:
    """``df`` with the lists of ``column`` as ids in ``into``, which is replaced if it is there.

    Tokens the dictionary lacks and null tokens are unknown; a null list stays null, an empty one
    empty. Equal lists are looked up once. The dictionary is read several times: hand in a table.
    """
    in_head = (F.col("id") < FIRST_ID + head_tokens) & (F.octet_length("token") <= HEAD_BYTES)
    head = F.broadcast(dictionary.where(in_head).select("token", "id"))
    tail = dictionary.where(~in_head).select("token", "id")
    own = [F.col(f"`{c}`") for c in df.columns if c != into]
    rows = df.select(
        F.struct(*own).alias("row"), F.sha2(F.to_json(F.col(f"`{column}`")), 256).alias("list"),
        F.col(f"`{column}`").alias("tokens"),
    )
    distinct = rows.where("tokens IS NOT NULL").groupBy("list").agg(F.first("tokens").alias("tokens"))
    placed = distinct.select("list", F.posexplode("tokens").alias("place", "token")).join(head, "token", "left")
    rest = placed.where("id IS NULL").drop("id").join(tail, "token", "left")
    found = placed.where("id IS NOT NULL").unionByName(rest).groupBy("list").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id")))).alias("found")
    )
    ids = F.transform(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), lambda x: x["id"])
    return (
        rows.join(found, "list", "left")
        .select("row", F.when(F.col("tokens").isNotNull(), ids).alias("ids"))
        .select("row.*", F.col("ids").alias(into))
    )
