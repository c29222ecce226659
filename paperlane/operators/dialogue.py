"""Token budgets and role order of conversations with a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(characters: Column, messages: Column) -> Column:
    """A careful estimate: characters by 3.5 and 15 a message, a fifth more."""
    return F.floor(F.floor(characters / 3.5 + messages * 15) * 1.2).cast("int")


def safe_limit(used: Column, context: int = 4096, wanted: int = 2048) -> Column:
    """Tokens an answer may take: what is left less 200, halved but at least 50 where that is under 100."""
    left = F.lit(context) - used - 200
    return F.when(left >= 100, F.least(F.lit(wanted), left)).when(left > 0, F.greatest(F.lit(50), F.floor(left / 2).cast("int"))).otherwise(50)


def vllm_limit(used: Column, context: int = 4096, wanted: int = 2048) -> Column:
    left = F.lit(context) - used - 100
    return F.when(left <= 0, 50).otherwise(F.greatest(F.lit(50), F.least(F.lit(wanted), left)))


def merged_roles(messages: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) whose system messages are moved into the first user message."""
    g = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    first_other = F.array_position(F.transform("m", lambda x: x["role"] != "system"), True)
    early = F.filter("m", lambda x, i: (x["role"] == "system") & ((first_other == 0) | (i + 1 < first_other)))
    head = F.array_join(F.transform(early, lambda x: x["text"]), "\n\n")
    rest = F.filter("m", lambda x: x["role"] != "system")
    g = g.select("conv_id", head.alias("head"), F.transform(rest, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("rest"))
    user = lambda t: F.array(F.struct(F.lit("user").alias("role"), t.alias("text")))
    first = F.get("rest", 0)
    merged = F.when(F.col("head") == "", F.col("rest")).when(F.size("rest") == 0, user(F.col("head"))).when(first["role"] == "user", F.concat(user(F.concat_ws("\n\n", "head", first["text"])), F.slice("rest", 2, F.greatest(F.lit(1), F.size("rest"))))).otherwise(F.concat(user(F.col("head")), F.col("rest")))
    return g.select("conv_id", merged.alias("messages"))
