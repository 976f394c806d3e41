"""Preference formatting of chosen and rejected conversations (operator 2).

Both conversations of a pair share their first turns. The longest common turn prefix is rendered once
as the prompt; what follows in each is a completion whose mask tells which characters to learn from.
All of it is expressions over two arrays of turns in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a turn is written.
TURN_HEAD, TURN_HEAD_END, TURN_END = "<|", "|>\n", "<|end|>\n"


def turn_arrays(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id, turns``: each conversation's turns in order (ties by role, then text), from a table with a row a turn.

    Rows without id take no part. A conversation is one training example and has to fit in one row.
    """
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("t"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _text(t: Column) -> Column:
    return F.concat(F.lit(TURN_HEAD), F.coalesce(t["role"], F.lit("")), F.lit(TURN_HEAD_END), F.coalesce(t["text"], F.lit("")), F.lit(TURN_END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _text), "")


def _mask(turns: Column, learn_role: str) -> Column:
    """Spans [start, end) of the completion to learn from: text and end mark of the turns of that role."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        stop = acc["at"] + F.length(_text(t))
        body = F.length(F.coalesce(t["text"], F.lit(""))) + F.lit(len(TURN_END))
        span = F.array(F.struct((stop - body).alias("start"), stop.alias("end")))
        spans = F.when(t["role"] == F.lit(learn_role), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many first turns are equal in role and text (nulls equal nulls)."""
    n = F.least(F.size(a), F.size(b))
    same = lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])
    where = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~same(F.get(a, i), F.get(b, i)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.array_min(where), n))


def format_preferences(pairs: DataFrame, learn_role: str = "assistant", id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """``pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask`` for each row of two turn arrays.

    Turns are structs with ``role`` and ``text``; nulls are written as nothing. A null array counts as
    empty. Where one conversation is a prefix of the other its completion is empty; equal ones have two
    empty completions. Masks are arrays of spans [start, end) in characters of the completion: the text
    and end mark of each turn of ``learn_role``. Repeated rows each give a row; other columns are ignored.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    slim = lambda c: F.coalesce(F.transform(F.col(c), lambda t: F.struct(t["role"].cast("string").alias("role"), t["text"].cast("string").alias("text"))), empty)
    p = pairs.select(F.col(id_col).alias("pair_id"), slim(chosen_col).alias("_c"), slim(rejected_col).alias("_r"))
    p = p.withColumn("n_common", common_turns(F.col("_c"), F.col("_r")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    p = p.withColumn("_cc", rest(F.col("_c"))).withColumn("_rr", rest(F.col("_r")))
    return p.select(
        "pair_id",
        "n_common",
        _rendered(F.slice(F.col("_c"), F.lit(1), F.col("n_common"))).alias("prompt"),
        _rendered(F.col("_cc")).alias("chosen"),
        _rendered(F.col("_rr")).alias("rejected"),
        _mask(F.col("_cc"), learn_role).alias("chosen_mask"),
        _mask(F.col("_rr"), learn_role).alias("rejected_mask"),
    )


def swapped_answers(conversations: DataFrame, **columns: str) -> DataFrame:
    """``pair_id, chosen, rejected`` from conversations alone, for tables that hold no preferences.

    Conversations 2i and 2i + 1 are partners. Chosen is a conversation up to its last assistant turn;
    rejected is the same with that turn replaced by its partner's last assistant turn. Conversations
    without partner or without an assistant turn give no pair.
    """
    c = turn_arrays(conversations, **columns)
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get(F.col("turns"), i)["role"] == "assistant"))
    c = c.withColumn("last", last).where("last IS NOT NULL").select("id", F.slice("turns", F.lit(1), F.col("last") + 1).alias("turns"))
    both = c.groupBy(F.expr("id div 2").alias("half")).agg(F.sort_array(F.collect_list(F.struct("id", "turns"))).alias("m")).where("size(m) = 2")
    both = both.select(F.explode(F.array(F.struct(F.get("m", F.lit(0)).alias("a"), F.get("m", F.lit(1)).alias("b")), F.struct(F.get("m", F.lit(1)).alias("a"), F.get("m", F.lit(0)).alias("b")))).alias("p"))
    a, b = F.col("p.a.turns"), F.col("p.b.turns")
    return both.select(F.col("p.a.id").alias("pair_id"), a.alias("chosen"), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.size(b), F.lit(1))).alias("rejected"))
