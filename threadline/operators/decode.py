"""Greedy CTC decoding: largest class of each step, repeats collapsed, blanks dropped, tokens joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadline.functions.signal import argmax
from threadline.functions.text import collapse
from threadline.operators.ordered import with_previous


def collapsed(ids: Column, blank: int) -> Column:
    """Ids without repeats of the one before, then without blanks; a blank between equal ids keeps both."""
    changed = F.filter(ids, lambda x, i: (i == 0) | (x != F.element_at(ids, F.greatest(i, F.lit(1)))))
    return F.filter(changed, lambda x: x != blank)


def decode(steps: DataFrame, vocabulary: DataFrame, blank: int, key: str = "session_id", time: str = "t") -> DataFrame:
    """key and text, from key, time and logits. vocabulary: token_id, token; ids without a token are skipped. Keys without any
    token have the empty text."""
    ids = steps.select(key, time, argmax(F.col("logits")).alias("token_id"))
    ids = with_previous(ids, [key], [time], _before_id=F.col("token_id"))
    kept = ids.where((F.col("_before_id").isNull() | (F.col("token_id") != F.col("_before_id"))) & (F.col("token_id") != blank))
    tokens = kept.join(vocabulary, "token_id").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(time, "token"))).alias("_tokens"))
    text = collapse(F.regexp_replace(F.array_join(F.transform("_tokens", lambda t: t["token"]), ""), "▁", " "))
    return steps.select(key).distinct().join(tokens.select(key, text.alias("text")), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
