"""Attributes for spans that the caller brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assertion import Config, assess_windows


def assess(docs: DataFrame, windows: DataFrame, spans: DataFrame, concept: DataFrame, config: Config = Config()) -> DataFrame:
    """spans (doc_id, span_id, start, end, cui) to one row a span with ``assessed`` and the attributes (null if not assessed).

    A span that is empty or outside its text raises. One whose non-space text leaves its window isn't assessed; one that begins or
    ends inside a token is widened to whole tokens for the rules and keeps its own offsets."""
    text = docs.select("doc_id", "text")
    s = spans.join(text, "doc_id")
    bad = (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.length("text"))
    s = s.withColumn("start", F.when(bad, F.raise_error(F.lit("a span is empty or outside the text"))).otherwise(F.col("start")))
    w = windows.select("doc_id", "win", "tokens", F.element_at("tokens", 1)["start"].alias("w_start"), F.element_at("tokens", -1)["end"].alias("w_end"))
    # A span belongs to the first window that ends after its start.
    own = s.join(w, "doc_id").where("start < w_end").groupBy("span_id", "doc_id", "start", "end", "cui", "text").agg(F.min(F.struct("win", "w_start", "w_end", "tokens")).alias("w"))
    before = F.substring(F.col("text"), F.col("start") + 1, F.col("w.w_start") - F.col("start"))
    after = F.substring(F.col("text"), F.col("w.w_end") + 1, F.col("end") - F.col("w.w_end"))
    own = own.where((F.trim(before) == "") & (F.trim(after) == ""))
    own = own.withColumn("hit", F.filter("w.tokens", lambda t: (t["end"] > F.col("start")) & (t["start"] < F.col("end")))).where(F.size("hit") > 0)
    m = own.select("doc_id", F.col("w.win").alias("win"), "span_id", "cui", F.lit("").alias("term"), "start", "end", F.element_at("hit", 1)["i"].alias("tok_start"), (F.element_at("hit", -1)["i"] + 1).alias("tok_end"))
    m = m.join(concept.select("cui", "preferred_text", F.col("best_group").alias("grp")), "cui", "left").fillna("", ["preferred_text", "grp"])
    from dataclasses import replace

    out = assess_windows(windows, m, replace(config, resolve_overlaps=False, drop_header_mentions=False, groups=None))
    keep = ["negated", "subject", "history_of", "uncertain", "conditional", "generic", "preferred_text", "grp"]
    got = out.select("doc_id", "span_id", *keep, F.lit(True).alias("assessed"))
    return spans.select("doc_id", "span_id", "start", "end", "cui").join(got, ["doc_id", "span_id"], "left").withColumn("assessed", F.coalesce("assessed", F.lit(False)))
