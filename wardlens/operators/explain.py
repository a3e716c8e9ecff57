"""Why a mention came out as it did: causes of positives, causes of misses, cues by their estimated errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assertion import live_cues, phrase_spans
from .evaluate import ratio


def explained(annotations: DataFrame, attr: str) -> DataFrame:
    """The positives of an attribute with what claimed them: ``rule`` (self: the first cue lies in the mention; cue: it stands beside
    it; section: there is none) and ``label`` (the cue and its direction, or the section)."""
    flag = F.col(attr) == "family_member" if attr == "subject" else F.col(attr)
    first = F.try_element_at(f"{attr}_causes", F.lit(1))
    cue = F.coalesce(first["cue"], F.lit(""))
    inside = F.contains(F.concat(F.lit(" "), F.col("term"), F.lit(" ")), F.concat(F.lit(" "), cue, F.lit(" ")))
    rule = F.when(first.isNull(), "section").when(inside, "self").otherwise("cue")
    label = F.when(first.isNull(), F.coalesce("section", F.lit("(no section)"))).otherwise(F.concat(first["cue"], F.lit(" ("), first["dir"], F.lit(")")))
    return annotations.where(flag).select("doc_id", "win", "cui", "start", "end", rule.alias("rule"), label.alias("label"))


def cues_by_rule(annotations: DataFrame, attr: str) -> DataFrame:
    return explained(annotations, attr).groupBy("rule", "label").agg(F.count(F.lit(1)).alias("n"))


def miss_causes(missed: DataFrame, windows: DataFrame, attr: str = "negated") -> DataFrame:
    """Why positives of the reference were missed: missed (doc_id, win, ...) to cause, n. A window without a cue has ``no trigger``;
    else its cues were out of scope, and their names are the cause."""
    cues = live_cues(phrase_spans(F.col("tokens")), attr, "forward", "backward")
    named = F.array_join(F.array_sort(F.array_distinct(F.transform(cues, lambda c: c["phrase"]))), ", ")
    w = windows.join(missed.select("doc_id", "win").distinct(), ["doc_id", "win"], "left_semi").select("doc_id", "win", named.alias("named"))
    cause = F.when(F.col("named") == "", "no trigger").otherwise(F.concat(F.lit("out of scope: "), F.col("named")))
    return missed.select("doc_id", "win").join(w, ["doc_id", "win"]).groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def cue_examples(wrong: DataFrame, docs: DataFrame, windows: DataFrame, most: int = 3) -> DataFrame:
    """wrong (doc_id, win, cue, start, end) to cue, n and the first examples: mention and sentence, white space as one space."""
    w = windows.select("doc_id", "win", F.element_at("tokens", 1)["start"].alias("b"), F.element_at("tokens", -1)["end"].alias("e"))
    cut = lambda b, e: F.trim(F.regexp_replace(F.substring(F.col("text"), F.col(b) + 1, F.col(e) - F.col(b)), r"\s+", " "))
    j = wrong.join(w, ["doc_id", "win"]).join(docs.select("doc_id", "text"), "doc_id")
    j = j.select("cue", "doc_id", "start", cut("start", "end").alias("mention"), cut("b", "e").alias("sentence"))
    # The first of a cue are kept where they are read, so a cue that many mentions have isn't gathered in one row.
    n = wrong.groupBy("cue").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("cue").orderBy("doc_id", "start"))
    few = j.withColumn("k", k).where(F.col("k") <= most).groupBy("cue").agg(F.array_sort(F.collect_list(F.struct("k", "mention", "sentence"))).alias("x"))
    return n.join(few, "cue").select("cue", "n", F.transform("x", lambda r: F.struct(r["mention"].alias("mention"), r["sentence"].alias("sentence"))).alias("examples"))


def weighted_cues(sampled: DataFrame, verdicts: DataFrame, population: DataFrame, evidence: DataFrame, attr: str = "negated", positive: str = "negated") -> DataFrame:
    """Estimated right and wrong flags by the set of cues behind them: each judged flag stands for population / judged of its stratum.

    ``sampled``: case_id, doc_id, start, end, cui, stratum; ``evidence``: annotations with causes."""
    judged = sampled.join(verdicts, "case_id")
    w = population.join(judged.groupBy("stratum").agg(F.count(F.lit(1)).alias("judged")), "stratum").select("stratum", (F.col("population") / F.col("judged")).alias("w"))
    keys = ["doc_id", "start", "end", "cui"]
    label = F.array_join(F.array_sort(F.transform(f"{attr}_causes", lambda c: c["cue"])), " | ")
    e = evidence.where(F.size(f"{attr}_causes") > 0).select(*keys, label.alias("label")).distinct()
    j = judged.where(F.col("stratum").isin("both_positive", "engine_only")).join(w, "stratum").join(e, keys)
    g = j.groupBy("label").agg(F.sum(F.when(F.col("verdict") == positive, F.col("w")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("verdict") != positive, F.col("w")).otherwise(0.0)).alias("fp"))
    return g.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp")))
