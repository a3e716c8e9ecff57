"""Stratified review sets and the estimates that their verdicts give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import ratio

STRATA = ("both_positive", "engine_only", "reference_only", "both_negative")
QUOTAS = {"both_positive": 150, "engine_only": None, "reference_only": None, "both_negative": 600}


def stratify(pairs: DataFrame, attribute: str) -> DataFrame:
    """Aligned pairs with case_id and stratum."""
    g, p = F.coalesce("value", F.lit(False)), F.coalesce("p_value", F.lit(False))
    s = F.when(g & p, STRATA[0]).when(p, STRATA[1]).when(g, STRATA[2]).otherwise(STRATA[3])
    case = F.concat_ws(":", F.lit(attribute), F.col("doc_id").cast("string"), F.col("p_begin").cast("string"), F.col("p_end").cast("string"), "cui")
    return pairs.where("p_begin IS NOT NULL").select(case.alias("case_id"), F.lit(attribute).alias("attribute"), "doc_id", F.col("p_begin").alias("start"), F.col("p_end").alias("end"), "cui", s.alias("stratum"))


def sample(cases: DataFrame, seed: int = 0, quotas: dict[str, int | None] | None = None) -> DataFrame:
    """Without replacement, at most a stratum's quota: those with the least md5 of seed and case_id.

    A stratum with a quota is cut by a rank after the best of each partition have been kept, so that a large one isn't sorted whole."""
    quotas = QUOTAS if quotas is None else quotas
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col("case_id")).cast("binary"))
    whole = [s for s, q in quotas.items() if q is None]  # one pass for all of them
    parts = [cases.where(F.col("stratum").isin(*whole))] + [cases.where(F.col("stratum") == s).orderBy(key, "case_id").limit(q) for s, q in quotas.items() if q is not None]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def design(cases: DataFrame, sampled: DataFrame) -> DataFrame:
    """stratum, population, sampled."""
    a = cases.groupBy("stratum").agg(F.count(F.lit(1)).alias("population"))
    b = sampled.groupBy("stratum").agg(F.count(F.lit(1)).alias("sampled"))
    return a.join(b, "stratum", "left").fillna(0, ["sampled"])


def stratum_counts(sampled: DataFrame, verdicts: DataFrame, positive: str) -> DataFrame:
    """stratum, positives, judged, unclear. Verdicts on unknown cases are left out."""
    j = sampled.select("case_id", "stratum").join(verdicts, "case_id")
    return j.groupBy("stratum").agg(F.count_if(F.col("verdict") == positive).alias("positives"), F.count_if(F.col("verdict") != "unclear").alias("judged"), F.count_if(F.col("verdict") == "unclear").alias("unclear"))


def reweighted(counts: DataFrame, population: DataFrame) -> DataFrame:
    """Precision, recall, f1 of the whole population from the strata's rates."""
    j = population.join(counts, "stratum", "left").withColumn("hit", F.col("population") * ratio(F.coalesce("positives", F.lit(0)), F.coalesce("judged", F.lit(0))))
    flagged = F.col("stratum").isin(*STRATA[:2])
    a = j.agg(F.sum(F.when(flagged, F.col("hit")).otherwise(0.0)).alias("tp"), F.sum(F.when(flagged, F.col("population")).otherwise(0)).alias("flagged"), F.sum(F.when(flagged, 0.0).otherwise(F.col("hit"))).alias("missed"))
    p, r = ratio("tp", "flagged"), ratio(F.col("tp"), F.col("tp") + F.col("missed"))
    return a.select(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def bootstrap(counts: DataFrame, population: DataFrame, times: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals; a stratum that was judged in full is held fixed. Draws are a sum of uniform tests, in a row each."""
    j = population.join(counts, "stratum", "left").fillna(0, ["positives", "judged"])
    b = j.sparkSession.range(times).withColumnRenamed("id", "b")
    rate = ratio("positives", "judged")
    u = F.transform(F.sequence(F.lit(1), F.greatest("judged", F.lit(1))), lambda k: (F.pmod(F.xxhash64(F.lit(seed), "b", "stratum", k), F.lit(1 << 53)) / float(1 << 53)) < rate)
    drawn = ratio(F.size(F.filter(u, lambda x: x)), "judged")
    x = b.join(F.broadcast(j)).withColumn("rate", F.when(F.col("judged") == 0, 0.0).when(F.col("sampled") >= F.col("population"), rate).otherwise(drawn))  # four strata
    flagged = F.col("stratum").isin(*STRATA[:2])
    hit = F.col("population") * F.col("rate")
    s = x.groupBy("b").agg(F.sum(F.when(flagged, hit).otherwise(0.0)).alias("tp"), F.sum(F.when(flagged, F.col("population")).otherwise(0)).alias("flagged"), F.sum(F.when(flagged, 0.0).otherwise(hit)).alias("missed"))
    s = s.select(ratio("tp", "flagged").alias("p"), ratio(F.col("tp"), F.col("tp") + F.col("missed")).alias("r"))
    tail = (1 - confidence) / 2
    lo, hi = min(int(tail * times), times - 1) + 1, min(int((1 - tail) * times), times - 1) + 1
    a = s.agg(F.array_sort(F.collect_list("p")).alias("p"), F.array_sort(F.collect_list("r")).alias("r"))  # ``times`` values
    return a.select(*[F.element_at(c, i).alias(f"{n}_{w}") for c, n in (("p", "precision"), ("r", "recall")) for w, i in (("lo", lo), ("hi", hi))])


def horvitz_thompson(sampled: DataFrame, verdicts: DataFrame, predictions: DataFrame, population: DataFrame, positive: str) -> DataFrame:
    """A variant's predictions (case_id, predicted) scored with weights population / judged."""
    j = sampled.select("case_id", "stratum").join(verdicts.where("verdict <> 'unclear'"), "case_id").join(predictions, "case_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit(False)))
    n = j.groupBy("stratum").agg(F.count(F.lit(1)).alias("judged"))
    w = population.join(n, "stratum").select("stratum", (F.col("population") / F.col("judged")).alias("w"))
    x = j.join(w, "stratum").withColumn("true", F.col("verdict") == positive)
    return x.agg(F.sum(F.when(F.col("true") & F.col("predicted"), F.col("w")).otherwise(0.0)).alias("tp"), F.sum(F.when(~F.col("true") & F.col("predicted"), F.col("w")).otherwise(0.0)).alias("fp"), F.sum(F.when(F.col("true") & ~F.col("predicted"), F.col("w")).otherwise(0.0)).alias("fn"))


def review_rows(sampled: DataFrame, annotations: DataFrame, docs: DataFrame, windows: DataFrame, question: str) -> DataFrame:
    """The twelve columns of a blind review sheet; the stratum isn't among them."""
    a = annotations.select("doc_id", "start", "end", "cui", "preferred_text", "win").distinct()
    w = windows.select("doc_id", "win", F.element_at("tokens", 1)["start"].alias("w_start"), F.element_at("tokens", -1)["end"].alias("w_end"))
    j = sampled.join(a, ["doc_id", "start", "end", "cui"], "left").join(w, ["doc_id", "win"], "left").join(docs.select("doc_id", "text"), "doc_id")
    cut = lambda s, e: F.regexp_replace(F.trim(F.substring(F.col("text"), F.col(s) + 1, F.col(e) - F.col(s))), r"\s+", " ")
    return j.select("case_id", F.col("doc_id").cast("string").alias("document"), "attribute", F.lit(question).alias("question"), "cui", "start", "end", cut("start", "end").alias("mention"), "preferred_text", cut("w_start", "w_end").alias("sentence"), F.lit("").alias("verdict"), F.lit("").alias("notes"))


def read_verdicts(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """case_id, attribute, verdict: lower case, blanks left out, anything else unknown raises."""
    v = rows.withColumn("verdict", F.lower(F.trim("verdict"))).where("verdict <> ''")
    known = F.col("verdict").isin(*allowed, "unclear")
    v = v.withColumn("verdict", F.when(known, F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), F.col("verdict"), F.lit(" for "), F.col("case_id")))))
    attribute = F.coalesce(F.col("attribute"), F.lit("negated")) if "attribute" in rows.columns else F.lit("negated")
    return v.select("case_id", attribute.alias("attribute"), "verdict")
