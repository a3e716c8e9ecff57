"""The annotation warehouse: document dimension, fact table, the cookbook's queries, cohorts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONAL = ("subject", "history_of", "uncertain", "conditional", "generic")


def load(annotations: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """documents (every document, with n_annotations) and annotations without the columns that were never assessed."""
    kept = annotations.agg(*[F.count(c).alias(c) for c in OPTIONAL]).first()
    facts = annotations.drop(*[c for c in OPTIONAL if not kept[c]])
    n = annotations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_annotations"))
    dim = docs.select("doc_id", "source").join(n, "doc_id", "left").fillna(0, ["n_annotations"])
    return {"documents": dim, "annotations": facts}


def keyed(documents: DataFrame, annotations: DataFrame) -> dict[str, DataFrame]:
    """The same tables with a numeric key of the documents: 63 bits of the source's hash, which no split of the input changes. Two
    sources with one key are refused."""
    dim = documents.withColumn("document_key", F.xxhash64("source").bitwiseAND(F.lit((1 << 63) - 1)))
    if dim.groupBy("document_key").agg(F.countDistinct("source").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("two sources have one key")
    return {"documents": dim, "annotations": annotations.join(dim.select("doc_id", "document_key"), "doc_id")}


def dropped_values(annotations: DataFrame, kept: DataFrame) -> DataFrame:
    """attribute, dropped: values in columns that the narrow table hasn't."""
    gone = [c for c in OPTIONAL if c in annotations.columns and c not in kept.columns]
    n = annotations.agg(*[F.count(c).alias(c) for c in gone], F.lit(0).alias("_"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("long").alias("dropped")) for c in gone], F.struct(F.lit("_").alias("attribute"), F.lit(0).cast("long").alias("dropped")))).alias("x")).select("x.*").where("attribute <> '_'")


def histogram(annotations: DataFrame, column: str) -> DataFrame:
    return annotations.groupBy(F.coalesce(F.col(column), F.lit("(none)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def load_report(annotations: DataFrame) -> DataFrame:
    """attribute, assessed, positive."""
    parts = [annotations.agg(F.count("negated").alias("assessed"), F.count_if(F.col("negated")).alias("positive")).withColumn("attribute", F.lit("negated"))]
    parts += [annotations.agg(F.count(c).alias("assessed"), F.count_if(F.col(c)).alias("positive")).withColumn("attribute", F.lit(c)) for c in ("history_of", "uncertain", "conditional", "generic")]
    parts.append(annotations.agg(F.count("subject").alias("assessed"), F.count_if(F.col("subject") == "family_member").alias("positive")).withColumn("attribute", F.lit("subject")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("attribute", "assessed", "positive")


def top_concepts(a: DataFrame, k: int = 20) -> DataFrame:
    g = a.where("NOT negated").groupBy("cui").agg(F.min("preferred_text").alias("concept"), F.min("grp").alias("grp"), F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"))
    return g.orderBy(F.desc("documents"), F.desc("mentions"), "cui").limit(k)


def by_group(a: DataFrame) -> DataFrame:
    return a.groupBy("grp").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("cui").alias("distinct_concepts"), F.count_if(F.col("negated")).alias("negated"))


def negation_rate(a: DataFrame, least: int = 5, k: int = 20) -> DataFrame:
    g = a.groupBy("cui").agg(F.min("preferred_text").alias("concept"), F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("negated")).alias("negated")).where(F.col("mentions") >= least)
    return g.withColumn("pct_negated", F.round(100.0 * F.col("negated") / F.col("mentions"), 1)).orderBy(F.desc("pct_negated"), F.desc("mentions"), "cui").limit(k)


def co_occurrence(a: DataFrame, group: str = "DISORDER", least: int = 2, k: int = 20) -> DataFrame:
    """Pairs of affirmed concepts of a group by documents. Distinct (document, concept) first: the join sees a document's concepts once."""
    d = a.where((F.col("grp") == group) & ~F.col("negated")).groupBy("doc_id", "cui").agg(F.min("preferred_text").alias("concept"))
    x, y = (d.select("doc_id", F.col("cui").alias(f"cui_{s}"), F.col("concept").alias(f"concept_{s}")) for s in "ab")
    g = x.join(y, "doc_id").where("cui_a < cui_b").groupBy("cui_a", "cui_b").agg(F.min("concept_a").alias("concept_a"), F.min("concept_b").alias("concept_b"), F.count(F.lit(1)).alias("documents"))
    return g.where(F.col("documents") >= least).orderBy(F.desc("documents"), "cui_a", "cui_b").limit(k)


def cohort(a: DataFrame, documents: DataFrame, cui: str) -> DataFrame:
    g = a.where(F.col("cui") == cui).groupBy("doc_id").agg(F.count_if(~F.col("negated")).alias("affirmed"), F.count_if(F.col("negated")).alias("negated"))
    return g.join(documents.select("doc_id", "source"), "doc_id").select("source", "affirmed", "negated")


def doc_sizes(documents: DataFrame, k: int = 20) -> DataFrame:
    return documents.select("source", "n_annotations").orderBy(F.desc("n_annotations"), "source").limit(k)


def cohort_status(a: DataFrame, documents: DataFrame, cuis: list[str]) -> DataFrame:
    """Every document with its counts and status: affirmed, negated_only, absent."""
    g = a.where(F.col("cui").isin(*cuis)).groupBy("doc_id").agg(F.count_if(~F.col("negated")).alias("affirmed"), F.count_if(F.col("negated")).alias("negated"))
    j = documents.select("doc_id").join(g, "doc_id", "left").fillna(0, ["affirmed", "negated"])
    return j.withColumn("status", F.when(F.col("affirmed") > 0, "affirmed").when(F.col("negated") > 0, "negated_only").otherwise("absent"))


def problem_list(a: DataFrame, groups: list[str]) -> DataFrame:
    """Per document and concept of the groups: label, affirmed and negated mentions."""
    return a.where(F.col("grp").isin(*groups)).groupBy("doc_id", "cui").agg(F.min("preferred_text").alias("label"), F.count_if(~F.col("negated")).alias("n"), F.count_if(F.col("negated")).alias("n_negated"))


def read_only_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One SELECT over the tables as temporary views; anything else is refused."""
    q = query.strip().rstrip(";")
    if not re.match(r"(?is)^(select|with)\b", q) or ";" in q:
        raise ValueError("one SELECT statement only")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(q)
