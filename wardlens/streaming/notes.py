"""Notes as a stream: each batch goes through the same functions as a table does."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..operators import assertion, lookup, sections


def analyze(docs: DataFrame, rare_term: DataFrame, concept: DataFrame, config: assertion.Config = assertion.PROFILES["default"], longest: int | None = None) -> DataFrame:
    """docs (doc_id, text) to annotations. Texts of white space only give no rows; longer ones than ``max_chars`` raise."""
    from pyspark.sql import functions as F

    size = F.length("text")
    text = F.when(size > config.max_chars, F.raise_error(F.concat(F.lit("a text is longer than max_chars: "), size.cast("string")))).otherwise(F.col("text"))
    w = sections.with_sections(T.windows(docs.select("doc_id", text.alias("text"))))
    return assertion.assess_windows(w, lookup.match(w, rare_term, concept, longest), config)


ANNOTATION = ("cui", "start", "end", "grp", "negated", "subject", "history_of", "uncertain", "conditional", "generic", "preferred_text", "term")


def analyze_batch(docs: DataFrame, rare_term: DataFrame, concept: DataFrame, config: assertion.Config = assertion.PROFILES["default"], longest: int | None = None, metrics=None) -> DataFrame:
    """doc_id, annotations, error for every document: one that can't be analysed has the error's kind (NoText, TextTooLong) and no
    annotations, and the others are analysed all the same. ``metrics`` (an Observation) gets documents, failed, chars, annotations."""
    from pyspark.sql import functions as F

    error = F.when(F.col("text").isNull(), "NoText").when(F.length("text") > config.max_chars, "TextTooLong")
    d = docs.select("doc_id", "text", error.alias("error"))
    found = analyze(d.where("error IS NULL"), rare_term, concept, config, longest)
    found = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", *[c for c in ANNOTATION if c not in ("start", "end")]))).alias("annotations"))
    empty = F.slice(F.array(F.lit(None).cast(found.schema["annotations"].dataType.elementType)), 1, 0)
    out = d.join(found, "doc_id", "left").withColumn("annotations", F.when(F.col("error").isNull(), F.coalesce("annotations", empty)))
    if metrics is not None:
        out = out.observe(metrics, F.count(F.lit(1)).alias("documents"), F.count("error").alias("failed"), F.sum(F.length("text")).alias("chars"), F.sum(F.greatest(F.size("annotations"), F.lit(0))).alias("annotations"))
    return out.select("doc_id", "annotations", "error")


def stream(docs: DataFrame, rare_term: DataFrame, concept: DataFrame, out: str, checkpoint: str, config: assertion.Config = assertion.PROFILES["default"]):
    """A streaming query that appends each batch's annotations below ``out``, in a folder of the batch: a batch that is run again
    after a failure replaces its own rows."""
    longest = rare_term.agg({"token_count": "max"}).first()[0] or 1

    def batch(df: DataFrame, number: int) -> None:
        analyze(df, rare_term, concept, config, longest).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
