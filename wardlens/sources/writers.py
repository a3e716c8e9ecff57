"""Writers: JSON lines, a text listing, run folders with a manifest, review sheets."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("cui", "start", "end", "grp", "negated", "subject", "history_of", "uncertain", "conditional", "generic", "preferred_text", "term")


def json_lines(annotations: DataFrame, docs: DataFrame) -> DataFrame:
    """source, annotations in text order; documents without any are there with an empty list."""
    a = annotations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", *[c for c in FIELDS if c not in ("start", "end")]))).alias("annotations"))
    j = docs.select("doc_id", "source").join(a, "doc_id", "left")
    return j.select("source", F.coalesce("annotations", F.slice(F.array(F.lit(None).cast(a.schema["annotations"].dataType.elementType)), 1, 0)).alias("annotations"))


def listing(annotations: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, start, line: span, concept, group, mention, and the flags that are set."""
    j = annotations.join(docs.select("doc_id", "text"), "doc_id")
    mention = F.substring(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), 1, 40)
    flags = F.concat_ws(" ", F.when(F.col("negated"), "NEGATED"), F.when(F.col("subject") == "family_member", "FAMILY"), F.when(F.col("history_of"), "HISTORY"), F.when(F.col("uncertain"), "UNCERTAIN"), F.when(F.col("conditional"), "CONDITIONAL"))
    return j.select("doc_id", "start", F.rtrim(F.format_string("%d:%d %s %s %s %s", "start", "end", "cui", "grp", mention, flags)).alias("line"))


def new_run_id() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%SZ") + "-" + uuid.uuid4().hex[:6]


def write_run(annotations: DataFrame, docs: DataFrame, root: str, settings: dict) -> str:
    """A fresh folder with the annotations and, last, a manifest of the settings in force. An existing folder is refused."""
    out = f"{root.rstrip('/')}/{new_run_id()}"
    json_lines(annotations, docs).write.mode("errorifexists").json(f"{out}/annotations")
    spark = annotations.sparkSession
    spark.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{out}/manifest")
    return out


def review_sheet(rows: DataFrame, path: str) -> None:
    """A CSV folder; each file begins with the mark by which spreadsheets know UTF-8."""
    names = rows.columns
    rows.select(*[F.col(f"`{c}`").cast("string").alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(names)]).write.mode("errorifexists").option("header", "true").csv(path)


def json_array(annotations: DataFrame, docs: DataFrame) -> DataFrame:
    """source, json: a document's annotations as one JSON array; ``[]`` where there are none."""
    return json_lines(annotations, docs).select("source", F.to_json("annotations").alias("json"))


def safe_name(label: str) -> str:
    """A file name of a label: letters, digits, dots, dashes and underscores only."""
    import re

    return re.sub(r"[^A-Za-z0-9._-]+", "_", label).strip("._") or "note"


def file_names(docs: DataFrame) -> DataFrame:
    """source, file: safe names; where two sources get the same one, the later by source has -2, -3 ..."""
    from pyspark.sql import Window

    base = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace("source", r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit("note"))
    d = docs.select("source").distinct().withColumn("base", base)
    k = F.row_number().over(Window.partitionBy("base").orderBy("source"))
    return d.withColumn("k", k).select("source", F.when(F.col("k") > 1, F.concat_ws("-", "base", F.col("k").cast("string"))).otherwise(F.col("base")).alias("file"))


DESIGN = ("attribute", "case_stratum", "pipeline_options", "population", "sampled", "seed")


def design_json(population: DataFrame, sampled: DataFrame, attribute: str, seed: int, options: dict) -> str:
    """The design of a review as JSON with sorted keys. ``population``: stratum, population, sampled; ``sampled``: case_id, stratum, as
    many as people are to judge."""
    d = population.collect()
    return json.dumps({"attribute": attribute, "seed": seed, "pipeline_options": options, "population": {r.stratum: r.population for r in d}, "sampled": {r.stratum: r.sampled for r in d}, "case_stratum": {r.case_id: r.stratum for r in sampled.select("case_id", "stratum").collect()}}, indent=2, sort_keys=True)


def read_design(text: str) -> dict:
    """A design back from JSON. Fields and strata that aren't known are refused: other strata can't be weighted."""
    from ..operators.adjudicate import STRATA

    d = json.loads(text)
    if unknown := sorted(set(d) - set(DESIGN)):
        raise ValueError(f"unknown fields {unknown}: draw the design anew")
    if stale := sorted({*d.get("population", {}), *d.get("sampled", {}), *d.get("case_stratum", {}).values()} - set(STRATA)):
        raise ValueError(f"unknown strata {stale}: there are {', '.join(STRATA)}")
    return {"population": {}, "sampled": {}, "case_stratum": {}, "seed": 0, "attribute": "negated", "pipeline_options": {}} | d


def write_search(out: str, search: dict, concepts: DataFrame, status: DataFrame, documents: DataFrame, console: list[tuple[str, str]]) -> None:
    """A cohort search as four tables below ``out``: search (one row with the counts by status), concepts, documents (all of them,
    absent ones too) and console (stream, text). An existing folder is refused."""
    spark = status.sparkSession
    found = documents.select("doc_id", "source").join(status, "doc_id").select("source", "status", "affirmed", "negated")
    n = status.agg(F.count(F.lit(1)).alias("n_documents"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("affirmed", "negated_only", "absent")])
    head = n.select(*[F.lit(None if v is None else str(v)).alias(k) for k, v in sorted(search.items())], *n.columns)
    lines = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(console)], "line int, stream string, text string")
    for name, df in (("search", head), ("concepts", concepts), ("documents", found), ("console", lines)):
        df.write.mode("errorifexists").parquet(f"{out}/{name}")


def silver_jsonl(records: DataFrame, out: str) -> None:
    records.write.mode("errorifexists").json(out)
