"""Readers: text folders, release files, reference records, XML exports, note and annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = (".txt", ".text", ".note")
RECORD = (
    "source_file string, text string, sentences array<array<int>>, tokens array<array<int>>, pos_tokens array<array<string>>, "
    "mentions array<struct<type:string,text:string,begin:int,end:int,negated:boolean,uncertain:boolean,conditional:boolean,generic:boolean,subject:string,history_of:boolean,"
    "concepts:array<struct<cui:string,tui:string,scheme:string,preferred_text:string>>>>"
)


def text_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, text of every note below ``root``; undecodable bytes are replaced. Order by path where order matters."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    f = f.where(F.lower("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$"))
    # try_validate_utf8 would null a bad file; make_valid_utf8 replaces its bad bytes.
    return f.select("path", F.expr("make_valid_utf8(cast(content AS string))").alias("text"))


def conso(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of a release file: 18 columns between bars; shorter lines are left out."""
    c = F.split("value", r"\|", -1)
    t = spark.read.text(path).where(F.size(c) >= 18)
    at = {"cui": 0, "lat": 1, "ispref": 6, "sab": 11, "tty": 12, "str": 14, "suppress": 16}
    return t.select(*[c[i].alias(n) for n, i in at.items()])


def sty(spark: SparkSession, path: str, allowed: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Semantic types of a release file, of the ``allowed`` ones if given. ``limit`` counts lines as they are read, kept or not."""
    c = F.split("value", r"\|", -1)
    lines = spark.read.text(path)
    out = (lines if limit is None else lines.limit(limit)).where(F.size(c) >= 6).select(c[0].alias("cui"), c[1].alias("tui"))
    return out if allowed is None else out.where(F.upper(F.trim("tui")).isin(*allowed))


def sql_script(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Rows of ``INSERT INTO table VALUES(...)`` lines; doubled quotes are one. A line with another number of values is left out."""
    t = spark.read.text(path).where(F.col("value").startswith(f"INSERT INTO {table} VALUES("))
    body = F.regexp_extract("value", r"VALUES\((.*)\)\s*;?\s*$", 1)
    v = F.regexp_extract_all(body, F.lit(r"('(?:[^']|'')*'|[^,']+)"), F.lit(1))
    clean = F.transform(v, lambda x: F.when(x == "NULL", F.lit(None)).when(x.startswith("'"), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("''"), F.lit("'"))).otherwise(F.trim(x)))
    return t.select(clean.alias("v")).where(F.size("v") == len(columns)).select(*[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def script_counts(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """read, kept, skipped: how many of a table's lines could be parsed."""
    n = spark.read.text(path).where(F.col("value").startswith(f"INSERT INTO {table} VALUES(")).agg(F.count(F.lit(1)).alias("read"))
    k = sql_script(spark, path, table, columns).agg(F.count(F.lit(1)).alias("kept"))
    return n.crossJoin(k).withColumn("skipped", F.col("read") - F.col("kept"))  # one row each


def import_script(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A prebuilt dictionary's script, end to end: rare_term, concept, concept_tui and ``skipped`` (table, read, kept, skipped).

    Its numbers become identifiers (C and 7 digits, T and 3), its terms are taken as they are spelled, since its own tokenizer
    made them; a concept's group is that of its types."""
    from ..functions.lexicons import tui_table
    from ..operators.dictionary import imported_concepts

    shape = {"CUI_TERMS": ["CUI", "RINDEX", "TCOUNT", "TEXT", "RWORD"], "PREFTERM": ["CUI", "PREFTERM"], "TUI": ["CUI", "TUI"]}
    raw = {t: sql_script(spark, path, t, c) for t, c in shape.items()}
    terms = raw["CUI_TERMS"].select(F.col("RWORD").alias("rare_word"), F.col("TEXT").alias("norm"), cui_text(F.col("CUI")).alias("cui"), F.col("RINDEX").cast("int").alias("word_index"), F.col("TCOUNT").cast("int").alias("token_count")).distinct()
    types = raw["TUI"].select(cui_text(F.col("CUI")).alias("cui"), tui_text(F.col("TUI")).alias("tui")).distinct()
    groups = types.join(F.broadcast(tui_table(spark)), "tui").groupBy("cui").agg(F.max(F.struct("grp_code", "grp")).alias("g")).select("cui", F.col("g.grp").alias("best_group"))  # 136 types
    names = raw["PREFTERM"].groupBy(cui_text(F.col("CUI")).alias("cui")).agg(F.min("PREFTERM").alias("preferred_text"))
    counts = None
    for t, c in shape.items():
        one = script_counts(spark, path, t, c).withColumn("table", F.lit(t))
        counts = one if counts is None else counts.unionByName(one)
    meta = spark.createDataFrame([("source", "pretokenized")], "key string, value string")
    return {"rare_term": terms, "concept": imported_concepts(terms, names, groups), "concept_tui": types, "skipped": counts, "meta": meta}


def cui_text(number) -> "F.Column":
    return F.format_string("C%07d", number.cast("int"))


def tui_text(number) -> "F.Column":
    return F.format_string("T%03d", number.cast("int"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Reference records, one object a line; a line that doesn't parse fails the read."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def flatten_records(recs: DataFrame, tui: DataFrame) -> DataFrame:
    """One row a mention and concept, with the group of its type; concepts without an identifier are left out."""
    m = recs.select("source_file", F.explode("mentions").alias("m")).select("source_file", "m.*")
    c = m.withColumn("c", F.explode("concepts")).where("c.cui IS NOT NULL")
    c = c.select("source_file", "text", "begin", "end", "negated", "uncertain", "conditional", "generic", "subject", "history_of", F.col("c.cui").alias("cui"), F.upper(F.trim("c.tui")).alias("tui"), F.col("c.preferred_text").alias("preferred_text"))
    return c.join(F.broadcast(tui.select("tui", "grp")), "tui", "left")  # 136 types


def _xml_tags(spark: SparkSession, root: str) -> DataFrame:
    """path, t: the start tags of annotations."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower("path").endswith(".xmi"))
    x = f.select("path", F.expr("make_valid_utf8(cast(content AS string))").alias("x"))
    tags = F.regexp_extract_all("x", F.lit(r"<((?:textsem|refsem|textspan|syntax|cas):[A-Za-z]+)\s([^>]*)>"), F.lit(0))
    return x.select("path", F.explode(tags).alias("t"))


def _xml_attribute(name: str):
    v = F.regexp_extract("t", rf'[\s:]{name}="([^"]*)"', 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&#9;", "\t"), ("&amp;", "&")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def xml_spans(spark: SparkSession, root: str) -> DataFrame:
    """Sentences and tokens of annotation exports: path, kind (sentence, token), begin, end, type, pos, each once."""
    t = _xml_tags(spark, root)
    name, at = F.regexp_extract("t", r"^<[a-z]+:([A-Za-z]+)", 1), [_xml_attribute(x).cast("int").alias(x) for x in ("begin", "end")]
    s = t.where(F.col("t").startswith("<textspan:Sentence")).select("path", F.lit("sentence").alias("kind"), *at, F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("pos"))
    k = t.where(F.col("t").startswith("<syntax:") & name.endswith("Token")).select("path", F.lit("token").alias("kind"), *at, name.alias("type"), F.nullif(_xml_attribute("partOfSpeech"), F.lit("")).alias("pos"))
    return s.unionByName(k).distinct()


def silver_records(spark: SparkSession, root: str, inputs: DataFrame | None = None) -> DataFrame:
    """Reference records of annotation exports: source_file, text, sentences, tokens, pos_tokens, mentions, each list in order of
    (begin, end, type). ``inputs`` (stem): files of other runs are left out."""
    text = _xml_tags(spark, root).where(F.col("t").startswith("<cas:Sofa")).select("path", _xml_attribute("sofaString").alias("text"))
    m = xml_exports(spark, root)
    concept = F.struct("cui", "tui", "scheme", "preferred_text")
    keys = ["path", "type", "text", "begin", "end", "negated", "uncertain", "conditional", "generic", "subject", "history_of"]
    m = m.groupBy(*keys).agg(F.array_sort(F.collect_set(concept)).alias("concepts"))
    m = m.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "type", *[c for c in keys if c not in ("path", "begin", "end", "type")], "concepts"))).alias("mentions"))
    s = xml_spans(spark, root)
    pair = F.array("begin", "end")
    spans = s.groupBy("path").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "sentence", pair))).alias("sentences"), F.array_sort(F.collect_set(F.when(F.col("kind") == "token", pair))).alias("tokens"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "token", F.struct("begin", "end", "type", "pos")))).alias("typed"),
    )
    spans = spans.withColumn("pos_tokens", F.transform("typed", lambda x: F.array(x["begin"].cast("string"), x["end"].cast("string"), x["type"], x["pos"]))).drop("typed")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.xmi$", "")
    out = text.join(m, "path", "left").join(spans, "path", "left").withColumn("source_file", stem).drop("path")
    return out if inputs is None else out.join(inputs.select(F.col("stem").alias("source_file")).distinct(), "source_file", "left_semi")


def xml_exports(spark: SparkSession, root: str) -> DataFrame:
    """Mentions of annotation exports: path, type, begin, end, text, polarity flags and concepts.

    A file is parsed as one text with regular expressions over its start tags; attributes may come in any order."""
    t, attr, kind = _xml_tags(spark, root), _xml_attribute, F.regexp_extract("t", r"^<[a-z]+:([A-Za-z]+)", 1)
    text = t.where(F.col("t").startswith("<cas:Sofa")).select("path", attr("sofaString").alias("sofa"))
    concepts = t.where(F.col("t").startswith("<refsem:UmlsConcept")).select("path", attr("id").alias("ref"), attr("cui").alias("cui"), attr("tui").alias("tui"), attr("codingScheme").alias("scheme"), attr("preferredText").alias("preferred_text"))
    arrays = t.where(F.col("t").startswith("<cas:FSArray")).select("path", attr("id").alias("arr"), F.explode(F.split(attr("elements"), " ")).alias("ref"))
    m = t.where(F.col("t").startswith("<textsem:") & kind.endswith("Mention")).select("path", kind.alias("type"), attr("begin").cast("int").alias("begin"), attr("end").cast("int").alias("end"), (attr("polarity") == "-1").alias("negated"), (attr("uncertainty") == "1").alias("uncertain"), (attr("conditional") == "true").alias("conditional"), (attr("generic") == "true").alias("generic"), F.nullif(attr("subject"), F.lit("")).alias("subject"), (attr("historyOf") == "1").alias("history_of"), attr("ontologyConceptArr").alias("arrs"))
    refs = m.withColumn("arr", F.explode_outer(F.split("arrs", " ")))
    direct = refs.withColumn("ref", F.col("arr"))
    hop = refs.join(arrays, ["path", "arr"])
    found = direct.unionByName(hop.select(*direct.columns)).join(concepts, ["path", "ref"]).drop("ref", "arr", "arrs")
    return found.distinct().join(text, "path", "left").withColumn("text", F.substring("sofa", F.col("begin") + 1, F.col("end") - F.col("begin"))).drop("sofa")


def csv_notes(spark: SparkSession, path: str, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text: identifiers made safe, a repeated stem gets a number of its own. Rows are numbered by their content, so
    that no identifier depends on how files are split; equal rows stand for one another."""
    n = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if text_column not in n.columns:
        raise ValueError(f"{path} has no column {text_column}")
    stem = F.regexp_replace(F.col(id_column), r"[^A-Za-z0-9._-]+", "_")
    k = F.row_number().over(Window.partitionBy("stem").orderBy(F.col(id_column), F.col(text_column)))
    n = n.withColumn("stem", stem).withColumn("k", k)
    return n.select(F.when(F.col("k") > 1, F.concat_ws("_", "stem", F.col("k").cast("string"))).otherwise(F.col("stem")).alias("doc_id"), F.col(text_column).alias("text"))


def annotation_table(spark: SparkSession, path: str) -> DataFrame:
    """Annotations from CSV (a column ``document`` is needed) or JSON lines with ``annotations``. Empty cells are null."""
    if path.endswith(".csv"):
        t = spark.read.option("header", "true").csv(path)
        if "document" not in t.columns:
            raise ValueError("the table has no column document")
        for c in ("negated", "history_of", "uncertain", "conditional", "generic"):
            if c in t.columns:
                t = t.withColumn(c, F.when(F.col(c).isNull(), None).otherwise(F.lower(F.trim(c)).isin("1", "true", "yes", "t")))
        return t
    t = spark.read.json(path)
    if not t.columns or not t.limit(1).count():
        raise ValueError(f"{path} has no records")
    if "annotations" in t.columns:
        out = t.select(F.col("source").alias("document"), F.explode("annotations").alias("a")).select("document", "a.*")
    elif "mentions" in t.columns:  # reference records: one row a mention and concept
        m = records(spark, path).select(F.col("source_file").alias("document"), F.explode("mentions").alias("m")).select("document", "m.*")
        out = m.withColumn("c", F.explode("concepts")).select("document", F.col("begin").alias("start"), "end", "negated", "uncertain", "conditional", "generic", "subject", "history_of", "c.cui", "c.preferred_text").where("cui IS NOT NULL")
    else:
        raise ValueError("the records have neither annotations nor mentions")
    if not out.limit(1).count():
        raise ValueError(f"{path} has no annotations")
    return out


def browse(tables: dict[str, DataFrame], rows: int = 10, texts: bool = True) -> dict[str, dict]:
    """Each table's columns, number of rows and first rows; without ``texts``, columns called text are left out."""
    out = {}
    for name, df in sorted(tables.items()):
        shown = df if texts else df.drop("text")
        out[name] = {"columns": shown.dtypes, "rows": df.count(), "first": shown.limit(rows)}
    return out


def gather(spark: SparkSession, inputs: list[str], stdin: str | None = None) -> DataFrame:
    """doc_id (the label), text of files, folders and ``-`` (``stdin``). A path that isn't there raises FileNotFoundError."""
    parts, named = [], [i for i in inputs if i != "-"]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in named:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(hadoop)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        if fs.getFileStatus(p).isDirectory():
            parts.append(text_files(spark, path))
        else:
            f = spark.read.format("binaryFile").load(path)
            parts.append(f.select("path", F.expr("make_valid_utf8(cast(content AS string))").alias("text")))
    if "-" in inputs:
        parts.append(spark.createDataFrame([("-", stdin or "")], "path string, text string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().select(F.col("path").alias("doc_id"), "text")


def artifacts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Files below ``root``, newest first, then by path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").endswith(suffix))
    return f.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")
