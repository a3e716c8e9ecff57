"""Building the dictionary tables from atoms and semantic types, as one chain of DataFrames.

The order of the steps is an invariant, so it isn't left to the caller: ``build`` returns all tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import excluded_texts, not_rare, tui_table, whitelist
from ..functions.text import dictionary_norm, fenced, strip_semantic_tag, tokens

CODE_SOURCES = ("SNOMEDCT_US", "RXNORM")
UNKNOWN = "UNKNOWN"


def semantic_types(sty: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(cui, tui) of the allowed types; upper case, trimmed."""
    t = sty.select("cui", F.upper(F.trim("tui")).alias("tui"))
    return t.where(F.col("tui").isin(*(allowed if allowed is not None else whitelist())))


def atoms(conso: DataFrame, sources: tuple[str, ...] | None = None, strip_tags: bool = True, exclude: bool = True) -> DataFrame:
    """English, unsuppressed atoms with their norm: cui, norm, text, sab, tty, ispref."""
    a = conso.where("lat = 'ENG' AND suppress = 'N'")
    if sources is not None:
        a = a.where(F.col("sab").isin(*sources))
    a = a.withColumn("text", F.trim("str")).withColumn("norm", fenced(dictionary_norm(F.col("text"))))
    if strip_tags:
        a = a.withColumn("norm", fenced(F.when(F.col("tty") == "FN", strip_semantic_tag(F.col("norm"))).otherwise(F.col("norm"))))
    a = a.where("norm <> ''")
    if exclude:
        a = a.where(~F.col("norm").isin(*excluded_texts()))
    return a.select("cui", "norm", "text", "sab", "tty", "ispref")


def code_cuis(conso: DataFrame, code_sources: tuple[str, ...] | None = CODE_SOURCES) -> DataFrame | None:
    """Concepts with a code in one of the sources; recorded before any choice of synonym sources."""
    if code_sources is None:
        return None
    return conso.where("lat = 'ENG' AND suppress = 'N'").where(F.col("sab").isin(*code_sources)).select("cui").distinct()


def concept_tui(types: DataFrame, terms: DataFrame, codes: DataFrame | None) -> DataFrame:
    out = types.join(terms.select("cui"), "cui", "left_semi")
    if codes is not None:  # no code at all means no restriction
        any_code = codes.limit(1).count() > 0
        out = out.join(codes, "cui", "left_semi") if any_code else out
    return out.select("cui", "tui").distinct()


def term_table(raw: DataFrame, types: DataFrame) -> DataFrame:
    return raw.join(types.select("cui"), "cui", "left_semi").select("norm", "text", "cui", "sab", "tty").distinct()


def concepts(raw: DataFrame, types: DataFrame) -> DataFrame:
    """cui, preferred_text, best_group. The preferred text is chosen among all raw atoms: preferred ones, then short, then first."""
    best = raw.groupBy("cui").agg(F.min(F.struct((F.col("ispref") != "Y").alias("k"), F.length("text").alias("n"), F.col("text"))).alias("b"))
    groups = types.join(F.broadcast(tui_table(types.sparkSession)), "tui", "left").groupBy("cui").agg(F.max(F.when(F.col("grp") != UNKNOWN, F.struct("grp_code", "grp"))).alias("g"))
    return groups.join(best, "cui", "left").select("cui", F.coalesce("b.text", F.lit("")).alias("preferred_text"), F.coalesce("g.grp", F.lit(UNKNOWN)).alias("best_group"))


def retokenized(norm: Column) -> Column:
    """A norm as the tokenizer spells it; one pass is a fixed point. Empty results leave the norm as it is."""
    joined = F.array_join(F.transform(tokens(norm), lambda t: t["norm"]), " ")
    return F.when(joined == "", norm).otherwise(joined)


def retokenize(terms: DataFrame, most: int = 4, log=None) -> DataFrame:
    """Repeats until no term changes, ``most`` times at most. ``log`` is told how many changed each time; without it one pass is
    made, which is a fixed point for this tokenizer."""
    if log is None:
        # Spelled once: joins push their filters on norm down, and each would spell it again.
        return terms.withColumn("norm", fenced(retokenized(F.col("norm"))))
    for k in range(1, most + 1):
        step = terms.withColumn("norm_", fenced(retokenized(F.col("norm"))))
        changed = step.where("norm_ <> norm").count()
        log(f"pass {k}: {changed} terms respelled")
        terms = step.drop("norm").withColumnRenamed("norm_", "norm").select(*terms.columns)
        if not changed:
            return terms
    log("terms were still changing: the tokenizer has no fixed point here")
    return terms


STAGES = ("build", "retokenize", "index")


def run_stages(conso: DataFrame, sty: DataFrame, first: str = "build", only: str | None = None, dry: bool = False, given: dict[str, DataFrame] | None = None, log=print) -> dict[str, DataFrame]:
    """The three stages in order, from ``first`` on or ``only`` one; ``given`` has what the ones left out would have made. A dry run
    names the stages and makes nothing. A stage that fails stops the run."""
    for s in (first, only or first):
        if s not in STAGES:
            raise ValueError(f"no stage {s!r}: there are {', '.join(STAGES)}")
    out = dict(given or {})
    for stage in STAGES[STAGES.index(first) :] if only is None else (only,):
        log(stage)
        if dry:
            continue
        if stage == "build":
            raw = atoms(conso, None)
            types = concept_tui(semantic_types(sty, None), raw, code_cuis(conso, CODE_SOURCES))
            out |= {"concept": concepts(raw, types), "concept_tui": types, "term": term_table(raw, types)}
        elif "term" not in out:
            raise ValueError(f"{stage} needs the terms of build")
        elif stage == "retokenize":
            if "meta" in out and out["meta"].where("key = 'source' AND value = 'pretokenized'").limit(1).count():
                raise ValueError("an imported dictionary is spelled by its own tokenizer")
            out["term"] = retokenize(out["term"]).distinct()
            out.pop("rare_term", None)  # it was made of the old spellings
            out["meta"] = conso.sparkSession.createDataFrame([("terms_retokenized", "yes")], "key string, value string")
        else:
            out["rare_term"] = rare_word_index(out["term"])
    return out


def tui_whitelist(concept_tui: DataFrame) -> DataFrame:
    return concept_tui.select(F.upper(F.trim("tui")).alias("tui")).distinct().orderBy("tui")


def top_keys(rare_term: DataFrame, k: int = 5) -> DataFrame:
    """The rare words with most candidates."""
    return rare_term.groupBy("rare_word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rare_word").limit(k)


def fallbacks(rare_term: DataFrame) -> DataFrame:
    """How many terms of several tokens stand under a word that isn't rarable, since they have no other."""
    return rare_term.where((F.col("token_count") > 1) & ~rarable(F.col("rare_word"))).agg(F.countDistinct("norm").alias("fallbacks"))


def rarable(word: Column) -> Column:
    return (F.length(word) > 1) & word.rlike(r"\p{L}") & ~word.isin(*not_rare())


def token_counts(terms: DataFrame) -> DataFrame:
    """Occurrences of each rarable token over distinct norms."""
    w = terms.select("norm").distinct().select(F.explode(F.split("norm", " ")).alias("word"))
    return w.where(rarable(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def rare_word_index(terms: DataFrame) -> DataFrame:
    """rare_word, norm, cui, word_index, token_count: each term under its rarest token.

    The earliest of the least frequent rarable tokens is taken, and its first position; a single token stands for itself; a term
    without a rarable token falls back on its first."""
    norms = terms.select("norm").distinct()
    pieces = norms.select("norm", F.posexplode(F.split("norm", " ")).alias("pos", "word"))
    counted = pieces.join(token_counts(terms), "word", "left").where(F.col("n").isNotNull())
    best = counted.groupBy("norm").agg(F.min(F.struct("n", "pos", "word")).alias("b"))
    words = F.split("norm", " ")
    out = norms.join(best, "norm", "left").withColumn("token_count", F.size(words))
    out = out.withColumn("rare_word", F.when(F.col("token_count") == 1, F.col("norm")).otherwise(F.coalesce("b.word", F.get(words, F.lit(0)))))
    out = out.withColumn("word_index", (F.array_position(words, F.col("rare_word")) - 1).cast("int"))
    return terms.select("norm", "cui").distinct().join(out, "norm").select("rare_word", "norm", "cui", "word_index", "token_count")


def build(conso: DataFrame, sty: DataFrame, sources: tuple[str, ...] | None = None, code_sources: tuple[str, ...] | None = CODE_SOURCES, allowed: list[str] | None = None) -> dict[str, DataFrame]:
    """concept, concept_tui, term, rare_term, meta."""
    raw = atoms(conso, sources)
    types = concept_tui(semantic_types(sty, allowed), raw, code_cuis(conso, code_sources))
    terms = retokenize(term_table(raw, types)).distinct()
    spark = conso.sparkSession
    meta = spark.createDataFrame([("terms_retokenized", "yes"), ("sources", ",".join(sources or ("all",)))], "key string, value string")
    return {"concept": concepts(raw, types), "concept_tui": types, "term": terms, "rare_term": rare_word_index(terms), "meta": meta}


def check_aligned(meta: DataFrame) -> None:
    """Refuse a dictionary whose terms aren't spelled as the tokenizer spells text."""
    if not meta.where("(key = 'terms_retokenized' AND value = 'yes') OR (key = 'source' AND value = 'pretokenized')").limit(1).count():
        raise ValueError("the dictionary's terms are not tokenizer-aligned: build it with retokenize()")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    t = tables["term"].agg(F.count(F.lit(1)).alias("terms"), F.countDistinct("norm").alias("distinct_norms"))
    return t.crossJoin(tables["concept"].agg(F.count(F.lit(1)).alias("concepts"))).crossJoin(tables["concept_tui"].agg(F.count(F.lit(1)).alias("concept_tuis")))  # one row each


def group_histogram(concept: DataFrame) -> DataFrame:
    return concept.groupBy("best_group").agg(F.count(F.lit(1)).alias("n"))


def index_stats(rare_term: DataFrame) -> DataFrame:
    per = rare_term.groupBy("rare_word").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("avg_candidates"))


def backfill_source(terms: DataFrame, source_of: DataFrame) -> DataFrame:
    """source_of: cui, sab, rank; a term takes the first source of its concept."""
    first = source_of.groupBy("cui").agg(F.min(F.struct("rank", "sab")).alias("f")).select("cui", F.col("f.sab").alias("first_sab"))
    return terms.join(first, "cui", "left").withColumn("sab", F.coalesce("first_sab", "sab")).drop("first_sab")


def imported_concepts(rare_term: DataFrame, preferred: DataFrame, groups: DataFrame) -> DataFrame:
    out = rare_term.select("cui").distinct().join(preferred, "cui", "left").join(groups, "cui", "left")
    return out.select("cui", F.coalesce("preferred_text", F.lit("")).alias("preferred_text"), F.coalesce("best_group", F.lit(UNKNOWN)).alias("best_group"))


def resolve(term: DataFrame, concept: DataFrame, texts: list[str]) -> DataFrame:
    """Concepts that a text names, by norm."""
    asked = term.sparkSession.createDataFrame([(t,) for t in texts], "asked string").withColumn("norm", retokenized(dictionary_norm(F.col("asked"))))
    return asked.join(term.select("norm", "cui"), "norm").join(concept, "cui").select("asked", "cui", "preferred_text", "best_group").distinct()
