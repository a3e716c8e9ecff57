"""Quality rules (operator 4): one threshold table, compiled into one Spark projection.

The measures are built-in expressions only. Long texts stay in their row: nothing is exploded or shuffled.

Edge cases: a null or empty text has no words and fails the base rule; repeated rows are judged alike, each for
itself; very long texts are judged whole, in time of n log n; an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are ignored by the query
and passed through by ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table

STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he at this are or his from had have but which you were "
    "an they we all her she their there will would can if has more when who so no out up into than them only other new "
    "el la de que y en los del se las por un para con una su al lo como más pero sus le ya este sí porque esta entre "
    "cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie "
    "nach wird bei einer um am sind noch wie einem über einen zum haben nur oder aber vor zur bis mehr durch man "
    "et est une dans qui pas au sur ne ce il sont mais avec ou aux son cette ont ses être fait plus les"
).split()
SYMBOLS = "#*$%&|<>"

#: name, the measure, the words from which the rule applies, lowest and highest value that passes (None: open).
RULES: list[tuple[str, str, int, float | None, float | None]] = [
    ("mean_word_chars", "word_chars / n_words", 20, 2.0, 12.0),
    ("symbols_per_word", "n_symbols / n_words", 20, None, 0.1),
    ("stop_word_ratio", "n_stop_words / n_words", 40, 0.03, None),
    ("dup_line_ratio", "n_dup_lines / n_lines", 20, None, 0.3),
]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def measures(df: DataFrame) -> DataFrame:
    """Adds the counts. The caller's columns must not be called as a measure or begin with ``_``; ``filter_documents`` renames them."""
    names = [f"`{c}`" for c in df.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("_w", F.array_remove(F.split(text, SPACE + "+"), ""))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    h = F.when(F.col("n_words") >= WINDOW, F.transform("_w", lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", h)
    windows = F.transform("_h", lambda x, i: F.xxhash64(F.slice("_h", i + 1, WINDOW)))
    df = df.withColumn("_win", F.slice(windows, 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))))
    df = df.withColumn("_rep", F.size(F.array_distinct("_win")) < F.size("_win"))
    # Only texts in which some window comes twice are sorted: hashes with positions, then the positions of the repeated ones.
    pairs = F.when(F.col("_rep"), F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("_sorted", pairs)
    n = F.size("_sorted")
    twice = F.filter(
        "_sorted",
        lambda x, i: ((i > 0) & (F.get("_sorted", i - 1)["h"] == x["h"])) | ((i + 1 < n) & (F.get("_sorted", i + 1)["h"] == x["h"])),
    )
    df = df.withColumn("_pos", F.when(F.col("_rep"), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("_pos", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_pos", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_rep"), covered).otherwise(F.lit(0)).cast("long"),
            "n_stop_words": F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
        }
    )
    # The struct isn't deterministic to the optimiser, so filters stay above it: pushed below, they would hold a copy of every
    # measure's expression wherever a rule names it.
    df = df.withColumn("_m", F.when(F.monotonically_increasing_id() >= 0, F.struct(*MEASURES)))
    return df.select(*names, *[F.col("_m")[m].alias(m) for m in MEASURES])


def compile_rules(rules=RULES) -> Column:
    """The table as one boolean: true where every rule that applies is met."""
    passed = F.lit(True)
    for _, measure, least_words, low, high in rules:
        top, bottom = measure.split(" / ")
        value = F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))
        ok = F.lit(True)
        if low is not None:
            ok &= value >= low
        if high is not None:
            ok &= value <= high
        passed &= (F.col("n_words") < least_words) | F.coalesce(ok, F.lit(True))
    return passed


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for each row, beside its own columns."""
    df = measures(docs)
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    judged = judge(inner.withColumn("text", F.col(f"c{names.index('text')}")))
    return judged.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_stop() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


def sql(source: str = "documents", columns: str | None = None) -> str:
    """DuckDB SQL of ``query`` (columns None) or of the kept rows' named columns."""
    out = columns or "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    cond = []
    for _, measure, least, low, high in RULES:
        top, bottom = measure.split(" / ")
        v = f"({top}::double / nullif({bottom}, 0)::double)"
        tests = [f"{v} >= {low}"] * (low is not None) + [f"{v} <= {high}"] * (high is not None)
        cond.append(f"(n_words < {least} OR coalesce({' AND '.join(tests)}, true))")
    return f"""
WITH a AS (
  SELECT *, coalesce(text, '') AS t_,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w_,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l_
  FROM {source}),
b AS (
  SELECT *, len(w_)::bigint AS n_words,
         CASE WHEN len(w_) >= {WINDOW} THEN list_transform(range(1, len(w_) - {WINDOW} + 2), lambda i: array_to_string(list_slice(w_, i, i + {WINDOW - 1}), ' ')) ELSE [] END AS win_
  FROM a),
r AS (SELECT row_number() OVER () AS rid_, * FROM b),
u AS (SELECT rid_, unnest(win_) AS k_, unnest(range(1, len(win_) + 1)) AS p_ FROM r),
v AS (SELECT rid_, p_, count(*) OVER (PARTITION BY rid_, k_) AS c_ FROM u),
x AS (SELECT rid_, p_, lead(p_) OVER (PARTITION BY rid_ ORDER BY p_) AS q_ FROM v WHERE c_ > 1),
y AS (SELECT rid_, sum(least({WINDOW}, coalesce(q_ - p_, {WINDOW})))::bigint AS rep_ FROM x GROUP BY rid_),
m AS (
  SELECT r.*, coalesce(length(array_to_string(w_, '')), 0)::bigint AS word_chars,
         (length(t_) - length(regexp_replace(t_, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
         len(l_)::bigint AS n_lines, (len(l_) - len(list_distinct(l_)))::bigint AS n_dup_lines,
         coalesce(rep_, 0)::bigint AS n_repeat_words,
         len(list_filter(w_, lambda x: lower(x) IN ({_sql_stop()})))::bigint AS n_stop_words
  FROM r LEFT JOIN y USING (rid_)),
j AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m),
k AS (SELECT *, (NOT base_failed AND {' AND '.join(cond)}) AS kept FROM j)
SELECT {out} FROM k{' WHERE kept' if columns else ''}"""
