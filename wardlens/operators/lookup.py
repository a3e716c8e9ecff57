"""Dictionary lookup: anchors joined with the index of rare words, verified in place; overlap resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags of tokens that never anchor a lookup.
CLOSED_TAGS = "CC CD DT EX IN LS MD PDT POS PP PP$ PRP PRP$ RP TO VB VBD VBG VBN VBP VBZ WDT WP WPS WRB".split()
LEAST_CHARS = 3


def anchor(token: Column) -> Column:
    return token["is_word"] & (token["pos"].isNull() | ~token["pos"].isin(*CLOSED_TAGS))


def match(windows: DataFrame, rare_term: DataFrame, concept: DataFrame, longest: int | None = None) -> DataFrame:
    """All matches, overlapping ones included: doc_id, win, cui, term, start, end, tok_start, tok_end, preferred_text, grp.

    Each anchor carries the ``longest`` - 1 tokens on either side and no more, so a long window isn't copied for each of its
    tokens. ``longest`` is the most tokens a term has; it is read from the index if it isn't given. Which join is used is left
    to the optimiser: the index is broadcast only if its measured size allows."""
    if longest is None:
        longest = rare_term.agg(F.max("token_count")).first()[0] or 1
    around = F.transform(
        "tokens",
        lambda t, i: F.struct(i.alias("i"), t["norm"].alias("norm"), anchor(t).alias("anchor"), F.greatest(i - (longest - 1), F.lit(0)).alias("from"), F.slice("tokens", F.greatest(i - (longest - 1), F.lit(0)) + 1, 2 * longest - 1).alias("near")),
    )
    a = windows.select("doc_id", "win", F.size("tokens").alias("n"), F.explode(F.filter(around, lambda x: x["anchor"])).alias("a"))
    a = a.select("doc_id", "win", "n", F.col("a.i").alias("i"), F.col("a.norm").alias("word"), F.col("a.from").alias("from"), F.col("a.near").alias("near"))
    index = rare_term.where(F.length("norm") >= LEAST_CHARS).select(F.col("rare_word").alias("word"), F.col("norm").alias("term"), "cui", "word_index", "token_count")
    j = a.join(index, "word").withColumn("tok_start", F.col("i") - F.col("word_index"))
    j = j.where("tok_start >= 0 AND tok_start + token_count <= n")
    span = F.slice("near", F.greatest(F.col("tok_start") - F.col("from") + 1, F.lit(1)), F.col("token_count"))
    j = j.withColumn("span", span)
    j = j.where((F.col("token_count") == 1) | (F.concat_ws(" ", F.transform("span", lambda t: t["norm"])) == F.col("term")))
    out = j.select(
        "doc_id", "win", "cui", "term", F.element_at("span", 1)["start"].alias("start"), F.element_at("span", -1)["end"].alias("end"), "tok_start", (F.col("tok_start") + F.col("token_count")).alias("tok_end")
    ).distinct()
    c = concept.select("cui", "preferred_text", F.col("best_group").alias("grp"))
    return out.join(c, "cui", "left").withColumns({"preferred_text": F.coalesce("preferred_text", F.lit("")), "grp": F.coalesce("grp", F.lit(""))})


def longest_non_overlapping(matches: Column, coextensive: bool = True) -> Column:
    """Of an array of match structs: longest first, then leftmost, then cui; co-extensive ones all stay, or the first of them alone."""
    order = F.array_sort(F.transform(matches, lambda m: F.struct((m["start"] - m["end"]).alias("k"), m["start"].alias("s"), m["cui"].alias("c"), m.alias("m"))))

    def take(kept: Column, x: Column) -> Column:
        m = x["m"]
        same = lambda k: (k["start"] == m["start"]) & (k["end"] == m["end"]) & F.lit(coextensive)
        clash = F.exists(kept, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"]) & ~same(k))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(m)))

    return F.aggregate(order, F.slice(matches, 1, 0), take)


def resolve_overlaps(matches: DataFrame, coextensive: bool = True) -> DataFrame:
    """One row a kept match; a window's matches are folded in one row."""
    names = [c for c in matches.columns if c not in ("doc_id", "win")]
    g = matches.groupBy("doc_id", "win").agg(F.collect_list(F.struct(*names)).alias("ms"))
    return g.select("doc_id", "win", F.explode(longest_non_overlapping(F.col("ms"), coextensive)).alias("m")).select("doc_id", "win", "m.*")
