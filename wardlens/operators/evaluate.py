"""Agreement between a reference and the engine: set scores, alignment, confusion, errors by cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b as double, 0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def set_scores(gold: DataFrame, predicted: DataFrame, docs: DataFrame, item: list[str]) -> DataFrame:
    """Per document tp, fp, fn and scores over the distinct items; documents without items count too."""
    keys = ["doc_id", *item]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(predicted.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full")
    per = both.groupBy("doc_id").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    per = docs.select("doc_id").distinct().join(per, "doc_id", "left").fillna(0, ["tp", "fp", "fn"])
    return per.withColumns(prf())


def micro_macro(per_doc: DataFrame) -> DataFrame:
    """Pooled counts and means of the documents' scores."""
    a = per_doc.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.count(F.lit(1)).alias("n_docs"))
    return a.withColumns({f"micro_{k}": v for k, v in prf().items()})


def align(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Greedy one-to-one alignment: each reference occurrence in turn takes the unused prediction of its concept with the largest
    overlap, the earlier start among equals. doc_id, cui, begin, end, value, p_begin, p_end, p_value (null: unaligned).

    ``gold`` and ``predicted``: doc_id, begin, end, cui, value, order. The fold runs inside one (document, concept) row."""
    # Both sides are gathered in one shuffle.
    side = lambda df, g: df.select("doc_id", "cui", F.struct("order", "begin", "end", "value").alias("x"), F.lit(g).alias("g"))
    of = lambda g: F.array_sort(F.collect_list(F.when(F.col("g") == g, F.col("x"))))
    j = side(gold, True).unionByName(side(predicted, False)).groupBy("doc_id", "cui").agg(of(True).alias("gs"), of(False).alias("ps")).where(F.size("gs") > 0)

    def step(acc: Column, x: Column) -> Column:
        cand = F.filter(
            F.transform("ps", lambda q, i: F.struct((F.greatest(x["begin"], q["begin"]) - F.least(x["end"], q["end"])).alias("k"), q["begin"].alias("b"), i.cast("int").alias("i"))),
            lambda c: (c["k"] < 0) & ~F.array_contains(acc["used"], c["i"]),
        )
        best = F.try_element_at(F.array_sort(cand), F.lit(1))["i"]
        return F.struct(F.when(best.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(best))).alias("used"), F.concat(acc["out"], F.array(best)).alias("out"))

    empty = F.expr("named_struct('used', cast(array() AS array<int>), 'out', cast(array() AS array<int>))")
    j = j.withColumn("pick", F.aggregate("gs", empty, step, lambda a: a["out"]))
    pairs = F.transform("gs", lambda x, k: F.struct(x.alias("g"), F.get("ps", F.get("pick", k)).alias("p")))
    e = j.select("doc_id", "cui", F.explode(pairs).alias("x"))
    return e.select("doc_id", "cui", F.col("x.g.begin").alias("begin"), F.col("x.g.end").alias("end"), F.col("x.g.value").alias("value"), F.col("x.p.begin").alias("p_begin"), F.col("x.p.end").alias("p_end"), F.col("x.p.value").alias("p_value"))


def attribute_scores(pairs: DataFrame) -> DataFrame:
    """Per document confusion of an attribute over aligned pairs. Null values count as false here, and only here."""
    g, p = F.coalesce("value", F.lit(False)), F.coalesce("p_value", F.lit(False))
    on = F.col("p_begin").isNotNull()
    per = pairs.groupBy("doc_id").agg(
        F.count_if(on).alias("aligned"), F.count_if(~on).alias("unaligned"), F.count_if(on & g & p).alias("tp"), F.count_if(on & ~g & p).alias("fp"), F.count_if(on & g & ~p).alias("fn"), F.count_if(on & (g == p)).alias("agree")
    )
    return per.withColumns(prf() | {"accuracy": ratio("agree", "aligned")})


def error_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """kind (false_positive, false_negative), folded text, n."""
    g, p = F.coalesce("value", F.lit(False)), F.coalesce("p_value", F.lit(False))
    wrong = pairs.where(F.col("p_begin").isNotNull() & (g != p)).withColumn("kind", F.when(p, "false_positive").otherwise("false_negative"))
    t = wrong.join(docs.select("doc_id", "text"), "doc_id").select("kind", F.lower(F.substring("text", F.col("p_begin") + 1, F.col("p_end") - F.col("p_begin"))).alias("mention"))
    return t.groupBy("kind", "mention").agg(F.count(F.lit(1)).alias("n"))


def document_polarity(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """bool_or by (document, concept); scores over the concepts that both have."""
    g = gold.groupBy("doc_id", "cui").agg(F.bool_or("value").alias("g"))
    p = predicted.groupBy("doc_id", "cui").agg(F.bool_or("value").alias("p"))
    j = g.join(p, ["doc_id", "cui"])
    per = j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("common"), F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"), F.count_if(F.col("g") == F.col("p")).alias("agree"))
    return per.withColumns(prf() | {"accuracy": ratio("agree", "common")})


def tag_confusion(gold: DataFrame, predicted: DataFrame, closed: list[str]) -> DataFrame:
    """Tokens joined on their exact span: gold_tag, tag, whether either anchors a lookup, n."""
    j = gold.select("doc_id", "begin", "end", F.col("pos").alias("gold_tag")).join(predicted.select("doc_id", "begin", "end", F.col("pos").alias("tag")), ["doc_id", "begin", "end"], "left")
    a = j.withColumns({"gold_anchor": ~F.col("gold_tag").isin(*closed), "anchor": ~F.col("tag").isin(*closed)})
    return a.groupBy("gold_tag", "tag", "gold_anchor", "anchor").agg(F.count(F.lit(1)).alias("n"))


def boundary_scores(gold: DataFrame, windows: DataFrame, docs: DataFrame, unit: str) -> DataFrame:
    """Agreement on exact spans by document. gold: doc_id, begin, end, type; newline tokens of the reference don't count.
    ``unit``: ``sentence`` (first token's start to last one's end) or ``token``."""
    if unit == "sentence":
        own = windows.select("doc_id", F.element_at("tokens", 1)["start"].alias("begin"), F.element_at("tokens", -1)["end"].alias("end"))
    else:
        own = windows.select("doc_id", F.explode("tokens").alias("t")).select("doc_id", F.col("t.start").alias("begin"), F.col("t.end").alias("end"))
    return set_scores(gold.where(F.coalesce(F.col("type") != "NewlineToken", F.lit(True))), own, docs, ["begin", "end"])


NEVER_ANCHOR = ("PunctuationToken", "SymbolToken", "NumToken", "ContractionToken", "NewlineToken")


def tag_agreement(gold: DataFrame, windows: DataFrame, closed: list[str]) -> DataFrame:
    """Tags on tokens of the same span, by document. gold: doc_id, begin, end, type, pos. A token anchors a lookup by its type
    first, then by its tag; flips have a direction."""
    own = windows.select("doc_id", F.explode("tokens").alias("t")).select("doc_id", F.col("t.start").alias("begin"), F.col("t.end").alias("end"), F.col("t.pos").alias("tag"), F.col("t.is_word").alias("is_word"))
    j = gold.where(F.col("type") != "NewlineToken").join(own, ["doc_id", "begin", "end"], "left")
    open_ = lambda c: F.coalesce(~F.col(c).isin(*closed), F.lit(True))
    on, theirs, ours = F.col("is_word").isNotNull(), ~F.col("type").isin(*NEVER_ANCHOR) & open_("pos"), F.col("is_word") & open_("tag")
    j = j.select("doc_id", on.alias("on"), F.coalesce(F.col("pos") == F.col("tag"), F.lit(False)).alias("same"), theirs.alias("theirs"), ours.alias("ours"))
    c = lambda x: F.count_if(F.col("on") & x)
    a = j.groupBy("doc_id").agg(
        c(F.lit(True)).alias("compared"), F.count_if(~F.col("on")).alias("unaligned"), c(F.col("same")).alias("tag_matches"), c(F.col("theirs") == F.col("ours")).alias("anchor_matches"),
        c(~F.col("theirs") & F.col("ours")).alias("extra_anchors"), c(F.col("theirs") & ~F.col("ours")).alias("missed_anchors"),
    )
    return a.withColumns({"tag_agreement": ratio("tag_matches", "compared"), "anchor_agreement": ratio("anchor_matches", "compared")})


def second_opinion(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two engines' flags on the same mentions (doc_id, start, end, cui, value): agree and disagree by both values; a mention that
    one lacks is ``missing`` there."""
    keys = ["doc_id", "start", "end", "cui"]
    j = ours.select(*keys, F.col("value").alias("ours")).distinct().join(theirs.select(*keys, F.col("value").alias("theirs")).distinct(), keys, "full")
    kind = F.when(F.col("ours").isNull() | F.col("theirs").isNull(), "missing").when(F.col("ours") == F.col("theirs"), "agree").otherwise("disagree")
    return j.groupBy(kind.alias("kind"), "ours", "theirs").agg(F.count(F.lit(1)).alias("n"))


def disagreement_examples(gold: DataFrame, predicted: DataFrame, most: int = 3) -> DataFrame:
    """Per concept that the reference of a document lacks: mentions, documents, and the first examples in order of document and place.

    Each document's first mentions are kept before documents come together, so no concept's mentions are gathered whole."""
    from pyspark.sql import Window

    keys = ["doc_id", "cui"]
    fp = predicted.join(gold.select(*keys).distinct(), keys, "left_anti")
    k = F.row_number().over(Window.partitionBy("doc_id", "cui").orderBy("begin", "end"))
    x = fp.withColumn("k", k)
    per = x.groupBy("cui").agg(F.count(F.lit(1)).alias("fp_mentions"), F.count_if(F.col("k") == 1).alias("fp_docs"))
    first = F.row_number().over(Window.partitionBy("cui").orderBy("doc_id", "begin", "end"))
    few = x.where(F.col("k") <= most).withColumn("r", first).where(F.col("r") <= most)
    few = few.groupBy("cui").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%020d:%010d:%010d", F.col("doc_id"), F.col("begin"), F.col("end")))), " ").alias("examples"))
    return per.join(few, "cui")


def disagreements(gold: DataFrame, predicted: DataFrame, top: int = 20) -> DataFrame:
    """Per concept: mentions predicted in documents whose reference lacks it, and documents that lack it the other way."""
    keys = ["doc_id", "cui"]
    fp = predicted.join(gold.select(*keys).distinct(), keys, "left_anti").groupBy("cui").agg(F.count(F.lit(1)).alias("fp_mentions"), F.countDistinct("doc_id").alias("fp_docs"))
    fn = gold.select(*keys).distinct().join(predicted.select(*keys), keys, "left_anti").groupBy("cui").agg(F.count(F.lit(1)).alias("fn_docs"))
    j = fp.join(fn, "cui", "full").fillna(0, ["fp_mentions", "fp_docs", "fn_docs"])
    return j.orderBy(F.desc(F.col("fp_mentions") + F.col("fn_docs")), "cui").limit(top)


def errors_by_cue(pairs: DataFrame, evidence: DataFrame, attr: str = "negated") -> DataFrame:
    """Each predicted positive counts once for every cue behind it: cue, correct, wrong."""
    e = evidence.select("doc_id", "cui", F.col("start").alias("p_begin"), F.col("end").alias("p_end"), F.explode_outer(f"{attr}_causes").alias("c"))
    j = pairs.where("p_value").join(e, ["doc_id", "cui", "p_begin", "p_end"])
    return j.groupBy(F.coalesce("c.cue", F.lit("section")).alias("cue")).agg(F.count_if(F.col("value")).alias("correct"), F.count_if(~F.col("value")).alias("wrong"))


def latency(df: DataFrame, value: str) -> DataFrame:
    """Index-based percentiles: the element at int(n * p) of the sorted values. No task sees all of them: values fall into ranges, the
    ranges' sizes say in which one a rank lies, and only that range is sorted."""
    n = df.where(F.col(value).isNotNull()).select(value)
    total = n.count()
    if not total:
        return n.agg(F.avg(value).alias("mean"), F.max(value).alias("median"), F.max(value).alias("p95"), F.max(value).alias("p99"), F.max(value).alias("max"))
    per = n.groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    cuts = per.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.005)
    bucket = F.expr(" + ".join(["0", *[f"cast({value} > {c!r}D AS int)" for c in sorted(set(cuts))]]))
    per = per.withColumn("bucket", bucket)
    sizes = {r.bucket: r.n for r in per.groupBy("bucket").agg(F.sum("k").alias("n")).collect()}  # 64 rows at most
    wanted, below = {}, 0
    for b in sorted(sizes):
        for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)):
            at = min(int(total * p), total - 1)
            if below <= at < below + sizes[b]:
                wanted[name] = (b, at - below)
        below += sizes[b]
    from pyspark.sql import Window

    inside = per.where(F.col("bucket").isin(*{b for b, _ in wanted.values()}))
    inside = inside.withColumn("upto", F.sum("k").over(Window.partitionBy("bucket").orderBy(value)))
    picks = [F.min(F.when((F.col("bucket") == b) & (F.col("upto") > at), F.col(value))).alias(name) for name, (b, at) in wanted.items()]
    whole = per.agg((F.sum(F.col(value) * F.col("k")) / total).alias("mean"), F.max(value).alias("max"))
    return whole.crossJoin(inside.agg(*picks)).select("mean", "median", "p95", "p99", "max")  # one row each


def duplicate_labels(paths: DataFrame) -> DataFrame:
    return paths.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).where("n > 1")
