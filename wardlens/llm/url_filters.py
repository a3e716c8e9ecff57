"""URL filters (operator 8): a path-template tree for each host, with DataFrame functions only.

1. Paths are cut into segments; digits and hexadecimal names become ``{n}`` and ``{h}``. Equal shapes of a host are counted
   together before anything else is shuffled.
2. From the root down, a node with many distinct children turns the rare ones into ``*``.
3. From the leaves up, branches that differ in one segment only are merged into ``*`` unless their share of bad labels
   differs significantly from that of all of them together.
4. A template is blocked if its smoothed share of good labelled pages is below ``LEAST_PURITY``.

Fixed rules of host suffix and path prefix come before the tree. Each level's table is written to the shared folder,
so plans stay short and lost executors cost one level. All groups are sums that are combined before the shuffle; joins on
a hot host are left to adaptive skew splitting. The tree is as deep as the longest path; each level costs two tables.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets its template's verdict
(allow, as a template without labels always does); repeated pages are judged alike; an empty table gives no
rows; columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The SQL has so many levels: the tree's results for tables whose paths are no longer.
DEPTH = 3
#: A node with more than MANY children turns those with less than RARE of its pages into ``*``.
MANY, RARE = 20, 0.05
#: A branch stays apart if it has LEAST labelled pages and differs by Z standard errors.
LEAST, Z = 20, 2.58
LEAST_PURITY, WEIGHT = 0.5, 10.0


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    def general(x: Column) -> Column:
        x = F.regexp_replace(x, r"^[0-9]+(?=\.[A-Za-z]{1,5}$|$)", "{n}")
        return F.regexp_replace(x, r"^(?=[A-Fa-f-]*[0-9])[0-9A-Fa-f-]{8,}$", "{h}")

    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), general)


def templates(pages: DataFrame) -> DataFrame:
    """host, s (a shape: its segments) with m (its template, padded with '') and the template's n_pages, n_labelled, n_bad, purity, verdict.

    ``pages`` has host, path and bad (1, 0, or null: no label)."""
    t = (
        pages.select("host", "bad", shape(F.col("path")).alias("s"))
        .groupBy("host", "s")
        .agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b"))
    )
    t = written(t, "shapes")
    total = t.agg(F.sum("l"), F.sum("b"), F.max(F.size("s"))).first()
    prior = (total[1] or 0) / total[0] if total[0] else 0.0
    depth = total[2] or 0
    t = t.withColumn("m", F.concat("s", F.array_repeat(F.lit(""), F.lit(depth) - F.size("s"))))
    for d in range(1, depth + 1):
        up, below = F.slice("m", 1, d - 1), F.slice("m", d + 1, depth)
        t = t.withColumns({"up": up, "x": F.get("m", F.lit(d - 1))})
        nodes = t.groupBy("host", "up", "x").agg(F.sum("n").alias("n_child"))
        # Named segments only: an absent one or one already general is no variable name.
        named = F.expr("x <> '' AND x NOT LIKE '{_}%'")
        parents = nodes.where(named).groupBy("host", "up").agg(F.count(F.lit(1)).alias("k"), F.sum("n_child").alias("n_all"))
        wild = nodes.join(parents, ["host", "up"]).where((F.col("k") > MANY) & (F.col("n_child") < RARE * F.col("n_all")) & named)
        t = t.join(wild.select("host", "up", "x", F.lit(True).alias("wild")), ["host", "up", "x"], "left")
        t = written(t.withColumn("m", F.when(F.col("wild"), F.concat(up, F.array(F.lit("*")), below)).otherwise(F.col("m"))).drop("wild", "up", "x"), f"general{d}")
    for d in range(depth, 0, -1):
        up, below = F.slice("m", 1, d - 1), F.slice("m", d + 1, depth)
        leaf = t.groupBy("host", "m").agg(F.sum("l").alias("ll"), F.sum("b").alias("bb")).withColumn("others", F.concat(up, below))
        pool = leaf.groupBy("host", "others").agg(F.count(F.lit(1)).alias("k"), F.sum("ll").alias("pl"), F.sum("bb").alias("pb"))
        p = F.try_divide(F.col("pb"), F.col("pl"))
        z = F.abs(F.try_divide(F.col("bb"), F.col("ll")) - p)
        error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("ll")) - F.try_divide(F.lit(1.0), F.col("pl"))))
        apart = F.coalesce((F.col("ll") >= LEAST) & (z > Z * error), F.lit(False))
        merge = leaf.join(pool, ["host", "others"]).where((F.col("k") > 1) & ~apart).select("host", "m", F.lit(True).alias("merge"))
        t = t.join(merge, ["host", "m"], "left").withColumn("m", F.when(F.col("merge"), F.concat(up, F.array(F.lit("*")), below)).otherwise(F.col("m"))).drop("merge")
        t = written(t, f"merged{d}")
    stats = t.groupBy("host", "m").agg(F.sum("n").alias("n_pages"), F.sum("l").alias("n_labelled"), F.sum("b").alias("n_bad"))
    purity = 1 - (F.col("n_bad") + WEIGHT * prior) / (F.col("n_labelled") + WEIGHT)
    stats = stats.withColumn("purity", purity)
    stats = stats.withColumn("verdict", F.when((F.col("n_labelled") > 0) & (F.col("purity") < LEAST_PURITY), "block").otherwise("allow"))
    return t.select("host", "s", "m").join(stats, ["host", "m"])


def judge(pages: DataFrame) -> DataFrame:
    """``pages``: page_id, url, bad (1 bad, 0 good, null unknown). One row a page with host, path, rule, verdict and template."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("long").alias("bad"))
    known = templates(rows)
    name = F.regexp_replace(F.array_join("m", "/"), "/+$", "")
    known = known.select("host", "s", name.alias("template"), "purity", F.col("verdict").alias("learned"))
    rows = rows.select("page_id", "host", "path", shape(F.col("path")).alias("s"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    out = rows.join(known, ["host", "s"], "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("learned"), F.lit("allow")).alias("verdict"), "template", "purity")


def with_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's address ends in the number of the document that it shows; bad: that one is of low quality or toxic."""
    bad = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[A-Za-z]{1,5})?/?$", 1)
    pages = pages.select("page_id", "url", number.try_cast("bigint").alias("doc_id"))
    return pages.join(bad, "doc_id", "left").select("page_id", "url", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_labels(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return judge(written(pages, "pages")).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def sql() -> str:
    rest = "CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    general = (
        "CASE WHEN regexp_matches(x, '^[0-9]+(\\.[A-Za-z]{1,5})?$') THEN regexp_replace(x, '^[0-9]+', '{n}')"
        " WHEN regexp_matches(x, '^[0-9A-Fa-f-]{8,}$') AND regexp_matches(x, '^[A-Fa-f-]*[0-9]') THEN '{h}' ELSE x END"
    )
    s, m = [f"s{d}" for d in range(1, DEPTH + 1)], [f"m{d}" for d in range(1, DEPTH + 1)]
    rule, verdict = "NULL", "NULL"
    for what, text in sorted(RULES, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = f"((host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '/{p}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    ctes = [
        "lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id)",
        f"u AS (SELECT page_id, {rest} AS r_ FROM pages)",
        f"v AS (SELECT page_id, translate(regexp_extract(coalesce(r_, ''), '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host, regexp_extract(coalesce(r_, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        "w AS (SELECT v.*, bad, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: " + general + ") AS p_ FROM v LEFT JOIN lab ON lab.doc_id = try_cast(regexp_extract(path, '/([0-9]{1,18})(?:\\.[A-Za-z]{1,5})?/?$', 1) AS BIGINT))",
        f"rows_ AS (SELECT page_id, host, path, bad, {', '.join(f"coalesce(p_[{d}], '') AS s{d}" for d in range(1, DEPTH + 1))}, coalesce(array_to_string(p_[{DEPTH + 1}:], '/'), '') AS rest FROM w)",
        f"t0 AS (SELECT host, {', '.join(s)}, rest, count(*) AS n, count(bad) AS l, coalesce(sum(bad), 0) AS b, {', '.join(f'{a} AS {c}' for a, c in zip(s, m))} FROM rows_ GROUP BY ALL)",
        "prior AS (SELECT coalesce(sum(b)::double / nullif(sum(l), 0), 0) AS prior FROM t0)",
    ]
    last = "t0"
    keys = f"host, {', '.join(s)}, rest, n, l, b"
    for d in range(1, DEPTH + 1):
        above = ", ".join(["host", *m[: d - 1]])
        named = f"(m{d} <> '' AND m{d} NOT LIKE '{{_}}%')"
        ctes += [
            f"n{d} AS (SELECT {above}, m{d}, sum(n) AS c FROM {last} GROUP BY ALL)",
            f"p{d} AS (SELECT {above}, count(*) AS k, sum(c) AS a FROM n{d} WHERE {named} GROUP BY ALL)",
            f"w{d} AS (SELECT {above}, m{d}, true AS wild FROM n{d} JOIN p{d} USING ({above}) WHERE {named} AND k > {MANY} AND c < {RARE} * a)",
            f"g{d} AS (SELECT {keys}, {', '.join(f'CASE WHEN wild THEN chr(42) ELSE m{d} END AS m{d}' if c == f'm{d}' else c for c in m)} FROM {last} LEFT JOIN w{d} USING ({above}, m{d}))",
        ]
        last = f"g{d}"
    full = ["host", *m, "rest"]
    for d in range(DEPTH, 0, -1):
        others = ", ".join(c for c in full if c != f"m{d}")
        ctes += [
            f"l{d} AS (SELECT {', '.join(full)}, sum(l)::double AS ll, sum(b)::double AS bb FROM {last} GROUP BY ALL)",
            f"q{d} AS (SELECT {others}, count(*) AS k, sum(ll) AS pl, sum(bb) AS pb FROM l{d} GROUP BY ALL)",
            f"x{d} AS (SELECT {', '.join(full)}, true AS merge_ FROM l{d} JOIN q{d} USING ({others}) WHERE k > 1 AND NOT coalesce(ll >= {LEAST} AND abs(bb / nullif(ll, 0) - pb / nullif(pl, 0)) > {Z} * sqrt((pb / nullif(pl, 0)) * (1 - pb / nullif(pl, 0)) * (1.0::double / nullif(ll, 0) - 1.0::double / nullif(pl, 0))), false))",
            f"y{d} AS (SELECT {keys}, {', '.join(f'CASE WHEN merge_ THEN chr(42) ELSE m{d} END AS m{d}' if c == f'm{d}' else c for c in m)} FROM {last} LEFT JOIN x{d} USING ({', '.join(full)}))",
        ]
        last = f"y{d}"
    ctes += [
        f"st AS (SELECT {', '.join(full)}, sum(l) AS nl, 1 - (sum(b) + {WEIGHT}::double * max(prior)) / (sum(l) + {WEIGHT}::double) AS purity FROM {last}, prior GROUP BY {', '.join(full)})",
        f"kn AS (SELECT host, {', '.join(s)}, rest, regexp_replace(concat_ws('/', {', '.join(m)}, rest), '/+$', '') AS template, purity, CASE WHEN nl > 0 AND purity < {LEAST_PURITY} THEN 'block' ELSE 'allow' END AS learned FROM {last} JOIN st USING ({', '.join(full)}))",
    ]
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, learned, 'allow') AS verdict, template, round(purity, 6) AS purity FROM rows_ LEFT JOIN kn USING (host, {', '.join(s)}, rest)"
