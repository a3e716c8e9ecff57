"""Cues, scopes and the assertion attributes of matches, decided in the row of a window.

The decision and its evidence come from the same arrays. Attributes that aren't assessed are null, never false.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import phrase_map
from ..functions.text import _let
from .sections import negative_findings

NEGATION_CAP = 8
HISTORY_CAPS, HEDGE_CAPS = (4, 4), (6, 4)
FAMILY_HEADER_CAP, KINSHIP_CAPS = 10, (4, 4)
CLAUSE_CAP, INDICATION_CAP = 8, 4
CANDIDATE_HISTORY_SECTIONS = ("family_history", "past_medical_history", "past_surgical_history", "social_history")
_FAR = 1 << 30
ATTRIBUTES = ("negated", "subject", "history_of", "uncertain", "conditional")


@dataclass(frozen=True)
class Config:
    """Switches. An attribute that is off comes out as null."""

    max_scope: int | None = NEGATION_CAP
    coordination: bool = True
    clause_bounding: bool = True
    sections: bool = True
    resolve_overlaps: bool = False
    subject: bool = True
    subject_self_reference: bool = True
    history: bool = True
    history_sections: tuple[str, ...] = ()
    history_self_reference: bool = False
    uncertain: bool = True
    conditional: bool = False
    drop_header_mentions: bool = False
    groups: tuple[str, ...] | None = None
    max_chars: int = 1_000_000

    def __post_init__(self):
        if self.max_scope is not None and self.max_scope < 0:
            raise ValueError("max_scope must not be negative")
        if self.max_chars < 1:
            raise ValueError("max_chars must be at least 1")

    @property
    def assessed(self) -> tuple[str, ...]:
        on = {"negated": True, "subject": self.subject, "history_of": self.history, "uncertain": self.uncertain, "conditional": self.conditional}
        return tuple(a for a in ATTRIBUTES if on[a])


PROFILES = {
    "default": Config(),
    "clinical_recall": Config(history_sections=CANDIDATE_HISTORY_SECTIONS, drop_header_mentions=True),
}


def profile(name: str = "default", **overrides) -> Config:
    if name not in PROFILES:
        raise ValueError(f"no profile {name!r}: there are {', '.join(sorted(PROFILES))}")
    return replace(PROFILES[name], **overrides)


def phrase_spans(tokens: Column) -> Column:
    """Every span that spells a lexicon's phrase: array<struct<attr, role, phrase, s, e>>."""

    def at(norms: Column, norm: Column, i: Column) -> Column:
        some = F.coalesce(F.try_element_at(phrase_map(), norm), F.expr("cast(array() AS array<struct<attr:string,role:string,phrase:string,n:int>>)"))
        real = F.filter(some, lambda p: F.concat_ws(" ", F.slice(norms, i + 1, p["n"])) == p["phrase"])
        return F.transform(real, lambda p: F.struct(p["attr"].alias("attr"), p["role"].alias("role"), p["phrase"].alias("phrase"), i.cast("int").alias("s"), (i + p["n"]).cast("int").alias("e")))

    return _let(F.transform(tokens, lambda t: t["norm"]), lambda norms: F.flatten(F.transform(norms, lambda n, i: at(norms, n, i))))


def of_role(spans: Column, attr: str, *roles: str) -> Column:
    return F.filter(spans, lambda x: (x["attr"] == attr) & x["role"].isin(*roles))


def live_cues(spans: Column, attr: str, *roles: str) -> Column:
    """Cues that no pseudo cue of the same attribute overlaps."""
    pseudo = of_role(spans, attr, "pseudo")
    return F.filter(of_role(spans, attr, *roles), lambda c: ~F.exists(pseudo, lambda p: (p["s"] < c["e"]) & (c["s"] < p["e"])))


def scopes(cues: Column, stops: Column, n: Column, forward: bool, cap: Column | int | None) -> Column:
    """Capped (s, e) and uncapped (o_s, o_e) token range of each cue."""
    cap = F.lit(_FAR) if cap is None else cap if isinstance(cap, Column) else F.lit(cap)

    def one(c: Column) -> Column:
        if forward:
            stop = F.coalesce(F.array_min(F.transform(F.filter(stops, lambda t: t["s"] >= c["e"]), lambda t: t["s"])), n)
            first, last, low, high = c["e"], F.least(stop, n, c["e"] + cap), c["e"], F.least(stop, n)
        else:
            stop = F.coalesce(F.array_max(F.transform(F.filter(stops, lambda t: t["e"] <= c["s"]), lambda t: t["e"])), F.lit(0))
            first, last, low, high = F.greatest(stop, c["s"] - cap, F.lit(0)), c["s"], F.greatest(stop, F.lit(0)), c["s"]
        return F.struct(
            c["phrase"].alias("cue"), c["s"].alias("c_s"), c["e"].alias("c_e"), F.lit("forward" if forward else "backward").alias("dir"), first.cast("int").alias("s"), last.cast("int").alias("e"), low.cast("int").alias("o_s"), high.cast("int").alias("o_e")
        )

    return F.transform(cues, one)


def both(spans: Column, attr: str, n: Column, stops: Column, caps, forward=("forward",), backward=("backward",)) -> Column:
    return F.concat(scopes(live_cues(spans, attr, *forward), stops, n, True, caps[0]), scopes(live_cues(spans, attr, *backward), stops, n, False, caps[1]))


def covering(m: Column, scope_array: Column) -> Column:
    return F.filter(scope_array, lambda s: (s["s"] <= m["tok_start"]) & (m["tok_end"] <= s["e"]))


def non_word_stops(tokens: Column) -> Column:
    bad = F.filter(tokens, lambda t: ~t["is_word"])
    return F.transform(bad, lambda t: F.struct(t["i"].alias("s"), (t["i"] + 1).alias("e")))


def _ranges(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def assess_windows(windows: DataFrame, matches: DataFrame, config: Config = Config()) -> DataFrame:
    """windows (doc_id, win, tokens, section, header_end) and matches to one row a match with its attributes and causes.

    Only windows with matches are looked at. One shuffle by (doc_id, win) brings them together."""
    from .coordination import clause_boundaries, negation_outer

    names = [c for c in matches.columns if c not in ("doc_id", "win")]
    grouped = matches.groupBy("doc_id", "win").agg(F.collect_list(F.struct(*names)).alias("ms"))
    w = windows.join(grouped, ["doc_id", "win"])
    if config.drop_header_mentions:
        w = w.withColumn("ms", F.filter("ms", lambda m: F.col("header_end").isNull() | (m["end"] > F.col("header_end"))))
    if config.resolve_overlaps:
        from .lookup import longest_non_overlapping

        w = w.withColumn("ms", longest_non_overlapping(F.col("ms")))
    section = F.col("section") if config.sections else F.lit(None).cast("string")
    w = w.withColumn("_n", F.size("tokens")).withColumn("_sec", section).withColumn("_sp", phrase_spans(F.col("tokens")))
    sp, n = F.col("_sp"), F.col("_n")
    cap = F.when(negative_findings(F.col("_sec")), F.lit(None).cast("int")).otherwise(F.lit(config.max_scope).cast("int"))
    cap = F.coalesce(cap, F.lit(_FAR))
    neg_stops = _ranges(of_role(sp, "negated", "terminator"))
    if config.clause_bounding:
        neg_stops = F.concat(neg_stops, clause_boundaries(F.col("tokens")))
    cols = {"_neg": both(sp, "negated", n, neg_stops, (cap, cap))}
    if config.subject:
        stops = _ranges(of_role(sp, "subject", "terminator", "patient"))
        family = F.concat(
            scopes(live_cues(sp, "subject", "header"), stops, n, True, FAMILY_HEADER_CAP), scopes(live_cues(sp, "subject", "kinship"), stops, n, True, KINSHIP_CAPS[0]), scopes(live_cues(sp, "subject", "kinship"), stops, n, False, KINSHIP_CAPS[1])
        )
        cols |= {"_fam": family, "_famcue": _ranges(live_cues(sp, "subject", "header", "kinship"))}
        cols["_famall"] = F.coalesce(F.col("_sec") == "family_history", F.lit(False)) & (F.size(of_role(sp, "subject", "patient")) == 0)
    if config.history:
        stops = _ranges(of_role(sp, "history", "terminator"))
        cols |= {"_his": both(sp, "history", n, stops, HISTORY_CAPS), "_hiscue": _ranges(of_role(sp, "history", "forward", "backward"))}
        claimed = F.col("_sec").isin(*config.history_sections) if config.history_sections else F.lit(False)
        cols["_hisall"] = F.coalesce(claimed, F.lit(False)) & (F.size(of_role(sp, "history", "terminator")) == 0)
    if config.uncertain:
        cols["_unc"] = both(sp, "uncertain", n, _ranges(of_role(sp, "uncertain", "terminator")), HEDGE_CAPS)
    if config.conditional:
        stops = _ranges(of_role(sp, "conditional", "terminator"))
        cols["_con"] = F.concat(
            scopes(live_cues(sp, "conditional", "clause"), stops, n, True, CLAUSE_CAP), scopes(live_cues(sp, "conditional", "indication"), F.concat(stops, non_word_stops(F.col("tokens"))), n, True, INDICATION_CAP)
        )
    w = w.withColumns(cols)
    if config.coordination:
        w = w.withColumn("_ext", negation_outer(F.col("tokens"), F.col("_neg")))
    else:
        w = w.withColumn("_ext", F.expr("cast(null AS array<struct<ok:array<int>,o_s:int,o_e:int>>)"))
    m = F.col("m")
    # The window's arrays are dropped before its matches are multiplied with anything else: decisions are made per match inside.
    carried = [c for c in w.columns if c.startswith("_") and c not in ("_sp", "_n")]
    e = w.select("doc_id", "win", "section", "tokens", *carried, F.explode("ms").alias("m"))
    from .coordination import negation_causes

    causes = {"negated": negation_causes(m, F.col("_neg"), F.col("_ext"), F.col("tokens"))}
    out = {"negated": F.size(causes["negated"]) > 0}
    if config.subject:
        c = covering(m, F.col("_fam"))
        own = F.exists("_famcue", lambda x: (x["s"] < m["tok_end"]) & (m["tok_start"] < x["e"])) if config.subject_self_reference else F.lit(False)
        out["subject"] = F.when((F.size(c) > 0) | own | F.col("_famall"), "family_member").otherwise("patient")
        causes["subject"] = c
    if config.history:
        c = covering(m, F.col("_his"))
        own = F.exists("_hiscue", lambda x: (x["s"] < m["tok_end"]) & (m["tok_start"] < x["e"])) if config.history_self_reference else F.lit(False)
        out["history_of"] = (F.size(c) > 0) | own | F.col("_hisall")
        causes["history_of"] = c
    for on, name, col in ((config.uncertain, "uncertain", "_unc"), (config.conditional, "conditional", "_con")):
        if on:
            causes[name] = covering(m, F.col(col))
            out[name] = F.size(causes[name]) > 0
    nothing = {"subject": F.lit(None).cast("string")} | {a: F.lit(None).cast("boolean") for a in ("history_of", "uncertain", "conditional")}
    cue = "array<struct<cue:string,dir:string>>"
    evidence = [F.transform(causes[a], lambda s: F.struct(s["cue"].alias("cue"), s["dir"].alias("dir"))).cast(cue).alias(f"{a}_causes") if a in causes else F.lit(None).cast(cue).alias(f"{a}_causes") for a in ATTRIBUTES]
    e = e.select("doc_id", "win", "section", "m.*", *[(out.get(a, nothing.get(a))).alias(a) for a in ATTRIBUTES], F.lit(None).cast("boolean").alias("generic"), *evidence)
    return e.where(F.col("grp").isin(*config.groups)) if config.groups is not None else e
