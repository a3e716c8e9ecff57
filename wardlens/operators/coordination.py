"""The rules that read a dependency parse: clause boundaries, coordination closure and the head rule of negation.

They use the tokens' ``dep``, ``head`` (index in the window, -1 for none) and ``pos``; without a parse they change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JOINED = ("appos", "conj")
MODIFIERS = ("amod", "compound", "det", "nmod", "nummod", "poss", "punct")


def clause_boundaries(tokens: Column) -> Column:
    """A verb joined to a verb by ``conj`` begins a clause: (i, i + 1) stops scopes."""
    own = F.filter(tokens, lambda t: (t["dep"] == "conj") & (t["head"] >= 0) & F.coalesce(t["pos"].startswith("VB"), F.lit(False)) & F.coalesce(F.get(tokens, t["head"])["pos"].startswith("VB"), F.lit(False)))
    return F.transform(own, lambda t: F.struct(t["i"].alias("s"), (t["i"] + 1).alias("e")))


def _labels(tokens: Column) -> Column:
    """For each token the least index of its component over conj and appos edges; one round a token settles any chain."""
    linked = F.filter(tokens, lambda t: t["dep"].isin(*JOINED) & (t["head"] >= 0))

    def spread(labels: Column) -> Column:
        return F.transform(
            labels,
            lambda x, i: F.array_min(
                F.concat(
                    F.array(x),
                    F.transform(F.filter(linked, lambda t: t["i"] == i), lambda t: F.get(labels, t["head"])),
                    F.transform(F.filter(linked, lambda t: t["head"] == i), lambda t: F.get(labels, t["i"])),
                )
            ),
        )

    first = F.transform(tokens, lambda t: t["i"])
    return F.aggregate(linked, first, lambda labels, _: spread(labels))


def negation_outer(tokens: Column, scopes: Column) -> Column:
    """For each scope the tokens it reaches by coordination: those of components that it touches, with their modifiers, clipped
    to the uncapped range. Null where no token has a dependency: then the plain ranges decide."""
    parsed = F.exists(tokens, lambda t: t["dep"] != "")
    labels = _labels(tokens)

    def reach(s: Column) -> Column:
        inside = F.filter(tokens, lambda t: (t["i"] >= s["s"]) & (t["i"] < s["e"]))
        joined = F.filter(tokens, lambda t: t["dep"].isin(*JOINED) & (t["head"] >= 0))
        in_component = lambda t: F.exists(joined, lambda j: F.get(labels, j["i"]) == F.get(labels, t["i"]))
        touched = F.transform(F.filter(inside, in_component), lambda t: F.get(labels, t["i"]))
        members = F.filter(tokens, lambda t: F.array_contains(touched, F.get(labels, t["i"])) & in_component(t))
        member_ids = F.transform(members, lambda t: t["i"])
        children = F.filter(tokens, lambda t: t["dep"].isin(*MODIFIERS) & F.array_contains(member_ids, t["head"]))
        ids = F.array_union(F.array_union(F.transform(inside, lambda t: t["i"]), member_ids), F.transform(children, lambda t: t["i"]))
        return F.filter(ids, lambda i: (i >= s["o_s"]) & (i < s["o_e"]))

    return F.when(parsed, F.transform(scopes, lambda s: F.struct(reach(s).alias("ok"), s["o_s"].alias("o_s"), s["o_e"].alias("o_e"))))


def span_head(m: Column, tokens: Column) -> Column:
    """The first token of the span whose head lies outside it, else its first token."""
    out = F.filter(tokens, lambda t: (t["i"] >= m["tok_start"]) & (t["i"] < m["tok_end"]) & ~((t["head"] >= m["tok_start"]) & (t["head"] < m["tok_end"])))
    return F.coalesce(F.array_min(F.transform(out, lambda t: t["i"])), m["tok_start"])


def negation_causes(m: Column, scopes: Column, reach: Column, tokens: Column) -> Column:
    """Scopes that cover the whole match or, with a parse, its head while the match lies in the uncapped range."""

    def covered(s: Column, k: Column) -> Column:
        plain = (s["s"] <= m["tok_start"]) & (m["tok_end"] <= s["e"])
        x = F.get(reach, k)
        whole = F.forall(F.sequence(m["tok_start"], m["tok_end"] - 1), lambda i: F.array_contains(x["ok"], i))
        head = F.array_contains(x["ok"], span_head(m, tokens)) & (x["o_s"] <= m["tok_start"]) & (m["tok_end"] <= x["o_e"])
        return F.when(reach.isNull(), plain).otherwise(whole | head)

    return F.filter(scopes, covered)
