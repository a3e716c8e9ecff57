"""The small tables: cue phrases, section headings, semantic types, excluded texts. All of fixed size, kept as data files."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATA = Path(__file__).resolve().parent.parent / "data"


@lru_cache
def rows(name: str) -> tuple[tuple[str, ...], ...]:
    with open(DATA / f"{name}.tsv", encoding="utf-8") as f:
        return tuple(tuple(line.rstrip("\n").split("\t")) for line in f)


def respell(phrase: str) -> str:
    """A phrase as the tokenizer spells it: ``cannot``, possessives and slashes fall into several tokens."""
    out: list[str] = []
    for word in phrase.casefold().split():
        if word == "cannot":
            out += ["can", "not"]
        elif word.endswith("'s") and len(word) > 2:
            out += [word[:-2], "'s"]
        elif "/" in word and len(word) > 1:
            out += [x for x in word.replace("/", " / ").split(" ") if x]
        else:
            out.append(word)
    return " ".join(out)


def lexicon(attribute: str | None = None, role: str | None = None) -> list[tuple[str, str, str]]:
    return [r for r in rows("lexicon") if attribute in (None, r[0]) and role in (None, r[1])]


def sections() -> list[tuple[str, str, bool]]:
    return [(p, s, n == "1") for p, s, n in rows("sections")]


def excluded_texts() -> list[str]:
    return sorted({w for kind, w in rows("exclusions") if kind in ("closed_class", "unwanted")})


def not_rare() -> list[str]:
    return sorted({w for kind, w in rows("exclusions") if kind == "not_rare"})


def whitelist() -> list[str]:
    return [r[0] for r in rows("tui") if r[4] == "1"]


def lexicon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, r, p, len(p.split(" "))) for a, r, p in lexicon()], "attr string, role string, phrase string, len int")


def section_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sections(), "phrase string, section string, is_negative boolean")


def tui_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, n, g, int(c), w == "1") for t, n, g, c, w in rows("tui")], "tui string, name string, grp string, grp_code int, in_whitelist boolean")


def _constant(value: dict, kind: str) -> Column:
    """A constant map. It is written as one JSON literal, which the optimiser folds; spelled out entry by entry, its thousands of
    nodes would be walked by every rule of every plan."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def phrase_map() -> Column:
    """A constant map from a phrase's first token to all phrases that begin with it."""
    by: dict[str, list[dict]] = {}
    for a, r, p in sorted(lexicon()):
        by.setdefault(p.split(" ")[0], []).append({"attr": a, "role": r, "phrase": p, "n": len(p.split(" "))})
    return _constant(by, "map<string,array<struct<attr:string,role:string,phrase:string,n:int>>>")


def section_map() -> Column:
    return _constant({p: s for p, s, _ in sections()}, "map<string,string>")
