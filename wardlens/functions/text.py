"""Text as columns: tokens with code-point offsets, sentence windows, normalisation. No Python runs on a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
#: A possessive stands in for two private characters while the text is cut, so that no lookahead is needed.
_MARK = "\ue000\ue001"
PIECE = rf"{_SPACE}*({_MARK}|[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}']*|[^\s\p{{Z}}\x0b\x1c-\x1f\x85])"
PIECE_WITH_HYPHENS = rf"{_SPACE}*([\p{{L}}\p{{N}}][\p{{L}}\p{{N}}'-]*|[^\s\p{{Z}}\x0b\x1c-\x1f\x85])"
BLOCK = 32
TOKEN = "struct<i:int,text:string,norm:string,start:int,end:int,pos:string,is_word:boolean,dep:string,head:int>"


def casefold(c: Column) -> Column:
    """Full case folding of what lower() leaves: sharp s, long s, final sigma, Latin ligatures."""
    for a, b in (("ß", "ss"), ("ẞ", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(F.lower(c), "ſς", "sσ")


def dictionary_norm(c: Column) -> Column:
    """Case folded, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(casefold(c), r"\s+", " "))


def strip_semantic_tag(c: Column) -> Column:
    """'Fever (finding)' to 'Fever': a last bracket of at most 40 characters after at least three others."""
    base = F.regexp_extract(c, r"^(.+?)\s*\([^()]{1,40}\)$", 1)
    return F.when(F.length(base) >= 3, base).otherwise(c)


def _cut(text: Column, split_hyphens: bool, group: int) -> Column:
    """All pieces of a text in one pass: with the white space before them (group 0) or without (group 1)."""
    source = F.replace(text, F.lit("'s"), F.lit(_MARK)) if split_hyphens else text
    return F.regexp_extract_all(source, F.lit(PIECE if split_hyphens else PIECE_WITH_HYPHENS), F.lit(group))


def _shown(words: Column) -> Column:
    """Possessives as they were. White space never stands in a word, so the words of a text are handled as one string."""
    return F.when(F.size(words) == 0, words).otherwise(F.split(F.replace(F.array_join(words, "\n"), F.lit(_MARK), F.lit("'s")), "\n"))


def _norms(words: Column) -> Column:
    return F.when(F.size(words) == 0, words).otherwise(F.split(casefold(F.array_join(words, "\n")), "\n"))


def _ends(pieces: Column) -> Column:
    """Where each piece ends: sums of lengths, in blocks of BLOCK pieces, so a long text costs its length, not its square."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pieces) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.transform(F.slice(pieces, b * BLOCK + 1, BLOCK), lambda x: F.length(x)))
    running = F.transform(blocks, lambda b: F.aggregate(b, F.expr("cast(array() AS array<int>)"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))

    def shifted(runs: Column) -> Column:
        first = F.aggregate(runs, F.array(F.lit(0)), lambda a, r: F.array_append(a, F.element_at(a, -1) + F.coalesce(F.try_element_at(r, F.lit(-1)), F.lit(0))))
        return _let(first, lambda f: F.flatten(F.transform(runs, lambda r, k: F.transform(r, lambda x: x + F.get(f, k)))))

    return _let(running, shifted)


def tokens(text: Column, split_hyphens: bool = True) -> Column:
    """array<struct<i, text, norm, start, end, is_word>>, offsets in code points."""

    def made(words: Column, ends: Column, norms: Column) -> Column:
        return F.transform(words, lambda w, i: F.struct(i.cast("int").alias("i"), w.alias("text"), F.get(norms, i).alias("norm"), (F.get(ends, i) - F.length(w)).alias("start"), F.get(ends, i).alias("end"), is_word(w).alias("is_word")))

    ends = _let(_cut(text, split_hyphens, 0), _ends)
    words = _shown(_cut(text, split_hyphens, 1)) if split_hyphens else _cut(text, split_hyphens, 1)
    return _let(words, lambda w: _let(ends, lambda e: _let(_norms(w), lambda n: made(w, e, n))))


def is_word(word: Column) -> Column:
    return word.rlike(r"\p{L}")


def fenced(value: Column) -> Column:
    """The value, in a form that filters are not pushed through: pushed, they would compute it again for every name they use."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts_content(text: Column) -> Column:
    """First character is upper case or a digit."""
    return text.rlike(r"^[\p{Lu}\p{Nd}]")


def windows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, win, tokens: sentences, in the row that holds the text.

    A window ends after ``.``, ``!`` or ``?`` before white space, at a line's end, and after a colon that content follows.
    Token numbers begin again in each window; offsets stay those of the document. A text without tokens has no window."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", fenced(_cut(text, True, 0)).alias("_p"), fenced(_shown(_cut(text, True, 1))).alias("_w"))
    df = df.select("doc_id", "_p", "_w", fenced(_ends(F.col("_p"))).alias("_b"), fenced(_norms(F.col("_w"))).alias("_n"))

    def ends(word: Column, i: Column) -> Column:
        nxt, piece = F.get("_w", i + 1), F.get("_p", i + 1)
        stop = word.isin(".", "!", "?") & (F.length(piece) > F.length(nxt))
        label = word.endswith(":") & starts_content(nxt)
        return F.coalesce(stop | piece.contains("\n") | label, F.lit(True))

    marks = F.filter(F.transform("_w", lambda w, i: F.when(ends(w, i), i + 1)), lambda x: x.isNotNull())
    df = df.withColumn("_e", fenced(marks))

    def token(i: Column, first: Column) -> Column:
        w, e = F.get("_w", i), F.get("_b", i)
        return F.struct(
            (i - first).cast("int").alias("i"), w.alias("text"), F.get("_n", i).alias("norm"), (e - F.length(w)).alias("start"), e.alias("end"), F.lit(None).cast("string").alias("pos"), is_word(w).alias("is_word"), F.lit("").alias("dep"), F.lit(-1).alias("head")
        )

    parts = F.transform("_e", lambda e, k: _let(F.coalesce(F.get("_e", k - 1), F.lit(0)), lambda first: F.transform(F.sequence(first, e - 1), lambda i: token(i, first))))
    return df.select("doc_id", fenced(parts).alias("windows"))


def display(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")
