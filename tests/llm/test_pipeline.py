"""The pipeline against a plain Python version of its five stages, on documents made to try each of them."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from wardlens.llm import near_dedup, pii
from wardlens.llm.quality_rules import RULES, STOP_WORDS

SF = "/root/testdata/sf0.001"
KEY = "a key of the tests"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def good(t):
    """Quality rules, one document at a time."""
    w = words(t)
    n = len(w)
    seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    hit = {i + k for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    if n < 20 or 100 * len(hit) > 30 * n:
        return False
    lines = [x for x in t.split("\n") if words(x)]
    m = {"word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_stop_words": sum(x.lower() in STOP_WORDS for x in w), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_words": n}
    for _, rule, least, low, high in RULES:
        top, bottom = rule.split(" / ")
        value = m[top] / m[bottom]
        if n >= least and (low is not None and value < low or high is not None and value > high):
            return False
    return True


def without_copies(docs):
    """The least doc_id of each group of documents that links of similarity 0.8 join."""
    sets = {}
    for d, t in docs.items():
        w = words(t.translate(LOW))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: t for d, t in docs.items() if find(d) == d}


def leaked(t, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    w = pattern.findall(t.translate(LOW))
    keys = {tuple(x[i : i + 13]) for x in (pattern.findall(i.translate(LOW)) for i in items) for i in range(max(1, len(x) - 12))} - {()}
    hit = set()
    for k in keys:
        hit |= {i + j for i in range(len(w) - len(k) + 1) if tuple(w[i : i + len(k)]) == k for j in range(len(k))}
    run = longest = 0
    for i in range(len(w)):
        run = run + 1 if i in hit else 0
        longest = max(longest, run)
    return longest >= 13 or hit and 20 * len(hit) >= len(w)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", *(f"word{i}" for i in range(300))], n, p=[0.1, 0.1, 0.1, *[0.7 / 300] * 300])) + "."


def made():
    rng = np.random.default_rng(11)
    item = " ".join(f"quest{i}" for i in range(30)) + "?"
    texts = [prose(rng, int(n)) for n in rng.integers(30, 200, 24)]
    texts += [texts[3], texts[3] + " tail", texts[4].replace("the", "The"), texts[5] + " " + " ".join(texts[6].split()[:9])]
    texts += [prose(rng, 2000) + " " + item + " " + prose(rng, 900)]  # a long document with one passage
    texts += [prose(rng, 60) + " " + " ".join(item.split()[4:17]) + " " + prose(rng, 60), prose(rng, 60) + " " + " ".join(item.split()[4:16]) + " " + prose(rng, 400)]
    texts += [prose(rng, 50) + " Mr. John Smith, john.smith@mail.example.com, +1 (724) 555-7058. Smith left.", None, "", "too short", "spam spam " * 40, "## $$ %% " * 30 + prose(rng, 30)]
    texts += [prose(rng, 6000)]
    return [(i, t, "en" if i % 3 else None, None, None if t is None else len(t)) for i, t in enumerate(texts)], [item, "one two three"]


def test_run_equals_plain_python(spark, tmp_path):
    rows, items = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {d: t for d, t, *_ in rows if t is not None and good(t)}
    assert 20 < len(want) < len(rows)
    some = without_copies(want)
    assert len(some) < len(want)
    clean = {d: t for d, t in some.items() if not leaked(t, items)}
    assert len(some) - len(clean) == 2
    replaced = {d: pii.Surrogates(KEY.encode()).replace(t)[0] for d, t in clean.items()}
    assert sum(replaced[d] != clean[d] for d in clean) == 1
    spark.conf.set("spark.wardlens.pii.key", KEY)
    try:
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.wardlens.pii.key")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(clean)
    for d, pieces in by.items():
        ids = np.array(tok.encode(replaced[d], add_special_tokens=False).ids + [1], "<u4")
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces]
        assert {p.doc_tokens for p in pieces} == {len(ids)} == {sum(p.length for p in pieces)}
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))] and sum(p.length for p in pieces) <= 2048


def test_stages_keep_the_columns(spark):
    """On nothing at all, and with the columns of documents in another order."""
    empty = spark.createDataFrame([], "source string, text string, doc_id long, n_chars int, lang string, h long, maybe string")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == empty.columns


def test_no_secret_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in pii.stage(docs).join(docs.selectExpr("doc_id", "text AS old"), "doc_id").collect():
        for m in re.findall(r"[\w.+-]+@[\w.-]+\.\w+|AKIA[0-9A-Z]{16}|\+1 \(\d{3}\) \d{3}-\d{4}", r.old):
            assert m not in r.text


def test_unlike_copies_make_no_table_of_pairs_in_the_dedup_stage(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["t%d" % i for i in range(120)]
    texts = [" ".join(w if rng.random() > q else "x%d" % rng.integers(1 << 40) for w in words) for q in rng.uniform(0.0, 0.1, 250)]
    most, write = [], near_dedup.written

    def counted(df, name):
        out = write(df, name)
        most.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    kept = corpus_pipeline.dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").count()
    assert 20 < kept < len(texts) and max(most) <= 30 * len(texts)
