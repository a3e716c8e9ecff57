"""The engine on small notes, and its queries against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.functions import text as T
from wardlens.functions.lexicons import lexicon, respell
from wardlens.operators import adjudicate, assertion, coordination, dictionary, evaluate, lookup, sections, warehouse
from wardlens.plans import catalog
from wardlens.streaming.notes import analyze, stream

SF = "/root/testdata/sf0.001"
TERMS = ["fever", "chills", "pain", "pneumonia", "diabetes mellitus", "diabetes", "chest pain", "culture", "obstruction", "myocardial infarction", "sepsis", "insomnia", "dextrose", "water", "copd", "hypoglycemia"]


@pytest.fixture(scope="module")
def index(spark):
    terms = spark.createDataFrame([(t, t, "C%04d" % i, "SAB", "PT") for i, t in enumerate(TERMS)], "norm string, text string, cui string, sab string, tty string")
    concept = spark.createDataFrame([("C%04d" % i, t, "DISORDER") for i, t in enumerate(TERMS)], "cui string, preferred_text string, best_group string")
    return dictionary.rare_word_index(terms).persist(), concept


CASES = [
    ("Patient denies fever and chills.", "negated", {"fever": True, "chills": True}),
    ("Patient reports pain, no fever.", "negated", {"pain": False, "fever": True}),
    ("Pneumonia was ruled out.", "negated", {"pneumonia": True}),
    ("No fever but pain present.", "negated", {"fever": True, "pain": False}),
    ("Pneumonia has not been ruled out.", "negated", {"pneumonia": False}),
    ("Chronic airway obstruction, not elsewhere classified, since 2009.", "negated", {"obstruction": False}),
    ("Urine culture negative.", "negated", {"culture": True}),
    ("Patient with h/o diabetes mellitus.", "history_of", {"diabetes mellitus": True}),
    ("Diabetes mellitus, resolved.", "history_of", {"diabetes mellitus": True}),
    ("History of COPD but now diabetes mellitus is new.", "history_of", {"copd": True, "diabetes mellitus": False}),
    ("Mother with diabetes mellitus.", "subject", {"diabetes mellitus": "family_member"}),
    ("Myocardial infarction in her father.", "subject", {"myocardial infarction": "family_member"}),
    ("Wife found patient with hypoglycemia.", "subject", {"hypoglycemia": "patient"}),
    ("Possible sepsis, but confirmed pneumonia on culture.", "uncertain", {"sepsis": True, "pneumonia": False}),
    ("Pneumonia can not be excluded.", "uncertain", {"pneumonia": True}),
    ("Findings consistent with prior pneumonia.", "uncertain", {"pneumonia": False}),
    ("Call the office if you develop chest pain.", "conditional", {"chest pain": True}),
    ("We asked if he had chest pain.", "conditional", {"chest pain": False}),
    ("Bisacodyl 10 mg Rectal Daily PRN . Dextrose in water 50% Intravenous.", "conditional", {"dextrose": False, "water": False}),
]


def test_assertion_cases(spark, index):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id int, text string")
    got = {(r.doc_id, r.term): r for r in analyze(docs, *index, assertion.profile(conditional=True)).collect()}
    for i, (text, attr, want) in enumerate(CASES):
        for term, value in want.items():
            assert getattr(got[i, term], attr) == value, (text, term, attr)


def test_unassessed_is_null(spark, index):
    docs = spark.createDataFrame([(1, "No fever."), (2, "  "), (3, None)], "doc_id int, text string")
    (r,) = analyze(docs, *index, assertion.profile(subject=False, history=False, uncertain=False)).collect()
    assert (r.negated, r.subject, r.history_of, r.uncertain, r.conditional, r.generic) == (True, None, None, None, None, None)


def test_configuration():
    with pytest.raises(ValueError):
        assertion.profile("none")
    with pytest.raises(ValueError):
        assertion.profile(max_scope=-1)
    assert assertion.profile("clinical_recall").drop_header_mentions and assertion.profile().assessed == ("negated", "subject", "history_of", "uncertain")


@pytest.mark.parametrize(("text", "split", "want"), [("x-ray", True, ["x", "-", "ray"]), ("x-ray", False, ["x-ray"]), ("crohn's", True, ["crohn", "'s"]), ("o'brien 500.", True, ["o'brien", "500", "."])])
def test_tokenizer(spark, text, split, want):
    (r,) = spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t"), split).alias("k")).collect()
    assert [k.text for k in r.k] == want and all(text[k.start : k.end] == k.text for k in r.k)


def test_long_text_offsets(spark):
    text = " ".join(f"w{i}'s," for i in range(500))
    (r,) = spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t")).alias("k")).collect()
    assert len(r.k) == 1500 and all(text[k.start : k.end] == k.text for k in r.k) and [k.i for k in r.k] == list(range(1500))


def test_lexicons_are_respelled():
    assert respell("cannot exclude") == "can not exclude" and respell("h/o") == "h / o" and respell("patient's") == "patient 's"
    assert all(respell(p) == p for _, _, p in lexicon())


def test_overlaps(spark):
    m = spark.createDataFrame([(1, 0, 0, 5, "A"), (1, 0, 0, 12, "B"), (1, 0, 6, 10, "C"), (1, 0, 0, 12, "D"), (1, 0, 12, 15, "E")], "doc_id int, win int, start int, end int, cui string")
    assert {r.cui for r in lookup.resolve_overlaps(m).collect()} == {"B", "D", "E"}


def test_coordination_and_clauses(spark):
    # "denies pain, chills and reports pneumonia": chills hangs on pain, reports on denies.
    words = [("denies", "VBZ", "ROOT", -1), ("pain", "NN", "dobj", 0), (",", ",", "punct", 1), ("chills", "NNS", "conj", 1), ("and", "CC", "cc", 0), ("reports", "VBZ", "conj", 0), ("pneumonia", "NN", "dobj", 5)]
    w = spark.createDataFrame([(1, 0, [(i, t, t, 0, 0, p, True, d, h) for i, (t, p, d, h) in enumerate(words)], None, None)], f"doc_id int, win int, tokens array<{T.TOKEN}>, section string, header_end int")
    m = spark.createDataFrame([(1, 0, c, c, 0, 1, s, s + 1, "", "") for c, s in (("pain", 1), ("chills", 3), ("pneumonia", 6))], "doc_id int, win int, cui string, term string, start int, end int, tok_start int, tok_end int, preferred_text string, grp string")
    run = lambda **k: {r.cui: r.negated for r in assertion.assess_windows(w, m, assertion.profile(**k)).collect()}
    assert run(max_scope=1, clause_bounding=False) == {"pain": True, "chills": True, "pneumonia": False}
    assert run(max_scope=1, coordination=False) == {"pain": True, "chills": False, "pneumonia": False}
    assert run(coordination=False, clause_bounding=False)["pneumonia"] and not run()["pneumonia"]
    assert coordination.JOINED == ("appos", "conj")


def test_alignment_is_greedy(spark):
    s = "doc_id int, begin int, end int, cui string, value boolean, order int"
    g = spark.createDataFrame([(1, 0, 10, "A", True, 1), (1, 5, 9, "A", False, 2), (1, 30, 40, "A", True, 3), (2, 0, 5, "B", None, 1)], s)
    p = spark.createDataFrame([(1, 4, 10, "A", True, 1), (1, 0, 6, "A", True, 2), (1, 50, 60, "A", True, 3)], s)
    got = {(r.begin, r.doc_id): r.p_begin for r in evaluate.align(g, p).collect()}
    assert got == {(0, 1): 0, (5, 1): 4, (30, 1): None, (0, 2): None}
    scores = {r.doc_id: r for r in evaluate.attribute_scores(evaluate.align(g, p)).collect()}
    assert (scores[1].aligned, scores[1].unaligned, scores[1].tp, scores[1].fp, scores[2].aligned, scores[2].f1) == (2, 1, 1, 1, 0, 0.0)


def test_estimates_with_known_answers(spark):
    pop = spark.createDataFrame([("both_positive", 1000, 10), ("engine_only", 100, 10)], "stratum string, population long, sampled long")
    counts = spark.createDataFrame([("both_positive", 10, 10), ("engine_only", 0, 10)], "stratum string, positives long, judged long")
    (e,) = adjudicate.reweighted(counts, pop).collect()
    assert round(e.precision, 3) == 0.909 and e.recall == 1.0
    (b,) = adjudicate.bootstrap(counts, pop, times=200).collect()
    assert b.precision_lo == b.precision_hi == pytest.approx(1000 / 1100)  # rates of 0 and 1 don't vary


def test_verdicts_are_checked(spark):
    v = spark.createDataFrame([("a", " Negated "), ("b", ""), ("c", "unclear")], "case_id string, verdict string")
    assert {(r.case_id, r.verdict, r.attribute) for r in adjudicate.read_verdicts(v, ["negated", "affirmed"]).collect()} == {("a", "negated", "negated"), ("c", "unclear", "negated")}
    with pytest.raises(Exception, match="unknown verdict"):
        adjudicate.read_verdicts(spark.createDataFrame([("a", "maybe")], "case_id string, verdict string"), ["negated"]).collect()


def test_sql_surface_refuses_writes(spark):
    with pytest.raises(ValueError):
        warehouse.read_only_sql(spark, "DROP TABLE x", {})


def test_unaligned_dictionary_is_refused(spark):
    with pytest.raises(ValueError):
        dictionary.check_aligned(spark.createDataFrame([("sources", "all")], "key string, value string"))


def test_stream_equals_batch(spark, index, tmp_path):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), *index, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    cols = ["doc_id", "cui", "start", "negated", "subject", "history_of", "uncertain"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, analyze(docs, *index).select(*cols).collect()))


def test_section_state(spark):
    text = "Family History: fever.\nStable.\nWound Care:\nFever.\n1. Allergies: none"
    w = sections.with_sections(T.windows(spark.createDataFrame([(1, text)], "doc_id int, text string"))).orderBy("win").collect()
    assert [r.section for r in w if r.win < 3] == ["family_history"] * 3 and w[-2].section == w[-1].section == "allergies" or w[-1].section == "allergies"


@pytest.mark.parametrize("name", ["windows_notes", "sections_notes", "dictionary_rare_term", "lookup_notes", "annotations_all", "review_estimate"])
def test_queries_agree_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(catalog.ORACLE[name]).df()
    assert sorted(want.columns) == cols
    plain = lambda x: None if x is None or x != x else bool(x) if isinstance(x, (bool, np.bool_)) else x if isinstance(x, str) else round(float(x), 6)
    key = lambda rows: sorted(str([plain(x) for x in r]) for r in rows)
    assert key(map(tuple, df.select(*cols).toPandas().itertuples(index=False))) == key(want[cols].itertuples(index=False))


def test_assessed_spans_are_those_of_all_notes(spark):
    """Every span of every note once, with the attributes that the engine gives it itself."""
    got = catalog.QUERIES["assessed_spans"](spark, SF).collect()
    want = catalog.annotated(spark, SF).select("doc_id", "start", "end", "cui", "term", "negated", "subject", "uncertain").collect()
    assert {r.doc_id % 3 for r in want} == {0, 1, 2} and all(r.assessed for r in got)
    assert sorted((r.span_id, r.negated, r.subject, r.uncertain) for r in got) == sorted((f"{r.doc_id}:{r.start}:{r.end}:{r.cui}:{r.term}", r.negated, r.subject, r.uncertain) for r in want)


def test_strict_overlaps(spark):
    m = spark.createDataFrame([(1, 0, 0, 5, "A"), (1, 0, 0, 12, "D"), (1, 0, 0, 12, "B"), (1, 0, 12, 15, "E")], "doc_id int, win int, start int, end int, cui string")
    assert {r.cui for r in lookup.resolve_overlaps(m, coextensive=False).collect()} == {"B", "E"}


def test_batch_isolates_what_fails(spark, index):
    from wardlens.streaming.notes import analyze_batch

    docs = spark.createDataFrame([("a", "No fever."), ("b", None), ("c", "x" * 40), ("d", "")], "doc_id string, text string")
    got = {r.doc_id: r for r in analyze_batch(docs, *index, assertion.profile(max_chars=20)).collect()}
    assert [got[k].error for k in "abcd"] == [None, "NoText", "TextTooLong", None]
    assert [a.term for a in got["a"].annotations] == ["fever"] and got["d"].annotations == [] and got["b"].annotations is None


def test_explained(spark, index):
    from wardlens.operators import explain

    docs = spark.createDataFrame([(1, "History of diabetes. Past Medical History: Copd."), (2, "Mother with diabetes.")], "doc_id int, text string")
    a = analyze(docs, *index, assertion.profile("clinical_recall"))
    got = {(r.rule, r.label) for r in explain.explained(a, "history_of").collect()}
    assert ("cue", "history of (forward)") in got and ("section", "past_medical_history") in got
    assert {(r.rule, r.label) for r in explain.explained(a, "subject").collect()} == {("cue", "mother (forward)")}
    x = spark.createDataFrame([(2, 0, "mother", 12, 20)], "doc_id int, win int, cue string, start int, end int")
    (r,) = explain.cue_examples(x, docs, T.windows(docs).select("doc_id", F.posexplode("windows").alias("win", "tokens"))).collect()
    assert (r.cue, r.n, r.examples[0].mention, r.examples[0].sentence) == ("mother", 1, "diabetes", "Mother with diabetes.")


def test_attribute_registry():
    from wardlens import attributes

    assert attributes.names(True) == ("negated", "subject", "history_of", "uncertain") and attributes.scorable("conditional") == ("conditional",)
    assert attributes.attribute("negated").verdicts == ("negated", "affirmed", "unclear") and "prototype" in attributes.attribute("conditional").caveat()
    with pytest.raises(KeyError, match="negated"):
        attributes.attribute("nothing")
    with pytest.raises(ValueError):
        attributes.scorable("generic")


def test_stages_of_the_dictionary(spark):
    conso = spark.createDataFrame([("C1", "ENG", "Y", "RXNORM", "PT", "X-ray of head", "N")], "cui string, lat string, ispref string, sab string, tty string, str string, suppress string")
    sty = spark.createDataFrame([("C1", "T047")], "cui string, tui string")
    said = []
    assert dictionary.run_stages(conso, sty, dry=True, log=said.append) == {} and said == list(dictionary.STAGES)
    out = dictionary.run_stages(conso, sty, log=said.append)
    assert [r.norm for r in out["term"].collect()] == ["x - ray of head"] and out["rare_term"].count() == 1
    with pytest.raises(ValueError):
        dictionary.run_stages(conso, sty, only="index")
    with pytest.raises(ValueError):
        dictionary.run_stages(conso, sty, first="nothing")
    said = []
    dictionary.retokenize(out["term"], log=said.append)
    assert said == ["pass 1: 0 terms respelled"]
