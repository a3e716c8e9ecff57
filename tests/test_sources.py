"""Readers and writers on small files."""

import json

import pytest

from wardlens.functions.lexicons import tui_table
from wardlens.sources import readers, writers

XMI = """<?xml version="1.0"?><xmi:XMI xmlns:xmi="x"><cas:Sofa xmi:id="1" sofaString="Fever &amp; chills"/>
<refsem:UmlsConcept xmi:id="10" codingScheme="S" cui="C1" tui="T184" preferredText="Fever"/><refsem:UmlsConcept xmi:id="11" codingScheme="S" cui="C2" tui="T184" preferredText="Chills"/>
<cas:FSArray xmi:id="20" elements="10 11"/>
<textsem:SignSymptomMention xmi:id="30" begin="0" end="5" polarity="-1" uncertainty="1" conditional="false" generic="false" subject="patient" historyOf="0" ontologyConceptArr="10"/>
<textsem:SignSymptomMention xmi:id="31" begin="8" end="14" ontologyConceptArr="20" polarity="1"/></xmi:XMI>"""


def test_text_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n1.TXT").write_bytes(b"caf\xc3\xa9 \xff end")
    (tmp_path / "n2.note").write_text("two")
    (tmp_path / "skip.csv").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert got == {"n1.TXT": "café � end", "n2.note": "two"}


def test_release_files(spark, tmp_path):
    row = ["C1", "ENG", "", "", "", "", "Y", "", "", "", "", "MSH", "PT", "", "Fever", "", "N", "", ""]
    (tmp_path / "c").write_text("|".join(row) + "\nshort|line\n")
    (r,) = readers.conso(spark, str(tmp_path / "c")).collect()
    assert (r.cui, r.lat, r.ispref, r.sab, r.tty, r.str, r.suppress) == ("C1", "ENG", "Y", "MSH", "PT", "Fever", "N")
    (tmp_path / "s").write_text("C1|T184|A|B|C|D|\nC2|T1\n")
    assert [(r.cui, r.tui) for r in readers.sty(spark, str(tmp_path / "s")).collect()] == [("C1", "T184")]


def test_sql_script(spark, tmp_path):
    (tmp_path / "s").write_text("INSERT INTO PREFTERM VALUES(12,'Crohn''s disease')\nINSERT INTO OTHER VALUES(1,'x')\nINSERT INTO PREFTERM VALUES(13)\n")
    t = readers.sql_script(spark, str(tmp_path / "s"), "PREFTERM", ["cui", "text"])
    assert [(r.cui, r.text) for r in t.select(readers.cui_text(t.cui).alias("cui"), "text").collect()] == [("C0000012", "Crohn's disease")]


def test_xml_exports(spark, tmp_path):
    (tmp_path / "d.xmi").write_text(XMI)
    got = {(r.begin, r.cui): r for r in readers.xml_exports(spark, str(tmp_path)).collect()}
    assert set(got) == {(0, "C1"), (8, "C1"), (8, "C2")}
    assert got[0, "C1"].negated and got[0, "C1"].uncertain and got[0, "C1"].text == "Fever" and got[8, "C2"].text == "chills" and not got[8, "C2"].negated


def test_records(spark, tmp_path):
    m = {"type": "S", "text": "fever", "begin": 0, "end": 5, "negated": True, "concepts": [{"cui": "C1", "tui": "T184"}, {"cui": None}]}
    (tmp_path / "r.jsonl").write_text(json.dumps({"source_file": "a", "text": "fever", "mentions": [m]}) + "\n")
    (r,) = readers.flatten_records(readers.records(spark, str(tmp_path / "r.jsonl")), tui_table(spark)).collect()
    assert (r.cui, r.grp, r.negated, r.uncertain) == ("C1", "FINDING", True, None)


def test_csv_notes(spark, tmp_path):
    (tmp_path / "n.csv").write_text("note_id,note_text\na/1,x\na?1,y\nb,z\n")
    got = readers.csv_notes(spark, str(tmp_path / "n.csv"), "note_id", "note_text").collect()
    assert len({r.doc_id for r in got}) == 3 and {r.text for r in got} == {"x", "y", "z"}
    with pytest.raises(ValueError):
        readers.csv_notes(spark, str(tmp_path / "n.csv"), "note_id", "none")


def test_run_folder(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s1", "No fever"), (2, "s2", "none")], "doc_id int, source string, text string")
    a = spark.createDataFrame([(1, "C1", 3, 8, "FINDING", True, "patient", False, None, None, None, "Fever", "fever")], "doc_id int, cui string, start int, end int, grp string, negated boolean, subject string, history_of boolean, uncertain boolean, conditional boolean, generic boolean, preferred_text string, term string")
    out = writers.write_run(a, docs, str(tmp_path), {"profile": "default"})
    got = {r.source: len(r.annotations) for r in spark.read.json(out + "/annotations").collect()}
    assert got == {"s1": 1, "s2": 0} and "default" in spark.read.text(out + "/manifest").first()[0]
    assert writers.listing(a, docs).first().line == "3:8 C1 FINDING fever NEGATED"


XMI = """<?xml version="1.0"?><xmi:XMI xmlns:xmi="x"><cas:Sofa xmi:id="1" sofaString="No fever.&#10;Pain"/>
<textspan:Sentence xmi:id="2" begin="0" end="9"/><textspan:Sentence xmi:id="3" begin="10" end="14"/>
<syntax:WordToken xmi:id="4" begin="3" end="8" partOfSpeech="NN"/><syntax:NewlineToken xmi:id="5" begin="9" end="10"/>
<refsem:UmlsConcept xmi:id="7" cui="C1" tui="T184" codingScheme="S" preferredText="Fever"/>
<textsem:SignSymptomMention xmi:id="6" begin="3" end="8" polarity="-1" ontologyConceptArr="7"/></xmi:XMI>"""


def test_silver_records(spark, tmp_path):
    from wardlens.sources import readers, writers

    for name in ("a.txt", "b.txt"):
        (tmp_path / f"{name}.xmi").write_text(XMI)
    got = {r.source_file: r for r in readers.silver_records(spark, str(tmp_path)).collect()}
    r = got["a.txt"]
    assert set(got) == {"a.txt", "b.txt"} and r.text == "No fever.\nPain" and r.sentences == [[0, 9], [10, 14]] and r.tokens == [[3, 8], [9, 10]]
    assert r.mentions[0].negated and [c.cui for c in r.mentions[0].concepts] == ["C1"] and r.pos_tokens[0] == ["3", "8", "WordToken", "NN"]
    only = readers.silver_records(spark, str(tmp_path), spark.createDataFrame([("b.txt",)], "stem string"))
    writers.silver_jsonl(only, str(tmp_path / "out"))
    again = readers.annotation_table(spark, str(tmp_path / "out")).collect()
    assert [(a.document, a.cui, a.start, a.negated) for a in again] == [("b.txt", "C1", 3, True)]


def test_import_of_a_script(spark, tmp_path):
    from wardlens.sources import readers

    (tmp_path / "s.script").write_text("\n".join(["CREATE TABLE X", "INSERT INTO CUI_TERMS VALUES(12,0,1,'it''s','it''s')", "INSERT INTO CUI_TERMS VALUES(12,0)", "INSERT INTO PREFTERM VALUES(12,'It')", "INSERT INTO TUI VALUES(12,47)"]))
    d = readers.import_script(spark, str(tmp_path / "s.script"))
    assert [tuple(r) for r in d["rare_term"].collect()] == [("it's", "it's", "C0000012", 0, 1)]
    assert {r.table: r.skipped for r in d["skipped"].collect()} == {"CUI_TERMS": 1, "PREFTERM": 0, "TUI": 0}
    assert [(r.cui, r.tui) for r in d["concept_tui"].collect()] == [("C0000012", "T047")] and d["concept"].first().preferred_text == "It"


def test_designs_and_names(spark, tmp_path):
    import json

    import pytest

    from wardlens.sources import readers, writers

    p = spark.createDataFrame([("both_positive", 10, 2)], "stratum string, population long, sampled long")
    s = spark.createDataFrame([("x", "both_positive")], "case_id string, stratum string")
    text = writers.design_json(p, s, "negated", 3, {"max_scope": 8})
    assert writers.read_design(text)["population"] == {"both_positive": 10} and json.loads(text)["seed"] == 3
    for bad in ('{"nothing": 1}', '{"population": {"both_negated": 1}}'):
        with pytest.raises(ValueError):
            writers.read_design(bad)
    f = writers.file_names(spark.createDataFrame([("a b",), ("a_b",), ("..",)], "source string"))
    assert {r.source: r.file for r in f.collect()} == {"a b": "a_b", "a_b": "a_b-2", "..": "note"} and writers.safe_name("a/b c") == "a_b_c"
    writers.review_sheet(s, str(tmp_path / "sheet"))
    parts = [p.read_bytes() for p in (tmp_path / "sheet").glob("*.csv") if p.stat().st_size]
    assert parts and all(p.startswith(b"\xef\xbb\xbfcase_id,stratum") for p in parts)
    b = readers.browse({"t": spark.createDataFrame([(1, "x")], "id int, text string")}, texts=False)
    assert b["t"]["rows"] == 1 and b["t"]["first"].columns == ["id"]


def test_command_line(spark, tmp_path, capsys):
    import io

    from wardlens.cli import main

    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.txt").write_text("No fever. Pain.")
    spark.createDataFrame([(t, t, f"C{i}", 0, 1) for i, t in enumerate(("fever", "pain"))], "rare_word string, norm string, cui string, word_index int, token_count int").write.parquet(str(tmp_path / "d/rare_term"))
    spark.createDataFrame([("C0", "Fever", "FINDING"), ("C1", "Pain", "FINDING")], "cui string, preferred_text string, best_group string").write.parquet(str(tmp_path / "d/concept"))
    call = lambda *a: (main([*a, "--dictionary", str(tmp_path / "d")], spark, out := io.StringIO()), out.getvalue())
    code, text = call(str(tmp_path / "n"))
    assert code == 0 and text.splitlines()[0] == "3:8 C0 FINDING fever NEGATED" and len(text.splitlines()) == 2
    assert call(str(tmp_path / "n" / "a.txt"), "--affirmed")[1].startswith("10:14 C1")
    assert '"annotations":[{"start":3' in call(str(tmp_path / "n"), "--json", "--negated")[1]
    assert call(str(tmp_path / "none"))[0] == 2 and call(str(tmp_path / "n"), "--negated", "--affirmed")[0] == 2
    assert main([str(tmp_path / "n"), "--dictionary", str(tmp_path / "none")], spark, io.StringIO()) == 1
    assert main([str(tmp_path / "n"), "--dictionary", str(tmp_path / "d"), "--run-root", str(tmp_path / "runs")], spark) == 0
    assert list((tmp_path / "runs").glob("*/manifest/*.txt"))
