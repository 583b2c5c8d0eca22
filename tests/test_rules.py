"""Rule-source cases: what each source must and must not report."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusops.operators import rule_findings, rules
from corpusops.operators import rules_text as rt
from corpusops.plans import registry
from corpusops.plans.rules import sources

SAMPLE = """@ Sample rule @
Definir Numero nCod;
Definir Alfa aNome;
Definir Data dIni;
Definir Numero nQtd;
Definir Alfa aMsg;
Definir Cursor cFun;
/* reads
   employees */
nCod = NumEmp;
cFun.SQL "SELECT NUMCAD, NOMFUN FROM R034FUN WHERE NUMEMP = :nCod";
cFun.AbrirCursor();
Enquanto (cFun.Achou)
Inicio
  aNome = R034FUN.NomFun;
  nQtd = nQtd + 1;
  cFun.Proximo();
Fim;
cFun.FecharCursor();
DataHoje(dIni);
IntParaAlfa(nQtd, aMsg);
TamanhoAlfa(aNome, nCod);
Mensagem(Retorna, aMsg);
"""

STRUCTURE = [
    ("brace", "{ x = 1;", [("error", rt.OPENING_BRACE, 0)]),
    ("closing brace", "x = 1; }", [("error", rt.CLOSING_BRACE, 0)]),
    ("string", 'a = "abc;', [("error", rt.OPEN_STRING, 0)]),
    ("char", "a = 'abc;", [("warning", rt.OPEN_STRING, 0)]),
    ("block", "Inicio\n x = 1;", [("error", rt.LONE_INICIO, 0)]),
    ("lone fim", "x = 1;\nFim;", [("error", rt.LONE_FIM, 1)]),
    ("declaration", "Definir Numero nX", [("warning", rt.NO_SEMICOLON, 0)]),
    ("block comment", "x = 1; /* open\nmore", [("error", rt.OPEN_BLOCK, 0)]),
    ("at comment", "x;\n@ open\nmore", [("error", rt.OPEN_AT, 1)]),
    ("continued string", 'c.SQL "SELECT A \\\n FROM B";\nx = 1;', []),
    ("continued with comment", 'c.SQL "SELECT A \\ - note\n WHERE B \\\n = 1";', []),
    ("char literals", "a = 'x'; b = '\\';", []),
    ("words inside names", "nInicioFim = 1; xFim = 2; Inicio_1 = 3;", []),
    ("comment in line", "x = 1; @ Inicio { @ y = 2; /* \" */ z = 3;", []),
    ("escaped quote", 'a = "x \\" y";', []),
    ("empty", "", []),
    ("sample", SAMPLE, []),
]


def test_structure(spark):
    df = spark.createDataFrame([(n, s) for n, s, _ in STRUCTURE], "file string, source string")
    got = {}
    for r in rules.structure(df).collect():
        got.setdefault(r["file"], []).append((r["severity"], r["message"], r["line"]))
    for name, _, want in STRUCTURE:
        assert sorted(got.get(name, [])) == sorted(want), name


@pytest.fixture(scope="module")
def sample(spark):
    df = spark.createDataFrame([("s", SAMPLE)], "file string, source string")
    return df, rules.scan(df)


def test_sample_names(sample):
    df, scanned = sample
    decl = rules.declarations(rules.parse(scanned)).collect()
    assert sorted(r["name"] for r in decl if r["kind"] == "variable") == ["aMsg", "aNome", "cFun", "dIni", "nCod", "nQtd"]
    assert [r["name"] for r in decl if r["kind"] == "cursor"] == ["cFun"]
    tokens = rules.tokenize(scanned)
    assert {r["value"] for r in rules.used_words(tokens, "builtinFunction").collect()} == {
        "DataHoje", "IntParaAlfa", "TamanhoAlfa", "Mensagem"}
    assert {r["value"] for r in rules.used_words(tokens, "systemVariable").collect()} == {"NumEmp"}
    assert df.select(rules.sql_texts(F.col("source"))).first()[0] == [
        "SELECT NUMCAD, NOMFUN FROM R034FUN WHERE NUMEMP = :nCod"]
    assert df.select(rules.table_refs(F.col("source"))).first()[0] == ["R034FUN"]
    assert [tuple(r)[1:] for r in rules.field_refs(df).collect()] == [("R034FUN", "NomFun")]
    assert rules.semantic(rules.parse(scanned)).count() == 0


SEMANTIC = [
    ("undeclared", "nX = 1;", ["Undeclared variable 'nX'"]),
    ("system", "x = NumEmp; Definir Numero x;", []),
    ("field", "Definir Numero x;\nx = R034FUN.NumCad;", []),
    ("prefix", "Definir Numero x;\nx = GerSolExa_Algo;", []),
    ("duplicate", "Definir Numero x;\nDefinir Alfa X;", ["Duplicate variable declaration 'X'"]),
    ("arity", "Definir Numero x;\nMensagem(Erro);", ["Function 'Mensagem': expected 2 args, got 1"]),
    ("nested", "Definir Numero x;\nMensagem(Erro, (1 + x), Nada(x, 2));",
     ["Function 'Mensagem': expected 2 args, got 3", "Unknown function 'Nada'", "Undeclared variable 'Nada'"]),
    ("no arguments", "DataHoje();", ["Function 'DataHoje': expected 1 args, got 0"]),
    ("range", 'Concatena("a", "b");', ["Function 'Concatena': expected 3-10 args, got 2"]),
    ("own function", "Definir Funcao Minha(a);\nMinha(1, 2);", ["Undeclared variable 'a'"]),
    ("cycle", 'Definir Cursor c;\nc.SQL "S";\nc.AbrirCursor();\nc.FecharCursor();', []),
    ("no sql", "Definir Cursor c;\nc.AbrirCursor();\nc.FecharCursor();", ["Cursor 'c' opened without SQL set"]),
    ("left open", 'Definir Cursor c;\nc.SQL "S";\nc.AbrirCursor();', ["Cursor 'c' was never closed"]),
    ("closed twice", 'Definir Cursor c;\nc.SQL "S";\nc.AbrirCursor();\nc.FecharCursor();\nC.FecharCursor();',
     ["Cursor 'c' closed without being open"]),
    ("tested", "Definir Cursor c;\nSe (c.Achou)\n c.Proximo();",
     ["Cursor 'c' tested without being open", "Cursor 'c': Proximo() without open cursor"]),
    ("endless", 'Definir Cursor c;\nc.SQL "S";\nc.AbrirCursor();\nEnquanto (c.Achou)\nInicio\n Se (1 = 1)\n Inicio\n Fim;\nFim;\nc.Proximo();\nc.FecharCursor();',
     ["While loop with 'c.Achou' without 'c.Proximo()'"]),
    ("inner next", 'Definir Cursor c;\nc.SQL "S";\nc.AbrirCursor();\nEnquanto (c.Achou)\nInicio\n Se (1 = 1)\n Inicio\n c.Proximo();\n Fim;\nFim;\nc.FecharCursor();', []),
]


def test_semantic(spark):
    df = spark.createDataFrame([(n, s) for n, s, _ in SEMANTIC], "file string, source string")
    got = {}
    for r in rules.semantic(rules.parse(rules.scan(df))).collect():
        got.setdefault(r["file"], []).append(r["message"])
    for name, _, want in SEMANTIC:
        found = sorted(got.get(name, []))
        assert len(found) == len(want), (name, found)
        for w in want:
            assert any(w in f for f in found), (name, found)


def test_tokens_cover_the_text():
    lines = SAMPLE.split("\n")
    for kind, value, line, start, end in rt.tokens(SAMPLE):
        assert lines[line][start:end].replace(" ", "") == value.replace(" ", ""), (kind, value)


def test_member_of_table_is_one_token():
    kinds = [(t[0], t[1]) for t in rt.tokens("R034FUN.NumCad = c.SQL;")]
    assert kinds[0] == ("tableReference", "R034FUN.NumCad")
    assert ("cursorMethod", "SQL") in kinds


def test_summary(spark):
    df = spark.createDataFrame([("ok", "x;"), ("bad", "{")], "file string, source string")
    per_file = rules.summary(df, rules.structure(df))
    assert {r["file"]: r["status"] for r in per_file.collect()} == {"ok": "ok", "bad": "fail"}
    assert rules.batch_summary(per_file).first()["fail"] == 1


def test_token_rows_give_back_every_source(spark, sf):
    got = {}
    for r in registry.QUERIES["rul_token_rows"](spark, sf).collect():
        got.setdefault(r["file"], []).append(r)
    files = {r["file"]: r["source"] for r in sources(spark, sf).collect()}
    assert set(got) == set(files)
    for file, source in files.items():
        lines = [" " * len(line) for line in source.split("\n")]
        for t in got[file]:
            text, end = lines[t["line"]], t["start"] + len(t["value"])
            assert text[t["start"] : end].strip() == ""  # no token lies over another
            lines[t["line"]] = text[: t["start"]] + t["value"] + text[end:]
        assert lines == source.split("\n")
    kinds = {t["type"] for ts in got.values() for t in ts}
    assert {"keyword", "number", "operator", "punctuation", "comment", "identifier", "cursorMethod", "string"} <= kinds


def relational(df):
    return rules.structure(df).unionByName(rules.semantic(rules.parse(rules.scan(df))))


def test_findings_of_one_pass_are_those_of_the_checks(spark):
    """Sources thrown together from the words the checks look at, so that blocks, calls and cursors are broken in all ways."""
    rnd = random.Random(17)
    words = ["Definir Cursor cA;", "Definir Cursor CA;", "Definir cursor cB;", "Definir Numero nX;", "Definir Alfa", "Definir Funcao FnY(x);", "Funcao FnZ();", "Inicio", "Fim;", "Se (nX = 1)",
             "Senao", "Enquanto (cA.Achou)", "Enquanto (cb.Achou)", "Enquanto (nX < 3 e 1 = 1 e 2 = 2 e cA.Achou)", "Enquanto", "cA.Achou", "cA.Proximo();", "cB.Proximo()",
             'cA.SQL "SELECT 1";', "CA.AbrirCursor();", "cA.FecharCursor();", "cB.NaoAchou", "cC.AbrirCursor();", "Mensagem(Erro);", "Mensagem(Erro, (1, 2), nX);", "FnY(1", ")", "(", ",", "DataHoje();",
             "nUnknown = 1;", "R034FUN.NumCad", "gersolexa_x", "\n", "\n", "@ note @", '"text"', "{", "}"]
    rows = [(f"f{i:03d}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 45)))) for i in range(400)]
    rows += [("sample", SAMPLE), ("empty", ""), ("null", None)]
    df = spark.createDataFrame(rows, "file string, source string").repartition(4).cache()
    got = rule_findings.findings(df).select("file", F.explode("findings").alias("f")).select("file", "f.*")
    want = Counter(map(tuple, relational(df).collect()))
    assert Counter(map(tuple, got.collect())) == want
    assert len({re.sub("'[^']*'|[0-9-]+", "", w[2]) for w in want if w[1] == "warning"}) >= len(rules.MESSAGES)
    per_file = {r.file: tuple(r)[1:] for r in rule_findings.summary(rule_findings.findings(df)).collect()}
    assert per_file == {r.file: tuple(r)[1:] for r in rules.summary(df, relational(df)).collect()}


def test_summary_reads_its_sources_once(spark, sf):
    plan = registry.QUERIES["rul_summary"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("LogicalRelation") <= 1


def test_every_check_reads_a_source_once(spark):
    """The scan stands once in a plan, above the exchange that deals the sources over the cores."""
    df = spark.createDataFrame([("a", "Definir Cursor c;\nc.Proximo();\nMensagem(NumEmp);")], "file string, source string").repartition(2, "file")
    parsed, tokens = rules.parse(rules.scan(df)), rules.tokenize(rules.scan(df))
    found = [rules.used_words(tokens, "systemVariable"), tokens, rules.declarations(parsed), *[check(parsed) for check in rules.CHECKS]]
    for frame in found:
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "REPARTITION_BY_NUM" in plan.split("ArrowEvalPython")[1]


def test_loops_and_cursors_of_one_scan(spark):
    """A move before the block or of another cursor is none; a cursor left open is told once, under its last spelling."""
    loop = "Definir Cursor cA;\nDefinir Cursor cB;\nca.SQL \"x\";\nca.AbrirCursor();\ncA.Proximo();\nEnquanto (cA.Achou)\nInicio\n  %s.Proximo();\nFim;\n"
    df = spark.createDataFrame([("other", loop % "cB"), ("own", loop % "CA"), ("late", loop % "cB" + "cA.Proximo();")], "file string, source string")
    parsed = rules.parse(rules.scan(df))
    assert sorted(r["file"] for r in rules.loops_without_next(parsed).collect()) == ["late", "other"]
    left = [(r["file"], r["message"]) for r in rules.cursor_lifecycle(parsed).collect() if r["line"] == 0]
    assert sorted(left) == [(f, rules.MESSAGES["left"] % ("cA", "cA")) for f in ("late", "other", "own")]


def test_no_words_and_null_sources_have_no_tokens(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "file string, source string")
    assert [(r["file"], r["n"], r["value"]) for r in rules.tokenize(rules.scan(df)).collect()] == [("c", 0, "x")]
