"""Rule-source queries. Every order becomes a rule source whose lines, and so whose faults,
follow from the order's columns; texts and turns serve where any text will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators import rule_corpus as corpus
from corpusops.operators import rule_findings, rules
from corpusops.plans.registry import query
from corpusops.tables import documents, spread, table


def sources(spark: SparkSession, sf: str) -> DataFrame:
    c, lit = F.col, F.lit
    status, priority = c("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    even = c("o_custkey") % 2 == 0
    lines = [
        F.concat(lit("@ Rule "), c("o_orderkey"), lit(" @")),
        lit("Definir Cursor cCur;"),
        lit("Definir Numero nVal;"),
        F.when(priority == "1", "Definir Numero nVal;").otherwise("Definir Alfa aTxt;"),
        F.when(status == "O", "").otherwise('cCur.SQL "SELECT NUMCAD FROM R034FUN WHERE NUMEMP = 1";'),
        lit("cCur.AbrirCursor();"),
        lit("Enquanto (cCur.Achou)"),
        lit("Inicio"),
        F.when(priority == "5", "  nOther = NumEmp;").otherwise("  nVal = nVal + R034FUN.NumCad;"),
        F.when(even, "  cCur.Proximo();").otherwise(""),
        lit("Fim;"),
        F.when(status == "F", "cCur.FecharCursor();").otherwise(""),
        F.when(priority == "2", "Mensagem(Erro);").when(priority == "3", 'Mensagem(Erro, "x");')
        .when(priority == "4", "FooBar(1, (2 + 3));").otherwise("Definir Funcao FnX(x);"),
        F.when(priority == "5", 'aTxt = "abc;').when(priority == "4", "Definir Data dDia").otherwise("{ nVal = 1; }"),
    ]
    orders = spread(table(spark, sf, "orders"), "o_orderkey")
    return orders.select(F.concat(lit("RULE"), c("o_orderkey"), lit(".rule")).alias("file"),
                         F.concat_ws("\n", *lines).alias("source"))


_F = """o AS (SELECT 'RULE' || o_orderkey || '.rule' AS file, o_orderkey AS k, o_orderstatus AS st, substring(o_orderpriority, 1, 1) AS pr,
  o_custkey % 2 = 0 AS even FROM orders)"""


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return rules.tokenize(rules.scan(sources(spark, sf)))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return rules.parse(rules.scan(sources(spark, sf)))


@query("rul_tokens", f"""WITH {_F},
n AS (SELECT file, 1 AS comment,
  -- identifiers: cCur, nVal, and those of the lines that differ
  2 + CASE WHEN pr = '1' THEN 1 ELSE 1 END + CASE WHEN st = 'O' THEN 0 ELSE 1 END + 2 + CASE WHEN pr = '5' THEN 1 ELSE 2 END
    + CASE WHEN even THEN 1 ELSE 0 END + CASE WHEN st = 'F' THEN 1 ELSE 0 END
    + CASE pr WHEN '4' THEN 1 WHEN '2' THEN 0 WHEN '3' THEN 0 ELSE 2 END + 1 AS identifier,
  2 + CASE WHEN st = 'O' THEN 0 ELSE 1 END + CASE WHEN even THEN 1 ELSE 0 END + CASE WHEN st = 'F' THEN 1 ELSE 0 END AS cursorMethod,
  CASE WHEN st = 'O' THEN 0 ELSE 1 END + CASE WHEN pr IN ('3', '5') THEN 1 ELSE 0 END AS string,
  CASE WHEN pr = '5' THEN 0 ELSE 1 END AS tableReference,
  CASE WHEN pr = '5' THEN 1 ELSE 0 END AS systemVariable,
  CASE WHEN pr IN ('2', '3') THEN 1 ELSE 0 END AS builtinFunction FROM o)
SELECT * FROM (UNPIVOT n ON comment, identifier, cursorMethod, string, tableReference, systemVariable, builtinFunction INTO NAME type VALUE n) WHERE n > 0""")
def rul_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens per file and type, without the punctuation, keywords, numbers and operators; rul_token_rows has all of them."""
    kinds = ["comment", "identifier", "cursorMethod", "string", "tableReference", "systemVariable", "builtinFunction"]
    return _tokens(spark, sf).filter(F.col("type").isin(kinds)).groupBy("file", "type").agg(F.count(F.lit(1)).alias("n"))


# The lines of ``sources`` cut by hand: line, condition, its tokens between middle dots, and their types by first letter
# (m: cursorMethod, v: systemVariable).
_KINDS = {"k": "keyword", "i": "identifier", "p": "punctuation", "s": "string", "m": "cursorMethod", "t": "tableReference",
          "v": "systemVariable", "b": "builtinFunction", "n": "number", "o": "operator"}
_CUT = [
    (1, "true", "Definir· ·Cursor· ·cCur·;", "kkip"),
    (2, "true", "Definir· ·Numero· ·nVal·;", "kkip"),
    (3, "pr = '1'", "Definir· ·Numero· ·nVal·;", "kkip"),
    (3, "pr <> '1'", "Definir· ·Alfa· ·aTxt·;", "kkip"),
    (4, "st <> 'O'", 'cCur·.·SQL· ·"SELECT NUMCAD FROM R034FUN WHERE NUMEMP = 1"·;', "ipmsp"),
    (5, "true", "cCur·.·AbrirCursor·(·)·;", "ipmppp"),
    (6, "true", "Enquanto· ·(·cCur·.·Achou·)", "kpipmp"),
    (7, "true", "Inicio", "k"),
    (8, "pr = '5'", "  ·nOther· ·=· ·NumEmp·;", "iovp"),
    (8, "pr <> '5'", "  ·nVal· ·=· ·nVal· ·+· ·R034FUN.NumCad·;", "ioiotp"),
    (9, "even", "  ·cCur·.·Proximo·(·)·;", "ipmppp"),
    (10, "true", "Fim·;", "kp"),
    (11, "st = 'F'", "cCur·.·FecharCursor·(·)·;", "ipmppp"),
    (12, "pr = '2'", "Mensagem·(·Erro·)·;", "bpkpp"),
    (12, "pr = '3'", 'Mensagem·(·Erro·,· ·"x"·)·;', "bpkpspp"),
    (12, "pr = '4'", "FooBar·(·1·,· ·(·2· ·+· ·3·)·)·;", "ipnppnonppp"),
    (12, "pr NOT IN ('2', '3', '4')", "Definir· ·Funcao· ·FnX·(·x·)·;", "kkipipp"),
    (13, "pr = '5'", 'aTxt· ·=· ·"abc;', "ios"),
    (13, "pr = '4'", "Definir· ·Data· ·dDia", "kki"),
    (13, "pr NOT IN ('4', '5')", "{· ·nVal· ·=· ·1·;· ·}", "pionpp"),
]


def _cut_sql(line: int, when: str, cut: str, kinds: str) -> str:
    parts = cut.split("·")
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    found = [(s, v) for s, v in zip(starts, parts) if v.strip()]
    rows = ", ".join(f"({s}, '{_KINDS[k]}', '{v}')" for (s, v), k in zip(found, kinds, strict=True))
    return f"SELECT file, {line}, t.* FROM o, (VALUES {rows}) t WHERE {when}"


@query("rul_token_rows", f"""WITH {_F}
SELECT file, 0 AS line, 0 AS start, 'comment' AS type, '@ Rule ' || k || ' @' AS value FROM o
UNION ALL {" UNION ALL ".join(_cut_sql(*c) for c in _CUT)}""")
def rul_token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every token of every file, of all types, with its place and value."""
    return _tokens(spark, sf).select("file", "line", "start", "type", "value")


@query("rul_structure", f"""WITH {_F}
SELECT file, 'error' AS severity, 'String não fechada (Unclosed string literal)' AS message, 13 AS line, 7 AS start, 12 AS "end" FROM o WHERE pr = '5'
UNION ALL SELECT file, 'warning', 'Falta ponto-e-vírgula após declaração Definir (Missing semicolon after Definir statement)', 13, 16, 17 FROM o WHERE pr = '4'""")
def rul_structure(spark: SparkSession, sf: str) -> DataFrame:
    return rules.structure(sources(spark, sf))


@query("rul_decls", f"""WITH {_F}
SELECT file, 'variable' AS kind, 'cCur' AS name, 'cursor' AS declared, 1 AS line FROM o
UNION ALL SELECT file, 'cursor', 'cCur', 'cursor', 1 FROM o
UNION ALL SELECT file, 'variable', 'nVal', 'numero', CASE WHEN pr = '1' THEN 3 ELSE 2 END FROM o
UNION ALL SELECT file, 'variable', 'aTxt', 'alfa', 3 FROM o WHERE pr <> '1'
UNION ALL SELECT file, 'variable', 'dDia', 'data', 13 FROM o WHERE pr = '4'
UNION ALL SELECT file, 'function', 'FnX', NULL, 12 FROM o WHERE pr NOT IN ('2', '3', '4')""")
def rul_decls(spark: SparkSession, sf: str) -> DataFrame:
    return rules.declarations(_parsed(spark, sf))


@query("rul_table_refs", """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(replace(text, 'th', 'r123'), '[Rr]\\d{3}[A-Za-z_]\\w*'),
  lambda t: upper(substring(t, 1, 4)) || substring(t, 5)))), ',') AS refs FROM documents""")
def rul_table_refs(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.replace("text", F.lit("th"), F.lit("r123"))
    return documents(spark, sf).select("doc_id", F.array_join(rules.table_refs(marked), ",").alias("refs"))


@query("rul_field_refs", """
SELECT DISTINCT doc_id AS file, 'R12' || substring(m, 4, 1) || substring(split_part(m, '.', 1), 5) AS "table", split_part(m, '.', 2) AS field
FROM (SELECT doc_id, unnest(regexp_extract_all(replace(replace(text, 'th', 'r123'), ' ', '.'), '[Rr]\\d{3}[A-Za-z_]\\w*\\.[A-Za-z_]\\w*')) AS m FROM documents)""")
def rul_field_refs(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.replace(F.replace("text", F.lit("th"), F.lit("r123")), F.lit(" "), F.lit("."))
    return rules.field_refs(documents(spark, sf).select(F.col("doc_id").alias("file"), marked.alias("source")))


@query("rul_sql", f"WITH {_F} SELECT file, 'SELECT NUMCAD FROM R034FUN WHERE NUMEMP = 1' AS sql_text FROM o WHERE st <> 'O'")
def rul_sql(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).select("file", F.explode(rules.sql_texts(F.col("source"))).alias("sql_text"))


@query("rul_sysvars", f"WITH {_F} SELECT file, 'NumEmp' AS value FROM o WHERE pr = '5'")
def rul_sysvars(spark: SparkSession, sf: str) -> DataFrame:
    return rules.used_words(_tokens(spark, sf), "systemVariable")


@query("rul_builtins", f"WITH {_F} SELECT file, 'Mensagem' AS value FROM o WHERE pr IN ('2', '3')")
def rul_builtins(spark: SparkSession, sf: str) -> DataFrame:
    return rules.used_words(_tokens(spark, sf), "builtinFunction")


@query("rul_dup_decl", f"""WITH {_F}
SELECT file, 'warning' AS severity, 'Variável ''nVal'' declarada mais de uma vez (Duplicate variable declaration ''nVal'')' AS message,
  3 AS line, 15 AS start, 19 AS "end" FROM o WHERE pr = '1'""")
def rul_dup_decl(spark: SparkSession, sf: str) -> DataFrame:
    return rules.duplicate_declarations(_parsed(spark, sf))


_UNDECLARED = """SELECT file, 'warning' AS severity, 'Variável ''' || v || ''' não declarada (Undeclared variable ''' || v || ''')' AS message, line, st AS start, st + length(v) AS "end" """


@query("rul_undeclared", f"""WITH {_F}
{_UNDECLARED} FROM (SELECT file, 'nOther' AS v, 8 AS line, 2 AS st FROM o WHERE pr = '5'
  UNION ALL SELECT file, 'x', 12, 19 FROM o WHERE pr IN ('1', '5')
  UNION ALL SELECT file, 'FooBar', 12, 0 FROM o WHERE pr = '4')""")
def rul_undeclared(spark: SparkSession, sf: str) -> DataFrame:
    return rules.undeclared(_parsed(spark, sf))


@query("rul_arity", f"""WITH {_F}
SELECT file, 'warning' AS severity, 'Função ''Mensagem'': esperados 2 argumento(s), recebidos 1 (Function ''Mensagem'': expected 2 args, got 1)' AS message,
  12 AS line, 0 AS start, 8 AS "end" FROM o WHERE pr = '2'
UNION ALL SELECT file, 'warning', 'Função ''FooBar'' desconhecida (Unknown function ''FooBar'')', 12, 0, 6 FROM o WHERE pr = '4'""")
def rul_arity(spark: SparkSession, sf: str) -> DataFrame:
    return rules.arity(_parsed(spark, sf))


@query("rul_cursor", f"""WITH {_F}
SELECT file, 'warning' AS severity, 'Cursor ''cCur'' aberto sem SQL definida (Cursor ''cCur'' opened without SQL set)' AS message, 5 AS line, 5 AS start, 16 AS "end" FROM o WHERE st = 'O'
UNION ALL SELECT file, 'warning', 'Cursor ''cCur'' não foi fechado (Cursor ''cCur'' was never closed)', 0, 0, 0 FROM o WHERE st <> 'F'""")
def rul_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return rules.cursor_lifecycle(_parsed(spark, sf))


@query("rul_loop_next", f"""WITH {_F}
SELECT file, 'warning' AS severity, 'Loop Enquanto com ''cCur.Achou'' sem ''cCur.Proximo()'' — possível loop infinito (While loop with ''cCur.Achou'' without ''cCur.Proximo()'' — possible infinite loop)' AS message,
  6 AS line, 0 AS start, 8 AS "end" FROM o WHERE NOT even""")
def rul_loop_next(spark: SparkSession, sf: str) -> DataFrame:
    return rules.loops_without_next(_parsed(spark, sf))


_WARNINGS = """CASE pr WHEN '1' THEN 2 WHEN '2' THEN 1 WHEN '3' THEN 0 WHEN '4' THEN 3 ELSE 2 END
  + CASE st WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END + CASE WHEN even THEN 0 ELSE 1 END"""


@query("rul_summary", f"""WITH {_F}, p AS (SELECT file, CASE WHEN pr = '5' THEN 1 ELSE 0 END AS errors, {_WARNINGS} AS warnings FROM o)
SELECT count(*) AS files, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings,
  count(*) FILTER (WHERE errors = 0) AS ok, count(*) FILTER (WHERE errors > 0) AS fail FROM p""")
def rul_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rules.batch_summary(rule_findings.summary(rule_findings.findings(sources(spark, sf))))


# tags of the same two forms, with words that occur in the given texts
TAGS = [
    ("pair", [["tion", "ment"]]), ("either", [["heit"], ["que "]]), ("word", r"(?i)the\s+\w+"), ("case", r"[A-Z]\w+\.\s"),
    ("rare", [["zzz"]]),
]


@query("rul_patterns", """
SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'tion') AND contains(lower(text), 'ment') THEN 'pair' END,
  CASE WHEN contains(lower(text), 'heit') OR contains(lower(text), 'que ') THEN 'either' END,
  CASE WHEN regexp_matches(text, '(?i)the\\s+\\w+') THEN 'word' END, CASE WHEN regexp_matches(text, '[A-Z]\\w+\\.\\s') THEN 'case' END,
  CASE WHEN contains(lower(text), 'zzz') THEN 'rare' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents""")
def rul_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(corpus.pattern_tags(F.col("text"), TAGS), ",").alias("tags"))


@query("rul_title", r"""
WITH t AS (SELECT conv_id, turn, role || turn || '.txt' AS file, CASE role WHEN 'user' THEN '@ ' || replace(text, '@', ' ') || ' @'
  WHEN 'assistant' THEN '/* ==== ' || text || ' ==== */' ELSE text END AS source FROM conversations),
h AS (SELECT *, trim(regexp_extract(array_to_string(string_split(source, chr(10))[1:3], chr(10)), '@\s*(.+?)\s*@', 1)) AS marked,
  list_filter(list_transform(string_split(regexp_extract(source, '/\*([\s\S]*?)\*/', 1), chr(10)),
    lambda l: trim(regexp_replace(regexp_replace(l, '^[\s*/|=-]+', ''), '[\s*/|=-]+$', ''))), lambda c: length(c) >= 5)[1] AS useful FROM t)
SELECT conv_id, turn, coalesce(nullif(marked, ''), useful, regexp_replace(file, '\.[^.]*$', '')) AS title FROM h""")
def rul_title(spark: SparkSession, sf: str) -> DataFrame:
    source = (
        F.when(F.col("role") == "user", F.concat(F.lit("@ "), F.replace("text", F.lit("@"), F.lit(" ")), F.lit(" @")))
        .when(F.col("role") == "assistant", F.concat(F.lit("/* ==== "), "text", F.lit(" ==== */")))
        .otherwise(F.col("text"))
    )
    file = F.concat("role", "turn", F.lit(".txt"))
    return table(spark, sf, "conversations").select("conv_id", "turn", corpus.title(source, file).alias("title"))


def rule_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as rule files of six modules."""
    codes = F.lit(list(corpus.MODULES))
    module = F.get(codes, (F.col("doc_id") % 7).cast("int"))
    return documents(spark, sf).select(
        F.concat(F.coalesce(module, F.lit("OTHER")), "doc_id", F.lit(".rule")).alias("file"), F.col("text").alias("source")
    )


_MODULE = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(corpus.MODULES)) + " ELSE 'OTHER' END"
_DESC = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(corpus.MODULES.values())) + " ELSE 'OTHER' END"
_LINES = "CAST(len(string_split(text, chr(10))) AS BIGINT)"


@query("rul_index", f"""
SELECT {_MODULE} || doc_id || '.rule' AS file, {_MODULE} AS module, {_DESC} AS module_desc, {_LINES} AS line_count FROM documents""")
def rul_index(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.list_rules(corpus.index(rule_files(spark, sf))).select(
        "file", "module", "module_desc", F.col("line_count").cast("long").alias("line_count")
    )


@query("rul_get", f"SELECT {_MODULE} || doc_id || '.rule' AS file, sha1(text) AS source_sha1 FROM documents WHERE doc_id = 16")
def rul_get(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.get_rule(rule_files(spark, sf), "rsrg16.RULE").select("file", F.sha1("source").alias("source_sha1"))


TERM = "tion the"


@query("rul_search", f"""
SELECT {_MODULE} || doc_id || '.rule' AS file, {_MODULE} AS module, {_LINES} AS line_count,
  CAST(len(list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), '{TERM}'))) AS BIGINT) AS match_count,
  (SELECT count(*) <= 2 FROM documents WHERE doc_id % 7 = 2 AND contains(lower(text), '{TERM}')) AS full_source, true AS has_context
FROM documents WHERE doc_id % 7 = 2 AND contains(lower(text), '{TERM}')""")
def rul_search(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus.search(corpus.index(rule_files(spark, sf)), TERM, module="rsrg")
    return found.select(
        "file", "module", F.col("line_count").cast("long").alias("line_count"),
        F.col("match_count").cast("long").alias("match_count"), "full_source",
        (F.length("context") > 0).alias("has_context"),
    )


@query("rul_context", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
h AS (SELECT doc_id, no AS hit FROM l WHERE contains(lower(line), 'the') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY no) <= 3)
SELECT l.doc_id AS file, CAST(hit AS BIGINT) AS hit, CAST(no AS BIGINT) AS line_no, sha1(line) AS line_sha1
FROM h JOIN l ON l.doc_id = h.doc_id AND no BETWEEN hit - 5 AND hit + 5""")
def rul_context(spark: SparkSession, sf: str) -> DataFrame:
    src = documents(spark, sf).select(F.col("doc_id").alias("file"), F.col("text").alias("source"))
    return corpus.context_lines(src, "the").select(
        "file", F.col("hit").cast("long").alias("hit"), F.col("line_no").cast("long").alias("line_no"),
        F.sha1("line").alias("line_sha1"),
    )
