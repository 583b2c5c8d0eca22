"""Checks over a corpus of rule sources, as relational steps on its tokens.

``sources`` has file and source. Token order within a file is ``n``; a file's tokens come from
one row, so windows per file are as bounded as that row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.functions.text import once
from corpusops.operators import rules_text as rt

TOKEN = "array<struct<n:int,type:string,value:string,line:int,start:int,end:int>>"
FAULT = "array<struct<severity:string,message:string,line:int,start:int,end:int>>"

NEIGHBOURS = ("p1", "p2", "n1", "n2")

# tokens looked at after a loop word
LOOKAHEAD = 9

# What each finding says.
MESSAGES = {
    "twice": "Variável '%s' declarada mais de uma vez (Duplicate variable declaration '%s')",
    "undeclared": "Variável '%s' não declarada (Undeclared variable '%s')",
    "arity": "Função '%s': esperados %s argumento(s), recebidos %s (Function '%s': expected %s args, got %s)",
    "unknown": "Função '%s' desconhecida (Unknown function '%s')",
    "open": "Cursor '%s' aberto sem SQL definida (Cursor '%s' opened without SQL set)",
    "close": "Cursor '%s' fechado sem estar aberto (Cursor '%s' closed without being open)",
    "test": "Cursor '%s' testado sem estar aberto (Cursor '%s' tested without being open)",
    "next": "Cursor '%s': Proximo() sem cursor aberto (Cursor '%s': Proximo() without open cursor)",
    "left": "Cursor '%s' não foi fechado (Cursor '%s' was never closed)",
    "stuck": "Loop Enquanto com '%s.Achou' sem '%s.Proximo()' — possível loop infinito (While loop with '%s.Achou' without '%s.Proximo()' — possible infinite loop)",
}

# Each function with its least and most arguments, in the order of the language's catalogue.
ARITY = [
    ("mensagem", 2, 2), ("mensagemlog", 1, 1), ("cancel", 1, 1),
    ("datahoje", 1, 1), ("desmontadata", 4, 4), ("montadata", 4, 4), ("busqtddiasmes", 3, 3), ("retornamesdata", 2, 2),
    ("retornaanodata", 2, 2), ("dataextenso", 2, 2),
    ("intparaalfa", 2, 2), ("alfaparaint", 2, 2), ("trocastring", 4, 4), ("tamanhoalfa", 2, 2), ("lerposicaoalfa", 3, 3),
    ("copiaralfa", 3, 3), ("convertecodificacaostring", 3, 3), ("retornaascii", 2, 2), ("formatar", 2, 2),
    ("convertemascara", 4, 4), ("concatena", 3, 10), ("estanulo", 2, 2), ("arredondarvalor", 2, 2),
    ("abrir", 2, 2), ("fechar", 1, 1), ("gravarnl", 2, 2), ("retornavalorcfg", 2, 2),
    ("wcheckvalinteger", 5, 5), ("wcheckvalstring", 5, 5), ("wcheckvaldata", 4, 4), ("wcheckvaldouble", 5, 5),
    ("wcheckvalcheckbox", 3, 3), ("retornanomecampofrmtevidencia", 4, 4),
    ("getaccesstoken", 3, 3), ("carregarcsvplataforma", 7, 7),
    ("retnivloc", 4, 4), ("retnumlocniv", 5, 5), ("retornacodloc", 2, 2), ("retcolabporcodusu", 4, 4),
    ("conferirquadroefetivo", 5, 5), ("retornaconferenciaquaefe", 9, 9), ("calculadatarev", 6, 6),
    ("retornalistaobjetivos", 1, 1), ("retornaperguntas", 1, 1), ("carregarrespostasporpergunta", 1, 1),
    ("retornarespostasporpergunta", 1, 1),
    ("descitemlista", 3, 3), ("listaquantidade", 3, 3), ("listaitem", 4, 4), ("montaabrangencia", 3, 3), ("contador", 3, 3),
    ("enviaemail", 8, 8),
    ("fluxobasico_criar", 2, 2), ("fluxobasico_adicionarsecao", 3, 3), ("fluxobasico_adicionarcaixa", 4, 4),
    ("fluxobasico_adicionaritem", 5, 5), ("fluxobasico_adicionarimagem", 4, 4), ("fluxobasico_adicionarlegenda", 2, 2),
    ("fluxobasico_finalizar", 0, 0),
    ("gersolexa_consultarlistaexames", 5, 5), ("gersolexa_adicionarexamelista", 9, 9), ("gersolexa_removerexamelista", 0, 0),
    ("gersolexa_limparlistaexames", 0, 0),
    ("sql_criar", 1, 1), ("sql_definircomando", 2, 2), ("sql_definirinteiro", 3, 3), ("sql_definiralfa", 3, 3),
    ("sql_definirdata", 3, 3), ("sql_abrircursor", 1, 1), ("sql_eof", 1, 1), ("sql_retornarinteiro", 3, 3),
    ("sql_retornaralfa", 3, 3), ("sql_retornardata", 3, 3), ("sql_proximo", 1, 1), ("sql_fecharcursor", 1, 1),
    ("sql_destruir", 1, 1),
]

# Words allowed without a declaration.
FREE_WORDS = ["retorna", "erro", "alerta", "gravarnl", "lernl", "i", "p", "primeiro", "proximo", "libera"]
UNCHECKED_CALLS = ["abrircursor", "fecharcursor", "proximo"]


def _arrays(found: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.ListArray:
    """Rows of tuples as one Arrow list column, built column by column."""
    offsets = np.zeros(len(found) + 1, dtype=np.int32)
    np.cumsum([len(f) for f in found], out=offsets[1:])
    columns = list(zip(*(x for f in found for x in f))) or [()] * len(fields)
    parts = [pa.array(c, type=t) for c, t in zip(columns, fields.values())]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=list(fields)))


_PLACE = {"line": pa.int32(), "start": pa.int32(), "end": pa.int32()}


def _scan(source: str) -> Column:
    @F.arrow_udf(TOKEN)
    def scan(texts: pa.Array) -> pa.Array:
        found = rt.Columns()
        offsets = np.array([0, *[found.add(t or "") for t in texts.to_pylist()]], np.int32)
        n = np.arange(offsets[-1], dtype=np.int32) - np.repeat(offsets[:-1], np.diff(offsets))
        words = [pa.array(c, pa.string()) for c in (found.types, found.values)]
        places = [pa.array(np.array(c, np.int32)) for c in (found.lines, found.starts, found.ends)]
        parts = pa.StructArray.from_arrays([pa.array(n), *words, *places], names=["n", "type", "value", "line", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets), parts)

    return scan(source)


def scan(sources: DataFrame) -> DataFrame:
    """One row per file with its tokens as a list; the table the checks start from."""
    return sources.select("file", _scan("source").alias("ts"))


def tokenize(scanned: DataFrame) -> DataFrame:
    """file, n, type, value, line, start, end.

    Of an explode Spark asks first for the rows whose list holds something, and reads every source a second time for
    it, before the rows are dealt to the cores; of an outer one it does not.
    """
    return scanned.select("file", F.explode_outer("ts").alias("t")).filter(F.col("t").isNotNull()).select("file", "t.*")


def structure(sources: DataFrame) -> DataFrame:
    @F.arrow_udf(FAULT)
    def find(texts: pa.Array) -> pa.Array:
        return _arrays([rt.faults(t or "") for t in texts.to_pylist()], {"severity": pa.string(), "message": pa.string(), **_PLACE})

    return sources.select("file", F.explode(find("source")).alias("f")).select("file", "f.*")


class Tok:
    """A token of the zipped list: its own fields, and its neighbours p1, p2, n1, n2, by name."""

    def __init__(self, element: Column):
        self.element = element

    def __getitem__(self, name: str) -> Column:
        return self.element[name] if name in NEIGHBOURS else self.element["t"][name]


def _is(t, kind: str, *values: str) -> Column:
    return (t["type"] == kind) & F.lower(t["value"]).isin(list(values))


def _mark(t, *values: str) -> Column:
    return (t["type"] == "punctuation") & t["value"].isin(list(values))


def _defines_variable(t) -> Column:
    return _is(t, "keyword", "definir") & F.lower(t["n1"]["value"]).isin(rt.DECLARED_TYPES)


def _on_line(t) -> Column:
    """Both following tokens stand on the token's own line."""
    return (t["n1"]["line"] == t["line"]) & (t["n2"]["line"] == t["line"])


def _zipped() -> Column:
    """Every token next to its neighbours, by shifting the whole list."""
    ts, n = F.col("ts"), F.size("ts")
    gap = F.array(F.lit(None).cast(TOKEN[6:-1]))
    shifted = {
        "t": ts,
        "p1": F.slice(F.concat(gap, ts), F.lit(1), n),
        "p2": F.slice(F.concat(gap, gap, ts), F.lit(1), n),
        "n1": F.slice(F.concat(ts, gap), F.lit(2), n),
        "n2": F.slice(F.concat(ts, gap, gap), F.lit(3), n),
    }
    return F.arrays_zip(*[c.alias(name) for name, c in shifted.items()])


def parse(scanned: DataFrame) -> DataFrame:
    """The scanned files with their tokens next to their neighbours, and with the lower-cased
    names each one declares.

    Names, and below the tokens a check looks at, are taken inside the row the tokens are in;
    only what a check keeps is ever shuffled.
    """
    def names(keep, name) -> Column:
        kept = F.filter("near", lambda e: keep(Tok(e)))
        return F.array_distinct(F.transform(kept, lambda e: F.lower(name(Tok(e)))))

    return once(scanned, near=_zipped()).withColumns(
        {
            "variables": names(lambda t: _defines_variable(t) & _on_line(t), lambda t: t["n2"]["value"]),
            "cursors": names(_defines_cursor, lambda t: t["n2"]["value"]),
            "functions": names(_names_function, _function_name),
        }
    )


def _defines_cursor(t) -> Column:
    return _is(t, "keyword", "definir") & _on_line(t) & (F.lower(t["n1"]["value"]) == "cursor")


def _names_function(t) -> Column:
    defined = _is(t, "keyword", "definir") & (F.lower(t["n1"]["value"]) == "funcao")
    return (t["type"] == "keyword") & (_is(t, "keyword", "funcao") | defined) & _on_line(t)


def _function_name(t) -> Column:
    said = F.when(_is(t, "keyword", "funcao"), t["n1"]["value"]).otherwise(t["n2"]["value"])
    return F.regexp_replace(said, r"\(.*\)", "")


def _picked(parsed: DataFrame, keep, *more: str) -> DataFrame:
    """Rows of the kept tokens with their neighbours."""
    kept = F.filter("near", lambda e: keep(Tok(e)))
    return parsed.select("file", *more, F.explode(kept).alias("e")).select(
        "file", *more, "e.t.*", *[F.col(f"e.{p}").alias(p) for p in NEIGHBOURS]
    )


def _order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("n")


def declarations(parsed: DataFrame) -> DataFrame:
    """file, kind (variable, cursor, function), name, declared type, line; last type wins."""
    said = F.when(F.lower("value") == "funcao", F.col("n1.value")).otherwise(F.col("n2.value"))
    is_function = (F.lower("value") == "funcao") | (F.lower("n1.value") == "funcao")
    named = _picked(parsed, lambda t: (_defines_variable(t) & _on_line(t)) | _names_function(t)).select(
        "file", "n", "line", is_function.alias("function"), F.lower("n1.value").alias("declared"),
        F.when(is_function, F.regexp_replace(said, r"\(.*\)", "")).otherwise(F.col("n2.value")).alias("name"),
    )
    latest = named.groupBy("file", "function", "name").agg(
        F.max_by(F.struct("declared", "line"), "n").alias("v"), F.max(F.col("declared") == "cursor").alias("cursor"), F.min("line").alias("first")
    )
    variable, cursor, function = (F.lit(k) for k in ("variable", "cursor", "function"))
    kinds = F.when(F.col("function"), F.array(function)).when(F.col("cursor"), F.array(variable, cursor)).otherwise(F.array(variable))
    return latest.select(
        "file", F.explode(kinds).alias("kind"), "name", F.when(~F.col("function"), F.col("v.declared")).alias("declared"),
        F.when(F.col("function"), F.col("first")).otherwise(F.col("v.line")).alias("line"),
    )


def _report(df: DataFrame, message: Column, severity: str = "warning") -> DataFrame:
    return df.select("file", F.lit(severity).alias("severity"), message.alias("message"), "line", "start", "end")


def duplicate_declarations(parsed: DataFrame) -> DataFrame:
    """Second and later declaration of a name, whatever its case."""
    named = _picked(parsed, lambda t: _defines_variable(t) & t["n2"].isNotNull()).select(
        "file", "n", F.col("n2.value").alias("name"), F.lower("n2.value").alias("k"), "n2.line", "n2.start", "n2.end"
    )
    later = named.withColumn("nth", F.row_number().over(_order("file", "k"))).filter("nth > 1")
    return _report(
        later,
        F.format_string(MESSAGES["twice"], "name", "name"),
    )


def undeclared(parsed: DataFrame) -> DataFrame:
    """Identifiers that nothing declares: not a variable, function or known word, not a member."""
    def unknown(t) -> Column:
        low = F.lower(t["value"])
        known_place = _mark(t["p1"], ".") | _is(t["p1"], "keyword", "definir") | _is(t["p2"], "keyword", "definir")
        return (
            (t["type"] == "identifier")
            & ~F.coalesce(known_place, F.lit(False))
            & ~low.isin(FREE_WORDS)
            & ~low.rlike("^(" + "|".join(rt.SYSTEM_PREFIXES) + ")")
            & ~t["value"].rlike(rf"(?i)^({rt.CURSOR_METHODS})\b")
            & ~F.array_contains("variables", low)
            & ~F.array_contains("functions", low)
        )

    return _report(
        _picked(parsed, unknown),
        F.format_string(MESSAGES["undeclared"], "value", "value"),
    )


def calls(parsed: DataFrame) -> DataFrame:
    """Calls with their number of arguments.

    Only parentheses and commas take part, each knowing whether anything else follows it. A mark
    inside L open parentheses belongs to the latest '(' that raised the depth to L.
    """
    def is_call(t) -> Column:
        return t["type"].isin("identifier", "builtinFunction") & _mark(t["n1"], "(")

    call = F.col("type").isin("identifier", "builtinFunction")
    rows = _picked(parsed, lambda t: _mark(t, "(", ")", ",") | is_call(t), "functions").select(
        "file", "n", "value", "line", "start", "end", call.alias("call"), F.when(call, F.col("functions")).alias("functions"),
        (~call & F.col("n1").isNotNull() & ~_mark(F.col("n1"), "(", ")", ",")).alias("content"),
    )
    is_open = F.col("value") == "("
    step = F.when(is_open, 1).when(F.col("value") == ")", -1).otherwise(0)
    upto = Window.unboundedPreceding
    deep = rows.withColumn("depth", F.sum(step).over(_order("file").rowsBetween(upto, 0)))
    latest = F.last(F.when(is_open, F.col("n")), ignorenulls=True).over(_order("file", "depth").rowsBetween(upto, 0))
    owned = deep.withColumn("paren", F.when(F.col("call"), F.col("n") + 1).otherwise(latest)).filter(F.col("paren").isNotNull())
    # the calls of a parenthesis stand in one window with the marks that belong to it
    inside = Window.partitionBy("file", "paren")
    return owned.withColumns(
        {"commas": F.count_if(F.col("value") == ",").over(inside), "filled": F.max("content").over(inside)}
    ).filter("call").select(
        "file", "value", "line", "start", "end", "functions",
        F.when(F.col("filled"), F.col("commas") + 1).otherwise(0).alias("args"),
    )


def arity(parsed: DataFrame) -> DataFrame:
    """Calls with too few or too many arguments, and calls of unknown functions."""
    known = calls(parsed).withColumn("k", F.lower("value")).join(F.broadcast(parsed.sparkSession.createDataFrame(ARITY, "k string, lo int, hi int")), "k", "left")
    expected = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    got = F.col("args").cast("string")
    message = F.when(
        ~F.col("args").between(F.col("lo"), F.col("hi")),
        F.format_string(
            MESSAGES["arity"],
            "value", expected, got, "value", expected, got,
        ),
    ).when(
        F.col("lo").isNull() & ~F.col("k").isin(UNCHECKED_CALLS) & ~F.array_contains("functions", F.col("k")),
        F.format_string(MESSAGES["unknown"], "value", "value"),
    )
    return _report(known.withColumn("m", message).filter(F.col("m").isNotNull()), F.col("m"))


def cursor_events(parsed: DataFrame) -> DataFrame:
    """Declarations of cursors and method calls on them, with the state each call meets and the cursor's last state.

    ``cursor`` is the spelling a cursor is reported under, that of its last declaration.
    """
    def used(t) -> Column:
        return (
            t["type"].isin("identifier", "tableReference") & _mark(t["n1"], ".")
            & (t["n2"]["type"] == "cursorMethod") & F.array_contains("cursors", F.lower(t["value"]))
        )

    defined = F.col("type") == "keyword"
    rows = _picked(parsed, lambda t: used(t) | _defines_cursor(t)).select(
        "file", "n", F.lower(F.when(defined, F.col("n2.value")).otherwise(F.col("value"))).alias("k"),
        F.when(~defined, F.lower("n2.value")).alias("method"), F.when(defined, F.col("n2.value")).alias("spelled"),
        "n2.line", "n2.start", "n2.end",
    )
    leads_to = (
        F.when(F.col("method") == "sql", "SQL_SET").when(F.col("method") == "abrircursor", "OPENED")
        .when(F.col("method") == "fecharcursor", "CLOSED")
    )
    whole = _order("file", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = _order("file", "k").rowsBetween(Window.unboundedPreceding, -1)
    return rows.filter(F.col("file").isNotNull()).withColumn("leads_to", leads_to).withColumns(
        {
            "state": F.coalesce(F.last("leads_to", ignorenulls=True).over(before), F.lit("DECLARED")),
            "final": F.last("leads_to", ignorenulls=True).over(whole),
            "cursor": F.last("spelled", ignorenulls=True).over(whole),
            "is_last": F.lead("n").over(_order("file", "k")).isNull(),
        }
    )


def cursor_lifecycle(parsed: DataFrame) -> DataFrame:
    """Methods met in the wrong state, and cursors left open."""
    opened = F.col("state") == "OPENED"
    wrong = (
        F.when((F.col("method") == "abrircursor") & (F.col("state") != "SQL_SET"), "open")
        .when((F.col("method") == "fecharcursor") & ~opened, "close")
        .when(F.col("method").isin("achou", "naoachou") & ~opened, "test")
        .when((F.col("method") == "proximo") & ~opened, "next")
    )
    place = ("line", "start", "end")
    own = F.struct(wrong.alias("wrong"), *place)
    left = F.struct(F.when(F.col("is_last") & (F.col("final") == "OPENED"), "left").alias("wrong"), *[F.lit(0).alias(c) for c in place])
    found = cursor_events(parsed).select("file", "cursor", F.explode(F.array(own, left)).alias("f")).select("file", "cursor", "f.*")
    message = F
    for key in ("open", "close", "test", "next", "left"):
        message = message.when(F.col("wrong") == key, F.format_string(MESSAGES[key], "cursor", "cursor"))
    return _report(found.filter(F.col("wrong").isNotNull()), message)


def loops_without_next(parsed: DataFrame) -> DataFrame:
    """While-loops that test a cursor but never move it on inside their block."""
    blocks = ("inicio", "fim", "enquanto", "se", "senao")
    moves = lambda t: _is(t, "cursorMethod", "proximo") & (t["p1"]["value"] == ".")
    seen = _picked(parsed, lambda t: _is(t, "keyword", *blocks) | _is(t, "cursorMethod", "achou") | moves(t), "cursors").select(
        "file", "n", F.lower("value").alias("word"), "line", "start", "end", "cursors",
        F.when(F.col("p1.value") == ".", F.col("p2.value")).alias("name"),
    )
    # the cursor tested right after the loop word, before any block or branch word
    w = _order("file").rowsBetween(1, Window.unboundedFollowing)
    is_move = F.col("word") == "proximo"
    stop = F.when(~is_move & (F.col("word") != "enquanto"), F.struct("n", "word", "name"))
    following = F.first(stop, ignorenulls=True).over(w)
    marks = (
        seen.withColumn("f", following)
        .filter(F.col("word").isin("inicio", "fim", "enquanto", "proximo"))
        .withColumn(
            "name",
            F.when(is_move, F.col("name"))
            .when((F.col("f.word") == "achou") & (F.col("f.n") <= F.col("n") + LOOKAHEAD), F.col("f.name")),
        )
    )
    step = F.when(F.col("word") == "inicio", 1).when(F.col("word") == "fim", -1).otherwise(0)
    deep = marks.withColumn("after", F.sum(step).over(_order("file").rowsBetween(Window.unboundedPreceding, 0)))
    # a loop met at depth d has its block from the next 'inicio' at d to the next 'fim' back to d
    level = F.when(F.col("word") == "fim", F.col("after")).otherwise(F.col("after") - step)
    ahead = _order("file", "level").rowsBetween(1, Window.unboundedFollowing)
    loops = (
        deep.withColumn("level", level)
        .withColumns(
            {
                f"block_{w}": F.first(F.when(F.col("word") == w, F.col("n")), ignorenulls=True).over(ahead)
                for w in ("inicio", "fim")
            }
        )
        .filter(
            is_move | (F.col("word") == "enquanto") & F.array_contains("cursors", F.lower("name"))
            & (F.col("block_inicio") < F.col("block_fim"))
        )
        .withColumns({"k": F.lower("name"), "at": F.when(is_move, F.col("n")).otherwise(F.col("block_inicio"))})
    )
    # the first move of the loop's cursor from the begin of its block on
    onward = Window.partitionBy("file", "k").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    moved = loops.withColumn("moved", F.min(F.when(is_move, F.col("n"))).over(onward))
    stuck = moved.filter(~is_move & (F.col("moved").isNull() | (F.col("moved") > F.col("block_fim"))))
    return _report(
        stuck,
        F.format_string(
            MESSAGES["stuck"],
            "name", "name", "name", "name",
        ),
    )


CHECKS = (duplicate_declarations, undeclared, arity, cursor_lifecycle, loops_without_next)


def semantic(parsed: DataFrame) -> DataFrame:
    """All checks. Each reads ``parsed``, so a large corpus is best scanned into a table first."""
    return reduce(lambda a, b: a.unionByName(b), [check(parsed) for check in CHECKS])


def summary(sources: DataFrame, issues: DataFrame) -> DataFrame:
    """Per file: errors, warnings and whether it passes; files without issues pass."""
    counted = issues.groupBy("file").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    zero = F.lit(0).cast("long")
    return sources.select("file").join(counted, "file", "left").select(
        "file", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"),
        F.when(F.coalesce("errors", zero) > 0, "fail").otherwise("ok").alias("status"),
    )


def batch_summary(per_file: DataFrame) -> DataFrame:
    return per_file.agg(
        F.count(F.lit(1)).alias("files"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"),
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "fail").alias("fail"),
    )


# References read straight from the source text, inside the row.

TABLE_REF = r"[Rr]\d{3}[A-Za-z_]\w*"
FIELD_REF = r"([Rr]\d{3}[A-Za-z_]\w*)\.([A-Za-z_]\w*)"
SQL_TEXT = r'(?i)\.SQL\s+"([^"]+)"'


def _upper_prefix(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 4)), F.substr(c, F.lit(5)))


def table_refs(source: Column, pattern: str = TABLE_REF) -> Column:
    """Distinct references, first four characters upper-cased, sorted."""
    found = F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), lambda t: _upper_prefix(t))
    return F.array_sort(F.array_distinct(found))


def field_refs(sources: DataFrame) -> DataFrame:
    """file, table, field: distinct qualified references."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("source", F.lit(FIELD_REF), F.lit(1)).alias("t"),
        F.regexp_extract_all("source", F.lit(FIELD_REF), F.lit(2)).alias("f"),
    )
    shaped = F.array_distinct(
        F.transform(pairs, lambda p: F.struct(_upper_prefix(p["t"]).alias("table"), p["f"].alias("field")))
    )
    return sources.select("file", F.explode(shaped).alias("r")).select("file", "r.*")


def sql_texts(source: Column) -> Column:
    return F.transform(F.regexp_extract_all(source, F.lit(SQL_TEXT), F.lit(1)), lambda s: F.trim(s))


def used_words(tokens: DataFrame, kind: str) -> DataFrame:
    """Distinct words of one token type per file: system variables or builtin calls."""
    return tokens.filter(F.col("type") == kind).select("file", "value").distinct()
