"""Reading one rule source: its tokens and the faults of its structure.

Both walk over a text with state that no set-based expression carries along (open comments,
open strings, open blocks). They run inside ``pandas_udf`` batches; all analysis above them is
relational (see rules.py).
"""

from __future__ import annotations

import re

# Words of the rule language.
KEYWORDS = set(
    "definir se senao enquanto inicio fim funcao numero alfa data cursor retorna erro e ou".split()
)
CURSOR_METHODS = "SQL|AbrirCursor|FecharCursor|Proximo|Achou|NaoAchou"
DECLARED_TYPES = ["numero", "alfa", "data", "cursor"]

# Functions the language offers.
BUILTINS = set(
    """
    mensagem mensagemlog cancel datahoje desmontadata montadata intparaalfa alfaparaint
    trocastring tamanhoalfa lerposicaoalfa convertecodificacaostring retornaascii formatar
    convertemascara retornavalorcfg abrir fechar gravarnl contador wcheckvalinteger
    wcheckvalstring wcheckvaldata wcheckvaldouble wcheckvalcheckbox getaccesstoken
    carregarcsvrplataforma retnivloc retnumlocniv retornaperguntas carregarespostasporpergunta
    conferirquadroefetivo calculadatarev
    copiaralfa concatena estanulo retornamesdata retornaanodata retornacodloc busqtddias
    busqtddiasmes dataextenso arredondarvalor montaabrangencia descitemlista listaquantidade
    listaitem enviaemail retornanomecampofrmtevidencia
    sql_criar sql_definircomando sql_definirinteiro sql_definiralfa sql_definirdata
    sql_abrircursor sql_retornarinteiro sql_retornaralfa sql_retornardata sql_eof sql_proximo
    sql_fecharcursor sql_destruir
    fluxobasico_criar fluxobasico_adicionarsecao fluxobasico_adicionarcaixa
    fluxobasico_adicionaritem fluxobasico_adicionarimagem fluxobasico_adicionarlegenda
    fluxobasico_finalizar
    gersolexaconsultarlistaexames gersolexaadicionarexamelista gersolexaremoverexamelista
    gersolexalimparlistaexames
    """.split()
)

# Variables the system provides, and prefixes that mark more of them.
SYSTEM_VARIABLES = set(
    """
    verweb datsis menlog numemp tipcol numcad
    empatu vexecucaoregra cgiaddr wnconector mediaavadet tipoavadet retdatrev tipoppes tipopaves
    listarequisicoesonuncio listarequisicoesamuncio datareferencialnt codusu
    abrsolexatipcol abrsolexanumcad abrsolexacodfic abrsolexacodex
    gersolexaorigem gersolexaperiodoinicio gersolexaperiodotermino gersolexaconsiderarexames
    gersolexadataexame gersolexavencimentoexame gersolexaatendente gersolexaconvenio
    gersolexaentidadeexame gersolexasolicitacoesaberto gersolexadiassolicitacao
    gersolexarequisicao gersolexaestruturapostos gersolexapostotrabalho gersolexafilial
    gersolexaorganograma gersolexalocal gersolexaestruturacargos gersolexacargo
    gersolexaatividade gersolexappra gersolexaabrangenciaghe gersolexaconsiderarsituacao
    gersolexagerarexamesorigem gersolexaconsiderarexamesmesmotipo resasstestearray
    listarequisicoes
    """.split()
)
SYSTEM_PREFIXES = ["gersolexa_", "abrsolexa_"]

TABLE = re.compile(r"[Rr]\d{3}[A-Za-z_]\w*", re.A)

# White space other than line ends is passed over: nothing matches there.
_TOKEN = re.compile(
    r"""(?P<word>[A-Za-z_]\w*)
    |(?P<newline>\n)
    |\.(?P<method>(?i:%s)\b)
    |(?P<punctuation>[(){};,.:\\])
    |(?P<comment>@[^@]*@?|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\[^\n]|[^"\n])*"?|'(?:\\[^\n]|[^'\n])*'?)
    |(?P<number>(?<![A-Za-z_])\d+(?:\.\d+)?)
    |(?P<operator><>|<=|>=|==|!=|\+\+|--|[-+*/=<>!])
    |(?P<unknown>[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff])"""
    % CURSOR_METHODS,
    re.X | re.A | re.S,
)

_WORD_TYPES = {w: t for t, words in (("systemVariable", SYSTEM_VARIABLES), ("builtinFunction", BUILTINS), ("keyword", KEYWORDS)) for w in words}


def _word_type(word: str) -> str:
    if word[0] in "Rr" and TABLE.match(word):
        return "tableReference"
    return _WORD_TYPES.get(word.lower(), "identifier")


class Columns:
    """Tokens column by column: type, value, line, start and end of each; a comment over several lines gives one per line."""

    def __init__(self) -> None:
        self.types: list[str] = []
        self.values: list[str] = []
        self.lines: list[int] = []
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, source: str) -> int:
        """The tokens of one more source; tells how many tokens there are then."""
        types, values, lines, starts, ends = self.types, self.values, self.lines, self.starts, self.ends
        first = len(types)

        def put(kind: str, value: str, at: int) -> None:
            types.append(kind)
            values.append(value)
            lines.append(line)
            starts.append(at)
            ends.append(at + len(value))

        line, origin = 0, 0  # current line and where it begins
        for m in _TOKEN.finditer(source.replace("\r\n", "\n")):
            kind = m.lastgroup
            if kind == "newline":
                line, origin = line + 1, m.end()
                continue
            at, value = m.start() - origin, m.group()
            if kind == "word":
                # behind a table and its point on the same line the word is the table's field
                if (len(types) - first > 1 and values[-1] == "." and lines[-1] == line and ends[-1] == at
                        and types[-2] == "tableReference" and lines[-2] == line):
                    for column in (types, values, lines, starts, ends):
                        column.pop()
                    values[-1], ends[-1] = f"{values[-1]}.{value}", at + len(value)
                    continue
                kind = _word_type(value)
            elif kind == "method":
                after_token = len(types) > first and lines[-1] == line
                put("punctuation", ".", at)
                kind, value, at = "cursorMethod" if after_token else _word_type(m["method"]), m["method"], at + 1
            elif kind == "comment":
                for i, part in enumerate(value.split("\n")):
                    if i:
                        line, at = line + 1, 0
                    if part:
                        put(kind, part, at)
                if "\n" in value:
                    origin = m.start() + value.rfind("\n") + 1
                continue
            types.append(kind)
            values.append(value)
            lines.append(line)
            starts.append(at)
            ends.append(at + len(value))
        return len(types)


def tokens(source: str) -> list[tuple]:
    """(type, value, line, start, end) of every token."""
    c = Columns()
    c.add(source)
    return list(zip(c.types, c.values, c.lines, c.starts, c.ends))


# Texts of the structural messages.
OPEN_STRING = "String não fechada (Unclosed string literal)"
CLOSING_BRACE = "Chave de fechamento sem correspondência (Unmatched closing brace)"
OPENING_BRACE = "Chave de abertura sem correspondência (Unmatched opening brace)"
LONE_FIM = '"Fim" sem "Inicio" correspondente ("Fim" without matching "Inicio")'
LONE_INICIO = '"Inicio" sem "Fim" correspondente ("Inicio" without matching "Fim")'
OPEN_BLOCK = "Comentário /* não fechado (Unclosed /* comment)"
OPEN_AT = "Comentário @ não fechado (Unclosed @ comment)"
NO_SEMICOLON = "Falta ponto-e-vírgula após declaração Definir (Missing semicolon after Definir statement)"

_STOP = re.compile(r"/\*|[@\"'{}]|(?<![A-Za-z0-9_])(?:inicio|fim)\b", re.I | re.A)
_DOUBLE = re.compile(r'"(?:\\.|[^"\\])*"')
_BARE_DECLARATION = re.compile(r"definir\s+(?:numero|alfa|data|cursor)\s+\w+\s*$", re.I | re.A)


def faults(source: str) -> list[tuple]:
    """(severity, message, line, start, end) of unbalanced strings, comments and blocks."""
    lines = re.split(r"\r?\n", source)
    found: list[tuple] = []
    stacks: dict[str, list[tuple[int, int]]] = {"{": [], "inicio": []}
    comment: tuple[str, int] | None = None  # closing mark and first line
    in_string = False
    for no, text in enumerate(lines):
        pos = 0
        if in_string:
            close = text.find('"')
            in_string = close < 0 and "\\" in text
            pos = close + 1 if close >= 0 else len(text)
            if pos >= len(text):
                continue
        while pos < len(text):
            if comment:
                end = text.find(comment[0], pos)
                if end < 0:
                    break
                pos, comment = end + len(comment[0]), None
                continue
            m = _STOP.search(text, pos)
            if not m:
                break
            mark, at, pos = m.group().lower(), m.start(), m.end()
            if mark in ("/*", "@"):
                comment = ("*/" if mark == "/*" else "@", no)
            elif mark == '"':
                closed = _DOUBLE.match(text, at)
                if closed:
                    pos = closed.end()
                else:
                    pos, in_string = len(text), "\\" in text[at + 1 :]
                    if not in_string:
                        found.append(("error", OPEN_STRING, no, at, len(text)))
            elif mark == "'":
                end = text.find("'", pos)
                pos = end + 1 if end >= 0 else len(text)
                if end < 0:
                    found.append(("warning", OPEN_STRING, no, at, len(text)))
            elif mark in stacks:
                stacks[mark].append((no, at))
            else:
                opener, message = ("{", CLOSING_BRACE) if mark == "}" else ("inicio", LONE_FIM)
                if stacks[opener]:
                    stacks[opener].pop()
                else:
                    found.append(("error", message, no, at, pos))
        if not comment and _BARE_DECLARATION.match(text.strip()):
            found.append(("warning", NO_SEMICOLON, no, len(text) - 1, len(text)))
    if comment:
        message = OPEN_BLOCK if comment[0] == "*/" else OPEN_AT
        found.append(("error", message, comment[1], 0, len(lines[comment[1]])))
    found += [("error", OPENING_BRACE, no, at, at + 1) for no, at in stacks["{"]]
    found += [("error", LONE_INICIO, no, at, at + 6) for no, at in stacks["inicio"]]
    return found
