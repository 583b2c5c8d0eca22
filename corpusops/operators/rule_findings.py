"""All findings of a rule source in one pass over its tokens, inside the row that holds it.

The checks of ``rules`` say what each finding is, as relational steps. Here a file is cut into tokens once, and
one walk along them keeps what the checks need: the latest open parenthesis of each depth, the state of each
cursor, and the loops that still wait for the begin and the end of their block. Nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.operators import rules
from corpusops.operators import rules_text as rt

#: State that a method leaves a cursor in, the state another one asks for, and what it is told without that.
LEADS_TO = {"sql": "SQL_SET", "abrircursor": "OPENED", "fecharcursor": "CLOSED"}
ASKS_FOR = {
    "abrircursor": ("SQL_SET", "open"), "fecharcursor": ("OPENED", "close"), "achou": ("OPENED", "test"),
    "naoachou": ("OPENED", "test"), "proximo": ("OPENED", "next"),
}
ARITY = {name: (least, most) for name, least, most in rules.ARITY}
SYSTEM_WORD = re.compile("(" + "|".join(rt.SYSTEM_PREFIXES) + ")")
METHOD_WORD = re.compile(rf"(?i)({rt.CURSOR_METHODS})\b")
#: Types of tokens that a walk stops at, beside parentheses and commas.
VISITED = {"keyword", "cursorMethod", "identifier", "builtinFunction", "tableReference"}
NONE = (None, "", -1, 0, 0)


class Names:
    """What a file declares, in lower case; ``cursors`` with the spelling of their last declaration."""

    def __init__(self, tokens: list[tuple]) -> None:
        self.variables: set[str] = set()
        self.functions: set[str] = set()
        self.cursors: dict[str, str] = {}
        for n in [n for n, t in enumerate(tokens[:-2]) if t[0] == "keyword"]:
            t, a, b = tokens[n : n + 3]
            if not t[2] == a[2] == b[2]:
                continue
            word, kind = t[1].lower(), a[1].lower()
            if word == "definir" and kind in rt.DECLARED_TYPES:
                self.variables.add(b[1].lower())
            if word == "definir" and kind == "cursor":
                self.cursors[b[1].lower()] = b[1]
            if word == "funcao" or (word == "definir" and kind == "funcao"):
                self.functions.add(re.sub(r"\(.*\)", "", (a if word == "funcao" else b)[1]).lower())


def _mark(t: tuple, *values: str) -> bool:
    return t[0] == "punctuation" and t[1] in values


class Walk:
    """The findings of one file: (severity, message, line, start, end)."""

    def __init__(self, tokens: list[tuple]) -> None:
        self.found: list[tuple] = []
        self.names = Names(tokens)
        self.tokens = [NONE, NONE, *tokens, NONE, NONE]
        self.declared: set[str] = set()
        self.depth, self.open_at, self.arguments = 0, {}, defaultdict(lambda: [0, False])
        self.calls: list[tuple[int, tuple]] = []
        self.states: dict[str, str] = {}
        self.level, self.untested, self.loops, self.moves = 0, [], defaultdict(list), defaultdict(list)
        for n, t in enumerate(tokens, 2):
            if t[0] in VISITED or (t[0] == "punctuation" and t[1] in "(),"):
                self._visit(n, *self.tokens[n - 2 : n + 3])
        self._settle()

    def _warn(self, message: str, place: tuple, *values: object) -> None:
        self.found.append(("warning", rules.MESSAGES[message] % values, *place[2:]))

    def _visit(self, n: int, p2: tuple, p1: tuple, t: tuple, n1: tuple, n2: tuple) -> None:
        kind, low = t[0], t[1].lower()
        if kind == "punctuation":
            self._parenthesis(n, t[1], n1)
        elif kind == "keyword":
            if low == "definir" and n1[1].lower() in rt.DECLARED_TYPES and n2 is not NONE:
                if n2[1].lower() in self.declared:
                    self._warn("twice", n2, n2[1], n2[1])
                self.declared.add(n2[1].lower())
            elif low in ("inicio", "fim", "enquanto", "se", "senao"):
                self._block(n, low)
        elif kind == "cursorMethod":
            if low == "achou":
                self._tested(n, p2[1] if p1[1] == "." else None)
            elif low == "proximo" and p1[1] == ".":
                self.moves[p2[1].lower()].append(n)
        else:
            if kind == "identifier":
                self._identifier(t, low, p1, p2)
            if kind in ("identifier", "builtinFunction") and _mark(n1, "("):
                self.calls.append((n + 1, t))
            if kind in ("identifier", "tableReference") and _mark(n1, ".") and n2[0] == "cursorMethod" and low in self.names.cursors:
                self._method(low, n2)

    def _identifier(self, t: tuple, low: str, p1: tuple, p2: tuple) -> None:
        told = _mark(p1, ".") or any(p[0] == "keyword" and p[1].lower() == "definir" for p in (p1, p2))
        known = low in rules.FREE_WORDS or low in self.names.variables or low in self.names.functions
        if not told and not known and not SYSTEM_WORD.match(low) and not METHOD_WORD.match(t[1]):
            self._warn("undeclared", t, t[1], t[1])

    def _parenthesis(self, n: int, mark: str, following: tuple) -> None:
        """A mark at a depth belongs to the parenthesis that was the last to reach this depth."""
        self.depth += (mark == "(") - (mark == ")")
        if mark == "(":
            self.open_at[self.depth] = n
        if self.depth in self.open_at:
            own = self.arguments[self.open_at[self.depth]]
            own[0] += mark == ","
            own[1] |= following is not NONE and not _mark(following, "(", ")", ",")

    def _method(self, cursor: str, method: tuple) -> None:
        word, spelled = method[1].lower(), self.names.cursors[cursor]
        wanted, told = ASKS_FOR.get(word, (None, None))
        if wanted and self.states.get(cursor) != wanted:
            self._warn(told, method, spelled, spelled)
        if word in LEADS_TO:
            self.states[cursor] = LEADS_TO[word]

    def _block(self, n: int, word: str) -> None:
        """A loop at a level waits for the next begin there and ends with the next end back to it."""
        if word != "enquanto":
            self.untested = []  # a cursor is tested before any other word of a block or branch
        if word == "enquanto":
            loop = {"at": n, "level": self.level, "cursor": None, "begin": None}
            self.untested.append(loop)
            self.loops[self.level].append(loop)
        elif word == "inicio":
            for loop in self.loops[self.level]:
                loop["begin"] = loop["begin"] or n
            self.level += 1
        elif word == "fim":
            self.level -= 1
            for loop in self.loops.pop(self.level, []):
                self._ended(loop, n)

    def _tested(self, n: int, cursor: str | None) -> None:
        for loop in self.untested:
            if n <= loop["at"] + rules.LOOKAHEAD:
                loop["cursor"] = cursor
        self.untested = []

    def _ended(self, loop: dict, end: int) -> None:
        name = loop["cursor"]
        if name is None or name.lower() not in self.names.cursors or loop["begin"] is None:
            return
        moved = self.moves[name.lower()]
        if bisect_left(moved, loop["begin"]) == len(moved):  # all moves so far are before the end
            self._warn("stuck", self.tokens[loop["at"]], name, name, name, name)

    def _settle(self) -> None:
        for paren, t in self.calls:
            commas, content = self.arguments[paren]
            given, low = commas + 1 if content else 0, t[1].lower()
            if low in ARITY:
                least, most = ARITY[low]
                if not least <= given <= most:
                    expected = least if least == most else f"{least}-{most}"
                    self._warn("arity", t, t[1], expected, given, t[1], expected, given)
            elif low not in rules.UNCHECKED_CALLS and low not in self.names.functions:
                self._warn("unknown", t, t[1], t[1])
        for cursor, state in self.states.items():
            if state == "OPENED":
                self._warn("left", NONE[:2] + (0, 0, 0), self.names.cursors[cursor], self.names.cursors[cursor])


def findings(sources: DataFrame) -> DataFrame:
    """file, findings for every row of ``sources`` (file, source): structural faults and what the five checks say.

    A null or empty source has none.
    """

    @F.arrow_udf(rules.FAULT)
    def find(texts: pa.Array) -> pa.Array:
        found = [[*rt.faults(t or ""), *Walk(list(rt.tokens(t or ""))).found] for t in texts.to_pylist()]
        return rules._arrays(found, {"severity": pa.string(), "message": pa.string(), **rules._PLACE})

    return sources.select("file", find("source").alias("findings"))


def summary(found: DataFrame) -> DataFrame:
    """file, errors, warnings, status for every row of ``findings``; a file without errors passes."""
    of = lambda severity: F.size(F.filter("findings", lambda f: f["severity"] == severity)).cast("long")
    counted = found.select("file", of("error").alias("errors"), of("warning").alias("warnings"))
    return counted.withColumn("status", F.when(F.col("errors") > 0, "fail").otherwise("ok"))
