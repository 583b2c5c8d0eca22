"""Path-derived fields and ordered tag rules of source files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusops.functions.text import blank_to_null

FIELDS = ("module", "routine_name", "heading_path", "context", "product", "version")

# Extensions kept and folders never entered.
EXTENSIONS = [".lsp", ".prg", ".src", ".txt", ".sql", ".xml"]
SKIPPED_DIRS = [".git", "node_modules", "dist", "build", "output", ".next", ".cache"]


@dataclass(frozen=True)
class TagRule:
    match: str
    module: str | None = None
    routine_name: str | None = None
    heading_path: str | None = None
    context: str | None = None
    product: str | None = None
    version: str | None = None


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension(path: Column) -> Column:
    """Lower-cased last suffix of the file name, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def allowed_extension(path: Column, kept: list[str] = EXTENSIONS) -> Column:
    return extension(path).isin([e.lower() for e in kept])


def path_ignored(path: Column, relative: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        if p.strip():
            u = p.strip().upper()
            hit = hit | F.upper(forward_slashes(path)).contains(u) | F.upper(relative).contains(u)
    return hit


def relative_path(path: Column, base: Column, root: Column) -> Column:
    """Path below its base folder; extra bases put their own name in front."""
    rel = F.when(
        F.startswith(path, F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 2)
    ).otherwise(F.element_at(F.split(path, "/"), -1))
    name = F.element_at(F.split(base, "/"), -1)
    return F.when((base == root) | (name == ""), rel).otherwise(F.concat_ws("/", name, rel))


def module_name(relative: Column) -> Column:
    parts = F.filter(F.split(relative, "/"), lambda s: s != "")
    return F.when(F.size(parts) <= 1, "root").otherwise(F.get(parts, F.lit(0)))


def routine_from_file(relative: Column) -> Column:
    name = F.element_at(F.split(F.regexp_replace(relative, "/+$", ""), "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(blank_to_null(stem), F.lit("routine"))


def source_key(relative: Column, path: Column) -> Column:
    return F.concat_ws("::", relative, forward_slashes(path))


def apply_rules(path: Column, relative: Column, rules: list[TagRule],
                module: Column, routine: Column) -> dict[str, Column]:
    """Six tag columns: for each, the last matching rule that sets it, else its default.

    The rules are configuration, so they become one CASE per column: no join, no shuffle.
    """
    upper_path, upper_rel = F.upper(forward_slashes(path)), F.upper(relative)

    def last_set(field: str, default: Column | None) -> Column:
        out = None
        for rule in reversed(rules):
            value = getattr(rule, field)
            if not value or not rule.match.strip():
                continue
            m = rule.match.strip().upper()
            hit = upper_path.contains(m) | upper_rel.contains(m)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        empty = default if default is not None else F.lit(None).cast("string")
        return empty if out is None else out.otherwise(empty)

    tags = {"module": last_set("module", module), "routine_name": last_set("routine_name", routine)}
    tags["heading_path"] = last_set("heading_path", routine)
    for field in ("context", "product", "version"):
        tags[field] = last_set(field, None)
    return tags
