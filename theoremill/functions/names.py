"""Fully qualified names, modules and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of one library's old and new names.
STANDARD, OLD_PREFIXES = "Stdlib.", ("Coq.", "Corelib.")

# Declaration forms and the kinds they are stored as; other forms are definitions.
KINDS = {
    "lemma": "lemma",
    "theorem": "theorem",
    "definition": "definition",
    "let": "definition",
    "coercion": "definition",
    "canonical structure": "definition",
    "inductive": "inductive",
    "record": "inductive",
    "class": "inductive",
    "constructor": "constructor",
    "instance": "instance",
    "axiom": "axiom",
    "parameter": "axiom",
    "conjecture": "axiom",
}
UNINDEXED = ("notation", "abbreviation", "section variable", "ltac", "module")
PROVABLE = ("lemma", "theorem", "instance", "definition")


def module_of(name: str | Column) -> Column:
    """Everything in front of the last dot; '' without one."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def suffixes(name: str | Column) -> Column:
    """All proper dot-suffixes, the longest first."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.array_join(F.slice(parts, k, n), "."))


def alias_prefix(name: Column) -> Column:
    """The same prefix under the library's other name; null if it has none."""
    out = F.when(name.startswith(STANDARD), F.concat(F.lit(OLD_PREFIXES[0]), F.substring(name, len(STANDARD) + 1, 1 << 30)))
    for old in OLD_PREFIXES:
        out = out.when(name.startswith(old), F.concat(F.lit(STANDARD), F.substring(name, len(old) + 1, 1 << 30)))
    return out


def alias_symbol(name: Column) -> Column:
    """An old-style symbol under its new name; others unchanged."""
    out = None
    for old in OLD_PREFIXES:
        new = F.concat(F.lit(STANDARD), F.substring(name, len(old) + 1, 1 << 30))
        out = F.when(name.startswith(old), new) if out is None else out.when(name.startswith(old), new)
    return out.otherwise(name)


def source_of_module(module: Column, prefix: str = "") -> Column:
    """The source file of a module under an optional library prefix."""
    rest = F.when(module.startswith(prefix), F.substring(module, len(prefix) + 1, 1 << 30)).otherwise(module) if prefix else module
    return F.concat(F.replace(F.btrim(rest, F.lit(".")), F.lit("."), F.lit("/")), F.lit(".v"))


def local_name(name: Column, source: Column) -> Column:
    """A name inside its document: what follows the file's stem, else the last segment."""
    stem = F.regexp_extract(source, r"([^/]*?)(?:\.v)?$", 1)
    mark = F.concat(F.lit("."), stem, F.lit("."))
    at = F.instr(F.concat(F.lit("."), name), mark)
    return F.when((stem != "") & (at > 0), F.substr(name, at + F.length(stem) + 1)).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))


def kind_of_form(form: Column) -> Column:
    """Stored kind of a declaration form; null for forms that aren't indexed."""
    key = F.lower(form)
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(~key.isin(*UNINDEXED), F.coalesce(table[key], F.lit("definition")))


def is_placeholder(name: Column) -> Column:
    return name.rlike("^_.+_$")


def constants(text: str | Column) -> Column:
    """Distinct names that follow an @, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"@([A-Za-z_][A-Za-z0-9_'.]*)"), F.lit(1)))


def dotted_symbols(text: str | Column) -> Column:
    """Distinct dotted identifiers, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9_']*(?:\.[A-Za-z_][A-Za-z0-9_']*)+)"), F.lit(1)))
