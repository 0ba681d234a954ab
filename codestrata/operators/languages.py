"""The registry of languages: which files a language takes, and how its facts are found.

A language gives, for files (repo, path, content), tables of facts in the columns of the built-in ones: symbols, imports, calls, routes; those that it
lacks are left out. Registered languages take part in every ``Analysis`` made afterwards.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import suffix_of

Extract = Callable[[DataFrame], dict[str, DataFrame]]


@dataclass(frozen=True)
class Language:
    name: str
    suffixes: tuple[str, ...]
    #: None for the languages that the package knows itself.
    extract: Extract | None = None


_REGISTRY: dict[str, Language] = {}

#: How Python files are read: by their syntax tree, with patterns where that fails, or by patterns alone.
PARSER_MODES = ("syntax", "pattern")


def register(name: str, suffixes: tuple[str, ...] | list[str], extract: Extract | None = None) -> Language:
    """Adds a language, or replaces the one of that name. A suffix belongs to one language."""
    taken = {s: x.name for x in _REGISTRY.values() if x.name != name for s in x.suffixes}
    if clash := [s for s in suffixes if s.lower() in taken]:
        raise ValueError(f"{clash[0]} belongs to {taken[clash[0].lower()]}")
    _REGISTRY[name] = Language(name, tuple(s.lower() for s in suffixes), extract)
    return _REGISTRY[name]


def unregister(name: str) -> None:
    _REGISTRY.pop(name, None)


def registered() -> list[Language]:
    return list(_REGISTRY.values())


def suffixes() -> list[str]:
    return [s for x in _REGISTRY.values() for s in x.suffixes]


def language_of(path: Column) -> Column:
    """The registered language of a path by its suffix, in any case of letters; null if none takes it."""
    pairs = [(s, x.name) for x in _REGISTRY.values() for s in x.suffixes]
    return F.create_map(*(F.lit(v) for pair in pairs for v in pair))[suffix_of(path)] if pairs else F.lit(None).cast("string")


def extracted(files: DataFrame, table: str) -> list[DataFrame]:
    """The named table of every registered language that brings one."""
    out = []
    for x in _REGISTRY.values():
        if x.extract and (found := x.extract(files.where(suffix_of(F.col("path")).isin(list(x.suffixes)))).get(table)) is not None:
            out.append(found)
    return out


def parser_mode(mode: str | None = None) -> str:
    """The mode asked for, else that of the environment variable CODESTRATA_PARSER, else 'syntax'."""
    mode = mode or os.environ.get("CODESTRATA_PARSER") or "syntax"
    if mode not in PARSER_MODES:
        raise ValueError(f"parser mode {mode!r} is not among {PARSER_MODES}")
    return mode


register("python", fixed.PY_SUFFIXES)
register("javascript", fixed.JS_SUFFIXES)
