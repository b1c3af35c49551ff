"""Column expressions on names, ids and paths. All of them run inside codegen'd stages."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, functions as F

SEPARATOR = "::"
#: Any of the three line ends; the parser counts lines by them too.
LINE_END = r"\r\n|\r|\n"


def entity_id(file_path: Column, scopes: Column) -> Column:
    """``file::A::b`` from a path and an array of scope names."""
    return F.when(F.size(scopes) > 0, F.concat(file_path, F.lit(SEPARATOR), F.array_join(scopes, SEPARATOR))).otherwise(
        file_path
    )


def id_parts(id_col: Column) -> Column:
    return F.split(id_col, SEPARATOR)


def last_segment(id_col: Column, separator: str = SEPARATOR) -> Column:
    """Text after the last separator (the whole text if there is none)."""
    return F.substring_index(id_col, separator, -1)


def ancestor_ids(id_col: Column) -> Column:
    """All proper ``::`` prefixes of an id, outermost first."""
    parts = id_parts(id_col)
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), SEPARATOR),
        ),
    ).otherwise(F.array().cast("array<string>"))


def is_upper(text: Column) -> Column:
    """At least one upper-case letter and no other cased letter."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_constant_name(name: Column) -> Column:
    """UPPER_CASE names; underscores carry no case, so one test covers both spellings."""
    return is_upper(name)


def looks_like_class(name: Column) -> Column:
    """Starts upper-case without being all upper-case."""
    return name.rlike(r"^\p{Lu}") & ~is_upper(name)


def directory(path: Column) -> Column:
    """Everything before the last ``/``; empty when there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(path: Column, base: str) -> Column:
    """``path`` below ``base``, or unchanged when it lies elsewhere."""
    prefix = base.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)


def matches_any_glob(path: Column, patterns: list[str]) -> Column:
    """Shell-style match on the full path or the file name; ``*`` also crosses ``/``."""
    hit = F.lit(False)
    for pattern in patterns:
        regex = "^" + _java_regex(pattern)
        hit = hit | path.rlike(regex) | base_name(path).rlike(regex)
    return hit


def _java_regex(pattern: str) -> str:
    # The translation ends in an anchor that Java spells differently.
    return fnmatch.translate(pattern).replace("(?>", "(?:").removesuffix(r"\z").removesuffix(r"\Z") + r"\z"


def code_slice(source: Column, line_number: Column, end_line: Column, window: int) -> Column:
    """Lines of an entity: from its first line to ``end_line``, else ``window`` lines."""
    lines = F.split(source, LINE_END)
    start = F.greatest(line_number, F.lit(1))
    has_end = end_line.isNotNull() & (end_line > 0)
    count = F.when(has_end, F.greatest(end_line - start + 1, F.lit(0))).otherwise(F.lit(window))
    return F.array_join(F.slice(lines, start, count), "\n")
