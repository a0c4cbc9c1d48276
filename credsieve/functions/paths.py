"""Path parts and glob predicates."""

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.lets import let


def basename(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension with its dot; a leading dot alone makes no extension."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)\z", 1))


def glob_match(path: Column, glob: str) -> Column:
    """Shell-style match over the whole path, where ``*`` also crosses ``/``.

    Globs made of literal text with stars at the ends become prefix, suffix or containment
    tests, which cost far less per row than a regular expression.
    """
    core = glob.strip("*")
    if not any(c in core for c in "*?["):
        before, after = glob.startswith("*"), glob.endswith("*")
        if not core:
            return F.lit(True) if before else path == ""
        if before and after:
            return path.contains(core)
        if before:
            return path.endswith(core)
        if after:
            return path.startswith(core)
        return path == core
    return path.rlike(r"\A" + fnmatch.translate(glob).replace(r"\Z", r"\z"))


def ignored_by(path: Column, globs: list[str]) -> Column:
    """True where any ignore glob covers the path.

    A glob is tried on the full path; a leading ``**/`` may also stand for nothing; and what
    follows the last ``**`` may match the full path or the bare file name.
    """
    # The path is bound, as the filter is pushed to where a path may be put together from columns.
    return let(path, lambda p: _any_glob(p, globs)) if globs else F.lit(False)


def _any_glob(path: Column, globs: list[str]) -> Column:
    tests: dict[tuple[str, str], Column] = {}
    name = basename(path)
    for glob in globs:
        tests["path", glob] = glob_match(path, glob)
        if glob.startswith("**/"):
            tests["path", glob[3:]] = glob_match(path, glob[3:])
        _, stars, tail = glob.rpartition("**")
        tail = tail.lstrip("/")
        if stars and tail:
            tests["path", tail] = glob_match(path, tail)
            tests["name", tail] = glob_match(name, tail)
    # One value and not a chain of ORs: a negated chain falls apart into dozens of filters, and
    # planning time grows steeply with those.
    return F.greatest(F.lit(False), *tests.values())
