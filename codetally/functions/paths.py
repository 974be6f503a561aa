"""Path expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codetally.functions.matching import found_numbers
from codetally.sources.dimensions import LICENSE_FILENAMES

# More fragments than this are looked for in one pass, by an automaton.
MAX_LITERALS = 64


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty for a bare file name."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def extension(path: Column) -> Column:
    """From the last dot of the file name, dot included; empty without a dot."""
    name = basename(path)
    return F.when(
        name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))
    ).otherwise(F.lit(""))


def normalised(path: Column) -> Column:
    """Drop ``.`` components and repeated slashes; ``..`` is kept.

    Almost every path is already normal, so the regular expressions are run only
    on a path that shows a reason to.
    """
    single_slashes = F.regexp_replace(path, "/{2,}", "/")
    cleaned = F.regexp_replace(single_slashes, r"(^|/)(?:\./)+", "$1")
    suspect = path.contains("//") | path.contains("./")
    return F.when(suspect, cleaned).otherwise(path)


def in_slashes(path: Column) -> Column:
    """A normalised path with one slash on either side, so that components stand between slashes."""
    return F.concat(F.lit("/"), F.trim(path, F.lit("/")), F.lit("/"))


def component_fragments(fragments: list[str]) -> list[str]:
    """Fragments as they stand in :func:`in_slashes`; those without a component are left out."""
    parts = ([p for p in fragment.split("/") if p not in ("", ".")] for fragment in fragments)
    return ["/" + "/".join(p) + "/" for p in parts if p]


def is_ignored(path: Column, fragments: list[str], whole_components: bool = False) -> Column:
    """True when any fragment occurs anywhere in the normalised path.

    A plain substring test: ``dist`` also ignores ``distance.py`` and
    ``redistribute/``, and an empty fragment ignores everything. A fragment that
    contains another one adds nothing and is left out.

    With ``whole_components`` a fragment is one or more components in a row:
    ``dist`` ignores ``a/dist/b.py`` but neither of the above, ``a/b`` also
    ``x/a/b/c.py``, and an empty fragment nothing.
    """
    clean = normalised(path)
    if whole_components:
        clean, fragments = in_slashes(clean), component_fragments(fragments)
    fragments = list(dict.fromkeys(fragments))
    if "" in fragments:
        return clean.isNotNull()
    if len(fragments) > MAX_LITERALS:
        return F.size(found_numbers(clean, fragments)) > 0
    needed = [
        fragment
        for fragment in fragments
        if not any(other != fragment and other in fragment for other in fragments)
    ]
    return reduce(or_, [clean.contains(fragment) for fragment in needed], F.lit(False))


def is_license_name(path: Column) -> Column:
    """True when the file name, in any case, is that of a licence file."""
    return F.lower(basename(path)).isin(LICENSE_FILENAMES)


def ancestors(directory: Column) -> Column:
    """The directory itself and all its parents, as an array of paths."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda depth: F.array_join(F.slice(parts, 1, depth), "/"),
    )
