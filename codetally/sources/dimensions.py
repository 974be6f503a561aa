"""Constant relations: languages, licence fingerprints, aliases, defaults.

All of them are fixed and tiny (54 languages, 11 licences, 22 aliases), so they
are the only relations the engine ever broadcasts or inlines as literals.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Language, extensions, single-line markers, block opener, block
# closer, nesting flag. The position in the table is the report order.
LANGUAGES = [
    ("Ada", [".ada", ".adb", ".ads"], ["--"], "", "", False),
    ("Assembly", [".asm", ".s", ".S"], [";", "#"], "/*", "*/", False),
    ("AWK", [".awk"], ["#"], "", "", False),
    ("Bash", [".sh", ".bash", ".zsh", ".fish"], ["#"], ": '", "'", False),
    ("Basic", [".bas", ".vb", ".vbs"], ["'", "REM"], "", "", False),
    ("C", [".c", ".h"], ["//"], "/*", "*/", False),
    ("COBOL", [".cob", ".cbl", ".cpy"], ["*"], "", "", False),
    ("CPP", [".cpp", ".hpp", ".cc", ".hxx", ".cxx"], ["//"], "/*", "*/", False),
    ("CSharp", [".cs"], ["//"], "/*", "*/", False),
    ("CSS", [".css"], [], "/*", "*/", False),
    ("D", [".d"], ["//"], "/*", "*/", True),
    ("Dart", [".dart"], ["//"], "/*", "*/", False),
    ("Elixir", [".ex", ".exs"], ["#"], '@doc """', '"""', False),
    ("Elm", [".elm"], ["--"], "{-", "-}", True),
    ("Erlang", [".erl", ".hrl"], ["%"], "", "", False),
    ("FSharp", [".fs", ".fsx", ".fsi"], ["//"], "(*", "*)", True),
    ("Fortran", [".f", ".f90", ".f95", ".f03"], ["!"], "", "", False),
    ("Go", [".go"], ["//"], "/*", "*/", False),
    ("Groovy", [".groovy", ".gvy", ".gy", ".gsh"], ["//"], "/*", "*/", False),
    ("Haskell", [".hs", ".lhs"], ["--"], "{-", "-}", True),
    ("HTML", [".html", ".htm", ".xhtml"], [], "<!--", "-->", False),
    ("Java", [".java"], ["//"], "/*", "*/", False),
    ("JavaScript", [".js", ".jsx", ".mjs"], ["//"], "/*", "*/", False),
    ("JSON", [".json"], [], "", "", False),
    ("Julia", [".jl"], ["#"], "#=", "=#", True),
    ("Kotlin", [".kt", ".kts"], ["//"], "/*", "*/", True),
    ("Lisp", [".lisp", ".cl", ".el"], [";"], "#|", "|#", True),
    ("Lua", [".lua"], ["--"], "--[[", "]]", False),
    ("MATLAB", [".m", ".mat"], ["%"], "%{", "%}", False),
    ("Nim", [".nim"], ["#"], "#[", "]#", True),
    ("ObjectiveC", [".m", ".mm"], ["//"], "/*", "*/", False),
    ("OCaml", [".ml", ".mli"], [], "(*", "*)", True),
    ("Pascal", [".pas", ".pp"], ["//"], "{", "}", False),
    ("Perl", [".pl", ".pm", ".t"], ["#"], "=pod", "=cut", False),
    ("PHP", [".php"], ["//", "#"], "/*", "*/", False),
    ("PowerShell", [".ps1", ".psm1", ".psd1"], ["#"], "<#", "#>", False),
    ("Prolog", [".pl", ".pro", ".p"], ["%"], "/*", "*/", False),
    ("Python", [".py", ".pyw", ".pyx"], ["#"], '"""', '"""', False),
    ("R", [".r", ".R"], ["#"], "", "", False),
    ("Racket", [".rkt"], [";"], "#|", "|#", True),
    ("Ruby", [".rb", ".rake", ".gemspec"], ["#"], "=begin", "=end", False),
    ("Rust", [".rs"], ["//"], "/*", "*/", True),
    ("Scala", [".scala", ".sc"], ["//"], "/*", "*/", True),
    ("Scheme", [".scm", ".ss"], [";"], "#|", "|#", True),
    ("Shell", [".sh", ".bash", ".zsh", ".fish"], ["#"], ": '", "'", False),
    ("Smalltalk", [".st"], ['"'], '"', '"', False),
    ("SQL", [".sql"], ["--"], "/*", "*/", False),
    ("Swift", [".swift"], ["//"], "/*", "*/", True),
    ("Tcl", [".tcl"], ["#"], "", "", False),
    ("TypeScript", [".ts", ".tsx"], ["//"], "/*", "*/", False),
    ("VB", [".vb"], ["'"], "", "", False),
    ("VHDL", [".vhd", ".vhdl"], ["--"], "", "", False),
    ("XML", [".xml", ".svg", ".plist"], [], "<!--", "-->", False),
    ("Zig", [".zig"], ["//"], "", "", False),
]

# The open "any other extension" languages sort after every known one.
OTHER_ORDINAL = len(LANGUAGES)

# Spellings accepted by the ignore-language parameter.
LANGUAGE_ALIASES = {
    "ada": "Ada", "asm": "Assembly", "awk": "AWK", "bash": "Bash", "c": "C",
    "cpp": "CPP", "cs": "CSharp", "css": "CSS", "go": "Go", "hs": "Haskell",
    "html": "HTML", "java": "Java", "js": "JavaScript", "json": "JSON",
    "py": "Python", "rb": "Ruby", "rs": "Rust", "scala": "Scala", "sql": "SQL",
    "swift": "Swift", "ts": "TypeScript", "xml": "XML",
}

# Path fragments ignored always / with the hidden switch.
DEFAULT_IGNORE_DIRS = ["dist", "dist-newstyle", ".stack-work", "node_modules"]
HIDDEN_IGNORE_DIRS = [".git", ".hie", ".vscode"]

# Code points trimmed from both ends of a line or licence text.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)

# Lower-cased names of files that hold a licence.
LICENSE_FILENAMES = [
    "license", "licence", "copying", "copyright",
    "license.txt", "licence.txt", "license.md", "licence.md",
    "copying.txt", "copying.md", "license.rst",
    "unlicense", "unlicence", "copyright.txt",
    "license-mit", "license-apache", "license.mit", "license.apache",
    "mit-license", "apache-license", "license-bsd", "bsd-license",
]

# Characters removed from a licence text before matching.
LICENSE_DELETED_CHARS = ",.()[]{}\"'"

# Licence and its fingerprint phrases, in tie-break order (the
# later licence wins a tie).
LICENSE_FINGERPRINTS = [
    ("MIT", [
        "mit license",
        "permission is hereby granted, free of charge",
        "without restriction, including without limitation",
        "mit © ",
    ]),
    ("Apache2", [
        "apache license, version 2",
        "apache license 2",
        "licensed under the apache license",
        "www.apache.org/licenses",
        "apache-2.0",
    ]),
    ("GPL2", [
        "gnu general public license version 2",
        "gpl version 2",
        "gpl-2",
        "www.gnu.org/licenses/gpl-2",
        "either version 2 of the license",
    ]),
    ("GPL3", [
        "gnu general public license version 3",
        "gpl version 3",
        "gpl-3",
        "www.gnu.org/licenses/gpl-3",
        "either version 3 of the license",
    ]),
    ("BSD2", [
        "bsd 2-clause",
        "redistribution and use in source and binary",
        "2. redistributions in binary",
        "bsd-2-clause",
    ]),
    ("BSD3", [
        "bsd 3-clause",
        "redistribution and use in source and binary",
        "3. neither the name",
        "bsd-3-clause",
    ]),
    ("LGPL", [
        "gnu lesser general public license",
        "gnu library general public license",
        "www.gnu.org/licenses/lgpl",
        "lesser general public license",
        "either version 3 of the license",
    ]),
    ("MPL2", [
        "mozilla public license version 2",
        "mozilla public license 2",
        "mpl-2.0",
        "mozilla.org/MPL/2.0",
    ]),
    ("AGPL3", [
        "gnu affero general public license",
        "agpl version 3",
        "gnu agpl version 3",
        "www.gnu.org/licenses/agpl",
        "agpl-3.0",
    ]),
    ("Unlicense", [
        "this is free and unencumbered software",
        "unlicense",
        "unlicense.org",
    ]),
    ("ISC", [
        "isc license",
        "permission to use, copy, modify, and/or distribute this software",
        'the software is provided "as is"',
        "internet systems consortium",
    ]),
]

# Every phrase that can match contains one of these, so a text without any of
# them needs no phrase search at all. A test keeps the two lists consistent.
LICENSE_ANCHORS = [
    "license",
    "gpl",
    "-clause",
    "mit ©",
    "redistribution and use in source and binary",
    "free and unencumbered software",
    "internet systems consortium",
]

# Licence values that no fingerprint produces, as they are displayed.
CUSTOM_LICENSE = 'Custom "Unknown License"'
UNKNOWN_LICENSE = "Unknown"
CUSTOM_ORDINAL = len(LICENSE_FINGERPRINTS)
UNKNOWN_ORDINAL = CUSTOM_ORDINAL + 1

LANGUAGE_SCHEMA = pa.schema([
    ("ordinal", pa.int32()),
    ("language", pa.string()),
    ("extensions", pa.list_(pa.string())),
    ("single", pa.list_(pa.string())),
    ("multi_start", pa.string()),
    ("multi_end", pa.string()),
    ("nested", pa.bool_()),
])

EXTENSION_SCHEMA = pa.schema([
    ("ext", pa.string()),
    ("known_language", pa.string()),
    ("known_ordinal", pa.int32()),
])

FINGERPRINT_SCHEMA = pa.schema([
    ("ordinal", pa.int32()),
    ("license", pa.string()),
    ("total", pa.int32()),
    ("phrase", pa.string()),
])


def language_rows():
    return [(ordinal, *row) for ordinal, row in enumerate(LANGUAGES)]


def extension_rows():
    """One row per extension; a contested extension goes to the later language."""
    owner = {}
    for ordinal, (name, extensions, *_) in enumerate(LANGUAGES):
        for ext in extensions:
            owner[ext] = (ext, name, ordinal)
    return [owner[ext] for ext in sorted(owner)]


def can_match(phrase: str) -> bool:
    """A phrase with deleted or upper-case characters never occurs in
    normalised text: it counts in a licence's total but is not evaluated."""
    return phrase == phrase.lower() and not set(phrase) & set(LICENSE_DELETED_CHARS)


def fingerprint_rows():
    return [
        (ordinal, name, len(phrases), phrase)
        for ordinal, (name, phrases) in enumerate(LICENSE_FINGERPRINTS)
        for phrase in phrases
        if can_match(phrase)
    ]


def _relation(spark: SparkSession, rows, schema: pa.Schema) -> DataFrame:
    # An Arrow table of this size becomes a LocalRelation: no job builds it, and
    # its size is known to the planner.
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def languages(spark: SparkSession) -> DataFrame:
    """54 rows: the language dimension."""
    return _relation(spark, language_rows(), LANGUAGE_SCHEMA)


def extensions(spark: SparkSession) -> DataFrame:
    """105 rows: extension -> owning language."""
    return _relation(spark, extension_rows(), EXTENSION_SCHEMA)


def fingerprints(spark: SparkSession) -> DataFrame:
    """31 rows: the licence phrases that can match."""
    return _relation(spark, fingerprint_rows(), FINGERPRINT_SCHEMA)
