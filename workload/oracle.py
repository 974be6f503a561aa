"""DuckDB equivalents of the registered queries.

They restate the rules line by line over VALUES lists of the constant relations;
nothing of the Spark plans is reused.
"""

from __future__ import annotations

from codetally.sources import dimensions as dims
from workload import tables as t
from workload.queries import ALL_ALIASES, IGNORE_DIRS, IGNORE_LANGS, MANY_FRAGMENTS


def text(value: str) -> str:
    """A string literal; control and non-ASCII characters are spelled with chr()."""
    pieces, plain = [], ""
    for char in value:
        if " " <= char < "\x7f":
            plain += char.replace("'", "''")
        else:
            pieces += [f"'{plain}'", f"chr({ord(char)})"]
            plain = ""
    pieces.append(f"'{plain}'")
    kept = [piece for piece in pieces if piece != "''"] or ["''"]
    return kept[0] if len(kept) == 1 else "(" + " || ".join(kept) + ")"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def pick(values: list[str], index: str) -> str:
    return f"{strings(values)}[CAST({index} % {len(values)} AS INTEGER) + 1]"


def with_clause(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- dimensions


def _extension_values() -> str:
    rows = []
    for ext, name, ordinal in dims.extension_rows():
        single = dims.LANGUAGES[ordinal][2] + [None, None]
        markers = ", ".join("NULL" if m is None else text(m) for m in single[:2])
        opener = text(dims.LANGUAGES[ordinal][3])
        rows.append(f"({text(ext)}, {text(name)}, {ordinal}, {markers}, {opener})")
    return ",\n".join(rows)


KNOWN = f"known(ext, name, ordinal, s0, s1, opener) AS (VALUES {_extension_values()})"

FINGERPRINTS = "fingerprints(ordinal, license, total, phrase) AS (VALUES " + ",\n".join(
    f"({ordinal}, {text(name)}, {len(phrases)}, {text(phrase)})"
    for ordinal, (name, phrases) in enumerate(dims.LICENSE_FINGERPRINTS)
    for phrase in phrases
) + ")"

# -------------------------------------------------------------- derived files


def _shape_cases() -> str:
    cases = []
    for number, (before, after) in enumerate(t.LINE_SHAPES):
        cases.append(f"WHEN {number} THEN {text(before)} || x || {text(after)}")
    return " ".join(cases)


SHAPED = f"""array_to_string(list_transform(string_split(text, chr(10)),
        lambda x, i: CASE (i - 1 + doc_id) % {len(t.LINE_SHAPES)} {_shape_cases()} END), chr(10))"""


SOURCE_FILES = f"""files AS (
  SELECT source AS repo,
    'r/' || source || '/' || {pick(t.DIRECTORIES, "doc_id")}
      || CASE WHEN extra THEN '/e' ELSE '/f' END || doc_id || {pick(t.EXTENSIONS, "doc_id")} AS path,
    NOT extra AND doc_id % 89 = 88 AS invalid,
    CASE WHEN extra THEN '' ELSE
      {SHAPED} || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END
    END AS content
  FROM (SELECT *, false AS extra FROM documents
    UNION ALL SELECT *, true FROM documents WHERE doc_id % 97 = 0))"""

LARGE_FILES = f"""files AS (
  SELECT 'large' AS repo, 'r/large/f' || number || {pick(t.EXTENSIONS, "number")} AS path,
    number % 2 = 1 AS invalid, string_agg(shaped || chr(10), '' ORDER BY doc_id) AS content
  FROM (SELECT doc_id, doc_id // {t.DOCUMENTS_PER_LARGE_FILE} AS number, {SHAPED} AS shaped
    FROM documents)
  GROUP BY number)"""

PAGE_FILES = f"""files AS (
  SELECT string_split(url, '/')[3] AS repo,
    'w/' || page_id || {pick(t.PAGE_EXTENSIONS, "page_id")} AS path,
    false AS invalid, html AS content
  FROM pages)"""

# --------------------------------------------------------- languages and lines


def ignored_path(fragments: list[str]) -> str:
    clean = r"regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '(^|/)(\./)+', '\1', 'g')"
    return " OR ".join(f"contains({clean}, {text(f)})" for f in fragments) or "false"


LOCATED = r"""located AS (
  SELECT f.*, e.ext, coalesce(k.name, nullif(substr(e.ext, 2), '')
      , CASE WHEN e.ext = '.' THEN '' END) AS language,
    CAST(CASE WHEN e.ext <> '' THEN coalesce(k.ordinal, %d) END AS INTEGER) AS ordinal,
    CASE WHEN e.ext <> '' THEN k.ordinal IS NULL END AS is_other, k.s0, k.s1, k.opener
  FROM (SELECT *, regexp_extract(path, '(\.[^./]*)$', 1) AS ext FROM files) e
  JOIN files f USING (path) LEFT JOIN known k ON k.ext = e.ext)""" % dims.OTHER_ORDINAL


def eligible(fragments: list[str], ignore_langs: list[str] = ()) -> str:
    dropped = []
    for alias in ignore_langs:
        name = dims.LANGUAGE_ALIASES.get(alias)
        dropped.append(
            f"(NOT is_other AND language = {text(name)})" if name
            else f"(is_other AND language = {text(alias)})"
        )
    return f"""eligible AS (SELECT * FROM located
      WHERE language IS NOT NULL AND NOT ({ignored_path(fragments)})
        AND NOT ({" OR ".join(dropped) or "false"}))"""


LINES = f"""pieces AS (
  SELECT repo, path, language, ordinal, is_other, s0, s1, opener,
    CASE WHEN invalid THEN [] ELSE string_split(content, chr(10)) END AS split
  FROM eligible),
numbered AS (
  SELECT pieces.*, trim(u.piece, {text(dims.WHITESPACE)}) AS line,
    CAST(u.i - 1 AS BIGINT) AS pos
  FROM pieces, LATERAL (SELECT unnest(split) AS piece, unnest(range(1, len(split) + 1)) AS i) u
  WHERE NOT (u.i = len(split) AND u.piece = '')),
lines AS (
  SELECT repo, path, language, ordinal, is_other, pos,
    CASE WHEN line = '' THEN 'blank'
         WHEN is_other THEN 'code'
         WHEN coalesce(starts_with(line, s0), false) OR coalesce(starts_with(line, s1), false)
           THEN 'single'
         WHEN starts_with(line, opener) THEN 'multi'
         ELSE 'code' END AS kind
  FROM numbered)"""

COUNTS = ", ".join(
    f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS {kind}"
    for kind in ("blank", "code", "single", "multi")
)
FILE_STATS = f"""file_stats AS (
  SELECT e.repo, e.path, e.language, e.ordinal, e.is_other, CAST(1 AS BIGINT) AS files, {COUNTS}
  FROM eligible e LEFT JOIN lines l USING (path) GROUP BY ALL)"""
SUMS = ", ".join(
    f"CAST(sum({name}) AS BIGINT) AS {name}" for name in ("files", "blank", "code", "single", "multi")
)

LANGUAGE_KEY = "language, ordinal, is_other"
DEFAULTS = dims.DEFAULT_IGNORE_DIRS


def stats_ctes(files: str, fragments: list[str] = DEFAULTS) -> tuple[str, ...]:
    return (KNOWN, files, LOCATED, eligible(fragments), LINES, FILE_STATS)


def located_query(fragments, ignore_langs=()):
    return with_clause(KNOWN, SOURCE_FILES, LOCATED, eligible(fragments, ignore_langs)) + (
        f"SELECT repo, path, ext, {LANGUAGE_KEY} FROM eligible"
    )


def stats_query(files=SOURCE_FILES, by="", fragments=DEFAULTS):
    return with_clause(*stats_ctes(files, fragments)) + (
        f"SELECT {by}{LANGUAGE_KEY}, {SUMS} FROM file_stats GROUP BY ALL"
    )


SUBTREES = with_clause(*stats_ctes(SOURCE_FILES)) + f"""
SELECT array_to_string(parts[1:u.depth], '/') AS directory, {LANGUAGE_KEY}, {SUMS}
FROM (SELECT *, string_split(path, '/') AS parts FROM file_stats),
  LATERAL (SELECT unnest(range(1, len(parts))) AS depth) u
GROUP BY ALL"""

COMBINED = f"""SELECT {LANGUAGE_KEY}, {SUMS} FROM (
  SELECT * FROM ({stats_query()}) UNION ALL SELECT * FROM ({stats_query(PAGE_FILES)})
) GROUP BY ALL"""

# --------------------------------------------------------------------- reports


def summary_query(by: str = "") -> str:
    measures = """CAST(sum(blank) AS BIGINT) AS blank,
      CAST(sum(single + multi) AS BIGINT) AS comment, CAST(sum(code) AS BIGINT) AS code"""
    group = f"GROUP BY {by.rstrip(', ')}" if by else "HAVING count(*) > 0"
    keyed = "GROUP BY ALL"
    return with_clause(*stats_ctes(SOURCE_FILES)) + f"""
    SELECT {by}language, CAST(sum(files) AS BIGINT) AS files, {measures}
      FROM file_stats WHERE NOT is_other {keyed}
    UNION ALL
    SELECT {by}'Other', CAST(sum(files) + 1 AS BIGINT), {measures}
      FROM file_stats WHERE is_other {group}
    UNION ALL
    SELECT {by}'Total', CAST(sum(files) + 1 AS BIGINT), {measures} FROM file_stats {group}"""


_NAMES = ", ".join(f"({i}, {text(name)})" for i, (name, *_) in enumerate(dims.LANGUAGES))
SUMMARY_POSITIONS = f"""SELECT s.*, row_number() OVER (ORDER BY
    CASE s.language WHEN 'Other' THEN 1 WHEN 'Total' THEN 2 ELSE 0 END, n.ordinal) - 1 AS position
FROM ({summary_query()}) s LEFT JOIN (VALUES {_NAMES}) n(ordinal, name) ON n.name = s.language"""

SUMMARY_LINES = f"""SELECT printf('%-12s %7d %8d %9d %8d', language, files, blank, comment, code) AS line
FROM ({summary_query()})"""

# -------------------------------------------------------------------- licences

_PHRASES = [*t.PHRASES, ""]
LICENSE_TEXTS = f"""texts AS (
  SELECT doc_id, text || chr(10) || upper({pick(_PHRASES, "doc_id")}) || chr(10)
    || {pick(_PHRASES, f"(doc_id // {len(_PHRASES)})")} AS text
  FROM documents)"""
DOCUMENT_TEXTS = "texts AS (SELECT doc_id, text FROM documents)"

LICENSE_REPOS = f"""repos AS (
  SELECT kind || doc_id AS repo,
    kind || doc_id || '/' || {pick(t.LICENSE_DIRECTORIES, "doc_id")}
      || {pick(t.LICENSE_NAMES, "doc_id")} AS path,
    CASE WHEN kind = 'p/e' THEN '' ELSE text END AS content
  FROM (SELECT *, 'p/' AS kind FROM texts
    UNION ALL SELECT *, 'p/e' FROM texts WHERE doc_id % 97 = 0)),
candidates AS (
  SELECT repo AS doc_id, repo, path, regexp_extract(path, '[^/]*$') AS file, content AS text FROM repos
  WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) = repo
    AND lower(regexp_extract(path, '[^/]*$')) IN ({", ".join(map(text, dims.LICENSE_FILENAMES))}))"""


def scored(relation: str) -> str:
    deleted = text(dims.LICENSE_DELETED_CHARS)
    return f"""normal AS (
  SELECT doc_id, lower(trim(translate(text, {deleted}, ''), {text(dims.WHITESPACE)})) AS norm
  FROM {relation}),
scores AS (
  SELECT doc_id, license, CAST(ordinal AS INTEGER) AS ordinal,
    CAST(sum(CASE WHEN contains(norm, phrase) THEN 1 ELSE 0 END) AS INTEGER) AS matches,
    CAST(total AS INTEGER) AS total,
    least(1.0::DOUBLE, sum(CASE WHEN contains(norm, phrase) THEN 1 ELSE 0 END)::DOUBLE
      / total::DOUBLE * 1.5::DOUBLE) AS score
  FROM normal, fingerprints GROUP BY doc_id, license, ordinal, total)"""


def scores_query(texts: str) -> str:
    return with_clause(FINGERPRINTS, texts, scored("texts")) + (
        "SELECT doc_id, license, ordinal, matches, total, score FROM scores"
    )


def best(relation: str) -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal DESC) AS place
  FROM scores WHERE score > 0.3::DOUBLE),
best AS (
  SELECT c.*, coalesce(r.license, CASE WHEN c.text = '' THEN {text(dims.UNKNOWN_LICENSE)}
      ELSE {text(dims.CUSTOM_LICENSE)} END) AS license,
    CAST(coalesce(r.ordinal, CASE WHEN c.text = '' THEN {dims.UNKNOWN_ORDINAL}
      ELSE {dims.CUSTOM_ORDINAL} END) AS INTEGER) AS ordinal,
    CASE WHEN r.license IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
    coalesce(r.score, 0.0::DOUBLE) AS score
  FROM {relation} c LEFT JOIN ranked r ON r.doc_id = c.doc_id AND r.place = 1)"""


def classify_query(texts: str) -> str:
    return with_clause(FINGERPRINTS, texts, scored("texts"), best("texts")) + (
        "SELECT doc_id, license, ordinal, confidence, score FROM best"
    )


LICENSE_REPORT = with_clause(
    FINGERPRINTS, LICENSE_TEXTS, LICENSE_REPOS, scored("candidates"), best("candidates")
) + """SELECT repo, file, license, confidence, score,
  printf('%.0f%%', confidence * 100) AS confidence_pct,
  printf('%-12s (%.0f%% confidence) in %s', license, confidence * 100, file) AS line
FROM best"""

# ---------------------------------------------------------- block comments


def _block_values() -> str:
    rows = []
    for ordinal, (_, _, _, opener, closer, nested) in enumerate(dims.LANGUAGES):
        if opener:
            both = sorted({opener, closer}, key=len, reverse=True)
            escaped = "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in token) for token in both)
            rows.append(f"({ordinal}, {text(opener)}, {text(closer)}, {str(nested).lower()}, {text(escaped)})")
    return ",\n".join(rows)


_IS_SINGLE = "(coalesce(starts_with(line, s0), false) OR coalesce(starts_with(line, s1), false))"
BLOCK_LINES = "WITH RECURSIVE " + ",\n".join([
    KNOWN, SOURCE_FILES, LOCATED, eligible(DEFAULTS), LINES,
    f"blocks(ordinal, opens, closes, nested, tokens) AS (VALUES {_block_values()})",
    """marked AS (
  SELECT n.*, b.opens, list_transform(regexp_extract_all(line, tokens), lambda t:
      CASE WHEN opens = closes THEN 3 WHEN t = opens AND nested THEN 2 WHEN t = opens THEN 1 ELSE 0 END) AS codes
  FROM numbered n LEFT JOIN blocks b USING (ordinal))""",
    f"""walk AS (
  SELECT path, CAST(-1 AS BIGINT) AS pos, 0 AS before, 0 AS after FROM eligible
  UNION ALL
  SELECT w.path, m.pos, w.after, CASE
      WHEN codes IS NULL OR w.after = 0 AND {_IS_SINGLE} THEN w.after
      ELSE list_reduce(list_prepend(w.after, codes), lambda x, c: CASE c
        WHEN 3 THEN 1 - x WHEN 2 THEN least(x + 1, 15) WHEN 1 THEN 1 ELSE greatest(x - 1, 0) END) END
  FROM walk w JOIN marked m ON m.path = w.path AND m.pos = w.pos + 1)""",
]) + f"""
SELECT repo, path, language, is_other, pos, CASE WHEN line = '' THEN 'blank' WHEN before > 0 THEN 'multi'
    WHEN is_other THEN 'code' WHEN {_IS_SINGLE} THEN 'single'
    WHEN coalesce(starts_with(line, opens), false) THEN 'multi' ELSE 'code' END AS kind
FROM marked JOIN walk USING (path, pos)"""

ORACLE: dict[str, str] = {
    "lines_with_blocks": BLOCK_LINES,
    "lines_with_blocks_cut": BLOCK_LINES,
    "language_detect": with_clause(KNOWN, SOURCE_FILES, LOCATED)
    + f"SELECT repo, path, ext, {LANGUAGE_KEY} FROM located",
    "eligible_files": located_query(DEFAULTS),
    "eligible_files_hidden": located_query(
        [*DEFAULTS, *IGNORE_DIRS, *dims.HIDDEN_IGNORE_DIRS]
    ),
    "ignore_lang_alias": located_query(DEFAULTS, IGNORE_LANGS),
    "ignore_lang_all_aliases": located_query(DEFAULTS, ALL_ALIASES),
    "eligible_files_components": with_clause(KNOWN, SOURCE_FILES, LOCATED, eligible([]))
    + f"""SELECT repo, path, ext, {LANGUAGE_KEY} FROM (
      SELECT *, list_filter(string_split(path, '/'), lambda p: p NOT IN ('', '.')) AS parts FROM eligible)
    WHERE len(list_filter(range(1, len(parts) + 1), lambda i:
        parts[i] IN ({", ".join(map(text, [*DEFAULTS, *dims.HIDDEN_IGNORE_DIRS, "src", "src1"]))})
        OR parts[i] = 'a' AND parts[i + 1] = 'b')) = 0""",
    "eligible_files_many_fragments": located_query([*DEFAULTS, *IGNORE_DIRS, *MANY_FRAGMENTS]),
    "eligible_files_fragment_table": with_clause(KNOWN, SOURCE_FILES, LOCATED, eligible(DEFAULTS))
    + f"""SELECT repo, path, ext, {LANGUAGE_KEY} FROM eligible
    WHERE NOT regexp_matches(path, '/f[0-9]+\\.py')""",
    "ignore_lang_table": with_clause(KNOWN, SOURCE_FILES, LOCATED, eligible(DEFAULTS, IGNORE_LANGS))
    + f"""SELECT repo, path, ext, {LANGUAGE_KEY} FROM eligible
    WHERE NOT (is_other AND language IN (SELECT string_split(text, ' ')[1] FROM documents))""",
    "license_scores_table": with_clause(FINGERPRINTS, LICENSE_TEXTS, scored("texts"))
    + "SELECT doc_id, license, ordinal, matches, total, score FROM scores WHERE matches > 0",
    "count_source_files_none": with_clause(KNOWN, SOURCE_FILES, LOCATED, eligible([""]))
    + "SELECT count(*) AS files FROM eligible",
    "count_source_files": with_clause(KNOWN, SOURCE_FILES, LOCATED, eligible(DEFAULTS))
    + "SELECT count(*) AS files FROM eligible",
    "classified_lines": with_clause(KNOWN, SOURCE_FILES, LOCATED, eligible(DEFAULTS), LINES)
    + "SELECT repo, path, language, is_other, pos, kind FROM lines",
    "file_stats": with_clause(*stats_ctes(SOURCE_FILES))
    + "SELECT * EXCLUDE (ordinal) FROM file_stats",
    "language_stats": stats_query(),
    "language_stats_by_repo": stats_query(by="repo, "),
    "language_stats_single_file": stats_query(fragments=[]),
    "language_stats_pages": stats_query(PAGE_FILES),
    "subtree_stats": SUBTREES,
    "combine_stats": COMBINED,
    "summary_report": summary_query(),
    "summary_report_by_repo": summary_query("repo, "),
    "summary_report_positions": SUMMARY_POSITIONS,
    "summary_lines": SUMMARY_LINES,
    "license_files": with_clause(LICENSE_TEXTS, LICENSE_REPOS)
    + "SELECT repo, path, file FROM candidates",
    "license_scores": scores_query(LICENSE_TEXTS),
    "license_scores_documents": scores_query(DOCUMENT_TEXTS),
    "classify_license": classify_query(LICENSE_TEXTS),
    "classify_license_documents": classify_query(DOCUMENT_TEXTS),
    "license_report": LICENSE_REPORT,
    "source_tree_stats": stats_query(),
    "source_tree_pruned": stats_query(
        fragments=[*DEFAULTS, *IGNORE_DIRS, *dims.HIDDEN_IGNORE_DIRS]
    ),
    "source_tree_single_file": stats_query(fragments=[]),
    "source_tree_large": with_clause(*stats_ctes(LARGE_FILES))
    + "SELECT * EXCLUDE (ordinal) FROM file_stats",
    "source_tree_license_report": LICENSE_REPORT,
    "source_tree_count": with_clause(KNOWN, SOURCE_FILES, LOCATED, eligible(DEFAULTS))
    + "SELECT repo, count(*) AS files FROM eligible GROUP BY repo",
    "source_tree_eligible": with_clause(
        KNOWN, SOURCE_FILES, LOCATED,
        eligible([*DEFAULTS, *IGNORE_DIRS, *dims.HIDDEN_IGNORE_DIRS], IGNORE_LANGS), LINES, FILE_STATS,
    ) + f"SELECT repo, {LANGUAGE_KEY}, {SUMS} FROM file_stats GROUP BY ALL",
    "source_tree_root_licenses": LICENSE_REPORT,
    "summary_report_empty": with_clause(*stats_ctes(SOURCE_FILES, [""])) + f"""
    SELECT repo, looked_at, language, total AS files, blank, comment, code
    FROM (SELECT repo, count(*) AS looked_at FROM files GROUP BY repo)
    LEFT JOIN (SELECT repo, language, CAST(sum(files) AS BIGINT) AS total,
        CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(single + multi) AS BIGINT) AS comment,
        CAST(sum(code) AS BIGINT) AS code
      FROM file_stats GROUP BY repo, language) USING (repo)""",
    "large_rows_file_stats": with_clause(*stats_ctes(SOURCE_FILES))
    + "SELECT * EXCLUDE (ordinal) FROM file_stats",
    "large_rows_lines": with_clause(KNOWN, SOURCE_FILES, LOCATED, eligible(DEFAULTS), LINES)
    + "SELECT repo, path, language, is_other, pos, kind FROM lines",
    "files_table_file_stats": with_clause(*stats_ctes(SOURCE_FILES))
    + "SELECT * EXCLUDE (ordinal) FROM file_stats",
    "files_table_stats": stats_query(by="repo, "),
    "files_table_license_report": LICENSE_REPORT,
}
