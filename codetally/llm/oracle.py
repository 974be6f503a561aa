"""SQL equivalents of the queries that SQL can express."""

from __future__ import annotations

# Shingles are sets of five consecutive words; the SQL looks up those of the items.
OP9 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), item_shingles AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS length,
    unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS shingle
  FROM item_words WHERE len(w) > 0
), sizes AS (
  SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id
), lengths AS (
  SELECT DISTINCT length FROM item_shingles
), doc_shingles AS (
  SELECT DISTINCT doc_id, length,
    unnest(list_transform(range(1, len(w) - length + 2), lambda i: array_to_string(w[i:i+length-1], ' '))) AS shingle
  FROM words, lengths WHERE len(w) >= length
), shared AS (
  SELECT d.doc_id, i.item_id, count(*) AS n_shared
  FROM doc_shingles d JOIN item_shingles i USING (length, shingle)
  GROUP BY d.doc_id, i.item_id
)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id)
WHERE n_shared >= 0.8 * n_item
"""


OP1 = r"""
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS kept,
    regexp_matches(html, '\*\*\*|%%%|\$\$\$|!!|://[^/]*(casino-win|cheap-pills|free-bets|spam-farm)')
      OR regexp_matches(url, '\*\*\*|%%%|\$\$\$|!!|://[^/]*(casino-win|cheap-pills|free-bets|spam-farm)') AS marked
  FROM pages
), canonical AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url
  FROM parsed
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM canonical
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN url IN (SELECT url FROM canonical WHERE marked AND url IS NOT NULL) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


OP3 = r"""
WITH turns AS (
  SELECT conv_id AS pair_id, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS position
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)
), worse AS (
  SELECT pair_id, position, role, text,
    CASE WHEN role = 'assistant'
      AND 2 * count(*) FILTER (role = 'assistant') OVER (PARTITION BY pair_id ORDER BY position)
        > count(*) FILTER (role = 'assistant') OVER (PARTITION BY pair_id)
      THEN coalesce(lag(text) OVER (PARTITION BY pair_id ORDER BY position), '') ELSE text END AS echo
  FROM turns
), prefixes AS (
  SELECT pair_id, coalesce(min(position) FILTER (text <> echo), max(position) + 1) AS prefix
  FROM worse GROUP BY pair_id
), parts AS (
  SELECT pair_id, 'prompt' AS part, position, role, text
  FROM worse JOIN prefixes USING (pair_id) WHERE position < prefix
  UNION ALL
  SELECT pair_id, 'chosen', position, role, text
  FROM worse JOIN prefixes USING (pair_id) WHERE position >= prefix
  UNION ALL
  SELECT pair_id, 'rejected', position, role, echo
  FROM worse JOIN prefixes USING (pair_id) WHERE position >= prefix
), rendered AS (
  SELECT pair_id, part, position, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
  FROM parts
), summed AS (
  SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY position)::BIGINT AS stop FROM rendered
)
SELECT pair_id, part, position, role, rendered, part <> 'prompt' AND role = 'assistant' AS trained,
  stop - length(rendered) AS start, stop
FROM summed
"""


OP11 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i,
    unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS words
  FROM words WHERE len(w) >= 13
), firsts AS (
  SELECT words, min(doc_id) AS least FROM windows GROUP BY words
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (words) WHERE least < doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words)
  ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id) USING (doc_id)
"""


OP12 = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
    list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (
    PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# The rules once more, for the SQL alone. Words stand for themselves with a space on
# both sides; ~ is a licence, @v a version, (a|b) either word, a? a word that may lack.
OP4_FIXED = """
mit;4;obtaining a copy;permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit;3;substantial portions;this permission notice shall be included in all copies or substantial portions of the software
mit;2;noninfringement;the warranties of merchantability fitness for a particular purpose and noninfringement
x11;3;except as contained;except as contained in this notice the (name|names) of
bsl-1;4;person or organization;permission is hereby granted free of charge to any person or organization obtaining a copy of the software
isc;4;without fee;permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted
bsd-0-clause;4;without fee;permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
postgresql;4;without fee;for any purpose without fee and without a written agreement is hereby granted
hpnd;3;its documentation;permission to use copy modify and or? distribute this software and its documentation for any purpose
bsd;3;redistribution;redistribution and use in source and binary forms with or without modification are permitted
bsd;2;redistributions;redistributions (of|in) (source|binary) (code|form) must (retain|reproduce) the above copyright notice this list of conditions
bsd-3-clause;4;endorse or promote;may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause;4;acknowledgement;all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2;3;in compliance with;you may not use this file except in compliance with the license
apache-2;4;an as is basis;software distributed under the license is distributed on an as is basis
apache-2;4;apache;www? apache org licenses license 2 0
apache-2;3;use reproduction;terms and conditions for use reproduction and distribution
gpl;3;redistribute it;this (program|file|software) is free software you can redistribute it and or? modify it under the terms of the gnu general public license
gpl-2-or-later;4;any later version;gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3-or-later;4;any later version;gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl;3;redistribute it;this (library|program|software) is free software you can redistribute it and or? modify it under the terms of the gnu (lesser|library) general public license
lgpl-2.1-or-later;4;any later version;gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3-or-later;4;any later version;gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl;3;redistribute it;this program is free software you can redistribute it and or? modify it under the terms of the gnu affero general public license
gpl;2;gnu;see the gnu general public license for more details
lgpl;2;gnu;see the gnu (lesser|library) general public license for more details
agpl;2;gnu;see the gnu affero general public license for more details
gpl-3;4;copyleft;the gnu general public license is a free copyleft license for software and other kinds of works
agpl-3;4;copyleft;the gnu affero general public license is a free copyleft license for software and other kinds of works
gpl-2;4;your freedom;the licenses for most software are designed to take away your freedom to share and change it
mpl-2;4;mozilla;this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2;4;mpl;if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1;4;mozilla;the contents of this file are subject to the mozilla public license version 1 1
epl;4;eclipse;this program and the accompanying materials are made available under the terms of the eclipse (public|distribution) license
epl;4;eclipse;the accompanying program is provided under the terms of this eclipse public license
zlib;4;damages arising;in no event will the authors be held liable for any damages arising from the use of this software
zlib;4;misrepresented;the origin of this software must not be misrepresented
zlib;3;altered source;altered source versions must be plainly marked as such
unlicense;4;unencumbered;this is free and unencumbered software released into the public domain
wtfpl;4;fuck;do what the fuck you want to
cc-zero;4;this deed;the person who associated a work with this deed has dedicated the work to the public domain
cc-zero;3;has waived all;has waived all copyright and related or neighboring rights
cc;2;creative;this work is licensed under a creative commons
public-domain;2;public domain;(released|placed|dedicated) (in|into|to) the public domain
public-domain;2;public domain;(is|are) in the public domain
artistic-or-gpl;4;perl;under the same terms as perl itself
artistic-or-gpl;4;perl;the same terms as the perl 5 programming language system itself
cddl;4;common development;subject to the terms of the common development and distribution license
eupl-1.2;4;eupl;licensed under the eupl version 1 2 or as soon they will be approved by the european commission
psf-2;4;psf;psf is making python available to licensee on an as is basis
openssl;4;openssl;software developed by the openssl project for use in the openssl toolkit
ofl-1.1;4;sil;this font software is licensed under the sil open font license version 1 1
ofl;4;ofl;the goals of the open font license ofl are to stimulate worldwide development
odbl;4;database;made available under the open database license
json;4;not evil;the software shall be used for good not evil
beerware;4;this stuff;you can do whatever you want with this stuff
ms-pl;3;microsoft public;microsoft public license
ms-rl;3;microsoft reciprocal;microsoft reciprocal license
ncsa;3;illinois;university of illinois ncsa open source license
afl;3;academic free;academic free license
osl;3;open software;open software license
ipl;3;ibm;ibm public license
cpl;3;common public;common public license
apsl;3;apple public;apple public source license
sissl;3;sun industry;sun industry standards source license
qpl;3;q public;q public license
sleepycat;3;sleepycat;sleepycat (license|public)
php;3;php;php license version 3 01?
zpl;3;zope public;zope public license
w3c;3;w3c;w3c software notice and license
sspl;3;server side public;server side public license
busl-1.1;3;business source;business source license 1 1
elastic-2;3;elastic license;elastic license 2 0
commons-clause;3;commons clause;commons clause license condition
polyform-nc;3;polyform;polyform noncommercial license
mulan;3;mulan;mulan permissive software license
ecl-2;3;educational community;educational community license version 2 0
cecill;3;cecill;cecill free software license agreement
blueoak-1;3;blue oak;blue oak model license
proprietary;2;proprietary and confidential;proprietary and confidential
proprietary;2;unauthorized copying;unauthorized copying of this file via any medium is strictly prohibited
"""
OP4_FAMILIES = """
mit;mit;mit,mit x11,mit expat;
apache;apache;apache,apache software,asl apache;1,1 1,2
gpl;gpl;gpl,gnu gpl;1,2,3
gpl;gnu;gnu general public,gnu gpl general public;1,2,3
lgpl;lgpl;lgpl,gnu lgpl;2,2 1,3
lgpl;gnu;gnu lesser general public,gnu library general public;2,2 1,3
agpl;agpl;agpl,gnu agpl;1,3
agpl;affero;gnu affero general public,affero general public;1,3
fdl;gnu;gnu free documentation,gnu fdl;1 1,1 2,1 3
mpl;mpl;mpl;1,1 1,2
mpl;mozilla;mozilla public;1,1 1,2
epl;eclipse;eclipse public,eclipse distribution;1,2
eupl;eupl;eupl,european union public;1 1,1 2
cddl;cddl;cddl,common development and distribution;1,1 1
artistic;artistic;artistic,perl artistic;1,2
bsd;bsd;bsd,berkeley bsd;2 clause,3 clause,4 clause,0 clause
bsl;boost;boost software,boost;1
isc;isc;isc,isc style;
zlib;zlib;zlib,zlib libpng;
unlicense;unlicense;unlicense,the unlicense;
wtfpl;wtfpl;wtfpl;2
psf;python;python software foundation,python;2
openssl;openssl;openssl;
odbl;database;open database;1
ofl;sil;sil open font,sil ofl;1,1 1
"""
OP4_CREATIVE = {
    "by": "attribution", "by sa": "attribution share_alike", "by nc": "attribution non_commercial",
    "by nd": "attribution no_derivs", "by nc sa": "attribution non_commercial share_alike",
    "by nc nd": "attribution non_commercial no_derivs", "zero": "zero",
}
OP4_SCORES = {1: 0.4, 2: 0.6, 3: 0.85, 4: 1.0}


def _op4_regex(pattern: str) -> str:
    """A pattern as a regular expression of the SQL engine over spaced words."""
    named = {
        "~": "( licen[cs]e )", "~?": "( licen[cs]e )?", "share_alike": "( share( {2})?alike )",
        "non_commercial": "( non( {2})?commercial )", "no_derivs": "( no( {2})?deriv[a-z]* )",
    }
    out = ""
    for word in pattern.split():
        if word in named:
            out += named[word]
        elif word.endswith("?"):
            out += f"( {word[:-1]} )?"
        else:
            out += f" {word} "
    return out


def _op4_version(version: str) -> str:
    spaced = _op4_regex(version)
    tail = "" if " " in version else "( 0 )?"
    return f"((( version )|( v )|( ver ))?{spaced}|{_op4_regex('v' + version)}){tail}"


def _op4_rules() -> list[tuple[str, int, str, str]]:
    """Label, priority, keyword and regular expression, in order."""
    rules = [
        ("mit", 4, "mit", _op4_regex("under the mit license")),
        ("apache-2", 4, "apache", _op4_regex("apache license version 2")),
        ("cc-by-nc", 4, "cc", _op4_regex("cc by nc")),
    ]
    for line in OP4_FIXED.strip().splitlines():
        label, priority, keyword, words = line.split(";")
        rules.append((label, int(priority), keyword, _op4_regex(words)))
    granted = _op4_regex("(licensed|released|distributed|published|available|covered|provided) under the?")
    granted += f"({_op4_regex('terms of the?')})?"
    for line in OP4_FAMILIES.strip().splitlines():
        family, keyword, names, versions = line.split(";")
        for name in names.split(","):
            for version in filter(None, versions.split(",")):
                label, number = f"{family}-{version.replace(' ', '.')}", _op4_version(version)
                whole = f"{_op4_regex(name + ' ~?')}{number}"
                if "clause" in version:
                    label, number = f"bsd-{version[0]}-clause", _op4_regex(version)
                    whole = f"({_op4_regex(name)}{number}|{number}{_op4_regex(name)}){_op4_regex('~?')}"
                rules.append((label, 4, keyword, granted + whole))
                rules.append((label, 4, keyword, _op4_regex(f"spdx license identifier {name}") + number))
                rules.append((label, 3, keyword, whole))
            rules.append((family, 3, keyword, granted + _op4_regex(f"{name} ~?")))
            rules.append((family, 2, keyword, _op4_regex(f"{name} ~")))
            rules.append((family, 1, keyword, _op4_regex(f"~ (is|type)? the? {name}")))
    for terms, said in OP4_CREATIVE.items():
        for version in ("", "1", "2", "2 5", "3", "4"):
            label = "-".join(["cc", *terms.split(), *([version.replace(" ", ".")] if version else [])])
            number = _op4_version(version) if version else ""
            rules.append((label, 3 if version else 2, "cc", _op4_regex(f"cc {terms}") + number))
            rules.append((label, 4 if version else 3, "creative", _op4_regex(f"creative commons {said} ~?") + number))
    return rules


def _op4() -> str:
    rules = ",\n  ".join(
        f"({i}, {_text(label)}, {priority}, {_text(_op4_regex(keyword))}, {_text(regex)})"
        for i, (label, priority, keyword, regex) in enumerate(_op4_rules())
    )
    phrases = ", ".join(
        f"({_text(label)}, {_text(_op4_regex(phrase))})"
        for phrase, label in [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
    )
    confidence = ", ".join(str(OP4_SCORES[i]) for i in sorted(OP4_SCORES))
    words = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    starts = (
        "unnest(list_transform(range(1, len(hits) + 1), lambda j: struct_pack("
        f"start := {words.format("array_to_string(gaps[1:j], '') || array_to_string(hits[1:j-1], '')")}, "
        f"n := {words.format('hits[j]')})))"
    )
    return rf"""
WITH rules(rule, label, priority, keyword, regex) AS (VALUES
  {rules}
), phrases(label, regex) AS (VALUES {phrases}
), words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), spaced AS (
  SELECT r, doc_id, len(w) AS n_words,
    CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS s
  FROM words
), cut AS (
  SELECT r, rule, label, priority, string_split_regex(s, regex) AS gaps, regexp_extract_all(s, regex) AS hits
  FROM spaced, rules WHERE contains(s, keyword) AND regexp_matches(s, regex)
), placed AS (
  SELECT r, rule, label, priority, {starts} AS p FROM cut
), found AS (
  SELECT r, rule, label, priority, p.start AS a, p.start + p.n AS z FROM placed
), kept AS (
  SELECT * FROM found d WHERE NOT EXISTS (
    SELECT 1 FROM found e WHERE e.r = d.r AND e.a <= d.a AND e.z >= d.z
      AND (e.priority > d.priority OR e.priority = d.priority
        AND (e.z - e.a > d.z - d.a OR e.z - e.a = d.z - d.a AND e.rule < d.rule)))
), base_cut AS (
  SELECT r, label, string_split_regex(s, regex) AS gaps, regexp_extract_all(s, regex) AS hits
  FROM spaced, phrases WHERE contains(s, regex)
), base AS (
  SELECT r, label, {starts} AS p FROM base_cut
), base_rows AS (
  SELECT r, count(*) AS n_base, min(p.start) AS first_word, max(p.start) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM base GROUP BY r
), all_labels AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM kept) GROUP BY r
), scores AS (
  SELECT r, max(priority) AS best FROM kept GROUP BY r
)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN best IS NULL THEN 0.0 ELSE [{confidence}][best] END::DOUBLE AS score
FROM spaced LEFT JOIN base_rows USING (r) LEFT JOIN all_labels USING (r) LEFT JOIN scores USING (r)
"""


ORACLE: dict[str, str] = {
    "op1_url_filter": OP1,
    "op3_preferences": OP3,
    "op4_license_scan": _op4(),
    "op9_decontamination": OP9,
    "op11_substring_dedup": OP11,
    "op12_hard_negatives": OP12,
}
