"""Licence mentions by ordered signature rules."""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII characters other than letters and digits stand between words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# Base phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Licence families: label, keyword (a whole word), names, versions.
FAMILIES = [
    ("mit", "mit", ["mit", "mit x11", "mit expat"], []),
    ("apache", "apache", ["apache", "apache software", "asl apache"], ["1", "1 1", "2"]),
    ("gpl", "gpl", ["gpl", "gnu gpl"], ["1", "2", "3"]),
    ("gpl", "gnu", ["gnu general public", "gnu gpl general public"], ["1", "2", "3"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"], ["2", "2 1", "3"]),
    ("lgpl", "gnu", ["gnu lesser general public", "gnu library general public"], ["2", "2 1", "3"]),
    ("agpl", "agpl", ["agpl", "gnu agpl"], ["1", "3"]),
    ("agpl", "affero", ["gnu affero general public", "affero general public"], ["1", "3"]),
    ("fdl", "gnu", ["gnu free documentation", "gnu fdl"], ["1 1", "1 2", "1 3"]),
    ("mpl", "mpl", ["mpl"], ["1", "1 1", "2"]),
    ("mpl", "mozilla", ["mozilla public"], ["1", "1 1", "2"]),
    ("epl", "eclipse", ["eclipse public", "eclipse distribution"], ["1", "2"]),
    ("eupl", "eupl", ["eupl", "european union public"], ["1 1", "1 2"]),
    ("cddl", "cddl", ["cddl", "common development and distribution"], ["1", "1 1"]),
    ("artistic", "artistic", ["artistic", "perl artistic"], ["1", "2"]),
    ("bsd", "bsd", ["bsd", "berkeley bsd"], ["2 clause", "3 clause", "4 clause", "0 clause"]),
    ("bsl", "boost", ["boost software", "boost"], ["1"]),
    ("isc", "isc", ["isc", "isc style"], []),
    ("zlib", "zlib", ["zlib", "zlib libpng"], []),
    ("unlicense", "unlicense", ["unlicense", "the unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], ["2"]),
    ("psf", "python", ["python software foundation", "python"], ["2"]),
    ("openssl", "openssl", ["openssl"], []),
    ("odbl", "database", ["open database"], ["1"]),
    ("ofl", "sil", ["sil open font", "sil ofl"], ["1", "1 1"]),
]
# Fixed wording of licences and notices: label, priority, rare words of it, and words;
# (a|b) is either word, a word with ? may be missing.
SIGNATURES = [
    ("mit", 4, "obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, "substantial portions", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 2, "noninfringement", "the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("x11", 3, "except as contained", "except as contained in this notice the (name|names) of"),
    ("bsl-1", 4, "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", 4, "without fee", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-0-clause", 4, "without fee", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("postgresql", 4, "without fee", "for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", 3, "its documentation", "permission to use copy modify and or? distribute this software and its documentation for any purpose"),
    ("bsd", 3, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, "redistributions", "redistributions (of|in) (source|binary) (code|form) must (retain|reproduce) the above copyright notice this list of conditions"),
    ("bsd-3-clause", 4, "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 4, "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", 3, "in compliance with", "you may not use this file except in compliance with the license"),
    ("apache-2", 4, "an as is basis", "software distributed under the license is distributed on an as is basis"),
    ("apache-2", 4, "apache", "www? apache org licenses license 2 0"),
    ("apache-2", 3, "use reproduction", "terms and conditions for use reproduction and distribution"),
    ("gpl", 3, "redistribute it", "this (program|file|software) is free software you can redistribute it and or? modify it under the terms of the gnu general public license"),
    ("gpl-2-or-later", 4, "any later version", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", 4, "any later version", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", 3, "redistribute it", "this (library|program|software) is free software you can redistribute it and or? modify it under the terms of the gnu (lesser|library) general public license"),
    ("lgpl-2.1-or-later", 4, "any later version", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3-or-later", 4, "any later version", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", 3, "redistribute it", "this program is free software you can redistribute it and or? modify it under the terms of the gnu affero general public license"),
    ("gpl", 2, "gnu", "see the gnu general public license for more details"),
    ("lgpl", 2, "gnu", "see the gnu (lesser|library) general public license for more details"),
    ("agpl", 2, "gnu", "see the gnu affero general public license for more details"),
    ("gpl-3", 4, "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3", 4, "copyleft", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", 4, "your freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("mpl-2", 4, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 4, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 4, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", 4, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse (public|distribution) license"),
    ("epl", 4, "eclipse", "the accompanying program is provided under the terms of this eclipse public license"),
    ("zlib", 4, "damages arising", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 4, "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", 3, "altered source", "altered source versions must be plainly marked as such"),
    ("unlicense", 4, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 4, "fuck", "do what the fuck you want to"),
    ("cc-zero", 4, "this deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-zero", 3, "has waived all", "has waived all copyright and related or neighboring rights"),
    ("cc", 2, "creative", "this work is licensed under a creative commons"),
    ("public-domain", 2, "public domain", "(released|placed|dedicated) (in|into|to) the public domain"),
    ("public-domain", 2, "public domain", "(is|are) in the public domain"),
    ("artistic-or-gpl", 4, "perl", "under the same terms as perl itself"),
    ("artistic-or-gpl", 4, "perl", "the same terms as the perl 5 programming language system itself"),
    ("cddl", 4, "common development", "subject to the terms of the common development and distribution license"),
    ("eupl-1.2", 4, "eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission"),
    ("psf-2", 4, "psf", "psf is making python available to licensee on an as is basis"),
    ("openssl", 4, "openssl", "software developed by the openssl project for use in the openssl toolkit"),
    ("ofl-1.1", 4, "sil", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", 4, "ofl", "the goals of the open font license ofl are to stimulate worldwide development"),
    ("odbl", 4, "database", "made available under the open database license"),
    ("json", 4, "not evil", "the software shall be used for good not evil"),
    ("beerware", 4, "this stuff", "you can do whatever you want with this stuff"),
    ("ms-pl", 3, "microsoft public", "microsoft public license"),
    ("ms-rl", 3, "microsoft reciprocal", "microsoft reciprocal license"),
    ("ncsa", 3, "illinois", "university of illinois ncsa open source license"),
    ("afl", 3, "academic free", "academic free license"),
    ("osl", 3, "open software", "open software license"),
    ("ipl", 3, "ibm", "ibm public license"),
    ("cpl", 3, "common public", "common public license"),
    ("apsl", 3, "apple public", "apple public source license"),
    ("sissl", 3, "sun industry", "sun industry standards source license"),
    ("qpl", 3, "q public", "q public license"),
    ("sleepycat", 3, "sleepycat", "sleepycat (license|public)"),
    ("php", 3, "php", "php license version 3 01?"),
    ("zpl", 3, "zope public", "zope public license"),
    ("w3c", 3, "w3c", "w3c software notice and license"),
    ("sspl", 3, "server side public", "server side public license"),
    ("busl-1.1", 3, "business source", "business source license 1 1"),
    ("elastic-2", 3, "elastic license", "elastic license 2 0"),
    ("commons-clause", 3, "commons clause", "commons clause license condition"),
    ("polyform-nc", 3, "polyform", "polyform noncommercial license"),
    ("mulan", 3, "mulan", "mulan permissive software license"),
    ("ecl-2", 3, "educational community", "educational community license version 2 0"),
    ("cecill", 3, "cecill", "cecill free software license agreement"),
    ("blueoak-1", 3, "blue oak", "blue oak model license"),
    ("proprietary", 2, "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", 2, "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
]
CC_TERMS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd", "zero"]
CC_VERSIONS = ["", "1", "2", "2 5", "3", "4"]
CC_WORDS = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv[a-z]*", "zero": "zero"}

# Values that a running aggregate collects in one array.
SCAN_BLOCK = 128
NO_PLACES = "cast(array() as array<struct<start: bigint, stop: bigint>>)"
NO_BASE = "cast(array() as array<struct<start: bigint, label: string>>)"
NO_HITS = "cast(array() as array<struct<start: bigint, stop: bigint, priority: int, rule: int, label: string>>)"

# By priority of a rule, 1 to 4.
CONFIDENCE = [0.4, 0.6, 0.85, 1.0]


@dataclass(frozen=True)
class SignatureRule:
    """``regex`` over spaced words, tried on texts that have the keyword, one word or some in a row."""

    label: str
    priority: int
    keyword: str
    regex: str


def _spaced(words: str) -> str:
    """Words as they stand in a spaced text: each with a space on both sides."""
    return "".join(f" {w} " for w in words.split())


def _signature(words: str) -> str:
    """The regular expression of an entry of ``SIGNATURES``."""
    parts = []
    for word in words.split():
        said = f" {word.rstrip('?').replace('(', '(?:')} "
        parts.append(f"(?:{said})?" if word.endswith("?") else said)
    return "".join(parts)


def _version(version: str) -> str:
    """``2``, ``2.0``, ``version 2``, ``v2`` and the like."""
    zero = "" if " " in version else "(?: 0 )?"
    return f"(?:(?: version | v | ver )?{_spaced(version)}|{_spaced('v' + version)}){zero}"


def signature_rules() -> list[SignatureRule]:
    """The ordered rules: fixed wording, then for each family, name and version the forms of a mention."""
    licence = " licen[sc]e "
    verb = "(?: licensed | released | distributed | published | available | covered | provided )"
    under = "(?: under (?: the )?(?: terms  of (?: the )?)?)"
    rules = [SignatureRule(label, 4, label.split("-")[0], _spaced(phrase)) for phrase, label in PHRASES]
    rules += [SignatureRule(label, priority, word, _signature(words)) for label, priority, word, words in SIGNATURES]
    for family, keyword, names, versions in FAMILIES:
        for name in names:
            said = _spaced(name)
            for version in versions:
                label = f"{family}-{version.replace(' ', '.')}" if "clause" not in version else f"bsd-{version[0]}-clause"
                v = _version(version) if "clause" not in version else _spaced(version)
                whole = f"{said}(?:{licence})?{v}" if "clause" not in version else f"(?:{said}{v}|{v}{said})(?:{licence})?"
                rules += [
                    SignatureRule(label, 4, keyword, f"{verb}{under}{whole}"),
                    SignatureRule(label, 4, keyword, f" spdx  license  identifier {said}{v}"),
                    SignatureRule(label, 3, keyword, whole),
                ]
            rules += [
                SignatureRule(family, 3, keyword, f"{verb}{under}{said}(?:{licence})?"),
                SignatureRule(family, 2, keyword, f"{said}{licence}"),
                SignatureRule(family, 1, keyword, f" licen[sc]e (?: is | type )?(?: the )?{said}"),
            ]
    for terms, version in product(CC_TERMS, CC_VERSIONS):
        label = "-".join(["cc", *terms.split()] + ([version.replace(" ", ".")] if version else []))
        v = _version(version) if version else ""
        named = "".join(f" {CC_WORDS[t].replace(' ?', '(?:  )?')} " for t in terms.split())
        rules += [
            SignatureRule(label, 3 if version else 2, "cc", f" cc {_spaced(terms)}{v}"),
            SignatureRule(label, 4 if version else 3, "creative", f" creative  commons {named}(?:{licence})?{v}"),
        ]
    return rules


def spaced_words(text: Column) -> Column:
    """All words of a text, A-Z lower-cased, each between two spaces of its own."""
    bare = F.trim(F.regexp_replace(F.translate(text, CAPITALS, SMALL), f"{GAP}+", "  "))
    return F.when(bare == "", "").otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def _count(spaced: str) -> str:
    return f"(length({spaced}) - length(replace({spaced}, ' ', ''))) div 2"


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it in ``body`` by its name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(values: str, start: str, step: str, out: str, kind: str) -> str:
    """SQL for a running aggregate: ``out`` for each value ``x``, given the state ``s`` before it.

    ``start`` is the first state, ``step`` the state after ``x``, ``out`` an array of what
    ``x`` adds to the result, and ``kind`` the type of its items. Arrays only grow within
    blocks and over blocks, so that the time is about proportional to the values.
    """
    blocks = f"transform(sequence(0, size(v__) div {SCAN_BLOCK}), b -> slice(v__, b * {SCAN_BLOCK} + 1, {SCAN_BLOCK}))"
    states = (
        f"aggregate(blocks__, struct({start} AS s, cast(array() as array<struct<s: {{state}}>>) AS out),"
        f" (acc, blk) -> struct(aggregate(blk, acc.s, (s, x) -> {step}) AS s,"
        f" array_append(acc.out, struct(acc.s AS s)) AS out), acc -> acc.out)"
    )
    within = (
        f"aggregate(blk, struct(st.s AS s, cast(array() as array<{kind}>) AS out),"
        f" (acc, x) -> {_let('s', 'acc.s', f'struct({step} AS s, concat(acc.out, {out}) AS out)')}, acc -> acc.out)"
    )
    return _let("v__", values, _let("blocks__", blocks, f"flatten(zip_with(blocks__, {states}, (blk, st) -> {within}))"))


def _places(spaced: str, regex: str) -> str:
    """SQL for the word intervals ``start, stop`` where a regular expression matches.

    The text between matches is counted in words, one match after the other.
    """
    pieces = f"""zip_with(split({spaced}, {regex}, -1), regexp_extract_all({spaced}, {regex}, 0),
        (gap, hit) -> struct({_count("gap")} AS gap, {_count("hit")} AS n))"""
    place = "struct(s + x.gap AS start, s + x.gap + x.n AS stop)"
    return _scan(
        pieces, "cast(0 as bigint)", "s + x.gap + coalesce(x.n, 0)", f"if(x.n IS NULL, {NO_PLACES}, array({place}))",
        "struct<start: bigint, stop: bigint>",
    ).replace("{state}", "bigint")


def rule_groups(rules: list[SignatureRule]) -> list[tuple[str, str]]:
    """By keyword, one regular expression that finds what any of its rules finds."""
    groups: dict[str, list[str]] = {}
    for rule in rules:
        groups.setdefault(rule.keyword, []).append(rule.regex)
    return [(keyword, "|".join(f"(?:{regex})" for regex in regexes)) for keyword, regexes in groups.items()]


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, base, hits``.

    ``base`` holds a struct ``start, label`` for each place where a base phrase
    stands; ``hits`` the detections that remain, as structs ``start, stop, priority,
    rule, label`` in text order. Of the detections of all rules, one is suppressed
    if its interval lies within that of another of higher priority, or of the same
    priority and a longer interval, or the same interval and an earlier rule. Null
    texts are empty and have no words, ``base`` and ``hits`` of empty arrays. Columns
    of ``docs`` with the names of the new ones are replaced.

    Everything is decided within the row by built-in functions: no shuffle, and
    repeated rows or ids do not matter. Texts without a keyword are only counted. On
    the others, the rules of a keyword that is there are tried together, as one fixed
    expression, and one by one if that finds something. Time is about proportional to
    a text's length and its mentions.
    """
    rules = signature_rules()
    groups = rule_groups(rules)
    keywords = sorted(keyword for keyword, _ in groups)
    gate = f"(?i)(?:^|{GAP})(?:{'|'.join(k.replace(' ', f'{GAP}+') for k in keywords)})(?:$|{GAP})"
    text = F.coalesce(F.col(text_col), F.lit(""))
    other = [c for c in docs.columns if c not in ("n_words", "base", "hits")]
    gated = docs.select(
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in other)).alias("row__"),
        F.regexp_count(text, F.lit(f"{WORD}+")).cast("long").alias("n_words"),
        F.when(text.rlike(gate), spaced_words(text)).alias("spaced__"),
    )
    tried = "array_compact(array(" + ", ".join(
        f"if(contains(spaced__, '{_spaced(keyword)}') AND spaced__ RLIKE {_quoted(regex)}, '{keyword}', NULL)"
        for keyword, regex in groups
    ) + "))"
    table = [
        {"keyword": keyword, "rules": [
            {"rule": i, "label": r.label, "priority": r.priority, "regex": r.regex}
            for i, r in enumerate(rules) if r.keyword == keyword
        ]}
        for keyword, _ in groups
    ]
    fields = "array<struct<keyword: string, rules: array<struct<rule: int, label: string, priority: int, regex: string>>>>"
    listed = f"from_json({_quoted(json.dumps(table))}, '{fields}')"
    base = "concat(" + ", ".join(
        f"if(contains(spaced__, '{_spaced(phrase)}'), transform({_places('spaced__', _quoted(_spaced(phrase)))},"
        f" p -> struct(p.start AS start, '{label}' AS label)), {NO_BASE})"
        for phrase, label in PHRASES
    ) + ")"
    found = f"""
    flatten(transform(
      filter(flatten(transform(filter({listed}, g -> array_contains(tried__, g.keyword)), g -> g.rules)),
        r -> regexp_like(spaced__, r.regex)),
      r -> transform({_places('spaced__', 'r.regex')},
        p -> struct(p.start AS start, -p.stop AS before, -r.priority AS after, r.rule AS rule, r.label AS label))))"""
    # In this order a detection comes after all that may suppress it; m1 to m4 are
    # the furthest ends so far of detections of at least that priority.
    most = ", ".join(f"if(-x.after >= {p}, greatest(s.m{p}, -x.before), s.m{p}) AS m{p}" for p in range(1, 5))
    detection = "struct(x.start AS start, -x.before AS stop, -x.after AS priority, x.rule AS rule, x.label AS label)"
    state = "struct<m1: bigint, m2: bigint, m3: bigint, m4: bigint>"
    kept = _scan(
        f"array_sort({found})",
        f"struct({', '.join(f'cast(-1 as bigint) AS m{p}' for p in range(1, 5))})",
        f"struct({most})",
        f"if(element_at(array(s.m1, s.m2, s.m3, s.m4), -x.after) >= -x.before, {NO_HITS}, array({detection}))",
        "struct<start: bigint, stop: bigint, priority: int, rule: int, label: string>",
    ).replace("{state}", state)
    return (
        gated.withColumn("tried__", F.expr(f"if(spaced__ IS NULL, NULL, {tried})"))
        .withColumns({
            "base": F.expr(f"if(spaced__ IS NULL, {NO_BASE}, {base})"),
            "hits": F.expr(f"if(spaced__ IS NULL OR size(tried__) = 0, {NO_HITS}, {kept})"),
        })
        .select(*(F.col("row__")[c].alias(c) for c in other), "n_words", "base", "hits")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def confidence(hits: Column) -> Column:
    """The confidence of the strongest detection, 0 without any."""
    best = F.array_max(F.transform(hits, lambda h: h["priority"]))
    scores = F.array(*(F.lit(c) for c in CONFIDENCE))
    return F.when(F.size(hits) > 0, F.element_at(scores, best)).otherwise(F.lit(0.0))
