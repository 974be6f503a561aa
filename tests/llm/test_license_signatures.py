"""Licence rules against the SQL's own list of them, and their cost on long texts."""

import random
import time

import duckdb

from codetally.llm import license_rules, oracle, queries

MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS "
    "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
BSD_BODY = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions. Neither the name of X "
    "nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission."
)


def hits(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = license_rules.scan_licenses(rows).collect()
    return {r.doc_id: {h.label for h in r.hits} for r in found}


def test_bodies_of_licences(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    gpl = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )
    apache = "Unless required, software distributed under the License is distributed on an \"AS IS\" BASIS. www.apache.org/licenses/LICENSE-2.0"
    found = hits(spark, [MIT_BODY, BSD_BODY, isc, isc + ". THE SOFTWARE IS PROVIDED \"AS IS\"", gpl, apache, "an open fee, at your option"])
    assert found[0] == {"mit"} and found[1] == {"bsd", "bsd-3-clause"}
    assert found[2] == {"isc"} and found[3] == {"bsd-0-clause"}
    assert {"gpl", "gpl-3-or-later"} <= found[4] and found[5] == {"apache-2"} and found[6] == set()


def test_every_signature_is_found_by_its_words(spark):
    texts = [
        " ".join(w.strip("(?)").split("|")[0] for w in words.split() if not w.endswith("?"))
        for *_, words in license_rules.SIGNATURES
    ]
    found = hits(spark, texts)
    for i, (label, *_) in enumerate(license_rules.SIGNATURES):
        assert label in found[i], texts[i]


def generated(rng):
    """Texts of mentions of all kinds, some of them nearly right."""
    pieces = [words.replace("?", "").replace("(", "").replace(")", "") for *_, words in license_rules.SIGNATURES]
    pieces += [p for p, _ in license_rules.PHRASES] + [MIT_BODY, BSD_BODY]
    for _, _, names, versions in license_rules.FAMILIES:
        for name in names:
            for v in [*versions, ""]:
                pieces += [f"{name} {v}", f"licensed under the {name} license version {v}", f"SPDX-License-Identifier: {name}-v{v}.0",
                           f"{v} {name} licence", f"license: {name}", f"released under the terms of the {name} v {v.replace(' ', '.')}"]
    for terms in license_rules.CC_TERMS:
        pieces += [f"CC-{terms} {v}" for v in license_rules.CC_VERSIONS] + [f"Creative Commons {terms} license 4.0"]
    pieces += ["Creative Commons Attribution Non-Commercial ShareAlike 2.5", "creative commons attribution noderivatives licence v4"]
    texts = ["; ".join(rng.sample(pieces, rng.randrange(1, 7))) + rng.choice([".", "", " éü"]) for _ in range(700)]
    return texts + [p.split("|")[0] for p in pieces]


def test_sql_with_its_own_rules_agrees(spark, tmp_path):
    rows = list(enumerate(generated(random.Random(5))))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = duck.execute(oracle.ORACLE["op4_license_scan"])
    columns = [c[0] for c in cursor.description]
    expected = sorted(map(str, cursor.fetchall()))
    found = queries.op4_license_scan(spark, str(tmp_path)).select(columns).collect()
    assert sorted(str(tuple(r)) for r in found) == expected
    assert len({r.labels for r in found}) > 200


def test_time_follows_the_mentions(spark):
    mention = "Released under the MIT license, apache license version 2.0; see gpl. "

    def seconds(n):
        rows = spark.createDataFrame([(1, mention * n)], "doc_id long, text string")
        start = time.time()
        row = license_rules.scan_licenses(rows).selectExpr("size(base) AS b", "size(hits) AS h").first()
        assert row.b == 2 * n and row.h == 5 * n
        return time.time() - start

    seconds(10)
    few, many = seconds(2_000), seconds(8_000)
    assert many < 12 * max(few, 0.5)


def test_the_query_is_built_quickly(spark):
    rows = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    license_rules.scan_licenses(rows)
    start = time.time()
    license_rules.scan_licenses(rows)
    assert time.time() - start < 5
