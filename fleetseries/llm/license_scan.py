"""Licence scan: lines compared to licence templates by the Dice coefficient of their word bigrams.

Text is lower-cased and everything but letters, digits and line ends becomes a
space. Each line with at least two words is compared, as the set of its word
bigrams, to the templates; Dice >= t needs t / (2 - t) <= |line| / |template|
<= (2 - t) / t, so the bounds on the number of bigrams leave out most lines,
and for the others most templates, before any set is compared. All of it is
built-in functions on the row: no shuffle, no Python on the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .queries import query

THRESHOLD = 0.8

# Usual licence statements (fixed values).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    " associated documentation files",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
    " hereby granted",
}


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for name, text in sorted(templates.items()):
        words = _plain(text).split()
        out[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
    return out


def _bigrams(line: Column) -> Column:
    words = F.split(line, " ")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows doc_id, matches: one per row of ``docs`` (doc_id, text; others are not read).

    ``matches`` has a struct (line, license, dice) for each line, from 0, whose
    best template reaches ``threshold``; of equal values the smaller name. Null
    and empty text has none; neither have lines of one word.
    """
    grams = template_bigrams(TEMPLATES if templates is None else templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(g) for g in grams.values()]
    least, most = min(sizes) * low, max(sizes) * high
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.regexp_replace(lower, "[^a-z0-9\n]+", " ")
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("t")))

    def in_bounds(x):
        # with repeated bigrams a line has more words than its set; only the lower bound holds for words alone
        return F.size(F.split(x["t"], " ")) - 1 >= least

    def best(g):
        scores = [
            F.when(
                (F.size(g) >= len(own) * low) & (F.size(g) <= len(own) * high),
                F.struct(
                    (F.size(F.array_intersect(g, F.array(*map(F.lit, own)))) * 2.0 / (F.size(g) + len(own))).alias("dice"),
                    F.lit(name).alias("license"),
                ),
            )
            for name, own in grams.items()
        ]
        top = F.array_max(F.transform(F.filter(F.array(*scores), lambda s: s.isNotNull()), lambda s: s["dice"]))
        return F.get(F.filter(F.array(*scores), lambda s: s["dice"] >= F.greatest(top, F.lit(threshold))), F.lit(0))

    sets = F.transform(F.filter(lines, in_bounds), lambda x: F.struct(x["line"].alias("line"), _bigrams(x["t"]).alias("g")))
    sets = F.filter(sets, lambda x: (F.size(x["g"]) >= least) & (F.size(x["g"]) <= most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sets.alias("__sets"))
    scored = F.transform("__sets", lambda x: F.struct(x["line"].alias("line"), best(x["g"]).alias("b")))
    found = F.filter(scored, lambda x: x["b"].isNotNull())
    matches = F.transform(
        found, lambda x: F.struct(x["line"].alias("line"), x["b"]["license"].alias("license"), x["b"]["dice"].alias("dice"))
    )
    return rows.select("doc_id", matches.alias("matches"))


def _oracle() -> str:
    values = ", ".join(
        f"('{name}', {len(own)}, [" + ", ".join(f"'{g}'" for g in own) + "])" for name, own in template_bigrams(TEMPLATES).items()
    )
    return f"""
WITH t(license, n, g) AS (VALUES {values}),
l AS (SELECT rn, doc_id, unnest(range(len(a))) AS line, unnest(a) AS x
      FROM (SELECT row_number() OVER () AS rn, doc_id, string_split(regexp_replace(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS a FROM documents)),
w AS (SELECT rn, doc_id, line, string_split(trim(x), ' ') AS w FROM l),
b AS (SELECT rn, doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
s AS (SELECT rn, doc_id, line, t.license, len(list_intersect(b.g, t.g)) * 2.0 / (len(b.g) + t.n) AS dice
      FROM b JOIN t ON len(b.g) BETWEEN 0.6 * t.n AND 1.6 * t.n WHERE len(list_intersect(b.g, t.g)) * 2.0 / (len(b.g) + t.n) >= {THRESHOLD}),
m AS (SELECT *, row_number() OVER (PARTITION BY rn, line ORDER BY dice DESC, license) AS r FROM s),
d AS (SELECT row_number() OVER () AS rn, doc_id FROM documents)
SELECT d.doc_id, CAST(count(license) AS BIGINT) AS n_matches, coalesce(string_agg(license, ',' ORDER BY line), '') AS licenses
FROM d LEFT JOIN (SELECT * FROM m WHERE r = 1) m USING (rn) GROUP BY d.rn, d.doc_id
"""


@query("op4_license_scan", _oracle())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join("matches.license", ",").alias("licenses"),
    )
