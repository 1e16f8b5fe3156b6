"""License scans by sentence rules, on built-in expressions only.

Each text is cut at line breaks and sentence ends; normalised sentences that are known get an identifier, also where a
line break, a comment leader or a colon stands inside, but not across a blank line. The sequence of identifiers is matched against ordered rules. A rule names the identifiers that stand in a row; a rule whose
sequence is part of an earlier matching rule's is taken to be explained by it.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let

#: Normalised sentences by identifier: lower case, runs of other characters than a-z and 0-9 are one space.
SENTENCES = {
    "mit-title": ["mit license", "the mit license", "the mit license mit"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache-title": ["apache license", "apache license version 2 0", "apache license version 2 0 january 2004"],
    "apache-notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "this work is licensed under the apache license version 2 0"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-obtain": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "gpl3-title": ["gnu general public license version 3", "gnu general public license version 3 29 june 2007"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl-notice": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1"],
    "agpl-notice": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "mpl-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "released under the mozilla public license version 2 0"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-notice": ["released under the bsd license", "licensed under the bsd license", "licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "bsd2-notice": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "isc-notice": ["licensed under the isc license", "released under the isc license"],
    "cc0-notice": ["licensed under cc0 1 0", "released under cc0 1 0", "licensed under cc0", "this work is dedicated to the public domain"],
    "ccby-notice": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa-notice": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccbync-notice": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccbynd-notice": ["licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"],
    "ccbyncsa-notice": ["licensed under cc by nc sa 4 0", "this work is licensed under cc by nc sa 4 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
}
#: (licence, identifiers in a row), the more telling rules first.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-obtain")),
    ("Apache-2.0", ("apache-notice", "apache-comply")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("AGPL-3.0", ("agpl-notice",)),
    ("LGPL", ("lgpl-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant",)),
    ("BSD-3-Clause", ("bsd-notice",)),
    ("BSD-2-Clause", ("bsd2-notice",)),
    ("BSD", ("bsd-grant",)),
    ("ISC", ("isc-notice",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa-notice",)),
    ("CC-BY-NC-4.0", ("ccbync-notice",)),
    ("CC-BY-ND-4.0", ("ccbynd-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa-notice",)),
    ("CC-BY-4.0", ("ccby-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("Unlicense", ("unlicense",)),
    ("Apache-2.0", ("apache-title",)),
    ("MIT", ("mit-title",)),
    ("all-rights-reserved", ("reserved",)),
)


#: Marks of a blank line and of other line breaks and sentence ends.
BLANK, CUT = "\x01", "\x02"
#: Each known sentence has one of these; other texts are not normalised.
TELLING = "licen[sc]|permi|copyright|reserved|public|warranty|redistrib|obtain|compliance|cc0|cc by"


def _known() -> dict[str, str]:
    return {s: k for k, all_of in SENTENCES.items() for s in all_of}


def _pattern(ids: tuple[str, ...]) -> str:
    return "," + ",".join(ids) + ","


def _identifiers(text: Column) -> Column:
    """Identifiers of the known sentences in their order."""
    known = _known()
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), BLANK + CUT, "  ")
    cut = F.regexp_replace(F.regexp_replace(low, r"\n(?=[^\p{L}\p{N}\n]*\n)", BLANK), r"[.!?;:][ \t]+|\n", CUT)
    plain = F.regexp_replace(F.regexp_replace(F.concat(F.lit(CUT), cut, F.lit(CUT)), f"([{BLANK}{CUT}])", " $1 "), f"[^a-z0-9{BLANK}{CUT}]+", " ")
    sentence = "|".join(s.replace(" ", f"(?: {CUT})* ") for s in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(plain, F.lit(f"(?<=[{BLANK}{CUT}] )(?:{sentence})(?= [{BLANK}{CUT}])"), F.lit(0))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    ids = F.transform(found, lambda s: F.element_at(table, F.regexp_replace(s, f"[ {CUT}]+", " ")))
    return F.when(low.rlike(TELLING), ids).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (their identifiers, comma-joined), licenses (of the matching rules in rule
    order, each once, comma-joined) and license (the first of them, null without any) for every row, from its whole text.

    A known sentence may stand over several lines, with comment leaders and any other signs and white space between its words, but not across a
    blank line; its length does not matter. Null and empty texts: no sentence. Repeated rows are scanned each for itself; a null doc_id is kept.
    """
    rules = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(_pattern(ids)).alias("p")) for k, (name, ids) in enumerate(RULES)])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(_identifiers(F.col("text")), ",").alias("sentence_ids"))
    row = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    matching = F.filter(rules, lambda r: F.contains(row, r["p"]))
    names = let(matching, lambda m: F.array_distinct(F.transform(F.filter(m, lambda r: ~F.exists(m, lambda e: (e["k"] < r["k"]) & F.contains(e["p"], r["p"]))), lambda r: r["name"])))
    found = ids.withColumn("names", F.when(F.col("sentence_ids") != "", names).otherwise(F.array().cast("array<string>")))
    return found.select(
        "doc_id", F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", ","))).cast("long").alias("n_sentences"),
        "sentence_ids", F.array_join("names", ",").alias("licenses"), F.get(F.col("names"), F.lit(0)).alias("license"),
    )


def sql() -> str:
    """The same in DuckDB, without look-around: lines become blocks at blank lines and pieces at sentence ends; a known sentence is a row of whole
    pieces of one block, the longest from where it starts, each piece used once from the left."""
    known = ", ".join(f"('{s}', '{k}')" for s, k in _known().items())
    rules = ", ".join(f"({k}, '{name}', '{_pattern(ids)}')" for k, (name, ids) in enumerate(RULES))
    return f"""
WITH RECURSIVE known(s, id) AS (VALUES {known}),
rules(k, name, p) AS (VALUES {rules}),
docs AS (SELECT doc_id, string_split(translate(lower(text), chr(1) || chr(2), '  '), chr(10)) AS l FROM documents WHERE regexp_matches(lower(text), '{TELLING}')),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s, len(l) AS n FROM docs),
blocks AS (SELECT *, sum(CASE WHEN i > 1 AND i < n AND NOT regexp_matches(s, '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM lines),
pieces AS (SELECT doc_id, b, i, generate_subscripts(l, 1) AS k, trim(regexp_replace(unnest(l), '[^a-z0-9]+', ' ', 'g')) AS t FROM (SELECT *, string_split_regex(s, '[.!?;:][ \\t]+') AS l FROM blocks)),
placed AS (SELECT doc_id, b, t, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS g, sum(length(t) + 1) OVER (PARTITION BY doc_id, b ORDER BY i, k) - length(t) AS at FROM pieces WHERE t <> ''),
joined AS (SELECT doc_id, b, string_agg(t, ' ' ORDER BY g) AS whole FROM placed GROUP BY doc_id, b),
found AS (
  SELECT p.doc_id, p.g, e.g AS g_end, id, row_number() OVER (PARTITION BY p.doc_id, p.g ORDER BY length(s) DESC) AS longest
  FROM placed p JOIN known ON split_part(p.t, ' ', 1) = split_part(s, ' ', 1) JOIN joined j ON j.doc_id = p.doc_id AND j.b = p.b AND substr(j.whole, p.at::BIGINT, length(s)) = s
  JOIN placed e ON e.doc_id = p.doc_id AND e.b = p.b AND e.at + length(e.t) = p.at + length(s)
),
best AS (SELECT doc_id, g, g_end, id FROM found WHERE longest = 1),
taken AS (
  SELECT doc_id, g, g_end, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS r FROM best) WHERE r = 1
  UNION ALL SELECT doc_id, g, g_end, id FROM (SELECT x.*, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.g) AS r FROM taken JOIN best x ON x.doc_id = taken.doc_id AND x.g > taken.g_end) WHERE r = 1
),
ids AS (SELECT doc_id, string_agg(id, ',' ORDER BY g) AS sentence_ids, count(*) AS n FROM taken GROUP BY doc_id),
hit AS (SELECT doc_id, k, name, p FROM ids, rules WHERE contains(',' || sentence_ids || ',', p)),
own AS (
  SELECT doc_id, name, min(k) AS k FROM hit h
  WHERE NOT EXISTS (SELECT 1 FROM hit e WHERE e.doc_id = h.doc_id AND e.k < h.k AND contains(e.p, h.p))
  GROUP BY doc_id, name
),
named AS (SELECT doc_id, string_agg(name, ',' ORDER BY k) AS licenses, arg_min(name, k) AS license FROM own GROUP BY doc_id)
SELECT d.doc_id, coalesce(i.n, 0) AS n_sentences, coalesce(i.sentence_ids, '') AS sentence_ids,
       coalesce(n.licenses, '') AS licenses, n.license
FROM documents d LEFT JOIN ids i USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
