"""Licence scan by sentence rules.

A text is cut into sentences; each is normalised and looked up among the known licence sentences,
which gives it an identifier or none. A licence is an ordered rule over identifiers: its sentences, in
order, with at most GAP other sentences between neighbours. A rule whose sentences all belong to
a longer rule that also matches is dropped. Each text is judged within its row: no rows move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import clear_of, raw_texts, read

GAP = 2          # other sentences between two neighbours of a rule, at most
CATEGORIES = ("proprietary", "noncommercial", "copyleft", "permissive", "public")  # strongest first

# Licence name, category and wording, as published.
LICENSES = [
    ("All-Rights-Reserved", "proprietary", "All rights reserved."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the
License."""),
    ("Apache-2.0", "permissive", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("Apache-2.0", "permissive", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "permissive", """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", "permissive", """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""),
    ("BSD-3-Clause", "permissive", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "copyleft",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "public", "To the extent possible under law, the author has waived all copyright and related or "
     "neighboring rights to this work."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "copyleft", """This program is free software: you can redistribute it and/or modify it under the
terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details."""),
    ("GPL-3.0-or-later", "copyleft", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "permissive", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies."""),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""),
    ("MIT", "permissive", "SPDX-License-Identifier: MIT"),
    ("Unlicense", "public", "This is free and unencumbered software released into the public domain."),
]

_END = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n")
_ODD = re.compile(rb"[^a-z0-9.\x80-\xff]+")


def sentences(text: bytes) -> list[bytes]:
    """The pieces between sentence ends (., ! or ? before white space) and blank lines."""
    return _END.split(text)


def normalised(sentence: bytes) -> bytes:
    """A-Z lower-cased; all but letters, digits and inner full stops as single spaces."""
    return _ODD.sub(b" ", sentence.lower()).strip(b" .")


@cache
def rules() -> tuple[dict[bytes, str], list[tuple[str, str, tuple[str, ...]]]]:
    """Known sentences with their identifiers, and the ordered rules (licence, category, identifiers)."""
    known: dict[bytes, str] = {}
    out = []
    for name, category, text in LICENSES:
        own = [n for s in sentences(text.encode()) if (n := normalised(s))]
        for s in own:
            known.setdefault(s, f"s{len(known):03d}")
        out.append((name, category, tuple(known[s] for s in own)))
    return known, out


@cache
def patterns() -> list[tuple[str, str, re.Pattern, set[str]]]:
    """Each rule as a pattern over a text's identifiers, written ' s001 - - s004' with - for unknown."""
    between = r"(?: \S+){0,%d} " % GAP
    return [(name, category, re.compile(" " + between.join(ids) + r"(?= |$)"), set(ids)) for name, category, ids in rules()[1]]


@cache
def _last_words() -> frozenset[bytes]:
    return frozenset(s.rsplit(b" ", 1)[-1] for s in rules()[0])


def identify(sentence: bytes) -> tuple[str | None, bytes]:
    """The identifier of a sentence and its text. A sentence may begin on any of its lines (a heading
    or an unfinished line may stand before it): the longest known run of lines up to its end counts,
    and if there is none, its first line that is known by itself."""
    known = rules()[0]
    lines = sentence.split(b"\n")
    tail = normalised(sentence).rsplit(b" ", 1)[-1]
    if len(sentence) > 40 and tail not in _last_words():  # no known sentence ends so
        alone = lines if len(lines) > 1 else []
        return next(((f, line) for line in alone if (f := known.get(normalised(line)))), (None, sentence))
    rest = sentence
    while True:
        if found := known.get(normalised(rest)):
            return found, rest
        _, line, rest = rest.partition(b"\n")
        if not line:
            break
    return next(((f, line) for line in lines if (f := known.get(normalised(line)))), (None, sentence))


def scan(text: bytes) -> tuple[int, int, list[tuple[str, str, int, int, bytes]]]:
    """(sentences, known sentences, matches as (licence, category, first, last sentence, text))."""
    parts = sentences(text)
    found = [identify(s) for s in parts]
    count = sum(1 for s in parts if normalised(s[:200]) or normalised(s))
    hits = [i for i, (f, _) in enumerate(found) if f]
    if not hits:
        return count, 0, []
    seen = "".join(" " + (f or "-") for f, _ in found)
    at = {m.start(): i for i, m in enumerate(re.finditer(r" \S+", seen))}
    matches = [(name, category, ids, m) for name, category, p, ids in patterns() for m in p.finditer(seen)]
    best = [x for x in matches if not any(x[2] < y[2] for y in matches)]
    out = []
    for name, category, _, m in best:
        first, last = at[m.start()], at[m.start()] + m.group().count(" ") - 1
        out.append((name, category, first, last, b" ".join(s for _, s in found[first:last + 1])))
    return count, len(hits), sorted(out, key=lambda x: (x[2], x[0]))


def scan_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with n_sentences, n_known, licenses (sorted names), category (the strongest, or none) and
    found: (license, first, last, text) of every match, sentences counted from 0.

    Null and empty texts have no sentences; rows are judged one by one, repeated and null ids too;
    columns with the names added here are replaced.
    """
    added = ("n_sentences", "n_known", "licenses", "category", "found")
    docs = clear_of(docs, *added)
    at = docs.columns.index("text")
    match = (StructType().add("license", StringType()).add("first", LongType()).add("last", LongType())
             .add("text", StringType()))
    schema = (StructType([*docs.schema.fields]).add("n_sentences", LongType()).add("n_known", LongType())
              .add("licenses", ArrayType(StringType())).add("category", StringType()).add("found", ArrayType(match)))
    kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("text", pa.string())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t) for t in raw_texts(b.column(at))]
            names = [sorted({m[0] for m in r[2]}) for r in rows]
            strongest = [next((c for c in CATEGORIES if any(m[1] == c for m in r[2])), "none") for r in rows]
            found = [[{"license": m[0], "first": m[2], "last": m[3], "text": m[4].decode("utf-8", "replace")}
                      for m in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array(names, pa.list_(pa.string())), pa.array(strongest, pa.string()), pa.array(found, kind)],
                names=[*b.schema.names, *added])

    return docs.mapInArrow(judge, schema)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    out = scan_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_known", F.concat_ws(",", "licenses").alias("licenses"), "category")


def _sql() -> str:
    """The query in SQL: the same sentences, identifiers and rules as values."""
    known, every = rules()
    values = ", ".join(f"('{s.decode()}', '{i}')" for s, i in known.items())
    between = r"( [^ ]+){0,%d} " % GAP
    listed = ", ".join(
        f"({k}, '{name}', {CATEGORIES.index(category)}, '{'( ' + between.join(ids) + ')( |$)'}')"
        for k, (name, category, ids) in enumerate(every))
    covers = ", ".join(f"({a}, {b})" for a, x in enumerate(every) for b, y in enumerate(every) if set(x[2]) < set(y[2]))
    return rf"""
WITH known(s, id) AS (VALUES {values}),
rule(k, name, strength, pattern) AS (VALUES {listed}),
inside(k, longer) AS (VALUES {covers}),
d AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n') AS parts
      FROM documents),
p AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM d),
l AS (SELECT doc_id, i, string_split(s, chr(10)) AS lines, unnest(generate_series(1, len(string_split(s, chr(10))))) AS k
      FROM p),
r AS (SELECT doc_id, i, k, array_to_string(lines[k:], chr(10)) AS s FROM l
      UNION ALL SELECT doc_id, i, 1000000 + k, lines[k] FROM l),
n AS (SELECT doc_id, i, k, trim(regexp_replace(translate(s,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'), ' .') AS s
      FROM r),
f AS (SELECT n.doc_id, n.i, max(CASE WHEN n.k = 1 AND n.s <> '' THEN 1 ELSE 0 END) AS counted,
             coalesce(arg_min(known.id, CASE WHEN known.id IS NOT NULL THEN n.k END), '-') AS id
      FROM n LEFT JOIN known ON n.s = known.s GROUP BY n.doc_id, n.i),
q AS (SELECT doc_id, sum(counted) AS n_sentences, count(*) FILTER (WHERE id <> '-') AS n_known,
             ' ' || string_agg(id, ' ' ORDER BY i) AS seen FROM f GROUP BY doc_id),
m AS (SELECT q.doc_id, rule.k, rule.name, rule.strength FROM q, rule
      WHERE q.n_known > 0 AND regexp_matches(q.seen, rule.pattern)),
b AS (SELECT m.* FROM m WHERE NOT EXISTS (
        SELECT 1 FROM inside JOIN m AS o ON o.k = inside.longer WHERE inside.k = m.k AND o.doc_id = m.doc_id))
SELECT q.doc_id, any_value(q.n_sentences)::BIGINT AS n_sentences, any_value(q.n_known)::BIGINT AS n_known,
       coalesce(string_agg(DISTINCT b.name, ',' ORDER BY b.name), '') AS licenses,
       CASE min(b.strength) {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES))} ELSE 'none' END AS category
FROM q LEFT JOIN b ON q.doc_id = b.doc_id GROUP BY q.doc_id
"""


OP5_SQL = _sql()
