"""Licence scans by sentence rules, in DataFrame functions.

Texts are cut into sentences (at line ends, and after . ! ? before white space), which are normalised: lower case, runs of other
characters than a-z and 0-9 as one space. Known sentences map to identifiers of one character, unknown ones to a space, empty
ones to nothing; so a text becomes a string of identifiers. Ordered rules, each a sequence of identifiers, match in it leftmost
first and by their order; a match uses its sentences up. An unknown sentence breaks a sequence. Sentences that name a licence
but are unknown count separately, so that gaps of the rules show.

Notices are found however they are wrapped: the words of a known sentence may stand on several lines, behind comment marks and with
full stops between ("v. 2.0"), if the sentence begins and ends where sentences are cut. Long sentences, which no other text holds by
chance (``LONG``), may also stand inside a longer one, as they do in notices written on one line; what is around them stays a
sentence. Numbers of a list before its points count as nothing. Sentences that a notice runs together give both identifiers.
``oracle`` knows none of this: it agrees where each notice's sentence stands whole on one line, as in the test tables.

Lines "SPDX-License-Identifier: ..." are sentences of their own.

Null and empty texts: no sentence. Empty table: no rows. Very long texts are scanned whole. Rows repeated, or of null doc_id: each gives a row. Other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licence notices, normalised, by identifier.
SENTENCES = {
    "A": "licensed under the apache license version 2 0",
    "B": "you may not use this file except in compliance with the license",
    "C": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "D": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "E": "see the license for the specific language governing permissions and limitations under the license",
    "M": "released under the mit license",
    "N": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "O": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "G": "this work is licensed under the gnu general public license version 3",
    "H": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "I": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "J": "see the gnu general public license for more details",
    "R": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "S": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "T": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "U": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "V": "licensed under cc by nc 4 0",
    "W": "this work is licensed under a creative commons attribution 4 0 international license",
    "X": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "Y": "all rights reserved",
    "Γ": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "Δ": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "Θ": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "Λ": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "Ξ": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "Π": "this is free and unencumbered software released into the public domain",
    "Σ": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "Φ": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "Ψ": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "Ω": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "Б": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "Ж": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "Ш": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
}
#: In order: the first rule that matches at a place wins, so longer sequences stand before their beginnings.
RULES = [
    ("Apache-2.0", "ABCDE"), ("Apache-2.0", "ABCD"), ("Apache-2.0", "A"), ("MIT", "NO"), ("MIT", "N"), ("MIT", "M"), ("GPL-3.0-or-later", "HIJ"), ("GPL-3.0-or-later", "H"), ("GPL-3.0-only", "G"),
    ("BSD-3-Clause", "RSTU"), ("BSD-2-Clause", "RST"), ("CC-BY-NC-4.0", "V"), ("CC-BY-4.0", "W"), ("MPL-2.0", "X"),
    ("GPL-2.0-or-later", "ΓIJ"), ("GPL-2.0-or-later", "Γ"), ("GPL-2.0-only", "Ш"), ("LGPL-2.1-or-later", "Δ"), ("AGPL-3.0-or-later", "Θ"), ("ISC", "Λ"), ("0BSD", "Ξ"), ("Unlicense", "Π"), ("Zlib", "Σ"), ("BSL-1.0", "Φ"), ("EPL-2.0", "Ψ"), ("CC-BY-SA-4.0", "Ω"), ("CC0-1.0", "Б"), ("WTFPL", "Ж"),
]
#: SPDX tags: a sentence and a rule for each licence of the rules.
TAGS = {chr(0x2460 + i): licence for i, licence in enumerate(dict.fromkeys(x for x, _ in RULES))}
SENTENCES |= {k: "spdx license identifier " + re.sub("[^a-z0-9]+", " ", licence.lower()) for k, licence in TAGS.items()}
RULES += [(licence, k) for k, licence in TAGS.items()]
#: What an unknown sentence holds that seems to speak of a licence.
HINT = "licen[sc]e|copyright"
SPACE = r"[ \t\n\f\r\x0B]"
#: Identifiers are characters that normalised sentences don't hold.
IDENTIFIER = r"^[^a-z0-9 \n]$"

#: Sentences that are also known inside longer ones. The others could go on there ("version 3 or any later version").
LONG = "BCDEHIJNORSTUXΓΔΘΛΞΠΣΦΨΩБЖШ"
#: Points of a list, whose number or letter counts as nothing.
POINTS = "STU"
#: As real notices have them, beside the forms above: sentences run together, other spellings, names filled in.
TOGETHER = {"AB": f"{SENTENCES['A']} the license {SENTENCES['B']}"}
SPELLINGS = [(" http www ", " https? www "), ("licenses license 2 0", "licenses license 2 0(?: txt| html)?"), ("name of the copyright holder nor", "name of (?:[a-z0-9]+ ){1,12}?nor")]
#: A word of every sentence.
WORDS = "licen|permission|copyright|warranty|redistribution|rights|unencumbered"
#: Of the later sentences, a word or more of each, so that other texts are spared their expressions.
LATER = "spdx|version 2|affero|lesser|any purpose|person or organization|unencumbered|eclipse|sharealike|extent possible|verbatim"


def forms(sentences: dict[str, str] = SENTENCES) -> list[tuple[str, str]]:
    """Expressions over cut sentences, one on each line, and the identifiers that stand for what they match."""
    out = []
    for ids, words in [*TOGETHER.items(), *sentences.items()]:
        for plain, spelt in SPELLINGS:
            words = words.replace(plain, spelt)
        words = words.replace(" ", "[ \\n]")
        number = r"(?:\b(?:[0-9]{1,2}|[a-z])[ \n]+)?" if ids in POINTS else ""
        out.append((rf"{number}\b{words}\b" if len(ids) > 1 or ids in LONG else rf"(?<=\n){words}(?=\n)", "\n" + "\n".join(ids) + "\n"))
    return out


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The text's string of identifiers: "?" for an unknown sentence that names a licence, a space for any other; empty for texts without any of ``WORDS``."""
    lines = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), rf"([.!?]){SPACE}+", "$1\n")
    plain = F.filter(F.split(F.regexp_replace(lines, r"[^a-z0-9\n]+", " "), r" ?\n[ \n]*"), lambda s: F.trim(s) != "")
    whole = F.concat(F.lit("\n"), F.array_join(F.transform(plain, lambda s: F.trim(s)), "\n"), F.lit("\n"))
    spoken = F.regexp_like(whole, F.lit(LATER.replace(" ", "[ \\n]")))
    first, more = ([x for x in forms(sentences) if bool(re.search(LATER, x[0].replace("[ \\n]", " "))) == later] for later in (False, True))
    both = plain_marks = whole
    for expression, ids in first:
        plain_marks = F.regexp_replace(plain_marks, expression, ids)
    for expression, ids in more + first:
        both = F.regexp_replace(both, expression, ids)
    cut = F.filter(F.split(F.when(spoken, both).otherwise(plain_marks), r" ?\n[ \n]*"), lambda s: F.trim(s) != "")
    told = F.array_join(F.transform(cut, lambda s: F.when(F.regexp_like(s, F.lit(IDENTIFIER)), s).when(F.regexp_like(s, F.lit(HINT)), "?").otherwise(" ")), "")
    # a text without any of the words has no known sentence and none that names a licence
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in WORDS.split("|")]), told).otherwise("")


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """doc_id, licences (sorted, distinct, joined by comma), n_matches, n_known and n_unknown sentences, matched sequences."""
    found = F.regexp_extract_all("ids", F.lit("|".join(s for _, s in rules)), F.lit(0))
    name = F.create_map(*[F.lit(x) for licence, s in reversed(rules) for x in (s, licence)])
    rows = docs.select("doc_id", identifiers(F.col("text"), sentences).alias("ids")).withColumn("found", found)
    return rows.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: F.element_at(name, x)))), ",").alias("licences"), F.size("found").cast("long").alias("n_matches"),
        F.char_length(F.regexp_replace("ids", "[ ?]", "")).cast("long").alias("n_known"), F.char_length(F.regexp_replace("ids", "[^?]", "")).cast("long").alias("n_unknown"), F.array_join("found", " ").alias("sequences"),
    )


def oracle(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str]] = RULES) -> str:
    """The same in DuckDB's SQL."""
    known = " ".join(f"WHEN '{s}' THEN '{k}'" for k, s in sentences.items())
    name = " ".join(f"WHEN '{s}' THEN '{licence}'" for licence, s in rules)
    sequences = "|".join(s for _, s in rules)
    return f"""
WITH a AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \\t\\n\\f\\r\\x0B]+', E'\\\\1\\n', 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n[ \\n]*') AS s FROM documents),
b AS (SELECT doc_id, array_to_string(list_transform(list_filter(s, lambda x: trim(x) <> ''), lambda x: CASE trim(x) {known} ELSE CASE WHEN regexp_matches(x, '{HINT}') THEN '?' ELSE ' ' END END), '') AS ids FROM a),
c AS (SELECT *, regexp_extract_all(ids, '{sequences}') AS found FROM b)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda x: CASE x {name} END))), ','), '') AS licences, len(found)::BIGINT AS n_matches,
  length(regexp_replace(ids, '[ ?]', '', 'g'))::BIGINT AS n_known, length(regexp_replace(ids, '[^?]', '', 'g'))::BIGINT AS n_unknown, coalesce(array_to_string(found, ' '), '') AS sequences
FROM c"""
