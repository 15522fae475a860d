"""Licence scans by sentence-rule recognition, with DataFrame functions only.

A text is normalised (lower case, blanks joined, no comment signs at a line's start) and the known licence sentences are found
in it, in order, each from one sentence boundary to another: a line's end or closing punctuation before a blank, which a known
sentence may also hold inside. A known sentence may be wrapped at single line breaks; blank lines and list marks end it. The sequence of identifiers found is
matched against ordered rules, the longest and most specific first. A rule takes its identifiers out of the sequence, so a
general rule doesn't fire on what a specific one has explained; what no rule explains is reported as partial.

Everything is a projection over one row: no shuffle, no broadcast table. Texts without a licence word skip the scan.

Defined cases: null text is empty (no sentence, no licence); repeated rows are scanned each; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers, from the public licence texts.
SENTENCES = {
    "released under the mit license": "MIT-ref",
    "licensed under the mit license": "MIT-ref",
    "this project is licensed under the mit license": "MIT-ref",
    "the mit license": "MIT-title",
    "mit license": "MIT-title",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:": "MIT-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-notice",
    "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "MIT-warranty",
    "licensed under the apache license, version 2.0": "Apache-2-ref",
    "licensed under the apache license, version 2.0 (the \"license\")": "Apache-2-ref",
    "you may not use this file except in compliance with the license": "Apache-compliance",
    "you may obtain a copy of the license at": "Apache-copy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied": "Apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "Apache-see",
    "this work is licensed under the gnu general public license, version 3": "GPL-3-ref",
    "licensed under the gnu general public license, version 3": "GPL-3-ref",
    "licensed under the gnu general public license, version 2": "GPL-2-ref",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "GPL-3-later",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version": "GPL-2-later",
    "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "GPL-warranty",
    "see the gnu general public license for more details": "GPL-see",
    "you should have received a copy of the gnu general public license along with this program": "GPL-copy",
    "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version": "LGPL-21-later",
    "licensed under cc by-nc 4.0": "CC-BY-NC-4-ref",
    "licensed under cc by 4.0": "CC-BY-4-ref",
    "licensed under cc by-sa 4.0": "CC-BY-SA-4-ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "CC-BY-4-ref",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "CC-BY-SA-4-ref",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "CC-BY-NC-4-ref",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD-grant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSD-source",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSD-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-endorse",
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "MPL-2-ref",
    "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/": "MPL-2-copy",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISC-grant",
    "this is free and unencumbered software released into the public domain": "Unlicense-grant",
    "all rights reserved": "Reserved",
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "MIT-liability",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so": "MIT-0-grant",
    "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSD-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage": "BSD-liability",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0BSD-grant",
    "the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC-warranty",
    "in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software": "ISC-liability",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "AGPL-3-later",
    "see the gnu affero general public license for more details": "AGPL-see",
    "this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "LGPL-3-later",
    "this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "LGPL-warranty",
    "see the gnu lesser general public license for more details": "LGPL-see",
    "this software is provided 'as-is', without any express or implied warranty": "Zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "Zlib-liability",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "Zlib-grant",
    "distributed under the boost software license, version 1.0": "BSL-1-ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "EPL-2-ref",
    "to the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0-waiver",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "Unlicense-free",
}

#: Ordered: a rule's identifiers must follow one another in the sequence.
RULES = (
    ("Apache-2.0", ("Apache-2-ref", "Apache-compliance", "Apache-copy", "Apache-warranty", "Apache-see")),
    ("Apache-2.0", ("Apache-2-ref", "Apache-compliance", "Apache-copy")),
    ("GPL-3.0-or-later", ("GPL-3-later", "GPL-warranty", "GPL-see")),
    ("GPL-3.0-or-later", ("GPL-3-later",)),
    ("GPL-2.0-or-later", ("GPL-2-later", "GPL-warranty", "GPL-see")),
    ("GPL-2.0-or-later", ("GPL-2-later",)),
    ("AGPL-3.0-or-later", ("AGPL-3-later", "GPL-warranty", "AGPL-see")),
    ("AGPL-3.0-or-later", ("AGPL-3-later",)),
    ("LGPL-3.0-or-later", ("LGPL-3-later", "LGPL-warranty", "LGPL-see")),
    ("LGPL-3.0-or-later", ("LGPL-3-later",)),
    ("LGPL-2.1-or-later", ("LGPL-21-later", "LGPL-warranty", "LGPL-see")),
    ("LGPL-2.1-or-later", ("LGPL-21-later",)),
    ("MIT", ("MIT-title", "MIT-grant", "MIT-notice", "MIT-warranty", "MIT-liability")),
    ("MIT", ("MIT-title", "MIT-grant", "MIT-notice", "MIT-warranty")),
    ("MIT", ("MIT-grant", "MIT-notice", "MIT-warranty", "MIT-liability")),
    ("MIT", ("MIT-grant", "MIT-notice", "MIT-warranty")),
    ("MIT-0", ("MIT-0-grant", "MIT-warranty", "MIT-liability")),
    ("BSD-3-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse", "BSD-warranty", "BSD-liability")),
    ("BSD-2-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-warranty", "BSD-liability")),
    ("ISC", ("ISC-grant", "ISC-warranty", "ISC-liability")),
    ("0BSD", ("0BSD-grant", "ISC-warranty", "ISC-liability")),
    ("Zlib", ("Zlib-warranty", "Zlib-liability", "Zlib-grant")),
    ("Unlicense", ("Unlicense-grant", "Unlicense-free")),
    ("MIT", ("MIT-grant", "MIT-notice")),
    ("BSD-3-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse")),
    ("BSD-2-Clause", ("BSD-grant", "BSD-source", "BSD-binary")),
    ("MPL-2.0", ("MPL-2-ref", "MPL-2-copy")),
    ("ISC", ("ISC-grant",)),
    ("Unlicense", ("Unlicense-grant",)),
    ("MPL-2.0", ("MPL-2-ref",)),
    ("BSL-1.0", ("BSL-1-ref",)),
    ("EPL-2.0", ("EPL-2-ref",)),
    ("CC0-1.0", ("CC0-waiver",)),
    ("Apache-2.0", ("Apache-2-ref",)),
    ("GPL-3.0-only", ("GPL-3-ref",)),
    ("GPL-2.0-only", ("GPL-2-ref",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4-ref",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4-ref",)),
    ("CC-BY-4.0", ("CC-BY-4-ref",)),
    ("MIT", ("MIT-ref",)),
    ("MIT", ("MIT-title",)),
)

HINT = r"(?i)licen[cs]e|copyright|permi(ssion|tted)|warrant|redistribut|free[\s#/*-]+software|unencumbered|all[\s#/*-]+rights|no[\s#/*-]+event|anyone|mozilla\.org"


#: Any known sentence between two boundaries, the longest first.
KNOWN = r"(?<=\A|\n|[.;!?][ \n])(?:" + "|".join("[ \\n]".join(map(re.escape, s.split(" "))) for s in sorted(SENTENCES, key=len, reverse=True)) + r")(?=[.;!?]*(?:\n|\z)|[.;!?]+ )"


def normalised(text: Column) -> Column:
    """Lines without comment signs; a blank line before each list item."""
    flat = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), text), r"\r", ""), r"\n[ \t]*(#|//|/\*|\*/|\*|--)*[ \t]*", "\n")
    lines = F.regexp_replace(F.regexp_replace(F.trim(F.lower(flat)), r"[ \t]+", " "), r" ?\n", "\n")
    return F.regexp_replace(lines, r"\n(?:[-•]|\(?[0-9a-z]{1,2}\)) ", "\n\n")


def identifiers(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    return F.transform(F.regexp_extract_all(normalised(text), F.lit(KNOWN), F.lit(0)), lambda s: F.element_at(known, F.replace(s, F.lit("\n"), F.lit(" "))))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sequence, licenses, partial): known sentences, their identifiers in order, the licences that
    rules explain (in rule order, each once), and whether identifiers are left over. What a rule has taken leaves a gap, which
    no other rule spans."""
    text = F.coalesce("text", F.lit(""))
    ids = docs.select("doc_id", F.when(text.rlike(HINT), identifiers(text)).otherwise(F.array().cast("array<string>")).alias("ids"))
    start = F.struct(F.array_join(F.transform("ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "").alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(seq)).alias("seq")) for name, seq in RULES])

    def fold(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["seq"])
        return F.struct(F.when(hit, F.replace(state["rest"], rule["seq"], F.lit(GAP))).otherwise(state["rest"]).alias("rest"), F.when(hit & ~F.array_contains(state["found"], rule["name"]), F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    done = ids.withColumn("done", F.when(F.size("ids") > 0, F.aggregate(rules, start, fold)).otherwise(start))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", "|").alias("sequence"), F.array_join("done.found", ",").alias("licenses"), (F.replace("done.rest", F.lit(GAP), F.lit("")) != "").alias("partial"))


GAP = "/"


def _sequence(seq: tuple[str, ...]) -> str:
    return "".join(f"|{i}|" for i in seq)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    """The same in DuckDB, whose patterns can't look behind or ahead: each boundary is written twice, so that a sentence may
    take one copy on each side. One step of a chain of subqueries per rule."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "map([" + ", ".join(map(q, SENTENCES)) + "], [" + ", ".join(map(q, SENTENCES.values())) + "])"
    join = lambda w: f"(?:{re.escape(w[-1])} {re.escape(w[-1])} |{re.escape(w[-1])}\\n\\n)" if w[-1] in ".;!?" else re.escape(w[-1]) + "(?: |\\n\\n)"
    twice = ["".join(re.escape(w[:-1]) + join(w) for w in s.split(" ")[:-1]) + re.escape(s.split(" ")[-1]) for s in sorted(SENTENCES, key=len, reverse=True)]
    pattern = q("(?:^|\\n|[.;!?][ \\n])(" + "|".join(twice) + ")(?:[.;!?]*(?:\\n|$)|[.;!?]+ )")
    steps = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
flat AS (SELECT doc_id, regexp_matches(text, {q(HINT)}) AS hint,
  regexp_replace(replace(chr(10) || text, chr(13), ''), '\\n[ \\t]*(#|//|/\\*|\\*/|\\*|--)*[ \\t]*', chr(10), 'g') AS t FROM base),
plain AS (SELECT doc_id, hint, regexp_replace(regexp_replace(trim(lower(t), ' '), '[ \\t]+', ' ', 'g'), ' ?\\n', chr(10), 'g') AS t FROM flat),
twice AS (SELECT doc_id, hint, regexp_replace(replace(regexp_replace(t, '\\n(?:[-•]|\\(?[0-9a-z]{{1,2}}\\)) ', chr(10) || chr(10), 'g'), chr(10), chr(10) || chr(10)), '([.;!?]) ', '\\1 \\1 ', 'g') AS t FROM plain),
ids AS (SELECT doc_id, CASE WHEN hint THEN list_transform(regexp_extract_all(t, {pattern}, 1),
  lambda s: KNOWN[regexp_replace(replace(s, chr(10) || chr(10), ' '), '([.;!?]) [.;!?] ', '\\1 ', 'g')]) ELSE [] END AS ids FROM twice),
s0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: '|' || i || '|'), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM ids)""".replace("KNOWN", known)
    for k, (name, seq) in enumerate(RULES):
        s = q(_sequence(seq))
        steps += f""",
s{k + 1} AS (SELECT doc_id, ids, replace(rest, {s}, '{GAP}') AS rest,
  CASE WHEN contains(rest, {s}) AND NOT list_contains(found, {q(name)}) THEN list_append(found, {q(name)}) ELSE found END AS found FROM s{k})"""
    return steps + f"""
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, '|') AS sequence,
  array_to_string(found, ',') AS licenses, replace(rest, '{GAP}', '') <> '' AS partial FROM s{len(RULES)}"""
