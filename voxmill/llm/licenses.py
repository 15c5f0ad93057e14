"""Op 8, licence scans by sentence and rule. DataFrame functions only.

A text falls into sentences; each is normalised and looked up among known licence sentences; the identifiers found, in
text order, are matched against rules, first the longest chains; what a rule matched is taken out before the next rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.session import read_table

#: Known sentences, normalised (lower case, runs of other characters than a-z, 0-9 and dots one blank, no
#: dot at the end), with their identifiers.
SENTENCES = {
    "released under the mit license": "MIT-NOTE",
    "licensed under the mit license": "MIT-NOTE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-KEEP",
    "the software is provided as is without warranty of any kind express or implied": "AS-IS",
    "licensed under the apache license version 2.0": "APACHE2-NOTE",
    "licensed under the apache license version 2.0 the license": "APACHE2-NOTE",
    "you may not use this file except in compliance with the license": "APACHE2-USE",
    "you may obtain a copy of the license at": "APACHE2-COPY",
    "this work is licensed under the gnu general public license version 3": "GPL3-NOTE",
    "this program is free software": "GPL-FREE",
    "you should have received a copy of the gnu general public license along with this program": "GPL-COPY",
    "licensed under cc by 4.0": "CCBY4-NOTE",
    "licensed under cc by sa 4.0": "CCBYSA4-NOTE",
    "licensed under cc by nc 4.0": "CCBYNC4-NOTE",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CCBYNC4-NOTE",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SRC",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BIN",
    "all rights reserved": "RESERVED",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-NOTE",
}
#: Chains of identifiers, in the order in which they are tried, and what each stands for.
RULES = [
    ("MIT-GRANT MIT-KEEP AS-IS", "MIT"),
    ("APACHE2-NOTE APACHE2-USE APACHE2-COPY", "Apache-2.0"),
    ("GPL-FREE GPL-COPY", "GPL"),
    ("BSD-SRC BSD-BIN", "BSD-2-Clause"),
    ("MIT-GRANT MIT-KEEP", "MIT"),
    ("MIT-NOTE", "MIT"),
    ("APACHE2-NOTE", "Apache-2.0"),
    ("GPL3-NOTE", "GPL-3.0"),
    ("CCBY4-NOTE", "CC-BY-4.0"),
    ("CCBYSA4-NOTE", "CC-BY-SA-4.0"),
    ("CCBYNC4-NOTE", "CC-BY-NC-4.0"),
    ("UNLICENSE-NOTE", "Unlicense"),
    ("RESERVED", "proprietary"),
]
#: Whole sentences of licence texts and notices, or variants of those above.
WHOLE = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-GRANT",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT-KEEP",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AS-IS",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement": "AS-IS",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-GRANT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC-AS-IS",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2-BASIS",
    "apache license version 2.0 january 2004": "APACHE2-TITLE",
    "apache license version 2.0 january 2004 http www.apache.org licenses": "APACHE2-TITLE",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPL-TERMS",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3-TERMS",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2-TERMS",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL2-ONLY",
    "either version 2 of the license or at your option any later version": "VERSION-2",
    "either version 2.1 of the license or at your option any later version": "VERSION-21",
    "either version 3 of the license or at your option any later version": "VERSION-3",
    "this library is free software": "LGPL-FREE",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPL-TERMS",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3-TERMS",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "LGPL21-TERMS",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3-TERMS",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPL-COPY",
    "you should have received a copy of the gnu lesser general public license along with this program": "LGPL-COPY",
    "gnu general public license version 3 29 june 2007": "GPL3-TITLE",
    "gnu general public license version 2 june 1991": "GPL2-TITLE",
    "gnu lesser general public license version 3 29 june 2007": "LGPL3-TITLE",
    "gnu lesser general public license version 2.1 february 1999": "LGPL21-TITLE",
    "gnu affero general public license version 3 19 november 2007": "AGPL3-TITLE",
    "mozilla public license version 2.0": "MPL2-TITLE",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2-NOTE",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "MPL2-COPY",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "MPL2-COPY",
    "this work is licensed under a creative commons attribution 4.0 international license": "CCBY4-NOTE",
    "this work is licensed under the creative commons attribution 4.0 international license": "CCBY4-NOTE",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "CCBYSA4-NOTE",
    "this work is licensed under the creative commons attribution sharealike 4.0 international license": "CCBYSA4-NOTE",
    "this work is licensed under the creative commons attribution noncommercial 4.0 international license": "CCBYNC4-NOTE",
    "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0-NOTE",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-NOTE",
}
#: Chains tried before those above, longer ones first.
WHOLE_RULES = [
    ("RESERVED BSD-GRANT BSD-SRC BSD-BIN BSD-NAME", "BSD-3-Clause"),
    ("BSD-GRANT BSD-SRC BSD-BIN BSD-NAME", "BSD-3-Clause"),
    ("RESERVED BSD-SRC BSD-BIN BSD-NAME", "BSD-3-Clause"),
    ("BSD-SRC BSD-BIN BSD-NAME", "BSD-3-Clause"),
    ("RESERVED BSD-GRANT BSD-SRC BSD-BIN", "BSD-2-Clause"),
    ("BSD-GRANT BSD-SRC BSD-BIN", "BSD-2-Clause"),
    ("RESERVED BSD-SRC BSD-BIN", "BSD-2-Clause"),
    ("APACHE2-NOTE APACHE2-USE APACHE2-COPY APACHE2-BASIS", "Apache-2.0"),
    ("LGPL-FREE LGPL-TERMS VERSION-21 LGPL-COPY", "LGPL-2.1-or-later"),
    ("LGPL-FREE LGPL21-TERMS LGPL-COPY", "LGPL-2.1-or-later"),
    ("LGPL-FREE LGPL3-TERMS LGPL-COPY", "LGPL-3.0-or-later"),
    ("GPL-FREE LGPL3-TERMS LGPL-COPY", "LGPL-3.0-or-later"),
    ("GPL-FREE AGPL3-TERMS", "AGPL-3.0-or-later"),
    ("GPL-FREE GPL3-TERMS GPL-COPY", "GPL-3.0-or-later"),
    ("GPL-FREE GPL-TERMS VERSION-3 GPL-COPY", "GPL-3.0-or-later"),
    ("GPL-FREE GPL2-TERMS GPL-COPY", "GPL-2.0-or-later"),
    ("GPL-FREE GPL-TERMS VERSION-2 GPL-COPY", "GPL-2.0-or-later"),
    ("GPL-FREE GPL2-ONLY GPL-COPY", "GPL-2.0-only"),
    ("ISC-GRANT ISC-AS-IS", "ISC"),
    ("MPL2-NOTE MPL2-COPY", "MPL-2.0"),
    ("MPL2-NOTE", "MPL-2.0"),
    ("MPL2-TITLE", "MPL-2.0"),
    ("GPL3-TITLE", "GPL-3.0"),
    ("GPL2-TITLE", "GPL-2.0"),
    ("LGPL3-TITLE", "LGPL-3.0"),
    ("LGPL21-TITLE", "LGPL-2.1"),
    ("AGPL3-TITLE", "AGPL-3.0"),
    ("APACHE2-TITLE", "Apache-2.0"),
    ("ISC-GRANT", "ISC"),
    ("CC0-NOTE", "CC0-1.0"),
]
#: Beginnings of grants, before which a title or a copyright line may run on without a sign.
OPENERS = ["permission is hereby granted free of charge", "permission to use copy modify", "redistribution and use in source and binary forms"]
#: In normalised text S is a sentence's end; a blank of a sentence may be a line's end, but not an empty line.
_GAP = r"(?: ?\n ?| )"


def _expression() -> str:
    spaced = lambda x: x.replace(".", r"\.").replace(" ", _GAP)
    known = [spaced(x) for x in sorted({**SENTENCES, **WHOLE}, key=lambda x: -len(x))]
    # the one sentence that holds a name
    ends = "neither the name of", " may be used to endorse or promote products derived from this software without specific prior written permission"
    known.append(rf"{spaced(ends[0])}(?:{_GAP}[a-z0-9.]+){{1,40}}?{spaced(ends[1])}")
    return rf"(?<![^S\n])[ .]*+(?:[a-z0-9] (?=redistributions|neither))?+({'|'.join(known)})[ .]*+(?![^S\n])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in text order.

    A sentence begins and ends at a sentence's or a line's end and may be wrapped over lines within its paragraph.
    """
    ended = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[.!?:;][ \t\r\n]+", "S")
    plain = F.regexp_replace(ended, r"[^a-z0-9.S\n]+", " ")
    plain = F.regexp_replace(plain, f" (?={'|'.join(OPENERS)})", "S")
    known = F.create_map(*[F.lit(x) for pair in {**SENTENCES, **WHOLE}.items() for x in pair])
    found = F.regexp_extract_all(plain, F.lit(_expression()), F.lit(1))
    return F.transform(found, lambda s: F.coalesce(F.try_element_at(known, F.regexp_replace(s, _GAP, " ")), F.lit("BSD-NAME")))


def matched(ids: Column) -> Column:
    """Licences by the rules, in order of the rules, each as often as its chain occurs."""
    start = F.struct(F.concat(F.lit(" "), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), " "), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("out"))
    rules = F.array(*[F.struct(F.lit(" ".join(f"<{x}>" for x in chain.split())).alias("chain"), F.lit(name).alias("name")) for chain, name in WHOLE_RULES + RULES])

    def take(state: Column, rule: Column) -> Column:
        rest = F.replace(state["rest"], rule["chain"], F.lit(""))
        times = ((F.length(state["rest"]) - F.length(rest)) / F.length(rule["chain"])).cast("int")
        return F.when(times > 0, F.struct(rest.alias("rest"), F.concat(state["out"], F.array_repeat(rule["name"], times)).alias("out"))).otherwise(state)

    return F.when(F.size(ids) > 0, F.aggregate(rules, start, take, lambda s: s["out"])).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sentence_ids, licenses)`` of every whole text.

    A licence is known by its sentences in their order, whatever its lines, signs, blanks, case and comment marks. A null
    or empty text has none of either. Rows stay apart, repeated ones too; other columns are left out.
    """
    own = df.select(F.col(f"`{id_col}`").alias("doc_id"), sentence_ids(F.col(f"`{text_col}`").cast("string")).alias("sentence_ids"))
    return own.withColumn("licenses", matched(F.col("sentence_ids")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every whole text of ``documents``; null and empty texts have none, repeated rows and null ids stay."""
    done = scan(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in {**SENTENCES, **WHOLE}.items())
    steps, out = [], []
    for i, (chain, name) in enumerate(WHOLE_RULES + RULES):
        chain = " ".join(f"<{x}>" for x in chain.split())
        steps.append(f"r{i + 1} AS (SELECT *, replace(s{i}, '{chain}', '') AS s{i + 1}, (length(s{i}) - length(replace(s{i}, '{chain}', ''))) // {len(chain)} AS t{i} FROM r{i})")
        out.append(f"list_transform(range(t{i}), lambda x: '{name}')")
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
lines AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?:;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS xs FROM documents),
parts AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM lines),
plain AS (SELECT doc_id, k, regexp_replace(regexp_replace(lower(x), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS s FROM parts),
found AS (SELECT doc_id, list(id ORDER BY k) AS ids FROM plain JOIN known ON s = sentence GROUP BY doc_id),
r0 AS (SELECT d.doc_id, coalesce(ids, []) AS ids, ' ' || array_to_string(list_transform(coalesce(ids, []), lambda x: '<' || x || '>'), ' ') || ' ' AS s0 FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_concat({", ".join(out)}), ',') AS licenses FROM r{len(WHOLE_RULES + RULES)}
"""


OP8_SQL = _sql()
