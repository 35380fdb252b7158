"""License scans: known licence sentences, and rules over the order in which they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Sentences end at these signs before white space, and at blank lines (lines without letters and digits).
ENDS = r"""([.!?;:]["')\]]*)[\x20\x09-\x0D]+"""
BLANK = r"\n[^A-Za-z0-9\n\x01]*\n"
# How notices begin, and names that stand inside sentences: words a sentence must have, pattern, what it becomes; the first whose words are there counts.
SAME = (
    ("permission is hereby granted free", r"^(?:the )?(?:mit license )?(?:mit )?copyright [a-z0-9 ]{1,200}? permission is hereby granted free ", "permission is hereby granted free "),
    ("neither the name of ", r"^neither the name of [a-z0-9 ]{1,200}? nor the names of its contributors ", "neither the name of the holder nor the names of its contributors "),
    ("this software is provided by ", r"^this software is provided by [a-z0-9 ]{1,200}? as is and any express or implied warranties ", "this software is provided by the holders as is and any express or implied warranties "),
    ("d under ", r"^(?:(?:this|the|all|our)(?: [a-z0-9]+){1,4} (?:is|are) |it is )?(?:released|licensed|distributed|made available|published) under (?:the terms (?:of|and conditions of) )?(?:the |a |an )?", "licensed under "),
    ("available under ", r"^(?:(?:this|the|all|our)(?: [a-z0-9]+){1,4} (?:is|are) |it is )?(?:made )?available under (?:the terms (?:of|and conditions of) )?(?:the |a |an )?", "licensed under "),
)

# Normalised sentences of public licences and notices, by identifier (fixed values).
SENTENCES = {
    "apache-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-notice": "licensed under apache license version 2 0",
    "apache-notice-short": "licensed under apache license 2 0",
    "apache-notice-file": "licensed under apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "licensed under mit license",
    "mit-name": "the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-notice": "licensed under isc license",
    "gpl-free": "this program is free software",
    "gpl-free-library": "this library is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3-version": "either version 3 of the license or at your option any later version",
    "gpl2-version": "either version 2 of the license or at your option any later version",
    "lgpl21-version": "either version 2 1 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-fitness": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "gpl3-notice": "licensed under gnu general public license version 3",
    "gpl3-notice-short": "licensed under gpl v3",
    "gpl2-notice": "licensed under gnu general public license version 2",
    "gpl2-notice-short": "licensed under gpl v2",
    "mpl2-title": "mozilla public license version 2 0",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-notice": "licensed under mozilla public license 2 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-full": "licensed under creative commons attribution noncommercial 4 0 international license",
    "cc-by-full": "licensed under creative commons attribution 4 0 international license",
    "cc-by-sa-full": "licensed under creative commons attribution sharealike 4 0 international license",
    "cc0-notice": "licensed under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the holders as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-notice": "licensed under bsd 3 clause license",
    "bsd2-notice": "licensed under bsd 2 clause license",
    "spdx": "spdx license identifier",
    "spdx-apache": "apache 2 0",
    "spdx-mit": "mit",
    "spdx-bsd-3": "bsd 3 clause",
    "spdx-bsd-2": "bsd 2 clause",
    "spdx-mpl": "mpl 2 0",
    "spdx-gpl-3": "gpl 3 0 or later",
    "spdx-gpl-2": "gpl 2 0 or later",
    "all-rights": "all rights reserved",
}
# Licences and the sentences they need, one after the other; earlier rules come first (fixed values).
RULES = (
    ("Apache-2.0", ("apache-notice-file", "apache-use")),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice-short",)),
    ("Apache-2.0", ("apache-title",)),
    ("Apache-2.0", ("spdx", "spdx-apache")),
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-name", "mit-grant")),
    ("MIT", ("spdx", "spdx-mit")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl3-version")),
    ("GPL-3.0-or-later", ("spdx", "spdx-gpl-3")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl2-version")),
    ("GPL-2.0-or-later", ("spdx", "spdx-gpl-2")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-terms")),
    ("LGPL-3.0-or-later", ("gpl-free-library", "lgpl3-terms")),
    ("LGPL-2.1-or-later", ("gpl-free-library", "lgpl-terms", "lgpl21-version")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-only", ("gpl3-notice-short",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("GPL-2.0-only", ("gpl2-notice-short",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    ("LGPL-2.1-only", ("lgpl21-title",)),
    ("AGPL-3.0-only", ("agpl3-title",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy-http")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-2.0", ("spdx", "spdx-mpl")),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-full",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-full",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-by-full",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("Unlicense", ("unlicense",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-notice",)),
    ("BSD-3-Clause", ("spdx", "spdx-bsd-3")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd2-notice",)),
    ("BSD-2-Clause", ("spdx", "spdx-bsd-2")),
)


def normal(sentence: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 one space, the beginnings of notices alike."""
    def alike(plain: Column) -> Column:
        cases = F
        for words, pattern, same in SAME:
            cases = cases.when(F.contains(plain, F.lit(words)), F.regexp_replace(plain, pattern, same))
        return cases.otherwise(plain)

    # An array of one, so that the normal form is made once and not for each use.
    return F.transform(F.array(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))), alike)[0]


def sentences(text: Column) -> Column:
    """Sentences of a text, line breaks inside them kept."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ENDS, "$1\x01"), BLANK, "\x01")
    return F.filter(F.split(marked, "\x01"), lambda s: F.rlike(s, F.lit("[A-Za-z0-9]")))


def scan(documents: DataFrame) -> DataFrame:
    """Licences that each document's sentences speak of.

    Sentences, with wrapped lines joined, are mapped to the identifiers of known
    licence sentences; of an unknown one its lines are looked up one by one (titles
    and notices stand on lines of their own), and what is unknown falls out. What is left is a line of identifiers, and a rule matches where its own
    stand in it one after the other. A licence is named once, in the order of rules.
    Everything is one expression of the row: no shuffle, and the only tables are the
    fixed ones above.

    Defined cases: null and empty texts have no sentences and no licence; a null
    doc_id stays; repeated rows give repeated results; only doc_id and text are read;
    an empty table gives no rows. Returns doc_id, n_sentences, sentence_ids (array),
    licenses (array).
    """
    known = F.create_map(*(F.lit(x) for name, text in SENTENCES.items() for x in (text, name)))
    held = documents.select("doc_id", sentences(F.col("text").cast("string")).alias("found"))

    def ids(sentence: Column) -> Column:
        lines = F.transform(F.split(sentence, "\n"), lambda line: F.element_at(known, normal(line)))
        wrapped = F.when(F.contains(sentence, F.lit("\n")), lines)
        return F.transform(F.array(F.element_at(known, normal(sentence))), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.coalesce(wrapped, F.array(whole))))[0]

    marked = held.select("doc_id", F.size("found").cast("long").alias("n_sentences"), F.array_compact(F.flatten(F.transform("found", ids))).alias("sentence_ids"))
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    hits = F.array(*(F.when(F.contains(line, F.lit(f" {' '.join(ids)} ")), F.lit(name)) for name, ids in RULES))
    return marked.withColumn("licenses", F.array_distinct(F.array_compact(hits)))


def answer() -> str:
    """The same in DuckDB, arrays joined by commas."""
    cases = " ".join(f"when '{text}' then '{name}'" for name, text in SENTENCES.items())
    ends = ENDS.replace("'", "''")

    def known(sentence: str) -> str:
        plain = f"trim(regexp_replace(lower({sentence}), '[^a-z0-9]+', ' ', 'g'))"
        alike = " ".join(f"when contains(p, '{words}') then regexp_replace(p, '{pattern}', '{same}')" for words, pattern, same in SAME)
        return f"list_transform(list_transform([{plain}], lambda p: case {alike} else p end), lambda k: case k {cases} end)[1]"

    # The first rule of a licence that matches gives its place.
    rules = ", ".join(f"case when contains(line, ' {' '.join(ids)} ') then '{name}' end" for name, ids in RULES)
    return rf"""
        with s as (
            select doc_id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{ends}', '\1' || chr(1), 'g'), '{BLANK}', chr(1), 'g'), chr(1)),
                lambda x: regexp_matches(x, '[A-Za-z0-9]')) as found from documents),
        m as (select doc_id, len(found) as n_sentences, list_filter(flatten(list_transform(found, lambda x: case when {known('x')} is not null then [{known('x')}]
            else list_transform(string_split(x, chr(10)), lambda y: {known('y')}) end)), lambda x: x is not null) as ids from s),
        l as (select *, ' ' || array_to_string(ids, ' ') || ' ' as line from m),
        r as (select *, list_filter([{rules}], lambda x: x is not null) as named from l)
        select doc_id, n_sentences, array_to_string(ids, ',') as sentence_ids,
            array_to_string(list_filter(named, lambda x, i: list_position(named, x) = i), ',') as licenses from r"""
