"""Licence scanning by sentence rules.

A text is cut into sentences, each is normalised (lower case; letters, digits and dots; single blanks) and looked up
among known licence sentences. The identifiers of a document, in order, are matched against ordered rules: each rule
is a sequence of identifiers; the first rule that occurs takes its identifiers out, then the next rule is tried.
A sentence that speaks of licences but is not known is written ``?`` and keeps its neighbours apart.

A sentence ends at ``.``, ``!`` or ``?`` before white space. One that is not known as a whole is searched for known
sentences that begin at a line, a list marker or after ``:`` or ``;`` and end at a line, a list marker, ``:`` or a URL;
they may be wrapped, and comment signs do not matter. Those of LONG words or more, which nothing else looks like, may
also begin at a capital within a line, as below a copyright line that was joined with them. A line of the rest that
speaks of licences is ``?``. Null and empty texts have no sentences, no licences and counts of zero; a licence that occurs twice is
named once. Repeated rows give repeated result rows. Only identifiers are looked at, never prefixes of a text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words without which no known sentence occurs, sentences of published licences, and their sequences.
KEYWORD = r"(?i)licen[cs]e|warrant|permission|copyright|redistribut"
SENTENCES = {
    "apache2-licensed": "licensed under the apache license version 2.0",
    "apache2-licensed-the": "licensed under the apache license version 2.0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "bsd-allowed": "redistribution and use in source and binary forms with or without modification are permitted "
                   "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and "
                  "the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions "
                  "and the following disclaimer in the documentation and or other materials provided with the "
                  "distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                "promote products derived from this software without specific prior written permission",
    "cc-by-4": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-4-short": "licensed under cc by 4.0",
    "cc-by-nc-4-short": "licensed under cc by nc 4.0",
    "cc-by-sa-4-short": "licensed under cc by sa 4.0",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty "
                       "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl2-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "general public license as published by the free software foundation either version 2 of the "
                  "license or at your option any later version",
    "gpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "general public license as published by the free software foundation either version 3 of the "
                  "license or at your option any later version",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted provided that the above copyright notice and this permission notice appear in all "
                 "copies",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions the above copyright notice and this permission notice shall be included in "
                 "all copies or substantial portions of the software",
    "mit-licensed": "licensed under the mit license",
    "mit-released": "released under the mit license",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v",
    "spdx-apache2": "spdx license identifier apache 2.0",
    "spdx-mit": "spdx license identifier mit",
}
RULES = (
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-no-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-no-warranty", "gpl-details")),
    ("Apache-2.0", ("apache2-licensed-the", "apache2-comply", "apache2-copy")),
    ("BSD-3-Clause", ("bsd-allowed", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-allowed", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-2.0-only", ("gpl2-work",)),
    ("Apache-2.0", ("apache2-licensed-the",)),
    ("Apache-2.0", ("apache2-licensed",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("spdx-mit",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-short",)),
)
#: Usual wordings that stand for known sentences: the Apache notice joins two by ``;``, others vary by some words.
WORDINGS = {
    f"{SENTENCES['apache2-licensed-the']} {SENTENCES['apache2-comply']}": ("apache2-licensed-the", "apache2-comply"),
    SENTENCES["isc-grant"].replace("and or distribute", "and distribute"): ("isc-grant",),
    SENTENCES["mit-grant"].replace("notice shall", "notice including the next paragraph shall"): ("mit-grant",),
}
#: The owner named in the third BSD condition, which is otherwise fixed.
BSD_OWNER = r"(?i)(\bneither\W+the\W+name\W+of\b)[\s\S]{1,200}?(\bnor\W+the\W+names\W+of\W+its\W+contributors\b)"
LONG = 12
UNKNOWN = "?"
SENTENCE_END = r"(?<=[.!?])\s+"


def normalised(sentence: Column) -> Column:
    plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " ")
    return F.regexp_replace(plain, r"^[ .]+|[ .]+$", "")


def _spaced(sentence: Column) -> Column:
    # Lower-case words with one sign between two: a line break, | for other ends, ; and ^ where only a beginning may be
    # (^ before a capital), or a blank; of several the first of this list.
    text = F.regexp_replace(sentence, r"[|^]|;(?!\s)", " ")
    text = F.lower(F.regexp_replace(text, r"(?<=\s)(?=[A-Z][a-z])", "^"))
    text = F.regexp_replace(text, r"(?<![a-z0-9])\(?(?:\d{1,2}|[a-h]|[ivx]{1,4})\)(?=\s)|:(?=\s)|(?=\bhttps?://)", "|")
    text = F.regexp_replace(F.regexp_replace(text, r"\R", "\n"), r"[^a-z0-9.\n|;^]", " ")
    text = F.regexp_replace(text, r"(?<![a-z0-9])\.+|\.+(?![a-z0-9])", " ")
    text = F.regexp_replace(text, r"(?<![ \n|;^])[ |;^]*+\n[ \n|;^]*+", "\n")
    text = F.regexp_replace(text, r"(?<![ |;^])[ ;^]*+\|[ |;^]*+", "|")
    text = F.regexp_replace(text, r"(?<![ ;^])[ ^]*+;[ ;^]*+", ";")
    text = F.regexp_replace(F.regexp_replace(text, r"(?<![ ^]) *+\^[ ^]*+", "^"), " ++", " ")
    return F.regexp_replace(text, r"^[ \n|;^]|[ \n|;^]$", "")


def _anywhere(known) -> str:
    # Pattern of the known sentences within a spaced one, longest first.
    ordered = sorted(known, key=lambda s: (-len(s.split()), s))
    gaps = lambda s: r"[ \n|;^]".join(map(re.escape, s.split()))
    long = [gaps(s) for s in ordered if len(s.split()) >= LONG]
    short = [gaps(s) for s in ordered if len(s.split()) < LONG]
    starts = [f"(?<![^{signs}])(?:{'|'.join(some)})" for signs, some in ((r"\n|;^", long), (r"\n|;", short)) if some]
    return rf"((?:{'|'.join(starts)})(?![^\n|]))"


def identifiers(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of the licence sentences of a text in order, ``?`` for unknown ones."""
    known = {sentence: (name,) for name, sentence in (sentences or SENTENCES).items()}
    if sentences is None:
        known |= WORDINGS
    ids = F.create_map(*[x for s, names in known.items() for x in (F.lit(s), F.array(*map(F.lit, names)))])
    unknown = lambda part: F.transform(
        F.filter(F.split(part, "\n"), lambda line: line.rlike(KEYWORD)), lambda _: F.lit(UNKNOWN))
    # known sentences within an unknown one stand between two \x01, the first followed by \x02
    within = lambda s: F.flatten(F.transform(
        F.split(F.regexp_replace(_spaced(s), _anywhere(known), "\x01\x02$1\x01"), "\x01"),
        lambda part: F.when(part.startswith("\x02"), F.try_element_at(ids, F.translate(F.substr(part, F.lit(2)), "\n|;^", "    ")))
        .otherwise(unknown(part))))
    owned = F.regexp_replace(text, BSD_OWNER, "$1 the copyright holder $2")
    cut_up = F.filter(F.split(owned, SENTENCE_END), lambda s: s.rlike(KEYWORD))
    named = F.flatten(F.transform(cut_up, lambda s: F.coalesce(F.try_element_at(ids, normalised(s)), within(s))))
    return F.when(text.rlike(KEYWORD), named).otherwise(F.array().cast("array<string>"))


def _sequence(names) -> str:
    return "".join(f"<{name}>" for name in names)


def licences(ids: Column, rules=RULES) -> Column:
    """Licences whose sequences occur, in rule order, each once; a rule's identifiers serve it alone."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(names)).alias("names")) for name, names in rules])
    start = F.struct(
        F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("rest"),
        F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        hit = F.struct(
            F.replace(acc["rest"], rule["names"], F.lit("<>")).alias("rest"),
            F.concat(acc["found"], F.array(rule["name"])).alias("found"))
        return F.when(F.contains(acc["rest"], rule["names"]), hit).otherwise(acc)

    found = F.aggregate(table, start, step, lambda acc: F.array_distinct(acc["found"]))
    return F.when(F.exists(ids, lambda i: i != UNKNOWN), found).otherwise(F.array().cast("array<string>"))


def recognised(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` plus ``sentence_ids`` and ``licences`` (arrays of string), one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(*keep, identifiers(text).alias("sentence_ids"))
    return found.withColumn("licences", licences(F.col("sentence_ids")))
