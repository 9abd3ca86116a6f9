"""Licence sentences and rules."""

import textwrap

import pytest
from helpers import clashing, documents
from stayrate.llm import licenses

GPL = """
 * This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
 * Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
 * any later version.
 *
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
 * warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.
"""
CASES = [
    (None, [], []), ("", [], []), ("No such words here.", [], []),
    ("Licensed under the Apache License, Version 2.0.", ["apache2-licensed"], ["Apache-2.0"]),
    ("Text. Released under the MIT License.\nmore | text", ["mit-released"], ["MIT"]),
    ("first line\nLicensed under CC BY-NC 4.0.\nlast", ["cc-by-nc-4-short"], ["CC-BY-NC-4.0"]),
    ("A licence of my own! Licensed under the MIT License.", ["?", "mit-licensed"], ["MIT"]),
    ("My own license.", ["?"], []),
    (GPL, ["gpl3-later", "gpl-no-warranty", "gpl-details"], ["GPL-3.0-or-later"]),
    ("This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License. "
     "Released under the MIT License.", ["gpl3-work", "mit-released", "mit-released"], ["GPL-3.0-only", "MIT"]),
    ("// Licensed under the Apache License, Version 2.0 (the \"License\"); x. "
     "You may not use this file except in compliance with the License.", ["?", "apache2-comply"], []),
    ("licence " * 200_000, ["?"], []),
    ("x" * 1_000_000 + ". Released under the MIT License.", ["mit-released"], ["MIT"]),
]


def test_cases(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(CASES)] + [(3, CASES[3][0]), (None, CASES[3][0])]
    docs = clashing(documents(spark, rows), "sentence_ids", "licences", "rest")
    found = [tuple(r) for r in licenses.recognised(docs).collect()]
    assert len(found) == len(rows)
    for i, ids, names in found:
        assert (ids, names) == CASES[3 if i is None else i][1:]
    assert licenses.recognised(documents(spark, [])).count() == 0


def test_order_of_rules_and_unknown_sentences_between(spark):
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that " \
            "the following conditions are met. "
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the " \
             "following disclaimer. "
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the " \
             "following disclaimer in the documentation and/or other materials provided with the distribution. "
    name = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote " \
           "products derived from this software without specific prior written permission. "
    docs = documents(spark, [(1, grant + source + binary + name), (2, grant + source + binary), (3, grant + source),
                             (4, grant + "An odd permission. " + source + binary)])
    found = {r["doc_id"]: r["licences"] for r in licenses.recognised(docs).collect()}
    assert found == {1: ["BSD-3-Clause"], 2: ["BSD-2-Clause"], 3: [], 4: []}


@pytest.mark.parametrize("name, ids", licenses.RULES)
def test_every_rule_uses_known_sentences(name, ids):
    assert set(ids) <= set(licenses.SENTENCES) and name


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
       "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
       "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
       "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.")
BSD2 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
WARRANTY = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.",)
OWNED = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL2 = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>.")
APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
          "http://www.apache.org/licenses/LICENSE-2.0",
          "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.")
NOTICES = {
    "MIT": MIT, "ISC": ISC, "BSD-2-Clause": BSD2 + WARRANTY, "BSD-3-Clause": BSD2 + (OWNED.format("the copyright holder"),) + WARRANTY,
    "GPL-2.0-or-later": GPL2, "Apache-2.0": APACHE,
    "GPL-3.0-or-later": (GPL2[0].replace("software;", "software:").replace("Foundation;", "Foundation,").replace("2", "3"), *GPL2[1:]),
}


def forms(notice):
    """A notice with one line a paragraph, wrapped, in a comment, and on one line."""
    wrapped = "\n\n".join(textwrap.fill(p, 72) for p in notice)
    return ["\n\n".join(notice), wrapped, textwrap.indent(wrapped, " * ", lambda _: True), " ".join(notice), wrapped.replace("\n", "\r\n")]


HEADS = ("", "Copyright (c) 2020 Foo\n", "Copyright 2020 Foo Inc\nAll rights reserved\n\n", "Some License\n\nCopyright (c) 2020 Foo\n\n")


@pytest.mark.parametrize("name", NOTICES)
def test_published_notices(spark, name):
    texts = [head + form for head in HEADS for form in forms(NOTICES[name])]
    texts += [(head + form).replace("\n", " ") for head in HEADS for form in forms(NOTICES[name])[:1]]
    found = licenses.recognised(documents(spark, list(enumerate(texts)))).collect()
    assert [(r["doc_id"], r["licences"]) for r in found if r["licences"] != [name]] == [] and len(found) == len(texts)


def test_other_wordings(spark):
    texts = [
        ("\n".join((*BSD2, OWNED.format("Foo Inc. and Sons"))), ["BSD-3-Clause"]),
        ("\n".join(p.replace("1.", "(a)").replace("2.", "b)") for p in BSD2), ["BSD-2-Clause"]),
        ("\n".join(BSD2[:2]) + "\n\nAn odd permission.\n\n" + BSD2[2], []),
        ("This is not licensed under the MIT License.", []), ("This is not Licensed under the MIT License.", []),
        ("Note: licensed under the MIT License.", ["MIT"]), (ISC[0].replace("and/or", "and"), ["ISC"]),
    ]
    found = licenses.recognised(documents(spark, [(i, t) for i, (t, _) in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["licences"] for r in found} == {i: names for i, (_, names) in enumerate(texts)}
