import re
import time

from netloom.llm import licenses as L
from netloom.llm.licenses import COUNTER_EXAMPLES, CUES, NOTICES, UNKNOWN, WINDOWS, Families, op10_license_scan, scan_licenses


def test_every_counter_example_has_a_cue():
    for text in COUNTER_EXAMPLES:
        assert re.search(CUES, text)


def slow_scan(text, model, weights, known):
    """Rows of one text: (line, family, probability, similarity, confirmed), window by window."""
    rows, first_line = [], 0
    telling, versions = set(L.telling_pairs()), L.versions_of_families()
    for part in re.split(r"\n[ \t\x0b\f\r]*(?=\n)", text or ""):
        placed = [(w, k, j > 0 and at == 0) for k, line in enumerate(part.split("\n")) for j, s in enumerate(re.split(r"(?<!\b[vV])[.!?;:][ \t]+", line)) for at, w in enumerate(L.words_of(s))]
        words = [w for w, *_ in placed]
        pairs = [" ".join(words[k : k + 2]) for k in range(len(words))]

        def denied(k):
            before = any(pairs[d] in L.DENIALS_BEFORE and not any(x[2] for x in placed[d + 1 : k + 1]) for d in range(max(0, k - L.DENIED_BEFORE), k + 1))
            return before or any(pairs[d] in L.DENIALS_AFTER and not any(x[2] for x in placed[k + 1 : d + 1]) for d in range(k + 1, min(len(words), k + L.DENIED_AFTER + 1)))

        found = {}
        if re.search(CUES, part) or any(f"{a} {b}" in telling for a, b in zip(L.words_of(part), L.words_of(part)[1:])):
            for place, (word, line) in enumerate((w, k) for w, k, _ in placed):
                if " ".join(words[place : place + 2]) not in telling and not re.search(L.CUE, word):
                    continue
                judged = []
                for size, before in WINDOWS:
                    start = max(0, place - before)
                    grams = L.grams_of(words[start:][:size])
                    names = [k for k in range(start, min(start + size, len(words))) if pairs[k] in telling]
                    hidden = bool(names) and all(map(denied, names))
                    # a window's last word is read with the word behind it
                    more = start + size + L.VERSION_AFTER
                    stated = [v for k in range(start, min(more, len(words))) for v in L.stated_versions(words[k : k + 2])[: 1 if re.search(L.VERSION, pairs[k]) or re.search(L.NAMED_VERSION, words[k]) else 0]]
                    sums = [b + sum(weights.get(g, (0,) * 99)[k] for g in grams) for k, b in enumerate(model.intercepts)]
                    chances = L._softmax(sums, model.temperature)
                    shared = [sum(c in known.get(g, ()) for g in grams) for c in model.classes]
                    best = max(range(1, len(sums)), key=lambda k: (sums[k], model.classes[k]))
                    own = any(g in telling and model.classes[best] in known[g] for g in grams)
                    fits = not stated or not versions[model.classes[best]] or bool(set(stated) & set(versions[model.classes[best]]))
                    sure = fits and not hidden and chances[best] > model.cut and 2 * shared[best] >= len(grams) and shared[best] == max(shared) and own
                    judged.append((sure, size, model.classes[best], chances[best], shared[best] / len(grams)))
                sure, _, family, chance, share = max(judged)
                found.setdefault(family if sure else UNKNOWN, []).append((chance, share, -place, line, sure))
        most = max((sum(x[0] for x in xs) for f, xs in found.items() if f != UNKNOWN), default=None)
        for family, xs in found.items():
            if most is None or family != UNKNOWN and sum(x[0] for x in xs) >= 0.5 * most:
                chance, share, _, line, sure = max(xs)
                rows.append((first_line + line, family, round(chance, 6), round(share, 6), sure))
        first_line += part.count("\n") + 1
    return sorted(rows)


def test_query_against_brute_force(spark, tiny):
    model = Families(spark)
    weights, known = {r.gram: r.weights for r in model.weights.collect()}, L.families_of_grams()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {}
    for r in op10_license_scan(spark, tiny).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.family, round(r.probability, 6), round(r.similarity, 6), r.confirmed))
    want = {i: rows for i, t in texts.items() if (rows := slow_scan(t, model, weights, known))}
    assert {i: sorted(rows) for i, rows in got.items()} == want and any(f != UNKNOWN for rows in want.values() for _, f, *_ in rows)


def test_held_out_names_get_their_family_and_held_out_prose_none(spark):
    model = Families(spark)
    weights, none = {r.gram: r.weights for r in model.weights.collect()}, [0.0] * len(model.classes)
    right = []
    for family, text in L.training_texts(True):
        sums = [sum(x) for x in zip(model.intercepts, *(weights.get(g, none) for g in L.grams_of(L.words_of(text))))]
        chances = L._softmax(sums, model.temperature)
        best = max(range(1, len(sums)), key=chances.__getitem__)
        right.append((model.classes[best] if chances[best] > model.cut else UNKNOWN) == family)
    assert sum(right) / len(right) > 0.97 and model.cut < 0.9


def test_notices_are_found_and_prose_is_not(spark):
    family_of = {t: name for name, texts in NOTICES.items() for t in texts if t not in L._GPL_REST}
    prose = ["Her driver's license had expired in May.", "A dog license and permission of the landlord are needed.", "Nothing here.", "", None]
    texts = [f"Intro é\n{t}\nmore words" for t in family_of] + prose + ["x " * 50000 + "\nReleased under the MIT License."] * 2
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "Released under the MIT License.", 2)], "doc_id long, text string, line int")
    rows = scan_licenses(docs).collect()
    found = {r.doc_id: r for r in rows if r.confirmed}
    n = len(family_of)
    assert [found[k].family for k in range(n)] == list(family_of.values())
    assert all(found[k].line == 1 for k in range(n))
    assert not set(range(n, n + 5)) & set(found) and {found[n + 5].family, found[n + 6].family, found[None].family} == {"mit"}
    assert {r.family for r in rows if not r.confirmed} == {UNKNOWN}
    assert scan_licenses(docs.limit(0)).count() == 0


MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
PROSE = "The harbour was quiet when the boats came home, and the men sat down to mend their nets until the lamps were lit along the quay. "


def families(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in scan_licenses(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.family)
    return {k: found.get(k, {None}) for k in range(len(texts))}


def test_full_licences_and_notices_inside_prose_are_found(spark):
    texts = [MIT, BSD, GPL, PROSE + "Released under the MIT License.", PROSE * 200 + MIT + PROSE * 200, PROSE + "All of it is released under the MIT License unless noted. " + PROSE, PROSE + "Licensed under the Apache License, Version 2.0. " + PROSE]
    prose = ["The album was released under the license of the label. " + PROSE, PROSE + "Students of the MIT asked for permission to enter the lab.", PROSE * 20 + "The public library asks for the license of the driver."]
    assert families(spark, texts + prose) == dict(enumerate([{x} for x in ["mit", "bsd", "gpl-3.0", "mit", "mit", "mit", "apache-2.0", *[UNKNOWN] * 3]]))


def test_names_versions_and_identifiers(spark):
    named = {
        "GNU General Public License, version 2": "gpl-2.0",
        GPL.replace("version 3", "version 2"): "gpl-2.0",
        "This file is free software under GPL version 2 only": "gpl-2.0",
        "SPDX-License-Identifier: MIT": "mit",
        "Dual MIT/Apache-2.0, choose one": "mit-or-apache-2.0",
        "Lizenziert unter GPL 3.": "gpl-3.0",
        "Distributed under CC BY 4.0.": "cc-by",
        "Released under GPLv3.": "gpl-3.0",
        "covered by the GNU GPL, version 3 or later": "gpl-3.0",
        PROSE + "Released under GPLv3. " + PROSE: "gpl-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "lgpl",
        "Covered by the Elastic License.": UNKNOWN,
        "Er kam mit dem Apache in die Stadt und fuhr mit ihm fort.": UNKNOWN,
        L._GPL_REST[0]: UNKNOWN,
        PROSE: None,
    }
    assert families(spark, list(named)) == dict(enumerate({x} for x in named.values()))


def test_other_versions_and_denials_are_unknown(spark):
    named = {
        "Licensed under the Apache License, Version 1.1.": UNKNOWN,
        "Apache License Version 1.0": UNKNOWN,
        "This work is licensed under the GNU General Public License, version 1.": UNKNOWN,
        "Licensed under CC BY 3.0.": UNKNOWN,
        "Mozilla Public License Version 1.1": UNKNOWN,
        "Licensed under the Apache License, Version 2.": "apache-2.0",
        "Licensed under the Apache License, v. 2.0": "apache-2.0",
        "Version 1.1 of the tool. Released under the MIT License.": "mit",
        "We do not use the MIT License here.": UNKNOWN,
        "This is not the\nMIT License, whatever the page says.": UNKNOWN,
        "The MIT License does not apply to the pictures.": UNKNOWN,
        "The code is no longer available under the GNU General Public License, version 3.": UNKNOWN,
        "It is not finished. Released under the MIT License.": "mit",
        "Unter der Apache-Lizenz 2.0 veröffentlicht": "apache-2.0",
        "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0",
        "Made available under the Eclipse Public License 2.0": "epl-2.0",
        "Licensed under the EUPL, Version 1.2": "eupl-1.2",
        "Released under the zlib license.": "zlib",
    }
    got = families(spark, list(named))
    assert {t: got[k] for k, t in enumerate(named)} == {t: {x} for t, x in named.items()}


def test_every_family_knows_its_own_versions():
    versions = L.versions_of_families()
    assert versions["apache-2.0"] == ["2"] and versions["lgpl"] == ["2.1", "3"] and versions["cc-by"] == ["4"] and versions["mit"] == [] and versions["gpl-3.0"] == ["3"]


def test_wrapped_notices_and_paragraphs(spark):
    wrapped = "to any person obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without\nrestriction, including without limitation the rights to use, copy, modify,"
    apache = "you may not use this file\nexcept in compliance with the License.\nYou may obtain a copy"
    texts = [wrapped, apache, f"Title\n\n{wrapped}\n \t\n\nReleased under GPLv3.\nSPDX-License-Identifier: GPL-3.0-only\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted((r.doc_id, r.family, r.line) for r in scan_licenses(docs).collect())
    assert [(d, f) for d, f, _ in rows] == [(0, "mit"), (1, "apache-2.0"), (2, "gpl-3.0"), (2, "mit")]
    assert rows[2][2] in (7, 8) and rows[3][2] in (2, 3, 4)


def test_a_text_of_very_many_paragraphs(spark):
    """The work follows the text's length: a paragraph's row has no more of it than the paragraph."""
    parts = ["Released under the MIT License." if k % 25_000 == 7 else f"word{k} and\nothers" for k in range(100_000)]
    began = time.monotonic()
    rows = scan_licenses(spark.createDataFrame([(1, "\n\n".join(parts))], "doc_id long, text string")).collect()
    assert time.monotonic() - began < 60
    lines = "\n\n".join(parts).split("\n")
    assert sorted(r.line for r in rows) == [k for k, line in enumerate(lines) if "MIT" in line] and all(r.family == "mit" for r in rows)
