"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

A paragraph is the text between blank lines, whatever its lines; a notice that is
wrapped, or stands inside prose, is found by reading a paragraph through windows of
``WINDOWS`` words. Windows are laid around every place that can matter: each telling
2-gram (one that at most ``TELLING`` families' templates have, without common words)
and each cue word. A window without a telling 2-gram could not be confirmed, so no
paragraph is left out by this; a cue alone makes a row of the class "unknown".

Windows are classified by multinomial logistic regression on the presence of word
1-grams and 2-grams. The vocabulary is that of the training texts, so the table of
weights has a fixed size and is broadcast; everything else is splitting, an
equality join and sums. Training texts are notices, licences' names after lead-ins
of four languages, SPDX lines, and texts of the class "unknown": sentences with a
cue that license nothing and lead-ins before names of no known family. Half of the
lead-ins and of the unknown texts are held out: on them the temperature of the
probabilities is fitted, and the cut is the highest probability of a family that
an unknown text gets there, 1/2 at least.

A window is confirmed if its probability passes the cut and it compares best with
the predicted family's templates: at least ``MIN_SIMILARITY`` of its n-grams are in
them, a telling 2-gram of the family among these, and no other family has more. A
window that suits two versions of a licence alike divides its probability and does
not pass; one that shows the version does. Of the windows around one place the
longest that is confirmed counts, so a licence whose name is part of another's is not
taken for it. Two things that n-grams do not say are read from the words around: a window
that states versions (in it or shortly after it), none of them one that its family's
templates have, is not confirmed ("Apache License, Version 1.1"); nor is one whose every telling
2-gram stands in a denial of the same sentence ("we do not use the MIT License").
A paragraph lists every family
with at least half the evidence (summed probabilities of confirmed places) of its
first family.

Only DataFrame operations and Spark's own estimators are used.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.session import table
from netloom.llm.text import let, running

UNKNOWN = "unknown"
MIN_SIMILARITY = 0.5
#: Words of the windows, and how many of them lie before the place they are laid around.
WINDOWS = ((5, 2), (24, 14))
TELLING = 3
#: A denial is sought this many words before and after a telling 2-gram, a version after a window.
DENIED_BEFORE, DENIED_AFTER, VERSION_AFTER = 12, 4, 5

# Public licence notices, by family.
_GPL_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
)
NOTICES = {
    "agpl-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "bsl-1.0": [
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ],
    "epl-2.0": [
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "eupl-1.2": [
        "European Union Public Licence v. 1.2",
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL",
    ],
    "gpl-2.0": [
        "Released under GPLv2.",
        "Covered by the GNU GPL, version 2 or later.",
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        *_GPL_REST,
    ],
    "gpl-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Released under GPLv3.",
        "Covered by the GNU GPL, version 3 or later.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        *_GPL_REST,
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "mit-or-apache-2.0": ["Licensed under either of Apache License, Version 2.0 or MIT license at your option."],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "mpl-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "The author has dedicated the work to the public domain by waiving all rights under copyright law; see the CC0 1.0 Universal public domain dedication license.",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
}
# What licences are called in notices, and their SPDX identifiers.
NAMES = {
    "agpl-3.0": ("AGPLv3", "AGPL 3", "GNU Affero General Public License, version 3"),
    "apache-2.0": ("Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache-Lizenz 2.0", "licence Apache 2.0", "licencia Apache 2.0"),
    "bsd": ("BSD license", "BSD 3-Clause License", "BSD 2-Clause License"),
    "cc-by": ("CC BY 4.0", "CC-BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "bsl-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"),
    "epl-2.0": ("EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "eupl-1.2": ("EUPL 1.2", "EUPL v1.2", "European Union Public Licence 1.2"),
    "gpl-2.0": ("GPLv2", "GPL 2", "GPL version 2", "GNU GPL v2", "GNU General Public License, version 2"),
    "gpl-3.0": ("GPLv3", "GPL 3", "GPL version 3", "GNU GPL v3", "GNU General Public License, version 3"),
    "isc": ("ISC license",),
    "lgpl": ("LGPL 2.1", "LGPLv3", "GNU Lesser General Public License"),
    "mit": ("MIT license", "MIT licence", "MIT-Lizenz", "licence MIT", "licencia MIT"),
    "mit-or-apache-2.0": ("MIT/Apache-2.0", "MIT or Apache-2.0"),
    "mpl-2.0": ("MPL 2.0", "Mozilla Public License 2.0"),
    "public-domain": ("CC0 1.0", "Unlicense"),
    "zlib": ("zlib license", "zlib/libpng license"),
}
SPDX = {
    "agpl-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache-2.0": ("Apache-2.0",),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "cc-by": ("CC-BY-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0",),
    "bsl-1.0": ("BSL-1.0",),
    "epl-2.0": ("EPL-2.0",),
    "eupl-1.2": ("EUPL-1.2",),
    "gpl-2.0": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"),
    "gpl-3.0": ("GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"),
    "isc": ("ISC",),
    "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mit": ("MIT",),
    "mit-or-apache-2.0": ("MIT OR Apache-2.0", "Apache-2.0 OR MIT"),
    "mpl-2.0": ("MPL-2.0",),
    "public-domain": ("CC0-1.0", "Unlicense"),
    "zlib": ("Zlib",),
}
# What stands before a licence's name. The second half is held out.
LEADS = (
    "Licensed under the {}", "Released under the {}", "Distributed under the terms of the {}", "This project is covered by the {}", "Lizenziert unter der {}", "Publié sous {}", "Bajo la {}", "Dual {}",
    "Released under {}", "Licensed under {}", "Available under the {}", "Published under the terms of {}", "Veröffentlicht unter {}", "Distribué sous la {}", "Publicado bajo la {}", "{} applies",
)
# Names after which no family is meant.
OTHER_NAMES = (
    "license of the label", "Acme Commercial License", "terms of the publisher", "name of the author", "license plate office", "law of the land", "guidance of the teacher", "Elastic License",
    "version 2 of the map", "version 4 of the rules", "fishing licence", "licence fee of the port", "version 3 of the game", "public general meeting", "GNU and other animals", "MIT and other schools",
    "label of the studio", "general rules of the house", "public transport act", "version 3 of the plan", "licence of the city council", "driver's license", "agreement with the union", "old title in 1991",
)
# Sentences with a cue that license nothing.
COUNTER_EXAMPLES = [
    "He lost his driver's license after the accident last winter.",
    "The license plate of the car was covered with mud.",
    "A fishing license costs twenty dollars a year in this state.",
    "The bar was closed because it had no liquor license.",
    "Poetic license lets the author bend the facts a little.",
    "The committee will review the copyright law next spring.",
    "Copyright disputes between the two studios went on for years.",
    "She asked for permission to leave the room.",
    "They entered the field without permission of the owner.",
    "The warranty on the washing machine ends in March.",
    "A search warrant was issued by the judge on Monday.",
    "The evidence does not warrant such a conclusion.",
    "Redistribution of land was the main demand of the peasants.",
    "Income redistribution is debated in every election.",
    "The company was licensed to sell medicines in five countries.",
    "Licensed electricians must do the wiring of the house.",
    "Copyright notices are printed at the foot of every page.",
    "The pilot licence test takes two days in the north.",
    "Our software license server was down all morning.",
    "Please read the license agreement before you open the box.",
    "The team released a new version of the game under a license from the studio.",
    "The museum gave permission to copy the painting for a fee.",
    "A general license to hunt was granted to the village in 1820.",
    "The public library asks for the permission of a parent.",
]
#: A word that makes a row even where no family is met.
CUE = r"^(?:licen[sc]|lizen|copyright|permission|warrant|redistribut|l?a?gplv?[0-9]?$|gnu$|apache|bsd$|cc0|mpl$|mozilla$|epl$|eupl$|zlib|spdx)"
#: The same as a test of a whole text, and the names that are words elsewhere.
CUES = r"(?i)licen[sc]|lizen|copyright|permission|warrant|redistribut|public\x20domain|creative\x20commons|\bl?a?gplv?[0-9]?\b|\bgnu\b|\bcc[\x20-]by\b|\bcc0\b|\bapache\b|\bbsd\b|\bmpl\b|mozilla|\be(?:u)?pl\b|\bzlib\b|spdx|(?-i:\bMIT\b)"
#: 2-grams with such a word tell nothing.
# Pairs of words that deny what follows, or what stands before them.
DENIALS_BEFORE = (
    "do not", "does not", "did not", "is not", "are not", "was not", "were not", "will not", "can not", "cannot be", "must not", "should not", "don t", "doesn t", "didn t", "isn t", "aren t", "wasn t", "weren t", "won t",
    "no longer", "never under", "never used", "not under", "not licensed", "not released", "not the", "not available", "not covered", "rather than", "instead of", "nicht unter", "nicht mehr", "ist nicht", "sind nicht", "n est", "ne sont", "no es",
)
DENIALS_AFTER = ("not apply", "no longer", "not used", "not cover", "not chosen", "not permitted", "gilt nicht")
#: A version behind the word before it, and one inside a word.
VERSION = r"^(?:version|versión|v|licen[sc]e|lizenz|licencia|[al]?gpl|apache|apache-lizenz|mpl|epl|eupl|bsl|by(?:-nc|-sa|-nd)*|attribution(?:-[a-z]+)*)\x20v?([0-9]+(?:\.[0-9]+)*)$"
NAMED_VERSION = r"^(?:[al]?gpl|apache|mpl|epl|eupl|bsl|cc-by(?:-nc|-sa|-nd)*)-?v?([0-9]+(?:\.[0-9]+)*)(?:-only|-or-later)?$"
#: Sentences end here; "v. 2" goes on.
_SENTENCE_END = r"(?<!\b[vV])[.!?;:][\x20\t]+"
COMMON = set("a an and at der for from in is la of on or that the this to was with".split())

_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_BLANK_LINES = r"\n[\x20\t\x0B\f\r]*(?=\n)"


def words_of(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def training_texts(held_out: bool) -> list[tuple[str, str]]:
    """(family, text); held_out: those that are not fitted but calibrate."""
    half = slice(1, None, 2) if held_out else slice(0, None, 2)
    leads = LEADS[len(LEADS) // 2 :] if held_out else LEADS[: len(LEADS) // 2]
    texts = [(family, lead.format(name)) for family, names in NAMES.items() for name in names for lead in leads]
    texts += [(UNKNOWN, text) for text in COUNTER_EXAMPLES[half]] + [(UNKNOWN, lead.format(name)) for name in OTHER_NAMES[half] for lead in leads]
    if not held_out:
        texts += [(family, piece) for family, notices in NOTICES.items() for notice in notices for piece in pieces(notice)]
        texts += [(family, f"SPDX-License-Identifier: {name}") for family, names in SPDX.items() for name in names]
    return texts


def templates() -> dict[str, list[str]]:
    """What a window is compared with: each family's notices, and its names after every lead-in."""
    return {family: [*NOTICES.get(family, []), *(lead.format(name) for name in names for lead in LEADS), *(f"SPDX-License-Identifier: {name}" for name in SPDX[family])] for family, names in NAMES.items()}


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def families_of_grams() -> dict[str, set[str]]:
    """The families whose templates have an n-gram."""
    found: dict[str, set[str]] = {}
    for family, texts in templates().items():
        for text in texts:
            for gram in grams_of(words_of(text)):
                found.setdefault(gram, set()).add(family)
    return found


def telling_pairs() -> list[str]:
    return sorted(g for g, families in families_of_grams().items() if " " in g and len(families) <= TELLING and not COMMON & set(g.split()))


def stated_versions(words: list[str]) -> list[str]:
    """The versions that words state, "2.0" as "2"."""
    found = [m for a, b in zip(words, [*words[1:], ""]) if (m := re.search(VERSION, f"{a} {b}") or re.search(NAMED_VERSION, a))]
    return [re.sub(r"(?:\.0)+$", "", m[1]) for m in found]


def versions_of_families() -> dict[str, list[str]]:
    """The versions in each family's templates; a family without any has every version."""
    return {family: sorted({v for text in texts for v in stated_versions(words_of(text))}) for family, texts in templates().items()}


def pieces(text: str) -> list[str]:
    """A notice whole, and in overlapping pieces as windows show it."""
    words, (size, _) = text.split(), WINDOWS[-1]
    cut = (" ".join(words[k : k + size]) for k in range(0, max(1, len(words) - size // 2), size // 2))
    return list(dict.fromkeys([text, *(c for c in cut if len(words) > size)]))


def ngrams(words: Column) -> Column:
    """Distinct 1-grams and 2-grams of an array of words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.array_compact(F.concat(words, pairs)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def paragraphs(docs: DataFrame) -> DataFrame:
    """row, doc_id, first_line and paragraph of every paragraph that has a telling 2-gram or a cue."""
    telling = telling_pairs()
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    # a blank line goes with the paragraph before it, so lines are counted by line feeds; their running sum is
    # made once for a text, and a paragraph's row has no more of the text than the paragraph
    def numbered(parts: Column) -> Column:
        lines = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + 1)
        return F.zip_with(parts, running(F.concat(F.array(F.lit(0)), lines)), lambda p, line: F.struct(p.alias("paragraph"), line.alias("first_line")))

    cut = rows.select("row", "doc_id", F.posexplode(let(F.split("text", _BLANK_LINES), numbered)).alias("par", "x")).select("row", "doc_id", "par", "x.paragraph", F.col("x.first_line").cast("long").alias("first_line")).filter("paragraph IS NOT NULL")

    def told(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.exists(pairs, lambda p: F.coalesce(p.isin(telling), F.lit(False)))

    kept = cut.filter(F.col("paragraph").rlike(CUES) | let(tokens(F.col("paragraph")), told))
    return kept.select("row", "doc_id", "par", "first_line", "paragraph")


def windows(paragraph: Column) -> Column:
    """Array of struct(place, size, line, words, versions, denied): the windows around telling 2-grams and cue words,
    each with its place among the paragraph's words, that place's line, the versions stated in it or shortly after
    it (joined by commas), and whether it has telling 2-grams that are all denied."""
    telling = telling_pairs()

    def sentences(line: Column, k: Column) -> Column:
        """A line's words; all but its first sentence begin anew."""
        return F.flatten(F.transform(F.split(line, _SENTENCE_END), lambda part, j: F.transform(tokens(part), lambda w, at: F.struct(w.alias("w"), k.alias("line"), ((j > 0) & (at == 0)).alias("starts")))))

    placed = F.flatten(F.transform(F.split(paragraph, "\n"), sentences))

    def pair(words: Column, k: Column) -> Column:
        return F.concat(F.get(words, k)["w"], F.lit(" "), F.get(words, k + 1)["w"])

    def read(words: Column) -> Column:
        """The words with what is known at each: whether a telling 2-gram begins, is denied, and the version stated."""

        def of_word(x: Column, k: Column) -> Column:
            here = pair(words, k)
            name = F.coalesce(here.isin(telling), F.lit(False))

            def denies(d: Column, first: Column, last: Column, pairs: tuple[str, ...]) -> Column:
                cut = F.exists(F.slice(words, first + 2, F.greatest(last - first, F.lit(0))), lambda y: y["starts"])
                return F.coalesce(pair(words, d).isin(*pairs), F.lit(False)) & ~cut

            before = F.exists(F.sequence(F.greatest(k - DENIED_BEFORE, F.lit(0)), k), lambda d: denies(d, d, k, DENIALS_BEFORE))
            after = F.exists(F.sequence(k + 1, k + DENIED_AFTER), lambda d: denies(d, k, d, DENIALS_AFTER))
            said = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(here, F.lit("")), VERSION, 1), F.lit("")), F.regexp_extract(x["w"], NAMED_VERSION, 1))
            return F.struct(x["w"].alias("w"), x["line"].alias("line"), name.alias("name"), F.when(name, before | after).otherwise(False).alias("denied"), F.regexp_replace(said, r"(?:\.0)+$", "").alias("version"))

        return F.transform(words, of_word)

    def around(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: F.get(words, k)["name"] | F.get(words, k)["w"].rlike(CUE))

        def laid(size: int, before: int) -> Column:
            def window(k: Column) -> Column:
                start = F.greatest(k - before, F.lit(0))
                shown = F.slice(words, start + 1, F.lit(size))
                names = F.filter(shown, lambda x: x["name"])
                versions = F.filter(F.transform(F.slice(words, start + 1, F.lit(size + VERSION_AFTER)), lambda x: x["version"]), lambda v: v != "")
                denied = (F.size(names) > 0) & F.forall(names, lambda x: x["denied"])
                return F.struct(k.alias("place"), F.lit(size).alias("size"), F.get(words, k)["line"].alias("line"), F.transform(shown, lambda x: x["w"]).alias("words"), F.array_join(versions, ",").alias("versions"), denied.alias("denied"))

            return F.transform(places, window)

        return F.concat(*(laid(*shape) for shape in WINDOWS))

    none = F.array().cast("array<struct<place:int,size:int,line:int,words:array<string>,versions:string,denied:boolean>>")
    return let(placed, lambda words: F.when(F.size(words) > 0, let(read(words), around)).otherwise(none))


class Families:
    """The fitted classifier: weights (gram, weights of each class, of_family: 0 or 1 for each class whether its
    templates have the gram, telling), the classes with intercepts, the temperature and the cut."""

    def __init__(self, spark: SparkSession, regularisation: float = 0.002):
        self.classes = [UNKNOWN, *sorted(NAMES)]
        fitted = [(float(self.classes.index(f)), words_of(t)) for f, t in training_texts(False)]
        examples = spark.createDataFrame(fitted, "label double, words array<string>").coalesce(1).withColumn("grams", ngrams(F.col("words")))
        vectorizer = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0).fit(examples)
        model = LogisticRegression(family="multinomial", regParam=regularisation, maxIter=60).fit(vectorizer.transform(examples))
        matrix, known, telling = model.coefficientMatrix.toArray(), families_of_grams(), set(telling_pairs())
        of_gram = dict(zip(vectorizer.vocabulary, matrix.T.tolist()))
        none = [0.0] * len(self.classes)
        rows = [(g, of_gram.get(g, none), [int(c in known.get(g, ())) for c in self.classes], int(g in telling)) for g in sorted(set(of_gram) | set(known))]
        self.weights = spark.createDataFrame(rows, "gram string, weights array<double>, of_family array<int>, telling int").coalesce(1)
        self.intercepts = model.interceptVector.toArray().tolist()
        # the held-out texts are fixed and few: their class sums fit the temperature here
        held = []
        for family, text in training_texts(True):
            sums = list(self.intercepts)
            for g in grams_of(words_of(text)):
                sums = [a + b for a, b in zip(sums, of_gram.get(g, none))]
            held.append((self.classes.index(family), sums))
        self.temperature = min((0.5 + k / 4 for k in range(19)), key=lambda t: sum(-math.log(max(_softmax(sums, t)[k], 1e-12)) for k, sums in held))
        self.cut = max([0.5, *(max(_softmax(sums, self.temperature)[1:]) for k, sums in held if k == 0)])


def _softmax(sums: list[float], temperature: float) -> list[float]:
    top = max(sums)
    e = [math.exp((x - top) / temperature) for x in sums]
    return [x / sum(e) for x in e]


def _total(arrays: Column, n: int, kind: str) -> Column:
    return F.array(*(F.coalesce(F.sum(F.get(arrays, F.lit(k))), F.lit(0).cast(kind)) for k in range(n)))


def judged_windows(seen: DataFrame, keys: list[str], model: Families) -> DataFrame:
    """keys, family (the likeliest that is not unknown), probability, similarity (the share of the distinct
    n-grams that the family's templates have) and confirmed, of every window (keys, words, versions, denied);
    versions and denied are among the keys."""
    n = len(model.classes)
    grams = seen.select(*keys, F.explode(ngrams(F.col("words"))).alias("gram"))
    met = grams.join(F.broadcast(model.weights), "gram", "left")  # as many rows as the training texts have n-grams
    summed = met.groupBy(*keys).agg(F.count("*").alias("n"), _total(F.col("weights"), n, "double").alias("sums"), _total(F.col("of_family"), n, "long").alias("shared"), _total(F.transform("of_family", lambda x: x * F.col("telling")), n, "long").alias("telling"))
    scaled = summed.withColumn("s", F.zip_with("sums", F.array(*map(F.lit, model.intercepts)), lambda a, b: (a + b) / model.temperature))
    top = scaled.withColumn("e", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    picked = top.withColumn("best", F.array_max(F.array(*(F.struct(F.get("s", F.lit(k)).alias("s"), F.lit(name).alias("family"), F.get("shared", F.lit(k)).alias("shared"), F.get("telling", F.lit(k)).alias("telling"), (F.get("e", F.lit(k)) / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("probability")) for k, name in enumerate(model.classes) if k))))
    closest = F.array_max("shared") == F.col("best.shared")
    similarity = F.col("best.shared") / F.col("n")
    stated = F.split("versions", ",")
    other = F.lit(False)
    for family, versions in versions_of_families().items():
        if versions:
            other = other | ((F.col("best.family") == family) & (F.col("versions") != "") & ~F.arrays_overlap(stated, F.array(*map(F.lit, versions))))
    confirmed = ~F.col("denied") & ~other & (F.col("best.probability") > model.cut) & (similarity >= MIN_SIMILARITY) & closest & (F.col("best.telling") > 0)
    return picked.select(*keys, "best.family", "best.probability", similarity.alias("similarity"), confirmed.alias("confirmed"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), family, probability, similarity and confirmed.

    A row for each family that a paragraph's confirmed windows name, with its best window: the line,
    probability and similarity of that. A paragraph that only has a cue or a telling 2-gram gives one
    row of the family "unknown" with its likeliest window. Null and empty texts give no rows;
    repeated rows are listed each; a null doc_id stays null; an empty table gives no rows; other
    columns are ignored.
    """
    model = Families(docs.sparkSession)
    paragraph = ["row", "doc_id", "par", "first_line"]
    keys = [*paragraph, "place", "size", "line", "versions", "denied"]
    # outer, as Spark else computes the windows once more to leave out rows without any
    seen = paragraphs(docs).select(*paragraph, F.explode_outer(windows(F.col("paragraph"))).alias("x")).select(*paragraph, "x.*").filter("words IS NOT NULL")
    judged = judged_windows(seen, keys, model)
    of_place = judged.groupBy(*paragraph, "place").agg(F.max_by(F.struct("family", "probability", "similarity", "confirmed", "line"), F.struct("confirmed", "size")).alias("x")).select(*paragraph, "place", "x.*")
    family = F.when(F.col("confirmed"), F.col("family")).otherwise(UNKNOWN)
    best = F.max(F.struct("probability", "similarity", (-F.col("place")).alias("place"), "line")).alias("best")
    named = of_place.groupBy(*paragraph, family.alias("family"), "confirmed").agg(F.sum("probability").alias("evidence"), best)
    by_paragraph = named.groupBy(*paragraph).agg(F.max(F.when(F.col("confirmed"), F.col("evidence"))).alias("most"), F.collect_list(F.struct("family", "confirmed", "evidence", "best")).alias("found"))
    listed = F.filter("found", lambda x: F.when(F.col("most").isNull(), F.lit(True)).otherwise(x["confirmed"] & (x["evidence"] >= 0.5 * F.col("most"))))
    rows = by_paragraph.select("doc_id", "first_line", F.explode(listed).alias("x"))
    return rows.select("doc_id", (F.col("first_line") + F.col("x.best.line")).alias("line"), "x.family", "x.best.probability", "x.best.similarity", "x.confirmed")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES: dict[str, str] = {}
