"""Licence scan: known licence sentences become identifiers, sequences of identifiers match ordered rules.

Only built-in column functions run on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import materialize

# Wording of public licence texts, in lower case, without punctuation. Sentences with one identifier mean the same.
SENTENCES = {
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "the mit license": "MitTitle",
    "mit license": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "licensed under the apache license version 2 0": "Apache2Ref",
    "licensed under the apache license version 2 0 the license": "Apache2Ref",
    "released under the apache license version 2 0": "Apache2Ref",
    "this work is licensed under the apache license version 2 0": "Apache2Ref",
    "you may not use this file except in compliance with the license": "Apache2Comply",
    "you may obtain a copy of the license at": "Apache2Copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "Apache2Copy",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "released under the gnu general public license version 3": "Gpl3Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplNoWarranty",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "licensed under the gnu lesser general public license version 2 1": "Lgpl21Ref",
    "licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Ref",
    "licensed under the mozilla public license version 2 0": "Mpl2Ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under the bsd 2 clause license": "Bsd2Ref",
    "licensed under the bsd 3 clause license": "Bsd3Ref",
    "licensed under cc by 4 0": "CcBy4Ref",
    "licensed under cc by sa 4 0": "CcBySa4Ref",
    "licensed under cc by nc 4 0": "CcByNc4Ref",
    "licensed under cc by nc sa 4 0": "CcByNcSa4Ref",
    "licensed under cc by nd 4 0": "CcByNd4Ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4Ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySa4Ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNc4Ref",
    "this work has been dedicated to the public domain under cc0 1 0": "Cc0Ref",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "all rights reserved": "Reserved",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdWarranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdLiability",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2Warranty",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2See",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscWarranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "IscLiability",
    "this software is provided as is without any express or implied warranty": "ZlibWarranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21Later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplNoWarranty",
    "see the gnu lesser general public license for more details": "LgplSee",
    "you should have received a copy of the gnu lesser general public license along with this library": "LgplCopy",
    "you should have received a copy of the gnu lesser general public license along with this program": "LgplCopy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Later",
    "see the gnu affero general public license for more details": "AgplSee",
    "you should have received a copy of the gnu affero general public license along with this program": "AgplCopy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "Mpl2Copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "Mpl2Copy",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseUse",
}

# SPDX short names of licences, their identifier, and what running text calls them.
NAMES = [
    ("MIT", "MitRef", ["the mit license", "the expat license"]),
    ("Apache-2.0", "Apache2Ref", ["the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license"]),
    ("GPL-3.0-only", "Gpl3Ref", ["the gnu general public license version 3", "the gnu general public license v3 0", "the gnu gpl version 3", "the gnu gplv3"]),
    ("GPL-2.0-only", "Gpl2Ref", ["the gnu general public license version 2", "the gnu general public license v2 0", "the gnu gpl version 2", "the gnu gplv2"]),
    ("LGPL-3.0-only", "Lgpl3Ref", ["the gnu lesser general public license version 3", "the gnu lgpl version 3"]),
    ("LGPL-2.1-only", "Lgpl21Ref", ["the gnu lesser general public license version 2 1", "the gnu lgpl version 2 1"]),
    ("AGPL-3.0-only", "Agpl3Ref", ["the gnu affero general public license version 3", "the gnu agpl version 3"]),
    ("MPL-2.0", "Mpl2Ref", ["the mozilla public license version 2 0", "the mozilla public license 2 0"]),
    ("BSD-2-Clause", "Bsd2Ref", ["the bsd 2 clause license", "the 2 clause bsd license"]),
    ("BSD-3-Clause", "Bsd3Ref", ["the bsd 3 clause license", "the 3 clause bsd license"]),
    ("ISC", "IscRef", ["the isc license"]),
    ("Zlib", "ZlibRef", ["the zlib license"]),
    ("BSL-1.0", "BoostRef", ["the boost software license version 1 0"]),
    ("EPL-2.0", "Epl2Ref", ["the eclipse public license version 2 0", "the eclipse public license v2 0"]),
    ("Unlicense", "UnlicenseGrant", ["the unlicense"]),
    ("CC0-1.0", "Cc0Ref", ["cc0 1 0"]),
    ("CC-BY-4.0", "CcBy4Ref", ["cc by 4 0"]),
    ("CC-BY-SA-4.0", "CcBySa4Ref", ["cc by sa 4 0"]),
    ("CC-BY-NC-4.0", "CcByNc4Ref", ["cc by nc 4 0"]),
    ("CC-BY-NC-SA-4.0", "CcByNcSa4Ref", ["cc by nc sa 4 0"]),
    ("CC-BY-ND-4.0", "CcByNd4Ref", ["cc by nd 4 0"]),
    ("GPL-3.0-or-later", "Gpl3Later", []),
    ("GPL-2.0-or-later", "Gpl2Later", []),
    ("LGPL-3.0-or-later", "Lgpl3Later", []),
    ("LGPL-2.1-or-later", "Lgpl21Later", []),
    ("AGPL-3.0-or-later", "Agpl3Later", []),
]
WORK = ["", "this project is ", "this software is ", "this library is ", "this program is ", "this file is ", "this code is ", "this work is "]
VERBS = ["licensed under ", "released under ", "distributed under "]
# The sentences that refer to a licence follow a rule: what is licensed, how, and the licence's name; and a line for tools.
REFERENCES = {work + verb + called: name for _, name, every in NAMES for called in every for work in WORK for verb in VERBS}
LINES = {"spdx license identifier " + short.lower().replace("-", " ").replace(".", " "): name for short, name, _ in NAMES}
SENTENCES |= REFERENCES | LINES

# As RULES, and tried before them: whole notices with their disclaimers, and licences without an older rule.
NOTICES = [
    ("MIT", ["MitTitle", "MitGrant", "MitNotice", "MitWarranty", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "MitWarranty", "MitLiability"]),
    ("Apache-2.0", ["Apache2Ref", "Apache2Comply", "Apache2Copy", "Apache2Warranty", "Apache2See"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdWarranty", "BsdLiability"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdWarranty", "BsdLiability"]),
    ("ISC", ["IscGrant", "IscWarranty", "IscLiability"]),
    ("ISC", ["IscGrant"]),
    ("ISC", ["IscRef"]),
    ("Zlib", ["ZlibWarranty", "ZlibLiability", "ZlibGrant"]),
    ("Zlib", ["ZlibGrant"]),
    ("Zlib", ["ZlibRef"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostRef"]),
    ("EPL-2.0", ["Epl2Ref"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later", "GplNoWarranty", "LgplSee", "LgplCopy"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later", "GplNoWarranty", "LgplSee", "LgplCopy"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later"]),
    ("AGPL-3.0-or-later", ["Agpl3Later", "GplNoWarranty", "AgplSee", "AgplCopy"]),
    ("AGPL-3.0-or-later", ["Agpl3Later"]),
    ("MPL-2.0", ["Mpl2Ref", "Mpl2Copy"]),
    ("Unlicense", ["UnlicenseGrant", "UnlicenseUse"]),
]

# Licence and the identifiers that follow one another for it. The first rule that matches takes
# its identifiers away from the later ones; the longer of two comes first.
RULES = [
    ("MIT", ["MitTitle", "MitGrant", "MitNotice"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitRef"]),
    ("Apache-2.0", ["Apache2Ref", "Apache2Comply", "Apache2Copy"]),
    ("Apache-2.0", ["Apache2Ref"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GplNoWarranty", "GplSee", "GplCopy"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-3.0", ["Gpl3Ref"]),
    ("GPL-2.0-or-later", ["Gpl2Later", "GplNoWarranty", "GplSee", "GplCopy"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("GPL-2.0", ["Gpl2Ref"]),
    ("LGPL-3.0", ["Lgpl3Ref"]),
    ("LGPL-2.1", ["Lgpl21Ref"]),
    ("AGPL-3.0", ["Agpl3Ref"]),
    ("MPL-2.0", ["Mpl2Ref"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["Bsd3Ref"]),
    ("BSD-2-Clause", ["Bsd2Ref"]),
    ("CC-BY-4.0", ["CcBy4Ref"]),
    ("CC-BY-SA-4.0", ["CcBySa4Ref"]),
    ("CC-BY-NC-4.0", ["CcByNc4Ref"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa4Ref"]),
    ("CC-BY-ND-4.0", ["CcByNd4Ref"]),
    ("CC0-1.0", ["Cc0Ref"]),
    ("Unlicense", ["UnlicenseGrant"]),
    ("MIT", ["MitTitle"]),
    ("Proprietary", ["Reserved"]),
]

#: A piece ends at a line break, or after a stop, colon or semicolon with a blank behind it; "2.0" holds together.
SENTENCE_END = r"[.;:!?]+[ \t]+|[.;:!?]*[\r\n]+"
#: A run of other characters than a-z and 0-9 counts as one blank.
FILLER = "[^a-z0-9]+"
#: Words that lead a comment line; other leaders are FILLER.
LEADER = r"(^|[\r\n])[ \t@]*+(?:dnl|rem|c)(?![^ \t\r\n])"
#: A list number in brackets at the beginning of a line, which is a piece of its own as "1." is; "(c)" is a copyright sign.
BRACKETED = r"((?:^|[\r\n])[^a-z0-9\r\n]*+(?!(?<=\()c\))[0-9a-z]{1,3}\))[ \t]+"
#: A piece that is more than a list number.
WORDS = r"\n(?!(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})(?:\n|\z))[^\n]"


def pieces(text: Column) -> Column:
    """The text in lower case, only words: one blank between them, a line break before and after each piece."""
    lines = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), LEADER, "$1")
    lines = F.regexp_replace(F.regexp_replace(lines, BRACKETED, "$1\n"), SENTENCE_END, "\n")
    words = F.regexp_replace(F.concat(F.lit("\n"), lines, F.lit("\n")), "[^a-z0-9\n]+", " ")
    return F.regexp_replace(words, " ?\n[ \n]*", "\n")


def known_pattern() -> str:
    """A pattern for all SENTENCES, the longest first; those of the rule as its parts, so that a piece is tried a few times only."""
    either = lambda parts: "(?:" + "|".join(sorted(filter(None, parts), key=len, reverse=True)) + ")"
    whole = [s for s in SENTENCES if s not in REFERENCES and s not in LINES]
    references = f"{either(WORK)}?{either(VERBS)}{either({called for _, _, every in NAMES for called in every})}"
    return "|".join([*sorted(whole, key=len, reverse=True), references, either(LINES)]).replace(" ", "[ \n]")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, each between commas; others are a ``?``.

    A known sentence begins and ends with a piece and may run over several: lines that are wrapped, and stops,
    colons and semicolons inside it. The longest one counts. List numbers between sentences are left out.
    Runs of ``?`` are one, so a long text without licences is a single mark.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    parts = F.split(F.regexp_replace(pieces(text), rf"\n({known_pattern()})(?=\n)", "\t=$1\t"), "\t")
    ids = F.transform(
        parts,
        lambda s: F.when(s.startswith("="), F.element_at(known, F.translate(F.substring(s, 2, 1 << 30), "\n", " ")))
        .when(s.rlike(WORDS), F.lit("?"))
        .otherwise(F.lit("")),
    )
    ids = F.filter(ids, lambda s: s != "")
    return F.regexp_replace(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")), r"(,\?)+", ",?")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses, unmatched) of every row of ``docs`` (doc_id, text).

    sentence_ids has the known sentences in order, joined by commas; licenses the licences whose rules match,
    in the order of the rules, joined by commas; unmatched the known sentences that no rule took, in order.
    A rule's sentences must follow one another; it takes every such run. Null and empty texts, and texts
    without a known sentence, have empty strings. Repeated rows come back alike; an empty table gives an
    empty table; other columns are ignored.
    """
    # Written once: an expression that is used several times would split every text as often.
    rows = materialize(docs.select("doc_id", sentence_ids(F.col("text")).alias("_left")), "sentences")
    rows = rows.withColumn("sentence_ids", _known(F.col("_left")))
    rows = materialize(
        rows.select("doc_id", "sentence_ids", F.when(F.col("sentence_ids") != "", _match(F.col("_left"))).alias("_match")),
        "licences",
    )
    return rows.select(
        "doc_id",
        "sentence_ids",
        F.coalesce(F.array_join(F.array_distinct("_match.found"), ","), F.lit("")).alias("licenses"),
        F.coalesce(_known(F.col("_match.left")), F.lit("")).alias("unmatched"),
    )


def _known(sequence: Column) -> Column:
    return F.array_join(F.filter(F.split(sequence, ","), lambda name: ~name.isin("", "?", "!")), ",")


def _match(sequence: Column) -> Column:
    """Fold the rules over the sequence: a match leaves a ``!`` in its place and adds its licence."""
    rules = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(ids) + ",").alias("ids")) for name, ids in [*NOTICES, *RULES]]
    )
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(
        rules,
        start,
        lambda state, rule: F.when(
            F.instr(state["left"], rule["ids"]) > 0,
            F.struct(
                F.replace(state["left"], rule["ids"], F.lit(",!,")).alias("left"),
                F.concat(state["found"], F.array(rule["name"])).alias("found"),
            ),
        ).otherwise(state),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + value.replace("'", "''") + "'" for value in values) + "]"


def oracle() -> str:
    """DuckDB SQL for the rows of scan(documents)."""
    steps, previous = [], "ids"
    for i, (name, ids) in enumerate([*NOTICES, *RULES]):
        rule = "," + ",".join(ids) + ","
        steps.append(
            f"r{i} AS (SELECT doc_id, names, replace(seq, '{rule}', ',!,') AS seq,"
            f" CASE WHEN contains(seq, '{rule}') THEN list_append(found, '{name}') ELSE found END AS found FROM {previous})"
        )
        previous = f"r{i}"
    known = "lambda x: x NOT IN ('', '?', '!')"
    return rf"""
WITH pieces AS (
    SELECT doc_id, list_filter(list_transform(
        regexp_split_to_array(coalesce(text, ''), '{SENTENCE_END}'),
        lambda s: CASE WHEN length(s) <= {2 * max(map(len, SENTENCES))}
            THEN trim(regexp_replace(lower(s), '{FILLER}', ' ', 'g')) ELSE '?' END), lambda s: s <> '') AS p
    FROM documents
), named AS (
    SELECT doc_id, list_transform(p, lambda s: coalesce(
        map({_sql_list(list(SENTENCES))}, {_sql_list(list(SENTENCES.values()))})[s], '?')) AS n FROM pieces
), ids AS (
    SELECT doc_id, array_to_string(list_filter(n, {known}), ',') AS names,
        regexp_replace(',' || array_to_string(n, ',') || ',', '(,\?)+', ',?', 'g') AS seq, CAST([] AS VARCHAR[]) AS found
    FROM named
), {', '.join(steps)}
SELECT doc_id, names AS sentence_ids,
    array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS licenses,
    array_to_string(list_filter(string_split(seq, ','), {known}), ',') AS unmatched
FROM {previous}
"""
