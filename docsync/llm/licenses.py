"""Licence scan by sentence rules.

1. A text loses comment marks and is cut into sentences: at ends of sentences, at blank lines,
   and before lines that begin as a licence sentence does; other line ends are only white space.
2. A sentence in normal form (lower case, runs of other than letters and digits as one space) is
   looked up among the known licence sentences and becomes an identifier.
3. Ordered rules, longest and most specific first, are matched against the sequence of a text's
   identifiers. A match names a licence and uses its identifiers up.

All of it is built-in functions on one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A text without any of these holds no known sentence.
CUE = "licen[cs]e|copyright|spdx|permission|redistribut|warrant|free software|public domain|rights reserved|unlicense"
COMMENT_MARK = r"(?m)^[ \t]*(//+|/\*+|\*+/|\*+|#+|;+|--+|<!--|%+)[ \t]*"
# Beginnings of licence sentences; a line that begins so starts a sentence.
STARTS = (
    "licensed under|released under|this work is|this work has|this file is|this software is|"
    "this program is|this library is|permission is|permission to|redistribution|redistributions|neither the name|the above copyright|"
    "the software is|in no event|spdx-license-identifier|copyright|all rights|unless required|you may obtain|you may not|"
    "you should have|you can redistribute|see the license|see the gnu"
)

# Known sentences in normal form: identifier and pattern of the whole sentence.
# Wordings and names of public licences.
SENTENCES = [
    ("ApacheGrant", "licensed under the apache license version 2 0( the license)?"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at( https? www apache org licenses license 2 0)?"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MITName", "(this (work|file|software|project) is )?(released|licensed|distributed|available) under the( terms of the)? mit license"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("MITLiability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability .*"),
    ("ISCGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSDConditions", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDSource", "(1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDBinary", "(2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSDNames", "(3 )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDAsIs", "this software is provided by the .* as is and any express or implied warranties .* are disclaimed"),
    ("GPLFree", "this (program|library|file|software) is free software"),
    ("GPL2Later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL3Later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("LGPL21Later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("AGPL3Later", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPLHope", "this (program|library|file) is distributed in the hope that it will be useful but without any warranty"),
    ("GPLFitness", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPL2Name", "(this (work|file|software|program) is )?(released|licensed|distributed) under the( terms of the)? gnu general public license version 2( 0)?( only)?"),
    ("GPL3Name", "(this (work|file|software|program) is )?(released|licensed|distributed) under the( terms of the)? gnu general public license version 3( 0)?( only)?"),
    ("CCBYName", "(this work is )?licensed under (a )?(cc|creative commons) (by|attribution) 4 0( international)?( license)?"),
    ("CCBYSAName", "(this work is )?licensed under (a )?(cc|creative commons) (by sa|attribution sharealike) 4 0( international)?( license)?"),
    ("CCBYNCName", "(this work is )?licensed under (a )?(cc|creative commons) (by nc|attribution noncommercial) 4 0( international)?( license)?"),
    ("CCBYNCSAName", "(this work is )?licensed under (a )?(cc|creative commons) (by nc sa|attribution noncommercial sharealike) 4 0( international)?( license)?"),
    ("CCBYNDName", "(this work is )?licensed under (a )?(cc|creative commons) (by nd|attribution noderivatives) 4 0( international)?( license)?"),
    ("CC0Name", "(this work is )?(released|licensed) under (the )?cc0( 1 0)?( universal)?( license)?"),
    ("PublicDomain", "this (work|file|software) (is|has been) (released |placed )?(in|into|to) the public domain"),
    ("MPL2Subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("SpdxApache2", "spdx license identifier apache 2 0"),
    ("SpdxMIT", "spdx license identifier mit"),
    ("SpdxBSD3", "spdx license identifier bsd 3 clause"),
    ("SpdxGPL3", "spdx license identifier gpl 3 0( only| or later)?"),
    ("SpdxGPL2", "spdx license identifier gpl 2 0( only| or later)?"),
    ("AllRights", "(copyright .* )?all rights reserved"),
]

# Ordered rules: licence and its sequence of identifiers.
RULES = [
    ("Apache-2.0", ["ApacheGrant", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("MIT", ["MITGrant", "MITNotice", "MITAsIs", "MITLiability"]),
    ("MIT", ["MITGrant", "MITNotice", "MITAsIs"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("BSD-3-Clause", ["BSDConditions", "BSDSource", "BSDBinary", "BSDNames", "BSDAsIs"]),
    ("BSD-2-Clause", ["BSDConditions", "BSDSource", "BSDBinary", "BSDAsIs"]),
    ("ISC", ["ISCGrant"]),
    ("GPL-2.0-or-later", ["GPLFree", "GPL2Later", "GPLHope", "GPLFitness"]),
    ("GPL-3.0-or-later", ["GPLFree", "GPL3Later", "GPLHope", "GPLFitness"]),
    ("LGPL-2.1-or-later", ["GPLFree", "LGPL21Later", "GPLHope", "GPLFitness"]),
    ("AGPL-3.0-or-later", ["GPLFree", "AGPL3Later", "GPLHope", "GPLFitness"]),
    ("GPL-2.0-or-later", ["GPLFree", "GPL2Later"]),
    ("GPL-3.0-or-later", ["GPLFree", "GPL3Later"]),
    ("LGPL-2.1-or-later", ["GPLFree", "LGPL21Later"]),
    ("AGPL-3.0-or-later", ["GPLFree", "AGPL3Later"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheUse", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheGrant"]),
    ("MIT", ["MITName"]),
    ("GPL-2.0", ["GPL2Name"]),
    ("GPL-3.0", ["GPL3Name"]),
    ("CC-BY-4.0", ["CCBYName"]),
    ("CC-BY-SA-4.0", ["CCBYSAName"]),
    ("CC-BY-NC-4.0", ["CCBYNCName"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSAName"]),
    ("CC-BY-ND-4.0", ["CCBYNDName"]),
    ("CC0-1.0", ["CC0Name"]),
    ("public domain", ["PublicDomain"]),
    ("MPL-2.0", ["MPL2Subject"]),
    ("Apache-2.0", ["SpdxApache2"]),
    ("MIT", ["SpdxMIT"]),
    ("BSD-3-Clause", ["SpdxBSD3"]),
    ("GPL-3.0", ["SpdxGPL3"]),
    ("GPL-2.0", ["SpdxGPL2"]),
    ("all rights reserved", ["AllRights"]),
]
# How a break between sentences is marked while a text is cut.
MARK = "\u0001"
# Regular expression and replacement, {0} for the group, applied in turn.
CUTS = [
    (COMMENT_MARK, ""),
    (r"\r?\n[ \t\r]*\n", MARK),
    (rf"(?i)\n[ \t]*({STARTS})", MARK + "{0}"),
    (r"(?i)(spdx-license-identifier:[ \t]*[^ \t\n]+)", "{0}" + MARK),
    (r"([.!?;])[ \t\r\n]+", "{0}" + MARK),
    (r"(:)[ \t\r]*\n", "{0}" + MARK),
]

# The registered SQL is made of the tables above. The scan goes further, by these.
# Between words any white space or comment mark.
ANY_CUE = CUE.replace(" ", "[^a-z0-9]+")
# Words that end no sentence; a line after them continues it.
OPEN_ENDS = "a|above|all|and|by|of|or|provided that|reproduce|retain|that|the|to|whom"
ALL_CUTS = [
    *CUTS[:2],
    (rf"(?i)(?<!\b(?:{OPEN_ENDS})[ \t\r]{{0,9}})\n[ \t]*({STARTS})", CUTS[2][1]),
    CUTS[3],
    # Not in "v. 2.0", and not before the version of the GPL-2 and LGPL notices.
    (r"(?i)((?<!\bv)[.!?;])[ \t\r\n]++(?!either version)", CUTS[4][1]),
    CUTS[5],
    (r"(?i)(:)\s+(?=you can redistribute)", "{0}" + MARK),
]
# SPDX identifiers in normal form; ahead of the sentences above, which take -or-later for the bare version.
SPDX = {
    "BSD-2-Clause": ("SpdxBSD2", "bsd 2 clause"), "ISC": ("SpdxISC", "isc"), "MPL-2.0": ("SpdxMPL2", "mpl 2 0"),
    "GPL-2.0-or-later": ("SpdxGPL2Later", "gpl 2 0 or later"), "GPL-3.0-or-later": ("SpdxGPL3Later", "gpl 3 0 or later"),
    "LGPL-2.1-or-later": ("SpdxLGPL21Later", "lgpl 2 1 or later"), "AGPL-3.0-or-later": ("SpdxAGPL3Later", "agpl 3 0 or later"),
    "CC-BY-4.0": ("SpdxCCBY", "cc by 4 0"), "CC-BY-SA-4.0": ("SpdxCCBYSA", "cc by sa 4 0"), "CC-BY-NC-4.0": ("SpdxCCBYNC", "cc by nc 4 0"),
    "CC-BY-NC-SA-4.0": ("SpdxCCBYNCSA", "cc by nc sa 4 0"), "CC-BY-ND-4.0": ("SpdxCCBYND", "cc by nd 4 0"), "CC0-1.0": ("SpdxCC0", "cc0 1 0"),
}
ALL_SENTENCES = [*((name, f"spdx license identifier {x}") for name, x in SPDX.values()), *SENTENCES]
ALL_RULES = [*RULES[:-1], *((licence, [name]) for licence, (name, _) in SPDX.items()), RULES[-1]]


def step(names: list[str]) -> str:
    return "|" + "|".join(names) + "|"


def sentences(text: Column) -> Column:
    """Sentences in normal form."""
    for pattern, by in ALL_CUTS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by.replace("{0}", "$1")))
    parts = F.split(F.translate(text, UPPER, LOWER), MARK)
    return F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def identifier(sentence: Column) -> Column:
    """Identifier of a known sentence, else null."""
    found = None
    for name, pattern in ALL_SENTENCES:
        test = sentence.rlike(f"^({pattern})$")
        found = F.when(test, name) if found is None else found.when(test, name)
    return found


def match_rules(sequence: Column) -> Column:
    """``(rest, names)``: rules applied in order to ``|A|B|...|``, each using its matches up.

    Neighbouring identifiers share a bar; bars are doubled for matching, so that a sequence
    matched twice in a row is found twice.
    """
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(step(s).replace("|", "||")[1:-1]).alias("steps")) for n, s in ALL_RULES])
    start = F.struct(F.replace(sequence, F.lit("|"), F.lit("||")).alias("rest"), F.array().cast("array<string>").alias("names"))
    return F.aggregate(
        rules, start,
        lambda a, r: F.struct(
            F.replace(a["rest"], r["steps"], F.lit("|!|")).alias("rest"),
            F.when(F.contains(a["rest"], r["steps"]), F.array_union(a["names"], F.array(r["name"]))).otherwise(a["names"]).alias("names"),
        ),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, licenses, sentence_ids, unmatched)``, one row per row of ``docs(doc_id, text)``.

    ``licenses``: distinct names in the order of the rules. ``sentence_ids``: known sentences in
    the order of the text, repeated ones too. ``unmatched``: number of those that no rule used.
    A null or empty text has none of them. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cued = F.translate(text, UPPER, LOWER).rlike(ANY_CUE)
    rows = docs.select("doc_id", F.when(cued, text).otherwise(F.lit("")).alias("t"))
    cut = rows.select("doc_id", F.filter(sentences(F.col("t")), lambda s: s.rlike(CUE + "|software|notice|license|liable|version")).alias("s"))
    known = cut.select("doc_id", F.filter(F.transform("s", identifier), lambda x: x.isNotNull()).alias("ids"))
    result = known.withColumn("m", match_rules(F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))))
    left = F.filter(F.split(F.col("m.rest"), r"\|"), lambda x: (x != "") & (x != "!"))
    return result.select("doc_id", F.col("m.names").alias("licenses"), F.col("ids").alias("sentence_ids"), F.size(left).cast("long").alias("unmatched"))


def digest(docs: DataFrame) -> DataFrame:
    """:func:`scan` with its lists as text."""
    return scan(docs).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("sentence_ids").cast("long").alias("n_sentences"), "unmatched",
    )


def oracle() -> str:
    """The scan in SQL, by the tables that it shares with the code; it lacks ``ALL_CUTS``, ``ANY_CUE`` and ``SPDX``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    # E-strings for the mark; patterns have no quote.
    mark = "chr(1)"
    text = "CASE WHEN regexp_matches(translate(coalesce(text, ''), '{u}', '{l}'), {cue}) THEN text ELSE '' END".format(
        u=UPPER, l=LOWER, cue=quote(CUE)
    )
    for pattern, by in CUTS:
        new = " || ".join(mark if p == MARK else quote(p.replace("{0}", "\\1")) for p in by.replace(MARK, f"\0{MARK}\0").split("\0") if p) or "''"
        text = f"regexp_replace({text}, {quote(pattern)}, {new}, 'g')"
    case = " ".join(f"WHEN regexp_full_match(s, {quote(p)}) THEN {quote(n)}" for n, p in SENTENCES)
    lines = [
        f"WITH cut AS (SELECT doc_id, string_split(translate({text}, '{UPPER}', '{LOWER}'), {mark}) AS parts FROM documents),",
        "norm AS (SELECT doc_id, [trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')) for p in parts] AS ss FROM cut),",
        f"ids AS (SELECT doc_id, [x for x in [CASE {case} END for s in ss] if x IS NOT NULL] AS ids FROM norm),",
        "r0 AS (SELECT doc_id, ids, replace('|' || array_to_string(ids, '|') || '|', '|', '||') AS rest, CAST([] AS VARCHAR[]) AS names FROM ids)",
    ]
    for i, (name, steps) in enumerate(RULES):
        pattern = quote(step(steps).replace("|", "||")[1:-1])
        lines.append(
            f", r{i + 1} AS (SELECT doc_id, ids, replace(rest, {pattern}, '|!|') AS rest, CASE WHEN contains(rest, {pattern}) "
            f"AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)}) ELSE names END AS names FROM r{i})"
        )
    lines.append(
        "SELECT doc_id, array_to_string(names, ',') AS licenses, array_to_string(ids, ',') AS sentence_ids, "
        "CAST(len(ids) AS BIGINT) AS n_sentences, "
        f"CAST(len([x for x in string_split(rest, '|') if x <> '' AND x <> '!']) AS BIGINT) AS unmatched FROM r{len(RULES)}"
    )
    return "\n".join(lines)
