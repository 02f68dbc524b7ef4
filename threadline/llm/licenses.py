"""License scans: sentences become identifiers, sequences of identifiers become licences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.title": "the mit license",
    "mit.title-short": "mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2.licensed": "licensed under the apache license version 2 0",
    "apache2.licensed-the-license": "licensed under the apache license version 2 0 the license",
    "apache2.title": "apache license version 2 0",
    "apache2.may-not": "you may not use this file except in compliance with the license",
    "apache2.obtain": "you may obtain a copy of the license at",
    "apache2.url": "http www apache org licenses license 2 0",
    "apache2.unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.licensed": "licensed under the gnu general public license version 3",
    "gpl3.title": "gnu general public license version 3",
    "gpl2.title": "gnu general public license version 2",
    "gpl2.licensed": "licensed under the gnu general public license version 2",
    "gpl.free": "this program is free software",
    "gpl3.redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gnu.either-2": "either version 2 of the license or at your option any later version",
    "gnu.either-2.1": "either version 2 1 of the license or at your option any later version",
    "gnu.either-3": "either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl.implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl.free": "this library is free software",
    "lgpl.redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl3.redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3.redistribute": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3.title": "gnu affero general public license version 3",
    "cc-by.licensed": "licensed under cc by 4 0",
    "cc-by-sa.licensed": "licensed under cc by sa 4 0",
    "cc-by-nc.licensed": "licensed under cc by nc 4 0",
    "cc-by-nd.licensed": "licensed under cc by nd 4 0",
    "cc-by-nc-sa.licensed": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd.licensed": "licensed under cc by nc nd 4 0",
    "cc-by.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc.work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd.work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa.work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd.work": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "cc0.dedicated": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "cc0.waived": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc.as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl2.subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2.obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2.obtain-safely": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2.title": "mozilla public license version 2 0",
    "epl2.available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2.title": "eclipse public license v 2 0",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "unlicense.anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib.as-is": "this software is provided as is without any express or implied warranty",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib.origin": "the origin of this software must not be misrepresented",
    "boost.licensed": "distributed under the boost software license version 1 0",
    "boost.title": "boost software license version 1 0",
    "ofl.licensed": "this font software is licensed under the sil open font license version 1 1",
    "artistic2.title": "the artistic license 2 0",
    "postgresql.grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "domain.placed": "this work has been placed in the public domain",
    "any.rights": "all rights reserved",
}


@dataclass(frozen=True)
class Rule:
    """A licence is found where these sentence identifiers occur in this order, other known sentences between them allowed."""

    license: str
    sentences: tuple[str, ...]


# Licences and the sentence sequences that show them.
RULES = (
    Rule("MIT", ("mit.grant", "mit.notice", "mit.as-is")),
    Rule("MIT", ("mit.grant",)),
    Rule("MIT", ("mit.released",)),
    Rule("MIT", ("mit.licensed",)),
    Rule("MIT", ("mit.title",)),
    Rule("MIT", ("mit.title-short",)),
    Rule("Apache-2.0", ("apache2.licensed-the-license", "apache2.may-not", "apache2.obtain", "apache2.unless")),
    Rule("Apache-2.0", ("apache2.licensed-the-license",)),
    Rule("Apache-2.0", ("apache2.licensed",)),
    Rule("Apache-2.0", ("apache2.title",)),
    Rule("GPL-3.0-or-later", ("gpl3.redistribute", "gpl.hope")),
    Rule("GPL-3.0-or-later", ("gpl3.redistribute",)),
    Rule("GPL-3.0-or-later", ("gpl.redistribute", "gnu.either-3")),
    Rule("GPL-2.0-or-later", ("gpl.redistribute", "gnu.either-2")),
    Rule("GPL-3.0", ("gpl3.work",)),
    Rule("GPL-3.0", ("gpl3.licensed",)),
    Rule("GPL-3.0", ("gpl3.title",)),
    Rule("GPL-2.0", ("gpl2.licensed",)),
    Rule("GPL-2.0", ("gpl2.title",)),
    Rule("LGPL-3.0-or-later", ("lgpl3.redistribute",)),
    Rule("LGPL-3.0-or-later", ("lgpl.redistribute", "gnu.either-3")),
    Rule("LGPL-2.1-or-later", ("lgpl.redistribute", "gnu.either-2.1")),
    Rule("AGPL-3.0-or-later", ("agpl3.redistribute",)),
    Rule("AGPL-3.0", ("agpl3.title",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc.licensed",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc.work",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa.licensed",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa.work",)),
    Rule("CC-BY-4.0", ("cc-by.licensed",)),
    Rule("CC-BY-4.0", ("cc-by.work",)),
    Rule("CC-BY-ND-4.0", ("cc-by-nd.licensed",)),
    Rule("CC-BY-ND-4.0", ("cc-by-nd.work",)),
    Rule("CC-BY-NC-SA-4.0", ("cc-by-nc-sa.licensed",)),
    Rule("CC-BY-NC-SA-4.0", ("cc-by-nc-sa.work",)),
    Rule("CC-BY-NC-ND-4.0", ("cc-by-nc-nd.licensed",)),
    Rule("CC-BY-NC-ND-4.0", ("cc-by-nc-nd.work",)),
    Rule("CC0-1.0", ("cc0.dedicated",)),
    Rule("CC0-1.0", ("cc0.waived",)),
    Rule("BSD-4-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.advertising")),
    Rule("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse")),
    Rule("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary")),
    Rule("ISC", ("isc.grant",)),
    Rule("0BSD", ("0bsd.grant",)),
    Rule("MPL-2.0", ("mpl2.subject", "mpl2.obtain")),
    Rule("MPL-2.0", ("mpl2.subject", "mpl2.obtain-safely")),
    Rule("MPL-2.0", ("mpl2.title",)),
    Rule("EPL-2.0", ("epl2.available",)),
    Rule("EPL-2.0", ("epl2.title",)),
    Rule("Unlicense", ("unlicense.free",)),
    Rule("Zlib", ("zlib.as-is", "zlib.grant")),
    Rule("Zlib", ("zlib.grant", "zlib.origin")),
    Rule("BSL-1.0", ("boost.licensed",)),
    Rule("BSL-1.0", ("boost.title",)),
    Rule("OFL-1.1", ("ofl.licensed",)),
    Rule("Artistic-2.0", ("artistic2.title",)),
    Rule("PostgreSQL", ("postgresql.grant",)),
    Rule("LicenseRef-PublicDomain", ("domain.placed",)),
    Rule("LicenseRef-AllRightsReserved", ("any.rights",)),
)
#: A sentence ends at . ! ? ; : followed by a space, at a line's end before an empty line or a line end after one of these, or at any line's end.
SENTENCE_END = r"[.!?;:]+\s+|[.!?;:]*\n+"
NOISE = r"[^a-z0-9]+"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text: lower case, a space for each run of anything but a-z and 0-9; empty ones are left out."""
    parts = F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(F.lower(s), NOISE, " ")))
    return F.filter(parts, lambda s: s != "")


def _hint(known: dict[str, str]) -> str:
    """A pattern that occurs in the lower-case text of every document with a known sentence: normalising leaves words whole, so one
    word of each sentence will do. Few words of six letters or more that many sentences share, else a sentence's longest word."""
    left = {s: [w for w in s.split() if len(w) >= 6] or [max(s.split(), key=len)] for s in known.values() if s.strip()}
    chosen = []
    while left:
        shared = {w: sum(w in s for s in left) for ws in left.values() for w in ws}
        chosen.append(max(shared, key=lambda w: (shared[w], len(w), w)))
        left = {s: ws for s, ws in left.items() if chosen[-1] not in s}
    return "|".join(r"\Q%s\E" % w for w in chosen) or r"(?!)"


#: Parts whose sums are carried along in one array, which grows by copies.
CARRIED = 256


def _sums_before(sizes: Column) -> Column:
    """For each size the sum of those before it, in time that follows their number: first by blocks, then inside each."""

    def carried(values: Column, start: Column) -> Column:
        state = F.struct(start.cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(values, state, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])

    def of(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("sizes"), carried(totals, F.lit(0)).alias("start")), lambda z: carried(z["sizes"], z["start"])))

    def blocks_of(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CARRIED))
        return F.transform(starts, lambda i: F.slice(values, i + 1, F.lit(CARRIED)))

    bound = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  computed once, not for each element
    return bound(sizes, lambda v: bound(blocks_of(v), of))


def _sorted_once(items: Column) -> Column:
    """The items in order, equal ones once."""
    own = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1) != x))
    return F.element_at(F.transform(F.array(F.array_sort(items)), own), 1)


def scan_licenses(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with sentence_ids (identifiers of the known sentences, in order) and licenses (in the order of the rules).

    A known sentence may also be wrapped over lines: sentences are looked for both line by line and, where lines break inside a
    sentence, over the paragraph. What either finds counts, in the order of the text: by where a sentence begins, then by its
    length; what both find counts once. Time follows a text's length, whatever
    the number of its hits. Null and empty texts have empty lists. Each row is judged by itself, repeated ones too;
    an empty table gives an empty result. Columns named sentence_ids or licenses are replaced, all others pass through.
    """
    docs = docs.drop("sentence_ids", "licenses")
    wanted = F.array(*[F.lit(s) for s in known.values()])
    names = F.array(*[F.lit(k) for k in known])
    place = lambda s: F.array_position(wanted, s)
    hinted = F.coalesce(F.lower("text").rlike(_hint(known)), F.lit(False))
    longest = max(map(len, known.values()))

    def hits(parts: Column) -> Column:
        """Known sentences as structs of at (letters and digits before it, alike in both views), n (its length) and s."""
        before = _sums_before(F.transform(parts, lambda s: F.length(F.replace(s, F.lit(" "), F.lit("")))))
        kept = F.filter(F.arrays_zip(parts.alias("s"), before.alias("at")), lambda x: (F.length(x["s"]) <= longest) & x["s"].isin(*known.values()))
        return F.transform(kept, lambda x: F.struct(x["at"].alias("at"), F.length(x["s"]).alias("n"), x["s"].alias("s")))

    once = lambda parts: F.flatten(F.transform(F.array(parts), hits))
    lines = once(sentences(F.col("text")))
    wrapped = once(sentences(F.regexp_replace("text", r"([^.!?;:\n\s])[ \t]*\n[ \t]*(?=\S)", "$1 ")))
    ids = F.transform(_sorted_once(F.concat(lines, wrapped)), lambda x: F.element_at(names, place(x["s"]).cast("int")))
    rows = docs.withColumn("sentence_ids", F.when(hinted, ids).otherwise(F.array().cast("array<string>")))
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    ordered = lambda rule: line.rlike("^" + "".join("(?>.*? %s(?= ))" % x.replace(".", r"\.") for x in rule.sentences))
    found, done = [], set()
    for rule in rules:
        if rule.license not in done:
            done.add(rule.license)
            options = [ordered(r) for r in rules if r.license == rule.license]
            match = options[0]
            for o in options[1:]:
                match = match | o
            found.append(F.when(match, F.lit(rule.license)))
    return rows.withColumn("licenses", F.when(F.size("sentence_ids") > 0, F.array_compact(F.array(*found))).otherwise(F.array().cast("array<string>")))
