"""Operator 2: licence recognition by known sentences and ordered rules, in DataFrame functions only.

A text's lines lose blanks and comment marks at both ends, CRLF counts as LF, and the lines of a paragraph are
joined, so that wrapped, indented and commented notices become whole sentences; a second reading takes each
line by itself, for notices that stand on a line of their own amid others. Sentences are normalised (lower case,
everything but letters and digits as one space, numbering before a sentence left out; in the sentences of `VARIANTS`
an owner's or a project's name is any words) and looked up by hash
among known licence sentences. The identifiers found, in order, form the text's sequence, and after it those of the
licences in SPDX expressions. A rule is a
sequence of identifiers and matches where they stand in it side by side, whatever unknown sentences lie between.
Longer rules go first: a match inside the span of a longer one is none, nor is one whose rule is part of
a longer one's that the other reading matches, so a licence that contains another is reported alone. Rules of `FALLBACK`
(all rights reserved) count where no other matches; their sentences, which stand in most notices, are in no
other rule's way. All of it happens within the row: no shuffle, and no table that grows.

A null or empty text has no sentences and no licence. Repeated rows are judged each; null keys pass
through. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licences in normal form, by identifier.
SENTENCES = {
    "all-rights": "all rights reserved",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-short-2": "licensed under the apache license 2 0",
    "apache-short-3": "licensed under the apache 2 0 license",
    "apache-the": "licensed under the apache license version 2 0 the license",
    "apache-you-may": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "x11-name": "except as contained in this notice the name of the owner shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the owner",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-author-name": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2-short": "licensed under the bsd 2 clause license",
    "bsd3-short": "licensed under the bsd 3 clause license",
    "isc-short": "licensed under the isc license",
    "mpl-short": "licensed under the mozilla public license 2 0",
    "mpl-short-2": "licensed under the mozilla public license version 2 0",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "hpnd-grant": "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "gpl3-short": "licensed under the gnu general public license version 3",
    "gpl2-short": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software",
    "gpl-library-free": "this library is free software",
    "gpl3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-library-terms": "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "v2-later": "either version 2 of the license or at your option any later version",
    "v21-later": "either version 2 1 of the license or at your option any later version",
    "v3-later": "either version 3 of the license or at your option any later version",
    "v2-only": "version 2 of the license",
    "lgpl21-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl2-later": "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl3-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-short": "licensed under the gnu affero general public license version 3",
    "lgpl3-short": "licensed under the gnu lesser general public license version 3",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-incompatible": "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "cddl-terms": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsl-short": "distributed under the boost software license version 1 0",
    "artistic2-title": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "artistic2-terms": "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
    "ncsa-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "eupl-terms": "licensed under the eupl version 1 2",
    "ofl-terms": "this font software is licensed under the sil open font license version 1 1",
    "wtfpl-terms": "you just do what the fuck you want to",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-nd-4": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-4": "licensed under cc by nc sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-long": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-long": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-long": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
}

# Licences by the sequences of sentences that state them.
RULES = {
    "0bsd": [["0bsd-grant", "isc-as-is"]],
    "agpl-3.0-or-later": [["gpl-free", "agpl3-later"], ["gpl-free", "agpl-terms", "v3-later"]],
    "agpl-3.0": [["agpl3-short"]],
    "apache-2.0": [["apache-short"], ["apache-short-2"], ["apache-short-3"], ["apache-the", "apache-you-may"], ["apache-the", "apache-you-may", "apache-obtain", "apache-as-is", "apache-see"], ["apache-as-is", "apache-see"]],
    "artistic-2.0": [["artistic2-title", "artistic2-terms"]],
    "bsd-2-clause": [["bsd2-short"], ["bsd-grant", "bsd-source", "bsd-binary"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]],
    "bsd-3-clause": [["bsd3-short"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-author-name"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-author-name", "bsd-as-is"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]],
    "bsd-4-clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names", "bsd-as-is"]],
    "bsl-1.0": [["bsl-short"], ["bsl-grant"]],
    "cc-by-4.0": [["cc-by-4"], ["cc-by-long"]],
    "cc-by-nc-4.0": [["cc-by-nc-4"], ["cc-by-nc-long"]],
    "cc-by-nc-nd-4.0": [["cc-by-nc-nd-long"]],
    "cc-by-nc-sa-4.0": [["cc-by-nc-sa-4"], ["cc-by-nc-sa-long"]],
    "cc-by-nd-4.0": [["cc-by-nd-4"], ["cc-by-nd-long"]],
    "cc-by-sa-4.0": [["cc-by-sa-4"], ["cc-by-sa-long"]],
    "cc0-1.0": [["cc0"]],
    "cddl-1.0": [["cddl-terms"]],
    "epl-1.0": [["epl1-terms"]],
    "epl-2.0": [["epl2-terms"]],
    "eupl-1.2": [["eupl-terms"]],
    "gpl-2.0": [["gpl2-short"], ["gpl-free", "gpl2-only"], ["gpl-free", "gpl-terms", "v2-only"]],
    "gpl-2.0-or-later": [["gpl-free", "gpl2-later"], ["gpl-free", "gpl-terms", "v2-later"]],
    "gpl-3.0": [["gpl3-short"], ["gpl-free", "gpl3-only"]],
    "gpl-3.0-or-later": [["gpl-free", "gpl3-later"], ["gpl-free", "gpl-terms", "v3-later"]],
    "hpnd": [["hpnd-grant"]],
    "isc": [["isc-short"], ["isc-grant"], ["isc-grant", "isc-as-is"]],
    "lgpl-2.0-or-later": [["gpl-library-free", "lgpl2-later"], ["gpl-free", "lgpl2-later"], ["gpl-library-free", "lgpl-library-terms", "v2-later"]],
    "lgpl-2.1-or-later": [["gpl-library-free", "lgpl21-later"], ["gpl-free", "lgpl21-later"], ["gpl-library-free", "lgpl-terms", "v21-later"], ["gpl-free", "lgpl-terms", "v21-later"]],
    "lgpl-3.0": [["lgpl3-short"]],
    "lgpl-3.0-or-later": [["gpl-library-free", "lgpl3-later"], ["gpl-free", "lgpl3-later"], ["gpl-library-free", "lgpl-terms", "v3-later"], ["gpl-free", "lgpl-terms", "v3-later"]],
    "mit": [["mit-short"], ["mit-grant", "mit-notice"], ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"], ["mit-as-is", "mit-liable"]],
    "mit-0": [["mit-0-grant"], ["mit-0-grant", "mit-as-is", "mit-liable"]],
    "mpl-2.0": [["mpl-short"], ["mpl-short-2"], ["mpl-terms"], ["mpl-terms", "mpl-copy"], ["mpl-terms", "mpl-copy-2"]],
    "mpl-2.0-no-copyleft-exception": [["mpl-terms", "mpl-copy", "mpl-incompatible"], ["mpl-terms", "mpl-copy-2", "mpl-incompatible"]],
    "ncsa": [["ncsa-grant"], ["ncsa-grant", "bsd-source", "bsd-binary"]],
    "ofl-1.1": [["ofl-terms"]],
    "postgresql": [["postgresql-grant"]],
    "proprietary": [["all-rights"]],
    "unlicense": [["unlicense"], ["unlicense", "unlicense-anyone"]],
    "wtfpl": [["wtfpl-terms"]],
    "x11": [["mit-grant", "mit-notice", "mit-as-is", "x11-name"], ["mit-grant", "mit-notice", "mit-as-is", "mit-liable", "x11-name"]],
    "zlib": [["zlib-as-is", "zlib-grant"], ["zlib-as-is", "zlib-grant", "zlib-origin"], ["zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered"]],
}

#: Rules that count where no other matches.
FALLBACK = ("proprietary",)
#: Licences that SPDX expressions name: those of the rules, "only" or not for versions.
SPDX = [n for n in RULES if n not in FALLBACK] + ["lgpl-2.0", "lgpl-2.1"]
for _name in SPDX:
    _words = _name.replace("-", " ").replace(".", " ")
    for _id, _s in [(f"spdx-{_name}", f"spdx {_words}")] + [(f"spdx-{_name}-only", f"spdx {_words} only")] * ("gpl-" in _name and "later" not in _name):
        SENTENCES[_id] = _s
        RULES.setdefault(_name, []).append([_id])
EXPRESSION, OPERATORS = r"spdx-license-identifier:[ \t]*([^\r\n]*)", r"[ \t]+(?:or|and)[ \t]+|[()]|[ \t]+with[ \t].*$"

#: Variants of known sentences: for a sentence that holds the first text, what the expression finds becomes the third.
VARIANTS = [
    ("neither the name", "^neither the names? of .{1,120}? nor the names? of (?:its|their|any|any of its|other) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("may not be used to endorse", "^the names? of .{1,120}? may not be used to endorse", "the name of the author may not be used to endorse"),
    ("this software is provided by", "^this software is provided by .{1,120}? as is and any express or implied", "this software is provided by the copyright holders and contributors as is and any express or implied"),
    ("except as contained in this notice", "^(except as contained in this notice the name) of .{1,120}? (shall not be used in advertising .{1,160}? authorization from) .{1,120}$", "\\1 of the owner \\2 the owner"),
    ("be liable for any claim", "^in no event shall .{1,120}? be liable for any claim", "in no event shall the authors or copyright holders be liable for any claim"),
    ("any later version", "either version (2|2 1|3) or at your option any later version$", "either version \\1 of the license or at your option any later version"),
    ("is free software", "^(?:[^ ]+ ){1,8}?is free software$", "this program is free software"),
    (" under the ", "^(?:.{0,80}? )?(?:licensed|released|distributed|available) under (?:the terms of )?(the .{2,60}?license(?: version)?(?: [0-9]){0,2})(?: (?:see|please see|as found|which|and|in) .{0,160})?$", "licensed under \\1"),
]

#: What lines lose at their beginnings (blanks, comment marks, bullets, numbering), where paragraphs and sentences
#: end, what normal forms leave out. The expressions mean the same in SQL, and none looks twice at a run of blanks.
BEGINS = r"(^|\n)[ \t/*#;%!<>|-]*(?:(?:[0-9]{1,2}[.)]|\(?(?:[0-9]{1,2}|[a-h]|i{1,3}|iv)\))[ \t]+)?"
#: A point after these (in owners' names) ends no sentence.
SHORT = r"(^|[ \t\n,])(inc|ltd|co|corp|jr|dr)[.]"
PARAGRAPHS, ENDS, OUT = r"\n\n+", r"[.!?;:][ \t\n\x0B\x0C\x01]+", r"[\x00\x02-\x2F\x3A-\x60\x7B-\x7F]+"
#: Places in the table of hashes.
TABLE = 1024


def _sentences(text: Column, joined: bool) -> Column:
    """The normal forms of a text's sentences, in order."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, SHORT, "$1$2"), BEGINS, "$1"), PARAGRAPHS, "\x01")
    s = F.translate(F.regexp_replace(s, ENDS, "\x01"), "\n", " " if joined else "\x01")
    s = F.regexp_replace(s, OUT, " ")
    return F.filter(F.transform(F.split(s, "\x01"), lambda x: _canonical(F.trim(x))), lambda x: x != "")


def _canonical(x: Column) -> Column:
    """A sentence with the names in it as in the known one."""
    out = F.when(x == "this library is free software", x)
    for held, found, instead in VARIANTS:
        out = out.when(x.contains(held), F.regexp_replace(x, found, instead.replace("\\", "$")))
    return out.otherwise(x)


def _named(text: Column) -> Column:
    """Sentences of the licences that SPDX expressions name."""
    lists = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(EXPRESSION), F.lit(1)), lambda x: F.split(x, OPERATORS))
    words = F.transform(F.flatten(lists), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\+", " or later"), OUT, " ")))
    return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit("spdx "), x))


def _lookup(sentences: dict[str, str]) -> Column:
    """The known sentences as a literal array of `TABLE` lists, each sentence at the place of its checksum."""
    rows: list[list] = [[] for _ in range(TABLE)]
    for name, s in sentences.items():
        rows[zlib.crc32(s.encode()) % TABLE].append({"s": s, "id": name})
    return F.from_json(F.lit(json.dumps(rows)), "array<array<struct<s:string,id:string>>>")


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES, rules: dict[str, list[list[str]]] = RULES) -> DataFrame:
    """One row per document: key, n_sentences, sentence_ids (those known, in order; of the reading with joined lines,
    or line by line where that knows more) and licenses (names of the rules that match in either, sorted)."""
    if len(sentences) > 10_000 or sum(map(len, rules.values())) > 10_000:
        raise ValueError("sentences and rules are looked up in literals of the plan; split the tables")
    table = _lookup(sentences)
    known = lambda s: F.filter(F.transform(s, lambda x: F.get(F.filter(F.get(table, F.pmod(F.crc32(F.encode(x, "UTF-8")), F.lit(TABLE)).cast("int")), lambda e: e["s"] == x), 0)["id"]), lambda x: x.isNotNull())
    weak = {i for name in FALLBACK for w in rules.get(name, []) for i in w}

    def matcher(chosen: dict[str, list[list[str]]]):
        flat = [{"name": name, "seq": ",".join(w) + ",", "n": len(w)} for name, ways in sorted(chosen.items()) for w in ways]
        ways = F.from_json(F.lit(json.dumps(flat)), "array<struct<name:string,seq:string,n:int>>")
        longest = max((r["n"] for r in flat), default=1)

        def matches(ids: Column) -> Column:
            at = lambda i: F.concat(F.array_join(F.slice(ids, i + 1, longest), ","), F.lit(","))
            found = lambda i: F.transform(F.filter(ways, lambda r: F.startswith(at(i), r["seq"])), lambda r: F.struct(r["name"].alias("name"), r["seq"].alias("seq"), i.alias("a"), (i + r["n"]).alias("b")))
            return F.when(F.size(ids) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(ids) - 1), found))).otherwise(F.array().cast("array<struct<name:string,seq:string,a:int,b:int>>"))

        return matches

    def outer(m: Column, other: Column) -> Column:
        span = lambda x: x["b"] - x["a"]
        inside = lambda x: F.exists(m, lambda o: (o["a"] <= x["a"]) & (o["b"] >= x["b"]) & (span(o) > span(x)))
        part = lambda x: F.exists(other, lambda o: (span(o) > span(x)) & F.contains(F.concat(F.lit(","), o["seq"]), F.concat(F.lit(","), x["seq"])))
        return F.transform(F.filter(m, lambda x: ~inside(x) & ~part(x)), lambda x: x["name"])

    main, last = matcher({n: w for n, w in rules.items() if n not in FALLBACK}), matcher({n: w for n, w in rules.items() if n in FALLBACK})
    strong = lambda ids: F.filter(ids, lambda x: ~x.isin(sorted(weak))) if weak else ids
    df = docs.select(key, _sentences(F.col(text), True).alias("_s"), _sentences(F.col(text), False).alias("_l"), _named(F.col(text)).alias("_x"))
    df = df.select(key, F.size("_s").cast("long").alias("n_sentences"), known(F.concat("_s", "_x")).alias("_s"), known(F.concat("_l", "_x")).alias("_l"))
    ids = F.when(F.size("_l") > F.size("_s"), F.col("_l")).otherwise(F.col("_s"))
    df = df.select(key, "n_sentences", ids.alias("sentence_ids"), strong(F.col("_s")).alias("_s1"), strong(F.col("_l")).alias("_l1"), last(F.col("_l")).alias("_f1"))
    df = df.select(key, "n_sentences", "sentence_ids", main(F.col("_s1")).alias("_s2"), main(F.col("_l1")).alias("_l2"), F.transform("_f1", lambda x: x["name"]).alias("_f2"))
    found = F.concat(outer(F.col("_s2"), F.col("_l2")), outer(F.col("_l2"), F.col("_s2")))
    df = df.select(key, "n_sentences", "sentence_ids", found.alias("_names"), "_f2")
    return df.select(key, "n_sentences", "sentence_ids", F.array_sort(F.array_distinct(F.when(F.size("_names") > 0, F.col("_names")).otherwise(F.col("_f2")))).alias("licenses"))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = licenses(docs)
    return out.select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    names = ", ".join(f"('{s}', '{name}')" for name, s in SENTENCES.items())
    rules = ", ".join(f"('{name}', '{','.join(w)},', {len(w)}, {name in FALLBACK})" for name, ways in RULES.items() for w in ways)
    weak = ", ".join(f"'{i}'" for name in FALLBACK for w in RULES[name] for i in w)
    cases = " ".join(f"WHEN contains(x, '{quoted(h)}') THEN regexp_replace(x, '{quoted(f)}', '{quoted(i)}', 'g')" for h, f, i in VARIANTS)
    return rf"""
WITH known(s, id) AS (VALUES {names}), rules(name, seq, n, last) AS (VALUES {rules}), t AS (
  SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\r\n?', chr(10), 'g'), '{SHORT}', '\1\2', 'g'),
         '{BEGINS}', '\1', 'g'), '{PARAGRAPHS}', chr(1), 'g'), '{ENDS}', chr(1), 'g') AS a FROM documents
), r AS (
  SELECT doc_id, text, 1 AS way, replace(a, chr(10), ' ') AS a FROM t UNION ALL SELECT doc_id, text, 2, replace(a, chr(10), chr(1)) FROM t
), s0 AS (
  SELECT doc_id, text, way, list_filter(list_transform(list_transform(string_split(regexp_replace(a, '{OUT}', ' ', 'g'), chr(1)), lambda x: trim(x)),
    lambda x: CASE WHEN x = 'this library is free software' THEN x {cases} ELSE x END), lambda x: x <> '') AS list FROM r
), s AS (
  SELECT doc_id, way, list, list_concat(list, list_transform(list_filter(list_transform(flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '{EXPRESSION}', 1),
    lambda x: string_split_regex(x, '{OPERATORS}'))), lambda x: trim(regexp_replace(replace(x, '+', ' or later'), '{OUT}', ' ', 'g'))), lambda x: x <> ''), lambda x: 'spdx ' || x)) AS every FROM s0
), e AS (
  SELECT doc_id, way, i, every[i] AS x FROM (SELECT doc_id, way, every, unnest(range(1, len(every) + 1)) AS i FROM s)
), ids AS (
  SELECT doc_id, way, list(id ORDER BY i) AS l FROM e JOIN known ON known.s = e.x GROUP BY doc_id, way
), pos AS (
  SELECT doc_id, way, false AS last, m AS l, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, way, list_filter(l, lambda x: x NOT IN ({weak})) AS m FROM ids)
  UNION ALL SELECT doc_id, way, true, l, unnest(range(1, len(l) + 1)) FROM ids WHERE way = 2
), m AS (
  SELECT doc_id, way, rules.last, name, seq, i AS a, i + n AS b FROM pos JOIN rules ON rules.last = pos.last AND starts_with(array_to_string(l[i : i + 20], ',') || ',', seq)
), main AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM m
  WHERE NOT last AND NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND NOT o.last AND o.b - o.a > m.b - m.a
    AND CASE WHEN o.way = m.way THEN o.a <= m.a AND o.b >= m.b ELSE contains(',' || o.seq, ',' || m.seq) END) GROUP BY doc_id
), fallback AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM m WHERE last GROUP BY doc_id
), best AS (
  SELECT doc_id, arg_max(l, len(l) * 10 - way) AS l FROM ids GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(list) AS BIGINT) AS n_sentences, CAST(coalesce(len(l), 0) AS BIGINT) AS n_known, coalesce(array_to_string(l, ','), '') AS sentence_ids, coalesce(main.names, fallback.names, '') AS licenses
FROM s LEFT JOIN best ON best.doc_id = s.doc_id LEFT JOIN main ON main.doc_id = s.doc_id LEFT JOIN fallback ON fallback.doc_id = s.doc_id WHERE s.way = 1
"""


OP2_SQL = _sql()
