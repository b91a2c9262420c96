"""License scans by sentence rules, in DataFrame expressions alone.

A text becomes its words and the places where a sentence may begin or end: marks, colons, line ends (blank
lines too) and list numbers. A known license sentence is found where its words stand between two such places,
whatever places lie inside it, so wrapped lines, comment marks and a mark as in 'v. 2.0' do no harm. Of known
sentences that overlap, the first and then the longest counts. The identifiers found, in the order of the
text, form a sequence, in which ordered rules are matched. A rule that is part of a longer matched rule is
left out.

The tables of sentences and rules have a fixed size, so both go with the query. Texts without any word
that known sentences need are left after one pass of one pattern.

``oracle`` keeps to the first tables and to a plainer cut of sentences, so it knows a part of what is found.

Defined results: null and empty texts and texts without a known sentence have no rows; repeated rows are
reported alike; a null doc_id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, normalised. Every one holds one of NEEDED.
SENTENCES = (
    ("apache2-short", "licensed under the apache license version 2 0"),
    ("apache2-the-license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache2-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache2-spdx", "spdx license identifier apache 2 0"),
    ("mit-released", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-project", "this project is licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit-spdx", "spdx license identifier mit"),
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("gpl3-spdx", "spdx license identifier gpl 3 0 or later"),
    ("gpl3-only-spdx", "spdx license identifier gpl 3 0 only"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd2-spdx", "spdx license identifier bsd 2 clause"),
    ("bsd3-spdx", "spdx license identifier bsd 3 clause"),
    ("mpl2-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by-nc4", "licensed under cc by nc 4 0"),
    ("cc-by4", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa4", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc4-work", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights", "all rights reserved no license is granted"),
)

# Sentences of further notices and families; 'https' is read as 'http'. Every rule holds one of NEEDED.
MORE_SENTENCES = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("gpl2-only-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl3-only-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl2-spdx", "spdx license identifier gpl 2 0 or later"),
    ("gpl2-only-spdx", "spdx license identifier gpl 2 0 only"),
    ("gpl2-only-spdx", "spdx license identifier gpl 2 0"),
    ("lgpl21-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl-see", "see the gnu lesser general public license for more details"),
    ("lgpl21-spdx", "spdx license identifier lgpl 2 1 or later"),
    ("lgpl3-spdx", "spdx license identifier lgpl 3 0 or later"),
    ("agpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-see", "see the gnu affero general public license for more details"),
    ("agpl3-spdx", "spdx license identifier agpl 3 0 or later"),
    ("agpl3-only-spdx", "spdx license identifier agpl 3 0 only"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liability", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("mpl2-spdx", "spdx license identifier mpl 2 0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc-liability", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("isc-spdx", "spdx license identifier isc"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-liability", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib-spdx", "spdx license identifier zlib"),
    ("bsl1-short", "distributed under the boost software license version 1 0"),
    ("bsl1-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("bsl1-spdx", "spdx license identifier bsl 1 0"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-spdx", "spdx license identifier unlicense"),
    ("epl2-terms", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0"),
    ("epl2-terms", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at http www eclipse org legal epl 2 0"),
    ("epl2-spdx", "spdx license identifier epl 2 0"),
    ("cc0-dedicated", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc0-spdx", "spdx license identifier cc0 1 0"),
)

# Ordered rules over sentence identifiers.
RULES = (
    ("apache2-notice", "Apache-2.0", ("apache2-short",)),
    ("apache2-header-start", "Apache-2.0", ("apache2-the-license",)),
    ("apache2-header", "Apache-2.0", ("apache2-the-license", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("apache2-identifier", "Apache-2.0", ("apache2-spdx",)),
    ("mit-released-notice", "MIT", ("mit-released",)),
    ("mit-notice", "MIT", ("mit-licensed",)),
    ("mit-project-notice", "MIT", ("mit-project",)),
    ("mit-grant-only", "MIT", ("mit-grant",)),
    ("mit-text", "MIT", ("mit-grant", "mit-as-is", "mit-liability")),
    ("mit-identifier", "MIT", ("mit-spdx",)),
    ("gpl3-notice", "GPL-3.0", ("gpl3-work",)),
    ("gpl3-grant-only", "GPL-3.0-or-later", ("gpl3-free",)),
    ("gpl3-header", "GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-see")),
    ("gpl3-identifier", "GPL-3.0-or-later", ("gpl3-spdx",)),
    ("gpl3-only-identifier", "GPL-3.0-only", ("gpl3-only-spdx",)),
    ("gpl2-grant-only", "GPL-2.0-or-later", ("gpl2-free",)),
    ("gpl2-header", "GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("bsd-grant", "BSD", ("bsd-redistribution",)),
    ("bsd2-identifier", "BSD-2-Clause", ("bsd2-spdx",)),
    ("bsd3-identifier", "BSD-3-Clause", ("bsd3-spdx",)),
    ("mpl2-first", "MPL-2.0", ("mpl2-subject",)),
    ("mpl2-header", "MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("cc-by-nc4-notice", "CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("cc-by-nc4-work-notice", "CC-BY-NC-4.0", ("cc-by-nc4-work",)),
    ("cc-by4-notice", "CC-BY-4.0", ("cc-by4",)),
    ("cc-by-sa4-notice", "CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("all-rights-reserved", "LicenseRef-all-rights-reserved", ("all-rights",)),
)

MORE_RULES = (
    ("gpl3-only-grant", "GPL-3.0-only", ("gpl3-only-free",)),
    ("gpl2-only-grant", "GPL-2.0-only", ("gpl2-only-free",)),
    ("gpl3-only-header", "GPL-3.0-only", ("gpl3-only-free", "gpl-hope", "gpl-see")),
    ("gpl2-only-header", "GPL-2.0-only", ("gpl2-only-free", "gpl-hope", "gpl-see")),
    ("gpl2-identifier", "GPL-2.0-or-later", ("gpl2-spdx",)),
    ("gpl2-only-identifier", "GPL-2.0-only", ("gpl2-only-spdx",)),
    ("lgpl21-grant-only", "LGPL-2.1-or-later", ("lgpl21-free",)),
    ("lgpl21-header", "LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("lgpl3-grant-only", "LGPL-3.0-or-later", ("lgpl3-free",)),
    ("lgpl3-header", "LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-see")),
    ("lgpl3-program-header", "LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-see")),
    ("lgpl21-identifier", "LGPL-2.1-or-later", ("lgpl21-spdx",)),
    ("lgpl3-identifier", "LGPL-3.0-or-later", ("lgpl3-spdx",)),
    ("agpl3-grant-only", "AGPL-3.0-or-later", ("agpl3-free",)),
    ("agpl3-header", "AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-see")),
    ("agpl3-identifier", "AGPL-3.0-or-later", ("agpl3-spdx",)),
    ("agpl3-only-identifier", "AGPL-3.0-only", ("agpl3-only-spdx",)),
    ("bsd2-clauses", "BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("bsd2-text", "BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("bsd3-clauses", "BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
    ("bsd3-text", "BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is", "bsd-liability")),
    ("mpl2-identifier", "MPL-2.0", ("mpl2-spdx",)),
    ("isc-grant-only", "ISC", ("isc-grant",)),
    ("isc-text", "ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("isc-identifier", "ISC", ("isc-spdx",)),
    ("zlib-grant-only", "Zlib", ("zlib-grant",)),
    ("zlib-text", "Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("zlib-identifier", "Zlib", ("zlib-spdx",)),
    ("bsl1-notice", "BSL-1.0", ("bsl1-short",)),
    ("bsl1-grant-only", "BSL-1.0", ("bsl1-grant",)),
    ("bsl1-identifier", "BSL-1.0", ("bsl1-spdx",)),
    ("unlicense-notice", "Unlicense", ("unlicense-free",)),
    ("unlicense-identifier", "Unlicense", ("unlicense-spdx",)),
    ("epl2-notice", "EPL-2.0", ("epl2-terms",)),
    ("epl2-identifier", "EPL-2.0", ("epl2-spdx",)),
    ("cc0-notice", "CC0-1.0", ("cc0-dedicated",)),
    ("cc0-identifier", "CC0-1.0", ("cc0-spdx",)),
)

#: Every known sentence that a rule rests on holds one of these.
NEEDED = ("licens", "permission", "warrant", "copyright", "redistribut", "mpl", "unencumbered")

#: Ends of sentences in ``oracle``: a mark and white space.
ENDS = r"[.!?]+\s+"

#: Where a sentence may end, and marks of list items behind which one may begin.
BREAKS = r"[.!?:]+\s+"
ITEMS = r"(?m)^[^\p{L}\p{N}\n]*(?:\p{N}{1,2}|[a-z]|[ivx]{2,4})\)\s+"


def _marked(text: Column) -> Column:
    """Words in lower case with a blank between them, or a line end where a sentence may begin or end."""
    broken = F.regexp_replace(F.regexp_replace(F.lower(text), ITEMS, "$0\n"), BREAKS, "\n")
    words = F.regexp_replace(F.regexp_replace(broken, r"[^\p{L}\p{N}\n]+", " "), r"\bhttps\b", "http")
    return F.regexp_replace(F.concat(F.lit("\n"), words, F.lit("\n")), r" ?\n[ \n]*", "\n")


def sentence_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: tuple = SENTENCES + MORE_SENTENCES) -> DataFrame:
    """(doc_id, sids): the known sentences of every row that has some, in the order of the text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike("(?i)" + "|".join(NEEDED)))
    longest = sorted({words for _, words in sentences}, key=lambda x: (-len(x), x))
    known = r"(?<=\n)(?:" + "|".join(x.replace(" ", "[ \n]") for x in longest) + r")(?=\n)"
    names = F.create_map(*[F.lit(x) for sid, words in sentences for x in (words, sid)])
    found = rows.select("doc_id", F.regexp_extract_all(_marked(F.col("text")), F.lit(known), F.lit(0)).alias("found")).where(F.size("found") > 0)
    return found.select("doc_id", F.transform("found", lambda x: F.element_at(names, F.translate(x, "\n", " "))).alias("sids"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: tuple = SENTENCES + MORE_SENTENCES,
         rules: tuple = RULES + MORE_RULES) -> DataFrame:
    """(doc_id, rule, license, matches): the rules that match a row, and how often."""
    ids = sentence_ids(docs, doc_id, text, sentences)
    texts = ids.select("doc_id", F.array_join(F.transform("sids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "").alias("s"))
    table = [(r, lic, "".join(f"<{x}>" for x in seq)) for r, lic, seq in rules]
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"), F.lit(seq).alias("seq")) for r, lic, seq in table])
    hits = texts.withColumn("hit", F.filter(listed, lambda r: F.contains(F.col("s"), r["seq"])))
    longest = F.filter("hit", lambda r: ~F.exists("hit", lambda o: (F.length(o["seq"]) > F.length(r["seq"])) & F.contains(o["seq"], r["seq"])))
    one = hits.select("doc_id", "s", F.explode(longest).alias("r"))
    times = (F.length("s") - F.length(F.replace("s", F.col("r.seq"), F.lit("")))) / F.length("r.seq")
    return one.select("doc_id", F.col("r.rule").alias("rule"), F.col("r.license").alias("license"), times.cast("long").alias("matches"))


def oracle() -> str:
    """DuckDB SQL for ``scan`` of the table ``documents`` with its columns doc_id and text."""
    text = lambda rows: ", ".join("(" + ", ".join("'" + x + "'" for x in r) + ")" for r in rows)
    needed = "(?i)" + "|".join(NEEDED)
    return rf"""
with known(sid, words) as (values {text(SENTENCES)}), rule(rule, license, seq) as (values {text([(r, l, "".join(f"<{x}>" for x in s)) for r, l, s in RULES])}),
part as (
  select doc_id, unnest(regexp_split_to_array(text, '{ENDS}')) as sentence, generate_subscripts(regexp_split_to_array(text, '{ENDS}'), 1) as i from documents
), piece as (
  select doc_id, i, 0 as j, sentence as piece from part
  union all
  select doc_id, i, generate_subscripts(string_split(sentence, chr(10)), 1), unnest(string_split(sentence, chr(10))) from part
  where len(list_filter(string_split(sentence, chr(10)), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))) > 1
), seq as (
  select doc_id, string_agg('<' || sid || '>', '' order by i, j) as s
  from (select *, trim(regexp_replace(lower(piece), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as words from piece) join known using (words)
  group by doc_id
), hit as (
  select doc_id, s, rule, license, seq from seq join rule on contains(s, seq)
)
select doc_id, rule, license, cast((length(s) - length(replace(s, seq, ''))) / length(seq) as bigint) as matches
from hit h where not exists (select 1 from hit o where o.doc_id = h.doc_id and length(o.seq) > length(h.seq) and contains(o.seq, h.seq))
"""
