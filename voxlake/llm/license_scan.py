"""License scans by sentence rules, in DataFrame functions alone.

A text is normalised, with the places where a sentence may begin or end; what stands between two of these, over line ends and
comment signs too, is looked up in a table of known licence sentences, which gives each an identifier; the sequence of a text's identifiers is then matched against ordered rules, each of which names a licence. The first
rule that matches claims its identifiers, the next ones see what is left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Identifier and sentence, as lower-case words. ``<v>`` stands for a version number.
SENTENCES = (
    ("ApacheLic", "licensed under the apache license version <v>"),
    ("ApacheLicUnder", "licensed under the apache license version <v> the license"),
    ("ApacheNoUse", "you may not use this file except in compliance with the license"),
    ("ApacheObtain", "you may obtain a copy of the license at"),
    ("ApacheBasis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MITRef", "released under the mit license"),
    ("MITRef", "licensed under the mit license"),
    ("MITRef", "this project is licensed under the mit license"),
    ("MITPerm", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITCond", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("GPLRef", "this work is licensed under the gnu general public license version <v>"),
    ("GPLRef", "licensed under the gnu general public license version <v>"),
    ("GPLFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <v> of the license or at your option any later version"),
    ("GPLHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLSee", "see the gnu general public license for more details"),
    ("LGPLRef", "licensed under the gnu lesser general public license version <v>"),
    ("BSDRedist", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSDName", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CCRef", "licensed under cc by nc <v>"),
    ("CCByRef", "licensed under cc by <v>"),
    ("CCBySaRef", "licensed under cc by sa <v>"),
    ("MPLRef", "this source code form is subject to the terms of the mozilla public license v <v>"),
    ("LGPLFree", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version <v> of the license or at your option any later version"),
    ("LGPLHope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("LGPLSee", "see the gnu lesser general public license for more details"),
    ("AGPLFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version <v> of the license or at your option any later version"),
    ("AGPLSee", "see the gnu affero general public license for more details"),
    ("AGPLRef", "licensed under the gnu affero general public license version <v>"),
    ("ISCPerm", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroPerm", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISCAsIs", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("BoostPerm", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("BoostRef", "distributed under the boost software license version <v>"),
    ("ZlibPerm", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("UnlicenseFree", "this is free and unencumbered software released into the public domain"),
    ("ZeroRef", "licensed under cc <v>"),
    ("EPLRef", "this program and the accompanying materials are made available under the terms of the eclipse public license <v>"),
    ("EPLRef", "this program and the accompanying materials are made available under the terms of the eclipse public license v <v>"),
    ("EPLRef", "licensed under the eclipse public license version <v>"),
)

#: Identifiers that tags name, and whether they are permissive.
TAGS = (
    ("MIT", True), ("MIT-0", True), ("ISC", True), ("0BSD", True), ("BSD-2-Clause", True), ("BSD-3-Clause", True), ("Apache-2.0", True), ("Zlib", True), ("BSL-1.0", True), ("Unlicense", True), ("CC0-1.0", True), ("CC-BY-4.0", True), ("CC-BY-SA-4.0", False), ("CC-BY-NC-4.0", False),
    ("MPL-2.0", True), ("EPL-2.0", False), ("GPL-2.0-only", False), ("GPL-2.0-or-later", False), ("GPL-3.0-only", False), ("GPL-3.0-or-later", False), ("LGPL-2.1-only", False), ("LGPL-2.1-or-later", False), ("LGPL-3.0-only", False), ("LGPL-3.0-or-later", False),
    ("AGPL-3.0-only", False), ("AGPL-3.0-or-later", False), ("Artistic-2.0", True), ("PostgreSQL", True), ("NCSA", True), ("X11", True), ("WTFPL", True), ("Python-2.0", True), ("EUPL-1.2", False), ("OFL-1.1", True),
)


def _tag(identifier: str) -> tuple[str, str, str]:
    """Name and sentence of the tag of an identifier, and the version that stands in it."""
    words = re.sub(r"([0-9]+(?:_[0-9]+)?)", r" \1 ", re.sub(r"([0-9])\.([0-9])", r"\1_\2", identifier.lower())).replace("-", " ").split()
    text = " ".join("<v>" if w[0].isdigit() else w for w in words)
    version = next((w.replace("_", ".") for w in words if w[0].isdigit()), "")
    return "Tag-" + text.replace("<v>", "v").replace(" ", "-"), f"spdx license identifier {text}", version


#: More sentences, of the official notices, and the tags.
NOTICES = (
    *((name, f"{start}licensed under {article}creative commons attribution {kind}<v> international{end}") for name, kind in (("CCRef", "noncommercial "), ("CCByRef", ""), ("CCBySaRef", "sharealike ")) for start in ("", "this work is ") for article in ("a ", "the ", "") for end in ("", " license")),
    *dict.fromkeys(_tag(identifier)[:2] for identifier, _ in TAGS),
)

#: Rules in their order, as (licence, pattern over a text's ``<identifier:version>`` items, permissive or not).
_RULES = (
    ("GPL-3.0-or-later", r"<GPLFree:3>(?:<GPLHope:>)?(?:<GPLSee:>)?", False),
    ("GPL-2.0-or-later", r"<GPLFree:2>(?:<GPLHope:>)?(?:<GPLSee:>)?", False),
    ("GPL-3.0-only", r"<GPLRef:3(?:\.0)?>", False),
    ("GPL-2.0-only", r"<GPLRef:2(?:\.0)?>", False),
    ("LGPL-3.0-only", r"<LGPLRef:3(?:\.0)?>", False),
    ("LGPL-2.1-only", r"<LGPLRef:2\.1>", False),
    ("Apache-2.0", r"<(?:ApacheLic|ApacheLicUnder):2\.0>(?:<ApacheNoUse:>)?(?:<ApacheObtain:>)?(?:<ApacheBasis:>)?(?:<ApacheSee:>)?", True),
    ("MIT", r"<MITPerm:>(?:<MITCond:>)?(?:<MITAsIs:>)?|<MITRef:>", True),
    ("BSD-3-Clause", r"<BSDRedist:><BSDSource:><BSDBinary:><BSDName:>", True),
    ("BSD-2-Clause", r"<BSDRedist:><BSDSource:><BSDBinary:>", True),
    ("CC-BY-NC-4.0", r"<CCRef:4\.0>", False),
    ("CC-BY-SA-4.0", r"<CCBySaRef:4\.0>", False),
    ("CC-BY-4.0", r"<CCByRef:4\.0>", True),
    ("MPL-2.0", r"<MPLRef:2\.0>", False),
    ("LGPL-3.0-or-later", r"<LGPLFree:3(?:\.0)?>(?:<LGPLHope:>)?(?:<LGPLSee:>)?", False),
    ("LGPL-2.1-or-later", r"<LGPLFree:2\.1>(?:<LGPLHope:>)?(?:<LGPLSee:>)?", False),
    ("AGPL-3.0-or-later", r"<AGPLFree:3(?:\.0)?>(?:<GPLHope:>)?(?:<AGPLSee:>)?", False),
    ("AGPL-3.0-only", r"<AGPLRef:3(?:\.0)?>", False),
    ("ISC", r"<ISCPerm:>(?:<ISCAsIs:>)?", True),
    ("0BSD", r"<ZeroPerm:>(?:<ISCAsIs:>)?", True),
    ("BSL-1.0", r"<BoostPerm:>|<BoostRef:1\.0>", True),
    ("Zlib", r"<ZlibPerm:>", True),
    ("Unlicense", r"<UnlicenseFree:>", True),
    ("EPL-2.0", r"<EPLRef:2\.0>", False),
)


def _with_tags() -> tuple[tuple[str, str, bool], ...]:
    """The rules, each with the tag of its licence, and one for each other tag."""
    tags = {identifier: f"<{name}:{re.escape(version)}>" for identifier, (name, _, version) in ((i, _tag(i)) for i, _ in TAGS)}
    named = {name for name, _, _ in _RULES}
    return (*((name, f"{pattern}|{tags[name]}" if name in tags else pattern, free) for name, pattern, free in _RULES), *((i, tags[i], free) for i, free in TAGS if i not in named))


RULES = _with_tags()

#: What every known sentence holds, on one line however it is wrapped; only texts with one of these are searched. Derived from the table.
MARKS = r"(?i)mit license|licen[sc]e|unencumbered|permission|warrant|redistribut|copyright|free software|obtain a copy|except in compliance"


def _flat(text: Column) -> Column:
    """Lower case, each number as one word with ``_`` for its point, other signs as single spaces, and ``|`` where a sentence may begin or end.

    That is at line ends, and after ``.``, ``!``, ``?``, ``:`` or ``;`` before a space. Comment signs go with the other signs.
    """
    words = F.translate(F.lower(text), "|_", "  ")
    for pattern, by in ((r"(?m)^[ \t]*(?:rem|dnl)\b", " "), (r"[.!?:;]+(?=[ \t\r\n]|$)|[\r\n]+", " | "), (r"([0-9]+)\.([0-9]+)", "$1_$2"), (r"([0-9]+(?:_[0-9]+)?)", " $1 "), (r"[^a-z0-9_|]+", " "), (r"(?:\| )+", "| ")):
        words = F.regexp_replace(words, pattern, by)
    return F.concat(F.lit("| "), F.trim(words), F.lit(" |"))


def _pattern() -> str:
    """Any known sentence between two boundaries, the longest first; boundaries inside it, as at the ends of wrapped lines, are passed over."""
    gap, number = r" (?:\| )?", r"[0-9]+(?:_[0-9]+)?"
    texts = sorted({t for _, t in (*SENTENCES, *NOTICES)}, key=lambda t: (-len(t.split()), t))
    return r"\| (" + "|".join(gap.join(number if w == "<v>" else w for w in t.split()) for t in texts) + r")(?= \|)"


def _known() -> Column:
    return F.create_map(*[F.lit(v) for pair in {text: name for name, text in (*SENTENCES, *NOTICES)}.items() for v in pair])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, sentence_ids, licenses, n_known, n_unmatched, permissive``.

    ``sentence_ids`` are the identifiers of the text's known licence sentences in their order, with versions after a colon;
    ``licenses`` the rules that matched, in the rules' order; ``n_unmatched`` the known sentences that no rule claimed;
    ``permissive`` whether all licences found are, null where none is. Null and empty texts have empty arrays; repeated rows are
    scanned alike; ids may be null; other columns are not read; an empty table gives an empty result. Whole texts are read, and no row is
    moved: the two small tables are part of the plan.
    """
    known = _known()
    text = text_or_empty(text_col)
    # A text without a mark has no known sentence: it is not searched.
    cut = F.when(text.rlike(MARKS), F.regexp_extract_all(_flat(text), F.lit(_pattern()), F.lit(1))).otherwise(F.array().cast("array<string>"))

    def item(sentence: Column) -> Column:
        words = F.replace(sentence, F.lit("| "), F.lit(""))
        name = F.try_element_at(known, F.regexp_replace(words, "[0-9]+(?:_[0-9]+)?", "<v>"))
        return F.concat(F.lit("<"), name, F.lit(":"), F.replace(F.regexp_extract(words, "([0-9]+(?:_[0-9]+)?)", 1), F.lit("_"), F.lit(".")), F.lit(">"))

    found = docs.select(F.col(id_col).alias("doc_id"), F.transform(cut, item).alias("items"))
    rest = F.array_join("items", "")
    out = found.select("doc_id", F.transform("items", lambda x: F.replace(F.replace(x, F.lit("<"), F.lit("")), F.lit(">"), F.lit(""))).alias("sentence_ids"), F.size("items").cast("bigint").alias("n_known"), rest.alias("s0"))
    hits = []
    for i, (name, pattern, free) in enumerate(RULES):
        hits.append(F.when(F.col(f"h{i}"), F.struct(F.lit(name).alias("name"), F.lit(free).alias("free"))))
        out = out.withColumns({f"h{i}": F.col(f"s{i}").rlike(pattern), f"s{i + 1}": F.regexp_replace(f"s{i}", pattern, "")}).drop(f"s{i}")
    matched = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return out.withColumn("m", matched).select(
        "doc_id", "sentence_ids", F.transform("m", lambda x: x["name"]).alias("licenses"), "n_known",
        F.greatest(F.size(F.split(f"s{len(RULES)}", "<")) - 1, F.lit(0)).cast("bigint").alias("n_unmatched"), F.when(F.size("m") > 0, F.forall("m", lambda x: x["free"])).alias("permissive"),
    )


def license_sql() -> str:
    """The same scan in DuckDB's SQL: the whole text is flattened alike; each boundary is doubled, as patterns there can't look ahead."""
    texts = {text: name for name, text in (*SENTENCES, *NOTICES)}
    known = ", ".join(f"('{t}', '{n}')" for t, n in texts.items())
    number = "[0-9]+(_[0-9]+)?"
    listed = "|".join(" (?:[|] [|] )?".join("[0-9]+(?:_[0-9]+)?" if w == "<v>" else w for w in t.split()) for t in sorted(texts, key=lambda t: (-len(t.split()), t)))
    steps, last = [], "s"
    for i, (_, pattern, _) in enumerate(RULES):
        steps.append(f"r{i} AS (SELECT *, regexp_matches(seq{i}, '{pattern}') AS h{i}, regexp_replace(seq{i}, '{pattern}', '', 'g') AS seq{i + 1} FROM {last})")
        last = f"r{i}"
    hits = ", ".join(f"CASE WHEN h{i} THEN '{n}' END" for i, (n, _, _) in enumerate(RULES))
    strict = " OR ".join(f"h{i}" for i, (_, _, free) in enumerate(RULES) if not free)
    some = " OR ".join(f"h{i}" for i in range(len(RULES)))
    flat = "translate(lower(text), '|_', '  ')"
    for pattern, by in ((r"(?m)^[ \t]*(?:rem|dnl)\b", " "), (r"[.!?:;]+([ \t\r\n]|$)|[\r\n]+", r" | \1"), (r"([0-9]+)\.([0-9]+)", r"\1_\2"), (f"({number})", r" \1 "), (r"[^a-z0-9_|]+", " "), (r"([|] )+", "| ")):
        flat = f"regexp_replace({flat}, '{pattern}', '{by}', 'g')"
    return rf"""
WITH k(t, name) AS (VALUES {known}),
f AS (SELECT doc_id, replace('| ' || trim({flat}) || ' |', '|', '| |') AS flat FROM documents WHERE regexp_matches(text, '{MARKS.removeprefix("(?i)")}', 'i')),
m AS (SELECT doc_id, regexp_extract_all(flat, '[|] ({listed}) [|]', 1) AS found FROM f),
p AS (SELECT doc_id, replace(unnest(found), '| | ', '') AS words, generate_subscripts(found, 1) AS n FROM m),
i AS (SELECT doc_id, n, '<' || name || ':' || replace(regexp_extract(words, '({number})', 1), '_', '.') || '>' AS item FROM p JOIN k ON k.t = regexp_replace(words, '{number}', '<v>', 'g')),
s AS (SELECT d.doc_id, coalesce(string_agg(item, '' ORDER BY n), '') AS seq0, count(item) AS n_known FROM documents d LEFT JOIN i ON i.doc_id = d.doc_id GROUP BY d.doc_id),
{", ".join(steps)}
SELECT doc_id, replace(replace(replace(seq0, '><', ','), '<', ''), '>', '') AS sentence_ids, concat_ws(',', {hits}) AS licenses, n_known,
  CAST(length(seq{len(RULES)}) - length(replace(seq{len(RULES)}, '<', '')) AS BIGINT) AS n_unmatched, CASE WHEN {some} THEN NOT ({strict}) END AS permissive
FROM {last}
"""
