"""License scan by sentence rules.

A text is cut into sentences, each normalised sentence that is known becomes an identifier, and ordered rules are
matched against the sequence of identifiers. Everything is row-local: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialcc.llm.common import fresh, text_or_empty

# Known licence sentences, normalised (ASCII letters and digits in lower case, one space between words).
SENTENCES = {
    "released under the mit license": "mit_notice",
    "licensed under the mit license": "mit_notice",
    "this project is licensed under the mit license": "mit_notice",
    "the mit license": "mit_title",
    "mit license": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "licensed under the apache license version 2 0": "apache2_notice",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2_notice",
    "apache license version 2 0": "apache2_title",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_link",
    "this work is licensed under the gnu general public license version 3": "gpl3_notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_grant",
    "gnu general public license version 3": "gpl3_title",
    "gnu general public license version 2": "gpl2_title",
    "licensed under cc by nc 4 0": "ccbync4_notice",
    "licensed under cc by 4 0": "ccby4_notice",
    "licensed under cc by sa 4 0": "ccbysa4_notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4_notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4_notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4_notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_notice",
    "spdx license identifier mit": "mit_notice",
    "spdx license identifier apache 2 0": "apache2_notice",
    "spdx license identifier gpl 3 0 only": "gpl3_notice",
    "spdx license identifier gpl 3 0 or later": "gpl3_grant",
    "all rights reserved": "reserved_notice",
}

# Licences with their rules, tried in this order. A rule is a pattern over identifiers, each followed by
# one space; what a rule has matched is taken from the sequence before the next rule is tried.
RULES = [
    ("BSD-3-Clause", "bsd_grant bsd_source bsd_binary bsd_endorse "),
    ("BSD-2-Clause", "bsd_grant bsd_source bsd_binary "),
    ("MIT", "(?:mit_title )?mit_grant (?:mit_condition )?(?:mit_warranty )?"),
    ("MIT", "(?:mit_title )?mit_notice |mit_title "),
    ("Apache-2.0", "(?:apache2_title )?apache2_notice (?:apache2_link )?|apache2_title (?:apache2_link )?"),
    ("GPL-3.0", "(?:gpl3_title )?gpl3_notice |(?:gpl3_title )?gpl3_grant |gpl3_title "),
    ("GPL-2.0", "(?:gpl2_title )?gpl2_grant |gpl2_title "),
    ("CC-BY-NC-4.0", "ccbync4_notice "),
    ("CC-BY-SA-4.0", "ccbysa4_notice "),
    ("CC-BY-4.0", "ccby4_notice "),
    ("ISC", "isc_grant "),
    ("MPL-2.0", "mpl2_notice "),
    ("proprietary", "reserved_notice "),
]

#: Every known sentence has one of these words, whatever its case; a text without them needs no cutting.
KEYWORDS = "licen[sc]e|copyright|permission|redistribut|warrant|rights|spdx"
#: Where a sentence ends: marks followed by white space or the text's end. It may also begin and end with a line.
SENTENCE_END, STOP = r"[.!?]+(?=[\x20\x09-\x0D]|\z)", "\x01"
#: The point of a version ("v. 2.0") ends no sentence.
VERSION_POINT = r"([^A-Za-z0-9][Vv](?:er|ers)?)\.([\x20\x09-\x0D]+[0-9])"
#: What isn't of a wrapped sentence at a line's start, beside marks without letters and digits.
LIST_MARK = r"(?:\A|\n)[^A-Za-z0-9\n\x01]*(?:[0-9]{1,2}\)|[A-Za-z]\)|[ivxIVX]{2,4}\)|(?:dnl|rem|REM)[\x20\x09])"

assert all(re.search(KEYWORDS, s) for s in SENTENCES)


def _any_case(pattern: str) -> str:
    """The pattern with ASCII letters in either case, spelt out so that all engines agree."""
    return re.sub(r"\[(\w+)\]|([a-z])", lambda m: f"[{m[1]}{m[1].upper()}]" if m[1] else f"[{m[2]}{m[2].upper()}]", pattern)


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order, each followed by a space; unknown sentences give none.

    A sentence begins and ends at an end mark or a line's edge, and may run over several lines, with comment or list
    marks and blank lines between them. Of several that begin at one place the longest counts.
    """
    known = SENTENCES if sentences is None else sentences
    longest = sorted((k for k in known if re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", k)), key=len, reverse=True)
    if not longest:
        return F.lit("")
    # A line feed stays as a mark: a sentence may begin and end at it, and may run over it.
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, VERSION_POINT, "$1 $2"), SENTENCE_END, STOP), LIST_MARK, "\n")
    plain = F.lower(F.regexp_replace(F.regexp_replace(marked, f"[^A-Za-z0-9\n{STOP}]+", " "), " ?([\n\\x01])[\n ]*", "$1"))
    whole = rf"(?<=\A ?|[\n{STOP}])(?:" + "|".join(k.replace(" ", "[ \n]") for k in longest) + rf")(?= ?\z|[\n{STOP}])"
    found = F.transform(F.regexp_extract_all(plain, F.lit(whole), F.lit(0)), lambda s: F.translate(s, "\n", " "))
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ids = F.transform(found, lambda s: F.concat(F.element_at(lookup, s), F.lit(" ")))
    if not all(re.search(KEYWORDS, k) for k in longest):  # sentences of the caller's own
        return F.array_join(ids, "")
    return F.when(text.rlike(_any_case(KEYWORDS)), F.array_join(ids, "")).otherwise(F.lit(""))


def scan_licenses(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """The rows of `docs` with what their texts declare.

    Adds sentence_seq (identifiers in order), n_sentences, licenses (names in rule order, joined by a comma),
    n_licenses, primary_license (of the first rule that matched, null if none) and unclaimed (known sentences that no
    rule took). Null and empty texts have no sentences. Repeated rows are scanned each on its own. A column of `docs`
    with one of the added names is replaced.
    """
    seq, names, left = F.col("sentence_seq"), [], fresh(docs, "_left")
    df = docs.withColumn("sentence_seq", sentence_ids(text_or_empty(text), sentences)).withColumn(left, seq)
    # Each rule takes what it matches; `left` is what remains for the next.
    for i, (name, pattern) in enumerate(RULES if rules is None else rules):
        whole = rf"(?:^|(?<= ))(?:{pattern})"
        names.append(fresh(docs, f"_hit{i}"))
        df = df.withColumn(names[-1], F.when(F.col(left).rlike(whole), F.lit(name)))
        df = df.withColumn(left, F.when(F.col(names[-1]).isNotNull(), F.regexp_replace(left, whole, "- ")).otherwise(F.col(left)))
    found = F.array_distinct(F.array_compact(F.array(*names)))
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda x: (x != "") & (x != "-")))
    return (
        df.withColumn("licenses", F.array_join(found, ","))
        .withColumn("n_licenses", F.size(found).cast("int"))
        .withColumn("primary_license", F.get(found, F.lit(0)))
        .withColumn("n_sentences", words(seq).cast("int"))
        .withColumn("unclaimed", words(F.col(left)).cast("int"))
        .withColumn("sentence_seq", F.rtrim(seq))
        .drop(left, *names)
    )


COLUMNS = ["doc_id", "sentence_seq", "n_sentences", "licenses", "n_licenses", "primary_license", "unclaimed"]


def oracle() -> str:
    """DuckDB SQL of the query, for texts whose known sentences are not wrapped."""
    ids = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
    known = ", ".join(f"'{k}'" for k in SENTENCES)
    ctes, at = [], "s0"
    for i, (name, pattern) in enumerate(RULES):
        whole = f"(^| )({pattern})"
        ctes.append(
            f"s{i + 1} AS (SELECT * REPLACE (CASE WHEN regexp_matches(rest, '{whole}') THEN regexp_replace(rest, '{whole}', '\\1- ', 'g') ELSE rest END AS rest), "
            f"CASE WHEN regexp_matches(rest, '{whole}') THEN '{name}' END AS h{i} FROM {at})"
        )
        at = f"s{i + 1}"
    hits = ", ".join(f"h{i}" for i in range(len(RULES)))
    distinct = f"list_filter([{hits}], lambda x, i: x IS NOT NULL AND list_position([{hits}], x) = i)"
    return rf"""
WITH cut AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '{_any_case(KEYWORDS)}')
    THEN string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{VERSION_POINT}', '\1 \2', 'g'), '[.!?]+([\x20\x09-\x0D]|\z)|\n', chr(10), 'g'), chr(10)) ELSE [] END AS cut FROM documents),
plain AS (SELECT doc_id, list_transform(cut, lambda s: trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g')))) AS p FROM cut),
found AS (SELECT doc_id, list_transform(list_filter(p, lambda s: s IN ({known})), lambda s: ({ids})[s]) AS f FROM plain),
s0 AS (SELECT doc_id, coalesce(array_to_string(f, ' '), '') AS sentence_seq, len(f)::INT AS n_sentences,
  CASE WHEN len(f) = 0 THEN '' ELSE array_to_string(f, ' ') || ' ' END AS rest FROM found),
{", ".join(ctes)}
SELECT doc_id, sentence_seq, n_sentences, coalesce(array_to_string({distinct}, ','), '') AS licenses, len({distinct})::INT AS n_licenses,
  ({distinct})[1] AS primary_license, len(list_filter(string_split(rest, ' '), lambda x: x <> '' AND x <> '-'))::INT AS unclaimed FROM {at}
"""
