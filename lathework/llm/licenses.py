"""Licence scans: normalised sentences become identifiers of known licence sentences, and sequences of
identifiers are matched against ordered licence rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences of licence texts, notices and headers. Versions and years stand as #.
SENTENCES = {
    "apache_notice": "Licensed under the Apache License, Version #.#",
    "apache_use": "You may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-#.#",
    "apache_basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License",
    "mit_notice": "Released under the MIT License",
    "mit_licensed": "Licensed under the MIT License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "gpl_notice": "This work is licensed under the GNU General Public License, version #",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl_details": "See the GNU General Public License for more details",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version #.# of the License, or (at your option) any later version",
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl_details": "See the GNU Lesser General Public License for more details",
    "agpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version",
    "agpl_details": "See the GNU Affero General Public License for more details",
    "mpl_form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "fsf_verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "gpl_title": "GNU GENERAL PUBLIC LICENSE Version #, # June #",
    "lgpl_title": "GNU LESSER GENERAL PUBLIC LICENSE Version #, # June #",
    "agpl_title": "GNU AFFERO GENERAL PUBLIC LICENSE Version #, # November #",
    "apache_title": "Apache License Version #.#, January #",
    "mpl_title": "Mozilla Public License Version #.#",
    "cc_by": "Licensed under CC BY #.#",
    "cc_by_sa": "Licensed under CC BY-SA #.#",
    "cc_by_nc": "Licensed under CC BY-NC #.#",
    "cc_by_nd": "Licensed under CC BY-ND #.#",
    "rights_reserved": "All rights reserved",
}


#: Further forms in which headers have a known sentence.
FORMS = (
    ("apache_notice", "Licensed under the Apache License, Version #.# (the \"License\")"),
    ("bsd_name", "Neither the name of copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("lgpl_free", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version"),
    ("gpl_free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version # of the License, or (at your option) any later version"),
    ("lgpl_title", "GNU LESSER GENERAL PUBLIC LICENSE Version #.#, February #"),
    ("apache_copy", "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-#.#"),
)


@dataclass(frozen=True)
class Rule:
    """A licence is found where the sentences occur in this order, whatever stands between them, and those of `without` nowhere."""

    licence: str
    sentences: tuple[str, ...]
    without: tuple[str, ...] = ()


RULES = (
    Rule("Apache", ("apache_notice",)),
    Rule("Apache-header", ("apache_notice", "apache_use", "apache_copy", "apache_basis", "apache_see")),
    Rule("MIT", ("mit_notice",)),
    Rule("MIT", ("mit_licensed",)),
    Rule("MIT-text", ("mit_grant", "mit_condition")),
    Rule("GPL", ("gpl_notice",)),
    Rule("GPL-header", ("gpl_free", "gpl_hope", "gpl_details")),
    Rule("GPL-text", ("gpl_title", "fsf_verbatim")),
    Rule("LGPL-header", ("lgpl_free", "lgpl_hope", "lgpl_details")),
    Rule("LGPL-text", ("lgpl_title", "fsf_verbatim")),
    Rule("AGPL-header", ("agpl_free", "gpl_hope", "agpl_details")),
    Rule("AGPL-text", ("agpl_title", "fsf_verbatim")),
    Rule("Apache-text", ("apache_title",)),
    Rule("MPL", ("mpl_form",)),
    Rule("MPL-text", ("mpl_title",)),
    Rule("ISC-text", ("isc_grant",)),
    Rule("BSD-2-Clause-text", ("bsd_grant", "bsd_source", "bsd_binary"), without=("bsd_name",)),
    Rule("BSD-3-Clause-text", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    Rule("CC-BY", ("cc_by",)),
    Rule("CC-BY-SA", ("cc_by_sa",)),
    Rule("CC-BY-NC", ("cc_by_nc",)),
    Rule("CC-BY-ND", ("cc_by_nd",)),
    Rule("Proprietary", ("rights_reserved",)),
)
#: Sentences end at a line's end, and at a full stop, question or exclamation mark or colon before white space or the text's end.
ENDS = r"[.!?:;]+(?=[\x20\x09-\x0D]|$)|\n"
#: In scan() a line's end alone ends no sentence that goes on in the next line; a blank line does.
MARKS = ENDS.removesuffix(r"|\n")
#: Comment marks at a line's start.
COMMENT = r"(?md)^[\x20\t]*[#;:*%/!<>'\"-]+(?=[\x20\t\r\n]|$)"
#: Stands for an end mark or a blank line.
END = "\x01"
#: Only texts with one of these can hold a known sentence. Each is within one word, which no line break, blank or mark divides.
HINT = r"(?i)licen[sc]e|copyright|rights|redistribution|permission|warranty"


def normalised_text(sentence: str) -> str:
    """Of a string of ASCII characters: lower case, each number as #, everything else but a to z as one space."""
    return re.sub(r"[^a-z#]+", " ", re.sub(r"[0-9]+", "#", sentence.lower())).strip()


def marked(text) -> F.Column:
    """Lower case, each number as #, ends as END, single line breaks kept, everything else but a to z as one space."""
    text = F.regexp_replace(F.translate(F.lower(text), END, " "), COMMENT, "")
    text = F.regexp_replace(F.regexp_replace(text, MARKS, END), r"[0-9]+", "#")
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-z#\n\x01]+", " "), r"\x20?\n\x20?", "\n")
    text = F.concat(F.lit(END), F.regexp_replace(text, r"\n{2,}", END), F.lit(END))
    return F.regexp_replace(text, r"[\x20\n]*\x01[\x20\n\x01]*", END)


def pattern(sentence: str) -> str:
    """A known sentence in marked() text: lines may break between its words, and an end is met only where it has one itself."""
    parts = [normalised_text(x) for x in re.split(ENDS, sentence.replace("#", "0"))]
    return r"[\x20\n\x01]".join(x.replace(" ", r"[\x20\n]") for x in parts if x)


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES, forms=FORMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, sentence_ids (of its known sentences in order, comma-joined), licences (names of the
    rules that match, in order of name, comma-joined) and n_sentences (how many are known).

    A sentence stands between ends or line breaks. Its own lines may be wrapped and have comment marks before them.
    forms are further forms of those sentences. A rule matches if its sentences' first occurrences after one another exist. Null and empty texts have
    none. Repeated rows are scanned each; null ids stay. An empty table gives an empty result. The known
    sentences are a small constant of the plan; no row is shuffled. Other columns are not read.
    """
    listed = [*sentences.items(), *((name, s) for name, s in forms if name in sentences)]
    known = {normalised_text(s.replace("#", "0")): name for name, s in listed}
    unhinted = [s for s in known if not re.search(HINT, s)]
    if unhinted:
        raise ValueError(f"the hint misses {unhinted}")
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(HINT), text).alias("text"))
    any_known = r"(?<=[\x01\n])(" + "|".join(pattern(s) for _, s in listed) + r")(?=[\x01\n])"
    same = F.regexp_extract_all(marked(F.col("text")), F.lit(any_known), F.lit(1))
    found = F.transform(same, lambda s: F.element_at(names, F.translate(s, "\n" + END, "  ")))
    rows = rows.select("doc_id", F.coalesce(found, F.array().cast("array<string>")).alias("ids"))

    def matched(rule: Rule) -> F.Column:
        """Each sentence is looked for behind the last one found."""
        at = F.lit(0)
        for name in rule.sentences:
            place = F.array_position(F.slice("ids", F.greatest(at, F.lit(0)) + 1, F.size("ids")), name)
            at = F.when((at >= 0) & (place > 0), at + place).otherwise(-1).cast("int")
        return (at > 0) & ~F.arrays_overlap("ids", F.array(*map(F.lit, rule.without)).cast("array<string>"))

    licences = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(matched(r), F.lit(r.licence)) for r in rules)))))
    return rows.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licences, ",").alias("licences"), F.size("ids").cast("long").alias("n_sentences"))
