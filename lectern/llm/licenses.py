"""License scans: sentences map to known licence-sentence identifiers, identifier sequences match ordered rules.

Built-in functions only.  A text without any of the cue words cannot hold a known sentence and is not split.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

# fixed values: normalised licence sentences and their identifiers
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "licensed under the apache license version 2 0 the license": "apache-2-header",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2-see",
    "this work is licensed under the gnu general public license version 2": "gpl-2-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-terms",
    "either version 2 of the license or at your option any later version": "version-2-or-later",
    "either version 2 1 of the license or at your option any later version": "version-2-1-or-later",
    "either version 3 of the license or at your option any later version": "version-3-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-header",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-obtain",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "boost software license version 1 0 august 17th 2003": "bsl-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4-notice",
    "all rights reserved": "reserved",
}
# fixed values: each licence's rules, any of which is enough; a rule's identifiers follow each other, others may stand between
RULES = {
    "AGPL-3.0": [["agpl-3-terms"]],
    "Apache-2.0": [["apache-2-notice"], ["apache-2-header", "apache-2-compliance", "apache-2-as-is", "apache-2-see"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]],
    "BSL-1.0": [["bsl-title"]],
    "CC-BY-4.0": [["cc-by-4-notice"]],
    "CC-BY-NC-4.0": [["cc-by-nc-4-notice"]],
    "CC-BY-NC-ND-4.0": [["cc-by-nc-nd-4-notice"]],
    "CC-BY-SA-4.0": [["cc-by-sa-4-notice"]],
    "EPL-2.0": [["epl-2-notice"]],
    "GPL-2.0": [["gpl-2-notice"], ["gpl-2-terms", "gpl-hope"], ["gpl-terms", "version-2-or-later", "gpl-hope"]],
    "GPL-3.0": [["gpl-3-notice"], ["gpl-3-terms", "gpl-hope"], ["gpl-terms", "version-3-or-later", "gpl-hope"]],
    "ISC": [["isc-grant", "isc-warranty"]],
    "LGPL-2.1": [["lgpl-terms", "version-2-1-or-later", "gpl-hope"]],
    "LGPL-3.0": [["lgpl-3-terms", "gpl-hope"], ["lgpl-terms", "version-3-or-later", "gpl-hope"]],
    "MIT": [["mit-notice"], ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]],
    "MPL-2.0": [["mpl-header", "mpl-2-obtain"]],
    "Proprietary": [["reserved"]],
    "Unlicense": [["unlicense-domain", "unlicense-free"]],
    "Zlib": [["zlib-as-is", "zlib-liability", "zlib-grant"]],
}
# identifier lines name a licence by itself; those of the GNU family also come with what later versions are allowed
SPDX = "spdx license identifier "
for _name in [n for n in RULES if n != "Proprietary"]:
    for _suffix in ("", " only", " or later") if "GPL" in _name else ("",):
        SENTENCES[SPDX + _name.lower().replace("-", " ").replace(".", " ") + _suffix] = f"spdx-{_name.lower()}"
    RULES[_name].append([f"spdx-{_name.lower()}"])
#: A longer rule that holds a shorter one speaks for it.
COVERS = {"BSD-3-Clause": "BSD-2-Clause"}
#: Parts of single words, at least one in each known sentence, so that no blank or line end between words can hide one.
CUES = ("licen", "permission", "copyright", "redistribut", "warrant", "liab", "software", "reserved", "mozilla")


def rule_pattern(rule: list[str]) -> str:
    """A regular expression over ``|id|id|...|`` for the rule's identifiers in order.

    Each is taken where it comes first and never given back, which loses no match and takes one pass over the text.
    """
    return "^" + "".join(rf"(?>.*?\|{i.replace('.', '\\.')}(?=\|))" for i in rule)


def sentence_text(text: Column) -> Column:
    """Normalised words with single spaces between; ``Z`` stands at sentence ends and blank lines, a line end at others.

    Lower-case text has no capital of its own.  Marks at the front of a line (as of comments) go first, so that a ``;``
    among them ends no sentence and a line of nothing else is blank.
    """
    low = F.replace(F.lower(text), F.lit("spdx-license-identifier:"), F.lit("spdx-license-identifier"))
    low = F.regexp_replace(low, "\n[^a-z0-9\n]+", "\n")
    ended = F.regexp_replace(F.regexp_replace(low, "\n\n+", "Z"), r"[.!?;:](?:[ \t\r]+|(?=[\nZ]))", "Z")
    ended = F.regexp_replace(ended, "\n*Z[\nZ]*", "Z")
    plain = F.regexp_replace(F.regexp_replace(ended, "[^a-z0-9\nZ]+", " "), " ?([\nZ]) ?", "$1")
    return F.concat(F.lit("Z"), F.trim(plain), F.lit("Z"))


def sentence_pattern() -> str:
    """Any known sentence, from the start of a line or sentence to the end of one, over any line ends between.

    Shorter ones come first: one that fills its lines counts as itself, whatever the next line would add to it.
    """
    return "(?<=[\nZ])(?:" + "|".join(k.replace(" ", "[ \n]") for k in sorted(SENTENCES, key=len)) + ")(?=[\nZ])"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licences named or quoted in every whole text: doc_id, licenses (sorted, comma-joined), n_sentences, sentence_ids.

    A sentence may run over several lines, as licence texts ship, also behind comment marks; a blank line ends it.  Null
    and empty texts have none.  Rows that repeat a doc_id are scanned each.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SENTENCES.items()))
    low = F.lower("text")
    cue = F.lit(False)
    for word in CUES:
        cue = cue | F.contains(low, F.lit(word))
    quoted = F.regexp_extract_all(sentence_text(F.col("text")), F.lit(sentence_pattern()), F.lit(0))
    ids = F.transform(quoted, lambda s: known[F.translate(s, "\n", " ")])
    found = only(docs, "doc_id", "text").select("doc_id", F.when(cue, ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    found = found.select("doc_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    sequence = F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))

    def holds(name: str) -> Column:
        out = F.lit(False)
        for rule in RULES[name]:
            out = out | F.col("sequence").rlike(rule_pattern(rule))
        return out

    marks = [F.when(holds(n) & ~(holds(next(k for k, v in COVERS.items() if v == n)) if n in COVERS.values() else F.lit(False)), F.lit(n)) for n in sorted(RULES)]
    return found.withColumn("sequence", sequence).select(
        "doc_id",
        F.when(F.size("ids") > 0, F.concat_ws(",", *marks)).otherwise("").alias("licenses"),
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
    )
