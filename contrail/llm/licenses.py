"""License scans by canonical digest.

A text is cut into lines. A line's canonical form is lower case; a copyright line (one that begins, after marks, with
``copyright``, ``(c)``, the sign, or ``all rights reserved``) is empty; runs of other marks than letters and digits
become one space; equivalent spellings become one. A text's canonical form is its lines' forms, empty ones left out,
joined by a space. Its SHA-256 is looked up, whole, among the digests of known licenses and notices, by a hash join;
so is that of each line that is not the whole text.

Known are the full texts below ``known_licenses`` (``X~2`` is another wording of license X that is in wide use), the
usual one-line notices and the SPDX identifier line of every license in ``NAMES``. A notice over several lines is known
as a text of its own only. The known texts are few (``KNOWN``, and what a caller adds up to ``MOST_KNOWN``), so their digests are broadcast and
documents are not shuffled. Null and empty texts, and lines without a letter or digit, match nothing. Every row of the
documents gives its own hits, also when rows repeat. Extra columns are not looked at.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_KNOWN = 10_000

# Words that licenses spell in two ways, after punctuation is gone.
SPELLINGS = {
    "licence": "license",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
    "copyright owner": "copyright holder",
    "per cent": "percent",
    "organisation": "organization",
    "authorised": "authorized",
    "favour": "favor",
    "https ": "http ",
}

# License texts and notices by name.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
    " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
    " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
    " Software is furnished to do so"
)
_AS_IS_MIT = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES"
    " OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE"
    " LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR"
    " IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
    " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
    " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,"
    " NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = {
    "MIT": f"MIT License\n\n{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice"
    f" shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS_MIT}",
    "MIT-0": f"MIT No Attribution\n\n{_PERMISSION}.\n\n{_AS_IS_MIT}",
    "ISC": f"ISC License\n\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AS_IS_ISC}",
    "0BSD": f"BSD Zero Clause License\n\n{_ISC}.\n\n{_AS_IS_ISC}",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "BSD-notice": "Licensed under the BSD License.",
}
# What notices call a license.
NAMES = {
    "0BSD": ("the BSD Zero Clause License",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL-3.0"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache-2.0"),
    "Artistic-1.0-Perl": ("the Artistic License",),
    "Artistic-2.0": ("the Artistic License 2.0",),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License"),
    "BlueOak-1.0.0": ("the Blue Oak Model License 1.0.0",),
    **{
        f"CC-BY{code}-{version}": (f"CC BY{code} {version}", f"Creative Commons Attribution{name} {version}", f"a Creative Commons Attribution{name} {version} International License")
        for version in ("4.0", "3.0")
        for code, name in (("", ""), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC", "-NonCommercial"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
    },
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal"),
    "EPL-1.0": ("the Eclipse Public License 1.0",),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License v2.0"),
    "GFDL-1.2": ("the GNU Free Documentation License, version 1.2",),
    "GFDL-1.3": ("the GNU Free Documentation License, version 1.3",),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "GPL-3.0", "GPLv3"),
    "ISC": ("the ISC License",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "LGPL-3.0"),
    "MIT": ("the MIT License", "MIT"),
    "MIT-0": ("the MIT No Attribution License",),
    "MPL-1.1": ("the Mozilla Public License, version 1.1", "the Mozilla Public License 1.1"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "Unicode-3.0": ("the Unicode License v3",),
    "Unlicense": ("the Unlicense",),
    "Zlib": ("the zlib License",),
}
_SAYINGS = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "This project is licensed under {}.", "Distributed under {}.")
_OR_LATER = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3")
_HEADERS = {
    "Apache-2.0-header~2": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
    " this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-2.0-header~2": "This Source Code Form is subject to the terms of the Mozilla Public",
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"
    " https://www.boost.org/LICENSE_1_0.txt)",
    **{
        f"{code}-{version}-or-later-header": f"This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by"
        f" the Free Software Foundation, either version {version.removesuffix('.0')} of the License, or (at your option) any later version."
        for code, what, name in (("GPL", "program", "General Public License"), ("LGPL", "library", "Lesser General Public License"), ("AGPL", "program", "Affero General Public License"))
        for version, colon in (("3.0", ":"), ("2.1" if code == "LGPL" else "2.0", ";"))
        if (code, version) != ("AGPL", "2.0")
    },
}


def _fill() -> None:
    """Full texts, notices, headers and identifiers into ``KNOWN``, none of them twice."""
    for file in sorted(files(__package__).joinpath("known_licenses").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            KNOWN[file.name.removesuffix(".txt")] = file.read_text(encoding="utf-8")
    KNOWN.update(_HEADERS)
    given = {text.lower() for text in KNOWN.values()}
    for code, names in NAMES.items():
        texts = [saying.format(name) for name in names for saying in _SAYINGS]
        texts += [f"SPDX-License-Identifier: {code}{end}" for end in ("", "-only", "-or-later") if not end or code in _OR_LATER]
        k = 1 + (f"{code}-notice" in KNOWN)
        for text in texts:
            if text.lower() not in given:
                given.add(text.lower())
                KNOWN[f"{code}-notice~{k}" if k > 1 else f"{code}-notice"] = text
                k += 1


_fill()

# A line is a copyright notice by how it begins, unless it goes on as the running text of a license does where a line
# happens to break before "copyright". Neither pattern looks ahead, so both engines read them alike.
_NOTICE = "^[^a-z0-9]*(copyright([^a-z0-9].*)?|\\(c\\)[^a-z0-9]*[0-9]{4}.*|©.*|all rights reserved.*)$"
_RUNNING = (
    "^[^a-z0-9]*copyright([^a-z0-9]*$|[^a-z0-9]+((holder|notice|owner|law|licen[cs]e|interest|statement|disclaimer|doctrine)s?|ownership|and|or|patent"
    "|the (software|library|program)|resulting|line|permission|of|on|in|is|are|if|to|those|treaty)([^a-z0-9].*)?$)"
)
_MARKS = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"


def canonical_line(line: Column) -> Column:
    lower = F.lower(line)
    kept = F.when(lower.rlike(_NOTICE) & ~lower.rlike(_RUNNING), "").otherwise(lower)
    return F.trim(F.regexp_replace(kept, _MARKS, " "))


def spelled(text: Column) -> Column:
    """Equivalent spellings made one; after lines are joined, as a phrase may go over a line's end."""
    for other, one in SPELLINGS.items():
        text = F.replace(text, F.lit(other), F.lit(one))
    return text


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line)


def whole(lines: Column) -> Column:
    return spelled(F.concat_ws(" ", F.filter(lines, lambda x: x != "")))


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """A row per hit: doc_id, license_id, line (null: the whole text; else counted from 1), digest."""
    known = KNOWN if known is None else known
    if len(known) > MOST_KNOWN:
        raise ValueError(f"at most {MOST_KNOWN} known texts are broadcast")
    texts = docs.sparkSession.createDataFrame(list(known.items()), "license_id string, text string")
    table = texts.select(F.sha2(whole(canonical_lines(F.col("text"))), 256).alias("digest"), "license_id")
    units = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines")).select("doc_id", "lines", F.posexplode(F.concat(F.array(whole(F.col("lines"))), F.transform("lines", spelled))).alias("line", "unit"))
    units = units.where((F.col("unit") != "") & ((F.col("line") == 0) | (F.size("lines") > 1)))
    hits = units.select("doc_id", "line", F.sha2("unit", 256).alias("digest")).join(F.broadcast(table), "digest")
    return hits.select("doc_id", "license_id", F.expr("nullif(line, 0)").cast("long").alias("line"), "digest")


def oracle(known: dict[str, str] | None = None) -> str:
    """The same in DuckDB SQL over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = "lower(x)"
    notice = f"regexp_matches({low}, {quote(_NOTICE)}) AND NOT regexp_matches({low}, {quote(_RUNNING)})"
    line = f"trim(regexp_replace(CASE WHEN {notice} THEN '' ELSE {low} END, {quote(_MARKS)}, ' ', 'g'))"

    def one_spelling(text: str) -> str:
        for other, one in SPELLINGS.items():
            text = f"replace({text}, {quote(other)}, {quote(one)})"
        return text

    lines = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {line})"
    whole_ = one_spelling("array_to_string(list_filter(lines, lambda x: x <> ''), ' ')")
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in (KNOWN if known is None else known).items())
    return f"""
    WITH known AS (SELECT license_id, sha256({whole_}) AS digest
        FROM (SELECT license_id, {lines} AS lines FROM (VALUES {rows}) AS v(license_id, text))),
    d AS (SELECT doc_id, {lines} AS lines FROM documents),
    u AS (SELECT doc_id, 0 AS line, {whole_} AS unit FROM d
        UNION ALL SELECT doc_id, line, {one_spelling('lines[line]')} FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line FROM d WHERE len(lines) > 1))
    SELECT doc_id, license_id, nullif(line, 0)::BIGINT AS line, digest
    FROM (SELECT doc_id, line, sha256(unit) AS digest FROM u WHERE unit <> '') JOIN known USING (digest)
    """
