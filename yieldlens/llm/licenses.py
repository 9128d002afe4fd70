"""License scans by canonical digest lookup (DataFrame functions only).

A text is brought to a canonical form: lower case, lines that state a copyright removed,
equivalent spellings replaced, ASCII signs turned to single blanks; the SHA-256 of that is the
answer's digest. Licences are found by a second, wider form: everything but letters and digits
of any script turned to blanks, more copyright lines and the postal addresses of the GNU texts
removed, replaceable names (BSD) made equal. Its SHA-256 is joined with the digests of the known
texts, with and without their usual titles and appendices, brought to that form by the same
expressions. Whole texts are compared, so a licence inside a longer document is no match.

The known texts are a parameter; the table of their digests is broadcast only up to
``MAX_KNOWN`` rows of a digest and a name (otherwise the join is left to the planner).

Edge cases: null texts count as empty; texts whose canonical form is empty match nothing;
two known texts of one canonical form answer with the smaller name; repeated rows match
alike; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

MAX_KNOWN = 100_000

#: lines that state a copyright (not those that only mention one, as wrapped licence texts do)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|[0-9]{4}|by\b)|\(c\)|©)[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"

# fixed values: equivalent spellings of the public licence matching guidelines
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("catalogue", "catalog"),
    ("cheque", "check"),
    ("colour", "color"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelling", "modeling"),
    ("normalise", "normalize"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
]

# fixed values: public licence texts and notices
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

#: further public licence texts, one file each
TEXTS = Path(__file__).parent / "license_texts"

# fixed values: titles above texts that do not hold their own
TITLES = {
    "MIT": ["MIT", "MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "License: MIT", "Expat License", "MIT/Expat License"],
    "ISC": ["ISC", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "License: ISC"],
    "0BSD": ["0BSD", "0BSD License", "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "BSD 0-Clause License"],
    "Zlib": ["zlib", "zlib License", "The zlib License", "zlib License (zlib)", "zlib/libpng License", "The zlib/libpng License", "The zlib/libpng License (Zlib)"],
    "BSD-2-Clause": ["BSD License", "The BSD License", "BSD 2-Clause License", "The BSD 2-Clause License", "2-Clause BSD License", "The 2-Clause BSD License", "Simplified BSD License", "FreeBSD License", 'BSD 2-Clause "Simplified" License', "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD License", "The BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", "3-Clause BSD License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD-3-Clause"],
    "Unlicense": ["Unlicense", "The Unlicense", "The Unlicense (Unlicense)", "UNLICENSE"],
}

# fixed values: (licence, usual wording, its variant)
VARIANTS = [
    ("MIT", "this permission notice shall", "this permission notice (including the next paragraph) shall"),
    ("ISC", "and/or distribute", "and distribute"),
    ("Unlicense", "For more information, please refer to <http://unlicense.org/>", ""),
    ("CC0-1.0", "Creative Commons Legal Code", ""),
]

#: lines after which a text is complete, whether its appendix follows or not
ENDINGS = ["END OF TERMS AND CONDITIONS", "Exhibit A - Source Code Form", "EXHIBIT A -Mozilla"]

#: further lines that state a copyright: with a placeholder, with a year after the name, alone in their paragraph
MORE_COPYRIGHT = r"(?m)^[^a-z0-9\n]*copyright(?:[^a-z0-9\n]*[<\[{][^\n]{0,200}|\b[^\n]{1,120}\b(?:19|20)[0-9]{2}\b[^\n]{0,120})$"
LONE_COPYRIGHT = r"(?:\A|\n[ \t]*\n)[^a-z0-9\n]*copyright\b[^\n]{1,120}(?=\n[ \t]*\n)"
ADDRESS = r"(?m)^[^a-z0-9\n]*(?:(?:foundation, inc\.,? +)?(?:51 franklin|59 temple|675 mass)[^\n]{0,120}|https?://(?:www\.)?fsf\.org[^a-z0-9\n]*)$"

# fixed values: passages of the wide form that hold replaceable names
NAMES = [
    (r"neither the names? of .{1,200}? nor the names of (?:its|any|their|the|other) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this software is provided by .{1,200}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"in no event shall .{1,200}? be liable for any direct", "in no event shall the copyright holder or contributors be liable for any direct"),
]


def canonical(text: Column) -> Column:
    """Canonical form of a licence text, for the digest."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, COPYRIGHT_LINE, " ")
    t = F.regexp_replace(t, r"[\x00-/:-`{-\x7f]+", " ")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(t)


def wide(text: Column) -> Column:
    """Wide form of a licence text, for the comparison."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?|[\x{2028}\x{2029}\x{85}]", "\n"), r"\x{ad}", "")
    for lines in (COPYRIGHT_LINE, MORE_COPYRIGHT, ADDRESS):
        t = F.regexp_replace(t, lines, " ")
    t = F.regexp_replace(t, LONE_COPYRIGHT, "\n\n")
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]+", " ")
    for old, new in [*SPELLINGS, ("https", "http")]:
        t = F.replace(t, F.lit(old), F.lit(new))
    for old, new in NAMES:
        t = F.regexp_replace(t, old, new)
    return F.trim(t)


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of every known text: as published, without appendix, in variants, below its titles."""
    texts = [*KNOWN.items(), *((f.stem, f.read_text()) for f in sorted(TEXTS.glob("*.txt")))]
    for name, text in list(texts):
        for end in ENDINGS:
            head, found, _ = text.partition(end)
            texts += [(name, head), (name, head + found)] if found and end.startswith("END") else [(name, head)] if found else []
    texts += [(name, text.replace(old, new)) for name, text in list(texts) for of, old, new in VARIANTS if of == name]
    return texts + [(name, f"{title}\n\n{text}") for name, text in texts for title in TITLES.get(name, [])]


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(form, license) of the known texts, one row per digest of the wide form."""
    texts = spark.createDataFrame(sorted(known), "license string, text string")
    form = texts.select("license", wide(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("form")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest (of the canonical text) and license (null: no known text) of every row."""
    known = known_texts() if known is None else list(known.items())
    digests = known_digests(docs.sparkSession, known)
    digests = F.broadcast(digests) if len(known) <= MAX_KNOWN else digests
    forms = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.sha2(wide(F.col("text")), 256).alias("form"))
    return forms.join(digests, "form", "left").select("doc_id", "digest", "license")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(col: str) -> str:
        t = f"regexp_replace(lower(coalesce({col}, '')), {q(COPYRIGHT_LINE)}, ' ', 'g')"
        t = f"regexp_replace({t}, '[\\x00-/:-`{{-\\x7f]+', ' ', 'g')"
        for old, new in SPELLINGS:
            t = f"replace({t}, {q(old)}, {q(new)})"
        return f"trim({t})"

    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in KNOWN.items())
    return f"""
WITH k AS (SELECT license, {canon('text')} AS form FROM (VALUES {rows}) t(license, text)),
kd AS (SELECT sha256(form) AS digest, min(license) AS license FROM k WHERE form <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({canon('text')}) AS digest FROM documents)
SELECT doc_id, d.digest, license FROM d LEFT JOIN kd ON d.digest = kd.digest"""


OP8_SQL = _sql()
