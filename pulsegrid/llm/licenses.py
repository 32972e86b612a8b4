"""License scans: canonical digests of entire texts, joined to the digests of known licences.

Canonical form of a text: A-Z lower-cased; lines that begin with a copyright notice removed; punctuation and white
space turned into single spaces; equivalent spellings unified; trimmed.  Two copies of a licence that differ in these
respects only have one SHA-256 digest.  The scan joins the digest of each entire text to the table of known digests.
A line of a text that holds the word stem ``licen`` is looked up in the same way as a text of its own, which finds the
one-line notices inside larger documents.

The canonical form depends on where lines break: a clause that goes on with "copyright holders" at the start of a line is
taken for a notice.  A text without a match is therefore looked up a second time by its unwrapped form, from which only
lines go that are a notice (a sign, year, name field or "by" follows) or a licence's title.  A notice that shares its line
with the licence takes the licence along.

Cases: a null text counts as empty; empty canonical forms match nothing.  Texts of any length are read whole.  Repeated rows are all returned.  Columns
beyond those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower

COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
#: A copyright notice, not a clause that has the word at the start of a line; "(c)" may also number a list.
NOTICE_LINE = (
    r"(^|\n)[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{:]|by[ \t])[^\n]*"
    r"|(?:\(c\)|©)[ \t]*(?:copyright|[0-9<\[{])[^\n]*|all rights reserved[ \t.\r]*(?=\n|$))"
)
TITLE_LINE = (
    r"(^|\n)[ \t*#/;=-]*(?:the[ \t]+)?(?:mit|mit/x11|x11|expat|isc|0bsd|bsd[ -]zero[ -]clause|zero[ -]clause[ -]bsd|bsd[ -][23][ -]clause|[23][ -]clause[ -]bsd)"
    r"[ \t]+licen[cs]e(?:[ \t]*\((?:mit|expat|isc|0bsd)\))?[ \t.:*#=\r-]*(?=\n|$)"
)
#: ASCII controls, space and punctuation; no-break space, typographic quotes, dashes and bullets.
PUNCTUATION = r"[\x01-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x{a0}\x{a9}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2022}]+"
#: Spellings that count as equal, as given by public licence-matching guidelines; applied in this order.
EQUIVALENT = [
    ("licence", "license"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("whilst", "while"),
    ("programme", "program"),
    (" per cent", " percent"),
]

#: Licence texts and the usual one-line notices.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

#: Further licences, looked up by their unwrapped form only; BSD's conditions also without numbers.
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
"""
_BSD_CONDITIONS = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE {} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _bsd(name: str, owner: str, holders: str, holder: str, numbers: tuple[str, str, str]) -> tuple[str, str]:
    names = numbers[2] + _BSD_NAMES.format(owner) if name == "BSD-3-Clause" else ""
    return name, _BSD_HEAD + numbers[0] + _BSD_CONDITIONS.format(numbers[1]) + names + _BSD_TAIL.format(holders, holder)


MORE = [
    _bsd(name, *owner, numbers)
    for name in ("BSD-2-Clause", "BSD-3-Clause")
    for owner in (("copyright holder", "copyright holders", "copyright holder"), ("copyright holder", "copyright holders", "copyright holders"), ("University", "Regents", "Regents"))
    for numbers in (("1. ", "2. ", "3. "), ("", "", ""))
]
#: Digests of the unwrapped forms of longer licences, from the texts in Debian's /usr/share/common-licenses.
WHOLE = {
    "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71": "GFDL-1.2-only",
    "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6": "GFDL-1.3-only",
    "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6": "GPL-1.0-only",
    "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1": "GPL-2.0-only",
    "df71f3c423c11bc52456a9775329f1d9a3168a6f071654750b9eb155fb3ec0eb": "GPL-3.0-only",
    "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d": "LGPL-2.0-only",
    "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f": "LGPL-2.1-only",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0-only",
    "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1": "MPL-1.1",
    "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d": "MPL-2.0",
}


def canonical(text: Column, left_out: tuple[str, ...] = (COPYRIGHT_LINE,)) -> Column:
    plain = reduce(lambda c, line: F.regexp_replace(c, line, "$1"), left_out, ascii_lower(F.coalesce(text, F.lit(""))))
    spaced = F.regexp_replace(plain, PUNCTUATION, " ")
    return F.trim(reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), EQUIVALENT, spaced))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def unwrapped_digest(text: Column) -> Column:
    return F.sha2(canonical(text, (NOTICE_LINE, TITLE_LINE)), 256)


#: Each built-in licence and notice has one of these.
STEMS = ("licen", "permission", "redistribution")


def may_be_known(text: Column, known: list[tuple[str, str]] = KNOWN) -> Column:
    """False only for texts that are surely none of the known ones; with a known text that has none of the stems always true."""
    if not all(any(stem in entry.lower() for stem in STEMS) for _, entry in known):
        return F.lit(True)
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(stem) for stem in STEMS))


def known_digests(spark, known=KNOWN) -> DataFrame:
    """digest, license_id: as many rows as ``known`` has entries, which bounds what is broadcast."""
    rows = spark.createDataFrame([(str(name), text) for name, text in known], "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def unwrapped_digests(spark, known=KNOWN) -> dict[str, str]:
    """Unwrapped digest -> identifier: as many entries as ``known``, ``MORE`` and ``WHOLE`` have."""
    rows = spark.createDataFrame([(str(name), text) for name, text in [*known, *MORE]], "license_id string, text string")
    rows = rows.where(canonical(F.col("text"), (NOTICE_LINE, TITLE_LINE)) != "").groupBy(unwrapped_digest(F.col("text")).alias("digest"))
    return WHOLE | {r["digest"]: r["license_id"] for r in rows.agg(F.min("license_id").alias("license_id")).collect()}


def scan_licenses(documents: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """documents: doc_id, text.  Returns doc_id, digest (canonical form), license_id (of the entire text, or null) and notices.

    notices: identifiers of licences whose text or notice is a line of its own, sorted, joined by commas; '' if none.
    """
    spark = documents.sparkSession
    lookup = known_digests(spark, known)
    of_line = F.create_map(*(F.lit(x) for row in lookup.collect() for x in (row["digest"], row["license_id"])))
    of_whole = F.create_map(*(F.lit(x) for pair in unwrapped_digests(spark, known).items() for x in pair))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: may_be_known(x, known))
    either = lambda x: F.coalesce(F.try_element_at(of_line, digest(x)), F.try_element_at(of_whole, unwrapped_digest(x)))
    found = F.filter(F.transform(lines, either), lambda x: x.isNotNull())
    return (
        documents.select(
            "doc_id", digest(F.col("text")).alias("digest"), F.when(may_be_known(F.col("text"), known), F.try_element_at(of_whole, unwrapped_digest(F.col("text")))).alias("whole"),
            F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"),
        )
        .join(F.broadcast(lookup), "digest", "left")
        .select("doc_id", "digest", F.coalesce("license_id", "whole").alias("license_id"), "notices")
    )
