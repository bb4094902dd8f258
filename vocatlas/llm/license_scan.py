"""License scans by canonical digest, in DataFrame functions only.

A text's canonical form drops copyright lines, lower-cases A-Z, writes
equivalent spellings one way, word by word, and turns every run of other
characters than letters and digits into one space. Of a copyright line that goes
on with the terms only the notice is dropped. The sha256 of an entire canonical text is
joined, as a hash join, to the digests of known license texts, so a copy that
differs in case, punctuation, line breaks, holder, year or spelling is found
and a text that merely mentions a license is not.

The catalogue holds license notices and short licenses in full, and of long
licenses the digests of their canonical texts; its size is
fixed here (or checked against ``MAX_CATALOGUE`` where a caller gives one
before it is broadcast; a larger one is joined by shuffle).

Defined results: null and empty texts have the digest of the empty text and no
license. A digest that several catalogue rows share gives the least license
id, so that documents are never repeated. Repeated rows are scanned each; an
empty catalogue leaves every license null. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatlas.llm.base import ascii_lower, table

MAX_CATALOGUE = 10_000

#: Spellings taken as equivalent, as whole words of the canonical text.
EQUIVALENT = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("sub license", "sublicense"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("recognised", "recognized"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("whilst", "while"),
    ("https", "http"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Fixed values: (license id, text).
CATALOGUE = (
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License " + _ISC),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAME} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_HEAD} {_BSD_NAME} {_BSD_TAIL}"),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Fixed values: (license id, sha256 of the canonical form of the license's full text as its publisher gives it).
DIGESTS = (
    ("Apache-2.0", "4bc3c949c895ead14c0dc8c6e33fd6ed118359acaad7c084c4d563cd526a878d"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)

#: Where the terms begin on a line that a copyright notice opens, in lower case.
_TERMS = r"(?m)^([^\n\p{L}\p{N}]*(?:copyright|\(c\)|©)[^\n]*?[^\n\p{L}\p{N}])(permission (?:is|to)|redistribution and|released under|licensed under|distributed under|this (?:software|work|program|library|file|code) )"
#: A line that names a holder or a year, in lower case, after its flags.
_COPYRIGHT = r"^[^\n\p{L}\p{N}]*(?:copyright[^\n]*(?:[0-9]{4}|\(c\)|©)|copyright (?:the|by) (?:[^\n,;.]* )?(?:authors|contributors|developers|foundation|project|team)\b|\(c\)|©|all rights reserved)[^\n]*$"
_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form: words with single spaces between them."""
    t = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "(?d)" + _TERMS, "$1\n$2")
    t = F.regexp_replace(t, "(?md)" + _COPYRIGHT, "")
    # Every word has a space of its own on both sides, so that neighbours are replaced alike.
    t = F.concat(F.lit(" "), F.regexp_replace(t, _OTHER, "  "), F.lit(" "))
    for old, new in EQUIVALENT:
        t = F.replace(t, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return F.btrim(F.replace(t, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def catalogue_frame(spark: SparkSession, catalogue=CATALOGUE, digests=DIGESTS) -> DataFrame:
    """license_id with the text, or canonical_sha256, of known licenses, without Python on the executors."""
    null = F.lit(None).cast("string")
    rows = [(F.lit(k), F.lit(v), null) for k, v in catalogue] + [(F.lit(k), null, F.lit(v)) for k, v in digests]
    rows = F.array(*(F.struct(k.alias("license_id"), t.alias("text"), d.alias("canonical_sha256")) for k, t, d in rows))
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, catalogue: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_CATALOGUE) -> DataFrame:
    """``id_col``, canonical_sha256, license_id (null: none known). ``catalogue``:
    license_id, text and, where it has the column, canonical_sha256 in place of a text."""
    given = [F.col("canonical_sha256")] if "canonical_sha256" in catalogue.columns else []
    known = catalogue.select(F.coalesce(*given, digest(F.col("text"))).alias("canonical_sha256"), "license_id").where(F.col("canonical_sha256") != F.sha2(F.lit(""), 256))
    known = known.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    if known.limit(bound + 1).count() <= bound:
        known = F.broadcast(known)
    return docs.select(id_col, digest(F.col(text_col)).alias("canonical_sha256")).join(known, "canonical_sha256", "left").select(id_col, "canonical_sha256", "license_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every whole document, and the license that it is."""
    return scan(table(spark, sf_dir, "documents"), catalogue_frame(spark))


def _sql(text: str) -> str:
    t = rf"regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}', E'\\1\n\\2', 'g')"
    t = rf"regexp_replace({t}, '(?m){_COPYRIGHT}', '', 'g')"
    t = rf"' ' || regexp_replace({t}, '{_OTHER}', '  ', 'g') || ' '"
    for old, new in EQUIVALENT:
        t = f"replace({t}, ' {old.replace(' ', '  ')} ', ' {new} ')"
    return f"sha256(trim(replace({t}, '  ', ' ')))"


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL = {
    "op5_license_scan": f"""
WITH known AS (
  SELECT canonical_sha256, min(k) AS license_id FROM (
    SELECT {_sql('v')} AS canonical_sha256, k FROM (VALUES {', '.join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in CATALOGUE)}) AS t(k, v)
    UNION ALL VALUES {', '.join(f"('{v}', '{k}')" for k, v in DIGESTS)}) GROUP BY 1),
d AS (SELECT doc_id, {_sql("coalesce(text, '')")} AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN known USING (canonical_sha256)
"""
}
