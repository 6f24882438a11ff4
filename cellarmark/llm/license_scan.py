"""Licence scan by canonical digests of entire texts.

A text is brought to a canonical form (lower case, no copyright lines, words only, equivalent spellings made one), its
SHA-256 is looked up by a hash join among the digests of known licences. Single lines are looked up in the same
way among known notices. The join carries ids and digests only, never texts.

Defined cases: null text counts as empty; an empty canonical form matches no licence; repeated rows are reported each, notices
are those of all rows with the same doc id; null ids are kept without notices; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.llm.common import table, text_or_empty

# Spellings that count as the same word (the second is kept).
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("licencee", "licensee"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

# Licence texts as published.
LICENCES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

# One-line notices. Each holds a form of the word license, which lets a scan pass over other lines.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
}
NOTICE_MARK = "licen"

COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|\(c\)|©|<year>|\[year\])[^\n]*$"
RESERVED_LINE = r"^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"


VARIANT = " (?:" + "|".join(variant for variant, _ in SPELLINGS) + ") "


def words_only(text: Column) -> Column:
    """Lower-cased words, each between two spaces of its own, without copyright lines."""
    lowered = F.lower(text)
    without = F.regexp_replace(F.regexp_replace(lowered, "(?dm)" + COPYRIGHT_LINE, ""), "(?dm)" + RESERVED_LINE, "")
    return F.concat(F.lit(" "), F.regexp_replace(without, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def respelled(words: Column) -> Column:
    """One spelling of each word; texts that hold no variant are left alone."""
    changed = words
    for variant, kept in SPELLINGS:
        changed = F.replace(changed, F.lit(f" {variant} "), F.lit(f" {kept} "))
    return F.when(words.rlike(VARIANT), changed).otherwise(words)


def with_digest(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the SHA-256 of the canonical form in place of the text; the steps are columns, so none is evaluated twice."""
    spelled = rows.withColumn("_words", words_only(F.col(text))).drop(text).withColumn("_spelled", respelled(F.col("_words"))).drop("_words")
    return spelled.withColumn("digest", F.sha2(F.trim(F.regexp_replace("_spelled", " +", " ")), 256)).drop("_spelled")


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """name, digest of a list of (name, text)."""
    return with_digest(spark.createDataFrame(texts, "name string, known string"), "known")


def scan(docs: DataFrame, licences: DataFrame, notices: DataFrame, notice_mark: str = NOTICE_MARK) -> DataFrame:
    """doc_id, digest, licence (null: none), notices (names, sorted), n_notices (lines that are known notices)."""
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    whole = with_digest(texts, "text").join(licences.select("digest", F.col("name").alias("licence")), "digest", "left")
    lines = texts.filter(F.lower("text").contains(notice_mark)).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = with_digest(lines.filter(F.lower("line").contains(notice_mark)), "line")
    found = lines.join(notices, "digest").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices"), F.count("*").alias("n_notices"))
    return whole.join(found, "doc_id", "left").select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"))


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    licences = known_digests(spark, list(LICENCES.items()))
    notices = known_digests(spark, [(name, line) for name, lines in NOTICES.items() for line in lines])
    return scan(table(spark, sf_dir, "documents"), licences, notices)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({text}), {_quoted('(?m)' + COPYRIGHT_LINE)}, '', 'g'), {_quoted('(?m)' + RESERVED_LINE)}, '', 'g')"
    spaced = rf"' ' || regexp_replace({plain}, '[^\p{{L}}\p{{N}}]+', '  ', 'g') || ' '"
    for variant, kept in SPELLINGS:
        spaced = f"replace({spaced}, ' {variant} ', ' {kept} ')"
    return f"trim(regexp_replace({spaced}, ' +', ' ', 'g'))"


def _digest_sql(text: str) -> str:
    return f"sha256({_canonical_sql(text)})"


OP4_SQL = f"""
WITH licences AS (SELECT name, {_digest_sql("known")} AS digest FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in LICENCES.items())}) v(name, known)),
notices AS (SELECT name, {_digest_sql("known")} AS digest FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, lines in NOTICES.items() for t in lines)}) v(name, known)),
whole AS (SELECT doc_id, {_digest_sql("coalesce(text, '')")} AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE lower(text) LIKE '%{NOTICE_MARK}%'),
digests AS (SELECT doc_id, {_digest_sql("line")} AS digest FROM lines WHERE lower(line) LIKE '%{NOTICE_MARK}%'),
found AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(*) AS n_notices FROM digests JOIN notices USING (digest) GROUP BY 1)
SELECT w.doc_id, w.digest, l.name AS licence, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices
FROM whole w LEFT JOIN licences l ON l.digest = w.digest LEFT JOIN found f ON f.doc_id = w.doc_id
"""
