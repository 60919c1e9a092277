"""License scans by canonical digest: whole units of text against digests of known licence texts.

A unit is a whole document, and each line of it that is not blank: a licence notice mostly stands on a
line of its own. Canonical form: lower case; copyright statements and "all rights reserved" go; everything but
letters and digits (line breaks and comment leaders, too) becomes one space; equivalent spellings become one, and
so does the holder that a licence names in its text. Its SHA-256 is hash-joined with the digests of the known texts.
There is no partial match: a unit equals a known text or it does not.

A copyright statement is "copyright", "(c)" or the sign with a year or a place for one, or "copyright (c)", and the
holder behind it: up to the words with which a licence begins, on the same or the next line, else up to the end of the
line. Other uses of these words ("(c) You must ...", "copyright notice") stay, wherever a line begins.

A line that a third of all rows hold counts once in each document and is never gathered; the known texts
are broadcast only if their number is small.

Defined results:
- null, empty and blank texts have no unit: license null, no licence line.
- known texts with equal digests: the smallest name counts. Null known texts or names are ignored.
- line breaks and comment leaders of punctuation do not count in whole texts; a line is a unit by itself.
- repeated rows have equal results; null ids are kept. Empty tables: no rows, or no licence.
- texts are taken whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import small

# Known notices; full texts are in license_texts/, a file a license.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
)
# Spellings that count as equal, applied in this order to canonical text between spaces.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("creative commons", "cc"), ("attribution", "by"),
    ("noncommercial", "nc"), ("sharealike", "sa"), ("v 2 0", "version 2 0"), ("v2 0", "version 2 0"), ("v2", "version 2"), ("v3", "version 3"),
)
TEXTS = Path(__file__).parent / "license_texts"
END = "END OF TERMS AND CONDITIONS"
# Words with which a licence or notice begins behind a copyright statement, and words of no effect.
OPENINGS = (
    "all rights reserved", "permission is hereby", "permission to use", "redistribution and use",
    "licensed under", "released under", "this work is", "this program is", "this program comes", "gnomovision comes", "this file is", "this software is", "this source code",
)
DOCUMENT_OPENING = "everyone is permitted to copy"  # behind holders with an address of some lines
IDLE = "all rights reserved"
# Patterns that Java and RE2 read alike, on lower-cased text.
YEAR = r"(?:[0-9]{4}|[<\[{](?:year|yyyy)[^>\]}\n]*[>\]}]|19yy)"
SIGNS = ("copyright", "(c)", "©", "&copy;")  # one of them is in all that MARK matches
SIGN = r"(?:\(c\)|©|&copy;)"
MARK = rf"(?:copyright[\s:]*{SIGN}|copyright[\s:]*{YEAR}|{SIGN}[\s]*(?:copyright[\s]*)?{YEAR})"
_words = lambda *phrases: "|".join(p.replace(" ", "[^a-z0-9]+") for p in phrases)
# Between the mark and an opening: some of its line, and the start of the next one or a place for a holder, which may be broken.
BETWEEN = r"[^\n]{0,200}?(?:\n[^\n]{0,80}?|<[^<>\n]*(?:\n[^<>\n]*)?>\s*)?"
TO_OPENING = rf"{MARK}(?:[\s\S]{{0,200}}?\b({_words(DOCUMENT_OPENING)})|{BETWEEN}\b({_words(*OPENINGS)}))"
TO_LINE_END = rf"{MARK}[^\n]*"
HOLDER = r"(neither the name of) .{1,120}? (nor the names of)"


def canonical(text: Column) -> Column:
    """The canonical form; '' for null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    marked = F.lit(False)
    for sign in SIGNS:  # most texts have none, and need no pattern
        marked |= F.contains(t, F.lit(sign))
    t = F.when(marked, F.regexp_replace(F.regexp_replace(t, TO_OPENING, "$1$2"), TO_LINE_END, " ")).otherwise(t)
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    t = F.replace(t, F.lit(f" {IDLE} "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    t = F.trim(t)
    return F.when(F.contains(t, F.lit("neither the name of")), F.regexp_replace(t, HOLDER, "$1 the copyright holder $2")).otherwise(t)


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of the full texts: as they are, without a title line, and without what follows the terms."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text("utf-8")
        title, rest = text.split("\n\n", 1)
        forms = [text] if "\n" in title.strip() else [text, rest]
        forms += [f[: f.index(END) + len(END)] for f in forms if END in f]
        out += [(path.stem, f) for f in forms]
    return out


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest, license of the known texts (license, text); one row a digest."""
    if known is None:
        known = spark.createDataFrame([*KNOWN, *full_texts()], "license string, text string")
    c = canonical(F.col("text"))
    rows = known.where("license is not null and text is not null").where(c != "")
    return rows.select(F.sha2(c, 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, *, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the whole canonical text), license (of the whole text),
    line_licenses (of its lines; distinct, sorted, comma-joined)."""
    spark = docs.sparkSession
    digests = small(known_digests(spark, known))
    whole = canonical(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.when(whole != "", F.sha2(whole, 256)).alias("digest"))
    lines = docs.select(F.col(id_col).alias("line_id"), F.xxhash64(text_col).alias("line_hash"), F.explode(F.array_distinct(F.split(text_col, "\n"))).alias("line"))
    form = canonical(F.col("line"))
    named = lines.select("line_id", "line_hash", F.sha2(form, 256).alias("digest")).join(digests, "digest")
    per = named.groupBy("line_id", "line_hash").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    out = base.join(digests, "digest", "left")
    return out.join(per, out["doc_id"].eqNullSafe(per["line_id"]) & (out["text_hash"] == per["line_hash"]), "left").select(
        "doc_id", "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    t = f"regexp_replace(lower({text}), {_sql_text(TO_OPENING)}, '\\1\\2', 'g')"
    t = f"' ' || regexp_replace(regexp_replace({t}, {_sql_text(TO_LINE_END)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for a, b in ((IDLE, ""), *SPELLINGS):
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"regexp_replace(trim(regexp_replace({t}, ' +', ' ', 'g')), {_sql_text(HOLDER)}, '\\1 the copyright holder \\2', 'g')"


OP9_SQL = f"""
WITH k AS (SELECT sha256({_sql_canonical('t')}) AS digest, min(l) AS license
  FROM (VALUES {', '.join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in [*KNOWN, *full_texts()])}) AS v(l, t) GROUP BY 1),
d AS (SELECT doc_id, text, {_sql_canonical("coalesce(text, '')")} AS c FROM documents),
l AS (SELECT DISTINCT doc_id, {_sql_canonical('line')} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
p AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS line_licenses
  FROM (SELECT DISTINCT doc_id, license FROM l JOIN k ON sha256(l.c) = k.digest) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest, k.license, coalesce(line_licenses, '') AS line_licenses
FROM d LEFT JOIN k ON CASE WHEN c <> '' THEN sha256(c) END = k.digest LEFT JOIN p USING (doc_id)
"""
