"""License scan: canonical digests of entire texts, hash-joined to the digests of known licences; DataFrame functions only.

Canonical form: lower case, equivalent spellings made one, copyright lines dropped, every run of characters other than
letters and digits one space. The entire document, and each of its lines taken as an entire text, get a SHA-256 digest of
that form; the known licences' digests (a fixed list, broadcast: its size is that of license_texts.KNOWN and DIGESTS) are
joined to them. KNOWN holds short texts and notices, DIGESTS only the digests of long licences (Apache, GPL, LGPL, MPL, CC0,
GFDL, Artistic, BSD of the Regents). The join needs no shuffle; a document's matches meet again in a grouping that begins map-side.
Every known text holds one of WORDS (as tests say), which the canonical form leaves as they are; so only lines and documents
that hold one are brought into that form. This loses nothing, and spares nearly all the regular expressions.

Result, a row for each document row: doc_id, license (of the whole text, else null), licenses (those found in it, sorted,
joined by ';', '' if none), n_lines (lines that match), first_line (the first of them from 0, else null).

Cases: very long texts are taken whole, as one row and its lines. Null and empty texts match nothing, nor do texts of which nothing but punctuation or copyright lines is left. Rows
that repeat give rows that repeat. Extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, KNOWN, SPELLINGS
from .shared import table

#: Each known text holds one of these in lower case. Fixed values.
WORDS = ("licen", "permission", "redistribution")
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b(?! (?:notice|holder))|\(c\) |©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form, its lines kept apart by \\n."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, word in SPELLINGS:
        out = F.regexp_replace(out, pattern, word)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    return F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n")


def _whole(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def _may_match(text: Column) -> Column:
    low = F.lower(text)
    return low.contains(WORDS[0]) | low.contains(WORDS[1]) | low.contains(WORDS[2])


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """digest, license: of each known text, and those given as digests."""
    listed = lambda pairs, names: spark.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(*(F.lit(x).alias(n) for x, n in zip(p, names, strict=True))) for p in pairs])))
    rows, given = listed([(i, t) for i, _, t in known], ("license", "text")), listed([(d, i) for i, d in digests], ("digest", "license"))
    return rows.select(F.sha2(_whole(canonical(F.col("text"))), 256).alias("digest"), "license").unionByName(given).distinct()


def license_scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    form = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"), _may_match(text).alias("may"))
    raw = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("int").alias("line"), x.alias("raw"))), lambda x: _may_match(x["raw"]))
    lines = F.when(F.col("may"), F.transform(raw, lambda x: F.struct(x["line"].alias("line"), F.trim(canonical(x["raw"])).alias("unit"))))
    whole = F.struct(F.lit(-1).alias("line"), F.when(F.col("may"), _whole(canonical(F.col("text")))).otherwise("").alias("unit"))
    units = form.select("doc_id", "row", F.concat(F.array(whole), F.coalesce(lines, F.array().cast("array<struct<line:int,unit:string>>"))).alias("units"))
    units = units.select("doc_id", "row", F.explode("units").alias("u")).select(
        "doc_id", "row", F.col("u.line").alias("line"), F.when(F.col("u.unit") != "", F.sha2(F.col("u.unit"), 256)).alias("digest")
    )
    found = units.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest", "left")
    inner = F.col("license").isNotNull() & (F.col("line") >= 0)
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(F.col("line") < 0, F.col("license"))).alias("license"),
            F.array_join(F.sort_array(F.collect_set("license")), ";").alias("licenses"),
            F.count_if(inner).alias("n_lines"),
            F.min(F.when(inner, F.col("line"))).alias("first_line"),
        )
        .drop("row")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def oracle(known=KNOWN, digests=DIGESTS) -> str:
    """The same in DuckDB's SQL, digests included. Its patterns have no look-ahead: what it would spare is set apart first and put back after."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        for pattern, word in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(word.replace('$1', chr(92) + '1'))}, 'g')"
        out = f"regexp_replace({out}, 'copyright (notice|holder)', 'xcopyright \\1', 'g')"
        out = f"regexp_replace({out}, {quoted(COPYRIGHT_LINE.replace('(?! (?:notice|holder))', ''))}, '', 'g')"
        out = f"regexp_replace({out}, 'xcopyright (notice|holder)', 'copyright \\1', 'g')"
        out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        return f"regexp_replace({out}, ' ?\\n ?', chr(10), 'g')"

    whole = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    rows, given = (", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs) for pairs in ([(i, t) for i, _, t in known], digests))
    return f"""
    WITH k AS (SELECT license, sha256({whole(form("text"))}) AS digest FROM (VALUES {rows}) AS v(license, text) UNION SELECT license, digest FROM (VALUES {given}) AS v(license, digest)),
    f AS (SELECT doc_id, row_number() OVER () AS row, {form("text")} AS form FROM documents),
    l AS (SELECT doc_id, row, string_split(form, chr(10)) AS lines FROM f),
    u AS (SELECT doc_id, row, -1 AS line, {whole("form")} AS unit FROM f UNION ALL SELECT doc_id, row, i - 1, trim(lines[i]) FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)),
    m AS (SELECT u.doc_id, u.row, u.line, k.license FROM u LEFT JOIN k ON u.unit <> '' AND k.digest = sha256(u.unit))
    SELECT doc_id, max(license) FILTER (WHERE line < 0) AS license, coalesce(array_to_string(list_sort(list(DISTINCT license) FILTER (WHERE license IS NOT NULL)), ';'), '') AS licenses,
           count(*) FILTER (WHERE line >= 0 AND license IS NOT NULL) AS n_lines, (min(line) FILTER (WHERE line >= 0 AND license IS NOT NULL))::INTEGER AS first_line
    FROM m GROUP BY doc_id, row
    """
