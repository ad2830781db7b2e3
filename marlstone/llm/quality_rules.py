"""Line-first quality rules, in DataFrame functions only.

Each line is judged by rules of punctuation, navigation and boilerplate; lines that fail go; a document that loses too much of
its text with them is rejected. Base counts that hold for the whole text stand beside the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of notices, in lower case; a line with one fails.
BOILERPLATE = (
    "all rights reserved|licensed under|apache license|creative commons|spdx-license|gnu general public|copyright|permission is hereby granted"
    "|privacy policy|terms of (use|service)|cookie|click here|sign up|log in|subscribe|javascript"
)
#: Words in a window of which repeats are counted.
WINDOW = 8
#: A document is rejected when failed lines hold more than this share of the characters in words.
MAX_LOST = 0.4


def _without(c: Column, chars: str) -> Column:
    return F.length(F.translate(c, chars, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with words fails: symbols in more than a twentieth of it, shouting, menu bars, short ends, notices."""
    chars = F.length(line)
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = chars - _without(line, SYMBOLS)
    loud = chars - _without(line, "!?")
    bars = chars - _without(line, "|»•·")
    closed = line.rlike(r"[.!?:;,…\"')\]][\x20\x09-\x0D]*$")
    return (20 * symbols > chars) | (3 * loud > words) | ((bars >= 2) & (6 * bars > words)) | ((words <= 2) & ~closed) | F.lower(line).rlike(BOILERPLATE)


def quality(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, cleaned.

    cleaned is the text without its failed lines. A null text has no words, fails the base and has a null `cleaned`. Repeated
    rows are judged alike. Other columns are not read. Windows are compared by 64-bit hashes within a document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long"), F.col("text").isNull().alias("none"), text.alias("text"))
    two = one.select(
        "doc_id",
        "none",
        "text",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.split("text", "\n").alias("lines"),
    )
    full = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    three = two.select(
        "doc_id",
        "none",
        _without(F.col("text"), SPACE).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("words").cast("long").alias("n_words"),
        full.alias("full"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), (x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x)).alias("bad"))).alias("judged"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("hashes"),
    )
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    bad = F.filter("judged", lambda x: x["bad"])
    lost = F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + _without(x["line"], SPACE))
    four = three.select(
        "doc_id",
        "none",
        "word_chars",
        "n_symbols",
        "n_words",
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.size("full").cast("long").alias("n_lines"),
        F.size(bad).cast("long").alias("n_failed_lines"),
        lost.alias("lost"),
        F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("cleaned"),
        F.when(again, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"),
    )
    same = F.filter("sorted", lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]))
    five = four.withColumn("at", F.array_sort(F.transform(same, lambda x: x["i"]))).drop("sorted")
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1), x + WINDOW) - x)), F.lit(0).cast("long"), lambda a, x: a + x)
    six = five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return six.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("lost") <= max_lost * F.col("word_chars"))).alias("kept"),
        "n_lines",
        "n_failed_lines",
        F.when(~F.col("none"), F.col("cleaned")).alias("cleaned"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, u.i AS i, array_to_string(ws[u.i : u.i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win),
rep AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx, i + 8) - i)) AS n FROM rep GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
ln AS (SELECT doc_id, unnest(ls) AS x FROM l),
lm AS (SELECT doc_id, x, length(x) AS chars, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(x, '[^!?]', '', 'g')) AS loud,
  length(regexp_replace(x, '[^|»•·]', '', 'g')) AS bars, regexp_matches(x, '[.!?:;,…"'')\\]][\\x20\\x09-\\x0D]*$') AS closed FROM ln),
lf AS (SELECT doc_id, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) AS size,
  20 * symbols > chars OR 3 * loud > words OR (bars >= 2 AND 6 * bars > words) OR (words <= 2 AND NOT closed) OR regexp_matches(lower(x), '{BOILERPLATE}') AS bad FROM lm),
lo AS (SELECT doc_id, sum(CASE WHEN bad THEN size ELSE 0 END) AS lost, count(*) FILTER (WHERE bad) AS n_bad FROM lf GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  len(ls) AS n_lines, coalesce(n_bad, 0) AS n_failed_lines, coalesce(lost, 0) AS lost
  FROM w JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lo USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND lost <= {MAX_LOST} * word_chars AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_failed_lines AS BIGINT) AS n_failed_lines
FROM f
"""
