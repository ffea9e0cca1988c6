"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules per document: counts of words, symbols, repeated lines and words in repeated three-word windows.

Method. A line is normalised (trimmed, lower-case, white space runs to one space) and hashed. For each host the number
of distinct documents that hold the line is counted; exact copies of a text count once. A line held by more than
``share`` of the host's distinct documents, and by more than ``least`` of them, is removed from all of them (by default by
three or more: with fewer, two texts that share a line would be a frequency of their own). A
document left with fewer than ``min_words`` words, or with less than ``min_left`` of its words, is depleted and
rejected. The host of a document is its source; rows without one form a host of their own.

Scale. The texts are read once into one narrow row per document (counts, line hashes and word counts), written to the
shared folder. Counting distinct texts per (host, line) is combined map-side, so a hot host or line is spread over
its texts first. Lines above the limit are few (at most 1 / share times a document's lines per host); joining them back is
left to Spark, which measures the side before it broadcasts and splits skewed keys otherwise.

Edge cases. Null text has no words; blank lines are never counted or removed; repeated rows are judged alike; a null
host is the host ''; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_record, no_text, stored, with_text

#: White space and symbol characters of the base rules.
BLANK = " \t\n\x0b\f\r"
BLANKS = r"[\x20\x09-\x0D]+"
#: A run of white space that isn't one space.
UNEVEN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
MIN_WORDS = 50
REPEAT_PERCENT = 50


def words_of(text: Column) -> Column:
    """Words of a text without outer white space; empty for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, BLANKS))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def normal_line(line: Column) -> Column:
    # most lines are even and need no regular expression
    uneven = reduce(or_, [F.contains(line, F.lit(x)) for x in ("  ", *BLANK[1:])])
    return F.lower(F.when(uneven, F.regexp_replace(trimmed(line), UNEVEN, " ")).otherwise(trimmed(line)))


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words that lie in a three-word window which the text holds twice or more.

    Windows are hashed; only texts with a repeat sort (hash, place) pairs, so that equal hashes are neighbours.
    """
    w = F.col(words)
    df = df.withColumn("_h", F.when(F.size(w) < 4, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
                                    F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    s = F.col("_s")
    df = df.withColumn("_p", F.sort_array(F.transform(
        F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["p"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x)),
                          F.lit(0), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def profile(docs: DataFrame) -> DataFrame:
    """One narrow row per document: base counts, the text's hash and its lines' hashes with word counts."""
    text = no_text("text")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
                     text.alias("text"), F.monotonically_increasing_id().alias("row"))
    df = df.withColumn("words", words_of(trimmed(F.col("text"))))
    df = repeated_words(df, "words", "n_repeat_words")
    lines = F.filter(F.split("text", "\n"), lambda x: trimmed(x) != "")
    df = df.withColumn("lines", lines)
    normal = F.transform("lines", normal_line)
    return df.select(
        "doc_id", "host", "row", F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("n"))).alias("lines"))


def frequent_lines(profiles: DataFrame, share: float, least: int) -> DataFrame:
    """(host, line) above the host's limit."""
    hosts = profiles.groupBy("host").agg(F.countDistinct("text_hash").alias("docs"))
    held = (profiles.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
            .groupBy("host", "line").agg(F.countDistinct("text_hash").alias("n")).filter(F.col("n") > least))
    return held.join(hosts, "host").filter(F.col("n") > F.col("docs") * share).select("host", "line")


def verdicts(profiles: DataFrame, share: float, least: int, min_words: int, min_left: float) -> DataFrame:
    """Every stored profile with base_failed, kept, removed (hashes of its lines above the limit) and words_left."""
    frequent = frequent_lines(profiles, share, least)
    lost = (profiles.select("host", "row", F.explode("lines").alias("x")).select("host", "row", F.col("x.line").alias("line"), "x.n")
            .join(frequent, ["host", "line"]).groupBy("row")
            .agg(F.sum("n").alias("lost"), F.count("*").alias("removed_lines"), F.collect_set("line").alias("removed")))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (profiles.drop("lines").join(lost, "row", "left")
            .withColumn("base_failed", failed).withColumn("words_left", left.cast("long"))
            .withColumn("kept", ~failed & (left >= min_words) & (left >= min_left * F.col("n_words")))
            .withColumn("removed_lines", F.coalesce("removed_lines", F.lit(0)).cast("long")).drop("lost"))


def judge(docs: DataFrame, share: float = 0.1, least: int = 2, min_words: int = MIN_WORDS, min_left: float = 0.2) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, removed_lines, words_left of every document."""
    return (verdicts(stored(profile(docs), "quality-profile"), share, least, min_words, min_left)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "removed_lines", "words_left"))


def kept_documents(docs: DataFrame, share: float = 0.1, least: int = 2, min_words: int = MIN_WORDS, min_left: float = 0.2) -> DataFrame:
    """The documents that pass, in their own columns, without the lines above their host's limit.

    Rows are met again by a hash of what decides the verdict (doc_id, text, host): equal rows have equal verdicts.
    Only rejected or changed rows are joined back.
    """
    found = verdicts(stored(profile(docs), "quality-profile"), share, least, min_words, min_left)
    name = F.xxhash64("doc_id", "text_hash", "host").alias("key")
    changed = (found.filter(~F.col("kept") | (F.col("removed_lines") > 0)).select(name, "text_hash", "kept", "removed")
               .dropDuplicates(["key", "text_hash"]))
    text, host = no_text("text"), F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = (docs.select(as_record(docs).alias("record"), F.xxhash64(text).alias("text_hash"),
                        F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text), host).alias("key"))
            .join(changed, ["key", "text_hash"], "left").filter(F.coalesce("kept", F.lit(True))))
    shorter = F.array_join(F.filter(F.split("record.text", "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(normal_line(x)))), "\n")
    record = F.col("record")
    return rows.select(F.when(F.col("removed").isNull(), record).otherwise(with_text(record, shorter, docs)).alias("record")).select("record.*")


def oracle_sql(share: float = 0.1, least: int = 2, min_words: int = MIN_WORDS, min_left: float = 0.2) -> str:
    """DuckDB SQL for ``judge`` over the table ``documents``."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
ln AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, host, text, line, lower(regexp_replace(trim(line, {blank}), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
       FROM ln WHERE trim(line, {blank}) <> ''),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM lw GROUP BY r),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
held AS (SELECT host, k, count(DISTINCT text) AS n FROM lw GROUP BY host, k),
freq AS (SELECT host, k FROM held JOIN hosts USING (host) WHERE n > {least} AND n > docs * {share}),
lost AS (SELECT r, count(*) AS m, sum(len(string_split(k, ' '))) AS n FROM lw JOIN freq USING (host, k) GROUP BY r),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
        (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(lost.m, 0)::BIGINT AS removed_lines, (len(ws) - coalesce(lost.n, 0))::BIGINT AS words_left
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r) LEFT JOIN lost USING (r)),
y AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND words_left >= {min_words} AND words_left >= {min_left} * n_words AS kept, removed_lines, words_left
FROM y
"""
