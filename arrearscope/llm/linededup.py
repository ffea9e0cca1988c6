"""Fuzzy line dedup by MinHash over character shingles, in DataFrame operations only.

Lines are compared after trimming, lower-casing and joining white space; blank lines take no part and stay.

Shingles. A line's shingles are all its runs of ``SHINGLE`` characters (code points), one from every character on; a line
of fewer characters is one shingle.

Signature. The shingles are hashed by one function (one permutation). Lines of ``LONG`` shingles or more: the hash range
is cut into ``BANDS * ROWS`` equal bins, the smallest hash of each is a MinHash value, and the minima of ``ROWS``
neighbouring bins make a band key; at similarity 0.8 two lines share one with probability 0.997. Lines below ``SHORT``
shingles: the pairs of the five smallest hashes (bottom-k sketch) are the keys, shared with probability 0.994 or more; below
four shingles the whole set, where only equal sets reach 0.8. The ranges overlap so far that two lines at 0.8 always
have one kind of key in common.

Search. Lines that share a band key are candidates; in each bucket every line is first compared with the smallest, then, in
buckets left with several components, every line outside the main one with one line of it, another in each bucket, and
at last with all lines of the bucket in other components. For the last step each line's shingles are counted in
``PLACES`` places, as one bit for a place that holds one or more and another for two or more. Bits that two lines share bound the
shingles that they share from above, which rules most pairs out exactly while they are joined, before they become rows;
beyond about 1,500 shingles the bound is loose. Every pair that is left gets the exact Jaccard similarity of the shingle sets, so only
candidates are ever missed. A distributed union-find forms components; the first line of each (by doc_id, then position)
is kept, all others are removed from their documents.

Scale. Texts are read to hash lines, to fetch the lines that have candidates and to write the result; only the
last shuffles them. Equal lines share one hash, so copies never form pairs. Before wide joins a bit set of bounded size (at most ``BITS`` bits, built in Spark) drops rows whose key surely has no
partner; it saves shuffling and never decides. Hot lines and hot buckets are combined map-side; joins on them are
equi-joins that Spark splits.

Edge cases. Null text is the empty text and stays null. Rows equal in doc_id and text are one document and keep the same
lines; a null doc_id comes last. A document that loses all its lines gets the empty text. An empty table gives an
empty result; further columns pass through ``dedup_documents`` unchanged (``n_chars`` follows the text).
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_record, no_text, one_per_content, stored, with_text
from .components import components
from .quality import normal_line, trimmed

SHINGLE, TENTHS = 8, 8  # characters; similarity in tenths
SKETCH, BANDS, ROWS = 5, 8, 3
#: Lines below WHOLE shingles have their set as key, below SHORT the pairs of their sketch, from LONG on their bands.
WHOLE, LONG, SHORT = 4, 40, 50
#: Most bits of a membership filter (4 MB).
BITS = 1 << 25
#: Places in which a line's shingles are counted, and the 64-bit words of their two bits.
PLACES = 1 << 10
WORDS = 2 * PLACES // 64


def shingle_hashes(line: Column) -> Column:
    """Hashes of a normalised line's shingles (with repeats). Four bytes per character, for constant-time slices."""
    width = 4 * SHINGLE

    def hashes(units):
        last = F.octet_length(units) - width
        return F.when(last <= 0, F.array(F.xxhash64(units))).otherwise(
            F.transform(F.sequence(F.lit(1), last + 1, F.lit(4)), lambda at: F.xxhash64(F.substring(units, at, F.lit(width)))))

    # bound as a lambda's variable, so that a line is encoded once and not for every shingle
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), hashes), F.lit(0))


def scaled(x: Column, parts: int) -> Column:
    """The part (0 .. parts-1) of the 64-bit range that a hash falls into; neighbours in order stay neighbours."""
    return F.shiftrightunsigned(F.shiftrightunsigned(x, 32) * parts, 32)


def bounds() -> list[int]:
    """The smallest hash (as a signed number) of each of the ``BANDS * ROWS`` bins that ``scaled`` makes."""
    first = [-(-(part << 32) // (BANDS * ROWS)) << 32 for part in range(BANDS * ROWS)]
    return [x - (1 << 64) if x >> 63 else x for x in first]


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, doc (identity), pos, line (hash of the normalised line) and band keys of every non-blank line."""
    text = no_text("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("doc"),
                       # normalised inside the generator, so that each line is normalised once
                       F.posexplode(F.transform(F.split(text, "\n"), normal_line)).alias("pos", "norm")).filter("norm <> ''")
    rows = rows.select("doc_id", "doc", "pos", line_hash(F.col("norm")).alias("line"), F.array_distinct(shingle_hashes(F.col("norm"))).alias("h"))
    n, h, starts = F.size("h"), F.col("h"), [F.lit(x).cast("long") for x in bounds()]
    # among the sorted hashes and the lower bounds of the bins, the smallest hash of a bin comes right after its bound
    rows = rows.select("doc_id", "doc", "pos", "line", n.alias("n"), F.when(n < SHORT, F.slice(F.sort_array(h), 1, SKETCH)).alias("few"),
                       F.when(n >= LONG, F.sort_array(F.concat(h, F.array(*starts)))).alias("marked"))
    n, few = F.col("n"), F.col("few")
    pairs = [F.when(F.get(few, F.lit(j)).isNotNull(), F.xxhash64(F.get(few, F.lit(i)), F.get(few, F.lit(j))))
             for i, j in combinations(range(SKETCH), 2)]
    low = [F.get("marked", F.array_position("marked", x).cast("int")).alias(f"low{i}") for i, x in enumerate(starts)]
    rows = rows.select("doc_id", "doc", "pos", "line", "n", "few", without_nulls(pairs).alias("pairs"), *low)

    def band(b):
        """The smallest hash of each of the band's bins, null where what follows the bound lies in a later bin."""
        return [F.when(scaled(F.col(f"low{i}"), BANDS * ROWS) == i, F.col(f"low{i}")) for i in range(b * ROWS, (b + 1) * ROWS)]

    long = without_nulls([F.when(F.coalesce(*band(b)).isNotNull(), F.xxhash64(*band(b))) for b in range(BANDS)])
    bands = (F.when(n < WHOLE, F.array(F.xxhash64("few"))).when(n < LONG, F.col("pairs"))
             .when(n < SHORT, F.concat("pairs", long)).otherwise(long))
    return rows.select("doc_id", "doc", "pos", "line", bands.alias("bands"))


def without_nulls(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def may_hold(keys: DataFrame, name: str, n: int):
    """A predicate that is true for every value of ``keys[name]`` and false for most others; at most ``BITS`` bits."""
    bits = 1 << 12
    while bits < 16 * n and bits < BITS:
        bits *= 2
    spot = lambda c: F.pmod(F.xxhash64(c, F.lit(77)), F.lit(bits))
    at = spot(F.col(name))
    words = (keys.select(F.shiftright(at, 6).alias("w"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("v")))
    spark = keys.sparkSession
    full = spark.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    row = stored(full.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("bits")), "line-filter")

    def test(c: Column) -> Column:
        s = spot(c)
        return F.call_function("bit_get", F.get(row.scalar(), F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def bit_words(lines: DataFrame) -> DataFrame:
    """line, n, words (bits of the places with one shingle, then of those with two) and rest (shingles beyond). lines: line, norm, n."""
    places = F.sort_array(F.transform(F.array_distinct(shingle_hashes(F.col("norm"))), lambda x: x.bitwiseAND(F.lit(PLACES - 1)).cast("int")))
    again = F.transform("p", lambda x, i: F.when(F.get("p", i - 1) == x, x + PLACES).otherwise(x))
    marks = lines.select("line", "n", places.alias("p")).select("line", "n", F.explode(again).alias("at")).select(
        "line", "n", F.shiftright("at", 6).alias("word"), F.expr("1L").alias("one"), F.col("at").bitwiseAND(F.lit(63)).alias("b"))
    mark, none = F.expr("shiftleft(one, b)"), F.lit(0).cast("long")
    words = [F.bit_or(F.when(F.col("word") == w, mark).otherwise(none)) for w in range(WORDS)]
    return (marks.groupBy("line", "n").agg(F.array(*words).alias("words"))
            .withColumn("rest", F.col("n") - F.aggregate(F.transform("words", F.bit_count), F.lit(0), lambda a, x: a + x)))


def may_reach(x: str, y: str) -> Column:
    """False only for lines below the threshold, by their numbers of shingles and by the most shingles that they can share."""
    n, m = F.col(f"{x}_n"), F.col(f"{y}_n")
    bits = F.zip_with(f"{x}_words", f"{y}_words", lambda a, b: F.bit_count(a.bitwiseAND(b)))
    both = F.aggregate(bits, F.least(f"{x}_rest", f"{y}_rest"), lambda a, b: a + b)
    return (10 * F.least(n, m) >= TENTHS * F.greatest(n, m)) & ((10 + TENTHS) * both >= TENTHS * (n + m))


def bucket_pairs(left: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that share a bucket, are in different components and may reach the threshold.

    left: (key, line, comp, main), main being the component that most of the bucket's lines are in.
    """
    left = left.join(one_per_content(left, "line"), "key")
    keys = left.groupBy("line").agg(F.collect_list("key").alias("keys"))
    bits = stored(bit_words(lines.join(keys, "line", "left_semi")).join(keys, "line"), "line-bits")
    members = left.join(bits, "line")

    def side(name: str) -> DataFrame:
        return members.select("key", "main", *[F.col(c).alias(f"{name}_{c}") for c in ("line", "comp", *bits.columns[1:])])

    # pairs with the main component once from the line outside it, others from the line with the smaller hash, all in one of their buckets
    wanted = ((F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("main")) | (F.col("x_line") < F.col("y_line")))
              & may_reach("x", "y") & (F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("key")))
    pairs = side("x").filter("x_comp <> main").join(side("y").drop("main"), "key").filter(wanted)
    return pairs.select(F.least("x_line", "y_line").alias("a"), F.greatest("x_line", "y_line").alias("b"))


def similar(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines whose exact Jaccard similarity reaches TENTHS / 10. lines: line, norm, n (distinct shingles)."""
    one = lines.select(F.col("line").alias("a"), F.col("norm").alias("x"), F.col("n").alias("nx"))
    two = lines.select(F.col("line").alias("b"), F.col("norm").alias("y"), F.col("n").alias("ny"))
    near = (pairs.join(one, "a").join(two, "b")
            # the smaller set is at most the intersection, the larger at least the union
            .filter(10 * F.least("nx", "ny") >= TENTHS * F.greatest("nx", "ny")))
    both = F.size(F.array_intersect(shingle_hashes(F.col("x")), shingle_hashes(F.col("y"))))
    return (near.select("a", "b", (F.col("nx") + F.col("ny")).alias("n"), both.alias("both"))
            .filter(10 * F.col("both") >= TENTHS * (F.col("n") - F.col("both"))).select("a", "b"))


def line_components(docs: DataFrame, occ: DataFrame) -> DataFrame:
    """(line, root) of every line that is similar to another one."""
    held = occ.select(F.explode("bands").alias("key"), "line").filter("key is not null")
    shared = stored(held.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("top")).filter("low <> top"), "line-shared")
    maybe = may_hold(shared, "key", shared.count())
    members = stored(held.filter(maybe(F.col("key"))).join(shared, "key").distinct(), "line-members")

    wanted = stored(members.select("line").distinct(), "line-wanted")
    maybe_line = may_hold(wanted, "line", wanted.count())
    text = no_text("text")
    norms = F.transform(F.transform(F.split(text, "\n"), normal_line), lambda x: F.struct(x.alias("norm"), line_hash(x).alias("line")))
    norm = docs.select(F.explode(norms).alias("x")).select("x.norm", "x.line").filter((F.col("norm") != "") & maybe_line(F.col("line")))
    lines = stored(norm.groupBy("line").agg(F.first("norm").alias("norm")).join(wanted, "line", "left_semi")
                   .withColumn("n", F.size(F.array_distinct(shingle_hashes(F.col("norm"))))), "line-texts")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tested = stored(members.filter("line <> low").select(*pair("line", "low")).distinct(), "line-stars")
    links = stored(similar(tested, lines), "line-links")
    roots = components(links).withColumnRenamed("node", "line")
    for last in (False, True):
        where = members.join(roots, "line", "left").withColumn("comp", F.coalesce("root", "line")).drop("root")
        several = where.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        left = stored(where.join(several, "key", "left_semi"), "line-mixed")
        sizes = left.groupBy("key", "comp").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"))
        left = left.join(main, "key")
        if not last:  # one line of the main component, another in each bucket
            one = left.filter("comp = main").groupBy("key").agg(F.min_by("line", F.xxhash64("line", "key")).alias("one"))
            more = left.filter("comp <> main").join(one, "key").select(*pair("line", "one"))
        else:  # the whole bucket
            more = bucket_pairs(left, lines)
        more = stored(more.distinct().join(tested, ["a", "b"], "left_anti"), "line-more")
        tested = tested.unionByName(more)
        roots = joined(roots, similar(more, lines))
    return roots


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(line, root) of every line of ``roots`` or ``links`` (a, b): links are followed between components only, which stay small."""
    known = roots.select("line", "root")
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(known.select(F.col("line").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(
            f"{end}_root", F.coalesce(f"{end}_root", end))
    ends = stored(ends.select("a", "b", "a_root", "b_root"), "line-links")
    higher = components(ends, "a_root", "b_root").select(F.col("node").alias("root"), F.col("root").alias("top"))
    lines = known.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("line"), F.col("a_root").alias("root")),
                                                            F.struct(F.col("b").alias("line"), F.col("b_root").alias("root")))).alias("x")).select("x.*"))
    return stored(lines.distinct().join(higher, "root", "left").select("line", F.coalesce("top", "root").alias("root")), "line-roots")


def kept_positions(docs: DataFrame) -> DataFrame:
    """(doc, places): the positions of the lines that each document keeps, rising; no row if it keeps none."""
    occ = stored(occurrences(docs), "line-occurrences")
    roots = line_components(docs, occ)
    named = occ.select("doc_id", "doc", "pos", "line").join(roots, "line", "left").withColumn("root", F.coalesce("root", "line"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "pos")).alias("at"))
    return first.groupBy("at.doc").agg(F.sort_array(F.collect_list("at.pos")).alias("places"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents in their own columns, without lines that another kept line repeats."""
    rows, record = _shortened(docs), F.col("record")
    return rows.select(F.when(F.col("kept") == F.col("n"), record).otherwise(with_text(record, F.col("left"), docs)).alias("record")).select("record.*")


def _shortened(docs: DataFrame) -> DataFrame:
    """record (the document), n (its non-blank lines), kept (how many of them stay) and left (the text that stays)."""
    text = no_text("text")
    rows = docs.select(as_record(docs).alias("record"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("doc"))
    rows = rows.join(kept_positions(docs), "doc", "left").withColumn("lines", F.split(no_text("record.text"), "\n"))
    lines = F.col("lines")
    rows = rows.withColumn("blank", F.filter(F.transform(lines, lambda x, i: F.when(trimmed(x) == "", i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("n", F.size("lines") - F.size("blank")).withColumn("kept", F.coalesce(F.size("places"), F.lit(0)))
    shorter = F.array_join(F.transform(F.sort_array(F.concat("places", "blank")), lambda p: F.get(lines, p)), "\n")
    return rows.select("record", "n", "kept", F.when(F.col("kept") == F.col("n"), F.col("record.text"))
                       .when(F.col("places").isNull(), F.lit("")).otherwise(shorter).alias("left"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed and the text that is left, for every document."""
    return _shortened(docs.select("doc_id", "text")).select(
        F.col("record.doc_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n_lines"),
        (F.col("n") - F.col("kept")).cast("long").alias("n_removed"), F.col("left").alias("text"))
