"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words, lower-cased. Two lines match at a Jaccard similarity of 0.8 or more; a line that matches an
earlier one, by document id, row and line number, is removed, whether or not the earlier one goes too. Lines without words stay.

Words are ordered by rarity. If two sets match, the rarest ``n - ceil(0.8 n) + 1`` words of each share one, and in the smaller one
it is among ``n - ceil(8 n / 9) + 1`` (prefix filter); their sizes are within 0.8 of each other (length filter); and the words behind the shared one suffice for
the overlap (positional filter). Beside them goes a parity filter: each set carries 128 bits, of which each word turns one over; two
sets that differ in d words differ in at most d bits, and matching ones may differ in a ninth of their sizes. What passes is
verified on the whole sets.

Nothing here is quadratic in a group of copies. Equal sets are one candidate, under a number of its own; a set is first compared
with the earliest line of each of its prefix words, which settles nearly all members of a group; only sets that are still open meet
the other lines of their words. The rarity of a word is the class of the number of words in one of a million hash buckets,
counted over all lines: the table has a fixed size, and any order that all lines share keeps the filters exact. Texts are cut into words
once, and the hashed words are stored. The words of the prefixes, and the pairs with their
words, are worked off in ``SLICES`` parts, so that one part at a time lies on disk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.session import discard, free_shuffles, materialize, weighed

#: J >= 4/5 for sets of n and m with overlap o: 9 o >= 4 (n + m)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: bits of a key behind the class of its word
KEY_BITS = 56
WHITE = " \t\x0b\f\r\n"
#: bits of the filter that picks the candidate lines; 4 MB whatever the corpus
FILTER_BITS = 1 << 25


#: bits of a row's number that hold its place in its file
PLACE_BITS = 40


def _as_read(docs: DataFrame) -> bool:
    """Whether a frame is a table as it was read, without any step on it."""
    return docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def numbered(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Each row of ``docs`` as one struct ``doc`` (no column of it can clash with those of the job), and its number ``row``.

    Rows of a Parquet table that is read as it is (``stored``) are told apart by their file and their place in it, so nothing is
    copied. Any other frame may come out in another order when it is read again, so it is written first, ``stored`` or not.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if not (stored and _as_read(docs)):
        return materialize(docs.select(doc, F.monotonically_increasing_id().alias("row")), "numbered", "zstd")
    found = docs.metadataColumn("_metadata")
    rows = docs.select(doc, found["file_path"].alias("path"), found["row_index"].alias("at"))
    # one short row for each file of the table
    paths = sorted(r["path"] for r in rows.select("path").distinct().collect())
    files = docs.sparkSession.createDataFrame([(name, k << PLACE_BITS) for k, name in enumerate(paths)], "path string, first long")
    return rows.join(F.broadcast(files), "path").select("doc", (F.col("first") + F.col("at")).alias("row"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def words_of(line: Column) -> Column:
    """Lower-cased words of a line that has any.

    A split at one plain character needs no regular expression, which makes it several times faster.
    """
    spaced = F.lower(line)
    for c in WHITE[1:-1]:  # a line holds no line feed
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def by_line(rows: DataFrame) -> DataFrame:
    """``id, row, line_no, line, line_hash`` of every line with words of ``numbered`` rows; a null id sorts first."""
    own = F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    lines = rows.select(own.alias("id"), "row", F.posexplode(split_lines(F.coalesce("doc.text", F.lit("")))).alias("line_no", "line"))
    return lines.where(F.btrim("line", F.lit(WHITE)) != "").select("*", F.xxhash64("line").alias("line_hash"))


def line_words(rows: DataFrame) -> DataFrame:
    """``PLACE, hashes`` of every line with words, as a written table: its distinct words as sorted hashes. Texts are cut into words once."""
    hashes = F.sort_array(F.array_distinct(F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w))))
    return materialize(by_line(rows).select(*PLACE, hashes.alias("hashes")), "line-words", "zstd")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(words: DataFrame) -> Column:
    """The class of each bucket by the number of words in it, one byte each, as one binary constant: 0 for a single word, which no
    other line has, then four classes for each doubling."""
    counted = words.select(F.explode("hashes").alias("h")).groupBy(_bucket(F.col("h")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    classes = np.zeros(BUCKETS, np.uint8)  # as many numbers whatever the corpus
    n = counted.column("n").to_numpy()
    classes[counted.column("bucket").to_numpy()] = np.where(n > 1, np.minimum(4 * np.log2(n), 127), 0)
    return F.lit(classes.tobytes())


def keys_of(hashes: Column, classes: Column) -> Column:
    """The hashed words as longs that sort by rarity: the class of the word, then the high bits of its hash."""

    def key(h: Column) -> Column:
        found = F.ascii(F.substring(classes, _bucket(h) + 1, F.lit(1)).cast("string"))
        return F.shiftleft(found.cast("long"), KEY_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - KEY_BITS))

    return F.sort_array(F.transform(hashes, key))


def _matches(overlap: Column, n: Column, m: Column) -> Column:
    return 9 * overlap >= 4 * (n + m)


def _prefix(n: Column, share: tuple[int, int]) -> Column:
    """How many of the rarest words of a set hold one of any ``share`` (a fraction) of its words."""
    return n - F.ceil(n * share[0] / share[1]).cast("int") + 1


#: of the words of the larger set, and of those of the smaller one, the overlap of two matching sets has at least so much
OF_LARGER, OF_SMALLER = (4, 5), (8, 9)


def _may_match() -> Column:
    """Prefix, length, positional and parity filters of two sets that share the words at their places ``i``: columns a_n, a_i, a_every, a_odd, b_n, ...;
    sizes below zero are those of settled sets."""
    n, m, i, j = F.abs("a_n"), F.abs("b_n"), F.col("a_i"), F.col("b_i")
    every, odd = (F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")) for c in ("every", "odd"))
    differing = F.bit_count(every.bitwiseXOR(odd)) + F.bit_count(odd)
    # the rarest word of both lies in the shorter prefix of the smaller set
    early = F.when(n <= m, i < _prefix(n, OF_SMALLER)).otherwise(j < _prefix(m, OF_SMALLER))
    return (9 * differing <= n + m) & (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & _matches(1 + F.least(n - i, m - j) - 1, n, m) & early


ORDER = ("id", "row", "line_no")
PLACE = (*ORDER, "line_hash")


def line_sets(words: DataFrame, classes: Column) -> DataFrame:
    """One row per distinct set of words, as a written table: its earliest line, size, 128 parity bits and prefix, and its number ``set``,
    which rises with the place of that line. Words that no other line has are null in the prefix."""
    spark = words.sparkSession
    equal = words.select(*ORDER, F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(7), "hashes").alias("k2"))
    # a line that comes a billion times is one row of each task
    single = materialize(equal.groupBy("k1", "k2").agg(F.min(F.struct(*ORDER)).alias("s")).select("s.*"), "line-first", "zstd")
    free_shuffles(spark)
    # numbers of sorted ranges rise with the order
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = single.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    order = materialize(ranged.select("row", "line_no", F.monotonically_increasing_id().alias("set")), "line-order", "zstd")
    n = F.size("hashes")
    # sets of up to three words match only equal sets, so they need no prefix; 40 bits of a word suffice to meet by
    rarest = F.slice(keys_of(F.col("hashes"), classes), 1, _prefix(n, OF_LARGER))
    short = F.transform(rarest, lambda k: F.when(k >= (1 << KEY_BITS), k.bitwiseAND(F.lit((1 << 40) - 1))))
    # the parity of all words, and that of those with an odd seventh bit; the others are what is between
    every = F.expr("aggregate(hashes, 0L, (b, h) -> b ^ shiftleft(1L, cast(h & 63L AS INT)))")
    odd = F.expr("aggregate(hashes, 0L, (b, h) -> b ^ shiftleft(shiftright(h, 6) & 1L, cast(h & 63L AS INT)))")
    sized = words.select(*PLACE, n.alias("n"), every.alias("every"), odd.alias("odd"), F.when(n >= 4, short).alias("prefix"))
    out = materialize(sized.join(weighed(order), ["row", "line_no"]).select("set", *PLACE, "n", "every", "odd", "prefix"), "line-sets", "zstd")
    discard(single, order)
    free_shuffles(spark)
    return out


#: the words of the prefixes are dealt out in so many parts, one after another, since together they weigh as much as the texts
SLICES = 4


def _prefix_words(stored: DataFrame, part: int) -> DataFrame:
    """``word, set, n, every, odd, i``: each set under those words of its prefix that are in the part."""
    each = stored.where("prefix is not null").select("set", "n", "every", "odd", F.posexplode("prefix").alias("i", "word"))
    return each.where(F.pmod(F.col("word"), F.lit(SLICES)) == part).select("word", "set", "n", "every", "odd", "i")


def _side(words: DataFrame, side: str) -> DataFrame:
    """The columns but ``word`` under names of one side of a pair."""
    return words.select("word", *[F.col(c).alias(f"{side}_{c}") for c in words.columns if c != "word"])


def _pairs(spark: SparkSession, joined: Callable[[int], DataFrame]) -> DataFrame:
    """``x, y``: each pair of sets once, the later one as ``y``, as a written table; ``joined`` gives the pairs ``a_set < b_set`` of a part."""
    parts = []
    for part in range(SLICES):
        parts.append(materialize(joined(part).select(F.col("a_set").alias("x"), F.col("b_set").alias("y")).distinct(), "line-pairs"))
        free_shuffles(spark)
    pairs = materialize(reduce(DataFrame.unionByName, parts).distinct(), "line-pairs")
    discard(*parts)
    return pairs


def kept_lines(rows: DataFrame) -> DataFrame:
    """``id, row, line_no, line_hash`` of the lines with words that match no earlier line, of ``numbered`` rows.

    ``id`` is the document's (the smallest long for a null one). Every row is a document of its own; rows of one id are
    ordered by their numbers.
    """
    words = line_words(rows)
    stored = line_sets(words, rarity(words))

    # first round: each set and the earliest set of each word of its shorter prefix, which settles what it can
    def with_earliest(part: int) -> DataFrame:
        rarest = _prefix_words(stored, part).where(F.col("i") < _prefix(F.col("n"), OF_SMALLER))
        first = [F.min_by(c, "set").alias(f"a_{c}") for c in ("n", "every", "odd", "i")]
        anchors = rarest.groupBy("word").agg(F.min("set").alias("a_set"), *first, F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets")
        # Spark sizes the words of a prefix as one row, so the hint keeps them from being broadcast
        return anchors.hint("merge").join(_side(rarest, "b"), "word").where((F.col("a_set") < F.col("b_set")) & _may_match())

    settled = _later_of(words, stored, _pairs(rows.sparkSession, with_earliest))

    # second round: sets that are still open and all other sets of their words
    done = weighed(settled).withColumn("done", F.lit(-1))
    marked = stored.join(done, "set", "left").withColumn("n", F.col("n") * F.coalesce("done", F.lit(1)))

    def with_others(part: int) -> DataFrame:
        words = _prefix_words(marked, part)
        both = _side(words, "a").hint("merge").join(_side(words, "b"), "word")
        # the later set of a pair is the one that would go, so it must be open; a condition on both sides at once leaves them one
        # shuffle, read twice
        later_open = F.col("b_set") - F.col("a_set") > F.when(F.col("b_n") > 0, F.lit(0)).otherwise(F.lit((1 << 63) - 1))
        return both.where(later_open & _may_match())

    late = _later_of(words, stored, _pairs(rows.sparkSession, with_others))
    discard(words)
    return stored.select("set", *PLACE).join(weighed(settled.unionByName(late)), "set", "left_anti").select(*PLACE)


def _later_of(words: DataFrame, stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """``set``: the later of each of the written ``pairs`` of sets that match on all their words, as a written table."""
    involved = pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct()
    places = materialize(stored.select("set", "row", "line_no").join(involved, "set"), "line-places")
    # a bit for each line of a candidate, in parts of 4 KB: picks the lines before they are dealt out
    bit = F.pmod(F.xxhash64("row", "line_no"), F.lit(FILTER_BITS))
    bits = places.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (at % 8).cast("int")) == 1
    lines = words.select("row", "line_no", "hashes", bit.alias("bit"))
    chosen = lines.withColumn("part", F.bitmap_bucket_number("bit")).join(F.broadcast(bits), "part").where(is_set)
    whole = materialize(chosen.select("row", "line_no", "hashes").join(weighed(places), ["row", "line_no"]).select("set", "hashes"), "line-whole", "zstd")
    free_shuffles(words.sparkSession)
    x, y = (whole.select(F.col("set").alias(s), F.col("hashes").alias(f"{s}_keys")) for s in "xy")
    equal = _matches(F.size(F.array_intersect("x_keys", "y_keys")), F.size("x_keys"), F.size("y_keys"))
    parts = []
    for part in range(SLICES):  # a pair travels with the words of a set, so all pairs at once weigh more than the texts
        both = pairs.where(F.pmod(F.xxhash64("x"), F.lit(SLICES)) == part).join(x, "x").join(y, "y")
        parts.append(materialize(both.where(equal).select(F.col("y").alias("set")).distinct(), "line-later"))
        free_shuffles(words.sparkSession)
    later = materialize(reduce(DataFrame.unionByName, parts).distinct(), "line-later")
    discard(pairs, places, whole, *parts)
    free_shuffles(words.sparkSession)
    return later


def _kept_of(rows: DataFrame) -> DataFrame:
    """``row, kept``: the kept lines of each row as one list; the row's own lines bound it."""
    return kept_lines(rows).groupBy("row").agg(F.collect_list(F.struct("line_no", "line_hash")).alias("kept"))


_NONE = "array<struct<line_no:int,line_hash:bigint>>"


def _hashes(lines: Column) -> Column:
    """A hash for each line with words, null for the others."""
    return F.transform(lines, lambda line: F.when(F.btrim(line, F.lit(WHITE)) != "", F.xxhash64(line)))


def _removed(hashes: str, kept: str) -> Column:
    """Numbers (from 0, ascending) of the lines with words that are not kept."""
    own = F.filter(F.coalesce(kept, F.array().cast(_NONE)), lambda k: F.get(F.col(hashes), k["line_no"]) == k["line_hash"])
    worded = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.get(F.col(hashes), i).isNotNull())
    return F.array_except(worded, F.transform(own, lambda k: k["line_no"]))


def dedup(docs: DataFrame, stored: bool = False) -> DataFrame:
    """``docs`` with matching later lines taken out of ``text`` (and ``n_chars`` counted anew where it is there).

    A text of which no line goes, null and empty texts among them, stays as it is; a text that loses all lines becomes
    empty. Every row is a document of its own: of exact copies with one id, the row read first keeps its lines. Columns of any name pass through.
    ``stored`` says that ``docs`` is a Parquet table as it was read.
    """
    rows = numbered(docs, stored)
    lines = split_lines(F.coalesce("doc.text", F.lit("")))
    marked = rows.join(_kept_of(rows), "row", "left").select("doc", "kept", lines.alias("lines"), _hashes(lines).alias("hashes")).select("doc", "lines", _removed("hashes", "kept").alias("removed"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    text = F.when(F.size("removed") > 0, F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")).otherwise(F.col("doc.text"))
    clean = marked.select("doc", text.alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, stored: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` of every row: how many lines it has and which go, counted from 0.

    ``stored`` says that ``docs`` is a Parquet table as it was read.
    """
    rows = numbered(docs if stored else docs.select("doc_id", "text"), stored)
    # only hashes of lines are dealt out beside the kept lines
    hashed = rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "row", _hashes(split_lines(F.coalesce("doc.text", F.lit("")))).alias("hashes"))
    joined = hashed.join(_kept_of(rows), "row", "left")
    removed = joined.select("doc_id", F.size("hashes").alias("n_lines"), _removed("hashes", "kept").alias("removed"))
    return removed.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")
