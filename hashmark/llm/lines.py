"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words.  Lines with equal sets are one class, which stands where it occurs first.  The words of a
line are ordered by rarity (by the number of digits of how often they occur in the corpus, then longer words first, by bytes,
then by hash), so that two lines with a Jaccard similarity of ``PERCENT`` % must share one of the first words of either (prefix filter), at places that leave
room for the words they need in common (positional filter), and be of like size (length filter); a parity sketch of the
words, of 64 bits and of 256 for lines of ``LONG`` words and more, bounds their difference as well.  What passes is verified
on the full sets.

A class that matches an earlier class is removed, as are all later lines of a class.  Every class is tried against the
earliest class under each of its words first; only what that leaves is tried against all others, so a line with very many
variants is not expanded into pairs.

Blank lines stay; NULL texts are empty and stay empty.  Rows that share an id but not the text are documents of their own, in
the order of a hash of the text; repeated rows (equal id and text) are one document and stay alike.  Rows without an id pass
unchanged.  Columns besides the id and the text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.tables import BLANKS, documents, word_array, written

PERCENT = 80
#: Hash slots whose occurrences order the words: what is collected has two or three bytes for each, at any size of the corpus.  It is a
#: constant of several plans, whose text the driver keeps.
SLOTS = 1 << 16
#: From so many words on 64 bits tell two lines apart no longer: they may differ in 18 words, unlike sets differ in 32 bits or so.
LONG = 80
#: 64-bit parts of a long line's sketch besides the first, which is the sum of all; one less than a power of two.
PARTS = ("part1", "part2", "part3")
#: What a line is held against before its set is fetched.
FILTERS = ("n", "parity", *PARTS)


#: What names a line: the id of its document, a hash of the text where several texts have that id (else 0), and its number.
LINE = ("doc", "tag", "line")


def _earlier(x: str, y: str) -> Column:
    """Whether the line ``x`` stands before the line ``y``."""
    after = F.lit(False)
    for c in reversed(LINE):
        after = (F.col(f"{x}.{c}") < F.col(f"{y}.{c}")) | ((F.col(f"{x}.{c}") == F.col(f"{y}.{c}")) & after)
    return after


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with ``doc`` and ``tag``.  Ids with several texts are written first, so few of them are joined by broadcast."""
    several = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc"))
    several = several.agg(F.min(F.xxhash64(text_col)).alias("lo"), F.max(F.xxhash64(text_col)).alias("hi")).filter("lo < hi").select("doc", F.lit(True).alias("several"))
    several = written(several, "line-ids").withColumnRenamed("doc", "several_doc")
    met = docs.join(several, F.col(id_col) == F.col("several_doc"), "left")
    tag = F.when(F.col("several"), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))
    return met.withColumns({"doc": F.col(id_col), "tag": tag}).drop("several", "several_doc")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _words(line: Column) -> Column:
    """The words of a line; lines without other blanks are cut at spaces, which takes no regular expression."""
    odd = reduce(Column.__or__, [line.contains(c) for c in BLANKS if c != " "])
    return F.when(odd, word_array(line)).otherwise(F.array_remove(F.split(line, " "), ""))


def rarity(docs: DataFrame, text_col: str = "text") -> Column:
    """A constant array, a number for each hash slot: how many binary digits the number of its words has.

    Where a corpus has fewer distinct words than slots, a slot tells how often one word occurs, within a factor of two; where it
    has more, a word counts as often as all words of its slot, so rare words are told apart less well.  Any order is exact.
    """
    spark = docs.sparkSession
    words = docs.select(F.explode(_lines(F.col(text_col))).alias("words")).select(F.explode(_words(F.col("words"))).alias("w"))
    words = words.select(_slot(F.xxhash64("w")).alias("slot"))
    level = F.length(F.bin(F.coalesce("count", F.lit(0)))).alias("level")
    counted = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(words.groupBy("slot").count(), "slot", "left")
    digits = counted.select("slot", level.cast("string").alias("digit")).groupBy(F.shiftright("slot", 12).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "digit"))), lambda x: x["digit"]), ",").alias("digits")
    )
    chunks = {r["chunk"]: r["digits"] for r in digits.collect()}
    return F.split(F.lit(",".join(chunks[k] for k in sorted(chunks))), ",").cast("array<tinyint>")


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def codes(line: Column, levels: Column) -> Column:
    """The distinct words of a line as sorted numbers: six bits of frequency, six of shortness, then 51 of the hash."""

    def code(word: Column) -> Column:
        hashed = F.xxhash64(word)
        order = 64 * F.get(levels, _slot(hashed)).cast("int") + 63 - F.least(F.octet_length(word), F.lit(63))
        return F.shiftleft(order.cast("long"), 51).bitwiseOR(F.shiftrightunsigned(hashed, 13))

    return F.sort_array(F.array_distinct(F.transform(_words(line), code)))


def _bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), code.bitwiseAND(F.lit(63)).cast("int"))


def _parity(found: Column | str) -> Column:
    """64 bits, each the parity of the words that hash to it: two sets differ in as many words at least as in bits."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(_bit(c)))


def _part(found: str, k: int) -> Column:
    """The parity of the ``k``-th share of the words; NULL for shorter lines.  All shares together make ``_parity``."""
    def mine(c: Column) -> Column:
        return F.shiftrightunsigned(c, 6).bitwiseAND(F.lit(len(PARTS))) == k

    return F.when(F.size(found) >= LONG, F.aggregate(found, F.lit(0).cast("long"), lambda a, c: F.when(mine(c), a.bitwiseXOR(_bit(c))).otherwise(a)))


def line_classes(docs: DataFrame, levels: Column, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each distinct set: the ``doc`` and ``line`` of its first occurrence, ``FILTERS`` and ``prefix``."""
    lines = (
        docs.filter(F.col(id_col).isNotNull())
        .select("doc", "tag", F.posexplode(_lines(F.col(text_col))).alias("line", "words"))
        .filter(_has_words(F.col("words")))
        .select(*LINE, codes(F.col("words"), levels).alias("codes"))
    )
    n = F.size("codes")
    filters = [n.alias("n"), _parity("codes").alias("parity"), *(_part("codes", k).alias(p) for k, p in enumerate(PARTS, 1))]
    prefix = F.slice("codes", 1, n - F.ceil(n * F.lit(percent) / 100).cast("int") + 1)
    rows = lines.select(
        F.xxhash64("codes").alias("h1"), F.hash("codes").alias("h2"),
        F.struct(*LINE, *filters, prefix.alias("prefix")).alias("one"),
    )
    return rows.groupBy("h1", "h2").agg(F.min("one").alias("one")).select("one.*")


def _may_match(x: str, y: str, percent: int, positions: bool) -> Column:
    """The length, parity and positional filters for two rows with ``FILTERS`` and the place ``at`` of a common word."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    # ceil(percent * (n + m) / (100 + percent)) words in common are needed
    need = F.expr(f"({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent}")
    found = (100 * n >= percent * m) & (100 * m >= percent * n)
    apart = [F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}")) for p in ("parity", *PARTS)]
    parts = [reduce(Column.bitwiseXOR, apart), *apart[1:]]
    found &= F.bit_count(apart[0]) <= n + m - 2 * need
    found &= F.coalesce(reduce(Column.__add__, map(F.bit_count, parts)) <= n + m - 2 * need, F.lit(True))
    if positions:
        found &= F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at")) >= need
    return found


def _verified(docs: DataFrame, pairs: DataFrame, levels: Column, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The later line of each pair (``doc``, ``tag``, ``line`` and the same with ``0``) that is similar indeed."""
    wanted = pairs.select(*LINE).unionByName(pairs.select(*[F.col(f"{c}0").alias(c) for c in LINE]))
    listed = wanted.distinct().groupBy("doc", "tag").agg(F.collect_list("line").alias("wanted")).hint("merge")
    # repeated rows are one document
    texts = docs.select("doc", "tag", F.col(text_col).alias("text")).join(listed, ["doc", "tag"]).dropDuplicates(["doc", "tag"])
    split = texts.select("doc", "tag", "wanted", _lines(F.col("text")).alias("lines"))
    picked = split.select("doc", "tag", F.explode(F.expr("transform(wanted, i -> struct(i AS line, lines[i] AS words))")).alias("p"))
    sets = written(picked.select("doc", "tag", "p.line", codes(F.col("p.words"), levels).alias("codes")), "line-sets")
    first, line0 = [F.col(c).alias(f"{c}0") for c in LINE], [f"{c}0" for c in LINE]
    full = pairs.join(sets, list(LINE)).join(sets.select(*first, F.col("codes").alias("codes0")), line0)
    both = F.size(F.array_intersect("codes", "codes0"))
    return full.filter(100 * both >= percent * (F.size("codes") + F.size("codes0") - both)).select(*LINE).distinct()


def _near_first(docs: DataFrame, classes: DataFrame, levels: Column, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Classes that are similar to the earliest class under one of their prefix words."""
    entries = classes.select(*LINE, *FILTERS, F.explode("prefix").alias("code"))
    first = entries.groupBy("code").agg(F.min(F.struct(*LINE, *FILTERS)).alias("x"), F.count("*").alias("entries"))
    first = written(first.filter("entries > 1").select("code", "x"), "line-words")
    met = entries.select("code", F.struct(*LINE, *FILTERS).alias("y")).join(first.hint("merge"), "code")
    tried = met.filter(_earlier("x", "y") & _may_match("x", "y", percent, False)).select(
        *[f"y.{c}" for c in LINE], *[F.col(f"x.{c}").alias(f"{c}0") for c in LINE]
    )
    return _verified(docs, written(tried.distinct(), "line-tries"), levels, percent, id_col, text_col)


def _others(classes: DataFrame, removed: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a line, and with ``0`` an earlier one) whose later class is not removed yet.

    Both sides of the join are one and the same exchange; the term that leaves removed classes out names both sides, as
    a filter on one would make a second exchange.
    """
    gone = removed.withColumn("gone", F.lit(1)).hint("merge")
    marked = classes.join(gone, list(LINE), "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    rows = marked.select(*LINE, *FILTERS, "gone", F.posexplode("prefix").alias("at", "code"))
    x, y = rows.alias("x"), rows.alias("y")
    open_y = F.col("x.gone") + 2 * F.col("y.gone") < 2
    pairs = y.join(x.hint("merge"), (F.col("x.code") == F.col("y.code")) & open_y & _earlier("x", "y") & _may_match("x", "y", percent, True))
    return pairs.select(*[f"y.{c}" for c in LINE], *[F.col(f"x.{c}").alias(f"{c}0") for c in LINE]).distinct()


def dedup_lines(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col``, ``n_lines`` (with words), ``n_removed`` and ``text`` without the removed lines, for every row.

    The columns ``others`` come along in one struct, ``others``.
    """
    levels = rarity(docs, text_col)
    beside = [F.struct(*others).alias("others")] if others else []
    docs = _tagged(docs.select(F.col(id_col), F.col(text_col).alias("text"), *beside), id_col, "text")
    classes = written(line_classes(docs, levels, percent, id_col, "text"), "line-classes")
    removed = written(_near_first(docs, classes, levels, percent, id_col, "text"), "line-removed")
    rest = written(_others(classes, removed, percent), "line-rest")
    removed = removed.unionByName(_verified(docs, rest, levels, percent, id_col, "text"))
    kept = classes.select(*LINE).join(removed, list(LINE), "left_anti").groupBy("doc", "tag").agg(F.collect_list("line").alias("kept"))
    joined = docs.join(kept.hint("merge"), ["doc", "tag"], "left")
    split = joined.select(id_col, "kept", "text", *(["others"] if others else []), _lines(F.col("text")).alias("lines"))
    marked = split.withColumn("blank", F.filter(F.transform("lines", lambda line, i: F.when(~_has_words(line), i)), lambda i: i.isNotNull()))
    stays = F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), "blank"))
    rebuilt = F.array_join(F.transform(stays, lambda i: F.col("lines")[i]), "\n")
    total = F.size("lines") - F.size("blank")
    return marked.select(
        id_col,
        total.cast("long").alias("n_lines"),
        F.when(F.col(id_col).isNull(), 0).otherwise(total - F.coalesce(F.size("kept"), F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col(id_col).isNull() | F.col("text").isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
        *(["others"] if others else []),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))
