"""Cross-entropy difference of a target and a background language model.

Both models are bigram models over one vocabulary: every word of the whole corpus and one sign for the edge of a text.  The
background is all documents, the target those that the labels call good; counts cover every text of either.  A document's
score is the mean over its words of target loss minus background loss, in nats: the lower, the closer to the target.

Nothing about the corpus is cut off or collected whole.  The loss of a bigram is what its context costs, ``log(count of the
context + BACKOFF)``, less what the bigram is worth, ``log(its count + BACKOFF * chance of its word)``.  A word costs as a
context of what follows just where it occurs and is not the last of its text.  So every figure that a row of a text and a
bigram needs belongs to the bigram or to its word: rows are dealt by word, each once, and counts are sums over runs of the sorted rows.
Each row then costs its text a loss, and Spark adds these up.  No table of bigrams and no join of rows is made.

Words that make up at least one in ``HOT_SHARES`` of all (so never more than that many) are counted first and broadcast; their
rows are dealt by bigram.  Bigrams as frequent as that are broadcast too, and added up where the text is read: those among the
``HOT_SHARES`` that batches report most.  Whether a bigram is among them decides where it is counted, never what it counts.

Words and bigrams are known by 64-bit hashes.  Losses are whole numbers of ``UNIT`` nats, so that sums do not depend on the
order of rows.  NULL and blank texts have no words and NULL losses.  Labels that repeat count once, labels without a document
are ignored; rows that share an id are scored each on its own text.  Without a target document the target model knows the
vocabulary only.  Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.tables import arrow_map, documents, labels, written
from hashmark.llm.textbytes import chunks, flat, hashes, lowered, mix, words

#: The context of a text's first word.
EDGE = 0
#: Weight of the unigram model in a bigram context, in words.
BACKOFF = 50.0
UNIT = 1e-6
HOT_SHARES = 1 << 18
#: What a batch reports as frequent occurs in it so many times at least.
REPORTED = 8
COUNT_BYTES = 8 << 20
#: Keys are dealt in so many parts, one after the other, as their rows take more room than the texts.
PASSES = 2
#: How much of a context's hash stands beside the rank of its word in a sort, at most.
CONTEXT_BITS = 48
#: Rows that a task passes on at once.
ROWS = 1 << 17
#: Pairs are hashed in blocks that stay in a core's cache.
BLOCK = 1 << 14


def _word_hashes(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, word hashes and their rows, for consecutive rows of a string column."""
    data, offsets = flat(column)
    for row, part, bounds in chunks(data, offsets, limit):
        part = lowered(part)
        starts, lengths, rows = words(part, bounds)
        yield row, len(bounds) - 1, hashes(part, starts, lengths), rows


#: The public constants of xxHash64.
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` makes of two longs."""
    one, two, three, four, five = _PRIMES

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    out = np.full(len(first), 42, dtype=np.uint64)
    for k in range(0, len(out), BLOCK):
        h = out[k : k + BLOCK]
        for value in (first, second):
            h = (h + five + np.uint64(8)) ^ (turned(value[k : k + BLOCK] * two, 31) * one)
            h = turned(h, 27) * one + four
            h = (h ^ h >> np.uint64(33)) * two
            h = (h ^ h >> np.uint64(29)) * three
            h = h ^ h >> np.uint64(32)
        out[k : k + BLOCK] = h
    return out


def _in_runs(values: np.ndarray) -> np.ndarray:
    """An order by hashes in which equal ones stand together, as they come; numbers are sorted, not places.

    A number is a hash whose last bits give way to its place.  Where hashes agree in all other bits, which is rare, their runs
    may be torn: what is made of the runs has to be sums.
    """
    low = np.uint64((1 << len(values).bit_length()) - 1)
    return (np.sort(values.view(np.uint64) & ~low | np.arange(len(values), dtype=np.uint64)) & low).view(np.int64)


def _bigrams(found: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of every word, and the hash of the two."""
    before = np.full(len(found), EDGE, dtype=np.uint64)
    inner = rows[1:] == rows[:-1]
    before[1:][inner] = found[:-1][inner]
    return before, pair_hashes(before, found)


def _last(rows: np.ndarray) -> np.ndarray:
    """Which words are the last of their text."""
    last = np.ones(len(rows), dtype=bool)
    last[:-1] = rows[1:] != rows[:-1]
    return last


def _often(pairs: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a bigram stands first that is as frequent as is reported, and how often it occurs."""
    in_order = np.sort(pairs)
    begins = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
    times = np.diff(np.append(begins, len(pairs)))
    frequent = (times * shares >= len(pairs)) & (times >= REPORTED)
    often, times = in_order[begins[frequent]], times[frequent]
    seen = _held(often, pairs)
    at, met = _found(often, pairs[seen])
    first = np.zeros(len(often), np.int64)
    # of equal places the last one written stays
    first[at[met][::-1]] = seen[met][::-1]
    return first, times


#: For target and background: how often a word occurs, and how often with a word after it.
COUNTS = ("target", "every", "target_before", "every_before")


def word_counts(marked: DataFrame, shares: int) -> DataFrame:
    """``COUNTS`` of each ``word``, and, with ``context``, how often batches report a bigram as ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, _, found, rows in _word_hashes(batch.column(0), COUNT_BYTES):
                mark, inner = marks[row + rows], ~_last(rows)
                if not len(found):
                    continue
                order = _in_runs(found)
                in_order, mark, inner = found[order], mark[order], inner[order]
                begins = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
                known, every = in_order[begins], np.diff(np.append(begins, len(found)))
                sums = (np.add.reduceat(mark, begins, dtype=np.int64), every, *(np.add.reduceat(m, begins, dtype=np.int64) for m in (mark & inner, inner)))
                words_of = [pa.nulls(len(known), pa.int64()), pa.array(known.view(np.int64)), *(pa.array(x) for x in sums)]
                before, pairs = _bigrams(found, rows)
                at, times = _often(pairs, shares)
                none = pa.array(np.zeros(len(at), np.int64))
                for columns in (words_of, [pa.array(before[at].view(np.int64)), pa.array(found[at].view(np.int64)), none, pa.array(times.astype(np.int64)), none, none]):
                    yield pa.RecordBatch.from_arrays(columns, names=["context", "word", *COUNTS])

    schema = "context long, word long, " + ", ".join(f"{c} long" for c in COUNTS)
    return arrow_map(marked.select("text", "target"), run, schema).groupBy("context", "word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _found(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number stands in the sorted ``known``, and whether it does."""
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    return at, known[at] == asked if len(known) else np.zeros(len(asked), dtype=bool)


def _held(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in ``asked`` of all hashes that ``known`` holds, and of some others: those alike in their first bits."""
    bits = min(20, len(known).bit_length() + 4)
    marked = np.zeros(1 << bits, dtype=bool)
    marked[known.view(np.uint64) >> np.uint64(64 - bits)] = True
    return np.flatnonzero(marked[asked.view(np.uint64) >> np.uint64(64 - bits)])


def pair_counts(marked: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``target`` and ``every`` count of the bigrams whose hashes the sorted ``wanted`` holds, by their place ``at``."""
    shared = marked.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums = np.zeros((2, len(known)), np.int64)
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, _, found, rows in _word_hashes(batch.column(0), COUNT_BYTES):
                pairs = _bigrams(found, rows)[1].view(np.int64)
                seen = _held(known, pairs)
                at, met = _found(known, pairs[seen])
                for k, chosen in enumerate((met & marks[row + rows[seen]], met)):
                    sums[k] += np.bincount(at[chosen], minlength=len(known))[: len(known)]
        seen = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(x[seen]) for x in sums)], names=["at", "target", "every"])

    rows = arrow_map(marked.select("text", "target"), run, "at long, target long, every long")
    return rows.groupBy("at").agg(F.sum("target").alias("target"), F.sum("every").alias("every"))


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log(x) / UNIT).astype(np.int64)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


def _read(marked: DataFrame, words_hot: tuple[np.ndarray, ...], pairs_hot: tuple[np.ndarray, ...], edge: list[int], turn: int) -> DataFrame:
    """A row for each text and distinct bigram, which ``key`` deals: the word's hash, the bigram's for words in ``words_hot``.

    ``hot`` is the word's place there, else -1, with the ``context``; ``mark`` is the text's row, whether the bigram ends it and
    whether it is a target.  Bigrams in ``pairs_hot`` have no rows.  Each text has two more rows, whose ``context`` is the loss that
    is known already: the target's, of which ``hot`` is -2 and ``times`` how many of its words had no rows, and the background's,
    -3.  ``hot`` and ``times`` share the number ``count``.  Keys come in ``PASSES`` turns, texts with the first.
    """
    passes = PASSES
    shared = marked.sparkSession.sparkContext.broadcast((words_hot, pairs_hot))
    # what differs from row to row stands together, so that little of the rest is left when rows are compressed
    schema = "count long, context long, key long, mark long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, *costs), (known_pairs, *worth) = shared.value
        for batch in batches:
            marks = batch.column(2).to_numpy(zero_copy_only=False) * 4 + batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, n, found, rows in _word_hashes(batch.column(0), COUNT_BYTES):
                before, pairs = (x.view(np.int64) for x in _bigrams(found, rows))
                found, last = found.view(np.int64), _last(rows)
                at, frequent = _found(known, found)
                keys = np.where(frequent, pairs, found)
                mine = keys.view(np.uint64) % np.uint64(passes) == turn
                # a frequent bigram is one of a frequent word
                asked = np.flatnonzero(frequent & (mine | (turn == 0)))
                place, done = np.zeros(len(found), np.int64), np.zeros(len(found), dtype=bool)
                place[asked], done[asked] = _found(known_pairs, pairs[asked])
                if turn == 0:
                    edges = np.searchsorted(rows, np.arange(n + 1))
                    ready = []
                    for k in range(2):
                        own = np.where(frequent & ~last, costs[k][at], 0) if len(known) else np.zeros(len(found), np.int64)
                        own = own - np.where(done, worth[k][place], 0) if len(known_pairs) else own
                        ready.append(_sums(own, edges) + edge[k] * (edges[1:] > edges[:-1]))
                    passed, own = _sums(done.astype(np.int64), edges), marks[lo : lo + n]
                    for k in range(2):
                        whole = [passed * (1 - k) | (-2 - k) << 32, ready[k], mix((own + 2 * k).astype(np.uint64)).view(np.int64), own]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, whole)], names=names)
                left = np.flatnonzero(~done & mine)
                # of equal bigrams texts stay in order
                left = left[_in_runs(pairs[left])]
                first = np.ones(len(left), dtype=bool)
                first[1:] = np.logical_or.reduce([x[left[1:]] != x[left[:-1]] for x in (pairs, rows)])
                begins = np.flatnonzero(first)
                if not len(begins):
                    continue
                times = np.diff(np.append(begins, len(left)))
                ends, left = np.logical_or.reduceat(last[left], begins), left[begins]
                hot = frequent[left]
                columns = [
                    pa.array(times | np.where(hot, at[left], -1) << 32), pa.array(np.where(hot, 0, before[left])), pa.array(keys[left]), pa.array(marks[lo + rows[left]] + 2 * ends),
                ]
                whole = pa.RecordBatch.from_arrays(columns, names=names)
                for k in range(0, len(left), ROWS):
                    yield whole.slice(k, ROWS)

    return arrow_map(marked.select("text", "target", "row"), run, schema)


def _sorted(key: np.ndarray, hot: np.ndarray, context: np.ndarray) -> np.ndarray:
    """An order by the sorted ``key``, in which rows with equal ``hot`` and ``context`` stand together; other keys' rows may not be mixed.

    One number holds the key's rank and some bits of the context's hash.  Where these bits or the keys of words and bigrams
    clash, all columns are sorted.
    """
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.cumsum(new).astype(np.uint64)
    bits = min(CONTEXT_BITS, 64 - len(key).bit_length())
    both = rank << np.uint64(bits) | mix(context.view(np.uint64)) >> np.uint64(64 - bits)
    order = np.argsort(both)
    both, in_order = both[order], context[order]
    clash = (both[1:] == both[:-1]) & (in_order[1:] != in_order[:-1])
    if clash.any() or (~new[1:] & (hot[1:] != hot[:-1])).any():
        return np.lexsort((context, hot, key))
    return order


def _added(rows: DataFrame, hot_counts: list[np.ndarray], scale: list[float]) -> DataFrame:
    """``row``, ``n_words`` and the losses as ``target`` and ``every`` of each row of ``_read``; these are dealt and sorted by ``key``.

    There is one row for each that comes in; Spark sums them by text, before its exchange where a task holds several of a text.
    A key that may go on is kept for the next batch.  Keys have a share of ``HOT_SHARES`` at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hot_counts)

    def losses(part: list[np.ndarray]) -> pa.RecordBatch:
        order = _sorted(part[3], part[1], part[2])
        times, hot, context, key, mark = (x[order] for x in part)
        counts = shared.value
        word = np.ones(len(key), dtype=bool)
        # the hashes of a word and of a bigram might be equal
        word[1:] = (key[1:] != key[:-1]) | (hot[1:] != hot[:-1])
        pair = word.copy()
        pair[1:] |= context[1:] != context[:-1]
        at_word, at_pair = np.flatnonzero(word), np.flatnonzero(pair)
        of_word, of_pair = np.cumsum(word) - 1, np.cumsum(pair) - 1
        counted = np.where(hot < -1, 0, times)
        before, place = counted - (mark >> 1 & 1), hot[at_word]
        spot = np.maximum(place, 0)
        out = [mark >> 2, times]
        for k, own in enumerate((mark & 1, np.ones_like(mark))):
            n_pair, n_word, n_before = (np.add.reduceat(x * own, at) for x, at in ((counted, at_pair), (counted, at_word), (before, at_word)))
            if len(counts[k]):
                n_word = np.where(place >= 0, counts[k][spot], n_word)
            worth = _units(n_pair + BACKOFF * (n_word[of_word[at_pair]] + 1) / scale[k])
            cost = np.where(place >= 0, 0, _units(n_before + BACKOFF))
            out.append(np.where(hot == -2 - k, context, before * cost[of_word] - counted * worth[of_pair]))
        return pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["row", "n_words", "target", "every"])

    def in_slices(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = losses(part)
        for k in range(0, whole.num_rows, ROWS):
            yield whole.slice(k, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            count, *others = (batch.column(k).to_numpy() for k in range(batch.num_columns))
            held.append([count & 0xFFFFFFFF, count >> 32, *others])
            size += batch.num_rows
            key = held[-1][3]
            if size < 4 * ROWS or not len(key) or key[-1] == held[0][3][0]:
                continue
            part = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(part[3], key[-1]))
            yield from in_slices([x[:cut] for x in part])
            held, size = [[x[cut:] for x in part]], len(part[3]) - cut
        if size:
            yield from in_slices([np.concatenate(x) for x in zip(*held, strict=True)])

    return arrow_map(rows, run, "row long, n_words long, target long, every long")


def score(marked: DataFrame) -> DataFrame:
    """``row``, ``n_words``, ``target_loss`` and ``background_loss`` of the written table ``marked``: ``row``, ``text``, ``target``."""
    shares = HOT_SHARES
    counted = written(word_counts(marked, shares), "word-counts", "zstd")
    single = counted.filter(F.col("context").isNull())
    whole = single.agg(F.count("*").alias("known"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first()
    scale = [float(max(1, whole[c] + whole["known"])) for c in COUNTS[:2]]
    most = single.filter(F.col("every") * F.lit(shares) >= F.lit(whole["every"])).drop("context")
    common = most.orderBy("word").toArrow()
    hot, *hot_counts = (common.column(c).to_numpy().astype(np.int64) for c in ("word", *COUNTS))
    # as many texts have a first word as words have none after them
    edge = [int(_units(np.array([whole[c] - whole[f"{c}_before"] + BACKOFF]))[0]) for c in COUNTS[:2]]

    tried = counted.filter(F.col("context").isNotNull()).join(F.broadcast(most.select("word")), "word", "left_semi")
    tried = tried.orderBy(F.desc("every"), "word", "context").limit(shares).select(F.xxhash64("context", "word").alias("pair"), "word").orderBy("pair").toArrow()
    pair, word = (tried.column(c).to_numpy().astype(np.int64) for c in ("pair", "word"))
    exact = pair_counts(marked, pair).filter(F.col("every") * F.lit(shares) >= F.lit(whole["every"])).orderBy("at").toArrow()
    at, *times = (exact.column(c).to_numpy().astype(np.int64) for c in ("at", "target", "every"))
    of = np.searchsorted(hot, word[at])
    worth = [_units(n + BACKOFF * (hot_counts[k][of] + 1) / scale[k]) for k, n in enumerate(times)] if len(at) else [at, at]

    costs = [_units(n + BACKOFF) for n in hot_counts[2:]]
    totals, parts = [F.sum(c).alias(c) for c in ("n_words", "target", "every")], []
    for turn in range(PASSES):
        rows = _read(marked, (hot, *costs), (pair[at], *worth), edge, turn)
        added = _added(rows.repartition("key").sortWithinPartitions("key"), hot_counts[:2], scale)
        parts.append(written(added.groupBy("row").agg(*totals), "text-sums"))
    done = reduce(DataFrame.unionByName, parts).groupBy("row").agg(*totals).withColumnsRenamed({"target": "target_loss", "every": "background_loss"})
    means = [F.when(F.col("n_words") > 0, F.col(c) * F.lit(UNIT) / F.col("n_words")).alias(c) for c in ("target_loss", "background_loss")]
    return done.select("row", "n_words", *means)


def cross_entropy_difference(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``target_loss``, ``background_loss`` and ``difference`` (means over words) of every row.

    The target documents are those whose ids ``good`` holds in ``id_col``.
    """
    marks = good.select(F.col(id_col)).distinct().withColumn("target", F.lit(True)).hint("merge")  # one plan at every size
    marked = docs.select(id_col, text_col).join(marks, id_col, "left").withColumn("target", F.coalesce("target", F.lit(False)))
    marked = marked.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), "target")
    marked = written(marked, "marked", "zstd")
    means = score(marked).withColumn("difference", F.col("target_loss") - F.col("background_loss"))
    return marked.select("row", F.col("id").alias(id_col)).join(means.hint("merge"), "row").drop("row")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(documents(spark, sf_dir), labels(spark, sf_dir).filter("quality = 1"))
