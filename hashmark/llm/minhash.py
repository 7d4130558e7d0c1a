"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A signature has ``SYMBOLS`` symbols of 16 bits, one per hash function, in chunks of five or six.  Two signatures that
differ in at most ``2 * chunks - 1`` symbols agree, but for one symbol, in some chunk (pigeonhole); so each chunk is
entered once for every symbol that may be wrong, that symbol left out.  All pairs within that distance meet under a key.

Links are confirmed on the full shingle sets.  Documents with equal sets are one class first.  Under a key every class is
paired with the smallest one only, its centre; what the centre does not confirm is then compared, block by block, with
everything that met the same centre, so that no link within the distance is lost and no group is expanded into rows of pairs.
A class whose signature is far from its centre's is compared so if another that met the centre is within the distance.

NULL and blank texts have no shingles and no links; texts shorter than a shingle are one shingle; equal rows are copies of
each other; an empty table gives an empty result.  Rows without an id take no part: they have no component and are
kept.  Classes are numbered, not known by an id, so rows that share an id but not the text are linked each on its own text.
Columns besides the id and the text are not read, but for those named to come along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.components import components
from hashmark.llm.tables import arrow_map, documents, ship, written
from hashmark.llm.textbytes import mix, shingle_sets, stream

SYMBOLS = 32
CHUNKS = (5, 5, 5, 5, 6, 6)
#: The pigeonhole finds all pairs at up to this distance; a centre confirms those up to ``SCREEN``.
DISTANCE = 2 * len(CHUNKS) - 1
SCREEN = 18
#: A task that compares the rest of a group holds about so many unlinked members, and so many members and shingles of the group.
BLOCK_ROWS = 512
SLICE_ROWS = 2048
SLICE_SHINGLES = 1 << 20

_FACTORS, _SHIFTS = stream(3, SYMBOLS) | np.uint64(1), stream(4, SYMBOLS)


def signature(found: np.ndarray) -> np.ndarray:
    """16-bit symbols of a non-empty set of 64-bit hashes."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(found), 4096):
        np.minimum(least, (found[lo : lo + 4096, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """One column for each symbol: the key of its chunk with that symbol left out."""
    symbols = signatures.astype(np.uint64)
    out, lo = [], 0
    for c, size in enumerate(CHUNKS):
        for left_out in range(size):
            key = np.full(len(symbols), 64 * c + left_out + 1, dtype=np.uint64)
            for k in range(size):
                if k != left_out:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, lo + k])
            out.append(key)
        lo += size
    return np.stack(out, axis=1)


def sketched(docs: DataFrame, size: int, id_col: str, text_col: str, others: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``n_shingles``, two hashes of the set (``h1``, ``h2``), its ``signature`` (NULL if empty) and the ``tag`` of the text.

    The columns ``others`` come along in one struct, ``others``.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _tag(text_col).alias("tag"),
        *([F.struct(*others).alias("others")] if others else []),
    )
    more = [(c, rows.schema[c].dataType.simpleString()) for c in rows.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, h1, h2, marks = [], [], [], []
            for found in shingle_sets(batch.column(1), size):
                counts.append(len(found))
                h1.append(int(np.bitwise_xor.reduce(mix(found + np.uint64(11)), initial=0)))
                h2.append(int(np.add.reduce(mix(found + np.uint64(12)), dtype=np.uint64)))
                marks.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)),
                pa.array(np.array(h2, np.uint64).view(np.int64)), pa.array(marks, pa.binary()), *batch.columns[2:],
            ], names=["doc_id", "n_shingles", "h1", "h2", "signature", *(c for c, _ in more)])

    schema = "doc_id long, n_shingles long, h1 long, h2 long, signature binary, " + ", ".join(f"{c} {kind}" for c, kind in more)
    return arrow_map(rows, run, schema)


def _tag(text_col: str) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keyed(classes: DataFrame) -> DataFrame:
    """``key``, ``id``: a row for every key of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
                keys = chunk_keys(marks)
                ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return arrow_map(classes.select("id", "signature"), run, "key long, id long")


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _met(pairs: DataFrame) -> DataFrame:
    """``centre``, ``id``, ``near`` (``s1`` and ``s2`` differ in at most ``SCREEN`` symbols) and the member's ``signature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_marks(batch.column(2)) != _marks(batch.column(3))).sum(axis=1) <= SCREEN
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near), batch.column(3)], names=["centre", "id", "near", "signature"])

    return arrow_map(pairs.select("centre", "id", "s1", "s2"), run, "centre long, id long, near boolean, signature binary")


def _far_with_company(met: DataFrame) -> DataFrame:
    """``centre``, ``id`` of the members that are not ``near``, but within ``DISTANCE`` of another that met the centre.

    A task gets a block of these and a slice of the group, as in ``_compare_rest``, and no texts.
    """
    sizes = met.groupBy("centre").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("rest")).filter("n > 1 AND rest > 0")
    members = met.join(sizes, "centre").withColumnRenamed("near", "linked")
    blocks, slices = (F.ceil(F.col(c) / F.lit(size)).cast("int") for c, size in (("rest", BLOCK_ROWS), ("n", SLICE_ROWS)))

    def run(group: pa.Table) -> pa.Table:
        marks, ids, tries = _marks(group.column("signature")), group.column("id").to_numpy(), group.column("tries").to_numpy(zero_copy_only=False)
        rest, all_rows = np.flatnonzero(tries), np.flatnonzero(~tries)
        meets = [i for i in rest.tolist() if (((marks[all_rows] != marks[i]).sum(axis=1) <= DISTANCE) & (ids[all_rows] != ids[i])).any()]
        found = ids[np.array(meets, dtype=np.int64)]
        return pa.table({"centre": np.full(len(found), group.column("centre")[0].as_py(), dtype=np.int64), "id": found})

    ship(met.sparkSession)
    dealt = dealt_copies(members, blocks, slices)
    return dealt.groupBy("centre", "block", "slice").applyInArrow(run, "centre long, id long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id`` and the sorted distinct shingle hashes of the classes in ``wanted`` (``id``, and ``doc_id`` and ``tag`` of a row).

    The join shuffles the texts whatever the number of wanted ids, so that the plan is one at every size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), size))
            offsets = np.cumsum([0] + [len(x) for x in found])
            values = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _tag(text_col).alias("tag"))
    found = texts.join(wanted.hint("merge"), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])
    return arrow_map(found.select("id", "text"), run, "id long, shingles array<long>")


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """``centre``, ``id`` and ``linked`` of pairs that come with both sets (``t1``, ``t2``)."""
    both = F.size(F.array_intersect("t1", "t2"))
    linked = 100 * both >= percent * (F.size("t1") + F.size("t2") - both)
    return pairs.select("centre", "id", linked.alias("linked"), F.size("t2").alias("n_shingles"))


def dealt_copies(members: DataFrame, blocks: Column, slices: Column) -> DataFrame:
    """``block``, ``slice`` and ``tries`` for each copy of a member.

    A group's unlinked members are dealt into blocks and all its members into slices.  A slice's members visit every block,
    and a block's unlinked ones, which are to be tried there, every slice.
    """
    block, part = F.pmod(F.xxhash64("id"), blocks).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), slices).cast("int")

    def copy(block: Column, part: Column, tries: bool) -> Column:
        return F.struct(block.alias("block"), part.alias("slice"), F.lit(tries).alias("tries"))

    visits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: copy(b, part, False))
    stays = F.transform(F.sequence(F.lit(0), slices - 1), lambda s: copy(block, s, True))
    copies = F.when(F.col("linked"), visits).otherwise(F.concat(visits, stays))
    return members.withColumn("copy", F.explode(copies)).select(*members.columns, "copy.*")


def _compare_rest(members: DataFrame, percent: int, slices: Column | None = None) -> DataFrame:
    """Links (``a``, ``b``) that join the unlinked members of each centre's group to others of the group.

    ``members``: ``centre``, ``id``, ``linked``, ``shingles`` and the number ``rest`` of unlinked members.  ``slices`` is the
    number of parts of a group.  A task gets one block of unlinked members and one slice of the group, however large the
    group is, and counts common shingles by an inverted index.  Of the links it finds, those that join what was apart come
    out: fewer than it has members.
    """
    blocks = F.ceil(F.col("rest") / F.lit(BLOCK_ROWS)).cast("int")
    dealt = dealt_copies(members, blocks, F.lit(1) if slices is None else slices.cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tries", ascending=False).drop_duplicates("id")
        sets = [np.asarray(x, dtype=np.int64) for x in group["shingles"]]
        ids, sizes = group["id"].to_numpy(), np.array([len(x) for x in sets])
        rest = np.flatnonzero(group["tries"].to_numpy())
        tokens = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        found, above = [], list(range(len(sets)))

        def top(k: int) -> int:
            while above[k] != k:
                above[k] = above[above[k]]
                k = above[k]
            return k

        for i in rest.tolist():
            lo, hi = np.searchsorted(tokens, sets[i]), np.searchsorted(tokens, sets[i], side="right")
            at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(int((hi - lo).sum()))
            both = np.bincount(owners[at], minlength=len(sets))
            close = 100 * both >= percent * (sizes + sizes[i] - both)
            for j in np.flatnonzero(close).tolist():
                x, y = top(i), top(j)
                if x != y:
                    above[y] = x
                    found.append((ids[i], ids[j]))
        return pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype="int64")

    ship(members.sparkSession)
    return dealt.groupBy("centre", "block", "slice").applyInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    With ``others``, these columns come along in one struct, ``others``, and ``first`` is true for one row of each component,
    where ``kept`` is true for all rows that have its smallest id; rows that take no part are ``first``, too.

    Documents whose sets of ``size``-word shingles have at least ``percent`` % in common are linked; a component is named
    by its smallest id, which is the one kept.
    """
    sketch = sketched(docs, size, id_col, text_col, others)
    sketch = written(sketch.withColumn("row", F.monotonically_increasing_id()) if others else sketch, "sketch")
    some = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    top = F.min(F.struct("doc_id", "tag", *(["row"] if others else [])))
    classes = written(
        some.groupBy("h1", "h2", "n_shingles").agg(top.alias("top"), F.first("signature").alias("signature"))
        .withColumn("id", F.monotonically_increasing_id()), "classes"
    )
    keys = keyed(classes)
    centres = keys.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    first = keys.join(centres.select("key", "centre"), "key").filter("id != centre").select("centre", "id").distinct()
    marks = classes.select("id", "signature")
    signed = (
        first.join(marks.withColumnRenamed("signature", "s2"), "id")
        .join(marks.select(F.col("id").alias("centre"), F.col("signature").alias("s1")), "centre")
    )
    met = written(_met(signed), "met")
    pairs = written(met.filter("near").select("centre", "id").unionByName(_far_with_company(met)), "pairs")
    wanted = pairs.select("id").unionByName(pairs.select(F.col("centre").alias("id"))).distinct()
    wanted = wanted.join(classes.select("id", "top.doc_id", "top.tag"), "id")
    sets = written(_sets(docs, wanted, size, id_col, text_col), "sets")
    full = (
        pairs.join(sets.withColumnRenamed("shingles", "t2"), "id")
        .join(sets.select(F.col("id").alias("centre"), F.col("shingles").alias("t1")), "centre")
    )
    tried = written(_confirm(full, percent), "tried")
    groups = tried.groupBy("centre").agg(
        F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("rest"), F.sum("n_shingles").alias("held")
    )
    slices = F.ceil(F.greatest(F.col("n") / F.lit(SLICE_ROWS), F.col("held") / F.lit(SLICE_SHINGLES))).cast("int")
    open_groups = groups.filter("n > 1 AND rest > 0").select("centre", "rest", slices.alias("slices"))
    members = tried.drop("n_shingles").join(open_groups, "centre").join(sets, "id")
    rest = _compare_rest(members, percent, F.col("slices"))
    links = tried.filter("linked").select(F.col("centre").alias("a"), F.col("id").alias("b")).unionByName(rest)
    roots = components(links)
    rooted = classes.join(roots, "id", "left").select("h1", "h2", "n_shingles", "top", F.coalesce("component_id", "id").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("top").alias("head"))
    named = rooted.drop("top").join(heads, "root").drop("root")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("head.doc_id", "doc_id"))
    result = sketch.join(named, ["h1", "h2", "n_shingles"], "left").withColumn("component_id", component)
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")]
    if others:
        alone = F.col("doc_id").isNull() | F.col("head").isNull()
        columns += [(alone | (F.col("head.row") == F.col("row"))).alias("first"), "others"]
    return result.select(*columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)
