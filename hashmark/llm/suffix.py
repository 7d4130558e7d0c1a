"""Removal of byte strings that repeat anywhere in the corpus, by bucket-pointer refinement of sampled suffixes.

Suffixes start in q-gram buckets (q = 64) and are refined by the bucket identifiers of their later offsets, an identifier
of 2 m bytes being made of two of m bytes, until buckets stand for strings of 200 bytes.  Three things keep this small:

* each window of 200 bytes is represented by one suffix inside it, the one with the least q-gram bucket, so that about
  one suffix in 70 is sampled, and equal windows sample the same offset;
* a bucket with one suffix in it is never looked at again;
* a run of windows around one sampled suffix is refined as a whole first (by the 200-byte buckets of its first and last
  window); only runs that differ from all others of their q-gram bucket are refined window by window, in a task that
  holds the surroundings of one bucket, or of a part of a large one.

All of this is counted by grouped aggregates and joins, so a passage that a third of all documents share is one group key
that is combined map-side.  Identifiers are 64-bit; a window is named by two of them.

Texts shorter than the string, empty and NULL texts lose nothing.  Rows that repeat are copies and lose what they share;
rows with one id or none but different texts are told apart.  Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.tables import arrow_map, documents, written
from hashmark.llm.textbytes import BYTE_VALUES, flat, mix

GRAM = 64
LENGTH = 200
#: Stands for a missing id inside.
NO_ID = -(1 << 63)
#: Windows looked at together in a very long text.
PIECE_WINDOWS = 1 << 20
#: Runs of one q-gram bucket that a task refines together, about; larger buckets are split and their parts matched by name.
PART_ROWS = 4096


def _pair(first: np.ndarray, later: np.ndarray, factor: int) -> np.ndarray:
    """The bucket of a suffix, refined by the bucket of one of its later offsets."""
    return mix(first * np.uint64(factor) + later)


def buckets(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the ``GRAM``-byte and of the ``length``-byte string at each offset where one fits."""
    name, width = BYTE_VALUES[data], 1
    gram = name
    while 2 * width <= length:
        name = _pair(name[: len(name) - width], name[width:], 0x9E3779B97F4A7C15 + 2 * width)
        width *= 2
        if width == GRAM:
            gram = name
    rest = length - width
    if rest:
        name = _pair(name[: len(name) - rest], name[rest:], 0xD1B54A32D192ED03)
    return gram, name


def sampled(gram: np.ndarray, windows: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sampled suffix of each window: that with the smallest bucket, the leftmost of equals.

    Returned by runs of windows with one sampled suffix: its offset, the first and the last window.
    """
    reach = length - GRAM + 1
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= reach:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    rest = reach - width
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], windows) - 1


def _pieces(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo in range(0, len(data) - length + 1, PIECE_WINDOWS):
        yield lo, data[lo : lo + PIECE_WINDOWS + length - 1]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    data, offsets = flat(batch.column(column))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


def _longs(values: list[np.ndarray]) -> pa.Array:
    joined = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.array(joined.view(np.int64) if joined.dtype == np.uint64 else joined)


def _grams(docs: DataFrame, length: int) -> DataFrame:
    """``gram`` of every sampled suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in _texts(batch, 0):
                for _, piece in _pieces(text, length):
                    gram, name = buckets(piece, length)
                    out.append(gram[sampled(gram, len(name), length)[0]])
            yield pa.RecordBatch.from_arrays([_longs(out)], names=["gram"])

    return arrow_map(docs.select("text"), run, "gram long")


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """A row for every run: ``gram``, ``context`` (names all bytes of the run), ``id``, ``tag``, ``first``, ``span``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, contexts, rows, firsts, spans = [], [], [], [], []
            for k, text in enumerate(_texts(batch, 2)):
                for lo, piece in _pieces(text, length):
                    gram, name = buckets(piece, length)
                    at, first, last = sampled(gram, len(name), length)
                    grams.append(gram[at])
                    shape = ((last - first) * length + at - first).astype(np.uint64)
                    contexts.append(_pair(_pair(name[first], name[last], 0x9FB21C651E98DF25), shape, 0xA24BAED4963EE407))
                    rows.append(np.full(len(at), k))
                    firsts.append(first + lo)
                    spans.append(last - first)
            at = _longs(rows)
            yield pa.RecordBatch.from_arrays(
                [_longs(grams), _longs(contexts), batch.column(0).take(at), batch.column(1).take(at), _longs(firsts), _longs(spans).cast(pa.int32())],
                names=["gram", "context", "id", "tag", "first", "span"],
            )

    return arrow_map(docs.select("id", "tag", "text"), run, "gram long, context long, id long, tag int, first long, span int")


def _surroundings(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs listed with each text: ``gram``, ``part``, ``parts``, ``id``, ``tag``, ``first``, ``single``, ``raw``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            listed = lists.flatten()
            firsts, spans = (listed.field(n).to_numpy(zero_copy_only=False).tolist() for n in ("first", "span"))
            edges = np.cumsum([0, *(len(x) for x in lists)]).tolist()
            raw, rows = [], []
            for k, text in enumerate(_texts(batch, 2)):
                for j in range(edges[k], edges[k + 1]):
                    raw.append(text[firsts[j] : firsts[j] + spans[j] + length].tobytes())
                    rows.append(k)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [listed.field("gram"), listed.field("part"), listed.field("parts"), batch.column(0).take(at), batch.column(1).take(at),
                 listed.field("first"), listed.field("single"), pa.array(raw, pa.binary())],
                names=["gram", "part", "parts", "id", "tag", "first", "single", "raw"],
            )

    schema = "gram long, part int, parts int, id long, tag int, first long, single boolean, raw binary"
    return arrow_map(texts.select("id", "tag", "text", "runs"), run, schema)


def _refine(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Sort the windows of whole (gram, part) groups by their buckets.

    Out come the windows of single runs that repeat in their group (``name`` is NULL), as runs, and, where a q-gram bucket
    was split into parts, one window for each other bucket, named, to be matched with those of the other parts.
    """
    raw = rows.column("raw").combine_chunks()
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    counts = np.diff(offsets) - length + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    name = buckets(data, length)[1][offsets[:-1][owner] + step]
    gram, part = rows.column("gram").to_numpy(), rows.column("part").to_numpy()
    group = np.cumsum(np.concatenate([[0], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
    order = np.lexsort((name, group[owner]))
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = (name[order][1:] == name[order][:-1]) & (group[owner[order]][1:] == group[owner[order]][:-1])
    found = np.zeros(len(order), dtype=bool)
    found[order] = same[1:] | same[:-1]
    single = rows.column("single").to_numpy()
    hit = found & single[owner]
    begin = hit.copy()
    begin[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))
    final = hit.copy()
    final[:-1] &= ~(hit[1:] & (owner[1:] == owner[:-1]))
    at, end = np.flatnonzero(begin), np.flatnonzero(final)
    first_of_name = np.zeros(len(order), dtype=bool)
    first_of_name[order] = ~same[:-1]
    named = np.flatnonzero(first_of_name & (rows.column("parts").to_numpy() > 1)[owner])
    pick = np.concatenate([at, named])
    first = rows.column("first").to_numpy()[owner[pick]] + step[pick]
    shown = np.concatenate([np.zeros(len(at), bool), np.ones(len(named), bool)])
    taken = pa.array(owner[pick])
    return pa.RecordBatch.from_arrays(
        [pa.array(gram[owner[pick]]), pa.array(name[pick].view(np.int64), mask=~shown), *(rows.column(c).combine_chunks().take(taken) for c in ("id", "tag")),
         pa.array(first), pa.array(np.concatenate([end - at, np.zeros(len(named), np.int64)]), pa.int32()),
         pa.array(np.concatenate([np.ones(len(at), bool), (single[owner] & ~found)[named]]))],
        names=["gram", "name", "id", "tag", "first", "span", "single"],
    )


def _refined(surroundings: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            gram, part = held.column("gram").to_numpy(), held.column("part").to_numpy()
            last = int(np.count_nonzero((gram != gram[-1]) | (part != part[-1]))) if len(gram) else 0
            if last:  # the rows are in the order of their groups; the last group may go on
                yield _refine(held.slice(0, last), length)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield _refine(held, length)

    dealt = surroundings.repartition("gram", "part").sortWithinPartitions("gram", "part")
    return arrow_map(dealt, run, "gram long, name long, id long, tag int, first long, span int, single boolean")


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """``id``, ``kept`` (remaining bytes), ``n_bytes``, ``n_removed``, ``n_spans`` for each text and its repeated runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            kept, counts = [], []
            for k, text in enumerate(_texts(batch, 1)):
                steps = np.zeros(len(text) + 1, dtype=np.int64)
                if lists[k].is_valid and len(text) >= length:
                    spans = lists[k].values
                    first = spans.field("first").to_numpy(zero_copy_only=False)
                    np.add.at(steps, first, 1)
                    np.add.at(steps, first + spans.field("span").to_numpy(zero_copy_only=False) + length, -1)
                gone = np.cumsum(steps)[:-1] > 0
                begins = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                kept.append(text[~gone].tobytes())
                counts.append((len(text), int(gone.sum()), begins))
            columns = np.array(counts, dtype=np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), *(pa.array(c) for c in columns), batch.column(3)],
                names=["id", "kept", "n_bytes", "n_removed", "n_spans", "others"],
            )

    others = texts.schema["others"].dataType.simpleString()
    schema = f"id long, kept binary, n_bytes long, n_removed long, n_spans long, others {others}"
    return arrow_map(texts.select("id", "text", "spans", "others"), run, schema)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col``, ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans`` of every row.

    A byte goes if a string of ``length`` bytes covers it that starts anywhere else as well; strings are those of the input
    and end with their text.  The columns ``others`` come along in one struct, ``others``.
    """
    if length < GRAM:
        raise ValueError(f"strings are at least {GRAM} bytes long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    beside = F.struct(*others) if others else F.lit(None).cast("string")
    whole_rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.hash(text).alias("tag"), text.alias("text"), beside.alias("others")
    )
    texts = whole_rows.drop("others")
    shared = written(_grams(texts, length).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "shared-grams")
    runs = written(_runs(texts, length).join(shared, "gram"), "shared-runs")
    contexts = written(
        runs.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "tag", "first", "span")).alias("one")), "contexts"
    )
    open_grams = contexts.groupBy("gram").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("u")).filter("m > 1 AND u > 0")
    parts = F.ceil(F.col("m") / F.lit(PART_ROWS)).cast("int")
    asked = contexts.join(open_grams, "gram").select(
        "one.id", "one.tag",
        F.struct(
            "gram", F.pmod(F.xxhash64("context"), parts).cast("int").alias("part"), parts.alias("parts"), "one.first", "one.span",
            (F.col("n") == 1).alias("single"),
        ).alias("run"),
    )
    listed = asked.groupBy("id", "tag").agg(F.collect_list("run").alias("runs"))
    refined = written(_refined(_surroundings(texts.join(listed, ["id", "tag"]), length), length), "refined")
    named = refined.filter("name IS NOT NULL")
    across = named.groupBy("gram", "name").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "name")
    single = refined.filter("name IS NULL").select("id", "tag", "first", "span").unionByName(
        named.filter("single").join(across, ["gram", "name"]).select("id", "tag", "first", "span")
    )
    whole = runs.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"]).select("id", "tag", "first", "span")
    spans = whole.unionByName(single).groupBy("id", "tag").agg(F.collect_set(F.struct("first", "span")).alias("spans"))
    spans = written(spans, "spans")
    cut = _cut(whole_rows.join(spans, ["id", "tag"], "left"), length)
    named = [F.nullif("id", F.lit(NO_ID)).alias(id_col), "kept", "n_bytes", "n_removed", "n_spans"]
    return cut.select(*named, *(["others"] if others else []))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
