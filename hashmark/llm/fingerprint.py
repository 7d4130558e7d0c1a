"""Document fingerprints by a randomised edit embedding of characters.

A walk reads the characters of a text: at each step it writes the character it stands on and then, by a random bit that
depends on the step and the character and is shared by all texts, stays or moves on.  Two walks that an edit has parted
meet again after a few steps, so edit distance becomes Hamming distance.  Walks start anew at content-defined cuts (a
character that is the least of its neighbourhood), so one edit disturbs one segment only and long texts take no longer
walks than short ones.  Every walk goes on to the end of its segment; where a run of stays would keep it from there, it is made
to move.  It gives a bit string, of which a fixed sample of bits, spread over all steps, makes ``BANDS`` bands; for
each of ``SLOTS`` slots the segment whose bands hash least is chosen and lends the slot 16 of its bits.  The share e
of equal slots estimates how many of all segments two texts have in common, and 2 e / (1 + e), their likeness, how much of
either text.  ``near_links`` finds texts with like fingerprints by bands of sampled bits and verifies each candidate on the
Hamming distance of the whole fingerprints.

NULL and empty texts have one fingerprint of their own and are alike with nothing but each other.  Equal texts have equal
fingerprints.  Rows that repeat, or share an id, are ordered by their text.  Columns besides the id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.components import components
from hashmark.llm.minhash import BLOCK_ROWS, SLICE_ROWS, dealt_copies
from hashmark.llm.tables import arrow_map, documents, ship, written
from hashmark.llm.textbytes import mix, stream

SLOTS = 64
#: A cut falls on a character whose hash is least among the ``REACH`` before and after it; segments are cut at ``LONGEST`` too.
REACH = 12
LONGEST = 64
#: Steps that a walk may take (it moves at every other one), those whose characters are sampled, and bands of a segment.
STEPS = 3 * LONGEST
SAMPLED = STEPS * 5 // 16
BANDS = 4
CHUNK_CHARS = 1 << 19
#: Slots of a banding key and number of keys, for candidate pairs.
KEY_SLOTS = 4
KEYS = 16

_BITS = stream(21, STEPS)
#: One sampled step in each of ``SAMPLED`` equal stretches, dealt to the bands in turn.
_PICKED = (np.arange(SAMPLED) * STEPS + (stream(22, SAMPLED) % np.uint64(STEPS)).astype(np.int64)) // SAMPLED
_BAND_OF = dict(zip(_PICKED.tolist(), (np.arange(SAMPLED) % BANDS).tolist(), strict=True))
_SLOT_FACTORS, _SLOT_SHIFTS = stream(23, SLOTS) | np.uint64(1), stream(24, SLOTS)


def _segments(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every segment.  Texts stand at ``starts`` to ``stops`` with ``REACH`` zeros or more after each."""
    n, most = len(points), np.iinfo(np.uint64).max
    local = np.zeros(n, dtype=np.uint64)
    for k in range(3):  # a cut is decided by three characters
        local[: n - k] = mix(local[: n - k] + points[k:].astype(np.uint64) + np.uint64(k + 1))
    real = np.zeros(n + 1, dtype=np.int8)
    real[starts] = 1
    real[stops] = -1
    real = np.cumsum(real[:n]) > 0
    local[~real] = most
    around = np.full(n + 2 * REACH, most, dtype=np.uint64)
    around[REACH : REACH + n] = local
    width = 1
    while 2 * width <= 2 * REACH + 1:
        around = np.minimum(around[: len(around) - width], around[width:])
        width *= 2
    rest = 2 * REACH + 1 - width
    if rest:
        around = np.minimum(around[: len(around) - rest], around[rest:])
    begins = np.union1d(np.flatnonzero((local == around) & real), starts)
    rows = np.searchsorted(starts, begins, side="right") - 1
    ends = np.minimum(np.append(begins[1:], n), stops[rows])
    more = (ends - begins - 1) // LONGEST
    if more.any():
        begins = np.repeat(begins, more + 1) + LONGEST * (np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
        rows, ends = np.repeat(rows, more + 1), np.minimum(begins + LONGEST, np.repeat(ends, more + 1))
    return begins, ends, rows


def _embedded(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each band of each segment: its first character and those that the walk writes at the band's steps."""
    at, live = begins, np.arange(len(begins))
    bands = mix(points[begins].astype(np.uint64)[:, None] * np.uint64(31) + np.arange(1, BANDS + 1, dtype=np.uint64))
    for step in range(STEPS):
        sign = points[at].astype(np.uint64)
        if step in _BAND_OF:
            b = _BAND_OF[step]
            bands[live, b] = mix(bands[live, b] * np.uint64(31) + sign + np.uint64(b + 1))
        moves = (sign * np.uint64(0x9E3779B97F4A7C15) + _BITS[step]) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(63)
        at = at + (moves.astype(bool) | (ends - at >= STEPS - step))
        going = at < ends
        live, at, ends = live[going], at[going], ends[going]
    return bands


def embed_segments(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of every segment, one column for each band, and the segment's text."""
    begins, ends, rows = _segments(points, starts, stops)
    return _embedded(points, begins, ends), rows


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of ``SLOTS`` 16-bit values for each text."""
    out = np.zeros((len(texts), SLOTS), dtype=np.uint16)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_CHARS):
            size += len(texts[hi])
            hi += 1
        some = np.array([k for k in range(lo, hi) if texts[k]], dtype=np.int64) - lo
        if len(some):
            gap = "\0" * (REACH + 3)
            lengths = np.array([len(texts[lo + k]) for k in some], dtype=np.int64)
            points = np.frombuffer((gap.join([texts[lo + k] for k in some]) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            starts = np.cumsum(lengths + len(gap)) - lengths - len(gap)
            bands, rows = embed_segments(points, starts, starts + lengths)
            edges = np.searchsorted(rows, np.arange(len(some) + 1))
            for k, row in enumerate(some.tolist()):
                own = np.unique(bands[edges[k] : edges[k + 1]])
                least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
                for a in range(0, len(own), 4096):
                    np.minimum(least, (own[a : a + 4096, None] * _SLOT_FACTORS + _SLOT_SHIFTS).min(axis=0), out=least)
                out[lo + row] = (mix(least) >> np.uint64(48)).astype(np.uint16) | 1
        lo = hi
    return out


def likeness(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    equal = (first == second).mean(axis=1)
    return 2 * equal / (1 + equal)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part``, ``ahead``, ``id``, ``text``: ranges of falling ids, equal ids by their text, NULL last.

    Every range ends with rows ``ahead`` that repeat the first of the range after it (of the first range, in the last).
    Ranges are cut at quantiles of the ids, as many as the session has shuffle partitions; one head id a range is looked
    up, so what is collected and broadcast is bounded by that number.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    ship(spark)
    least = -(1 << 63)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("at"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = texts.agg(F.percentile_approx("at", [k / ranges for k in range(1, ranges)], 10_000).alias("cuts")).first()
    bounds = np.array(sorted(set(row["cuts"] or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(at: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, at.to_numpy(), side="left")).astype("int32")

    dealt = texts.withColumn("part", part_of("at"))
    tops = sorted((r["part"], r["top"]) for r in dealt.select("part", "at").groupBy("part").agg(F.max("at").alias("top")).collect())
    heads = [(tops[(k + 1) % len(tops)][1], part) for k, (part, _) in enumerate(tops)]
    ahead = texts.join(F.broadcast(spark.createDataFrame(heads, "at long, part int")), "at")
    columns = ("part", "at", "id", "text")
    both = dealt.select(*columns, F.lit(False).alias("ahead")).unionByName(ahead.select(*columns, F.lit(True).alias("ahead")))
    return both.repartition("part").sortWithinPartitions("part", "ahead", F.desc("at"), "text").select("part", "ahead", "id", "text")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text has its last ``n_chars // 2`` characters replaced by as many of the first of the next row's text.
    Fingerprints are hexadecimal, four digits a slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                held += zip(*(c.to_pylist() for c in part.columns), strict=True)
                yield _compared(held)
                held = held[-1:]

    schema = (
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return arrow_map(with_next(docs, id_col, text_col), run, schema)


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """Each own row of ``rows`` that a row of its range follows, compared with its edited text and with that row."""
    own = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k + 1][0] == rows[k][0]]
    texts = [r[3] for r in rows]
    edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in own]
    marks, edited_marks = fingerprints(texts), fingerprints(edited)
    at = np.array(own, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[k][2] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array([marks[k].astype(">u2").tobytes().hex() for k in own], pa.string()),
            pa.array([m.astype(">u2").tobytes().hex() for m in edited_marks], pa.string()),
            pa.array(likeness(marks[at], edited_marks)), pa.array(likeness(marks[at], marks[at + 1])),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _agreeing(pairs: DataFrame, slots: int) -> DataFrame:
    """``centre``, ``id`` and whether their fingerprints (``m1``, ``m2``) agree in ``slots`` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m1, m2 = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((m1 == m2).sum(axis=1) >= slots)], names=["centre", "id", "linked"])

    return arrow_map(pairs.select("centre", "id", "m1", "m2"), run, "centre long, id long, linked boolean")


def _rest_links(members: DataFrame, slots: int) -> DataFrame:
    """Links (``a``, ``b``) that join the unlinked members of each centre's group to others of the group, by blocks and slices.

    ``members``: ``centre``, ``id``, ``linked``, ``mark`` and the numbers ``n`` and ``rest`` of members and unlinked members.
    """
    blocks, slices = (F.ceil(F.col(c) / F.lit(size)).cast("int") for c, size in (("rest", BLOCK_ROWS), ("n", SLICE_ROWS)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tries", ascending=False).drop_duplicates("id")
        ids, marks = group["id"].to_numpy(), np.frombuffer(b"".join(group["mark"]), np.uint16).reshape(-1, SLOTS)
        found, label = [], np.arange(len(ids))
        for i in range(int(group["tries"].sum())):
            same = marks == marks[i]
            close = (same.sum(axis=1) >= slots) & same.reshape(len(ids), KEYS, -1).all(axis=2).any(axis=1)
            for other in np.unique(label[close]).tolist():
                if other != label[i]:
                    found.append((ids[label[i]], ids[other]))
                    label[label == other] = label[i]
        return pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype="int64")

    ship(members.sparkSession)
    return dealt_copies(members, blocks, slices).groupBy("centre", "block", "slice").applyInPandas(run, "a long, b long")


def near_links(marked: DataFrame, slots: int = 40) -> DataFrame:
    """``marked`` with the ``component_id`` of the rows whose fingerprints, linked where ``slots`` slots or more agree, hang together.

    ``marked`` has ``id`` and ``fingerprint``.  Equal fingerprints are one class.  Classes that share a band of ``KEY_SLOTS``
    slots are candidates.  Each is tried against one centre of its band; what the centre does not confirm is then compared
    with all that met that centre, in bounded tasks, so that no link between candidates is lost and none depends on which class
    is a centre.  A component is named by
    its smallest id: NULL if none of its rows has one.
    """
    mark = F.unhex("fingerprint")
    numbered = marked.select(mark.alias("mark"), "id").groupBy("mark").agg(F.min("id").alias("least"))
    classes = written(numbered.withColumn("id", F.monotonically_increasing_id()), "marks")
    width = 2 * KEY_SLOTS
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring("mark", 1 + width * k, width)) for k in range(KEYS)))
    keyed = classes.select("id", F.explode(bands).alias("key"))
    centres = keyed.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(centres.select("key", "centre"), "key").filter("id != centre").select("centre", "id").distinct()
    full = met.join(classes.select("id", F.col("mark").alias("m2")), "id").join(
        classes.select(F.col("id").alias("centre"), F.col("mark").alias("m1")), "centre"
    )
    tried = written(_agreeing(full, slots), "tried")
    groups = tried.groupBy("centre").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("rest"))
    members = tried.join(groups.filter("n > 1 AND rest > 0"), "centre").join(classes.select("id", "mark"), "id")
    links = tried.filter("linked").select(F.col("centre").alias("a"), F.col("id").alias("b")).unionByName(_rest_links(members, slots))
    rooted = classes.join(components(links), "id", "left").select("mark", "least", F.coalesce("component_id", "id").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select("mark", "component_id")
    return marked.withColumn("mark", mark).join(named, "mark").drop("mark")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(written(fingerprinted(documents(spark, sf_dir)), "fingerprints")).withColumnRenamed("id", "doc_id")
