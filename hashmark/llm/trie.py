"""Prefix trie of rebuilt conversations, by composable fingerprints.

A rebuilt conversation is the head of another conversation followed by its own later turns.  Its text is never put together:
the fingerprint of a sequence of turns is a polynomial over the turns' digests, ``(u v) = (u) x^|v| + (v)``, so the prefixes
of a rebuilt conversation follow from those of its base and its own by a difference and a power of ``x``.

* Turns are put in order by one range exchange; each task folds its own, and what runs on from one task into the next is
  carried over as one product a task, so a conversation of any length is many tasks' work.
* A node is a group of (depth, fingerprint).  The fingerprints of a group's prefixes are the same, and so are the digests of
  the turns that they refer to last, hence (``x`` has an inverse) the fingerprints one turn before.  Each digest stands for
  one role and text, which is verified on the turns themselves; by induction all prefixes of a group are equal.  Where either
  check fails, everything is done again with other constants.
* Subtrees are never walked.  Each conversation owns the nodes of which it is the smallest member; they are the end of its
  path.  Sums over a subtree are then sums over a node's members of what each owns: one grouped aggregate at any depth.

NULL roles and texts are empty; rows without a conversation id take no part; the id has to be a whole number.  NULL turns
come first, equal ones are ordered by the md5 of ``length of role:role text``.  Repeated rows are turns of their own.  No rows
give no nodes, not even a root.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.hot import join_groups
from hashmark.llm.tables import arrow_map, word_array, written

#: Field of the fingerprints, and the two points at which the polynomials are taken (one more for each further attempt).
FIELD = (1 << 61) - 1
POINTS = (1_181_783_497_276_652_981, 723_471_715_091_736_653)
ATTEMPTS = 5
#: Ids that are written out and joined by one task before a node's hash reads them.
CHUNK_IDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def prefix_trie(
    conversations: DataFrame,
    base: Callable[[Column], Column],
    head: Callable[[Column], Column],
    max_head: int,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    field: Callable[[int], int] = lambda attempt: FIELD,
) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    ``base`` and ``head`` give, for a conversation's id, the conversation whose head it takes and how many turns of it
    (``max_head`` at most); the same number of its own first turns goes.  ``conv_id`` and ``depth`` name a node by its smallest
    member; ``last_conv`` and ``last_turn`` say where its last turn is stored (position from 1).
    """
    turns = conversations.select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("c IS NOT NULL")
    for attempt in range(ATTEMPTS):
        p, points = field(attempt), [x + attempt for x in POINTS]
        own = _own_prefixes(turns, attempt, p, points)
        seams = written(_seams(own, base, head, max_head, p), "trie-seams")
        paths = written(_paths(own, seams, p, points), "trie-paths")
        nodes = written(
            paths.groupBy("d", "f1", "f2").agg(
                F.count("*").alias("n"), F.min("c").alias("owner"), F.count_if(F.col("d") == F.col("len")).alias("n_ends"),
                ((F.min("t1") == F.max("t1")) & (F.min("t2") == F.max("t2"))).alias("same"),
            ),
            "trie-nodes",
        )
        if _holds(turns, nodes, attempt):
            return _figures(paths, nodes)
    raise ValueError(f"fingerprints collided in {ATTEMPTS} attempts")


def _content(attempt: int) -> Column:
    mark = F.lit(f"{attempt}#" if attempt else "")
    return F.md5(F.concat(mark, F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


def _digest(attempt: int) -> list[Column]:
    """Two numbers of 60 bits each from a turn's role and text."""
    return [F.conv(F.substring(_content(attempt), at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "t1"), (16, "t2"))]


def _holds(turns: DataFrame, nodes: DataFrame, attempt: int) -> bool:
    """Whether the last turns of each node have one digest, and each digest one role and text."""
    if nodes.filter(~F.col("same")).limit(1).count():
        return False
    contents = turns.select(*_digest(attempt), "role", "text").distinct()
    return not contents.groupBy("t1", "t2").count().filter("count > 1").limit(1).count()


def _own_prefixes(turns: DataFrame, attempt: int, p: int, points: list[int]) -> DataFrame:
    """Every turn's position in its conversation, and fingerprint and words of the turns up to it."""
    numbered = turns.select("c", "turn", _content(0).alias("tie"), *_digest(attempt), F.size(word_array(F.col("text"))).cast("long").alias("w"))
    ordered = numbered.repartitionByRange("c", "turn", "tie").sortWithinPartitions("c", "turn", "tie").select("c", "t1", "t2", "w")
    schema = "part int, c long, k long, t1 long, t2 long, f1 long, f2 long, w long, cw long"
    x1, x2 = points

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k, f1, f2, cw = TaskContext.get().partitionId(), None, 0, 0, 0, 0
        for batch in batches:
            out = []
            for c, t1, t2, w in zip(*(column.to_pylist() for column in batch.columns)):
                if c != last:
                    last, k, f1, f2, cw = c, 0, 0, 0, 0
                k, f1, f2, cw = k + 1, (f1 * x1 + t1) % p, (f2 * x2 + t2) % p, cw + w
                out.append((part, c, k, t1, t2, f1, f2, w, cw))
            yield _batch(out, schema)

    local = written(arrow_map(ordered, fold, schema), "trie-turns")
    carried = _carries(local, p, points)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, c, k, t1, t2, f1, f2, w, cw in zip(*(column.to_pylist() for column in batch.columns)):
                before = carried.get(part)
                if before is not None and before[0] == c:
                    f1, f2 = (before[2] * pow(x1, k, p) + f1) % p, (before[3] * pow(x2, k, p) + f2) % p
                    k, cw = k + before[1], cw + before[4]
                out.append((part, c, k, t1, t2, f1, f2, w, cw))
            yield _batch(out, schema)

    return arrow_map(local, shift, schema) if carried else local


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = [pa.int32() if field.split()[1] == "int" else pa.int64() for field in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], names=names)


def _carries(local: DataFrame, p: int, points: list[int]) -> dict[int, tuple]:
    """What the first conversation of a task brings along from the tasks before: one row for each task reaches the driver."""
    last = F.max(F.struct("c", "k", "f1", "f2", "cw")).alias("last")
    edges = sorted(local.groupBy("part").agg(F.min("c").alias("first"), last).collect(), key=lambda r: r.part)
    carried, before = {}, None
    for r in edges:
        c, k, f1, f2, cw = r.last
        if before is not None and before[0] == r.first:
            carried[r.part] = before
            if c == r.first:
                _, k0, g1, g2, w0 = before
                f1, f2 = (g1 * pow(points[0], k, p) + f1) % p, (g2 * pow(points[1], k, p) + f2) % p
                k, cw = k + k0, cw + w0
        before = (c, k, f1, f2, cw)
    return carried


def _seams(own: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], max_head: int, p: int) -> DataFrame:
    """One row for each conversation: the head that it takes, its rebuilt length, and what its own prefixes are shifted by."""
    cut = head(F.col("c")).cast("long")
    ends = own.groupBy("c").agg(F.max("k").alias("n_own"), F.max(F.when(F.col("k") == cut, F.struct("f1", "f2", "cw"))).alias("gone"))
    ends = ends.withColumn("h", cut).withColumn("b", base(F.col("c")).cast("long"))
    first = own.filter(F.col("k") <= max_head).groupBy(F.col("c").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("k", "t1", "t2", "f1", "f2", "w", "cw"))).alias("turns")
    )
    taken = ends.join(first, "b", "left").withColumn("head", F.slice(F.coalesce("turns", F.array()), F.lit(1), F.col("h").cast("int")))
    seam, gone = F.try_element_at("head", F.lit(-1)), F.col("gone")

    def moved(name: str) -> Column:
        return F.coalesce(seam[name], F.lit(0)) - F.coalesce(gone[name], F.lit(0))

    return taken.select(
        "c", "h", F.size("head").cast("long").alias("hb"), "head", "n_own", "b",
        (F.size("head") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).cast("long").alias("len"),
        F.pmod(moved("f1"), F.lit(p)).alias("s1"), F.pmod(moved("f2"), F.lit(p)).alias("s2"), moved("cw").alias("sw"),
    )


def _paths(own: DataFrame, seams: DataFrame, p: int, points: list[int]) -> DataFrame:
    """A row for each conversation and depth, the root included: fingerprint, digest and place of the last turn, words."""
    columns = ["c", "len", "d", "t1", "t2", "f1", "f2", "w", "cw", "last_conv", "last_turn"]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = seams.select("c", "len", *[zero.alias(x) for x in columns[2:9]], none.alias("last_conv"), none.alias("last_turn"))
    heads = seams.select("c", "len", "b", F.inline("head")).select(
        "c", "len", F.col("k").alias("d"), *columns[3:9], F.col("b").alias("last_conv"), F.col("k").alias("last_turn")
    )
    x1, x2 = points
    schema = ", ".join(f"{x} long" for x in columns)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, k, t1, t2, f1, f2, w, cw, n, h, hb, s1, s2, sw in zip(*(column.to_pylist() for column in batch.columns)):
                f1, f2 = (f1 + s1 * pow(x1, k - h, p)) % p, (f2 + s2 * pow(x2, k - h, p)) % p
                out.append((c, n, k - h + hb, t1, t2, f1, f2, w, cw + sw, c, k))
            yield _batch(out, schema)

    after = join_groups(own.drop("part"), seams.select("c", "n_own", "len", "h", "hb", "s1", "s2", "sw"), ["c"], "n_own")
    later = after.filter("k > h").select("c", "k", "t1", "t2", "f1", "f2", "w", "cw", "len", "h", "hb", "s1", "s2", "sw")
    return roots.unionByName(heads).unionByName(arrow_map(later, shift, schema))


def _figures(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with what their subtrees hold."""
    keys = ["d", "f1", "f2"]
    shared = nodes.filter("n > 1").select(*keys, "owner", (F.col("n") == F.col("n_ends")).alias("closed"), "n")
    met = join_groups(paths, shared, keys, "n")
    met = met.withColumn("owner", F.coalesce("owner", "c")).withColumn("closed", F.coalesce("closed", F.col("d") == F.col("len")))
    met = written(met, "trie-met")
    # the deepest node that a conversation does not own, and whether it owns a leaf
    other = F.when(F.col("owner") != F.col("c"), F.struct("d", "owner", "cw"))
    share = met.groupBy("c").agg(F.max(other).alias("at"), F.count("*").alias("rows"), F.max(F.when(F.col("d") == F.col("len"), F.col("closed"))).alias("closed"))
    share = share.select(
        "c", F.coalesce("at.d", F.lit(-1)).alias("s"), F.coalesce("at.cw", F.lit(0)).alias("sw"), F.col("at.owner").alias("so"), "rows", F.col("closed").alias("ends_closed"),
    )
    rows = join_groups(met.drop("n", "closed"), written(share, "trie-share"), ["c"], "rows")
    d, s = F.col("d"), F.col("s")
    owned = s < d
    last = F.when(owned, F.struct("last_conv", "last_turn"))
    sums = rows.groupBy(*keys).agg(
        F.min("c").alias("conv_id"), F.max(F.when(owned, F.when(s < d - 1, F.col("c")).otherwise(F.col("so")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"), F.count_if((s <= d) & (d < F.col("len"))).alias("n_children"),
        F.count_if((s < F.col("len")) & F.col("ends_closed")).alias("n_leaves"),
        F.sum(F.greatest(F.lit(0), F.col("sw") - (F.col("cw") - F.col("w")))).alias("saved_tokens"), F.max(last).alias("last"),
        F.count_if(d == F.col("len")).alias("n_ends"), F.min(F.when(d == F.col("len"), F.col("c"))).alias("end"),
    )
    ends = rows.filter("d = len").select(*keys, "c")
    many = _end_hashes(join_groups(ends, nodes.filter("n_ends > 1").select(*keys, "n_ends"), keys, "n_ends").filter("n_ends IS NOT NULL").drop("n_ends"))
    one = F.when(F.col("n_ends") == 0, F.lit(EMPTY)).otherwise(F.sha2(F.col("end").cast("string"), 256))
    return sums.join(many, keys, "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", one).alias("ends_sha256"), "last.*", F.col("f1").alias("fingerprint_1"), F.col("f2").alias("fingerprint_2"),
    )


def _end_hashes(ends: DataFrame) -> DataFrame:
    """The hash of the ids that end at a node, in order.

    Tasks of a range exchange join up to ``CHUNK_IDS`` ids each into one text; a node's hash reads these texts one after the
    other, so that a task that has a hot node reads one row for thousands of ids and holds one at a time.
    """
    keys = ["d", "f1", "f2"]
    names = [*keys, "first", "ids"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def chunk() -> list[tuple]:
            return [(*key, held[0], ",".join(map(str, held)))] if held else []

        for batch in batches:
            out = []
            for d, f1, f2, c in zip(*(column.to_pylist() for column in batch.columns)):
                if (d, f1, f2) != key or len(held) == CHUNK_IDS:
                    out += chunk()
                    key, held = (d, f1, f2), []
                held.append(c)
            yield texts(out)
        yield texts(chunk())

    def texts(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.string())], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> list[tuple]:
            return [(*key, state.hexdigest())] if state else []

        def shas(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())], names=[*keys, "sha"])

        for batch in batches:
            out = []
            for d, f1, f2, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if (d, f1, f2) != key:
                    out += done()
                    key, state = (d, f1, f2), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield shas(out)
        yield shas(done())

    ranged = ends.repartitionByRange(*keys, "c").sortWithinPartitions(*keys, "c")
    chunks = arrow_map(ranged, join, "d long, f1 long, f2 long, first long, ids string")
    return arrow_map(chunks.repartition(*keys).sortWithinPartitions(*keys, "first"), hashed, "d long, f1 long, f2 long, sha string")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(
        spark.read.parquet(f"{sf_dir}/conversations.parquet"), base=lambda c: c - c % 20, head=lambda c: F.crc32(c.cast("string").cast("binary")) % 4, max_head=3
    )
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
