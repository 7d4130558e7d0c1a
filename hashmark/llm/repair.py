"""Repair of damaged conversations: weighted edits that make the roles parse, found by a generalised LR parser.

The role grammar is ``(s?(ua)+)?`` over the initials of the roles.  Its LR automaton, with completed pairs reduced at once, has
four stack tops; a graph-structured stack holds, after every row, one node for each top that some edits reach: keep (K), rerole
to what the automaton shifts next (R), delete (D) and insert an empty turn (I).  Edits that lead to equal tops merge into the
node of the least (cost, audit).  Audits that spend the same rows and cost never begin one another, so the least one stays the
least whatever follows.

A conversation of any length is many tasks' work.  Rows are put in order by a range exchange and cut into blocks bounded by rows
and bytes.  A conversation inside a block is repaired there.  Pieces of one that reaches over a block's edge are parsed from
every top to every top; these tables are composed in order, and only then are the pieces' texts written out and hashed, one
piece after another.  What a task holds of a conversation that spans blocks is its audit, which is as long as a row of the
result has to be.

A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation, compared by their sha256),
truncated.  NULL ids, turns, roles and texts are one space in the damage key, NULL roles and texts one space from then on; rows
without an id are one conversation, whose id is NULL.  Rows of equal turn are ordered by the sha256 of ``length of role:role
text``.  Repeated rows are duplicates of the first.  Other columns are not read.  No rows give no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.hot import join_groups
from hashmark.llm.tables import BLANKS, arrow_map, ship, written

#: Tops of the stack: nothing shifted, a system turn, an open pair, completed pairs; what each shifts, by the initial.
START, SYSTEM, OPEN, PAIRS = range(4)
SHIFT = {START: {"s": SYSTEM, "u": OPEN}, SYSTEM: {"u": OPEN}, OPEN: {"a": PAIRS}, PAIRS: {"u": OPEN}}
ACCEPTED = (START, PAIRS)
#: The one role that an inserted or reroled turn can have where the automaton stands.
EXPECTED = {START: "user", SYSTEM: "user", OPEN: "assistant", PAIRS: "user"}
LEGAL = {"su", "ua", "au"}
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
FAULTS = ("blank", "duplicate", "truncated")

Stack = dict[int, tuple[int, str]]


def _inserted(stack: Stack) -> Stack:
    """The stack with every top that inserted turns reach."""
    todo = list(stack)
    while todo:
        top = todo.pop()
        cost, audit = stack[top]
        after = SHIFT[top][EXPECTED[top][0]]
        new = (cost + COSTS["I"], audit + "I")
        if after not in stack or new < stack[after]:
            stack[after] = new
            todo.append(after)
    return stack


def parse(rows: Iterable[tuple[str, str | None]], top: int = START) -> Stack:
    """The least (cost, audit) that leads from ``top`` to every top over ``rows`` of (initial of the role, fault)."""
    stack = _inserted({top: (0, "")})
    for initial, fault in rows:
        after: Stack = {}

        def merge(top: int, node: tuple[int, str]) -> None:
            if top not in after or node < after[top]:
                after[top] = node

        for top, (cost, audit) in stack.items():
            merge(top, (cost + COSTS["D"], audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            extra = TRUNCATED if fault == "truncated" else 0
            if initial in SHIFT[top]:
                merge(SHIFT[top][initial], (cost + extra, audit + "K"))
            merge(SHIFT[top][EXPECTED[top][0]], (cost + COSTS["R"] + extra, audit + "R"))
        stack = _inserted(after)
    return stack


def rewrite(rows: Iterable[tuple[str, str]], audit: str, top: int = START) -> list[str]:
    """``role:text`` of the turns that an audit makes of rows of (role, text)."""
    out, rows = [], iter(rows)
    for edit in audit:
        if edit == "I":
            role, text = EXPECTED[top], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            role = EXPECTED[top] if edit == "R" else role
        top = SHIFT[top][role[:1]]
        out.append(f"{role}:{text}")
    return out


def fault_of(text: str, duplicate: bool) -> str | None:
    seen = text.rstrip(BLANKS)
    return "blank" if not seen else "duplicate" if duplicate else None if seen[-1] in ".!?" else "truncated"


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role`` and ``text`` after a damage that follows from ``conv:turn``."""
    kind = (F.crc32(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in (conv, ":", turn)]).cast("binary")) % 20).alias("kind")
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), kind
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Faults, cheapest repair and its hash for each conversation in ``rows`` (``conv``, ``turn``, ``role``, ``text``)."""
    ordered = written(_blocks(rows, block_rows, block_bytes), "repair-rows")
    first = ordered.groupBy("no_id", "c", "sha").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeats = join_groups(ordered.select("no_id", "c", "sha", "block", "pos"), written(first, "repair-first"), ["no_id", "c", "sha"], "n")
    repeats = repeats.filter("pos > first").select(F.col("block").alias("in_block"), F.col("pos").alias("at"))
    ship(rows.sparkSession)
    done = ordered.drop("sha").groupBy("block").cogroup(repeats.groupBy("in_block")).applyInArrow(_repair_block, _BLOCK)
    done = written(done, "repair-blocks")
    inside = done.filter("NOT open").select("no_id", "c", *_SUMS, "cost", "audit", "hash")
    over = done.filter("open")
    joined = written(_composed(over.drop("cost", "audit", "hash", "roles", "texts", "open")), "repair-composed")
    hashes = _hashes(over.select("no_id", "c", "block", "roles", "texts"), joined.filter("block IS NOT NULL").select("no_id", "c", "block", "top", "piece"))
    whole = joined.filter("block IS NULL").select("no_id", "c", *_SUMS, "cost", "audit").join(hashes, ["no_id", "c"], "left")
    turns = ordered.groupBy("no_id", "c").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n_turns"))
    gaps = turns.select("no_id", "c", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"))
    found = inside.unionByName(whole).join(gaps, ["no_id", "c"])
    return found.select(
        F.when(~F.col("no_id"), F.col("c")).alias("conv"), "gaps", *_SUMS, "cost", "audit", F.coalesce("hash", F.lit(EMPTY)).alias("repaired_sha256")
    )


_SUMS = [*FAULTS, "illegal"]
_PATHS = "array<struct<start:int,end:int,cost:bigint,audit:string>>"
_BLOCK = (
    "no_id boolean, c long, block long, open boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    f"cost long, audit string, hash string, paths {_PATHS}, roles array<string>, texts array<string>"
)


def _key() -> list[Column]:
    return [F.col("conv").isNull().alias("no_id"), F.coalesce(F.col("conv").cast("long"), F.lit(0)).alias("c")]


def _blocks(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Rows in order (``pos``), in runs of bounded rows and bytes (``block``); repeats of one row are dealt by a random number."""
    sha = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("sha")
    keyed = rows.select(*_key(), F.col("turn").cast("long").alias("turn"), "role", "text", sha, F.rand(13).alias("noise"))
    order = ["no_id", "c", "turn", "sha"]
    ordered = keyed.repartitionByRange(*order, "noise").sortWithinPartitions(*order).drop("noise")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        block, n, size = at, 0, 0
        for batch in batches:
            blocks = []
            for length in pc.binary_length(batch.column("text")).to_pylist():
                if n and (n == block_rows or size + length > block_bytes):
                    block, n, size = block + 1, 0, 0
                blocks.append(block)
                n, size = n + 1, size + length
            pos = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pos, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "pos", "block"])

    return arrow_map(ordered, cut, "no_id boolean, c long, turn long, role string, text string, sha string, pos long, block long")


def _repair_block(rows: pa.Table, repeats: pa.Table) -> pa.Table:
    """Conversations inside a block repaired; its first and last one parsed from every top, with their texts for later."""
    gone = set(repeats.column("at").to_pylist())
    rows = rows.sort_by("pos")
    keys = list(zip(rows.column("no_id").to_pylist(), rows.column("c").to_pylist()))
    texts, roles, pos = (rows.column(c).to_pylist() for c in ("text", "role", "pos"))
    block, out, start = (rows.column("block")[0].as_py() if rows.num_rows else 0), [], 0
    while start < len(keys):
        stop = start + 1
        while stop < len(keys) and keys[stop] == keys[start]:
            stop += 1
        part = slice(start, stop)
        faults = [fault_of(text, at in gone) for text, at in zip(texts[part], pos[part])]
        initials = [role[:1] for role in roles[part]]
        row = dict(zip(("no_id", "c"), keys[start])) | {"block": block, "open": start == 0 or stop == len(keys)}
        row |= {f: faults.count(f) for f in FAULTS} | {"illegal": sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))}
        row |= {"first": initials[0], "last": initials[-1]}
        edits = list(zip(initials, faults))
        if row["open"]:
            paths = [{"start": s, "end": e, "cost": cost, "audit": audit} for s in SHIFT for e, (cost, audit) in parse(edits, s).items()]
            row |= {"paths": paths, "roles": roles[part], "texts": texts[part]}
        else:
            cost, audit = _cheapest(parse(edits))
            repaired = "\n".join(rewrite(zip(roles[part], texts[part]), audit))
            row |= {"cost": cost, "audit": audit, "hash": hashlib.sha256(repaired.encode()).hexdigest()}
        out.append(row)
        start = stop
    return pa.Table.from_pylist(out, schema=_BLOCK_ARROW)


_PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_BLOCK_ARROW = pa.schema([
    ("no_id", pa.bool_()), ("c", pa.int64()), ("block", pa.int64()), ("open", pa.bool_()), *((s, pa.int64()) for s in _SUMS), ("first", pa.string()),
    ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("hash", pa.string()), ("paths", pa.list_(_PATH)),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])


def _cheapest(stack: Stack) -> tuple[int, str]:
    return min(stack[top] for top in ACCEPTED if top in stack)


class _Open:
    """A conversation whose pieces come one after the other."""

    def __init__(self, key: tuple):
        self.key, self.sums, self.last = key, [0] * len(_SUMS), None
        # each top: cost, edits since the common beginning, tops of the pieces since then
        self.tops: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}
        self.audit: list[str] = []
        self.pieces: list[tuple[int, int, str]] = []

    def add(self, block: int, sums: list[int], first: str, last: str, paths: list[dict]) -> None:
        self.sums = [x + y for x, y in zip(self.sums, sums)]
        if self.last is not None and self.last + first not in LEGAL:
            self.sums[-1] += 1
        self.last = last
        after: dict[int, tuple[int, str, tuple]] = {}
        for path in paths:
            if path["start"] in self.tops:
                cost, edits, pieces = self.tops[path["start"]]
                new = (cost + path["cost"], edits + path["audit"])
                if path["end"] not in after or new < after[path["end"]][:2]:
                    after[path["end"]] = (*new, (*pieces, (block, path["start"], path["audit"])))
        self.tops = after
        self._settle()

    def _settle(self) -> None:
        """Pieces on which all tops agree are final, and need not be carried along or compared any more."""
        ways = [pieces for _, _, pieces in self.tops.values()]
        same = 0
        while all(len(way) > same and way[same] == ways[0][same] for way in ways):
            same += 1
        if same:
            gone = "".join(piece[2] for piece in ways[0][:same])
            self.pieces += ways[0][:same]
            self.audit.append(gone)
            self.tops = {top: (cost, edits[len(gone):], pieces[same:]) for top, (cost, edits, pieces) in self.tops.items()}

    def rows(self) -> list[dict]:
        cost, edits, pieces = min(self.tops[top] for top in ACCEPTED if top in self.tops)
        key = dict(zip(("no_id", "c"), self.key))
        out = [key | {"block": block, "top": top, "piece": piece} for block, top, piece in (*self.pieces, *pieces)]
        return [*out, key | dict(zip(_SUMS, self.sums)) | {"cost": cost, "audit": "".join(self.audit) + edits}]


_COMPOSED = "no_id boolean, c long, block long, top int, piece string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COMPOSED_ARROW = pa.schema([
    ("no_id", pa.bool_()), ("c", pa.int64()), ("block", pa.int64()), ("top", pa.int32()), ("piece", pa.string()), *((s, pa.int64()) for s in _SUMS),
    ("cost", pa.int64()), ("audit", pa.string()),
])


def _composed(over: DataFrame) -> DataFrame:
    """Tables of pieces composed in order: a row for the conversation (no block) and one with the edits of each piece."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Open | None = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = (r["no_id"], r["c"])
                if own is None or own.key != key:
                    out += own.rows() if own else []
                    own = _Open(key)
                own.add(r["block"], [r[s] for s in _SUMS], r["first"], r["last"], r["paths"])
            yield pa.RecordBatch.from_pylist(out, schema=_COMPOSED_ARROW)
        yield pa.RecordBatch.from_pylist(own.rows() if own else [], schema=_COMPOSED_ARROW)

    return arrow_map(over.repartition("no_id", "c").sortWithinPartitions("no_id", "c", "block"), compose, _COMPOSED)


def _hashes(pieces: DataFrame, edits: DataFrame) -> DataFrame:
    """The hash of each conversation's repaired turns, from the texts of its pieces and the edits of each."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["no_id"], r["c"], r["block"], "\n".join(rewrite(zip(r["roles"], r["texts"]), r["piece"], r["top"]))) for r in batch.to_pylist()]
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["no_id", "c", "block", "turns"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> list[tuple]:
            return [(*key, state.hexdigest())] if state else []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.bool_(), pa.int64(), pa.string()))], names=["no_id", "c", "hash"])

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["no_id"], r["c"]) != key:
                    out += done()
                    key, state = (r["no_id"], r["c"]), hashlib.sha256(r["turns"].encode())
                else:
                    state.update(f"\n{r['turns']}".encode())
            yield rows(out)
        yield rows(done())

    made = pieces.join(edits, ["no_id", "c", "block"]).select("no_id", "c", "block", "roles", "texts", "top", "piece")
    # a piece has turns where an edit is not a deletion; pieces without turns leave no line
    made = arrow_map(made.filter(F.translate("piece", "D", "") != ""), rebuild, "no_id boolean, c long, block long, turns string")
    return arrow_map(made.repartition("no_id", "c").sortWithinPartitions("no_id", "c", "block"), hashed, "no_id boolean, c long, hash string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *_SUMS, "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256")
    )
