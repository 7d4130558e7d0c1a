"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task collects the distinct pre-tokens of its texts, lays their symbols out in one flat array and indexes every adjacent
pair by its merge rank: rank -> all positions where the pair occurs.  The active ranks are then applied in ascending order;
each application merges all occurrences of its pair at once and enters the pairs that this creates beside them into the
lists of their own, always higher, ranks.  One pass over the ranks encodes every pre-token.  Encoded pre-tokens stay in a
cache of bounded size in the Python worker.

NULL and empty texts encode to no ids; repeated rows give repeated results; ids outside the vocabulary decode to nothing,
as do NULL id lists.  Columns besides the named ones are not read by ``encode`` and are kept by ``decode``.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.llm.tables import arrow_map, documents
from hashmark.llm.textbytes import chunks, flat, hashes

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens kept in a worker, bytes of text split at a time, and bytes whose new pre-tokens are indexed together.
CACHE_WORDS = 500_000
PIECE_BYTES = 1 << 20
TOGETHER_BYTES = 16 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> bytes:
    """The tokenizer file; at most a few MB, so it is broadcast as it is."""
    with open(path, "rb") as file:
        return file.read()


BLANK, LETTER, NUMBER, OTHER = range(4)
# fixed values: the Unicode White_Space characters
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    table[WHITE_SPACE] = BLANK
    return table


def pretokens(points: np.ndarray, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in a flat array of code points whose rows begin at ``rows``.

    A pre-token is a run of letters, of numbers or of other signs, with one blank before it if that is U+0020; an English
    contraction after an apostrophe; or what is left of a run of white space.
    """
    n = len(points)
    kind = table[points]
    head = np.zeros(n + 1, dtype=bool)
    head[rows] = True
    begins = head[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    joined = ~head[1:n]
    meets = joined & (kind[:-1] == BLANK) & (kind[1:] != BLANK)
    begins[:-1] |= meets
    begins[1:] &= ~(meets & (points[:-1] == 0x20))
    quote = np.flatnonzero(begins & (points == 0x27))
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        near = [padded[quote + k] for k in range(3)]
        ends = np.concatenate([head, [True, True]])
        one = np.isin(near[1], [ord(c) for c in "sdmt"]) & ~ends[quote + 1]
        two = np.zeros(len(quote), dtype=bool)
        for x, y in ("re", "ve", "ll"):
            two |= (near[1] == ord(x)) & (near[2] == ord(y))
        two &= ~ends[quote + 1] & ~ends[quote + 2]
        begins[quote[one | two] + 1] = False
        stop = np.concatenate([quote[one] + 2, quote[two] + 3])
        stop = stop[stop < n]
        begins[stop[kind[stop] == LETTER]] = True
    return np.flatnonzero(begins)


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Codec:
    """The merges and bytes of one vocabulary, and the cache of encoded pre-tokens."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        alphabet = _byte_alphabet()
        value = {c: b for b, c in enumerate(alphabet)}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.first = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = self.left * self.size + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.none = len(merges)
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_sizes = np.array([*map(len, pieces), 0], dtype=np.int64)
        self.piece_begins = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.table = _class_table()
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.forget()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, ``none`` where it has none; negative symbols are ends of words."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], self.none)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and their number for each word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"\x00" + b"\x00".join(words) + b"\x00", dtype=np.uint8)
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])
        symbol = self.first[data]
        symbol[ends] = -1
        after = np.arange(1, len(symbol) + 1)
        before = np.arange(-1, len(symbol) - 1)
        rank = self.rank(symbol[:-1], symbol[1:])
        order = np.argsort(rank, kind="stable")
        order = order[: int(np.searchsorted(rank[order], self.none))]
        active, cuts = np.unique(rank[order], return_index=True)
        index: dict[int, list[np.ndarray]] = {int(r): [p] for r, p in zip(active, np.split(order, cuts[1:]), strict=True)} if len(order) else {}
        heap = sorted(index)
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[symbol[at] == self.left[r]]
            at = at[symbol[after[at]] == self.right[r]]
            if self.left[r] == self.right[r] and len(at) > 1:
                at = _alternate(at, after)
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.merged[r]
            symbol[gone] = -2
            follower = after[gone]
            after[at] = follower
            before[follower] = at
            starts = np.concatenate([before[at], at])
            new = self.rank(symbol[starts], symbol[after[starts]])
            some = new < self.none
            starts, new = starts[some], new[some]
            if not len(new):
                continue
            if len(new) > 1:
                order = np.argsort(new, kind="stable")
                starts, new = starts[order], new[order]
            cut = np.flatnonzero(new[1:] != new[:-1]) + 1
            for k, positions in zip(new[np.concatenate([[0], cut])].tolist(), np.split(starts, cut), strict=True):
                if k in index:
                    index[k].append(positions)
                else:
                    index[k] = [positions]
                    heapq.heappush(heap, k)
        counts = np.add.reduceat((symbol[:-1] >= 0).astype(np.int64), ends[:-1])
        return symbol[symbol >= 0].astype(np.uint32), counts

    def forget(self) -> None:
        """Empty the cache: hash of a pre-token -> its place in the pool of ids."""
        self.known: dict[int, int] = {}
        self.pool = np.zeros(0, dtype=np.uint32)
        self.begins, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Token ids of consecutive rows of a string column and, for each of these rows, where its ids end.

        The distinct new pre-tokens of up to ``TOGETHER_BYTES`` of text go through the pair index together.
        """
        data, offsets = flat(column)
        held, size = [], 0
        for _, part, bounds in chunks(data, offsets, PIECE_BYTES):
            raw = part.tobytes()
            special = any(s.encode() in raw for s in self.special)
            held.append(self._read_with_specials(raw, bounds) if special else (*self._read(part, bounds), None))
            size += len(part)
            if size >= TOGETHER_BYTES:
                yield from self._finish(held)
                held, size = [], 0
        yield from self._finish(held)

    def _read(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Hashes and spellings of the distinct pre-tokens, which of them stands at each place, where each row ends."""
        if not len(data):
            return np.zeros(0, np.uint64), [], np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        edges = np.searchsorted(place, bounds)
        starts = pretokens(points, edges, self.table)
        at = place[starts]
        lengths = np.diff(np.append(at, len(data)))
        values, first, inverse = np.unique(hashes(data, at, lengths), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [
            b"" if v in self.known else raw[a : a + n]
            for v, a, n in zip(values.tolist(), at[first].tolist(), lengths[first].tolist(), strict=True)
        ]
        return values, words, inverse.astype(np.int32), np.searchsorted(starts, edges[1:])

    def _read_with_specials(self, raw: bytes, bounds: np.ndarray) -> tuple:
        """Special tokens stand for themselves; the text between them is read as rows of its own."""
        rows = [self.splitter.split(raw[a:b].decode("utf-8")) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        plain = [p.encode("utf-8") for row in rows for p in row[::2]]
        data = np.frombuffer(b"".join(plain), dtype=np.uint8)
        return (*self._read(data, np.cumsum([0] + [len(p) for p in plain])), rows)

    def _finish(self, held: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        known = self.known
        new = {v: w for values, words, *_ in held for v, w in zip(values.tolist(), words, strict=True) if w}
        if new:
            ids, counts = self.encode_words(list(new.values()))
            known.update(zip(new, range(len(self.counts), len(self.counts) + len(new)), strict=True))
            self.begins = np.concatenate([self.begins, len(self.pool) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.pool = np.concatenate([self.pool, ids])
        for values, _, inverse, stops, rows in held:
            slot = np.array([known[v] for v in values.tolist()], dtype=np.int64)[inverse] if len(values) else inverse.astype(np.int64)
            counts, begins = self.counts[slot], self.begins[slot]
            total = np.concatenate([[0], np.cumsum(counts)])
            ids = self.pool[np.repeat(begins - total[:-1], counts) + np.arange(int(total[-1]))]
            yield (ids, total[stops]) if rows is None else self._insert(ids, total[stops], rows)
        if len(known) > CACHE_WORDS:
            self.forget()

    def _insert(self, ids: np.ndarray, ends: np.ndarray, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        pieces = iter(np.split(ids, ends[:-1]))
        out, stops, total = [], [], 0
        for row in rows:
            for k, part in enumerate(row):
                out.append(next(pieces) if k % 2 == 0 else np.array([self.special[part]], dtype=np.uint32))
                total += len(out[-1])
            stops.append(total)
        return np.concatenate(out), np.array(stops, dtype=np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each row of ids."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        counts = self.piece_sizes[ids]
        total = np.cumsum(counts)
        steps = np.arange(int(total[-1]) if len(total) else 0)
        raw = self.piece_data[np.repeat(self.piece_begins[ids] - (total - counts), counts) + steps].tobytes()
        stops = np.concatenate([[0], total])[ends].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of touching occurrences of a pair of equal symbols, every other one from the left."""
    touches = np.concatenate([[False], after[at[:-1]] == at[1:]])
    run = np.flatnonzero(~touches)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return at[place % 2 == 0]


_CODECS: dict[int, Codec] = {}


def codec(blob: bytes) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    key = hash(blob)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(blob)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the token ids of the whole text, for every row."""
    blob = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value)
        for batch in batches:
            lo = 0
            for ids, ends in own.encode(batch.column(1)):
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(ends)), lists], names=[id_col, "ids"])
                lo += len(ends)

    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return arrow_map(docs.select(id_col, text_col), run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` without ``ids_col``, and the text its ids stand for."""
    blob = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    others = [c for c in encoded.columns if c not in (ids_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value)
        for batch in batches:
            lists = batch.column(ids_col)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, lo = np.cumsum(sizes), 0
            while lo < len(ends):
                done = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + PIECE_BYTES // 4, side="right")))
                texts = pa.array(own.decode(ids[done : ends[hi - 1]], ends[lo:hi] - done), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in others), texts], names=[*others, text_col])
                lo = hi

    schema = T.StructType([encoded.schema[c] for c in others] + [T.StructField(text_col, T.StringType())])
    return arrow_map(encoded.select(*others, ids_col), run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    encoded = encode(documents(spark, sf_dir), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "ids",
    )
    return decode(encoded, path).withColumn("decoded", F.sha2("decoded", 256)).withColumnRenamed("decoded", "decoded_sha256")
