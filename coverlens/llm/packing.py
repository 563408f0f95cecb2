"""Best-fit packing by length histogram.

Documents become pieces of at most `max_len` tokens. Only the histogram of piece lengths, at most `max_len` rows, reaches the driver; best
fit decreasing runs over its counts and yields a plan of slot ranges whose size depends on `max_len`, not on the data. Pieces are ranked
within their length in salted groups and take the slot of their rank by a join on length."""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlens.llm.common import byte_slices, checkpointed, texts_of, tidy, worker_state

MAX_LEN = 2048
END_ID = 0
JOINED_BYTES = 1 << 12
BLOCK_BYTES = 1 << 23
#: Bytes of a worker's cache of units, and of its objects for each of them besides their contents.
CACHE_BYTES = 120 << 20
ENTRY_BYTES = 160


class UnitEncoder:
    """Ids of whole texts through the tokenizers library, unit by unit.

    A unit is a run of white space and the text up to the next one. No match of the tokenizer's pattern goes from text into the white space
    behind it, so the ids of a text are those of its units. Distinct units of a block are looked up in a cache bounded by bytes; those that
    it lacks are sent joined, and their ids are dealt back by the byte lengths of their tokens. The rest is done by Arrow: one dictionary
    encoding and one take for each block."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.specials = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        vocab = self.model.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.cache: dict[bytes, bytes] = {}
        self.size, self.cache_bytes = 0, cache_bytes

    def text(self, text: bytes) -> bytes:
        return np.array(self.model.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, units: list[bytes]) -> None:
        """Encodes units that the cache lacks: joined, if they start with a blank or line end and end with none."""
        joined = [u for u in units if u[0] in (0x20, 0x0A) and (0x20 < u[-1] < 0x7F or (u[-1] >= 0x80 and 0xC3 <= u[-2] <= 0xDF))]
        inside = set(joined)
        for u in units:
            if u not in inside:
                self.cache[u] = self.text(u)
        start = 0
        while start < len(joined):
            stop, size = start, 0
            while stop < len(joined) and size < JOINED_BYTES:
                size += len(joined[stop])
                stop += 1
            part = joined[start:stop]
            ids = np.array(self.model.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(u) for u in part])) + 1
            data, cuts = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            self.cache.update(zip(part, (data[x:y] for x, y in zip([0, *cuts], cuts))))
            start = stop
        self.size += sum(len(u) + len(self.cache[u]) + ENTRY_BYTES for u in units)

    def trim(self) -> None:
        """Over the limit, keeps the shorter half of the units, which return more often than long ones."""
        if self.size > self.cache_bytes:
            longest = sorted(map(len, self.cache))[len(self.cache) // 2]
            self.cache = {u: v for u, v in self.cache.items() if len(u) < longest}
            self.size = sum(len(u) + len(v) + ENTRY_BYTES for u, v in self.cache.items())

    def block(self, texts: list[bytes]) -> tuple[memoryview, list[int]]:
        """The ids of all texts, and where in these bytes each text starts, with the end as last entry."""
        plain = [b"" if any(s in t for s in self.specials) else t for t in texts]
        ends = np.cumsum([len(t) for t in plain], dtype=np.int64)
        buffer = np.frombuffer(b"".join(plain), np.uint8)
        first = np.zeros(len(buffer) + 1, bool)
        first[unit_starts(buffer)] = first[0] = first[ends] = True
        starts = np.flatnonzero(first[:-1])
        offsets = np.append(starts, len(buffer)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        self.trim()
        self.learn([u for u in distinct if u not in self.cache])
        ids = pa.array([self.cache[u] for u in distinct], pa.large_binary()).take(units.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        bounds = at[np.searchsorted(starts, np.append(0, ends))].tolist()
        data = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] is not None else memoryview(b"")
        if all(p is t for p, t in zip(plain, texts)):
            return data, bounds
        parts = [self.text(t) if p is not t else bytes(data[x:y]) for p, t, x, y in zip(plain, texts, bounds, bounds[1:])]
        return memoryview(b"".join(parts)), [0, *np.cumsum([len(p) for p in parts]).tolist()]


def unit_starts(buffer: np.ndarray) -> np.ndarray:
    """Blanks and line ends that follow something that is surely no white space: an ASCII character, a two-byte character other than
    U+0085 and U+00A0, or the quotes and dashes of U+2010 to U+2027. After anything else the unit goes on, which is right as well."""
    at = np.flatnonzero((buffer == 0x20) | (buffer == 0x0A))
    at = at[at > 0]
    one = buffer[at - 1]
    two, three = buffer[np.maximum(at - 2, 0)], buffer[np.maximum(at - 3, 0)]
    ascii_text = (one > 0x20) & (one < 0x7F)
    pair = (two >= 0xC3) & (two <= 0xDF)
    mark = (three == 0xE2) & (two == 0x80) & (one >= 0x90) & (one <= 0xA7)
    return at[ascii_text | ((one >= 0x80) & (pair | mark))]


def pieces(docs: DataFrame, path: str, max_len: int = MAX_LEN, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut if longer than max_len into pieces of max_len
    of which only the first may be shorter. Null text is empty: one piece of the end id alone. Other columns are not read."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("library", path), lambda: UnitEncoder(path))
        for whole in batches:
            for block in byte_slices(whole, text_col, BLOCK_BYTES):
                data, bounds = encoder.block([t.encode() for t in texts_of(block.column(1))])
                rows, of, ids = [], [], []
                for k, (first, last) in enumerate(zip(bounds, bounds[1:])):
                    n = (last - first) // 4 + 1  # with the end id
                    cuts = [0, *range((n - 1) % max_len + 1, n + 1, max_len)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        crc = zlib.crc32(data[first + 4 * a : min(first + 4 * b, last)])
                        rows.append((i, a, b - a, zlib.crc32(end, crc) if b == n else crc))
                        of.append(k)
                        if with_ids:
                            ids.append(np.frombuffer(bytes(data[first + 4 * a : min(first + 4 * b, last)]) + (end if b == n else b""), "<u4").astype(np.int32))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(of, pa.int64())), *columns, *more], [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: rows (length, first_rank, n, first_sequence, per_sequence, offset).

    The n pieces of a length from first_rank on fill consecutive sequences, per_sequence to each, from `offset` on. Open sequences are
    kept as ranges by the room they have left; a piece goes to the smallest room that holds it, and so do the next ones of its length."""
    plan, rooms, ranges, n_sequences = [], [], {}, 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
                per = room // length
            else:
                room, per = capacity, capacity // length
                first, n = n_sequences, -(-left // per)
                n_sequences += n
            full = min(n, left // per)
            rest = left - full * per if full < n else 0
            if full:
                plan.append((length, rank, full * per, first, per, capacity - room))
                put(room - per * length, first, full)
            if rest:
                plan.append((length, rank + full * per, rest, first + full, rest, capacity - room))
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            rank += full * per + rest
            left -= full * per + rest
    return plan


def ranked(rows: DataFrame, counts: dict[int, int], by: tuple[str, ...]) -> DataFrame:
    """Adds `rank`, a number from 0 without gaps within each length.

    Lengths are salted so that no group exceeds a fraction of a shuffle partition; salts are offset by their running counts. The order
    covers all columns in `by`, so rows that tie are interchangeable."""
    spark = rows.sparkSession
    share = max(1, sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = spark.createDataFrame([(k, -(-n // share)) for k, n in counts.items()], "length long, n_salts int")
    salted = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(*by), F.col("n_salts"))).drop("n_salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*by)) - 1
    return salted.withColumn("within", within).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within")).drop("base", "within", "salt")


def pack(parts: DataFrame, max_len: int = MAX_LEN, id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset. Every piece gets one slot; the slots of a sequence leave no gap and never exceed max_len.

    The plan is broadcast: a few rows for each of at most max_len lengths. An empty table gives an empty result; repeated rows each get
    a slot of their own."""
    spark = parts.sparkSession
    parts = checkpointed(parts)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_plan(counts, max_len), "length long, first_rank long, n long, first_sequence long, per long, at long")
    rows = ranked(parts, counts, (id_col, "piece", "start", "ids_crc32"))
    k = F.col("rank") - F.col("first_rank")
    slots = rows.join(F.broadcast(plan), (rows["length"] == plan["length"]) & (k >= 0) & (k < F.col("n"))).drop(plan["length"])
    sequence, offset = F.col("first_sequence") + F.floor(k / F.col("per")), F.col("at") + k % F.col("per") * F.col("length")
    return slots.select(*parts.columns, sequence.cast("long").alias("sequence_id"), offset.alias("offset"))


def packed(docs: DataFrame, path: str, max_len: int = MAX_LEN, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path, max_len, with_ids), max_len)
