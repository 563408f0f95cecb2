"""Byte-level BPE encoding and decoding by merge replay.

Texts are cut into chunks at blanks (`ChunkCache`), so that equal chunks of a share of the corpus are encoded once. Their pieces, the
matches of the tokenizer's pattern, go through one replay together: an inverted index from pair rank to the positions of that pair in
all words applies the merges in rank order, and each merge touches only its neighbours. Every task replays the distinct words of its
Arrow batches and keeps a bounded cache; nothing is shuffled, and no vocabulary of the corpus travels anywhere."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from coverlens.llm.common import byte_slices, texts_of, worker_state

CACHE_WORDS = 600_000
BLOCK_BYTES = 1 << 23
SLICE_BYTES = 1 << 21
NONE = np.int32(2**31 - 1)
SHIFT = 17

def chunks(text: str) -> list[list[str]] | None:
    """Lines of blank-separated chunks, or None where blanks and line ends stand next to white space in a way that joins them in a match.
    Each chunk but a line's first stands for a blank and itself; a line end is a piece of its own."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return None
    lines = text.split("\n")
    if any(line[:1].isspace() for line in lines[1:]):
        return None
    return [line.split(" ") for line in lines]


def letters(chunk: str) -> bool:
    """Letters of the first blocks only: one match of the pattern, found without it."""
    return chunk.isalpha() and max(chunk) < "\u0250"


class ChunkCache:
    """Little-endian 32-bit ids of texts. `encode` maps a list of distinct pieces, matches of `pattern`, to the bytes of their ids."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_WORDS):
        self.find, self.encode, self.limit = regex.compile(pattern).findall, encode, limit
        self.pieces: dict[str, bytes] = {}  # by piece or first chunk of a line
        self.after: dict[str, bytes] = {}  # by chunk that follows a blank

    def split(self, lead: str, chunk: str) -> list[str]:
        """The pattern's matches in lead + chunk."""
        if letters(chunk):
            return [lead + chunk]
        if chunk[-1:] in (".", ",") and letters(chunk[:-1]):
            return [lead + chunk[:-1], chunk[-1]]
        return self.find(lead + chunk)

    def trim(self) -> None:
        """Over the limit, keeps the shorter half of the chunks, which return more often than long ones."""
        for d in (self.pieces, self.after):
            if len(d) > self.limit:
                longest = sorted(map(len, d))[len(d) // 2]
                kept = {c: v for c, v in d.items() if len(c) < longest}
                d.clear()
                d.update(kept)

    def learn(self, texts: Iterator[str]) -> None:
        """Encodes what the texts hold and the cache lacks."""
        self.trim()
        first, after = {"\n"}, set()
        for text in texts:
            lines = chunks(text)
            if lines is None:
                first.update(self.find(text))
            else:
                for line in lines:
                    first.add(line[0])
                    after.update(line[1:])
        first -= self.pieces.keys()
        after -= self.after.keys()
        matches = [(self.pieces, c, self.split("", c)) for c in first]
        matches += [(self.after, c, self.split(" ", c)) for c in after]
        known: dict[str, bytes] = {}
        new = set()
        for _, _, parts in matches:
            for p in parts:
                ids = self.after.get(p[1:]) if p[0] == " " else self.pieces.get(p)
                if ids is None:
                    new.add(p)
                else:
                    known[p] = ids
        new = list(new)
        known.update(zip(new, self.encode(new)))
        for d, chunk, parts in matches:
            d[chunk] = known[parts[0]] if len(parts) == 1 else b"".join(map(known.__getitem__, parts))

    def ids(self, text: str) -> bytes:
        """Ids of a text whose pieces were learnt."""
        lines = chunks(text)
        if lines is None:
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        one, many = self.pieces.__getitem__, self.after.__getitem__
        return one("\n").join(one(line[0]) + b"".join(map(many, line[1:])) for line in lines)


class MergeTable:
    """Ranks of a vocabulary: ids of single bytes, and the rank of every pair of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                x, y = ranks.get(token[:i]), ranks.get(token[i:])
                if x is not None and y is not None:
                    pairs[x << SHIFT | y] = rank
        self.codes = np.array(sorted(pairs), np.int64)
        self.values = np.append(np.array([pairs[c] for c in self.codes.tolist()], np.int32), NONE)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of each pair (x, y), NONE where it is no token."""
        code = (x.astype(np.int64) << SHIFT) | y
        at = np.searchsorted(self.codes, code)
        hit = self.codes[np.minimum(at, len(self.codes) - 1)] == code
        return np.where(hit, self.values[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """Ids of one word by a heap of its pairs, lowest rank first, leftmost on ties."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        nxt, prv = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(r, i) for i in range(len(word) - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if parts[i] is not None else len(word)
            if j >= len(word) or parts[j] is None or self.ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            nxt[i] = nxt[j]
            if nxt[i] < len(word):
                prv[nxt[i]] = i
                if (s := self.ranks.get(parts[i] + parts[nxt[i]])) is not None:
                    heapq.heappush(heap, (s, i))
            if (k := prv[i]) >= 0 and (s := self.ranks.get(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (s, k))
        return [self.ranks[p] for p in parts if p is not None]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all words in a row, and for each word the number of ids up to its end.

        A word in which a merge creates a pair of lower rank than the merge itself would need its merges one at a time; such words are
        marked and encoded alone."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        stops = np.cumsum(sizes)
        sym = np.append(self.bytes[np.frombuffer(b"".join(words), np.uint8)], np.int32((1 << SHIFT) - 1))
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        full = sizes > 0
        nxt[stops[full] - 1] = n
        prv[(stops - sizes)[full]] = n
        nxt[n] = prv[n] = n
        pair = np.append(self.rank(sym[:n], sym[nxt[:n]]), NONE)
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        odd: set[int] = set()

        def file(at: np.ndarray) -> None:
            """Puts positions into the index by the rank of their pair."""
            rank = pair[at]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(at)]
            for r, i, j in zip(rank[starts[:-1]].tolist(), starts, starts[1:]):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(queue, r)

        if (start := np.flatnonzero(pair[:n] != NONE)).size:
            file(start)
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            at = np.unique(lists[0] if len(lists) == 1 else np.concatenate(lists))
            at = at[pair[at] == r]
            if not at.size:
                continue
            right = nxt[at]
            chained = right[:-1] == at[1:]
            if chained.any():  # overlapping pairs: every second one of a run, from the left
                place = np.arange(len(at))
                first = np.append(0, np.where(chained, 0, place[1:]))
                keep = (place - np.maximum.accumulate(first)) % 2 == 0
                at, right = at[keep], right[keep]
            after = nxt[right]
            sym[at] = r
            nxt[at] = after
            prv[after] = at
            before = prv[at]  # read after the update: neighbours may have merged too
            alive[right] = False
            pair[right] = NONE
            pair[at] = self.rank(sym[at], sym[after])
            pair[before] = self.rank(sym[before], sym[at])
            pair[n] = NONE
            touched = np.concatenate([at, before])
            rank = pair[touched]
            touched = touched[rank != NONE]
            if touched.size:
                lower = touched[pair[touched] < r]
                if lower.size:
                    odd.update(word[lower].tolist())
                file(touched)
        ids, owner = sym[:n][alive], word[alive]
        counts = np.bincount(owner, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        if odd:
            ends = np.cumsum(counts)
            out = np.split(ids, ends[:-1])
            for k in odd:
                out[k] = np.array(self.one(words[k]), np.int32)
            ids, counts = np.concatenate(out), np.array([len(x) for x in out])
        return ids, np.cumsum(counts)

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Bytes of the ids of each piece."""
        ids, ends = self.replay([p.encode() for p in pieces])
        data = ids.astype("<u4").tobytes()
        stops = (ends * 4).tolist()
        return [data[i:j] for i, j in zip([0, *stops], stops)]


def merge_table(path: str) -> MergeTable:
    with open(path, "rb") as f:
        return MergeTable({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def replayer(path: str, pattern: str) -> tuple[MergeTable, ChunkCache]:
    table = merge_table(path)
    return table, ChunkCache(pattern, table.encode)


def encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The first column and the ids of the texts of the second, slice by slice."""
    _, words = worker_state(("replay", path, pattern), lambda: replayer(path, pattern))
    for whole in batches:
        for block in byte_slices(whole, whole.schema.names[1], BLOCK_BYTES):
            parts = list(byte_slices(block, block.schema.names[1], SLICE_BYTES))
            words.learn(t for part in parts for t in texts_of(part.column(1)))
            for part in parts:
                yield part.column(0), [words.ids(t) for t in texts_of(part.column(1))]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): every document's token ids as little-endian 32-bit words, as the library of such rank files gives them.

    Null text encodes as the empty one, with no ids; repeated rows are encoded alike; other columns are not read. The rank file must
    lie at `path` on every executor."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids in encoded(batches, path, pattern):
            yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.binary())], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes that the ids stand for; null ids decode to null."""
    schema = f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = worker_state(("table", path), lambda: merge_table(path)).tokens.__getitem__
        for batch in batches:
            data = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what `encode` and `decode` give, taken in one pass without storing the ids."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = worker_state(("replay", path, pattern), lambda: replayer(path, pattern))
        token, decimal = table.tokens.__getitem__, [str(i) for i in range(len(table.tokens))].__getitem__
        for key, texts in encoded(batches, path, pattern):
            rows = []
            for x in texts:
                ids = np.frombuffer(x, "<u4").tolist()
                rows.append((len(ids), hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(b"".join(map(token, ids))).hexdigest()))
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
