"""Phrase collocation mining over a prefix-free parse.

A text is a row of words with breaks between its pieces. A hash of three words in a row, with no break between, is a trigger when it is
divisible by PERIOD; chunks run from one trigger to the next and hold that trigger too, so neighbours overlap by three words and equal
passages fall into equal chunks wherever they stand. The chunks of a language form a dictionary with the frequencies of the parse. Phrases
of up to four words are counted inside distinct chunks, weighted with the chunk's frequency; a phrase belongs to the chunk that holds its
first word before the closing trigger, so that the overlap counts once.

A phrase is at most as frequent as its parts. Longer phrases are therefore counted only where a bitmap of fixed size knows their parts as
frequent. A false hit of the bitmap costs a count that the threshold drops, never a result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import byte_slices, checkpointed, written

PERIOD = 32
OVERLAP = 3
LONGEST = 4
LEAST = 30
COVER = 80
TOP = 2000
#: Bits of a bitmap of frequent phrases: 8 MB, whatever the corpus.
BITS = 1 << 26
SLICE = 4 << 20
BREAK, WORD = 1, 2
KIND = np.full(256, WORD, np.uint8)
KIND[[0x20, 0x09]] = 0
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Words:
    """The words of some texts: number of the distinct word, number of the text, and whether a break follows."""

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kind = KIND[self.buffer]
        self.inside = kind == WORD
        edges = np.flatnonzero(np.diff(self.inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        # words are parts of texts of valid UTF-8, cut at ASCII bytes
        words = pa.Array.from_buffers(pa.large_string(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.buffer[self.inside])])
        coded = words.dictionary_encode()
        self.id, self.distinct = np.asarray(coded.indices, np.int64), coded.dictionary
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.starts, text_ends), prepend=0))
        self.broken = np.zeros(len(self.id), bool)
        before = np.searchsorted(self.starts, np.flatnonzero(kind == BREAK)) - 1
        self.broken[before[before >= 0]] = True

    @cached_property
    def hash(self) -> np.ndarray:
        """A hash of each word in its place."""
        return hashes(self.distinct)[self.id]

    def joined(self, n: int) -> np.ndarray:
        """Whether the n words from each word on stand in one piece."""
        ok = np.ones(len(self.id), bool)
        for k in range(1, n):
            ok[len(ok) - k :] = False
            ok[:-k] &= ~self.broken[k - 1 : -1] if len(ok) > k else ok[:-k]
        return ok


def hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A hash of each string: the sum of its bytes times an odd number of their place, mixed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    with np.errstate(over="ignore"):
        place = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.uint64)
        factor = (place + np.uint64(1)) * ODD[2]
        factor ^= factor >> np.uint64(31)
        factor = factor * ODD[3] | np.uint64(1)
        total = np.zeros(len(words), np.uint64)
        some = sizes > 0
        total[some] = np.add.reduceat((data + np.uint64(1)) * factor, starts[some])
        return mixed([total])


def mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of the hashes of consecutive words."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(hashes[0]), np.uint64)
        for v in hashes:
            h = (h ^ v) * ODD[0]
            h ^= h >> np.uint64(29)
            h *= ODD[1]
            h ^= h >> np.uint64(32)
    return h


def parse(docs: DataFrame, text_col: str, lang_col: str, period: int = PERIOD) -> DataFrame:
    """(lang, chunk, ahead, freq): the dictionary of distinct chunks; the last `ahead` words of a chunk belong to the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                texts = [t.encode() for t in pc.ascii_lower(pc.fill_null(part.column("text"), "")).to_pylist()]
                w = Words(texts)
                if not len(w.id):
                    continue
                h = w.hash
                trigger = w.joined(OVERLAP)
                at = np.flatnonzero(trigger)
                trigger[at] = mixed([h[at + k] for k in range(OVERLAP)]) % np.uint64(period) == 0
                first = np.append(True, w.text[1:] != w.text[:-1])
                starts = np.flatnonzero(trigger | first)
                ends = np.append(starts[1:], len(w.id))
                ahead = np.where(np.append(first[starts[1:]], True), 0, OVERLAP)
                # every word with one blank or break behind it
                sizes = w.ends - w.starts + 1
                off = np.concatenate([[0], np.cumsum(sizes)])
                canon = np.full(off[-1], 0x20, np.uint8)
                canon[off[1:][w.broken] - 1] = 0x0A
                letters = np.ones(off[-1], bool)
                letters[off[1:] - 1] = False
                canon[letters] = w.buffer[w.inside]
                data = canon.tobytes()
                chunks = [data[a:b] for a, b in zip(off[starts].tolist(), off[ends + ahead].tolist())]
                lang = part.column("lang").take(pa.array(w.text[starts]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(ahead, pa.int32())], ["lang", "chunk", "ahead"])

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "lang string, chunk string, ahead int").groupBy("lang", "chunk", "ahead").agg(F.count("*").alias("freq"))


def counts(chunks: DataFrame, lengths: tuple[int, ...], known: np.ndarray | None) -> DataFrame:
    """(n, lang, phrase, f) of phrases of the given lengths, of them only those whose parts one word shorter, or of two words, are known."""
    bits = None if known is None else chunks.sparkSession.sparkContext.broadcast(known)
    part = max(1, min(lengths) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, SLICE):
            w = Words([c.encode() for c in batch.column("chunk").to_pylist()])
            if not len(w.id):
                continue
            freq, ahead = np.asarray(batch.column("freq"), np.int64)[w.text], np.asarray(batch.column("ahead"), np.int64)[w.text]
            coded = batch.column("lang").dictionary_encode()
            lang = np.asarray(coded.indices, np.int64)[w.text]
            langs = len(coded.dictionary)
            last = np.searchsorted(w.text, w.text, side="right") - 1
            own = np.arange(len(w.id)) <= last - ahead
            if bits is not None:
                h, salt = w.hash, hashes(coded.dictionary.cast(pa.large_string()))[lang]
                at = np.flatnonzero(w.joined(part))
                good = np.zeros(len(w.id), bool)
                good[at] = hit(bits.value, mixed([salt[at], *[h[at + k] for k in range(part)]]))
            for n in lengths:
                ok = own & w.joined(n)
                if bits is not None:
                    for k in range(n - part + 1):
                        ok[: len(ok) - k] &= good[k:]
                at = np.flatnonzero(ok)
                key, size, words = lang[at], langs, [w.id[at + k] for k in range(n)]
                for x in words:
                    if size * len(w.distinct) >= 1 << 62:  # one number per distinct row so far
                        key = np.unique(key, return_inverse=True)[1]
                        size = len(at)
                    key, size = key * len(w.distinct) + x, size * len(w.distinct)
                order = np.argsort(key)
                heads = np.flatnonzero(np.diff(key[order], prepend=-1))
                if len(heads):
                    one = order[heads]
                    total = np.add.reduceat(freq[at][order], heads)
                    parts = [w.distinct.take(pa.array(x[one])) for x in words]
                    phrase = (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), n), pa.int32()), coded.dictionary.take(pa.array(lang[at][one])), phrase, pa.array(total)], ["n", "lang", "phrase", "f"])

    found = chunks.mapInArrow(run, "n int, lang string, phrase string, f long")
    return found.groupBy("n", "lang", "phrase").agg(F.sum("f").alias("f"))


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of chunks put together, or cut, to about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        for part in byte_slices(batch, "chunk", limit):
            held.append(part)
            size += part.get_total_buffer_size() if part.num_rows == batch.num_rows else limit
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rest[0]


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(34)) % np.uint64(bits)).astype(np.int64)


def hit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = probes(h, 8 * len(bitmap))
    return (bitmap[one >> 3] >> (one & 7).astype(np.uint8) & 1).astype(bool) & (bitmap[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(frequent: DataFrame, size: int) -> np.ndarray:
    """Two of `size` bits for each (lang, phrase), as bytes; at most size / 64 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = hashes(pc.list_flatten(pc.split_pattern(batch.column(1).cast(pa.large_string()), " ")))
                h = mixed([hashes(batch.column(0).cast(pa.large_string())), *words.reshape(batch.num_rows, -1).T])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(probes(h, size)))], ["bit"])

    bits = frequent.select("lang", "phrase").mapInArrow(run, "bit long")
    rows = bits.groupBy(F.expr("bit DIV 64").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("v")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[np.asarray(rows["i"])] = np.asarray(rows["v"])
    return out.view(np.uint8)


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, text_col: str = "text", lang_col: str = "lang", period: int = PERIOD, bits: int = BITS) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null language is `und`, a null text empty. A phrase has 2 to 4 words of one piece and occurs at least `least` times. Its score is the
    lowest floor(2000000 a / (l + r)) of its cuts, of equal ones the first. A phrase inside a longer one that has at least `cover` percent
    of its occurrences is dropped. Repeated rows count as often as they stand, other columns are not read, an empty table gives an empty
    result. Ties in score go to the more frequent phrase, then to the smaller one in UTF-8 order."""
    chunks = written(parse(docs, text_col, lang_col, period), "chunks")
    singles = checkpointed(counts(chunks, (1,), None))
    totals = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [singles.where(F.col("f") >= least)]
    for lengths in ((2,), (3, 4)):
        levels.append(checkpointed(counts(chunks, lengths, bitmap(levels[-1], bits)).where(F.col("f") >= least)))
    frequent = levels[0].union(levels[1]).union(levels[2]).withColumnRenamed("n", "words")
    many = frequent.where("words >= 2").withColumnRenamed("f", "a")
    word = F.split("phrase", " ")
    piece = lambda start, length: F.concat_ws(" ", F.slice(word, start, length))
    cuts = many.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", piece(F.lit(1), F.col("k"))).withColumn("right", piece(F.col("k") + 1, F.col("words") - F.col("k")))
    sides = frequent.select("lang", "phrase", "f")
    cuts = cuts.join(sides.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(sides.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("CAST(2000000 * CAST(a AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    inner = many.where("words >= 3").select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    inner = inner.groupBy("lang", piece(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    covered = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(cover) * F.col("a"), F.lit(False))
    left = lowest.join(inner, ["lang", "phrase"], "left").where(~covered).join(totals, "lang")
    ranked = left.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def twin_sql(least: int = LEAST, cover: int = COVER, top: int = TOP) -> str:
    """DuckDB SQL of the same rows, by listing every phrase of every piece."""
    blank, cut = "[ \\t]+", "[.,;:!?\\n\\x0b\\x0c\\r]"
    grams = " UNION ALL ".join(f"SELECT lang, {n} AS words, concat_ws(' ', {', '.join(f'w{k}' for k in range(1, n + 1))}) AS phrase FROM nexts WHERE w{n} IS NOT NULL" for n in range(1, LONGEST + 1))
    nexts = ", ".join(f"lead(w, {k - 1}) OVER (PARTITION BY piece ORDER BY i) AS w{k}" for k in range(1, LONGEST + 1))
    ascii_lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        f"WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({ascii_lower}, '{cut}')) AS text FROM documents),"
        f" pieces AS MATERIALIZED (SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(text, '{blank}'), lambda x: x <> '') AS w FROM texts),"
        f" nexts AS MATERIALIZED (SELECT lang, {nexts} FROM (SELECT lang, piece, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM pieces)),"
        f" grams AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),"
        f" many AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE words >= 2 AND f >= {least}),"
        " cuts AS (SELECT *, unnest(range(1, words)) AS k FROM many),"
        " scored AS (SELECT c.*, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f + y.f) AS score FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')"
        " JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),"
        " lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),"
        " sizes AS (SELECT *, unnest(range(2, words)) AS size FROM many), inner_parts AS (SELECT *, unnest(range(1, words - size + 2)) AS s FROM sizes),"
        " longer AS (SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),"
        " totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE words = 1 GROUP BY lang)"
        " SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score::BIGINT AS score"
        f" FROM lowest LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang) WHERE coalesce(100 * longer < {cover} * a, TRUE) QUALIFY rank <= {top}"
    )
