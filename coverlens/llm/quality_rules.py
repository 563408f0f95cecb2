"""Quality rules: word statistics and compression bands.

A text is compressed whole and in fixed chunks with zstandard. Its ratio (bytes / compressed bytes) must lie inside the band of its
length, and so must the ratios of its chunks: too large a share of bad chunks, or a run of them, rejects the text. Below the band a text is
incompressible (encoded data), above it repetitive. A first pass narrows the bands to quantiles of the ratios of all documents, with a
margin. Everything is computed per row in Arrow batches; only the ratios' quantile summaries are shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import texts_of, tidy, worker_state

#: (least bytes, lowest ratio, highest ratio), chosen so that prose of any language lies well inside; a short text carries the frame's fixed bytes.
BANDS = ((0, 0.0, 1e9), (64, 0.6, 2.6), (300, 1.1, 3.0), (1000, 1.25, 3.6), (3000, 1.36, 4.2), (10_000, 1.4, 4.8), (30_000, 1.4, 5.5))
CHUNK_BYTES = 4096
#: A text is rejected from this share of bytes in bad chunks, or this many bad chunks in a row.
BAD_SHARE, BAD_RUN = 0.2, 4
#: Quantiles that narrow a length class of at least so many documents, and the factors of their margin, for languages that are rare here.
QUANTILES, MARGINS, LEAST_DOCS = (0.01, 0.99), (0.92, 1.15), 200
LEVEL = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunk_bytes long, kept boolean"


def in_band(n_bytes: int, ratio: float, bands=BANDS) -> bool:
    low, high = next((lo, hi) for least, lo, hi in reversed(bands) if n_bytes >= least)
    return low <= ratio <= high


def repeat_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge(text: str, compress, chunk: int = CHUNK_BYTES, bands=BANDS) -> tuple:
    """All columns of FIELDS for one text."""
    words = WORD.findall(text)
    n = len(words)
    repeated = repeat_words(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    data = text.encode("utf-8", "surrogatepass")
    ratio = len(data) / len(compress(data))
    bad = run = longest = 0
    for at in range(0, len(data), chunk) if len(data) > chunk else ():
        part = data[at : at + chunk]
        if not in_band(len(part), len(part) / len(compress(part)), bands):
            bad += len(part)
            run += 1
            longest = max(longest, run)
        else:
            run = 0
    kept = not base_failed and in_band(len(data), ratio, bands) and bad < max(1, BAD_SHARE * len(data)) and longest < BAD_RUN
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, base_failed, ratio, bad, kept


def learned_bands(docs: DataFrame, text_col: str = "text") -> tuple:
    """BANDS narrowed by the quantiles of the documents that pass the base rule and lie inside BANDS, per length class.

    A class of too few documents takes the lower end of the class below it, since longer texts compress better, and keeps its upper one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            sizes, ratios = [], []
            for text in texts_of(batch.column(0)):
                words = WORD.findall(text)
                data = text.encode("utf-8", "surrogatepass")
                if len(words) < MIN_WORDS or 100 * repeat_words(words) > MAX_REPEAT_PERCENT * len(words):
                    continue
                ratio = len(data) / len(compress(data))
                if in_band(len(data), ratio):
                    sizes.append(max(b[0] for b in BANDS if b[0] <= len(data)))
                    ratios.append(ratio)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(ratios, pa.float64())], ["least", "ratio"])

    found = docs.select(text_col).mapInArrow(tidy(run), "least long, ratio double").groupBy("least").agg(F.count("*").alias("n"), F.percentile_approx("ratio", list(QUANTILES), 10_000).alias("q"))
    seen = {r["least"]: r["q"] for r in found.collect() if r["n"] >= LEAST_DOCS}
    out, below = [], 0.0
    for least, low, high in BANDS:
        if least in seen:
            below, high = seen[least][0] * MARGINS[0], min(high, seen[least][1] * MARGINS[1])
        out.append((least, max(low, below), high))
    return tuple(out)


NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the columns of FIELDS.

    Null and blank texts have no word, fail the base rule and are not kept. Repeated rows are judged one by one, an empty table gives
    an empty one, and other columns of the input are not read, whatever their names."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {FIELDS}"
    bands = learned_bands(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            rows = list(zip(*(judge(x, compress, bands=bands) for x in texts_of(batch.column(1))))) or [()] * len(NAMES)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, t) for r, t in zip(rows, types))], [id_col, *NAMES])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; a filter inside the Arrow batches, without join or shuffle."""
    at = docs.columns.index(text_col)
    bands = learned_bands(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            yield batch.filter(pa.array([judge(x, compress, bands=bands)[-1] for x in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
