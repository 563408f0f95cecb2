"""Token counts: lengths only, from batches balanced by bytes, long texts split at safe boundaries.

A sentencepiece BPE model without extra white space removal encodes a text as if every blank were its word mark and a mark stood before
the text. If no piece holds a mark behind another character, no merge crosses the place before a blank that follows a non-blank. Cut
there and drop that one blank: the part's own leading mark takes its place, so the lengths add up exactly. `safe_model` proves the
condition on the vocabulary; texts of a model that fails it are never split."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from coverlens.llm.common import byte_slices, texts_of

BATCH_BYTES = 1 << 20
PART_CHARS = 1 << 14
LIMIT = 4096
MARK = "▁"
CUT = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Pieces of about `size` characters, cut at single blanks between other characters, the blank dropped."""
    out, start = [], 0
    while len(text) - start > size:
        m = CUT.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.end()
    out.append(text[start:])
    return out


def safe_model(model) -> bool:
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return not any(MARK in p.lstrip(MARK) for p in pieces) and model.encode("a b", out_type=str)[0].startswith(MARK) and len(model.encode("a  b ")) == len(model.encode("a  b")) + 1


def sentencepiece_lengths(path: str):
    """Function from texts to their token counts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = PART_CHARS if safe_model(model) else 1 << 62

    def lengths(texts: list[str]) -> list[int]:
        cut = [parts(t, size) for t in texts]
        flat = iter(map(len, model.encode([p for ps in cut for p in ps], num_threads=1)))
        return [sum(next(flat) for _ in ps) for ps in cut]

    return lengths


def tokenizers_lengths(path: str):
    """The same for a tokenizers file; its long texts are not split, as their boundaries depend on the file's pre-tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. Null text counts as empty and has 0 tokens; repeated rows are counted one
    by one; other columns are not read. The vocabulary file must lie at `path` on every executor. Nothing is shuffled."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (sentencepiece_lengths if path.endswith(".model") else tokenizers_lengths)(path)
        for whole in batches:
            for batch in byte_slices(whole, text_col, BATCH_BYTES):
                n = pa.array(lengths(texts_of(batch.column(1))), pa.int64())
                size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
