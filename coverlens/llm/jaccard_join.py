"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts with the same shingle set form one class, represented by its set key. Every class enters each tree of the forest under a prefix of
its MinHash signature; the prefixes start at full depth and are shortened until the recall over all trees, for a pair just at the
threshold, reaches the target. Classes that share a prefix in a tree form a bucket. A bucket's members are dealt into blocks of bounded
size, and each pair of blocks is verified in one task from whole shingle sets; a pair counts only in the first tree that it shares. A
verified block sends one row per linked class: its links and the smallest class it is connected with, never the pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import byte_slices, checkpointed, linked_rows, texts_of, tidy, worker_state

WORDS, THRESHOLD = 5, 0.8
TREES, FULL_DEPTH, RECALL = 20, 8, 0.9999
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 17
SLICE_BYTES = 1 << 21
WORD = re.compile("[^\x20\x09-\x0d]+")
MUL = np.uint64(0x9E3779B97F4A7C15)


def forest_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, full: int = FULL_DEPTH) -> int:
    """Longest prefix at which a pair at the threshold shares one in some tree with probability `recall`; 1 if none is short enough."""
    depth = full
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MUL
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text has one shingle of all its words, a wordless one none."""
    lists = [WORD.findall(t) for t in texts]
    flat = np.fromiter((xxhash.xxh64_intdigest(w) for ws in lists for w in ws), np.uint64, sum(map(len, lists)))
    out, at = [], 0
    for n in map(len, lists):
        h, at = flat[at : at + n], at + n
        k = min(n, words)
        x = np.full(n - k + 1 if n else 0, k, np.uint64)
        for i in range(k):
            x = mix(x + h[i : n - k + 1 + i])
        out.append(np.unique(x))
    return out


def set_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """A 128-bit key of each set, null of an empty one."""
    return [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]


def prefixes(sets: list[np.ndarray], depth: int, trees: int = TREES) -> np.ndarray:
    """(sets, trees) hashes of the first `depth` MinHash values in each tree. The sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)][:-1])
    rng = np.random.default_rng(20)
    keys = np.zeros((len(sets), trees), np.uint64)
    for tree in range(trees):
        for _ in range(depth):
            salt, odd = rng.integers(0, 1 << 63, 2, np.uint64)
            keys[:, tree] = mix(keys[:, tree] + np.minimum.reduceat((flat ^ salt) * (odd | np.uint64(1)), starts))
    return keys.view(np.int64)


def signatures(docs: DataFrame, depth: int, id_col: str, text_col: str, with_sets: bool) -> DataFrame:
    """(id, set_key, n, prefixes[, shingles]) of each text; all but the id are null for a wordless one."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, set_key binary, n int, prefixes array<long>" + ", shingles binary" * with_sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        for whole in batches:
            for batch in byte_slices(whole, text_col, SLICE_BYTES):
                sets = shingle_sets(texts_of(batch.column(1)))
                full = [s for s in sets if len(s)]
                found = iter(prefixes(full, depth) if full else ())
                columns = [batch.column(0), pa.array(set_keys(sets), pa.binary()), pa.array([len(s) or None for s in sets], pa.int32()), pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64()))]
                if with_sets:
                    columns.append(pa.array([s.tobytes() if len(s) else None for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "set_key", "n", "prefixes", *["shingles"] * with_sets])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def verify(threshold: float):
    """Function of one pair of blocks: (set_key, links, root) of every class linked in it."""
    t = Fraction(str(threshold))
    need, both = t.numerator, t.numerator + t.denominator

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tree, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        name = rows["set_key"].to_pylist()
        keep = list({k: at for at, k in reversed(list(enumerate(name)))}.values())  # rows of a repeated document come twice
        keep.sort(key=name.__getitem__)
        rows = rows.take(pa.array(keep, pa.int64())).combine_chunks()
        name = rows["set_key"].to_pylist()
        m = len(name)
        prefix = np.array(pc.list_flatten(rows["prefixes"])).reshape(m, -1)
        data = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        n, size, block = np.array([len(x) for x in data]), np.array(rows["size"]), np.array(rows["block"])
        starts = np.cumsum(n) - n
        distinct, ids = np.unique(np.concatenate(data), return_inverse=True)
        mark = np.zeros(len(distinct), bool)
        links, root = np.zeros(m, np.int64), np.arange(m)
        linked = np.zeros(m, bool)
        for a in range(m - 1):
            rest = slice(a + 1, m)
            shared = prefix[rest] == prefix[a]
            fits = (shared.argmax(1) == tree) & shared[:, tree] & (need * np.maximum(n[rest], n[a]) <= (both - need) * np.minimum(n[rest], n[a]))
            if i != j:
                fits &= block[rest] != block[a]
            if not fits.any():
                continue
            other = np.flatnonzero(fits) + a + 1
            mark[ids[starts[a] : starts[a] + n[a]]] = True
            if len(other) * 4 > m:
                common = np.add.reduceat(mark[ids], starts, dtype=np.int64)[other]
            else:
                common = np.array([np.count_nonzero(mark[ids[starts[b] : starts[b] + n[b]]]) for b in other.tolist()])
            mark[ids[starts[a] : starts[a] + n[a]]] = False
            other = other[both * common >= need * (n[other] + n[a])]
            if not len(other):
                continue
            links[a] += size[other].sum()
            links[other] += size[a]
            linked[a] = linked[other] = True
            roots = np.unique(np.append(root[other], root[a]))
            root[np.isin(root, roots)] = roots[0]
        at = np.flatnonzero(linked)
        return pa.table([pa.array([name[k] for k in at], pa.binary()), pa.array(links[at]), pa.array([name[root[k]] for k in at], pa.binary())], ["set_key", "links", "root"])

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, set_key, class_id, n_links, kept.

    n_links counts the other documents whose shingle sets have a Jaccard similarity of at least the threshold, exact copies included;
    class_id is the smallest id that links connect the document with; kept marks documents with that id. Null and wordless texts link
    with nothing and form classes of their own, with a null set_key. Repeated rows are copies of each other. Other columns are not read."""
    depth = forest_depth(threshold, recall)
    rows = checkpointed(signatures(docs, depth, id_col, text_col, False))
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(id_col).alias("rep"), F.count("*").alias("size"), F.min("n").alias("n"), F.min("prefixes").alias("prefixes"))
    classes = checkpointed(classes)
    trees = classes.select("set_key", "rep", "size", "n", F.posexplode("prefixes").alias("tree", "prefix"))
    buckets = trees.groupBy("tree", "prefix").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("set_key")).alias("x"), F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("y")).where("c > 1")
    first = buckets.groupBy("c", "total", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("b"))  # buckets of the same members: the first tree's
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    first = first.select("b.tree", "b.prefix", blocks.alias("blocks"))
    members = trees.join(first, ["tree", "prefix"]).withColumn("block", F.pmod(F.xxhash64("set_key", F.lit(2)), F.col("blocks")).cast("int"))
    members = checkpointed(members.select("tree", "prefix", "blocks", "block", "set_key", "rep", "size"))
    wanted = members.select(F.col("rep").alias("_rep")).distinct()
    found = docs.select(id_col, text_col).join(wanted, F.col(id_col).eqNullSafe(F.col("_rep")), "left_semi")
    sets = signatures(found, depth, id_col, text_col, True).where("set_key IS NOT NULL").select("set_key", "prefixes", "shingles")
    pairs = members.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("tree", "prefix", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "set_key", "size")
    tasks = pairs.join(sets, "set_key").groupBy("tree", "prefix", "i", "j")
    out = checkpointed(tasks.applyInArrow(verify(threshold), "set_key binary, links long, root binary"))
    return linked_rows(rows, classes, out, id_col)


def with_set_key(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """The documents with the key of their shingle set as a further column."""
    at, schema = docs.columns.index(text_col), docs.select("*", F.lit(None).cast("binary").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        for whole in batches:
            for batch in byte_slices(whole, text_col, SLICE_BYTES):
                keys = pa.array(set_keys(shingle_sets(texts_of(batch.column(at)))), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, keys], [f.name for f in schema])

    return docs.mapInArrow(tidy(run), schema)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id, with all its columns; wordless texts all stay."""
    best = jaccard_join(docs, id_col=id_col, text_col=text_col).where("kept AND set_key IS NOT NULL").select(F.col(id_col).alias("_id"), F.col("set_key").alias("_key")).distinct()
    keyed = with_set_key(docs, "_set", text_col)
    on = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_set") == F.col("_key"))
    some = keyed.where("_set IS NOT NULL").join(best, on, "left_semi").dropDuplicates([id_col, "_set"])
    return some.unionByName(keyed.where("_set IS NULL")).drop("_set")
