"""MinHash near-dedup: one-permutation hashing, bands, star-shaped candidates, exact confirmation.

Each document is a set of hashed word shingles. Documents of one set form a class, and
only classes are compared. One-permutation hashing fills BINS bins; empty bins copy a
filled one by optimal densification. Classes that share a band are candidates: each is
first compared with one smallest class of its bands, so that the candidate edges form
stars. Bands whose members then still are of several components are searched in blocks:
a task compares the full sets of a block's members of different components and gives only
the links that join components, so no list of pairs is ever made and no link is lost.

Defined cases: null, empty and wordless text has an empty set, is linked with nothing
and is its own component; fewer than SHINGLE words are one shingle; repeated rows are
copies of each other; of null doc_ids a component takes none unless it has no other; an
empty table gives no rows; near_duplicates() returns no other columns of the input, and
one_of_each() all of them and no others. Shingles are compared by 64-bit hashes, sets by
128-bit ones. A task's memory is a multiple of the longest text. There are as many bands as a pair at the
threshold misses with a probability of MISS: 25 at 85 percent, 37 at 80.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlens.llm.arrow import chunks
from formlens.llm.common import BROADCAST_ROWS, documents, nested, release, stored
from formlens.llm.components import connected

SHINGLE = 5
#: Least similarity in percent that op10 links.
THRESHOLD = 85
#: Members of a bucket that are compared in one task.
BLOCK = 1024
BINS, ROWS, MISS = 256, 5, 4.5e-7
CHUNK = 4 << 20
PROBES = 4096
_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_PROBE = np.random.default_rng(7).integers(0, BINS, (BINS, PROBES), dtype=np.int16)
_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(56)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.flatten()
    full = np.concatenate([[0], np.cumsum(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))])
    ends = full[offsets - offsets[0]]
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    vocabulary = np.array([xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)
    w = vocabulary[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    n = len(w) - SHINGLE + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for j in range(SHINGLE if n > 0 else 0):
        grams += w[j : j + n] * _ODD[j]
    grams = mixed(grams)
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a >= SHINGLE:
            found = np.sort(grams[a : b - SHINGLE + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            out.append(mixed(np.sum(w[a:b] * _ODD[8 : 8 + b - a], keepdims=True) + _ODD[20 + b - a : 21 + b - a]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bands_at(percent: float) -> int:
    """How many bands a pair of that similarity misses with MISS."""
    found = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))
    if found * ROWS > BINS:
        raise ValueError(f"{found} bands need more than {BINS} bins")
    return found


def bands(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n band keys of a sorted set that isn't empty."""
    at = np.searchsorted(hashes, _STARTS)
    filled = np.diff(np.append(at, len(hashes))) > 0
    source = np.arange(n * ROWS)
    empty = np.flatnonzero(~filled[: n * ROWS])
    for probes in (16, PROBES):
        if len(empty):
            hits = filled[_PROBE[empty, :probes]]
            source[empty] = _PROBE[empty, hits.argmax(axis=1)]
            empty = empty[~hits.any(axis=1)]
    source[empty] = np.flatnonzero(filled)[0]
    values = hashes[at[source]].reshape(n, ROWS)
    return mixed((values * _ODD[32 : 32 + ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64) * _ODD[40])


def signed(docs: DataFrame, percent: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, bands) of each row; set_id and bands are null for the empty set."""
    n = bands_at(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            sets = shingle_sets(batch.column("text"))
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            of = [bands(x, n).view(np.int64) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(of, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_id", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key binary, n_shingles bigint, set_id binary, bands array<bigint>")


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, shingles) of the classes whose text_key is wanted; each text is worked on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            sets = [x for x in shingle_sets(batch.column("text")) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                names=["set_id", "shingles"],
            )

    few = wanted.count() <= BROADCAST_ROWS  # else the texts are shuffled once
    texts = docs.select(text_key().alias("text_key"), "text").join(F.broadcast(wanted) if few else wanted, "text_key", "left_semi")
    once = texts.groupBy("text_key").agg(F.min("text").alias("text"))
    return once.select("text").mapInArrow(run, "set_id binary, shingles array<bigint>").dropDuplicates(["set_id"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with shared and union: the sizes of the intersection and the union of their sets."""
    right = pairs.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("union"))


def similar(percent: float) -> Column:
    return F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("union")


def mixed_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (bucket, cls, root) of buckets that hold several components, with the size of the bucket."""
    rooted = members.select("bucket", "cls").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    kept = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    return rooted.join(kept.select("bucket", "size"), "bucket")


def links_within(table: pa.Table, percent: float = THRESHOLD) -> pa.Table:
    """The links (a, b) between components of one block of a bucket; each joins two of them, so they are fewer than the members."""
    keys = table["cls"].to_pylist()
    names, group = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)
    lists = table["shingles"].combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    codes = np.unique(flat, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(keys)), sizes)
    held = np.zeros(codes.max(initial=-1) + 1, bool)
    out: list[tuple[bytes, bytes]] = []
    for i in range(len(keys) - 1):
        if (group[i + 1 :] == group[i]).all():
            continue
        own = codes[offsets[i] : offsets[i + 1]]
        held[own] = True
        rest = slice(offsets[i + 1], None)
        shared = np.bincount(owner[rest][held[codes[rest]]], minlength=len(keys))[i + 1 :]
        held[own] = False
        for j in np.flatnonzero(100 * shared >= percent * (sizes[i] + sizes[i + 1 :] - shared)) + i + 1:
            if group[i] != group[j]:
                out.append((keys[i], keys[j]))
                group[group == group[j]] = group[i]
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})


def remaining_links(state: DataFrame, sets: DataFrame, percent: float = THRESHOLD) -> DataFrame:
    """Links between the components of mixed buckets; a bucket of over BLOCK members is cut into blocks, and each two meet once."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), parts).cast("int")
    dealt = state.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cls", "root")
    full = dealt.join(sets.select(F.col("set_id").alias("cls"), "shingles"), "cls")
    return full.groupBy("bucket", "lo", "hi").applyInArrow(lambda table: links_within(table, percent), "a binary, b binary")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after links (a, b) between nodes are added."""
    if roots is None:
        return connected(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    rooted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v"))
    step = connected(rooted).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = step.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots.select("node"), "node", "left_anti")
    return stored(moved.unionByName(fresh), "roots")


def class_roots(classes: DataFrame, docs: DataFrame, percent: float = THRESHOLD) -> DataFrame:
    """(node, root) of the classes that are linked with another; classes: set_id, n, text_key, bands."""
    members = classes.select(F.explode("bands").alias("bucket"), F.col("set_id").alias("cls"), "n", "text_key")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cls")).alias("held"), F.min("cls").alias("centre")).filter("size > 1")
    once = shared.groupBy("size", "held").agg(F.min(F.struct("bucket", "centre")).alias("x")).select("x.bucket", "x.centre")  # bands with the same members count once
    members = stored(members.join(once, "bucket"), "near-members")
    wanted = stored(members.select("text_key").distinct(), "near-wanted")
    sets = stored(full_sets(docs, wanted), "near-sets")
    release(wanted)
    first = members.groupBy(F.col("cls").alias("b")).agg(F.min("centre").alias("a")).filter("a <> b")
    roots = merged(None, compared(first, sets).filter(similar(percent)))
    state = stored(mixed_buckets(members, roots), "near-mixed")
    if not state.isEmpty():
        links = stored(remaining_links(state, sets, percent).distinct(), "near-links")
        roots = merged(roots, links)
        release(links)
    release(sets, members, state)
    return roots


def judged(docs: DataFrame, percent: float = THRESHOLD) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of near_duplicates(), and stored tables that they are made from."""
    signs = stored(signed(docs, percent), "near-signs")
    classes = stored(signs.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.min("text_key").alias("text_key"), F.first("bands").alias("bands")), "near-classes")
    roots = class_roots(classes, docs, percent)
    firsts = classes.select(F.col("set_id").alias("node"), "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = firsts.groupBy("root").agg(F.min("first_id").alias("component"))
    by_class = firsts.join(least, "root").select(F.col("node").alias("set_id"), "component")
    rows = signs.select("doc_id", "text_key", "n_shingles", "set_id")
    joined = rows.join(by_class, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    found = joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found, [signs, classes]


def near_duplicates(docs: DataFrame, percent: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of each row of docs; pairs of percent similarity or more are linked."""
    return judged(docs, percent)[0]


def one_of_each(docs: DataFrame, percent: float = THRESHOLD) -> DataFrame:
    """One row of docs a component of near_duplicates(), and each row without words.

    Of rows that are equal in doc_id and text, that with the least hash of all columns
    stays; rows that are equal in that too are the same but for columns that can't be hashed.
    """
    found, made_from = judged(docs, percent)
    found = stored(found, "near-verdicts")
    release(*made_from)
    by_row = found.filter("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marks = stored(by_row.filter("NOT kept OR n > 1").select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_text"), "kept"), "near-marks")
    release(found)
    few = marks.count() <= BROADCAST_ROWS
    hashed = [F.col(f"`{x.name}`") for x in docs.schema if not re.search("map|variant", x.dataType.simpleString())]
    keyed = nested(docs, "doc_id", text_key().alias("text_key"), F.xxhash64(*hashed).alias("hash"))
    joined = lambda some, how: keyed.join(F.broadcast(some) if few else some, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_text")), how)
    first = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("hash"))
    of_several = joined(marks.filter("kept"), "left_semi").withColumn("place", first).filter("place = 1")
    return joined(marks, "left_anti").select("row.*").unionByName(of_several.select("row.*"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
