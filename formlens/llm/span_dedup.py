"""Suffix-array dedup: removes each byte of a string of MATCH bytes that also starts elsewhere.

Only regions around repeated anchors can hold such strings: the gram of a window with the
least hash is the same in equal windows, and one that is found once in all texts rules its
windows out. The regions are dealt into shards by their least repeated anchor, so that
copies mostly meet; a suffix array of each shard, refined by ranks, and Kasai's common
prefixes give the strings that repeat within it. Anchors found in several shards remain:
the windows at these are fingerprinted, and each shard's sorted list is looked up in those
of the others by binary search. Groups of one anchor larger than a shard are spread over
several. Equal texts are worked on once.

Passages are told by words: where a number of words is asked for, each run of as many words
that also starts elsewhere goes too, whatever its bytes and the spaces between. Anchors are
grams of words then, and the windows of words at repeated ones are compared by 64 bits and
the range, one of 1,024 at least, that they fall into by as many others.

Defined cases: null and empty text has no bytes and loses none; text under MATCH bytes
loses none; a text that is there twice loses all; strings never cross texts; an empty table
gives no rows; remove_repeats() returns all columns of the input and no others. A task's
memory is a multiple of the longest text. remove_repeats() keeps the characters that are removed in part, so that text stays text.
Grams are found by 64-bit hashes, where a chance hit costs time only; windows of different
shards are compared by 64 bits and the range they fall into by as many others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm.arrow import chunks, flat_bytes
from formlens.llm.common import BROADCAST_ROWS, documents, join_keyed, nested, release, stored
from formlens.llm.suffixes import BASES, BORDER, GRAM, SPACE, WORD_GRAM, anchors, common_prefixes, mixed, runs, suffix_array, window_hashes
from formlens.llm.suffixes import words as words_of

MATCH = 400
CHUNK = 4 << 20
#: Mean bytes of a shard; a group of regions with more is spread.
SHARD_BYTES = 2 << 20
#: Most windows of a region.
PIECE = 1 << 18
#: Least words of a passage.
PASSAGE_WORDS = 51
#: Hashes of a block of texts, which are handed on at once.
PRINTS = 1 << 18
#: Least ranges that hashes of blocks are dealt into, and most hashes of one, on average.
RANGES, RANGE_PRINTS = 1 << 10, 1 << 21


def text_key() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def anchored_texts(docs: DataFrame, match: int = MATCH, words: int = 0) -> DataFrame:
    """(key, copies, packed, hashes, places, and word_hashes, word_places if words are asked for) of each different text of match bytes, or of as many words, at least."""
    names = ["hashes", "places"] + ["word_hashes", "word_places"] * (words > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in chunks(batches, "text", CHUNK):
            data, offsets = flat_bytes(batch.column("text"))
            texts = [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            of_words = [anchors(words_of(x)[2], words, WORD_GRAM) for x in texts] if words else [((), ())] * len(texts)
            long = [i for i, x in enumerate(texts) if len(x) >= match or len(of_words[i][0])]
            columns = [batch.column("key").take(pa.array(long, pa.int64())), pa.array([packer.compress(texts[i].tobytes()) for i in long], pa.binary())]
            for found in [[anchors(texts[i], match) for i in long], [of_words[i] for i in long]][: len(names) // 2]:
                columns += [pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "packed", *names])

    least = min(match, 2 * words - 1) if words else match  # a word takes a byte, and a space stands between two
    long = docs.filter(F.octet_length("text") >= least).select(text_key().alias("key"), "text")
    made = lambda some: some.mapInArrow(run, "key binary, packed binary, " + ", ".join(f"{x} array<{'int' if 'places' in x else 'bigint'}>" for x in names))

    def once(found: DataFrame) -> DataFrame:
        return found.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("packed", *names)).alias("x")).select("key", "copies", "x.*")

    several = stored(long.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "span-copies")
    if several.count() > BROADCAST_ROWS:
        return once(made(long))
    alone = made(long.join(F.broadcast(several), "key", "left_anti")).select("key", F.lit(1).cast("long").alias("copies"), "packed", *names)  # texts without copies aren't shuffled
    return alone.unionByName(once(made(long.join(F.broadcast(several), "key", "left_semi"))))


def in_several(found: DataFrame, values: list[str], name: str) -> DataFrame:
    """The values of found (key, place, values) that stand at several places; stored, else a join on them can't be split where a value is hot."""
    where = F.xxhash64("key", "place")
    return stored(found.groupBy(*values).agg(F.min(where).alias("lo"), F.max(where).alias("hi")).filter("lo <> hi").select(*values), name)


def blocked(block: int, keys: pa.Array, rows: list[tuple[np.ndarray, ...]], ranges: int) -> Iterator[pa.RecordBatch]:
    """One block of texts, each with places in order and two hashes a place: where each text stands in the block, the places whose hashes repeat within it, and the other hashes by range."""
    sizes = np.array([int(at[-1]) + 2 if len(at) else 1 for at, *_ in rows])  # no place of a text follows one of the text before
    bases = np.cumsum(sizes) - sizes
    at = np.concatenate([x[0] + base for x, base in zip(rows, bases, strict=True)]).astype(np.int32)
    first, second = (np.concatenate([x[k] for x in rows]) for k in (1, 2))
    of = (second % np.uint64(ranges)).astype(np.uint16)
    order = np.argsort(first)
    order = order[np.argsort(of[order], kind="stable")]
    at, first, of = at[order], first[order], of[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (first[1:] != first[:-1]) | (of[1:] != of[:-1])
    alone = fresh & np.append(fresh, True)[1:]
    first, of, asked = first[fresh], of[fresh], np.where(alone, at, np.int32(-1))[fresh]
    cuts = np.append(np.flatnonzero(np.diff(of.astype(np.int32), prepend=-1)), len(of))
    parts = list(zip(cuts, cuts[1:], strict=False))
    told = [(None, None, at[~alone].tobytes())] + [(int(of[a]), first[a:b].tobytes(), asked[a:b].tobytes()) for a, b in parts]
    n, more = len(keys), len(told)
    columns = [pa.array([block] * (n + more), pa.int64()), pa.concat_arrays([keys, pa.nulls(more, keys.type)]), pa.array([*bases.tolist(), *[None] * more], pa.int32())]
    columns += [pa.array([*[None] * n, *x], kind) for x, kind in zip(zip(*told, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
    yield pa.RecordBatch.from_arrays(columns, names=["shard", "key", "base", "range", "prints", "places"])


def repeated_places(texts: DataFrame, prints: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]], width: int, ranges: int, name: str) -> DataFrame:
    """(key, spans): runs of the places of each text whose two hashes also stand elsewhere, each width long; prints gives the places and hashes of a batch's texts.

    Hashes travel in blocks of texts, sorted and packed by range, each once a block, so a
    hot one is as many entries as there are blocks.
    """
    whole = "packed" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "packed", CHUNK) if whole else batches:
            keys, rows, held, done = batch.column("key"), [], 0, 0
            for i, row in enumerate(prints(batch)):
                rows.append(row)
                held += len(row[0])
                if held > PRINTS or i == batch.num_rows - 1:
                    yield from blocked(block, keys.slice(done, len(rows)), rows, ranges)
                    block, rows, held, done = block + 1, [], 0, i + 1

    local = stored(texts.mapInArrow(run, "shard bigint, key binary, base int, range int, prints binary, places binary"), name)
    answers = local.filter("range IS NOT NULL").select("range", "shard", "prints", "places").groupBy("range").applyInArrow(looked_up, "of_shard bigint, places binary")
    answers = answers.unionByName(local.filter("range IS NULL AND octet_length(places) > 0").select(F.col("shard").alias("of_shard"), "places"))
    layout = local.filter("key IS NOT NULL").select("shard", "key", F.lit(0).alias("start"), "base")
    across = layout.groupBy("shard").cogroup(answers.groupBy("of_shard")).applyInArrow(lambda left, right: placed(left, right, width), "key binary, spans array<int>")
    spans = stored(across, f"{name}-spans")
    release(local)
    return spans


def repeated_passages(texts: DataFrame, words: int) -> DataFrame:
    """(key, spans) of the runs of so many words that also start elsewhere, from a word to before another, by their numbers."""
    total = texts.agg(F.coalesce(F.sum(F.size("word_hashes")), F.lit(0))).first()[0]
    ranges = min(max(RANGES, total * (words - WORD_GRAM + 2) // 2 // RANGE_PRINTS), 1 << 16)  # a window of words for each word, at most

    def of_anchors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for hashes, places in zip(batch.column("word_hashes"), batch.column("word_places"), strict=True):
            found = hashes.values.to_numpy().view(np.uint64)
            yield places.values.to_numpy(), found, mixed(found)  # an anchor that is found by chance costs time only

    def of_windows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        opener = zstandard.ZstdDecompressor()
        for packed, own in zip(batch.column("packed"), batch.column("spans"), strict=True):
            names = words_of(np.frombuffer(opener.decompress(packed.as_buffer()), np.uint8))[2]
            n, spans = len(names) - words + 1, own.values.to_numpy().reshape(-1, 2)
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, np.maximum(spans[:, 0] - (words - WORD_GRAM), 0), 1)
            np.add.at(edges, np.minimum(spans[:, 1], n), -1)
            at = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
            yield at, *(window_hashes(names, words, base)[at] for base in BASES)

    anchored = repeated_places(texts.filter(F.size("word_hashes") > 0).select("key", "word_hashes", "word_places"), of_anchors, 1, ranges, "passage-anchors")
    spans = repeated_places(texts.select("key", "packed").join(anchored, "key"), of_windows, words, ranges, "passage-windows")
    release(anchored)
    return spans


def regions(texts: DataFrame, match: int = MATCH, piece: int = PIECE) -> DataFrame:
    """(key, start, bytes, hashes, places, group): the parts of texts whose windows hold a repeated anchor; a part of over piece windows is cut so that each window is in one."""
    found = texts.select("key", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("key", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
    repeated = in_several(found, ["hash"], "span-anchors")
    own = found.join(repeated, "hash", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in chunks(batches, "packed", CHUNK):
            rows: list[tuple] = []
            keys = batch.column("key").to_pylist()
            own = batch.column("own")
            ends = own.offsets.to_numpy()
            fields = own.values.flatten()
            places, hashes = fields[0].to_numpy().astype(np.int64), fields[1].to_numpy()
            for i, packed in enumerate(batch.column("packed")):
                text = opener.decompress(packed.as_buffer())
                at, named = places[ends[i] : ends[i + 1]], hashes[ends[i] : ends[i + 1]]
                lo, hi = np.maximum(at - (match - GRAM), 0), np.minimum(at + match, len(text))
                cuts = np.concatenate([[0], np.flatnonzero(lo[1:] > hi[:-1]) + 1, [len(at)]])
                for a, b in zip(cuts, cuts[1:], strict=False):
                    for first in range(int(lo[a]), int(hi[b - 1]) - match + 1, piece):  # windows that start from first to last
                        last = min(first + piece, int(hi[b - 1]) - match + 1) - 1
                        some = slice(a + int(np.searchsorted(at[a:b], first)), a + int(np.searchsorted(at[a:b], last + match - GRAM, "right")))
                        if some.start < some.stop:
                            rows.append((keys[i], first, text[first : last + match], named[some], (at[some] - first).astype(np.int32), int(named[some].min())))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["key", "start", "bytes", "hashes", "places", "group"])

    return texts.select("key", "packed").join(own, "key").mapInArrow(run, "key binary, start int, bytes binary, hashes array<bigint>, places array<int>, group bigint")


def dealt(found: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The regions with a shard, and the number of shards."""
    sizes = stored(found.groupBy("group").agg(F.sum(F.octet_length("bytes")).alias("bytes")), "span-groups")
    total, large = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_if(F.col("bytes") > shard_bytes)).first()
    shards = max(1, -(-total // shard_bytes))
    parts = sizes.filter(F.col("bytes") > shard_bytes).select("group", F.ceil(F.col("bytes") / F.lit(shard_bytes)).alias("parts"))
    own = F.xxhash64("key", "start")
    part = F.pmod(own, F.coalesce("parts", F.lit(1)))
    return join_keyed(found, parts, "group", large, own).withColumn("shard", F.pmod(F.xxhash64("group", part), F.lit(shards)).cast("int")).drop("parts"), shards


def searched(left: pa.Table, right: pa.Table, match: int, ranges: int) -> pa.Table:
    """One shard: the spans that repeat within it, by region, and the windows at anchors that other shards have too, by range."""
    left = left.combine_chunks().sort_by([("key", "ascending"), ("start", "ascending")])
    keys, starts = left["key"].to_pylist(), left["start"].to_pylist()
    flat, offsets = flat_bytes(left["bytes"].combine_chunks() if left.num_rows else pa.array([], pa.binary()))
    bases = offsets[:-1] + np.arange(len(keys))
    data = np.full(int(offsets[-1]) + len(keys), BORDER, np.uint8)
    whole = np.zeros(len(data), bool)
    for base, a, b in zip(bases, offsets, offsets[1:], strict=False):
        data[base : base + b - a] = flat[a:b]
        whole[base : base + b - a - match + 1] = True
    before, common = common_prefixes(data, suffix_array(data, match), match)
    repeats = common >= match
    heads = before[repeats]
    twice = repeats.copy()
    twice[heads] = True
    spans: list[list[int]] = [[] for _ in keys]
    for a, b in zip(*runs(twice), strict=True):
        k = int(np.searchsorted(bases, a, side="right")) - 1
        spans[k] += [int(starts[k] + a - bases[k]), int(starts[k] + b - 1 - bases[k] + match)]
    n = len(keys)
    out = {"shard": [], "range": [None] * n, "prints": [None] * n, "places": [None] * n}
    row_of = {x: i for i, x in enumerate(zip(keys, starts, strict=True))}
    edges = np.zeros(len(data) + 1, np.int64)
    for key, start, asked in zip(right["key"].to_pylist(), right["start"].to_pylist(), right["asked"], strict=True):
        base, places = bases[row_of[key, start]], asked.values.to_numpy()
        np.add.at(edges, base + np.maximum(0, places - (match - GRAM)), 1)
        np.add.at(edges, base + places + 1, -1)
    at = np.flatnonzero((np.cumsum(edges[:-1]) > 0) & whole & ~repeats)
    if len(at):
        first, second = (window_hashes(data, match, base)[at] for base in BASES)
        of = (second % np.uint64(ranges)).astype(np.int64)
        order = np.lexsort((first, of))
        first, of = first[order], of[order]
        at = np.where(twice[at], -1, at)[order].astype(np.int32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            out["range"].append(int(of[a]))
            out["prints"].append(first[a:b].tobytes())
            out["places"].append(at[a:b].tobytes())
    more = len(out["range"]) - n
    shard = left["shard"][0].as_py() if n else None
    return pa.table(
        {
            "shard": pa.array([shard] * (n + more), pa.int32()),
            "key": pa.array(keys + [None] * more, pa.binary()),
            "start": pa.array(starts + [None] * more, pa.int32()),
            "base": pa.array(bases.tolist() + [None] * more, pa.int32()),
            "spans": pa.array(spans + [None] * more, pa.list_(pa.int32())),
            "range": pa.array(out["range"], pa.int32()),
            "prints": pa.array(out["prints"], pa.binary()),
            "places": pa.array(out["places"], pa.binary()),
        }
    )


def looked_up(table: pa.Table) -> pa.Table:
    """One range: the places of each shard's windows that are in another shard's list."""
    lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["prints"]]
    merged = np.sort(np.concatenate(lists)) if lists else np.empty(0, np.uint64)
    rows = []
    for shard, prints, places in zip(table["shard"].to_pylist(), lists, table["places"], strict=True):
        places = np.frombuffer(places.as_buffer(), np.int32)
        asked = places >= 0
        prints, places = prints[asked], places[asked]
        found = places[np.searchsorted(merged, prints, side="right") - np.searchsorted(merged, prints, side="left") > 1]
        if len(found):
            rows.append((shard, found.tobytes()))
    return pa.table({"of_shard": pa.array([x for x, _ in rows], table["shard"].type), "places": pa.array([x for _, x in rows], pa.binary())})


def placed(layout: pa.Table, answers: pa.Table, match: int) -> pa.Table:
    """One shard: the spans of its regions' texts that other shards repeat."""
    layout = layout.combine_chunks().sort_by("base")
    found = np.sort(np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x.as_buffer(), np.int32) for x in answers["places"])]))
    bases, starts = layout["base"].to_numpy(), layout["start"].to_numpy()
    first = np.flatnonzero(np.diff(found, prepend=-2) > 1)
    last = np.append(first, len(found))[1:] - 1
    of = np.searchsorted(bases, found[first], side="right") - 1
    shift = starts[of] - bases[of]
    rows, counts = np.unique(of, return_counts=True)
    ends = pa.array(np.concatenate([[0], np.cumsum(2 * counts)]), pa.int32())
    spans = pa.array(np.column_stack([found[first] + shift, found[last] + shift + match]).ravel(), pa.int32())
    return pa.table({"key": layout["key"].take(pa.array(rows, pa.int64())), "spans": pa.ListArray.from_arrays(ends, spans)})


def repeated_spans(texts: DataFrame, match: int = MATCH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, spans): starts and ends, one after the other and perhaps overlapping, of the bytes of each text that are repeated."""
    parts = stored(regions(texts, match), "span-regions")
    found, shards = dealt(parts, shard_bytes)
    found = stored(found, "span-shards")
    release(parts)
    held = found.select("shard", "key", "start", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("shard", "key", "start", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
    crossing = stored(held.groupBy("hash").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).filter("lo <> hi").select("hash"), "span-crossing")
    asked = held.join(crossing, "hash", "left_semi").groupBy("shard", "key", "start").agg(F.collect_list("place").alias("asked")).toDF("of_shard", "key", "start", "asked")  # a row a region at most
    ranges = 4 * shards
    by_shard = found.select("shard", "key", "start", "bytes").groupBy("shard").cogroup(asked.groupBy("of_shard"))
    kinds = "shard int, key binary, start int, base int, spans array<int>, range int, prints binary, places binary"
    local = stored(by_shard.applyInArrow(lambda left, right: searched(left, right, match, ranges), kinds), "span-local")
    release(found, crossing)
    answers = local.filter("range IS NOT NULL").select("range", "shard", "prints", "places").groupBy("range").applyInArrow(looked_up, "of_shard int, places binary")
    layout = local.filter("key IS NOT NULL").select("shard", "key", "start", "base")
    across = layout.groupBy("shard").cogroup(answers.groupBy("of_shard")).applyInArrow(lambda left, right: placed(left, right, match), "key binary, spans array<int>")
    both = local.filter("size(spans) > 0").select("key", "spans").unionByName(across)
    spans = stored(both.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "span-spans")
    release(local)
    return spans


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Rows of start and end, apart and in order."""
    pairs = spans.reshape(-1, 2)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    first = np.concatenate([[True], pairs[1:, 0] > ends[:-1]])
    return np.column_stack([pairs[first, 0], ends[np.concatenate([first[1:], [True]])]])


def whole_characters(text: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The spans without the characters that they cut."""
    inside = np.append((text & 0xC0) == 0x80, False)
    out = []
    for a, b in spans.tolist():
        while inside[a]:
            a += 1
        while inside[b]:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def left_of(text: np.ndarray, spans: np.ndarray) -> bytes:
    keep = np.ones(len(text), bool)
    for a, b in spans.tolist():
        keep[a:b] = False
    return text[keep].tobytes()


def verdicts(docs: DataFrame, match: int = MATCH, shard_bytes: int = SHARD_BYTES, with_text: bool = False, *, words: int = 0) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, n_passage_bytes, and kept_text if asked for) of each text that loses bytes or holds a repeated passage.

    The first three are of strings of match bytes alone, n_passage_bytes of runs of so many
    words alone (0 if words is 0); kept_text is without both. n_removed and n_passage_bytes
    are null for texts that stand several times, of which all goes.
    """
    texts = stored(anchored_texts(docs, match, words), "span-texts")
    none = F.array().cast("array<int>")
    by_words = repeated_passages(texts, words).select("key", none.alias("spans"), F.col("spans").alias("passages")) if words else None  # first, as it needs the most disk
    spans = repeated_spans(texts, match, shard_bytes).select("key", "spans", none.alias("passages"))
    if words:
        spans = by_words.unionByName(spans)
        spans = spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("passages")).alias("passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in chunks(batches, "packed", CHUNK):
            removed, count, digest, of_words, kept = [], [], [], [], []
            for packed, own, passages in zip(batch.column("packed"), batch.column("spans"), batch.column("passages"), strict=True):
                text = np.frombuffer(opener.decompress(packed.as_buffer()), np.uint8)
                found, more = joined_spans(own.values.to_numpy()), passages.values.to_numpy().reshape(-1, 2)
                if len(more):
                    starts, ends = runs(~SPACE[text])
                    more = joined_spans(np.column_stack([starts[more[:, 0]], ends[more[:, 1] - 1]]))
                removed.append(int((found[:, 1] - found[:, 0]).sum()))
                count.append(len(found))
                digest.append(hashlib.sha256(left_of(text, found)).hexdigest())
                of_words.append(int((more[:, 1] - more[:, 0]).sum()))
                if with_text:
                    kept.append(left_of(text, whole_characters(text, joined_spans(np.concatenate([found, more])))).decode())
            columns = [batch.column("key"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(of_words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * with_text, names=["key", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"] + ["kept_text"] * with_text)

    kinds = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_bytes bigint" + ", kept_text string" * with_text
    parts = texts.filter("copies = 1").select("key", "packed").join(spans, "key").mapInArrow(run, kinds)
    has = lambda column: F.size(column) > 0
    all_of = lambda held: F.when(held, F.lit(None)).otherwise(F.lit(0)).cast("long")
    gone = texts.filter("copies > 1").select(
        "key",
        all_of(has("hashes")).alias("n_removed"),
        has("hashes").cast("long").alias("n_spans"),
        F.when(has("hashes"), F.lit(hashlib.sha256().hexdigest())).alias("kept_sha256"),
        all_of(has("word_hashes") if words else F.lit(False)).alias("n_passage_bytes"),
        *[F.lit("").alias("kept_text")] * with_text,
    )
    found = stored(parts.unionByName(gone), "span-verdicts")
    release(texts)
    return found


def remove_repeats(docs: DataFrame, match: int = MATCH, words: int = 0) -> DataFrame:
    """docs without the repeated bytes, and the repeated runs of words if asked for, in text, and with n_chars, where it is a column, of what is left."""
    found = verdicts(docs, match, with_text=True, words=words).select("key", "kept_text")
    keyed = nested(docs, text_key().alias("key")).filter("row.text IS NOT NULL")
    changed = {"text": F.col("kept_text")} | ({"n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    with_kept = lambda rows: [changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in rows]
    if found.count() > BROADCAST_ROWS:
        joined = keyed.join(found, "key", "left")
        parts = [joined.filter("kept_text IS NULL").select("row.*"), joined.filter("kept_text IS NOT NULL").select(*with_kept(docs.columns))]
    else:  # only the rows that change are shuffled, and without their text
        few = F.broadcast(found.select("key"))
        slim = keyed.join(few, "key", "left_semi").select("key", F.col("row").dropFields("text").alias("row"))
        parts = [keyed.join(few, "key", "left_anti").select("row.*"), slim.join(found, "key").select(*with_kept(docs.columns))]
    return docs.filter("text IS NULL").unionByName(parts[0]).unionByName(parts[1])


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document, and the digest of the rest; n_passage_bytes are those in runs of PASSAGE_WORDS words that also start elsewhere, whatever their bytes, and are not removed for it."""
    docs = documents(spark, sf_dir)
    found = verdicts(docs, words=PASSAGE_WORDS)
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), text_key().alias("key"))
    of_all = lambda column: F.when(F.col("n_spans").isNull(), F.lit(0)).otherwise(F.coalesce(column, "n_bytes")).cast("long")
    return rows.join(found, "key", "left").select(
        "doc_id",
        "n_bytes",
        of_all("n_removed").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("key"))).alias("kept_sha256"),
        of_all("n_passage_bytes").alias("n_passage_bytes"),
    )
