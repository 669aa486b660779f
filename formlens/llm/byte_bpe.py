"""Byte-level BPE encoding and decoding.

Each match of the pattern is a word of its own. A word starts as its bytes, of which those
merges are done that the bytes beside them make certain (`sure`); an array fold merges the neighbours of least rank, the leftmost first, until none is
left, where ranks come from a literal map of part pairs. The words that are found most
often are folded once each and kept in a literal map as well, the commonest with the codes
and bytes of their ids. The map is bounded, and so
other words are folded where they stand: to fold these once too, all documents would have
to be shuffled to bring the ids back. Decoding looks up the bytes of each id, and
concatenates them over the text.

Defined cases: null text is encoded as the empty text; special tokens are plain text;
repeated rows stay; an empty table gives no rows; columns named as the added ones are
replaced. A fold takes the square of a word's length: words of over LONG bytes are made
distinct and each is merged once in a task in Python that keeps the pairs in a heap, with
the same ids; they are joined to their texts, whose other words are folded.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from formlens.llm.arrow import chunks
from formlens.llm.common import documents, release, stored

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Bytes of the longest word that is folded.
LONG = 1024
#: Most words that are folded ahead, and bytes of the longest of them; together they bound the literal maps.
KNOWN, KNOWN_BYTES = 250_000, 64
#: Most words of the first map, which has their codes and bytes as well, and buckets of the two, each a power of two.
OFTEN, WORD_BUCKETS = 20_000, (16_384, 131_072)
PAIR_BUCKETS = 32_749
#: Tokens below this rank, of so many bytes at most, are looked for as sure starts of a fold; others are left to its merges, with the same ids.
SURE_BELOW, SURE_BYTES, SURE_BUCKETS = 768, 8, 1024
#: A part's number: its id, its place among the first parts, and its rank with the next part.
ID_BITS, RANK_AT = 20, 40
ID_MASK, PLACE_MASK, NO_RANK = (1 << 20) - 1, ((1 << 40) - 1) ^ ((1 << 20) - 1), 1 << 60
CHUNK = 4 << 20
#: What \s stands for in the pattern, in any language.
SPACE = r"\t-\r \x85\xA0  -     　"


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(of: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """All pairs of ids that merge, with their rank."""
    for token, rank in of.items():
        for cut in range(1, len(token)):
            a, b = of.get(token[:cut]), of.get(token[cut:])
            if a is not None and b is not None:
                yield a, b, rank


@functools.lru_cache(2)
def sure(path: str) -> dict[bytes, list[tuple[frozenset[int], frozenset[int]]]]:
    """Tokens whose merges are certain from the bytes beside them: for each token, the choices of bytes that must not come before it and after it.

    A pair is merged before anything else takes one of its parts if its rank is below that
    of all pairs of a part that ends in the byte before with its left part, and of all
    pairs of its right part with one that starts with the byte after. Nothing else changes
    if this is done ahead, provided that all pairs with the merged part rank behind it. Parts of
    such a pair are single bytes, or such tokens themselves.
    """
    of = ranks(path)
    pieces = {rank: token for token, rank in of.items()}
    least: dict[int, int] = {}  # of the pairs with an id
    before: dict[int, dict[int, int]] = defaultdict(dict)  # by the right part's id and the left part's last byte
    after: dict[int, dict[int, int]] = defaultdict(dict)
    for a, b, rank in merges(of):
        for held, key in ((least, a), (least, b), (before[b], pieces[a][-1]), (after[a], pieces[b][0])):
            held[key] = min(held.get(key, rank), rank)
    found = {bytes([x]): [(frozenset(), frozenset())] for x in range(256)}
    for token, rank in sorted(of.items(), key=lambda x: x[1]):
        if rank >= SURE_BELOW or not 2 <= len(token) <= SURE_BYTES or least.get(rank, rank + 1) <= rank:
            continue
        choices = set()
        for cut in range(1, len(token)):
            a, b = token[:cut], token[cut:]
            if a in found and b in found:
                no_left, no_right = (frozenset(x for x, r in held.items() if r <= rank) for held in (before[of[a]], after[of[b]]))
                choices |= {(p | no_left, n | no_right) for p, q in found[a] for o, n in found[b] if b[0] not in q and a[-1] not in o}
        if choices:
            found[token] = sorted((x for x in choices if not any(y != x and y[0] <= x[0] and y[1] <= x[1] for y in choices)), key=lambda x: (sorted(x[0]), sorted(x[1])))
    return found


def sure_pattern(tokens: dict[bytes, list[tuple[frozenset[int], frozenset[int]]]]) -> str:
    """A pattern whose matches are the parts a word's bytes, as characters, start with; the longest token first, byte by byte, so that few are tried."""
    code = lambda some: "".join(f"\\x{x:02x}" for x in some)

    def from_byte(some: list[bytes], k: int) -> str:
        """The tokens some, which are alike up to byte k, from there."""
        nexts = defaultdict(list)
        for x in some:
            nexts[x[k : k + 1]].append(x)
        whole = [(f"(?<![{code(sorted(left))}][\\x00-\\xff]{{{k}}})" if left else "") + (f"(?![{code(sorted(right))}])" if right else "") for x in nexts.pop(b"", []) for left, right in tokens[x]]
        return "(?:" + "|".join([*(code(x) + from_byte(more, k + 1) for x, more in sorted(nexts.items())), *whole]) + ")"

    return from_byte([x for x in tokens if len(x) > 1], 0) + r"|[\x00-\xff]"


def java_pattern(pattern: str) -> str:
    """pattern with the white space of Unicode where it says \\s or \\S."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def words(text: Column, pattern: str = PATTERN) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once; by an aggregate over nothing, as taking an element of an array asks for the type of all that is below at each call."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


class Codec:
    """The literal maps of a vocabulary, as one-row tables that queries read as scalars."""

    def __init__(self, spark: SparkSession, path: str = RANKS) -> None:
        of = ranks(path)
        keys, found = array("q"), array("q")
        for a, b, rank in merges(of):
            keys.append(a << ID_BITS | b)
            found.append(rank << RANK_AT)
        pairs = spark.createDataFrame(pa.table({"key": pa.array(keys, pa.int64()), "value": pa.array(found, pa.int64())}))
        pairs = in_buckets(pairs.withColumn("bucket", F.col("key") % PAIR_BUCKETS), PAIR_BUCKETS).toDF("pairs")
        self.sure = sure_pattern(sure(path))
        starts = spark.createDataFrame([(x.decode("ISO-8859-1"), of[x]) for x in sure(path)], "key string, value int")
        starts = in_buckets(starts.withColumn("bucket", bucket(F.col("key"), SURE_BUCKETS)), SURE_BUCKETS).toDF("starts")
        size = max(of.values()) + 1
        pieces = [b""] * size
        for token, rank in of.items():
            pieces[rank] = token
        by_id = spark.createDataFrame(pa.table({"id": pa.array(range(size), pa.int32()), "piece": pa.array(pieces, pa.binary())}))
        reversed_bytes = F.concat(*[F.lpad(F.hex(F.shiftright("id", 8 * k).bitwiseAND(F.lit(255)).cast("long")), 2, "0") for k in range(4)])
        listed = by_id.agg(F.sort_array(F.collect_list(F.struct("id", F.col("piece").cast("string").alias("piece"), F.unhex(reversed_bytes).cast("string").alias("code")))).alias("x"))  # strings of any bytes
        self.table = stored(listed.select(F.col("x.piece").alias("pieces"), F.col("x.code").alias("codes")).crossJoin(pairs).crossJoin(starts), "bpe-ranks")  # one row each
        self.known: DataFrame | None = None
        self.longest = 0  # bytes of the longest word of the texts that learn() has seen

    def scalar(self, name: str) -> Column:
        return self.table.select(name).scalar()

    def folded(self, word: Column, maps: Column) -> Column:
        """The ids of a word, by a fold over its parts; maps: pairs, starts.

        A part is a number of the rank with the next part, of its place and of its id, so the least number is the leftmost of the least rank. A merge changes that
        number and the one before it.
        """
        parts = F.regexp_extract_all(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), F.lit(self.sure), F.lit(0))
        start = F.transform(parts, lambda x: F.get(maps["starts"], bucket(x, SURE_BUCKETS).cast("int"))[x].cast("bigint"))
        id_of = lambda part: part.bitwiseAND(F.lit(ID_MASK))
        place_of = lambda part: part.bitwiseAND(F.lit(PLACE_MASK))

        def numbered(a: Column, b: Column, place: Column) -> Column:
            key = F.shiftleft(a, ID_BITS) + b
            return F.coalesce(F.get(maps["pairs"], (key % PAIR_BUCKETS).cast("int"))[key], F.lit(NO_RANK)) + place + a

        def step(parts: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                def at(p: Column) -> Column:  # of the least part, counted from 1
                    def put(before: Column) -> Column:
                        rank = F.shiftright(least, RANK_AT)
                        fresh = numbered(rank, id_of(F.get(parts, p + 1)), place_of(least))
                        left = numbered(id_of(before), rank, place_of(before))
                        return F.transform(F.array_remove(parts, F.get(parts, p)), lambda part: F.when(part == least, fresh).when(part == before, left).otherwise(part))

                    return let(F.coalesce(F.get(parts, p - 2), F.lit(-1)), put)

                return F.when(least >= F.lit(NO_RANK), parts).otherwise(let(F.array_position(parts, least).cast("int"), at))

            return let(F.array_min(parts), merge)

        def fold(parts: Column) -> Column:
            first = F.transform(parts, lambda part, i: numbered(part, F.get(parts, i + 1), F.shiftleft(i.cast("bigint"), ID_BITS)))
            return F.when(F.size(parts) < 2, F.transform(parts, lambda x: x.cast("int"))).otherwise(
                F.aggregate(F.sequence(F.lit(2), F.size(parts)), first, step, lambda held: F.transform(held, lambda x: id_of(x).cast("int")))
            )

        return let(start, fold)

    def learn(self, docs: DataFrame, *, with_ids: bool = True) -> None:
        """Folds the words ahead that docs holds most often. The commonest are kept with their codes and bytes, and all where ids aren't asked for, which leaves the room for that."""
        seen = Observation()
        every_word = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").count().observe(seen, F.max(F.octet_length("word")).alias("longest"))
        counts = every_word.filter((F.col("count") > 1) & (F.octet_length("word") <= KNOWN_BYTES))
        counts = stored(counts.withColumn("level", F.floor(F.log2("count") * 8).cast("int")), "bpe-words")
        self.longest = seen.get["longest"] or 0
        cuts, held = {OFTEN: 0, KNOWN: 0}, 0
        for row in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # at most 8 levels for each doubling of a count
            held += row.n
            for most in cuts:
                cuts[most] = cuts[most] or (row.level + 1 if held > most else 0)
        often = F.col("level") >= cuts[OFTEN]
        maps = counts.filter(F.col("level") >= cuts[KNOWN]).withColumns({x: self.scalar(x) for x in ("pairs", "starts")})
        found = stored(maps.select(often.alias("often"), F.col("word").alias("key"), let(F.struct("pairs", "starts"), lambda m: self.folded(F.col("word"), m)).alias("value")), "bpe-folded")  # read once, else Spark would make a column of it

        def completed(some: DataFrame) -> DataFrame:
            some = some.withColumns({"codes": self.scalar("codes"), "pieces": self.scalar("pieces")})
            return some.select("key", let(F.struct("codes", "pieces"), lambda m: whole(F.col("value"), m, with_ids)).alias("value"))

        others = found.filter("NOT often")
        tables = [in_buckets(x.select("key", "value", bucket(F.col("key"), n).alias("bucket")), n).toDF(f"known{k}") for k, (x, n) in enumerate(zip((completed(found.filter("often")), others if with_ids else completed(others)), WORD_BUCKETS, strict=True))]
        self.known = stored(tables[0].crossJoin(tables[1]), "bpe-known")  # one row each
        release(found)
        release(counts)


def bucket(word: Column, buckets: int) -> Column:
    """The word's bucket, of a power of two."""
    return F.xxhash64(word).bitwiseAND(F.lit(buckets - 1))


def in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """One row with an array of maps from key to value, one map for each bucket; rows: bucket, key, value, of a bounded number."""
    held = rows.groupBy("bucket").agg(F.collect_list(F.struct("key", "value")).alias("held"))
    every = rows.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(held, "bucket", "left").select("bucket", F.coalesce("held", F.array()).alias("held"))
    row = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "held"))).alias("x"))
    return row.select(F.transform("x", lambda x: F.map_from_entries(x["held"])).alias("maps"))


def whole(ids: Column, tables: Column, with_ids: bool) -> Column:
    """ids, if asked for, and what the tables of codes and pieces hold for each, in a row."""
    in_a_row = lambda table: F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    return F.struct(*[ids.alias("ids")] * with_ids, in_a_row(tables["codes"]).alias("codes"), in_a_row(tables["pieces"]).alias("pieces"))


def long_words(texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """(key, longs): place and ids of the words of over LONG bytes of each text (key, text); each such word is merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ranks(path)
        for batch in chunks(batches, "word", CHUNK):
            found = pa.array([_heaped(x.encode(), of) for x in batch.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), found], names=["name", "ids"])

    placed = texts.dropDuplicates(["key"]).select("key", F.posexplode(words(F.col("text"), pattern)).alias("place", "word")).filter(F.octet_length("word") > LONG)
    placed = stored(placed.withColumn("name", F.unhex(F.sha2(F.col("word").cast("binary"), 256))), "bpe-long")
    ids = placed.select("name", "word").dropDuplicates(["name"]).mapInArrow(run, "name binary, ids array<int>")
    return placed.drop("word").join(ids, "name").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("longs"))


def encoded(docs: DataFrame, codec: Codec, path: str = RANKS, pattern: str = PATTERN, *, with_ids: bool = True) -> DataFrame:
    """docs with ids, the tokens of text, if asked for here and in learn(); codes, the ids as little-endian numbers of 4 bytes; and decoded, the bytes of the ids in a row.

    All is made in one expression: the maps are read as scalars and never become columns of rows.
    """
    docs = docs.drop("ids", "codes", "decoded")
    ids_too = ["ids"] * with_ids
    text = F.coalesce(F.col("text"), F.lit(""))

    def finished(rows: DataFrame, spliced: Callable[[Column, Callable[[Column], Column]], Column] | None = None) -> DataFrame:
        names = ["pairs", "starts", "codes", "pieces"]
        known = [f"known{k}" for k in range(len(WORD_BUCKETS))]
        with_maps = rows.withColumns({f"__{x}": codec.scalar(x) for x in names} | {f"__{x}": codec.known.select(x).scalar() for x in known})
        maps = F.struct(*[F.col(f"__{x}").alias(x) for x in [*names, *known]])

        def made(m: Column) -> Column:
            made_of = lambda ids: let(ids, lambda x: whole(x, m, with_ids))

            def short(w: Column) -> Column:  # the commonest words, and without ids all known ones, have their codes and pieces
                often, seen = (F.get(m[x], bucket(w, n).cast("int"))[w] for x, n in zip(known, WORD_BUCKETS, strict=True))
                ids = F.when(F.octet_length(w) <= LONG, codec.folded(w, m)).otherwise(F.array().cast("array<int>"))
                return F.coalesce(often, made_of(F.coalesce(seen, ids))) if with_ids else F.coalesce(often, seen, made_of(ids))

            def joined(parts: Column) -> Column:
                return F.struct(*[F.flatten(parts[x]).alias(x) for x in ids_too], *[F.array_join(parts[x], "").alias(x) for x in ("codes", "pieces")])

            parts = F.transform(words(F.col("text"), pattern), short)
            return let(parts, joined if spliced is None else lambda x: let(spliced(x, made_of), joined))

        found = with_maps.select(*docs.columns, let(maps, made).alias("__made"))
        return found.select(*docs.columns, *[F.col(f"__made.{x}").alias(x) for x in ids_too], F.col("__made.codes").cast("binary").alias("codes"), F.col("__made.pieces").cast("binary").alias("decoded"))

    if codec.longest <= LONG:
        return finished(docs)

    def spliced(parts: Column, made_of: Callable[[Column], Column]) -> Column:
        """All words as they are made, the long ones from __longs."""
        longs = F.col("__longs")
        after = lambda k: F.coalesce(F.get(longs, k - 1)["place"] + 1, F.lit(0))
        heads = F.transform(longs, lambda x, k: F.concat(F.slice(parts, after(k) + 1, x["place"] - after(k)), F.array(made_of(x["ids"]))))
        return F.when(longs.isNull(), parts).otherwise(F.concat(F.flatten(heads), F.slice(parts, after(F.size(longs)) + 1, F.size(parts))))

    long = text.rlike(rf"[^{SPACE}]{{{LONG // 4}}}|[{SPACE}]{{{LONG // 4}}}")  # may have a word of over LONG bytes
    keyed = docs.filter(long).withColumn("__key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    longs = stored(long_words(keyed.select(F.col("__key").alias("key"), "text"), path, pattern), "bpe-spliced").toDF("__key", "__longs")
    return finished(docs.filter(~long)).unionByName(finished(keyed.join(longs, "__key", "left"), spliced))


def _heaped(word: bytes, of: dict[bytes, int]) -> list[int]:
    """The ids of a long word, with a heap of its pairs."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each byte
    heap: list[tuple[int, int, int]] = []

    def push(a: int) -> None:
        b = ends[a]
        if b < n and (rank := of.get(word[a : ends[b]])) is not None:
            heapq.heappush(heap, (rank, a, ends[b]))

    for a in range(n - 1):
        push(a)
    gone = bytearray(n)
    while heap:
        _, a, end = heapq.heappop(heap)
        b = ends[a]
        if gone[a] or b >= n or ends[b] != end:
            continue
        gone[b], ends[a] = 1, end
        if end < n:
            before[end] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    out, a = [], 0
    while a < n:
        out.append(of[word[a : ends[a]]])
        a = ends[a]
    return out


def round_trip(docs: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """docs with ids, if asked for, n_tokens, ids_sha256 and decoded, the bytes of the ids."""
    codec = Codec(docs.sparkSession)
    codec.learn(docs, with_ids=with_ids)
    found = encoded(docs.drop("n_tokens", "ids_sha256"), codec, with_ids=with_ids)
    return found.withColumns({"n_tokens": F.shiftright(F.octet_length("codes"), 2).cast("long"), "ids_sha256": F.sha2("codes", 256)}).drop("codes")


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of every document."""
    found = round_trip(documents(spark, sf_dir).select("doc_id", "text"), with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
