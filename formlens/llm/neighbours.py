"""Nearest neighbours by hierarchical navigable small-world graphs, one a shard.

Equal vectors are one class, of which the smallest ids that an answer can name are kept; the
classes are dealt into shards of a bounded size by a hash. A task builds the graph of one
shard: each vector draws a level, is inserted after all of higher levels, and is linked with
close vectors that lie in different directions. Vectors are inserted in batches that search
the graph in step, so numpy works on whole arrays. A graph is stored as one row: vectors,
ids and the flat array of neighbours of all levels. A search sends blocks of queries to each
shard, scores what the graph finds in double precision and merges the shards' best rows.

All shards answer each query, so the work is queries times shards; a shard's answer is as
many rows as the query asks for, of which Spark keeps the best before it shuffles.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without vec_id; of several rows with one vec_id that with the least
vector counts; vectors of different length are never compared; a query isn't its own
neighbour, but an equal vector of another id is, at distance 0; ties go to the smaller id;
fewer candidates give fewer rows; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlens.llm.common import stored

NEAREST = 10
#: Rows whose vec_id this divides are the queries of the query.
QUERY_EVERY = 100
#: Bytes of a shard's vectors, in double precision.
SHARD_BYTES = 4 << 20
#: Queries of a task.
QUERIES = 8192
#: Links of a vector when it is inserted, and twice as many at most on the lowest level.
LINKS = 16
#: Candidates that are held while inserting, and while searching.
EF_BUILD, EF_SEARCH = 64, 128
#: Candidates whose neighbours are looked at in one step.
WIDTH = 4
BATCH = 256
INDEX = "dim int, shard int, ids array<array<bigint>>, vectors binary, sizes array<int>, links binary"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a - b
    return np.einsum("...j,...j->...", diff, diff)


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, ids: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray]:
    """The held nearest vectors to each query that a walk from ids (a row a query) finds, and their squared distances; -1 and infinite where fewer."""
    b, n = len(queries), len(vectors)
    out_i, out_d = np.full((b, held), -1, np.int32), np.full((b, held), np.inf, np.float32)
    rows = np.arange(b)
    seen = np.zeros((b, n), bool)
    i = np.full((b, held), -1, np.int32)
    i[:, : ids.shape[1]] = ids[:, :held]
    d = np.where(i >= 0, squared(vectors[i], queries[:, None, :]), np.float32(np.inf)).astype(np.float32)
    r, c = np.nonzero(i >= 0)
    seen[r, i[r, c]] = True
    fresh = i >= 0
    width = min(WIDTH, held)
    while True:
        open_d = np.where(fresh, d, np.float32(np.inf))
        active = np.isfinite(open_d).any(axis=1)
        if not active.all():
            out_i[rows[~active]], out_d[rows[~active]] = i[~active], d[~active]
            rows, i, d, fresh, seen, queries, open_d = rows[active], i[active], d[active], fresh[active], seen[active], queries[active], open_d[active]
            if not len(rows):
                break
        pick = np.argpartition(open_d, width - 1, axis=1)[:, :width]
        usable = np.isfinite(np.take_along_axis(open_d, pick, 1))
        np.put_along_axis(fresh, pick, False, 1)
        next_to = links[np.take_along_axis(i, pick, 1)]
        next_to[~usable] = -1
        next_to = next_to.reshape(len(rows), -1)
        flat = (np.arange(len(rows))[:, None] * n + next_to)[next_to >= 0]
        flat = np.unique(flat[~seen.reshape(-1)[flat]])
        seen.reshape(-1)[flat] = True
        r, v = flat // n, flat % n
        counts = np.bincount(r, minlength=len(rows))
        col = np.arange(len(flat)) - (np.cumsum(counts) - counts)[r]
        more_d = np.full((len(rows), counts.max(initial=0)), np.inf, np.float32)
        more_i = np.full(more_d.shape, -1, np.int32)
        more_d[r, col], more_i[r, col] = squared(vectors[v], queries[r]), v
        all_d, all_i = np.concatenate([d, more_d], 1), np.concatenate([i, more_i], 1)
        all_f = np.concatenate([fresh, more_i >= 0], 1)
        best = np.argpartition(all_d, held - 1, axis=1)[:, :held]
        d, i, fresh = (np.take_along_axis(x, best, 1) for x in (all_d, all_i, all_f))
    order = np.argsort(out_d, axis=1, kind="stable")
    return np.take_along_axis(out_i, order, 1), np.take_along_axis(out_d, order, 1)


def spread_out(vectors: np.ndarray, ids: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, by distance, up to most: first those nearer to the row's vector than to any chosen before, then the nearest of the rest; -1 where fewer."""
    order = np.argsort(d, axis=1, kind="stable")
    ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
    b, c = ids.shape
    own = vectors[ids]
    norms = np.einsum("bcj,bcj->bc", own, own)
    apart = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
    chosen, near, count = np.zeros((b, c), bool), np.full((b, c), np.inf, np.float32), np.zeros(b, np.int64)
    for k in range(c):
        ok = np.isfinite(d[:, k]) & (d[:, k] < near[:, k]) & (count < most)
        chosen[:, k] = ok
        count += ok
        near[ok] = np.minimum(near[ok], apart[ok, k])
    rank = np.arange(c) + c * ~chosen + 2 * c * ~np.isfinite(d)
    picked = np.argsort(rank, axis=1)[:, :most]
    return np.where(np.take_along_axis(np.isfinite(d), picked, 1), np.take_along_axis(ids, picked, 1), -1)


def linked_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Adds to links of each chosen vector the new ones that chose it; rows that are full choose anew."""
    p, s = np.repeat(new, chosen.shape[1])[chosen.ravel() >= 0], chosen.ravel()[chosen.ravel() >= 0]
    order = np.argsort(s, kind="stable")
    p, s = p[order], s[order]
    of, counts = np.unique(s, return_counts=True)
    at = np.repeat(np.arange(len(of)), counts)
    col = np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)
    for a in range(0, len(of), 512):
        some = slice(a, a + 512)
        mine = (at >= a) & (at < a + 512)
        more = np.full((len(of[some]), counts[some].max()), -1, np.int32)
        more[at[mine] - a, col[mine]] = p[mine]
        both = np.concatenate([links[of[some]], more], 1)
        full = (both >= 0).sum(axis=1) > links.shape[1]
        order = np.argsort(both < 0, axis=1, kind="stable")[:, : links.shape[1]]
        rows = np.take_along_axis(both, order, 1)
        if full.any():
            d = np.where(both[full] >= 0, squared(vectors[both[full]], vectors[of[some][full]][:, None, :]), np.float32(np.inf))
            rows[full] = spread_out(vectors, both[full], d, links.shape[1])
        links[of[some]] = rows


def graph(vectors: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The neighbours of each vector on each level, -1 behind the last; the first sizes[l] vectors are on level l."""
    links = [np.full((n, LINKS * (2 if level == 0 else 1)), -1, np.int32) for level, n in enumerate(sizes)]
    i, n = 0, len(vectors)
    while i < n:
        level = max(x for x in range(len(sizes)) if i < sizes[x])
        j = min(sizes[level], i + max(1, min(BATCH, i)))
        batch, new = vectors[i:j], np.arange(i, j, dtype=np.int32)
        ids = np.zeros((j - i, 1), np.int32)
        among = squared(batch[:, None, :], batch[None, :, :]) if j - i > 1 else np.full((1, 1), np.inf, np.float32)
        np.fill_diagonal(among, np.inf)
        mates = np.argsort(among, axis=1)[:, :LINKS]
        for x in range(len(sizes) - 1, -1, -1):
            there = min(i, sizes[x])
            if not there:
                continue
            ids, d = beam(vectors[:there], links[x], batch, ids, 1 if x > level else EF_BUILD)
            if x <= level:
                with_mates = np.concatenate([ids, new[mates]], 1), np.concatenate([d, np.take_along_axis(among, mates, 1)], 1)
                chosen = spread_out(vectors, *with_mates, LINKS)
                links[x][i:j, :LINKS] = chosen
                linked_back(vectors, links[x], new, chosen)
        i = j
    return links


def levels(ids: np.ndarray) -> np.ndarray:
    """The level that each vector draws by its id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.floor(-np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / np.log(LINKS)).astype(np.int64)


def scaled(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """rows in single precision, in units of the largest component of vectors, so that squares of large numbers stay finite."""
    return np.clip(rows / np.abs(vectors).max(), -1e15, 1e15).astype(np.float32)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def built(key: tuple, table: pa.Table) -> pa.Table:
    """One shard's row of the index."""
    dim, shard = (x.as_py() for x in key)
    vectors, ids = matrix(table["embedding"], dim), table["ids"].combine_chunks()
    first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]]
    drawn = levels(first)
    order = np.lexsort((first, -drawn))
    vectors, drawn = np.ascontiguousarray(vectors[order]), drawn[order]
    sizes = [int((drawn >= x).sum()) for x in range(int(drawn[0]) + 1)]
    flat = np.concatenate([x.ravel() for x in graph(scaled(vectors, vectors), sizes)])
    row = [[dim], [shard], [ids.take(pa.array(order)).to_pylist()], [vectors.tobytes()], [sizes], [flat.tobytes()]]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.list_(pa.int32()), pa.binary()]
    return pa.table([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["dim", "shard", "ids", "vectors", "sizes", "links"])


def answered(key: tuple, left: pa.Table, right: pa.Table, k: int, kind: type, held: int) -> pa.Table:
    """The k nearest of one shard to each of one block of queries."""
    out: list[list] = [[], [], []]
    if left.num_rows and right.num_rows:
        dim = key[0].as_py()
        vectors = np.frombuffer(left["vectors"][0].as_buffer(), kind).reshape(-1, dim)
        sizes, flat, links, a = left["sizes"][0].as_py(), np.frombuffer(left["links"][0].as_buffer(), np.int32), [], 0
        for x, n in enumerate(sizes):
            width = LINKS * (2 if x == 0 else 1)
            links.append(flat[a : a + n * width].reshape(n, width))
            a += n * width
        ids = left["ids"].combine_chunks().values
        starts, names = ids.offsets.to_numpy(), ids.values.to_numpy()
        queries, query_ids = matrix(right["embedding"], dim), right["vec_id"].to_numpy()
        near, held = scaled(vectors, vectors), max(held, 2 * k)
        for a in range(0, len(queries), BATCH):
            some, asked = queries[a : a + BATCH], query_ids[a : a + BATCH]
            if len(near) <= held:
                found = np.tile(np.arange(len(near), dtype=np.int32), (len(some), 1))
            else:
                found = np.zeros((len(some), 1), np.int32)
                for x in range(len(sizes) - 1, -1, -1):
                    found, _ = beam(near[: sizes[x]], links[x], scaled(some, vectors), found, held if x == 0 else 1)
            r, c = np.nonzero(found >= 0)
            v = found[r, c]
            score = np.zeros(len(v))
            for j in range(dim):  # in the order of components, as a plain sum goes
                score += (vectors[v, j].astype(np.float64) - some[r, j].astype(np.float64)) ** 2
            score = np.sqrt(score)
            many = starts[v + 1] - starts[v]
            each = np.repeat(starts[v] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            r, score, named = np.repeat(r, many), np.repeat(score, many), names[each]
            other = named != asked[r]
            r, score, named = r[other], score[other], named[other]
            order = np.lexsort((named, score, r))
            r, score, named = r[order], score[order], named[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            for x, column in zip(out, (asked[r[best]], named[best], score[best]), strict=True):
                x.append(column)
    kinds = [np.int64, np.int64, np.float64]
    return pa.table([pa.array(np.concatenate([np.empty(0, t), *x])) for x, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score"])


def vectors_of(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part, one a vec_id."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    embedding = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    found = rows.select("vec_id", embedding.alias("embedding")).filter("vec_id IS NOT NULL AND size(embedding) > 0").filter(~odd).filter(~zero)
    return found.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(dim, embedding, ids): the different vectors, each with its k + 1 smallest ids, as more can't be among k neighbours."""
    place = F.row_number().over(Window.partitionBy("dim", "embedding").orderBy("vec_id"))
    return vectors.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("dim", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def index_of(vectors: DataFrame, k: int = NEAREST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row a shard: dim, shard, ids, vectors, sizes of the levels and the flat array of neighbours of all levels. Stored; it answers up to k neighbours."""
    classes = stored(classes_of(vectors, k), "neighbour-classes")
    shards = classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / F.lit(shard_bytes)).cast("int").alias("shards"))  # a row a length of vectors
    dealt = classes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int")).drop("shards")
    each = max(1, shards.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0])  # a task a shard, as building takes time and few bytes
    return stored(dealt.repartition(each, "dim", "shard").groupBy("dim", "shard").applyInArrow(built, INDEX), "neighbour-index")


def searched(index: DataFrame, queries: DataFrame, k: int = NEAREST, held: int = EF_SEARCH, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of index to each of queries (vec_id, embedding, dim; stored)."""
    kind = np.float32 if queries.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    parts = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))  # a row a length of vectors
    asked = queries.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    places = index.select(F.col("dim").alias("of_dim"), F.col("shard").alias("of_shard"))
    asked = asked.join(places, F.col("dim") == F.col("of_dim")).select(F.col("of_dim").alias("to_dim"), F.col("of_shard").alias("to_shard"), F.col("part").alias("to_part"), "vec_id", "embedding")
    held_by = index.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = held_by.groupBy("dim", "shard", "part").cogroup(asked.groupBy("to_dim", "to_shard", "to_part")).applyInArrow(lambda key, left, right: answered(key, left, right, k, kind, held), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors to every QUERY_EVERYth row of embeddings, found among all others."""
    vectors = stored(vectors_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "neighbour-vectors")
    queries = vectors.filter(F.col("vec_id") % QUERY_EVERY == 0)
    return searched(index_of(vectors), queries)
