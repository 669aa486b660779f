"""Which distances of all pairs of vectors are at wanted places, exactly, without a row for a pair.

Equal vectors are one row with a number. Rows are packed into blocks, and each two stored
blocks meet once in a Cartesian product, so that vectors are shuffled once, to find equal
ones, and then nothing but counts. For two blocks, a product of matrices in single precision
bounds all squared distances; only a pair whose bounds touch a wanted range is worked out by
direct differences, in double precision. A count is always of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlens.operators.links import cut

#: A block has this many rows and bytes at most, and one row at least.
BLOCK_ROWS, BLOCK_BYTES = 4096, 2 << 20
#: Rows of a block that are multiplied at once; fewer than 256, as a column's count of them is a byte.
STRIP = 128
#: Pairs that are worked out by direct differences at once.
CHUNK = 2048
#: Bytes of vectors that a task holds of one side, and tasks a core at least where there are blocks for that.
PART_BYTES, TASKS = 64 << 20, 9
#: Parts of a range that a round counts, as powers of two: at least and at most.
DIGITS = 12, 16
#: A range that holds no more pairs is counted by the very distances.
LISTED = 100_000
#: Pairs drawn to guess the first ranges, at most, and the pairs of blocks that they are drawn from, about.
GUESSED, GUESSED_BLOCKS = 1 << 24, 1024
#: Bits of a drawn pair's distance that a guess does without.
COARSE = 38
#: Distances aren't negative, so their bits as whole numbers have the same order; what isn't a number comes last, as in SQL.
INFINITE, NAN = (int(np.array(x).view(np.int64)) for x in (np.inf, np.nan))
TOP = NAN + 1


BLOCKS = "dims int, total long, n binary, data binary"


def present(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """(vec_id, v) of rows with vec_id and embedding, and whether v is in single precision."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    v = F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("v")
    return vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", v), single


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows."""
    sizes, values = lists.value_lengths().to_numpy(), lists.flatten()
    if values.null_count:
        raise ValueError("an embedding has a null component")
    if (sizes != sizes[0]).any():
        raise ValueError("embeddings have different lengths")
    return values.to_numpy().reshape(len(sizes), sizes[0])


def block(n: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row of BLOCKS, ordered by n."""
    order = np.argsort(n, kind="stable")
    data = [[rows.shape[1]], [int(n.sum())], [n[order].astype(np.int64).tobytes()], [np.ascontiguousarray(rows[order]).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["dims", "total", "n", "data"])


def stored(blocks: DataFrame, single: bool) -> DataFrame:
    return cut(blocks.select(F.monotonically_increasing_id().alias("block"), "dims", "total", "n", "data", F.lit(single).alias("single")))


def packed(vectors: DataFrame) -> DataFrame:
    """(block, dims, total, n, data): different vectors and how often each is found, as bytes, ordered by that number; rows without vec_id or embedding take no part."""
    there, single = present(vectors)
    rows, numbers = there.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    size = numbers * (4 if single else 8)
    blocks = max(1, -(-rows // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    parts = min(blocks, max(math.ceil((TASKS * vectors.sparkSession.sparkContext.defaultParallelism) ** 0.5), -(-size // PART_BYTES)))  # the product has the square of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("n").to_numpy(), matrix(batch.column("v"))))
            if held[-1][1].shape[1] != held[0][1].shape[1]:
                raise ValueError("embeddings have different lengths")
            most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, held[0][1][0].nbytes)))
            if sum(len(x) for x, _ in held) >= most:
                ns, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = len(ns) // most * most
                for at in range(0, whole, most):
                    yield block(ns[at : at + most], rows[at : at + most])
                held = [(ns[whole:], rows[whole:])] if whole < len(ns) else []
        if held:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return stored(there.groupBy("v").agg(F.count(F.lit(1)).alias("n")).coalesce(parts).mapInArrow(run, BLOCKS), single)


def twins(vectors: DataFrame) -> DataFrame | None:
    """A block as in packed() of the vectors of each vec_id that has several, which are no pairs; none if there is no such vec_id."""
    there, single = present(vectors)
    again = there.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = matrix(batch.column("v")[row].values)
                yield block(np.ones(len(rows), np.int64), rows)

    lists = there.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.collect_list("v").alias("v")).select("v")
    return stored(lists.mapInArrow(run, BLOCKS), single)


def over_blocks(held: DataFrame, work: Callable, schema: str, kept: Column | None = None, less: DataFrame | None = None) -> DataFrame:
    """work(vectors and numbers of a, of b, whether they are one, a seed), a table with a number n, for each two blocks and each block with itself, added up.

    kept narrows by the hash of a pair of blocks; less has blocks whose own pairs are taken off.
    """
    x, y, once = F.col("block"), F.col("block_b"), F.col("block") == F.col("block_b")
    mixed = F.xxhash64(F.least(x, y), F.greatest(x, y))
    met = once | ((x < y) == (F.pmod(mixed, F.lit(2)) == 0))  # by a coin, so that tasks have like shares of the pairs
    pairs = held.hint("shuffle_replicate_nl").join(held.toDF(*[f"{c}_b" for c in held.columns]), met if kept is None else met & (F.pmod(F.shiftright(mixed, 1), kept) == 0))  # a Cartesian product: nothing is shuffled

    def added(tables: list[pa.Table]) -> pa.Table:
        by = [c for c in tables[0].column_names if c != "n"]
        return pa.concat_tables(tables).group_by(by, use_threads=False).aggregate([("n", "sum")]).rename_columns([*by, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row] for c in batch.schema.names}
                sides = []
                for side in ("", "_b"):
                    n = np.frombuffer(x[f"n{side}"].as_buffer(), np.int64)
                    v = np.frombuffer(x[f"data{side}"].as_buffer(), np.float32 if x["single"].as_py() else np.float64)
                    sides += [v.reshape(len(n), x[f"dims{side}"].as_py()).astype(np.float64), n]
                found.append(work(*sides, x["block"] == x["block_b"], abs(x["mixed"].as_py())))
                if sum(map(len, found)) > 1 << 20:
                    found = [added(found)]
        if found:
            yield from added(found).to_batches()

    found = pairs.withColumn("mixed", mixed).mapInArrow(run, schema)
    if less is not None:
        own = less.select("*", *[F.col(c).alias(f"{c}_b") for c in less.columns]).withColumn("mixed", mixed)
        found = found.unionByName(own.mapInArrow(run, schema).withColumn("n", -F.col("n")))
    return found.groupBy(*[x.split()[0] for x in schema.split(", ")][:-1]).agg(F.sum("n").alias("n"))


def keys(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The bits of the Euclidean distances of rows i of a and rows j of b, by direct differences, so that equal vectors are at 0 exactly."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for at in range(0, len(i), CHUNK):
            d = a[i[at : at + CHUNK]] - b[j[at : at + CHUNK]]
            out[at : at + CHUNK] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return np.where(np.isnan(out), NAN, out.view(np.int64))


def factors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Two matrices whose product is all squared distances times the square of the third; the fourth is twice or more what it is off by.

    Vectors are moved so that their middle is 0 and scaled by a power of two so that the
    longest is about 1. The error is that of a sum of k + 2 products in any order and of
    rounding what is multiplied. Rows that aren't finite, or too long, give no number.
    """
    with np.errstate(all="ignore"):
        odd = [~(np.einsum("ij,ij->i", x, x) <= 1e300) for x in (a, b)]
        plain = b[~odd[1]]
        middle = plain.mean(0) if len(plain) else np.zeros(b.shape[1])
        moved = [np.where(o[:, None], 0.0, x - middle) for x, o in zip((a, b), odd, strict=True)]
    longest = max(float(np.einsum("ij,ij->i", x, x).max()) for x in moved)
    scale = 2.0 ** -np.frexp(np.sqrt(longest))[1] if longest > 1e-280 else 1.0
    moved = [x * scale for x in moved]
    squares = [np.einsum("ij,ij->i", x, x) for x in moved]
    off = (a.shape[1] + 8) * 2.0**-22 * float(squares[0].max() + squares[1].max()) if longest > 1e-280 else np.inf
    for x, o in zip(squares, odd, strict=True):
        x[o] = np.nan
    ones = [np.ones(len(x)) for x in moved]
    left = np.column_stack([-2 * moved[0], squares[0], ones[0]]).astype(np.float32)
    right = np.column_stack([moved[1], ones[1], squares[1]]).astype(np.float32)
    return left, np.ascontiguousarray(right.T), scale, off


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different digits and their numbers."""
    digits, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(digits, kind="stable")
    digits, n = digits[order], n[order]
    first = np.flatnonzero(np.diff(digits, prepend=-1))
    return digits[first], np.add.reduceat(n, first) if len(n) else n


def counted(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, same: bool, ranges: list[tuple[int, int, int]]) -> pa.Table:
    """(head, digit, n): for each range (from, to, shift) of bits of distances how many pairs are below it, with digit -1, and in each part of it of 2^shift."""
    left, right, scale, off = factors(a, b)
    with np.errstate(all="ignore"):
        ends = [(np.array([min(x, INFINITE) for x in (lo, hi - 1)]).view(np.float64) * scale) ** 2 for lo, hi, _ in ranges]
        ends = [(np.float32(x - off), np.float32(y + off)) for x, y in ends]
    below, inside = [0] * len(ranges), [[(np.empty(0, np.int64), np.empty(0, np.int64))] for _ in ranges]

    def take(at: int, k: np.ndarray, n: np.ndarray) -> None:
        lo, hi, shift = ranges[at]
        below[at] += int(n[k < lo].sum())
        here = (k >= lo) & (k < hi)
        inside[at].append(((k[here] - lo) >> shift, n[here]))
        if sum(len(x) for x, _ in inside[at]) > 1 << 20:
            inside[at] = [summed(inside[at])]

    alike = np.flatnonzero(np.diff(na, prepend=na[0] - 1)).tolist()  # where rows of another number begin
    out, low, high = (np.empty((STRIP, len(b)), kind) for kind in (np.float32, bool, bool))
    opened = np.zeros(-(-STRIP * len(b) // 8) * 8, bool)
    for begin, end in zip(alike, [*alike[1:], len(a)], strict=True):
        for first in range(begin, end, STRIP):
            rows, number = min(STRIP, end - first), int(na[begin])
            about, under, over, size = np.dot(left[first : first + rows], right, out=out[:rows]), low[:rows], high[:rows], rows * len(b)
            either = opened[:size].reshape(rows, -1)
            either[:], opened[size:] = False, False
            for at, (least, most) in enumerate(ends):
                np.less(about, least, out=under)
                below[at] += number * int(np.add.reduce(under.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64) @ nb)
                np.equal(under, np.greater(about, most, out=over), out=over)  # neither, as for what is no number
                np.logical_or(either, over, out=either)
            words = np.flatnonzero(opened.view(np.uint64))  # eight pairs each, nearly all of which are settled
            word, byte = np.nonzero(opened.reshape(-1, 8)[words])
            open_ = words[word] * 8 + byte
            i, j = np.divmod(open_, len(b))
            k, n, about = keys(a, b, i + first, j), number * nb[j], about.ravel()[open_]
            for at, (least, most) in enumerate(ends):
                here = (about < least) == (about > most)
                take(at, k[here], n[here])
    head, digit, n = [], [], []
    own = keys(a, a, *[np.arange(len(a))] * 2) if same else None
    for at in range(len(ranges)):
        if same:  # each pair came twice, and n equal vectors n * n times in place of n * (n - 1) / 2
            take(at, own, -na)
        d, m = summed(inside[at])
        d, m = np.append(d, -1), np.append(m, below[at]) // (2 if same else 1)
        head.append(np.full(np.count_nonzero(m), at))
        digit.append(d[m != 0])
        n.append(m[m != 0])
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in (head, digit, n)], names=["head", "digit", "n"])


def drawn(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, same: bool, seed: int, draws: int) -> pa.Table:
    """(digit, n) of pairs drawn at random, n so that the sum stands for all pairs of the blocks."""
    rng = np.random.default_rng(seed)
    i, j = (rng.integers(0, len(n), draws) if n[0] == n[-1] else np.searchsorted(np.cumsum(n), rng.integers(0, n.sum(), draws), side="right") for n in (na, nb))
    digits, n = np.unique(keys(a, b, i, j) >> COARSE, return_counts=True)
    return pa.table({"digit": digits, "n": n * (float(na.sum()) * float(nb.sum()) / draws * (0.5 if same else 1.0))})


def guessed(held: DataFrame, blocks: int, n: int, shares: list[float]) -> dict[float, tuple[int, int, int]]:
    """A range for each share that its quantile is likely in, and how many pairs are there, about, from pairs drawn at random; a wrong guess costs rounds and changes no result."""
    of_blocks = blocks * (blocks + 1) // 2
    every = -(-of_blocks // GUESSED_BLOCKS)
    draws = max(64, min(GUESSED, n >> 8) * every // of_blocks)
    counts = over_blocks(held, lambda a, na, b, nb, same, seed: drawn(a, na, b, nb, same, seed, draws), "digit long, n double", F.lit(every) if every > 1 else None)
    upto, whole = F.sum("n").over(Window.orderBy("digit")), F.sum("n").over(Window.partitionBy())  # as many rows as parts of the drawn distances' range
    m = draws * of_blocks / every
    around = {s: 5 * (s * (1 - s) / m) ** 0.5 + 10 / m for s in shares}
    asked = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(side).alias("side"), F.lit(s + x * (2 * side - 1)).alias("place")) for s, x in around.items() for side in (0, 1)])
    found = counts.withColumns({"upto": upto / whole, "part": F.col("n") / whole}).withColumn("x", F.explode(F.filter(asked, lambda x: (x["place"] > F.col("upto") - F.col("part")) & (x["place"] <= F.col("upto")))))
    out = {s: [0, TOP] for s in shares}
    for r in found.select("digit", "x.share", "x.side").collect():
        out[r.share][r.side] = min(TOP, (r.digit + r.side) << COARSE)
    return {s: (lo, hi, max(LISTED + 1, int(2 * around[s] * n))) if lo < hi else (0, TOP, n) for s, (lo, hi) in out.items()}


def shift(width: int, n: int) -> int:
    """The bits of a part of a range of that width with n pairs: none if these can be listed, and else so many that a part's pairs likely can."""
    parts = min(max((n // LISTED).bit_length() + 6, DIGITS[0]), DIGITS[1])
    return 0 if n <= LISTED else max(0, (width - 1).bit_length() - parts)


def at_places(vectors: DataFrame, places_of: Callable[[int], dict[int, float]]) -> tuple[int, dict[int, float]]:
    """The number of pairs, and the distances at the places (from 0) that places_of(it) names, with the share that each is near to."""
    held = packed(vectors)
    sums = held.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("blocks"), F.min("dims").alias("least"), F.max("dims").alias("most")).first()
    if sums.least != sums.most:
        raise ValueError("embeddings have different lengths")
    less = twins(vectors)
    n = sums.rows * (sums.rows - 1) // 2 - (less.agg(F.sum(F.expr("total * (total - 1) div 2"))).first()[0] if less is not None else 0)
    wanted = places_of(n) if n else {}
    if n > LISTED:
        near = guessed(held, sums.blocks, n, sorted(set(wanted.values())))
        where = {p: near[s] for p, s in wanted.items()}
    else:
        where = {p: (0, TOP, n) for p in wanted}
    while any(hi - lo > 1 for lo, hi, _ in where.values()):
        open_ = {p: (lo, hi, shift(hi - lo, most)) for p, (lo, hi, most) in where.items() if hi - lo > 1}
        ranges = sorted(set(open_.values()))
        counts = over_blocks(held, lambda a, na, b, nb, same, _, r=ranges: counted(a, na, b, nb, same, r), "head long, digit long, n long", less=less)
        upto = F.sum("n").over(Window.partitionBy("head").orderBy("digit"))  # 2^16 or LISTED rows a head, about
        asked = F.array(*[F.struct(F.lit(ranges.index(x)).alias("head"), F.lit(p).alias("place")) for p, x in open_.items()])
        found = counts.withColumn("upto", upto).withColumn("x", F.explode(F.filter(asked, lambda x: (x["head"] == F.col("head")) & (x["place"] < F.col("upto")) & (x["place"] >= F.col("upto") - F.col("n")))))
        rows = {r.place: r for r in found.select("digit", "n", "x.place").collect()}
        for p, (lo, hi, bits) in open_.items():
            if p not in rows:  # above: a wrong guess, so the range beside it is next
                where[p] = (hi, min(TOP, hi + 16 * (hi - lo)), n)
            elif rows[p].digit < 0:
                where[p] = (max(0, lo - 16 * (hi - lo)), lo, n)
            else:
                begin = lo + (rows[p].digit << bits)
                where[p] = (begin, min(hi, begin + (1 << bits)), rows[p].n)
    return n, {p: float(np.array(lo).view(np.float64)) for p, (lo, _, _) in where.items()}
