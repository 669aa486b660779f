"""Token counts at every prefix of a text, by prefix dynamic programming over BPE pieces.

The encoding of a prefix ends in the one piece that follows rightly on the encoding of
what is before it, so the count at a prefix is the count before that piece plus one.
Texts fall into units that no piece crosses; the distinct units of a slice are worked on
in step, position by position. What is stored of a text is by how much each character
changes the count (prefix_steps); running sums of it answer how many tokens any prefix
has and which prefix fits a budget, without encoding again.

Defined cases: null and empty text have no tokens; a character that no piece has counts
as its UTF-8 bytes; strings of special tokens are plain text; repeated rows stay; an
empty table gives no rows; columns named as the added ones are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formlens.llm.arrow import chunks, flat_bytes, with_columns
from formlens.llm.common import documents, stored

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
CHUNK = 4 << 20
SPACE = "▁"
#: Units worked on in step: at most so many, of so many characters in all once the shorter are padded; fewer than FEW units of over LONG characters are quicker one by one.
TOGETHER = 20_000
CELLS = 2 << 20
FEW = 128
LONG = 48
#: Verdicts on pairs of pieces that a worker keeps; they are worked out anew beyond it.
KEPT_PAIRS = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
START = -1


class Pieces:
    """The pieces of a model, their ranks, and which may stand side by side."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = [sp.id_to_piece(i) for i in ids]
        scores = np.array([sp.get_score(i) for i in ids])
        self.rank = dict(zip(self.text, np.argsort(np.argsort(-scores, kind="stable"), kind="stable").tolist(), strict=True))
        self.longest = max(map(len, self.text))
        if any(SPACE in x.lstrip(SPACE) or "\n" in x or "\0" in x for x in self.text):
            raise ValueError("a piece crosses the units' borders")
        self.chars = {x for x in self.text if len(x) == 1}
        self.alone = np.array([len(self.merged(x)) == 1 for x in self.text])
        self.number = {x: k for k, x in enumerate(self.text)}
        self.powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        hashes = np.array([self.hashed(x) for x in self.text], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces hash alike")
        self.near = np.zeros(1 << 20, bool)
        self.near[self.hashes >> np.uint64(44)] = True
        self.pairs: dict[int, bool] = {}

    def hashed(self, text: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = h * BASE + np.uint64(ord(c) + 1)
        return h[0]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-ranked neighbours, the leftmost first."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: int, piece: int) -> bool:
        """Whether both stay whole side by side."""
        if before == START:
            return bool(self.alone[piece])
        key = before << 20 | piece
        if key not in self.pairs:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            a, b = self.text[before], self.text[piece]
            self.pairs[key] = self.merged(a + b) == [a, b]
        return self.pairs[key]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.near[hashes >> np.uint64(44)])
        wanted = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == wanted, self.order[at], -1)
        return out

    def counts(self, units: list[str]) -> np.ndarray:
        """For each unit, the count at every prefix; prefixes past its end repeat the last. Without units, one row of no counts."""
        if not units:
            return np.zeros((1, 0), np.int32)
        width = max(map(len, units), default=0)
        codes = np.array(units, dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(units), -1)
        sizes = np.array([len(x) for x in units])
        n = len(units)
        prefix = np.zeros((width + 1, n), np.uint64)
        for i in range(width):
            prefix[i + 1] = prefix[i] * BASE + (codes[:, i].astype(np.uint64) + np.uint64(1))
        last = np.full((width + 1, n), START, np.int64)
        count = np.zeros((width + 1, n), np.int32)
        for i in range(1, width + 1):
            open_ = np.flatnonzero(sizes >= i)
            count[i] = count[i - 1]
            code = codes[open_, i - 1]
            count[i, open_] += 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)  # a character in no piece
            for size in range(min(i, self.longest), 0, -1):
                if not len(open_):
                    break
                piece = self.find(prefix[i, open_] - prefix[i - size, open_] * self.powers[size])
                some = np.flatnonzero(piece >= 0)
                rows, piece = open_[some], piece[some]
                keys, which = np.unique((last[i - size, rows] + 1) << 20 | piece, return_inverse=True)
                right = np.fromiter((self.follows((k >> 20) - 1, k & 0xFFFFF) for k in keys.tolist()), bool, len(keys))[which]
                rows, piece = rows[right], piece[right]
                last[i, rows], count[i, rows] = piece, count[i - size, rows] + 1
                left = np.ones(len(open_), bool)
                left[some[right]] = False
                open_ = open_[left]
        return count

    def long_counts(self, unit: str) -> np.ndarray:
        """counts() of one long unit."""
        last, count = [START] * (len(unit) + 1), np.zeros(len(unit) + 1, np.int32)
        for i in range(1, len(unit) + 1):
            count[i] = count[i - 1] + len(unit[i - 1].encode())
            for size in range(min(i, self.longest), 0, -1):
                piece = self.number.get(unit[i - size : i])
                if piece is not None and self.follows(last[i - size], piece):
                    last[i], count[i] = piece, count[i - size] + 1
                    break
        return count


@functools.lru_cache(2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts in a row, and the offsets of each text's; each but a text's last stands before a line feed, a NUL or a space."""
    plain = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")  # the model doesn't tell them apart
    marked = pc.binary_join_element_wise(SPACE, plain, "")
    marked = pc.replace_substring(pc.replace_substring(marked, "\n", "\0"), " ", f"\0{SPACE}")
    while pc.any(pc.match_substring(marked, f"{SPACE}\0{SPACE}")).as_py():
        marked = pc.replace_substring(marked, f"{SPACE}\0{SPACE}", SPACE * 2)
    split = pc.split_pattern(marked, "\0")
    return split.flatten(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()


def unit_steps(words: list[str], of: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The steps of all units in a row, those of a unit behind a one, and where each unit's one is: by how much each character changes the count, in two bytes."""
    sizes = np.array([len(x) for x in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    rising, found, at = sizes[order].tolist(), [np.empty(0, np.int16)], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < TOGETHER and (end - at + 1) * rising[end] <= CELLS:
            end += 1
        some = [words[k] for k in order[at:end].tolist()]
        if rising[end - 1] <= LONG or len(some) >= FEW:
            steps = np.ones((len(some), rising[end - 1] + 1), np.int16)
            steps[:, 1:] = narrow(np.diff(of.counts(some), axis=0).T)
            found.append(steps[np.arange(rising[end - 1] + 1) <= np.array(rising[at:end])[:, None]])
        else:
            found += [np.insert(narrow(np.diff(of.long_counts(x))), 0, 1) for x in some]
        at = end
    starts = np.empty(len(words), np.int64)
    starts[order] = np.cumsum(sizes[order] + 1) - sizes[order] - 1
    return np.concatenate(found), starts


def narrow(steps: np.ndarray) -> np.ndarray:
    """The steps in two bytes each; one character would have to change the count by more than 32,767 for an error."""
    small = steps.astype(np.int16)
    if (small != steps).any():
        raise OverflowError("a character changes the count of tokens by more than two bytes hold")
    return small


def text_steps(texts: pa.Array, model: str) -> pa.Array:
    """Of each text, by how much each of its characters changes the count, as little-endian 16-bit integers."""
    flat, offsets = units(texts)
    coded = flat.dictionary_encode()
    steps, starts = unit_steps(coded.dictionary.to_pylist(), pieces(model))
    index, sizes = coded.indices.to_numpy(), pc.utf8_length(coded.dictionary).to_numpy()
    # a unit that doesn't begin with a space follows on a line feed or NUL, a token and a character of its own: the one before its steps
    breaks = (~pc.starts_with(coded.dictionary, SPACE).to_numpy(zero_copy_only=False)).astype(np.int64)
    lengths = (sizes + breaks)[index]
    ends = np.cumsum(lengths)
    places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((starts + 1 - breaks)[index] - (ends - lengths), lengths)
    whole = steps[places]
    borders = np.concatenate([[0], ends])[offsets]
    # the first unit has a space before it that is no character of the text
    filled = borders[:-1][np.diff(borders) > 1]
    whole[filled + 1] += whole[filled]
    kept = np.ones(len(whole), bool)
    kept[borders[:-1]] = False
    borders = 2 * (borders - np.arange(len(borders)))
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(borders.astype(np.int64).tobytes()), pa.py_buffer(whole[kept].astype("<i2").tobytes())]).cast(pa.binary())


def prefix_steps(docs: DataFrame, model: str = MODEL, keep_text: bool = True) -> DataFrame:
    """docs with prefix_steps: by how much each character of text changes the count, two bytes each; their running sums are the counts at every prefix. Without text, if it is not to be kept."""
    docs = docs.drop("prefix_steps")
    dropped = () if keep_text else ("text",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            yield with_columns(batch, {"prefix_steps": text_steps(batch.column("text"), model)}, dropped)

    added = StructType.fromDDL("prefix_steps binary")
    return docs.mapInArrow(run, StructType([*docs.drop(*dropped).schema.fields, *added.fields]))


def answered(stepped: DataFrame, limit: int = LIMIT, every: bool = False) -> DataFrame:
    """What prefix_steps tell, no text encoded again: n_tokens, over_limit, fits_chars (of the longest prefix with limit tokens at most), half_tokens (of the first half of the characters, rounded down) and, if asked for, prefix_tokens: the count at every prefix. Null steps are those of an empty text."""
    names = ["n_tokens", "over_limit", "fits_chars", "half_tokens", *["prefix_tokens"] * every]
    stepped = stepped.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "prefix_steps", 2 * CHUNK):
            steps, ends = flat_bytes(batch.column("prefix_steps"))
            steps, ends = np.frombuffer(steps.tobytes(), "<i2"), ends // 2
            rows = [np.cumsum(np.concatenate([[0], steps[a:b]]), dtype=np.int64) for a, b in zip(ends, ends[1:], strict=False)]
            added = {
                "n_tokens": pa.array([int(x[-1]) for x in rows], pa.int64()),
                "over_limit": pa.array([bool(x[-1] > limit) for x in rows]),
                "fits_chars": pa.array([int(np.flatnonzero(x <= limit)[-1]) for x in rows], pa.int64()),
                "half_tokens": pa.array([int(x[(len(x) - 1) // 2]) for x in rows], pa.int64()),
            }
            yield with_columns(batch, added | ({"prefix_tokens": pa.array(rows, pa.list_(pa.int32()))} if every else {}))

    added = StructType.fromDDL("n_tokens bigint, over_limit boolean, fits_chars bigint, half_tokens bigint" + ", prefix_tokens array<int>" * every)
    return stepped.mapInArrow(run, StructType([*stepped.schema.fields, *added.fields]))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, every: bool = False) -> DataFrame:
    """docs with the answers of answered()."""
    return answered(prefix_steps(docs, model), limit, every).drop("prefix_steps")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, from a stored table of the counts at every prefix."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    steps = stored(prefix_steps(docs, keep_text=False), "op6-prefixes")
    return answered(steps).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars", "half_tokens")
