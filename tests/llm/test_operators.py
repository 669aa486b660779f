"""The numbered operators against libraries, brute force and SQL on small tables with edge cases."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from formlens.llm import byte_bpe, chat, classifier, media, mixing, near_dedup, quality, registry, sharding, span_dedup, suffixes, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ", lang string, n_chars bigint, size string, kept string, rate string, ids string"


def texts():
    rng = random.Random(1)
    words = ["the", "und", "año", "Ünder", "été", "x1", "A", "gehen", "ñandú", "日本語", "it's", "...", "#", "é"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ing", ",", ".\n"]) for _ in range(n))
    base = prose(400)
    passage = prose(150)
    near = base.split(" ")
    near[200] = "changed"
    return [
        None, "", " \n\t ", "one", "one two three", base, base, " ".join(near), prose(80) + passage + prose(60), prose(30) + passage + prose(90), "ab" * 900, "x" * 500 + " " * 300 + "y" * 500,
        "line\n" * 60, "don't <|endoftext|>  　 ﻿ 🙂🙂 \r\n" * 8, prose(900), prose(12),
    ]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, None if i % 5 == 4 else "big" if i % 3 else f"s{i}") for i, t in enumerate(texts())]
    return [*found, (3, "one", "s3"), (None, "no id here at all", "big")]


@pytest.fixture
def folder(spark, rows, tmp_path):
    """A folder with documents (columns with clashing names too) and labels."""

    def make(some=rows):
        more = [(*r, "en", 1, "size", "kept", "rate", "ids") for r in some]
        spark.createDataFrame(more, "doc_id bigint, text string, source string" + EXTRA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, 0, "user", "hi")], "conv_id bigint, turn bigint, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        spark.createDataFrame([(1, "one two words and gehen"), (2, None)], "item_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(5 if some else 0)], "vec_id bigint, embedding array<float>, label int").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return make


def collected(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def by_sql(path, sql):
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    found = con.sql(sql)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    return sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_an_empty_table_gives_no_rows(spark, folder, name):
    path = folder([])
    if "chat" in name:
        spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    assert registry.QUERIES[name](spark, path).count() == 0


def test_mix_is_its_sql(spark, folder, rows):
    path = folder([r for r in rows if r[0] is not None] + [(100 + i, "w " * (i % 50), f"site{i % 37}") for i in range(400)])
    found = {tuple(r) for r in mixing.op1_mixing_sources_to_target_weights(spark, path).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert found == set(con.sql(mixing.OP1_SQL).fetchall())


def test_mix(spark, folder, rows):
    found = [r.asDict() for r in mixing.op1_mixing_sources_to_target_weights(spark, folder()).collect()]
    assert len(found) == len(rows)
    assert all(r["size"] <= r["taken"] + r["size"] <= 3 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-9 for r in found)
    assert sum({(r["source_size"], r["target"]): r["target"] for r in found}.values()) <= 1.5 * sum(r["size"] for r in found) + 1e-6
    assert {r["size"] for r in found if r["doc_id"] in (0, 1, 2)} == {0}
    docs = spark.read.parquet(f"{folder()}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixing.emitted(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_mix_of_rows_without_ids_meets_the_target(spark, folder):
    path = folder([(None, f"text number {i} of ten words a b c d e", "s") for i in range(2000)] + [(i, f"other {i}", "t") for i in range(900)])
    for found in (mixing.op1_mixing_sources_to_target_weights(spark, path).toPandas(), mixing.mix(spark.read.parquet(f"{path}/documents.parquet")).selectExpr("doc_id", "source_size", "target", "copies * size AS taken").toPandas()):
        some = found[found.doc_id.isna()]
        assert 1.2 < some.target.iloc[0] / some.source_size.iloc[0] < 1.8
        assert abs(some.taken.sum() / some.target.iloc[0] - 1) < 0.05


def test_quality(spark, folder, rows):
    path = folder([r for r in rows if r[0] not in (None, 3)])
    assert collected(quality.op2_quality_rules(spark, path)) == by_sql(path, quality.OP2_SQL)


def test_bpe(spark, folder):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = ["ab" * 900, "日本" * 300, "é" * 513, " " * 1500, "=" * 1025]
    mixed = "one " + " two\n".join(long) + " three"
    some = {i: t for i, t in enumerate([*texts(), mixed, mixed, f"{long[0]} {long[0]}", "x" * 1024, "x " * 3000, *long])}
    found = {r.doc_id: r for r in byte_bpe.op3_byte_level_bpe(spark, folder([(i, t, "s") for i, t in some.items()])).collect()}
    for i, t in some.items():
        ids = library.encode_ordinary(t or "")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), (i, t)
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_media(spark, folder):
    some = {i: t for i, t in enumerate(texts())}
    found = {r.doc_id: r for r in media.op4_media_columns(spark, folder([(i, t, "s") for i, t in some.items()])).collect()}
    for i, t in some.items():
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert found[5].media_sha256 == found[6].media_sha256 != found[7].media_sha256


@pytest.mark.parametrize("wide", [False, True])
def test_pictures_of_others_have_their_quantiser_and_comments(spark, wide):
    data = bytes(random.Random(6).randrange(256) for _ in range(64 * 40))
    own = media.jpegs(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    table = bytes([0x10]) + b"\x01\x2c" + b"\0\1" * 63 if wide else bytes([0, 3, *[1] * 63])
    step = 300 if wide else 3
    other = own.replace(media.QUANT, media.segment(0xDB, bytes([1, *[9] * 64]) + table) + media.segment(0xFE, b"a=b") + media.segment(0xFE, b"=") + media.segment(0xE0, b"JFIF"))
    noteless = other.replace(media.segment(0xFE, b"payload-blocks=40"), b"")
    assert len({own, other, noteless}) == 3
    pictures = [media.Picture(x) for x in (own, other, noteless)]
    blocks = [next(iter(x.values())) for x in media.decode(pictures)]
    thumbs = [media.thumbnail(p, b) for p, b in zip(pictures, blocks, strict=True)]
    plain = blocks[0][:, 0].astype(int).reshape(thumbs[0].shape)
    assert (thumbs[0] == np.clip(plain // 8 + 128, 0, 255)).all()
    assert (thumbs[1] == np.clip(plain * step // 8 + 128, 0, 255)).all() and (thumbs[1] == thumbs[2]).all()
    table = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate((own, other, noteless))], "doc_id int, media binary")
    found = media.media_features(table).orderBy("doc_id").collect()
    assert {r.payload_sha256 for r in found} == {hashlib.sha256(data).hexdigest()}
    assert found[0].feature != found[1].feature == found[2].feature


def test_classifier_separates_held_out_rows(spark, folder):
    found = classifier.op5_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good])
    assert auc > 0.85
    assert all(r.score is not None and 0 <= r.score <= 1 for r in classifier.op5_quality_classifier(spark, folder()).collect())


def test_classifier_trains_on_whole_documents(spark, docs):
    long = " ".join(f"word{i}" for i in range(64 * 100))
    table = docs([(i, long if i % 4 == 0 else f"short text {i}", "s") for i in range(12)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    drawn = {r.doc_id for r in labels.filter(~classifier.held_out()).collect()}
    size = lambda found: {k: len(x) // (4 * classifier.WIDTH) for k, x in zip(found["doc_id"].to_pylist(), found["bag"].to_pylist())}
    wanted = {i: 1 if i % 4 else 100 for i in drawn}
    assert 100 in wanted.values()
    assert size(classifier.sample(table, labels)) == wanted
    assert size(classifier.sample(table, labels, 12, 5)) == {i: n for i, n in wanted.items() if n == 1}


def test_classifier_takes_ids_of_text(spark, docs):
    table = docs([(i, f"word {i} " * (30 if i % 2 else 3), "s") for i in range(40)]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = table.select("doc_id", (F.substring("doc_id", 2, 9).cast("int") % 2).alias("quality"))
    assert classifier.trained(table, labels).trained


def test_classifier_gradients():
    rng = np.random.default_rng(1)
    model, x, owner, y = classifier.Model(5), rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    loss = lambda: float(np.mean(np.logaddexp(0, s := model.forward(x, owner, 4)[0]) - y * s))
    for name, d in model.gradients(x, owner, y).items():
        at = tuple(0 for _ in d.shape)
        model.p[name][at] += 1e-6
        up = loss()
        model.p[name][at] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(d[at], abs=1e-5), name
        model.p[name][at] += 1e-6


def test_token_counts(spark, folder):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    some = {i: t for i, t in enumerate(texts())}
    found = {r.doc_id: r for r in token_counts.op6_token_counts(spark, folder([(i, t, "s") for i, t in some.items()])).collect()}
    for i, t in some.items():
        assert (found[i].n_tokens, found[i].n_bytes) == (len(library.encode(t or "")), len((t or "").encode())), (i, t)


@pytest.mark.parametrize("some", [["a" * 60], ["", None], ["日本語" * 40], ["x" * 48, "y" * 49], []])
def test_token_counts_of_odd_slices(spark, folder, some):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    found = {r.doc_id: r.n_tokens for r in token_counts.op6_token_counts(spark, folder([(i, t, "s") for i, t in enumerate(some)])).collect()}
    assert found == {i: len(library.encode(t or "")) for i, t in enumerate(some)}


def test_token_counts_at_every_prefix_and_budget(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    some = ["Hello  world\nnew line", " lead", "\n", "tab\there 日本語 🙂 x", "w" * 60 + " end", "", "▁a ▁▁b", "\0zero"]
    for limit in (0, 1, 3, 7):
        found = {r.doc_id: r for r in token_counts.token_counts(docs([(i, t, "s") for i, t in enumerate(some)]), limit=limit, every=True).collect()}
        for i, t in enumerate(some):
            counts = [len(library.encode(t[:k])) for k in range(len(t) + 1)]
            assert found[i].prefix_tokens == counts, t
            assert found[i].fits_chars == max(k for k, n in enumerate(counts) if n <= limit), (t, limit)
            assert found[i].over_limit == (counts[-1] > limit)
            assert found[i].half_tokens == counts[len(t) // 2], t


@pytest.mark.parametrize("few", [1, 10**9])
def test_long_units_count_alike_in_step_and_alone(spark, docs, few, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "FEW", few)
    monkeypatch.setattr(token_counts, "CELLS", 700)
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    draw = random.Random(5)
    some = ["".join(draw.choice("abethelnr日本語のу🙂") for _ in range(draw.randrange(40, 160))) for _ in range(12)] + ["ha" * 500, "\n\n", " "]
    for t, found in zip(some, token_counts.text_steps(pa.array(some), token_counts.MODEL).to_pylist(), strict=True):
        counts = np.cumsum(np.frombuffer(found, "<i2")).tolist()
        assert counts == [len(library.encode(t[: k + 1])) for k in range(len(t))], t


def test_one_text_larger_than_a_slice_and_rows_without_ids(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    long = "lorem ipsum dolor sit amet " * 200_000
    found = token_counts.token_counts(docs([(None, long, "s"), (None, "a", "s"), (1, "a", None), (1, "a", None)]).withColumn("prefix_steps", F.lit(3)))
    assert found.columns == ["doc_id", "text", "source", "n_tokens", "over_limit", "fits_chars", "half_tokens"]
    assert sorted(r.n_tokens for r in found.collect()) == [1, 1, 1, len(library.encode(long))]


def test_chat(spark, tmp_path):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "bot", "yes"), (4, 2, "user", None), (5, 0, "user", ""), (None, 0, "user", "x"), (6, 1, "user", "a"), (6, 1, "bot", "a")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.op7_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(found) == {3, 5, 6, None}
    assert found[3] == (3, 2, "<|user|>\nhi<|end|>\n<|bot|>\nyes<|end|>\n<|user|>\n<|end|>\n")


def covered(data, k):
    seen = {}
    for t in data:
        for a in range(len(t) - k + 1):
            seen[t[a : a + k]] = seen.get(t[a : a + k], 0) + 1
    out = []
    for t in data:
        mark = bytearray(len(t))
        for a in range(len(t) - k + 1):
            if seen[t[a : a + k]] > 1:
                mark[a : a + k] = b"\1" * k
        out.append(bytes(mark))
    return out


def test_common_words_are_known_with_their_codes_and_bytes(spark, docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "OFTEN", 3)
    some = [(i, "the été the 日本 the\x00ñandú" + " été" * 3 + f" once{i} {t or ''}", "s") for i, t in enumerate(texts())] + [(99, None, "s"), (98, "", "s")]
    codec = byte_bpe.Codec(spark)
    codec.learn(docs(some))
    of = byte_bpe.ranks(byte_bpe.RANKS)
    by_id = {i: b for b, i in of.items()}
    held = [(w, v) for m in codec.known.first().known0 for w, v in m.items()]
    assert held
    for w, v in held:
        ids = byte_bpe._heaped(w.encode(), of)
        assert v.ids == ids and b"".join(by_id[i] for i in ids) == w.encode()
    first = codec.known.select(F.explode("known0").alias("m")).select(F.explode("m").alias("w", "v")).select(F.col("w").cast("binary").alias("w"), "v.ids", F.col("v.codes").cast("binary").alias("codes"), F.col("v.pieces").cast("binary").alias("pieces"))
    for r in first.collect():
        assert bytes(r.pieces) == bytes(r.w) and bytes(r.codes) == np.array(r.ids, "<u4").tobytes()
    whole = byte_bpe.round_trip(docs(some))
    slim = byte_bpe.round_trip(docs(some), with_ids=False)
    assert "ids" in whole.columns and "ids" not in slim.columns
    rows = {r.doc_id: r for r in whole.collect()}
    for r in slim.collect():
        t = dict((i, t) for i, t, _ in some)[r.doc_id] or ""
        assert bytes(r.decoded) == bytes(rows[r.doc_id].decoded) == t.encode()
        assert r.n_tokens == len(rows[r.doc_id].ids) and r.ids_sha256 == rows[r.doc_id].ids_sha256 == hashlib.sha256(np.array(rows[r.doc_id].ids, "<u4").tobytes()).hexdigest()


def test_folds_start_with_merges_that_are_certain(spark, docs):
    """The parts a fold starts with lead to the library's ids, whatever stands beside them, and are fewer than the bytes."""
    of = byte_bpe.ranks(byte_bpe.RANKS)
    pair = {(a, b): r for a, b, r in byte_bpe.merges(of)}
    tokens = byte_bpe.sure(byte_bpe.RANKS)
    pattern = re.compile(byte_bpe.sure_pattern(tokens))
    rng, pieces = random.Random(3), sorted(x for x in of if len(x) < 5)
    some = [b"".join(rng.choice([rng.choice(pieces), rng.choice(sorted(tokens)), bytes([rng.randrange(256)])]) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    n_bytes = n_parts = 0
    for word in [b"", b"\0", b"\0e", b"aaaa", b"ererer", *some]:
        starts = [x.encode("latin-1") for x in pattern.findall(word.decode("latin-1"))]
        assert b"".join(starts) == word
        parts = [of[x] for x in starts]
        while found := [(pair[x], i) for i, x in enumerate(zip(parts, parts[1:], strict=False)) if x in pair]:
            rank, i = min(found)
            parts[i : i + 2] = [rank]
        assert parts == byte_bpe._heaped(word, of), word
        n_bytes, n_parts = n_bytes + len(word), n_parts + len(starts)
    assert n_parts < 0.9 * n_bytes
    codec = byte_bpe.Codec(spark)
    words = [x.decode(errors="ignore") for x in some[:400]] + ["", "\0", "hereinafter", " übernehmen", "ererer", "日本語"]
    table = spark.createDataFrame([(x,) for x in words], "word string").withColumns({x: codec.scalar(x) for x in ("pairs", "starts")})
    for r in table.select("word", byte_bpe.let(F.struct("pairs", "starts"), lambda m: codec.folded(F.col("word"), m)).alias("ids")).collect():
        assert r.ids == byte_bpe._heaped(r.word.encode(), of), r.word


def test_known_words_need_no_lookups_where_ids_are_unasked(spark, docs, monkeypatch):
    """Both maps have codes and bytes then; a text's long words are put between the others."""
    monkeypatch.setattr(byte_bpe, "OFTEN", 3)
    long = "ab" * 900
    some = [(i, f"the été the 日本 {long} ñandú ñandú\0 {long}{i} once{i} the", "s") for i in range(6)] + [(9, None, "s"), (10, long, "s")]
    codec = byte_bpe.Codec(spark)
    codec.learn(docs(some), with_ids=False)
    of = byte_bpe.ranks(byte_bpe.RANKS)
    for name in ("known0", "known1"):
        held = codec.known.select(F.explode(name).alias("m")).select(F.explode("m").alias("w", "v")).select("w", "v.*").withColumns({x: F.col(x).cast("binary") for x in ("codes", "pieces")}).collect()
        assert held and set(held[0].asDict()) == {"w", "codes", "pieces"}
        for r in held:
            assert bytes(r.pieces) == r.w.encode() and bytes(r.codes) == np.array(byte_bpe._heaped(r.w.encode(), of), "<u4").tobytes()
    rows = {r.doc_id: r for r in byte_bpe.round_trip(docs(some)).collect()}
    for r in byte_bpe.round_trip(docs(some), with_ids=False).collect():
        assert bytes(r.decoded) == (dict((i, t) for i, t, _ in some)[r.doc_id] or "").encode()
        assert r.n_tokens == len(rows[r.doc_id].ids) and r.ids_sha256 == rows[r.doc_id].ids_sha256


@pytest.mark.parametrize("shard_bytes", [span_dedup.SHARD_BYTES, 1500])
def test_repeated_spans(spark, folder, shard_bytes, monkeypatch):
    monkeypatch.setattr(span_dedup.verdicts, "__defaults__", (span_dedup.MATCH, shard_bytes, False))
    some = dict(enumerate(texts()))
    data = [(t or "").encode() for t in some.values()]
    found = {r.doc_id: r for r in span_dedup.op8_suffix_array_dedup(spark, folder([(i, t, "s") for i, t in some.items()])).collect()}
    for i, (t, mark) in enumerate(zip(data, covered(data, span_dedup.MATCH), strict=True)):
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        runs = len(re.findall(b"\1+", mark))
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()), i


def test_repeated_spans_of_long_and_hot_texts(spark, folder, monkeypatch):
    monkeypatch.setattr(span_dedup.regions, "__defaults__", (span_dedup.MATCH, 300))
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    line, long = prose(80) + "\n", prose(1500)
    some = [prose(20) + line * 3 + prose(i) for i in range(12)] + [long, "ä" + long, prose(3) + long[3000:9000], "ab" * 3000, long, prose(70)]
    passage = prose(55)
    some += [f"{prose(5)} {passage} {prose(5)}", f"{passage.replace(' ', chr(10))} b"]
    data = [t.encode() for t in some]
    found = {r.doc_id: r for r in span_dedup.op8_suffix_array_dedup(spark, folder([(i, t, "s") for i, t in enumerate(some)])).collect()}
    for i, (t, mark) in enumerate(zip(data, covered(data, span_dedup.MATCH), strict=True)):
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        assert (found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (sum(mark), len(re.findall(b"\1+", mark)), hashlib.sha256(kept).hexdigest()), i
    passages = {r.text for r in span_dedup.remove_repeats(spark.read.parquet(f"{folder([(i, t, 's') for i, t in enumerate(some)])}/documents.parquet"), words=51).collect()}
    assert not any(passage in t for t in passages) and found[18].n_removed == 0


@pytest.mark.parametrize("prints", [span_dedup.PRINTS, 40])
def test_passages_of_over_50_words_have_a_column(spark, folder, prints, monkeypatch):
    monkeypatch.setattr(span_dedup, "PRINTS", prints)  # each text a block of its own, or several in one
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    short, fifty, hot = (" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (51, 50, 60))
    some = [f"{prose(70)} {short} {prose(5)}", f"{prose(9)}\n{short.replace(' ', '  ')} {prose(80)}", f"{prose(60)} {fifty} {prose(60)}", f"{prose(60)} {fifty} {prose(60)}", "k " * 60, short, prose(90), prose(50), "", None]
    some += [f"{prose(i)} {hot} é{prose(3)} {hot}" for i in range(1, 20)] + [prose(60)] * 2 + ["two words"] * 2
    data = [(t or "").encode() for t in some]
    marks, places = [bytearray(len(t)) for t in data], {}
    for i, t in enumerate(data):
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        for k in range(len(at) - 50):
            places.setdefault(tuple(t[a:b] for a, b in at[k : k + 51]), []).append((i, at[k][0], at[k + 50][1]))
    for found in places.values():
        for i, a, b in found if len(found) > 1 else []:
            marks[i][a:b] = b"\1" * (b - a)
    wanted = [len(t) if t and data.count(t) > 1 and any(m) else sum(m) for t, m in zip(data, marks, strict=True)]
    found = {r.doc_id: r for r in span_dedup.op8_suffix_array_dedup(spark, folder([(i, t, "s") for i, t in enumerate(some)])).collect()}
    assert [found[i].n_passage_bytes for i in range(len(some))] == wanted
    assert found[5].n_passage_bytes == len(short) and found[5].n_removed == found[2].n_passage_bytes == 0


def test_columns_named_as_the_kept_text_stay(spark, docs):
    table = docs([(1, "a", "s", "k", 1), (2, None, "s", "k", 1)], ", kept_text string, n_passage_bytes int")
    found = span_dedup.remove_repeats(table)
    assert collected(found) == collected(table)


def test_removed_spans_keep_whole_characters(spark, folder):
    docs = spark.read.parquet(f"{folder()}/documents.parquet")
    found = span_dedup.remove_repeats(docs)
    assert found.columns == docs.columns
    assert found.count() == docs.count()
    assert found.filter("text IS NULL").count() == 1


def test_suffix_array():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 1500).astype(np.uint8)
    data[900:1400] = data[100:600]
    order = suffixes.suffix_array(data, 64)
    text = data.tobytes() + b"\xff" * 64
    assert [text[i : i + 64] for i in order] == sorted(text[i : i + 64] for i in range(1500))
    before, common = suffixes.common_prefixes(data, order, 64)
    for i in range(1500):
        if before[i] >= 0:
            a, b = data[i:].tobytes(), data[before[i] :].tobytes()
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[i] == min(n, 64)


def test_shards(spark, folder, rows):
    found = sharding.op9_sharding(spark, "/root/testdata/sf0.01").collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r.shard, []).append(r)
    assert sorted(sizes) == list(range(8))
    total = [sum(r.size for r in x) for x in sizes.values()]
    assert max(total) < 1.1 * min(total)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in sizes.values())
    small = sharding.op9_sharding(spark, folder()).collect()
    by_id = {r.doc_id: r for r in small}
    assert len(small) == len(rows)
    assert all(by_id[i].size == len((t or "").encode()) + 1 and by_id[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in enumerate(texts()))


def test_shards_do_not_depend_on_partitions(spark, folder, tmp_path):
    path = folder([(i if i % 9 else None, f"text {i % 300} " * (i % 40), "s") for i in range(3000)])
    first = collected(sharding.op9_sharding(spark, path))
    spark.read.parquet(f"{path}/documents.parquet").repartition(7, "n_chars", "text").write.parquet(f"{tmp_path}/other/documents.parquet")
    second = sharding.op9_sharding(spark, f"{tmp_path}/other")
    assert collected(second) == first
    by_shard = {}
    for r in second.collect():
        by_shard.setdefault(r.shard, []).append(r)
    assert max(sum(r.size for r in x) for x in by_shard.values()) - min(sum(r.size for r in x) for x in by_shard.values()) < 4000
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by_shard.values())


def test_rows_alike_in_all_are_spread_over_shards(spark, folder):
    path = folder([(None, "the same text in all rows", "s")] * 2000 + [(i, f"other {i}", "s") for i in range(1000)])
    found = sharding.op9_sharding(spark, path).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("last")).collect()
    assert len(found) == 8 and max(r.n for r in found) < 1.15 * min(r.n for r in found)
    assert all(r["last"] == r["rows"] - 1 for r in found)


@pytest.mark.parametrize("text", ["a", "the same in all", "", None, "another text 5"])
def test_shards_of_a_table_of_alike_rows(spark, folder, text):
    path = folder([(None, text, "s")])
    spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    found = sharding.op9_sharding(spark, path).groupBy("shard").agg(F.count("*").alias("rows"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(found) == 8 and sum(r.rows for r in found) == 60_000 and max(r.rows for r in found) < 1.1 * min(r.rows for r in found)
    assert all(r["rows"] == r.slots == r["last"] + 1 for r in found)
    one = sharding.op9_sharding(spark, folder([(5, text, "s")])).collect()
    assert [(r.size, r.slot) for r in one] == [(len((text or "").encode()) + 1, 0)]


def test_boundaries_are_the_quantiles_of_the_drawn_keys(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(40)), float(rng.randrange(2**53)), rng.randrange(1, 50)) for _ in range(600)] + [(7.0, 3.0, 20)] * 500
    total, ranges = sum(r[2] for r in rows), 24
    keys = sorted(k for k, second, size in rows if second / 2**53 < sharding.SAMPLE * ranges * size / total)
    records = spark.createDataFrame(rows, "key double, second double, size long")
    assert sharding.boundaries(records, total, ranges) == sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})


def test_slots_follow_the_keys(spark, folder):
    """A restatement: rows by key fill the shards one after the other, each as far as its part of the bytes goes."""
    path = folder([(i, f"text {i} " * (1 + i % 17), "s") for i in range(4000)])
    records = sharding.keyed(spark.read.parquet(f"{path}/documents.parquet")).cache()
    found = sharding.sharded(records, 5).orderBy("shard", "slot").collect()
    total, upto = sum(r["size"] for r in found), 0
    assert sum(a.key > b.key for a, b in zip(found, found[1:], strict=False)) < 40  # divided ranges only
    for r in found:
        assert abs(r.shard - upto * 5 / total) < 1 + 5 * 3 / (5 * sharding.RANGES_A_SHARD) * 5
        upto += r["size"]
    for s in range(5):
        assert [r.slot for r in found if r.shard == s] == list(range(sum(r.shard == s for r in found)))


def test_written_shards_replace_clashing_columns(spark, docs, tmp_path):
    table = docs([(i, f"text {i}", "s", 7, 7, 7, i, -i, i * i, 5, 6) for i in range(50)], ", shard int, slot int, size int, key int, second int, row_id int, row int, __range int")
    sharding.write_shards(table, f"{tmp_path}/out", 3)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == 50 and sorted(r.shard for r in found.select("shard").distinct().collect()) == [0, 1, 2]
    assert {r.slot for r in found.filter("shard = 0").collect()} == set(range(found.filter("shard = 0").count()))
    assert all((r.key, r.second, r.row_id, r["row"], r["__range"]) == (r.doc_id, -r.doc_id, r.doc_id**2, 5, 6) for r in found.collect())


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 2])
def test_near_duplicates(spark, folder, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    some = list(texts())
    for _ in range(25):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(120)] = f"v{rng.randint(0, 9)}"
        some.append(" ".join(own).upper() if rng.random() < 0.3 else "  ".join(own))
    sets = []
    for t in some:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(some)))
    for _ in some:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.op10_minhash_near_dedup(spark, folder([(i, t, "s") for i, t in enumerate(some)])).collect()}
    assert found == {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}
