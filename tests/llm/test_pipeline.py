"""The corpus pipeline's stages on a small table."""

import base64
import hashlib
import random
import re

import corpus_pipeline
import duckdb
import public_tokenizers
import tiktoken

from formlens.llm import byte_bpe, quality

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_stages_keep_clean_documents_and_drop_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, kept, "/root/testdata/sf0.001"), f"test-{name}")
        assert kept.columns == columns, name
        if name == "near_duplicates":
            assert kept.count() == kept.select("text").distinct().count()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001")
    assert last.count() == kept.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_spans", "source_mix", "token_ids"]


def without_repeats(texts, words, match):
    """Brute force: the texts without the runs of so many words, and the strings of so many bytes, that also start elsewhere."""
    seen = {}
    found = []
    for t in texts:
        at = [m.span() for m in WORD.finditer(t)]
        own = [(at[k][0], at[k + words - 1][1], tuple(t[a:b] for a, b in at[k : k + words])) for k in range(len(at) - words + 1)]
        own += [(a, a + match, t[a : a + match]) for a in range(len(t) - match + 1)]
        found.append(own)
        for *_, key in own:
            seen[key] = seen.get(key, 0) + 1
    out = []
    for t, own in zip(texts, found, strict=True):
        gone = bytearray(len(t))
        for a, b, key in own:
            if seen[key] > 1:
                gone[a:b] = b"\1" * (b - a)
        out.append(bytes(x for x, g in zip(t, gone, strict=True) if not g).decode())
    return out


def test_repeated_spans_finds_every_passage_of_over_50_words(spark, docs):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    short = " ".join(rng.choice("abcdefgh") for _ in range(51))  # 101 bytes
    fifty = " ".join(rng.choice("abcdefgh") for _ in range(50))
    passage, long = prose(60), "x".join(str(rng.randrange(10**6)) for _ in range(100))
    assert len(short) == 101
    texts = [f"{prose(70)} {short} {prose(5)}", f"{prose(9)} {short} {prose(80)}", f"{passage} {prose(40)}", f"{prose(40)}\n{passage}", f"{prose(30)}, {passage.replace(' ', '  ')}", f"{prose(60)} {fifty} {prose(60)}", f"{prose(60)} {fifty} {prose(60)}", f"é {long} {prose(3)}", f"{prose(3)} {long} b", short, "k " * 51, "k", "", " ", prose(51)]
    wanted = dict(enumerate(without_repeats([t.encode() for t in texts], 51, 400)))
    table = docs([(i, t, "s") for i, t in enumerate(texts)] + [(99, None, "s")])
    found = {r.doc_id: r.text for r in corpus_pipeline.repeated_spans(spark, table, "").collect()}
    assert found.pop(99) is None
    assert found == wanted
    assert short not in found[0] and passage not in found[2] and fifty in found[5]


def one_of_each_component(texts, percent):
    """Brute force: the numbers of the texts of which no smaller one is in the same component of pairs with that similarity of word shingles."""
    sets = []
    for t in texts:
        w = WORD.findall(t.lower().encode())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return {i for i, r in enumerate(root) if i == r}


def test_near_duplicates_links_from_a_similarity_of_80_percent(spark, docs, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.near_dedup, "BLOCK", 2)
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        texts.append(" ".join(base))
        for changes in (2, 3, 2):  # 106 of 126 shingles are shared, 0.84, or 101 of 131, 0.77
            own = list(base)
            for k in rng.sample(range(10, 110, 10), changes):
                own[k] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += ["", "one", "ONE"]
    table = docs([(i, t, "s") for i, t in enumerate(texts)])
    found = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect()}
    assert found == one_of_each_component(texts, 80)
    assert len(found) < len(one_of_each_component(texts, 85))


CLASHING = ["__key", "__text_key", "__kept_text", "__draw", "__w", "__copy", "key", "second", "row_id", "row", "kept", "n_words", "size", "rate", "copies", "draw", "copy", "hash", "place", "kept_text", "text_key", "ids"]


def mixed_by_hand(rows):
    """rows (doc_id, text, source) as often as the mix takes them, by plain loops."""
    sizes = [len(WORD.findall(t.encode())) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, open_, budget = {}, list(names), 1.5 * sum(sizes)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * total[s] <= level * weight[s]]
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        budget -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    out = []
    for doc_id, text, source in rows:
        rate = target[source] / total[source] if total[source] else 0.0
        name = str(doc_id) if doc_id is not None else "text:" + hashlib.md5(text.encode()).hexdigest()
        draw = int(hashlib.md5(f"mix-1:{name}".encode()).hexdigest()[:8], 16) / 4294967296
        out += [(doc_id, text, source)] * (int(rate) + (draw < rate - int(rate)))
    return out


def test_the_whole_pipeline_is_its_plain_version(spark, tmp_path):
    """All stages against brute force: nulls, empty and short texts, copies, repeated rows and passages, and columns of many names."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["Wort", "año", "x"]) + str(rng.randrange(10**5)) for _ in range(n))
    passage, base = prose(70), prose(130).split(" ")
    near = [*base[:60], "changed", *base[61:]]
    texts = [prose(rng.randrange(12, 60)) for _ in range(24)] + [" ".join(base), " ".join(near), " ".join(base), f"{prose(40)} {passage}", f"{passage}\n{prose(55)}", "same line of words\n" * 30, "short", "", None]
    rows = [(i, t, ["a", "b", None, "ü"][i % 4]) for i, t in enumerate(texts)] + [(None, prose(25), "b"), (3, texts[3], "ü"), (3, texts[3], "ü")]
    path = f"{tmp_path}/documents.parquet"
    frame = spark.createDataFrame([(*r, "en", len(r[1] or ""), *range(len(CLASHING))) for r in rows], "doc_id bigint, text string, source string, lang string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASHING))
    frame.repartition(3).write.parquet(path)

    sql = duckdb.connect()
    sql.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    sql.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, (_, t, s) in enumerate(rows)])
    good = sql.sql(f"SELECT doc_id FROM ({quality.OP2_SQL}) WHERE kept ORDER BY doc_id").fetchall()
    kept = [rows[i] for (i,) in good]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    kept = [kept[i] for i in sorted(one_of_each_component([t for _, t, _ in kept], 80))]
    kept = [(i, t, s) for (i, _, s), t in zip(kept, without_repeats([t.encode() for _, t, _ in kept], 51, 400), strict=True)]
    wanted = sorted((str(i), str(s), library.encode_ordinary(t)) for i, t, s in mixed_by_hand(kept))

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.source), r.ids) for r in found) == wanted and len(wanted) > 20
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in r.ids)).hexdigest() for r in found)

    docs, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, ""), f"test-{name}")
        assert docs.columns == frame.columns and docs.schema.simpleString() == frame.schema.simpleString(), name
        for r in docs.collect():
            assert list(r)[5:] == list(range(len(CLASHING))), name
            assert r.n_chars == len(r.text)
            seen.setdefault(name, []).append(r.doc_id)
    assert len(seen["near_duplicates"]) == len(kept) and None in seen["near_duplicates"]


def test_the_pipeline_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, source string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_of_equal_rows_stays_whatever_else_repeats(spark, docs):
    rows = [(7, "", "en"), (7, "", "de"), (8, "one two three four five six", "x"), (8, "one two three four five six", "y"), (9, "ONE two three four five six", "z")]
    found = {}
    for more in ([], [(8, "one two three four five six", "y")], [(8, "one two three four five six", "a")] * 300):
        kept = sorted((r.doc_id, r.source) for r in corpus_pipeline.near_duplicates(spark, docs(rows + more).repartition(4), "").collect())
        assert [x for x in kept if x[0] == 7] == [(7, "de"), (7, "en")] and [x[0] for x in kept] == [7, 7, 8]
        found[len(more)] = kept[2]
    assert found[0] == found[1]
