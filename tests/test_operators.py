"""Operators on hand-made boxes, tags and texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from formlens.functions import text as tx
from formlens.functions.geometry import Box, cell, clipped, iou, rotated
from formlens.operators import annotate, checked, convert, curate, detect, diversity, embeddings, evaluate, labels, links, subtokens, tokens
from formlens.sources import readers, sinks

BOXES = "doc_id int, category string, id int, x0 int, y0 int, x1 int, y1 int"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def box(*values):
    return Box(*[F.lit(v) for v in values])


def test_geometry(spark):
    row = one(spark, same=iou(box(0, 0, 2, 2), box(0, 0, 2, 2)), third=iou(box(0, 0, 2, 2), box(1, 0, 3, 2)), none=iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), edge=cell(box(770, 1048, 770, 1048))[0], x=clipped(box(0, 0, 800, 10), F.lit(770), F.lit(1048)).x1, y=clipped(box(0, 0, 700, 10), F.lit(770), F.lit(1048)).x1)
    assert (row.same, round(row.third, 6), row.none, row.edge, row.x, row.y) == (1.0, 0.333333, 0.0, 3, 769, 700)
    turned = one(spark, x0=F.round(rotated(box(0, 0, 10, 4), F.lit(90.0), F.lit(10), F.lit(4)).x0, 6), y1=F.round(rotated(box(0, 0, 10, 4), F.lit(90.0), F.lit(10), F.lit(4)).y1, 6))
    assert (turned.x0, turned.y1) == (3.0, 7.0)


def test_bin_edges_and_masks(spark):
    row = one(spark, a=diversity.bin_of(F.lit(0.3), 10), b=diversity.bin_of(F.lit(1.0), 10), c=diversity.bin_of(F.lit(1.1), 10), d=diversity.bin_of(F.lit(0.0), 10))
    assert (row.a, row.b, row.c, row.d) == (2, 9, None, 0)
    edges = one(spark, a=diversity.bin_of(F.lit(0.6), 10), b=diversity.bin_of(F.lit(0.7), 10), c=diversity.bin_of(F.lit(0.30000000000000004), 10), d=diversity.bin_of(F.lit(0.5), 10))
    assert (edges.a, edges.b, edges.c, edges.d) == (5, 6, 3, 5)
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10), (1, 760, 1040, 770, 1048), (2, 0, 0, 10, 10), (3, 5, 5, 6, 6)], "doc_id int, x0 int, y0 int, x1 int, y1 int")
    masks = diversity.by_document(boxes, ["doc_id"], spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id int"))
    assert {r.doc_id: (r.mask, r.cells) for r in masks.collect()} == {1: (32769, 12.5), 2: (1, 6.25), 3: (1, 6.25), 4: (0, 0.0)}
    assert diversity.uniqueness(masks).first().uniqueness == 50.0


def test_coverage_edges(spark):
    gt = spark.createDataFrame([(1, "a", 1, 0, 0, 10, 10), (1, "a", 2, 0, 0, 10, 10), (2, "a", 3, 0, 0, 10, 10), (3, "b", 4, 5, 5, 5, 9)], BOXES)
    pred = spark.createDataFrame([(1, "a", 1, 0, 0, 7, 10), (2, "a", 2, 0, 0, 6, 10), (4, "a", 5, 0, 0, 5, 5)], BOXES)
    found = {(r.doc_id, r.category): (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluate.per_class(gt, pred, ["doc_id"]).collect()}
    assert found == {(1, "a"): (2, 0, 0, 1.0, 1.0), (2, "a"): (0, 1, 1, 0.0, 0.0), (3, "b"): (0, 0, 1, 0.0, 0.0), (4, "a"): (0, 1, 0, 0.0, 1.0)}
    assert {r.doc_id: r.recall for r in evaluate.overall(gt, pred, ["doc_id"]).collect()}[4] == 0.0
    assert {r.category: (r.tp, r.fp, r.fn) for r in evaluate.pooled(gt, pred).collect()} == {"a": (3, 2, 0), "b": (0, 0, 1)}


def test_pooled_by_tiles_is_the_plain_join(spark):
    rng = random.Random(3)
    rows = lambda n: [(d, rng.choice("ab"), d, x, y, x + rng.randint(0, 90), y + rng.randint(0, 90)) for d in range(n) for x, y in [(rng.randint(0, 300), rng.randint(0, 300))]]
    g, p = rows(150), rows(150)
    covers = lambda a, b: (s := (a[5] - a[3]) * (a[6] - a[4])) > 0 and max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4])) / s >= 0.7
    want = {c: (sum(any(covers(x, y) for y in p if y[1] == c) for x in g if x[1] == c), sum(any(covers(x, y) for x in g if x[1] == c) for y in p if y[1] == c)) for c in "ab"}
    found = evaluate.pooled(spark.createDataFrame(g, BOXES), spark.createDataFrame(p, BOXES)).collect()
    assert {r.category: (r.tp, r.n_pred - r.fp) for r in found} == want


def test_matches_take_each_box_once(spark):
    rng = random.Random(5)
    rows = lambda n: [(i % 3, "a", i, x, y, x + 40, y + 40) for i in range(n) for x, y in [(rng.randint(0, 30), rng.randint(0, 30))]]
    g, p = rows(60), rows(60)
    share = lambda a, b: (i := max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))) / (3200 - i)
    want = {}
    for d in range(3):
        left, hits = [x for x in g if x[0] == d], 0
        for y in (y for y in p if y[0] == d):
            best = max(left, key=lambda x: share(x, y), default=None)
            if best and share(best, y) >= 0.7:
                left.remove(best)
                hits += 1
        want[d] = hits
    found = detect.matches(spark.createDataFrame(g, BOXES), spark.createDataFrame(p, BOXES), ["doc_id", "category"]).collect()
    assert {r.doc_id: r.tp for r in found} == want


@pytest.mark.parametrize("tile", [detect.TILE, 7])
def test_pooled_matches_are_the_plain_loop(spark, tile):
    """Over all images, with equal boxes, ties between different ones, boxes that are turned round, and classes of one side only."""
    rng = random.Random(9)
    spot = lambda: rng.choice([(0, 0), (0, 1), (1, 0), (2, 1), (1, 2), (40, 40), (41, 40), (40, 42), (300, 7)])
    rows = lambda n, classes: [(rng.randrange(9), rng.choice(classes), i, x, y, x + rng.choice([10, 12]), y + rng.choice([10, 12])) for i in range(n) for x, y in [spot()]] + [(3, "a", 900, 9, 9, 5, 5)]
    g, p = rows(300, "abc"), rows(320, "abd")
    area = lambda a: (a[5] - a[3]) * (a[6] - a[4])
    common = lambda a, b: max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
    want = {}
    for c in "abcd":
        left, mine, tp = sorted(x for x in g if x[1] == c), sorted(x for x in p if x[1] == c), 0
        sizes = len(left), len(mine)
        for y in mine:
            best = max(left, key=lambda x: common(x, y) / u if (u := area(x) + area(y) - common(x, y)) else 0.0, default=None)
            if best and common(best, y) and common(best, y) / (area(best) + area(y) - common(best, y)) >= 0.6:
                left.remove(best)
                tp += 1
        want[c] = (*sizes, tp)
    found = detect.pooled(spark.createDataFrame(g, BOXES).repartition(3), spark.createDataFrame(p, BOXES).repartition(3), ["doc_id"], 0.6, tile).collect()
    assert {r.category: (r.n_gt, r.n_pred, r.tp) for r in found} == want and want["a"][2] > 20
    with pytest.raises(ValueError):
        detect.pooled(spark.createDataFrame(g, BOXES), None, ["doc_id"], 0.0)


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (9, 5), (5, 3)]
    found = {r.node: r.root for r in links.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {7: 7, 9: 3, 5: 3, 3: 3}


def test_pieces_are_the_longest_that_fit(spark):
    rng = random.Random(1)
    vocabulary = ["ab", "abc", "bca", "c", "ü", "a.b", "(("]
    words = ["".join(rng.choice("abcüx.(🙂\n") for _ in range(rng.randrange(14))) for _ in range(60)] + ["", None]

    def cut(word):
        out = []
        while word:
            out.append(max((p for p in [*vocabulary, word[0]] if word.startswith(p)), key=len))
            word = word[len(out[-1]) :]
        return out

    table = spark.createDataFrame([(1, i, w, "B-vin" if i % 3 else "B-other") for i, w in enumerate(words)], "doc int, idx int, token string, tag string")
    rows = subtokens.encoded(table, ["doc"], "tag", vocabulary)
    found = {}
    for r in rows.orderBy("idx").collect():
        found.setdefault(r.word_id, []).append((r.piece, r.label))
    assert {i: [x for x, _ in v] for i, v in found.items()} == {i: cut(w) for i, w in enumerate(words) if w}
    assert all(v[0][1] == (tx.TAGS.index("B-vin") if i % 3 else subtokens.IGNORE) and {x for _, x in v[1:]} <= {subtokens.IGNORE} for i, v in found.items())
    assert subtokens.counted(rows).count() == sum(bool(w) and i % 3 > 0 for i, w in enumerate(words))
    assert {r.n_pieces for r in subtokens.sizes(table).filter("coalesce(token, '') = ''").collect()} == {0}
    assert spark.range(1).select(subtokens.label_name(F.lit(-100)), subtokens.label_name(F.lit(99)), subtokens.label_name(subtokens.label_id(F.lit("I-address")))).first()[:] == (None, None, "I-address")


def test_chunks_leave_an_empty_one_before_a_large_word(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([7, 2, 2, 1, 5])], "doc_id int, idx int, n int")
    assert [r.chunk for r in annotate.chunks(rows, ["doc_id"], "n", 5).orderBy("idx").collect()] == [1, 2, 2, 2, 3]


def test_spans_and_tags(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["B-a", "I-a", "I-b", "O", "I-b", "B-b"])], "doc_id int, idx int, tag string")
    assert sorted((r.category, r.start, r.end) for r in annotate.spans(rows, ["doc_id"]).collect()) == [("a", 0, 1), ("b", 2, 2), ("b", 4, 4), ("b", 5, 5)]
    row = one(spark, a=tx.category(F.lit("x-y")), b=tx.label_name(F.lit("O")), c=tx.stem_before_last(F.lit("a_b_1.png")), d=tx.stem_before_last(F.lit("plain")), e=tx.argmax(F.array(F.lit(1), F.lit(5), F.lit(5))))
    assert tuple(row) == ("x-y", "other", "a_b", "", 1)


def test_matching_and_tagging(spark):
    words = spark.createDataFrame([(1, i, w, 10 * i, 0, 10 * i + 9, 8, 0, i // 3) for i, w in enumerate("the Ada Stone met ada stone".split())], "doc_id int, idx int, token string, x0 int, y0 int, x1 int, y1 int, block int, line int")
    entities = spark.createDataFrame([(1, "full_name", "Ada Stone"), (1, "address", "Nowhere"), (1, "signature", "x")], "doc_id int, entity_type string, value string")
    found = annotate.matched(words, entities, "doc_id")
    assert [r.tag for r in annotate.tagged(words, found, "doc_id").orderBy("idx").collect()] == ["O", "B-full_name", "I-full_name", "O", "B-full_name", "I-full_name"]
    assert {(r.first, r.idx) for r in annotate.fuzzy_matched(words, entities, ["doc_id"]).collect()} == {(1, 1), (1, 2), (4, 4), (4, 5)}
    pages = spark.createDataFrame([(1, "the Ada Stone met Nowhere")], "doc_id int, text string")
    assert [(r.value, r.in_text) for r in annotate.unmatched(entities, found, pages, "doc_id").collect()] == [("Nowhere", True)]


def alike_by_hand(a, b):
    """The rule for words that are alike, by plain loops."""
    if a == b:
        return True
    a, b = (re.sub(r"[^\w]", " ", x.lower()).strip() for x in (a, b))
    if not a or not b or 2 * max(len(a), len(b)) >= 3 * min(len(a), len(b)):
        return False
    x, y = set(a.split()), set(b.split())
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (c == d)))
        row = new
    return x <= y or y <= x or 1000 * (len(a) + len(b) - 2 * row[-1]) < 55 * (len(a) + len(b))


def test_fuzzy_occurrences_are_those_of_plain_loops(spark):
    rng = random.Random(2)
    stems = ["Smith", "smith,", "O'Neil", "oneil", "12-34", "34-12", "12", "-", "Donaudampfschifffahrt", "Donaudampfschiffahrt", "Donaudampfschifffahrd", "internationalisation", "internationalization", "ínternationalizations", "a_b", "a-b", "Müller-Lüdenscheidt", "Mueller-Luedenscheidt", "x" * 60, "x" * 57 + "y", "x" * 57 + "yyy", "abcdefghijklmnopqrstuvwxyzabcdefghijklmn", "abcdefghijklmnopqrtsuvwxyzabcdefghijklmn"]
    pages = {p: [rng.choice(stems) for _ in range(40)] for p in range(6)}
    entities = [(p, pos, rng.choice(["first_name", "address", "company_name"]), " ".join(rng.choice(stems) for _ in range(rng.choice([1, 1, 2, 2, 3])))) for p in pages for pos in range(12)] + [(0, 50, "address", "  "), (1, 51, "address", None)]
    want = set()
    for p, pos, kind, value in entities:
        parts = (value or "").split()
        for first in range(len(pages[p]) - len(parts) + 1):
            if parts and all(alike_by_hand(t, w) for t, w in zip(pages[p][first:], parts, strict=False)):
                want |= {(p, pos, kind, first, first + k) for k in range(len(parts))}
    words = spark.createDataFrame([(p, i, t) for p, ts in pages.items() for i, t in enumerate(ts)], "page int, idx int, token string")
    wanted = spark.createDataFrame(entities, "page int, pos int, entity_type string, value string")
    found = labels.occurrences(words, wanted, "page", fuzzy=True)
    assert {(r.page, r.pos, r.entity_type, r.first, r.idx) for r in found.collect()} == want and len(want) > 100

    tags = {}
    for p, pos, kind, first, idx in sorted(want):  # in the order of entities, names never write over others
        tag = ("B-" if first == idx else "I-") + ("full_name" if kind == "first_name" else kind)
        if kind != "first_name" or (p, idx) not in tags:
            tags[p, idx] = tag
    assert {(r.page, r.idx): r.tag for r in labels.tags_in_order(found, "page").collect()} == tags


@pytest.mark.parametrize("kind", ["spread", "equal", "ties", "one"])
def test_quantiles_of_all_pairs_are_exact(spark, kind):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = {"spread": rng.normal(size=(90, 5)) * 10.0 ** rng.integers(-8, 9, (90, 1)), "equal": np.ones((30, 3)), "ties": rng.integers(0, 2, (60, 3)).astype(float), "one": np.ones((1, 3))}[kind]
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(rows)], "vec_id long, label int, embedding array<double>")
    shares = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    pairs = [np.sqrt(((a - b) ** 2).sum()) for i, a in enumerate(rows) for b in rows[:i]]
    want = [pytest.approx(x, rel=1e-12) for x in np.quantile(pairs, shares)] if pairs else [None] * 6
    assert embeddings.pair_quantiles(table, shares) == want


def odd_vectors(kind):
    import numpy as np

    rng = np.random.default_rng(5)
    unit = rng.normal(size=(300, 6))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    holes = lambda value: np.where(rng.random((300, 6)) < 0.01, value, unit)
    return {"spread": unit, "far": unit + 1e4, "copies": np.concatenate([unit[:200], np.repeat(unit[:3], 90, axis=0)]), "ties": rng.integers(0, 3, (300, 4)).astype(float), "tiny": unit * 1e-160, "huge": unit * 1e160, "endless": holes(np.inf), "none": holes(np.nan)}[kind]


@pytest.mark.parametrize("kind", ["spread", "far", "copies", "ties", "tiny", "huge", "endless", "none"])
def test_quantiles_by_blocks_and_rounds_are_exact(spark, monkeypatch, kind):
    import numpy as np

    from formlens.operators import pair_counts

    monkeypatch.setattr(pair_counts, "BLOCK_ROWS", 64)
    monkeypatch.setattr(pair_counts, "LISTED", 500)
    rows = odd_vectors(kind)
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(rows)] + [(None, 0, [9.0] * rows.shape[1]), (9999, 0, None)], "vec_id long, label int, embedding array<double>").repartition(3)
    assert pair_counts.packed(table).count() > 1
    with np.errstate(all="ignore"):
        pairs = np.sort(np.concatenate([np.sqrt(((rows[i + 1 :] - x) ** 2).sum(1)) for i, x in enumerate(rows)]))
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    places = [s * (len(pairs) - 1) for s in shares]
    near = [(pairs[int(p)], pairs[min(int(p) + 1, len(pairs) - 1)], p % 1) for p in places]
    want = [a if a == b or not rest else a + (b - a) * rest for a, b, rest in near]
    assert embeddings.pair_quantiles(table, shares) == [pytest.approx(x, rel=1e-12, nan_ok=True) for x in want]


@pytest.mark.parametrize("kind", ["spread", "copies", "endless"])
def test_vectors_of_one_id_are_no_pair(spark, monkeypatch, kind):
    import numpy as np

    from formlens.operators import pair_counts

    monkeypatch.setattr(pair_counts, "LISTED", 500)
    rows = odd_vectors(kind)
    ids = [i // 40 if i < 120 else i % 170 for i in range(len(rows))]
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in zip(ids, rows, strict=True)], "vec_id long, label int, embedding array<float>")
    with np.errstate(all="ignore"):
        single = rows.astype(np.float32).astype(float)
        pairs = np.sort([np.sqrt(((single[i] - single[j]) ** 2).sum()) for i in range(len(rows)) for j in range(i) if ids[i] != ids[j]])
    assert embeddings.pair_quantiles(table, (0.0, 1.0)) == [pytest.approx(x, rel=1e-12, nan_ok=True) for x in pairs[[0, -1]]]
    middle = (len(pairs) - 1) // 2
    assert embeddings.pair_quantiles(table, (middle / (len(pairs) - 1),))[0] == pytest.approx(pairs[middle], rel=1e-6)
    assert embeddings.pair_quantiles(table.withColumn("vec_id", F.lit(1))) == [None] * 3


@pytest.mark.parametrize("last, said", [([1.0], "different lengths"), ([1.0, None], "null component")])
def test_quantiles_take_no_broken_vectors(spark, last, said):
    table = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [0.0, 2.0]), (3, 0, last)], "vec_id long, label int, embedding array<double>").repartition(1)
    with pytest.raises(Exception, match=said):
        embeddings.pair_quantiles(table)


def test_a_wrong_guess_changes_no_quantile(spark, monkeypatch):
    import numpy as np

    from formlens.operators import pair_counts

    rows = odd_vectors("spread")
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(rows)], "vec_id long, label int, embedding array<double>")
    want = embeddings.pair_quantiles(table)
    at = lambda x: int(np.array(x).view(np.int64))
    monkeypatch.setattr(pair_counts, "LISTED", 500)
    monkeypatch.setattr(pair_counts, "guessed", lambda held, blocks, n, shares: {s: (at(0.1 + s), at(0.11 + s), n) if s < 0.6 else (at(1.99), at(1.999), n) for s in shares})
    assert embeddings.pair_quantiles(table) == want


def test_quantiles_shuffle_vectors_once(spark):
    import numpy as np

    rows = np.random.default_rng(1).normal(size=(2500, 64))
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(rows)], "vec_id long, label int, embedding array<double>")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    found = embeddings.pair_quantiles(table)
    assert 0 < written() - before < 4 * rows.nbytes
    pairs = np.concatenate([np.sqrt(((rows[i + 1 :] - x) ** 2).sum(1)) for i, x in enumerate(rows)])
    assert found == [pytest.approx(x, rel=1e-12) for x in np.quantile(pairs, (0.25, 0.5, 0.75))]


def test_joins_that_check(spark):
    files = lambda *ids: spark.createDataFrame([(i, None) for i in ids], "doc int, more string")
    boxes = lambda *ids: spark.createDataFrame([(i, i * 10) for i in ids], "doc int, x int")
    ids = lambda df: sorted(r.doc for r in df.collect())
    gt, pred = checked.evaluated(boxes(1, 1, 2, 3), boxes(2, 3, 3), files(1, 2, 3, 4), files(2, 3, 4), "doc")
    assert (ids(gt), ids(pred)) == ([2, 3], [2, 3, 3])
    gt, pred = checked.evaluated(boxes(1, 2), boxes(2, 9), files(1, 2), files(2, 9), "doc")
    with pytest.raises(Exception, match="no annotation for 9"):
        pred.collect()
    gt, pred = checked.evaluated(boxes(1, 2), boxes(2, 9), files(1, 2), files(2, 9), "doc", led_by="gt")
    assert (ids(gt), ids(pred)) == ([2], [2])
    assert checked.required(files(None, 1), files(1, None), "doc").columns == ["doc", "more"]
    with pytest.raises(Exception, match="for null"):
        checked.required(files(None), files(1), "doc").collect()
    assert {tuple(r) for r in checked.missing_files(files(1, 2), files(2, 3, 3), "doc").collect()} == {(1, "label"), (3, "image")}
    with pytest.raises(ValueError):
        checked.evaluated(gt, pred, gt, pred, "doc", led_by="both")


def test_file_rules_count_and_stop(spark):
    good = (1, ["a", "b"], [[0, 0, 5, 5], [0, 0, 1000, 1000]], ["O", "B-vin"])
    bad = [(2, ["a"], [], ["O"]), (3, ["a"], [[0, 0, 5, 5]], ["B-signature"]), (4, ["a"], [[0, 0, 5, 5]], ["I-middle_name"]), (5, ["a"], [[0, 0, 5, 1001]], [None]), (6, ["a"], [[9, 0, 5, 5]], ["O"]), (7, ["a"], [[0, 0, 5]], ["O"]), (8, None, None, None), (9, [], [], [])]
    table = spark.createDataFrame([good, *bad], "doc int, tokens array<string>, bboxes array<array<int>>, ner_tags array<string>")
    want = {"equal_lengths": 2, "no_signature": 2, "no_middle_name": 2, "boxes_inside": 4}
    rules = checked.file_rules()
    assert {r.rule: r.n_failed for r in checked.rule_counts(table, rules).collect()} == want
    rows, seen = checked.observed(table, rules)
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_files": 9} | want
    assert checked.strict(table.filter("doc IN (1, 9)"), rules, "doc").count() == 2
    with pytest.raises(Exception, match="no_signature is broken by 3"):
        checked.strict(table.filter("doc IN (1, 3)"), rules, "doc").collect()


@pytest.mark.parametrize("parts", [checked.HASH_PARTS, 3])
def test_samples_have_the_exact_size(spark, parts, monkeypatch):
    import hashlib

    monkeypatch.setattr(checked, "HASH_PARTS", parts)
    rows = [(i, "hot" if i % 3 else None if i % 5 else "few", i % 7) for i in range(900)]
    table = spark.createDataFrame(rows, "id int, kind string, part int").repartition(5)
    by = lambda i: (hashlib.md5(f"s:{i}".encode()).hexdigest()[:8], i)
    for size in (0, 50, 60, 5000):
        want = {i for kind in ("hot", None, "few") for i in sorted((i for i, k, _ in rows if k == kind), key=by)[:size]}
        found = checked.exact_samples(table, "kind", "id", size, "s")
        assert found.columns == table.columns and {r.id for r in found.collect()} == want
        assert all(r.part == r.id % 7 for r in found.collect())
    assert {r["count"] for r in checked.equal_samples(table, "kind", "id").groupBy("kind").count().collect()} == {60}
    assert checked.equal_samples(table.limit(0), "kind", "id").count() == 0


def tagged_by_hand(words, entities):
    """Tags by plain loops: entities in order, a later one writes over others, a name only where nothing is."""
    low, tags = [(w or "").lower() for w in words], ["O"] * len(words)
    for _, kind, value in sorted({(pos, kind, value.lower()) for pos, kind, value in entities if kind and (value or "").split()}):
        parts = value.split()
        hits = [i for i in range(len(low)) if low[i : i + len(parts)] == parts]
        name, free = kind in labels.NAMES, [t == "O" for t in tags]
        for i in reversed(hits) if name else hits:
            for k in range(len(parts)):
                if free[i + k] or not name:
                    tags[i + k] = ("I-" if k else "B-") + ("full_name" if name else kind)
    return tags


def test_label_files_are_those_of_plain_loops(spark):
    rng = random.Random(4)
    kinds = ["first_name", "last_name", "address", "company_name"]
    pages = {p: [rng.choice(["a", "A", "b", "c", None] if p % 2 else ["a", "a", "B"]) for _ in range(rng.choice([1, 7, 40]))] for p in range(40)} | {50: [], 51: ["a"] * 400}
    entities = [(p, pos, rng.choice(kinds), " ".join(rng.choice("abcA") for _ in range(rng.choice([1, 1, 2, 3])))) for p in pages for pos in range(rng.choice([0, 2, 5]))]
    entities += [*entities[:20], (51, 9, "address", "a a a"), (0, 7, None, "a"), (1, 7, "address", None), (2, 7, "address", "  "), (99, 0, "address", "a"), (None, 0, "address", "a")]
    box = lambda i: [i, 0, i + 3, 9]
    pages[52] = ['quote " and \\ \n\t\x01', "", "é\u2028漢😀", "a", "null", "[1]"]
    files = spark.createDataFrame([*[(p, ws, [box(i) for i in range(len(ws))], "more") for p, ws in pages.items()], (None, ["a"], [box(1)], "more"), (60, None, None, "more")], "page int, tokens array<string>, bboxes array<array<int>>, wanted string")
    wanted = spark.createDataFrame(entities, "page int, pos int, entity_type string, value string")
    images = spark.createDataFrame([(p, pos, pos, 1, 200, 3) for p in (0, 3, 70) for pos in (0, 1)], "page int, pos int, x0 int, y0 int, x1 int, y1 int")
    arrays = files.select("*", *tokens.sides(F.col("bboxes")))
    found = labels.label_files(arrays, wanted, images, (100, 100), "page")
    assert found.columns == ["page", "idx", "token", "x0", "y0", "x1", "y1", "tag"]
    by_page = {}
    for r in sorted(map(tuple, found.collect()), key=lambda r: (r[0] is None, r[:2])):
        by_page.setdefault(r[0], []).append(r[1:])
    assert set(by_page) == {*pages, None, 70} - {50}
    assert by_page[None] == [(0, "a", 1, 0, 4, 9, "O")] and by_page[70] == [(0, "[SIGNATURE]", 1, 1, 99, 3, "B-signature")]
    for p, ws in pages.items():
        tags = tagged_by_hand(ws, [e[1:] for e in entities if e[0] == p])
        want = [(i, w, i, 0, min(i + 3, 99) if i > 97 else i + 3, 9, t) for i, (w, t) in enumerate(zip(ws, tags, strict=True))]
        assert by_page.get(p, []) == want + [(len(ws), "[SIGNATURE]", 1, 1, 99, 3, "B-signature")] * (p in (0, 3))
    words = tokens.exploded(files.filter("page IS NOT NULL").withColumn("ner_tags", F.col("tokens")), "page")
    for pictures in (None, images):
        rows, again = (made(given, wanted, pictures, (100, 100), "page").filter("page <> 70").collect() for made, given in ((labels.label_rows, words), (labels.label_files, arrays)))
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert labels.label_files(arrays.limit(0), wanted.limit(0), None, (100, 100), "page").collect() == []


def test_page_files_are_the_laid_out_words(spark, docs):
    table = docs([(1, " ".join(f"w{i % 13}" * (i % 3 + 1) for i in range(700)), "s"), (2, " \n ", "s"), (3, None, "s"), (4, "one", None), (4, "one", None)])
    rows = tokens.exploded(tokens.page_files(table, "source").select("*", tokens.boxed().alias("bboxes"), F.col("tokens").alias("ner_tags")), "doc_id", "page", "source").drop("tag")
    want = tokens.laid_out(table, "source").drop("i").select(rows.columns)
    in_order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert in_order(rows) == in_order(want) and rows.count() == 702


def test_first_pieces_give_words_back(spark):
    words = spark.createDataFrame([(1, 0, "interesting", "B-address"), (1, 1, "a", "O"), (1, 2, "", "O"), (1, 3, None, "O"), (2, 0, "ing", "unknown"), (2, 0, "xx", "O")], "page int, idx int, token string, tag string")
    rows = subtokens.encoded(words, ["page"])
    found = subtokens.first_pieces(rows)
    assert sorted((r.page, r.word_id, r.piece, subtokens.TAGS[r.label] if r.label >= 0 else None) for r in found.collect()) == [(1, 0, "inter", "B-address"), (1, 1, "a", "O"), (2, 0, "ing", None), (2, 0, "x", "O")]
    assert rows.count() > found.count() and subtokens.first_pieces(rows.limit(0)).collect() == []


def test_repeated_entities_count_once(spark):
    words = spark.createDataFrame([(1, i, t) for i, t in enumerate("a b a b".split())], "page int, idx int, token string")
    entities = spark.createDataFrame([(1, 0, "address", "a b")] * 2, "page int, pos int, entity_type string, value string")
    for fuzzy in (False, True):
        found = labels.occurrences(words, entities, "page", fuzzy=fuzzy)
        assert sorted((r.first, r.idx) for r in found.collect()) == [(0, 0), (0, 1), (2, 2), (2, 3)]


def test_label_rows_have_signatures_and_clipped_boxes(spark):
    words = spark.createDataFrame([(1, 0, "Ada", 5, 5, 30, 20), (1, 1, "Stone", 90, 5, 130, 20), (2, 0, "none", 0, 0, 9, 9)], "page int, idx int, token string, x0 int, y0 int, x1 int, y1 int")
    entities = spark.createDataFrame([(1, 0, "first_name", "ada"), (1, 1, "last_name", "ada stone"), (3, 0, "address", "x")], "page int, pos int, entity_type string, value string")
    images = spark.createDataFrame([(1, 0, 1, 1, 2, 2), (1, 3, 10, 90, 50, 140)], "page int, pos int, x0 int, y0 int, x1 int, y1 int")
    found = [tuple(r) for r in labels.label_rows(words, entities, images, (100, 100), "page").orderBy("page", "idx").collect()]
    assert found == [(1, 0, "Ada", 5, 5, 30, 20, "B-full_name"), (1, 1, "Stone", 90, 5, 99, 20, "I-full_name"), (1, 2, "[SIGNATURE]", 10, 90, 50, 99, "B-signature"), (2, 0, "none", 0, 0, 9, 9, "O")]
    assert labels.label_rows(words, entities.limit(0), None, (100, 100), "page").filter("tag <> 'O'").isEmpty()


def test_signature_rows_are_dropped_and_counted_anew(spark):
    rows = spark.createDataFrame([(1, 0, "B-signature"), (1, 1, "B-iban"), (1, 2, "I-dates")], "doc_id int, idx int, tag string")
    assert [(r.idx, r.tag) for r in curate.curated(curate.without_signatures(rows, "doc_id")).orderBy("idx").collect()] == [(0, "B-payment_information"), (1, "O")]


def test_malformed_answers_give_nothing(spark):
    words = spark.createDataFrame([(1, 0, "a", 0, 0, 1, 1), (2, 0, "b", 0, 0, 1, 1)], "doc_id int, idx int, token string, x0 int, y0 int, x1 int, y1 int")
    answers = spark.createDataFrame([(1, '```json\n{"entities":[{"id":0,"word":"a","label":"company name"},{"id":9,"word":"z","label":"x"}]}\n```'), (2, '{"entities":[{')], "doc_id int, answer string")
    assert [(r.doc_id, r.tag) for r in convert.from_answers(answers, words, "doc_id").collect()] == [(1, "B-company_name")]


def test_files_round_trip(spark, tmp_path):
    labelled = spark.createDataFrame([("d1", ["a", "b"], [[0.0, 0.0, 1.0, 1.0]] * 2, ["O", "B-vin"])], f"doc_id string, {readers.TOKEN_LABELS}")
    sinks.token_labels(labelled, f"{tmp_path}/labels")
    assert readers.token_labels(spark, f"{tmp_path}/labels").first().ner_tags == ["O", "B-vin"]
    (tmp_path / "pool.json").write_text('{"iban": ["x", "y"]}')
    assert readers.value_pool(spark, f"{tmp_path}/pool.json").count() == 2
    assert readers.value_pool(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "boxes").mkdir()
    (tmp_path / "boxes/p1.txt").write_text("3.0 1 2 3 4\n\n0 5 6 7 8\n")
    assert sorted(r.cls for r in convert.detection_lines(readers.detection_text(spark, f"{tmp_path}/boxes")).collect()) == [0, 3]
    (tmp_path / "entities").mkdir()
    (tmp_path / "entities/p1.json").write_text('[["iban", "X1", [1, 2.5, 3, 4]]]')
    assert readers.entity_labels(spark, f"{tmp_path}/entities").first().y0 == 2.5


def test_label_stream_adds_up(spark, tmp_path):
    from formlens.operators.tokens import exploded
    from formlens.streaming import labels

    rows = [(f"d{i}", ["a", "b"], [[0.0, 0.0, 10.0, 10.0], [20.0, 0.0, 30.0, 10.0]], ["B-vin", "O"]) for i in range(4)]
    labelled = spark.createDataFrame(rows, f"doc_id string, {readers.TOKEN_LABELS}")
    entities = lambda df: evaluate.entities(exploded(df, "doc_id").withColumn("i", F.col("idx")), ["doc_id"])
    sinks.token_labels(labelled.repartition(2), f"{tmp_path}/in")
    query = labels.keep_counts(labels.label_stream(spark, f"{tmp_path}/in"), entities(labelled), entities, f"{tmp_path}/counts", f"{tmp_path}/checkpoint")
    query.awaitTermination(60)
    row = labels.so_far(spark, f"{tmp_path}/counts").first()
    assert (row.tp, row.fp, row.fn) == (4, 0, 0)


@pytest.mark.parametrize("parts", [1, 7])
def test_results_hold_for_any_partitions(spark, parts):
    from formlens.operators import embeddings

    rng = random.Random(2)
    rows = spark.createDataFrame([(i, i % 3, [rng.random() for _ in range(4)]) for i in range(30)], "vec_id bigint, label int, embedding array<float>").repartition(parts)
    import numpy as np

    v = np.array([r.embedding for r in rows.orderBy("vec_id").collect()])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))[np.triu_indices(30, 1)]
    assert embeddings.intradiversity(rows).first().intradiversity == pytest.approx(d.mean(), abs=1e-9)


def test_both_sides_in_one_pass_are_the_two(spark):
    tags = [("B-a", "B-a"), ("O", "I-b"), ("I-b", "O"), ("O", "O"), ("B-b", None), ("B-a", "B-b")]
    rows = spark.createDataFrame([(d, i, 10 * i, 0, 10 * i + 9, 8, t, p, i % 2) for d in (1, 2) for i, (t, p) in enumerate(tags)], "doc_id int, i int, x0 int, y0 int, x1 int, y1 int, tag string, pred_tag string, shift int")
    two = evaluate.entities(rows, ["doc_id"]), evaluate.entities(rows, ["doc_id"], "pred_tag", "shift")
    one_pass = evaluate.both_sides(rows, ["doc_id"], shift="shift")
    rows_of = lambda df: sorted(map(str, df.collect()))
    assert rows_of(evaluate.sided(one_pass, None, ["doc_id", "category"])) == rows_of(evaluate.sided(*two, ["doc_id", "category"]))
    counts = evaluate.nested_counts(*two, ["doc_id"])
    columns = ["doc_id", "category", "n_gt", "n_pred", "tp", "correct"]
    apart = evaluate.counted(*two, ["doc_id", "category"]).select(columns).unionByName(evaluate.counted(*two, ["doc_id"]).withColumn("category", F.lit(None).cast("string")).select(columns))
    assert rows_of(counts.select(columns)) == rows_of(apart)
    assert evaluate.nested_counts(*[x.filter("doc_id > 9") for x in two], ["doc_id"]).count() == 0


def test_runs_pass_over_missing_tags(spark):
    rows = spark.createDataFrame([(1, 0, "B-a", "I-a"), (1, 1, None, "O"), (1, 2, "I-a", "I-a")], "doc_id int, idx int, tag string, pred_tag string")
    assert [(r.start, r.end) for r in annotate.spans(rows, ["doc_id"]).collect()] == [(0, 2)]
    found = {r.category: (r.precision, r.recall, r.support) for r in annotate.sequence_metrics(rows, ["doc_id"]).collect()}
    assert found == {"a": (0.0, 0.0, 1), "all": (0.0, 0.0, 1)}
