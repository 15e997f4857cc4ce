"""Operators with an exact answer, against brute force; and their results on odd input."""

import json
import random

import numpy as np
import pytest

from colloquy.functions.words import words
from colloquy.llm import encode, formatting, leaks, overlap

INTENTS = "id string, text string, label string, split string, source string, attrs string, h string, key string, words int, cls string"
HELD = "id string, query string, specialty string, expected_keyword string, split string, source string, attrs string, lead long, n int"


def intents(spark, rows):
    """Rows of (id, text, label, split, attrs), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, label, split, "src", attrs, "h", "key", 1, "cls") for i, t, label, split, attrs in rows], INTENTS)


def held(spark, rows):
    return spark.createDataFrame([(i, q, s, k, "test", "src", a, 1, 2) for i, q, s, k, a in rows], HELD)


# ---- overlap


def brute_pairs(train, evals):
    out = set()
    for i, a in evals:
        for j, b in train:
            x, y = words(a), words(b)
            if i and j and i != j and min(len(x), len(y)) >= 6 and overlap.distance(x, y) <= 2:
                out.add((min(i, j), max(i, j)))
    return out


def edited(rnd, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        at = rnd.randrange(len(ws) + 1)
        kind = rnd.randrange(3)
        if kind == 0:
            ws.insert(at, rnd.choice("abcdefgh"))
        elif ws and kind == 1:
            del ws[min(at, len(ws) - 1)]
        elif ws:
            ws[min(at, len(ws) - 1)] = rnd.choice("abcdefgh")
    return ws


@pytest.mark.parametrize("hot", [overlap.HOT, 3, 0])
def test_overlap_equals_brute_force(spark, monkeypatch, hot):
    """Also when every lead counts as hot, so that pairs come by the later levels."""
    monkeypatch.setattr(overlap, "HOT", hot)
    rnd = random.Random(hot)
    base = [[rnd.choice("abcdefgh") for _ in range(rnd.randrange(5, 14))] for _ in range(25)]
    texts = [" ".join(edited(rnd, rnd.choice(base), rnd.randrange(4))) for _ in range(160)]
    rows = [(f"i{k}", t, "l", rnd.choice(["train", " Train", "dev", "TEST", None, "other"]), None) for k, t in enumerate(texts[:120])]
    rows += rows[:10] + [("n1", None, None, "train", None), ("n2", "", "x", "train", None), (None, texts[0], "x", "dev", None)]
    queries = [(f"e{k}", t.upper() + " !", None, None, None) for k, t in enumerate(texts[120:])] + [("e0", None, None, None, None)]
    split = lambda s: (s or "").strip().lower()
    train = [(i, t) for i, t, _, s, _ in rows if split(s) == "train"]
    evals = [(i, t) for i, t, _, s, _ in rows if split(s) in ("dev", "test")] + [(i, q) for i, q, *_ in queries]
    got = {tuple(r) for r in overlap.found(intents(spark, rows), held(spark, queries)).collect()}
    assert got == brute_pairs(train, evals) and len(got) > 20


@pytest.mark.parametrize("crowded", [overlap.CROWDED, 40, 3, 0])
def test_covered_words_equal_brute_force(spark, monkeypatch, crowded):
    """Pairs and covered words, also when prefixes are hot and split deeper."""
    monkeypatch.setattr(overlap, "CROWDED", crowded)
    rnd = random.Random(7)
    base = [["common", "start", "of", "all", "texts", "here", *(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 30)))] for _ in range(12)]
    texts = [" ".join(edited(rnd, rnd.choice(base), rnd.randrange(6))) for _ in range(120)]
    rows = [(f"i{k}", t, "l", rnd.choice(["train", "dev"]), None) for k, t in enumerate(texts[:90])]
    queries = [(f"e{k}", t, None, None, None) for k, t in enumerate(texts[90:])]
    train = [words(t) for _, t, _, s, _ in rows if s == "train"]
    evals = [(i, t) for i, t, _, s, _ in rows if s == "dev"] + [(i, q) for i, q, *_ in queries]
    spans = {tuple(t[k : k + overlap.SPAN]) for t in train if len(t) >= overlap.LEAST_WORDS for k in range(len(t) - overlap.SPAN + 1)}
    want = set()
    for i, t in evals:
        ws = words(t)
        if len(ws) >= overlap.LEAST_WORDS:
            hit = {p for k in range(len(ws) - overlap.SPAN + 1) if tuple(ws[k : k + overlap.SPAN]) in spans for p in range(k, k + overlap.SPAN)}
            want.add((i, len(ws), len(hit)))
    assert {tuple(r) for r in overlap.covered(intents(spark, rows), held(spark, queries)).collect()} == want and sum(n for *_, n in want) > 50
    got = {tuple(r) for r in overlap.found(intents(spark, rows), held(spark, queries)).collect()}
    assert got == brute_pairs([(i, t) for i, t, _, s, _ in rows if s == "train"], evals)
    report = overlap.report(intents(spark, rows), held(spark, queries)).agg({"n_covered": "sum", "n_links": "sum"}).first()
    assert set(report) == {sum(n for *_, n in want), sum((a in dict(evals)) + (b in dict(evals)) for a, b in got)}


def test_cool_prefixes_stay_whole_beside_a_hot_one(spark, monkeypatch):
    """splitting off a hot prefix must not spread the suffixes of the other prefixes over several tasks."""
    monkeypatch.setattr(overlap, "CROWDED", 40)
    texts = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(200)]
    hot = [(f"h{k}", f"common start h{k} " + " ".join(f"h{k}y{j}" for j in range(6)), None, "train", None) for k in range(60)]
    rows = [(f"i{k}", t, "l", "train", None) for k, t in enumerate(texts)] + hot
    queries = [(f"e{k}", f"{t} more", None, None, None) for k, t in enumerate(texts)]
    # Classes in as many partitions as cores, as of larger tables: suffixes come without a shuffle in between.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in overlap.found(intents(spark, rows), held(spark, queries)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(f"e{k}", f"i{k}") for k in range(200)}


def test_common_prefixes():
    import numpy as np

    keys = np.zeros((4, overlap.DEPTH), np.uint32)
    keys[0, :3], keys[1, :4], keys[2, :2], keys[3] = [1, 2, 3], [1, 2, 3, 4], [1, 9], 7
    assert overlap.common_prefixes(keys, np.array([3, 4, 2, overlap.DEPTH])).tolist() == [0, 3, 1, 0]
    assert overlap.common_prefixes(keys[:0], np.zeros(0, int)).tolist() == []


def test_leads_never_miss():
    rnd = random.Random(5)
    for _ in range(1500):
        a = [rnd.choice("abcd") for _ in range(rnd.randrange(6, 20))]
        b = edited(rnd, a, rnd.randrange(3))
        if len(b) >= 6 and overlap.distance(a, b) <= 2:
            for count in overlap.LEVELS:
                assert set(overlap.train_leads(a, count)) & set(overlap.eval_leads(b, count))


def test_distance():
    full = lambda a, b: min((full(a[1:], b) + 1, full(a, b[1:]) + 1, full(a[1:], b[1:]) + (a[0] != b[0]))) if a and b else len(a) + len(b)
    rnd = random.Random(1)
    for _ in range(400):
        a, b = [rnd.choice("ab") for _ in range(rnd.randrange(6))], [rnd.choice("ab") for _ in range(rnd.randrange(6))]
        assert overlap.distance(a, b) == min(full(a, b), 3)


def test_overlap_of_nothing(spark):
    none = intents(spark, [])
    assert overlap.found(none, held(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(20_000))
    pairs = overlap.found(intents(spark, [("a", long, None, "train", None)]), held(spark, [("b", long + " x", None, None, None)]))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]
    report = overlap.coverage(pairs, intents(spark, [("c", "x", None, "Dev", None)]), held(spark, [("b", "x", None, None, None)]))
    assert {(r["split"], r["n_records"], r["n_leaked"], r["n_links"]) for r in report.collect()} == {("dev", 1, 0, 0), ("test", 1, 1, 1)}


# ---- formatting


def test_folds():
    assert formatting.same("Straße, ﬁne ½", "STRASSE FINE 1⁄2") and not formatting.same("ab", "a b c")
    assert formatting.same("ẹ́", "ẹ́") and formatting.same("é", "é") and not formatting.same("é", "e")
    texts = ["Straße", "STRASSE!", "", "a", "a​", "  ", "𝐀", "日本", "日 本"]
    h = list(zip(*[x.tolist() for x in formatting.hashes(texts)]))
    assert h[0] == h[1] and h[3] == h[4] == h[6] and h[2] == h[5] and h[7] == h[8] and len(set(h)) == 4
    assert formatting.hashes([])[0].tolist() == []
    assert formatting.object_key('{"a": 1, "b": [1.0, true]}') == formatting.object_key('{"b":[1,true],"a":1.0}') != formatting.object_key('{"b":[1,1],"a":1}')
    assert formatting.object_key(None) is None and formatting.object_key("{x") == "!{x" and formatting.object_key("NaN") is not None


def test_copies(spark):
    t = "one two three four five six"
    rows = [
        ("a", t, "L", "train", '{"x":1,"y":2}'), ("b", "One, two THREE - four five   six!", " l ", "dev", '{"y": 2, "x": 1.0}'), ("b", "One, two THREE - four five   six!", " l ", "dev", '{"y": 2, "x": 1.0}'),
        ("c", t, "other", None, '{"x":1,"y":2}'), ("d", t, None, None, '{"x":1,"y":2}'), ("e", t, None, None, '{"x":1,"y":2}'), ("f", t, "l", None, None), ("g", t, "l", None, None),
        ("h", "one two three four five", "l", None, None), ("i", "one two three four five", "l", None, None), ("j", None, "l", None, None), ("k", None, "l", None, None), ("l", t + " x" * 30_000, "l", None, None),
    ]
    queries = [("q2", t, None, "K", None), ("q1", t.upper(), None, " k", None), ("q3", t, "s", "k", None)]
    got = {tuple(r) for r in formatting.found(intents(spark, rows), held(spark, queries)).collect()}
    assert got == {("a", "b"), ("d", "e"), ("f", "g"), ("q1", "q2")}
    counts = {r["id"]: r["n_copies"] for r in formatting.collapsed(intents(spark, rows), "id", "text", ["label"], "attrs").collect()}
    assert counts["a"] == 2 and counts["h"] == counts["i"] == 1 and "b" not in counts
    assert formatting.found(intents(spark, []), held(spark, [])).count() == 0


def test_words_are_counted_without_folding():
    rnd = random.Random(9)
    pool = [chr(rnd.randrange(32, 0x3100)) for _ in range(2000)] + list("abc de  \u00bd\u00b4\ufb01\u0323\u0301\u200d\u00ad-'") * 40
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 30))) for _ in range(2000)]
    assert formatting.counted(texts)[3].tolist() == [len(words(t)) for t in texts]
    # Marks in another order are the same; a mark on another letter isn't.
    a, b, c = "a\u0301\u0323 b", "a\u0323\u0301b", "ab\u0323\u0301"
    h = formatting.counted([a, b, c])
    assert h[0][0] == h[0][1] != h[0][2] and formatting.same(a, b) and not formatting.same(a, c)


def test_large_groups_are_salted(spark, monkeypatch):
    """A third of all rows in one group, verified in parts of two rows; counts of copies add up to the rows."""
    monkeypatch.setattr(formatting, "GROUP_ROWS", 2)
    rows = [(f"a{k:02}", "One two three four five six" + "!" * k, "L", "train", None) for k in range(20)] + [(f"b{k}", f"one two three four five six {k}", "L", "train", None) for k in range(40)] + [("c", "short", "L", "train", None)]
    got = {tuple(r) for r in formatting.found(intents(spark, rows), held(spark, [])).collect()}
    assert got == {("a00", f"a{k:02}") for k in range(1, 20)}
    told = {r["id"]: r["n_copies"] for r in formatting.counts(intents(spark, rows), held(spark, [])).collect()}
    assert told["a00"] == 20 and sum(told.values()) == 61 and len(told) == 42


def test_collisions_are_split(spark, monkeypatch):
    """With hashes that always collide, the comparison and the second grouping must do the work."""
    monkeypatch.setattr(formatting, "hashes", lambda texts: (np.zeros(len(texts), np.int64),) * 3)
    ts = ["a b c d e f", "x b c d e f", "A b c d e f", "X b c d e f", "y b c d e f"]
    df = intents(spark, [(str(i), t, None, None, None) for i, t in enumerate(ts)])
    rows = df.select("id", "text").rdd.map(tuple).collect()
    key = spark.createDataFrame([(i, t, (0, 0, 0, "")) for i, t in rows], "id string, text string, key struct<h1:bigint,h2:bigint,n:bigint,fields:string>")
    assert {tuple(r) for r in formatting.copies(key).collect()} == {("0", "2"), ("1", "3")}


# ---- encoding


def test_encoder_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{encode.VOCABULARIES}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rnd = random.Random(2)
    pools = ["abcdefghij ", "aeinrst", "é½ß日本กि🙂 \n\t", "0123456789., ", "'stremvlld "]
    texts = ["", "<|endoftext|>", "it's  we'll\n\n", " " * 3000 + "x", "a" * 5000, "ก" * 2000] + ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(1, 300))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*texts, None])], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode.ids_of(df).collect()}
    assert [got[i] for i in range(len(texts))] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert got[len(texts)] is None and got[0] == []
    back = {r["doc_id"]: r["text"] for r in encode.decoded(encode.ids_of(df)).collect()}
    assert [back[i] for i in range(len(texts) + 1)] == [*texts, None]
    assert encode.ids_of(df.limit(0)).count() == 0


# ---- leaks


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 11, 12, 20, 40])))) for k in range(30)] + [(98, None), (99, "")]
    docs = []
    for k in range(120):
        ws = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60))]
        if rnd.random() < 0.6:
            own = words(items[rnd.randrange(30)][1])
            a = rnd.randrange(max(1, len(own) - 12))
            ws[len(ws) // 2 : len(ws) // 2] = own[a : a + rnd.randrange(8, 25)]
        docs.append((k, rnd.choice([" ", ", ", "\n"]).join(rnd.choice([str.upper, str.lower])(w) for w in ws), 1, "s"))
    docs += [(200, None, 1, "s"), (201, "", 1, "s"), (202, " ".join(vocabulary) * 2000, 1, "s"), docs[0]]
    shingled = {k: {tuple(ws[i : i + 12]) for i in range(len(ws) - 11)} for k, t in items for ws in [words(t)]}
    want = set()
    for k, t, *_ in docs:
        ws = words(t, accents=False)
        own = {tuple(ws[i : i + 12]) for i in range(len(ws) - 11)}
        want |= {(k, i) for i, s in shingled.items() if own & s}
    documents, passages = spark.createDataFrame(docs, "doc_id long, text string, pos int, source string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leaks.found(documents, passages).collect()} == want and len(want) > 20
    assert leaks.found(documents.limit(0), passages).count() == leaks.found(documents, passages.limit(0)).count() == 0


def test_leaks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SENT", 0)
    text = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, "Ça, " + text.upper()), (2, text.replace("w3", "v3"))], "doc_id long, text string")
    assert [tuple(r) for r in leaks.found(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()] == [(1, 7)]


def test_json_records_stay_whole():
    assert json.loads(formatting.object_key('{"b": {"z": 1, "a": null}, "a": []}')) == {"a": [], "b": {"a": None, "z": 1}}


def test_leaks_with_a_crowded_bitmap_and_salts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BITS", 1 << 8)
    monkeypatch.setattr(leaks, "SENT", 0)
    monkeypatch.setattr(leaks, "PLACES", 1)
    test_leaks_equal_brute_force(spark)
