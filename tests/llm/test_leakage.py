import math
import random

import numpy as np
import pytest

from quillspark.llm import leakage as lk

def letters(seed, alphabet, n):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


D, I = "doc_id long, text string, item_id long", "item_id long, text string, doc_id long"


def brute(docs, items):
    out = set()
    for d, x in docs:
        x = lk.normalise(x or "")
        for i, y in items:
            y = lk.normalise(y or "")
            if any(y[k : k + 60] in x for k in range(len(y) - 59)):
                out.add((d, i))
    return out


def found(spark, docs, items):
    got = lk.leaks(spark.createDataFrame([(d, t, 0) for d, t in docs], D), spark.createDataFrame([(i, t, 0) for i, t in items], I)).collect()
    return {(r["doc_id"], r["item_id"]) for r in got}, got


def test_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij 中文字，.") for _ in range(n))
    items = [(i, word(150)) for i in range(20)]
    docs = [(d, word(300)) for d in range(30)]
    for k in range(40):
        i, text = rng.choice(items)
        size = rng.randrange(40, 120)
        at = rng.randrange(0, 150 - size)
        docs.append((100 + k, word(rng.randrange(0, 90)) + text[at : at + size].upper().replace(" ", "  ") + word(rng.randrange(0, 90))))
    got, _ = found(spark, docs, items)
    assert got == brute(docs, items)


def test_exact_bounds_and_forms(spark):
    item = letters(2, "abcdefghijklmnop0123456789", 100)
    full = "".join(chr(ord(c) + 0xFEE0) for c in item[10:70])
    docs = [(1, "x" + item[:60] + "y"), (2, "x" + item[:59] + "y"), (3, "。".join(full)), (4, None), (5, ""), (6, item), (6, item)]
    got, rows = found(spark, docs, [(7, item), (8, item), (9, None), (10, "kurz")])
    assert got == {(d, i) for d in (1, 3, 6) for i in (7, 8)}
    whole = next(r for r in rows if r["doc_id"] == 6)
    assert (whole["run_chars"], whole["item_share"], round(whole["similarity"], 6)) == (100, 1.0, 1.0)
    assert len(rows) == len(got)


def test_shuffle_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(lk, "BROADCAST_WINDOWS", 0)
    item = letters(3, "abcdefghijklmnop", 120)
    assert found(spark, [(1, "q" * 30 + item)], [(2, item)])[0] == {(1, 2)}


def test_blocks_meet_all_prints_within_the_radius(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 30, dtype=np.int64)
    near = [int(np.int64(b) ^ np.int64(sum(1 << int(k) for k in rng.choice(62, 3, replace=False)))) for b in base]
    a = lk.blocks(spark.createDataFrame([(i, 0, int(b)) for i, b in enumerate(base)], "id long, pos int, print long"), 3)
    b = lk.blocks(spark.createDataFrame([(i, 0, n) for i, n in enumerate(near)], "id long, pos int, print long"), 3)
    assert {r[0] for r in a.alias("a").join(b.alias("b"), "block").where("a.id = b.id").select("a.id").collect()} == set(range(30))


def test_empty_tables_and_long_texts(spark):
    item = letters(4, "abcdefghijklmnop", 120)
    assert found(spark, [], [(1, item)])[0] == set()
    assert found(spark, [(1, item)], [])[0] == set()
    long = letters(6, "abcdefghijklmnop", 250_000) + item
    assert found(spark, [(1, long)], [(2, item)])[0] == {(1, 2)}


def weighted_brute(doc, item, items):
    """Weighted similarity of an item and the best item-sized stretch."""
    grams = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    weight = {g: math.log1p(len(items) / sum(g in grams(t) for t in items)) for g in grams(item)}
    best = (-1.0, None)
    for k in range(max(1, len(doc) - len(item) + 1)):
        got = sum(weight.get(doc[j : j + 5], 0.0) for j in range(k, min(k + len(item) - 4, len(doc) - 4)))
        if got > best[0] + 1e-9:
            best = (got, grams(doc[k : k + len(item)]))
    both = sum(weight[g] for g in best[1] & set(weight))
    return both / (sum(weight.values()) + math.log1p(len(items)) * len(best[1] - set(weight)))


def test_edited_leaks_by_weighted_similarity(spark):
    shared = letters(8, "abcdefghijklmnop", 40)
    items = [(1, letters(9, "abcdefghijklmnop", 200) + shared), (2, shared + letters(10, "abcdefghijklmnop", 150))]
    edited = items[0][1][:90] + "zz" + items[0][1][91:]
    docs = [(1, "q" * 50 + edited + "q" * 50), (2, "q" * 80 + items[0][1][:100]), (3, items[1][1])]
    tables = spark.createDataFrame([(d, t, 0) for d, t in docs], D), spark.createDataFrame([(i, t, 0) for i, t in items], I)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in lk.judged_candidates(*tables).collect()}
    texts = [t for _, t in items]
    for (d, i), similarity in got.items():
        assert similarity == pytest.approx(weighted_brute(dict(docs)[d], dict(items)[i], texts), abs=1e-6)
    assert {(r["doc_id"], r["item_id"]) for r in lk.edited_leaks(*tables).collect()} == {(1, 1), (3, 2)}


def test_forms_that_normalisation_lengthens(spark):
    text = "㌀㌁㌂㌃㌄㌅㌆㌇㌈㌉㌊㌋㌌㌍㌎㌏㌐㌑"
    assert len(text) < lk.WINDOW and len(lk.normalise(text)) >= 60
    assert found(spark, [(1, text)], [(2, lk.normalise(text))])[0] == {(1, 2)}


def test_shorter_runs_are_refused(spark):
    with pytest.raises(ValueError):
        lk.leaks(spark.createDataFrame([], D), spark.createDataFrame([], I), 59)
