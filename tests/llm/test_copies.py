"""Near copies and exact copies against brute force, with hot groups and awkward rows."""

import itertools
import json
import random
import re

import numpy as np
import pytest

from tolmach.llm import bagminhash, exactcopies, nearcopies
from tolmach.llm.words import words

W = re.compile(r"[^\W_]+")


def test_words_of_odd_texts():
    assert words("Größe_2  ÉTÉ—x1²") == ["größe", "2", "été", "x1²"]
    assert words("İx") == ["i̇x"]
    assert words(None) == words("") == words("… –") == []


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a = {int(e): int(w) for e, w in zip(elements[:40], rng.integers(1, 12, 40), strict=True)}
    b = {int(e): int(w) for e, w in zip(elements[15:], rng.integers(1, 12, 45), strict=True)} | {int(e): a[int(e)] for e in elements[15:30]}
    rows = np.repeat([0, 1], [len(a), len(b)])
    made = bagminhash.signatures(rows, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, 4000)
    wanted = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    assert abs((made[0] == made[1]).mean() - wanted) < 0.03
    assert np.isfinite(made).all()


def test_signature_depends_on_own_entries_only():
    rng = np.random.default_rng(2)
    e, w = rng.integers(0, 2**63, 30, dtype=np.uint64), rng.integers(1, 6, 30)
    alone = bagminhash.signatures(np.zeros(10, int), e[:10], w[:10], 1, 64)
    order = rng.permutation(30)
    rows = np.where(order < 10, 1, 0)
    among = bagminhash.signatures(rows, e[order], w[order], 3, 64)
    assert (among[1] == alone[0]).all() and np.isinf(among[2]).all()
    assert np.allclose(bagminhash.signatures(rows, e[order], w[order], 3, 64, first=3)[1], alone[0])


def near_by_hand(rows, threshold=0.7, least=8):
    sets = {(t, i): frozenset(W.findall((x or "").lower())) for t, i, x in rows}
    out = set()
    for (a, sa), (b, sb) in itertools.combinations(sorted(sets.items()), 2):
        if a[0] == b[0] and a[1] != b[1] and min(len(sa), len(sb)) >= least and len(sa & sb) >= threshold * len(sa | sb) - 1e-12:
            out.add((a[0], min(a[1], b[1]), max(a[1], b[1])))
    return out


def edited(rng, text):
    ws = text.split()
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(ws))
        rng.choice([lambda: ws.insert(at, f"new{rng.randrange(50)}"), lambda: ws.pop(at), lambda: ws.reverse()])()
    return " ".join(ws)


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)]
    bases = [" ".join(rng.sample(vocabulary, rng.randrange(9, 30))) for _ in range(40)]
    rows = [(rng.randrange(2), i, edited(rng, rng.choice(bases))) for i in range(300)]
    rows += [(0, 1000 + i, bases[0].upper() + "!") for i in range(60)]  # copies of one text
    rows += [(0, 2000, None), (0, 2001, ""), (0, 2002, "one two"), (0, 2003, "… – …"), (1, 2004, " ".join(f"long{i}" for i in range(30000))), (1, 2005, " ".join(f"long{i}" for i in range(29000)))]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in [*rows, *rows[:20]]], "tbl int, id long, text string, words string, key double").repartition(7)
    got = [tuple(r) for r in nearcopies.near_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == near_by_hand(rows)


def test_near_pairs_of_nothing(spark):
    assert nearcopies.near_pairs(spark.createDataFrame([], "tbl int, id long, text string")).count() == 0
    assert nearcopies.near_pairs(spark.createDataFrame([(None, None, None)], "tbl int, id long, text string")).count() == 0


def test_common_words_are_a_bounded_table(spark):
    df = spark.createDataFrame([(" ".join(["the", *[f"n{i}x{j}" for j in range(9)]]),) for i in range(50)], "words string")
    weight = nearcopies.word_weights(df, 4)
    assert weight["the"] == 1 and len(weight) <= 7800


BASE = "The quick brown fox jumps over the lazy dog near 27 rivers"


def copies_by_hand(rows):
    groups = {}
    for t, i, x in rows:
        if x is not None and i is not None:
            groups.setdefault((t, x), set()).add(i)
    return {(t, min(ids), i) for (t, _), ids in groups.items() for i in ids if i != min(ids)}


@pytest.mark.parametrize("partitions", ["1", "5", "16"])
def test_copies_across_partition_borders(spark, partitions):
    rng = random.Random(8)
    rows = [(0, i, "hot") for i in rng.sample(range(5000), 400)] + [(rng.randrange(2), 5000 + i, f"k{rng.randrange(60)}") for i in range(500)]
    rows += [(0, 1, None), (None, 2, "n"), (0, None, "hot"), (1, 3, "")]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep the small partitions apart
    try:
        df = spark.createDataFrame([*rows, *rows[:50]], "tbl int, id long, canon string")
        got = [tuple(r) for r in exactcopies.copies(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    assert len(got) == len(set(got))
    assert set(got) == copies_by_hand(rows)


def test_canonical_texts_and_counts(spark):
    rows = [(0, 4, BASE), (0, 2, BASE.upper() + "!!"), (0, 9, "  ".join(BASE.split())), (0, 7, BASE + " x"), (1, 1, BASE), (0, 5, "short"), (0, 6, None), (0, 8, ""), (0, 3, "STRASSE " * 10), (0, 11, "straße " * 10)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tbl int, id long, text string, canon string")
    found = exactcopies.copies(exactcopies.canonical_texts(df))
    assert {tuple(r) for r in found.collect()} == {(0, 2, 4), (0, 2, 9), (0, 3, 11)}
    assert {tuple(r) for r in exactcopies.copy_counts(found).collect()} == {(0, 2, 3), (0, 3, 2)}
    assert exactcopies.copies(exactcopies.canonical_texts(df.limit(0))).count() == 0


def test_canonical_json():
    same = ['{"A": "x y", "b": [1, null]}', '{"b":[1,null],"a":"X-Y"}', '\n{ "B" : [ 1 , null ], "a" : "x\\u0020y" }']
    assert len({exactcopies.canonical_json(p) for p in same}) == 1
    other = ['{"a": "x y", "b": [1, 0]}', '{"a": "x y"}', '{"a": "x y", "b": [1, null], "c": ""}', '{"a": null, "b": [1, null]}', '{"a": "x y", "b": "1null"}', '{"a": "xy", "a": "z", "b": [1, null]}']
    assert len({exactcopies.canonical_json(p) for p in [same[0], *other]}) == len(other) + 1
    for bad in (None, "", "[1]", '"x"', '{"a": 1', '{"a": 1}}', "nonsense", "[" * 100000):
        assert exactcopies.canonical_json(bad) is None
    assert exactcopies.canonical_json(json.dumps({"a": {"B": "q r"}})) == exactcopies.canonical_json('{"A": {"b": "Q R"}}')


def test_canonical_payloads(spark):
    df = spark.createDataFrame([(2, 5, '{"a":"x"}'), (2, 3, '{"A": "X."}'), (2, 4, "{"), (2, 6, None)], "tbl int, id long, text string")
    assert [tuple(r) for r in exactcopies.copies(exactcopies.canonical_payloads(df)).collect()] == [(2, 3, 5)]


def test_classes_hold_every_link_without_pairs(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(14)], 11)) for _ in range(60)] + [BASE] * 30 + [BASE + " now"] * 3 + ["short text", None, ""]
    df = spark.createDataFrame([(0, i, t, "x") for i, t in enumerate(texts)], "tbl int, id long, text string, rep string")
    got = {r["id"]: (r["rep"], r["copies"], r["links"]) for r in nearcopies.near_classes(df, bands=400).collect()}
    sets = {i: frozenset(words(t)) for i, t in enumerate(texts) if t and len(set(words(t))) >= 8}
    reps = {}
    for i, s in sets.items():
        reps.setdefault(s, i)
    for i, s in sets.items():
        links = sum(len(s & o) >= 0.7 * len(s | o) for o in reps if o != s)
        copies = sum(o == s for o in sets.values())
        assert got.get(i) == ((reps[s], copies, links) if links or copies > 1 else None)
    assert nearcopies.near_classes(df.limit(0)).count() == 0


def test_a_hot_band_is_split(spark):
    words_of = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words_of, f"x{i}"]) for i in range(400)]  # all alike, no two equal
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "tbl int, id long, text string")
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        links, _ = nearcopies.near_links(df)
        assert len(links.collect()) == 400 * 399 // 2
        assert "skew=true" in links._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_letters_that_fold_into_two_count_once(spark):
    df = spark.createDataFrame([(0, 1, "ß" * 39), (0, 2, "ß" * 39), (0, 3, "ß" * 40), (0, 4, "ß " * 40)], "tbl int, id long, text string")
    assert {(r["rep"], r["id"]) for r in exactcopies.copies(exactcopies.canonical_texts(df)).collect()} == {(3, 4)}
