"""Near-duplicate classes on small made-up tables."""

import random
from collections import defaultdict

from wakeline.llm import common, near_dedup


def edited(rng, words, times):
    """``words`` with as many of them changed, far enough apart that each takes five shingles along."""
    out = list(words)
    for at in rng.sample(range(5, len(words) - 5, 6), times):
        out[at] = f"edit{rng.randrange(10**9)}"
    return out


def classes(spark, rows):
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    return got


def test_an_original_joins_all_its_edited_copies(spark):
    """Copies are alike to the original at some id, but not to each other; other texts share a passage with them."""
    rng = random.Random(5)
    original = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    copies = [edited(rng, original, 4) for _ in range(300)]
    passage = [[f"v{rng.randrange(10**6)}" for _ in range(110)] + original[:90] for _ in range(100)]
    texts = [*copies[:170], original, *copies[170:], *passage]
    got = {r.doc_id: r.class_id for r in classes(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])}
    assert {got[k] for k in range(301)} == {0}
    assert all(got[k] == k for k in range(301, 401))


def test_every_pair_that_agrees_on_a_sketch_counts(spark):
    """Chains of edits: links between any two members of a bucket, held against all pairs."""
    rng = random.Random(6)
    texts = []
    for _ in range(3):
        start = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(60):
            texts.append(edited(rng, rng.choice([start, *texts[-20:]]), rng.choice((1, 2, 3, 4))))
    rng.shuffle(texts)
    h = [near_dedup.shingles([w.encode() for w in t]) for t in texts]
    keys = [near_dedup.sketch(x) for x in h]
    group = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if (keys[i] == keys[j]).any() and near_dedup.similarity(h[i], h[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert len(set(group)) < len(texts)
    assert {r.doc_id: r.class_id for r in classes(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])} == dict(enumerate(group))


def test_null_and_repeated_ids(spark):
    rng = random.Random(7)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(150)] for _ in range(6)]
    text = [" ".join(w) for w in words]
    copy = " ".join(edited(rng, words[1], 1))
    rows = [
        (None, text[0]), (None, text[1]), (4, copy), (7, text[2]), (7, text[3]), (7, " ".join(edited(rng, words[3], 1))),
        (8, text[4]), (8, text[4]), (None, text[5]), (None, text[5]), (9, ""), (9, ""), (None, None), (None, " "),
    ]
    got = defaultdict(list)
    for r in near_dedup.classified(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.class_id].append((r.doc_id, r.n_shingles, r.kept))
    members = sorted(sorted(str(i) for i, _, _ in c) for c in got.values())
    assert members == sorted([["None"], ["4", "None"], ["7"], ["7", "7"], ["8", "8"], ["None", "None"], ["9"], ["9"], ["None"], ["None"]])
    assert all(sum(kept for _, _, kept in c) == 1 for c in got.values())
    assert {4, 7, 8, 9} <= set(got) and sum(k < 0 for k in got) == 6

    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in near_dedup.stage(spark, docs, "").collect()]
    for row in ((None, text[0]), (4, copy), (7, text[2]), (8, text[4]), (None, text[5]), (None, None), (None, " ")):
        assert left.count(row) == 1, row
    assert left.count((9, "")) == 2 and (None, text[1]) not in left and sum(i == 7 for i, _ in left) == 2 and len(left) == 10


def test_heavy_keys_are_joined_like_others(spark, monkeypatch):
    """Heavy keys by broadcast, the rest by key: together the plain join, nothing lost or doubled."""
    rows = spark.createDataFrame([(k, k % 7 if k % 3 else 0) for k in range(300)], "id long, key long")
    one = rows.groupBy("key").count().filter("key <> 5").withColumnRenamed("count", "size")
    plain = sorted(map(tuple, rows.join(one, ["key"]).collect()))
    for heavy in (1, 4, 10_000):
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert sorted(map(tuple, common.spread_join(rows, one, ["key"], "size").collect())) == plain
    assert common.spread_join(rows, one.limit(0), ["key"], "size").count() == 0
