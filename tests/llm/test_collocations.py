"""Level-wise mining against counting every phrase, whatever the size of the bit table and of the tasks' tables."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from wakeline.llm import chat, collocations
from wakeline.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def by_hand(rows, least, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        longer = Counter()
        for p, v in found.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], v)
        ranked = []
        for p, a in found.items():
            if len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a:
                continue
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def table():
    pick = random.Random(5)
    words = ["a", "b", "É", "é", "New", "york", "c d", "日本", "x'y", "\x1c", "z" * 300]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "?!"]
    text = lambda n: "".join(pick.choice(words) + pick.choice(ends) for _ in range(n))
    rows = [(pick.choice(["en", "fr", None, "und"]), text(pick.randint(0, 60))) for _ in range(150)]
    return rows + [("en", None), (None, ""), ("en", "...!!! "), ("de", text(4000)), ("xx", "one two"), *[("en", "same words here")] * 30]


@pytest.mark.parametrize(("bits", "held", "cut"), [(1 << 27, None, None), (1 << 6, None, None), (1 << 27, 3, 64)])
def test_against_counting_all(spark, monkeypatch, bits, held, cut):
    if held:
        monkeypatch.setattr(collocations, "SLICE", cut)
    rows = table()
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("phrase", "f", "n", "rank")})
    got = collocations.mine(df.repartition(3), least=4, top=25, filter_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, 4, 25)


def counted(lists, k, known=None, held=(10**9, 10**9), monkeypatch=None):
    monkeypatch.setattr(collocations, "HELD_WORDS", held[0])
    monkeypatch.setattr(collocations, "HELD_PHRASES", held[1])
    tally, out = collocations.Tally("en", k, known), Counter()
    batches = []
    for words in lists:
        tally.add(words)
        if tally.full():
            batches += tally.out()
    batches += tally.out()
    for b in batches:
        for p, n in zip(b.column("phrase").to_pylist(), b.column("f").to_pylist(), strict=True):
            out[p] += n
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_tallies_that_overflow(monkeypatch, k):
    class All:
        def holds(self, h):
            return h == h

    texts = [t or "" for _, t in table()]
    lists = list(collocations.word_lists(texts))
    assert counted(lists, k, All(), (5, 7), monkeypatch) == counted(lists, k, All(), monkeypatch=monkeypatch)


def test_products_beyond_64_bits(spark):
    n = 3 * 10**12
    level = lambda *rows: spark.createDataFrame(rows, "lang string, phrase string, f long")
    tables = [level(("en", "a", n), ("en", "b", n + 1), ("en", "", 10**13)), level(("en", "a b", n - 1))]
    (row,) = collocations.candidates(tables).collect()
    assert (row.l, row.r, row.score) == (n, n + 1, 10**6 * (n - 1) ** 2 // (n * (n + 1)))


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []


@pytest.mark.parametrize("name", ["op11_level_wise_collocations", "op12_offset_masks"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    asked = con.execute(SQL[name])
    df = QUERIES[name](spark, DATA)
    assert df.columns == [d[0] for d in asked.description]
    want = sorted(asked.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want and len(want) > 10
    if name.startswith("op12"):
        assert want[0][0] == chat.PROBE_ID and want[0][3] == len(chat.PROBE)
