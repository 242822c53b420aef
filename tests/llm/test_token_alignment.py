"""Alignment of two tokenizers against all pairs of token byte ranges, and bitsets against lists."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wakeline.llm import token_alignment
from wakeline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TEXTS = [
    "", None, " ", "   ", "a", "Hello, world!  Two spaces\n\nand lines\t", " leading", "trailing ", "x▁y has the mark itself", "日本語 テキスト 😀😀 naïve café",
    "<s> </s> <unk> <0x0A> <|endoftext|> <|endoftext|>x", "  　 odd spaces ½ ² \x00\x1c", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30,
    "the same text", "the same text", "word " * 20_000, "é combining \U0001f468‍\U0001f469‍\U0001f467", "\r\n", "12345678901234567890 3.14159 1e-5",
]


def by_hand(texts):
    """The contract's columns from plain encodings and a walk over all token pairs."""
    path_a, path_b = token_alignment.paths()
    side_a = Tokenizer.from_file(path_a)
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = {c: b for c, b in token_alignment.packing._letter_bytes().items()}
    entry = {i: t for t, i in side_a.get_vocab().items()}

    def ranges(parts):
        at, out = 0, []
        for x in parts:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    linked, rows = [], []
    for text in texts:
        if not text:
            linked.append(None)
            continue
        a = side_a.encode(" " + text, add_special_tokens=False).ids
        b = side_b.encode(text)
        bytes_a = [bytes(letters[c] for c in entry[i]) for i in a]
        pieces = [side_b.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if side_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            linked.append(None)
            continue
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, (s, e) in zip(a, ra, strict=True) if low <= s and e <= cut) + "|" + ",".join(str(i) for i, (s, e) in zip(b, rb, strict=True) if low <= s and e <= cut))
            low = cut
        links, k = [], 0
        for i, (s, e) in zip(a, ra, strict=True):
            while k and rb[k - 1][1] > s:
                k -= 1
            while k < len(b) and rb[k][0] < e:
                if rb[k][1] > s:
                    links.append((i, b[k]))
                k += 1
        linked.append((a, b, groups, links))
    count = Counter(p for x in linked if x for p in set(x[3]))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    for x in linked:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = x
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            rows.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return rows


@pytest.mark.parametrize("most_pairs", [2_000_000, 50, 0])
def test_counts_and_groups(spark, most_pairs):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(25).collect()]
    df = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "n", "pairs", "n_best")})
    got = sorted(tuple(r) for r in token_alignment.align(df.repartition(3), most_pairs=most_pairs).select(F.coalesce("doc_id", F.lit(3)), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    want = [(i, *r) for i, r in enumerate(by_hand(texts))]
    assert got == want
    assert want[8][1] == 0 and want[10][1] > 0  # the mark itself is read as a space; strings of special tokens are text


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_packed_bitsets"](spark, DATA).collect()}
    assert got == {d.doc_id: r for d, r in zip(docs, by_hand([d.text for d in docs]), strict=True)}


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitset():
    random = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        places = np.flatnonzero(random.random(size) < 0.3)
        bits = token_alignment.Bits.at(places, size)
        assert bits.select().tolist() == places.tolist()
        asked = np.arange(size + 1)
        assert bits.rank(asked).tolist() == [int((places < x).sum()) for x in asked]
