"""The pipeline over a small table: what each stage decides, against plain versions of it."""

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_text_queries import DATA, base, folder  # noqa: F401
from wakeline.llm.queries import QUERIES
from wakeline.sources import work

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def seen(spark, folder):  # noqa: F811
    """What each stage was given, and the result."""
    inputs, stages = {}, corpus_pipeline.STAGES

    def recorded(name, f):
        def stage(s, docs, sf_dir):
            inputs[name] = docs.select(COLUMNS).collect()
            return f(s, docs, sf_dir)

        return stage

    corpus_pipeline.STAGES = [(name, recorded(name, f)) for name, f in stages]
    try:
        result = corpus_pipeline.run(spark, folder).collect()
    finally:
        corpus_pipeline.STAGES = stages
    return inputs, result


def ids(rows):
    return sorted(r.doc_id for r in rows)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_language_stage_keeps_what_the_query_tells(spark, folder, seen):  # noqa: F811
    told = {r.doc_id for r in QUERIES["op7_language_ppm"](spark, folder).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert ids(seen[0]["near_dedup"]) == [i for i in ids(seen[0]["language"]) if i in told]
    assert len(told) > 0.9 * sum(any(c.isalpha() for c in r.text or "") for r in seen[0]["language"])


def labelled(text):
    w, out, times = words(text), [], Counter()
    for k in range(max(1, len(w) - 4)):
        s = tuple(w[k : k + 5])
        out.append((s, times[s]))
        times[s] += 1
    return out


def similarity(a, b, at_b):
    """Aligned shingles over all: none repeats, so that the longest common subsequence is a longest rising run."""
    tails = []
    for x in (at_b[s] for s in a if s in at_b):
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails) / (len(a) + len(b) - len(tails))


def test_one_of_each_group_of_near_copies_stays(seen):
    given = {r.doc_id: labelled(r.text) for r in seen[0]["near_dedup"]}
    at = {i: {s: k for k, s in enumerate(x)} for i, x in given.items()}
    group = {i: i for i in given}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    linked = 0
    for i, j in combinations(sorted(given), 2):
        a, b = given[i], given[j]
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and similarity(a, b, at[j]) >= 0.8:
            linked += 1
            low, high = sorted((top(i), top(j)))
            group[high] = low
    assert linked
    assert ids(seen[0]["decontaminate"]) == sorted(i for i in given if top(i) == i)


def test_documents_with_benchmark_windows_go(spark, folder, seen):  # noqa: F811
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text)
        size = min(10, len(w))
        windows |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1) if size}
    sizes = {len(w) for w in windows}
    hit = {r.doc_id for r in seen[0]["decontaminate"] for w in [words(r.text)] if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
    assert hit
    assert ids(seen[0]["pii"]) == [i for i in ids(seen[0]["decontaminate"]) if i not in hit]


def test_personal_data_is_replaced_and_the_rest_stays(seen):
    before, after = ({r.doc_id: r for r in seen[0][x]} for x in ("pii", "pack"))
    assert before.keys() == after.keys()
    for i, r in after.items():
        old = before[i].text
        assert not base(r.text) and r.n_chars == len(r.text), i
        kept = re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", r.text)
        assert re.fullmatch("(?s:.+?)".join(map(re.escape, kept)), old), i
        assert base(old) or len(kept) > 1 or r.text == old


def test_packed_sequences_hold_every_document(seen):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in seen[1]:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces) == ids(seen[0]["pack"])
    for r in seen[0]["pack"]:
        want = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        start = 0
        for k, (piece, at, length, crc) in enumerate(sorted(pieces[r.doc_id])):
            assert (piece, at, crc) == (k, start, zlib.crc32(want[start : start + length].tobytes())), r.doc_id
            assert length == 2048 or k == 0 or len(want) <= 2048
            start += length
        assert start == len(want) and (len(want) > 2048 or len(pieces[r.doc_id]) == 1)
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    rooms = []
    for length in sorted((n for held in places.values() for _, n in held), reverse=True):  # best fit, longest first
        fits = [k for k, room in enumerate(rooms) if room >= length]
        k = min(fits, key=rooms.__getitem__, default=None)
        if k is None:
            rooms.append(2048 - length)
        else:
            rooms[k] -= length
    assert len(places) <= len(rooms)


def test_runs_do_not_touch_each_others_tables(spark, tmp_path):
    """Two runs in turn; each result is written only after the other run has begun its next stage."""
    first = second = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        lazy = [stage(spark, docs, DATA) for docs in (first, second)]
        for n, df in enumerate(lazy):
            df.write.parquet(f"{tmp_path}/{n}-{k}")
        first, second = (spark.read.schema(df.schema).parquet(f"{tmp_path}/{n}-{k}") for n, df in enumerate(lazy))
    again = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    rows = [sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect()) for df in (lazy[0], first, second)]
    assert rows[0] == rows[1] == rows[2] and again.count() > 0


def test_a_run_leaves_only_its_result(spark):
    with work.tables_written() as tables:
        out = corpus_pipeline.run(spark, DATA)
    n = out.count()
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    there = [t for t in tables if hadoop(t).getFileSystem(conf).exists(hadoop(t))]
    assert len(there) == 1 and work.unread(there, out) == [] and n > 0
