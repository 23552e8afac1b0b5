import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import common, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(rows, texts, capacity, end_id=1):
    """Pieces give the documents' ids again, and sequences are gapless from 0 and within capacity."""
    t = Tokenizer.from_file(PATH)
    want = sorted((str(d), zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, end_id][at : at + capacity], "<u4").tobytes()), at // capacity, at) for d, x in texts for at in range(0, len(t.encode(x or "", add_special_tokens=False).ids) + 1, capacity))
    assert sorted((str(r.doc_id), r.ids_crc32, r.piece, r.start) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_pieces_are_the_tokenizers_ids(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    bins = checked(packing.pack(docs, PATH).collect(), texts, 4096)
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= total / 4096 * 1.05 + 2


def test_small_capacity(spark, tiny):
    docs = common.table(spark, tiny, "documents").limit(40)
    checked(packing.pack(docs, PATH, capacity=100).collect(), [(r.doc_id, r.text) for r in docs.collect()], 100)


def test_odd_tables(spark, odd, none):
    checked(packing.pack(odd, PATH).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], 4096)
    assert packing.pack(none, PATH).count() == 0


def test_ids_are_there_when_asked_for(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.ids for r in packing.pack(docs, PATH, with_ids=True).collect()}
    assert rows == {1: [*Tokenizer.from_file(PATH).encode("hello world", add_special_tokens=False).ids, 1], 2: [1]}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(30, 60))
def test_plan_packs_all(lengths, capacity):
    lengths = [min(x, capacity) for x in lengths]
    counts = {x: lengths.count(x) for x in lengths}
    bins = defaultdict(list)
    runs = packing.plan(counts, capacity)
    for x, n in counts.items():
        own = runs[runs[:, 0] == x]
        for r in range(n):
            run = own[np.searchsorted(own[:, 1], r, "right") - 1]
            i = r - run[1]
            bins[run[2] + i // run[3]].append((run[4] + i % run[3] * x, x))
    for b in bins.values():
        at = 0
        for offset, x in sorted(b):
            assert offset == at
            at += x
        assert at <= capacity
        assert sum(3 * x > capacity for _, x in b) <= 2
    fit: list[int] = []  # best-fit decreasing, one by one
    for x in sorted(lengths, reverse=True):
        room = [g for g in fit if g >= x]
        if room:
            fit[fit.index(min(room))] -= x
        else:
            fit.append(capacity - x)
    assert len(bins) <= len(fit) + max(1, len(fit) // 10)


def test_too_long_a_piece_is_refused():
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)
