import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import common, simhash
from tidemark.llm.components import connected_components


def plain(text):
    """The fingerprint, spelled out."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """id to smallest id, over all pairs."""
    ids = list(fps)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aA bB\t\n\x0b\x0c\r\x1c\x85 éÉß .", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_against_all_pairs(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    fps = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = components(fps)
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(rows) == len(fps)


def test_many_under_one_block(spark):
    """More fingerprints under a pair of blocks than are compared pair by pair, chained and apart."""
    chain = [0]
    for i in range(60):
        chain.append(chain[-1] ^ (1 << (i % 16)) ^ (1 << (16 + i % 15)))
    apart = [0xFFFF << 32 | i * 0x0101 for i in range(0, 200, 3)]
    fps = {i: f for i, f in enumerate(dict.fromkeys(chain + apart))}
    want = components(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps.values()]
    rows = simhash.groups(spark.createDataFrame(signed, "fp long")).collect()
    label = {r.fp & (2**64 - 1): r.label for r in rows}
    classes = {}
    for i, f in fps.items():
        classes.setdefault(label[f], set()).add(i)
    expected = {}
    for i, c in want.items():
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_odd_tables(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {1, 2, 3} and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([1, None, 4, 6, 7, 8, 9], key=str)
    assert simhash.one_of_each(none).count() == 0


def test_components_by_rounds(spark):
    """The same with rounds on all machines as in one task: a path, a star, loops, repeats and null ends."""
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(5, 5), (7, 8), (8, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    for local in (1_000_000, 0):
        assert {r.node: r.component for r in connected_components(df, local).collect()} == want
