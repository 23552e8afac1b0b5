import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import common, pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    """Base spans, by the expressions as they are written."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a@.-0149+ ()%é", max_size=40), st.text(alphabet="0123456789 -+.", max_size=60)))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)
    assert [s for s in pii.find(text, None)] == plain(text)


def test_known_shapes():
    text = "Write to jo.doe@mail.example.org or 4111 1111 1111 1111, +1 (555) 123-4567, host 10.0.0.255 not 10.0.0.256."
    assert [k for _, k, _ in pii.base_spans(text)] == [0, 2, 3, 1]


def test_texts_with_spelled_emails_alone_are_searched():
    """Also where nothing but the address itself, without digit, @ or title, says that there may be a span."""
    model = pii.Model(np.full((len(pii.EXTRA), 9 + sum(pii.FEATURES)), 9.0), np.zeros((len(pii.EXTRA), 4)))
    for address in ("jane [at] example [dot] com", "jane (at) example (dot) com", "jane at example dot com", "jane [at]example[dot]com"):
        assert [(address, k) for _, k, _ in pii.find(address, model)] == [(address, pii.KINDS.index("spelled_email"))]
        assert pii.redact(f"write to\n{address}\nsoon", model) == pii.redact(f"write to\n{address}\nsoon 1", model)[:-2] != f"write to\n{address}\nsoon"


def test_whole_table(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.detect(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base == pii.shown(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_reliabilities_follow_agreement():
    """Labelers that agree on most candidates come out more reliable than one that votes against them."""
    counted = {(0, v, (1, 0, 1, 1)): n for v, n in (((1, 1, 1, -1), 400), ((-1, -1, -1, 1), 300), ((1, 1, 0, 1), 30), ((-1, -1, 0, -1), 30))}
    model = pii.fit(counted)
    assert model.reliabilities[0][0] > 0.9 > model.reliabilities[0][3]
    assert model.chance(0, (1, 1, 1, 0)) > pii.LIKELY > model.chance(0, (-1, -1, 0, 0))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.tuples(*[st.sampled_from([-1, 0, 1])] * 4), st.integers(1, 500), min_size=1, max_size=30))
def test_expectation_maximisation_spelled_out(counted):
    """The same numbers by loops over single candidates."""
    from math import exp, log

    share, right = 0.4, [0.85] * 4
    for _ in range(pii.ROUNDS):
        good, votes, true, post = [17.0] * 4, [20.0] * 4, 4.0, {}
        for v, n in counted.items():
            up, down = log(share), log(1 - share)
            for x, r in zip(v, right, strict=True):
                if x:
                    up, down = up + log(r if x == 1 else 1 - r), down + log(1 - r if x == 1 else r)
            post[v] = p = 1 / (1 + exp(min(30.0, max(-30.0, down - up))))
            true += n * p
            for i, x in enumerate(v):
                if x:
                    good[i] += n * (p if x == 1 else 1 - p)
                    votes[i] += n
        right = [min(0.99, max(0.55, g / m)) for g, m in zip(good, votes, strict=True)]
        share = min(0.95, max(0.05, true / (sum(counted.values()) + 10)))
    got = pii.reliabilities(np.array(list(counted)), np.array(list(counted.values()), float))
    assert np.allclose(got[0], right) and np.isclose(got[1], share) and np.allclose(got[2], [post[v] for v in counted])


def test_features_decide_what_labelers_leave_open():
    """Candidates without votes that look like the likely ones are likelier than those that look like the others."""
    counted = {(0, (1, 1, 1, 0), (1, 0, 1, 2)): 500, (0, (-1, -1, -1, 0), (3, 3, 3, 3)): 500, (0, (0, 0, 0, 0), (1, 0, 1, 2)): 20, (0, (0, 0, 0, 0), (3, 3, 3, 3)): 20}
    model = pii.fit(counted)
    assert model.chance(0, (0, 0, 0, 0), (1, 0, 1, 2)) > model.chance(0, (0, 0, 0, 0), (3, 3, 3, 3)) + 0.1
    assert model.chance(0, (1, 1, 1, 0), (1, 0, 1, 2)) > pii.LIKELY > model.chance(0, (-1, -1, -1, 0), (3, 3, 3, 3))


def test_candidates_stand_outside_taken_spans():
    """Also where taken spans overlap each other; in time proportional to their number."""
    import time

    text = "SSN 123-45-6789 " * 3
    every = [c[0] for c in pii.candidates(text, [])]
    assert every == [4, 20, 36]
    assert [c[0] for c in pii.candidates(text, [(0, 0, 5), (2, 1, 3)])] == [20, 36]
    assert [c[0] for c in pii.candidates(text, [(0, 0, 4), (15, 1, 20), (16, 2, 37)])] == [4]
    took = []
    for n in (4_000, 16_000):
        text = "a@b.de 123-45-6789 " * n
        start = time.perf_counter()
        assert sum(1 for _ in pii.candidates(text, pii.base_spans(text))) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 1


def test_added_spans_and_redaction(spark):
    clean = "nothing to see here at all"
    rows = [(i, f"SSN 123-45-{1000 + i} of the patient, call (555) 234-{1000 + i} by phone") for i in range(40)] + [(99, clean), (100, None)]
    docs = spark.createDataFrame([(*r, None, None, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    assert found[0].startswith("ssn:4:15") and "local_phone" in found[0] and not found[99] and not found[100]
    red = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert red[0].text == "SSN [SSN] of the patient, call [LOCAL_PHONE] by phone" and red[0].n_chars == len(red[0].text)
    assert red[99].text == clean and red[100].text is None


def test_odd_tables(spark, odd, none):
    rows = pii.detect(odd).collect()
    assert len(rows) == odd.count() and all(r.base == "" for r in rows)
    out = pii.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert pii.detect(none).count() == 0 and pii.redacted(none).count() == 0
