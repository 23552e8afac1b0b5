"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a final classifier decides on spans.

Base spans (email, ip, card, phone) are what their expressions match. Further candidates, found where a text has digits, an at-sign, a spelled dot or a title, get
votes from regex, gazetteer and context labelers, and features of their own: length, the sign that parts the span, the kinds of character around it. How often each
pattern of votes and features occurs is counted over all documents: at most 81 patterns of votes times 256 of features for each kind, whatever the corpus. From the
counts expectation-maximisation estimates each labeler's reliability and the share of true candidates, and logistic regression on votes and features is fitted to its
posteriors, so that what labelers leave open is decided by what likely spans look like. Candidates that this classifier holds likely are added to the base spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

BASE = ("email", "ip", "card", "phone")
EXTRA = ("ssn", "iban", "local_phone", "spelled_email", "person")
KINDS = BASE + EXTRA
LIKELY = 0.9
ROUNDS = 50

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|\bdot\b|\b(?:[Mm](?:rs?|s|me|adame)|[Dd]r|[Pp]rof|[Ss]ra?|Herrn?|Frau|Monsieur)\b")


def _any(text: str) -> bool:
    """Whether the text can hold a span at all."""
    return _ANY.search(text) is not None


def _luhn(digits: str) -> bool:
    return not sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdecimal, m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds: leftmost, not overlapping within a kind, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(a, 3, b) for a, b in _phones(text)]
    return sorted(out)


_CANDIDATES = (
    re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
    re.compile(r"(?<!\w)[A-Za-z0-9._%+-]{1,64}\x20?[\[(]?(?:@|\bat\b)[\])]?\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]?\bdot\b[\])]?\x20?[A-Za-z]{2,10}(?!\w)"),
    re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Mme|Madame|Monsieur|Herrn?|Frau|Sra?)\.?\x20[A-ZÀ-Þ][\w'-]{1,30}(?:\x20[A-ZÀ-Þ][\w'-]{1,30})?"),
)
_WORDS_NEAR = (
    re.compile(r"(?i)\b(?:ssn|social security|tax id|steuernummer|seguridad social)\b"),
    re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    re.compile(r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|handy|telefon|t[ée]l[ée]fono|t[ée]l[ée]phone)\b"),
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|correo|courriel)\b"),
    re.compile(r"(?i)\b(?:name|born|lives|address|patient|customer|signed|met|said|dear)\b"),
)
#: Given names and country codes that labelers look up.
GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna hans peter klaus maria jose juan carlos luis carmen jean pierre marie michel sophie claire paul laura julia lukas".split())
COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
_AROUND = 48


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(kind: int, text: str, start: int, end: int) -> tuple[int, ...]:
    """What the labelers say of a candidate: 1 personal, -1 not, 0 nothing. In order: form, gazetteer, words near, surroundings."""
    s, near = text[start:end], text[max(0, start - _AROUND) : start] + " " + text[end : end + _AROUND]
    digits = re.sub(r"\D", "", s)
    if kind == 0:
        form, listed = (-1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1), 0
    elif kind == 1:
        form, listed = (1 if _iban(s) else -1), (1 if s[:2] in COUNTRIES else -1)
    elif kind == 2:
        form, listed = (1 if digits[0] in "23456789" and digits[3] in "23456789" else -1), (1 if digits[3:6] == "555" else 0)
    elif kind == 3:
        form, listed = (1 if re.search(r"[\[(]|@", s) else 0), (1 if re.search(r"(?i)(?:com|org|net|edu|de|fr|es)$", s) else -1)
    else:
        names = [x.lower() for x in s.replace(".", " ").split()[1:]]
        form, listed = (1 if len(names) > 1 else 0), (1 if any(x in GIVEN for x in names) else 0)
    context = 1 if _WORDS_NEAR[kind].search(near) else 0
    odd = sum(c in "#$%&*|{}<>=" for c in near)
    return form, listed, context, (-1 if odd > 8 or near.count(s) > 0 else 0)


#: Values that each feature of a span has.
FEATURES = (4, 4, 4, 4)
_BESIDE = ("", ":=", "\n\t .,;()[]\"'")


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """Length class, what parts the span, and what stands before and after it: nothing, a mark of assignment, a blank or stop, or anything else."""
    s = text[start:end]
    beside = lambda c: next((i for i, kind in enumerate(_BESIDE) if c in kind), 3) if c else 0
    before = text[start - 1 : start] if start else ""
    if before == " " and start > 1 and text[start - 2] in ":=":
        before = ":"
    return min(3, (end - start) // 8), next((i for i, c in enumerate("- .") if c in s), 3), beside(before), beside(text[end : end + 1])


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, tuple[int, ...], tuple[int, ...]]]:
    """(start, kind's number among EXTRA, end, votes, features) for candidates outside the taken spans, which are sorted."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in taken:  # as stretches that don't overlap
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    digits = any(c.isdigit() for c in text)
    for k, pattern in enumerate(_CANDIDATES):
        if k in (0, 2) and not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            at = bisect_left(starts, b)
            if not (at and ends[at - 1] > a):
                yield a, k, b, votes(k, text, a, b), features(text, a, b)


@dataclass
class Model:
    """For each extra kind: a bias and weights of the one-hot votes and features."""

    weights: np.ndarray
    reliabilities: np.ndarray

    def chance(self, kind: int, v: tuple[int, ...], f: tuple[int, ...] = ()) -> float:
        """Without features, by the votes alone."""
        return float(1 / (1 + np.exp(-np.clip(self.weights[kind] @ _hot(v, f), -500, 500))))


def _hot(v: tuple[int, ...], f: tuple[int, ...] = ()) -> np.ndarray:
    own = [float(x == y) for x, n in zip(f, FEATURES, strict=True) for y in range(n)] if f else [0.0] * sum(FEATURES)
    return np.array([1.0, *(float(x == y) for x in v for y in (1, -1)), *own])


def reliabilities(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """How often each labeler is right, the share of true candidates and each pattern's chance, by expectation-maximisation on n times each row of votes.

    A labeler is taken to be right more often than not to start with; weak priors keep kinds with few candidates near that.
    """
    share, right, post = 0.4, np.full(v.shape[1], 0.85), np.zeros(len(v))
    for _ in range(ROUNDS):
        up = np.where(v == 1, np.log(right), np.where(v == -1, np.log(1 - right), 0)).sum(1) + np.log(share)
        down = np.where(v == 1, np.log(1 - right), np.where(v == -1, np.log(right), 0)).sum(1) + np.log(1 - share)
        post = 1 / (1 + np.exp(np.clip(down - up, -30, 30)))
        good = (n[:, None] * ((v == 1) * post[:, None] + (v == -1) * (1 - post)[:, None])).sum(0)
        right = np.clip((good + 17) / ((n[:, None] * (v != 0)).sum(0) + 20), 0.55, 0.99)
        share = float(np.clip(((n * post).sum() + 4) / (n.sum() + 10), 0.05, 0.95))
    return right, share, post


def fit(counted: dict[tuple[int, tuple[int, ...], tuple[int, ...]], int], labelers: int = 4) -> Model:
    """Reliabilities by expectation-maximisation on counted patterns of votes, and a classifier of votes and features on its posteriors, for each kind of its own."""
    weights, reliable = np.zeros((len(EXTRA), 1 + 2 * labelers + sum(FEATURES))), np.full((len(EXTRA), labelers), 0.85)
    for k in range(len(EXTRA)):
        rows = [(v, f, n) for (kind, v, f), n in sorted(counted.items()) if kind == k]
        v = np.array([r[0] for r in rows]).reshape(-1, labelers)
        n = np.array([r[2] for r in rows], float)
        right, share, post = reliabilities(v, n)
        reliable[k] = right
        # candidates with votes teach the classifier, twice: as they are and with the votes hidden, so that features count where no labeler says anything.
        # What single votes alone would say guides it where no such pattern occurred, with little weight
        told = [i for i, r in enumerate(rows) if any(r[0])]
        one, none = np.eye(labelers, dtype=int), (0,) * labelers
        x = np.array([_hot(rows[i][0], rows[i][1]) for i in told] + [_hot(none, rows[i][1]) for i in told] + [_hot(tuple(r)) for r in np.vstack([one, -one])])
        bare = np.log(share / (1 - share)) + np.concatenate([np.log(right / (1 - right)), -np.log(right / (1 - right))])
        y = np.concatenate([post[told], post[told], 1 / (1 + np.exp(-bare))])
        own = n[told] / max(1.0, n[told].sum())
        w = np.concatenate([own * 80, own * 20, np.full(2 * labelers, 5.0)])
        ridge = np.array([0.05] * (1 + 2 * labelers) + [0.5] * sum(FEATURES))
        theta = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            theta -= np.linalg.solve(h, x.T @ (w * (p - y)) + ridge * theta)
        weights[k] = theta
    return Model(weights, reliable)


def find(text: str, model: Model | None) -> list[tuple[int, int, int]]:
    """All spans (start, kind's number among KINDS, end) of a text, in order; without a model, the base ones."""
    if not _any(text):
        return []
    base = base_spans(text)
    if model is None:
        return base
    return sorted(base + [(a, len(BASE) + k, b) for a, k, b, v, f in candidates(text, base) if model.chance(k, v, f) >= LIKELY])


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A model from the counted votes on, and features of, all candidates of all documents; no labels are used.

    Null and empty texts have no candidates; rows that repeat count each time. Without any candidates, or documents, the labelers' starting reliabilities decide.
    """
    common.shipped(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in common.slices(batches):
            for t in common.texts(b):
                if _any(t):
                    found.update((k, v, f) for _, k, _, v, f in candidates(t, base_spans(t)))
        rows = list(found.items())
        text = lambda x: ",".join(map(str, x))
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _, _), _ in rows], pa.int32()), pa.array([text(v) for (_, v, _), _ in rows], pa.string()), pa.array([text(f) for (_, _, f), _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["k", "v", "f", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(made, "k int, v string, f string, n long").groupBy("k", "v", "f").agg(F.sum("n").alias("n")).collect()
    numbers = lambda x: tuple(map(int, x.split(",")))
    return fit({(r.k, numbers(r.v), numbers(r.f)): r.n for r in counted})


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for every document; spans are `kind:start:end` in code points by start, then KINDS.

    Null text is the empty text, without spans. Ids may be null or repeat; equal texts have equal spans. No documents: no rows. Further columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text_col))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in common.slices(batches):
            rows = []
            for t in common.texts(b):
                s = find(t, model)
                base = [x for x in s if x[1] < len(BASE)]
                rows.append((*(sum(x[1] == k for x in base) for k in range(len(BASE))), shown(base), shown(s)))
            kinds = [pa.int64()] * len(BASE) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(made, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(text: str, model: Model | None) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in brackets."""
    out, done, at = [], 0, 0
    spans = find(text, model)
    while at < len(spans):
        start, kind, end = spans[at]
        at += 1
        while at < len(spans) and spans[at][0] < end:
            end = max(end, spans[at][2])
            at += 1
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join(out) + text[done:] if out else text


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data in text_col replaced; length_col, if there is one, gets the new length where the text changes.

    Null texts stay null; ids aren't looked at; rows that repeat stay as many, with equal texts. No documents: no rows. All columns stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, text_col))
    names = docs.columns
    at, size = names.index(text_col), names.index(length_col) if length_col in names else None

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = partial(redact, model=shared.value)
        for b in common.slices(batches, at):
            before = b.column(at).to_pylist()
            after = [None if t is None else change(t) for t in before]
            columns = list(b.columns)
            if after != before:
                columns[at] = pa.array(after, columns[at].type)
                if size is not None:
                    old = columns[size].to_pylist()
                    columns[size] = pa.array([n if x == y else len(y) for n, x, y in zip(old, before, after, strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(made, docs.schema)
