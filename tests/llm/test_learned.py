"""Quality, toxicity and language: held-out accuracy, and what they make of odd tables."""

import zlib

import numpy as np
import pytest

from tidemark.llm import common, language, quality, toxicity


def held(doc, m, r):
    return zlib.crc32(str(doc).encode()) % m == r


def area(score, label):
    """Share of pairs in the right order."""
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        ranks[score == s] = ranks[score == s].mean()
    n1 = label.sum()
    return (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize(("module", "run", "label", "m", "r"), [(quality, quality.quality, "quality", 5, 0), (toxicity, toxicity.toxicity, "toxic", 4, 2)])
def test_held_out(spark, small, module, run, label, m, r):
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    rows = run(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(x.held_out == held(x.doc_id, m, r) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    y = {x.doc_id: x[label] for x in labels.collect()}
    test = [(x.score, y[x.doc_id]) for x in rows if x.held_out and x.doc_id in y]
    score, want = (np.array(c, float) for c in zip(*test, strict=True))
    assert area(score, want) > 0.85
    assert ((score >= 0.3) == want).mean() > 0.8


@pytest.mark.parametrize(("run", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_labels_of_held_out_rows_do_not_matter(spark, tiny, run, label):
    from pyspark.sql import functions as F

    docs, labels = common.table(spark, tiny, "documents"), common.table(spark, tiny, "labels")
    out = common.crc_mod("doc_id", 5) == 0 if label == "quality" else common.crc_mod("doc_id", 4) == 2
    flipped = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    scores = [{x.doc_id: x.score for x in run(docs, y).collect()} for y in (labels, flipped)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_odd_tables(spark, odd, none, tiny, run):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    rows = run(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= x.score <= 1 for x in rows)
    assert len({x.score for x in rows if x.doc_id in (4, 5)}) == 1 and len({x.score for x in rows if x.doc_id in (1, 2)}) == 1
    assert run(none, labels).count() == 0
    assert len({x.score for x in run(odd, labels.limit(0)).collect()}) == 1


def test_rejected_documents_go(spark, small):
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    model = quality.train(docs, labels)
    scores = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, s in scores.items() if s >= 0.3}


def test_additive_model_finds_a_bend_and_a_pair():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((np.abs(x[:, 0]) > 0.5) ^ ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85


def booster(x, y):
    """The additive model spelled out: rows one by one, cuts as they are made by the operator; scores of rows by their features."""
    from itertools import combinations
    from math import exp, log

    place = lambda cuts, v: sum(v >= c for c in cuts)
    sigmoid = lambda t: 1 / (1 + exp(-t))
    features = range(x.shape[1])
    cuts, coarse = ([quality._cuts(x[:, i], bins) for i in features] for bins in (quality.BINS, quality.PAIR_BINS))
    at, wide = [[place(cuts[i], r[i]) for r in x] for i in features], [[place(coarse[i], r[i]) for r in x] for i in features]
    prior = (sum(y) + 0.5) / (len(y) + 1)
    total, tables = [log(prior / (1 - prior))] * len(y), [[0.0] * (len(c) + 1) for c in cuts]

    def gradients(cells):
        out = {}
        for c, t, want in zip(cells, total, y, strict=True):
            g, h, n = out.get(c, (0.0, 0.0, 0))
            out[c] = (g + sigmoid(t) - want, h + sigmoid(t) * (1 - sigmoid(t)), n + 1)
        return out

    added = lambda own, cells: tuple(sum(own.get(c, (0, 0, 0))[k] for c in cells) for k in range(3))
    worth = lambda s: s[0] ** 2 / (s[1] + 1)
    for _ in range(quality.ROUNDS):
        for i in features:
            own, borders = gradients(at[i]), [0, len(tables[i])]
            for _ in range(2):
                best = (1e-6, None)
                for a, b in zip(borders, borders[1:], strict=False):
                    for c in range(a + 1, b):
                        low, high, both = (added(own, range(*r)) for r in ((a, c), (c, b), (a, b)))
                        if min(low[2], high[2]) >= quality.LEAST_IN_LEAF and (gain := worth(low) + worth(high) - worth(both)) > best[0] + 1e-12:
                            best = (gain, c)
                if best[1] is None:
                    break
                borders = sorted([*borders, best[1]])
            for a, b in zip(borders, borders[1:], strict=False):
                g, h, _ = added(own, range(a, b))
                for c in range(a, b):
                    tables[i][c] -= quality.RATE * g / (h + 1)
                    total = [t - quality.RATE * g / (h + 1) if k == c else t for t, k in zip(total, at[i], strict=True)]

    def quarters(a, b):
        own, best = gradients(list(zip(wide[a], wide[b], strict=True))), (0.0, None)
        n, m = len(coarse[a]) + 1, len(coarse[b]) + 1
        whole = worth(added(own, own))
        for i in range(1, n):
            for j in range(1, m):
                parts = [[(p, q) for p in r for q in s] for r in (range(i), range(i, n)) for s in (range(j), range(j, m))]
                gain = sum(worth(added(own, p)) for p in parts) - whole
                if gain > best[0] + 1e-12:
                    best = (gain, {c: -(v := added(own, p))[0] / (v[1] + 1) for p in parts for c in p})
        return best

    pairs = {(a, b): {} for g, a, b in sorted(((quarters(a, b)[0], a, b) for a, b in combinations(features, 2)), reverse=True)[: quality.PAIRS] if g > 0}
    for _ in range(quality.PAIR_ROUNDS):
        for (a, b), table in pairs.items():
            step = quarters(a, b)[1] or {}
            for c, v in step.items():
                table[c] = table.get(c, 0.0) + quality.RATE * v
            total = [t + quality.RATE * step.get(c, 0.0) for t, c in zip(total, zip(wide[a], wide[b], strict=True), strict=True)]
    base = log(prior / (1 - prior))
    return lambda r: sigmoid(base + sum(tables[i][place(cuts[i], r[i])] for i in features) + sum(t.get((place(coarse[a], r[a]), place(coarse[b], r[b])), 0.0) for (a, b), t in pairs.items()))


def test_additive_model_spelled_out(monkeypatch):
    """Scores against loops over rows and bins."""
    for name, value in (("BINS", 6), ("PAIR_BINS", 3), ("PAIRS", 2), ("ROUNDS", 5), ("PAIR_ROUNDS", 3), ("LEAST_IN_LEAF", 4)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(160, 3)).round(1)
    y = ((x[:, 0] > 0.2) ^ ((x[:, 1] > 0) & (x[:, 2] > 0)) ^ (rng.random(160) < 0.1)).astype(float)
    model, plain = quality.fit(x, y), booster(x, y)
    assert len(model.pairs) == 2
    other = rng.normal(size=(50, 3)).round(1)
    assert np.allclose(model.score(np.concatenate([x, other])), [plain(r) for r in np.concatenate([x, other])], atol=1e-9)


def test_quality_scores_spelled_out(spark, tiny):
    """The whole query's scores: features one by one, the model from the rows that the contract lets learn."""
    docs, labels = common.table(spark, tiny, "documents"), common.table(spark, tiny, "labels")
    texts, y = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    own = [i for i in sorted(texts) if i in y and not held(i, 5, 0)]
    model = quality.fit(np.array([quality.features(texts[i]) for i in own]), np.array([y[i] for i in own], float))
    got = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    assert all(abs(got[i] - model.score(np.array([quality.features(t)]))[0]) < 1e-9 for i, t in texts.items())
    for t in ["", "a b a b a", "Words, #1 of 2 | lines\nwords, of lines"]:
        f = dict(zip(quality.NAMES, quality.features(t), strict=True))
        w = t.split()
        if t:
            ink = sum(not c.isspace() for c in t)
            assert np.isclose(f["log_words"], np.log1p(len(w))) and np.isclose(f["distinct_words"], len(set(w)) / len(w)) and np.isclose(f["digits"], sum(c.isdigit() for c in t) / ink)


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(4)
    good, noise = np.arange(1, 6), np.arange(100, 600)
    y = rng.integers(0, 2, 1500)
    rows = [np.unique(np.concatenate([good[rng.random(5) < (0.7 if t else 0.1)], rng.choice(noise, 20)])) for t in y]
    model = toxicity.fit(lambda: rows, y.astype(float))
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    assert all(weights[int(g)] > 0 for g in good) and len(weights) < 250


def ftrl(rows, labels):
    """FTRL-proximal with dictionaries, one coordinate after another; coordinates are any objects, None is the bias."""
    from math import exp, log, sqrt

    z, n = {}, {}
    prior = (sum(labels) + 0.5) / (len(labels) + 1)
    z[None] = -log(prior / (1 - prior)) * (toxicity.BETA / toxicity.ALPHA + toxicity.L2)

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i is None else toxicity.L1
        if abs(zi) <= l1:
            return 0.0
        return -(zi - (l1 if zi > 0 else -l1)) / ((toxicity.BETA + sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for row, y in zip(rows, labels, strict=True):
            own = {i: weight(i) for i in [*row, None]}
            g = 1 / (1 + exp(-max(-30.0, min(30.0, sum(own.values()))))) - y
            for i, w in own.items():
                s = (sqrt(n.get(i, 0.0) + g * g) - sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w
                n[i] = n.get(i, 0.0) + g * g
    return weight, list(z)


def plain_features(text):
    """Words, stems and pairs as they are, not hashed."""
    import re

    w = re.findall(r"\w+", text.lower())
    return {*(("w", x) for x in w), *(("s", k, x[:k]) for x in w for k in toxicity.STEMS if len(x) > k), *(("p", d, a, b) for d in (1, 2) for a, b in zip(w, w[d:], strict=False))}


def test_ftrl_spelled_out(spark, tiny):
    """Scores of a whole table against dictionaries over the features themselves, in the order of training."""
    from math import exp


    docs, labels = common.table(spark, tiny, "documents"), common.table(spark, tiny, "labels")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = [(i, y) for i, y in toxicity.sample_ids(labels, "toxic", common.crc_mod("doc_id", 4) == 2, toxicity.SAMPLE_ROWS) if i in texts]
    assert len(ids) > 50
    weight, _ = ftrl([sorted(plain_features(texts[i])) for i, _ in ids], [y for _, y in ids])
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    want = {i: 1 / (1 + exp(-(weight(None) + sum(map(weight, plain_features(t)))))) for i, t in texts.items()}
    off = [abs(got[i] - want[i]) for i in texts]
    assert np.quantile(off, 0.95) < 0.02 and np.mean([(got[i] >= 0.3) == (want[i] >= 0.3) for i in texts]) > 0.99  # what is left is coordinates that features share


def test_long_texts_take_nothing_away(spark):
    """However long a labelled text is, and wherever it stands in the order, the others teach as before; no weight is too many."""
    rows = [(i, f"{'vile hateful' if i % 3 == 0 else 'kind gentle'} words number{i} of note") for i in range(300)]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i, _ in rows] + [(1000, 0, 0)], "doc_id long, quality int, toxic int")
    long = " ".join(f"w{i}" for i in range(400_000))
    docs = spark.createDataFrame([*rows, (1000, long)], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    assert len(model.keys) > 2 and model.score("vile hateful words") > 0.5 > 0.3 > model.score("kind gentle words")


def test_languages(spark, small):
    docs = common.table(spark, small, "documents")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth)
    known = {lang for lang, _ in truth.values() if lang}
    right = []
    for r in rows:
        lang, text = truth[r.doc_id]
        assert r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und" and r.score == 0
        else:
            assert r.lang_pred in known
            if r.held_out and lang and len(text) > 100:
                right.append(r.lang_pred == lang)
    assert np.mean(right) > 0.95


def test_held_out_languages_do_not_matter(spark, tiny):
    from pyspark.sql import functions as F

    docs = common.table(spark, tiny, "documents")
    other = docs.withColumn("lang", F.when(common.crc_mod("doc_id", 4) == 2, F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.identify(d).collect()} for d in (docs, other))
    assert a == b


def test_probabilities_add_up(spark):
    """Over all characters that were seen and the one for the rest, a model's probabilities after a context come to 1."""
    docs = spark.createDataFrame([("aa", "abcab abd abca bdab"), ("bb", "dcba dacb acdb")], "lang string, text string")
    model = language.build(language.counts(docs))
    seen = [0, *map(ord, "abcd")]

    def chance(gram):
        out, n = 0.0, language.ORDER
        for n in range(language.ORDER, 0, -1):
            part = np.array([gram & ((1 << (16 * n)) - 1)], np.uint64)
            at = model.grams[n - 1].find(part)
            out = out + model.grams[n - 1].rows[at][0].astype(float)
            if at[0] != len(model.grams[n - 1].keys) - 1:
                return np.exp(out)
            if n > 1:
                c = model.contexts[n - 1]
                out = out + c.rows[c.find(part >> np.uint64(16))][0].astype(float)
        return np.exp(out + model.floor)

    for context in ("abc", "  a", "zzz"):
        head = sum((0 if c == " " else ord(c)) << (16 * (3 - i)) for i, c in enumerate(context))
        total = sum(chance(head | s) for s in seen) + chance(head | 0x7A7A)
        assert np.allclose(total, 1, atol=0.02), total


def kneser_ney(texts, n=4):
    """Interpolated Kneser-Ney with dictionaries: log-probability of a text's characters, as UTF-16 units, by the texts of a language and the alphabet of all."""
    from collections import Counter

    def units(text):
        out = [0]
        for c in text.lower():
            if c.isalpha():
                out += [int.from_bytes(c.encode("utf-16-le")[i : i + 2], "little") for i in range(0, len(c.encode("utf-16-le")), 2)]
            elif out[-1]:
                out.append(0)
        return out if not out[-1] else [*out, 0]

    def grams(text):
        u = [0] * (n - 1) + units(text)
        return [tuple(u[i : i + n]) for i in range(len(u) - n + 1)]

    def made(own, alphabet):
        levels = {n: Counter(g for t in own for g in grams(t))}
        for k in range(n - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        discount, totals, kinds = {}, {}, {}
        for k, level in levels.items():
            a, b = (sum(v == x for v in level.values()) for x in (1, 2))
            discount[k] = min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.5
            totals[k], kinds[k] = Counter(), Counter()
            for g, v in level.items():
                totals[k][g[:-1]] += v
                kinds[k][g[:-1]] += 1

        def chance(g):
            if not g:
                return 1 / (alphabet + 1)
            k, total = len(g), totals[len(g)][g[:-1]]
            lower = chance(g[1:])
            return lower if not total else max(levels[k][g] - discount[k], 0) / total + discount[k] * kinds[k][g[:-1]] / total * lower

        return lambda text: sum(np.log(chance(g)) for g in grams(text))

    every = {g[-1] for own in texts.values() for t in own for g in grams(t)}
    return {lang: made(own, len(every)) for lang, own in texts.items()}


def test_kneser_ney_spelled_out(spark):
    """Log-likelihoods of seen and unseen texts in each language; letters beyond U+FFFF are told apart."""
    texts = {"aa": ["the cat sat on the mat", "a hat, that cat's hat; 9 cats", ""], "bb": ["der hut und das tuch", "zwölf tücher"], "cc": ["\U00010330\U00010331\U00010332 \U00010330\U00010331", "\U00020000\U00020001 日本"]}
    docs = spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own], "lang string, text string")
    model = language.build(language.counts(docs))
    plain = kneser_ney(texts)
    tried = [*(t for own in texts.values() for t in own), "the tuch sat", "xyz ñ", "\U00010332\U00010330", "\U00020000\U00010331 hut", "!"]
    got, _, _ = model.totals(tried)
    for t, row in zip(tried, got, strict=True):
        assert np.allclose(row, [plain[lang](t) for lang in model.languages], atol=1e-3), t
    gothic, linear = "\U00010330\U00010331", "\U00010000\U00010001"
    a, b = model.totals([gothic, linear])[0]
    assert a[2] > b[2] + 1


def test_limits_of_acceptance_are_each_languages_own(spark):
    """Also of languages with few documents among very many of another: text unlike them is rejected, their own accepted."""
    rng = np.random.default_rng(5)
    draw = lambda words: " ".join(rng.choice(words.split(), 12))
    big, little = "the quick brown fox jumps over the lazy dog while we all sleep", "zwölf boxkämpfer jagen viktor quer über den großen sylter deich"
    tiny = ["ota hevonen talli", "hevonen juoksee", "talli ja tie"]
    rows = [(i, draw(big), "en") for i in range(3000)] + [(5000 + i, draw(little), "de") for i in range(700)] + [(8000 + i, t, "fi") for i, t in enumerate(tiny)]
    rows += [(9000 + i, t, None) for i, t in enumerate([draw(little), "žluťoučký kůň příšerně úpěl ďábelské ódy", draw(big), tiny[0], "hevsenqq tallxx zzot"])]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[9000 + i].accepted for i in range(5)] == [True, False, True, True, False]
    assert [got[9000 + i].lang_pred for i in (0, 2, 3)] == ["de", "en", "fi"]


def test_no_n_gram_is_left_out(spark, monkeypatch):
    """No number of n-grams is too many: those of a small language stay beside a large one, however low a limit once was set."""
    monkeypatch.setattr(language, "MOST_CELLS", 20, raising=False)
    big, little = "the quick brown fox jumps over the lazy dog while " * 50, "zwölf boxkämpfer"
    docs = spark.createDataFrame([("big", big), ("little", little)], "lang string, text string")
    model = language.build(language.counts(docs))
    every = np.unique(language.codes([big, little])[0])
    for n in range(1, language.ORDER + 1):
        part = np.unique(every & np.uint64((1 << (16 * n)) - 1))
        at = model.grams[n - 1].find(part)
        assert len(model.grams[n - 1].keys) - 1 == len(part) and sorted(at) == list(range(len(part)))


def test_odd_languages(spark, odd, none):
    rows = {r.doc_id: r for r in language.identify(odd).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == rows[8].lang_pred == "und"
    assert language.identify(none).count() == 0
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
