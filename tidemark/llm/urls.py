"""URL filters by the ratio of two character models, with built-in Spark functions only.

URLs that a rule allows and URLs that a rule blocks train two smoothed Markov models of variable order (Witten-Bell, up to three characters before).
The difference of a URL's log-likelihoods, by its length, is held against a limit. The limit is the one that separates a fifth of the ruled URLs best, scored by
models of the other four fifths; the models that judge are then made of all ruled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

ORDER = 4
#: Size of the alphabet that the lowest order spreads over.
ALPHABET = 256
#: The limit is sought in steps of one over this, between plus and minus 20.
STEPS = 100


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def parts(url):
    """Host, in lower case, and path of a URL column; both empty without ://."""
    pick = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(pick(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), pick(2)


def ruled(host, path, rules=RULES):
    """The longest rule that fits, as an index into rules; null if none does. Of rules of equal length the one named first counts."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].text), k))
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    return F.coalesce(*(F.when(fits(rules[k]), F.lit(k)) for k in order))


def grams(text):
    """The rows of ORDER characters that end at each character of a text, the last being an end mark."""
    chars = F.split(F.concat(F.lit("\x02" * (ORDER - 1)), text, F.lit("\x03")), "")
    n = F.size(chars) - ORDER + 1
    # the characters' array beside itself, moved on: made so few times for each text, whatever its length
    beside = F.arrays_zip(*(F.slice(chars, F.lit(k + 1), n).alias(f"c{k}") for k in range(ORDER)))
    return F.transform(beside, lambda z: F.concat(*(z[f"c{k}"] for k in range(ORDER))))


def ratios(counted: DataFrame) -> DataFrame:
    """(gram, ratio) for counted (gram, a, r), a and r being its counts in accepted and rejected URLs: log of the probabilities of its last character after the rest."""
    out = counted.select("gram").withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pr", F.lit(1.0 / ALPHABET))
    for n in range(1, ORDER + 1):
        own = counted.groupBy(F.substring("gram", ORDER + 1 - n, n).alias("s")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        after = own.groupBy(F.substring("s", 1, n - 1).alias("c")).agg(*(f.alias(x) for k in "ar" for f, x in ((F.sum(k), f"t{k}"), (F.count_if(F.col(k) > 0).cast("double"), f"k{k}"))))
        out = out.withColumn("s", F.substring("gram", ORDER + 1 - n, n)).withColumn("c", F.substring("gram", ORDER + 1 - n, n - 1)).join(own, "s").join(after, "c")
        mixed = lambda k: F.when(F.col(f"t{k}") > 0, (F.col(k) + F.col(f"k{k}") * F.col(f"p{k}")) / (F.col(f"t{k}") + F.col(f"k{k}"))).otherwise(F.col(f"p{k}"))
        out = out.select("gram", mixed("a").alias("pa"), mixed("r").alias("pr"))
    return out.select("gram", (F.ln("pa") - F.ln("pr")).alias("ratio"))


def limit(scored: DataFrame) -> float:
    """The score from which on URLs are allowed: the one with the least sum of both error rates among scored (score, allowed); 0 without either kind."""
    at = F.round(F.greatest(F.least("score", F.lit(20.0)), F.lit(-20.0)) * STEPS).cast("int")
    rows = sorted((r.at, r.a, r.b) for r in scored.groupBy(at.alias("at")).agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b")).collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, lost, held = (2.0, 0.0), 0, bad
    for k, (x, a, b) in enumerate(rows):
        lower = rows[k - 1][0] if k else x - 1
        error = lost / good + held / bad
        if error < best[0] - 1e-12:
            best = (error, (x + lower) / 2 / STEPS)
        lost, held = lost + a, held - b
    return best[1]


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every page; score is the length-normalised difference of log-likelihoods.

    The models see whole URLs as they are, with scheme, query, fragment and all digits. A null URL or one without :// has empty host and path; a
    null one is scored as the empty text. Where no URL is ruled, all scores and the limit are 0, and
    a score equal to the limit allows. Null and repeated ids are kept. No pages: no rows. Further columns are left out.
    """
    host, path = parts(F.col("__tm_url"))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__tm_url")).select("page_id", host.alias("host"), path.alias("path"), F.coalesce("__tm_url", F.lit("")).alias("text"))
    own = own.withColumn("k", ruled(F.col("host"), F.col("path"), rules))
    allow = [k for k, r in enumerate(rules) if r.verdict == "allow"]
    texts = own.groupBy("text").agg(F.count_if(F.col("k").isin(allow)).alias("a"), F.count_if(F.col("k").isNotNull() & ~F.col("k").isin(allow)).alias("r"))
    texts = common.checkpointed(texts.withColumn("t", F.monotonically_increasing_id()))  # n-grams carry this number, not the text
    test = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(5)) == 0
    each = texts.select("t", "a", "r", test.alias("test"), F.explode(grams(F.col("text"))).alias("gram"))
    counted = common.checkpointed(each.groupBy("gram").agg(*(F.sum(k).alias(k) for k in "ar"), *(F.sum(F.when(F.col("test"), 0).otherwise(F.col(k))).alias(f"{k}4") for k in "ar")))
    tested = texts.where(test & (F.col("a") + F.col("r") > 0))
    held = tested.select("t", F.explode(grams(F.col("text"))).alias("gram")).join(ratios(counted.select("gram", F.col("a4").alias("a"), F.col("r4").alias("r"))), "gram").groupBy("t").agg(F.avg("ratio").alias("score"))
    at = limit(tested.join(held, "t").select("score", (F.col("a") >= F.col("r")).alias("allowed")))
    table = common.checkpointed(ratios(counted.select("gram", "a", "r")))
    scores = common.checkpointed(each.select("t", "gram").join(table, "gram").groupBy("t").agg(F.avg("ratio").alias("score")).join(texts.select("t", "text"), "t").select("text", "score"))
    out = own.join(scores, "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_rule = F.get(F.array(*(F.lit(r.verdict) for r in rules)), F.col("k"))
    return out.select("page_id", "host", "path", F.get(F.array(*(F.lit(r.text) for r in rules)), F.col("k")).alias("rule"), F.coalesce(by_rule, F.when(F.col("score") >= at, "allow").otherwise("block")).alias("verdict"), "score")
