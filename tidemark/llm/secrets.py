"""Secret scans by an incremental blob ledger, with built-in Spark functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger says which blobs each version of each rule has seen; only the other pairs are
scanned, each blob once however many paths hold it, and findings are joined back to all paths. Matches and the pieces between them give the places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: a Java regular expression; kept: one that a match must fit to count (failing matches use up their text); hint: a string that all its matches hold."""

    kind: str
    pattern: str
    version: int = 1
    kept: str | None = None
    hint: str | None = None
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: The base rules and, after them, well-known shapes that have marks of their own.
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", kept="(?s)^" + _ASSIGN + "[A-Za-z0-9+/_.=-]{8,}$", base=True),
    Rule("access", "AKIA[A-Z0-9]{12,}", hint="AKIA", base=True),
    Rule("hex", "[0-9a-f]{32,}", base=True),
    Rule("key_block", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("hosted_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", hint="_"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    # the head's length is bounded, so that a text of many heads without a dot is searched in time proportional to its length
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,250}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint="eyJ"),
)


def addressed(docs: DataFrame, text_col: str = "text", name: str = "blob") -> DataFrame:
    """docs with the address of each text's content; null text is the empty text."""
    return docs.withColumn(name, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


#: Blobs that were seen by some rules alone: up to so many are sent to every executor (64 digits and the rules' names each), more meet the texts in a join.
FEW_BLOBS = 20_000


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """The distinct blobs (blob, text) that some rule has not seen, with todo, the keys of the rules that haven't.

    A sieve of the ledger's blobs, of fixed size, goes to every executor. Texts whose blobs it doesn't know are new to all rules; only of the others are the addresses
    held against the ledger, and only texts with rules left to run are moved.
    """
    keys = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        return blobs.dropDuplicates(["blob"]).withColumn("todo", keys)
    seen = common.checkpointed(ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen")))
    new, known = common.sieved(blobs, seen, "blob")
    again = known.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    again = common.checkpointed(again)
    few = again.limit(FEW_BLOBS + 1).count() <= FEW_BLOBS
    old = known.join(F.broadcast(again) if few else again, "blob").dropDuplicates(["blob"])
    return new.dropDuplicates(["blob"]).withColumn("todo", keys).unionByName(old.select("blob", "text", "todo"))


def findings(todo: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule, kind, at, start, end) for the blobs of unseen(); code points, end exclusive. at is the place of kind among the rules."""
    found = todo
    for k, r in enumerate(rules):
        fits = F.array_contains("todo", r.key)
        if r.hint is not None:
            fits &= F.contains("text", F.lit(r.hint))
        found = found.withColumn(f"m{k}", F.when(fits, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))))
    any_match = F.lit(False)
    for k in range(len(rules)):
        any_match |= F.coalesce(F.size(f"m{k}"), F.lit(0)) > 0
    found = found.where(any_match)
    parts = []
    for k, r in enumerate(rules):
        parts.append(F.when(F.size(f"m{k}") > 0, F.struct(F.lit(k).alias("at"), F.col(f"m{k}").alias("hits"), F.split("text", r.pattern, -1).alias("gaps"))))
    each = found.select("blob", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("blob", "x.at", F.posexplode(F.arrays_zip("x.hits", "x.gaps")).alias("i", "y"))
    each = each.where("y.hits is not null").select("blob", "at", "i", F.col("y.hits").alias("hit"), F.length("y.gaps").alias("gap"), F.length("y.hits").alias("n"))
    so_far = Window.partitionBy("blob", "at").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far)).withColumn("start", F.col("end") - F.col("n"))
    kept = F.lit(True)
    for k, r in enumerate(rules):
        if r.kept is not None:
            kept &= (F.col("at") != k) | F.col("hit").rlike(r.kept)
    name = lambda f: F.element_at(F.array(*(F.lit(f(r)) for r in rules)), F.col("at") + 1)
    return each.where(kept).select("blob", name(lambda r: r.key).alias("rule"), name(lambda r: r.kind).alias("kind"), "at", "start", "end")


def ledger_rows(todo: DataFrame) -> DataFrame:
    """What to add to the ledger once the blobs of unseen() are scanned: (blob, rule)."""
    return todo.select("blob", F.explode("todo").alias("rule"))


def spans(found: DataFrame, rules=RULES) -> DataFrame:
    """One row for each blob with findings: counts of the base kinds, the base spans' text and all spans' text."""
    own = found.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "at", "end", "kind"))).alias("s"))
    text = lambda x: F.array_join(F.transform(x, lambda y: F.concat_ws(":", y["kind"], y["start"].cast("string"), y["end"].cast("string"))), ",")
    base = [k for k, r in enumerate(rules) if r.base]
    number = lambda k: F.size(F.filter("s", lambda y: y["at"] == k))
    counts = [number(k).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    return own.select("blob", *counts, text(F.filter("s", lambda y: y["at"].isin(base))).alias("base"), text(F.col("s")).alias("spans"))


def known_findings(known: DataFrame, rules=RULES) -> DataFrame:
    """Earlier findings that rules in their versions of now have made, each at its rule's place of now."""
    places = F.array(*(F.lit(r.key) for r in rules))
    return known.where(F.col("rule").isin([r.key for r in rules])).withColumn("at", F.array_position(places, F.col("rule")).cast("int") - 1).select("blob", "rule", "kind", "at", "start", "end")


class Ledger:
    """A ledger and its findings as tables in a folder that all machines share: (blob, rule) pairs that were scanned, and what was found.

    Each update adds Parquet files to both, findings first: where it fails in between, the pairs aren't in the ledger and are scanned again, and
    findings that stand twice count once.
    """

    def __init__(self, spark, folder: str, rules=RULES):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    def _read(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else None

    @property
    def pairs(self) -> DataFrame | None:
        return self._read("ledger", "blob string, rule string")

    @property
    def findings(self) -> DataFrame | None:
        return self._read("findings", "blob string, rule string, kind string, at int, start long, end long")

    def update(self, versions: DataFrame, text_col: str = "text") -> None:
        """Scans what the ledger hasn't of the versions' blobs: each blob once, by the rules that have not seen it."""
        blobs = addressed(versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))).select("blob", "text")
        todo = unseen(blobs, self.pairs, self.rules)  # what it reads of the ledger is stored, so it says the same below
        found = findings(todo, self.rules)
        found.select("blob", "rule", "kind", "at", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).write.mode("append").parquet(f"{self.folder}/findings")
        # of the blobs again, by their addresses alone
        ledger_rows(todo.select("blob", "todo")).write.mode("append").parquet(f"{self.folder}/ledger")

    def report(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """What scan() gives for the documents, by the findings alone; their blobs must have been scanned."""
        found = self.findings
        if found is None:
            raise ValueError("nothing was scanned")
        return joined(docs, known_findings(found, self.rules), self.rules, id_col, text_col)


def joined(docs: DataFrame, found: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings joined back to all paths that hold their blobs."""
    paths = addressed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "blob")
    # stored, so that the join deals out both sides anew and a blob with very many paths can be split
    own = common.checkpointed(spans(found, rules))
    out = paths.join(own, "blob", "left")
    zero = [F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules if r.base]
    return out.select("doc_id", "blob", *zero, *(F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")))


def scan(docs: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, blob, n_<kind> for base kinds, base and spans (`kind:start:end` by start, then the rules' order, comma-joined).

    ledger (blob, rule) and known (findings of earlier scans) leave only new pairs to scan; findings of rules, or versions of rules, that are no longer among the
    rules don't count. Null text is the empty text, without findings. Null ids stay null; rows that repeat give rows that repeat; equal texts have equal
    results. No documents: no rows. Further columns are left out.
    """
    blobs = addressed(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))).select("blob", "text")
    found = findings(unseen(blobs, ledger, rules), rules)
    if known is not None:
        found = found.unionByName(known_findings(known, rules))
    return joined(docs, found, rules, id_col, text_col)


def history(docs: DataFrame, folder: str, versions: int = 2, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What scan() gives, by a ledger in the folder that grows as the documents did: in so many states, each holding the ones before and more, the last all."""
    ledger = Ledger(docs.sparkSession, folder, rules)
    of = F.pmod(F.xxhash64(F.col(id_col)), F.lit(versions))
    for k in range(versions):
        ledger.update(docs.where(of <= k) if k < versions - 1 else docs, text_col)
    return ledger.report(docs, id_col, text_col)
