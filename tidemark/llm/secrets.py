"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger holds
which (blob, rule version) pairs have been scanned; a run scans only blobs that it
has not seen under a rule's present version, then joins the findings of all blobs
back to every path and version that holds them. A text that thousands of paths share
is scanned once, and raising one rule's version rescans for that rule alone.

Where a match stands is found without user code: matches are wrapped in marks,
the marked text is split, and running lengths of the parts give code-point places.

Defined cases: a null text is the empty blob. Repeated rows each get the findings of
their blob. Null ids are carried. Other columns are ignored. Overlapping findings of
different rules are all kept. An empty table gives an empty result; an empty ledger
means that nothing was scanned yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: A private-use character that wraps matches; in texts it stands for another of that block first.
_MARK, _OTHER = "\ue000", "\ue001"


#: Groups over which the versions of one blob are spread.
SALTS = 32
#: Spans that are gathered before they are laid aside: adding one copies no more than these.
BLOCK = 1000
_SPANS = "array<struct<kind: string, start: int, end: int>>"
LEDGER = f"blob string, kind string, version int, found {_SPANS}"


@dataclass(frozen=True)
class Rule:
    """`pattern` matches leftmost and non-overlapping; a match stays if `group` has `least` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: Kinds, in the order that breaks ties, and their patterns.
ASSIGN = Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8)
ACCESS = Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16)
HEX = Rule("hex", 1, r"[0-9a-f]+", 0, 32)
#: Spans that the method adds: key blocks, credentials in addresses, signed web tokens.
KEY_BLOCK = Rule("key_block", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
URL_LOGIN = Rule("url_login", 2, r"://[^\x20\x09-\x0D/:@]*:[^\x20\x09-\x0D/@]{3,}@")
WEB_TOKEN = Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
BASE_RULES = (ASSIGN, ACCESS, HEX)
RULES = (*BASE_RULES, KEY_BLOCK, URL_LOGIN, WEB_TOKEN)

#: What a text must hold for a rule to be able to match; cheap to look for.
_HINTS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA[A-Z0-9]{12}",
    "hex": "[0-9a-f]{32}",
    "key_block": "PRIVATE KEY-----",
    "url_login": r"://[^\x20\x09-\x0D/:@]*:",
    "web_token": r"eyJ[A-Za-z0-9_-]{10,}\.",
}


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, end>> of the rule's matches, in code points, end exclusive."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), rule.pattern, f"{_MARK}$0{_MARK}")
    parts = F.split(marked, _MARK)
    # Parts alternate between what lies outside and inside of matches.
    long = lambda part: F.length(F.regexp_extract(part, rule.pattern, rule.group) if rule.group else part) >= rule.least
    sized = F.transform(parts, lambda part, i: F.struct(F.length(part).alias("n"), ((i % 2 == 1) & (long(part) if rule.least else F.lit(True))).alias("hit")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("open"), F.array().cast(f"array<{_SPANS}>").alias("done"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + part["n"]
        one = F.array(F.struct(F.lit(rule.kind).alias("kind"), state["at"].alias("start"), end.alias("end")))
        full = part["hit"] & (F.size(state["open"]) >= BLOCK)
        opened = F.when(full, one).when(part["hit"], F.concat(state["open"], one)).otherwise(state["open"])
        return F.struct(end.alias("at"), opened.alias("open"), F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"))

    found = F.aggregate(sized, zero, step, lambda state: F.flatten(F.concat(state["done"], F.array(state["open"]))))
    hint = _HINTS.get(rule.kind)
    return F.when(F.lit(True) if hint is None else text.rlike(hint), found)


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that this run adds: blob, kind, version, found.

    `ledger` has such rows of earlier runs. Each unseen (blob, kind, version) is scanned once.
    """
    blobs = versions.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {r.kind: r for r in rules}
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "kind", "version")).alias("seen"))
        blobs = blobs.dropDuplicates(["blob"]).join(seen, "blob", "left")
    else:
        blobs = blobs.dropDuplicates(["blob"]).withColumn("seen", F.lit(None).cast("array<string>"))
    due = {r.kind: ~F.coalesce(F.array_contains("seen", f"{r.kind}/{r.version}"), F.lit(False)) for r in rules}
    done = F.array(*(F.when(due[k], F.struct(F.lit(k).alias("kind"), F.lit(r.version).alias("version"), F.coalesce(spans(F.col("text"), r), F.array().cast(_SPANS)).alias("found"))) for k, r in kinds.items()))
    return blobs.select("blob", F.explode_outer(F.filter(done, lambda x: x.isNotNull())).alias("r")).where("r is not null").select("blob", "r.kind", "r.version", "r.found")


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in the folder `path`; empty before the first `record`."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def record(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Append what `versions` has unseen to the ledger at `path`, and give the whole ledger.

    `path` is a folder that all executors share. One append is one commit: a run that is lost leaves the ledger as it was.
    """
    spark = versions.sparkSession
    scan(versions, open_ledger(spark, path), rules).write.mode("append").parquet(path)
    return open_ledger(spark, path)


def findings(versions: DataFrame, scanned: DataFrame, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keys`, blob, found (all spans in order of start, then kind as listed) of every version.

    `keys` are what names a version: a path and a commit, say. `scanned` is the whole ledger; only present versions of `rules` count.
    """
    order = {r.kind: k for k, r in enumerate(rules)}
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    rank = F.coalesce(*(F.when(F.col("s.kind") == k, F.lit(i)) for k, i in order.items()))
    hits = scanned.where(current).select("blob", F.explode("found").alias("s")).select("blob", F.struct(F.col("s.start").alias("start"), rank.alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind")).alias("s"))
    hits = hits.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("found"))
    # Many versions may hold one blob: the salt spreads them, and only blobs with findings are repeated.
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = versions.select(F.struct(*keys).alias("key"), address(F.col("text")).alias("blob")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    nothing = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    return rows.join(hits, ["blob", "salt"], "left").select(*(F.col(f"key.`{k}`") for k in keys), "blob", F.coalesce("found", nothing).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; `ledger` has what `record` gave, else a new one is made and stored."""
    if ledger is None:
        ledger = stored(scan(versions, None, rules))
    all_found = findings(versions, ledger, rules)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return all_found.select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
