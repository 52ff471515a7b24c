"""Secret scans with an incremental blob ledger, in DataFrame operations only.

A version is a row with a path (`doc_id`) and a text. Texts are addressed by their SHA-256: equal ones are one blob.
The ledger has a row for each blob and rule version that was scanned: blob, rules, spans (kind, start, end in code
points, end exclusive). Only pairs that it lacks are scanned, once each, and findings are joined back to all paths.

Null texts count as empty. An empty blob has no spans. Rows that repeat get equal results, also under one doc_id or a
null one. Spans of a long text are found by one pass of each pattern and summed as rows; words that are
no finding, such as short hexadecimal runs, are never listed. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.llm.shared import lookup, packed, staged

# Kind, pattern (leftmost matches that don't overlap), the group whose length counts, its least length.
# Runs of `access` and `hex` are as long as they can be, so the patterns ask for the least length themselves.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
]

# The same, but only such texts can have a finding; cheaper to test.
HINTS = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(json.dumps(rules).encode()).hexdigest()[:16]


def versions(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("blob"))


def lengths(kind: int, pattern: str, group: int):
    """For each match of a pattern the code points between it and the one before, of itself, and of its group.

    Each step of the regular expression begins where the last ended and takes the gap along.
    """
    whole = rf"\G([\s\S]*?)({pattern})"
    parts = [F.transform(F.regexp_extract_all("text", F.lit(whole), F.lit(g)), F.length) for g in (1, 2, 2 + group)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("gap", "own", "part"), strict=True)]), lambda m: F.struct(F.lit(kind).alias("kind"), m["gap"].alias("gap"), m["own"].alias("own"), m["part"].alias("part")))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows of distinct blobs (blob, text)."""
    rows = []
    for k, (kind, pattern, group, _) in enumerate(rules):
        hit = F.col("text").rlike(HINTS.get(kind, pattern))
        rows.append(F.when(hit, lengths(k, pattern, group)).otherwise(F.expr("array()")))
    found = blobs.select("blob", F.concat(*rows).alias("found"))
    each = found.select("blob", F.posexplode_outer("found").alias("place", "m")).select("blob", "place", "m.*")
    order = Window.partitionBy("blob", "kind").orderBy("place")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("own")).over(order).cast("int"))
    least = F.create_map(*[F.lit(x) for k, rule in enumerate(rules) for x in (k, rule[3])])
    span = F.when(F.col("part") >= least[F.col("kind")], F.struct((F.col("end") - F.col("own")).alias("start"), "kind", "end"))
    spans = F.sort_array(F.collect_list(span)).cast(NO_SPANS)
    return each.groupBy("blob").agg(spans.alias("spans")).select("blob", F.lit(rule_version(rules)).alias("rules"), "spans")


def update(documents: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The ledger rows that the blobs of these documents add."""
    fresh = versions(documents).select("blob", "text")
    if ledger is not None:
        seen = ledger.where(F.col("rules") == rule_version(rules)).select("blob").distinct()
        fresh = fresh.join(seen, "blob", "left_anti")
    return scan(fresh.dropDuplicates(["blob"]), rules)


def findings(documents: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, blob and spans (null: none) of each document, from a ledger that covers them."""
    paths = staged(versions(documents).select("doc_id", "blob"), "paths")
    times = paths.groupBy("blob").agg(F.count("*").alias("n_key"))
    known = ledger.where((F.col("rules") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans")
    known = staged(known.join(times, "blob"), "found")
    return lookup(paths, known, "blob", F.xxhash64("doc_id"), paths.count())


def without_secrets(documents: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The documents whose text has no finding."""
    new = staged(update(documents, ledger, rules), "ledger")
    all_rows = new if ledger is None else ledger.unionByName(new)
    docs = packed(documents, _blob=F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    times = docs.groupBy("_blob").agg(F.count("*").alias("n_key"))
    known = all_rows.where((F.col("rules") == rule_version(rules)) & (F.size("spans") > 0))
    known = staged(known.select(F.col("blob").alias("_blob"), F.lit(True).alias("_found")).join(times, "_blob"), "found")
    out = lookup(docs, known, "_blob", F.xxhash64("doc.doc_id"), docs.count())
    return out.where("_found IS NULL").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = findings(documents, staged(update(documents), "ledger"))
    spans = F.coalesce("spans", F.expr("array()").cast(NO_SPANS))
    kinds = F.array(*[F.lit(rule[0]) for rule in RULES])
    shown = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{rule[0]}") for k, rule in enumerate(RULES)],
        F.sha2(shown, 256).alias("base_sha256"),
        shown.alias("spans"),
    )
