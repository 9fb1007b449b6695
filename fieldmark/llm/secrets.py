"""Secret scans with a blob ledger: every text is content-addressed and each (blob, rule version) is scanned once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import if_small, look_up, materialize, table

#: Kinds in their listed order: pattern, group that must reach the least length, least length. The first three are the
#: base; the others add spans.
RULES: tuple[tuple[str, re.Pattern, int, int], ...] = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.A), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}", re.A), 0, 24),  # runs are maximal, so shorter ones needn't be matched first
    ("forge", re.compile(r"gh[pousr]_[A-Za-z0-9]+", re.A), 0, 40),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]+", re.A), 0, 15),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", re.A), 0, 40),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", re.A), 0, 20),
)
BASE = ("assign", "access", "hex")
#: A rule can only match a text that holds one of these; lower-cased text for the rules that ignore case.
HINTS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "forge": ("gh",), "chat": ("xox",),
         "jwt": ("eyJ",), "pem": ("-----BEGIN ",)}
#: Part of the ledger's key; follows the rules, so that a changed rule is scanned anew.
VERSION = hashlib.sha256(repr([(k, p.pattern, p.flags, g, n) for k, p, g, n in RULES]).encode()).hexdigest()[:12]
FINDINGS = "array<struct<kind:string,start:int,end:int,found:string>>"


def find(text: str) -> list[dict]:
    """Spans of every kind in ``text``, by start, then kind as listed; ends are exclusive, positions are code points."""
    lower = text.lower()
    out = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        hints = HINTS.get(kind)
        if hints and not any(h in (lower if pattern.flags & re.I else text) for h in hints):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, {"kind": kind, "start": m.start(), "end": m.end(), "found": m.group()}))
    return [x for _, _, x in sorted(out, key=lambda x: x[:2])]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("found", pa.string())]))
    for batch in batches:
        found = [find(x.as_py() or "") for x in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, kind)], ["blob", "findings"])


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame | None:
    """(blob, findings, rule_version) scanned so far, or None before the first scan."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(f"blob string, findings {FINDINGS}, rule_version string").parquet(ledger) if files.exists(path) else None


def scan_secrets(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the id column, blob and findings (kind, start, end, found), by start, then kind.

    ``ledger`` is a folder that keeps what was scanned; without it, every distinct text is scanned once in this call.
    Null text counts as empty and has no findings, rows that repeat keep their own result row, null ids are kept, and an
    empty table gives no rows. A text that several rows share is scanned once, by the smallest id.
    """
    spark = df.sparkSession
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), blob.alias("blob"))
    paths = materialize(texts.select("_id", "blob"), "paths")
    first = paths.groupBy("blob").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    known = ledger_rows(spark, ledger) if ledger else None
    known = known.filter(F.col("rule_version") == VERSION).select("blob", "findings") if known is not None else None
    if known is not None:
        first = first.join(known.select("blob"), "blob", "left_anti")
    first = materialize(first, "unseen")
    total, unseen = paths.count(), first.count()
    # the rows to scan are told from the others by the shorter of the two lists
    if total - unseen < unseen and known is None:
        rest = paths.join(first, (F.col("_id") == F.col("_first")) & (paths["blob"] == first["blob"]), "left_anti")
        rest = materialize(rest.select(F.col("_id").alias("_other"), F.col("blob").alias("_other_blob")), "copies")
        todo = texts.join(if_small(rest, 90), F.col("_id").eqNullSafe(F.col("_other")) & (F.col("blob") == F.col("_other_blob")), "left_anti")
        todo = todo.filter("_id IS NOT NULL")
        orphans = first.filter("_first IS NULL").select(F.col("blob").alias("_orphan"))
        if not orphans.isEmpty():
            todo = todo.unionByName(texts.join(if_small(orphans, 90), F.col("blob") == F.col("_orphan"), "left_semi"))
    else:
        pick = first.select(F.col("_first"), F.col("blob").alias("_pick"))
        todo = texts.join(if_small(pick, 90), F.col("_id").eqNullSafe(F.col("_first")) & (F.col("blob") == F.col("_pick")), "left_semi")
    scanned = todo.select("blob", "_text").mapInArrow(_scan, f"blob string, findings {FINDINGS}").withColumn("rule_version", F.lit(VERSION))
    if ledger:
        scanned.write.mode("append").parquet(ledger)
        results = ledger_rows(spark, ledger).filter(F.col("rule_version") == VERSION)
    else:
        results = materialize(scanned, "ledger")
    hits = results.filter(F.size("findings") > 0).dropDuplicates(["blob"]).select("blob", "findings")
    counts = paths.groupBy("blob").agg(F.count("*").alias("_rows"))
    hits = materialize(hits.join(counts, "blob"), "hits")
    found = look_up(paths, hits, "blob", "_rows", total, F.xxhash64("_id", "blob"))
    none = F.array().cast(FINDINGS)
    return found.select(F.col("_id").alias(id_col), "blob", F.coalesce("findings", none).alias("findings"))


def joined(findings: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the findings, comma-joined; only ``kinds`` if given."""
    kept = F.filter(findings, lambda x: x["kind"].isin(*kinds)) if kinds else findings
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("bigint")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [of_kind(F.col("findings"), k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("findings"), BASE), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), "blob")


QUERIES = {"op9_secrets": op9}
ORACLE: dict[str, str] = {}
