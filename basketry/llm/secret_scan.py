"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its text. The ledger holds, for each blob,
which rule versions have seen it and what they found. A scan works out the pairs of blob and rule
version that the ledger lacks, reads each missing blob once however many paths hold it, appends the
findings, and joins the findings of the ledger back to all paths.

Defined results: a null text is the empty text and has no findings; null or repeated path columns
are kept as they are, one row out for each row in; an empty table gives an empty result; columns
beyond the named ones are not read by a scan and pass through `redact`, so their names cannot clash.
Of findings that begin at one place the earlier rule comes first. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import cut, fresh_path, text_or_empty, unused

#: A finding carries the version of the rule that made it, so that a changed rule leaves nothing behind.
FINDINGS = "array<struct<version:string,kind:string,start:int,end:int>>"
LEDGER_SCHEMA = f"blob string, rules array<string>, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """A pattern and what a match has to satisfy.

    hints: a text without any of them (letter case ignored) cannot match. group and least: that
    group of a match has at least so many characters.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        key = "\x00".join((self.kind, self.pattern, str(self.group), str(self.least)))
        return f"{self.kind}@{hashlib.sha256(key.encode()).hexdigest()[:16]}"


#: The kinds that the contract fixes, in its order.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hints=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further well-known key formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", hints=("private key",)),
    Rule("code_host_token", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}", hints=("aiza",)),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}", hints=("k_live_",)),
)
RULES = BASE_RULES + MORE_RULES


def find(text: str, rules: Sequence[Rule], compiled: Sequence[re.Pattern]) -> list[tuple[int, int, int]]:
    """(start, index of the rule, end) of every match, in that order. Code points, end exclusive."""
    low, found = text.lower(), []
    for k, (rule, pattern) in enumerate(zip(rules, compiled, strict=True)):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in pattern.finditer(text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        versions = [r.version for r in rules]
        kind = pa.struct([("version", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            findings, covered = [], []
            for text, due in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [k for k, v in enumerate(versions) if v in due]
                covered.append([versions[k] for k in own])
                found = find(text, [rules[k] for k in own], [compiled[k] for k in own])
                findings.append([{"version": versions[own[k]], "kind": rules[own[k]].kind, "start": s, "end": e} for s, k, e in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(covered, pa.list_(pa.string())), pa.array(findings, pa.list_(kind))],
                names=["blob", "rules", "findings"],
            )

    return scan


class BlobLedger:
    """The table of (blob, rule versions, findings), appended to by each scan.

    path: where it is kept; by default a new one in the shared folder, which begins empty.
    """

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "ledger")
        self.new = path is None

    def read(self) -> DataFrame:
        if not self.new:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            if jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
                return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)
        return self.spark.createDataFrame([], LEDGER_SCHEMA)

    def update(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """Scan what is missing of versions (blob, text); returns (blob, findings) of all its blobs.

        Blobs that the ledger knows are left out by their hashes, before any text moves. Copies are
        dropped before the shuffle by the partial aggregate, so the reducer of a blob gets one row of
        it from each map task at most.
        """
        wanted, own = F.array(*(F.lit(r.version) for r in rules)), None
        if self.new:
            due = versions.withColumn("due", wanted)
        else:
            own = cut(versions.select("blob").distinct())
            seen = self.read().select("blob", "rules").join(own, "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            lacking = own.join(seen, "blob", "left").select(F.col("blob").alias("due_blob"), F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("due")).where(F.size("due") > 0)
            due = versions.join(lacking, F.col("blob") == F.col("due_blob")).drop("due_blob")
        found = due.dropDuplicates(["blob"]).select("blob", "text", "due").mapInArrow(_scanner(rules), LEDGER_SCHEMA)
        found.write.mode("append").parquet(self.path)
        self.new = False
        # Written, so that the join back has plain exchanges on both sides and Spark can split a blob that many paths hold.
        return cut(self.findings(rules, own))

    def findings(self, rules: tuple[Rule, ...], blobs: DataFrame | None = None) -> DataFrame:
        """(blob, findings) with the findings of these versions of the rules by start, then rule order. blobs: only of these."""
        versions = F.array(*(F.lit(r.version) for r in rules))
        ledger = self.read() if blobs is None else self.read().join(blobs, "blob", "left_semi")
        merged = ledger.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("all"))
        keyed = F.transform(
            F.filter("all", lambda x: F.array_contains(versions, x["version"])),
            lambda x: F.struct(x["start"].alias("start"), F.array_position(versions, x["version"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")),
        )
        plain = F.transform(F.array_sort(F.array_distinct(keyed)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return merged.select("blob", plain.alias("findings"))


def scan_versions(versions: DataFrame, path_cols: Sequence[str], text_col: str = "text", ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path_cols, blob and findings of each row of versions."""
    ledger = ledger or BlobLedger(versions.sparkSession)
    named = versions.select(*(F.col(c) for c in path_cols), text_or_empty(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    found = ledger.update(named.select("blob", "text"), rules)
    return named.select(*path_cols, "blob").join(found, "blob", "left").select(*path_cols, "blob", "findings")


def joined(findings, kinds: Sequence[str] | None = None):
    """kind:start:end of the findings, comma-joined."""
    if kinds is not None:
        findings = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mask; overlapping spans are replaced as one. Null texts stay null.

    A column n_chars, if there is one, gets the new length. Only rows with findings go through the
    replacement; the join back is by blob.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    own_blob, found_blob, findings = (unused(docs, n) for n in ("blob", "found_blob", "findings"))
    keyed = docs.withColumn(own_blob, F.sha2(text_or_empty(text_col), 256))
    found = ledger.update(keyed.select(F.col(own_blob).alias("blob"), text_or_empty(text_col).alias("text")), rules)
    found = found.where(F.size("findings") > 0).select(F.col("blob").alias(found_blob), F.col("findings").alias(findings))
    # Pieces: from the end of the furthest earlier span to the start of the next, each gap closed by one mask.
    spans = F.aggregate(
        findings,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(
                (x["start"] >= acc["at"]) & ((x["start"] > acc["at"]) | (x["start"] == 0) | (acc["at"] == 0)),
                F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask)),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )
    rest = F.concat(spans["out"], F.substring(F.col(text_col), spans["at"] + 1, F.lit(2**31 - 1)))
    joined_docs = keyed.join(found, F.col(own_blob) == F.col(found_blob), "left")
    out = joined_docs.withColumn(text_col, F.when(F.col(findings).isNull(), F.col(text_col)).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(findings).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
