"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by SHA-256. Only pairs of a blob and a rule version that the
ledger doesn't hold are scanned, each blob once however many paths hold it; findings are then joined back to all
paths. A blob held by a large part of all paths is salted in that join.

Defined results: a null text is the empty blob; repeated rows and paths each get their findings; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import salted_join, store

RULES_VERSION = "1"
#: Versions to scan that may be broadcast, 8 bytes each.
PICK = 2_000_000
# The base kinds, in their order.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What a text must hold, lower-cased, for the assign rule to be able to match.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Further kinds, each with a plain substring that any match holds.
MORE = (
    ("bearer", "earer ", re.compile(r"[Bb]earer [A-Za-z0-9._~+/-]{20,}=*", re.ASCII)),
    ("connection", "://", re.compile(r"\b[a-z][a-z0-9+]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@[^\s/@]+", re.ASCII)),
    ("hosting", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}", re.ASCII)),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII)),
    ("private_key", "PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]{1,12} ){0,2}PRIVATE KEY-----")),
)

_FOUND = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text as (start, end, kind), by start, then kind in its order."""
    base = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    more = [(m.start(), m.end(), kind) for kind, sign, rule in MORE if sign in text for m in rule.finditer(text)]
    kinds = {k: i for i, k in enumerate((*BASE, *[k for k, *_ in MORE]))}
    order = lambda x: (x[0], kinds[x[2]], x[1])
    return sorted(base, key=order), sorted(base + more, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def content_address(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(path, blob, text): the blob is the SHA-256 of the version's UTF-8 bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, text) to findings, a row a blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = find(text)
                kinds = [k for _, _, k in base]
                out.append((blob, *[kinds.count(k) for k in BASE], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return blobs.select("blob", "text").mapInArrow(run, _FOUND)


def update_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """The ledger's rows for this rule version, with those of blobs that it hasn't seen. ledger: rule_version and scan_blobs' columns.

    Blobs and paths alone decide which version of an unseen blob is read; texts are then scanned where they lie, unless the
    versions picked are more than may be broadcast.
    """
    versions = content_address(docs, id_col, text_col)
    key = F.xxhash64("blob", "path")  # one more path with the same key is one more scan, and no more findings
    picked = versions.groupBy("blob").agg(F.min("path").alias("path"))
    seen = None if ledger is None else ledger.filter(F.col("rule_version") == rules)
    if seen is not None:
        picked = picked.join(seen.select("blob"), "blob", "left_anti")
    picked = store(picked.select(key.alias("key")))
    chosen = F.broadcast(picked) if picked.count() <= PICK else picked
    new = scan_blobs(versions.withColumn("key", key).join(chosen, "key", "left_semi")).dropDuplicates(["blob"]).withColumn("rule_version", F.lit(rules))
    return new if seen is None else seen.unionByName(new)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """Findings of every path's version: id, blob, n_assign, n_access, n_hex, base_sha256, spans."""
    found = update_ledger(docs, id_col, text_col, ledger, rules).drop("rule_version")
    return salted_join(content_address(docs, id_col, text_col).select("path", "blob"), found, "blob", "path").withColumnRenamed("path", id_col)


def scan_deliveries(deliveries: list[DataFrame], id_col: str = "doc_id", text_col: str = "text", rules: str = RULES_VERSION) -> DataFrame:
    """Findings of all paths of several deliveries of versions: each is met by the stored ledger of those before it, so that a blob
    is scanned in the first delivery that holds it and only there."""
    ledger = None
    for docs in deliveries:
        found = update_ledger(docs, id_col, text_col, ledger, rules)
        ledger = store(found)
    paths = [content_address(docs, id_col, text_col).select("path", "blob") for docs in deliveries]
    return salted_join(reduce(DataFrame.unionByName, paths), ledger.drop("rule_version"), "blob", "path").withColumnRenamed("path", id_col)
