"""Secret scans with an incremental blob ledger.

Every historical version of a text is addressed by its content (SHA-256). The ledger is a table of (blob, rule version)
pairs that were scanned, with what was found. A run scans only pairs that are not in it, one copy of each blob, and joins
findings back to every path and version that holds the blob.

The pass that computes addresses also notes whether a text holds any anchor, a literal or digit run without which no
rule can match. Blobs without one need no scan and no ledger row, so only few texts are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.llm.common import only, slices

RULE_VERSION = "2"
#: Fixed patterns of the base rules, by kind, with the least length of their group.
BASE_RULES = {
    "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Fixed patterns of well-known credential formats.
MORE_RULES = {
    "private_key": (r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?", 0, 0),
    "code_host": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", 0, 0),
    "chat": (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "web_token": (r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "cloud": (r"\bAIza[A-Za-z0-9_-]{35}", 0, 0),
    "payment": (r"\b[sr]k_live_[A-Za-z0-9]{16,}", 0, 0),
    "url_password": (r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:([^\s/:@]{3,200})@", 1, 3),
    "bearer": (r"\b[Bb]earer\x20+([A-Za-z0-9._~+/=-]{20,})", 1, 20),
}
KINDS = (*BASE_RULES, *MORE_RULES)
#: Fixed literals, in lower case, one of which is in every match of a rule but ``hex``.
ANCHORS = (
    "password", "passwd", "secret", "token", "apikey", "api_key", "akia", "-----begin", "ghp_", "gho_", "ghu_", "ghs_", "ghr_",
    "glpat-", "xox", "eyj", "aiza", "k_live_", "://", "bearer",
)
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, findings {FINDINGS}"
_compiled = {kind: (re.compile(pattern), group, least) for kind, (pattern, group, least) in {**BASE_RULES, **MORE_RULES}.items()}


def entropy(s: str) -> float:
    """Bits per character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then in the order of ``KINDS``.

    Matches of a kind don't overlap; those that fail the length or, for secrets inside others, the entropy rule are
    dropped without another try at the same place.
    """
    found = []
    for order, kind in enumerate(KINDS):
        pattern, group, least = _compiled[kind]
        for m in pattern.finditer(text):
            if len(m[group]) >= least and (kind != "bearer" or entropy(m[group]) >= 3):
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def anchored(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(a)) for a in ANCHORS]) | text.rlike("[0-9a-f]{24}")


def addresses(versions: DataFrame, text: str = "text", **keys: str) -> DataFrame:
    """``keys`` (names to columns) of every version, its ``blob`` and whether it is ``anchored``. A null text counts as empty."""
    t = F.coalesce(versions[f"`{text}`"], F.lit(""))
    return versions.select(*[versions[f"`{c}`"].alias(k) for k, c in keys.items()], F.sha2(t, 256).alias("blob"), anchored(t).alias("anchored"))


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in a folder that all executors share; begun empty if there is none."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in slices(rows):
        found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, pa.list_(span))], ["blob", "findings"])


def update(versions: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION) -> None:
    """Scan the blobs of ``versions`` that this rule version hasn't seen, and add them to the ledger.

    Copies meet in one row per task before the shuffle. A run that is cut short adds nothing; the next one scans again.
    """
    spark = versions.sparkSession
    seen = ledger_at(spark, ledger).filter(F.col("rule_version") == rule_version).select("blob")
    texts = only(versions, text=text).filter(anchored(F.col("text")))
    blobs = texts.groupBy(F.sha2("text", 256).alias("blob")).agg(F.first("text").alias("text"))
    new = blobs.join(seen, "blob", "left_anti").mapInArrow(_scan, f"blob string, findings {FINDINGS}")
    new.select("blob", F.lit(rule_version).alias("rule_version"), "findings").write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION, **keys: str) -> DataFrame:
    """Scan what is new, then give ``keys``, ``blob`` and ``findings`` (an array of kind, start, end) of every version.

    Every row of ``versions`` comes back once, repeated rows and rows with null keys included; null and empty texts have
    an empty array, and so have texts without secrets. Columns not named in ``keys`` are left out, whatever their names.
    """
    update(versions, ledger, text, rule_version)
    known = ledger_at(versions.sparkSession, ledger).filter(F.col("rule_version") == rule_version)
    known = known.dropDuplicates(["blob"]).select(F.col("blob").alias("known"), "findings")
    at = addresses(versions, text, **keys)
    return at.join(known, at["blob"] == known["known"], "left").select(
        *keys, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def attach(docs: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """All columns of ``docs`` under ``doc``, with ``findings`` beside it: the same scan, for users who go on with the rows."""
    update(docs, ledger, text, rule_version)
    known = ledger_at(docs.sparkSession, ledger).filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0))
    known = known.dropDuplicates(["blob"]).select(F.col("blob").alias("known"), "findings")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.join(known, F.sha2(F.coalesce(F.col(f"doc.`{text}`"), F.lit("")), 256) == known["known"], "left").select(
        "doc", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every stretch that spans cover replaced by ``mask``. Spans are in order of their starts."""

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.substr(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.when(s["end"] <= state["at"], state).when(
            s["start"] < state["at"], F.struct(state["out"].alias("out"), s["end"].alias("at"))
        ).otherwise(F.struct(more.alias("out"), s["end"].alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    end = lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))
