"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, by_place, matches, redact, text_scan
from .store import exists, slices, written

KINDS = ("assign", "access", "hex", "pem")
#: The rules and the version of each; a changed rule gets a new version and is then scanned again on all blobs.
RULES = {"assign": 1, "access": 1, "hex": 1, "pem": 1}

_ASSIGN = matches(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                  re.ASCII | re.IGNORECASE)
_SIGN = re.compile(r"[:=]")
_ACCESS = matches(r"AKIA[A-Z0-9]{16,}")
_HEX = matches(r"[0-9a-f]{24,}")
_PEM = matches(r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----")


def _assigned(text: str):
    if _SIGN.search(text):
        yield from ((a, b) for a, b, m in _ASSIGN(text) if m.end(2) - m.start(2) >= 6)


def _plain(finder):
    return lambda text: ((a, b) for a, b, _ in finder(text))


_FINDERS = {"assign": _assigned, "access": _plain(_ACCESS), "hex": _plain(_HEX), "pem": _plain(_PEM)}


def find(text: str, rules: list[str] | None = None) -> list[tuple]:
    """(kind, start, stop, score, base) of the spans of the given rules (``kind@version``; None: all)."""
    kinds = KINDS if rules is None else [r.split("@")[0] for r in rules]
    return by_place(((k, a, b, 1.0, k != "pem") for k in kinds for a, b in _FINDERS[k](text)), KINDS)


def _current() -> list[str]:
    return [f"{kind}@{version}" for kind, version in RULES.items()]


def addressed(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """The versions with ``_blob``, the SHA-256 of their content (null: empty), in place of the content."""
    return versions.withColumn("_blob", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: str, text_col: str = "text") -> DataFrame:
    """Scan each (blob, rule version) pair that the ledger lacks, append it, and return the ledger.

    The ledger is a Parquet table ``blob, rules, spans``: one row per scan of a blob, naming the rule versions applied.
    Versions are reduced to distinct blobs before the exchange (copies meet as one row per task), so a blob with many
    paths is scanned once. A run that is repeated after a failure finds what was committed and scans the rest.
    """
    spark = versions.sparkSession
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(content.cast("binary"), 256).alias("blob"), content.alias("text")) \
        .groupBy("blob").agg(F.max("text").alias("text"))
    wanted = F.array(*map(F.lit, _current()))
    if exists(spark, ledger):
        known = spark.read.parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("known", F.array())))
    else:
        blobs = blobs.withColumn("rules", wanted)
    todo = blobs.where(F.size("rules") > 0).select("blob", "text", "rules")
    todo.mapInArrow(text_scan(find, 1, with_next=True), f"blob string, rules array<string>, spans {SPAN}") \
        .write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger)


def secrets(versions: DataFrame, ledger: str, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Findings of the current rules for every path: ``keys`` and ``spans`` per input row.

    ``versions`` holds every historical version of every path: key columns and content. ``ledger`` is a path in shared
    storage that outlives the run; blobs scanned before, under any path, are not scanned again. Spans are leftmost and
    non-overlapping per kind, in code points: assignments with a value of 6 or more characters, access keys of 20 or more, hex
    runs of 24 or more (these are the base) and heads of private keys. Null and empty contents share the blob of the empty
    text and have no spans; repeated rows and null keys are kept. Columns besides keys and content are ignored. Keys travel
    packed, so they may have any name; one called ``spans`` comes back as ``key_spans``.
    """
    packed_keys = F.struct(*(F.col(f"`{k}`").alias("key_spans" if k == "spans" else k) for k in keys)).alias("keys")
    paths = addressed(versions.select(packed_keys, F.col(text_col).alias("_content")), "_content").drop("_content")
    done = scan_unseen(versions, ledger, text_col)
    wanted = F.array(*map(F.lit, _current()))
    rule_of = F.create_map(*(F.lit(x) for kind, rule in zip(RULES, _current(), strict=True) for x in (kind, rule)))
    # One row per blob with findings; a pair scanned twice by racing runs has equal spans and counts once.
    found = (done.where(F.arrays_overlap("rules", wanted) & (F.size("spans") > 0))
             .select("blob", F.filter("spans", lambda s: F.array_contains("rules", F.element_at(rule_of, s["kind"]))).alias("spans"))
             .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans")))
    order = F.array(*map(F.lit, KINDS))
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("at"), F.array_position(order, s["kind"]).alias("k"), s.alias("s")))
    found = written(found.withColumn("spans", F.transform(F.sort_array(ranked), lambda x: x["s"])), "findings")
    out = paths.join(found.withColumnRenamed("blob", "_blob"), "_blob", "left")
    return out.select("keys.*", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def redacted(found: DataFrame, text_col: str = "text") -> DataFrame:
    """A result of ``secrets`` whose keys include the text: every span in it is replaced by its kind, spans are dropped."""
    at, spans_at = found.columns.index(text_col), found.columns.index("spans")

    def run(batches):
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            for i, own in enumerate(batch.column(spans_at).to_pylist()):
                if own:
                    texts[i] = redact(texts[i], own)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(columns) if i != spans_at],
                                             names=[c for c in batch.schema.names if c != "spans"])

    return found.mapInArrow(run, found.drop("spans").schema)
