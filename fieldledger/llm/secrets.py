"""Secret scans over an incremental ledger of blobs.

Every historical version of a file is one row; its content address is the SHA-256 of its text, so the
same text under any number of paths is one blob.  The ledger holds (blob, rule version) pairs with
their findings; it is a table in a shared folder (``Ledger``), read before a scan and added to after
it.  A scan hashes the texts, leaves out the pairs that the ledger has, scans each other blob where
its text lies, once a task, and joins the findings back to every path.  A new rule version makes all pairs
unseen; a new commit only its new texts (the query makes two commits of the documents).  Only blobs and findings are shuffled, not texts, but where a
later commit has more unseen blobs than may be sent to the tasks.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from math import log2

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.base import HOT_ROWS, SLICE_ROWS, add_columns, boxed, cut, read_table, shared_folder, without

RULE_VERSION = "2"
#: Fixed by the contract: the base kinds, in this order.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: What the method adds: forms of keys that name themselves, and long strings of even spread.
ADDED = (
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", None),  # parts of a run of JWT_RUN's characters, see find_tokens
    ("stripe", re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}")),
)
JWT_RUN = re.compile(r"[A-Za-z0-9_.-]{24,}")
JWT_HEAD = "eyJ"
ENTROPY_WORD = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
LEAST_ENTROPY = 4.2
KINDS = (*BASE_KINDS, *(k for k, _ in ADDED), "entropy")
#: Unseen blobs up to this many bytes, at so many a row, are sent to every task.
MAX_SENT_BYTES, BLOB_BYTES = 16 << 20, 64
LEDGER = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * log2(k / n) for k in map(s.count, set(s)))


def find_tokens(text: str) -> list[tuple[int, int, str]]:
    """Web tokens: two dotted parts that begin with JWT_HEAD and have eight more characters, and a third part.

    Leftmost and non-overlapping; within a run of their characters parts end only at dots, so each
    character is looked at a few times, however long the run.
    """
    out = []
    for run in JWT_RUN.finditer(text) if JWT_HEAD in text else ():
        ends, free = [], run.start()
        for part in run[0].split("."):
            ends.append((ends[-1][1] + 1 if ends else run.start(), (ends[-1][1] + 1 if ends else run.start()) + len(part)))
        for (a, b), (c, d), (_, f) in zip(ends, ends[1:], ends[2:]):
            at = text.find(JWT_HEAD, max(a, free), b)
            if at >= 0 and b - at >= 11 and text.startswith(JWT_HEAD, c) and d - c >= 11:
                out.append((at, f, "jwt"))
                free = f
    return out


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then kind as listed; offsets in code points.

    Leftmost and non-overlapping within a kind, then matches below the kind's length are dropped.
    A string that is suspect only by its even spread is left out where it overlaps another kind's span.
    """
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    for kind, pattern in ADDED:
        out += find_tokens(text) if pattern is None else [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    known, at, upto = sorted(out), 0, 0  # upto: where the known spans that begin before a word's end have ended
    for m in ENTROPY_WORD.finditer(text):
        while at < len(known) and known[at][0] < m.end():
            upto = max(upto, known[at][1])
            at += 1
        if upto <= m.start() and any(map(str.isdigit, m[0])) and entropy(m[0]) >= LEAST_ENTROPY:
            out.append((m.start(), m.end(), "entropy"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


#: Maximal runs of 16 and more: what is left of HEX's matches once short ones are dropped.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


NOTHING = hashlib.sha256(b"").hexdigest()


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    spans = find_spans(text)
    if not spans:
        return 0, 0, 0, NOTHING, ""
    base = [x for x in spans if x[2] in BASE_KINDS]
    n = [sum(x[2] == k for x in base) for k in BASE_KINDS]
    return *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)


def with_blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``blob``, the content address (a null text has that of the empty one)."""
    return without(versions, ["blob"]).withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))


def scan_blobs(rule_version: str):
    """(blob, text) -> ledger rows of the blobs, each once a task: copies go no further, so a hot blob isn't a hot key."""
    schema = pa.schema([("blob", pa.binary()), ("rule_version", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = []
                for blob, text in zip(part.column("blob").to_pylist(), part.column("text"), strict=True):
                    if blob not in seen:
                        seen.add(blob)
                        out.append((blob, rule_version, *scan_text(text.as_py() or "")))
                columns = zip(*out) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


class Ledger:
    """The table of scanned (blob, rule version) pairs, in a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, rule_version: str = RULE_VERSION) -> DataFrame:
        """The pairs of a rule version, each once, however often a commit was added."""
        try:
            table = self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            table = self.spark.createDataFrame([], LEDGER)
        return table.filter(F.col("rule_version") == rule_version).dropDuplicates(["blob"])

    def findings(self, rule_version: str = RULE_VERSION) -> DataFrame:
        """The pairs with findings, as they are now.

        They are cut: to Spark all reads of one path are the same scan, whatever was added between them, so a plan that
        holds the findings of two commits would read one commit's for both.
        """
        return cut(self.rows(rule_version).filter(F.length("spans") > 0))

    def add(self, additions: DataFrame) -> None:
        additions.write.mode("append").parquet(self.path)


def scan_unseen(versions: DataFrame, known: DataFrame | None = None, rule_version: str = RULE_VERSION, max_bytes: int = MAX_SENT_BYTES) -> DataFrame:
    """The ledger rows of the blobs that ``known`` (blob) lacks: add them to the ledger.

    ``versions`` has blob and text.  Texts are scanned where they lie.  With a ledger, the unseen blobs
    are counted first; up to ``max_bytes`` of them are sent to the tasks, more are joined.
    """
    texts = versions.select("blob", "text")
    if known is not None and not known.isEmpty():
        unseen = cut(versions.select("blob").distinct().join(known.select("blob"), "blob", "left_anti"))
        texts = texts.join(F.broadcast(unseen) if unseen.count() * BLOB_BYTES <= max_bytes else unseen, "blob")
    found = texts.mapInArrow(scan_blobs(rule_version), LEDGER)
    rest = [c for c in found.columns if c != "blob"]
    return cut(found.groupBy("blob").agg(F.first(F.struct(*rest)).alias("f")).select("blob", *[f"f.{c}" for c in rest]))


def joined_by_blob(rows: DataFrame, found: DataFrame, max_bytes: int, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` (blob) with the findings (f_blob, spans or f_spans, ...) of their blobs, or nulls.

    Findings up to ``max_bytes`` are sent to the tasks.  Beyond, those of blobs with over ``hot`` copies are: at most one in
    ``hot`` of the rows, so the copies stay where they are; the others, of which no task gets more than ``hot``, are joined by blob.
    """
    spans = "f_spans" if "f_spans" in found.columns else "spans"
    same = F.col("blob") == F.col("f_blob")
    size = found.agg(F.sum(F.length(spans) + BLOB_BYTES)).first()[0] or 0
    if size <= max_bytes:
        return rows.join(F.broadcast(found), same, "left").drop("f_blob")
    often = cut(rows.groupBy("blob").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("blob"))
    few = F.broadcast(found.join(F.broadcast(often), same, "left_semi"))
    here = rows.join(F.broadcast(often), "blob", "left_semi").join(few, same, "left")
    rest = rows.join(F.broadcast(often), "blob", "left_anti").join(found, same, "left")
    return here.unionByName(rest).drop("f_blob")


def scan_versions(versions: DataFrame, ledger: Ledger, rule_version: str = RULE_VERSION, max_bytes: int = MAX_SENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(findings, additions): every row of ``versions`` without its text but with its blob's findings, and the rows that
    this commit added to the ledger.

    Null and empty texts have no findings; repeated rows and copies have the same ones; texts of any
    length are scanned whole, in time that grows with their length; columns of ``versions`` that clash with
    the findings' are replaced; an empty table adds nothing.
    """
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows = with_blobs(without(versions, [*names, "f_blob", "rule_version"]))
    additions = scan_unseen(rows, ledger.rows(rule_version), rule_version)
    ledger.add(additions)
    found = ledger.findings(rule_version).drop("rule_version").withColumnRenamed("blob", "f_blob")
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in names[:3]}
    findings = (
        joined_by_blob(rows.drop("text"), found, max_bytes)
        .withColumns(counts | {"base_sha256": F.coalesce("base_sha256", F.lit(NOTHING)), "spans": F.coalesce("spans", F.lit(""))})
    )
    return findings, additions


def new_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each union of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def parsed(spans: str) -> list[tuple[int, int, str]]:
    return [(int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(","))]


def redact_documents(docs: DataFrame, ledger: Ledger | None = None, max_bytes: int = MAX_SENT_BYTES) -> DataFrame:
    """The rows of ``docs`` with all secrets replaced in ``text``, and ``n_chars``, if there, to match.

    Equal texts get equal ones; null and empty texts stay; texts of any length are scanned whole; an empty table gives
    no rows.  Texts are scanned where they lie, and stay there while
    the blobs with findings take up to ``max_bytes``, which are sent to the tasks; beyond, rows join them by blob.
    """
    ledger = ledger or new_ledger(docs.sparkSession)
    rows = with_blobs(boxed(docs, "text"))
    ledger.add(scan_unseen(rows, ledger.rows()))
    found = ledger.findings().select(F.col("blob").alias("f_blob"), F.col("spans").alias("f_spans"))
    def make():
        return lambda texts, spans: [[redacted(t, parsed(s)) if s else t for t, s in zip(texts, spans, strict=True)]]

    joined = joined_by_blob(rows, found, max_bytes).select("boxed_row", "text", "f_spans")
    out = add_columns(joined, ["text", "f_spans"], "new_text string", make, drop=("text", "f_spans"))
    changed = {"text": F.col("new_text"), "n_chars": F.coalesce(F.length("new_text"), F.col("boxed_row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[(changed[f.name].cast(f.dataType) if f.name in changed else F.col("boxed_row")[f.name]).alias(f.name) for f in docs.schema])


def scan_commits(commits: list[DataFrame], ledger: Ledger) -> DataFrame:
    """The findings of several commits' rows, scanned one commit after another against one ledger: a later one scans only blobs that no earlier one had."""
    out = None
    for versions in commits:
        findings, _ = scan_versions(versions, ledger)
        out = findings if out is None else out.unionByName(findings)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as two commits against a new ledger, by the parity of their ids' checksum (a null id's is that of '')."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    second = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 1
    findings = scan_commits([docs.filter(~second), docs.filter(second)], new_ledger(spark))
    return findings.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
