"""The state of an index: health of its roots, validation against a tree, profiles and what they cover."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.index import strategy
from siltstone.operators.store import CONTENT_VERSION

#: Failures from which a root has too many, and texts in diagnostics that name a state.
TOO_MANY_FAILURES = 25
ACCESS_DENIED = ("access denied", "unauthorized")
JOURNAL_EXPIRED = ("older than the retained journal", "journal expired", "expired")
JOURNAL_UNAVAILABLE = ("journal unavailable", "journal changed", "journal was recreated", "newer than the journal cursor", "does not expose a supported", "usn replay is unavailable")
SCAN_DUE = ("snapshot scan queued", "root validation scan", "no usn checkpoint", "checkpoint is incomplete")


def root_key(path: Column) -> Column:
    r"""A root as it is compared: one kind of separator, none at the end (but of a drive's own root), any case."""
    p = F.lower(F.translate(path, "/", "\\"))
    return F.when(p.rlike(r"^[a-z]:\\*$"), F.concat(F.left(p, F.lit(2)), F.lit("\\"))).otherwise(F.regexp_replace(p, r"\\+$", ""))


def _says(text: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.coalesce(F.contains(F.lower(text), F.lit(n)), F.lit(False))
    return hit


_RUNTIME = {"detail": "string", "watcher_error": "string", "watching": "boolean", "queued": "long", "active": "boolean", "paused": "boolean", "reachable": "boolean", "validation": "string"}


def health(roots: DataFrame, files: DataFrame, volumes: DataFrame, pending: DataFrame, runtime: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """``root_id, root_key, status, files, queue, failures, strategy`` of each root: the first state that applies.

    Roots meet their pending changes, runtime and volume by their normalised name. A pending change is one ``id``, of any kind and however
    often delivered. ``runtime`` may say of a ``root_path`` what ``_RUNTIME`` lists; what it doesn't say counts as reachable, idle and not
    watched. ``issues`` has ``root_id, severity``; those that are only information are no failures. Roots of a repeated id count once.
    """
    own = roots.groupBy("id").agg(F.max(F.struct("root_path", "volume_id", "location_kind")).alias("r")).select(F.col("id").alias("root_id"), root_key(F.col("r.root_path")).alias("root_key"), "r.volume_id", "r.location_kind")
    waiting = pending.groupBy(root_key(F.col("root_path")).alias("root_key")).agg(F.count_distinct("id").alias("waiting"))
    bad = F.lower("status").isin("error", "skipped")
    known = files.groupBy("root_id").agg(F.count("*").alias("files"), F.count_if(bad).alias("failed"))
    # one row a volume and a root: small, but not assumed so; the planner broadcasts what its statistics show to be small
    vol = volumes.groupBy("id").agg(F.max(F.struct("health", "journal_id", "usn_supported", "last_committed_usn")).alias("v")).select(F.col("id").alias("volume_id"), "v.*", F.lit(True).alias("known"))
    x = own.join(vol, "volume_id", "left").join(waiting, "root_key", "left").join(known, "root_id", "left")
    if issues is not None:
        x = x.join(issues.groupBy("root_id").agg(F.count_if(F.coalesce(F.lower("severity"), F.lit("")) != "info").alias("noted")), "root_id", "left")
    else:
        x = x.withColumn("noted", F.lit(0))
    if runtime is not None:
        said = [F.max(c).alias(c) if c in runtime.columns else F.lit(None).cast(t).alias(c) for c, t in _RUNTIME.items()]
        x = x.join(runtime.groupBy(root_key(F.col("root_path")).alias("root_key")).agg(*said), "root_key", "left")
    else:
        for c, t in _RUNTIME.items():
            x = x.withColumn(c, F.lit(None).cast(t))
    yes = lambda c, d=False: F.coalesce(F.col(c), F.lit(d))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    x = x.withColumn("queue", F.greatest(zero("waiting"), zero("queued"))).withColumn("failures", zero("failed") + zero("noted"))
    x = x.withColumn("strategy", strategy(F.col("location_kind"), F.col("usn_supported")))
    no_checkpoint = F.col("known").isNull() | F.col("journal_id").isNull() | (zero("last_committed_usn") <= 0)
    status = (
        F.when(_says(F.col("detail"), ACCESS_DENIED) | _says(F.col("watcher_error"), ACCESS_DENIED), "AccessDenied")
        .when(~yes("reachable", True), "Offline")
        .when(yes("paused") & (yes("active") | (F.col("queue") > 0)), "Paused")
        .when(yes("active") | (F.col("queue") > 0), "CatchingUp")
        .when(_says(F.col("detail"), JOURNAL_EXPIRED) | _says(F.col("health"), JOURNAL_EXPIRED), "JournalExpired")
        .when(_says(F.col("detail"), JOURNAL_UNAVAILABLE) | _says(F.col("health"), JOURNAL_UNAVAILABLE), "JournalUnavailable")
        .when(F.coalesce(F.col("validation"), F.lit("")) == "DriftDetected", "NeedsFullScan")
        .when(F.col("failures") >= TOO_MANY_FAILURES, "TooManyExtractorFailures")
        .when(_says(F.col("detail"), SCAN_DUE) | ((F.col("strategy") == "ntfs-usn") & no_checkpoint), "NeedsFullScan")
        .when(yes("watching"), "Watching")
        .otherwise("Healthy")
    )
    return x.select("root_id", "root_key", status.alias("status"), zero("files").alias("files"), "queue", "failures", "strategy")


# ---------------------------------------------------------------- validation


def validate(seen: DataFrame, index: DataFrame, state: tuple[str, ...] = ("size_bytes", "created", "modified", "extractor_id", "extractor_version"), key: str = "path", error: str | None = None) -> DataFrame:
    """``key, kind`` of a comparison that changes nothing; ``kind`` is null where tree and index agree.

    Unlike a refresh, rows in error or skipped agree if their state does; rows still being indexed don't. ``error`` names a column of ``seen``
    that is set where the file couldn't be looked at. Keys are compared in any case and are unique on both sides.
    """
    failed = F.col(error).isNotNull() if error else F.lit(False)
    s = seen.select(F.lower(key).alias("_k"), F.col(key).alias("_seen"), F.struct(*state).alias("_s"), failed.alias("_failed"))
    i = index.select(F.lower(key).alias("_k"), F.col(key).alias("_indexed"), F.struct(*state).alias("_i"), F.col("status").alias("_status"))
    x = s.join(i, "_k", "full_outer")
    agrees = F.col("_s").eqNullSafe(F.col("_i")) & (F.lower("_status") != "indexing")
    kind = F.when(F.col("_s").isNull(), "MissingFromDisk").when(F.col("_failed"), "FailedCheck").when(F.col("_i").isNull(), "MissingFromIndex").when(~agrees, "ChangedSinceIndex")
    return x.select(F.coalesce("_seen", "_indexed").alias(key), kind.alias("kind"))


def validation_summary(checked: DataFrame) -> DataFrame:
    """One row of counters over :func:`validate`: what was checked and matched, the drifts by kind, and the status."""
    n = lambda k: F.count_if(F.col("kind") == k)
    out = checked.agg(
        F.count_if(F.col("kind").isNull() | (F.col("kind") != "MissingFromDisk")).alias("files_checked"), F.count_if(F.col("kind").isNull()).alias("files_matched"), n("MissingFromIndex").alias("missing_from_index"),
        n("ChangedSinceIndex").alias("changed_since_index"), n("MissingFromDisk").alias("missing_from_disk"), n("FailedCheck").alias("failed_checks"),
    )
    drift = F.col("missing_from_index") + F.col("changed_since_index") + F.col("missing_from_disk") + F.col("failed_checks")
    return out.withColumn("status", F.when(drift > 0, "DriftDetected").otherwise("Passed"))


# ------------------------------------------------------------------ profiles


def _names(values, dotted: bool = False) -> frozenset[str]:
    out = {str(v).strip().lower() for v in values or () if str(v).strip()}
    return frozenset(v if v.startswith(".") else f".{v}" for v in out) if dotted else frozenset(out)


@dataclass(frozen=True)
class Profile:
    """What an index was built with, or what a search asks for."""

    recursive: bool = True
    hidden: bool = False
    include: frozenset[str] = field(default_factory=frozenset)
    exclude: frozenset[str] = field(default_factory=frozenset)
    include_dirs: frozenset[str] = field(default_factory=frozenset)
    exclude_dirs: frozenset[str] = field(default_factory=frozenset)
    ocr: bool = False

    @classmethod
    def of(cls, recursive: bool = True, hidden: bool = False, include=(), exclude=(), include_dirs=(), exclude_dirs=(), ocr: bool = False) -> Profile:
        return cls(recursive, hidden, _names(include, True), _names(exclude, True), _names(include_dirs), _names(exclude_dirs), ocr)

    def encode(self) -> str:
        flag = lambda b: int(bool(b))
        lists = {"include": self.include, "exclude": self.exclude, "includeDirs": self.include_dirs, "excludeDirs": self.exclude_dirs}
        return "|".join(["v1", f"recursive={flag(self.recursive)}", f"hidden={flag(self.hidden)}", *(f"{k}={','.join(sorted(v))}" for k, v in lists.items()), f"ocr={flag(self.ocr)}"])

    @classmethod
    def parse(cls, text: str | None) -> Profile | None:
        """The profile that a text encodes, None if it is none. A list that is absent (an older profile) is empty."""
        parts = (text or "").split("|")
        if len(parts) < 5 or parts[0] != "v1":
            return None
        got = dict(p.split("=", 1) for p in parts[1:] if "=" in p)
        many = lambda k: [x for x in got.get(k, "").split(",") if x]
        on = lambda k: got.get(k) == "1"
        return cls.of(on("recursive"), on("hidden"), many("include"), many("exclude"), many("includeDirs"), many("excludeDirs"), on("ocr"))

    def covers(self, asked: Profile) -> bool:
        """Whether an index built so holds all that the search asks for: what it left out, the search must leave out as well."""
        if (asked.recursive and not self.recursive) or (asked.hidden and not self.hidden) or (asked.ocr and not self.ocr):
            return False
        for built, wanted in ((self.include, asked.include), (self.include_dirs, asked.include_dirs)):
            if built and (not wanted or not wanted <= built):
                return False
        return self.exclude <= asked.exclude and self.exclude_dirs <= asked.exclude_dirs


def coverage(asked: Profile, roots: list[str], root: dict | None, use_index: bool = True, extractors: str | None = None, identity: str | None = None) -> tuple[str, str]:
    """``(status, message)``: whether an index answers a search, by the first check that decides. Statuses and messages are fixed values.

    ``root`` is what the index has of the root: ``indexed_at, content_version, options, extractors, identity``; None if it has nothing.
    """
    if not use_index:
        return "Disabled", "Index disabled"
    if len(roots) != 1:
        return "Unsupported", "Indexed search supports one root at a time"
    try:
        if root is None:
            return "Missing", "Index does not cover this folder"
        if not root.get("indexed_at"):
            return "Missing", "Index refresh for this folder is incomplete"
        if root.get("content_version") != CONTENT_VERSION:
            return "Incompatible", "Index content version is out of date"
        if extractors is not None and root.get("extractors") != extractors:
            return "Incompatible", "Index extractor versions are out of date"
        if identity is not None and root.get("identity") not in (None, identity):
            return "Incompatible", "Indexed folder identity changed"
        built = Profile.parse(root.get("options"))
        if built is None:
            return "Incompatible", "Index profile is incompatible"
        return ("Covered", "Using indexed search") if built.covers(asked) else ("Incompatible", "Index does not cover this search")
    except (TypeError, AttributeError, ValueError) as e:
        return "Error", f"Index unavailable: {e}"
