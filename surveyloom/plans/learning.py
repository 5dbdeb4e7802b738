"""Library rebuild: from stored evidence and new files to both name libraries.

All tables below a root form one release (``sources.versions``): a rebuild that fails or is lost at any
point leaves the libraries, the evidence and the manifests as they were.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.operators import library
from surveyloom.session import stage
from surveyloom.sources import versions
from surveyloom.sources.manifest import MANIFEST_SCHEMA, unseen, updated_manifest
from surveyloom.sources.sinks import write_library, write_table
from surveyloom.sources.tables import PROB_SCHEMA, STRICT_SCHEMA

EVIDENCE_SCHEMA = "name string, source_file string, male long, female long"


class Tier(NamedTuple):
    """Rows (name, gender, source_file) and checksums (file_name, checksum) of one folder."""

    rows: DataFrame
    files: DataFrame


class Refreshed(NamedTuple):
    evidence: DataFrame
    manifest: DataFrame
    new_files: int


def _refresh(spark: SparkSession, tier: Tier, base: versions.Version, label: str, full: bool, name: str, gender: str) -> Refreshed:
    """Evidence and manifest of one tier after taking in its unseen files."""
    manifest = versions.read(spark, base, f"{label}_manifest", MANIFEST_SCHEMA)
    stored = versions.read(spark, base, f"{label}_evidence", EVIDENCE_SCHEMA)
    if full:
        manifest, stored = manifest.limit(0), stored.limit(0)
    todo = stage(unseen(tier.files, manifest).select("file_name", "checksum"), f"{label}-unseen")
    rows = tier.rows.join(todo.select(F.col("file_name").alias("source_file")), "source_file", "left_semi")
    counts = library.evidence_counts(library.name_gender_pairs(rows, name, gender))
    kept = stored.join(todo.select(F.col("file_name").alias("source_file")), "source_file", "left_anti")
    evidence = stage(kept.unionByName(counts), f"{label}-evidence")
    read = todo.join(
        library.pair_counts(rows, name, gender).withColumnRenamed("source_file", "file_name"), "file_name", "left"
    ).select(
        "file_name", "checksum", F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("pair_count", F.lit(0)).alias("pair_count"), F.current_timestamp().alias("ingested_at"),
    )
    return Refreshed(evidence, stage(updated_manifest(manifest, read), f"{label}-manifest"), todo.count())


def _sizes(spark: SparkSession, of: versions.Version) -> dict[str, int]:
    return {name: versions.read(spark, of, name, schema).count() for name, schema in (("strict", STRICT_SCHEMA), ("prob", PROB_SCHEMA))}


def rebuild(
    spark: SparkSession,
    root: str,
    verified: Tier,
    unverified: Tier,
    full: bool = False,
    dry_run: bool = False,
    strict_only: bool = False,
    prob_only: bool = False,
    name: str = "farmer_name",
    gender: str = "gender",
    keep: int = 2,
) -> dict[str, object]:
    """Rebuild one or both libraries below ``root`` as one release; a failing tier keeps its tables and does not stop the other one.

    Evidence is stored per file, so the incremental result equals a full rebuild. Without unseen files
    nothing is released (``no_changes``). Of earlier releases ``keep`` stay readable. Raises
    ``versions.Conflict`` if another rebuild was committed meanwhile.
    """
    base = versions.latest(spark, root)
    report: dict[str, object] = {"strict_skipped": prob_only, "prob_skipped": strict_only, "strict_error": None, "prob_error": None}
    before = _sizes(spark, base)
    if dry_run:
        for label, tier in (("verified", verified), ("unverified", unverified)):
            manifest = versions.read(spark, base, f"{label}_manifest", MANIFEST_SCHEMA)
            report[f"new_{label}"] = unseen(tier.files, manifest.limit(0) if full else manifest).count()
        return {**report, "status": "dry_run", "strict_entries": before["strict"], "prob_entries": before["prob"], "version": base.number}

    folder, changed = versions.new_folder(), {}

    def release(tables: dict[str, tuple]) -> None:
        """Write the tables of a tier; they belong to the release only if all of them could be written."""
        for table, (write, df) in tables.items():
            write(df, f"{root}/{folder}/{table}")
        changed.update({table: f"{folder}/{table}" for table in tables})

    if not prob_only:
        try:
            found = _refresh(spark, verified, base, "verified", full, name, gender)
            if found.new_files or full:
                release({
                    "strict": (write_library, library.strict_library(found.evidence)),
                    "ambiguous": (write_library, library.ambiguous_names(found.evidence)),
                    "strict_sources": (write_table, library.name_sources(found.evidence)),
                    "verified_evidence": (write_table, found.evidence),
                    "verified_manifest": (write_table, found.manifest),
                })
            report["new_verified"] = found.new_files
        except Exception as error:
            report["strict_error"] = str(error)
    if not strict_only:
        try:
            found = _refresh(spark, unverified, base, "unverified", full, name, gender)
            strict = versions.read(spark, base._replace(tables={**base.tables, **changed}), "strict", STRICT_SCHEMA)
            if found.new_files or full or "strict" in changed:
                release({
                    "prob": (write_library, library.without_strict(library.prob_candidates(found.evidence), strict)),
                    "prob_sources": (write_table, library.name_sources(found.evidence)),
                    "unverified_evidence": (write_table, found.evidence),
                    "unverified_manifest": (write_table, found.manifest),
                })
            report["new_unverified"] = found.new_files
        except Exception as error:
            report["prob_error"] = str(error)
    current = versions.commit(spark, base, changed) if changed else base
    if changed:
        versions.sweep(spark, root, keep)
    after = _sizes(spark, current)
    failed = report["strict_error"] or report["prob_error"]
    return {
        **report,
        "status": "partial" if failed else "success" if changed else "no_changes",
        "version": current.number,
        "strict_entries": after["strict"],
        "prob_entries": after["prob"],
        "strict_new": max(0, after["strict"] - before["strict"]),
        "prob_new": max(0, after["prob"] - before["prob"]),
    }


_SCHEMAS = {
    "strict": STRICT_SCHEMA,
    "prob": PROB_SCHEMA,
    "ambiguous": "name string, male_count long, female_count long, total long, n_files long, reason string",
}


def library_table(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """``strict``, ``prob`` or ``ambiguous`` of the latest release, or of the one with a given number."""
    of = versions.latest(spark, root) if number is None else versions.version(spark, root, number)
    return versions.read(spark, of, name, _SCHEMAS[name])


def library_status(spark: SparkSession, root: str, verified_files: DataFrame, unverified_files: DataFrame) -> DataFrame:
    """(tier, file_name, status) of files not yet ingested."""
    base, parts = versions.latest(spark, root), []
    for label, files in (("verified", verified_files), ("unverified", unverified_files)):
        manifest = versions.read(spark, base, f"{label}_manifest", MANIFEST_SCHEMA)
        parts.append(unseen(files, manifest).select(F.lit(label).alias("tier"), "file_name", "status"))
    return parts[0].unionByName(parts[1])
