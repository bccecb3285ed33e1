"""Recorded sessions: events in JSON lines, manifests, and artifacts addressed by their digest."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.integrity import repeated, require, sequence_gaps

EVENTS = """schema_version string, event_id string, session_id string, sequence bigint, observed_at string, monotonic_time double,
  source_monotonic_time double, source string, event_type string, confidence string, target_id string, frame_id string, request_id string,
  redirect_index int, method string, url_path string, route_pattern string, status_code int, request_body_ref string, response_body_ref string,
  fingerprint string, action_refs array<string>, form_field_names array<string>, action_kind string, is_trusted boolean, page_path string,
  form_action_path string, form_method string, action_event_id string, network_event_id string, correlation_status string,
  correlation_score double, delta_ms double, query map<string, array<string>>, headers map<string, string>, has_user_gesture boolean"""
MANIFEST = """schema_version string, session_id string, started_at string, ended_at string, status string, event_files array<string>,
  artifact_count bigint, warnings array<string>"""
#: Required of every event.
VALID = "event_id IS NOT NULL AND session_id IS NOT NULL AND sequence >= 0 AND observed_at IS NOT NULL AND monotonic_time >= 0 AND source IS NOT NULL AND event_type IS NOT NULL AND confidence IS NOT NULL"


def read_events(spark: SparkSession, *paths: str) -> DataFrame:
    """All events of the files; the job fails at the first line that is no event."""
    rows = spark.read.schema(EVENTS).option("mode", "FAILFAST").json(list(paths))
    return require(rows, VALID, "not a valid event")


def verified_lines(spark: SparkSession, *paths: str, expected: DataFrame) -> DataFrame:
    """(path, line) of files that have to be exactly those ``expected`` (path, sha256), with exactly these bytes.

    A file is read once for both: its bytes are digested and split into lines in the same row, so what is parsed
    is what was looked at, whenever and however often the result is computed; a file with other bytes fails the
    job. Files that are missing or not expected are found from names alone, at once. A file is held in a task, and
    can't have more than 2 GiB.
    """
    files = spark.read.format("binaryFile").load(list(paths))
    there, wanted = files.select("path"), expected.select("path")
    odd = there.exceptAll(wanted).unionByName(wanted.exceptAll(there)).limit(5).collect()
    if odd:
        raise ValueError(f"files are not those expected: {sorted({r.path for r in odd})}")
    told = files.select("path", "content").join(expected.select("path", F.col("sha256").alias("_told")), "path")
    same = require(told, "sha2(content, 256) = _told", "files are not those expected")
    # The condition stays in front of the generator, and both see the same row.
    lines = same.select("path", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    return lines.where("trim(line) <> ''")


def verified_events(spark: SparkSession, *paths: str, expected: DataFrame | None = None) -> DataFrame:
    """All events of the files after a look at the whole: sequences without gaps, each event_id once.

    ``expected``: (path, sha256) of the files, which have to be exactly these with exactly these bytes; the
    events are parsed from the bytes that are digested (verified_lines).
    """
    if expected is None:
        rows = read_events(spark, *paths)
    else:
        lines = verified_lines(spark, *paths, expected=expected)
        parsed = lines.select(F.from_json("line", EVENTS, {"mode": "FAILFAST"}).alias("e")).select("e.*")
        rows = require(parsed, VALID, "not a valid event")
    try:
        if not (gaps := sequence_gaps(rows).where("NOT contiguous").limit(5)).isEmpty():
            raise ValueError(f"sequences have gaps: {[r.session_id for r in gaps.collect()]}")
        if not repeated(rows, "event_id").isEmpty():
            raise ValueError("an event_id stands more than once")
    except PySparkException as e:
        if "files are not those expected" in str(e):
            raise ValueError("files are not those expected") from e
        raise
    return rows


def manifest_problems(manifests: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, problem) where finalised sessions and their events disagree; none in a sound store.

    ``manifests``: session_id, event_files, event_count and status. ``events``: session_id and file, one row an
    event. A session needs its manifest, its manifest's number of events, and events in exactly the files that
    the manifest lists; one that is still running is not looked at.
    """
    done = manifests.where("status <> 'running'").select("session_id", "event_files", "event_count")
    counts = events.groupBy("session_id").agg(F.count("*").alias("n"))
    both = done.join(counts, "session_id", "left")
    number = both.where("coalesce(n, 0) <> event_count").select("session_id", F.lit("number of events differs").alias("problem"))
    running = manifests.where("status = 'running'").select("session_id")
    unknown = counts.join(done.select("session_id").unionByName(running), "session_id", "left_anti").select("session_id", F.lit("no manifest").alias("problem"))
    listed = done.select("session_id", F.explode("event_files").alias("file")).distinct().withColumn("listed", F.lit(True))
    seen = events.join(done.select("session_id"), "session_id", "left_semi").select("session_id", "file").distinct().withColumn("seen", F.lit(True))
    files = listed.join(seen, ["session_id", "file"], "full_outer").where("listed IS NULL OR seen IS NULL")
    told = files.select("session_id", F.when(F.col("seen").isNull(), F.concat(F.lit("no events in "), "file")).otherwise(F.concat(F.lit("not listed: "), "file")).alias("problem"))
    twice = manifests.groupBy("session_id").count().where("count > 1").select("session_id", F.lit("more than one manifest").alias("problem"))
    return number.unionByName(unknown).unionByName(told).unionByName(twice)


def read_manifests(spark: SparkSession, *paths: str, finalised: bool = False, selected: list[str] | None = None) -> DataFrame:
    """Manifests in replay order; only completed and cancelled sessions if ``finalised``, only those ``selected``."""
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").option("multiLine", True).json(list(paths))
    rows = rows.where(F.col("status").isin("completed", "cancelled")) if finalised else rows
    return (rows if selected is None else rows.where(F.col("session_id").isin(*selected))).orderBy(*replay_order())


def replay_order() -> list[Column]:
    """Sessions by the instant of their start, not by its text, then by id."""
    return [F.to_timestamp("started_at"), F.col("session_id")]


def read_artifacts(spark: SparkSession, *paths: str) -> DataFrame:
    """(ref, content, size) of stored files: the ref is made from the bytes, not from the file's name."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("ref"), "content", F.col("length").alias("size"))


def verified_artifacts(refs: DataFrame, artifacts: DataFrame, *, limit: int = 4 << 20) -> DataFrame:
    """``refs`` (ref) with their content; a ref without bytes, or with more than ``limit``, fails the job."""
    joined = refs.join(artifacts, "ref", "left")
    return require(joined, f"content IS NOT NULL AND size <= {limit}", "artifact is missing or too large")


def put_artifacts(known: DataFrame, new: DataFrame) -> DataFrame:
    """(ref, content) of the contents (content) that ``known`` (ref) lacks, each once."""
    fresh = new.select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("ref"), "content").dropDuplicates(["ref"])
    return fresh.join(known.select("ref"), "ref", "left_anti")


def snapshot_identity(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, sha256, bytes) of each file, to be compared with what is expected before it is read."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
