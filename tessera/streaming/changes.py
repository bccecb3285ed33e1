"""Change history as a stream sink: checkpoint, changes and outbox become visible together.

State lies in three tables in hash buckets (``sources/buckets.py``): ``changes`` (by change), ``processed`` (by
session), and ``outbox`` (by bundle). A batch reads and writes the buckets that its rows fall into and no others, so
its cost follows the batch, and all it writes becomes the state with one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import knowledge
from tessera.operators.detect import apply_session, evidence_conflicts, with_profile
from tessera.sources.buckets import Buckets
from tessera.sources.shared import materialise

SCHEMAS = {
    "changes": "profile string, change_id string, first_seen string, last_seen string, occurrences bigint",
    "processed": "profile string, session_id string, evidence_sha256 string",
    "outbox": "profile string, bundle_id string, session_id string, payload string, payload_sha256 string, created_at string, state string",
}
KEYS = {"changes": ["profile", "change_id"], "processed": ["session_id"], "outbox": ["bundle_id"]}


class ChangeHistory(Buckets):
    """State in commits under ``root``.

    ``apply`` is the function of foreachBatch: a batch has change_id, session_id, started_at and
    evidence_sha256, and profile if there is more than one; rule, kind, path and method go into the
    bundles of the outbox. A batch delivered again finds its commit there and changes nothing. A session
    that comes back with other evidence fails the batch, before anything is written.

    A session counts once in each profile. The sessions whose findings are new to the state, each new one in the first
    session of the batch that has it by start and id, get a bundle in the outbox, which is pending until ``deliver``.
    """

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64):
        super().__init__(spark, root, SCHEMAS, KEYS, buckets)

    # Batches

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if self.commit(batch_id) is not None:
            return
        # A batch is read several times; what is lost of it with an executor is computed again.
        batch = with_profile(batch).persist()
        try:
            self._apply(batch, batch_id)
        finally:
            batch.unpersist()

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        base = self.base(batch_id)
        sessions = batch.select("profile", "session_id", "evidence_sha256").distinct()
        in_processed = self.touched(sessions, "processed", base)
        done = self.read(base, "processed", in_processed)
        if conflicts := evidence_conflicts(done.join(sessions.select("session_id").distinct(), "session_id", "left_semi"), sessions).limit(5).collect():
            raise ValueError(f"evidence of sessions differs from what was processed: {[r.session_id for r in conflicts]}")
        in_changes = self.touched(batch, "changes", base)
        state = self.read(base, "changes", in_changes)
        changed, processed = apply_session(state, done, batch, sessions)
        new = batch.join(done, ["profile", "session_id"], "left_anti").join(state.select("profile", "change_id"), ["profile", "change_id"], "left_anti")
        bundles = materialise(self._bundles(new))
        in_outbox = self.touched(bundles, "outbox", base)
        kept = self.read(base, "outbox", in_outbox)
        outbox = kept.unionByName(bundles.join(kept.select("bundle_id"), "bundle_id", "left_anti"))
        self.publish(batch_id, base, {"changes": (changed, in_changes), "processed": (processed, in_processed), "outbox": (outbox, in_outbox)})

    def _bundles(self, new: DataFrame) -> DataFrame:
        """A pending bundle for each session and profile with findings that are new."""
        for c in ("rule", "kind", "path", "method"):
            new = new if c in new.columns else new.withColumn(c, F.lit(None).cast("string"))
        facts = F.struct("change_id", "rule", "kind", "path", "method")
        first = new.groupBy("profile", "change_id").agg(F.min(F.struct("started_at", "session_id", facts.alias("f"))).alias("m"))
        found = first.select("profile", F.col("m.session_id").alias("session_id"), F.col("m.started_at").alias("created_at"), "m.f.*")
        started = found.groupBy("profile", "session_id").agg(F.min("created_at").alias("created_at"))
        made = knowledge.bundles_by_profile(found)
        return made.join(started, ["profile", "session_id"]).select("profile", "bundle_id", "session_id", "payload", "payload_sha256", "created_at", F.lit("pending").alias("state"))

    def deliver(self, path: str, version: int) -> int:
        """Write the pending bundles to ``path`` and commit as ``version`` that they are; the number of bundles written.

        Bundles are written before the commit; if the call dies between the two, the next one finds them written.
        """
        if self.commit(version) is not None:
            return 0
        base = self.base(version)
        pending = self.read(base, "outbox").where("state = 'pending'")
        n = knowledge.materialise(pending, path)
        touched = self.touched(pending, "outbox", base)
        rows = self.read(base, "outbox", touched if touched else [-1])
        self.publish(version, base, {"outbox": (rows.withColumn("state", F.lit("materialised")), touched)})
        return n

    # Readers

    def latest(self, version: int | None = None, profile: str | None = None) -> DataFrame:
        """The changes of a version (the last one) in the order of their ids, of one profile if it is named."""
        rows = self.read(self.at(version), "changes")
        return (rows if profile is None else rows.where(F.col("profile") == profile)).orderBy("profile", "change_id")

    def get(self, change_id: str, profile: str = "default", version: int | None = None) -> DataFrame:
        """One change; only the files of its bucket are read."""
        commit = self.at(version)
        key = self.spark.createDataFrame([(profile, change_id)], "profile string, change_id string")
        rows = self.read(commit, "changes", self.touched(key, "changes", commit))
        return rows.where((F.col("profile") == profile) & (F.col("change_id") == change_id))

    def outbox(self, version: int | None = None) -> DataFrame:
        """The bundles of a version in the order in which they were made."""
        return self.read(self.at(version), "outbox").orderBy("created_at", "bundle_id")

    def processed(self, version: int | None = None) -> DataFrame:
        return self.read(self.at(version), "processed")

    def problems(self, version: int | None = None) -> DataFrame:
        """(table, key, problem) of rows that no sequence of batches can leave: last before first, no occurrences, repeated keys."""
        commit = self.at(version)
        changes = self.read(commit, "changes")
        order = changes.where("last_seen < first_seen").select(F.lit("changes").alias("table"), F.col("change_id").alias("key"), F.lit("last_seen is before first_seen").alias("problem"))
        none = changes.where("occurrences < 1").select(F.lit("changes").alias("table"), F.col("change_id").alias("key"), F.lit("no occurrence").alias("problem"))
        keys = {"changes": ["profile", "change_id"], "processed": ["profile", "session_id"], "outbox": ["bundle_id"]}
        found = order.unionByName(none)
        for name, columns in keys.items():
            twice = self.read(commit, name).groupBy(*columns).count().where("count > 1")
            found = found.unionByName(twice.select(F.lit(name).alias("table"), F.col(columns[-1]).alias("key"), F.lit("repeated key").alias("problem")))
        return found
