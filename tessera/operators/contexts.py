"""Execution contexts of recorded sessions, and the binding calls that they let through.

A context is known from the frame that creates it to the one that creates it again or destroys it, or until
all contexts of its session are cleared. A call counts if its context is known at that moment, lives in the
observer's world, and its origin is first-party.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.asof import last_known

CREATED, DESTROYED, CLEARED, CALLED = "Runtime.executionContextCreated", "Runtime.executionContextDestroyed", "Runtime.executionContextsCleared", "Runtime.bindingCalled"


def known_contexts(frames: DataFrame) -> DataFrame:
    """``frames`` with context: what is registered for their context_id just then, null if nothing is.

    ``frames``: session_id, sequence, method, context_id, frame_id, world, origin and any other columns.
    context: sequence (of its creation), frame_id, world, origin. Frames without session or context_id
    know no context; of frames with equal sequence the later ones in the order of method count. Neither a
    large session nor a long-lived context is gathered in one task.
    """
    taken = F.col("session_id").isNotNull() & F.col("context_id").isNotNull()
    context = F.struct("sequence", "frame_id", "world", "origin")
    told = F.when(taken & (F.col("method") == CREATED), F.struct(F.lit(True).alias("alive"), context.alias("context")))
    told = told.when(taken & (F.col("method") == DESTROYED), F.struct(F.lit(False).alias("alive"), context.alias("context")))
    order = ["sequence", "method"]
    lived = last_known(frames, ["session_id", "context_id"], order, told, "_lived")
    # A clearing holds for every context of the session that was created before it.
    cleared = F.when(F.col("method") == CLEARED, F.col("sequence"))
    both = last_known(lived, ["session_id"], order, cleared, "_cleared")
    alive = taken & F.coalesce(F.col("_lived.alive"), F.lit(False)) & F.coalesce(F.col("_lived.context.sequence") > F.col("_cleared"), F.lit(True))
    return both.withColumn("context", F.when(alive, F.col("_lived.context"))).drop("_lived", "_cleared")


def observed_calls(frames: DataFrame, *, binding: str, world: str, first_party: Column) -> DataFrame:
    """The calls of ``binding`` that count: session_id, sequence, context_id, payload, frame_id of the context, origin.

    ``first_party``: whether column ``origin`` is first-party. ``frames`` also has name and payload.
    """
    calls = known_contexts(frames).where((F.col("method") == CALLED) & (F.col("name") == binding) & F.col("payload").isNotNull())
    found = calls.where(F.col("context.world") == world).select(
        "session_id", "sequence", "context_id", "payload", F.col("context.frame_id").alias("frame_id"), F.col("context.origin").alias("origin")
    )
    return found.where(F.col("origin").isNotNull() & first_party)
