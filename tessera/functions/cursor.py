"""Opaque page cursors: canonical JSON with its digest, bound to a query, its scope and a generation."""

from __future__ import annotations

import base64
import hashlib
import json

PREFIX, VERSION = "tscur1.", 1


def _canonical(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def encode(kind: str, scope: str, generation: str, key: tuple[str, ...]) -> str:
    payload = {"kind": kind, "scope": scope, "generation": generation, "key": list(key), "version": VERSION}
    token = _canonical({"payload": payload, "sha256": hashlib.sha256(_canonical(payload)).hexdigest()})
    return PREFIX + base64.urlsafe_b64encode(token).decode().rstrip("=")


def decode(cursor: str, kind: str, scope: str) -> tuple[str, tuple[str, ...]]:
    """(generation, key) of a cursor that was made for this query; anything else is a ValueError."""
    if not cursor.startswith(PREFIX):
        raise ValueError("not a cursor")
    body = cursor[len(PREFIX) :]
    try:
        envelope = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
        payload = envelope["payload"]
        known = envelope["sha256"] == hashlib.sha256(_canonical(payload)).hexdigest()
        own = (payload["kind"], payload["scope"], payload["version"]) == (kind, scope, VERSION)
        found = payload["generation"], tuple(payload["key"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("cursor is malformed") from e
    if not known or not own or encode(kind, scope, *found) != cursor:
        raise ValueError("cursor does not belong to this query")
    return found
