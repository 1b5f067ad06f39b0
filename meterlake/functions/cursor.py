"""Signed cursors of a paged search: a request may go on only where an answer to the same scope ended."""

from __future__ import annotations

import hashlib
import hmac
import json
from base64 import urlsafe_b64decode, urlsafe_b64encode
from dataclasses import dataclass
from datetime import UTC, datetime

#: Fixed values of the format.
VERSION, MOST_KEY, MOST_RECORD = 2, 4096, 32


@dataclass(frozen=True)
class Place:
    """The last activity of a session, and its key."""

    latest: datetime
    key: str


@dataclass(frozen=True)
class Cursor:
    """The range that is searched, the last session that is done with, and the one in which the search stopped, after a record."""

    start: datetime
    end: datetime
    after: Place | None = None
    resume: Place | None = None
    after_record: str | None = None


def _text(at: datetime) -> str:
    return at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def _instant(text: object) -> datetime:
    if not isinstance(text, str):
        raise ValueError("no instant")
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def _pack(data: bytes) -> str:
    return urlsafe_b64encode(data).rstrip(b"=").decode()


def _unpack(text: str) -> bytes:
    return urlsafe_b64decode(text + "=" * (-len(text) % 4))


def _is_key(key: object) -> bool:
    return isinstance(key, str) and 0 < len(key) <= MOST_KEY


def _is_record(record: object) -> bool:
    return isinstance(record, str) and 0 < len(record) <= MOST_RECORD and record.isascii() and record.isdigit()


def _sign(payload: str, secret: str) -> bytes:
    if not secret:
        raise ValueError("a cursor needs a secret")
    return hmac.new(secret.encode(), payload.encode(), hashlib.sha256).digest()


def encode(cursor: Cursor, scope: str, secret: str) -> str:
    """payload.signature, both in the URL's base 64; ValueError for a cursor that could not be read back."""
    places = [p for p in (cursor.after, cursor.resume) if p]
    if cursor.start >= cursor.end or (cursor.resume is None) != (cursor.after_record is None) or not all(_is_key(p.key) for p in places) or (cursor.resume and not _is_record(cursor.after_record)):
        raise ValueError("not a sound cursor")
    place = lambda p: {"latestTs": _text(p.latest), "key": p.key} if p else None
    resume = {"group": place(cursor.resume), "afterRecordId": cursor.after_record} if cursor.resume else None
    body = {"v": VERSION, "scope": scope, "from": _text(cursor.start), "to": _text(cursor.end), "afterGroup": place(cursor.after), "resume": resume}
    payload = _pack(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode())
    return f"{payload}.{_pack(_sign(payload, secret))}"


def decode(text: str | None, scope: str, secret: str) -> Cursor | None:
    """The cursor, or None for one that was not signed with this secret for this scope, or isn't sound."""
    if not text:
        return None
    payload, _, signature = text.partition(".")
    try:
        if not payload or not hmac.compare_digest(_unpack(signature), _sign(payload, secret) if secret else _sign(payload, "")):
            return None
        body = json.loads(_unpack(payload))
    except ValueError:
        if not secret:
            raise
        return None
    try:
        if body["v"] != VERSION or body["scope"] != scope:
            return None
        place = lambda p: Place(_instant(p["latestTs"]), p["key"])
        after, resume = body["afterGroup"], body["resume"]
        out = Cursor(_instant(body["from"]), _instant(body["to"]), after and place(after), resume and place(resume["group"]), resume and resume["afterRecordId"])
    except (KeyError, TypeError, ValueError):
        return None
    sound = out.start < out.end and all(_is_key(p.key) for p in (out.after, out.resume) if p) and (out.resume is None or _is_record(out.after_record))
    return out if sound else None


def encode_place(place: tuple[int, ...], scope: str, secret: str) -> str:
    """A place among rows with keys of whole numbers, signed for a scope."""
    payload = _pack(json.dumps({"v": VERSION, "scope": scope, "after": list(place)}, ensure_ascii=False, separators=(",", ":")).encode())
    return f"{payload}.{_pack(_sign(payload, secret))}"


def decode_place(text: str, scope: str, secret: str) -> tuple[int, ...] | None:
    """The place, or None if the text was not signed with this secret for this scope."""
    payload, _, signature = text.partition(".")
    try:
        if not payload or not hmac.compare_digest(_unpack(signature), _sign(payload, secret)):
            return None
        body = json.loads(_unpack(payload))
    except ValueError:
        return None
    return tuple(body["after"]) if body["v"] == VERSION and body["scope"] == scope else None
