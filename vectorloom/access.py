"""Keys and what they allow, kept on the driver; a grant may hold a payload filter, which then applies to every row that the key's owner reads."""

from __future__ import annotations

import hashlib
import secrets
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from .errors import AccessDenied

#: Each action includes those before it.
ACTIONS = ("read", "write", "admin")


@dataclass(frozen=True)
class Grant:
    """An action on one collection, or on all (``*``); ``where`` limits the rows that are read."""

    action: str
    collection: str = "*"
    where: dict | None = None

    def covers(self, action: str, collection: str) -> bool:
        return self.collection in ("*", collection) and ACTIONS.index(action) <= ACTIONS.index(self.action)


@dataclass
class _Key:
    description: str
    grants: tuple[Grant, ...]
    until: float | None
    made: float = field(default_factory=time.time)


class Access:
    """The keys. Only the SHA-256 of a key is kept, so a key that is lost can't be shown again."""

    def __init__(self):
        self._keys: dict[str, _Key] = {}

    @staticmethod
    def _hash(key: str) -> str:
        return hashlib.sha256(key.encode()).hexdigest()

    def create_key(self, description: str, grants: Sequence[Grant], seconds: float | None = None) -> str:
        """A new key, valid for so many seconds or until it is revoked."""
        for g in grants:
            if g.action not in ACTIONS:
                raise ValueError(f"an action is one of {', '.join(ACTIONS)}")
        key = f"vl_{secrets.token_urlsafe(24)}"
        self._keys[self._hash(key)] = _Key(description, tuple(grants), None if seconds is None else time.time() + seconds)
        return key

    def revoke(self, key: str) -> bool:
        return self._keys.pop(self._hash(key), None) is not None

    def list_keys(self) -> list[tuple[str, float, float | None]]:
        """(description, made at, valid until) of each key."""
        return [(k.description, k.made, k.until) for k in self._keys.values()]

    def require(self, key: str | None, action: str, collection: str, now: float | None = None) -> list[dict]:
        """The filters to read by, any of which may let a row pass; none means all rows. An error if the key doesn't allow the action."""
        k = self._keys.get(self._hash(key or ""))
        if k is None or (k.until is not None and k.until <= (now or time.time())):
            raise AccessDenied("no valid key")
        found = [g for g in k.grants if g.covers(action, collection)]
        if not found:
            raise AccessDenied(f"{action} on {collection}")
        return [] if any(g.where is None for g in found) else [g.where for g in found]
