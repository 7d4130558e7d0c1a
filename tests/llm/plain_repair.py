"""Repair of conversations by dynamic programming over plain lists, from the last row to the first."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damage(rows):
    """(conv, turn, role, text) rows after damage; None is one space."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def order(row):
    conv, turn, role, text = row
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


def repaired(rows):
    """The result for the damaged rows of one conversation."""
    rows = sorted(rows, key=order)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    @cache
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            new = "a" if state == "u" else "u"
            cost, audit = best(i, new, inserts + 1)
            found.append((cost + 2, "I" + audit))
        if i < len(rows):
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                if initials[i] in NEXT[state]:
                    cost, audit = best(i + 1, NEXT[state][initials[i]], 0)
                    found.append((cost + extra, "K" + audit))
                cost, audit = best(i + 1, "a" if state == "u" else "u", 0)
                found.append((cost + extra + 2, "R" + audit))
        return min(found, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    lines, state, i = [], "", 0
    for edit in audit:
        wanted = "assistant" if state == "u" else "user"
        role, text = (wanted, "") if edit == "I" else (rows[i][2] if edit == "K" else wanted, rows[i][3])
        i += edit != "I"
        if edit != "D":
            lines.append(f"{role}:{text}")
            state = role[:1]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
