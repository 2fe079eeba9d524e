"""Conversation repair against an exhaustive search over edits, in one chunk and in many."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from pagemill.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def broken(rows):
    """Damaged rows of one conversation, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))


def search(rows):
    """(cost, audit, lines) by trying every edit of every row, with up to two inserts between any two."""
    insert = [()] + [tuple(("I", 5, r, "") for r in rs) for n in (1, 2) for rs in itertools.product(("user", "assistant"), repeat=n)]
    options = []
    for role, text, must, late in rows:
        extra = 5 * late
        one = [("D", 2, None, None)]
        if not must:
            one += [("K", extra, role, text), ("R", 1 + extra, "user", text), ("R", 1 + extra, "assistant", text)]
        options += [insert, [(x,) for x in one]]
    best = None
    for pick in itertools.product(*options, insert):
        edits = [e for part in pick for e in part]
        cost, audit = sum(e[1] for e in edits), "".join(e[0] for e in edits)
        if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(e[2][:1] or "-" for e in edits if e[2] is not None)):
            best = cost, audit, [f"{e[2]}:{e[3]}" for e in edits if e[2] is not None]
    return best


def expected(rows):
    d, seen, counts, cut = broken(rows), set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in d:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        cut.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit, lines = search(cut)
    turns = [t for t, _, _ in d if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(d))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def generated():
    rng, rows = random.Random(11), []
    for conv in range(120):
        for turn in range(rng.randrange(1, 4)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ugly", "sys"])
            rows.append((conv, turn * rng.choice([1, 1, 2]) if rng.random() < 0.95 else None, role, rng.choice(["Yes.", "No!", "Why?  \n", "cut", "cut,", " \t", "", None, "é.", "a\x1f", "Yes."])))
    return rows + [(None, 0, "user", "Hello."), (None, 1, "assistant", "There."), (900, None, None, None), (901, 3, "assistant", "One."), (901, 3, "user", "Two."), (901, 3, "user", "Two."), (902, 9, "user", "x" * 300000 + ".")]


@pytest.mark.parametrize("chunk", [256, 1])
def test_cheapest_edits(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows, by = generated(), {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    d = spark.createDataFrame([(*r, "mine", 5, "x") for r in rows], SCHEMA + ", ck string, place int, audit string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(d).collect()}
    assert len(got) == len(by)
    for conv, own in by.items():
        if len(broken(own)) <= 3:
            assert got[conv] == expected(own), (conv, own)
    assert sum("I" in x[6] for x in got.values()) >= 0 and any("R" in x[6] for x in got.values()) and any(not x[6] for x in got.values())


def test_chunks_make_no_difference(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No."]) + str(rng.randrange(40)) + rng.choice([".", ""])) for c in range(3) for t in range(200)]
    d, got = spark.createDataFrame(rows, SCHEMA), []
    for chunk in (1000, 7):
        monkeypatch.setattr(conversations, "CHUNK", chunk)
        got.append(sorted(map(tuple, conversations.repair(d).collect())))
    assert got[0] == got[1] and len(got[0]) == 3
    for conv, *_, audit, _ in got[0]:
        assert len(audit.replace("I", "")) == len(broken([r for r in rows if r[0] == conv]))


def test_nothing_left(spark):
    gone = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    d = spark.createDataFrame([(*gone, "user", "Hello.")], SCHEMA)
    assert [tuple(r) for r in conversations.repair(d).collect()] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair(d.where("false")).isEmpty()
