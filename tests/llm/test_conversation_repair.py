import hashlib
import itertools
import random
import re
import zlib

import pytest

from redactlake.llm import conversation_repair as R

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        number = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(number, text)
        out += [(conv, turn, "user" if number == 4 else role, text)] * {0: 0, 3: 2}.get(number, 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns) by comparing whole suffixes."""
    follow = {"": "us", "s": "u", "u": "a", "a": "u"}  # the last initial said -> what may come

    def best(i, last, inserts):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        new = {"u": "user", "a": "assistant"}
        options = []
        if inserts:
            options += [("I", 3, i, r, new[r] + ":") for r in follow[last] if r in new]
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            options.append(("D", 4, i + 1, last, None))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if role[:1] and role[:1] in follow[last]:
                    options.append(("K", more, i + 1, role[:1], f"{role}:{text}"))
                options += [("R", 3 + more, i + 1, r, f"{new[r]}:{text}") for r in follow[last] if r in new]
        for letter, cost, j, said, line in options:
            rest = look(j, said, inserts - 1 if letter == "I" else 3)
            if rest:
                found.append((cost + rest[0], letter + rest[1], ((line,) if line else ()) + rest[2]))
        return min(found, default=None)

    known = {}

    def look(*key):
        if key not in known:
            known[key] = best(*key)
        return known[key]

    for i in range(len(rows), -1, -1):  # from the end, to stay within Python's recursion limit
        for last in follow:
            look(i, last, 3)
    return look(0, "", 3)


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in damaged(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        said = [r[1:] for r in own]
        faults = faults_of(said)
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = cheapest(said, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def run(df, folder):
    edits = R.repair(R.damage(df), folder)
    return sorted((tuple(r) for r in R.report(edits, df).select(*COLUMNS).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant"] if rng.random() < 0.4 else [("user", "assistant")[turn % 2]])
            role = rng.choice(["system", "tool", "", "useful", None]) if rng.random() < 0.15 else role
            text = rng.choice(["Yes.", "no", "So?\n ", "é!", " \x0b", "", "a\u00a0", None, f"t{rng.randint(0, 3)}.", "..", "\u2003"])
            rows.append((conv, rng.choice([turn, turn, turn * 3, None]), role, text))
        if rng.random() < 0.2 and rows:
            rows.append(rows[-1])
    return rows


def test_against_brute_force(spark, folder):
    rows = made(1)
    expected = brute(rows)
    assert {c for r in expected for c in r[7]} == set("DIKR")
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(7), folder) == expected


def test_conversations_over_many_chunks(spark, folder, monkeypatch):
    """Chunks of two rows: prices pass from chunk to chunk."""
    monkeypatch.setattr(R, "CHUNK_BITS", 1)
    rows = made(2, 40) + [(500, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 50}{'.' * (t % 3)}") for t in range(300)]
    assert run(spark.createDataFrame(rows, SCHEMA), folder) == brute(rows)


def test_every_short_conversation_is_repaired_at_least_cost():
    """All sequences of up to four kinds of rows, against the enumeration of all edits."""
    for n in range(5):
        for kinds in itertools.product([(i, f) for i in range(4) for f in (R.SOUND, R.BLANK, R.TRUNCATED)], repeat=n):
            if n == 4 and hash(kinds) % 7:
                continue
            rows = [("suat"[i] + str(k), str(k)) for k, (i, _) in enumerate(kinds)]
            faults = [{R.SOUND: "", R.BLANK: "blank", R.TRUNCATED: "truncated"}[f] for _, f in kinds]
            number, state, audit = [0], R.START, ""
            for i, f in reversed(kinds):
                number.append(R.before(R.kind_of(i, f), number[-1]))
            for k, (i, f) in enumerate(kinds):
                letters, state = R.moves_of(R.kind_of(i, f), number[n - 1 - k])[state]
                audit += letters
            audit += R.moves_of(R.END, 0)[state][0]
            assert audit == cheapest(rows, faults)[1]


def test_prices_are_feasible_and_tight_and_few():
    found, number = R.price_numbers()
    assert len(found) == len(number) < 100
    for behind in found:
        for kind in range(16):
            arcs, price, settled = R.arcs_of(kind), [0] * 4 + list(behind) + [0], {4, 5, 6, 7}
            for state in range(4):
                R.auction(arcs, price, settled, state)
            assert [min(c + price[to] for _, c, to in arcs[s]) for s in range(4)] == price[:4]


def test_a_long_conversation(spark, folder):
    n = 30_000
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(n)] + [(2, 0, "user", "x " * 100_000 + ".")]
    got = run(spark.createDataFrame(rows, SCHEMA), folder)
    kept = damaged(rows[:-1])
    assert [r[0] for r in got] == [1, 2] and len(got[0][7]) >= len(kept)
    assert got[0][2:5] == tuple(faults_of([r[2:] for r in kept]).count(f) for f in ("blank", "duplicate", "truncated"))


def test_other_columns_and_empty_table(spark, folder):
    rows = [(1, 0, "user", "Hi.", "k", 5), (1, 1, "assistant", "Ho.", "k", 6)]
    df = spark.createDataFrame(rows, SCHEMA + ", kind string, seq int")
    assert run(df, folder) == brute([r[:4] for r in rows])
    assert run(df.filter("turn > 5"), folder + "-2") == []


def test_the_repaired_turns_themselves(spark, folder):
    df = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "B")], "conv long, turn long, role string, text string")
    got = [tuple(r) for r in R.repair(df, folder).orderBy("place").select("edit", "cost", "fault", "new_role", "new_text").collect()]
    assert got == [("I", 3, None, "user", ""), ("K", 0, 0, "assistant", "A."), ("D", 4, 3, None, None)]
