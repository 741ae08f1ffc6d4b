import random
import re
from hashlib import sha256
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from momentrank.llm import repair

from .oracle import same

GOOD = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(rows):
    """(cost, audit, lines) of the cheapest repair of ``(role, text, fault)`` rows, over all edits with up to three insertions in a place."""
    choices = []
    for role, text, fault in rows:
        own = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault else 0
            own += [(more, "K", (role, text)), *[(3 + more, "R", (r, text)) for r in ("user", "assistant")]]
        choices.append(own)
    gaps = [[(3 * k, "I" * k, s) for k in range(4) for s in product(("user", "assistant"), repeat=k)] for _ in range(len(rows) + 1)]
    parts = [x for pair in zip(gaps, choices) for x in pair] + [gaps[-1]]
    # grow sequences place by place; those that no ending can mend are left out by the pattern's states, found with the regex alone
    alive = [(0, "", [])]
    for part in parts:
        grown = {}
        for cost, audit, said in alive:
            for more, letters, what in part:
                new = said + ([(r, "") for r in what] if letters[:1] in ("I", "") else [what] if what else [])
                told = "".join(r[:1] or " " for r, _ in new)
                if not any(GOOD.match(told + end) for end in ("", "a", "ua")):
                    continue
                key = ("" if not told else "s" if told == "s" else told[-1])
                best = grown.get(key)
                if best is None or (cost + more, audit + letters) < best[:2]:
                    grown[key] = (cost + more, audit + letters, new)
        alive = list(grown.values())
    return min((c, a, s) for c, a, s in alive if GOOD.match("".join(r[:1] for r, _ in s)))


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told = set(), []
        for _, role, text in own:
            stripped = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        counts = [sum(f == k for *_, f in told) for k in ("blank", "duplicate", "truncated")]
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, lines = exhaustive(told)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, bad, cost, audit, sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", None, "Why? ", "a\nb.", f"own {t}."])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows + [(None, 1, "user", "x."), (None, None, "assistant", "y."), (999, 5, "user", "Long. " * 20_000)]


def query(spark, rows, folder):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.withColumns({"uid": F.lit(1), "body": F.lit("x"), "key": F.lit(2)}).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return sorted((tuple(r) for r in repair.op12_repair(spark, str(folder)).collect()), key=str)


def test_matches_sql(spark, sf):
    same(spark, repair.op12_repair, repair.OP12_SQL, sf)


@pytest.mark.parametrize("bits", [1, 10])
def test_odd_rows_match_all_edits(spark, tmp_path, monkeypatch, bits):
    """Blocks of two rows make chains of blocks."""
    monkeypatch.setattr(repair, "BITS", bits)
    rows = made(bits, 60, 9)
    rows += [r for r in rows if r[0] == 3]
    rows += [(2000, t, r, "t.") for t, r in enumerate(["user", "assistant"] * 40)] + [(2001, None, "user", "same.")] * 50
    assert query(spark, rows, tmp_path) == expected(rows)


def test_no_rows(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_agenda_matches_a_plain_sweep(spark):
    """Long blocks from each state, against minima row by row."""
    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.choice("suat"), rng.choice([None, None, "blank", "truncated"])) for _ in range(rng.randint(0, 30))]
        got = repair.lightest(len(rows), range(4), repair.row_edits(rows), True)
        for p in range(4):
            best = {p: (0, "")}
            for i in range(len(rows) + 1):
                for _ in range(2):
                    for q, (c, a) in list(best.items()):
                        to = repair.NEXT[repair.WANTED[q][0]][q]
                        best[to] = min(best.get(to, (c + 3, a + "I")), (c + 3, a + "I"))
                if i < len(rows):
                    new = {}
                    for q, (c, a) in best.items():
                        for more, letters, to in repair.row_edits(rows)(i, q):
                            new[to] = min(new.get(to, (c + more, a + letters)), (c + more, a + letters))
                    best = new
            assert {q: (c, "".join(x.letters for x in t.parts())) for (s, q), (c, t) in got.items() if s == p} == best


def test_parts_of_other_key_types(spark):
    rows = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("b", 1, "assistant", "Oh.")], "conv_id string, turn int, role string, body string")
    got = {r.conv_id: r for r in repair.reports(rows, rows.select("conv_id")).collect()}
    assert got["a"].audit == "KK" and got["a"].cost == 0
    assert got["b"].audit == "IK" and got["b"].cost == 3
