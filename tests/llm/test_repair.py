"""Conversation repair against a search over all edit sequences, cheapest and least first."""

import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from rentlens.llm import queries, repair

from helpers import SF, sha

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
WHITE = "\x20\x09-\x0D"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def search(rows):
    """(cost, audit, lines): rows are (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, kept, lines = heapq.heappop(heap)
        key = (i, kept if len(kept) < 2 else kept[-1] + "+")
        if key in done:
            continue
        done.add(key)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[0][:1] for x in lines)):
            return cost, audit, lines

        def go(c, e, j, line=None):
            new = lines + [line] if line else lines
            initials = kept + line[0][:1] if line else kept
            if re.fullmatch("s?(ua)*u?", initials):
                heapq.heappush(heap, (cost + c, audit + e, j, initials, new))

        for r in ("user", "assistant"):
            go(5, "I", i, (r, ""))
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(2, "D", i + 1)
            if not must:
                go(5 * cut, "K", i + 1, (role, text)) if role[:1] in "sua" and role else None
                for r in ("user", "assistant"):
                    go(1 + 5 * cut, "R", i + 1, (r, text))


def brute(original, rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    out = set()
    for conv in {r[0] for r in original}:
        mine = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        seen, faults, todo = set(), Counter(), []
        for _, role, text in mine:
            blank, dup = not re.search(f"[^{WHITE}]", text), (role, text) in seen
            cut = not re.search(rf"[.!?][{WHITE}]*\Z", text)
            seen.add((role, text))
            faults["b" if blank else "d" if dup else "t" if cut else "n"] += 1
            todo.append((role, text, blank or dup, cut))
        turns = {t for t, _, _ in mine if t is not None}
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(mine, mine[1:]))
        cost, audit, lines = search(todo)
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["b"], faults["d"], faults["t"],
                 illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in lines))))
    return out


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert got(queries.op11_repair(spark, SF)) == brute(rows, damaged(rows))


def invented(seed, convs, size):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No", "Why?", "", " \t", None, "go on", "x. ", "a.b"]
    return [(rng.choice([c, c, None if c == 1 else c]), rng.choice([t, t, t, None, t + 2]), rng.choice(roles),
             f"{t} is it." if rng.random() < 0.5 else rng.choice(texts)) for c in range(convs) for t in range(rng.randint(0, size))]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_invented(spark, seed):
    """Nulls in every column, ties, repeats, odd roles, blank texts; extra columns with the operator's own names."""
    rows = invented(seed, 25, 9)
    df = spark.createDataFrame([(*r, 1, "e") for r in rows], SCHEMA + ", id int, edits string").repartition(6)
    assert got(repair.repair_report(df, repair.damage(df))) == brute(rows, damaged(rows))


@pytest.mark.parametrize("bits", [1, 3])
def test_long_conversations_over_chunks(spark, monkeypatch, bits):
    """Chunks of two and eight rows, a conversation with a third of all rows, stretches that pass vectors on unchanged."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    rows = [(0, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(60)]
    rows += [(1, t, "assistant" if t == 59 else "tool", f"cut off {t}") for t in range(60)]
    rows += [(2, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "same.", ""])) for t in range(40)]
    rows += [(3, 7, "user", "copy.")] * 30 + [(4, 0, "system", "s."), (4, 1, "user", "u.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(repair.repair_report(df, df)) == brute(rows, rows)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(repair.repair_report(none, none)) == set()
    some = spark.createDataFrame([(5, 1, "user", "x")], SCHEMA)
    assert got(repair.repair_report(some, none)) == {(5, 0, 0, 0, 0, 0, 0, "", sha(""))}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "assistant", "So."), (2, 0, "user", "Only.")]
    out = repair.Repair(spark.createDataFrame(rows, SCHEMA)).repaired().orderBy("conv_id", "id", "nth").collect()
    assert [(r.conv_id, r.turn, r.role, r.text, r.edit) for r in out if r.conv_id == 1] == [
        (1, 1, "user", "Hello.", "K"), (1, 2, "assistant", "So.", "K")]
    assert not [r for r in out if r.conv_id == 2]  # deleting costs 2, an answer 5


def test_restart_equals_start():
    """A fix-up pass that stops early gives the vector that a whole pass gives."""
    steps, rng = repair.Steps(), random.Random(3)
    vectors = {repair.END}
    for _ in range(300):
        run = repair.Run(0, 0, 0, repair.END)
        run.kinds = [rng.choice([-1, *range(8)]) for _ in range(rng.randint(1, 30))]
        old = run.start(steps, repair.END)
        for v in list(vectors)[:20]:
            assert run.restart(steps, v, repair.END, old) == run.start(steps, v)
            vectors.add(run.start(steps, v))
    assert len(vectors) < 200
