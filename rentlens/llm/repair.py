"""Conversation structure repair by a rank-convergence parallel Viterbi search.

Turns that are blank, repeated or cut off, and roles that do not alternate, are
mended by the cheapest edits that make the role initials read ``(s?(ua)+)?``:

    Keep 0 (+5 if truncated) | Rerole to user / assistant 1 (+5 if truncated)
    Delete 2 (always, for blank and duplicate turns) | Insert an empty turn 5

A conversation is a path through four states (nothing yet, behind a system
turn, behind a user turn, behind an assistant turn); the cost still to come is
a vector of four numbers, and a turn turns the vector behind it into the one
before it. A long conversation may lie in many chunks:

1. Rows are range-partitioned by conversation and turn (a conversation that
   holds a third of all rows spans many partitions, equal rows included) and
   written; a chunk is a conversation's rows in a stretch of SEGMENT rows.
2. Every chunk starts from a speculative vector: that of a conversation's end.
3. Fix-up passes run a chunk again from the vector that its successor starts
   with. Only differences between a vector's numbers matter, so a pass is over
   where the new vector differs from the old one by a constant; there are few
   vectors up to constants, and a chunk remembers what it made of each.
4. With all vectors stitched, every chunk traces the cheapest edits from each
   state it may be entered in, the least one in ASCII order first; following
   the states from the first chunk on picks one trace a chunk.

Chunk summaries are one row for each end of a segment. Only the digest of a
whole repaired conversation needs its rows in one task, where they are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rentlens.llm.chat import _emit, _stream
from rentlens.llm.common import ship, struct_of
from rentlens.session import materialize

#: Bits of a row's number that tell the rows of a segment apart (65536 rows).
SEGMENT_BITS = 16
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 5, 1, 2, 5
#: Role initials; any other role is number 3.
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
#: The state behind an inserted turn, or behind a turn that got the role that fits, by the state before it.
FITTING = (2, 2, 3, 2)
#: The state behind a kept turn, by initial and state before; none if it does not fit.
KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
#: Cost still to come at the end of a conversation, by state.
END = (0, 2 * INSERT, INSERT, 0)
#: Edits in a trace: D, K, U / A (rerole to user / assistant), u / a (insert user / assistant); in an audit R and I.
TRACE, AUDIT = "UAua", "RRII"
#: What ends a conversation that its last chunk leaves in a state.
TRAIL = ("", "ua", "a", "")


def normal(vector: tuple) -> tuple:
    low = min(vector)
    return tuple(x - low for x in vector)


class Steps:
    """What a turn makes of a vector, remembered by (vector up to a constant, turn). A turn is its initial's number
    twice, plus 1 if it is truncated."""

    def __init__(self):
        self.before: dict[tuple, tuple] = {}
        self.traces: dict[tuple, tuple] = {}

    def _vectors(self, after: tuple, turn: int) -> tuple[list[int], list[int]]:
        """(costs of the edits of this turn alone, costs with insertions in front of it), by state."""
        kept, cut = KEPT[turn >> 1], KEEP_TRUNCATED * (turn & 1)
        bare = []
        for q in range(4):
            best = min(DELETE + after[q], REROLE + cut + after[FITTING[q]])
            bare.append(best if kept[q] is None else min(best, cut + after[kept[q]]))
        return bare, [min(bare[q], INSERT + bare[FITTING[q]], 2 * INSERT + bare[FITTING[FITTING[q]]]) for q in range(4)]

    def back(self, after: tuple, turn: int) -> tuple:
        """The vector before a turn, up to a constant, from the one behind it."""
        got = self.before.get((after, turn))
        if got is None:
            got = self.before[after, turn] = normal(self._vectors(after, turn)[1])
        return got

    def trace(self, after: tuple, turn: int, state: int) -> tuple[str, int, int]:
        """(least cheapest edits up to this turn, their cost, the state behind it)."""
        got = self.traces.get((after, turn, state))
        if got is None:
            got = self.traces[after, turn, state] = self._trace(after, turn, state)
        return got

    def _trace(self, after: tuple, turn: int, state: int) -> tuple[str, int, int]:
        total = self._vectors(after, turn)[1]
        kept, cut = KEPT[turn >> 1], KEEP_TRUNCATED * (turn & 1)
        edits, cost = "", 0
        while True:
            to = FITTING[state]
            if total[state] == DELETE + after[state]:
                return edits + "D", cost + DELETE, state
            if total[state] == INSERT + total[to]:
                edits, cost, state = edits + "ua"[to - 2], cost + INSERT, to
                continue
            if kept[state] is not None and total[state] == cut + after[kept[state]]:
                return edits + "K", cost + cut, kept[state]
            return edits + "UA"[to - 2], cost + REROLE + cut, to


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the damaged rows: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties
    its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind, text = F.col("kind"), F.coalesce("text", blank)
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        copies.alias("copy")).drop("copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """The turns, written in order with a number ``id`` that rises along it: by conversation, turn (null first), role
    and SHA-256 of the text; equal rows by chance."""
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"),
                        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    keys = ["conv_id", "turn", "role", "sha", "chance"]
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("chance", F.xxhash64(F.monotonically_increasing_id()))
    return materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("chance")
                       .withColumn("id", F.monotonically_increasing_id()))


def _narrow(rows: DataFrame) -> DataFrame:
    """(seg, id, conv_id, initial, fault, turn_kind) by segment, in order: fault 0 none, 1 blank, 2 duplicate, 3
    truncated; turn_kind is -1 if the row must go."""
    white = " \t\n\x0b\x0c\r"
    last = F.right(F.rtrim(F.col("text"), F.lit(white)), F.lit(1))
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    bodies = rows.select("id", "conv_id", "role", "sha")
    firsts = bodies.groupBy("conv_id", "role", "sha").agg(F.min("id").alias("first")).select("first")
    marked = rows.select("id", "conv_id", initial.cast("int").alias("initial"), (last == "").alias("blank"),
                         (~last.isin(".", "!", "?")).alias("open"))
    marked = marked.join(firsts, F.col("id") == F.col("first"), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("open"), 3).otherwise(0).cast("int")
    kind = F.when(fault.isin(1, 2), -1).otherwise(F.col("initial") * 2 + (fault == 3).cast("int")).cast("int")
    out = marked.select(F.shiftright("id", SEGMENT_BITS).alias("seg"), "id", "conv_id", "initial", fault.alias("fault"),
                        kind.alias("turn_kind"))
    return materialize(out.repartition("seg").sortWithinPartitions("seg", "id"))


class Run:
    """A conversation's rows in a segment."""

    __slots__ = ("seg", "conv", "first_id", "initials", "faults", "kinds", "end", "opens", "closes")

    def __init__(self, seg, conv, first_id, end):
        self.seg, self.conv, self.first_id, self.end = seg, conv, first_id, end
        self.initials, self.faults, self.kinds = [], [], []
        self.opens = self.closes = False

    def start(self, steps: Steps, end: tuple) -> tuple:
        """The vector before the first row, from the one behind the last."""
        for kind in reversed(self.kinds):
            if kind >= 0:
                end = steps.back(end, kind)
        return end

    def restart(self, steps: Steps, end: tuple, old_end: tuple, old_start: tuple) -> tuple:
        """``start`` from another vector: over as soon as it differs from the old run's by a constant."""
        for kind in reversed(self.kinds):
            if end == old_end:
                return old_start
            if kind >= 0:
                end, old_end = steps.back(end, kind), steps.back(old_end, kind)
        return end

    def variants(self, steps: Steps, end: tuple, states) -> list[dict]:
        """The trace from each state that the run may be entered in: edits of every row, cost, state behind it."""
        after = []
        for kind in reversed(self.kinds):
            after.append(end)
            if kind >= 0:
                end = steps.back(end, kind)
        after.reverse()
        out = []
        for state in states:
            edits, total = [], 0
            for kind, v in zip(self.kinds, after):
                did, cost, state = ("D", DELETE, state) if kind < 0 else steps.trace(v, kind, state)
                edits.append(did)
                total += cost
            out.append({"exit": state, "cost": total, "edits": edits})
        return out


def _runs(stream: Iterator[tuple]) -> Iterator[Run]:
    """The runs of sorted rows (seg, id, conv_id, initial, fault, turn_kind[, end]), ``opens`` and ``closes`` set on
    the first and the last of a segment. A vector at ``end`` holds for the last run."""
    run = None
    for seg, at, conv, initial, fault, kind, *end in stream:
        if run is None or run.seg != seg or run.conv != conv:
            if run is not None:
                run.closes = run.seg != seg
                yield run
            opens = run is None or run.seg != seg
            run = Run(seg, conv, at, tuple(end[0]) if end and end[0] is not None else END)
            run.opens = opens
        run.initials.append(initial)
        run.faults.append(fault)
        run.kinds.append(kind)
    if run is not None:
        run.closes = True
        yield run


def _mapped(rows: DataFrame, fn, schema) -> DataFrame:
    """``fn`` over the runs of each partition's rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(fn(_runs(_stream(batches)), Steps()), arrow)

    return rows.mapInArrow(run, schema)


def _text(vector: tuple) -> str:
    return ",".join(map(str, vector))


def _vector(text: str) -> tuple:
    return tuple(map(int, text.split(",")))


def _stitched(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first_id and end of every chunk of a conversation that spans several, the vector behind its last row; and
    those chunks: seg, conv_id, first_id)."""
    conv = rows.schema["conv_id"].dataType
    memo = (("ends", "array<string>"), ("starts", "array<string>"))

    def heads(runs, steps):
        for r in runs:
            if r.opens or r.closes:
                yield r.seg, r.conv, r.first_id, [_text(END)], [_text(r.start(steps, END))]

    chunks = materialize(_mapped(rows, heads, struct_of(("seg", "bigint"), ("conv_id", conv), ("first_id", "bigint"), *memo)))
    several = chunks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    chain = materialize(chunks.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"))

    def resolve(frame: pd.DataFrame) -> pd.DataFrame:
        """Vectors from the last chunk to the first. A chunk that has not met its vector yet is marked, and hands on
        what it made of the speculative one."""
        out, end = [], _text(END)
        for x in frame.sort_values("first_id", ascending=False).itertuples():
            known = dict(zip(x.ends, x.starts))
            out.append((x.seg, x.first_id, end, end not in known, [*{*x.ends, *x.starts}]))
            end = known.get(end, known[_text(END)])
        return pd.DataFrame(out, columns=["seg", "first_id", "end", "missing", "met"])

    while True:
        ends = materialize(chain.groupBy("conv_id").applyInPandas(
            resolve, "seg bigint, first_id bigint, end string, missing boolean, met array<string>"))
        missing = ends.where("missing")
        if missing.isEmpty():
            return ends.select("seg", "first_id", "end"), chain.select("seg", "conv_id", "first_id")
        met = ends.select(F.explode("met").alias("v")).union(ends.select("end")).distinct()  # vectors up to constants: few
        tried = [_vector(r.v) for r in met.collect()]

        def again(runs, steps, tried=tuple(tried)):
            for r in runs:
                if r.opens or r.closes:
                    old = r.start(steps, END)
                    yield r.first_id, [*map(_text, tried)], [_text(r.restart(steps, v, END, old)) for v in tried]

        redo = rows.join(missing.select(F.col("seg").alias("s")).distinct(), F.col("seg") == F.col("s"), "left_semi")
        fresh = _mapped(redo.repartition("seg").sortWithinPartitions("seg", "id"), again, struct_of(
            ("first", "bigint"), ("new_ends", "array<string>"), ("new_starts", "array<string>")))
        chain = materialize(chain.join(fresh, F.col("first_id") == F.col("first"), "left").select(
            "seg", "conv_id", "first_id", F.coalesce("new_ends", "ends").alias("ends"),
            F.coalesce("new_starts", "starts").alias("starts")))


class Repair:
    """The damaged turns and their cheapest repair.

    ``turns`` needs conv_id, turn, role, text; further columns are ignored. Null roles and texts count as one space,
    rows with a null conv_id are one conversation, rows with a null turn come first. Rows of equal turn go by role and
    SHA-256 of the text (equal rows are copies: all but one are duplicates). An empty table gives empty results.
    """

    def __init__(self, turns: DataFrame):
        self.rows = _ordered(turns)
        narrow = _narrow(self.rows)
        ends, chain = _stitched(narrow)
        # only the last run of a segment can have another vector behind it than that of a conversation's end
        ends = ends.where(F.col("end") != _text(END)).select(
            F.col("seg").alias("s"), F.transform(F.split("end", ","), lambda x: x.cast("int")).alias("end"))
        rows = narrow.join(ends, F.col("seg") == F.col("s"), "left").drop("s")
        traced = materialize(_mapped(rows.repartition("seg").sortWithinPartitions("seg", "id"), self._trace, struct_of(
            ("seg", "bigint"), ("conv_id", turns.schema["conv_id"].dataType), ("first_id", "bigint"),
            ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("illegal", "bigint"),
            ("first_initial", "int"), ("last_initial", "int"),
            ("variants", "array<struct<exit:int,cost:bigint,edits:array<string>>>"))))
        self.runs = materialize(self._chosen(traced, chain))

    @staticmethod
    def _trace(runs: Iterator[Run], steps: Steps) -> Iterator[tuple]:
        letter = INITIALS + "?"
        for r in runs:
            illegal = sum(letter[x] + letter[y] not in LEGAL for x, y in zip(r.initials, r.initials[1:]))
            states = range(4) if r.opens else (0,)
            yield (r.seg, r.conv, r.first_id, *(r.faults.count(f) for f in (1, 2, 3)), illegal, r.initials[0], r.initials[-1],
                   r.variants(steps, r.end if r.closes else END, states))

    @staticmethod
    def _chosen(traced: DataFrame, chain: DataFrame) -> DataFrame:
        """Each run with the trace from the state that it is entered in, and what follows a conversation's last one."""

        def follow(frame: pd.DataFrame) -> pd.DataFrame:
            out, state, before = [], 0, None
            frame = frame.sort_values("first_id")
            for n, x in enumerate(frame.itertuples(), 1):
                border = before is not None and (INITIALS + "?")[before] + (INITIALS + "?")[x.first_initial] not in LEGAL
                out.append((x.first_id, state, int(border), n == len(frame)))
                state, before = int(x.exits[state if len(x.exits) > 1 else 0]), x.last_initial
            return pd.DataFrame(out, columns=["at", "entered", "border", "last"])

        mine = traced.join(chain.select(F.col("first_id").alias("f")), F.col("first_id") == F.col("f"), "left_semi")
        exits = F.transform("variants", lambda v: v.exit)
        picked = (mine.select("conv_id", "first_id", "first_initial", "last_initial", exits.alias("exits"))
                  .groupBy("conv_id").applyInPandas(follow, "at bigint, entered int, border bigint, last boolean"))
        runs = traced.join(picked, F.col("first_id") == F.col("at"), "left")
        taken = F.element_at("variants", F.when(F.size("variants") > 1, F.coalesce("entered", F.lit(0))).otherwise(0) + 1)
        runs = runs.withColumn("v", taken)
        trail = F.element_at(F.array(*map(F.lit, TRAIL)), F.col("v.exit") + 1)
        runs = runs.withColumn("trail", F.when(F.coalesce("last", F.lit(True)), trail).otherwise(""))
        return runs.select("conv_id", "first_id", "blank", "duplicate", "truncated",
                           (F.col("illegal") + F.coalesce("border", F.lit(0))).alias("illegal"),
                           (F.col("v.cost") + INSERT * F.length("trail")).alias("cost"), F.col("v.edits").alias("edits"), "trail")

    def summary(self) -> DataFrame:
        """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        written = F.translate(F.concat(F.array_join("edits", ""), F.col("trail")), TRACE, AUDIT)
        parts = F.array_sort(F.collect_list(F.struct("first_id", written.alias("audit"))))
        totals = self.runs.groupBy("conv_id").agg(
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
            F.array_join(F.transform(parts, lambda x: x.audit), "").alias("audit"))
        wide = "decimal(20,0)"  # turns may lie further apart than a long holds; gaps are then null
        gaps = (self.rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy(F.col("conv_id").alias("c"))
                .agg(F.coalesce((F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("turn")), F.lit(0)).try_cast("bigint").alias("gaps")))
        return totals.join(gaps, F.col("conv_id").eqNullSafe(F.col("c"))).select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def repaired(self) -> DataFrame:
        """The repaired turns: conv_id, id, nth (their order), turn (null if inserted), role, text, edit (K, R or I)."""
        role = lambda e: F.when(e.isin("U", "u"), "user").when(e.isin("A", "a"), "assistant")
        each = self.runs.select("conv_id", "first_id", F.posexplode(F.concat("edits", F.array("trail"))).alias("at", "edits"))
        size = each.select("conv_id", (F.col("first_id") + F.col("at")).alias("at_id"), "edits", "at", "first_id")
        letters = size.select("conv_id", "at_id", F.posexplode(F.split("edits", "(?!^)")).alias("nth", "e")).where("e not in ('D', '')")
        # an inserted turn needs no row; what follows the last row stands behind it, before the next run's first row
        inserted = letters.where(F.col("e").isin("u", "a")).select(
            "conv_id", F.col("at_id").alias("id"), "nth", F.lit(None).cast(self.rows.schema["turn"].dataType).alias("turn"),
            role(F.col("e")).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
        kept = letters.where(~F.col("e").isin("u", "a")).select(F.col("at_id"), "nth", "e")
        kept = self.rows.join(kept, F.col("id") == F.col("at_id")).select(
            "conv_id", "id", "nth", "turn", F.coalesce(role(F.col("e")), F.col("role")).alias("role"), "text",
            F.translate("e", "UA", "RR").alias("edit"))
        return kept.unionByName(inserted)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired turns as lines ``role:text``. A conversation's lines meet in one
    task, where they are streamed."""

    def rows(stream):
        conv = digest = None
        for c, _, _, role, text in stream:
            if digest is None or c != conv:
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield conv, digest.hexdigest()

    from pyspark.sql.pandas.types import to_arrow_schema
    schema = struct_of(("conv_id", repaired.schema["conv_id"].dataType), ("repaired_sha256", "string"))
    arrow = to_arrow_schema(schema)
    ship(repaired.sparkSession)
    src = repaired.select("conv_id", "id", "nth", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "id", "nth")
    return src.mapInArrow(lambda batches: _emit(rows(_stream(batches)), arrow), schema)


def repair_report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: the summary of the repair of ``turns`` and the digest of the repaired
    conversation; zeros, an empty audit and the empty string's digest where no turn is left."""
    done = Repair(turns)
    ids = conversations.select(F.col("conv_id").alias("c")).distinct()
    out = ids.join(done.summary(), F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    sha = repaired_digests(done.repaired()).withColumnRenamed("conv_id", "d")
    out = out.join(sha, F.col("c").eqNullSafe(F.col("d")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    zeros = [(F.col(c) if c == "gaps" else F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in numbers]
    zeros[0] = F.when(F.col("audit").isNull(), 0).otherwise(F.col("gaps")).cast("bigint").alias("gaps")
    return out.select(F.col("c").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def report_sql() -> str:
    """DuckDB SQL of ``repair_report`` of the damaged table: the best (cost, audit, text) of every state, row by row."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    codes = f"list_transform(range(1, length({key}) + 1), lambda i: CAST(ord(substr({key}, i, 1)) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"
    white = "\\x20\\x09-\\x0D"

    def best(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"

    def then(s: str, cost: str, letter: str, line: str = "''") -> str:
        return (f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': {s}.r || {line}}} END")

    def line(role: str, text: str = "''") -> str:
        return f"chr(10) || {role} || ':' || {text}"

    def closed(source: str) -> str:
        two = best("s2", *[then(f"s{q}", "5", "I", line("'user'")) for q in (0, 1, 3)])
        return (f"SELECT *, {best('s3', then('t2', '5', 'I', line(repr('assistant'))))} AS t3 "
                f"FROM (SELECT *, {two} AS t2 FROM {source})")

    state = {0: "s0", 1: "s1", 2: "t2", 3: "t3"}
    may, cut = "NOT blank AND NOT dup", "CASE WHEN cut THEN 5 ELSE 0 END"

    def into(q: int) -> str:
        options = [then(state[q], "2", "D")]
        for p in range(4):
            if KEPT[0][p] == q:
                options.append(f"CASE WHEN {may} AND ini = 's' THEN {then(state[p], cut, 'K', line('role', 'text'))} END")
            for n, initial in ((1, "u"), (2, "a")):
                if KEPT[n][p] == q:
                    options.append(f"CASE WHEN {may} AND ini = '{initial}' THEN {then(state[p], cut, 'K', line('role', 'text'))} END")
                    name = "'user'" if n == 1 else "'assistant'"
                    options.append(f"CASE WHEN {may} THEN {then(state[p], f'1 + {cut}', 'R', line(name, 'text'))} END")
        return best(*options)

    kind = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE kind <> 0),
placed AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
faulty AS MATERIALIZED (
  SELECT *, NOT regexp_matches(text, '[^{white}]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
         NOT regexp_matches(text, '[.!?][{white}]*$') AS cut, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'r': ''}} AS {kind}) AS s0,
         CAST(NULL AS {kind}) AS s1, CAST(NULL AS {kind}) AS s2, CAST(NULL AS {kind}) AS s3 FROM faulty
  UNION ALL
  SELECT w.conv_id, f.i, CAST({into(0)} AS {kind}), CAST({into(1)} AS {kind}), CAST({into(2)} AS {kind}), CAST({into(3)} AS {kind})
  FROM ({closed('walk')}) w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
done AS (
  SELECT conv_id, {best('s0', 't3')} AS b FROM ({closed('walk')}) w
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(NOT blank AND dup) AS duplicate, count_if(NOT blank AND NOT dup AND cut) AS truncated,
         count_if(i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(s.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(s.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(s.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(s.illegal, 0) AS BIGINT) AS illegal, coalesce(d.b.c, 0) AS cost, coalesce(d.b.a, '') AS audit,
       sha256(coalesce(substr(d.b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id"""
