"""Operator 12, conversation structure repair: a run-length program.

A conversation's rows, in order, are symbols: a role (system, user, assistant,
other: by its initial) and a fault (blank, duplicate, truncated, none). The
cheapest edits that make its roles read ``(s?(ua)+)?`` come from a min-plus
program over four states: nothing yet, after s, after u, after a.

*Runs.* Equal consecutive symbols are collapsed; a run of n rows advances the
costs by the binary powers of its symbol's 4 x 4 min-plus transition, which
are cached, so by about log2 n products.

*Chunks.* Products of transitions can be grouped at will, so no task needs a
conversation as a whole: the rows are sorted over all tasks at once and numbered, and
a conversation's rows are cut into chunks of at most CHUNK. A chunk gives
the product of its runs; a conversation's products, one a chunk, give the
costs of all that follows each chunk; with these a chunk unrolls its choices
from each state it may be entered in; the chosen pieces make up the audit.

*Choices.* Where several edits are as cheap, the ASCII-least initial is taken
(Delete, Insert, Keep, Rerole). In a state each initial leads to one next state
only, so the first such choice at each step gives the ASCII-least audit.

The digest of a repaired conversation is one chain of bytes: its lines stream in
order through a task that holds the running digest only. The audit is one string a
conversation, as asked for.

Order: by turn, nulls first; rows of one turn by the first PREFIX characters of
role and text, then by both, so the result doesn't depend on how the table is
laid out (equal rows are interchangeable).

Defined results: null ids, turns, roles and texts count as one space where they
are written out; rows with a null id are one conversation with a null id; a
blank text, a role of any other initial, repeated rows and very long texts are
like others; conversations that lose all rows have zeros, an empty audit and the
digest of no bytes; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import sliced, small, written

#: Rows of a conversation that a worker unrolls at once; characters of a sort key that the driver samples.
CHUNK, PREFIX = 1 << 16, 16
ROLES, FAULTS = "sua", ("ok", "blank", "duplicate", "truncated")
USER, ASSISTANT = "user", "assistant"
#: States: nothing yet, after s, after u, after a.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
NEVER = 1 << 40
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TRUNCATED = 1
_row = re.compile("I*[DKR](?:I+$)?")


def emitted(state: int, role: int) -> int | None:
    """The state after a role (0, 1, 2: s, u, a; else other), or None."""
    if role == 0:
        return AFTER_S if state == NOTHING else None
    if role == 1:
        return None if state == AFTER_U else AFTER_U
    return AFTER_A if role == 2 and state == AFTER_U else None


def wanted(state: int) -> int:
    """The role that Rerole and Insert give in a state: u, or a after u."""
    return 2 if state == AFTER_U else 1


def edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of a row's own edits in a state, ASCII-least first."""
    role, fault = divmod(symbol, len(FAULTS))
    out = [(DELETE, COST[DELETE], state)]
    if fault in (0, 3):
        extra = TRUNCATED * (fault == 3)
        if (to := emitted(state, role)) is not None:
            out.append((KEEP, COST[KEEP] + extra, to))
        out.append((REROLE, COST[REROLE] + extra, emitted(state, wanted(state))))
    return out


Matrix = tuple[tuple[int, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in STATES) for row in a)


def advance(a: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    """From the costs of all that follows a step, those of the step with it."""
    return tuple(min(x + c for x, c in zip(row, costs)) for row in a)


def _inserts() -> Matrix:
    """The costs of going from a state to another by Inserts alone."""
    out = [[0 if i == j else NEVER for j in STATES] for i in STATES]
    for i in STATES:
        to, cost = i, 0
        for _ in STATES:
            to, cost = emitted(to, wanted(to)), cost + COST[INSERT]
            out[i][to] = min(out[i][to], cost)
    return tuple(map(tuple, out))


INSERTS = _inserts()
#: The costs after the last row: Inserts to a state in which the roles may end.
AT_END = tuple(min(INSERTS[i][NOTHING], INSERTS[i][AFTER_A]) for i in STATES)


@lru_cache(maxsize=None)  # 16 symbols, powers up to the row count's bits
def power(symbol: int, k: int) -> Matrix:
    """The transition of 2 ** k rows of a symbol, Inserts before each row included."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    own = [[NEVER] * 4 for _ in STATES]
    for i in STATES:
        for _, cost, to in edits(i, symbol):
            own[i][to] = min(own[i][to], cost)
    return product(INSERTS, tuple(map(tuple, own)))


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, rows) of the runs; rows that must go are alike, whatever their role."""
    same = (s if s % len(FAULTS) in (0, 3) else FAULTS.index("blank") for s in symbols)
    return [(s, sum(1 for _ in g)) for s, g in groupby(same)]


def run_steps(symbol: int, n: int) -> list[Matrix]:
    return [power(symbol, k) for k in range(n.bit_length()) if n >> k & 1]


def transition(symbols: bytes) -> Matrix:
    """The product over a chunk."""
    out = tuple(tuple(0 if i == j else NEVER for j in STATES) for i in STATES)
    for symbol, n in runs(symbols):
        for m in run_steps(symbol, n):
            out = product(out, m)
    return out


def unroll(symbols: bytes, after: tuple[int, ...], last: bool) -> list[tuple[str, int]]:
    """For each entry state: the audit of the chunk (Inserts stand before their
    row, after a conversation's last row also behind it) and the state left.
    ``after``: the costs of all that follows the chunk."""
    parts, behind = runs(symbols), [after]
    for symbol, n in reversed(parts):
        costs = behind[-1]
        for m in run_steps(symbol, n):
            costs = advance(m, costs)
        behind.append(costs)
    behind.reverse()  # [0]: before the first run, [k]: behind the k-th
    rows = []  # (symbol, costs before it, costs behind it)
    for k, (symbol, n) in enumerate(parts):
        one, ahead = power(symbol, 0), [behind[k + 1]]
        for _ in range(n):
            ahead.append(advance(one, ahead[-1]))
        rows += [(symbol, ahead[left], ahead[left - 1]) for left in range(n, 0, -1)]
    return [_choose(rows, state, last) for state in STATES]


def _choose(rows: list[tuple[int, tuple[int, ...], tuple[int, ...]]], state: int, last: bool) -> tuple[str, int]:
    told = []
    for symbol, before, behind in rows:
        initial = INSERT
        while initial == INSERT:
            due = before[state]
            initial, _, state = next(e for e in choices(state, symbol) if e[1] + (before if e[0] == INSERT else behind)[e[2]] == due)
            told.append(initial)
    while last and AT_END[state]:
        told.append(INSERT)
        state = emitted(state, wanted(state))
    return "".join(told), state


@lru_cache(maxsize=None)
def choices(state: int, symbol: int) -> list[tuple[str, int, int]]:
    return sorted([*edits(state, symbol), (INSERT, COST[INSERT], emitted(state, wanted(state)))])


def lines(told: str, state: int, role: str, text: str) -> tuple[list[str], int]:
    """The lines that a row's edits leave, and the state after them."""
    out = []
    for initial in told:
        if initial == KEEP:
            out.append(f"{role}:{text}")
            state = emitted(state, ROLES.index(role[0]))
        elif initial != DELETE:
            out.append(f"{(USER, ASSISTANT)[wanted(state) - 1]}:{text if initial == REROLE else ''}")
            state = emitted(state, wanted(state))
    return out, state


def shown(c: Column) -> Column:
    """Nulls as one space."""
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text): by crc32 of ``conv:turn`` modulo 20 a row is
    dropped (0), emptied (1), freed of ``.!?`` (2), repeated (3) or its role
    set to user (4)."""
    kind = F.crc32(F.concat(shown(F.col(conv)), F.lit(":"), shown(F.col(turn))).cast("binary")) % 20
    slim = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), shown(F.col(role)).alias("role"), shown(F.col(text)).alias("text"), kind.alias("kind")).where("kind <> 0")
    new_text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    slim = slim.select("conv", "turn", F.when(F.col("kind") == 4, USER).otherwise(F.col("role")).alias("role"), new_text.alias("text"), "kind")
    return slim.withColumn("copy", F.explode(F.expr("sequence(1, if(kind = 3, 2, 1))"))).drop("copy", "kind")


def in_order(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, pos): ``pos`` numbers the rows in order. Sorted
    by ranges, so a long conversation is in many tasks; a conversation's rows in
    one task are numbered without gaps."""
    keys = [F.col("conv"), F.col("turn"), F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)]
    ranged = rows.repartitionByRange(*(k.asc_nulls_first() for k in keys))
    placed = ranged.sortWithinPartitions(*(k.asc_nulls_first() for k in [*keys, F.col("role"), F.col("text")]))
    return placed.withColumn("pos", F.monotonically_increasing_id())


def with_symbols(placed: DataFrame) -> DataFrame:
    """(conv, pos, symbol) of each row. Which row is the first one with its role
    and text is found by an aggregate, so many equal rows are no hot group."""
    bare = F.expr(r"trim(BOTH ' \t\n\u000b\f\r' FROM text)")
    fault = F.when(bare == "", 1).when(~F.substring(bare, -1, 1).isin(*".!?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    marked = written(placed.select("conv", "pos", kind.alias("kind"), fault.alias("fault"), same.alias("same")), "repair-marked")
    first = marked.groupBy("conv", "same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = small(written(first.select(F.col("conv").alias("of_conv"), F.col("same").alias("of_same"), "first"), "repair-first"), row_bytes=128)
    found = marked.join(first, F.col("conv").eqNullSafe(F.col("of_conv")) & (F.col("same") == F.col("of_same")), "left")
    again = F.coalesce((F.col("fault") != 1) & (F.col("pos") > F.col("first")), F.lit(False))
    return found.select("conv", "pos", (F.col("kind") * len(FAULTS) + F.when(again, 2).otherwise(F.col("fault"))).alias("symbol"))


def illegal(x: int, y: int) -> bool:
    """Whether two adjacent symbols' roles are not su, ua or au."""
    return (x // len(FAULTS), y // len(FAULTS)) not in ((0, 1), (1, 2), (2, 1))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*rows)] or [()] * len(schema), schema)], schema=schema)


LONGS = pa.list_(pa.int64())


def chunked(symbols: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, first, symbols, head, tail, counts, matrix) for each chunk: what a
    conversation has of a stretch of ``chunk`` numbers, from ``first`` on."""
    cut = symbols.groupBy("conv", F.floor(F.col("pos") / chunk)).agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("rows"))
    slim = cut.select("conv", F.col("rows")[0]["pos"].alias("first"), F.col("rows")["symbol"].alias("symbols"))
    kind = slim.schema["conv"].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            schema = pa.schema([("conv", b.column(0).type), ("first", pa.int64()), ("symbols", pa.binary()), ("head", pa.int32()), ("tail", pa.int32()), ("counts", LONGS), ("matrix", LONGS)])
            rows = []
            for conv, first, s in zip(*(c.to_pylist() for c in b.columns)):
                counts = [sum(x % len(FAULTS) == f for x in s) for f in (1, 2, 3)] + [sum(map(illegal, s, s[1:]))]
                rows.append((conv, first, bytes(s), s[0], s[-1], counts, [x for row in transition(bytes(s)) for x in row]))
            yield _batch(rows, schema)

    return slim.mapInArrow(run, f"conv {kind}, first long, symbols binary, head int, tail int, counts array<long>, matrix array<long>")


def per_conversation(chunks: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """``run`` over rows (conv, parts): a few numbers of each chunk, in order."""
    parts = chunks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("first", *columns))).alias("parts"))
    return parts.mapInArrow(run, schema)


def followed(chunks: DataFrame) -> DataFrame:
    """(conv, at, after, last, totals) for each chunk that begins ``at``: the
    costs of all that follows it; totals: the conversation's blank, duplicate,
    truncated and illegal rows and its cost."""
    def run(batches):
        for b in sliced(batches):
            schema = pa.schema([("conv", b.column(0).type), ("at", pa.int64()), ("after", LONGS), ("last", pa.bool_()), ("totals", LONGS)])
            rows = []
            for conv, parts in zip(*(c.to_pylist() for c in b.columns)):
                totals = [sum(p["counts"][f] for p in parts) for f in range(4)]
                totals[3] += sum(illegal(p["tail"], q["head"]) for p, q in zip(parts, parts[1:]))
                costs, own = AT_END, []
                for p in reversed(parts):
                    own.append((conv, p["first"], list(costs), not own))
                    costs = advance(tuple(tuple(p["matrix"][4 * i:4 * i + 4]) for i in STATES), costs)
                rows += [(*x, [*totals, costs[NOTHING]]) for x in own]
            yield _batch(rows, schema)

    kind = chunks.schema["conv"].dataType.simpleString()
    return per_conversation(chunks, ["head", "tail", "counts", "matrix"], run, f"conv {kind}, at long, after array<long>, last boolean, totals array<long>")


def unrolled(chunks: DataFrame, ahead: DataFrame) -> DataFrame:
    """(conv, first, audits, ends) of each chunk, by entry state."""
    joined = chunks.join(ahead.select("at", "after", "last"), F.col("first") == F.col("at")).select("conv", "first", "symbols", "after", "last")

    def run(batches):
        for b in sliced(batches):
            schema = pa.schema([("conv", b.column(0).type), ("first", pa.int64()), ("audits", pa.list_(pa.string())), ("ends", LONGS)])
            rows = []
            for conv, first, symbols, after, last in zip(*(c.to_pylist() for c in b.columns)):
                ways = unroll(symbols, tuple(after), last)
                rows.append((conv, first, [a for a, _ in ways], [e for _, e in ways]))
            yield _batch(rows, schema)

    return joined.mapInArrow(run, f"conv {chunks.schema['conv'].dataType.simpleString()}, first long, audits array<string>, ends array<long>")


def entered(ways: DataFrame) -> DataFrame:
    """(at, state) of each chunk: the state it is entered in."""
    def run(batches):
        for b in sliced(batches):
            rows = []
            for parts in b.column(1).to_pylist():
                state = NOTHING
                for p in parts:
                    rows.append((p["first"], state))
                    state = p["ends"][state]
            yield _batch(rows, pa.schema([("at", pa.int64()), ("state", pa.int32())]))

    return per_conversation(ways, ["ends"], run, "at long, state int")


def row_edits(ways: DataFrame) -> DataFrame:
    """(row, told): the edits at each row."""
    chosen = ways.join(entered(ways), F.col("first") == F.col("at")).select("first", F.col("audits")[F.col("state")].alias("audit"))

    def run(batches):
        for b in sliced(batches):
            rows = [(first + k, told) for first, audit in zip(*(c.to_pylist() for c in b.columns)) for k, told in enumerate(_row.findall(audit))]
            yield _batch(rows, pa.schema([("row", pa.int64()), ("told", pa.string())]))

    return chosen.mapInArrow(run, "row long, told string")


def written_out(placed: DataFrame, told: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of each conversation."""
    def run(batches):
        conv, audit, digest, state, begun, lead = None, [], None, NOTHING, False, b""
        schema = None
        for b in sliced(batches):
            done, schema = [], pa.schema([("conv", b.column(0).type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for own, _, role, text, edits_of in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or own != conv:
                    if begun:
                        done.append((conv, "".join(audit), digest.hexdigest()))
                    conv, audit, digest, state, begun, lead = own, [], hashlib.sha256(), NOTHING, True, b""
                audit.append(edits_of)
                out, state = lines(edits_of, state, role, text)
                for line in out:
                    digest.update(lead + line.encode())
                    lead = b"\n"
            yield _batch(done, schema)
        if begun:
            yield _batch([(conv, "".join(audit), digest.hexdigest())], schema)

    rows = placed.join(told, F.col("pos") == F.col("row")).select("conv", "pos", "role", "text", "told")
    dealt = rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "pos")
    return dealt.mapInArrow(run, f"conv {placed.schema['conv'].dataType.simpleString()}, audit string, repaired_sha256 string")


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of each conversation of ``rows`` (conv, turn, role, text:
    no null roles or texts) and of ``ids`` (conv)."""
    placed = written(in_order(rows), "repair-placed")
    chunks = written(chunked(with_symbols(placed), chunk), "repair-chunks")
    ahead = written(followed(chunks), "repair-followed")
    ways = written(unrolled(chunks, ahead), "repair-unrolled")
    # the numbers of a conversation come from several tables: one aggregate puts them side by side, also for a null id
    parts = [
        placed.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps")),
        ahead.where("last").select("conv", *(F.col("totals")[k].alias(c) for k, c in enumerate(COUNTS))),
        written_out(placed, row_edits(ways)),
        *([ids.select("conv").distinct()] if ids is not None else []),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    zero = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS)]
    empty = hashlib.sha256().hexdigest()
    return whole.groupBy("conv").agg(*zero, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))


def damage_and_repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """repair() of the damaged rows, for every original conversation."""
    out = repair(damage(conversations, conv, turn, role, text), conversations.select(F.col(conv).alias("conv")), chunk)
    return out.withColumnRenamed("conv", conv)
