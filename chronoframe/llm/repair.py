"""Repair of the order of roles in conversations, by the cheapest edits.

A row is the first of: *blank* (no character but white space), *duplicate* (its role and text
came earlier in the conversation), *truncated* (the last character that is no white space is
none of ``.!?``), or sound. Edits are K keep (0), R give the role user or assistant (1), D
delete (2; the only one for blank and duplicate rows) and I insert an empty row of user or
assistant anywhere (5); a truncated row that stays costs 5 more. The initials of the roles that
result must read ``(s?(ua)+)?``. Of the cheapest edits, those count whose initials in order, the
*audit*, come first in ASCII.

1. A row becomes one of nine symbols, of role and fault, and a conversation a string of them.
2. Re-Pair: pairs of neighbouring symbols that are frequent over all conversations become
   rules, in rounds; pairs of one round share no symbol. A table of symbols by symbols is all
   that is collected.
3. A symbol has a transfer matrix over the four states of the pattern: the cheapest edits that
   lead from one to another, inserts before the row included, with their audit as a rope that
   shares its parts. A rule's matrix is the min-plus product of its two symbols' matrices.
4. A conversation is its start state times the matrices of its compressed string; equal strings
   of a batch are computed once.
5. The audits go back to the rows by conversation, and are carried out in order.

Audits of equal cost between the same states never begin with one another: as strings they
would differ by inserts at the end alone, which cost. So minima may be taken part by part.

Nothing of a conversation is held in a task but its string of symbols and its audit. Which
rules are made affects the work only, not the result.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn are
taken by role, then text; repeated rows are rows of their own, all but the first of them
duplicates; a null conversation id is a conversation; roles are told by their first character,
case kept, and one that begins with none of s, u, a (an empty one too) needs R or D; a
conversation without rows has nothing to repair; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.storage import stored

SPACE = " \t\n\x0b\x0c\r"
DELETED = "x"
SYMBOLS = "suaoSUAOx"  # role s, u, a or another, in capitals where truncated; x must be deleted
FIRST_RULE = 0x100  # rules are written as characters from here on
ROUNDS, RULES, WORTH = 20, 240, 1000
MEMO = 1 << 22  # characters of results that a task keeps at hand
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # initials that may follow
LEADS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
Rope = str | tuple
Matrix = list  # of rows, of None or (cost, rope)


# --- ropes and matrices ------------------------------------------------------------------


def before(x: Rope, y: Rope) -> bool:
    """Whether one rope's text comes before another's; parts that both share are passed over."""
    left, right = [x], [y]
    while left and right:
        a, b = left.pop(), right.pop()
        if a is b:
            continue
        deep = False
        for stack, part in ((left, a), (right, b)):
            if isinstance(part, tuple):
                stack += [part[1], part[0]]
                deep = True
            else:
                stack.append(part)
        if deep:
            continue
        left.pop()
        right.pop()
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            return a < b
        left += [a[n:]] if len(a) > n else []
        right += [b[n:]] if len(b) > n else []
    return not any(map(text_of, left)) and any(map(text_of, right))


def text_of(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        part = stack.pop()
        if isinstance(part, tuple):
            stack += [part[1], part[0]]
        else:
            out.append(part)
    return "".join(out)


def better(old, new):
    """The cheaper of two (cost, rope), or the first by text."""
    if old is None or new[0] < old[0]:
        return new
    return new if new[0] == old[0] and before(new[1], old[1]) else old


def times(vector: list, matrix: Matrix) -> list:
    """A row of entries times a matrix, in the min-plus algebra."""
    out: list = [None] * 4
    for entry, row in zip(vector, matrix):
        if entry is None:
            continue
        for q, step in enumerate(row):
            if step is not None:
                cost = entry[0] + step[0]
                if out[q] is None or cost <= out[q][0]:
                    out[q] = better(out[q], (cost, (entry[1], step[1])))
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return [times(row, b) for row in a]


def _inserts() -> Matrix:
    """Inserts alone, none included; more than two never pay."""
    one = [[(5, "I") if any(LEADS[c] == q for c in AFTER[p] if c != "s") else None for q in range(4)] for p in range(4)]
    out = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]
    for _ in range(2):
        longer = product(out, one)
        out = [[better(a, b) if b is not None else a for a, b in zip(*rows)] for rows in zip(out, longer)]
    return [[(e[0], text_of(e[1])) if e else None for e in row] for row in out]


INSERTS = _inserts()


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts, then the edit of one row."""
    role, extra = symbol.lower(), 5 if symbol.isupper() else 0
    row: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        row[p][p] = (2, "D")
        for c in AFTER[p] if symbol != DELETED else "":
            q = LEADS[c]
            if c == role:
                row[p][q] = better(row[p][q], (extra, "K"))
            elif c != "s":
                row[p][q] = better(row[p][q], (1 + extra, "R"))
    return product(INSERTS, row)


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """The matrix of each symbol and, bottom up, of each rule, a pair of earlier symbols."""
    out = {s: symbol_matrix(s) for s in SYMBOLS}
    for k, (a, b) in enumerate(rules):
        out[chr(FIRST_RULE + k)] = product(out[a], out[b])
    return out


def cheapest(symbols: str, known: dict[str, Matrix]) -> tuple[int, str]:
    """Cost and audit of a compressed string of symbols."""
    vector: list = [(0, ""), None, None, None]
    for s in symbols:
        vector = times(vector, known[s])
    vector = times(vector, INSERTS)
    best = vector[START]
    best = best if vector[ASSISTANT] is None else better(best, vector[ASSISTANT])
    return best[0], text_of(best[1])


# --- Re-Pair -----------------------------------------------------------------------------


def compressed(strings: list[str], rules: list[str]) -> str:
    """The strings, a line each, with every rule put in place."""
    text = "\n".join(strings)
    for k, pair in enumerate(rules):
        text = text.replace(pair, chr(FIRST_RULE + k))
    return text


def _pairs(rules: list[str]):
    def run(batches):
        for batch in batches:
            codes = np.frombuffer(compressed(batch.column(0).to_pylist(), rules).encode("utf-32-le"), "<u4").astype(np.int64)
            within = (codes[:-1] != 10) & (codes[1:] != 10)
            pair, n = np.unique((codes[:-1] << 32 | codes[1:])[within], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return run


def grammar(strings: DataFrame, rounds: int = ROUNDS, most: int = RULES) -> list[str]:
    """Rules for a column of strings, each the pair of symbols it stands for.

    A round takes the most frequent pairs first and ends at a pair that saves less than a
    thousandth of all pairs left, or occurs once.
    """
    rules: list[str] = []
    for _ in range(rounds):
        found = strings.mapInArrow(_pairs(rules), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        # At most the square of the symbols and rules.
        counted = sorted(((n, pair) for pair, n in found.collect()), reverse=True)
        total, taken, new = sum(n for n, _ in counted), set(), []
        for n, code in counted:
            pair = chr(code >> 32) + chr(code & 0xFFFFFFFF)
            if n < 2 or n * WORTH < total or len(rules) + len(new) >= most:
                break
            if not taken & set(pair):
                taken |= set(pair)
                new.append(pair)
        if not new:
            break
        rules += new
    return rules


# --- conversations -----------------------------------------------------------------------


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """(conv, turn, role, text, present) with nulls filled in."""
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *filled, (F.lit(True) if present is None else present).alias("present"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, initial, symbol, fault) in order of conversation and row; symbol is null where no row is present."""
    said = F.rtrim("text", F.lit(SPACE))
    earlier = F.row_number().over(Window.partitionBy("conv", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(said == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), DELETED).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    marked = rows.repartition("conv").withColumn("again", earlier)
    in_order = marked.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "again")
    return in_order.withColumn("fault", fault).select("conv", F.when(F.col("present"), F.col("turn")).alias("turn"), F.when(F.col("present"), initial).alias("initial"), symbol.alias("symbol"), "fault")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
FOLLOWS = {("s", "u"), ("u", "a"), ("a", "u")}


def _strings(kind: pa.DataType):
    """Over rows of ``faults``: counts and the string of symbols of each conversation."""
    schema = pa.schema([("conv", kind), *[(c, pa.int64()) for c in COUNTS], ("symbols", pa.string())])

    def finish(conv, low, high, turns, counts, illegal, parts) -> tuple:
        gaps = 0 if low is None else high - low + 1 - turns
        return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, "".join(parts))

    def run(batches):
        state = None
        for batch in batches:
            out = []
            for conv, turn, initial, symbol, fault in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if state is None or conv != state[0]:
                    if state is not None:
                        out.append(finish(conv_, low, high, turns, counts, illegal, parts))
                    state, conv_ = (conv,), conv
                    low = high = last = None
                    turns, illegal, counts, parts = 0, 0, dict.fromkeys((*COUNTS, ""), 0), []
                if initial is None:
                    continue
                if turn is not None:
                    low = turn if low is None else low
                    turns += turn != high
                    high = turn
                illegal += last is not None and (last, initial) not in FOLLOWS
                last = initial
                counts[fault] += 1
                parts.append(symbol)
            yield table(out)
        if state is not None:
            yield table([finish(conv_, low, high, turns, counts, illegal, parts)])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _evaluate(rules: list[str], rest: int):
    """Cost and audit for the strings in the last column; the other columns are carried along."""

    def run(batches):
        known, memo, held = matrices(rules), {}, 0
        for batch in batches:
            costs, audits = [], []
            for line in compressed(batch.column(rest).to_pylist(), rules).split("\n") if batch.num_rows else []:
                if line not in memo:
                    if held > MEMO:
                        memo, held = {}, 0
                    memo[line] = cheapest(line, known)
                    held += len(line) + len(memo[line][1])
                cost, audit = memo[line]
                costs.append(cost)
                audits.append(audit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:rest], pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=[*batch.schema.names[:rest], "cost", "audit"])

    return run


def _carry_out(kind: pa.DataType):
    """Over an audit (kind 0) and then the rows (kind 1) of each conversation, in order: the rows that result."""
    schema = pa.schema([("conv", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        conv, audit, at, place, after = None, "", 0, 0, START

        def turned(initial: str) -> int:
            return LEADS[initial]

        for batch in batches:
            out: list[tuple] = []

            def inserted():
                nonlocal at, place, after
                while at < len(audit) and audit[at] == "I":
                    role = "assistant" if after == USER else "user"
                    out.append((conv, place, "I", role, ""))
                    at, place, after = at + 1, place + 1, turned(role[0])

            for key, plan, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if plan is not None:
                    inserted()
                    conv, audit, at, place, after = key, plan, 0, 0, START
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = "assistant" if after == USER else "user"
                out.append((conv, place, edit, role, text))
                place, after = place + 1, turned(role[0])
            yield table(out)
        out = []
        while at < len(audit):  # inserts at the very end
            role = "assistant" if after == USER else "user"
            out.append((conv, place, "I", role, ""))
            at, place, after = at + 1, place + 1, turned(role[0])
        yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _digests(kind: pa.DataType):
    """Over the resulting rows in order: SHA-256 of ``role:text`` lines, a conversation at a time."""
    schema = pa.schema([("conv", kind), ("repaired_sha256", pa.string())])

    def run(batches):
        conv, digest = None, None
        for batch in batches:
            out = []
            for key, place, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if place == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield table(out)
        if digest is not None:
            yield table([(conv, digest.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


class Repair:
    """Repair of conversations; ``present`` tells which rows are there, the others only name their conversation.

    ``plans`` has a row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit. Gaps are the turns missing between the first and the last.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> None:
        from pyspark.sql.pandas.types import to_arrow_type

        self.rows = _ordered(rows, conv, turn, role, text, present)
        self.type = self.rows.schema["conv"].dataType
        self.arrow = to_arrow_type(self.type)
        self.name = self.type.simpleString()
        counts = ", ".join(f"{c} long" for c in COUNTS)
        strings = stored(faults(self.rows).mapInArrow(_strings(self.arrow), f"conv {self.name}, {counts}, symbols string"), "symbols")
        self.rules = grammar(strings.select("symbols"))
        self.plans = stored(strings.mapInArrow(_evaluate(self.rules, 1 + len(COUNTS)), f"conv {self.name}, {counts}, cost long, audit string"), "audits")

    def repaired(self) -> DataFrame:
        """(conv, place, edit, role, text): the rows that result, in order within their partition."""
        none = F.lit(None)
        plans = self.plans.select("conv", "audit", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), F.lit(0).alias("kind"))
        rows = self.rows.where("present").select("conv", none.cast("string").alias("audit"), "turn", "role", "text", F.lit(1).alias("kind"))
        dealt = plans.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "text")
        return dealt.select("conv", "audit", "role", "text").mapInArrow(_carry_out(self.arrow), f"conv {self.name}, place long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """``plans`` with ``repaired_sha256``, over the resulting ``role:text`` joined by line ends."""
        made = self.repaired().mapInArrow(_digests(self.arrow), f"key {self.name}, repaired_sha256 string")
        joined = self.plans.join(made, F.col("conv").eqNullSafe(F.col("key")), "left").drop("key")
        return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
