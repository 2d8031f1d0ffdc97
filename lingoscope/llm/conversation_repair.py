"""Conversation structure repair: cheapest edits by a graph of tight arcs, read from both ends.

A conversation should be an optional system turn, then user and assistant in turns, or
nothing: the roles' initials match ``(s?(ua)+)?``.  A row is kept (K, free), given
another role (R, 1) or deleted (D, 2, a must for blank rows and duplicates); empty turns
may be inserted (I, 5); a truncated row that isn't deleted costs 5 more.

Nodes of the graph are (rows done, state of the pattern); arcs are edits.  The least
costs from the start and to the end show which arcs lie on a cheapest path: those with
cost from the start + own cost + cost to the end = the whole.  All cheapest repairs are
paths of such arcs, so the first one in ASCII order is read off by walking the set of
nodes that the letters so far lead to, always along the least letter (and by stopping
where a path may stop).  The letters decide every role, hence the repaired rows.

In Spark: rows meet by conversation, sorted within their partition.  The first pass
moves facts (a byte for each row) and no texts, and gives each conversation's letters;
the second streams the texts after the letters and hashes what is repaired.  A task
holds one conversation's facts or letters, never its texts; the letters are as long as
the result itself.

Order and ties: rows by turn, nulls first; rows of one turn by role, then by the SHA-256
of their text; rows alike in these are interchangeable.  Text equality goes by that
SHA-256.  Cases: a null conv_id is one conversation; a null role or text is one space (so the
text is blank and the role fits nowhere); null turns count for no gap; roles go by their
first letter; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.llm.common import narrow

#: Fixed values of the repair: costs of edits and of truncated rows.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Facts of a row: initial (0 other, 1 s, 2 u, 3 a) + 4 * fault.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
GONE = -1  # stands for its conversation only
#: States of the pattern: nothing yet, after s, after u, after a; where the pattern may end; what u and a lead to.
ENDS = (0, 3)
BY_U, BY_A = ((0, 2), (1, 2), (3, 2)), ((2, 3),)
BY = {1: ((0, 1),), 2: BY_U, 3: BY_A, 0: ()}
FAR = 1 << 30
MEMO, SHORT = 50_000, 64
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with nulls as spaces and the damage that a checksum deals; ``gone`` ones stay, marked."""
    spaced = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    dealt = spaced.withColumn("_d", (F.crc32(named.cast("binary")) % 20).cast("int"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_d") == 0).alias("gone"), F.explode(copies).alias("copy"))


def marked(rows: DataFrame) -> DataFrame:
    """A digest of each text, and what can be said of a row by itself: initial and fault but for duplicates."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    return rows.withColumns({"digest": F.sha2("text", 256), "fault": fault, "initial": initial})


def facts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, code: without texts; of rows alike in role and text all but the first are duplicates.

    Rows alike are counted before they are numbered: only the first of them by turn is told apart.
    """
    marks = rows.select("conv_id", "turn", "role", "digest", "fault", "initial", "gone")
    alike = marks.groupBy("conv_id", "turn", "role", "digest", "fault", "initial", "gone").agg(F.count(F.lit(1)).alias("n"))
    firsts = alike.where(~F.col("gone")).groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    same = alike["conv_id"].eqNullSafe(firsts["_c"]) & (alike["role"] == firsts["_r"]) & (alike["digest"] == firsts["_d"])
    joined = alike.join(firsts, same, "left").withColumn("leads", F.col("turn").eqNullSafe(F.col("first.turn")))
    code = lambda fault: (F.col("initial") + 4 * fault).cast("int")
    again = code(F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE))
    return joined.select(
        "conv_id", "turn", "role", "digest",
        F.when(F.col("gone"), GONE).when(F.col("leads"), code(F.col("fault"))).otherwise(again).alias("code"),
        F.when(F.col("gone"), GONE).otherwise(again).alias("code_after"),
        "n",
    )


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest repair of rows, the first of them in ASCII order."""
    n = len(codes)
    down = array("i", [0] * (4 * n + 4))  # from the start
    up = array("i", [0] * (4 * n + 4))  # to the end
    now = [0, FAR, FAR, FAR]
    for i in range(n + 1):
        now[2] = min(now[2], INSERT + min(now[0], now[1], now[3]))
        now[3] = min(now[3], INSERT + now[2])
        down[4 * i : 4 * i + 4] = array("i", now)
        if i < n:
            after = [FAR] * 4
            for _, q, p, cost in arcs(codes[i]):
                after[p] = min(after[p], now[q] + cost)
            now = after
    now = [0 if q in ENDS else FAR for q in range(4)]
    for i in range(n, -1, -1):
        if i < n:
            after, now = now, [FAR] * 4
            for _, q, p, cost in arcs(codes[i]):
                now[q] = min(now[q], after[p] + cost)
        now[2] = min(now[2], INSERT + now[3])
        now[3] = min(now[3], INSERT + now[2])
        now[0], now[1] = min(now[0], INSERT + now[2]), min(now[1], INSERT + now[2])
        up[4 * i : 4 * i + 4] = array("i", now)
    least = up[0]
    letters, front, i = bytearray(), {0}, 0
    while i < n or not any(q in ENDS and down[4 * n + q] == least for q in front):
        inserts = (("I", q, p, INSERT) for q, p in BY_U + BY_A)
        tight: dict[str, set] = {}
        for letter, q, p, cost in chain(arcs(codes[i]) if i < n else (), inserts):
            if q in front and down[4 * i + q] + cost + up[4 * (i + (letter != "I")) + p] == least:
                tight.setdefault(letter, set()).add(p)
        letter = min(tight)
        letters += letter.encode()
        front = tight[letter]
        i += letter != "I"
    return least, letters.decode()


def _arcs(code: int) -> tuple:
    initial, fault = code % 4, code // 4
    out = [("D", q, q, DELETE) for q in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        out += [("K", q, p, more) for q, p in BY[initial]]
        out += [("R", q, p, REROLE + more) for q, p in BY_U + BY_A]
    return tuple(out)


ARCS = [_arcs(code) for code in range(16)]
arcs = ARCS.__getitem__


class Tally:
    """What is known of one conversation while its rows come in order."""

    def __init__(self, conv_id):
        self.conv_id, self.codes = conv_id, bytearray()
        self.first = self.last = None
        self.turns = 0

    def add(self, turn, code: int, after: int, n: int) -> None:
        if code == GONE:
            return
        self.codes.append(code)
        self.codes += bytes([after]) * (n - 1)
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn

    def row(self, memo: dict) -> tuple:
        codes = bytes(self.codes)
        found = memo.get(codes)
        if found is None:
            faults = [bytes(c // 4 for c in codes).count(f) for f in (BLANK, DUPLICATE, CUT)]
            initials = bytes(c % 4 for c in codes)
            illegal = sum(pair not in ((1, 2), (2, 3), (3, 2)) for pair in zip(initials, initials[1:]))
            found = (*faults, illegal, *repair(codes))
            if len(codes) <= SHORT:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[codes] = found
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *found, int(self._keeps_system(codes, found[-1])))

    @staticmethod
    def _keeps_system(codes: bytes, letters: str) -> bool:
        """Whether the repaired conversation begins with a system turn."""
        at = next((k for k, x in enumerate(letters) if x != "D"), None)
        return at is not None and letters[at] == "K" and codes[at] % 4 == 1


FOUND = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, system int"


def audits(rows: DataFrame, kind: str) -> DataFrame:
    """A row for each conversation, of sorted facts."""
    schema = FOUND.format(kind=kind)
    names = [part.split()[0] for part in schema.split(", ")]

    def tallied(batches):
        memo: dict = {}
        tally = None
        for batch in batches:
            out = []
            for conv_id, turn, code, after, n in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "code_after", "n")]):
                if tally is None or conv_id != tally.conv_id:
                    if tally is not None:
                        out.append(tally.row(memo))
                    tally = Tally(conv_id)
                tally.add(turn, code, after, n)
            if out:
                yield _batch(out, names, batch.schema.field("conv_id").type)
        if tally is not None:
            yield _batch([tally.row(memo)], names, batch.schema.field("conv_id").type)

    return rows.mapInArrow(tallied, schema)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind] + [pa.string() if x in ("audit", "repaired_sha256") else pa.int32() if x == "system" else pa.int64() for x in names[1:]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class Repaired:
    """The hash of one conversation's repaired rows, as they come in order."""

    def __init__(self, found: tuple, letters: str, system: int):
        self.found, self.letters, self.system = found, letters, system
        self.at = self.kept = 0
        self.hash = hashlib.sha256()
        self._inserted()

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
        self.kept += 1

    def _fitting(self) -> str:
        return "assistant" if (self.kept - self.system) % 2 else "user"

    def _inserted(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self._write(self._fitting(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            self._write(role if letter == "K" else self._fitting(), text)
        self._inserted()

    def row(self) -> tuple:
        return (*self.found, self.letters, self.hash.hexdigest())


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def hashed(rows: DataFrame, kind: str) -> DataFrame:
    """The result, of conversations' letters, each followed by its rows in order."""

    def stream(batches):
        held = None
        for batch in batches:
            out, first = [], batch.column("first").to_pylist()
            ids, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            texts, found = batch.column("text"), batch.column("found")
            for k, leads in enumerate(first):
                if leads == 0:
                    if held is not None:
                        out.append(held.row())
                    f = found[k].as_py()
                    held = Repaired((ids[k], *[f[c] for c in RESULT[1:7]]), f["audit"], f["system"])
                else:
                    held.add(roles[k], texts[k].as_py())
            if out:
                yield _batch(out, RESULT, batch.schema.field("conv_id").type)
        if held is not None:
            yield _batch([held.row()], RESULT, batch.schema.field("conv_id").type)

    return rows.mapInArrow(stream, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage=damaged) -> DataFrame:
    """A row for each conversation: gaps, faults, illegal neighbours, cost, letters and the hash of its repaired rows.

    ``damage`` gives the rows to judge of (conv_id, turn, role, text), with ``gone`` and
    ``copy``; ``undamaged`` takes them as they are.
    """
    given = narrow(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    given = given.withColumns({"turn": F.col("turn").cast("long"), "role": F.col("role").cast("string"), "text": F.col("text").cast("string")})
    kind = given.schema["conv_id"].dataType.simpleString()
    rows = marked(damage(given))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    known = audits(facts(rows).repartition("conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "turn", "code", "code_after", "n"), kind)
    heads = known.select("conv_id", F.lit(0).alias("first"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.struct(*[c for c in known.columns if c != "conv_id"]).alias("found"))
    texts = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("first"), "turn", "role", "digest", "text", F.lit(None).cast(heads.schema["found"].dataType).alias("found"))
    both = heads.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "first", *order)
    return hashed(both.select("conv_id", "first", "role", "text", "found"), kind).withColumnRenamed("conv_id", conv_col)


def undamaged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}).withColumns({"gone": F.lit(False), "copy": F.lit(0)})
