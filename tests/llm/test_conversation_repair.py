import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lingoscope.llm import conversation_repair
from lingoscope.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, audit string, first int, found string"


def plain_repair(rows):
    """(cost, letters, repaired rows) by trying edits in order of cost, then of letters; rows: (role, text, fault)."""
    pattern = re.compile(r"s?(ua)*(u?)\Z")
    queue = [(0, "", 0, ())]
    while True:
        cost, letters, i, out = heapq.heappop(queue)
        initials = "".join(r[:1] if r[:1] in "sua" and r else "?" for r, _ in out)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, letters, out
        if not pattern.match(initials):
            continue
        for role in ("user", "assistant"):
            if len(out) <= len(rows) + 1:
                heapq.heappush(queue, (cost + 5, letters + "I", i, (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, letters + "D", i + 1, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + more, letters + "K", i + 1, (*out, (role, text))))
                for to in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 1, letters + "R", i + 1, (*out, (to, text))))


CODE = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}


def test_letters_against_all_edits():
    rng = random.Random(2)
    kinds = list(itertools.product(["system", "user", "assistant", "tool"], CODE))
    cases = [[k] for k in kinds] + [list(p) for p in itertools.product(kinds, kinds)] + [[rng.choice(kinds) for _ in range(rng.randrange(3, 7))] for _ in range(250)]
    for case in cases:
        rows = [(role, f"t{i}", fault) for i, (role, fault) in enumerate(case)]
        cost, letters, _ = plain_repair(rows)
        codes = bytes({"s": 1, "u": 2, "a": 3}.get(role[0], 0) + 4 * CODE[fault] for role, fault in case)
        assert conversation_repair.repair(codes) == (cost, letters), case


def expected(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = groups[conv]
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        rows += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for turn, role, text in rows:
            held = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not held else "duplicate" if (role, text) in seen else "" if held[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {r[0] for r in rows if r[0] is not None}
        initials = [r[1][:1] for r in rows]
        cost, letters, repaired = plain_repair(judged) if len(judged) < 9 else (*conversation_repair.repair(bytes({"s": 1, "u": 2, "a": 3}.get(r[:1], 0) + 4 * CODE[f] for r, _, f in judged)), None)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")],
            sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(initials, initials[1:])), cost, letters,
            None if repaired is None else hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        ))
    return out


def by_all(rows):
    return sorted(map(repr, map(tuple, rows)))


def random_table(rng, convs):
    rows = []
    for conv in convs:
        for _ in range(rng.randrange(1, 5)):
            rows.append((conv, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "cut", "", " \t\n", None, "Is it?\n", "é…", "a.b" * 2000, f"{rng.random()}."])))
    return rows


def spark_table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def test_repaired_against_plain_way(spark):
    rows = random_table(random.Random(9), [*range(150), None])
    got = conversation_repair.repaired(spark_table(spark, rows)).collect()
    assert list(got[0].asDict()) == conversation_repair.RESULT
    assert by_all(got) == by_all(expected(rows))
    assert conversation_repair.repaired(spark_table(spark, [])).count() == 0


def test_one_long_conversation(spark):
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{rng.randrange(5000)}.") for t in range(20000)] + [(8, 0, "user", "Hello.")]
    got = {r["conv_id"]: r for r in conversation_repair.repaired(spark_table(spark, rows)).collect()}
    want = {r[0]: r for r in expected(rows)}
    assert tuple(got[7])[:8] == want[7][:8] and tuple(got[8]) == want[8]


def test_rows_as_they_are(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Alone.")]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in conversation_repair.repaired(spark_table(spark, rows), damage=conversation_repair.undamaged).collect()}
    assert got == {1: (0, "KK"), 2: (2, "D")}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_its_sql(spark, sf):
    got = QUERIES["op12_conversation_repair"](spark, f"/root/testdata/{sf}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    want = con.execute(ORACLES["op12_conversation_repair"])
    assert [d[0] for d in want.description] == got.columns
    assert by_all(got.collect()) == by_all(want.fetchall())


def test_sql_on_awkward_rows():
    rows = random_table(random.Random(4), [*range(80), None])
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert by_all(con.execute(ORACLES["op12_conversation_repair"]).fetchall()) == by_all(expected(rows))
