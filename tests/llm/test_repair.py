"""Conversation repair against SQL and against all edits of short conversations."""

import re
import zlib
from functools import lru_cache
from hashlib import sha256
from itertools import product

import duckdb
import pytest

from gramwise.llm import repair
from gramwise.llm.queries import SQL

SCHEMA = "conv_id long, turn long, role string, text string, k string, n int"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = " " if conv is None else str(conv), " " if turn is None else str(turn)
        draw = zlib.crc32(":".join(name).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def plain(rows):
    """{conv_id: all columns} by trying the states row by row, keeping every cheapest way."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        starts = [r[2][:1] for r in own]

        @lru_cache(None)
        def best(i, emitted, own=own, faults=faults):
            """(cost, audit, rows) from row i on; emitted: the initials so far, shortened without changing what may follow."""
            short = re.sub(r"\A(s?)(ua)*", lambda m: m[1] + ("ua" if m[0][len(m[1]) :] else ""), emitted)
            if short != emitted:
                return best(i, short)
            ways = [(0, "", ())] if i == len(own) and GOOD.match(emitted) else []
            for x, name in (("u", "user"), ("a", "assistant")):
                if ok(emitted + x) and emitted.count("i") == 0 and inserts[0] < 2:
                    inserts[0] += 1
                    c, s, kept = best_after(i, emitted + x)
                    inserts[0] -= 1
                    ways.append((c + 5, "I" + s, ((name, ""), *kept)))
            if i < len(own):
                ways.append(add(2, "D", (), best_after(i + 1, emitted)))
                if faults[i] in (0, 3):
                    more, (_, _, role, text) = 5 * (faults[i] == 3), own[i]
                    if role[:1] and ok(emitted + role[:1]):
                        ways.append(add(more, "K", ((role, text),), best_after(i + 1, emitted + role[:1])))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if ok(emitted + x):
                            ways.append(add(more + 1, "R", ((name, text),), best_after(i + 1, emitted + x)))
            return min(ways, default=(10**9, "", ()))

        inserts = [0]

        def best_after(i, emitted, best=best):
            return best.__wrapped__(i, emitted) if inserts[0] else best(i, emitted)

        cost, audit, kept = best(0, "") if own else (0, "", ())
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (1, 2, 3)), sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False)), cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def ok(initials):
    return re.match(r"s?(ua)*u?\Z", initials) is not None


def add(cost, said, rows, rest):
    return cost + rest[0], said + rest[1], rows + rest[2]


def table(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


ROWS = [
    *[(1, t, r, x) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "Hi!"), ("assistant", "Hello."), ("user", "Bye."), ("assistant", "Bye")])],
    *[(2, t, "user", f"text {t}.") for t in range(9)],
    *[(3, t % 3, ("assistant", "user", "tool")[t % 3], "same.") for t in range(7)],
    (4, None, None, None), (4, 1, "user", None), (4, 3, "", "x ."), (4, 9, "assistant", "y?\n"),
    (None, 0, "user", "no id."), (None, 1, "assistant", "none."),
    *[(5, t, "ua"[t % 2] and ("user", "assistant")[t % 2], "long " * 3000 + f"{t}.") for t in range(4)],
    *[(6 + c, t, ("system", "user", "assistant", "user")[(c * 7 + t * t) % 4], ("a.", "b", "", "c!", "d?")[(c + t) % 5]) for c in range(40) for t in range(c % 9)],
]


@pytest.mark.parametrize(("block", "fan"), [(512, 64), (2, 2), (1, 3)])
def test_against_all_edits(spark, block, fan):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(3)
    assert table(repair.repair(df, block, fan)) == plain(ROWS)


def test_search_finds_what_a_table_finds():
    for n in range(5):
        for codes in product(("s0", "u0", "a0", "u3", "x0", "a1"), repeat=n):
            steps = [repair.steps_of(c) for c in codes]
            got = repair.search(steps, repair.INSERTS, 0, repair.DONE)
            now = {0: (0, "")}
            for i in range(n + 1):
                for _ in range(2):
                    for q, (c, s) in list(now.items()):
                        for to, more, said in repair.INSERTS[q]:
                            now[to] = min(now.get(to, (99, "")), (c + more, s + said))
                if i < n:
                    new = {}
                    for q, (c, s) in now.items():
                        for to, more, said in steps[i][q]:
                            new[to] = min(new.get(to, (999, "")), (c + more, s + said))
                    now = new
            assert got == min(now[q] for q in repair.DONE if q in now)


def test_sample_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(SQL["op13_conversation_repair"])
    at = want.columns.index("conv_id")
    got = repair.repair(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"), 3, 2)
    assert got.columns == want.columns
    assert table(got) == {r[at]: tuple(x for i, x in enumerate(r) if i != at) for r in want.fetchall()}


def test_a_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(3000)]
    got = table(repair.repair(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), 64, 4))[1]
    one = table(repair.repair(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), 4096, 4))[1]
    assert got == one and len(re.findall("[KRD]", got[6])) == len(damaged(rows))


def test_empty(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
