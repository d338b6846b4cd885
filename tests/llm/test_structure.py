"""Conversation repair against an exhaustive search, whole and in blocks."""

import hashlib
import heapq
import re
import zlib

import pytest

from cadenza.llm import structure as st

WORDY = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """Plain damage of (conv, turn, role, text), sorted as the operator states."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        code, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def plain(rows):
    """Everything by definition; edits by uniform-cost search over (cost, audit)."""
    seen, faults = set(), []
    for _, role, text in rows:
        marks = WORDY.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    names = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(names, names[1:]))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, text = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in ("user", "assistant"):
            if role[0] in follows[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*text, f"{role}:")))
        if i < len(rows):
            _, role, said = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, text))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] and role[:1] in follows[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*text, f"{role}:{said}")))
                for new in ("user", "assistant"):
                    if new[0] in follows[last]:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, new[0], (*text, f"{new}:{said}")))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    key = lambda r: (r[0] is not None, r[0] or 0)
    return {c: plain(sorted(damaged(own), key=key)) for c, own in by.items()}


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def talks(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for conv in range(400):
        n = rnd.choice([1, 2, 3, 5, 9])
        for turn in range(n):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            rows.append((conv, turn * rnd.choice([1, 1, 1, 2]) + conv % 3 if turn else None if conv % 50 == 0 else 0, role, rnd.choice([f"Said {turn}.", "Same!", "cut off", " \n", f"What {conv}? ", "é "])))
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())  # one row a turn: ties have an order of their own
    rows += [(900, t, ("user", "assistant")[t % 2], f"line {t % 700}.") for t in range(1500)]
    rows += [(None, 1, None, None), (None, 2, "assistant", "Yes."), (901, 0, "user", None)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [3, 64, st.ROWS])
def test_repair_equals_search(spark, talks, block):
    df = spark.createDataFrame(talks, SCHEMA).repartition(5)
    want = expected(talks)
    assert got(st.repair_conversations(st.damage(df), block)) == want


def test_rows_of_one_turn_have_an_order_of_their_own(spark):
    rows = [(1, 1, "user", f"Hello {i}.") for i in range(9)] + [(1, 1, "assistant", "Hi.")] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (got(st.repair_conversations(st.damage(df.repartition(n)))) for n in (1, 4))
    assert a == b and a[1][2] >= 2


def test_empty_table_and_extra_columns(spark):
    assert st.repair_conversations(st.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 5)], SCHEMA + ", live string, part int")
    assert got(st.repair_conversations(st.damage(odd))).keys() == {1}


def test_long_texts(spark):
    rows = [(7, 0, "user", "so " * 200_000 + "."), (7, 1, "assistant", "." + " " * 200_000), (7, 3, "user", "x" * 100_000)]
    assert got(st.repair_conversations(st.damage(spark.createDataFrame(rows, SCHEMA)))) == expected(rows)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    from cadenza.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_dial_structure_repair"](spark, sf)) == expected(rows)


def test_distances_are_those_of_all_paths():
    rows = [("a", st.WHOLE), ("u", st.TRUNCATED), ("u", st.BLANK), ("s", st.WHOLE)]
    whole = st.distances(rows, st.GOAL)
    for at in range(5):  # through any cut
        behind = st.distances(rows[at:], st.GOAL)[0]
        assert st.distances(rows[:at], behind)[0] == whole[0]
