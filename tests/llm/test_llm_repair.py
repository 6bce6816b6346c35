import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from llm_cases import rows
from pagetree.llm import queries
from pagetree.llm.repair import RepairCosts, repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, `a.b` int, _key int"
SPACE = " \t\n\x0b\f\r"
RIGHT = re.compile("(s?(ua)+)?")


def order(said):
    return sorted(said, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def fault_list(said):
    seen, out = set(), []
    for _, role, text in said:
        stripped = text.strip(SPACE)
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(said, most=4):
    """(cost, audit, lines) by searching whole sequences of edits, cheapest and then least first."""
    faults = fault_list(said)
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(said) and RIGHT.fullmatch(initials):
            if best is None or audit < best[1]:
                best = (cost, audit, lines)
        if not any(RIGHT.fullmatch(initials + more) for more in ("", "a", "u", "ua", "sua")):
            continue
        if len(initials) < len(said) + most:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", at, initials + role[0], (*lines, f"{role}:")))
        if at < len(said):
            _, role, text = said[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, initials, lines))
            if faults[at] in ("", "truncated"):
                more = 3 * (faults[at] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + (role[:1] if role[:1] in ("s", "u", "a") else "?"), (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, initials + new[0], (*lines, f"{new}:{text}")))
    return best


def conversation(said):
    """What the report should say of rows (turn, role, text)."""
    said = order([(t, " " if r is None else r, " " if x is None else x) for t, r, x in said])
    faults = fault_list(said)
    turns = [t for t, _, _ in said if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(said, said[1:])]
    cost, audit, lines = cheapest(said)
    numbers = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost)
    return (*numbers, audit), "\n".join(lines)


def reported(spark, conversations, how):
    """Report and repaired text per conv_id, and what they should be."""
    data = [(c, *r, "x", 1, 2) for c, said in conversations.items() for r in said]
    report, repaired = repair(spark.createDataFrame(data, SCHEMA).repartition(3), how)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.block, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = {c: conversation(said) for c, said in conversations.items()}
    return got, {c: "\n".join(lines.get(c, [])) for c in conversations}, {c: w[0] for c, w in want.items()}, {c: w[1] for c, w in want.items()}


def some(rnd, n):
    texts = ("Good.", "Fine!", "Cut", "Cut \n", "", " \t", "Done? \x1c", "Ünï.")
    roles = ("user", "assistant", "system", "tool", "user", "assistant")
    return [(rnd.choice((i, i, i + 1, None)), rnd.choice(roles), rnd.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("least", [1, 2, 1024])
def test_search_over_all_edits(spark, least):
    rnd = random.Random(least)
    conversations = {i: some(rnd, rnd.randint(1, 6)) for i in range(60)}
    got, text, want, want_text = reported(spark, conversations, RepairCosts(least_block=least))
    assert got == want
    assert text == want_text


def test_whole_conversations_stay(spark):
    good = [(0, "system", "Be kind."), (1, "user", "Hello?"), (2, "assistant", "Yes!")]
    got, text, *_ = reported(spark, {1: good, 2: good[1:]}, RepairCosts())
    assert got[1] == (0, 0, 0, 0, 0, 0, "KKK") and got[2] == (0, 0, 0, 0, 0, 0, "KK")
    assert text[2] == "user:Hello?\nassistant:Yes!"


def test_nulls_ties_and_roles(spark):
    conversations = {
        1: [(None, None, None), (None, "user", "A."), (3, None, "B."), (3, "user", None), (3, "user", "A.")],
        None: [(0, "user", "Q?"), (1, "assistant", "R.")],
        3: [(7, "user", "Same."), (7, "user", "Same."), (7, "assistant", "Same.")],
        4: [(None, "", "x" * 5000)],
    }
    got, text, want, want_text = reported(spark, conversations, RepairCosts())
    assert got == want and text == want_text


def test_block_size_changes_nothing_in_a_long_conversation(spark):
    rnd = random.Random(5)
    said = some(rnd, 3000)
    data = [(1, i, r, f"{x} {i}" if x.strip(SPACE) and i % 3 else x, "x", 1, 2) for i, (_, r, x) in enumerate(said)]
    df = spark.createDataFrame(data, SCHEMA)
    found = []
    for least in (1, 700, 10_000):
        report, repaired = repair(df, RepairCosts(least_block=least))
        lines = [f"{r.role}:{r.text}" for r in sorted(repaired.collect(), key=lambda r: (r.block, r.place))]
        found.append((rows(report, *report.columns), lines))
    assert found[0] == found[1] == found[2]
    assert RIGHT.fullmatch("".join(line[0] for line in found[0][1]))


def test_empty(spark):
    report, repaired = repair(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and repaired.count() == 0


def test_query_returns_every_conversation(spark, tmp_path):
    """Damage included: whole results against the search, a conversation without rows among them."""
    rnd = random.Random(11)
    data = [(c, t, rnd.choice(("user", "assistant", "system", None)), rnd.choice(("One. Two.", "Three", "Four!", None))) for c in range(25) for t in range(rnd.randint(1, 5))]
    data += [(c, 0, "user", "Alone.") for c in range(100, 160)]  # some lose their only row
    data.append((None, None, "user", "Null."))
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    left = {}
    for r in queries.damaged_conversations(df).collect():
        left.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    nothing = ((0, 0, 0, 0, 0, 0, ""), "")
    want = {c: conversation(left[c]) if c in left else nothing for c in {r[0] for r in data}}
    got = {r.conv_id: r for r in queries.op13_conversations(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and len(left) < len(want)
    for c, (numbers, text) in want.items():
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == numbers
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_damage(spark):
    df = spark.range(400).select((F.col("id") % 50).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("A. B!").alias("text"))
    got = queries.damaged_conversations(df).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.first("role").alias("r"), F.first("text").alias("x"))
    kinds = {(r.n, r.r, r.x) for r in got.collect()}
    assert kinds == {(1, "assistant", "A. B!"), (1, "assistant", ""), (1, "assistant", "A B"), (2, "assistant", "A. B!"), (1, "user", "A. B!")}
    assert got.count() < 400
