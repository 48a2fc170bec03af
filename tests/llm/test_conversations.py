import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import conversations, repair_search

SCHEMA = "conv_id long, turn long, role string, text string, gone int, fault string, part int, print string, low long"
NEXT = {"s": 1, "u": 2, "a": 3}


def table(spark, rows):
    return spark.createDataFrame([(*row, 7, "x", 3, "p", 5) for row in rows], SCHEMA)


def shortest(messages, entry=0, goals=(0, 3)):
    """The least (cost, edits) by a plain shortest-path search over all prefixes."""
    settled, queue = {}, [(0, "", 0, entry)]
    while queue:
        cost, edits, at, state = heapq.heappop(queue)
        if (at, state) in settled:
            continue
        settled[at, state] = cost, edits
        due = "a" if state == 2 else "u"
        heapq.heappush(queue, (cost + 5, edits + "I", at, NEXT[due]))
        if at < len(messages):
            fault, initial = messages[at]
            heapq.heappush(queue, (cost + 2, edits + "D", at + 1, state))
            if fault != repair_search.DOOMED:
                more = 5 * (fault == repair_search.CUT)
                heapq.heappush(queue, (cost + 1 + more, edits + "R", at + 1, NEXT[due]))
                if initial == due or (initial == "s" and state == 0):
                    heapq.heappush(queue, (cost + more, edits + "K", at + 1, NEXT[initial]))
    return min((settled[len(messages), goal] for goal in goals if (len(messages), goal) in settled), default=None)


def every(messages, limit):
    """All edit scripts with at most `limit` insertions, tried one by one."""
    best = None
    stack = [(0, "", 0, "", 0)]
    while stack:
        at, initials, cost, edits, inserted = stack.pop()
        if at == len(messages) and re.fullmatch("(s?(ua)+)?", initials):
            best = (cost, edits) if best is None else min(best, (cost, edits))
        if inserted < limit:
            stack += [(at, initials + new, cost + 5, edits + "I", inserted + 1) for new in "ua"]
        if at < len(messages):
            fault, initial = messages[at]
            stack.append((at + 1, initials, cost + 2, edits + "D", inserted))
            if fault != 1:
                more = 5 * (fault == 2)
                stack.append((at + 1, initials + initial, cost + more, edits + "K", inserted))
                stack += [(at + 1, initials + new, cost + 1 + more, edits + "R", inserted) for new in "ua"]
    return best


def test_search_against_all_scripts_and_shortest_paths():
    pick = random.Random(3)
    for _ in range(150):
        messages = [(pick.choice([0, 0, 0, 1, 2]), pick.choice("suauax")) for _ in range(pick.randrange(5))]
        assert repair_search.search(messages)[0] == every(messages, 2) == shortest(messages)
    for _ in range(150):
        size = pick.randrange(60)
        messages = [(pick.choice([0, 0, 0, 0, 1, 2]), pick.choice("suauax")) for _ in range(size)]
        want = shortest(messages)
        assert repair_search.search(messages)[0] == want
        cut = pick.randrange(size + 1)
        both = repair_search.joined(repair_search.paths(messages[:cut]), repair_search.paths(messages[cut:]))
        assert repair_search.cheapest(both) == want
        for entry in range(4):
            for goal in range(4):
                assert both.get((entry, goal)) == shortest(messages, entry, (goal,))


@pytest.mark.parametrize("roles", ["u", "a", "ua", "us", "uas", "x", "suat"])
def test_search_ends_soon(roles):
    pick = random.Random(roles)
    for faults in ([0], [0, 0, 0, 1, 2], [2], [0, 2]):
        messages = [(pick.choice(faults), pick.choice(roles)) for _ in range(repair_search.PART)]
        found, opened = repair_search.search(messages)
        assert found == shortest(messages) and opened < 100 * len(messages)


def expected(rows):
    groups = defaultdict(list)
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        damage = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        role = "user" if damage == 4 else role
        groups[conv_id] += [(turn, role, text)] * {0: 0, 3: 2}.get(damage, 1)
    out = []
    for conv_id, mine in groups.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, messages, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            sound = text.strip(" \t\n\v\f\r")
            fault = "blank" if not sound else "duplicate" if (role, text) in seen else "truncated" if sound[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            messages.append(({None: 0, "truncated": 2}.get(fault, 1), role[:1]))
        turns = {turn for turn, _, _ in mine if turn is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = shortest(messages)
        at, lines = 0, []
        for edit in audit:
            due = "user" if sum(not line.startswith("s") for line in lines) % 2 == 0 else "assistant"
            if edit == "I":
                lines.append(f"{due}:")
                continue
            _, role, text = mine[at]
            at += 1
            if edit != "D":
                lines.append(f"{role if edit == 'K' else due}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv_id, gaps, *count.values(), illegal, cost, audit, digest))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0))


def got(df, *sizes):
    rows = conversations.repaired(conversations.damaged(df), *sizes).collect()
    return sorted((tuple(row) for row in rows), key=lambda x: (x[0] is not None, x[0] or 0))


def odd(seed, size, conversations_, turns):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "so", " ", "", "Well. \n", "é.", "long " * 50 + ".", None, "end. ", "One. Two"]
    roles = ["user", "assistant", "system", "tool", "", "unknown", None, "user", "assistant", "user", "assistant"]
    return [
        (pick.choice([None, *range(conversations_)]), pick.choice([None, *range(turns)]), pick.choice(roles), pick.choice(texts))
        for _ in range(size)
    ]


@pytest.mark.parametrize("sizes", [(), (3, 4)])
def test_odd_rows_against_brute_force(spark, sizes):
    rows = odd(1, 500, 60, 9) + odd(2, 200, 1, 300) + [(99, 0, "user", "Hi.")] * 40
    assert got(table(spark, rows), *sizes) == expected(rows)


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_over_many_tasks(spark, many_tasks):
    pick = random.Random(6)
    long = [(5, turn, pick.choice(["user", "assistant"]), pick.choice(["Well.", f"So {turn}.", "cut"])) for turn in range(3000)]
    rows = odd(4, 200, 9, 5) + long
    frame = table(spark, rows)
    runs = conversations.runs_of(conversations.with_faults(conversations.damaged(frame))).collect()
    assert sum(row.conv_id == 5 for row in runs) > 1
    assert got(frame) == expected(rows)


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(row.conv_id, row.turn, row.role, row.text) for row in df.collect()]
    assert got(df) == expected(rows)
    assert sorted(map(tuple, conversations.result(df).collect())) == expected(rows)


def test_dropped_and_empty(spark):
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(table(spark, [(dropped, 0, "user", "Hi.")])) == [(dropped, 0, 0, 0, 0, 0, 0, "", empty)]
    assert got(table(spark, [])) == []
