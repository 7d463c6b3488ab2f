import random
from datetime import datetime, timedelta, timezone

import pytest

from tessera.llm.conversations import kahn_order, reply_order, whole_conversations

MESSAGES = "message_id long, conversation_id long, parent_id long, role string, content string, created_at timestamp, pos string"
T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def row(i, conversation, role, content, minute, parent=None):
    return (i, conversation, parent, role, content, None if minute is None else T0 + timedelta(minutes=minute), "x")


def whole(spark, rows):
    return sorted((r.conversation_id, r.turn_no, r.message_id) for r in whole_conversations(spark.createDataFrame(rows, MESSAGES)).collect())


def test_kahn_breaks_ties_by_priority_and_leaves_cycles():
    order, left = kahn_order([1, 2, 3, 4, 5], {2: [1], 3: [1], 4: [5], 5: [4]}, {1: 0, 2: 9, 3: 1, 4: 0, 5: 0})
    assert order == [1, 3, 2] and sorted(left) == [4, 5]


def test_whole_and_broken(spark):
    rows = [
        row(1, 1, " USER ", "hi there", 0), row(2, 1, "Bot", "hello", 0), row(9, 1, "user", "hi there", 0), row(3, 1, "system", "?", None),
        row(10, 2, "user", "a", 0), row(11, 2, "user", "b", 1), row(12, 2, "assistant", "c", 2),
        row(20, 3, "user", "a", 0), row(21, 3, "assistant", "...", 1),
        row(30, 4, "user", "a", 0), row(31, 4, "assistant", "b", 1), row(32, 4, "user", "late", None),
        row(40, 5, "user", "a", 0), row(41, 5, "assistant", None, 1), row(50, 6, "user", "a", 0), row(51, 6, "n/a", "b", 1), row(52, 6, "assistant", "c", 2),
        row(60, None, "user", "a", 0), row(70, 7, "user", "a", 0), row(71, 7, "assistant", "b", 0), row(71, 7, "assistant", "b", 0), row(80, 8, "user", "a", 0),
    ]
    assert whole(spark, rows) == [(1, 1, 1), (1, 2, 2), (7, 1, 70), (7, 2, 71)]
    assert whole(spark, []) == []


def test_long_conversation_is_ordered_over_many_tasks(spark):
    rows = [row(i, 1, "user" if i % 2 == 0 else "assistant", f"text {i}", i, i - 1 if i else None) for i in range(300)]
    random.Random(1).shuffle(rows)
    assert whole(spark, rows) == [(1, i + 1, i) for i in range(300)]


def test_replies_that_run_backwards_are_put_behind_their_parents(spark):
    rows = [row(1, 1, "user", "q", 5), row(2, 1, "assistant", "a", 3, 1), row(3, 1, "user", "q2", 6, 2), row(4, 1, "assistant", "a2", 7, 3), row(5, 2, "user", "x", 1, 6), row(6, 2, "assistant", "y", 2, 5)]
    ordered = {r.message_id: (r.pos, r.cyclic) for r in reply_order(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert [ordered[i][0] for i in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert ordered[5][1] and ordered[6][1]
    assert whole(spark, rows) == [(1, i, i) for i in (1, 2, 3, 4)]


def brute_order(rows):
    """Kahn's algorithm over whole conversations; parent of a message: the latest of those given."""
    by = {}
    for m, c, parent, *_, created, _x in rows:
        by.setdefault(c, []).append((created, m, parent))
    out = {}
    for c, said in by.items():
        said.sort(key=lambda r: (r[0], r[1]))
        place = {m: i for i, (_, m, _p) in enumerate(said)}
        order, left = kahn_order([m for _, m, _p in said], {m: (p,) for _, m, p in said if p in place}, place)
        out |= {m: (i, m in left) for i, m in enumerate(order + sorted(left, key=place.get))}
    return out


@pytest.mark.parametrize(("cut", "most"), [(1_000, 100_000), (5, 12), (3, 1)])
def test_reply_order_equals_kahn_over_whole_conversations(spark, cut, most):
    rng = random.Random(cut * most)
    rows = []
    for c in range(4):
        ids = [100 * c + i for i in range(40)]
        for k, i in enumerate(ids):
            parent = rng.choice([None, rng.choice(ids), ids[max(0, k - 1)], ids[max(0, k - rng.randrange(4))], ids[min(39, k + rng.randrange(3))]])
            rows.append(row(i, c, "user", f"text {i}", k, parent))
    rng.shuffle(rows)
    got = {r.message_id: (r.pos, r.cyclic) for r in reply_order(spark.createDataFrame(rows, MESSAGES), cut, most).collect()}
    want = brute_order(rows)
    assert {m for m, p in got.items() if p[1]} == {m for m, p in want.items() if p[1]}
    for c in range(4):  # every order holds the replies' order, and ties go by time
        mine = sorted((p[0], m) for m, p in got.items() if m // 100 == c)
        assert [p for p, _ in mine] == list(range(40))
    free = {c for c in range(4) if not any(p[1] for m, p in want.items() if m // 100 == c)}
    assert {m: p for m, p in got.items() if m // 100 in free} == {m: p for m, p in want.items() if m // 100 in free}


def test_long_backward_reply_in_a_long_conversation(spark):
    rows = [row(i, 1, "user", f"text {i}", i, {0: 59, 1: 0, 30: 29, 31: 58, 40: 31}.get(i)) for i in range(60)]
    got = {r.message_id: (r.pos, r.cyclic) for r in reply_order(spark.createDataFrame(rows, MESSAGES), 5, 10).collect()}
    assert got == brute_order(rows) and not any(c for _, c in got.values())


def test_a_message_that_replies_to_itself_lies_on_a_cycle(spark):
    rows = [row(1, 1, "user", "q", 0, 1), row(2, 1, "assistant", "a", 1, 1), row(3, 2, "user", "q", 0), row(4, 2, "assistant", "a", 1, 3)]
    got = {r.message_id: r.cyclic for r in reply_order(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False} and whole(spark, rows) == [(2, 1, 3), (2, 2, 4)]
