from datetime import datetime, timedelta, timezone

from tessera.llm.defects import LEAST_END, broken_pairs, is_copy, is_empty, is_refusal, judge, language_of, terminal_context

MESSAGES = "message_id long, conversation_id long, parent_id long, role string, content string, created_at timestamp, pos string"
T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def row(i, conversation, role, content, minute, parent=None):
    return (i, conversation, parent, role, content, None if minute is None else T0 + timedelta(minutes=minute), "x")


def test_defects_of_single_answers():
    q = "Who is responsible for the training budget at Golebar?"
    assert all(is_empty(a) for a in (None, "", " \n​", "[3]", "N/A", "<empty>", "…", "(none)", "Answer:"))
    assert not any(is_empty(a) for a in ("No [1]", "Yes", "Q3", "7"))
    assert is_copy(q, q.lower()) and is_copy(q, f"> {q}\n\n…") and is_copy(q, f"Question: {q}\nAnswer: {q}") and is_copy(q, q.replace("budget", "buget"))
    assert not is_copy(q, q[:-1] + ": the finance team has answered for it since March, as the minutes show.")
    assert is_refusal("Golebar: I'm sorry, but I can’t help with that request. [2]") and is_refusal("Dazu möchte ich mich nicht äußern.")
    assert not is_refusal("I could not find a signed copy, but the draft names 34 sites.") and not is_refusal("The documents give no figure for this.")
    assert [terminal_context(a)[0] for a in ("The network desk moved the window. The data centre asked for", "Text.\n\n```\nvlan 8\n na", "| a | b |\n| --- | --- |\n| 1 |", "It was renewed (see page")] == ["line", "fence", "part of a row", "bracket"]
    assert [terminal_context(a)[0] for a in ("All was done.", "Text:\n\n```\nvlan 8\n```", "| a | b |\n| --- | --- |\n| 1 | 2 |")] == ["stop", "block", "row"]
    assert language_of("Das Rechenzentrum hat ein zweites Angebot angefordert.") == "de" and language_of("De auditcommissie heeft de begroting goedgekeurd.") == "nl"
    assert judge("Answer in French: what is the status of the move?", "The move was completed by the end of the month.")[0] == "language"
    assert judge("Answer in French: what is the status of the move?", "Le comité d'audit a approuvé le budget révisé.")[0] is None


def test_pairs_across_tasks_and_the_terminal_context(spark):
    lists = [row(1_000 + i, 50, "assistant", "- The desk corrected the address list\n- The desk restored the missing folders", 900 + i) for i in range(5)]
    rows = [
        row(1, 1, "user", "What did the desk do about the records?", 0), row(2, 1, "assistant", "- The desk restored the missing folders\n- The desk corrected the address list", 1),
        row(3, 1, "user", "And what did the desk do after that?", 2), row(4, 1, "assistant", "- The desk restored the missing folders\n- The desk corrected the", 3),
        row(5, 1, "user", "And who signed?", 4), row(6, 1, "tool", "x", 5), row(7, 1, "assistant", None, 6), row(7, 1, "assistant", None, 6), row(8, 1, "assistant", "Nobody asked.", 7),
        row(9, None, "user", "q", 0), row(10, 2, "user", None, 0), row(11, 2, "assistant", "The board approved it.", 1), row(12, 2, "user", "q", None),
    ]
    found = {(r.question_id, r.answer_id, r.defect) for r in broken_pairs(spark.createDataFrame(rows + lists, MESSAGES)).collect()}
    assert found == {(3, 4, "truncated"), (5, 7, "empty")}
    many = [row(2 * i + k, 1, "user" if k == 0 else "assistant", "Is it done?" if k == 0 else "", 2 * i + k) for i in range(150) for k in (0, 1)]
    assert broken_pairs(spark.createDataFrame(many, MESSAGES)).count() == 150
    assert broken_pairs(spark.createDataFrame([], MESSAGES)).count() == 0


def test_refusals_and_copies_of_any_length():
    no = "I'm sorry, but I can't help with that request. "
    assert is_refusal(no) and is_refusal(no * 9) and is_refusal(no * 200)
    assert not is_refusal("The board approved the budget of the year and asked for a second quote from the vendor. " * 9 + no)
    assert is_copy("Why so?", "Why so?") and is_copy("Why so?", "why so") and is_copy("A?", "A") and not is_copy("A?", "B") and not is_copy("Why so?", "Yes") and not is_copy("Is it red?", "It is.")
    q = "Who is responsible for the training budget at Golebar? " * 40
    assert is_copy(q, q.upper()) and is_copy(q[:55], q) and not is_copy(q, "The finance team is responsible for the training budget at Golebar, as the minutes of March show.")


def test_truncation_goes_by_probability(spark):
    other = [row(1_000 + i, 50, "assistant", "- The desk saw the file\n- The desk saw the file and kept it", 900 + i) for i in range(300)]
    pair = [row(1, 1, "user", "What did the desk see and do?", 0), row(2, 1, "assistant", "- It kept it\n- The desk saw the file", 1)]
    defect = lambda rows: [r.defect for r in broken_pairs(spark.createDataFrame(rows, MESSAGES)).filter("answer_id = 2").collect()]
    assert defect(pair + other) == [] and 0 < LEAST_END < 0.5  # a line ends there as often as it goes on
    on = [row(5_000 + i, 51, "assistant", "- The desk saw the file and kept it\n- Done", 900 + i) for i in range(300)]
    assert defect(pair + on) == ["truncated"]
