import random

import pytest

from tessera.llm.filenames import canonical_hash, canonical_name, damerau, fingerprints, same_words, slip_prints
from tessera.llm.history import FingerprintStore, add_batch, repeated_files

FILES = "file_id long, filename string, sha256 string, batch_no int, fp string, a int"


def h(i):
    return f"{i:064x}"


def brute(rows):
    """In order of arrival, against every accepted file."""
    accepted, cases = [], {}
    for i, name, sha, *_ in sorted(rows, key=lambda r: (r[3] if r[3] is not None else 99, r[0])):
        digest = canonical_hash(sha)
        words, numbers = canonical_name(name) if name else ((), ())
        for j, d, w, n in accepted:
            if (digest and digest == d) or ((words or numbers) and numbers == n and same_words(words, w)):
                cases[i] = min(cases.get(i, j), j)
        if i not in cases:
            accepted.append((i, digest, words, numbers))
    return {(a, b) for b, a in cases.items()}


def found(spark, rows, **options):
    return {(r.file_id_a, r.file_id_b) for r in repeated_files(spark.createDataFrame(rows, FILES), **options).collect()}


def test_names_that_say_the_same():
    base = canonical_name("Finance/Incident Report Norvel Water NX-9000128.pptx")
    for other in (
        "Inbox/Incident%20Report%20Norvel%20Water%20NX-9000128.pdf", "INCIDENT_REPORT_NORVEL_WATER_NX-9000128.docx", "Copy (2) of Incident Report Norvel Water NX-9000128.pptx",
        "Incident  Report  Norvel  Water  NX-9000128 (rev B).pptx", "Norvel Water - NX-9000128 - Incident Report_signed.pptx", "FW_ Incident.Report.Norvel.Water.NX-9000128.pptx", "Incident Report Norvel Water NX-9000128 - Copy draft (1).pptx",
    ):
        assert canonical_name(other) == base, other
    assert canonical_name("Note 2021-08-03.txt") == canonical_name("note 03.08.2021.txt") == canonical_name("Note_20210803.txt")
    assert canonical_name("Górski Émeral 1.txt")[0] == canonical_name("gorski emeral 1.TXT")[0]
    assert same_words(("cable", "plan"), ("cabel", "plan")) and not same_words(("cable", "plan"), ("work", "plan"))
    assert canonical_name("Plan 2021-08-03.txt")[1] != canonical_name("Plan 2021-08-04.txt")[1]
    assert damerau("abcd", "abdc", 2) == 1 and damerau("a", "abcd", 2) == 3
    assert canonical_hash(f" SHA256:{h(255).upper()} ") == h(255) and canonical_hash("abc") is None and canonical_hash(None) is None
    assert len(set(fingerprints(("cable", "norvel", "plan"), ("1",))) & set(fingerprints(("cable", "norvle", "plan"), ("1",)))) >= 2


@pytest.mark.parametrize("merged", [False, True])
def test_equals_brute_force_over_batches(spark, merged, monkeypatch):
    if merged:  # layers are merged as they come
        monkeypatch.setattr("tessera.llm.history.MERGE", 2)
    rng = random.Random(1)
    kinds, firms = ["Cable Plan", "Work Plan", "Stock Count"], ["Norvel Rail", "Taskan Bank", "Dovric Clinic"]
    rows = []
    for i in range(120):
        name = f"{rng.choice(kinds)} {rng.choice(firms)} NX-{1000000 + rng.randrange(12)}"
        if rng.random() < 0.3:
            at = rng.randrange(4, 10)
            name = name[:at] + name[at + 1] + name[at] + name[at + 2 :]
        rows.append((i, f"Dir/{name}.pdf", rng.choice([h(rng.randrange(60)), h(rng.randrange(60)).upper(), None]), i // 40, "x", 1))
    assert found(spark, rows) == brute(rows)


def test_a_case_is_not_accepted_and_copies_are_many(spark):
    rows = [(1, "a/Plan One 1.txt", h(1), 0, "x", 1), (2, "a/Plan One 1.pdf", h(2), 0, "x", 1), (3, "b/Other Thing 7.txt", h(2), 1, "x", 1), (4, "c/Third Text 9.txt", h(2), 1, "x", 1)]
    assert found(spark, rows) == {(1, 2), (3, 4)}
    copies = [(i, f"d/scan_{i:08x}.pdf", h(9), i % 3, "x", 1) for i in range(90)]
    assert found(spark, copies) == {(0, i) for i in range(1, 90)}


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None, None, None, None), (2, "", None, 0, "x", 1), (3, "---.pdf", None, 0, "x", 1), (4, None, h(4), 0, "x", 1), (4, None, h(4), 0, "x", 1), (5, None, h(4), None, "x", 1), (None, "A 1.txt", h(1), 0, "x", 1), (6, "A" * 5_000 + " 1.txt", None, 0, "x", 1)]
    assert found(spark, rows) == {(4, 5)}
    assert found(spark, []) == set()


def test_short_names_with_slips_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(0, "a/Budget 2024.pdf", h(900), 0, "x", 1), (1, "a/Bugdet 2024.pdf", h(901), 1, "x", 1), (2, "b/Bud get 2024.pdf", h(902), 1, "x", 1), (3, "b/Budget 2025.pdf", h(903), 1, "x", 1)]
    for i in range(4, 120):
        name = rng.choice(["img", "untitled", "invoice", "tax form", "site plan", "red ink set"])
        other = list(name)
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(other) - 1)
            other[at : at + 2] = rng.choice([other[at : at + 2][::-1], other[at : at + 1], ["q", *other[at : at + 2]]]) if len(other) > 2 else other
        rows.append((i, f"d/{''.join(other)} {5000 + rng.randrange(6)}.pdf", h(i), i // 40, "x", 1))
    got = found(spark, rows)
    assert got == brute(rows) and (0, 1) in got
    for _ in range(3000):
        words = [rng.choice(["img", "budget", "untitled", "site", "minutes", "plan", "kx"]) for _ in range(rng.choice([1, 1, 2, 3]))]
        other = " ".join(words)
        for _ in range(2):
            at = rng.randrange(max(len(other) - 1, 1))
            if len(other) < 3:
                continue
            other = other[:at] + rng.choice([other[at : at + 2][::-1], other[at + 1], "q" + other[at : at + 2], "q" + other[at + 1]]) + other[at + 2 :]
        a, b = tuple(sorted(words)), tuple(sorted(other.split()))
        if max(len("".join(a)), len("".join(b))) <= 24 and b and same_words(a, b):
            assert set(slip_prints(a, ("1",))) & set(slip_prints(b, ("1",))), (a, b)


def test_a_store_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    make = lambda rows: spark.createDataFrame(rows, FILES)
    first = add_batch(FingerprintStore(spark, path, 4), make([(1, "a/Work Plan Norvel 1.txt", h(1), 0, "x", 1), (2, "a/Stock Count 2.txt", h(2), 0, "x", 1)]))
    assert first.count() == 0
    again = FingerprintStore(spark, path, 99)  # as in a later session; the number of buckets is the store's
    assert again.buckets == 4 and len(again.layers()) == 1
    got = add_batch(again, make([(3, "b/WORK-PLAN Norvle 1.pdf", h(3), 1, "x", 1), (4, "b/Other 7.txt", h(2), 1, "x", 1), (5, "c/New 8.txt", h(5), 1, "x", 1), (6, "c/new_8.txt", h(6), 1, "x", 1)]))
    assert {(r.file_id_a, r.file_id_b) for r in got.collect()} == {(1, 3), (2, 4), (5, 6)}
    third = FingerprintStore(spark, path)
    assert {(r.file_id_a, r.file_id_b) for r in add_batch(third, make([(7, "d/New 8.doc", h(7), 2, "x", 1)])).collect()} == {(5, 7)}
    assert third.cases().count() == 4


def test_a_batch_that_failed_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1, "a/Work Plan 1.txt", h(1), 0, "x", 1)], FILES)
    monkeypatch.setattr("tessera.llm.history.publish", lambda *_: False)
    with pytest.raises(Exception):
        add_batch(FingerprintStore(spark, path, 4), rows)
    monkeypatch.undo()
    store = FingerprintStore(spark, path, 4)
    assert store.layers() == [] and add_batch(store, rows).count() == 0
    assert {(r.file_id_a, r.file_id_b) for r in add_batch(store, spark.createDataFrame([(2, "b/Work Plan 1.txt", None, 1, "x", 1)], FILES)).collect()} == {(1, 2)}
