import random

import pytest

from tessera.llm.names import compare_firms, compare_people, is_nickname, lcs_ratio, name_groups, name_links, parse_name, same_names, same_spelling, slip_keys

NAMES = "phrase_id string, phrase string, form string, key int"


def groups(spark, names, **options):
    df = spark.createDataFrame([(str(i), n, "x", 1) for i, n in enumerate(names)], NAMES)
    by = {}
    for r in name_groups(df, "phrase_id", "phrase", **options).collect():
        by.setdefault(r.group_id, set()).add(names[int(r.id)])
    return {frozenset(g) for g in by.values()}


def test_parsing():
    assert parse_name("KETEDENAR, Anthony") == parse_name("dr anthony t ketedenar") == ("person", ["anthony", "ketedenar"], "")
    assert parse_name("The Kefabagor University P.L.C.") == parse_name("university of kefabagor") == ("firm", ["kefabagor"], "university")
    assert parse_name("bubudodur med assoc") == parse_name("Bubudodur Medical Association Ltd.")
    assert parse_name("dababenan gmbh") == ("firm", ["dababenan"], "")
    assert parse_name("asset ba 00192") is None and parse_name("  ") is None and parse_name("...") is None


def test_comparison():
    assert lcs_ratio("abcd", "abxd") == 0.75 and same_spelling("ketedenar", "ketidenar") and not same_spelling("ketedenar", "figibemur")
    assert is_nickname("ben", "benjamin") and is_nickname("larry", "lawrence") and is_nickname("mina", "wilhelmina") and not is_nickname("tony", "benjamin")
    many = {"johannes": 30, "yohannes": 30}
    assert compare_people(["gibemur", "johannes"], ["gibemur", "yohannes"], many) is None
    assert compare_people(["gibemur", "johannes"], ["gibemur", "johanes"], many)[0] == "S"


def test_one_group_for_each(spark):
    anthony = ["anthony ketedenar", "Anthony  Ketedenar", "KETEDENAR, Anthony", "anthony t ketedenar", "anthhony ketedenar", "anthony ketidenar", "tony ketedenar", "anthony kete denar", "capt anthony ketedenar"]
    water = ["bonabar water authority", "Bonabar Water Authority S.C.", "water authority of bonabar", "bonabar wtr auth", "bonbar water authority", "bonabar s c"]
    other = [["bonifar water authority", "bonifar limited"], ["deborah ketedenar"], ["bonabar2 tunnel"], ["lolo university", "lolo univ"]]
    got = groups(spark, anthony + water + [n for g in other for n in g] + [None, ""])
    assert got == {frozenset(anthony), frozenset(water), *(frozenset(g) for g in other if g != ["bonabar2 tunnel"])}


def test_short_names_that_fit_two_are_left_alone(spark):
    names = ["alexander bidedulur", "anthony bidedulur", "a bidedulur", "pogobotun telecom services", "pogobotun savings bank", "pogobotun gmbh"]
    assert groups(spark, names) == {frozenset([n]) for n in names}


@pytest.mark.parametrize("block", [3, 40])
def test_common_tokens_are_refined_not_dropped(spark, block):
    names = [f"michael sur{chr(97 + i // 26)}{chr(97 + i % 26)}namo" for i in range(60)]
    got = groups(spark, [*names, "michael surzzorel", "mike surzzorel", "michael surzzorrel"], block=block)
    assert frozenset(["michael surzzorel", "mike surzzorel", "michael surzzorrel"]) in got


def test_pairs_repeats_and_empty(spark):
    rows = [("b", "anna petrov", "x", 1), ("a", "Petrov, Anna", "x", 1), ("a", "Petrov, Anna", "x", 1), ("c", None, "x", 1), (None, "anna petrov", "x", 1), ("d", "x" * 20_000, "x", 1)]
    pairs = same_names(spark.createDataFrame(rows, NAMES), "phrase_id", "phrase").collect()
    assert [(r.id_a, r.id_b) for r in pairs] == [("a", "b")]
    assert same_names(spark.createDataFrame([], NAMES), "phrase_id", "phrase").count() == 0


def test_firms_of_a_common_core_are_compared(spark):
    kinds = ["bank", "university", "museum", "hotel", "port", "railway", "union", "club", "school", "clinic", "college", "airline"]
    names = [f"{core} {a} {b}" for core in ("abay", "bonabar") for a in kinds for b in kinds if a < b] + ["abbay bank hotel", "bonbar club hotel", "bonabar union", "bonabar gmbh"]
    names += [f"{first} {core}" for first in ("anna", "peter", "maria", "john") for core in ("abay", "bonabar", "abayneh")] + ["martin martin", "martin martyn"]
    names += [f"martin {x}{y}rolin" for x in "bdfgklm" for y in "aeiouyr"]
    parsed = {"|".join((c, " ".join(t), k)): (c, t, k) for c, t, k in map(parse_name, names)}
    true = set()
    for a, (class_a, tokens_a, kind_a) in parsed.items():
        for b, (class_b, tokens_b, kind_b) in parsed.items():
            if a < b and class_a == class_b == "firm" and compare_firms(tokens_a[0], kind_a, tokens_b[0], kind_b):
                true.add((a, b))
    forms = spark.createDataFrame([(f, *x) for f, x in parsed.items()], "form string, class string, tokens array<string>, kind string")
    found = {tuple(sorted((r.a, r.b))) for r in name_links(forms).collect()}
    assert {p for p in found if p[0].startswith("firm")} == true and len(true) > 40
    assert ("person|martin martin|", "person|martin martyn|") in found


def test_every_slip_in_a_core_leaves_a_key():
    rng = random.Random(3)
    for n in (3, 4, 5, 8, 11, 12, 13, 22, 24, 25, 26, 27, 28, 40, 90):
        for _ in range(150):
            core = "".join(rng.choice("abcdefgh") for _ in range(n))
            other = list(core)
            for _ in range(rng.choice([1, 2])):
                i, how = rng.randrange(len(other) - 1), rng.randrange(4)
                other[i : i + 2] = {0: other[i : i + 2][::-1], 1: other[i : i + 1], 2: ["x", *other[i : i + 2]], 3: ["x", other[i + 1]]}[how]
            other = "".join(other)
            assert not same_spelling(core, other) or slip_keys(core) & slip_keys(other), (core, other)
