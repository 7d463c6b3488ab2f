import numpy as np
import pytest

from tessera.llm.neighbours import nearest_vectors, probe_sets, similar_pairs, similar_vectors, tables_for

SCHEMA = "vec_set string, id string, embedding array<float>, similarity int"


def families(n, size, seed=0, noise=0.05):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(n):
        centre = rng.normal(size=32)
        out += [centre + rng.normal(size=32) * noise * rng.uniform(0.5, 4) for _ in range(size)]
    return np.array(out, dtype=np.float32)


def brute(ids, m, k, least):
    m = m.astype(float)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    sims = np.round(unit @ unit.T, 6)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if sims[i, j] >= least}
    return out


def run(spark, ids, m, **options):
    rows = [("s", i, v.tolist(), 1) for i, v in zip(ids, m)]
    return {(r.id_a, r.id_b) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA), **options).collect()}


@pytest.mark.parametrize("hot", [16, 2_048])
def test_recall_against_brute_force(spark, hot):
    m = families(150, 8)
    ids = [f"v{i:04d}" for i in range(len(m))]
    true, found = brute(ids, m, 5, 0.85), run(spark, ids, m, hot_cell=hot)
    assert len(found & true) / len(true) >= 0.95
    assert len(found & true) / len(found) >= 0.95


def test_copies_are_found_without_meeting_each_other(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 32)).astype(np.float32)
    m = np.concatenate([np.repeat(base[:1], 40, 0), np.repeat(base[1:2] * 2, 3, 0), base[1:2], base[2:]])
    ids = [f"c{i:02d}" for i in range(len(m))]
    assert run(spark, ids, m) == brute(ids, m, 5, 0.85)


def test_unusable_vectors_take_no_part(spark):
    good = [1.0, 2.0, 3.0]
    rows = [("s", "a", good, 1), ("s", "b", good, 1), ("s", "z", [0.0, 0.0, 0.0], 1), ("s", "n", None, 1), ("s", "e", [], 1), ("s", "h", [1.0, None, 3.0], 1), ("s", "q", [float("nan"), 1.0, 1.0], 1)]
    rows += [("s", "i", [float("inf"), 1.0, 1.0], 1), ("s", "long", [1.0, 2.0, 3.0, 0.0], 1), ("t", "a2", good, 1), ("s", None, good, 1)]
    found = similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_set, r.id, r.other_id, r.similarity, r["rank"]) for r in found) == [("s", "a", "b", 1.0, 1), ("s", "b", "a", 1.0, 1)]
    assert similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probes_and_tables():
    sets = probe_sets(6, 20)
    assert sets[0] == (0,) and len(set(sets)) == 20
    assert all(11 - r not in s for s in sets for r in s)
    assert tables_for(6, 0.548, 0.9, 1.5, 4) >= tables_for(6, 0.2, 0.9, 1.5, 4)


@pytest.mark.parametrize("tile", [40, 65_536])
def test_every_vector_gets_its_nearest_however_far(spark, tile):
    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(size=(150, 16)), np.repeat(rng.normal(size=(1, 16)), 9, 0), families(4, 5)[:, :16]]).astype(np.float32)
    ids = [f"v{i:03d}" for i in rng.permutation(len(m))]
    rows = [("s", i, v.tolist(), 1) for i, v in zip(ids, m)]
    rows += [("s", "zero", [0.0] * 16, 1), ("s", "none", None, 1), ("s", "long", [1.0] * 17, 1), ("t", "a", [1.0, 0.0], 1), ("t", "b", [-1.0, 0.0], 1)]
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    sims = np.round(unit @ unit.T, 6)
    true = {("t", "a", "b", 1, -1.0), ("t", "b", "a", 1, -1.0)}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:5]
        true |= {("s", ids[i], ids[j], n, float(sims[i, j])) for n, j in enumerate(order, 1)}
    got = [(r.vec_set, r.id, r.other_id, r["rank"], r.similarity) for r in nearest_vectors(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()]
    assert set(got) == true and len(got) == len(true)
    assert nearest_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
