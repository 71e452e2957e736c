"""Prefix candidates against all pairs, and families of one template."""

import numpy as np
import pytest

from mnemora.llm import prefixes, simhash


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def some_sets(seed, n=150):
    """Sets with cores in common, of similarities around the threshold, of any size."""
    rng = np.random.default_rng(seed)
    cores = [set(rng.integers(0, 1 << 62, rng.integers(1, 60)).tolist()) for _ in range(8)]
    out = []
    for i in range(n):
        core = cores[i % 8]
        keep = {x for x in core if rng.random() < rng.choice([0.8, 0.95, 1.0])}
        out.append(frozenset(keep | set(rng.integers(0, 1 << 62, rng.integers(0, 6)).tolist())) or frozenset([7]))
    return sorted(set(out), key=sorted)


def frame(spark, sets, component):
    rows = [(i, component(i), bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "node long, component long, shingles binary").repartition(3)


@pytest.mark.parametrize("seed,cells", [(1, 1 << 22), (2, 1 << 22), (3, 1 << 12)])
def test_no_pair_at_the_similarity_is_lost(spark, seed, cells):
    """Whatever the order of members, every pair at the similarity is proposed."""
    counts = np.random.default_rng(seed).integers(2, 9, cells).astype(np.uint16)
    sets = some_sets(seed)
    component = lambda i: i % 3
    want = {(j, i) for i in range(len(sets)) for j in range(i + 1, len(sets)) if component(i) != component(j) and jaccard(sets[i], sets[j]) >= 0.8}
    assert len(want) > 20
    for order in (prefixes.cell_counts(frame(spark, sets, component)), counts):
        rows = []
        for i, s in enumerate(sets):
            members, place = prefixes.prefix(np.array(sorted(s), np.uint64), order, 0.8)
            rows += [(m, len(s), i, component(i), p) for m, p in zip(members.view(np.int64).tolist(), place.tolist())]
        by_member = {}
        for r in rows:
            by_member.setdefault(r[0], []).append(r)
        found = set()
        for r in by_member.values():
            n, node, c, p = (np.array([x[k] for x in r]) for k in (1, 2, 3, 4))
            for i, j in prefixes.passing(np.array([0]), np.array([len(r)]), n, c, p, 0.8):
                found |= {(max(a, b), min(a, b)) for a, b in zip(node[i].tolist(), node[j].tolist())}
        assert want <= found


def test_cells_count_all_members(spark):
    sets = some_sets(5)
    total = np.zeros(prefixes.CELLS, np.int64)
    for s in sets:
        np.add.at(total, [x & (prefixes.CELLS - 1) for x in s], 1)
    assert (prefixes.cell_counts(frame(spark, sets, int)) == total).all()
    assert not prefixes.cell_counts(frame(spark, sets, int).limit(0)).any()


@pytest.mark.parametrize("rows", [1 << 14, 40])
def test_rows_give_pairs_or_name_their_member(spark, rows):
    sets = some_sets(6, 900)
    found = prefixes.prefix_rows(frame(spark, sets, int), 0.8)
    got = prefixes.close_pairs(found, 0.8, lambda batches, rows=rows, most=None: simhash.whole_keys(batches, rows, most)).collect()
    often = {r["member"] for r in found.groupBy("member").count().where(f"count > {prefixes.GROUP}").collect()}
    assert {r["a"] for r in got if r["b"] is None} == often
    own = {}
    for r in found.where("true").collect():
        own.setdefault(r["node"], set()).add(r["member"])
    want = {(j, i) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard(sets[i], sets[j]) >= 0.8 and (own[i] & own[j]) - often}
    assert len(want) > 20 and want <= {(r["a"], r["b"]) for r in got if r["b"] is not None}


def family(n, rng, words=120, own=22):
    """Documents of one template: about 0.7 alike to each other, none at 0.8."""
    base = [f"t{i}" for i in range(words)]
    out = []
    for i in range(n):
        v = list(base)
        at = int(rng.integers(0, words - own))
        v[at : at + own] = [f"x{i}w{k}" for k in range(own)]
        out.append(" ".join(v))
    return out


def test_a_template_family_costs_no_square(spark, monkeypatch):
    """Rows of all steps grow with the family, not with its square, and its members stay apart."""
    made = []
    real = simhash.written

    def counted(df, session, name):
        out = real(df, session, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(simhash, "written", counted)
    rows = {}
    for n in (200, 800):
        made.clear()
        docs = spark.createDataFrame(list(enumerate(family(n, np.random.default_rng(1)))), "doc_id long, text string").repartition(4)
        got = simhash.similar_documents(docs, spark).collect()
        rows[n] = max(c for _, c in made)
        assert len({r["component_id"] for r in got}) > 0.9 * n
        assert any(name == "similar-prefixes" for name, _ in made)
    assert rows[800] < 6 * rows[200]


def test_components_of_families_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    texts = family(40, rng, 60, 9) + family(40, rng, 60, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = lambda got: sorted((r["doc_id"], r["component_id"]) for r in got)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = sorted((i, root(i)) for i in range(len(texts)))
    assert key(simhash.similar_documents(docs, spark).collect()) == want


def test_frequent_members_are_compared_in_blocks(spark, monkeypatch):
    """Short documents of one template: its shingles stand in most prefixes, over GROUP times; pairs alike are still joined."""
    seen = []
    real = simhash.block_edges
    monkeypatch.setattr(simhash, "block_edges", lambda *a: seen.append(1) or real(*a))
    texts = family(400, np.random.default_rng(2), 40, 3)
    near = [t.split() for t in texts[:30]]
    texts += [" ".join(["new", *w[1:]]) for w in near]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    for i in range(30):
        alike = [j for j in range(len(texts)) if jaccard(sets[400 + i], sets[j]) >= 0.8]
        assert all(got[j] == got[400 + i] for j in alike)
    assert seen
