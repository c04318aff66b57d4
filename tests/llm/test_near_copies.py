"""Classes of near copies against brute-force Jaccard over whole sets of shingles."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from placewise.llm import near_copies, simhash
from placewise.llm.shared import components


def _sets(rows):
    out = []
    for _, text in rows:
        words = (text or "").lower().encode().split()
        k = min(5, len(words))
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    return out


def _brute(rows):
    """The smallest doc_id of each row's class, and the similarities of linked pairs of different texts."""
    sets, parent, linked = _sets(rows), list(range(len(rows))), []

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                parent[top(i)] = top(j)
                if a != b:
                    linked.append(len(a & b) / len(a | b))
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids.setdefault(top(i), []).append(doc_id)
    return [min(ids[top(i)]) for i in range(len(rows))], linked


def _rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    line = [f"licence{i}" for i in range(30)]
    rows = []

    def add(text):
        rows.append((len(rows), text))

    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(6, 160))]
        add(" ".join(base))
        for edits in range(1, 5):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(words)
            add(" ".join(other))
        add(" ".join(base[:-2]).upper())
        add(" ".join(base + line))
    # A large group of near copies: most of them are like the base only, and like no other copy.
    base = [rng.choice(words) for _ in range(100)]
    for _ in range(60):
        other = list(base)
        for at in rng.sample(range(100), 2):
            other[at] = rng.choice(words)
        add(" ".join(other))
    # Exactly 0.8: 20 of 25 shingles; and just below: 19 of 24.
    edge = [f"e{i}" for i in range(60)]
    add(" ".join(edge[:29]))
    add(" ".join(edge[:24]))
    add(" ".join(edge[30:58]))
    add(" ".join(edge[30:53]))
    for text in (None, "", " \n", "one", "ONE", "one two", "one two three four five", "one two three four five six"):
        add(text)
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_classes_against_brute_force(spark, block, monkeypatch):
    rows = _rows()
    whole = near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda docs, each, shingle: whole(docs, each, shingle, block=block))
    monkeypatch.setattr(near_copies, "COUNTED", 4000)
    got = {r.doc_id: r.component_id for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, linked = _brute(rows)
    assert got == dict(zip((i for i, _ in rows), want))
    assert sum(0.8 <= x < 0.9 for x in linked) > 30


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    rows = _rows()
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    want, _ = _brute(rows)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=lambda i: (i is None, i)) == [*sorted(set(want)), None]


def test_stage_keeps_every_class_when_doc_ids_repeat(spark):
    texts = {c: " ".join(f"{c}{k}" for k in range(40)) for c in "ABCD"}
    rows = [(1, texts["A"], 1), (2, texts["A"], 1), (2, texts["B"], 1), (3, texts["B"] + " x", 1), (5, texts["C"], 2), (5, texts["D"], 1), (5, texts["D"], 3), (5, texts["D"], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int").repartition(3)
    kept = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert kept == [(1, texts["A"], 1), (2, texts["B"], 1), (5, texts["C"], 2), (5, texts["D"], 1)]


def test_shared_line_and_template_cluster(spark):
    """A line that all texts hold links nothing; a large template cluster is one class; no task makes rows for all pairs."""
    rng = random.Random(8)
    line = " ".join(f"licence{i}" for i in range(20))
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(60)) + " " + line) for i in range(1500)]
    base = [f"t{i}" for i in range(120)]
    for i in range(2000, 3500):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i if i < 2000 else 2000 for i, _ in rows}


def test_stage_checks_what_simhash_proposes(spark, monkeypatch):
    """Without the search by shared shingles the stage still links what fingerprints show, and only what the exact check confirms."""
    base = [f"w{k}" for k in range(400)]
    near, far = [*base[:399], "x"], [f"v{k}" for k in range(400)]
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(far)), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # The fingerprint of an unlike text one bit from that of the first.
    prints = {0: 0, 1: 1, 2: 3, 3: 0, 4: 0}
    table = spark.createDataFrame([(i, f) for i, f in prints.items()], "doc_id long, fp long")
    own = lambda docs, shingle=4: docs.join(table, "doc_id").select("doc_id", F.xxhash64("text").alias("place"), "fp")
    monkeypatch.setattr(simhash, "fingerprints", own)
    monkeypatch.setattr(near_copies, "links", lambda docs, each, shingle: docs.sparkSession.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3]


def test_stage_checks_all_pairs_of_a_simhash_class(spark, monkeypatch):
    """Two alike texts whose fingerprints are chained through that of an unlike one: the chain's links fail, the pair does not."""
    base, far = [f"w{k}" for k in range(400)], [f"v{k}" for k in range(400)]
    rows = [(0, " ".join(far)), (1, " ".join(base)), (2, " ".join([*base[:399], "x"])), (3, " ".join(far[::-1])), (4, " ".join([*far[:0:-1], "x"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Fingerprint 0 is the chain's end for 1 and 3; 3 and 4 share theirs with an unlike text of the class.
    table = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 0), (4, 0)], "doc_id long, fp long")
    own = lambda docs, shingle=4: docs.join(table, "doc_id").select("doc_id", F.xxhash64("text").alias("place"), "fp")
    monkeypatch.setattr(simhash, "fingerprints", own)
    monkeypatch.setattr(near_copies, "links", lambda docs, each, shingle: docs.sparkSession.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 1, 3]


def test_rounds_of_components_keep_their_estimates_small(spark):
    """Spark's estimate of a join is the product of its sides; carried from round to round it filled the driver."""
    n = 300
    labels = components(spark.createDataFrame([(i * 37 % n, (i + 1) * 37 % n) for i in range(n - 1)], "a long, b long"))
    assert {(r.node, r.root) for r in labels.collect()} == {(i, 0) for i in range(n)}
    assert int(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 20


def test_no_rows(spark):
    assert near_copies.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
