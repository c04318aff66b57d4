"""Text operators against the tokenizer libraries and brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from pyspark.sql import functions as F

from placewise.llm import best_fit, language_id, neighbour_vote, orc_tokens, piece_codec, shared, simhash, viterbi_count, word_ids

WORDS, PIECES = word_ids.default_path(), piece_codec.default_path()
SCHEMA = "doc_id long, text string, lang string, fp string, root int, _group int, length string"
ODD = [
    (1, "One two three four five.", "en", "x", 1, 1, ""), (1, "One two three four five.", "en", "x", 1, 1, ""), (2, None, None, None, None, None, None),
    (3, "", "en", "", 0, 0, ""), (None, "no id here", "de", "", 0, 0, ""), (None, None, None, None, None, None, None), (4, " \n\t ", "en", "", 0, 0, ""),
    (5, "wörd " * 9000, "de", "", 0, 0, ""), (6, "x" * 30_000, None, "", 0, 0, ""), (7, "one TWO three four five.", "en", "", 0, 0, ""),
    (8, "  leading and  double ", "en", "", 0, 0, ""), (9, "▁ marks ▁▁ and <|endoftext|> <unk> 中文 😀 e\u0301", "en", "", 0, 0, ""),
]
ALPHABET = [*"abAB'sl ▁  \n\t\x1c\x85\u3000.,!<|>é\u0301İΣ9中😀", "<|endoftext|>", "<unk>", "<0x41>", "<s>", "▁▁", "   ", "the", "ing"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    unigram = Tokenizer(models.Unigram(viterbi_count.vocabulary(PIECES), unk_id=0, byte_fallback=True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES), unigram


def _ids(encoded):
    return np.frombuffer(encoded, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_encodings_equal_the_libraries(libraries, texts):
    words, pieces, unigram = libraries
    raw = [t.encode() for t in texts]
    assert [_ids(x) for x in word_ids.encode_texts(raw, WORDS)] == [[*words.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [_ids(x) for x in piece_codec.encode_texts(raw, PIECES)] == [pieces.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert list(viterbi_count.count_texts(raw, PIECES)) == [len(unigram.encode(t, add_special_tokens=False).ids) for t in texts]


def test_best_segmentation_against_all_segmentations():
    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -2.0), ("b", -3.0), ("ab", -5.0), ("▁a", -4.0), ("ba", -4.0), ("aba", -7.0)]
    counter, score = viterbi_count.Counter(pieces), dict(pieces)

    def every(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            head = text[:k]
            if head in score or k == 1:
                for rest in every(text[k:]):
                    yield [head, *rest]

    for text in ("▁abab", "▁aabba", "▁acb", "▁", "▁cca"):
        cost = lambda parts: sum(score.get(p, -17.0) for p in parts)
        best = max(map(cost, every(text)))
        total, n = counter.best(text)
        assert total == best
        assert n in {len(parts) for parts in every(text) if cost(parts) == best}


def test_counts_of_odd_rows(odd, libraries):
    want = sorted((r[0] or 0, len(libraries[2].encode(r[1] or "").ids)) for r in ODD)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in viterbi_count.counts(odd).collect()) == want


def test_piece_digests_and_round_trip(odd, libraries):
    model = libraries[1]
    want = []
    for doc_id, text, *_ in ODD:
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted((r[0] or 0, *r[1:]) for r in piece_codec.digests(odd).collect()) == sorted(want)
    texts = {r.doc_id: r.text for r in piece_codec.decoded(piece_codec.encoded(odd)).collect()}
    assert texts[8] == "  leading and  double " and texts[7] == ODD[9][1]


def test_orc_files(spark, odd, libraries, tmp_path):
    folder = str(tmp_path / "ids")
    orc_tokens.write(odd, folder, files=3)
    want, start = [], 0
    rows = sorted(((r[0] if r[0] is not None else -1, len(r[1] or ""), r[1] or "") for r in ODD))
    for doc_id, _, text in rows:
        ids = np.array([*libraries[0].encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [(r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in orc_tokens.catalogue(spark, folder).collect()]
    assert sorted(got) == sorted(want)
    one = orc_tokens.read(spark, folder, [7])
    assert one.first().ids == [*libraries[0].encode(ODD[9][1], add_special_tokens=False).ids, 1]
    assert "PushedFilters: [In(doc_id, [7])]" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()


def test_orc_starts_are_places_in_the_files(spark, tmp_path):
    """Equal doc_ids and null ones over several files: starts follow the rows as the files hold them."""
    folder = str(tmp_path / "ids")
    docs = [(None if k % 2 else 7, "word " * (k % 13) + str(k * 7919 % 101)) for k in range(400)]
    orc_tokens.write(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), folder, files=4)
    files = sorted((tmp_path / "ids").glob("part-*.orc"))
    assert len(files) > 2
    want, start = [], 0
    for file in files:
        rows = orc.read_table(str(file)).to_pylist()
        assert [r["row"] for r in rows] == list(range(len(rows)))
        for r in rows:
            want.append((r["doc_id"] or 0, start, r["n_tokens"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())))
            start += r["n_tokens"]
    assert sorted((r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in orc_tokens.catalogue(spark, folder).collect()) == sorted(want)


def test_packing_of_one_row_many_times(spark):
    """Equal rows are spread over the groups."""
    parts = spark.createDataFrame([(None, 0, 0, 10, 5)] * 3000, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    rows = best_fit.pack(parts, group_rows=256).collect()
    groups = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 3000 and len(groups) == 12 and max(groups.values()) < 400


def test_long_unknown_runs_take_time_in_proportion():
    counter = viterbi_count.Counter([("<unk>", 0.0), ("a", -1.0), ("ab", -1.5)])
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert counter.best("ж" * n)[1] == 2 * n and counter.best("z" * n)[1] == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def _check_packing(rows, tokens):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= tokens
    return by_sequence


def test_packing_of_odd_rows(odd, libraries):
    rows = best_fit.packed(odd, best_fit.Capacity(tokens=64, documents=64, attention=64 * 64)).collect()
    _check_packing(rows, 64)
    lengths = {}
    for r in rows:
        lengths.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in ODD:
        if doc_id in (None, 1):
            continue
        ids = np.array([*libraries[0].encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(lengths[doc_id], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in parts] == [(a, min(64, len(ids) - a)) for a in range(0, len(ids), 64)]
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts]
    assert len(lengths[1]) == 2 and len(lengths[None]) == 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    rng = random.Random(3)
    lengths = np.array(sorted((rng.randint(1, 77) for _ in range(700)), reverse=True))
    capacity = best_fit.Capacity(tokens=100, documents=3, attention=6000, rule=rule, weights=(1.0, 1.0, 1.0))
    bins, at = best_fit.place(lengths, capacity)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 6000
        assert sorted(at[bins == b]) == sorted(np.cumsum([0, *own])[:-1])
    bound = max(lengths.sum() / 100, len(lengths) / 3, (lengths**2).sum() / 6000)
    assert bins.max() + 1 <= 1.12 * bound + 1


def test_packing_is_tight_and_refuses_what_cannot_fit(spark):
    rng = random.Random(4)
    parts = spark.createDataFrame([(k, 0, 0, rng.randint(1, 1500), 0) for k in range(5000)], best_fit._PIECES)
    rows = best_fit.pack(parts, best_fit.Capacity(), group_rows=2000).collect()
    assert len(rows) == 5000
    assert len(_check_packing(rows, 4096)) <= 1.01 * sum(r.length for r in rows) / 4096 + 3
    with pytest.raises(ValueError):
        best_fit.pack(parts, best_fit.Capacity(attention=100))


def _fingerprint(text, k=4):
    from xxhash import xxh64_intdigest

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(rows):
    """doc_id -> smallest doc_id reachable, for (doc_id, fingerprint)."""
    label = {}
    for i, f in rows:
        reached, grew = {f}, True
        while grew:
            more = {g for _, g in rows if any((g ^ x).bit_count() <= 4 for x in reached)}
            grew, reached = more != reached, more
        label[i] = min((j for j, g in rows if g in reached and j is not None), default=None)
    return label


def test_simhash_of_odd_rows(odd):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(simhash.classes(odd)).collect()}
    rows = [(r[0], _fingerprint(r[1])) for r in ODD]
    label = _classes([r for r in rows])
    for doc_id, f in rows:
        if doc_id is not None:
            assert (doc_id, f"{f:016x}", label[doc_id]) in got


def test_simhash_classes_against_brute_force(spark):
    rng = random.Random(7)
    words = ["w%d" % i for i in range(300)]
    docs = []
    for i in range(150):
        base = [rng.choice(words) for _ in range(rng.randint(2, 120))]
        docs.append((i, " ".join(base)))
        for k in range(rng.choice([0, 0, 2])):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            docs.append((1000 + 10 * i + k, "\t".join(near).upper()))
    got = {r.doc_id: r.component_id for r in simhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _classes([(i, _fingerprint(t)) for i, t in docs])


@pytest.mark.parametrize("seed,budget", [(1, 4), (2, 0), (3, 7)])
def test_trie_join_finds_exactly_the_near_pairs(seed, budget):
    rng = np.random.default_rng(seed)
    values = set(rng.integers(0, 2**64, 700, dtype=np.uint64).tolist()) | {0, 2**64 - 1}
    for v in list(values)[:250]:
        for _ in range(3):
            flipped = v
            for b in rng.choice(64, rng.integers(0, 9), False):
                flipped ^= 1 << int(b)
            values.add(flipped)
    values = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    trie = simhash.Trie(values)
    got = [(i, j) for a, b in simhash.trie_links(trie, trie, True, budget, chunk=500) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(got) == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
    k = len(values) // 3
    got = [(i, j + k) for a, b in simhash.trie_links(simhash.Trie(values[:k]), simhash.Trie(values[k:]), False, budget, chunk=500) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(got) == sorted((i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(near))) if i < k <= j)


def test_links_of_one_hot_prefix(spark):
    """Thousands of fingerprints below one prefix: one class, few edges."""
    rng = np.random.default_rng(5)
    hot = np.uint64(0xABCDEF) << np.uint64(40)
    values = np.unique(np.concatenate([hot | rng.integers(0, 1 << 12, 3000, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = simhash.links(df)
    assert edges.count() < 40 * len(values)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    forest = shared.Forest(len(values))
    forest.add(*np.nonzero(near))
    want = {int(v): int(values.view(np.int64)[r]) for v, r in zip(values.view(np.int64), forest.roots(np.arange(len(values))))}
    got = {r.node: r.root for r in shared.components(edges).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values()) if sum(v == r for v in m.values()) > 1}
    assert groups(got) == groups(want)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], [(0, k) for k in range(1, 60)], [(k, k + 1) for k in range(40)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    forest = shared.Forest(100)
    for a, b in edges:
        forest.add(np.array([a]), np.array([b]))
    assert got == {n: int(forest.roots(np.array([n]))[0]) for n in nodes}


def test_kneser_ney_probabilities_sum_to_one():
    grams = {}
    for word in ["abba", "abc", "bca", "cab", "abba", "b"]:
        padded = "    " + word + " "
        for i in range(len(word) + 1):
            grams[padded[i : i + 5]] = grams.get(padded[i : i + 5], 0) + 1
    model = language_id.fit_counts([("xx", g, n) for g, n in grams.items()] + [("yy", "    z", 3), ("yy", "   z ", 3)])
    assert model.languages == ["xx", "yy"]
    alphabet = "abcz "
    for context in ("    ", "   a", "  ab", " abb", "qqqq", "cabb"):
        windows = np.array([[ord(c) for c in context + last] for last in alphabet], np.uint64)
        p = np.exp(language_id.log_probabilities(model, windows)).sum(axis=0)
        # What is missing from one is left for characters that were never seen.
        assert (p <= 1 + 1e-6).all() and (p[0] > 0.8)
        unseen = np.exp(language_id.log_probabilities(model, np.array([[ord(c) for c in context + "?"]], np.uint64)))[0]
        assert p + unseen == pytest.approx(np.ones(2), abs=1e-5)


def _two_languages(spark, n=400):
    rng = random.Random(11)
    parts = {"aa": ["lo", "ra", "ne", "mi", "ta"], "bb": ["scht", "ung", "pf", "eck", "ang"]}
    rows = []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang, "s", len(text)))
    return rows, "doc_id long, text string, lang string, source string, n_chars long"


def test_language_of_held_out_rows(spark):
    rows, schema = _two_languages(spark)
    docs = spark.createDataFrame(rows, schema)
    model = language_id.train(docs, per_language=256)
    odd = [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "123 !? 456", "bb", "s", 0), (903, "QXZ qxzzq zzxq qqzx xzzq " * 20, "aa", "s", 0)]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows + odd, schema), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    for k in (900, 901, 902):
        assert (got[k].lang_pred, got[k].score, got[k].accepted) == ("und", 0.0, False)
    assert got[903].lang_pred in ("aa", "bb") and not got[903].accepted
    kept = {r.doc_id for r in language_id.keep(spark.createDataFrame(rows + odd, schema), model).collect()}
    assert kept == {r[0] for r in rows}


def test_language_never_learns_from_held_out_rows(spark):
    rows, schema = _two_languages(spark, 120)
    spoiled = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows]
    assert language_id.train(spark.createDataFrame(spoiled, schema)).languages == ["aa", "bb"]
    nothing = spark.createDataFrame([(1, None, "aa", "s", 0), (2, "some text", None, "s", 0)], schema)
    model = language_id.train(nothing)
    assert model is None
    assert [r.lang_pred for r in language_id.predict(nothing, model).collect()] == ["und", "und"]


def _quality_rows():
    rng = random.Random(13)
    words = ["%s%s" % (a, b) for a in "bcdfg" for b in ("alo", "eri", "uno", "ity")]
    rows, labels = [], []
    for i in range(500):
        clean = i % 4 != 0
        tokens = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        text = " ".join(tokens).capitalize() + "." if clean else " ".join(t + rng.choice(["###", "$$$"]) for t in tokens)
        rows.append((i, text))
        labels.append((i, int(clean)))
    return rows, labels


def test_quality_of_held_out_rows(spark):
    rows, labels = _quality_rows()
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, rows[1][1])], "doc_id long, text string")
    marked = spark.createDataFrame(labels + [(1, 1), (None, 1), (950, None)], "doc_id long, quality int")
    model = neighbour_vote.train(docs, marked, max_labelled=256)
    got = {r.doc_id: r for r in neighbour_vote.score(docs, model).collect()}
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert all(got[i].predicted == q for i, q in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[900].score == got[901].score
    assert got[None].predicted == 1
    # Flipped labels of held-out rows change nothing.
    flipped = [(i, 1 - q) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q) for i, q in labels]
    again = neighbour_vote.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int"), max_labelled=256)
    assert np.array_equal(again.labels, model.labels)


def test_votes_against_all_cosines():
    rng = np.random.default_rng(2)
    rows = [(int(k % 3 > 0), np.sort(rng.choice(neighbour_vote.WIDTH, 30, False)).astype(np.int64), rng.random(30) + 1) for k in range(60)]
    model = neighbour_vote.fit(rows, dimensions=12, neighbours=5)
    asked = [(t, w) for _, t, w in rows[:7]]
    points = np.array([neighbour_vote._balanced(t, w * model.rarity[t]) @ model.space[t] for t, w in asked])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    for k, p in enumerate(points):
        cosine = model.vectors @ p
        best = np.argsort(-cosine)[:5]
        w = np.clip(cosine[best], 0, 1) ** 2 + 1e-9
        assert neighbour_vote.votes(model, asked)[k] == pytest.approx((w * model.labels[best]).sum() / w.sum())


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert simhash.digest(simhash.classes(docs)).count() == 0
    assert simhash.first_of_class(docs).columns == docs.columns
    assert best_fit.packed(docs).count() == 0
    assert piece_codec.digests(docs).count() == viterbi_count.counts(docs).count() == 0
    orc_tokens.write(docs, str(tmp_path / "none"))
    assert orc_tokens.catalogue(spark, str(tmp_path / "none")).count() == 0
    assert language_id.train(docs) is None and language_id.keep(docs, None).count() == 0
    assert neighbour_vote.train(docs, labels) is None and neighbour_vote.keep(docs, None).count() == 0


def test_one_row_of_each_class_stays(odd):
    kept = sorted((r.doc_id or 0) for r in simhash.first_of_class(odd).collect())
    label = _classes([(r[0], _fingerprint(r[1])) for r in ODD])
    assert kept == sorted([0, 0] + [i for i in label if i is not None and label[i] == i])
    assert simhash.first_of_class(odd).columns == odd.columns


def test_trimmed_tables_give_the_same_results():
    made = []
    table = shared.ChunkTable(lambda chunks: [made.append(c) or len(c) for c in chunks], limit=3, longest=4)
    rows = [[b"a", b"bb", b"a"], [b"longer than four", b"a"], [b"ccc", b"dddd"], [b"a", b"ccc"]]
    assert [table.look_up([r])[0] for r in rows] == [[len(c) for c in r] for r in rows]
    assert len(made) > len(set(made)) and len(table.known) <= 5 and b"longer than four" not in table.known


def test_labelled_text_of_a_repeated_id_does_not_follow_the_order_of_rows(spark):
    rows, labels = _quality_rows()
    twice = rows + [(i, "zz " + t[::-1]) for i, t in rows[:60]]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    scores = []
    for data in (twice, twice[::-1]):
        docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        scores.append({r.doc_id: round(r.score, 9) for r in neighbour_vote.score(spark.createDataFrame(rows[60:], docs.schema), neighbour_vote.train(docs, table)).collect()})
    assert scores[0] == scores[1]
