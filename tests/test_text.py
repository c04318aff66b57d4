"""Exact expectations for clean-up, entities, parsing and fuzzy scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placewise.functions import entities, fuzzy, gazetteer, lexicon, narrative, text
from placewise.operators import place_features

LOCALITIES = [("L1", "T1", "Kuvempu Layout"), ("L2", "T1", "Nehru Colony"), ("L3", "T1", "Green Park Layout")]

PARSE_CASES = [
    ("No. 328, 4th Cross, 3rd Main Rd, Kuvempu Layt, Kaveripura - 960102", "L1", 4.0, 3.0, "960102", None, "near"),
    ("6th Cross, 5th Main, ಚರ್ಚ್ ಹತ್ತಿರ, Kuvempu Layt, Kaveripura - 960102", "L1", 6.0, 5.0, "960102", "church", "near"),
    ("3rd cross 3rd main bhd hanuman temple kuvempu layout kaveripura", "L1", 3.0, 3.0, None, "hanuman_temple", "behind"),
    ("367/3 e block 2nd road green park layt kaveripura - 980301", "L3", 2.0, 5.0, "980301", None, "near"),
    ("NO. 393, GALI NO-, DOODH DAIRY KE PAAS, NEHRU COLONY", "L2", None, None, None, "milk_dairy", "near"),
    ("4TH CROSS, 2ND MN, KAVERIPURA - 960102", None, 4.0, 2.0, "960102", None, "near"),
    ("2nd cross near communitty hall kuvempu layot", "L1", 2.0, None, None, "community_hall", "near"),
]


def test_gazetteer_parser(spark):
    rows = [(i, "T1", c[0]) for i, c in enumerate(PARSE_CASES)]
    addresses = spark.createDataFrame(rows, "id int, town_id string, address_text string")
    localities = spark.createDataFrame(LOCALITIES, "locality_id string, town_id string, locality_name string")
    towns = spark.createDataFrame([("T1", "Kaveripura")], "town_id string, town_name string")
    out = {r.id: r for r in gazetteer.parse_addresses(addresses, localities, towns).collect()}
    for i, (_, locality, s1, s2, pin, landmark, relation) in enumerate(PARSE_CASES):
        r = out[i]
        assert (r.locality_id, r.s1, r.s2, r.pincode, r.landmark_type, r.relation) == (locality, s1, s2, pin, landmark, relation), i


def _common(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        above = rows[:]
        for j, y in enumerate(b, 1):
            rows[j] = above[j - 1] + 1 if x == y else max(above[j], rows[j - 1])
    return rows[-1]


def test_misspelt_names_against_all_pairs(spark):
    rng = random.Random(7)
    names = {"T1": ["kuvempu layout", "gandhi nagar", "gandhi nagara", "aab aab", "ಜಯ ನಗರ", "pura", "pur"], "T2": ["gandhi nagar", "pura colony"]}

    def spoil(text):
        letters = list(text)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = [rng.choice("aeginprು")] if rng.random() < 0.5 else []
        return " ".join("".join(letters).split())

    phrases = []
    for k in range(120):
        town = rng.choice(["T1", "T2", ""])
        words = [rng.choice(["no", "12", "cross", "near", "a"]) for _ in range(rng.randint(0, 4))]
        words.insert(rng.randint(0, len(words)), spoil(rng.choice(names["T1"])))
        phrases.append((town, " ".join(" ".join(words).split())))
    listed = [(f"L{k}", town, name.title() if name.isascii() else name) for town in names for k, name in enumerate(names[town])]
    localities = spark.createDataFrame(listed, "locality_id string, town_id string, locality_name string")
    got = {(r.town_id, r.phrase): (r.hit.locality_id, round(r.hit.score, 9), r.hit.start) for r in gazetteer.localities_of(spark.createDataFrame(phrases, "town_id string, phrase string").distinct(), localities).collect()}
    want = {}
    for town, phrase in phrases:
        words, found = phrase.split(" "), []
        for place, own, name in listed:
            name, width = name.lower(), len(name.split())
            for i in range(len(words) - width + 1 if own == town else 0):
                span = " ".join(words[i : i + width])
                score = 200 * _common(span, name) / (len(span) + len(name)) if span or name else 100
                if score >= 82:
                    found.append((-round(score, 9), place, i))
        if found:
            score, place, i = min(found)
            want[town, phrase] = (place, -score, i)
    assert got == want and sum(s < 100 for _, s, _ in want.values()) > 15


def test_misspelt_landmark_words(spark):
    words = ["temple", "masjid", "masjidd", "cuhrch", "communitty", "ganesh", "bus", "buss", "मस्जिद", "12345", "pharmcy", "zzzzz"]
    got = {r.word: (r.landmark_type, r.known) for r in gazetteer.landmark_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    listed = [(w, kind) for kind, own in lexicon.LANDMARK_TYPE_WORDS.items() for w in own]
    want = {}
    for word in words:
        exact = [kind for w, kind in listed if w == word]
        near = [kind for w, kind in listed if w.isascii() and len(w) >= 5 and 200 * _common(word, w) / (len(word) + len(w)) >= 84]
        if exact:
            want[word] = (exact[-1], True)
        elif len(word) >= 5 and word.isascii() and not word.isdigit() and near:
            want[word] = (near[0], False)
    assert got == want and ("communitty" in got) and ("buss" not in got)


NORMAL_CASES = [
    ("Hanuman Mandir", "hanuman temple", "en"),
    ("हनुमान मंदिर के पीछे", None, "hi"),
    ("Flat 201, MG Road, Bangalore", "flat 201, mg road, bangalore", "en"),
    ("Flat   201,   ABC   Apts; MG Rd", "flat 201, abc apartments, mg road", "en"),
    ("", "", None),
    ("  opp. Post Office – Main Rd. ", "opposite. post office - main road", "en"),
]


def test_normalise(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(NORMAL_CASES)], "id int, a string")
    out = {r.id: r for r in text.normalize_addresses(df, "a").collect()}
    for i, (_, expected, language) in enumerate(NORMAL_CASES):
        if expected is not None:
            assert out[i].normalized_address == expected
        assert out[i].language == language
        assert 0.0 <= out[i].norm_confidence <= 1.0
    assert out[4].norm_confidence == 0.0
    assert "हनुमान" in out[1].normalized_address


def test_nfc_only_changes_composition(spark):
    df = spark.createDataFrame([("café",), ("plain",), (None,)], "a string")
    assert [r[0] for r in df.select(text.normalize_unicode("a")).collect()] == ["café", "plain", None]


def test_relations_keep_pattern_order(spark):
    df = spark.createDataFrame([("shop near temple opposite bank and near park",)], "a string")
    rels = df.select(entities.relations(F.col("a")).alias("r")).collect()[0].r
    assert [(x.before, x.relation, x.after) for x in rels] == [
        ("shop", "near", "temple"), ("and", "near", "park"), ("temple", "opposite", "bank"),
    ]


def test_entities(spark):
    df = spark.createDataFrame(
        [("Flat 12, Shanti Apartment, 2nd Cross, Gandhi Nagar, Karnataka, Sector 5, 3 floor 2 560001",)], "a string"
    )
    r = entities.extract_entities(df, "a").collect()[0]
    kinds = {(e.entity_type, e.value) for e in r.entities}
    assert ("HOUSE_NUMBER", "12") in kinds
    assert ("CROSS", "2nd cross") in kinds
    assert ("STATE", "Karnataka") in kinds
    assert ("SECTOR", "sector 5") in kinds
    assert ("FLOOR", "2") in kinds
    assert ("LOCALITY", "Gandhi Nagar") in kinds
    assert r.pincode == "560001" and r.state == "Karnataka"


def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_against_table():
    rng = random.Random(7)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 80)))
        b = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 80)))
        assert fuzzy.lcs_length(a, b) == _lcs(a, b)


def test_partial_ratio_against_all_windows():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 15)))
        b = "".join(rng.choice("abcde ") for _ in range(rng.choice([len(a), rng.randint(1, 25)])))
        sides = [(a, b), (b, a)] if len(a) == len(b) else [min((a, b), (b, a), key=lambda x: len(x[0]))]
        best = max(fuzzy.ratio(s, t[max(0, i) : i + len(s)]) for s, t in sides for i in range(1 - len(s), len(t)))
        assert fuzzy.partial_ratio(a, b) == fuzzy.partial_ratio(b, a) == pytest.approx(best)
    assert fuzzy.partial_ratio("xabx", "abyy") == fuzzy.partial_ratio("abyy", "xabx") == pytest.approx(200 / 3)


def test_partial_ratio():
    assert fuzzy.partial_ratio("temple", "hanuman temple road") == 100.0
    assert fuzzy.partial_ratio("abc", "xyz") == 0.0
    assert fuzzy.ratio("layout", "layt") == pytest.approx(80.0)


def test_token_set_ratio(spark):
    df = spark.createDataFrame(
        [("a b c", "c b a x"), ("near temple", "temple road"), ("foo", "bar"), ("", "x")], "a string, b string"
    )
    got = [r[0] for r in df.select(fuzzy.token_set_ratio_col(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100.0
    # shared "temple" (6); leftovers near/road share no more than "r" -> best is shared against shared + leftover
    assert got[1] == pytest.approx(100 - 100 * 6 / 22)
    assert got[2] == pytest.approx(fuzzy.ratio("foo", "bar"))
    assert got[3] == 0.0


def test_directions(spark):
    df = spark.createDataFrame(
        [([("LANDMARK", "temple", 0.9, "BEHIND"), ("CROSS", "2nd cross", 0.9, None)], None, None), ([], None, "Gandhi Nagar"), ([], None, None)],
        f"entities {entities.ENTITY}, landmark string, locality string",
    )
    steps = narrative.direction_steps("entities", "landmark", "locality", F.lit(True))
    got = [r[0] for r in df.select(narrative.directions_text(steps)).collect()]
    assert got[0].split("\n") == [
        "1. Go behind temple.", "2. Continue towards 2nd cross.", "3. Continue on 2nd cross.",
        "4. The predicted location is approximately at this point.",
    ]
    assert got[1].startswith("1. Reach Gandhi Nagar.")
    assert got[2] == "1. The predicted location is approximately at this point."


def test_remark_correction(spark):
    df = spark.createDataFrame([("The actual place is behind the lane, ok",), ("nothing here",), (None,)], "r string")
    got = [r[0] for r in df.select(text.remark_correction("r")).collect()]
    assert got[0].startswith("actual place is behind") and got[1] is None and got[2] is None


def test_pair_similarity_by_hand(spark):
    schema = "account_id long, latitude double, longitude double, normalized_address string, landmark string, locality string, pincode string, building string, street string, cross string"
    features = spark.createDataFrame(
        [
            (1, 12.0, 77.0, "flat 2 near lake", "near lake", "Abc Nagar", "560001", "Rose", None, "3rd cross"),
            (2, 12.0, 77.0, "near lake flat 2", "near  lake", "Abd Nagar", "560002", "rose", "x road", "4th cross"),
            (3, None, None, None, None, None, None, None, None, None),
            (4, 12.001, 77.0, None, "school", None, "560001", None, None, None),
        ],
        schema,
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "account_id long, other_id long")
    got = {(r.account_id, r.other_id): r.similarity for r in place_features.pair_similarity(pairs, features).collect()}
    weights = place_features.WEIGHTS
    parts = {"spatial": 1.0, "landmark": 1.0, "text": 1.0, "building": 1.0, "locality": 16 / 18, "pincode": 0.0, "cross": 0.0}
    assert got[(1, 2)] == pytest.approx(sum(weights[k] * v for k, v in parts.items()) / sum(weights[k] for k in parts))
    assert got[(1, 3)] == 0.0
    away = 6371000 * math.radians(0.001)
    parts = {"spatial": math.exp(-away / 200), "landmark": 0.0, "pincode": 1.0}
    assert got[(1, 4)] == pytest.approx(sum(weights[k] * v for k, v in parts.items()) / sum(weights[k] for k in parts))


def test_equal_texts_are_read_once(spark):
    """The patterns run before the join that gives each row its text's facts; a null text reads as an empty one."""
    texts = ["No 5, 3rd Cross, near temple, Gandhi Nagar - 560001", "12 Rose Apartments, behind Old Bank, Delhi", None, ""]
    rows = [(i, texts[i % 4], f"kept {i}") for i in range(40)]
    out = entities.extract_entities(spark.createDataFrame(rows, "id long, a string, pincode string").coalesce(1), "a")
    assert "regexp" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.id: r for r in out.collect()}
    assert len(got) == 40
    for i in range(40):
        assert (got[i].a, got[i].raw_address) == (texts[i % 4], (texts[i % 4] or ""))
        assert got[i][2:] == got[i % 4][2:]
    assert (got[0].pincode, got[0].landmark, got[0].locality, got[1].state, got[2].confidence) == ("560001", "temple,", "Gandhi Nagar", "Delhi", got[3].confidence)
    assert [(r.before, r.relation, r.after) for r in got[1].relations] == [("apartments,", "behind", "old")]


def test_every_relation_word_passes_the_guard(spark):
    """Each way of each pattern is found, though the pattern only runs on texts that hold its letters."""
    ways = [w.replace("\\s+", "  ") for p in lexicon.RELATION_PATTERNS for w in p.removeprefix("\\b(").removesuffix(")\\b").split("|")]
    df = spark.createDataFrame([(i, f"a {w} b") for i, w in enumerate(ways)], "id int, t string")
    got = {r.id: r.rels for r in df.select("id", entities.relations(F.col("t")).alias("rels")).collect()}
    assert all(any(x.relation in w or w in x.relation for x in got[i]) for i, w in enumerate(ways)) and len(ways) > 40


def test_rules_look_for_their_letters_first(spark):
    """The reordered rule finds what the rule finds, also beside letters of other scripts."""
    words = ["no", "no.", "xno", "éno no", "nono no.5", "apts. apt", "crs cr xr xrd.", "ke peech ke  peeche", "कno no", "post office postoffice", "sec_ sec-5", "bus stop"]
    df = spark.createDataFrame([(" ".join(words),), *[(w,) for w in words]], "t string")
    for pattern, to in lexicon.ABBREVIATION_RULES:
        first = text._letters_first(pattern)
        assert not first.startswith(r"(?U)\b")
        assert df.filter(F.regexp_replace("t", f"(?U){pattern}", to) != F.regexp_replace("t", first, to)).isEmpty()
