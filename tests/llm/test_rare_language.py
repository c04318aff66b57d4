"""Rejection by languages with few labelled rows."""

import random
import zlib

import numpy as np
import pytest

from placewise.llm import language_id

_SCHEMA = "doc_id long, text string, lang string"


def _texts(syllables, rng, n, words=60):
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize("labelled", [6, 20])
def test_rare_language_rejects_what_no_language_knows(spark, labelled):
    rng = random.Random(3)
    learned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    common = _texts(["ba", "lo", "ri", "ten", "mu"], rng, 300)
    rare = _texts(["ke", "zo", "vish", "pra", "nu"], rng, labelled + 10)
    rows = [(i, t, "aa") for i, t in zip(learned, common)] + [(i, t, "zz") for i, t in zip(learned[300:], rare[:labelled])]
    model = language_id.train(spark.createDataFrame(rows, _SCHEMA), per_language=256)
    assert model.languages == ["aa", "zz"]
    foreign = _texts(["щу", "жа", "ыл", "эф", "ях"], rng, 10)
    unlearned = ["".join(rng.choice("bcdfghjkqwxy") if rng.random() < 0.9 else " " for _ in range(400)) for _ in range(10)]
    asked = [(k, t) for k, t in enumerate([*rare[labelled:], *foreign, *unlearned])]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert all(got[k].accepted and got[k].lang_pred == "zz" for k in range(10))
    assert not any(got[k].accepted for k in range(10, 30))


def test_no_held_back_row_at_all(spark):
    model = language_id.calibrated(language_id.fit_counts([("aa", "    b", 5), ("aa", "   ba", 5), ("aa", "  ba ", 5)]), [])
    _, _, ok = language_id.judge(model, *language_id.Scorer(model).entropies([b"ba ba ba", "щужа ыл эф".encode()]))
    assert ok.tolist() == [True, False]


def _plain_kneser_ney(words, order=5):
    """log-probability(context, character) from dictionaries: highest order by counts, lower ones by distinct continuations."""
    tables = [{}]
    for word in words:
        padded = " " * (order - 1) + word + " "
        for i in range(len(word) + 1):
            gram = padded[i : i + order]
            tables[0][gram] = tables[0].get(gram, 0) + 1
    for _ in range(order - 1):
        shorter = {}
        for gram in tables[-1]:
            shorter[gram[1:]] = shorter.get(gram[1:], 0) + 1
        tables.append(shorter)
    tables.reverse()
    alphabet = {gram[-1] for gram in tables[0]}

    def discount(table):
        once, twice = (sum(c == k for c in table.values()) for k in (1, 2))
        return min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))

    def probability(context, char):
        p = 1 / (len(alphabet) + 1)
        for n, table in enumerate(tables, 1):
            tail = context[len(context) - n + 1 :]
            follow = [c for g, c in table.items() if g[:-1] == tail]
            if follow:
                d = discount(table)
                p = max(table.get(tail + char, 0) - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p
        return p

    return probability


def test_probabilities_against_a_plain_model():
    rng = random.Random(4)
    words = ["".join(rng.choice("aabbcde") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    grams: dict = {}
    for word in words:
        padded = "    " + word + " "
        for i in range(len(word) + 1):
            grams[padded[i : i + 5]] = grams.get(padded[i : i + 5], 0) + 1
    model = language_id.fit_counts([("xx", g, n) for g, n in grams.items()])
    plain = _plain_kneser_ney(words)
    asked = ["".join(rng.choice("abcdez ") for _ in range(5)) for _ in range(300)] + list(grams)
    windows = np.array([[ord(c) for c in x] for x in asked], np.uint64)
    got = np.exp(language_id.log_probabilities(model, windows))[:, 0]
    assert np.allclose(got, [plain(x[:4], x[4]) for x in asked], rtol=1e-5)


def test_number_characters_are_no_letters(spark):
    assert language_id.words_of("ab½c²dé ①x 一".encode()) == ["ab", "c", "dé", "x", "一"]
    rows = [(k, "ba lo ri ten mu", "aa") for k in range(40)] + [(100, "½ ② ³ 5", "aa")]
    model = language_id.train(spark.createDataFrame(rows, _SCHEMA))
    got = {r.doc_id: (r.lang_pred, r.score, r.accepted) for r in language_id.predict(spark.createDataFrame(rows, _SCHEMA), model).collect()}
    assert got[100] == ("und", 0.0, False) and got[0][0] == "aa" and got[0][2]


def test_many_languages_with_rare_ones(spark):
    rng = random.Random(6)
    parts = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(6)] for k in range(60)}
    learned = iter(i for i in range(20_000) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows, asked = [], []
    for k, (lang, own) in enumerate(parts.items()):
        texts = _texts(own, rng, (3 if k % 6 == 0 else 25) + 4, 40)
        rows += [(next(learned), t, lang) for t in texts[4:]]
        asked += [(len(asked) + j, t, lang) for j, t in enumerate(texts[:4])]
    model = language_id.train(spark.createDataFrame(rows, _SCHEMA))
    assert model.languages == sorted(parts)
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(asked, _SCHEMA), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in asked) >= 0.98 * len(asked)
    assert sum(got[i].accepted for i, _, _ in asked) >= 0.97 * len(asked)


def test_equal_windows_are_looked_up_once(monkeypatch):
    model = language_id.fit_counts([("xx", "    b", 5), ("xx", "   ba", 5), ("yy", "  bad", 2), ("yy", " bad ", 2)])
    windows, _ = language_id.windows_of(["bad", "ba", "dab"])
    want = np.concatenate([language_id.log_probabilities(model, windows[k : k + 1]) for k in range(len(windows))])
    asked, rows = [], language_id._rows
    monkeypatch.setattr(language_id, "_rows", lambda keys, values, wanted, otherwise: asked.append(len(wanted)) or rows(keys, values, wanted, otherwise))
    got = language_id.log_probabilities(model, np.tile(windows, (50, 1)))
    assert np.array_equal(got, np.tile(want, (50, 1)))
    assert max(asked) <= len(windows)
