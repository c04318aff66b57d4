"""Address entities as arrays of structs, built from column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions import lexicon as lex
from placewise.functions.text import extract_pincode, normalize_addresses
from placewise.session import settled

ENTITY = "array<struct<entity_type:string,value:string,confidence:double,relation:string>>"
_MARK = "\u0001"
_KEYWORDS = [w for words in lex.LANDMARK_WORDS.values() for w in words]


def _entity(kind: str, value: Column, confidence: float) -> Column:
    return F.struct(
        F.lit(kind).alias("entity_type"), value.alias("value"), F.lit(confidence).alias("confidence"),
        F.lit(None).cast("string").alias("relation"),
    )


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(1))


def _each(kind: str, matches: Column, confidence: float, wrap=lambda v: v) -> Column:
    return F.transform(matches, lambda v: _entity(kind, wrap(v), confidence)).cast(ENTITY)


def _one(kind: str, value: Column, confidence: float) -> Column:
    return F.filter(F.array(_entity(kind, value, confidence)), lambda e: e["value"].isNotNull()).cast(ENTITY)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?U){pattern}", 1), F.lit(""))


def relations(text: Column) -> Column:
    """(before, relation, after) of every relation word: patterns in order, matches left to right.

    Each match is fenced by a marker, so the split text alternates between
    plain pieces and matches and the neighbours can be read off.
    """
    found = [_relation_triples(text, pattern) for pattern in lex.RELATION_PATTERNS]
    return F.filter(F.flatten(F.array(*found)), lambda r: (r["before"] != "") | (r["after"] != ""))


def _relation_triples(text: Column, pattern: str) -> Column:
    pieces = F.split(F.regexp_replace(text, f"(?U){pattern}", f"{_MARK}$1{_MARK}"), _MARK)

    def triple(i: Column) -> Column:
        left = F.array_join(F.slice(pieces, 1, i * 2 + 1), "")
        right = F.array_join(F.slice(pieces, i * 2 + 3, F.size(pieces)), "")
        return F.struct(
            F.regexp_extract(left, r"(?U)(\S+)\s*$", 1).alias("before"),
            F.element_at(pieces, (i * 2 + 2).cast("int")).alias("relation"),
            F.regexp_extract(right, r"(?U)^\s*(\S+)", 1).alias("after"),
        )

    n = F.floor((F.size(pieces) - 1) / 2).cast("int")
    # Most texts have no match for most patterns: those skip the split pieces, most even the regex.
    indexes = F.when(_holds(text, _heads(pattern)) & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(indexes, triple)


def _heads(pattern: str) -> list[str]:
    """The letters that the alternatives of a relation pattern start with: a match holds one of them."""
    return sorted({re.match("[a-z]+", way).group() for way in pattern.removeprefix(r"\b(").split("|")})


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def landmark(text: Column, rels: Column) -> Column:
    """The relation neighbour that names a landmark, else the first landmark word with its context."""
    any_word = "|".join(_KEYWORDS)
    first = F.get(F.filter(rels, lambda r: r["after"].rlike(any_word) | r["before"].rlike(any_word)), F.lit(0))
    by_relation = F.when(first.isNotNull(), F.when(first["after"].rlike(any_word), first["after"]).otherwise(first["before"]))
    words = F.array(*[F.lit(w) for w in _KEYWORDS])
    word = F.get(F.filter(words, lambda w: F.contains(text, w)), F.lit(0))
    pattern = F.concat(F.lit(r"(?U)([a-z\s]{0,20}"), word, F.lit(r"[a-z\s]{0,20})"))
    context = F.trim(F.call_function("regexp_extract", text, pattern, F.lit(1)))
    return F.coalesce(by_relation, F.when(word.isNotNull(), context))


def _states(text: Column) -> Column:
    """struct(rest, hits): known state names, each removed from the text once found."""
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("hits"))

    def step(acc: Column, state: Column) -> Column:
        hit = F.contains(acc["rest"], state)
        return F.struct(
            F.replace(acc["rest"], state, F.lit("")).alias("rest"),
            F.when(hit, F.array_append(acc["hits"], state)).otherwise(acc["hits"]).alias("hits"),
        )

    return F.aggregate(F.array(*[F.lit(s) for s in lex.STATES]), start, step)


def _suffixed(suffix: str):
    return lambda v: F.initcap(F.concat(F.trim(v), F.lit(f" {suffix}")))


def _word_in(text: Column, word: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" ")))


def extract_entities(df: DataFrame, text: str) -> DataFrame:
    """Normalises ``text`` and adds entities, relations, pincode, landmark, locality, city, state and confidence.

    Equal texts are read once. Few small files hold many addresses, so the distinct texts are
    dealt over all tasks whatever their bytes.
    """
    told = F.coalesce(F.col(text), F.lit(""))
    context = df.sparkSession.sparkContext
    tasks = max(2 * context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # By a hash: a second shuffle by the text itself would be taken for the first and merged into few tasks.
    texts = df.select(told.alias("_told")).distinct().repartition(tasks, F.xxhash64("_told"))
    facts = settled(_extracted(texts, "_told"))
    kept = df.select("*", told.alias("_text")).drop(*[c for c in facts.columns if c != text])
    return kept.join(facts, kept["_text"] == facts["_told"]).drop("_text", "_told")


def _extracted(df: DataFrame, text: str) -> DataFrame:
    out = normalize_addresses(df, text)
    t = F.col("normalized_address")
    out = out.withColumn("_st", _states(t)).withColumn("relations", relations(t))
    out = out.withColumn("pincode", extract_pincode(t)).withColumn("landmark", landmark(t, F.col("relations")))
    rest = F.col("_st.rest")

    house = [_each("HOUSE_NUMBER", _all(t, p), 0.8) for p in lex.HOUSE_NUMBER_PATTERNS]
    building = [_each("BUILDING", _all(t, p), 0.75, F.trim) for p in lex.BUILDING_PATTERNS]
    cross = _each("CROSS", _all(t, lex.CROSS_PATTERN), 0.9, lambda v: F.concat(v, F.lit(" cross")))
    road = _each("STREET", _all(t, lex.ROAD_PATTERN), 0.8, lambda v: F.concat(F.trim(v), F.lit(" road")))
    main = F.when(F.contains(t, F.lit("main road")), "main road").when(F.contains(t, F.lit("main cross")), "main cross")
    states = _each("STATE", F.col("_st.hits"), 0.95, F.initcap)
    codes = F.array(*[F.struct(F.lit(k).alias("code"), F.lit(v).alias("state")) for k, v in lex.STATE_CODES.items()])
    by_code = F.transform(F.filter(codes, lambda s: _word_in(rest, s["code"])), lambda s: F.initcap(s["state"]))
    localities = [
        _each("LOCALITY", F.when(F.contains(rest, F.lit(s)), _all(rest, rf"([a-z\s]+?)\s+{s}\b")).otherwise(F.array().cast("array<string>")), 0.7, _suffixed(s))
        for s in lex.LOCALITY_SUFFIXES
    ]
    sector = _first(t, lex.SECTOR_PATTERN)
    directions = F.filter(F.array(*[F.lit(w) for w in sorted(lex.DIRECTION_WORDS)]), lambda w: _word_in(t, w))
    entities = F.concat(
        *house, *building, cross, road, _one("STREET", main, 0.7), states, _each("STATE", by_code, 0.85), *localities,
        _one("FLOOR", _first(t, lex.FLOOR_PATTERN), 0.8),
        _one("BLOCK", _first(t, lex.BLOCK_PATTERN), 0.8),
        _one("SECTOR", F.concat(F.lit("sector "), sector), 0.85),
        _each("DIRECTION", directions, 0.7),
    )
    out = out.withColumn("entities", entities).drop("_st")
    e = F.col("entities")
    mean = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x["confidence"]) / F.size(e)
    extracted = F.least(
        F.lit(1.0),
        mean
        + F.when(F.col("pincode").isNotNull(), 0.1).otherwise(0.0)
        + F.when(F.col("landmark").isNotNull() & (F.col("landmark") != ""), 0.1).otherwise(0.0)
        + F.least(F.lit(0.1), F.size("relations") * 0.03),
    )
    return out.withColumns(
        {
            "locality": first_value("LOCALITY"),
            "city": first_value("CITY"),
            "state": first_value("STATE"),
            "confidence": F.least(F.col("norm_confidence"), F.when(F.size(e) == 0, 0.3).otherwise(extracted)),
        }
    )


def first_value(kind: str) -> Column:
    return F.get(F.filter("entities", lambda e: e["entity_type"] == kind), F.lit(0))["value"]
