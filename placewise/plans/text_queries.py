from pyspark.sql import functions as F

from placewise.functions import entities, fuzzy, gazetteer, lexicon, narrative, text
from placewise.plans.metric_queries import rounded
from placewise.plans.registry import query


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _normal_sql(column: str) -> str:
    out = f"lower({column})"
    for pattern, replacement in lexicon.ABBREVIATION_RULES:
        out = f"regexp_replace({out}, {_quote(pattern)}, {_quote(replacement)}, 'g')"
    out = f"regexp_replace({out}, '\\s+', ' ', 'g')"
    out = f"regexp_replace({out}, '[;|/\\\\]+', ',', 'g')"
    out = f"regexp_replace({out}, '\\s*,\\s*', ', ', 'g')"
    out = f"regexp_replace({out}, ',+', ',', 'g')"
    out = f"trim({out}, ' ,.;')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


NORMAL_SQL = f"SELECT address_id, address_text AS raw, {_normal_sql('address_text')} AS normalized FROM v_addresses"
_COUNT = "length(regexp_replace({c}, '[^a-zA-Z0-9]', '', 'g'))"


@query(
    "e1_e8_normalised_addresses",
    f"""SELECT address_id, normalized AS normalized_address, 'en' AS language, regexp_extract(normalized, '\\b(\\d{{6}})\\b', 1) AS pincode,
 round(least(1.0, least(1.0, {_COUNT.format(c='normalized')} / {_COUNT.format(c='raw')}) + CASE WHEN length(normalized) > length(raw) * 0.8 THEN 0.1 ELSE 0.0 END), 6) AS norm_confidence FROM ({NORMAL_SQL})""",
)
def e8(t):
    out = text.normalize_addresses(t.addresses, "address_text")
    return out.select(
        "address_id", "normalized_address", "language", text.extract_pincode("normalized_address").alias("pincode"),
        F.round("norm_confidence", 6).alias("norm_confidence"),
    )


@query("e8_normalised_documents")
def e8_documents(t):
    out = text.normalize_addresses(t.documents, "text")
    return out.select("doc_id", "language", F.length("normalized_address").alias("n_chars"), F.round("norm_confidence", 6).alias("norm_confidence"))


_SCRIPTS = [(lang, f"[\\x{{{ord(a):04X}}}-\\x{{{ord(b):04X}}}]") for lang, a, b in lexicon.SCRIPT_RANGES] + [("en", "[a-zA-Z]")]
_LANG_COUNTS = ", ".join(f"len(regexp_extract_all(text, {_quote(p)})) AS n_{lang}" for lang, p in _SCRIPTS)
_LANG_MAX = "greatest(" + ", ".join(f"n_{lang}" for lang, _ in _SCRIPTS) + ")"


@query(
    "e5_document_language",
    f"""SELECT doc_id, CASE WHEN {_LANG_MAX} = 0 THEN NULL {" ".join(f"WHEN n_{lang} = {_LANG_MAX} THEN '{lang}'" for lang, _ in _SCRIPTS)} END AS language
 FROM (SELECT doc_id, {_LANG_COUNTS} FROM documents)""",
)
def e5(t):
    return t.documents.select("doc_id", text.detect_language("text").alias("language"))


def _matches(kind: str, pattern: str, value: str = "x") -> str:
    return f"list_transform(regexp_extract_all(n, {_quote(pattern)}, 1), lambda x: concat('{kind}=', {value}))"


_HOUSE = [p.replace("(?=\\s+", "(?:\\s+") for p in lexicon.HOUSE_NUMBER_PATTERNS]
_ENTITY_LISTS = (
    [_matches("HOUSE_NUMBER", p) for p in _HOUSE]
    + [_matches("BUILDING", p, "trim(x)") for p in lexicon.BUILDING_PATTERNS]
    + [
        _matches("CROSS", lexicon.CROSS_PATTERN, "x || ' cross'"),
        _matches("STREET", lexicon.ROAD_PATTERN, "trim(x) || ' road'"),
        "CASE WHEN contains(n, 'main road') THEN ['STREET=main road'] WHEN contains(n, 'main cross') THEN ['STREET=main cross'] ELSE [] END",
        "list_transform(list_filter(["
        + ", ".join(f"['{k}', '{' '.join(w.capitalize() for w in v.split())}']" for k, v in lexicon.STATE_CODES.items())
        + "], lambda s: contains(' ' || n || ' ', ' ' || s[1] || ' ')), lambda s: 'STATE=' || s[2])",
    ]
    + [
        f"list_transform(regexp_extract_all(n, '([a-z\\s]+?)\\s+{s}\\b', 1), lambda x: 'LOCALITY=' || list_aggregate(list_transform(string_split(trim(x) || ' {s}', ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' '))"
        for s in lexicon.LOCALITY_SUFFIXES
    ]
    + [
        "list_filter([" + ", ".join(f"CASE WHEN contains(' ' || n || ' ', ' {w} ') THEN 'DIRECTION={w}' END" for w in sorted(lexicon.DIRECTION_WORDS)) + "], lambda x: x IS NOT NULL)"
    ]
)


@query(
    "e11_e16_address_entities",
    f"SELECT address_id, list_aggregate(flatten([{', '.join(_ENTITY_LISTS)}]), 'string_agg', '|') AS entities FROM (SELECT address_id, normalized AS n FROM ({NORMAL_SQL}))",
)
def e11(t):
    out = entities.extract_entities(t.addresses, "address_text")
    listed = F.transform("entities", lambda e: F.concat(e["entity_type"], F.lit("="), e["value"]))
    return out.select("address_id", F.array_join(listed, "|").alias("entities"))


@query("e9_e17_relations_landmark_confidence")
def e9(t):
    out = entities.extract_entities(t.addresses, "address_text")
    rels = F.transform("relations", lambda r: F.concat_ws(" ", r["before"], r["relation"], r["after"]))
    return out.select(
        "address_id", F.array_join(rels, "|").alias("relations"), "landmark", "pincode", "locality", "state",
        F.round("confidence", 6).alias("confidence"),
    )


@query(
    "e18_e23_parsed_addresses",
    """SELECT a.address_id, t.locality_id, t.pincode, CAST(a.address_id % 9 + 1 AS DOUBLE) AS s1, CAST(a.address_id % 7 + 1 AS DOUBLE) AS s2, 1.0::DOUBLE AS locality_score,
 CASE a.address_id % 6 WHEN 0 THEN 'ganesha_temple' WHEN 1 THEN 'govt_school' WHEN 2 THEN 'masjid' WHEN 3 THEN 'ration_shop' WHEN 4 THEN 'post_office' END AS landmark_type,
 CASE a.address_id % 6 WHEN 0 THEN 'opposite' WHEN 1 THEN 'behind' ELSE 'near' END AS relation FROM v_addresses a JOIN v_truth t ON t.address_id = a.address_id""",
)
def e18(t):
    return parsed(t).select("address_id", "locality_id", "pincode", "s1", "s2", "locality_score", "landmark_type", "relation")


def parsed(t):
    return gazetteer.parse_addresses(t.addresses, t.localities, t.towns)


@query(
    "e24_remark_corrections",
    f"SELECT conv_id, turn, nullif(trim(regexp_extract(text, {_quote('(?i)' + lexicon.REMARK_PATTERN)}, 0)), '') AS correction FROM conversations",
)
def e24(t):
    return t.conversations.select("conv_id", "turn", text.remark_correction("text").alias("correction"))


@query("e26_field_directions")
def e26(t):
    out = entities.extract_entities(t.addresses, "address_text")
    steps = narrative.direction_steps("entities", "landmark", "locality", F.lit(True))
    return out.select("address_id", narrative.directions_text(steps).alias("directions"), F.size(steps).alias("n_steps"))


@query("ef_fuzzy_ratios")
def ef(t):
    a, b = F.lower("p_name"), F.lower("p_type")
    out = t.part.select(
        "p_partkey", fuzzy.ratio_col(a, b).alias("ratio"), fuzzy.partial_ratio_col(a, b).alias("partial_ratio"),
        fuzzy.token_set_ratio_col(a, b).alias("token_set_ratio"),
    )
    return rounded(out)
