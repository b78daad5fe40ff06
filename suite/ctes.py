"""The views of `suite.views` in SQL, and the steps several queries share."""

from __future__ import annotations

from collections.abc import Sequence

from folioscope.fixed_values import PDF_PAGE
from suite import params as P


def words(names: Sequence[str], text: str, join: str = " OR ") -> str:
    return "(" + join.join(f"contains({text}, '{w}')" for w in names) + ")"


def _bonus(cues: Sequence[str], band: tuple[int, int], text: str) -> str:
    hits = " + ".join(f"CAST(contains(lower({text}), '{c}') AS INTEGER)" for c in cues)
    return (
        f"least(20, 3 * ({hits}) + CASE WHEN length(lower({text})) "
        f"BETWEEN {band[0]} AND {band[1]} THEN 5 ELSE 0 END)"
    )


def bonus(text: str, language: str = "language") -> str:
    return (
        f"CASE WHEN {language} = 'de' THEN {_bonus(P.CUES_DE, P.BAND_DE, text)} "
        f"ELSE {_bonus(P.CUES, P.BAND, text)} END"
    )


SPACE = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


HAYSTACK = "lower(title || ' ' || summary)"
ON_TOPIC = f"NOT {words(P.EXCLUSIONS, HAYSTACK)}"
ANY_KEYWORD = words(P.KEYWORDS, HAYSTACK)
RECENT = (
    f"published >= TIMESTAMP '{P.AS_OF:%Y-%m-%d %H:%M:%S}' - INTERVAL {P.DAYS} DAY"
)
BEST_FIRST = "coalesce(final_score, 0) DESC, published DESC, id"

CTES = {
    "papers": rf"""
        SELECT CAST(doc_id AS VARCHAR) AS id,
               split_part(text, chr(10), 1) AS title,
               text AS summary,
               '{PDF_PAGE}' || doc_id AS pdf_url,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id * 7919) % 43200)
                 AS published,
               [source] AS authors, [source, lang] AS categories, lang, source, n_chars
        FROM documents""",
    "labelled": rf"""
        SELECT * EXCLUDE (de, es, fr),
               CASE WHEN greatest(de, es, fr) > 0
                     AND greatest(de, es, fr) >= length(summary) * {P.FLOOR}::DOUBLE
                    THEN CASE greatest(de, es, fr)
                           WHEN de THEN 'de' WHEN es THEN 'es' ELSE 'fr' END
                    ELSE 'en' END AS language
        FROM (SELECT *,
                length(regexp_replace(summary, '[^{P.LANGUAGES[0].letters}]', '', 'g')) AS de,
                length(regexp_replace(summary, '[^{P.LANGUAGES[1].letters}]', '', 'g')) AS es,
                length(regexp_replace(summary, '[^{P.LANGUAGES[2].letters}]', '', 'g')) AS fr
              FROM papers)""",
    "sentences": rf"""
        SELECT id, language, pos, list[pos] AS sentence
        FROM (SELECT id, language, list, unnest(range(1, len(list) + 1)) AS pos
              FROM (SELECT id, language,
                      list_filter(list_transform(
                        regexp_split_to_array(summary, '[.!?\x{{3002}}\x{{FF01}}\x{{FF1F}}\n]+'),
                        lambda s: {strip('s')}), lambda s: s <> '') AS list
                    FROM labelled))""",
    "insights": rf"""
        SELECT l.*, coalesce(k.sentence, '') AS breakthrough,
               coalesce(k.tenths, 0) / 10.0::DOUBLE AS insight_bonus
        FROM labelled l LEFT JOIN (
          SELECT id, sentence, tenths FROM (
            SELECT id, sentence, tenths,
                   row_number() OVER (PARTITION BY id ORDER BY tenths DESC, pos) AS n
            FROM (SELECT id, pos, sentence, {bonus('sentence')} AS tenths FROM sentences))
          WHERE n = 1) k USING (id)""",
    "responses": r"""
        SELECT id, CASE WHEN lang = 'de' THEN '```json' || chr(10) || shaped || chr(10) || '```' || chr(10)
                        WHEN source = 'src11' THEN '```' || chr(10) || shaped || chr(10) || '```'
                        ELSE '  ' || shaped END AS response
        FROM (SELECT id, lang, source,
                CASE source WHEN 'src17' THEN left(body, length(body) - 5)
                            WHEN 'src13' THEN body || ' Hope this helps.'
                            ELSE body END AS shaped
              FROM (SELECT id, lang, source,
                      '{"innovation": ' || (1 + n_chars % 7) || ', "rigor": ' || (1 + n_chars % 9)
                      || CASE WHEN lang <> 'es' THEN ', "impact": ' || (1 + n_chars % 10) ELSE '' END
                      || ', "total_score": 9.5}' AS body
                    FROM papers))""",
    "cleaned": rf"""
        SELECT id, {strip('b')} AS content
        FROM (SELECT id, CASE WHEN ends_with(a, '```') THEN left(a, length(a) - 3) ELSE a END AS b
              FROM (SELECT id, CASE WHEN starts_with(s, '```json') THEN substr(s, 8) ELSE s END AS a
                    FROM (SELECT id, {strip('response')} AS s FROM responses)))""",
    "parsed": r"""
        SELECT id, content, ok,
               CASE WHEN ok THEN CAST(json_extract(content, '$.innovation') AS DOUBLE) END AS innovation,
               CASE WHEN ok THEN CAST(json_extract(content, '$.rigor') AS DOUBLE) END AS rigor,
               CASE WHEN ok THEN CAST(json_extract(content, '$.impact') AS DOUBLE) END AS impact
        FROM (SELECT id, content, json_valid(content) AS ok FROM cleaned)""",
    "rated": r"""
        SELECT id, coalesce(innovation, 0) AS innovation, coalesce(rigor, 0) AS rigor,
               coalesce(impact, 0) AS impact,
               round((coalesce(innovation, 0) + coalesce(rigor, 0) + coalesce(impact, 0)) / 3, 2)
                 AS total_score,
               CASE WHEN ok THEN 'ok' ELSE 'invalid' END AS parse_status
        FROM parsed""",
    "scored": r"""
        SELECT i.*, r.* EXCLUDE (id), round(total_score + insight_bonus, 2) AS final_score
        FROM insights i JOIN rated r USING (id)""",
    "candidates": rf"""
        SELECT * FROM scored WHERE {RECENT} AND {ON_TOPIC} AND {ANY_KEYWORD}""",
    "best": rf"""
        SELECT *, CAST(row_number() OVER (ORDER BY {BEST_FIRST}) AS INTEGER) AS rank
        FROM candidates QUALIFY rank <= {P.TOP_K}""",
    "store": r"""
        SELECT CAST(doc_id AS VARCHAR) AS paper_id,
               (3 + 4 * quality)::DOUBLE AS innovation, 5.0::DOUBLE AS rigor,
               (8 - 3 * toxic)::DOUBLE AS impact,
               round((3 + 4 * quality + 5.0::DOUBLE + 8 - 3 * toxic) / 3, 2) AS total_score,
               '' AS raw_response, CASE WHEN quality = 1 THEN 'done' END AS translation
        FROM labels""",
    "authored": r"""
        SELECT id, pos, name FROM (
          SELECT id, CAST(pos - 1 AS INTEGER) AS pos, names[pos] AS name FROM (
            SELECT *, unnest(range(1, 4)) AS pos FROM (
              SELECT CAST(event_id AS VARCHAR) AS id,
                     ['Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0'),
                      CASE event_type WHEN 'error' THEN 'Unknown' WHEN 'signup' THEN ''
                           ELSE 'Customer#' || lpad(CAST(user_id + 1 AS VARCHAR), 9, '0') END,
                      'Customer#' || lpad(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 9, '0')
                     ] AS names
              FROM events)))
        WHERE name <> '' AND name <> 'Unknown'""",
    "flat": r"""
        SELECT c_name AS name, CASE WHEN c_nationkey >= 3 THEN c_nationkey + 1 END AS h_index,
               CAST(floor(c_acctbal / 10) AS INTEGER) AS paper_count,
               CAST(floor(c_acctbal) AS INTEGER) AS citation_count,
               n_name AS affiliation, 'semantic_scholar' AS source_used
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 3000""",
    "nested": r"""
        SELECT c_name AS name, n_regionkey * 10 + 5 AS h_index,
               CAST(c_custkey + 7 AS INTEGER) AS paper_count,
               CAST(c_custkey * 3 AS INTEGER) AS citation_count,
               n_name AS affiliation, 'openalex' AS source_used
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE n_regionkey BETWEEN 1 AND 3""",
    "resolved": r"""
        SELECT n.name,
               CASE WHEN f.name IS NOT NULL THEN f.h_index ELSE e.h_index END AS h_index,
               CASE WHEN f.name IS NOT NULL THEN f.paper_count ELSE e.paper_count END AS paper_count,
               CASE WHEN f.name IS NOT NULL THEN f.citation_count ELSE e.citation_count END
                 AS citation_count,
               coalesce(f.affiliation, e.affiliation, '') AS affiliations,
               coalesce(f.source_used, e.source_used, 'none') AS source_used
        FROM (SELECT DISTINCT name FROM authored) n
        LEFT JOIN flat f USING (name) LEFT JOIN nested e USING (name)""",
}

_NEEDS = {
    "labelled": ["papers"],
    "sentences": ["labelled"],
    "insights": ["sentences"],
    "responses": ["papers"],
    "cleaned": ["responses"],
    "parsed": ["cleaned"],
    "rated": ["parsed"],
    "scored": ["insights", "rated"],
    "candidates": ["scored"],
    "best": ["candidates"],
    "resolved": ["authored", "flat", "nested"],
}


def sql(select: str, *views: str) -> str:
    """`select` with the named views, and the views those need, as WITH clauses."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    if not ordered:
        return select
    clauses = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    return f"WITH {clauses}\n{select}"
