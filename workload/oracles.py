"""SQL (DuckDB) for the registered queries, from the fixture formulas.

The expected rows come straight from the tables: no JSON is built or parsed.
"""

from __future__ import annotations

from voxlake.operators.dashboard import RESULT_COLUMNS
from voxlake.schemas import SENTIMENTS
from voxlake.sources import datasets
from workload import queries as q

# --- pieces ------------------------------------------------------------------------

_WS = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{_WS}+', ''), '{_WS}+$', '')"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values: list) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_PCT = "{n}::DOUBLE / {total}::DOUBLE * 100"

DIRTY = f"""
dirty AS (
  SELECT doc_id,
    CASE WHEN doc_id % 17 = 3 THEN '' WHEN doc_id % 17 = 5 THEN 'nan'
         WHEN doc_id % 17 = 7 THEN NULL
         WHEN doc_id % 17 = 9 THEN chr(160) || chr(9) || text || chr(12288)
         WHEN doc_id % 17 = 11 THEN '   ' ELSE text END AS text,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN '  web ' ELSE source END AS source,
    CASE WHEN doc_id % 13 <> 0 THEN lang END AS lang
  FROM documents),
clean AS (
  SELECT doc_id AS row_idx, 'documents_' || doc_id AS id, {_strip('text')} AS text,
    coalesce({_strip('source')}, 'documents') AS source, coalesce({_strip('lang')}, 'fr') AS lang
  FROM dirty),
kept AS (SELECT * FROM clean WHERE text IS NOT NULL AND text NOT IN ('', 'nan'))
"""

def _summary(text: str) -> str:
    plain = f"regexp_replace({text}, '[ \\t\\n\\r]+', ' ', 'g')"
    return (
        f"CASE WHEN length({plain}) <= 60 THEN {plain} "
        f"ELSE left({plain}, 60) || ' ' || length({plain}) || ' ' || md5({plain}) END"
    )


IDEAL = f"""
ideal AS (
  SELECT d.doc_id, d.doc_id // 10 AS batch_idx, d.doc_id % 10 AS p, 'doc_' || d.doc_id AS id,
    d.text, d.source, d.lang,
    CASE WHEN l.toxic = 1 THEN 'négatif' WHEN l.quality = 1 THEN 'positif' ELSE 'neutre' END AS sentiment,
    'theme ' || d.lang || ' ' || (d.doc_id % 23) AS theme,
    {_summary('d.text')} AS summary,
    CASE WHEN d.doc_id % 29 = 4 THEN 'missing' WHEN d.doc_id % 31 = 6 THEN 'dup'
         WHEN d.doc_id % 37 = 8 THEN 'ghost' WHEN d.doc_id % 41 = 10 THEN 'long'
         WHEN d.doc_id % 43 = 12 THEN 'blank' WHEN d.doc_id % 47 = 14 THEN 'short'
         ELSE 'ok' END AS fault
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""

ATTEMPTS = """
attempts AS (
  SELECT batch_idx, a::INTEGER AS attempt,
    CASE WHEN batch_idx % 13 = 9 THEN ['none', 'prose', 'bad_sentiment'][a + 1]
         WHEN batch_idx % 11 = 5 AND a = 0 THEN 'bad_sentiment'
         WHEN batch_idx % 7 = 1 AND a = 0 THEN 'none'
         WHEN batch_idx % 7 = 2 AND a = 0 THEN 'prose'
         WHEN batch_idx % 7 = 2 THEN 'fenced'
         WHEN batch_idx % 7 = 3 THEN 'wrapped'
         WHEN batch_idx % 7 = 4 AND a = 0 THEN 'two_objects'
         ELSE 'plain' END AS made
  FROM (SELECT DISTINCT doc_id // 10 AS batch_idx FROM documents), range(3) r(a)),
first_ok AS (
  SELECT batch_idx, min(attempt) AS attempt FROM attempts
  WHERE made IN ('plain', 'fenced', 'wrapped') GROUP BY batch_idx)
"""

ITEMS = f"""
returned AS (
  SELECT batch_idx, doc_id, source, text,
    row_number() OVER (PARTITION BY batch_idx ORDER BY p, copy) - 1 AS pos, copy,
    CASE WHEN fault = 'ghost' THEN 'ghost_' || doc_id ELSE id END AS verbatim_id,
    CASE fault WHEN 'long' THEN 'a b c d e f' WHEN 'blank' THEN '  ' ELSE theme END AS theme,
    CASE WHEN fault = 'short' THEN ' ok ' ELSE summary END AS summary,
    sentiment, fault
  FROM ideal, range(2) c(copy)
  WHERE fault <> 'missing' AND (copy = 0 OR fault = 'dup')
    AND batch_idx IN (SELECT batch_idx FROM first_ok)),
judged AS (
  SELECT *, copy = 1 AS dup, fault = 'ghost' AS ghost, fault IN ('long', 'blank') AS bad_theme,
    length({_strip('summary')}) < 5 AS bad_summary
  FROM returned),
sizes AS (
  SELECT batch_idx, count(*) AS expected,
    count(*) FILTER (fault <> 'missing') + count(*) FILTER (fault = 'dup') AS got,
    count(*) FILTER (fault IN ('missing', 'ghost')) AS n_missing,
    string_agg(id, ',' ORDER BY id) FILTER (fault IN ('missing', 'ghost')) AS missing_ids
  FROM ideal GROUP BY batch_idx),
answered AS (SELECT * FROM sizes WHERE batch_idx IN (SELECT batch_idx FROM first_ok)),
failed AS (SELECT * FROM sizes WHERE batch_idx NOT IN (SELECT batch_idx FROM first_ok)),
tallies AS (
  SELECT batch_idx, true AS completed,
    (SELECT count(*) FROM judged j WHERE j.batch_idx = a.batch_idx
       AND NOT (dup OR ghost OR bad_theme OR bad_summary)) AS n_valid,
    (SELECT count(*) FROM judged j WHERE j.batch_idx = a.batch_idx
       AND (dup OR ghost OR bad_theme OR bad_summary))
      + (expected <> got)::INTEGER + (n_missing > 0)::INTEGER AS n_errors
  FROM answered a
  UNION ALL SELECT batch_idx, false, 0, 1 FROM failed)
"""

MAPPED = """
themes AS (
  SELECT theme, doc_n % 23 AS n FROM (
    SELECT theme, any_value(doc_id) AS doc_n FROM ideal GROUP BY theme)),
mapping AS (
  SELECT theme, CASE WHEN n = 22 THEN 'Hors liste' WHEN n % 4 = 0 THEN 'Produit'
      WHEN n % 4 = 1 THEN 'Service' WHEN n % 4 = 2 THEN 'Tarifs'
      WHEN theme = (SELECT min(theme) FROM themes WHERE n % 4 = 3 AND n <> 22) THEN 'Autre'
      ELSE 'Produit' END AS macro_theme
  FROM themes),
enriched AS (
  SELECT i.*, m.macro_theme FROM ideal i JOIN mapping m USING (theme)),
listed AS (
  SELECT * FROM (VALUES (0, 'Produit'), (1, 'Service'), (2, 'Tarifs'), (3, 'Vide')) c(category_pos, macro_theme)
  UNION ALL SELECT 4, 'Autre' WHERE EXISTS (SELECT 1 FROM mapping WHERE macro_theme = 'Autre')),
distribution AS (
  SELECT macro_theme, count(doc_id) AS total,
    count(*) FILTER (sentiment = 'positif') AS positif,
    count(*) FILTER (sentiment = 'négatif') AS negatif,
    count(*) FILTER (sentiment = 'neutre') AS neutre,
    min(category_pos) AS category_pos, min(doc_id) AS first_row
  FROM listed FULL JOIN enriched USING (macro_theme) GROUP BY macro_theme),
ranked AS (
  SELECT *, row_number() OVER (
    ORDER BY total DESC, category_pos NULLS LAST, first_row NULLS LAST) AS rank
  FROM distribution),
cells AS (
  SELECT rank, macro_theme, total, 0 AS ord, 'positif' AS sentiment, positif AS n FROM ranked
  UNION ALL SELECT rank, macro_theme, total, 1, 'négatif', negatif FROM ranked
  UNION ALL SELECT rank, macro_theme, total, 2, 'neutre', neutre FROM ranked)
"""

_DOMAIN = "(VALUES ('positif'), ('négatif'), ('neutre')) s(sentiment)"
_OK_ITEM = "NOT (dup OR ghost OR bad_theme OR bad_summary)"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_ANSWERED = _with(IDEAL, ATTEMPTS, ITEMS)
_THEMED = _with(IDEAL, MAPPED)
_SOURCES = f"source IN {_in(q.KPI_SOURCES)}"


def _counts_by(column: str) -> str:
    return f"""SELECT {column} AS key, count(*) AS n FROM documents
               WHERE {column} IS NOT NULL GROUP BY {column}"""


def _kpi() -> str:
    names = [("positif", "positif"), ("négatif", "negatif"), ("neutre", "neutre")]
    counts = ", ".join(f"count(*) FILTER (sentiment = '{s}') AS n_{c}" for s, c in names)
    shares = ", ".join(_PCT.format(n=f"n_{c}", total="nullif(total, 0)") + f" AS pct_{c}" for _, c in names)
    return f"""{_with(IDEAL)}, k AS (SELECT count(*) AS total, {counts} FROM ideal WHERE {_SOURCES})
               SELECT *, {shares} FROM k"""


def _search(term: str) -> str:
    return f"""{_THEMED}, rows AS (SELECT id AS verbatim_id, source, text AS texte_original,
          macro_theme, theme, sentiment, summary FROM enriched)
        SELECT * FROM rows WHERE contains(lower(verbatim_id), lower('{term}'))
          OR contains(lower(source), lower('{term}'))
          OR contains(lower(texte_original), lower('{term}'))
          OR contains(lower(macro_theme), lower('{term}'))
          OR contains(lower(theme), lower('{term}'))
          OR contains(lower(sentiment), lower('{term}'))
          OR contains(lower(summary), lower('{term}'))"""


def _report_lines() -> str:
    pct = _PCT.format(n="n", total="total")
    return f"""{_THEMED},
    whole AS (SELECT sum(total)::BIGINT AS total, sum(positif)::BIGINT AS a,
                     sum(negatif)::BIGINT AS b, sum(neutre)::BIGINT AS c FROM distribution),
    overall AS (SELECT 0 AS ord, 'positif' AS sentiment, a AS n, total FROM whole
      UNION ALL SELECT 1, 'négatif', b, total FROM whole
      UNION ALL SELECT 2, 'neutre', c, total FROM whole),
    lines AS (
      SELECT 0 AS block, 0 AS sub, 'Total verbatims analysés : ' || total AS line FROM whole
      UNION ALL SELECT 0, ord + 1, '  ' || rpad(sentiment, 10, ' ') || ' : '
        || printf('%5.1f', {pct}) || '% (' || printf('%3d', n) || ')  '
        || repeat('█', floor({pct} / 5)::BIGINT) FROM overall
      UNION ALL SELECT rank, 0, rpad(macro_theme, greatest(30, length(macro_theme))::INTEGER, ' ')
        || ' | Total: ' || printf('%3d', total) || ' ('
        || printf('%5.1f', {_PCT.format(n='total', total='(SELECT total FROM whole)')}) || '%)' FROM ranked
      UNION ALL SELECT rank, ord + 1, '    - ' || rpad(sentiment, 10, ' ') || ' : '
        || printf('%5.1f', {pct}) || '% (' || printf('%2d', n) || ') '
        || repeat('░', floor({pct} / 10)::BIGINT) FROM cells WHERE n > 0)
    SELECT (row_number() OVER (ORDER BY block, sub))::INTEGER AS line_no, line FROM lines"""


def _synthetic(cut: bool = True) -> str:
    def draw(what: str, n: int) -> str:
        return f"(('0x' || substr(md5('7/{what}/' || id), 1, 8))::BIGINT % {n} + 1)"

    def choose(values: list, what: str) -> str:
        return f"({_list(values)})[{draw(what, len(values))}]"

    source = choose(datasets.SOURCES, "source")
    parts = []
    for prefix, lang, share in datasets.PARTS:
        text = (
            f"replace(replace({choose(datasets.TEMPLATES[prefix], 'template')}, '{{frais}}', "
            f"{choose(datasets.FEES, 'fee')}), '{{attente}}', {choose(datasets.WAITS, 'wait')})"
        )
        lang_sql = f"'{lang}'"
        if prefix == "be":
            text = f"CASE WHEN i % 3 = 0 THEN {choose(datasets.FLEMISH, 'flemish')} ELSE {text} END"
            lang_sql = "CASE WHEN i % 3 = 0 THEN 'nl' ELSE 'fr' END"
        parts.append(f"""SELECT id, {text} AS text, {source} AS source, {lang_sql} AS lang FROM (
            SELECT i, 'bank_{prefix}_' || i AS id FROM range((SELECT n * {share} // 100 FROM size)) r(i))""")
    return f"""WITH english AS (
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, text FROM documents WHERE lang = 'en'),
      size AS (SELECT count(*) AS n FROM english),
      everything AS (
        SELECT id, text, {source} AS source, 'en' AS lang FROM (SELECT 'bank_en_' || i AS id, text FROM english)
        UNION ALL {' UNION ALL '.join(parts)}),
      shuffled AS (
        SELECT *, row_number() OVER (ORDER BY md5('7/order/' || id), id) AS place FROM everything)
      SELECT id, text, source, lang FROM shuffled
      WHERE place <= (SELECT 4 * n FROM size) OR {not cut}"""


def _files() -> str:
    """Rows of the CSV files in file order, with the place in all and in their file."""
    return """
    files AS (
      SELECT *, row_number() OVER (PARTITION BY file, doc_id // 250 ORDER BY doc_id) - 1 AS row,
        row_number() OVER (ORDER BY file, doc_id) - 1 AS row_idx
      FROM (SELECT doc_id, 'said "' || text || '",' AS text, lang, source,
              ['avis été', 'b+c', 'd'][doc_id % 3 + 1] AS file FROM documents))"""


_ATTEMPT_KIND = """CASE made WHEN 'none' THEN 'no_answer' WHEN 'prose' THEN 'bad_json'
    WHEN 'two_objects' THEN 'bad_json' WHEN 'bad_sentiment' THEN 'bad_schema' END"""

# --- the queries -------------------------------------------------------------------

ORACLES: dict[str, str] = {
    "sentiment_by_source": f"""{_ANSWERED}
        SELECT {_strip('source')} AS source, count(*) AS total,
          count(*) FILTER (sentiment = 'positif') AS positif,
          count(*) FILTER (sentiment = 'négatif') AS negatif,
          count(*) FILTER (sentiment = 'neutre') AS neutre
        FROM judged WHERE {_OK_ITEM} GROUP BY 1""",
    "normalize_verbatims": f"{_with(DIRTY)} SELECT * FROM kept",
    "detect_columns": """
        SELECT 'text' AS role, 'text' AS column_name, count(text) AS n_values FROM documents
        UNION ALL SELECT 'id', NULL, 0
        UNION ALL SELECT 'source', 'source', count(source) FROM documents
        UNION ALL SELECT 'lang', 'lang', count(lang) FROM documents
        UNION ALL SELECT 'upload_text', 'text', count(text) FROM documents
        UNION ALL SELECT 'upload_id', NULL, 0""",
    "row_limit": f"""{_with(DIRTY)} SELECT id FROM kept
        WHERE row_idx < (SELECT count(*) // 2 FROM documents)""",
    "ingest_counts": f"""{_with(DIRTY)} SELECT (SELECT count(*) FROM dirty) AS rows_read,
        (SELECT count(*) FROM kept) AS rows_kept""",
    "raw_metadata_latest": """
        SELECT 'doc_' || doc_id AS id,
          CASE WHEN doc_id % 3 = 0 THEN 'v2 ' || text ELSE text END AS text, source
        FROM documents WHERE doc_id % 19 <> 1""",
    "normalize_dataset": """
        SELECT 'conv_' || (row_number() OVER (ORDER BY conv_id, turn) - 1) AS id, text,
          'conversations' AS source, 'en' AS lang FROM conversations""",
    "longest_text_column": """
        WITH m AS (
          SELECT 0 AS i, 'page_id' AS column_name, avg(length(coalesce(page_id::VARCHAR, 'nan'))) AS mean_len FROM pages
          UNION ALL SELECT 1, 'url', avg(length(coalesce(url, 'nan'))) FROM pages
          UNION ALL SELECT 2, 'html', avg(length(coalesce(html, 'nan'))) FROM pages)
        SELECT column_name, mean_len FROM m ORDER BY mean_len DESC, i LIMIT 1""",
    "synthetic_reviews": _synthetic(),
    "value_counts_lang": _counts_by("lang"),
    "value_counts_source": _counts_by("source"),
    "batch_assign": f"""{_with(DIRTY)}, placed AS (
          SELECT id, row_number() OVER (ORDER BY row_idx) - 1 AS place FROM kept)
        SELECT id, place // 10 AS batch_idx, (place % 10)::INTEGER AS pos_in_batch FROM placed""",
    "batch_prompts": f"""
        SELECT doc_id // 10 AS batch_idx, count(*)::INTEGER AS n_items,
          string_agg('[doc_' || doc_id || '] ' || {_strip('text')}, chr(10) ORDER BY doc_id) AS lines
        FROM documents GROUP BY 1""",
    "infer_batches": f"""
        SELECT doc_id // 10 AS batch_idx, 0 AS attempt,
          (sum(length('[doc_' || doc_id || '] ' || {_strip('text')}) + 1))::VARCHAR AS raw
        FROM documents GROUP BY 1""",
    "first_valid_attempt": f"{_with(ATTEMPTS)} SELECT batch_idx, attempt FROM first_ok",
    "attempt_errors": f"""{_with(IDEAL, ATTEMPTS)}, bad AS (
          SELECT batch_idx, attempt, made, {_ATTEMPT_KIND} AS kind FROM attempts)
        SELECT batch_idx, attempt, kind, CASE kind
            WHEN 'no_answer' THEN 'Pas de réponse de l''API'
            WHEN 'bad_schema' THEN 'Validation du schéma: réponse non conforme (analyses[0].sentiment)'
            ELSE 'JSON invalide: ' || CASE made WHEN 'prose' THEN 'Je ne peux pas répondre.'
              ELSE left(j.raw, 200) END END AS last_error
        FROM bad LEFT JOIN (
          SELECT batch_idx, '{{"analyses":[' || string_agg(
              '{{"verbatim_id":"' || CASE WHEN fault = 'ghost' THEN 'ghost_' || doc_id ELSE id END
              || '","theme":"' || CASE fault WHEN 'long' THEN 'a b c d e f' WHEN 'blank' THEN '  ' ELSE theme END
              || '","summary":' || to_json(CASE WHEN fault = 'short' THEN ' ok ' ELSE summary END)
              || ',"sentiment":"' || sentiment || '"}}', ',' ORDER BY p) || ']}}' AS raw
          FROM ideal, range(2) c(copy)
          WHERE fault <> 'missing' AND (copy = 0 OR fault = 'dup') GROUP BY batch_idx
        ) j USING (batch_idx)
        WHERE kind IS NOT NULL""",
    "extract_json": f"""{_with(ATTEMPTS)} SELECT batch_idx, attempt,
          made IN ('plain', 'fenced', 'wrapped', 'bad_sentiment') AS ok FROM attempts""",
    "flatten_analyses": f"""{_ANSWERED}
        SELECT batch_idx, pos, verbatim_id, theme, summary, sentiment FROM returned""",
    "count_mismatch": f"""{_ANSWERED} SELECT batch_idx, expected::INTEGER AS expected,
          got::INTEGER AS got FROM answered WHERE expected <> got""",
    "duplicate_ids": f"{_ANSWERED} SELECT batch_idx, pos, verbatim_id FROM judged WHERE dup",
    "unknown_ids": f"{_ANSWERED} SELECT batch_idx, pos, verbatim_id FROM judged WHERE ghost",
    "theme_issues": f"""{_ANSWERED} SELECT batch_idx, pos, CASE fault WHEN 'blank' THEN 'Thème vide'
          ELSE 'Thème trop long (6 mots): ''a b c d e f''' END AS issue FROM judged WHERE bad_theme""",
    "summary_issues": f"""{_ANSWERED} SELECT batch_idx, pos,
          'Résumé trop court: ''' || summary || '''' AS issue FROM judged WHERE bad_summary""",
    "item_errors": f"""{_ANSWERED}, n AS (SELECT batch_idx, pos, dup::INTEGER + ghost::INTEGER
          + bad_theme::INTEGER + bad_summary::INTEGER AS n_issues FROM judged)
        SELECT batch_idx, pos, n_issues FROM n WHERE n_issues > 0""",
    "valid_analyses": f"""{_ANSWERED} SELECT verbatim_id, theme, summary, sentiment,
          text AS texte_original, source FROM judged WHERE {_OK_ITEM}""",
    "missing_verbatims": f"""{_ANSWERED} SELECT batch_idx, n_missing::INTEGER AS n_missing, missing_ids
        FROM answered WHERE n_missing > 0""",
    "batch_failures": f"""{_ANSWERED} SELECT batch_idx, 'batch_failure' AS type,
          expected::INTEGER AS n_items,
          'Échec après 3 tentatives: Validation du schéma: réponse non conforme (analyses[0].sentiment)' AS error
        FROM failed""",
    "errors_by_type": f"""{_ANSWERED}, e AS (
          SELECT 'count_mismatch' AS type FROM answered WHERE expected <> got
          UNION ALL SELECT 'missing_verbatims' FROM answered WHERE n_missing > 0
          UNION ALL SELECT 'item_validation' FROM judged WHERE NOT ({_OK_ITEM})
          UNION ALL SELECT 'batch_failure' FROM failed)
        SELECT type, count(*) AS n FROM e GROUP BY type""",
    "batch_progress": f"""{_ANSWERED} SELECT batch_idx, batch_idx + 1 AS batch_no,
          (SELECT count(*) FROM sizes) AS total_batches,
          sum(n_valid) OVER (ORDER BY batch_idx)::BIGINT AS cum_valid,
          sum(n_errors) OVER (ORDER BY batch_idx)::BIGINT AS cum_errors FROM tallies""",
    "run_summary": f"""{_ANSWERED} SELECT sum(n_valid)::BIGINT AS valid, sum(n_errors)::BIGINT AS errors,
          count(*) FILTER (completed) AS completed, count(*) AS total FROM tallies""",
    "analysis_run": f"""{_ANSWERED} SELECT verbatim_id, theme, summary, sentiment,
          {_strip('text')} AS texte_original, {_strip('source')} AS source FROM judged WHERE {_OK_ITEM}""",
    "resume_pending": f"""{_with(ATTEMPTS)} SELECT DISTINCT batch_idx FROM attempts
        WHERE batch_idx NOT IN (SELECT batch_idx FROM first_ok)""",
    "list_runs": "SELECT DISTINCT 'run_' || lang AS run_id FROM documents",
    "unique_themes": f"{_with(IDEAL)} SELECT DISTINCT theme FROM ideal",
    "theme_mapping": f"{_THEMED} SELECT theme, macro_theme FROM mapping",
    "theme_mapping_autre": f"""{_THEMED} SELECT theme,
          CASE WHEN n % 4 = 3 AND n <> 22 THEN 'Autre' ELSE macro_theme END AS macro_theme
        FROM mapping JOIN themes USING (theme)""",
    "apply_mapping": f"{_THEMED} SELECT id AS verbatim_id, macro_theme FROM enriched",
    "global_sentiment": f"""{_with(IDEAL)} SELECT sentiment, count(doc_id) AS n
        FROM {_DOMAIN} LEFT JOIN ideal USING (sentiment) GROUP BY sentiment""",
    "theme_distribution": f"{_THEMED} SELECT macro_theme, total, positif, negatif, neutre FROM distribution",
    "theme_ranking": f"{_THEMED} SELECT rank::INTEGER AS rank, macro_theme, total FROM ranked",
    "sentiment_shares": f"""{_THEMED} SELECT macro_theme, sentiment, n,
          {_PCT.format(n='n', total='total')} AS pct FROM cells WHERE n > 0""",
    "category_shares": f"""{_THEMED} SELECT macro_theme, total,
          {_PCT.format(n='total', total='(SELECT sum(total) FROM distribution)')} AS pct FROM distribution""",
    "report_lines": _report_lines(),
    "report_document": f"""{_THEMED} SELECT 'results_run' AS source_file,
          sum(total)::BIGINT AS total_verbatims, sum(positif)::BIGINT AS positif,
          sum(negatif)::BIGINT AS negatif, sum(neutre)::BIGINT AS neutre,
          count(*)::INTEGER AS n_macro_themes,
          (sum(total) FILTER (macro_theme = 'Autre'))::BIGINT AS n_autre,
          (SELECT count(*) FROM mapping)::INTEGER AS n_mapped FROM distribution""",
    "backfill_metadata": """
        SELECT 'doc_' || doc_id AS verbatim_id,
          CASE WHEN doc_id % 5 NOT IN (0, 1) THEN text
               WHEN doc_id % 19 = 1 THEN '(Texte original introuvable)'
               WHEN doc_id % 3 = 0 THEN 'v2 ' || text ELSE text END AS texte_original,
          CASE WHEN doc_id % 7 IN (0, 1) AND doc_id % 19 = 1 THEN 'inconnue' ELSE source END AS source
        FROM documents""",
    "distinct_sources": "SELECT DISTINCT source FROM documents",
    "source_kpis": _kpi(),
    "sentiment_split": f"""{_with(IDEAL)} SELECT sentiment, count(doc_id) AS n
        FROM {_DOMAIN} LEFT JOIN (SELECT * FROM ideal WHERE {_SOURCES}) USING (sentiment)
        GROUP BY sentiment""",
    "theme_sentiment_counts": f"""{_THEMED} SELECT macro_theme, sentiment, count(*) AS n
        FROM enriched WHERE {_SOURCES} GROUP BY macro_theme, sentiment""",
    "explorer_filter": f"""{_THEMED} SELECT id AS verbatim_id, source, text AS texte_original,
          macro_theme, theme, sentiment, summary FROM enriched
        WHERE source IN {_in(q.EXPLORER['sources'])} AND macro_theme IN {_in(q.EXPLORER['macro_themes'])}
          AND sentiment IN {_in(q.EXPLORER['sentiments'])}""",
    "text_search": _search(q.SEARCH_TERM),
    "text_search_indexed": _search(q.INDEXED_TERM),
    "synthesis_inputs": f"""{_THEMED}, placed AS (
          SELECT *, (row_number() OVER (PARTITION BY macro_theme ORDER BY doc_id) - 1)
            // {q.LINES_PER_CALL} AS chunk FROM enriched)
        SELECT d.macro_theme AS category, coalesce(chunk, 0) AS chunk, count(doc_id) AS n,
          coalesce(string_agg('- [' || sentiment || '] ' || summary, chr(10) ORDER BY doc_id), '') AS lines
        FROM (SELECT macro_theme FROM distribution) d LEFT JOIN placed USING (macro_theme) GROUP BY 1, 2""",
    "synthesis_points": f"""{_THEMED}, placed AS (
          SELECT *, row_number() OVER (PARTITION BY macro_theme, sentiment ORDER BY doc_id) - 1 AS pos
          FROM enriched WHERE macro_theme <> 'Hors liste' AND sentiment <> 'neutre')
        SELECT macro_theme AS category,
          CASE sentiment WHEN 'positif' THEN 'positive' ELSE 'negative' END AS polarity,
          pos::INTEGER AS pos, summary AS point FROM placed WHERE pos < 2""",
    "enriched_results": f"""{_THEMED} SELECT id AS verbatim_id, theme, macro_theme, sentiment, source
        FROM enriched""",
    "stored_report": f"""{_THEMED} SELECT macro_theme AS category, total,
          CASE WHEN macro_theme = 'Hors liste' THEN NULL
               WHEN total = 0 THEN 'Aucun avis disponible pour cette catégorie.'
               ELSE macro_theme || ': bilan ' || total END AS global_synthesis,
          CASE WHEN macro_theme <> 'Hors liste' THEN least(positif, 2)::INTEGER END AS n_positive
        FROM distribution""",
    "streaming_sentiment": f"""
        WITH s AS (SELECT {_list(SENTIMENTS)}[doc_id % 3 + 1] AS sentiment,
            {_summary(_strip('text'))} AS summary FROM documents),
        ok AS (SELECT sentiment FROM s WHERE length({_strip('summary')}) >= 5)
        SELECT sentiment, count(ok.sentiment) AS n FROM {_DOMAIN} LEFT JOIN ok USING (sentiment)
        GROUP BY sentiment""",
    "streaming_replay": f"""
        WITH s AS (SELECT {_list(SENTIMENTS)}[doc_id % 3 + 1] AS sentiment,
            {_summary(_strip('text'))} AS summary FROM documents)
        SELECT sentiment, count(*) AS n, count(*) AS n_ids FROM s
        WHERE length({_strip('summary')}) >= 5 GROUP BY sentiment""",
    "theme_mapping_many": f"{_THEMED} SELECT theme, macro_theme FROM mapping",
    "csv_source": f"""{_with(_files())}
        SELECT row_idx, CASE file WHEN 'd' THEN doc_id::VARCHAR ELSE file || '_' || row_idx END AS id,
          {_strip('text')} AS text, CASE file WHEN 'd' THEN 'd' ELSE source END AS source,
          CASE file WHEN 'd' THEN 'fr' ELSE lang END AS lang, row_idx AS position FROM files""",
    "raw_metadata_files": f"""{_with(_files())}
        SELECT CASE file WHEN 'd' THEN doc_id::VARCHAR ELSE file || '_' || row END AS id, text,
          CASE file WHEN 'd' THEN 'd' ELSE source END AS source FROM files WHERE file <> 'b+c'
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1""",
    "jsonl_source": f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx,
          doc_id::VARCHAR AS id, 'said "' || {_strip('text || chr(34)')} || ',' AS text, source, lang,
          row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents""",
    "stored_errors": f"""{_ANSWERED}, e AS (
          SELECT 'count_mismatch' AS type, batch_idx FROM answered WHERE expected <> got
          UNION ALL SELECT 'missing_verbatims', batch_idx FROM answered WHERE n_missing > 0
          UNION ALL SELECT 'item_validation', batch_idx FROM judged WHERE NOT ({_OK_ITEM})
          UNION ALL SELECT 'batch_failure', batch_idx FROM failed)
        SELECT type, batch_idx, count(*) AS n FROM e GROUP BY type, batch_idx""",
    "resume_other_splits": f"""WITH p AS (
          SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, 'said "' || text || '",' AS t FROM documents)
        SELECT 'jsonl_' || i AS verbatim_id, length({_strip('t')}) || ' characters' AS summary,
          i // 10 AS batch_idx, i % 10 AS pos FROM p""",
    "sealed_answers": f"""WITH p AS (
          SELECT doc_id, {_summary(_strip('text'))} AS summary, row_number() OVER (ORDER BY doc_id) - 1 AS i
          FROM documents WHERE {_strip('text')} <> '')
        SELECT 'doc_' || doc_id AS verbatim_id, summary, i // 10 AS batch_idx, 1::BIGINT AS answers FROM p
        WHERE length({_strip('summary')}) >= 5""",
    "checkpoint_state": f"""{_ANSWERED} SELECT 'run' AS run_id, (SELECT count(*) FROM answered) AS completed_batches,
          (SELECT count(*) FROM sizes) AS total_batches, true AS recent""",
    "first_rows": f"""{_ANSWERED} SELECT batch_idx, pos, verbatim_id, summary FROM judged
        WHERE {_OK_ITEM} ORDER BY batch_idx, pos LIMIT 5""",
    "progress_events": f"""{_ANSWERED} SELECT row_number() OVER w AS handled, (SELECT count(*) FROM sizes) AS total,
          sum(n_valid) OVER w::BIGINT AS valid, sum(n_errors) OVER w::BIGINT AS errors,
          row_number() OVER w AS call FROM tallies WINDOW w AS (ORDER BY batch_idx)""",
    "run_id_format": "SELECT DISTINCT lang, true AS well_formed FROM documents",
    "empty_run": """SELECT count(*) AS rows_read, 0::BIGINT AS rows_kept, 0::BIGINT AS valid,
          0::BIGINT AS errors, 0::BIGINT AS completed, 0::BIGINT AS total, false AS quantified FROM documents""",
    "result_columns": f"""{_THEMED}, c AS (SELECT count(id) AS a, count(source) AS b, count(text) AS c,
          count(macro_theme) AS d, count(theme) AS e, count(summary) AS f, count(sentiment) AS g FROM enriched)
        SELECT unnest(range(7))::INTEGER AS place,
          unnest({_list(RESULT_COLUMNS)}) AS column_name, unnest([a, b, c, d, e, f, g]) AS n FROM c""",
    "preview_rows": f"""{_with(IDEAL)} SELECT id AS verbatim_id, text AS texte_original FROM ideal
        ORDER BY doc_id LIMIT 20""",
    "global_shares": f"""{_with(IDEAL)}, g AS (SELECT sentiment, count(doc_id) AS n
          FROM {_DOMAIN} LEFT JOIN ideal USING (sentiment) GROUP BY sentiment)
        SELECT sentiment, n, {_PCT.format(n='n', total='(SELECT sum(n) FROM g)')} AS pct FROM g""",
    "synthetic_reviews_all": _synthetic(cut=False),
}
