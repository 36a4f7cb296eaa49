"""The registered queries as SQL for DuckDB, written from the definitions, not from the plans.

Common table expressions state the data model once; each query names the ones it starts from.
"""

from __future__ import annotations

import re

from evalspark.plans.bindings import LABEL_ORDER, LINE_KEY, RUNS

KEYS = "run_id, artifact_hash, split"
NUMBER = r"\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*"
_RUN_LIST = ", ".join(f"'{r}'" for r in RUNS)
RUN_OF_CONV = f"([{_RUN_LIST}])[conv_id % 4 + 1]"


def h8(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 8))::BIGINT"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def split_of(identity: str) -> str:
    tenth = f"mod({h8(f'''concat('42:', {identity})''')}, 10)"
    return f"CASE WHEN {tenth} < 4 THEN 'train' WHEN {tenth} < 6 THEN 'dev' ELSE 'test' END"


def hash_prediction(name: str, number: str, identity: str, label: str) -> str:
    draw = f"mod({h8(f'''concat({name}, ':', {identity})''')}, 1000)"
    return f"CASE WHEN {draw} < least(950, 300 + 5 * mod({number}, 100)) THEN {label} ELSE 'wrong_' || {label} END"


def order_by_key(*identity: str) -> str:
    return "sha256(concat_ws(':', '42', " + ", ".join(identity) + "))"


CTES: dict[str, str] = {
    "examples": f"""
        SELECT d.lang AS run_id, d.doc_id AS id, d.text AS input, CAST(l.quality AS VARCHAR) AS label,
               d.source AS domain, {split_of('d.doc_id')} AS split
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "artifacts": f"""
        SELECT run_id, item_id + 1 AS iter, item_id // 5 + 1 AS batch,
               strftime(TIMESTAMP '2024-01-01' + to_minutes(item_id), '%Y-%m-%dT%H:%M:%S') AS ts,
               substr(sha256(text), 1, 16) AS artifact_hash, {h8('text')} AS number,
               nullif((item_id + 1) // 2, 0) AS parent, 'plan_' || item_id % 7 AS plan_id,
               'Change ' || item_id || ': ' || text AS rationale, text AS artifact,
               CASE WHEN item_id % 3 = 0 THEN 'Errors seen before ' || item_id END AS stage_a_summary
        FROM benchmark, (SELECT unnest([{_RUN_LIST}]) AS run_id)""",
    "texts": "SELECT DISTINCT run_id, artifact_hash, number, artifact FROM artifacts",
    "pairs": """
        SELECT t.run_id, t.artifact_hash, t.number, t.artifact, e.split, e.id, e.label
        FROM texts t JOIN examples e ON t.run_id = e.run_id""",
    "predictions": f"""
        SELECT {KEYS}, id, label, {hash_prediction('artifact_hash', 'number', 'id', 'label')} AS prediction FROM pairs""",
    "big": f"""
        SELECT 'lineitem' AS run_id, l_linestatus || ':' || l_linenumber AS artifact_hash, {split_of('l_orderkey')} AS split,
               l_orderkey AS id, l_returnflag AS label,
               CASE WHEN (7 * l_orderkey + 13 * l_linenumber) % 10 < 7 THEN l_returnflag
                    ELSE (['A', 'N', 'R'])[l_orderkey % 3 + 1] END AS prediction
        FROM lineitem""",
    "shapes": """
        SELECT conv_id, turn, role, text,
               'Here are the candidates.\n--- CANDIDATE ---\nplan_id: plan_' || conv_id % 7 || '\nrationale: ' || text
               || '\nIt helps.\n<PROMPT>\n' || text || '\nAnswer as ' || role || '.\n</PROMPT>\n'
               || '--- CANDIDATE ---\nplan_id: no_body\nrationale: nothing to show\n'
               || '--- CANDIDATE ---\nrationale: no plan for ' || role || '\n<PROMPT>' || role || ': ' || text || '</PROMPT>'
               AS whole
        FROM conversations""",
    "responses": f"""
        SELECT conv_id, turn, {RUN_OF_CONV} AS run_id, role,
               CASE turn % 4 WHEN 0 THEN whole WHEN 1 THEN '<think>' || text
                    WHEN 2 THEN '<Think>' || role || '</Think>\n' || whole
                    ELSE '--- CANDIDATE ---\nplan_id: open\n<PROMPT>\n' || text END AS text
        FROM shapes""",
    "blocks": """
        SELECT conv_id, turn, run_id, generate_subscripts(parts, 1) - 1 AS position, unnest(parts) AS part
        FROM (SELECT *, string_split(text, '--- CANDIDATE ---') AS parts FROM responses)""",
    "candidates": rf"""
        SELECT * FROM (
            SELECT conv_id, turn, run_id, position, conv_id * 100000000 + turn * 10000 + position AS candidate_id,
                   coalesce(nullif(regexp_extract(part, 'plan_id:\s*(\S+)', 1), ''), 'unknown') AS plan_id,
                   {strip(r"regexp_extract(part, '(?s)rationale:\s*(.+?)(?:<PROMPT>|$)', 1)")} AS rationale,
                   {strip(r"regexp_extract(part, '(?s)<PROMPT>(.*?)</PROMPT>', 1)")} AS artifact
            FROM blocks WHERE position > 0) WHERE artifact <> ''""",
    "selection_texts": f"""
        SELECT {RUN_OF_CONV} AS run_id, conv_id * 10 + turn AS selection_id,
               CASE turn % 5
                   WHEN 0 THEN 'I choose "iter=' || (conv_id % 40 + 1) || '" because: ' || role || ' said so.\nMore.'
                   WHEN 1 THEN 'merge=' || (conv_id % 40 + 1) || ',' || ((conv_id + turn) % 40 + 1) || '\nReason: both are good'
                   WHEN 2 THEN 'merge=' || (conv_id % 40 + 1) || ', ' || ((conv_id + turn) % 40 + 1) || ', 9999'
                   WHEN 3 THEN 'merge=' || ((conv_id + turn) % 40 + 1) || ' or iter=' || (conv_id % 40 + 1) || ' RATIONALE ' || text
                   ELSE 'No idea. ' || role END AS text
        FROM conversations""",
    "note_texts": """
        SELECT conv_id * 10 + turn AS note_id,
               '# Notebook\n\n## USER\n\n' || text || '\n### detail\n' || role || '\n\n## OBSERVATION\n\n' || text
               || '\n## USER\n  \n## USERS\nnot of the user\n## USER second\n- keep it short\n\n' || role AS text
        FROM conversations""",
    "note_lines": """
        SELECT note_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
        FROM (SELECT note_id, string_split(text, '\n') AS ls FROM note_texts)""",
}


def metric_ctes(name: str, source: str, keys: str = KEYS, order: dict[str, int] | None = None) -> dict[str, str]:
    """Kappa, macro-F1 and rho of a prediction table, row by row with window ranks."""
    if order is None:
        number = lambda c: f"CASE WHEN regexp_full_match({c}, '{NUMBER}') THEN CAST(trim({c}) AS DOUBLE) END"
    else:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in order.items())
        number = lambda c: f"CAST(CASE {c} {cases} ELSE 0 END AS DOUBLE)"
    rank = lambda c: (
        f"2 * rank() OVER (PARTITION BY {keys} ORDER BY {c}) + count(*) OVER (PARTITION BY {keys}, {c}) - 1"
        f" - (count(*) OVER (PARTITION BY {keys}) + 1)"
    )
    return {
        f"{name}_cells": f"SELECT {keys}, label, prediction, count(*) AS n FROM {source} GROUP BY ALL",
        f"{name}_classes": f"""
            SELECT {keys}, class, sum(r) AS r, sum(c) AS c, sum(t) AS t FROM (
                SELECT {keys}, label AS class, n AS r, 0 AS c, CASE WHEN label = prediction THEN n ELSE 0 END AS t FROM {name}_cells
                UNION ALL SELECT {keys}, prediction, 0, n, 0 FROM {name}_cells) GROUP BY ALL""",
        f"{name}_agree": f"""
            SELECT {keys}, CAST(sum(r) AS BIGINT) AS n, avg(CAST(2 * t AS DOUBLE) / CAST(r + c AS DOUBLE)) AS f1,
                   CASE WHEN sum(r) * sum(r) = sum(r * c) THEN 0.0
                        ELSE CAST(sum(r) * sum(t) - sum(r * c) AS DOUBLE) / CAST(sum(r) * sum(r) - sum(r * c) AS DOUBLE) END AS kappa
            FROM {name}_classes GROUP BY {keys}""",
        f"{name}_numbers": f"SELECT {keys}, {number('label')} AS x, {number('prediction')} AS y FROM {source}",
        f"{name}_rho": f"""
            SELECT {keys}, CASE WHEN bool_or(x IS NULL OR y IS NULL) THEN 0.0
                                WHEN sum(rx * rx) = 0 OR sum(ry * ry) = 0 THEN 0.0
                                ELSE CAST(sum(rx * ry) AS DOUBLE) / sqrt(CAST(sum(rx * rx) AS DOUBLE) * CAST(sum(ry * ry) AS DOUBLE)) END AS spearman
            FROM (SELECT {keys}, x, y, CAST({rank('x')} AS HUGEINT) AS rx, CAST({rank('y')} AS HUGEINT) AS ry FROM {name}_numbers)
            GROUP BY {keys}""",
        f"{name}_metrics": f"""
            SELECT {', '.join(f'a.{k.strip()} AS {k.strip()}' for k in keys.split(','))}, kappa, f1, spearman
            FROM {name}_agree a JOIN {name}_rho r ON {' AND '.join(f'a.{k.strip()} = r.{k.strip()}' for k in keys.split(','))}""",
    }


CTES.update(metric_ctes("chain", "predictions"))
CTES.update(metric_ctes("big", "big", order=LABEL_ORDER))

_M = ("kappa", "f1", "spearman")
_S = ("train", "dev", "test")
WIDE = ", ".join(f"{m}_{s}" for m in _M for s in _S)


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


def entries_sql(metrics: str) -> str:
    wide = ", ".join(f"max({m}) FILTER (split = '{s}') AS {m}_{s}" for m in _M for s in _S)
    return f"""
        SELECT a.*, {WIDE} FROM artifacts a JOIN (
            SELECT run_id, artifact_hash, {wide} FROM {metrics} GROUP BY ALL HAVING count(DISTINCT split) = 3) m
        ON a.run_id = m.run_id AND a.artifact_hash = m.artifact_hash"""


CTES.update(
    {
        "log": entries_sql("chain_metrics"),
        "best": "SELECT run_id, iter FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(kappa_dev, 0) DESC, iter) AS rn FROM log) WHERE rn = 1",
        "winners": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, batch ORDER BY coalesce(kappa_dev, 0) DESC, iter) AS rn FROM log) WHERE rn = 1",
        "deltas": """
            SELECT c.run_id, c.iter, c.batch, c.parent, c.plan_id, c.kappa_dev AS kappa, c.f1_dev AS f1, c.spearman_dev AS spearman,
                   p.kappa_dev AS parent_kappa, c.kappa_dev - p.kappa_dev AS delta_kappa, c.f1_dev - p.f1_dev AS delta_f1,
                   c.spearman_dev - p.spearman_dev AS delta_spearman
            FROM log c LEFT JOIN log p ON c.run_id = p.run_id AND c.parent = p.iter""",
        "parsed_texts": r"""
            SELECT t.run_id, selection_id, text, regexp_extract(text, '"?iter=(\d+)"?', 1) AS one,
                   regexp_replace(regexp_extract(text, '"?merge=(\d+(?:\s*,\s*\d+)*)"?', 1), '\s', '', 'g') AS many,
                   trim(regexp_extract(text, '(?i)(?:because|rationale|reason)[:\s]+(.+)', 1), E' \n\t\r') AS reason, b.iter AS best_iter
            FROM selection_texts t LEFT JOIN best b ON t.run_id = b.run_id""",
        "parsed": """
            SELECT run_id, selection_id,
                   CASE WHEN one <> '' THEN 'iter=' || one WHEN many <> '' THEN 'merge=' || many ELSE 'iter=' || coalesce(best_iter, 0) END AS action,
                   CASE WHEN one <> '' THEN one WHEN many <> '' THEN many ELSE CAST(coalesce(best_iter, 0) AS VARCHAR) END AS iters,
                   CASE WHEN reason <> '' THEN reason ELSE 'Default selection' END AS rationale
            FROM parsed_texts""",
        "named": """
            SELECT DISTINCT run_id, selection_id, action, base_iter, unnest(list) AS iter FROM (
                SELECT *, list_max(list) AS base_iter FROM (
                    SELECT *, CAST(string_split(iters, ',') AS BIGINT[]) AS list FROM parsed))""",
    }
)


def sql(body: str, recursive: str = "") -> str:
    """The body with the CTEs it uses, directly or through others, in the order they are defined."""
    used: set[str] = set()
    todo = [body + recursive]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(CTES[name])
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in used]
    if recursive:
        parts.append(recursive)
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""
    return head + body


ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, recursive: str = "") -> None:
    ORACLES[name] = sql(body, recursive)


# Sources -------------------------------------------------------------------------------------

oracle("read_examples", "SELECT id, input, label, domain FROM examples")
oracle("bad_example_lines", "SELECT id, id % 10 = 7 AS whole FROM examples WHERE id % 10 IN (3, 7)")
oracle("write_splits", "SELECT id, input, label, domain, split FROM examples")
oracle("append_log", "SELECT run_id, count(*) AS entries, count(DISTINCT iter) AS iterations, max(batch) AS batches FROM log GROUP BY run_id")
oracle("read_log", f"SELECT run_id, iter, batch, ts, artifact_hash, parent, plan_id, rationale, artifact, {rounded('kappa_train', 'kappa_dev', 'kappa_test')} FROM log")
oracle("log_integrity", "SELECT CAST(sum(CASE WHEN iter % 10 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN iter % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS corrupt FROM log")
oracle("duplicate_entries", "SELECT run_id, iter, 2::BIGINT AS copies FROM log WHERE batch = 2")
oracle("log_rewrites", "SELECT run_id, iter FROM (SELECT run_id, iter, rationale FROM log EXCEPT ALL SELECT run_id, iter, CASE WHEN iter % 10 = 0 THEN 'changed' ELSE rationale END FROM log)")
ORACLES["snapshot_rewrites"] = ORACLES["log_rewrites"]
oracle("changed_log_blocks", "SELECT DISTINCT run_id, iter // 4 AS block FROM log WHERE iter % 10 = 0")
oracle("parse_scorer_output", """
    SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '' WHEN 3 THEN replace(text, E'\\n', ' ')
        WHEN 4 THEN CAST(conv_id AS VARCHAR) ELSE '{"prediction": "cut' END AS prediction FROM conversations""")

# Sampling and splitting ----------------------------------------------------------------------

oracle("subsample", f"SELECT run_id, id, label FROM examples ORDER BY {order_by_key('id')} LIMIT 100")
_line = ", ".join(LINE_KEY)
oracle("subsample_lines", f"SELECT {_line} FROM lineitem ORDER BY {order_by_key(*LINE_KEY)} LIMIT 20000")


def quota_ctes(source: str, by: str, stratum: str) -> str:
    """CTEs that end in ``quotas``: rows ``n`` of a stratum, ``k`` kept for train and dev, ``t`` for train."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, {stratum}" if by else stratum
    return f"""sizes AS (SELECT {keys}, count(*) AS n FROM ({source}) GROUP BY ALL),
        totals AS (SELECT *, sum(n) OVER ({part}) AS rows_all FROM sizes),
        first_step AS (SELECT *, rows_all - (rows_all * 400 + 999) // 1000 AS kept_all FROM totals),
        kept_base AS (SELECT *, (n * kept_all) // rows_all AS base, (n * kept_all) % rows_all AS rest FROM first_step),
        kept AS (SELECT *, base + CASE WHEN row_number() OVER ({part} ORDER BY rest DESC, n DESC, {stratum})
                 <= kept_all - sum(base) OVER ({part}) THEN 1 ELSE 0 END AS k FROM kept_base),
        second_step AS (SELECT * EXCLUDE (base, rest), kept_all - (kept_all * 200 + 599) // 600 AS train_all FROM kept),
        train_base AS (SELECT *, coalesce((k * train_all) // nullif(kept_all, 0), 0) AS base, coalesce((k * train_all) % nullif(kept_all, 0), 0) AS rest FROM second_step),
        quotas AS (SELECT *, base + CASE WHEN row_number() OVER ({part} ORDER BY rest DESC, k DESC, {stratum})
                 <= train_all - sum(base) OVER ({part}) THEN 1 ELSE 0 END AS t FROM train_base)"""


def stratified_sql(source: str, by: str, stratum: str, out: str, identity: list[str]) -> str:
    keys = f"{by}, {stratum}" if by else stratum
    return f"""
        WITH {quota_ctes(source, by, stratum)},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order_by_key(*identity)}) AS rn FROM ({source}))
        SELECT {out}, CASE WHEN rn <= n - k THEN 'test' WHEN rn <= n - t THEN 'dev' ELSE 'train' END AS split
        FROM ranked JOIN quotas USING ({keys})"""


def grown_sql(body: str) -> str:
    """Rows with ids up to 6 (last digit) are split; the others fill up what the quotas of all rows leave open."""
    source = "SELECT d.lang AS run_id, d.doc_id AS id, d.source AS domain FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
    published = stratified_sql(f"SELECT * FROM ({source}) WHERE id % 10 < 7", "run_id", "domain", "run_id, id, domain", ["id"])
    return f"""
        WITH published AS ({published}),
        {quota_ctes(source, "run_id", "domain")},
        goals AS (SELECT run_id, domain, unnest(['train', 'dev', 'test']) AS split, unnest([t, k - t, n - k]) AS target FROM quotas),
        lacks AS (SELECT g.*, greatest(g.target - (SELECT count(*) FROM published p WHERE (p.run_id, p.domain, p.split) = (g.run_id, g.domain, g.split)), 0) AS lack,
            (SELECT count(*) FROM ({source}) s WHERE (s.run_id, s.domain) = (g.run_id, g.domain) AND id % 10 >= 7) AS fresh FROM goals g),
        bases AS (SELECT *, coalesce(lack * fresh // nullif(sum(lack) OVER w, 0), 0) AS base, coalesce(lack * fresh % nullif(sum(lack) OVER w, 0), 0) AS rest
            FROM lacks WINDOW w AS (PARTITION BY run_id, domain)),
        given AS (SELECT *, base + CASE WHEN row_number() OVER (PARTITION BY run_id, domain ORDER BY rest DESC, lack DESC, split)
            <= fresh - sum(base) OVER (PARTITION BY run_id, domain) THEN 1 ELSE 0 END AS share FROM bases),
        wide AS (SELECT run_id, domain, sum(share) FILTER (split = 'test') AS a, sum(share) FILTER (split = 'dev') AS b FROM given GROUP BY run_id, domain),
        dealt AS (SELECT run_id, id, domain, CASE WHEN rn <= a THEN 'test' WHEN rn <= a + b THEN 'dev' ELSE 'train' END AS split
            FROM (SELECT *, row_number() OVER (PARTITION BY run_id, domain ORDER BY {order_by_key('id')}) AS rn FROM ({source}) WHERE id % 10 >= 7) JOIN wide USING (run_id, domain)),
        grown AS (SELECT * FROM published UNION ALL SELECT * FROM dealt)
        {body}"""


ORACLES["grown_split"] = grown_sql("SELECT run_id, id, domain, split FROM grown")
ORACLES["split_drift"] = grown_sql("""
        SELECT run_id, domain, split, n, CAST(target AS BIGINT) AS target, CAST(n - target AS BIGINT) AS drift FROM (
            SELECT g.*, (SELECT count(*) FROM grown x WHERE (x.run_id, x.domain, x.split) = (g.run_id, g.domain, g.split)) AS n FROM goals g)""")
ORACLES["stratified_split"] = stratified_sql(
    "SELECT d.lang AS run_id, d.doc_id AS id, d.source AS domain FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "run_id", "domain", "run_id, id, domain", ["id"],
)
ORACLES["stratified_split_scalable"] = stratified_sql(
    f"SELECT {_line}, l_returnflag FROM lineitem", "", "l_returnflag", f"{_line}, l_returnflag", list(LINE_KEY)
)
oracle("hash_split", "SELECT run_id, id, split FROM examples")
CTES["levels"] = "SELECT run_id, split, domain FROM examples UNION ALL SELECT run_id, 'overall', domain FROM examples"
CTES["shares"] = """
    SELECT run_id, split, domain, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY run_id, split) AS BIGINT) AS split_rows,
           count(*) / sum(count(*)) OVER (PARTITION BY run_id, split) AS share
    FROM levels GROUP BY run_id, split, domain"""
oracle("split_statistics", "SELECT run_id, split, domain, n, split_rows, round(CAST(share AS DOUBLE), 9) AS share FROM shares")
oracle("split_balance", """
    SELECT o.run_id, s.split, round(max(abs(coalesce(x.share, 0) - o.share)), 9) AS largest_gap
    FROM shares o CROSS JOIN (SELECT unnest(['train', 'dev', 'test']) AS split) s
    LEFT JOIN shares x ON x.run_id = o.run_id AND x.domain = o.domain AND x.split = s.split
    WHERE o.split = 'overall' GROUP BY o.run_id, s.split""")
oracle("dataset_gates", """
    SELECT 'examples' AS gate, count(*) AS value, CASE WHEN count(*) < 200 THEN 'too few' WHEN count(*) < 1000 THEN 'few' ELSE 'ok' END AS status FROM examples
    UNION ALL SELECT 'artifact_bytes', max(strlen(artifact)), CASE WHEN max(strlen(artifact)) < 100000 THEN 'ok' ELSE 'too large' END FROM artifacts""")
oracle("rare_strata", "SELECT run_id, domain, count(*) AS n FROM examples GROUP BY ALL HAVING count(*) < 3")

# Artifacts -----------------------------------------------------------------------------------

oracle("artifact_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS artifact_hash FROM documents")
oracle("dedupe_artifacts", "SELECT lang AS run_id, min(doc_id) AS iter, substr(sha256(text), 1, 16) AS artifact_hash FROM documents GROUP BY lang, text")
oracle("selector_view", f"""SELECT run_id, iter, batch, ts, artifact_hash, parent, plan_id, rationale, artifact,
    {rounded(*[f'{m}_{s}' for m in _M for s in ('train', 'dev')])} FROM log""")

# Pairing and scoring -------------------------------------------------------------------------

oracle("score_pairs", f"SELECT {KEYS}, id FROM pairs")
oracle("align_predictions", f"SELECT {KEYS}, id, label, CASE WHEN split = 'dev' AND label = '1' THEN '' ELSE prediction END AS prediction FROM predictions")
CTES["cached"] = f"""
    SELECT {KEYS}, id, prediction FROM predictions WHERE split <> 'dev'
    AND (run_id, artifact_hash) IN (SELECT (run_id, artifact_hash) FROM artifacts WHERE batch <= 3)"""
oracle("pending_pairs", f"SELECT {KEYS}, id FROM pairs EXCEPT SELECT {KEYS}, id FROM cached")
oracle("cache_ledger", f"""SELECT {KEYS}, CAST(CASE WHEN id > 0 THEN 1 + (id - 1) // 32768 ELSE 0 END AS BIGINT) AS bucket, count(DISTINCT id) AS cached
    FROM cached GROUP BY ALL""")
oracle("cache_hit_rate", """
    SELECT p.run_id, p.pairs, coalesce(c.hits, 0) AS hits, round(coalesce(c.hits, 0) / p.pairs, 9) AS hit_rate
    FROM (SELECT run_id, count(*) AS pairs FROM predictions GROUP BY 1) p
    LEFT JOIN (SELECT run_id, count(*) AS hits FROM cached GROUP BY 1) c ON p.run_id = c.run_id""")
oracle("score", f"SELECT {KEYS}, id, label, prediction, CAST(NULL AS VARCHAR) AS error FROM predictions")
CTES["tries"] = f"""
    SELECT p.*, t.attempt, t.temperature, mod({h8("concat(artifact_hash, ':', id, ':', CAST(round(t.temperature * 10) AS INTEGER))")}, 3) = 0 AS failed
    FROM predictions p CROSS JOIN (VALUES (1, 0.0::DOUBLE), (2, 0.4::DOUBLE), (3, 0.7::DOUBLE), (4, 0.9::DOUBLE)) t(attempt, temperature)"""
CTES["attempts"] = f"""
    SELECT *, coalesce(bool_and(failed) OVER (PARTITION BY {KEYS}, id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reached
    FROM tries"""
_attempt = f"""{KEYS}, id, label, CAST(attempt AS INTEGER) AS attempt, temperature, CASE WHEN NOT failed THEN prediction END AS prediction,
    CASE WHEN failed THEN 'no prediction' END AS error"""
oracle("score_retry", f"SELECT {_attempt} FROM attempts WHERE reached")
oracle("score_retry_last", f"SELECT {_attempt} FROM attempts WHERE reached QUALIFY row_number() OVER (PARTITION BY {KEYS}, id ORDER BY attempt DESC) = 1")
CTES["refused"] = "SELECT DISTINCT run_id, artifact_hash FROM texts WHERE lower(artifact[1]) IN ('a', 'e', 'i', 'o', 'u')"
CTES["failed_groups"] = f"""
    SELECT DISTINCT {KEYS} FROM (SELECT {KEYS}, id FROM pairs EXCEPT SELECT {KEYS}, id FROM cached)
    WHERE (run_id, artifact_hash) IN (SELECT (run_id, artifact_hash) FROM refused)"""
oracle("score_artifacts", f"""
    SELECT m.run_id, m.artifact_hash, m.split,
           {', '.join(f'round(CASE WHEN f.split IS NULL THEN m.{x} ELSE 0.0 END, 9) AS {x}' for x in _M)},
           f.split IS NULL AS success, CASE WHEN f.split IS NOT NULL THEN 'ValueError: vowel' END AS error
    FROM chain_metrics m LEFT JOIN failed_groups f ON m.run_id = f.run_id AND m.artifact_hash = f.artifact_hash AND m.split = f.split""")
_wide = rounded(*[f"{m}_{s}" for m in _M for s in _S])
oracle("score_batch", f"SELECT run_id, iter, artifact_hash, plan_id, {_wide} FROM log")
oracle("finished_run_is_cached", f"""SELECT count(*) AS pending FROM pairs p WHERE NOT EXISTS (
    SELECT 1 FROM predictions c WHERE c.run_id = p.run_id AND c.artifact_hash = p.artifact_hash AND c.split = p.split AND c.id = p.id)""")
oracle("hash_scorer", f"SELECT {KEYS}, id, label, prediction FROM predictions")
_health = """CAST(length(text) AS BIGINT) AS length, contains(lower(text), '<think>') AS has_think,
    contains(lower(text), '</think>') AS think_closed, contains(text, '<PROMPT>') AND contains(text, '</PROMPT>') AS has_prompt,
    (contains(lower(text), '<think>') AND NOT contains(lower(text), '</think>'))
    OR (contains(text, '<PROMPT>') AND NOT contains(text, '</PROMPT>')) AS truncated"""
oracle("response_health", f"SELECT conv_id, turn, run_id, role, {_health} FROM responses")
CTES["health"] = f"SELECT role, {_health} FROM responses"
oracle("response_rates", f"""SELECT role, count(*) AS responses, max(length) AS longest,
    {', '.join(f'round(avg(CAST({f} AS INTEGER)), 9) AS {f}_rate' for f in ('has_think', 'think_closed', 'has_prompt', 'truncated'))}
    FROM health GROUP BY role""")

# Metrics -------------------------------------------------------------------------------------

oracle("contingency", "SELECT * FROM big_cells")
oracle("confusion_matrix", f"""SELECT {KEYS}, label, count(*) FILTER (prediction = 'A') AS "predicted_A",
    count(*) FILTER (prediction = 'N') AS "predicted_N", count(*) FILTER (prediction = 'R') AS "predicted_R",
    count(*) FILTER (coalesce(prediction NOT IN ('A', 'N', 'R'), true)) AS predicted_other FROM big GROUP BY {KEYS}, label""")
oracle("cohen_kappa", f"SELECT {KEYS}, {rounded('kappa')} FROM chain_agree")
oracle("macro_f1", f"SELECT {KEYS}, {rounded('f1')} FROM chain_agree")
CTES["line_numbers"] = """
    SELECT l_returnflag AS "group", CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS label,
           CASE WHEN l_linenumber > 3 THEN CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR)
                ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS prediction
    FROM lineitem"""
CTES.update(metric_ctes("lines", "line_numbers", '"group"'))
oracle("spearman", f'SELECT "group", {rounded("spearman")} FROM lines_rho')
CTES.update(metric_ctes("ordinal", "big", order={k: v for k, v in LABEL_ORDER.items() if k != "N"}))
oracle("spearman_ordinal", f"SELECT {KEYS}, {rounded('spearman')} FROM ordinal_rho")
CTES["prices"] = "SELECT l_linestatus, CAST(l_quantity AS VARCHAR) AS label, CAST(l_extendedprice AS VARCHAR) AS prediction FROM lineitem"
CTES.update(metric_ctes("prices", "prices", "l_linestatus"))
oracle("spearman_continuous", f"SELECT l_linestatus, {rounded('spearman')} FROM prices_rho")
oracle("all_metrics", f"SELECT {KEYS}, {rounded(*_M)} FROM big_metrics")
oracle("maintained_metrics", f"SELECT {KEYS}, {rounded(*_M)} FROM chain_metrics")
oracle("all_metrics_of_empty_groups", f"""SELECT {KEYS},
    {', '.join(f"round(CASE WHEN split = 'train' OR run_id = 'en' THEN {m} ELSE 0.0 END, 9) AS {m}" for m in _M)} FROM chain_metrics""")
oracle("metric_delta", """
    SELECT run_id, iter, metric, round(delta, 9) AS delta FROM (
        SELECT c.run_id, c.iter, unnest(['delta_kappa', 'delta_f1', 'delta_spearman']) AS metric,
               unnest([c.kappa_dev - p.kappa_dev, c.f1_dev, c.spearman_dev - p.spearman_dev]) AS delta
        FROM log c JOIN log p ON c.run_id = p.run_id AND c.parent = p.iter)""")
oracle("metrics_string", "SELECT run_id, iter, printf('κ=%.3f F1=%.3f ρ=%.3f', kappa_dev, f1_dev, spearman_dev) AS metrics FROM log")
oracle("per_class_report", f"""SELECT {KEYS}, class, round(CASE WHEN c = 0 THEN 0.0 ELSE CAST(t AS DOUBLE) / CAST(c AS DOUBLE) END, 9) AS precision,
    round(CASE WHEN r = 0 THEN 0.0 ELSE CAST(t AS DOUBLE) / CAST(r AS DOUBLE) END, 9) AS recall,
    round(CAST(2 * t AS DOUBLE) / CAST(r + c AS DOUBLE), 9) AS f1, CAST(r AS BIGINT) AS support FROM chain_classes""")
CTES["combined"] = """
    SELECT run_id, artifact_hash, split, label, prediction FROM predictions
    UNION ALL SELECT run_id, artifact_hash, 'all', label, prediction FROM predictions
    UNION ALL SELECT run_id, artifact_hash, 'dev+test', label, prediction FROM predictions WHERE split IN ('dev', 'test')"""
CTES.update(metric_ctes("combined", "combined"))
oracle("combined_kappa", f"SELECT {KEYS}, n, {rounded('kappa')} FROM combined_agree")
oracle("metric_disagreement", """
    SELECT run_id, iter, least(sign(k), sign(f), sign(s)) <> greatest(sign(k), sign(f), sign(s)) AS disagree
    FROM (SELECT run_id, iter, round(delta_kappa, 12) AS k, round(delta_f1, 12) AS f, round(delta_spearman, 12) AS s
          FROM deltas WHERE parent_kappa IS NOT NULL)""")

# Diagnosis -----------------------------------------------------------------------------------

CTES["wrong"] = "SELECT p.*, e.input FROM predictions p JOIN examples e ON p.run_id = e.run_id AND p.id = e.id WHERE p.label <> p.prediction"
CTES["samples"] = f"""
    SELECT {KEYS}, id, prediction, label, row_number() OVER (PARTITION BY {KEYS} ORDER BY id) AS sample, input FROM wrong
    QUALIFY sample <= 10"""
oracle("error_samples", f"SELECT {KEYS}, id, prediction, label, sample, substr(input, 1, 500) AS input FROM samples")
CTES["kinds"] = f"""
    SELECT {KEYS}, label, prediction, id, input, row_number() OVER (PARTITION BY {KEYS}, label, prediction ORDER BY id) AS turn,
           count(*) OVER (PARTITION BY {KEYS}, label, prediction) AS kind_rows FROM wrong"""
oracle("balanced_errors", f"""
    SELECT {KEYS}, label, prediction, id, turn, kind_rows, row_number() OVER (PARTITION BY {KEYS} ORDER BY turn, kind_rows DESC, id) AS sample,
           substr(input, 1, 500) AS input FROM kinds QUALIFY sample <= 10""")
oracle("error_types", f"""
    SELECT {KEYS}, label, prediction, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY {KEYS}) AS DOUBLE), 9) AS share
    FROM wrong GROUP BY {KEYS}, label, prediction""")
oracle("error_digest", f"""
    SELECT {KEYS}, string_agg('Example ' || sample || E':\\n  Input: ' || substr(input, 1, 200) || E'\\n  Prediction: ' || prediction
        || E'\\n  Ground Truth: ' || label || E'\\n', '' ORDER BY sample) AS digest FROM samples GROUP BY {KEYS}""")

# Log analytics -------------------------------------------------------------------------------

_k = rounded("kappa_train", "kappa_dev", "kappa_test")
_gap = "round(kappa_dev - kappa_test, 9) AS gap"
oracle("entry_by_iter", f"SELECT run_id, iter, plan_id, artifact, {_k} FROM log WHERE iter = 7")
oracle("best_entry", f"SELECT run_id, iter, plan_id, artifact, {_k} FROM log WHERE (run_id, iter) IN (SELECT (run_id, iter) FROM best)")
oracle("entries_by_batch", f"SELECT run_id, iter, batch, plan_id, {_k} FROM log WHERE batch = 3")
oracle("log_position", """
    SELECT r.run_id, coalesce(max(iter), 0) AS last_iter, coalesce(max(batch), 0) AS last_batch
    FROM (SELECT lang AS run_id FROM documents UNION SELECT source FROM documents) r LEFT JOIN log l ON r.run_id = l.run_id GROUP BY r.run_id""")
oracle("number_candidates", """
    SELECT c.run_id, c.candidate_id, c.plan_id, coalesce(p.i, 0) + row_number() OVER (PARTITION BY c.run_id ORDER BY candidate_id) AS iter,
           coalesce(p.b, 0) + 1 AS batch
    FROM candidates c LEFT JOIN (SELECT run_id, max(iter) AS i, max(batch) AS b FROM log GROUP BY run_id) p ON c.run_id = p.run_id""")
oracle("build_entries", f"SELECT run_id, iter, artifact_hash, plan_id, {_wide} FROM log WHERE run_id <> 'es'")
oracle("parent_delta", f"SELECT run_id, iter, batch, parent, plan_id, {rounded(*_M, 'parent_kappa', *[f'delta_{m}' for m in _M])} FROM deltas")
oracle("merge_parents", """
    SELECT n.run_id, n.selection_id, n.base_iter, n.iter, l.artifact_hash FROM named n JOIN log l ON n.run_id = l.run_id AND n.iter = l.iter
    WHERE n.action LIKE 'merge=%'""")
oracle(
    "lineage", "SELECT run_id, iter, root_iter, CAST(depth AS BIGINT) AS depth FROM tree",
    """tree AS (SELECT run_id, iter, iter AS root_iter, 0 AS depth FROM log WHERE parent IS NULL
       UNION ALL SELECT l.run_id, l.iter, t.root_iter, t.depth + 1 FROM log l JOIN tree t ON l.run_id = t.run_id AND l.parent = t.iter)""",
)
oracle(
    "lineage_with_cycles",
    "SELECT l.run_id, l.iter, t.root_iter, CAST(t.depth AS BIGINT) AS depth, t.iter IS NULL AS cyclic FROM bent l LEFT JOIN tree t ON l.run_id = t.run_id AND l.iter = t.iter",
    """bent AS (SELECT run_id, iter, CASE iter WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 6 THEN 6 ELSE parent END AS parent FROM log),
       tree AS (SELECT run_id, iter, iter AS root_iter, 0 AS depth FROM bent WHERE parent IS NULL
       UNION ALL SELECT l.run_id, l.iter, t.root_iter, t.depth + 1 FROM bent l JOIN tree t ON l.run_id = t.run_id AND l.parent = t.iter)""",
)
CTES["chosen_merges"] = """
    SELECT run_id, selection_id % 8 + 2 AS batch, max(selection_id) AS selection_id FROM parsed WHERE action LIKE 'merge=%' GROUP BY 1, 2"""
CTES["all_edges"] = """
    SELECT c.run_id, c.iter, p.iter AS parent FROM log c JOIN log p ON c.run_id = p.run_id AND c.parent = p.iter
    UNION SELECT c.run_id, c.iter, p.iter FROM log c JOIN chosen_merges m ON c.run_id = m.run_id AND c.batch = m.batch
    JOIN named n ON n.run_id = m.run_id AND n.selection_id = m.selection_id JOIN log p ON p.run_id = n.run_id AND p.iter = n.iter"""
CTES["forward_edges"] = "SELECT * FROM all_edges WHERE parent < iter"


def dag_sql(edges: str) -> str:
    """All (entry, root, depth) by paths no longer than the run, and all pairs of an entry and one above it."""
    return f"""paths AS (SELECT run_id, iter, iter AS root_iter, 0 AS depth FROM log l WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.run_id = l.run_id AND e.iter = l.iter)
       UNION SELECT e.run_id, e.iter, t.root_iter, t.depth + 1 FROM paths t JOIN {edges} e ON e.run_id = t.run_id AND e.parent = t.iter
       WHERE t.depth < (SELECT max(iter) FROM log)),
       above AS (SELECT run_id, iter, parent AS ancestor FROM {edges}
       UNION SELECT a.run_id, a.iter, e.parent FROM above a JOIN {edges} e ON e.run_id = a.run_id AND e.iter = a.ancestor)"""


for _name, _edges in (("lineage_dag", "forward_edges"), ("lineage_dag_with_cycles", "all_edges")):
    oracle(
        _name, """SELECT l.run_id, l.iter, coalesce(d.roots, 0) AS roots, d.least AS least_depth, CASE WHEN NOT c.cyclic THEN d.greatest END AS greatest_depth, c.cyclic
        FROM log l LEFT JOIN (SELECT run_id, iter, count(DISTINCT root_iter) AS roots, CAST(min(depth) AS BIGINT) AS least, CAST(max(depth) AS BIGINT) AS greatest
            FROM paths GROUP BY run_id, iter) d ON d.run_id = l.run_id AND d.iter = l.iter
        JOIN (SELECT run_id, iter, iter IN (SELECT a.iter FROM above a WHERE a.run_id = log.run_id AND (a.ancestor = a.iter OR EXISTS (
            SELECT 1 FROM above b WHERE b.run_id = a.run_id AND b.iter = a.ancestor AND b.ancestor = b.iter))) AS cyclic FROM log) c
        ON c.run_id = l.run_id AND c.iter = l.iter""",
        dag_sql(_edges),
    )
oracle("lineage_roots", "SELECT run_id, iter, root_iter, CAST(min(depth) AS BIGINT) AS depth FROM paths GROUP BY run_id, iter, root_iter", dag_sql("forward_edges"))
oracle(
    "best_lineage", "SELECT run_id, target_iter, iter, CAST(distance AS BIGINT) AS distance FROM chain_up",
    """chain_up AS (SELECT run_id, iter AS target_iter, iter, 0 AS distance FROM best
       UNION ALL SELECT c.run_id, c.target_iter, l.parent, c.distance + 1 FROM chain_up c JOIN log l ON c.run_id = l.run_id AND c.iter = l.iter
       WHERE l.parent IS NOT NULL)""",
)
CTES["ranked_log"] = "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iter DESC) AS back, (run_id, iter) IN (SELECT (run_id, iter) FROM best) AS is_best FROM log"
oracle("history_view", """
    SELECT run_id, iter, is_best, is_last, is_parent, is_best OR is_last OR is_parent AS "full" FROM (
        SELECT run_id, iter, is_best, back <= 5 AS is_last, (run_id, iter) IN (
            SELECT (run_id, iter) FROM named WHERE (run_id, selection_id) IN (SELECT (run_id, max(selection_id)) FROM parsed GROUP BY run_id)
        ) AS is_parent FROM ranked_log)""")
_parent = "coalesce(CAST(parent AS VARCHAR), 'None')"
oracle("history_lines", f"""
    SELECT run_id, iter, is_best OR back <= 5 AS "full", CASE WHEN is_best OR back <= 5 THEN
        '--- iter=' || iter || ' batch=' || batch || ' parent=' || {_parent} || ' plan=' || plan_id || E' ---\\nRationale: ' || rationale
        || printf(E'\\nMetrics: train: κ=%.3f dev: κ=%.3f', kappa_train, kappa_dev) || E'\\nArtifact:\\n<PROMPT>\\n' || artifact || E'\\n</PROMPT>'
        || CASE WHEN stage_a_summary IS NULL THEN '' ELSE E'\\nStage-A summary: ' || stage_a_summary END
        ELSE 'iter=' || iter || ' batch=' || batch || ' parent=' || {_parent} || ' plan=' || plan_id
        || printf(' train-κ=%.3f dev-κ=%.3f', kappa_train, kappa_dev) || ' rationale=' || substr(rationale, 1, 100) || '...' END AS line
    FROM ranked_log""")
oracle("batch_winners", f"SELECT run_id, batch, iter, plan_id, {rounded('kappa_dev')} FROM winners")


def plan_stats(log: str, winners: str, deltas: str) -> str:
    return f"""
        SELECT d.run_id, d.plan_id, count(*) AS proposed,
               CAST(sum(CASE WHEN w.plan_id = d.plan_id THEN 1 ELSE 0 END) AS BIGINT) AS won,
               CAST(sum(CASE WHEN w.iter = d.iter THEN 1 ELSE 0 END) AS BIGINT) AS won_entries,
               round(coalesce(avg(d.delta_kappa), 0.0), 9) AS mean_delta_dev
        FROM {deltas} d JOIN {winners} w ON d.run_id = w.run_id AND d.batch = w.batch GROUP BY d.run_id, d.plan_id"""


oracle("plan_statistics", plan_stats("log", "winners", "deltas"))
ORACLES["plan_statistics_from_tables"] = ORACLES["plan_statistics"]
CTES["stats"] = plan_stats("log", "winners", "deltas")
oracle("plan_table", "SELECT *, round(won * 100 / proposed, 9) AS win_rate FROM stats")
oracle("best_callout", f"""SELECT run_id, iter, batch, plan_id, {rounded('kappa_dev', 'kappa_train', 'kappa_test')}, {_gap}, rationale, artifact
    FROM log WHERE (run_id, iter) IN (SELECT (run_id, iter) FROM best)""")
oracle("batch_details", f"""SELECT run_id, batch, iter, parent, plan_id,
    CASE WHEN length(rationale) > 50 THEN substr(rationale, 1, 50) || '...' ELSE rationale END AS rationale, {_k}, {_gap} FROM log""")
oracle("gap_trend", f"SELECT run_id, iter, {rounded('kappa_dev', 'kappa_test')}, {_gap} FROM ranked_log WHERE back <= 20")
CTES["run_counts"] = "SELECT run_id, count(*) AS iterations, max(batch) AS batches, max(iter) AS last_iter FROM log GROUP BY run_id"
CTES["summaries"] = """
    SELECT c.run_id, c.iterations, c.batches, b.iter AS best_iter, b.kappa_dev AS best_kappa_dev, b.kappa_test AS best_kappa_test,
           b.kappa_dev - b.kappa_test AS best_gap, l.iter AS latest_iter, l.kappa_dev AS latest_kappa_dev,
           l.kappa_test AS latest_kappa_test, l.kappa_dev - l.kappa_test AS latest_gap
    FROM run_counts c JOIN best x ON c.run_id = x.run_id JOIN log b ON b.run_id = x.run_id AND b.iter = x.iter
    JOIN log l ON l.run_id = c.run_id AND l.iter = c.last_iter"""
oracle("run_summary", f"""SELECT run_id, iterations, batches, best_iter, {rounded('best_kappa_dev', 'best_kappa_test', 'best_gap')}, latest_iter,
    {rounded('latest_kappa_dev', 'latest_kappa_test', 'latest_gap')} FROM summaries""")
oracle("batch_best", "SELECT run_id, batch, round(max(kappa_dev), 9) AS best_kappa_dev FROM log GROUP BY run_id, batch")
oracle("gap_bands", f"""SELECT run_id, iter, gap, CASE WHEN gap < 0.05 THEN 'healthy' WHEN gap <= 0.10 THEN 'caution' ELSE 'warning' END AS band
    FROM (SELECT run_id, iter, {_gap} FROM log)""")
CTES["gap_steps"] = """
    SELECT run_id, iter, kappa_dev - kappa_test AS gap, lag(kappa_dev - kappa_test) OVER (PARTITION BY run_id ORDER BY iter) AS previous_gap,
           row_number() OVER (PARTITION BY run_id ORDER BY iter) AS rn FROM log"""
CTES["gap_islands"] = """
    SELECT *, coalesce(gap > previous_gap, false) AS growing,
           max(CASE WHEN gap > previous_gap THEN NULL ELSE rn END) OVER (PARTITION BY run_id ORDER BY iter) AS still FROM gap_steps"""
oracle("gap_growth", f"SELECT run_id, iter, {rounded('gap', 'previous_gap')}, growing, rn - still AS streak, rn - still >= 3 AS alarm FROM gap_islands")
CTES["bests"] = """
    SELECT run_id, iter, kappa_dev, max(kappa_dev) OVER (PARTITION BY run_id ORDER BY iter) AS best_so_far,
           max(kappa_dev) OVER (PARTITION BY run_id ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM log"""
oracle("running_best", f"""SELECT run_id, iter, {rounded('kappa_dev', 'best_so_far', 'best_before')},
    round(greatest(kappa_dev - best_before, 0.0), 9) AS gain FROM bests""")
CTES["judgements"] = """
    SELECT run_id, iter, delta_kappa, CAST(sum(CASE WHEN delta_kappa > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY iter) AS BIGINT) AS wins,
           count(*) OVER (PARTITION BY run_id ORDER BY iter) AS judged FROM deltas WHERE delta_kappa IS NOT NULL"""
oracle("win_rate", """SELECT run_id, iter, round(delta_kappa, 9) AS delta_kappa, wins, judged, round(wins / judged, 9) AS win_rate,
    wins / judged < 0.2 AS alarm FROM judgements""")
oracle("run_win_rate", """SELECT run_id, count(*) AS judged, count(*) FILTER (delta_kappa > 0) AS wins,
    round(count(*) FILTER (delta_kappa > 0) / count(*), 9) AS win_rate FROM deltas WHERE delta_kappa IS NOT NULL GROUP BY run_id""")
CTES["past_log"] = "SELECT * FROM log WHERE iter <= 20"
CTES["past_winners"] = "SELECT * FROM past_log QUALIFY row_number() OVER (PARTITION BY run_id, batch ORDER BY kappa_dev DESC, iter) = 1"
CTES["past_deltas"] = "SELECT c.run_id, c.iter, c.batch, c.plan_id, c.kappa_dev - p.kappa_dev AS delta_kappa FROM past_log c LEFT JOIN past_log p ON c.run_id = p.run_id AND c.parent = p.iter"
oracle("log_as_of", plan_stats("past_log", "past_winners", "past_deltas"))
oracle("run_comparison", f"""SELECT run_id, iterations, batches, best_iter, {rounded('best_kappa_dev', 'best_kappa_test', 'best_gap')},
    row_number() OVER (ORDER BY best_kappa_dev DESC, run_id) AS place FROM summaries""")

# Text extraction -----------------------------------------------------------------------------

oracle("extract_candidates", "SELECT conv_id, turn, run_id, position, plan_id, rationale, artifact FROM candidates")
oracle("parse_selection", "SELECT run_id, selection_id, action, iters, rationale FROM parsed")
oracle("parse_merge", r"""SELECT item_id, 'parts of ' || item_id || E'\nand others' AS rationale, """ + strip("text || E'\\nEnd.'") + " AS artifact FROM benchmark")


def constraints_sql(heading: str, opens: str) -> str:
    """Line by line: a heading starts a section; lines below a user heading belong to it."""
    return rf"""
        SELECT note_id, section, bool_or(is_user AND is_heading) AS mine, count(*) - 1 AS lines,
               {strip(r"string_agg(CASE WHEN is_heading THEN '' ELSE line END, E'\n' ORDER BY line_no)")} AS body
        FROM (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY note_id ORDER BY line_no) AS section FROM (
              SELECT *, {heading} AS is_heading, {opens} AS is_user FROM note_lines))
        GROUP BY note_id, section"""


CTES["strict_sections"] = constraints_sql("line LIKE '##%' AND line NOT LIKE '###%'", r"regexp_matches(line, '^## USER(\s|$)')")
CTES["loose_sections"] = constraints_sql("line LIKE '##%'", "line LIKE '## USER%'")
CTES["strict_constraints"] = "SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY section) AS position, body AS constraint FROM strict_sections WHERE mine AND body <> ''".replace("constraint", '"constraint"')
oracle("user_constraints", "SELECT * FROM strict_constraints")
oracle("user_constraints_any_heading", 'SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY section) AS position, body AS "constraint" FROM loose_sections WHERE mine AND lines > 0')
oracle("notes_summary", r"""
    SELECT n.note_id, count(c.position) AS constraints, E'=== NOTEBOOK ===\n\n'
        || CASE WHEN count(c.position) > 0 THEN E'### User Constraints\n' || string_agg(c.position || '. ' || c."constraint", E'\n' ORDER BY c.position) || E'\n\n' ELSE '' END
        || CASE WHEN length(any_value(text)) < 2000 THEN E'### Full Content\n' || any_value(text)
                ELSE E'### Recent Content (last 1000 chars)\n' || right(any_value(text), 1000) END AS summary
    FROM note_texts n LEFT JOIN strict_constraints c ON n.note_id = c.note_id GROUP BY n.note_id""")
_plain = lambda t: rf"' ' || regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
CTES["terms"] = f"""SELECT DISTINCT ' ' || trim({_plain('term')}) || ' ' AS term FROM (
    SELECT unnest([string_split(text, ' ')[1], string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2]]) AS term FROM benchmark)"""
CTES["spoken"] = f"SELECT *, {_plain('''concat(plan_id, ' ', rationale)''')} AS words FROM candidates"
oracle("constraint_filter", "SELECT run_id, candidate_id, plan_id FROM spoken s WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE contains(s.words, t.term))")
CTES["offers"] = """
    SELECT run_id, parent, plan_id, artifact, iter AS candidate_id FROM artifacts
    UNION ALL SELECT run_id, parent, plan_id, artifact || '!', iter + 1000 FROM artifacts
    UNION ALL SELECT run_id, parent, 'new_' || plan_id, artifact || '!', iter + 2000 FROM artifacts"""
oracle("repeat_proposals", """
    SELECT * FROM (SELECT o.run_id, candidate_id, substr(sha256(artifact), 1, 16) AS artifact_hash,
        (o.run_id, artifact) IN (SELECT (run_id, artifact) FROM artifacts) AS same_text,
        EXISTS (SELECT 1 FROM artifacts a WHERE a.run_id = o.run_id AND a.parent = o.parent AND a.plan_id = o.plan_id) AS same_plan
        FROM offers o) WHERE same_text OR same_plan""")

# Streaming -----------------------------------------------------------------------------------

oracle("stream_log", """
    SELECT run_id, batch, entries, round(best, 9) AS best_kappa_dev, round(max(best) OVER (PARTITION BY run_id ORDER BY batch), 9) AS best_so_far
    FROM (SELECT run_id, batch, count(*) AS entries, max(kappa_dev) AS best FROM log GROUP BY run_id, batch)""")
oracle("stream_plans", "SELECT run_id, plan_id, count(*) AS proposed FROM log GROUP BY run_id, plan_id")
ORACLES["stream_windows"] = """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS plan_id, count(*) AS proposals,
           count(*) FILTER (WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)) AS unstreamed
    FROM events GROUP BY ALL"""
ORACLES["stream_late_rows"] = """
    WITH arrived AS (SELECT ts, event_type, CASE WHEN event_id % 10 = 0 THEN 3 ELSE (day(ts) - 1) // 8 END AS file FROM events),
    marks AS (SELECT f AS file, (SELECT max(ts) FROM arrived WHERE file < f) - INTERVAL 10 MINUTE AS mark FROM range(5) t(f))
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS plan_id, count(*) AS proposals,
           count(*) FILTER (WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark) AS unstreamed,
           date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT mark FROM marks WHERE file = 4) AS closed
    FROM arrived JOIN marks USING (file) GROUP BY date_trunc('hour', ts), event_type"""
oracle("stream_dedupe", "SELECT run_id, iter, plan_id FROM log")
oracle("stream_score", f"SELECT {KEYS}, {rounded(*_M)} FROM chain_metrics")
oracle("stream_score_failures", f"""
    SELECT m.run_id, m.artifact_hash, m.split,
           {', '.join(f'round(CASE WHEN r.run_id IS NULL THEN m.{x} ELSE 0.0 END, 9) AS {x}' for x in _M)},
           r.run_id IS NULL AS success, CASE WHEN r.run_id IS NOT NULL THEN 'ValueError: vowel' END AS error
    FROM chain_metrics m LEFT JOIN refused r ON m.run_id = r.run_id AND m.artifact_hash = r.artifact_hash""")
