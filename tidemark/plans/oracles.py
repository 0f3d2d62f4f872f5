"""The same queries as plain SQL over the base tables, written as the definitions read:
interval joins, grouped subqueries and window functions, without the Spark side's rewrites."""

from __future__ import annotations

from tidemark import fixed
from tidemark.sources import star

_VIEWS = {
    "issues": """
SELECT o.o_orderkey AS issue_id, n.n_name AS repo_name,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_orderpriority END AS title,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE dd.text END AS body,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'COLLABORATOR' WHEN 'BUILDING' THEN 'contributor'
    WHEN 'FURNITURE' THEN 'FIRST_TIMER' WHEN 'HOUSEHOLD' THEN NULL ELSE 'OWNER' END AS author_association,
  o.o_orderdate AS issue_created_at, CAST(o.o_orderdate AS DATE) AS issue_date,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Fast' WHEN '2-HIGH' THEN 'Medium'
    WHEN '3-MEDIUM' THEN 'Slow' ELSE 'Stale' END AS label
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN documents dd ON dd.doc_id = o.o_orderkey % (SELECT COUNT(*) FROM documents)""",
    "activity": """
SELECT n.n_name AS repo_name, CAST(l.l_shipdate AS DATE) AS date, l.l_quantity, l.l_returnflag,
  l.l_linestatus, l.l_linenumber
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "pr_daily": """
SELECT repo_name, date, COUNT(*) AS pr_merged_count, AVG(l_quantity) AS avg_hours_to_merge
FROM activity WHERE l_returnflag = 'R' GROUP BY repo_name, date""",
    "push_daily": """
SELECT repo_name, date, COUNT(*) AS push_count FROM activity WHERE l_linestatus = 'F' GROUP BY repo_name, date""",
    "release_daily": """
SELECT repo_name, date, COUNT(*) AS release_count FROM activity WHERE l_linenumber = 7 GROUP BY repo_name, date""",
    "watch_daily": """
SELECT repo_name, date, CAST(SUM(l_quantity) AS BIGINT) AS star_count FROM activity GROUP BY repo_name, date""",
    "train": f"""
SELECT * FROM issues WHERE issue_created_at < '{star.TRAIN_END}'""",
    "predictions": f"""
SELECT issue_id, author_association, label AS true_label,
  CASE WHEN issue_id % 10 < 6 THEN label WHEN issue_id % 4 = 0 THEN 'Fast' WHEN issue_id % 4 = 1 THEN 'Medium'
    WHEN issue_id % 4 = 2 THEN 'Slow' ELSE 'Stale' END AS pred_label
FROM issues WHERE issue_created_at >= '{star.TRAIN_END}' AND issue_created_at < '{star.TEST_END}'""",
    "label_list": """
SELECT unnest(['Fast', 'Medium', 'Slow', 'Stale']) AS class""",
    "words": f"""
SELECT doc_id, regexp_extract_all(lower(text), '{fixed.TOKEN_PATTERN}') AS w FROM documents""",
    "placed": """
SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words""",
    "terms": """
SELECT doc_id, word AS term FROM placed
UNION ALL
SELECT doc_id, pair AS term FROM (
  SELECT doc_id, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY place) AS pair FROM placed) p
WHERE pair IS NOT NULL""",
    "buckets": f"""
SELECT doc_id, CAST(CAST('0x' || substr(md5(term), 1, 8) AS UBIGINT) % {fixed.HASH_BUCKETS} AS INTEGER) AS bucket,
  COUNT(*) AS n FROM terms GROUP BY 1, 2""",
}

_NEEDS = {
    "pr_daily": ["activity"],
    "push_daily": ["activity"],
    "release_daily": ["activity"],
    "watch_daily": ["activity"],
    "train": ["issues"],
    "predictions": ["issues"],
    "placed": ["words"],
    "terms": ["placed"],
    "buckets": ["terms"],
}

_FEEDS = {
    "pr_merged_30d": ("pr_daily", "pr_merged_count", fixed.SHORT_WINDOW_DAYS),
    "push_count_30d": ("push_daily", "push_count", fixed.SHORT_WINDOW_DAYS),
    "release_count_90d": ("release_daily", "release_count", fixed.LONG_WINDOW_DAYS),
    "star_count_30d": ("watch_daily", "star_count", fixed.SHORT_WINDOW_DAYS),
}
_DAILY = [table for table, _, _ in _FEEDS.values()]


def _with(views: list[str], query: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``query`` with the named views and whatever they need."""
    order: list[str] = []

    def add(view: str) -> None:
        for needed in _NEEDS.get(view, []):
            add(needed)
        if view not in order:
            order.append(view)

    for view in views:
        add(view)
    parts = [f"{v} AS ({_VIEWS[v]})" for v in order] + [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {query}"


def _window(table: str, days: int, left: str = "i") -> str:
    return (
        f"{table} p ON p.repo_name = {left}.repo_name AND p.date >= {left}.issue_date - INTERVAL {days} DAY "
        f"AND p.date < {left}.issue_date"
    )


def _signal(alias: str) -> str:
    """One signal per (repository, timestamp), joined from the raw issue rows."""
    table, column, days = _FEEDS[alias]
    average = ", AVG(p.avg_hours_to_merge) AS avg_merge_hours_30d" if table == "pr_daily" else ""
    return (
        f"SELECT i.repo_name, i.issue_created_at, SUM(p.{column}) AS {alias}{average} FROM issues i "
        f"LEFT JOIN {_window(table, days)} GROUP BY i.repo_name, i.issue_created_at"
    )


def _day_signal(alias: str) -> str:
    """One signal per distinct (repository, day)."""
    table, column, days = _FEEDS[alias]
    average = ", AVG(p.avg_hours_to_merge) AS avg_merge_hours_30d" if table == "pr_daily" else ""
    return (
        f"SELECT i.repo_name, i.issue_date, SUM(p.{column}) AS {alias}{average} "
        f"FROM (SELECT DISTINCT repo_name, issue_date FROM issues) i "
        f"LEFT JOIN {_window(table, days)} GROUP BY i.repo_name, i.issue_date"
    )


def _count(alias: str) -> str:
    return f"CAST(COALESCE({alias}, 0) AS BIGINT) AS {alias}"


_ALL_COLUMNS = ", ".join(
    "ROUND(avg_merge_hours_30d, 6) AS avg_merge_hours_30d" if s == "avg_merge_hours_30d" else _count(s)
    for s in fixed.SIGNALS
)
_BY_MOMENT = {f"s{i}": _signal(a) for i, a in enumerate(_FEEDS)}
_BY_DAY = {f"s{i}": _day_signal(a) for i, a in enumerate(_FEEDS)}
_JOIN_MOMENT = "issues i " + " ".join(f"LEFT JOIN s{i} USING (repo_name, issue_created_at)" for i in range(4))
_JOIN_DAY = "issues i " + " ".join(f"LEFT JOIN s{i} USING (repo_name, issue_date)" for i in range(4))
_JOINED = {
    **_BY_DAY,
    "joined": "SELECT i.issue_id, i.repo_name, i.issue_created_at, i.issue_date, i.author_association, "
    + ", ".join("avg_merge_hours_30d" if s == "avg_merge_hours_30d" else _count(s) for s in fixed.SIGNALS)
    + f" FROM {_JOIN_DAY}",
}


def _one(alias: str) -> str:
    table = _FEEDS[alias][0]
    average = ", ROUND(avg_merge_hours_30d, 6) AS avg_merge_hours_30d" if table == "pr_daily" else ""
    return _with(
        ["issues", table],
        f"SELECT i.issue_id, {_count(alias)}{average} FROM issues i LEFT JOIN s USING (repo_name, issue_created_at)",
        {"s": _signal(alias)},
    )


_AUTHOR = "UPPER(COALESCE(author_association, 'NONE'))"
_LOGS = [f"ROUND(LN(1 + COALESCE({s}, 0)), 6)" for s in fixed.SIGNALS]
_FLAGS = [f"CASE WHEN {_AUTHOR} = '{c}' THEN 1 ELSE 0 END" for c in fixed.AUTHOR_CATEGORIES]
_VECTOR = ", ".join(
    [f"CAST({e} AS DOUBLE) AS v{i}" for i, e in enumerate([*_LOGS, *_FLAGS])]
)
_ASSEMBLED = ", ".join(
    [f"CAST({e} AS DOUBLE) AS v{i}" for i, e in enumerate([*_FLAGS, *_LOGS])]
)

_FRACTION = "CAST(CAST('0x' || substr(md5('42:' || CAST(issue_id AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0"
_RATES = f"""
SELECT label, COUNT(*) AS n,
  LEAST(1.0, (CAST({star.SAMPLE_TARGET} AS DOUBLE) * COUNT(*) / (SELECT COUNT(*) FROM train)) / COUNT(*)) AS rate
FROM train GROUP BY label"""
_SAMPLE = f"""
SELECT t.issue_id, t.label FROM train t JOIN rates r ON r.label = t.label WHERE {_FRACTION} < r.rate"""

# One row per class with its counts, from a relation of (true_label, pred_label).
_SCORES = """
SELECT l.class,
  (SELECT COUNT(*) FROM {pairs} p WHERE p.true_label = l.class AND p.pred_label = l.class) AS tp,
  (SELECT COUNT(*) FROM {pairs} p WHERE p.true_label = l.class) AS support,
  (SELECT COUNT(*) FROM {pairs} p WHERE p.pred_label = l.class) AS predicted
FROM label_list l"""
_RATIOS = """
SELECT class, support, tp,
  CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * CAST(tp AS DOUBLE) / (support + predicted) END AS f1
FROM {scores}"""
_CELLS = """
SELECT t.class AS true_label, p.class AS pred_label,
  (SELECT COUNT(*) FROM predictions x WHERE x.true_label = t.class AND x.pred_label = p.class) AS n
FROM label_list t, label_list p"""
_LADDER = {
    "noisy": "pred_label",
    "always_fast": "'Fast'",
    "by_author": f"CASE {_AUTHOR} WHEN 'OWNER' THEN 'Fast' WHEN 'NONE' THEN 'Stale' ELSE 'Medium' END",
}


def _ladder() -> str:
    extra, lines = {}, []
    for i, (model, pred) in enumerate(_LADDER.items()):
        extra[f"pairs{i}"] = f"SELECT true_label, {pred} AS pred_label FROM predictions"
        extra[f"scores{i}"] = _SCORES.format(pairs=f"pairs{i}")
        extra[f"ratios{i}"] = _RATIOS.format(scores=f"scores{i}")
        lines.append(
            f"SELECT '{model}' AS model, ROUND(CAST(SUM(tp) AS DOUBLE) / SUM(support), 6) AS accuracy, "
            f"ROUND(SUM(f1) / 4, 6) AS macro_f1, ROUND(SUM(f1 * support) / SUM(support), 6) AS weighted_f1, "
            f"CAST(SUM(support) AS BIGINT) AS n, CAST(0 AS BIGINT) AS unscored FROM ratios{i}"
        )
    return _with(["predictions", "label_list"], " UNION ALL ".join(lines), extra)


def _lags() -> str:
    lines = []
    for alias, (table, _, days) in _FEEDS.items():
        lines.append(
            f"SELECT '{alias}' AS signal, COUNT(nearest) AS active_rows, MIN(nearest) AS min_lag, MAX(farthest) AS max_lag, "
            f"COUNT(*) FILTER (WHERE stored <> again) AS leaks FROM (SELECT i.issue_id, i.{alias} AS stored, "
            f"COALESCE(SUM(p.{_FEEDS[alias][1]}), 0) AS again, MIN(datediff('day', p.date, i.issue_date)) AS nearest, "
            f"MAX(datediff('day', p.date, i.issue_date)) AS farthest FROM joined i LEFT JOIN {table} p "
            f"ON p.repo_name = i.repo_name AND datediff('day', p.date, i.issue_date) BETWEEN 1 AND {days} "
            f"GROUP BY i.issue_id, i.{alias}) z"
        )
    return _with(["issues", *_DAILY], " UNION ALL ".join(lines), _JOINED)


def _profile() -> str:
    schemas = {
        "issues": [
            ("issue_id", "bigint"),
            ("repo_name", "string"),
            ("title", "string"),
            ("author_association", "string"),
            ("issue_created_at", "timestamp_ntz"),
            ("issue_date", "date"),
            ("label", "string"),
        ],
        "pr_daily": [
            ("repo_name", "string"),
            ("date", "date"),
            ("pr_merged_count", "bigint"),
            ("avg_hours_to_merge", "double"),
        ],
        "push_daily": [("repo_name", "string"), ("date", "date"), ("push_count", "bigint")],
        "release_daily": [("repo_name", "string"), ("date", "date"), ("release_count", "bigint")],
        "watch_daily": [("repo_name", "string"), ("date", "date"), ("star_count", "bigint")],
    }
    lines = [
        f"SELECT '{table}' AS dataset, (SELECT COUNT(*) FROM {table}) AS n_rows, {i} AS position, "
        f"'{column}' AS column_name, '{kind}' AS column_type"
        for table, columns in schemas.items()
        for i, (column, kind) in enumerate(columns, start=1)
    ]
    return _with(["issues", *_DAILY], " UNION ALL ".join(lines))


def _zero_fraction() -> str:
    lines = [
        f"SELECT '{s}' AS signal, ROUND(CAST(COUNT(*) FILTER (WHERE {s} = 0) AS DOUBLE) / COUNT(*), 3) AS frac_zero, "
        f"ROUND(AVG({s}), 1) AS mean, CAST(COUNT(*) FILTER (WHERE {s} = 0) AS DOUBLE) / COUNT(*) > 0.95 AS alarm "
        f"FROM joined"
        for s in _FEEDS
    ]
    return _with(["issues", *_DAILY], " UNION ALL ".join(lines), _JOINED)


def _signals_window() -> str:
    """Range frames over the stacked days, as the window reading of the join."""
    stacked = ["SELECT DISTINCT repo_name, issue_date AS day, 1 AS wanted, NULL AS a, NULL AS b, NULL AS c, NULL AS d, NULL AS e FROM issues"]
    for slot, (table, column, _) in zip("abcd", _FEEDS.values()):
        cells = [f"{column} AS {x}" if x == slot else f"NULL AS {x}" for x in "abcd"]
        mean = "avg_hours_to_merge AS e" if table == "pr_daily" else "NULL AS e"
        stacked.append(f"SELECT repo_name, date AS day, 0 AS wanted, {', '.join(cells)}, {mean} FROM {table}")
    frame = "(PARTITION BY repo_name ORDER BY day RANGE BETWEEN INTERVAL {} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    sums = [
        f"CAST(COALESCE(SUM({slot}) OVER {frame.format(days)}, 0) AS BIGINT) AS {alias}"
        for slot, (alias, (_, _, days)) in zip("abcd", _FEEDS.items())
    ]
    return _with(
        ["issues", *_DAILY],
        "SELECT repo_name, CAST(day AS VARCHAR) AS issue_day, pr_merged_30d, avg_merge_hours_30d, push_count_30d, "
        "release_count_90d, star_count_30d FROM framed WHERE wanted = 1",
        {
            "stacked": " UNION ALL ".join(stacked),
            "framed": f"SELECT repo_name, day, wanted, {', '.join(sums)}, "
            f"ROUND(AVG(e) OVER {frame.format(30)}, 6) AS avg_merge_hours_30d FROM stacked",
        },
    )


_REPORT_LINES = """
SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, support FROM ratios
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND(CAST(SUM(tp) AS DOUBLE) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM ratios
UNION ALL SELECT 'macro avg', ROUND(AVG(precision), 6), ROUND(AVG(recall), 6), ROUND(AVG(f1), 6), CAST(SUM(support) AS BIGINT) FROM ratios
UNION ALL SELECT 'weighted avg', ROUND(SUM(precision * support) / SUM(support), 6), ROUND(SUM(recall * support) / SUM(support), 6),
  ROUND(SUM(f1 * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM ratios"""
_PREDICTION_SCORES = {"scores": _SCORES.format(pairs="predictions"), "ratios": _RATIOS.format(scores="scores")}

_QUARTERS = ", ".join(
    f"list_sum(list_transform(embedding[len(embedding) * {q} // 4 + 1:len(embedding) * {q + 1} // 4], lambda x: CAST(x AS DOUBLE)))"
    for q in range(4)
)

_TEST_ROWS = "SELECT issue_id, true_label, TRUE AS named FROM predictions"
_TEST_SUPPORT = (
    "SELECT true_label AS class, COUNT(*) AS support, TRUE AS recounted, TRUE AS learnt FROM predictions GROUP BY true_label"
)
_PARTS = """
SELECT issue_id, label, CASE WHEN place <= LEAST(GREATEST(500, n // 10), n - 1) THEN 'val' ELSE 'train' END AS part
FROM (SELECT issue_id, label, COUNT(*) OVER () AS n, ROW_NUMBER() OVER (ORDER BY
md5('shuffle:42:' || CAST(issue_id AS VARCHAR)) DESC) AS place FROM sample) z"""
_SAMPLED = {"rates": _RATES, "sample": _SAMPLE, "parts": _PARTS}
_HOLES = {
    "holed": """
SELECT true_label, CASE WHEN issue_id % 13 = 0 THEN NULL WHEN issue_id % 17 = 0 THEN 'Later' ELSE pred_label END AS pred_label
FROM predictions""",
    "scores": _SCORES.format(pairs="holed"),
    "ratios": _RATIOS.format(scores="scores"),
}
_HOLED_LINES = """
SELECT class, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, support FROM ratios
UNION ALL SELECT 'accuracy', NULL, ROUND(CAST(SUM(tp) AS DOUBLE) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM ratios
UNION ALL SELECT 'macro avg', ROUND(AVG(recall), 6), ROUND(AVG(f1), 6), CAST(SUM(support) AS BIGINT) FROM ratios
UNION ALL SELECT 'weighted avg', ROUND(SUM(recall * support) / SUM(support), 6), ROUND(SUM(f1 * support) / SUM(support), 6),
  CAST(SUM(support) AS BIGINT) FROM ratios
UNION ALL SELECT 'no prediction', NULL, NULL, COUNT(*) FROM holed
  WHERE pred_label IS NULL OR pred_label NOT IN ('Fast', 'Medium', 'Slow', 'Stale')
UNION ALL SELECT 'ladder', ROUND(CAST(SUM(tp) AS DOUBLE) / SUM(support), 6), ROUND(SUM(f1) / 4, 6), CAST(SUM(support) AS BIGINT) FROM ratios"""


def _printed() -> str:
    """The printed report, line by line."""

    def number(value: str, width: int) -> str:
        return f"CASE WHEN {value} IS NULL THEN repeat(' ', {width}) ELSE format('{{:>{width}.3f}}', CAST({value} AS DOUBLE)) END"

    row = (
        "format('{:>12}', class) || " + " || ".join(number(c, w) for c, w in (("precision", 11), ("recall", 10), ("f1", 10)))
        + " || format('{:>10}', support)"
    )
    order = "list_position(['Fast', 'Medium', 'Slow', 'Stale', 'accuracy', 'macro avg', 'weighted avg'], class)"
    lines = [
        "SELECT 'Stand-in predictions' AS value",
        "SELECT 'rows: test'",
        f"SELECT 'cuts: train_end {star.TRAIN_END}, test_end {star.TEST_END}'",
        f"SELECT '{'-' * 53}'",
        "SELECT 'macro F1 ' || format('{:.4f}', (SELECT SUM(f1) / 4 FROM exact WHERE class IN "
        "('Fast', 'Medium', 'Slow', 'Stale'))) || ', without prediction 0'",
        *["SELECT ''"] * 5,
        f"SELECT '{'class':>12}{'precision':>11}{'recall':>10}{'F1':>10}{'rows':>10}'",
        f"SELECT {row} FROM exact WHERE {order} > 0",
        "SELECT 'true class down, predicted class across: Fast, Medium, Slow, Stale'",
        "SELECT string_agg(format('{:>9}', n), ' ' ORDER BY list_position(['Fast', 'Medium', 'Slow', 'Stale'], pred_label)) "
        "FROM cells GROUP BY true_label",
    ]
    exact = """
SELECT class, precision, recall, f1, support FROM ratios
UNION ALL SELECT 'accuracy', NULL, NULL, CAST(SUM(tp) AS DOUBLE) / SUM(support), CAST(SUM(support) AS BIGINT) FROM ratios
UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), CAST(SUM(support) AS BIGINT) FROM ratios
UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
  SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM ratios"""
    extra = {**_PREDICTION_SCORES, "exact": exact, "cells": _CELLS}
    return _with(["predictions", "label_list"], " UNION ALL ".join(lines), extra)


def _scorer() -> str:
    """Dot products with coefficient ((row + 1) * (column + 1)) % 7 - 3."""
    sums = ", ".join(
        f"SUM(CAST(x AS DOUBLE) * ((place * {c + 1}) % 7 - 3)) AS score_{c}" for c in range(4)
    )
    rounded = ", ".join(f"ROUND(score_{c}, 5) AS score_{c}" for c in range(4))
    best = "list_position([score_0, score_1, score_2, score_3], greatest(score_0, score_1, score_2, score_3))"
    return (
        "WITH cells AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings), "
        f"scored AS (SELECT vec_id, {sums} FROM cells GROUP BY vec_id) "
        f"SELECT vec_id, {rounded}, ['Fast', 'Medium', 'Slow', 'Stale'][{best}] AS pred_label FROM scored"
    )


_DAYS = (
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, COUNT(*) AS n, ROUND(SUM(value), 6) AS total, "
    "ROUND(SUM(value) / COUNT(*), 6) AS mean FROM {rows} GROUP BY ALL"
)


def _streamed() -> str:
    """Days are closed where their end is not beyond the watermark, a day before the latest instant, in milliseconds."""
    mark = "date_trunc('millisecond', MAX(ts)) - INTERVAL 1 DAY"
    over = "CAST(ts AS DATE) + INTERVAL 1 DAY"
    return _with(
        [],
        f"{_DAYS.format(rows='in_time')} UNION ALL SELECT CAST(CAST(ts AS DATE) AS VARCHAR), '(late)', COUNT(*), NULL, NULL "
        "FROM missed GROUP BY CAST(ts AS DATE)",
        {
            "arrived": f"SELECT *, CAST(ts AS DATE) < DATE '{star.STREAM_CUT}' AND event_id % 97 <> 0 AS early FROM events WHERE value IS NOT NULL",
            "marks": f"SELECT (SELECT {mark} FROM arrived WHERE early) AS before, (SELECT {mark} FROM arrived) AS after",
            "in_time": f"SELECT a.* FROM arrived a, marks m WHERE (early OR {over} > m.before) AND {over} <= m.after",
            "missed": f"SELECT a.* FROM arrived a, marks m WHERE NOT early AND {over} <= m.before",
        },
    )


def _footers() -> str:
    """Columns by the catalog, rows by counting."""
    names = ("orders", "lineitem", "customer", "nation", "events")
    counts = " UNION ALL ".join(f"SELECT '{n}' AS dataset, COUNT(*) AS n_rows FROM {n}" for n in names)
    return (
        f"SELECT dataset, n_rows, CAST(column_index AS INTEGER) AS position, column_name, TRUE AS has_groups FROM ({counts}) c "
        "JOIN duckdb_columns() d ON d.table_name = c.dataset AND d.schema_name = 'main'"
    )


def _durations() -> str:
    cases = " ".join(f"WHEN hours <= {limit} THEN '{name}'" for limit, name in zip(star.DURATIONS, fixed.LABELS))
    now = f"TIMESTAMP '{star.AS_OF}'"
    return (
        "WITH rows_ AS (SELECT o_orderkey AS issue_id, o_orderdate AS opened, (SELECT MAX(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS closed "
        f"FROM orders), timed AS (SELECT *, closed <= {now} AS shut, CASE WHEN closed <= {now} AND closed >= opened "
        "THEN (epoch_us(closed) - epoch_us(opened)) / 3.6e9 END AS hours FROM rows_), classed AS (SELECT issue_id, hours, "
        f"CASE WHEN opened > {now} THEN NULL WHEN shut THEN CASE {cases} WHEN hours IS NOT NULL THEN '{fixed.LABELS[-1]}' END "
        f"WHEN (epoch_us({now}) - epoch_us(opened)) / 3.6e9 > {star.DURATIONS[-1]} THEN '{fixed.LABELS[-1]}' END AS label FROM timed) "
        "SELECT issue_id, ROUND(hours, 6) AS duration_hours, label, label IS NOT NULL AS mature FROM classed"
    )


def _before(seconds: int) -> str:
    return f"b.ts < a.ts AND b.ts >= a.ts - INTERVAL {seconds} SECOND"


ORACLES: dict[str, str] = {
    "shuffled_places": _with(
        ["issues"],
        f"SELECT issue_id, row_number() OVER (ORDER BY md5('shuffle:{fixed.SEED}:' || CAST(issue_id AS VARCHAR))) - 1 AS place FROM issues",
    ),
    "file_profile": _footers(),
    "laid_out_signals": _with(
        ["issues", *_DAILY],
        f"SELECT i.issue_id, {_ALL_COLUMNS} FROM {_JOIN_DAY} WHERE i.issue_date >= DATE '{star.TRAIN_END}' AND i.issue_date < DATE '{star.TEST_END}'",
        _BY_DAY,
    ),
    "duration_classes": _durations(),
    "tree_signals": _with(
        ["issues", *_DAILY],
        "SELECT CASE WHEN slow AND own THEN 'Fast' WHEN slow THEN 'Medium' WHEN own THEN 'Slow' ELSE 'Stale' END AS class, "
        "COUNT(*) AS support, TRUE AS recounted, TRUE AS learnt FROM ("
        f"SELECT COALESCE(j.avg_merge_hours_30d, 0) > {star.SLOW_MERGE} AS slow, COALESCE(j.author_association, '') = 'OWNER' AS own FROM joined j "
        f"WHERE j.issue_created_at >= '{star.TRAIN_END}' AND j.issue_created_at < '{star.TEST_END}') z GROUP BY 1",
        _JOINED,
    ),
    "daily_rollup": _DAYS.format(rows="events WHERE value IS NOT NULL AND ts IS NOT NULL"),
    "daily_rollup_corrected": _DAYS.format(rows="events WHERE value IS NOT NULL AND ts IS NOT NULL"),
    "daily_rollup_stream": _streamed(),
    "trailing_hours": (
        f"SELECT a.event_id, COUNT(b.event_id) AS n_24h, ROUND(COALESCE(SUM(b.value), 0), 6) AS value_24h, "
        f"COUNT(CASE WHEN {_before(3600)} THEN 1 END) AS n_1h FROM events a "
        f"LEFT JOIN events b ON b.user_id = a.user_id AND {_before(86400)} GROUP BY a.event_id"
    ),
    "sgd_text": _with(["predictions"], _TEST_SUPPORT),
    "sgd_checkpoints": _with(
        ["train"],
        "SELECT i.item, CASE WHEN i.item = 'holdout rows' THEN (SELECT COUNT(*) FROM parts WHERE part = 'val') ELSE 1 END::DOUBLE AS value "
        "FROM (VALUES ('holdout rows'), ('kept is the first best'), ('kept scores as when stored'), ('ended in time'), "
        "('said why it ended')) i(item)",
        _SAMPLED,
    ),
    "scan_issues": _with(
        ["issues"],
        "SELECT issue_id, repo_name, author_association, CAST(issue_created_at AS VARCHAR) AS issue_created_at, label FROM issues",
    ),
    "sample_shards": _with(["issues"], "SELECT issue_id, label FROM issues WHERE issue_id % 8 < 3"),
    "materialize_signals": _with(
        ["issues", *_DAILY], f"SELECT i.issue_id, {_ALL_COLUMNS} FROM {_JOIN_DAY}", _BY_DAY
    ),
    "dataset_profile": _profile(),
    "issue_dates": _with(
        ["issues"],
        "SELECT issue_id, CAST(epoch(issue_created_at) AS BIGINT) AS epoch_seconds, "
        "CAST(CAST(issue_created_at AS DATE) AS VARCHAR) AS issue_day FROM issues",
    ),
    "issue_text": _with(
        ["issues"],
        "SELECT issue_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT issue_id, "
        "COALESCE(title, '') || ' ' || COALESCE(body, '') AS t FROM issues) z",
    ),
    "author_onehot": _with(
        ["issues"],
        "SELECT issue_id, "
        + ", ".join(f"{f} AS is_{c.lower()}" for f, c in zip(_FLAGS, fixed.AUTHOR_CATEGORIES))
        + " FROM issues",
    ),
    "signal_log1p": _with(
        ["issues", *_DAILY],
        "SELECT issue_id, " + ", ".join(f"{e} AS log_{s}" for e, s in zip(_LOGS, fixed.SIGNALS)) + " FROM joined",
        _JOINED,
    ),
    "signal_vector": _with(["issues", *_DAILY], f"SELECT issue_id, {_VECTOR} FROM joined", _JOINED),
    "label_ids": _with(
        ["issues"],
        "SELECT issue_id, label, CASE label WHEN 'Fast' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Slow' THEN 2 ELSE 3 END AS label_id, "
        "label AS label_back FROM issues",
    ),
    "temporal_split": _with(
        ["issues"],
        f"SELECT CASE WHEN issue_created_at < '{star.TRAIN_END}' THEN 'train' WHEN issue_created_at < '{star.TEST_END}' "
        "THEN 'test' ELSE 'discard' END AS split, COUNT(*) AS n FROM issues GROUP BY 1",
    ),
    "split_rows": _with(
        ["issues"],
        f"SELECT issue_id, CASE WHEN issue_created_at < '{star.TRAIN_END}' THEN 'train' ELSE 'test' END AS split "
        f"FROM issues WHERE issue_created_at < '{star.TEST_END}'",
    ),
    "label_distribution": _with(
        ["train"],
        "SELECT label, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM train), 6) AS pct FROM train GROUP BY label",
    ),
    "class_weights": _with(
        ["train"],
        "SELECT label, COUNT(*) AS n, ROUND(CAST((SELECT COUNT(*) FROM train) AS DOUBLE) / (4 * COUNT(*)), 6) AS weight "
        "FROM train GROUP BY label",
    ),
    "class_weighted_rows": _with(
        ["train"],
        "SELECT t.issue_id, t.label, ROUND(w.weight, 6) AS weight FROM train t JOIN w ON w.label = t.label",
        {
            "w": "SELECT label, CAST((SELECT COUNT(*) FROM train) AS DOUBLE) / (4 * COUNT(*)) AS weight FROM train GROUP BY label"
        },
    ),
    "sampling_rates": _with(["train"], "SELECT label, n, ROUND(rate, 6) AS rate FROM rates", {"rates": _RATES}),
    "stratified_sample": _with(["train"], "SELECT issue_id, label FROM sample", {"rates": _RATES, "sample": _SAMPLE}),
    "train_val_split": _with(
        ["train"],
        "SELECT issue_id, label, part FROM parts",
        _SAMPLED,
    ),
    "signal_pr": _one("pr_merged_30d"),
    "signal_push": _one("push_count_30d"),
    "signal_release": _one("release_count_90d"),
    "signal_watch": _one("star_count_30d"),
    "signals_window": _signals_window(),
    "issues_with_signals": _with(
        ["issues", *_DAILY], f"SELECT i.issue_id, {_ALL_COLUMNS} FROM {_JOIN_MOMENT}", _BY_MOMENT
    ),
    "issues_with_signals_dedup": _with(
        ["issues", *_DAILY], f"SELECT i.issue_id, {_ALL_COLUMNS} FROM {_JOIN_DAY}", _BY_DAY
    ),
    "row_parity": _with(
        ["issues", *_DAILY],
        "SELECT (SELECT COUNT(*) FROM issues) AS source_rows, (SELECT COUNT(*) FROM joined) AS joined_rows",
        _JOINED,
    ),
    "spot_check": _with(
        ["issues", *_DAILY],
        "SELECT CAST(f.issue_created_at AS VARCHAR) AS issue_created_at, f.issue_id, f.pr_merged_30d AS stored, "
        "CAST(COALESCE(SUM(d.pr_merged_count), 0) AS BIGINT) AS counted_again FROM five f "
        "LEFT JOIN pr_daily d ON d.repo_name = f.repo_name AND datediff('day', d.date, f.issue_date) BETWEEN 1 AND 30 "
        "GROUP BY ALL",
        {
            **_JOINED,
            "five": f"SELECT * FROM joined WHERE repo_name = '{star.SPOT_REPO}' ORDER BY issue_created_at, issue_id LIMIT 5",
        },
    ),
    "signal_zero_fraction": _zero_fraction(),
    "no_leakage": _lags(),
    "confusion_matrix": _with(["predictions", "label_list"], _CELLS),
    "stream_evaluation": _with(["predictions", "label_list"], _CELLS),
    "classification_report": _with(["predictions", "label_list"], _REPORT_LINES, _PREDICTION_SCORES),
    "macro_f1": _with(
        ["predictions", "label_list"], "SELECT ROUND(SUM(f1) / 4, 6) AS macro_f1 FROM ratios", _PREDICTION_SCORES
    ),
    "model_ladder": _ladder(),
    "argmax_label": (
        "SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS pred_id, "
        "['Fast', 'Medium', 'Slow', 'Stale'][list_position(s, list_max(s))] AS pred_label "
        f"FROM (SELECT vec_id, [{_QUARTERS}] AS s FROM embeddings) z"
    ),
    "tokens": _with(["placed"], "SELECT doc_id, word AS token, COUNT(*) AS n FROM placed GROUP BY doc_id, word"),
    "ngram_counts": _with(["terms"], "SELECT doc_id, term, COUNT(*) AS n FROM terms GROUP BY doc_id, term"),
    "hashed_tf_md5": _with(["buckets"], "SELECT doc_id, bucket, n FROM buckets"),
    "l2_tf": _with(
        ["buckets"],
        "SELECT doc_id, bucket, ROUND(n / SQRT(CAST(SUM(n * n) OVER (PARTITION BY doc_id) AS DOUBLE)), 6) AS weight FROM buckets",
    ),
    "token_cap": _with(
        ["words"],
        f"SELECT doc_id, len(w) AS n_tokens, len(w[1:{fixed.MAX_TOKENS}]) AS n_kept, "
        f"md5(array_to_string(w[1:{fixed.MAX_TOKENS}], ' ')) AS kept_md5 FROM words",
    ),
    "assembled_features": _with(["issues", *_DAILY], f"SELECT issue_id, {_ASSEMBLED}, CAST(has_terms AS DOUBLE) AS text_length "
        "FROM joined JOIN worded USING (issue_id)",
        {
            **_JOINED,
            "worded": "SELECT issue_id, regexp_matches(COALESCE(title, '') || ' ' || COALESCE(body, ''), "
            f"'{fixed.TOKEN_PATTERN}') AS has_terms FROM issues",
        },
    ),
    "batch_scoring": _scorer(),
    "unscored_evaluation": _with(["predictions", "label_list"], _HOLED_LINES, _HOLES),
    "eval_report": _printed(),
    "hashed_tf": _with(
        ["terms"],
        "SELECT d.doc_id, COUNT(t.term) AS n_terms, CASE WHEN COUNT(t.term) = 0 THEN 0.0 ELSE CAST(1 AS DOUBLE) END AS length "
        "FROM documents d LEFT JOIN terms t ON t.doc_id = d.doc_id GROUP BY d.doc_id",
    ),
    "lr_text": _with(["predictions"], _TEST_SUPPORT),
    "lr_text_one_vs_rest": _with(["predictions"], _TEST_SUPPORT),
    "lr_text_signals": _with(["predictions"], _TEST_SUPPORT),
    "lr_predictions": _with(["predictions"], _TEST_ROWS),
    "fitted_ladder": _with(
        ["predictions"],
        "SELECT m.model, (SELECT COUNT(*) FROM predictions) AS n, CAST(0 AS BIGINT) AS unscored, m.model <> 'commonest' AS above "
        "FROM (VALUES ('text'), ('text_signals'), ('trees'), ('commonest')) m(model)",
    ),
    "saved_model_scoring": _with(["predictions"], _TEST_ROWS),
    "model_selection": _with(
        ["train"],
        "SELECT c.candidate, c.l2, (SELECT COUNT(*) FROM parts WHERE part = 'val') AS val_rows, TRUE AS best_first "
        "FROM (VALUES ('candidate_0', CAST(1e-4 AS DOUBLE)), ('candidate_1', CAST(1e-2 AS DOUBLE))) c(candidate, l2)",
        _SAMPLED,
    ),
    "sampled_training": _with(
        ["train", "predictions"],
        "SELECT 'part ' || part AS item, CAST(COUNT(*) AS DOUBLE) AS value FROM parts GROUP BY part "
        "UNION ALL SELECT 'weight ' || label, ROUND(CAST((SELECT COUNT(*) FROM parts WHERE part = 'train') AS DOUBLE) / (4 * COUNT(*)), 6) "
        "FROM parts WHERE part = 'train' GROUP BY label "
        "UNION ALL SELECT 'test ' || true_label, CAST(COUNT(*) AS DOUBLE) FROM predictions GROUP BY true_label",
        _SAMPLED,
    ),
    "embedding_signals_lr": (
        "SELECT ['Fast', 'Medium', 'Slow', 'Stale'][list_position(s, list_max(s))] AS class, COUNT(*) AS support, "
        f"TRUE AS recounted, TRUE AS learnt FROM (SELECT vec_id, [{_QUARTERS}] AS s FROM embeddings) z "
        "WHERE CAST(CAST('0x' || substr(md5('42:' || CAST(vec_id AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 < 0.1 "
        "GROUP BY class"
    ),
    "model_roundtrip": _with(["predictions"], "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS differing FROM predictions"),
}
