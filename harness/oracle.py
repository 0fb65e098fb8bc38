"""The registered queries in SQL, written from the reports' definitions and not from the plans."""

from __future__ import annotations

CASES = """
SELECT CAST(date_trunc('month', l_shipdate) AS date) AS month,
       CASE WHEN l_linestatus = 'O' THEN 'digital' ELSE 'traditional' END AS channel,
       o_orderpriority AS case_type,
       NULLIF(l_returnflag, 'N') AS case_group,
       p_name AS reason,
       NULLIF(p_brand, 'Brand#13') AS brand,
       NULLIF(p_type, 'PROMO') AS subcat1,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS varchar) END AS subcat2,
       NULLIF(p_type, 'PROMO') AS line,
       NULLIF(split_part(p_name, ' ', 1), 'hot') AS variant
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
"""
WITH_CASES = f"WITH cases AS ({CASES})"

RAW = "month, case_type, case_group, reason, brand, subcat1, subcat2, line, variant"
PERIOD = "month BETWEEN DATE '1996-01-01' AND DATE '1996-12-01'"
LAST = "month = DATE '1996-12-01'"
FIRST = "month = DATE '1996-01-01'"
CHANNEL_PERIOD = "month BETWEEN DATE '1995-06-01' AND DATE '1999-12-01'"

TRADITIONAL = "channel = 'traditional' AND month >= DATE '1997-01-01'"
DIGITAL = "channel = 'digital' AND month < DATE '1999-01-01'"
SCOPES = {
    1000: "TRUE",
    8006: "channel = 'digital'",
    9006: "channel = 'traditional'",
    8106: DIGITAL,
    9106: TRADITIONAL,
}

COMPLAINT = "case_type = '1-URGENT'"
OTHER = "case_type <> '1-URGENT'"
TYPE_RANK = (
    "CASE upper(case_type) WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 "
    "WHEN 'MENTIONS' THEN 4 WHEN 'OTHER INTERACTIONS' THEN 5 END"
)
FOLDED = "CASE case_group WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE reason END"
TYPE_REASON = "lower(case_type || ' - ' || reason)"
LINE_VARIANT = (
    "CASE WHEN line IS NULL AND variant IS NULL THEN 'GENERAL' WHEN line = 'STANDARD' THEN variant "
    "WHEN line IS NOT NULL AND variant IS NOT NULL THEN line || '-' || variant "
    "WHEN line IS NOT NULL THEN line ELSE variant END"
)
SHOWN_BRAND = "CASE WHEN brand = 'Brand#1' THEN 'Unidentified' ELSE brand END"
BRANDS = [f"Brand#{n}" for n in sorted(range(1, 26), key=str) if n != 13]
SHOWN_BRANDS = [name for name in BRANDS if name != "Brand#1"] + ["Unidentified"]

MONTH_NAMES = "['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez']"


def title(text: str) -> str:
    runs = rf"regexp_extract_all({text}, '\p{{L}}+|\P{{L}}+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def capital(text: str) -> str:
    return f"upper(substr({text}, 1, 1)) || lower(substr({text}, 2))"


def month_text(month: str, year: str = "%y", upper: bool = False) -> str:
    name = f"{MONTH_NAMES}[CAST(month({month}) AS INTEGER)]"
    if upper:
        name = f"upper({name}[1]) || {name}[2:]"
    return f"({name} || '/' || strftime({month}, '{year}'))"


def select(columns: str, where: str = "TRUE") -> str:
    return f"{WITH_CASES} SELECT {columns} FROM cases WHERE {where}"


def count(label: str, name: str, where: str = "TRUE") -> str:
    return f"{WITH_CASES} SELECT {label} AS {name}, count(*) AS total FROM cases WHERE {where} GROUP BY 1"


def top(label: str, name: str, where: str, n: int = 10) -> str:
    return f"{count(label, name, where)} ORDER BY total DESC, {name} ASC NULLS FIRST LIMIT {n}"


def with_remainder(label: str, name: str, where: str, n: int = 10) -> str:
    return f"""
WITH counted AS ({count(label, name, where)}),
best AS (SELECT {name}, total, 0 AS bucket FROM counted ORDER BY total DESC, {name} ASC NULLS FIRST LIMIT {n}),
rest AS (SELECT 'remainder' AS {name}, CAST(sum(total) AS BIGINT) AS total, 1 AS bucket
         FROM counted WHERE {name} NOT IN (SELECT {name} FROM best))
SELECT * FROM best UNION ALL SELECT * FROM rest WHERE total IS NOT NULL"""


def pareto(label: str, where: str) -> str:
    order = "ORDER BY bucket, total DESC, reason ASC NULLS FIRST"
    running = f"sum(total) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
SELECT CAST(row_number() OVER ({order}) AS INTEGER) AS rank, {title('reason')} AS reason, total,
       CAST({running} AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS cum_share, bucket
FROM ({with_remainder(f'lower({label})', 'reason', where)})"""


def ranked(label: str, name: str, where: str) -> str:
    return f"""
SELECT CAST(row_number() OVER (ORDER BY total DESC, {name} ASC NULLS FIRST) AS INTEGER) AS rank,
       {title(name)} AS {name}, total
FROM ({top(f'lower({label})', name, where)})"""


def type_parts(where: str) -> str:
    return f"""
WITH cases AS ({CASES}), chosen AS (SELECT * FROM cases WHERE {where})
SELECT case_type, count(*) AS total FROM chosen WHERE case_type <> '5-LOW' OR case_type IS NULL GROUP BY 1
UNION ALL
SELECT 'MENTIONS', count(*) FROM chosen WHERE case_type = '5-LOW' AND case_group IN ('R') GROUP BY case_type
UNION ALL
SELECT 'OTHER INTERACTIONS', count(*) FROM chosen
WHERE case_type = '5-LOW' AND case_group NOT IN ('R') GROUP BY case_type"""


def breakdown(where: str, style=title, extra: str = "") -> str:
    return f"""
SELECT {style('case_type')} AS case_type, total, CAST({TYPE_RANK} AS INTEGER) AS rank,
       CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS share
FROM ({type_parts(where)}{extra})"""


def channels() -> str:
    def side(name: str, where: str) -> str:
        return f"(SELECT month, count(*) AS {name} FROM cases WHERE {where} AND {CHANNEL_PERIOD} GROUP BY month)"

    return f"""
{WITH_CASES}
SELECT coalesce(t.month, d.month) AS month, coalesce(traditional, 0) AS traditional, coalesce(digital, 0) AS digital
FROM {side('traditional', TRADITIONAL)} t FULL JOIN {side('digital', DIGITAL)} d ON t.month = d.month"""


def channel_report() -> str:
    return f"SELECT month, {month_text('month', upper=True)} AS month_label, traditional, digital FROM ({channels()})"


def wide(rows: str, brand: str, brands: list[str], where: str) -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE {brand} = '{name}') AS \"{name}\"" for name in brands)
    return f"{WITH_CASES} SELECT {rows}, {cells} FROM cases WHERE {where} GROUP BY 1"


def placed(table: str, first: str, label: str) -> str:
    order = f'"{first}" DESC, {label} ASC NULLS FIRST'
    return f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place FROM ({table})"


def category(where: str) -> str:
    return wide(f"{title(_subcat1())} AS category", f"({SHOWN_BRAND})", SHOWN_BRANDS, where)


def _subcat1() -> str:
    return "coalesce(subcat1, 'general')"


def category_long(where: str, scope: str = "TRUE") -> str:
    return f"""
WITH cases AS ({CASES}),
shown AS (SELECT month, {title(_subcat1())} AS category, {title(SHOWN_BRAND)} AS brand FROM cases WHERE {scope}),
chosen AS (SELECT * FROM shown WHERE {where})
SELECT category, brand, count(*) AS total FROM chosen WHERE brand IS NOT NULL GROUP BY 1, 2
UNION ALL
SELECT category, NULL, 0 FROM chosen GROUP BY 1 HAVING count(brand) = 0
UNION ALL
SELECT NULL, brand, 0 FROM (SELECT DISTINCT brand FROM shown WHERE brand IS NOT NULL)
WHERE brand NOT IN (SELECT brand FROM chosen WHERE brand IS NOT NULL)"""


def long_rows(sheet: str, inner: str, position: str, label: str, values: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{sheet}' AS sheet, CAST({position} AS BIGINT) AS position, {label} AS label, "
        f"'{value}' AS series, CAST({value} AS DOUBLE) AS value FROM ({inner})"
        for value in values
    )


def long_category(sheet: str, where: str, scope: str = "TRUE") -> str:
    return f"""
SELECT '{sheet}' AS sheet,
       CASE WHEN category IS NOT NULL THEN CAST(
           -coalesce(sum(total) FILTER (WHERE brand = 'Brand#10') OVER (PARTITION BY category), 0) AS BIGINT) END
           AS position,
       category AS label, brand AS series, CAST(total AS DOUBLE) AS value
FROM ({category_long(where, scope)})"""


def long_channels() -> str:
    return long_rows(
        "channel_evolution",
        channel_report(),
        "year(month) * 12 + month(month)",
        "month_label",
        ["traditional", "digital"],
    )


def long_types(sheet: str, where: str, style=title) -> str:
    return long_rows(sheet, breakdown(where, style), "rank", "case_type", ["total", "share"])


def full_pack(scope: str = "TRUE") -> str:
    parts = [long_channels()]
    for suffix, months in (("", PERIOD), ("_last", LAST)):
        where = f"{scope} AND {months}"
        shares = ["total", "cum_share"]
        complaint, other = pareto("reason", f"{COMPLAINT} AND {where}"), pareto(TYPE_REASON, f"{OTHER} AND {where}")
        parts += [
            long_types(f"type_breakdown{suffix}", where),
            long_rows(f"complaint_pareto{suffix}", complaint, "rank", "reason", shares),
            long_rows(f"other_pareto{suffix}", other, "rank", "reason", shares),
            long_category(f"category_brand{suffix}", months, scope),
            long_rows(
                f"line_variant{suffix}", ranked(LINE_VARIANT, "line_variant", where), "rank", "line_variant", ["total"]
            ),
            long_rows(f"subcat2{suffix}", ranked(SUBCAT2, "subcat2", where), "rank", "subcat2", ["total"]),
        ]
    return " UNION ALL ".join(parts)


def summary_pack(style=capital) -> str:
    return " UNION ALL ".join(
        [
            long_channels(),
            long_types("type_breakdown", PERIOD, style),
            long_types("type_breakdown_first", FIRST, style),
            long_types("type_breakdown_last", LAST, style),
        ]
    )


SUBCAT2 = "coalesce(subcat2, 'GENERAL')"


def per_scope(inner) -> str:
    return " UNION ALL ".join(
        f"SELECT {scope_id} AS scope_id, * FROM ({inner(f'{where} AND {PERIOD}')})" for scope_id, where in SCOPES.items()
    )


def many_scope_totals(how_many: int = 100) -> str:
    scopes = {scope_id: SCOPES[scope_id] for scope_id in (1000, 8006, 9006)}
    for at in range(how_many - len(scopes)):
        first = 1995 + at // 2 % 7
        channel = ("digital", "traditional")[at % 2]
        scopes[20000 + at] = (
            f"channel = '{channel}' AND month >= DATE '{first}-01-01' AND month < DATE '{first + 1 + at // 14}-01-01'"
        )
    counts = ", ".join(f"count(*) FILTER (WHERE {where}) AS s{scope_id}" for scope_id, where in scopes.items())
    rows = " UNION ALL ".join(f"SELECT {scope_id} AS scope_id, s{scope_id} AS total FROM counted" for scope_id in scopes)
    return (
        f"WITH cases AS ({CASES}), counted AS (SELECT {counts} FROM cases WHERE {PERIOD}) "
        f"SELECT * FROM ({rows}) WHERE total > 0"
    )


def many_scopes_by_rule(how_many: int) -> str:
    """The same from the rule of the scopes, for any number of them."""
    base = " UNION ALL ".join(
        f"SELECT {scope_id} AS scope_id, count(*) AS total FROM cases WHERE {SCOPES[scope_id]} AND {PERIOD}" for scope_id in (1000, 8006, 9006)
    )
    return f"""
WITH cases AS ({CASES}), counted AS (SELECT channel, year(month) AS y, count(*) AS n FROM cases WHERE {PERIOD} GROUP BY 1, 2),
scopes AS (
    SELECT CAST(20000 + k AS INTEGER) AS scope_id, CASE k % 2 WHEN 0 THEN 'digital' ELSE 'traditional' END AS channel,
           1995 + (k // 2) % 7 AS first, 1996 + (k // 2) % 7 + k // 14 AS ended
    FROM range({how_many - 3}) AS numbers(k))
SELECT scope_id, CAST(sum(n) AS BIGINT) AS total FROM scopes JOIN counted USING (channel) WHERE y >= first AND y < ended GROUP BY 1
UNION ALL {base}"""


def pareto_classes(counts: str, label: str, by: str = "") -> str:
    """All labels of ``counted`` with rank, running share and class."""
    part = f"PARTITION BY {by}" if by else ""
    order = f"ORDER BY total DESC, {label} ASC NULLS FIRST"
    return f"""
WITH counted AS ({counts}),
placed AS (
    SELECT *, row_number() OVER ({part} {order}) AS rank, sum(total) OVER ({part}) AS whole,
           sum(total) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
    FROM counted)
SELECT {by + ',' if by else ''} rank, {label}, total, CAST(running AS DOUBLE) / CAST(whole AS DOUBLE) AS cum_share,
       CASE WHEN CAST(running - total AS DOUBLE) / CAST(whole AS DOUBLE) < 0.8 THEN 'A'
            WHEN CAST(running - total AS DOUBLE) / CAST(whole AS DOUBLE) < 0.95 THEN 'B' ELSE 'C' END AS class
FROM placed"""


SCOPE_PATH = f"""
WITH RECURSIVE scopes AS (
    SELECT p_partkey AS id, {title('upper(p_name)')} AS name,
           CASE WHEN p_partkey % 97 = 0 THEN p_partkey WHEN p_partkey % 101 = 0 THEN -1 WHEN p_partkey >= 4 THEN p_partkey // 4 END AS parent
    FROM part),
way AS (
    SELECT id, parent AS above, 0 AS depth, [id] AS ids, name AS path, false AS circular FROM scopes
    UNION ALL
    SELECT way.id, up.parent, depth + 1, list_prepend(up.id, ids), up.name || ' / ' || path, list_contains(ids, up.id)
    FROM way JOIN scopes AS up ON up.id = above WHERE NOT circular)
SELECT id AS scope_id, path, depth, CASE WHEN circular THEN 'circle' WHEN above IS NOT NULL THEN 'orphan' ELSE 'complete' END AS state
FROM way QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC) = 1"""

PADDED = "case_type || repeat(' ', CAST(month(month) % 3 AS INTEGER))"


CATALOGUE = (
    "SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS scope_id, "
    "'[' || upper(p_brand) || '] cases/' || lower(p_brand) AS name FROM part"
)
STRIPPED = "replace(replace(name, '[', ''), ']', '')"
SCOPE_LABEL = f"SELECT scope_id, {title(STRIPPED)} AS label FROM ({CATALOGUE}) WHERE scope_id = 7"
PART_TEXT = "(p_name || '/d''' || p_type || '/x1' || p_brand)"
TEXT_NUMBER = (
    "CASE WHEN l_returnflag = 'N' THEN '#NÚM!' WHEN l_linestatus = 'O' THEN CAST(CAST(l_quantity AS INTEGER) AS varchar) "
    "ELSE 'q' || l_linenumber END"
)


def captions() -> str:
    name = f"(SELECT label FROM ({SCOPE_LABEL}))"
    subject = "Representatividade de tipos de ocorrência"

    def total(where: str) -> str:
        return f"(SELECT count(*) FROM cases WHERE {where})"

    return f"""
{WITH_CASES}
SELECT {name} || ' ' || chr(10) || '{subject}' || chr(10) || {total(PERIOD)} || ' manifestações - jan/96 a dez/96' AS caption
UNION ALL
SELECT {name} || ' ' || chr(10) || '{subject}' || chr(10) || {total(LAST)} || ' manifestações - dez/96'
UNION ALL
SELECT {name} || ' ' || chr(10) || 'Total de manifestações por categoria ' || chr(10) || 'jan/96 a dez/96'"""


def pack_captions() -> str:
    name = f"(SELECT label FROM ({SCOPE_LABEL}))"
    both = f"((SELECT count(*) FROM cases WHERE {CHANNEL_PERIOD} AND ({TRADITIONAL})) + (SELECT count(*) FROM cases WHERE {CHANNEL_PERIOD} AND ({DIGITAL})))"
    social = "(case_type <> '5-LOW' OR case_group IS NOT NULL OR case_type IS NULL)"

    def total(*conditions: str) -> str:
        return f"(SELECT count(*) FROM cases WHERE {' AND '.join(conditions)})"

    rows = [("channel_evolution", f"'Evolução das manifestações por canal' || chr(10) || {both} || ' manifestações - jun/95 a dez/99'")]
    for suffix, where, two, dash in (("", PERIOD, "jan/96 a dez/96", "jan/96 - dez/96"), ("_last", LAST, "dez/96", "dez/96")):
        rows += [
            ("type_breakdown" + suffix, f"'Representatividade de tipos de ocorrência' || chr(10) || {total(where, social)} || ' manifestações - {two}'"),
            ("complaint_pareto" + suffix, f"'10 principais motivos de reclamações ' || chr(10) || {total(where, COMPLAINT, 'reason IS NOT NULL')} || ' reclamações - {two}'"),
            (
                "other_pareto" + suffix,
                f"'10 principais manifestações (exceto reclamações) ' || chr(10) || {total(where, OTHER, 'reason IS NOT NULL')} || ' manifestações - {dash}'",
            ),
            ("category_brand" + suffix, f"'Total de manifestações por categoria ' || chr(10) || '{two}'"),
            ("line_variant" + suffix, f"'Total de manifestações por tipo de corte - 10 Principais Cortes ' || chr(10) || '{two}'"),
            ("subcat2" + suffix, f"'Total de manifestações por tipo de Subcategorias - 10 Principais manifestações ' || chr(10) || '{two}'"),
        ]
    return f"{WITH_CASES} " + " UNION ALL ".join(
        f"SELECT '{sheet}' AS sheet, {name} || ' ' || chr(10) || {text} AS caption" for sheet, text in rows
    )


COMPLAINTS = f"{COMPLAINT} AND {PERIOD}"
REASON_TOP = with_remainder("reason", "reason", COMPLAINTS)
REASON_ORDER = "ORDER BY bucket, total DESC, reason ASC NULLS FIRST"

ORACLE: dict[str, str] = {
    "scan_cases": select(f"{RAW}, channel"),
    "scope_filter": select(RAW, DIGITAL),
    "scope_label": SCOPE_LABEL,
    "report_long": summary_pack(),
    "report_manifest": f"""
        SELECT e.sheet, coalesce(c.n, 0) AS rows,
               CASE WHEN c.n > 0 THEN 'written' WHEN e.optional THEN 'skipped' ELSE 'empty' END AS state
        FROM (VALUES ('channel_evolution', TRUE), ('type_breakdown', FALSE), ('type_breakdown_first', FALSE),
                     ('type_breakdown_last', FALSE), ('subcat2', TRUE), ('complaint_pareto', FALSE)) e(sheet, optional)
        LEFT JOIN (SELECT sheet, count(*) AS n FROM ({summary_pack(title)}) GROUP BY 1) c ON e.sheet = c.sheet""",
    "multi_scope_top": per_scope(lambda where: ranked(SUBCAT2, "subcat2", where)),
    "multi_scope_complaints": per_scope(lambda where: pareto("reason", f"{COMPLAINT} AND {where}")),
    "multi_scope_types": per_scope(breakdown),
    "multi_scope_total": many_scope_totals(),
    "multi_scope_total_by_case": many_scope_totals(),
    "month_start": """
        SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', l_shipdate) AS date) AS month,
               CAST(date_trunc('month', l_shipdate) AS date) AS parsed FROM lineitem""",
    "filter_month_range": select(RAW, PERIOD),
    "filter_single_month": select(RAW, LAST),
    "filter_optional_range": f"""
        {WITH_CASES} SELECT month, count(*) AS total, 'open' AS part FROM cases GROUP BY 1
        UNION ALL SELECT month, count(*), 'closed' FROM cases WHERE {PERIOD} GROUP BY 1""",
    "filter_type_eq": select(RAW, COMPLAINT),
    "filter_type_ne": select(RAW, OTHER),
    "filter_in": select(RAW, "case_group IN ('R')"),
    "filter_not_in": select(RAW, "case_group NOT IN ('R')"),
    "drop_null_rows": select(RAW, "brand IS NOT NULL AND subcat2 IS NOT NULL"),
    "having_drop_group": f"{count('case_group', 'case_group', PERIOD)} HAVING case_group <> 'R' OR case_group IS NULL",
    "full_join_months": channels(),
    "anti_join_null_aware": f"""
        WITH counted AS ({count('reason', 'reason', COMPLAINTS)})
        SELECT * FROM counted WHERE reason NOT IN
            (SELECT reason FROM counted ORDER BY total DESC, reason ASC NULLS FIRST LIMIT 10)""",
    "anti_join_sum": f"""
        WITH counted AS ({count('subcat2', 'subcat2', PERIOD)}),
        best AS (SELECT subcat2 FROM counted ORDER BY total DESC, subcat2 ASC NULLS FIRST LIMIT 10)
        SELECT 'with null' AS subcat2, CAST(sum(total) AS BIGINT) AS total FROM counted
        WHERE subcat2 NOT IN (SELECT subcat2 FROM best)
        UNION ALL
        SELECT 'without null', CAST(sum(total) AS BIGINT) FROM counted
        WHERE subcat2 NOT IN (SELECT subcat2 FROM best WHERE subcat2 IS NOT NULL)""",
    "lookup_default": f"""
        WITH counted AS ({count(TYPE_REASON, 'label', PERIOD)})
        SELECT label, total, split_part(label, ' - ', 1) AS prefix,
               CASE WHEN label < '4' THEN '#' || label[1] ELSE '#other' END AS colour FROM counted""",
    "count_by_month": count("month", "month"),
    "count_by_type": count("case_type", "case_type"),
    "count_by_label": count(FOLDED, "label", PERIOD),
    "count_constant_label": f"""
        {WITH_CASES} SELECT 'MENTIONS' AS case_type, count(*) AS total FROM cases
        WHERE {PERIOD} AND case_type = '5-LOW' AND case_group = 'R'""",
    "global_sum": select("count(*) AS total", PERIOD),
    "grand_total": f"SELECT CAST(sum(traditional) + sum(digital) AS BIGINT) AS grand_total FROM ({channels()})",
    "distinct_brands": select("DISTINCT brand", "brand IS NOT NULL"),
    "brand_list": f"""
        {WITH_CASES} SELECT string_agg(name, ', ' ORDER BY CASE WHEN name = 'Unidentified' THEN 1 ELSE 0 END, name) AS brands
        FROM (SELECT DISTINCT {SHOWN_BRAND} AS name FROM cases WHERE brand IS NOT NULL)""",
    "pivot_brand": wide("subcat1", "brand", BRANDS, PERIOD),
    "top10_reasons": top("reason", "reason", COMPLAINTS),
    "top10_with_remainder": REASON_TOP,
    "top10_null_among": with_remainder("subcat2", "subcat2", PERIOD),
    "top10_null_outside": with_remainder("variant", "variant", PERIOD, 3),
    "pareto_share": f"""
        SELECT reason, total, bucket,
               CAST(sum(total) OVER ({REASON_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
               / CAST(sum(total) OVER () AS DOUBLE) AS cum_share
        FROM ({REASON_TOP})""",
    "share_of_total": f"""
        SELECT case_type, total, CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS share
        FROM ({count('case_type', 'case_type', PERIOD)})""",
    "row_numbers": f"""
        SELECT subcat2, total, bucket,
               CAST(row_number() OVER (ORDER BY bucket, total DESC, subcat2) AS INTEGER) AS rank
        FROM ({with_remainder('subcat2', 'subcat2', PERIOD)}) WHERE subcat2 IS NOT NULL""",
    "explicit_order": f"""
        SELECT case_type, total, CAST({TYPE_RANK} AS INTEGER) AS rank
        FROM ({count('case_type', 'case_type', PERIOD)})""",
    "remainder_last": f"SELECT reason, total, CAST(reason = 'remainder' AS INTEGER) AS bucket FROM ({REASON_TOP})",
    "pivot_sorted": placed(wide("subcat1", "brand", BRANDS, PERIOD), BRANDS[1], "subcat1"),
    "union_all_parts": type_parts(PERIOD),
    "present_categories": f"""
        SELECT DISTINCT case_type, CAST({TYPE_RANK} AS INTEGER) AS rank
        FROM ({select('case_type', PERIOD)}) WHERE {TYPE_RANK} IS NOT NULL""",
    "label_reason": select(f"month, case_group, reason, {FOLDED} AS label"),
    "label_default": select(f"month, subcat2, {SUBCAT2} AS label"),
    "label_brand": select(f"month, brand, {SHOWN_BRAND} AS label"),
    "label_line_variant": select(f"month, line, variant, {LINE_VARIANT} AS label"),
    "label_type_reason": select(f"month, case_type, reason, {TYPE_REASON} AS label"),
    "title_case": f"SELECT p_partkey, {title(PART_TEXT)} AS label FROM part",
    "capitalize": f"SELECT p_partkey, {capital(PART_TEXT)} AS label FROM part",
    "strip_brackets": f"SELECT scope_id, {STRIPPED} AS label FROM ({CATALOGUE})",
    "month_label": f"""
        SELECT l_orderkey, l_linenumber, {month_text('l_shipdate')} AS short,
               {month_text('l_shipdate', '%Y', upper=True)} AS long FROM lineitem""",
    "coerce_numeric": f"""
        SELECT l_orderkey, l_linenumber, TRY_CAST(NULLIF({TEXT_NUMBER}, '#NÚM!') AS DOUBLE) AS number FROM lineitem""",
    "series_label": f"""
        WITH months AS ({channels()})
        SELECT 'traditional' AS series, CAST(sum(traditional) AS BIGINT) AS total,
               'Tradicionais = ' || CAST(sum(traditional) AS BIGINT) AS series_label FROM months
        UNION ALL
        SELECT 'digital', CAST(sum(digital) AS BIGINT), 'Digitais = ' || CAST(sum(digital) AS BIGINT) FROM months""",
    "report_caption": captions(),
    "r_channel_evolution": channel_report(),
    "r_total_cases": select("count(*) AS total", PERIOD),
    "r_report_pack": full_pack(),
    "r_report_pack_per_key_set": full_pack(),
    "r_report_pack_one_pass": full_pack(),
    "r_report_pack_given_brands": full_pack(),
    "r_report_pack_captions": pack_captions(),
    "report_attributes": f"""
        SELECT label, CASE WHEN {TYPE_RANK.replace('case_type', 'label')} IS NOT NULL THEN
               list_extract(['#FFD700', '#70AD47', '#5B9BD5', 'red', 'F4A460'], {TYPE_RANK.replace('case_type', 'label')}) END AS colour
        FROM (SELECT case_type AS label FROM ({breakdown(PERIOD)}))
        UNION ALL
        SELECT reason, CASE lower(split_part(reason, ' - ', 1)) WHEN '2-high' THEN '#22' WHEN '5-low' THEN '#55' ELSE '#00' END
        FROM ({pareto(TYPE_REASON, f"{OTHER} AND {PERIOD}")})""",
    "read_cases_timestamp_day": """
        SELECT l_returnflag AS case_type, count(*) AS total FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
          AND l_shipdate + to_hours(3 * l_linenumber) < DATE '1997-01-01' GROUP BY 1""",
    "read_cases_mid_month": """
        SELECT CAST(date_trunc('month', l_shipdate) AS date) AS month, count(*) AS total FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1""",
    "scopes_from_table": many_scope_totals(),
    "pivot_special_names": f"""
        {WITH_CASES} SELECT subcat1 AS "subcat1_", count(*) FILTER (WHERE brand = 'Brand#11') AS "Dr.Oetker",
               count(*) FILTER (WHERE brand = 'Brand#12') AS "a`b", count(*) FILTER (WHERE brand = 'Brand#14') AS "EMPTY",
               count(*) FILTER (WHERE brand = 'Brand#15') AS "subcat1"
        FROM cases WHERE {PERIOD} GROUP BY 1""",
    "r_report_pack_direct": full_pack(),
    "r_report_packs": " UNION ALL ".join(
        f"SELECT {scope_id} AS scope_id, * FROM ({full_pack(where)})" for scope_id, where in SCOPES.items()
    ),
    "r_type_breakdown": breakdown(PERIOD),
    "r_type_breakdown_last": breakdown(LAST),
    "r_type_breakdown_first": breakdown(FIRST),
    "r_type_breakdown_unknown": breakdown(
        PERIOD,
        extra=f"""
            UNION ALL SELECT 'NO GROUP', count(*) FROM chosen
            WHERE case_type = '5-LOW' AND case_group IS NULL GROUP BY case_type""",
    ),
    "r_complaint_pareto": pareto("reason", COMPLAINTS),
    "r_complaint_pareto_last": pareto("reason", f"{COMPLAINT} AND {LAST}"),
    "r_other_pareto": pareto(TYPE_REASON, f"{OTHER} AND {PERIOD}"),
    "r_other_pareto_last": pareto(TYPE_REASON, f"{OTHER} AND {LAST}"),
    "r_category_brand": placed(category(PERIOD), SHOWN_BRANDS[0], "category"),
    "r_category_brand_last": placed(category(LAST), SHOWN_BRANDS[0], "category"),
    "r_category_brand_long": category_long(PERIOD),
    "r_top_line_variant": ranked(LINE_VARIANT, "line_variant", PERIOD),
    "r_top_line_variant_last": ranked(LINE_VARIANT, "line_variant", LAST),
    "r_top_subcat2": ranked(SUBCAT2, "subcat2", PERIOD),
    "r_top_subcat2_last": ranked(SUBCAT2, "subcat2", LAST),
    "top_n_two_phase": f"""
        SELECT * FROM (SELECT *, 'frequent' AS part FROM ({top('lower(rtrim(reason))', 'label', 'TRUE')}))
        UNION ALL
        SELECT * FROM (SELECT CAST(l_orderkey AS varchar) AS label, count(*) AS total, 'flat' AS part FROM lineitem
                       GROUP BY 1 ORDER BY total DESC, label LIMIT 10)""",
    "pareto_all_reasons": pareto_classes(count("reason", "reason", PERIOD), "reason"),
    "pareto_all_suppliers": pareto_classes(
        "SELECT CASE WHEN l_linestatus = 'O' THEN 'digital' ELSE 'traditional' END AS channel, l_suppkey AS supplier, count(*) AS total FROM lineitem GROUP BY 1, 2",
        "supplier",
        "channel",
    ),
    "r_pack_from_months": full_pack(),
    "brands_maintained": " UNION ALL ".join(
        f"SELECT {scope_id} AS scope_id, * FROM ({select('brand, min(month) AS first_month, max(month) AS last_month', f'{where} AND brand IS NOT NULL GROUP BY brand')})"
        for scope_id, where in SCOPES.items()
    ),
    "r_category_brand_kept": category_long(PERIOD),
    "multi_scope_from_months": many_scopes_by_rule(100),
    "multi_scope_2000": many_scopes_by_rule(2000),
    "scope_path": SCOPE_PATH,
    "filter_type_padded": select(RAW.replace("case_type", f"{PADDED} AS case_type"), COMPLAINT),
    "count_by_padded": f"""
        SELECT min(case_type) AS case_type, count(*) AS total FROM ({select(f'{PADDED} AS case_type')}) GROUP BY lower(rtrim(case_type))""",
    "read_cases_text_months": """
        SELECT CASE WHEN l_linenumber < 6 THEN CAST(date_trunc('month', l_shipdate) AS date) END AS month, count(*) AS total
        FROM lineitem WHERE l_linenumber <> 6 GROUP BY 1""",
    "bad_months": """
        SELECT 'n/a ' || l_returnflag AS bad_month, count(*) AS total FROM lineitem WHERE l_linenumber = 6 GROUP BY 1""",
    "pivot_as_map": f"""
        SELECT subcat1, coalesce(string_agg(brand || '=' || n, ',' ORDER BY brand) FILTER (brand IS NOT NULL), '') AS cells
        FROM ({select('subcat1, brand, count(*) AS n', f'{PERIOD} GROUP BY 1, 2')}) GROUP BY 1""",
    "report_published": summary_pack(),
}
