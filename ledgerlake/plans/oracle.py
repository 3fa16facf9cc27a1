"""Equivalent SQL per query, for DuckDB on the same Parquet tables.

The text is written from the definitions, not generated from the Spark plans: formulas and rules are stated
again here, so an error on one side shows.
"""

from __future__ import annotations

from ledgerlake.functions.expansion import EXPANSIONS, STATEMENT_HINTS
from ledgerlake.functions.ontology import ALIASES, CONCEPTS, METRICS
from ledgerlake.plans.queries import AVERAGED, DIRECT, LEVERAGE_CASH, LIQUIDITY, PROFIT, SPECIAL
from ledgerlake.sources.asked import PER_FILER, WORDINGS
from ledgerlake.sources.filings import PRINTED, UNTAGGED

# --- facts from the sales tables

LINES = """
li AS (SELECT CAST(o_custkey AS VARCHAR) fid, CAST(year(o_orderdate) AS INTEGER) fy, l_suppkey, p_type, p_size,
         l_returnflag rf, l_linestatus ls, CAST(round(l_extendedprice * 100) AS BIGINT) price,
         CAST(round(l_discount * 100) AS BIGINT) disc, CAST(round(l_tax * 100) AS BIGINT) tp,
         CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) cost
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
l AS (SELECT *, (price * (100 - disc) + 50) // 100 rev FROM li)"""

YEARS = LINES + """,
yl AS (SELECT fid, fy, sum(rev) rev, sum(cost) cogs, sum((rev * tp) // 100) tax, sum((price * disc) // 100) sga,
         sum(price // 20) FILTER (rf = 'R') rnd, sum(price // 50) FILTER (rf = 'A') interest,
         sum(price // 100) FILTER (rf = 'R' AND ls = 'F') restructuring, sum(cost) FILTER (ls = 'O') inventory,
         sum(cost) FILTER (p_size >= 26) ppe, sum(cost // 2) FILTER (ls = 'F') ltd,
         sum(cost // 10) FILTER (ls = 'F' AND rf = 'A') std, sum(price // 10) FILTER (ls = 'O' AND rf = 'N') sti,
         sum(price // 10) FILTER (p_size >= 45) capex, sum(cost // 10) FILTER (p_size >= 26) dep,
         sum(rev // 40) FILTER (rf = 'N') dividends FROM l GROUP BY ALL),
yo AS (SELECT CAST(o_custkey AS VARCHAR) fid, CAST(year(o_orderdate) AS INTEGER) fy,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'O') receivables,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'F') cash,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'P') payables
       FROM orders GROUP BY ALL),
y AS (SELECT yl.fid, yl.fy, """ + ", ".join(
    f"CAST(coalesce({c}, 0) AS DOUBLE) {c}" for c in
    "rev cogs tax sga rnd interest restructuring inventory ppe ltd std sti capex dep dividends receivables cash payables".split()
) + " FROM yl JOIN yo USING (fid, fy))"

# What each concept is, in cents, and the page of its statement.
CENTS = {
    5: {"revenue": "rev", "cogs": "cogs", "gross_profit": "rev-cogs", "operating_income": "rev-cogs-sga-rnd",
        "pretax_income": "rev-cogs-sga-rnd-interest", "tax_expense": "tax",
        "net_income": "rev-cogs-sga-rnd-interest-tax", "interest_expense": "interest", "rnd": "rnd", "sga": "sga",
        "restructuring": "restructuring"},
    6: {"assets": "cash+receivables+inventory+ppe", "assets_current": "cash+receivables+inventory",
        "liabilities": "payables+tax+ltd", "liabilities_current": "payables+tax", "cash": "cash",
        "short_term_investments": "sti", "inventory": "inventory", "receivables": "receivables",
        "payables": "payables", "ppe_net": "ppe", "equity": "cash+receivables+inventory+ppe-payables-tax-ltd",
        "debt_long_term": "ltd", "debt_short_term": "std",
        "retained_earnings": "rev-cogs-sga-rnd-interest-tax-dividends"},
    7: {"capex": "-capex", "ocf": "rev-cogs-sga-rnd-interest-tax+dep", "depreciation_amortization": "dep",
        "dividends_paid": "-dividends", "icf": "-capex", "financing_cf": "-dividends-std"},
}
_UNIONS = " UNION ALL ".join(
    f"SELECT fid, fy, '{c}' c, ({e}) / 100 v, {page} page FROM y" for page, cs in CENTS.items() for c, e in cs.items()
)
FACTS = YEARS + f",\nf AS (SELECT * FROM ({_UNIONS}) WHERE v <> 0)"

_MEMBER_TAIL = """,
m0 AS (SELECT fid, fy, 'co:' || upper(p_type[1]) || lower(p_type[2:]) || 'GoodsSegmentMember' seg,
         'co:' || list_aggregate(list_transform(string_split(r_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') || 'Member' geo,
         rev, cost FROM l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey),
m1 AS (SELECT fid, fy, 'us-gaap:StatementBusinessSegmentsAxis' axis, seg member, sum(rev) r, sum(cost) k FROM m0 GROUP BY ALL
       UNION ALL SELECT fid, fy, 'us-gaap:StatementGeographicalAxis', geo, sum(rev), sum(cost) FROM m0 GROUP BY ALL),
m AS (SELECT fid, fy, axis, member, 'revenue' c, CAST(r AS DOUBLE) / 100 v FROM m1
      UNION ALL SELECT fid, fy, axis, member, 'cogs', CAST(k AS DOUBLE) / 100 FROM m1)"""

MEMBERS = LINES + _MEMBER_TAIL

# Facts as a filing's reader sees them: untagged rows pair the i-th printed figure with the i-th year of the page.
_UNTAGGED = ", ".join(f"'{c}'" for c in UNTAGGED)
READ = FACTS + f""",
ylist AS (SELECT fid, fy, row_number() OVER (PARTITION BY fid ORDER BY fy DESC) n FROM (SELECT DISTINCT fid, fy FROM f)),
un AS (SELECT fid, c, v, page, row_number() OVER (PARTITION BY fid, c ORDER BY fy DESC) n FROM f WHERE c IN ({_UNTAGGED})),
g AS (SELECT fid, fy, c, v, page FROM f WHERE c NOT IN ({_UNTAGGED})
      UNION ALL SELECT un.fid, ylist.fy, c, v, page FROM un JOIN ylist USING (fid, n))"""


def wide(source: str, spine: bool = False) -> str:
    """CTEs from long facts to one row per year with the figure used (u_), its opening value (o_) and shift (s_)."""
    cols = [c for cs in CENTS.values() for c in cs]
    pivot = ", ".join(f"max(v) FILTER (c = '{c}') {c}" for c in cols)
    years = f"SELECT DISTINCT fid, fy FROM {source}"
    if spine:
        years = f"SELECT DISTINCT fid, fy + d fy FROM {source}, (VALUES (-1), (0), (1)) t(d)"
    used = ", ".join(
        f"coalesce(a.{c}, b.{c}, p.{c}) {c}, CASE WHEN a.{c} IS NOT NULL THEN p.{c} WHEN b.{c} IS NULL THEN q.{c} END o_{c}, "
        f"(a.{c} IS NULL AND coalesce(b.{c}, p.{c}) IS NOT NULL) s_{c}" for c in cols
    )
    return f""",
ys AS ({years}), pv AS (SELECT fid, fy, {pivot} FROM {source} GROUP BY fid, fy),
w0 AS (SELECT ys.fid, ys.fy, {used} FROM ys LEFT JOIN pv a ON a.fid = ys.fid AND a.fy = ys.fy
  LEFT JOIN pv b ON b.fid = ys.fid AND b.fy = ys.fy + 1 LEFT JOIN pv p ON p.fid = ys.fid AND p.fy = ys.fy - 1
  LEFT JOIN pv q ON q.fid = ys.fid AND q.fy = ys.fy - 2),
w AS (SELECT *, {", ".join(f"({c} + o_{c}) / 2 a_{c}" for c in cols)} FROM w0)"""


def _d(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


_EBITDA = "operating_income + depreciation_amortization"
FORMULAS = {
    "total_debt": "debt_long_term + coalesce(debt_short_term, 0)",
    "net_debt": "debt_long_term + coalesce(debt_short_term, 0) - cash",
    "debt_to_equity": _d("debt_long_term", "equity"),
    "debt_to_assets": _d("debt_long_term + coalesce(debt_short_term, 0)", "assets"),
    "debt_to_ebitda": _d("debt_long_term + coalesce(debt_short_term, 0)", _EBITDA),
    "interest_coverage": _d("operating_income", "abs(interest_expense)"),
    "free_cash_flow": "ocf - abs(capex)",
    "ebitda_less_capex": f"{_EBITDA} - abs(capex)",
    "dividend_payout_ratio": _d("abs(dividends_paid)", "net_income"),
    "retention_ratio": "1 - " + _d("abs(dividends_paid)", "net_income"),
    "working_capital": "assets_current - liabilities_current",
    "current_ratio": _d("assets_current", "liabilities_current"),
    "quick_ratio": _d("cash + coalesce(short_term_investments, 0) + receivables", "liabilities_current"),
    "cash_ratio": _d("cash + coalesce(short_term_investments, 0)", "liabilities_current"),
    "ocf_ratio": _d("ocf", "liabilities_current"),
    "gross_margin": _d("gross_profit", "revenue"), "cogs_margin": _d("cogs", "revenue"),
    "operating_margin": _d("operating_income", "revenue"), "net_margin": _d("net_income", "revenue"),
    "ebitda": _EBITDA, "ebitda_margin": _d(_EBITDA, "revenue"), "dna_margin": _d("depreciation_amortization", "revenue"),
    "rnd_margin": _d("rnd", "revenue"), "sga_margin": _d("sga", "revenue"),
    "effective_tax_rate": _d("tax_expense", "pretax_income"),
    "fcf_margin": _d("ocf - abs(capex)", "revenue"), "fcf_conversion": _d("ocf - abs(capex)", _EBITDA),
    "capital_intensity": _d("abs(capex)", "revenue"),
    "fixed_asset_turnover": _d("revenue", "a_ppe_net"), "asset_turnover": _d("revenue", "a_assets"),
    "inventory_turnover": _d("cogs", "a_inventory"), "days_inventory": _d("a_inventory * 365", "cogs"),
    "dso": _d("a_receivables * 365", "revenue"), "dpo": _d("a_payables * 365", "cogs"),
    "roa": _d("net_income", "a_assets"), "roe": _d("net_income", "a_equity"),
    "dpo_inventory_adjusted": _d("a_payables * 365", "cogs + (inventory - o_inventory)"),
    "cash_conversion_cycle": f"coalesce({_d('a_inventory * 365', 'cogs')}, CASE WHEN a_inventory IS NOT NULL AND cogs IS NOT NULL THEN 0 END)"
                             f" + coalesce({_d('a_receivables * 365', 'revenue')}, CASE WHEN a_receivables IS NOT NULL AND revenue IS NOT NULL THEN 0 END)"
                             f" - coalesce({_d('a_payables * 365', 'cogs')}, CASE WHEN a_payables IS NOT NULL AND cogs IS NOT NULL THEN 0 END)",
    "roic": _d(f"operating_income * (1 - {_d('tax_expense', 'pretax_income')})", "debt_long_term + equity - cash"),
}
_REPORTED = {c for cs in CENTS.values() for c in cs}
for _c in DIRECT:
    _base = _c if _c in _REPORTED else "CAST(NULL AS DOUBLE)"
    FORMULAS[_c] = f"abs({_base})" if _c in ("capex", "dividends_paid", "interest_expense", "restructuring") else _base


def metric_cte(keys: list[str], source: str = "f", spine: bool = False) -> str:
    parts = " UNION ALL ".join(
        f"SELECT fid, fy, '{k}' metric, CAST({FORMULAS[k]} AS DOUBLE) v, "
        + ("(" + " OR ".join(f"coalesce(s_{c}, false)" for c in METRICS[k].inputs if c in _REPORTED) + ")"
           if any(c in _REPORTED for c in METRICS[k].inputs) else "false")
        + " mixed FROM w" for k in keys
    )
    return wide(source, spine) + f",\nmt AS (SELECT * FROM ({parts}) WHERE v IS NOT NULL)"


def _metrics(keys: list[str]) -> str:
    return f"WITH {FACTS}{metric_cte(keys)} SELECT fid filing_id, fy fiscal_year, metric, round(v, 6) AS value FROM mt"


SQL: dict[str, str] = {
    "facts_consolidated": f"WITH {FACTS} SELECT fid filing_id, c concept_key, fy fiscal_year, v AS value, page FROM f",
    "facts_latest": f"WITH {FACTS} SELECT fid filing_id, c concept_key, max(fy) fiscal_year, arg_max(v, fy) AS value FROM f GROUP BY fid, c",
    "facts_prior_year": f"""WITH {FACTS} SELECT fid filing_id, c concept_key, fy fiscal_year, v AS value,
            CASE WHEN lag(fy) OVER w = fy - 1 THEN lag(v) OVER w END prior_value
        FROM f WINDOW w AS (PARTITION BY fid, c ORDER BY fy)""",
    "facts_by_segment": f"WITH {MEMBERS} SELECT fid filing_id, c concept_key, fy fiscal_year, member, v AS value FROM m WHERE axis LIKE '%BusinessSegments%'",
    "facts_by_geography": f"WITH {MEMBERS} SELECT fid filing_id, c concept_key, fy fiscal_year, member, v AS value FROM m WHERE axis LIKE '%Geographical%'",
    "filing_years": f"""WITH {FACTS} SELECT fid filing_id, count(*) n_facts, count(DISTINCT c) n_concepts,
        (SELECT string_agg(CAST(fy AS VARCHAR), ',' ORDER BY fy DESC) FROM (SELECT DISTINCT fy FROM f g WHERE g.fid = f.fid)) "years" FROM f GROUP BY fid""",
    "metric_direct": _metrics(DIRECT),
    "metric_profit": _metrics(PROFIT),
    "metric_liquidity": _metrics(LIQUIDITY),
    "metric_leverage_cash": _metrics(LEVERAGE_CASH),
    "metric_averaged": _metrics(AVERAGED),
    "metric_special": _metrics(SPECIAL),
    "metric_neighbour_year": f"""WITH {FACTS}{metric_cte(["gross_margin", "current_ratio", "dso", "capital_intensity"], spine=True)}
        SELECT fid filing_id, fy fiscal_year, metric, round(v, 6) AS value, mixed mixed_years FROM mt""",
    "metric_change": f"""WITH {FACTS}{metric_cte(["revenue", "net_income", "gross_margin", "capex"])},
        e AS (SELECT fid, metric, count(*) n, min(fy) y0, max(fy) y1, arg_min(v, fy) a, arg_max(v, fy) b, avg(v) mean FROM mt GROUP BY fid, metric)
        SELECT fid filing_id, metric, n n_years, y0 first_year, y1 last_year, round(b - a, 6) change,
          round((b - a) / nullif(abs(a), 0) * 100, 6) change_pct,
          round(CASE WHEN b / nullif(a, 0) >= 0 AND y1 > y0 THEN pow(b / a, 1.0 / (y1 - y0)) - 1 END, 6) cagr,
          CASE WHEN b > a THEN 'increased' WHEN b < a THEN 'decreased' ELSE 'was unchanged' END direction, round(mean, 6) mean_value
        FROM e WHERE n >= 2""",
    "activity_top": f"""WITH {FACTS}{metric_cte(["ocf", "icf", "financing_cf"])}
        SELECT fid filing_id, fy fiscal_year, CASE arg_max(metric, v) WHEN 'ocf' THEN 'operating' WHEN 'icf' THEN 'investing' ELSE 'financing' END activity,
          round(max(v), 6) AS value FROM mt GROUP BY fid, fy HAVING count(*) >= 2""",
    "figure_forms": f"""WITH {FACTS}, k AS (SELECT fid, c, fy, v, abs(v) s FROM f),
        t AS (SELECT *, list_distinct(list_filter([CASE WHEN s >= 1e6 THEN format('{{:,.0f}}', s/1e6) END, CASE WHEN s >= 1e6 THEN format('{{:,.1f}}', s/1e6) END,
          CASE WHEN s >= 1e6 THEN format('{{:,.2f}}', s/1e6) END, CASE WHEN s >= 1e3 THEN format('{{:,.0f}}', s/1e3) END,
          CASE WHEN s >= 1e3 THEN format('{{:,.1f}}', s/1e3) END, CASE WHEN s >= 1e3 THEN format('{{:,.2f}}', s/1e3) END,
          CASE WHEN s >= 1 THEN format('{{:,.0f}}', s) END, CASE WHEN s >= 1 THEN format('{{:,.1f}}', s) END,
          CASE WHEN s >= 1 THEN format('{{:,.2f}}', s) END], lambda x: x IS NOT NULL)) forms FROM k)
        SELECT fid filing_id, c concept_key, fy fiscal_year, len(forms) n_forms,
          CASE WHEN s >= 1 THEN format('{{:,.2f}}', s) END longest FROM t""",
}


def _ranked(axis: str, order: str) -> str:
    name = r"trim(regexp_replace(regexp_replace(regexp_replace(member, '^[^:]*:', ''), '(Segment)?Member$', ''), '([a-z])([A-Z])', '\1 \2', 'g'))"
    return f"""WITH {MEMBERS}, r AS (SELECT *, count(*) OVER g n, row_number() OVER (PARTITION BY fid, c, fy ORDER BY v {order}) k
        FROM m WHERE axis LIKE '%{axis}%' WINDOW g AS (PARTITION BY fid, c, fy))
        SELECT fid filing_id, c concept_key, fy fiscal_year, {name} "name", v AS value, n n_members FROM r WHERE n >= 2 AND k = 1"""


SQL["segment_top"] = _ranked("BusinessSegments", "DESC")
SQL["geography_bottom"] = _ranked("Geographical", "ASC")

# --- rendered filings read back

_INCOME_TAGGED = ", ".join(f"'{c}'" for c in CENTS[5] if c not in UNTAGGED)
SQL["xbrl_facts"] = f"""WITH {FACTS}{_MEMBER_TAIL},
    t AS (SELECT * FROM f WHERE c NOT IN ({_UNTAGGED})),
    newest AS (SELECT fid, c, max(fy) fy FROM f GROUP BY fid, c)
    SELECT fid filing_id, c concept_key, v AS value, fy fiscal_year, page, page = 6 instant, '' member, '' axis FROM t
    UNION ALL SELECT fid, c, v, fy, 4, false, '', '' FROM t JOIN newest USING (fid, c, fy) WHERE page = 5
    UNION ALL SELECT fid, c, v, fy, 9, false, member, axis FROM m WHERE v <> 0"""
_TAGS = ", ".join(f"('{c}', '{tag}')" for c, (_, tag) in PRINTED.items() if tag)
SQL["concept_pages_tagged"] = f"""WITH {FACTS}, tg(c, tag) AS (VALUES {_TAGS}),
    p AS (SELECT fid, tag, page FROM f JOIN tg USING (c)
          UNION SELECT fid, tag, 4 FROM f JOIN tg USING (c) WHERE page = 5 UNION SELECT fid, tag, 9 FROM f JOIN tg USING (c) WHERE c IN ('revenue', 'cogs'))
    SELECT fid filing_id, tag, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) pages FROM p GROUP BY fid, tag"""
# A row of a statement gives its figures to the newest years in turn, so a figure behind a missing year moves one year on.
SQL["statement_facts"] = f"""WITH {FACTS}, ylist AS (SELECT fid, fy, row_number() OVER (PARTITION BY fid ORDER BY fy DESC) n FROM (SELECT DISTINCT fid, fy FROM f)),
    r AS (SELECT fid, c, v, page, row_number() OVER (PARTITION BY fid, c ORDER BY fy DESC) n FROM f)
    SELECT fid filing_id, c concept_key, fy fiscal_year, v AS value, page FROM r JOIN ylist USING (fid, n)"""
SQL["facts_combined"] = f"""WITH {READ}, newest AS (SELECT fid, c, max(fy) fy FROM f GROUP BY fid, c)
    SELECT g.fid filing_id, g.c concept_key, g.fy fiscal_year, v AS value,
      CASE WHEN newest.fy IS NOT NULL AND page = 5 AND g.c NOT IN ({_UNTAGGED}) THEN 4 ELSE page END page
    FROM g LEFT JOIN newest ON newest.fid = g.fid AND newest.c = g.c AND newest.fy = g.fy"""
_FILERS = "(SELECT DISTINCT CAST(o_custkey AS VARCHAR) fid FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
SQL["page_labels"] = f"""SELECT fid filing_id, CAST(p AS INTEGER) page, CASE WHEN p - 2 >= 1 THEN p - 2 ELSE p END "label"
    FROM {_FILERS}, (SELECT unnest(range(1, 11)) p)"""
SQL["section_spans"] = f"""SELECT fid filing_id, item, s start_page, e end_page FROM {_FILERS},
    (VALUES ('1', 3, 3), ('7', 4, 4), ('8', 5, 9), ('9a', 10, 10)) t(item, s, e)"""
SQL["html_text"] = r"""WITH v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
      '<script[^>]*>.*?</script\s*>', '', 'gis'), '<style[^>]*>.*?</style\s*>', '', 'gis'), '<!doctype[^>]*>', '', 'gis') h FROM pages),
    t AS (SELECT page_id, regexp_replace(regexp_replace(h, '<br\s*/?>|<br\s[^>]*>|</(p|div|br|tr|li|h1|h2|h3|h4|h5|h6|section|article|header|footer|blockquote)\s*>', chr(10), 'gi'), '<[^>]*>', '', 'g') x FROM v),
    u AS (SELECT page_id, replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') x FROM t)
    SELECT CAST(page_id AS VARCHAR) filing_id, 1 page, regexp_replace(regexp_replace(regexp_replace(x, '[ \t\xA0]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') page_text FROM u"""
SQL["html_sanitise"] = r"""SELECT CAST(page_id AS VARCHAR) filing_id, 1 page, regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script\s*>', '', 'gis'),
    '</?(meta|link|base|embed|form|iframe|object|applet|script)\b[^>]*>', '', 'gis') page_html FROM pages"""
SQL["charset_decode"] = "SELECT CAST(doc_id AS VARCHAR) filing_id, sha1(text) utf8_sha1, length(replace(text, '€', '')) cp1252_chars FROM documents"
_UPLOADS = """u AS (SELECT doc_id, CASE WHEN source <> 'src0' THEN source END user_id, sha256(text) content_hash, doc_id % 10 = 3 early, doc_id % 20 <> 13 live FROM documents)"""
SQL["dedup_filings"] = f"""WITH {_UPLOADS}, k AS (SELECT user_id, content_hash FROM u WHERE early AND live)
    SELECT min(doc_id) filing_id, user_id, content_hash FROM u WHERE NOT early
      AND NOT EXISTS (SELECT 1 FROM k WHERE k.content_hash = u.content_hash AND k.user_id IS NOT DISTINCT FROM u.user_id) GROUP BY user_id, content_hash"""
SQL["stream_arrivals"] = f"""WITH {_UPLOADS}, c AS (SELECT user_id, content_hash, count(*) FILTER (early AND live) k, count(*) FILTER (NOT early) a FROM u GROUP BY ALL)
    SELECT user_id, content_hash, greatest(k, 1) n FROM c WHERE k > 0 OR a > 0"""
SQL["passage_ids"] = r"""WITH x AS (SELECT CAST(doc_id AS VARCHAR) fid, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 o FROM documents)
    SELECT fid filing_id, o // 10 + 1 page, o ordinal, fid || ':p' || (o // 10 + 1) || ':' || o || ':' || sha1(fid || ':' || (o // 10 + 1) || ':' || o || ':' || t)[1:16] passage_id
    FROM x WHERE trim(t, ' ') <> ''"""
SQL["passage_points"] = r"""WITH x AS (SELECT CAST(doc_id AS VARCHAR) fid, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 o FROM documents),
    h AS (SELECT fid || ':' || o passage_id, sha1(unhex('6f2c9b6e9b3b4b0a9c1a2f7e6a9d4b10') || encode(fid || ':' || o)) h FROM x)
    SELECT passage_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1)
      || substr(h, 18, 3) || '-' || substr(h, 21, 12) point_id FROM h"""
SQL["document_pages"] = r"""WITH x AS (SELECT CAST(doc_id AS VARCHAR) fid, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 o FROM documents),
    y AS (SELECT *, o // 10 + 1 page, contains(t, ' | ') tab FROM x),
    c AS (SELECT fid, page, o, unnest(string_split(t, ' | ')) cell, generate_subscripts(string_split(t, ' | '), 1) - 1 i FROM y WHERE tab),
    r AS (SELECT fid, page, o, i // 8 k, string_agg(cell, ' | ' ORDER BY i) line FROM c GROUP BY ALL),
    b AS (SELECT fid, page, o, chr(10) || chr(10) || '[TABLE]' || chr(10) || string_agg(line, chr(10) ORDER BY k) block FROM r GROUP BY ALL),
    tb AS (SELECT fid, page, string_agg(block, '' ORDER BY o) blocks FROM b GROUP BY ALL),
    pr AS (SELECT fid, page, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY o) FILTER (NOT tab), '') prose FROM y GROUP BY ALL)
    SELECT fid filing_id, page, sha1(prose || coalesce(blocks, '')) text_sha1 FROM pr LEFT JOIN tb USING (fid, page)"""

# --- questions

_W = ", ".join("'" + w.replace("'", "''") + "'" for w in WORDINGS)
ASKED = f"""
wl AS (SELECT [{_W}] w),
q0 AS (SELECT c_custkey, c_name, unnest(range({PER_FILER})) k FROM customer),
q AS (SELECT CAST(c_custkey AS VARCHAR) || '-' || k question_id, CAST(c_custkey AS VARCHAR) filing_id,
        replace(replace(replace(w[1 + (c_custkey * {PER_FILER} + k) % {len(WORDINGS)}], '{{n}}', c_name), '{{y}}', CAST(1995 + (c_custkey + k) % 6 AS VARCHAR)),
          '{{z}}', CAST(1997 + (c_custkey + k) % 6 AS VARCHAR)) question FROM q0, wl),
qf AS (SELECT *, regexp_replace(regexp_replace(lower(question), '\\s*&\\s*', ' and ', 'g'), '\\s+', ' ', 'g') form,
         regexp_replace(lower(question), '\\s+', ' ', 'g') raw FROM q),
qa AS (SELECT *, regexp_replace(form, '(is defined as|\\bdefined as\\b|\\bcalculated as\\b|\\bdefine[ds]?\\b).*$', '', 's') ask,
         regexp_extract(question, '(?i:(?:is\\s+)?(?:defined|calculated|computed)\\s+as\\s*:?\\s*)(.+)', 1) clause FROM qf)"""


_PAGE_TEXT = SQL["document_pages"].replace("sha1(", "(", 1)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_AL = ", ".join(f"({_quote(a)}, '{k}', {str(METRICS[k].derived).lower()}, {i})" for i, (a, k) in enumerate(ALIASES))
_IN = ", ".join(f"('{m.key}', '{c}')" for m in METRICS.values() for c in m.inputs)
NAMED = ASKED + f""",
al(a, k, derived, i) AS (VALUES {_AL}),
hit AS (SELECT question_id, k, row_number() OVER (PARTITION BY question_id ORDER BY derived DESC, length(a) DESC, i) n
        FROM qa JOIN al ON contains(form, a) OR contains(raw, a)),
nm AS (SELECT qa.*, CASE WHEN regexp_matches(form, '%\\s*margin|\\bmargin\\b|as an? (%|percent|percentage) of (revenue|sales|total revenue)') THEN
          coalesce(CASE k WHEN 'operating_income' THEN 'operating_margin' WHEN 'cogs' THEN 'cogs_margin' WHEN 'net_income' THEN 'net_margin'
          WHEN 'gross_profit' THEN 'gross_margin' WHEN 'ebitda' THEN 'ebitda_margin' WHEN 'depreciation_amortization' THEN 'dna_margin'
          WHEN 'capex' THEN 'capital_intensity' WHEN 'rnd' THEN 'rnd_margin' WHEN 'sga' THEN 'sga_margin' END, k) ELSE k END named
       FROM qa LEFT JOIN (SELECT * FROM hit WHERE n = 1) h USING (question_id)),
nq AS (SELECT *, CASE WHEN named = 'dpo' AND regexp_matches(clause, '(?i)change in inventor(y|ies)') THEN 'dpo_inventory_adjusted' ELSE named END metric,
         string_split(form, '?')[1] upto,
         list_max(list_transform(list_concat(regexp_extract_all(form, '\\b(?:fy|fiscal year|fiscaly|fyear) ?(\\d{{4}})\\b', 1),
           regexp_extract_all(form, '\\bfiscal\\s+(\\d{{4}})\\b', 1), regexp_extract_all(form, '\\b(20\\d{{2}})\\b', 1)), lambda x: CAST(x AS INTEGER))) long_year,
         regexp_extract(form, '\\bfy\\s*(\\d{{2}})\\b', 1) short_year,
         TRY_CAST(regexp_extract(ask, 'fy(\\d{{4}})\\s*(?:-|to|through|and)\\s*fy(\\d{{4}})', 1) AS INTEGER) r0,
         TRY_CAST(regexp_extract(ask, 'fy(\\d{{4}})\\s*(?:-|to|through|and)\\s*fy(\\d{{4}})', 2) AS INTEGER) r1,
         regexp_extract(ask, '\\b(\\d+|two|three|four|five)[- ]year\\b', 1) nyear FROM nm),
qq AS (SELECT *, coalesce(long_year, CASE WHEN short_year <> '' THEN CAST('20' || short_year AS INTEGER) END) AS qyear,
         NOT regexp_matches(form, '\\b(segment|division|geograph\\w*|business unit|region|by country|by product)\\b|\\b(which|what)\\b[^?]*\\b(highest|lowest|largest|smallest|best|worst|most|least|biggest)\\b|\\bexclud\\w+\\b')
         AND NOT regexp_matches(upto, '\\bwhich\\b[^?]*\\b(are|were|is|was)\\b|\\bwho\\b|\\bwhat (are|is) the (major|main|primary|key|nature|purpose|outcome|agenda)\\b|\\bstable trend\\b|\\btrend of\\b|\\bexplain\\b|\\bdescribe\\b|\\bwhy\\b')
         AND (regexp_matches(form, '\\bhow much\\b|\\bhow many\\b|\\bwhat (is|was|are|were)\\b|\\bwhat''?s\\b|\\bcalculate\\b|\\bcompute\\b|\\bamount of\\b|\\bvalue of\\b|\\b(does|did|do|is|was|has|have|had)\\b[^?]*\\b(positive|negative|healthy|improving|higher|lower|increase\\w*|decrease\\w*|grow\\w*|declin\\w*|drop\\w*|capital[- ]intensive)\\b')
              OR len(list_filter(string_split(upto, ' '), lambda x: x <> '')) <= 8) supported,
         CASE WHEN regexp_matches(ask, '\\baverage\\b') AND metric NOT IN ({", ".join(f"'{k}'" for k, m in METRICS.items() if m.averaged)}) AND r0 IS NULL AND nyear <> '' THEN 'average'
              WHEN regexp_matches(ask, '\\baverage\\b') AND metric NOT IN ({", ".join(f"'{k}'" for k, m in METRICS.items() if m.averaged)}) AND r0 IS NOT NULL THEN 'average'
              WHEN regexp_matches(ask, '\\bcagr\\b|\\bcompounded? annual growth\\b') AND r1 > r0 THEN 'cagr'
              WHEN regexp_matches(ask, '\\bchanges?\\b|\\bchanged\\b|\\byear[- ]over[- ]year\\b|\\byoy\\b|\\bby how much\\b|\\bgrowth\\b') AND r1 > r0 THEN 'change'
              WHEN regexp_matches(ask, '\\b(has|did|was|were|is|does)\\b[^?]*\\b(increas|decreas|grow|grew|ris|rose|fall|fell|drop|improv|declin|worsen|expand|shrink)\\w*\\b|\\bcompare[ds]?\\s+(to|with)\\b|\\bversus\\b|\\bvs\\.?\\b|\\bany (drop|increase|change)\\b') THEN 'compare'
              ELSE 'single' END kind FROM nq),
named_in AS (SELECT qa.question_id, k FROM qa JOIN al ON contains(ask, a) WHERE k IN ({", ".join(f"'{k}'" for k in CONCEPTS)})),
stated AS (SELECT qa.question_id, k FROM qa JOIN al ON clause <> '' AND contains(regexp_replace(regexp_replace(lower(clause), '\\s*&\\s*', ' and ', 'g'), '\\s+', ' ', 'g'), a)
           WHERE k IN ({", ".join(f"'{k}'" for k in CONCEPTS)})),
inp(metric, c) AS (VALUES {_IN}),
ref AS (SELECT qq.*, CASE WHEN NOT supported THEN 'not a single-period consolidated metric' WHEN metric IS NULL THEN 'not a recognised metric question'
    WHEN (SELECT count(*) FROM inp WHERE inp.metric = qq.metric) = 1 AND regexp_matches(ask, '\\bdivided by\\b|\\bdivide[sd]?\\b|\\bover\\b|\\bminus\\b|\\bsubtract(ed)?\\b|\\bplus\\b|\\badded to\\b|\\bmultiplied by\\b|\\btimes\\b|\\bas a (%|percent|percentage) of\\b')
      AND (SELECT count(DISTINCT k) FROM named_in n WHERE n.question_id = qq.question_id) > 1 THEN 'the question asks for an expression over several figures, not the value of one of them'
    WHEN EXISTS (SELECT 1 FROM stated s WHERE s.question_id = qq.question_id AND s.k NOT IN (SELECT c FROM inp WHERE inp.metric = qq.metric)) THEN
      'the question defines ' || replace(metric, '_', ' ') || ' differently from the definition this system computes' END refusal FROM qq)"""

_USERS_AL = f"""al(a, k, derived, i) AS (SELECT * FROM (VALUES {_AL}) UNION ALL
    SELECT lower(c_name), ['net_income', 'dso', 'revenue', 'free_cash_flow'][c_custkey % 4 + 1], c_custkey % 4 IN (1, 3), 1000000 FROM customer)"""
SQL["question_metric_users"] = f"WITH {NAMED.replace(f'al(a, k, derived, i) AS (VALUES {_AL})', _USERS_AL)} SELECT question_id, filing_id, question, metric, named FROM qq"
SQL["metric_users"] = f"SELECT * REPLACE ('own_' || metric AS metric) FROM ({_metrics(['dso', 'quick_ratio', 'dpo_inventory_adjusted', 'gross_margin'])})"
SQL["question_metric"] = f"WITH {NAMED} SELECT question_id, filing_id, question, metric, named FROM qq"
SQL["question_year"] = f"WITH {NAMED} SELECT question_id, qyear AS \"year\" FROM qq"
SQL["question_intent"] = f"""WITH {NAMED} SELECT question_id, kind, CASE WHEN r0 IS NOT NULL AND (kind IN ('average', 'single') OR r1 > r0) THEN least(r0, r1) END from_year,
    CASE WHEN r0 IS NOT NULL AND (kind IN ('average', 'single') OR r1 > r0) THEN greatest(r0, r1) END to_year,
    CASE WHEN kind = 'average' AND r0 IS NULL THEN CAST(CASE nyear WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'five' THEN 5 ELSE TRY_CAST(nyear AS INTEGER) END AS INTEGER) END n_back FROM qq"""
SQL["question_section"] = f"""WITH {ASKED} SELECT question_id, CASE
    WHEN regexp_matches(question, '(?i)registered (to trade|pursuant|under)|trading symbol|securities registered|national securities exchange|title of (each )?class') THEN 'cover'
    WHEN regexp_matches(question, '(?i)legal (battle|proceeding|dispute|matter)|litigation|lawsuit|court|settlement') THEN '3'
    WHEN regexp_matches(question, '(?i)risk factor|cyclical|subject to (cyclic|seasonal)|exposure to risk') THEN '1a'
    WHEN regexp_matches(question, '(?i)what drove|driven by|drove (the )?(change|growth|increase|decrease)|management''?s discussion|liquidity and capital|results of operations') THEN '7'
    WHEN regexp_matches(question, '(?i)acquisition|acquired|discontinued operation|spin[- ]?off|divest|separation of|subsequent event|restructuring (liability|charge|cost)|supplemental indenture') THEN '8'
    WHEN regexp_matches(question, '(?i)primary customer|major customer|products and services|major products|what industry|primarily operate|geograph|business segment|competitors?|number of (stores|employees)|key agenda') THEN '1'
    END section FROM qa"""
SQL["section_pages"] = f"""WITH s AS ({SQL["question_section"]}), o AS (SELECT CAST(c_custkey AS VARCHAR) || '-' || k question_id, CAST(c_custkey AS VARCHAR) filing_id
      FROM (SELECT c_custkey, unnest(range({PER_FILER})) k FROM customer)),
    t AS (SELECT * FROM s JOIN o USING (question_id)), p(section, page) AS (VALUES ('1', 3), ('7', 4), ('8', 5), ('8', 6), ('8', 7), ('8', 8), ('8', 9)),
    fl AS (SELECT fid FROM {_FILERS})
    SELECT question_id, filing_id, page FROM t JOIN p USING (section) JOIN fl ON fid = filing_id
    UNION ALL SELECT question_id, filing_id, unnest(CASE WHEN fid IS NULL THEN [1] ELSE [1, 2] END) FROM t LEFT JOIN fl ON fid = filing_id WHERE section = 'cover'"""
SQL["question_flags"] = f"""WITH {NAMED} SELECT question_id, supported,
    regexp_matches(form, '\\b(segments?|divisions?|business units?|reporting units?|geograph\\w*|regions?|country|countries|markets?)\\b')
      AND regexp_matches(form, '\\b(highest|largest|biggest|most|greatest|best|top|lowest|smallest|least|worst)\\b') is_segment,
    regexp_matches(form, '\\bgeograph\\w*|\\bregions?\\b|\\bcountry\\b|\\bcountries\\b') is_geography,
    regexp_matches(form, '\\b(lowest|smallest|least|worst)\\b') wants_lowest,
    len(list_distinct(regexp_extract_all(form, '\\boperations\\b|\\boperating\\b|\\binvesting\\b|\\bfinancing\\b'))) >= 2
      AND regexp_matches(form, '\\b(most|least|highest|lowest|biggest|largest|smallest)\\b') is_activity,
    regexp_matches(form, '\\b(most|least)\\b[^.?]*\\bor\\b[^.?]*\\b(most|least)\\b')
      OR regexp_matches(form, '\\b(most|highest|biggest|largest)\\b') <> regexp_matches(form, '\\b(lost|used|outflow)\\b') wants_highest FROM qq"""
SQL["question_refusal"] = f"WITH {NAMED} SELECT question_id, refusal FROM ref"
SQL["question_route"] = f"""WITH {NAMED}, fl AS (SELECT fid FROM {_FILERS}) SELECT question_id,
    CASE WHEN fid IS NOT NULL AND supported AND named IS NOT NULL THEN 'deterministic' ELSE 'llm' END engine,
    CASE WHEN fid IS NULL THEN 'no structured figures extracted from this filing' WHEN NOT supported THEN 'not a consolidated quantity this system computes'
      WHEN named IS NULL THEN 'no defined metric matches this question' ELSE 'computable from reported figures (' || named || ')' END route_reason
    FROM qq LEFT JOIN fl ON fid = filing_id"""
_EX = ", ".join(f"({_quote(t.replace('&', ' and '))}, {_quote(i)}, {_quote(s)}, {n})" for n, (t, i, s) in enumerate(EXPANSIONS))
_HI = ", ".join(f"({_quote(t.replace('&', ' and '))}, {_quote(s)}, {1000 + n})" for n, (t, s) in enumerate(STATEMENT_HINTS.items()))
SQL["query_expansion"] = f"""WITH {ASKED}, ex(t, items, st, n) AS (VALUES {_EX}), hi(t, st, n) AS (VALUES {_HI}),
    i AS (SELECT question_id, items x, min(n) n FROM qa JOIN ex ON contains(form, t) GROUP BY ALL),
    s AS (SELECT question_id, st x, 2000 + min(n) n FROM (SELECT question_id, st, n FROM qa JOIN ex ON contains(form, t) WHERE st <> ''
          UNION ALL SELECT question_id, st, n FROM qa JOIN hi ON contains(form, t)) GROUP BY ALL),
    a AS (SELECT question_id, string_agg(x, ' ' ORDER BY n) more FROM (SELECT * FROM i UNION ALL SELECT * FROM s) GROUP BY question_id)
    SELECT question_id, question || coalesce(' ' || more, '') expanded FROM qa LEFT JOIN a USING (question_id)"""

# --- retrieval over the lines of documents

DOCS = r"""
lp AS (SELECT CAST(doc_id AS VARCHAR) fid, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 o FROM documents),
ls AS (SELECT CAST(doc_id AS VARCHAR) fid, string_split(text, chr(10)) ls FROM documents),
lq AS (SELECT fid, split_part(ls[1], '.', 1) || ' ' || split_part(coalesce(ls[len(ls) // 2 + 1], ls[1]), '.', 1) || ' ' || split_part(ls[len(ls)], '.', 1) question FROM ls),
pt AS (SELECT fid, o, t, regexp_extract_all(lower(t), '[a-z0-9]+') toks FROM lp),
tk AS (SELECT fid, o, unnest(toks) term FROM pt),
tf AS (SELECT fid, o, term, count(*) tf FROM tk GROUP BY ALL),
sz AS (SELECT fid, count(*) n, avg(len(toks)) avgdl FROM pt GROUP BY fid),
d0 AS (SELECT fid, term, count(*) df FROM tf GROUP BY ALL),
d1 AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) raw FROM d0 JOIN sz USING (fid)),
ix AS (SELECT d1.*, greatest(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 0.0001) idf
       FROM d1 JOIN (SELECT fid, avg(raw) mean FROM d1 GROUP BY fid) USING (fid)),
qt AS (SELECT fid, term, count(*) qtf FROM (SELECT fid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) term FROM lq) GROUP BY ALL),
sc AS (SELECT fid, o, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl)))), 9) score
       FROM qt JOIN ix USING (fid, term) JOIN tf USING (fid, term) JOIN pt USING (fid, o) GROUP BY ALL),
lex AS (SELECT fid, o, coalesce(score, 0) score, row_number() OVER (PARTITION BY fid ORDER BY coalesce(score, 0) DESC, o) place FROM lp LEFT JOIN sc USING (fid, o)),
hv AS (SELECT fid, o, ((instr('0123456789abcdef', md5(term)[1:1]) - 1) * 16 + instr('0123456789abcdef', md5(term)[2:2]) - 1) % 64 dim, count(*) c FROM tk GROUP BY ALL),
hq AS (SELECT fid, ((instr('0123456789abcdef', md5(term)[1:1]) - 1) * 16 + instr('0123456789abcdef', md5(term)[2:2]) - 1) % 64 dim, sum(qtf) c FROM qt GROUP BY ALL),
hn AS (SELECT fid, o, sqrt(sum(c * c)) nn FROM hv GROUP BY ALL), hqn AS (SELECT fid, sqrt(sum(c * c)) nn FROM hq GROUP BY ALL),
dt AS (SELECT fid, o, CAST(sum(hv.c * hq.c) AS DOUBLE) dot FROM hv JOIN hq USING (fid, dim) GROUP BY ALL),
cs AS (SELECT lp.fid, lp.o, coalesce(round(dot / (hqn.nn * hn.nn), 9), 0) score FROM lp LEFT JOIN dt USING (fid, o) LEFT JOIN hn USING (fid, o) LEFT JOIN hqn ON hqn.fid = lp.fid),
sem AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY score DESC, o) place FROM cs)"""

SQL["bm25_idf"] = f"WITH {DOCS} SELECT fid filing_id, term, df, n n_docs, round(avgdl, 6) avgdl, round(idf, 6) idf FROM ix"
SQL["bm25_top10"] = f"WITH {DOCS} SELECT 'q' || fid question_id, fid || ':' || o passage_id, place, round(score + 1e-10, 6) score FROM lex WHERE place <= 10"
SQL["hashed_vector_top10"] = f"WITH {DOCS} SELECT 'q' || fid question_id, fid || ':' || o passage_id, place, round(score + 1e-10, 6) score FROM sem WHERE place <= 10"
SQL["rrf_top10"] = f"""WITH {DOCS}, p AS (SELECT fid, o, place, 0 l FROM lex WHERE place <= 25 UNION ALL SELECT fid, o, place, 1 FROM sem WHERE place <= 25),
    r AS (SELECT fid, o, round(sum(1.0::DOUBLE / (60 + place)), 12) rrf, min(l * 1000000 + place) s FROM p GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY rrf DESC, s) place FROM r)
    SELECT 'q' || fid question_id, fid || ':' || o passage_id, place, round(rrf, 9) rrf FROM k WHERE place <= 10"""
WINDOW = DOCS + """,
pp AS (SELECT fid, o, place, 0 l FROM lex WHERE place <= 50 UNION ALL SELECT fid, o, place, 1 FROM sem WHERE place <= 50),
fu AS (SELECT fid, o, round(sum(1.0::DOUBLE / (60 + place)), 12) wide, round(sum(1.0::DOUBLE / (60 + place)) FILTER (place <= 25), 12) near, min(l * 1000000 + place) s FROM pp GROUP BY ALL),
fp AS (SELECT fid, o, near, row_number() OVER (PARTITION BY fid ORDER BY near DESC NULLS LAST, s) np, row_number() OVER (PARTITION BY fid ORDER BY wide DESC, s) wp FROM fu),
wt AS (SELECT qt.fid, qt.term, coalesce(idf, ln(sz.n + 0.5) - ln(0.5), 0.0001) idf FROM qt LEFT JOIN ix USING (fid, term) LEFT JOIN (SELECT DISTINCT fid, n FROM ix) sz ON sz.fid = qt.fid),
wa AS (SELECT fid, sum(idf) total FROM wt GROUP BY fid),
wh AS (SELECT fid, o, sum(idf) held FROM wt JOIN tf USING (fid, term) GROUP BY ALL),
rs AS (SELECT fp.*, round(coalesce(coalesce(held, 0) / nullif(total, 0), 0) * 8 - 4, 9) score FROM fp LEFT JOIN wh USING (fid, o) LEFT JOIN wa ON wa.fid = fp.fid),
es AS (SELECT *, max(score) FILTER (near IS NOT NULL) OVER g > -3 AND max(score) FILTER (near IS NOT NULL) OVER g < -1
         AND count(*) OVER g > count(near) OVER g AS esc FROM rs WINDOW g AS (PARTITION BY fid)),
wi AS (SELECT fid, o, score, esc, row_number() OVER (PARTITION BY fid ORDER BY score DESC, CASE WHEN esc THEN wp ELSE np END) pos FROM es WHERE near IS NOT NULL OR esc),
wn AS (SELECT * FROM wi WHERE pos <= 8)"""
SQL["rerank_window"] = f"WITH {WINDOW} SELECT 'q' || fid question_id, fid || ':' || o passage_id, o // 10 + 1 page, pos AS position, round(score + 1e-10, 6) score, esc escalated FROM wn"
SQL["escalation_set"] = f"WITH {WINDOW} SELECT DISTINCT 'q' || fid question_id FROM wn WHERE esc"
SQL["relevance_gate"] = f"""WITH {WINDOW} SELECT 'q' || fid question_id, round(max(score) + 1e-10, 6) top_score, max(score) >= -2 relevant, least(count(*), 3) n_considered
    FROM wn GROUP BY fid"""
SQL["ranked_pages"] = f"""WITH {WINDOW}, g AS (SELECT fid, o // 10 + 1 page, max(score) score, min(pos) pos FROM wn GROUP BY ALL)
    SELECT 'q' || fid question_id, page, row_number() OVER (PARTITION BY fid ORDER BY pos) place, round(score + 1e-10, 6) score FROM g"""
SQL["prompt_context"] = f"""WITH {WINDOW}, g AS (SELECT fid, string_agg('[Page ' || (o // 10 + 1) || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY pos) c FROM wn JOIN lp USING (fid, o) GROUP BY fid)
    SELECT 'q' || fid question_id, 'Excerpts:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || question prompt FROM g JOIN lq USING (fid)"""
_JUDGED = WINDOW + """,
j AS (SELECT quality, s FROM labels JOIN (SELECT fid, max(score) s FROM wn GROUP BY fid) ON fid = CAST(doc_id AS VARCHAR))"""
SQL["retrieval_auc"] = f"""WITH {_JUDGED}, a AS (SELECT s, count(*) FILTER (quality = 1) p, count(*) FILTER (quality = 0) n FROM j GROUP BY s),
    b AS (SELECT *, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) above FROM a)
    SELECT sum(p) positives, sum(n) negatives, round(sum(n * (above + p / 2.0::DOUBLE)) / nullif(sum(p)::DOUBLE * sum(n), 0), 9) auc FROM b"""
SQL["threshold_curve"] = f"""WITH {_JUDGED} SELECT round(d.s + 1e-10, 6) score, count(*) admitted, round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 6) "precision",
    round(count(*) FILTER (quality = 1) / nullif((SELECT count(*) FROM j WHERE quality = 1), 0)::DOUBLE, 6) recall
    FROM (SELECT DISTINCT s FROM j) d JOIN j ON j.s >= d.s GROUP BY d.s"""
SQL["vector_top10"] = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) i FROM embeddings),
    c AS (SELECT label, i, avg(v) v FROM e GROUP BY ALL), cn AS (SELECT label, sqrt(sum(v * v)) nn FROM c GROUP BY label),
    s AS (SELECT e.label, vec_id, sum(e.v * c.v) / (any_value(cn.nn) * sqrt(sum(e.v * e.v))) score FROM e JOIN c USING (label, i) JOIN cn ON cn.label = e.label GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) place FROM s)
    SELECT CAST(label AS VARCHAR) filing_id, vec_id passage_id, place, round(round(score, 9) + 1e-10, 6) score FROM k WHERE place <= 10"""

# --- verification


def _fold(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^ | $', '', 'g'))"


def _collapse(x: str) -> str:
    inner = _fold(f"replace({x}, '|', ' ')")
    return f"regexp_replace(regexp_replace(regexp_replace({inner}, '([$£€])\\s+', '\\1', 'g'), '\\s+([%)])', '\\1', 'g'), '\\(\\s+', '(', 'g')"


SQL["quote_on_page"] = f"""WITH lp AS (SELECT CAST(doc_id AS VARCHAR) fid, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 o FROM documents),
    c AS (SELECT fid, o, CASE WHEN o % 3 = 2 THEN o + 1 ELSE o END page, translate(replace(substr(t, length(t) // 2 + 1), ' ', '  '), 'abcde', 'ABCDE') quote FROM lp),
    j AS (SELECT c.*, p.t page_text FROM c LEFT JOIN lp p ON p.fid = c.fid AND p.o = c.page),
    n AS (SELECT *, trim(quote) <> '' AND (contains({_fold("page_text")}, {_fold("quote")}) OR contains({_collapse("page_text")}, {_collapse("quote")})
        OR contains(translate({_collapse("page_text")}, '$£€', ''), translate({_collapse("quote")}, '$£€', ''))) ok FROM j)
    SELECT fid || ':' || o question_id, page_text IS NOT NULL AND ok on_page, CASE WHEN page_text IS NULL THEN 'page ' || page || ' is outside this filing'
      WHEN NOT ok THEN 'quote not found on page ' || page ELSE '' END failure FROM n"""
SQL["answer_numbers"] = r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '\$?-?\d+(?:,\d{3})*(?:\.\d+)?%?') n FROM documents)
    SELECT doc_id, len(n) n_numbers, coalesce(array_to_string(n, ' '), '') numbers FROM n"""
_NEAR = "abs({v} - {t}) <= greatest(0.015, abs({t}) * 0.003)"


def _derived(t: str) -> str:
    forms = ("a + b", "a - b", "a / b", "a / b * 100", "(a - b) / b * 100", "(a + b) / 2")
    return "(" + " OR ".join(_NEAR.format(v=f"({f})", t=t) for f in forms) + ")"


SQL["reconstruct_pairs"] = f"""WITH {FACTS}{wide("f")},
    p AS (SELECT pv.fid, pv.fy, gross_profit g, round(gross_profit / 7 + 12345.67, 2) x, list_distinct(list_filter([revenue, cogs, net_income, tax_expense], lambda v: v IS NOT NULL AND v <> 0)) vs
          FROM pv WHERE gross_profit IS NOT NULL),
    e AS (SELECT p.fid, p.fy, g, x, a, b FROM p, unnest(vs) t1(a), unnest(vs) t2(b) WHERE a <> b)
    SELECT p.fid filing_id, p.fy fiscal_year, coalesce(bool_or({_derived("e.g")}), false) from_parts, coalesce(bool_or({_derived("e.x")}), false) from_noise
    FROM p LEFT JOIN e USING (fid, fy) GROUP BY ALL"""
SQL["verify_answers"] = f"""WITH {FACTS}, p AS (SELECT r.fid, r.fy, r.v rev, g.v gp FROM f r JOIN f g USING (fid, fy) WHERE r.c = 'revenue' AND g.c = 'gross_profit' AND g.v > 0),
    t AS (SELECT *, CAST(format('{{:.1f}}', gp / rev * 100 + CASE WHEN fy % 2 = 1 THEN 7.7 ELSE 0 END) AS DOUBLE) m FROM p),
    e AS (SELECT t.*, a, b FROM t, LATERAL (VALUES (gp, rev), (rev, gp)) x(a, b) WHERE a <> b),
    k AS (SELECT fid, fy, bool_or({_derived("m")}) ok FROM e GROUP BY ALL),
    z AS (SELECT fid || '-' || fy question_id, CASE WHEN fy % 4 = 0 THEN 'quote not found on page 6' WHEN NOT coalesce(ok, false) THEN 'answer contains a number not present in the quotes' ELSE 'verified' END reason
          FROM t LEFT JOIN k USING (fid, fy))
    SELECT question_id, reason = 'verified' passed, reason FROM z"""
SQL["proposal_parse"] = r"""WITH c AS (SELECT conv_id, turn, turn % 4 n, regexp_replace(text, '\s', '', 'g') <> '' filled FROM conversations)
    SELECT conv_id, turn, n IN (0, 1) AS "found", n = 3 malformed, CASE WHEN n IN (0, 1) AND filled THEN 1 ELSE 0 END n_citations,
      CASE WHEN n = 0 AND filled THEN 1 WHEN n = 1 AND filled THEN 7 ELSE 0 END first_page FROM c"""

# --- answers

SQL["question_values"] = f"""WITH {READ}{metric_cte(list(METRICS), "g", spine=True)}, {NAMED},
    yl2 AS (SELECT fid, list(DISTINCT fy ORDER BY fy) ys FROM g GROUP BY fid),
    ask2 AS (SELECT question_id, fid, metric, kind, CASE WHEN kind = 'single' THEN [coalesce(qyear, ys[len(ys)])]
        WHEN r0 IS NOT NULL AND kind = 'average' THEN range(least(r0, r1), greatest(r0, r1) + 1) WHEN r1 > r0 THEN [r0, r1]
        WHEN kind = 'average' THEN ys[greatest(len(ys) - CASE nyear WHEN 'two' THEN 2 WHEN 'three' THEN 3 ELSE coalesce(TRY_CAST(nyear AS INTEGER), 3) END + 1, 1):]
        ELSE ys[greatest(len(ys) - 1, 1):] END yrs FROM ref JOIN yl2 ON fid = filing_id WHERE refusal IS NULL AND metric IS NOT NULL),
    pv2 AS (SELECT question_id, a.metric, kind, fy, v FROM ask2 a JOIN mt ON mt.fid = a.fid AND mt.metric = a.metric AND list_contains(yrs, mt.fy) WHERE kind = 'single' OR len(yrs) >= 2),
    ag AS (SELECT question_id, metric, kind, count(*) n, min(fy) y0, max(fy) y1, arg_min(v, fy) a, arg_max(v, fy) b, avg(v) mean FROM pv2 GROUP BY ALL HAVING kind = 'single' OR n >= 2),
    rv AS (SELECT *, CASE kind WHEN 'average' THEN mean WHEN 'change' THEN b - a WHEN 'cagr' THEN CASE WHEN b / nullif(a, 0) >= 0 THEN pow(b / a, 1.0 / (y1 - y0)) - 1 END ELSE b END val FROM ag)
    SELECT question_id, metric, kind, round(val, 6) AS value, y0 first_year, y1 last_year FROM rv WHERE val IS NOT NULL"""
SQL["segment_ranking"] = f"""WITH {FACTS}{_MEMBER_TAIL}, {NAMED}, fl AS (SELECT fid, max(fy) newest FROM f GROUP BY fid),
    s AS (SELECT question_id, filing_id, named, coalesce(qyear, newest) yr, regexp_matches(form, '\\bgeograph\\w*|\\bregions?\\b|\\bcountry\\b|\\bcountries\\b') geo,
        regexp_matches(form, '\\b(lowest|smallest|least|worst)\\b') low FROM qq JOIN fl ON fid = filing_id WHERE named IN ('revenue', 'cogs')
        AND regexp_matches(form, '\\b(segments?|divisions?|business units?|reporting units?|geograph\\w*|regions?|country|countries|markets?)\\b')
        AND regexp_matches(form, '\\b(highest|largest|biggest|most|greatest|best|top|lowest|smallest|least|worst)\\b')),
    r AS (SELECT s.*, member, v, count(*) OVER (PARTITION BY question_id) n, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN low THEN v ELSE -v END) k
        FROM s JOIN m ON m.fid = filing_id AND m.fy = yr AND m.c = named AND (axis LIKE '%Geographical%') = geo)
    SELECT question_id, named metric, yr AS "year", trim(regexp_replace(regexp_replace(regexp_replace(member, '^[^:]*:', ''), '(Segment)?Member$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g')) winner, v AS value
    FROM r WHERE n >= 2 AND k = 1"""

# --- history and streams

_PAIRS = """u AS (SELECT conv_id, turn, text question FROM conversations WHERE role = 'user'),
    s AS (SELECT conv_id, turn - 1 turn, text answer FROM conversations WHERE role = 'assistant'),
    ms AS (SELECT conv_id session_id, CASE WHEN conv_id % 5 <> 0 THEN conv_id % 7 END user_id, turn message_id, question, answer FROM u JOIN s USING (conv_id, turn))"""
SQL["session_list"] = f"""WITH {_PAIRS}, c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT conv_id session_id, CASE WHEN conv_id % 5 <> 0 THEN conv_id % 7 END user_id, CAST(conv_id % 10 AS VARCHAR) filing_id, count(message_id) message_count
    FROM c LEFT JOIN ms ON session_id = conv_id WHERE conv_id % 11 <> 3 GROUP BY conv_id"""
SQL["session_title"] = rf"""WITH {_PAIRS} SELECT session_id, substr(regexp_replace(arg_min(question, message_id), '^\s+|\s+$', '', 'g'), 1, 60) title FROM ms GROUP BY session_id"""
SQL["history_search"] = f"""WITH {_PAIRS} SELECT session_id, message_id, question FROM ms WHERE user_id IS NULL AND session_id % 11 <> 3
    AND (question ILIKE '%TION%' OR answer ILIKE '%TION%')"""
SQL["citations_fallback"] = f"""WITH {_PAIRS} SELECT session_id, message_id, CASE WHEN message_id % 4 = 0 THEN 9 WHEN substr(question, 1, 5) <> '' THEN 2 END page,
    CASE WHEN message_id % 4 = 0 THEN substr(answer, 1, 5) ELSE nullif(substr(question, 1, 5), '') END AS "quote" FROM ms"""
_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'indexing' WHEN 'purchase' THEN 'ready' ELSE 'failed' END"
SQL["status_latest"] = f"""SELECT user_id filing_id, arg_max({_STATUS}, ts) status, arg_max(CAST(trunc(value) AS INTEGER), ts) FILTER (event_type = 'click') num_pages
    FROM events GROUP BY user_id"""
SQL["interrupted_failed"] = f"""WITH s AS (SELECT user_id filing_id, arg_max({_STATUS}, ts) st FROM events GROUP BY user_id)
    SELECT filing_id, CASE WHEN st IN ('ready', 'failed') THEN st ELSE 'failed' END status,
      CASE WHEN st NOT IN ('ready', 'failed') THEN 'Interrupted before indexing finished - upload it again.' END error FROM s"""
SQL["feedback_rollup"] = """SELECT user_id message_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END feedback FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"""
SQL["usage_daily"] = """SELECT strftime(ts, '%Y-%m-%d') AS "day", event_type, count(*) n, count(DISTINCT user_id) users, round(sum(value), 4) AS value FROM events GROUP BY ALL"""
SQL["stream_usage"] = """SELECT strftime(ts, '%Y-%m-%d') AS "day", event_type, count(*) n, round(sum(value), 4) AS value, max(value) max_value FROM events GROUP BY ALL"""
SQL["stream_sliding"] = """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR, '%Y-%m-%d %H:%M') window_start, event_type, count(*) n
    FROM events, range(4) r(k) GROUP BY ALL"""
SQL["stream_sessions"] = """WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM a)
    SELECT user_id, count(*) n, round(sum(value), 4) AS value FROM b GROUP BY user_id, k"""
SQL["stream_status"] = f"SELECT user_id filing_id, arg_max({_STATUS}, ts) status FROM events GROUP BY user_id"
SQL["ingest_rejected"] = """SELECT CAST(page_id AS VARCHAR) filing_id, CASE WHEN page_id % 5 < 2 THEN 'failed' ELSE 'ready' END status,
    CASE WHEN page_id % 5 < 2 THEN 'This document contains no extractable text.' END error, CASE WHEN page_id % 5 >= 2 THEN 1 END num_pages FROM pages"""


# --- workspaces and reports

_RECORDS = """fr AS (SELECT doc_id filing_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 END user_id, length(text) * 1000 + doc_id % 3 created, doc_id % 11 = 4 deleted, doc_id % 4 = 1 archived,
    CASE WHEN doc_id % 9 = 2 THEN 'My filing ' || doc_id WHEN doc_id % 2 = 0 AND source IS NOT NULL THEN concat_ws(' · ', 'Company ' || source, CASE WHEN doc_id % 3 = 0 THEN '10-K' END, CASE WHEN doc_id % 6 < 3 THEN 'FY2024' END)
      ELSE doc_id || CASE WHEN doc_id % 8 = 5 THEN '.PDF' ELSE '.htm' END END title, CASE WHEN doc_id % 8 = 5 THEN 'pdf' ELSE 'html' END media,
    doc_id * 7919 % 10007 * 1000000000 + doc_id away, doc_id % 13 <> 6 ready FROM documents)"""


def _workspace_page(shelf: str) -> str:
    return f"""WITH {_RECORDS}, c AS (SELECT user_id, arg_min(created, away) ts, arg_min(filing_id, away) id FROM fr GROUP BY user_id),
      q AS (SELECT user_id, 'next' request, ts, id FROM c UNION ALL SELECT user_id, 'first', NULL, NULL FROM c),
      p AS (SELECT fr.user_id, request, filing_id, title, media, row_number() OVER (PARTITION BY fr.user_id, request ORDER BY created DESC, filing_id DESC) place
        FROM fr JOIN q ON fr.user_id IS NOT DISTINCT FROM q.user_id AND (ts IS NULL OR created < ts OR created = ts AND filing_id < id) WHERE NOT deleted AND {shelf})
      SELECT user_id, request, CAST(place AS INTEGER) place, filing_id, title, media FROM p WHERE place <= 20"""


SQL["workspace_active"] = _workspace_page("NOT archived")
SQL["workspace_archived"] = _workspace_page("archived")
SQL["session_messages"] = f"WITH {_PAIRS} SELECT session_id, message_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY message_id) AS INTEGER) place, question FROM ms"
SQL["message_session"] = f"WITH {_PAIRS} SELECT session_id, message_id FROM ms WHERE session_id % 11 <> 3 AND message_id % 3 <> 1"
SQL["askable_questions"] = f"WITH {_RECORDS} SELECT 'q' || filing_id question_id, filing_id FROM fr WHERE ready AND NOT deleted"
_LABEL = "CASE length(text) % 5 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate((
    "correct answer, correct page", "correct answer, wrong page", "abstained", "confidently wrong", "answered an unanswerable question"))) + " END"
SQL["eval_report"] = f"""WITH r AS (SELECT coalesce(source, 'guest') filing_id, {_LABEL} "label", CASE length(text) % 5 WHEN 0 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN -1 ELSE 0 END points,
      CASE WHEN doc_id % 4 <> 0 THEN nullif(doc_id % 97, 0) END ms FROM documents)
    SELECT filing_id, "label", CAST(2 * grouping(filing_id) + grouping("label") AS BIGINT) "level", count(*) n, CAST(sum(points) AS BIGINT) points, count(ms) timed,
      list_sort(list(ms) FILTER (ms IS NOT NULL))[count(ms) // 2 + 1] median_latency_ms FROM r GROUP BY CUBE (filing_id, "label")"""
SQL["page_hits"] = """WITH t AS (SELECT doc_id n, [length(text) % 6 + 1, length(text) % 11 + 1] want, [doc_id % 5, doc_id % 7, 3] shown FROM documents)
    SELECT count(*) questions, avg(CASE WHEN list_has_any(want, shown) THEN 1.0 ELSE 0 END) hit_rate, min(n % 101) min_ms, median(n % 101) median_ms, max(n % 101) max_ms FROM t"""
SQL["index_replace"] = f"""WITH p AS ({_PAGE_TEXT}), q AS (SELECT *, CAST(filing_id AS BIGINT) n FROM p)
    SELECT filing_id, page, sha1(CASE WHEN n % 3 = 0 THEN 'Amended. ' ELSE '' END || text_sha1) text_sha1 FROM q WHERE n % 7 <> 1
    UNION ALL SELECT 'new-' || filing_id, page, sha1(text_sha1) FROM q WHERE n % 5 = 0"""
