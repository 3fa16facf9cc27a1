"""Markup, passages, tags and statements against small fixtures and brute force."""

import itertools
import random
import re

from pyspark.sql import functions as F

from ledgerlake.operators import facts, passages, statements, structure, xbrl
from ledgerlake.plans import batches, queries
from ledgerlake.sources import filings, html, star


def _text(spark, markup):
    rows = html.pages(spark.createDataFrame([("f", markup)], "filing_id string, html string")).orderBy("page").collect()
    return [r.page_text for r in rows]


def test_pages_split_at_breaks_and_keep_blank_ones(spark):
    brk = '<p style="page-break-after:always"></p>'
    assert _text(spark, f"<p>one</p>{brk}{brk}<p>three</p>") == ["one", "", "three"]
    assert _text(spark, "<p>one</p><hr/><p>two</p>") == ["one", "two"]
    assert _text(spark, f"<p>a</p><hr>b{brk}c") == ["a\nb", "c"]
    assert _text(spark, "<p>only</p>") == ["only"]


def test_page_text_drops_markup_and_serialises_tables(spark):
    markup = (
        "<DOCUMENT><TYPE>10-K\n<TEXT><script>x</script><style>y</style><ix:header><ix:hidden>secret</ix:hidden></ix:header>"
        "</div><p>R&amp;D &#8217;s&nbsp;&nbsp;cost &amp;lt;</p><table><tr><td>Total <b>revenue</b></td><td>$</td><td> 184.6 </td></tr>"
        "<tr><td></td></tr><tr><th>Net</th><td>7</td></tr></table></TEXT></DOCUMENT>"
    )
    (text,) = _text(spark, markup)
    assert "10-K" not in text and "secret" not in text and "x" not in text.split("\n")[0]
    assert "R&D ’s cost &lt;" in text
    assert text.endswith("[TABLE]\nTotal revenue | $ | 184.6\nNet | 7")


def test_decode_falls_back(spark):
    rows = spark.createDataFrame([(1, bytearray("é€".encode())), (2, bytearray(b"caf\xe9 \x93q\x94")), (3, bytearray(b"\x81\xe9"))], "i int, c binary")
    got = {r.i: r.t for r in rows.select("i", html.decode_text(F.col("c")).alias("t")).collect()}
    assert got == {1: "é€", 2: "café “q”", 3: "\x81é"}


def test_sanitise_removes_active_content(spark):
    markup = (
        '<p onclick="a>b" class="k" onmouseover=evil()>hi</p><script>alert(1)</script><a href="javascript:x()">l</a>'
        "<img src='data:abc' alt='ok'><a href=' VBScript:x'>m</a><a href=\"http://ok\">n</a><iframe src=x>z</iframe><meta a=b>"
    )
    (row,) = html.display_pages(spark.createDataFrame([("f", markup)], "filing_id string, html string")).collect()
    assert row.page_html == '<p class="k">hi</p><a>l</a><img alt=\'ok\'><a>m</a><a href="http://ok">n</a>'


def test_sanitise_odd_markup():
    assert html.clean('<svg/onload=alert(1)><a href="java&#115;cript:x">a</a><a href="java\nscript:x">b</a>') == "<svg><a>a</a><a>b</a>"
    assert html.clean('<img alt=a"b onerror=x>t') == '<img alt=a"b>t'
    assert html.clean("a<form><b>c</b><form>d</form>e</form>f<object>g") == "afg"
    assert html.clean("x<script>if (a<b) '</p>'</SCRIPT >y<script>z<img src=q>") == "xy"
    assert html.clean("<!-- <p onclick=x> --><p title='1 > 0' onclick='a'>ok") == "<!-- <p onclick=x> --><p title='1 > 0'>ok"
    long = "<p>" + " one=1 " * 150_000 + "<" * 50_000 + "</p>"
    assert html.clean(long) == long and html.clean(None) is None


def test_uploads(spark):
    files = spark.createDataFrame(
        [("/x/a.htm", 5), ("/x/b.exe", 5), ("/x/c.HTML", 0), ("/x/d.pdf", 200 << 20), ("/x/e.pdf", 9)], "path string, length long"
    )
    good, bad = html.admit(files.withColumn("content", F.lit(b"x")))
    assert sorted(r.original_name for r in good.collect()) == ["a.htm", "e.pdf"]
    assert {r.original_name: r.error for r in bad.collect()} == {"b.exe": "unsupported file type", "c.HTML": "empty file", "d.pdf": "file too large"}
    batch = spark.createDataFrame([("1", "h", None), ("2", "h", None), ("3", "h", 7), ("4", "g", None)], "filing_id string, content_hash string, user_id long")
    stored = spark.createDataFrame([("h", 7, None), ("g", None, "2024")], "content_hash string, user_id long, deleted_at string")
    assert sorted(r.filing_id for r in html.new_uploads(batch, stored).collect()) == ["1", "4"]


def test_grid_text(spark):
    rows = spark.createDataFrame([(1, [["a", " b "], [None, ""], ["c", "d"]]), (2, [["a", ""], ["b", None]]), (3, [["x", "y"]])], "i int, g array<array<string>>")
    got = {r.i: r.t for r in rows.select("i", html.grid_text(F.col("g")).alias("t")).collect()}
    assert got == {1: "a | b\nc | d", 2: None, 3: None}


# --- passages: worked cases, and what has to hold for any page

def _passages(spark, pages):
    rows = spark.createDataFrame([("f", i + 1, p) for i, p in enumerate(pages)], "filing_id string, page int, page_text string")
    got = {i + 1: [] for i in range(len(pages))}
    for r in passages.passages(rows).orderBy("page", "ordinal").collect():
        got[r.page].append(r.text)
    return list(got.values())


def test_passages_worked_cases(spark):
    long = " ".join(f"Sentence number {i} has some words." for i in range(60))
    table = "[TABLE]\nhead | x\n" + "\n".join(f"row {i} | {i * 7}" for i in range(300))
    blank, short, pair, prose, parts, mixed = _passages(spark, [" \n ", "one", "one\n\ntwo", long, table, "intro\n\n[TABLE]\na | 1\nb | 2"])
    assert blank == [] and short == ["one"] and pair == ["one\n\ntwo"] and mixed == ["intro\n\n[TABLE]\na | 1\nb | 2"]
    assert len(prose) > 1 and " ".join(prose) == long
    assert len(parts) > 1 and all(p.startswith("[TABLE]\nhead | x\n") for p in parts)


def test_passages_lose_nothing(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + rng.choice(".!?")
    pages = ["x" * 5000]
    for _ in range(30):
        parts = [" ".join(sentence(rng.randint(1, 40)) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 5))]
        parts += ["[TABLE]\n" + "\n".join(f"{word()} | {rng.randint(1, 10**6)}" for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(0, 2))]
        pages.append("\n\n".join(parts))
    for page, got in zip(pages, _passages(spark, pages)):
        assert all(p.strip() and len(p) <= 2000 for p in got)
        prose = lambda text: re.sub(r"\s+", "", text.split("[TABLE]")[0])
        assert "".join(map(prose, got)) == prose(page)  # every word once, in order
        rows = lambda text: [r for t in text.split("[TABLE]\n")[1:] for r in t.split("\n") if r.strip()]
        shown = [r for p in got for r in rows(p)]
        assert set(shown) == set(rows(page))
        assert [r for r in dict.fromkeys(shown)] == [r for r in dict.fromkeys(rows(page))]


# --- tags

_CTX = '<xbrli:context id="{i}"><xbrli:entity>{seg}</xbrli:entity>{period}</xbrli:context>'
_DUR = "<xbrli:startDate>2022-01-01</xbrli:startDate><xbrli:endDate>{y}-12-31</xbrli:endDate>"
_SEG = '<xbrldi:explicitMember dimension="{axis}">{m}</xbrldi:explicitMember>'


def test_tagged_facts(spark):
    body = (
        _CTX.format(i="d", seg="", period=_DUR.format(y=2021)) + _CTX.format(i="d", seg="", period=_DUR.format(y=2022))
        + _CTX.format(i="s", seg=_SEG.format(axis="us-gaap:StatementBusinessSegmentsAxis", m="x:AMember"), period=_DUR.format(y=2022))
        + _CTX.format(i="o", seg=_SEG.format(axis="us-gaap:FairValueAxis", m="x:L1Member"), period=_DUR.format(y=2022))
        + _CTX.format(i="p", seg="", period="<xbrli:instant>2022-12-31</xbrli:instant>")
        + '<context id="bare"><instant>2020-12-31</instant></context>'
        + '<ix:nonFraction name="us-gaap:Revenues" contextRef="d" scale="6">1,234</ix:nonFraction>'
        + '<div style="page-break-before:always"><IX:NONFRACTION NAME="us-gaap:NetIncomeLoss" CONTEXTREF="d" SIGN="-" scale="3">5</IX:NONFRACTION>'
        + '<ix:nonFraction name="us-gaap:Revenues" contextRef="s">7</ix:nonFraction><ix:nonFraction name="us-gaap:Revenues" contextRef="o">8</ix:nonFraction>'
        + '<ix:nonFraction name="us-gaap:Assets" contextRef="p" format="ixt:zerodash">-</ix:nonFraction><ix:nonFraction name="us-gaap:Assets" contextRef="p">9</ix:nonFraction>'
        + '<ix:nonFraction name="us-gaap:Assets" contextRef="bare">1</ix:nonFraction><ix:nonFraction name="x:Unknown" contextRef="p">1</ix:nonFraction>'
    )
    bare = '<context id="b"><instant>2020-12-31</instant></context><ix:nonFraction name="us-gaap:Assets" contextRef="b">4</ix:nonFraction>'
    rows = spark.createDataFrame([("f", body), ("g", bare), ("h", "no tags")], "filing_id string, html string")
    got = {tuple(r) for r in xbrl.to_facts(xbrl.tagged_facts(rows)).select("filing_id", "concept_key", "value", "fiscal_year", "page", "instant", "member").collect()}
    assert got == {
        ("f", "revenue", 1.234e9, 2022, 1, False, ""), ("f", "net_income", -5000.0, 2022, 2, False, ""),
        ("f", "revenue", 7.0, 2022, 2, False, "x:AMember"), ("f", "assets", 9.0, 2022, 2, True, ""), ("g", "assets", 4.0, 2020, 1, True, ""),
    }


# --- statements

def test_cluster_matches_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for f in range(60):
        cands = {s: sorted(rng.sample(range(1, 30), rng.randint(0, 4))) for s in ("balance_sheet", "cash_flow", "income")}
        cands = {s: p for s, p in cands.items() if p}
        rows += [(str(f), p, "", s, 1.0) for s, ps in cands.items() for p in ps]
        names = sorted(cands)
        combos = list(itertools.product(*(cands[n] for n in names))) if names else []
        if combos:
            best = min(combos, key=lambda c: max(c) - min(c))
            want.update({(str(f), n): p for n, p in zip(names, best)})
    df = spark.createDataFrame(rows, "filing_id string, page int, page_text string, statement string, score double")
    assert {(r.filing_id, r.statement): r.page for r in statements.cluster(df).collect()} == want


def test_statement_facts_units_years_and_surplus(spark):
    page = (
        "Consolidated balance sheets (in millions)\n2022 2021\nTotal current assets | $ | 10 | 20 | 30\nTotal assets | (5.5) | 1,000\n"
        "total current liabilities | 1 | 2\nAccounts payable | 3 | 4\nretained earnings | — | 6\ncash and cash equivalents 7 8"
    )
    rows = spark.createDataFrame([("f", 4, page)], "filing_id string, page int, page_text string")
    got = {(r.concept_key, r.fiscal_year): r.value for r in statements.statement_facts(rows).collect()}
    assert got[("assets_current", 2022)] == 10e6 and got[("assets_current", 2021)] == 20e6
    assert got[("assets", 2022)] == -5.5e6 and got[("retained_earnings", 2022)] == 6e6 and got[("cash", 2021)] == 8e6
    assert len(got) == 11


def test_statement_years_after_a_long_preamble(spark):
    prose = "Total assets rose since 2015 as the notes explain, and net income was restated in 2017.\n"
    table = "Total current assets | 10 | 20\nTotal assets | 30 | 40\nTotal current liabilities | 1 | 2\nAccounts payable | 3 | 4\nRetained earnings | 5 | 6\nGoodwill | 7 | 8"
    pages = [(name, 1, prose * 60 + head + "\n" + table) for name, head in (("cells", "December 31, | 2022 | 2021"), ("years", "2022 2021"))]
    assert all(len(text) > 5000 for *_, text in pages)
    rows = spark.createDataFrame(pages, "filing_id string, page int, page_text string")
    found = statements.statement_facts(rows).where("concept_key = 'assets' and value >= 30").collect()
    assert {(r.filing_id, r.fiscal_year, r.value) for r in found if r.value < 100} == {(f, y, v) for f in ("cells", "years") for y, v in ((2022, 30.0), (2021, 40.0))}


def test_combine_and_latest(spark):
    schema = "filing_id string, concept_key string, value double, fiscal_year int, page int, source string, instant boolean, member string, axis string, doc_pos long"
    tagged = spark.createDataFrame([("f", "revenue", 1.0, 2020, 1, "xbrl", False, "", "", 1), ("f", "cogs", 9.0, 2020, 1, "xbrl", False, "m", "a", 2)], schema)
    read = spark.createDataFrame([("f", "revenue", 2.0, 2020, 2, "statement", False, "", "", 1), ("f", "cogs", 3.0, 2020, 2, "statement", False, "", "", 2)], schema)
    both = facts.combine(tagged, read)
    assert {(r.concept_key, r.value) for r in facts.best_by_year(both).collect()} == {("revenue", 1.0), ("cogs", 3.0)}
    assert {(r.concept_key, r.value) for r in facts.latest(tagged.unionByName(read)).collect()} == {("revenue", 2.0), ("cogs", 3.0)}


def test_facts_that_lie_with_their_filing(spark):
    """The same choice as among rows, with facts of several pages, years, members and none; nothing is shuffled or counted after the facts are made."""
    names = "concept_key value fiscal_year page source instant member axis doc_pos".split()
    schema = "filing_id string, concept_key string, value double, fiscal_year int, page int, source string, instant boolean, member string, axis string, doc_pos long"
    rows = [
        (f"f{n % 7}", ("revenue", "cogs", "cash")[n % 3], float(n), None if n % 23 == 5 else 2015 + n * n % 6, n % 9, "xbrl" if n % 4 else "statement", False,
         "m" if n % 11 == 3 else "", "", (n * 37) % 400) for n in range(400)
    ]
    long = spark.createDataFrame([*rows, ("g", "cash", 1.0, 2020, 1, "xbrl", True, "m", "a", 1)], schema)
    gathered = long.groupBy("filing_id").agg(F.collect_list(F.struct(*names)).alias("facts"))
    best = facts.best_by_year(long)
    for got, want in (
        (facts.best_of_gathered(gathered), best), (facts.prior_of_gathered(gathered), facts.prior_year(best)), (facts.latest_of_gathered(gathered), facts.latest(long)),
    ):
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    for name in ("facts_consolidated", "facts_latest", "facts_prior_year", "metric_direct"):
        plan = queries.CATALOGUE[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("ObjectHashAggregate")]
        assert "Exchange" not in above, name


def test_structure(spark):
    pages = ["cover", "Item 1.\nItem 1A.\nItem 7.\nItem 8.", "Item 1. Business\nx 1", "text see item 7 - no\n2", "ITEM 7: MD&A\n3", "end 9999"]
    rows = spark.createDataFrame([("f", i + 1, p) for i, p in enumerate(pages)], "filing_id string, page int, page_text string")
    assert [tuple(r) for r in structure.page_offsets(rows).collect()] == [("f", -2)]
    assert {tuple(r) for r in structure.sections(rows).collect()} == {("f", "1", 3, 4), ("f", "7", 5, 6)}


def test_tables_of_a_reading_are_written_when_asked_for(spark):
    html = ('<DOCUMENT><TEXT><xbrli:context id="c"><xbrli:period><xbrli:instant>2020-12-31</xbrli:instant></xbrli:period></xbrli:context>'
            '<p>Total assets <ix:nonFraction name="us-gaap:Assets" contextRef="c" scale="0">12</ix:nonFraction></p></TEXT></DOCUMENT>')
    rows = spark.createDataFrame([("a", html), ("b", "<p> </p>")], "filing_id string, html string")
    reading = batches.Reading(rows)
    assert [r.filing_id for r in reading.pages.select("filing_id").collect()] == ["a"]
    assert "pages" in vars(reading) and not {"passages", "tagged", "facts"} & set(vars(reading))
    lake = batches.ingest(rows)
    for name in ("pages", "passages", "tagged", "facts"):
        got, want = getattr(reading, name), getattr(lake, name)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())), name
    assert reading.facts.count() == 1


def test_reports_are_printed_in_the_row(spark):
    """Figures are shuffled, markup is not: nothing that an exchange sends on is a text that was built."""
    plan = filings.filings_html(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [filing_id"):]
    assert plan.count("collect_list(") == 1 and "ix:nonFraction" in plan and "ix:nonFraction" not in below


def test_markup_is_read_once_and_by_all_cores(spark):
    rendered = filings.filings_html(spark, "/root/testdata/sf0.001")
    assert rendered.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = xbrl.tagged_facts(rendered.select("filing_id", "html"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan[: plan.index("Generate")] and "array_distinct(transform(filter" not in plan
    body = (
        "<TABLE class=x><tr><td>a &amp; b<td> 1 </tr><TR><TH>c<br>d</TH><td></td></table><p>prose</p><table><tr><td>never closed"
        '<SCRIPT>if (a < b) {}</ script></SCRIPT ><div class="pp" style="page-break-inside: avoid; PAGE-BREAK-before : always">two<br />lines \n</div>'
    )
    got = spark.createDataFrame([("f", body)], "filing_id string, html string")
    texts = [r.page_text for r in html.pages(got).orderBy("page").collect()]
    assert texts == ["a & b 1 \nc\ndprose\nnever closed\n\n[TABLE]\na & b | 1\nc d | ", "two\nlines"]


def test_sections_are_read_without_writing_page_texts(spark):
    rendered = filings.filings_html(spark, "/root/testdata/sf0.001").select("filing_id", "html")
    reading = batches.Reading(rendered)
    got = structure.spans(reading.headings)
    assert "headings" in vars(reading) and "pages" not in vars(reading)
    assert sorted(map(str, got.collect())) == sorted(map(str, structure.sections(batches.Reading(rendered).pages).collect())) and not got.isEmpty()


def test_figures_reach_their_filing_as_sums(spark):
    """What is dealt to the printing tasks is a row per filing-year and member, not one per fact; the facts are those of the union."""
    plan = filings.filings_html(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "concept_key" not in plan[plan.index("RepartitionByExpression"):] and "RepartitionByExpression" in plan
    rows = lambda df: sorted(map(str, df.select("filing_id", "fiscal_year", "member", "concept_key", "value", "axis").collect()))
    got = star.figures_filed(spark, "/root/testdata/sf0.001", 3).select("filing_id", F.inline("facts"))
    assert rows(got) == rows(star.facts(spark, "/root/testdata/sf0.001", members=True))


def test_concept_pages_need_no_page_texts_on_disk(spark):
    rendered = filings.filings_html(spark, "/root/testdata/sf0.001").select("filing_id", "html").limit(40).localCheckpoint()
    reading = batches.Reading(rendered)
    got = structure.marked_concept_pages(reading.marks, xbrl.concept_pages(reading.tagged))
    assert not {"pages", "passages"} & set(vars(reading))
    want = structure.concept_pages(structure.page_words(reading.passages), xbrl.concept_pages(reading.tagged))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and not got.isEmpty()
