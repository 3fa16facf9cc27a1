"""Filing vocabulary a question implies. Off by default in retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.text import bind, match_form, matched_keys

_CASH = "consolidated statement of cash flows"
_BALANCE = "consolidated balance sheets"
_INCOME = "consolidated statements of operations"
_PURCHASES = "purchases of property plant and equipment additions capital spending investing activities"
_BUYBACK = "purchases of treasury stock repurchases of common stock financing activities"
_GROSS = "gross profit cost of sales cost of revenue net sales"
_TAX = "provision for income taxes income before income taxes"
_CURRENT = "total current assets total current liabilities"
_LEVERAGE = "long-term debt net total shareholders equity"

# Fixed values: (term, line items a filing prints, the statement they sit on), in order.
EXPANSIONS = [
    ("capital expenditure", _PURCHASES, _CASH),
    ("capex", _PURCHASES, _CASH),
    ("free cash flow", "net cash provided by operating activities purchases of property plant and equipment", _CASH),
    ("operating cash flow", "net cash provided by operating activities", _CASH),
    ("cash flow from operations", "net cash provided by operating activities", _CASH),
    ("depreciation", "depreciation and amortization", _CASH),
    ("amortization", "depreciation and amortization", _CASH),
    ("dividend", "dividends paid dividends declared per share financing activities", _CASH),
    ("share repurchase", _BUYBACK, _CASH),
    ("buyback", _BUYBACK, _CASH),
    ("working capital", _CURRENT, _BALANCE),
    ("current ratio", _CURRENT, _BALANCE),
    ("quick ratio", "cash and cash equivalents accounts receivable total current liabilities", _BALANCE),
    ("inventory", "inventories net", _BALANCE),
    ("receivable", "accounts receivable net of allowances", _BALANCE),
    ("payable", "accounts payable", _BALANCE),
    ("goodwill", "goodwill intangible assets net", _BALANCE),
    ("total assets", "total assets", _BALANCE),
    ("total debt", "long-term debt net current portion of long-term debt short-term borrowings", _BALANCE),
    ("long-term debt", "long-term debt net", _BALANCE),
    ("shareholders equity", "total shareholders equity retained earnings", _BALANCE),
    ("stockholders equity", "total stockholders equity retained earnings", _BALANCE),
    ("book value", "total shareholders equity", _BALANCE),
    ("cash and cash equivalents", "cash and cash equivalents", _BALANCE),
    ("fixed asset", "property and equipment net property plant and equipment", _BALANCE),
    ("leverage", _LEVERAGE, _BALANCE),
    ("revenue", "total revenues net sales net revenues", _INCOME),
    ("net sales", "net sales total revenues", _INCOME),
    ("gross margin", _GROSS, _INCOME),
    ("gross profit", _GROSS, _INCOME),
    ("operating margin", "operating income total revenues", _INCOME),
    ("operating income", "operating income", _INCOME),
    ("net margin", "net income total revenues", _INCOME),
    ("profit margin", "net income total revenues", _INCOME),
    ("net income", "net income", _INCOME),
    ("earnings per share", "earnings per share basic diluted", _INCOME),
    ("eps", "earnings per share basic diluted", _INCOME),
    ("ebitda", "operating income depreciation and amortization", _INCOME),
    ("interest expense", "interest expense", _INCOME),
    ("effective tax rate", _TAX, _INCOME),
    ("tax rate", _TAX, _INCOME),
    ("research and development", "research and development expense", _INCOME),
    ("cost of goods sold", "cost of sales cost of revenue", _INCOME),
    ("sg&a", "selling general and administrative expenses", _INCOME),
    ("return on assets", "net income total assets", _BALANCE),
    ("return on equity", "net income total shareholders equity", _BALANCE),
    ("asset turnover", "total revenues total assets property and equipment net", _BALANCE),
    ("inventory turnover", "inventories net cost of sales", _BALANCE),
    ("days inventory", "inventories net cost of sales", ""),
    ("days sales outstanding", "accounts receivable net total revenues", ""),
    ("days payable", "accounts payable cost of sales", ""),
    ("debt to equity", _LEVERAGE, _BALANCE),
    ("interest coverage", "operating income interest expense", _INCOME),
]

# Statements a question may name.
STATEMENT_HINTS = {
    "cash flow statement": _CASH,
    "statement of cash flows": _CASH,
    "balance sheet": _BALANCE,
    "statement of financial position": _BALANCE,
    "income statement": _INCOME,
    "statement of income": _INCOME,
    "statement of operations": _INCOME,
    "p&l": _INCOME,
    "profit and loss": _INCOME,
    "statement of shareholders equity": "consolidated statements of shareholders equity",
}


def _term(term: str) -> str:
    """Terms are compared in the same form as the question, so one written with '&' can match."""
    return term.replace("&", " and ")


def expand(question: Column) -> Column:
    """The question, then the line items and the statements of every term it contains, each once."""

    def found(form: Column) -> Column:
        hits = [(t, i, s, F.contains(form, F.lit(_term(t)))) for t, i, s in EXPANSIONS]
        items = F.array_distinct(matched_keys([(i, cond) for _, i, _, cond in hits]))
        named = [(s, cond) for _, _, s, cond in hits if s]
        hints = [(s, F.contains(form, F.lit(_term(t)))) for t, s in STATEMENT_HINTS.items()]
        return F.concat(items, F.array_distinct(matched_keys([*named, *hints])))

    return F.array_join(F.concat(F.array(question), bind(match_form(question), found)), " ")
