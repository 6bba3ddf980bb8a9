"""Fixed values. Results depend on them, so they are stated as they must be, in their natural order."""

from __future__ import annotations

# Friendly metric -> tagged concepts, the first with a value wins.
METRIC_CONCEPTS: dict[str, tuple[str, ...]] = {
    "revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet", "RevenuesNetOfInterestExpense", "Revenue"),
    "net sales": ("SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueGoodsNet", "Revenues"),
    "cost of revenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices", "CostOfSales"),
    "gross profit": ("GrossProfit",),
    "operating income": ("OperatingIncomeLoss", "ProfitLossFromOperatingActivities"),
    "net income": ("NetIncomeLoss", "ProfitLoss", "ProfitLossAttributableToOwnersOfParent"),
    "pretax income": (
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        "ProfitLossBeforeTax",
    ),
    "income tax expense": ("IncomeTaxExpenseBenefit", "IncomeTaxExpenseContinuingOperations"),
    "interest expense": ("InterestExpense", "InterestExpenseNonoperating", "InterestExpenseDebt"),
    "research and development": ("ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost"),
    "sg&a": ("SellingGeneralAndAdministrativeExpense",),
    "depreciation and amortization": ("DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "DepreciationAmortizationAndAccretionNet", "DepreciationAmortizationAndOther", "Depreciation"),
    "eps basic": ("EarningsPerShareBasic",),
    "eps diluted": ("EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"),
    "diluted shares": ("WeightedAverageNumberOfDilutedSharesOutstanding",),
    "basic shares": ("WeightedAverageNumberOfSharesOutstandingBasic",),
    "shares outstanding": ("CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"),
    "operating cash flow": ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations", "CashFlowsFromUsedInOperatingActivities"),
    "capital expenditure": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets", "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities"),
    "dividends paid": ("PaymentsOfDividends", "PaymentsOfDividendsCommonStock", "DividendsPaidClassifiedAsFinancingActivities"),
    "dividends per share": ("CommonStockDividendsPerShareDeclared", "CommonStockDividendsPerShareCashPaid"),
    "share repurchases": ("PaymentsForRepurchaseOfCommonStock",),
    "total assets": ("Assets",),
    "current assets": ("AssetsCurrent", "CurrentAssets"),
    "total liabilities": ("Liabilities",),
    "total liabilities and equity": ("LiabilitiesAndStockholdersEquity", "EquityAndLiabilities"),
    "total equity": ("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "StockholdersEquity", "Equity"),
    "current liabilities": ("LiabilitiesCurrent", "CurrentLiabilities"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue", "CashAndCashEquivalents", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"),
    "accounts receivable": ("AccountsReceivableNetCurrent", "ReceivablesNetCurrent", "TradeAndOtherCurrentReceivables"),
    "inventory": ("InventoryNet", "Inventories", "InventoryFinishedGoodsNetOfReserves"),
    "accounts payable": ("AccountsPayableCurrent", "AccountsPayableTradeCurrent", "TradeAndOtherCurrentPayables"),
    "property plant and equipment": ("PropertyPlantAndEquipmentNet", "PropertyPlantAndEquipment"),
    "goodwill": ("Goodwill",),
    "long-term debt": ("LongTermDebtNoncurrent", "LongTermDebt", "LongtermBorrowings"),
    "shareholders equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "Equity"),
}

# Other names of the metrics.
METRIC_ALIASES: dict[str, str] = {
    "sales": "net sales", "total revenue": "revenue", "revenues": "revenue", "total revenues": "revenue", "net revenue": "revenue",
    "cogs": "cost of revenue", "cost of goods sold": "cost of revenue", "cost of sales": "cost of revenue", "operating profit": "operating income",
    "ebit": "operating income", "net earnings": "net income", "net profit": "net income", "earnings per share": "eps diluted", "eps": "eps diluted",
    "diluted eps": "eps diluted", "capex": "capital expenditure", "capital expenditures": "capital expenditure",
    "purchases of property plant and equipment": "capital expenditure", "cash from operations": "operating cash flow",
    "cash flow from operations": "operating cash flow", "net cash from operating activities": "operating cash flow", "d&a": "depreciation and amortization",
    "r&d": "research and development", "selling general and administrative": "sg&a", "assets": "total assets", "liabilities": "total liabilities",
    "cash and cash equivalents": "cash", "receivables": "accounts receivable", "net receivables": "accounts receivable", "net ar": "accounts receivable",
    "ar": "accounts receivable", "inventories": "inventory", "payables": "accounts payable", "ap": "accounts payable", "pp&e": "property plant and equipment",
    "net pp&e": "property plant and equipment", "ppe": "property plant and equipment", "fixed assets": "property plant and equipment",
    "debt": "long-term debt", "long term debt": "long-term debt", "equity": "shareholders equity", "stockholders equity": "shareholders equity",
    "total equity": "shareholders equity", "buybacks": "share repurchases", "income before taxes": "pretax income", "tax expense": "income tax expense",
}

# A metric that is the first of two minus the second; one that is so only where it is not tagged itself.
DERIVED_METRICS = {"free cash flow": ("operating cash flow", "capital expenditure")}
FALLBACK_METRICS = {"total liabilities": ("total liabilities and equity", "total equity")}

# Where a filing is found; the pattern of an exact figure's id.
FILING_URL = "https://www.sec.gov/Archives/edgar/data/%s/%s/"
FACT_ID = r"xbrl:([A-Z][A-Z.\-]{0,5}):([\w-]+:\w+):(FY|Q[1-4])(\d{4})"

# What a ticker and a form may look like.
TICKER = r"^[A-Za-z][A-Za-z.\-]{0,5}$"
FORM = r"^[0-9A-Za-z][0-9A-Za-z\-/]{0,9}$"

# Bounds of a request for vectors, of a text in it, of a text in a vector's record, of an excerpt.
REQUEST_TOKENS, REQUEST_ITEMS, EMBEDDED_CHARS, RECORD_CHARS, EXCERPT_CHARS = 150_000, 2048, 6000, 1000, 300

# Characters of arguments in a log record, and the days that it is kept.
LOGGED_CHARS, LOG_DAYS = 500, 90

# Orders of preference.
NAMESPACES = ("us-gaap", "ifrs-full", "dei")
UNITS = ("USD", "USD/shares", "shares", "pure")
ANNUAL_FORMS = ("10-K", "20-F", "40-F")
QUARTER_FORMS = ("10-Q",)

# Names by which a question names a company.
COMPANY_NAMES: dict[str, tuple[str, ...]] = {
    "NVDA": ("nvidia",), "AAPL": ("apple",), "MSFT": ("microsoft",), "GOOGL": ("alphabet", "google"), "META": ("meta platforms", "facebook"),
    "TSLA": ("tesla",), "F": ("ford", "ford motor"), "GM": ("general motors",), "RIVN": ("rivian",), "LCID": ("lucid",),
    "JPM": ("jpmorgan", "jp morgan", "j.p. morgan"), "BAC": ("bank of america",), "GS": ("goldman sachs", "goldman"), "MS": ("morgan stanley",),
    "V": ("visa",), "JNJ": ("johnson & johnson", "johnson and johnson"), "PFE": ("pfizer",), "UNH": ("unitedhealth", "united health"), "ABBV": ("abbvie",),
    "MRK": ("merck",), "XOM": ("exxon", "exxonmobil", "exxon mobil"), "CVX": ("chevron",), "COP": ("conocophillips",), "SLB": ("schlumberger",),
    "OXY": ("occidental",), "WMT": ("walmart", "wal-mart"), "COST": ("costco",), "HD": ("home depot",), "TGT": ("target corporation", "target corp"),
    "LOW": ("lowe's", "lowes"), "BA": ("boeing",), "CAT": ("caterpillar",), "GE": ("general electric",), "HON": ("honeywell",),
    "UPS": ("united parcel service",), "T": ("at&t",), "VZ": ("verizon",), "TMUS": ("t-mobile", "t mobile"), "CMCSA": ("comcast",),
    "CHTR": ("charter communications",), "DIS": ("disney",), "NFLX": ("netflix",), "WBD": ("warner bros", "warner brothers"), "PARA": ("paramount",),
    "SPOT": ("spotify",), "AMD": ("advanced micro devices",), "INTC": ("intel",), "QCOM": ("qualcomm",), "TXN": ("texas instruments",), "AVGO": ("broadcom",),
    "MMM": ("3m",), "PEP": ("pepsico", "pepsi"), "AMCR": ("amcor",), "BBY": ("best buy",), "AXP": ("american express", "amex"), "MGM": ("mgm resorts",),
    "ULTA": ("ulta",), "ADBE": ("adobe",), "GLW": ("corning",), "CVS": ("cvs health",), "GIS": ("general mills",), "NKE": ("nike",),
    "AES": ("aes corporation",), "AMZN": ("amazon",), "AWK": ("american water works", "american water"), "SQ": ("block, inc", "block inc", "square inc"),
    "KO": ("coca-cola", "coca cola"), "LMT": ("lockheed martin", "lockheed"), "ATVI": ("activision",), "FL": ("foot locker",), "KHC": ("kraft heinz", "kraft"),
    "PYPL": ("paypal",),
}

# A term of a question -> the wording of filings.
SYNONYMS: dict[str, str] = {
    "capital expenditure": "purchases of property plant and equipment PP&E capital spending",
    "capital expenditures": "purchases of property plant and equipment PP&E capital spending",
    "capex": "purchases of property plant and equipment PP&E capital spending",
    "revenue": "net sales total revenues",
    "top line": "net sales total revenues",
    "cogs": "cost of sales cost of goods sold",
    "cost of goods sold": "cost of sales",
    "gross margin": "gross profit net sales cost of sales",
    "operating margin": "operating income net sales",
    "net margin": "net income net sales",
    "ebitda": "operating income depreciation and amortization",
    "free cash flow": "net cash provided by operating activities purchases of property plant and equipment",
    "operating cash flow": "net cash provided by operating activities",
    "inventory turnover": "cost of sales inventories",
    "dpo": "accounts payable cost of sales",
    "days payable outstanding": "accounts payable cost of sales",
    "working capital": "total current assets total current liabilities",
    "quick ratio": "cash and cash equivalents accounts receivable total current liabilities",
    "roa": "net income total assets",
    "return on assets": "net income total assets",
    "effective tax rate": "provision for income taxes income before income taxes",
    "dividend": "dividends paid to shareholders cash dividends",
    "eps": "earnings per share",
    "fixed asset turnover": "net sales property plant and equipment net",
}

# A ratio -> the lines of the statements that it needs.
RATIO_LINES: dict[str, tuple[str, ...]] = {
    "days payable outstanding": ("accounts payable", "cost of sales"),
    "dpo": ("accounts payable", "cost of sales"),
    "inventory turnover": ("cost of sales", "inventories"),
    "working capital": ("total current assets", "total current liabilities"),
    "current ratio": ("total current assets", "total current liabilities"),
    "quick ratio": ("cash and cash equivalents", "short-term investments", "accounts receivable", "total current liabilities"),
    "gross margin": ("net sales", "cost of sales"),
    "cogs": ("net sales", "cost of sales"),
    "operating margin": ("operating income", "net sales"),
    "net margin": ("net income", "net sales"),
    "ebitda": ("operating income", "depreciation and amortization", "net sales"),
    "free cash flow": ("net cash provided by operating activities", "purchases of property, plant and equipment"),
    "return on assets": ("net income", "total assets"),
    "roa": ("net income", "total assets"),
    "effective tax rate": ("provision for income taxes", "income before income taxes"),
    "dividend payout ratio": ("dividends", "net income"),
    "fixed asset turnover": ("net sales", "property, plant and equipment, net"),
    "operating cash flow ratio": ("net cash provided by operating activities", "total current liabilities"),
}

# Words that a search leaves out.
STOPWORDS = tuple("a an and are as at be by for from has have in is it its of on or that the this to was were what when where which who will with".split())

# How an answer declines.
REFUSALS = (
    r"does not (provide|include|contain|mention|specify)",
    r"cannot (determine|answer|calculate|be determined)",
    r"could not find",
    r"not (provided|available|included) in the (provided )?context",
    r"unavailable in retrieved",
    r"insufficient (information|context)",
    r"no information",
)

# What replaces a figure that no source holds; what marks a passage as cut.
REDACTED = "[exact figure unavailable in retrieved context]"
TRUNCATED = " [... truncated]"
MAX_PASSAGE = 8000

# Words of scale of the verifier and of the evaluation.
SCALE_WORDS = {"billion": 1e9, "b": 1e9, "million": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
ANSWER_SCALES = (1.0, 1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9)

# Limits of the service.
CALLS_A_MINUTE, CALLS_A_DAY, TOKENS_A_DAY, CACHE_HOURS = 30, 1000, 2_000_000, 24

# Static company numbers for tickers that the live map lacks are given by the caller; forms of the benchmark's documents.
BENCHMARK_FORMS = {"10k": "10-K", "10q": "10-Q", "8k": "8-K"}
