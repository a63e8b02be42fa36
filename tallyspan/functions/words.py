"""Word lists and patterns that results depend on."""

# Fixed values of the extraction contract, in their natural order.
TITLE_WORDS = ("reconciliation", "non-gaap", "adjusted ebitda", "ebitda", "balance sheet", "income statement", "operations", "cash flow", "segment", "schedule")
HEADER_TITLE_WORDS = ("reconciliation", "non-gaap", "adjusted ebitda")
RECONCILIATION_TITLES = ("non-gaap", "reconciliation", "adjusted", "non gaap", "bridge")
NOTE_MARK = r"(\(\d+\)|\([a-zA-Z]\)|\[\d+\]|[*†‡])"
METRIC_WORDS = (
    "reconciliation", "non-gaap", "adjusted ebitda", "ebitda", "net income", "operating income", "operating profit",
    "stock-based compensation", "share-based compensation", "depreciation", "amortization", "d&a", "restructuring",
    "impairment", "acquisition", "litigation", "interest expense", "tax expense", "provision for income taxes", "other non-operating",
)
UNRELATED_TITLES = (
    "balance sheet", "consolidated balance", "property, plant", "property and equipment", "operating lease",
    "leases", "debt", "borrowings", "credit facility", "fair value",
)
STRONG_WORDS = ("adjusted ebitda", "stock-based", "share-based", "restructuring", "reconciliation", "non-gaap")
PLACEHOLDERS = ("—", "-", "–", "--", "n/a", "na", "none", "*", "•")
#: First key contained in the label gives the class.
DICTIONARY = (
    ("net income", "Net Income"),
    ("net loss", "Net Income"),
    ("interest expense", "Interest Expense"),
    ("interest expense, net", "Interest Expense"),
    ("provision for income taxes", "Income Tax Expense"),
    ("provision for taxes", "Income Tax Expense"),
    ("income tax benefit", "Income Tax Expense"),
    ("depreciation and amortization", "Depreciation & Amortization"),
    ("depreciation & amortization", "Depreciation & Amortization"),
    ("stock-based compensation", "Stock-based compensation"),
    ("stock-based compensation expense", "Stock-based compensation"),
    ("share-based compensation", "Stock-based compensation"),
    ("r&d stock-based compensation", "Stock-based compensation"),
    ("sg&a stock-based compensation", "Stock-based compensation"),
    ("operating income", "Operating Income"),
    ("restructuring", "Restructuring Charges"),
    ("restructuring and facility exit costs", "Restructuring Charges"),
    ("restructuring charges", "Restructuring Charges"),
    ("litigation", "Litigation settlement"),
    ("litigation settlement", "Litigation settlement"),
    ("litigation settlement expense", "Litigation settlement"),
    ("operating lease cost adjustment", "Lease adjustments"),
    ("lease adjustments", "Lease adjustments"),
    ("transaction & acquisition costs", "M&A transaction costs"),
    ("acquisition-related expenses", "M&A transaction costs"),
    ("gain on disposal of assets", "Other non-operating income"),
    ("adjusted ebitda", "Adjusted EBITDA"),
)
FAILURE_PATTERNS = ("missing_item", "spurious_item", "unrecognized_label", "merged_cell_misalignment", "sign_mismatch", "multi_column_bleed", "note_severance")
SEED_TAXONOMY = (
    "Stock-Based Compensation", "Restructuring Charges", "Litigation Charges", "Lease Adjustments", "Amortization of Intangibles",
    "Acquisition-Related Expenses", "Impairment of Assets", "Gain/Loss on Divestitures", "Foreign Currency Adjustments", "Other Non-Operating Expenses",
)
BOILERPLATE = (
    r"(?i)^(item\s+\d+[a-z]?\.?|part\s+[ivx]+|table\s+of\s+contents|management'?s?\s+discussion"
    r"|index\s+to\s+financial\s+statements|see\s+accompanying\s+notes|notes\s+to\s+consolidated\s+financial\s+statements).*$"
)
UNIT_QUALIFIER = (
    r"(?i)^(\(?\s*in\s+(thousands|millions|billions)(\s*,\s*except.*)?\)?|\(?\s*unaudited\s*\)?|\(?\s*audited\s*\)?"
    r"|\(?\s*dollars\s+in\s+(thousands|millions)\s*\)?|\(?\s*in\s+usd\s*\)?|\(?\s*amounts\s+in\s+(thousands|millions)\s*\)?|\(?\s*\$\s*in\s+(thousands|millions)\s*\)?)$"
)
ALLOWED_TITLE_LENGTH, LEAST_CONFIDENCE_AUTO, LEAST_CONFIDENCE_REVIEW, MOST_FLAGGED_PERCENT = 3, 95, 65, 15.0
