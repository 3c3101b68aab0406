"""Fixed values that must equal the reference's for right results.

FIXED VALUES - do not edit: milestone names of the shared budgets, their hours,
German month names, English month tokens of the time export, position names,
header aliases and text markers used by the budget export.
"""

from __future__ import annotations

# Shared monthly budgets (hours per employee and month).
MONTHLY_BUDGETS = {
    "Einarbeitung neuer Mitarbeiter (max. 8h/Monat pro MA)": 8.0,
    "Angebote-Ausschreibungen-Kalkulationen (max. 8h/Monat pro MA)": 8.0,
    "Erstellung Vorlagen (übergreifend) (max. 8h/Monat pro MA)": 8.0,
}

# Shared quarterly budgets (hours per employee and quarter).
QUARTERLY_BUDGETS = {
    "Firmenveranstaltungen (max. 4h/Quartal pro MA)": 4.0,
    "Vorträge, Repräsentation (übergreifend) (max. 4h/Quartal pro MA)": 4.0,
    "Messeauftritt (max. 4h/Quartal pro MA)": 4.0,
}

# German month names, January first.
GERMAN_MONTHS = [
    "Januar", "Februar", "März", "April", "Mai", "Juni",
    "Juli", "August", "September", "Oktober", "November", "Dezember",
]

# English three-letter month tokens of the time export, January first.
ENGLISH_MONTH_TOKENS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Header names accepted for the project column, in order of preference.
PROJECT_COLUMN = "Projekte"
PROJECT_COLUMN_ALIASES = ["Projekt", "Project", "Projects", "Projektname"]

# Budget export column names.
COL_FLAG = "Honorarbereich"
COL_PACKAGE = "Arbeitspaket"
COL_TARGET_HOURS = "Sollstunden Budget"
COL_ACTUAL_HOURS = "Iststunden"
COL_BUDGET = "Budget"
COL_TARGET_FEE = "Sollhonorar"
COL_BILLED_FEE = "Verrechnete Honorare"
COL_COST = "Istkosten"

# Position markers in sub-rows of a top-level milestone (text contains).
POSITION_MARKERS = {
    "SV": ["'   SV", "'   S V"],
    "CAD": ["'   CAD", "'   C A D"],
    "ADM": ["'   ADM", "'   A D M"],
}

# Positions an employee can hold.
POSITIONS = ["SV", "CAD", "ADM", "Pauschale", "-"]

# Billing types.
BILLING_FLAT = "Pauschale"
BILLING_PROOF = "Nachweis"
BILLING_UNKNOWN = "Unbekannt"
BILLING_PROOF_MARKERS = ["(an)", "(a.n.)", "(a n)"]
BILLING_FLAT_MARKER = "(p)"

# Status colour bands of a utilisation percentage.
STATUS_GREEN_BELOW = 90.0
STATUS_YELLOW_UPTO = 100.0

# Quarter spellings ("Q3-2025", "2025Q3"), the budget in a milestone's
# name ("8h/Monat"), and the date in a booking's text ("01 Oct 2024").
QUARTER_FIRST = r"^Q(\d)[-/]?\s*(\d{4})$"
QUARTER_LAST = r"^(\d{4})[-/\s]*Q(\d)$"
BUDGET_IN_NAME = r"(?i)(\d+[\.,]?\d*)\s*h\s*(?:/|pro\s+)(monat|quartal)"

# Days that a quarter's range may have.
QUARTER_DAYS = (85, 95)

# Texts of the budget overview.
STATUS_COMPLETE = "✓ Vollständig"
STATUS_MANUAL = "⚠ Manual erforderlich"
REMARK_BILLING = "Abrechnungsart wählen"
REMARK_RATES = "Stundensätze eingeben"

# Label of the whole-range block.
TOTAL_BLOCK_LABEL = "Gesamt"
