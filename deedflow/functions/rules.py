"""Rule tables as data, and the expressions made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clause categories in order of precedence, with their keywords.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "confidentiality": ("confidential", "nondisclosure", "non-disclosure", "proprietary"),
    "termination": ("termination", "term and termination", "expiration", "cancellation"),
    "payment": ("payment", "compensation", "fees", "rent", "price", "remuneration", "invoicing"),
    "liability": ("liability", "limitation of liability", "damages", "disclaimer"),
    "indemnification": ("indemnif", "hold harmless", "defend and hold"),
    "intellectual_property": ("intellectual property", "ip rights", "work product", "inventions", "patent", "copyright"),
    "non_compete": ("non-compete", "noncompete", "restrictive covenant", "restraint"),
    "non_solicit": ("non-solicit", "nonsolicitation", "solicitation"),
    "dispute_resolution": ("dispute", "arbitration", "mediation", "governing law", "jurisdiction", "venue"),
    "notices": ("notice", "notices", "communication"),
    "severability": ("severability", "invalidity"),
    "representations": ("representations", "warranties", "representations and warranties"),
}
#: Date types in order of precedence: (type, keywords, description).
DATE_TYPES = (
    ("effective_date", ("effective", "commencement", "start date"), "Agreement effective or commencement date"),
    ("expiration_date", ("terminat", "expir", "end date"), "Agreement termination or expiration date"),
    ("renewal_deadline", ("renew",), "Agreement renewal or option notice date"),
    ("payment_due_date", ("pay", "rent", "fee"), "Payment or invoice due date"),
    ("notice_deadline", ("notice",), "Notice submission deadline"),
)
DATE_DEFAULT = ("milestone_date", "Document date reference")
#: Fixed values: (comparison category, parts of a clause category) in order of precedence.
COMPARISON_CATEGORIES = (
    ("TERMINATION", ("terminat",)),
    ("PAYMENT", ("pay", "fee", "price", "rent")),
    ("DURATION", ("durat", "term", "renew")),
    ("NOTICE", ("notice",)),
    ("DEFINITIONS", ("definit",)),
    ("OBLIGATIONS", ("obligat", "duty", "covenant")),
)
#: Fixed values: (category of a version's change, parts of a clause category) in order of precedence.
DIFF_CATEGORIES = (
    ("PARTIES", ("party", "parties")),
    ("DATES", ("date", "term", "duration")),
    ("OBLIGATIONS", ("oblig",)),
    ("NOTICE", ("notice", "terminat")),
    ("PAYMENT", ("pay", "fee", "rent", "price")),
    ("CLAUSE", ("clause", "govern", "confidential")),
)
#: Review flags: (type, title, severity, phrases).
FLAGS = (
    ("restrictive_covenant", "Restrictive Covenant (Non-Compete)", "medium", "non-compete|noncompete|restraint of trade"),
    ("renewal_lock_in", "Automatic Renewal Provision", "medium", "automatically renew|automatic renewal|auto-renew"),
    ("unilateral_discretion", "Unilateral Discretion or Modification", "low", "sole discretion|at its sole option|unilaterally modify|without prior notice"),
    ("ambiguous_term", "Potentially Subjective Standard", "low", "reasonable satisfaction|reasonable efforts|best efforts|time is of the essence"),
)
#: Role headers of party lines.
ROLES = (
    "Landlord", "Tenant", "Employer", "Employee", "Client", "Contractor", "Disclosing Party", "Receiving Party",
    "Buyer", "Seller", "Licensor", "Licensee", "Company", "Consultant", "Borrower", "Lender",
)
#: Months of the date patterns.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def first_rule(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """Name of the first rule one of whose keywords a text contains."""
    out = None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def lower_category(low: Column) -> Column:
    """Category of a clause by its title and text, lower-cased."""
    return first_rule(low, list(CATEGORIES.items()), "general")


def clause_category(title: Column, text: Column) -> Column:
    return lower_category(F.lower(F.concat(title, F.lit(" "), text)))


def date_type(sentence: Column) -> Column:
    return first_rule(F.lower(sentence), [(t, w) for t, w, _ in DATE_TYPES], DATE_DEFAULT[0])


def date_description(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for t, _, d in DATE_TYPES:
        out = out.when(kind == t, d)
    return out.otherwise(DATE_DEFAULT[1])


def comparison_category(category: Column) -> Column:
    return first_rule(F.lower(category), list(COMPARISON_CATEGORIES), "CLAUSE")


def diff_category(category: Column) -> Column:
    return first_rule(F.lower(F.trim(F.coalesce(category, F.lit("")))), list(DIFF_CATEGORIES), "OTHER")


def case_sql(text: str, rules: list[tuple[str, tuple[str, ...]]], default: str) -> str:
    """The same first rule as SQL, for checks in another engine."""
    whens = " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules)
    return f"CASE {whens} ELSE '{default}' END"
