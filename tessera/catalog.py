"""Constant tables of the filing domain."""

from __future__ import annotations

# Filing forms and the families they belong to.
FORM_FAMILIES = {
    "SC TO-T": "third_party_tender",
    "SC TO-T/A": "third_party_tender",
    "SC TO-I": "issuer_tender",
    "SC TO-I/A": "issuer_tender",
    "SC 14D9": "target_recommendation",
    "SC 14D9/A": "target_recommendation",
    "S-4": "registration_exchange_merger",
    "S-4/A": "registration_exchange_merger",
    "DEFM14A": "merger_proxy",
    "PREM14A": "merger_proxy",
    "SC 13E3": "going_private",
    "SC 13E3/A": "going_private",
    "425": "business_combination_comms",
    "424B2": "prospectus_supplement",
    "424B3": "prospectus_supplement",
    "424B4": "prospectus_supplement",
    "424B5": "prospectus_supplement",
    "S-3": "shelf_registration",
    "S-3ASR": "shelf_registration",
    "8-K": "current_report",
}
AMENDMENT_FORMS = ("SC TO-T/A", "SC TO-I/A", "SC 14D9/A", "S-4/A", "SC 13E3/A")

# Formats by file ending.
FORMATS = {".htm": "html", ".html": "html", ".txt": "text", ".pdf": "pdf", ".xml": "xml", ".xsd": "xml", ".jpg": "image", ".jpeg": "image", ".png": "image", ".gif": "image"}

# Collection tracks, their event types and base forms.
TRACKS = {
    "tender": (("tender_offer",), ("SC TO-T", "SC TO-I", "SC 14D9")),
    "merger_exchange": (("merger", "exchange_offer"), ("S-4", "DEFM14A", "PREM14A", "SC 13E3", "425")),
    "rights": (("rights_issue",), ("424B2", "424B3", "424B5")),
    "conversion": (("conversion",), ("8-K",)),
}

# Event types with their primary and supporting forms.
EVENT_TYPES = {
    "tender_offer": (("SC TO-T", "SC TO-T/A", "SC TO-I", "SC TO-I/A"), ("SC 14D9", "SC 14D9/A")),
    "exchange_offer": (("SC TO-T", "SC TO-T/A", "SC TO-I", "SC TO-I/A", "S-4", "S-4/A"), ("SC 14D9", "SC 14D9/A", "424B3", "8-K", "425")),
    "rights_issue": (("424B2", "424B3", "424B5", "S-3", "S-3ASR"), ("8-K", "424B4")),
    "merger": (("DEFM14A", "PREM14A", "S-4", "S-4/A", "SC 13E3", "SC 13E3/A"), ("8-K", "425")),
    "conversion": (("8-K", "424B2", "424B3", "S-3", "S-3ASR"), ("10-K", "10-Q")),
}

# Pattern families that show a field is mentioned.
FIELD_PATTERNS = {
    "event_type": (r"(?i)\btender\s+offer\b", r"(?i)\boffer\s+to\s+purchase\b", r"(?i)\bexchange\s+offer\b", r"(?i)\bself[- ]tender\b"),
    "issuer_target_offeror": (r"(?i)\b(subject\s+company|target\s+company|offeror|bidder|purchaser)\b", r"(?i)\b(issuer|filing\s+person)\b"),
    "security_identifiers": (r"(?i)\bCUSIP\b", r"(?i)\bISIN\b", r"(?i)\bticker\s+symbol\b", r"(?i)\bCommon\s+Stock\b"),
    "offer_price_consideration": (r"(?i)\$\s?\d+(?:\.\d+)?\s+per\s+share", r"(?i)\boffer\s+price\b", r"(?i)\bconsideration\b", r"(?i)\bcash\s+consideration\b"),
    "available_options": (r"(?i)\belection\b", r"(?i)\bmixed\s+consideration\b", r"(?i)\bcash\s+election\b", r"(?i)\bstock\s+election\b", r"(?i)\bproration\s+factor\b"),
    "expiration_date": (r"(?i)\bexpir(?:e|es|ation)\b.{0,40}\b(date|time)\b", r"(?i)\bExpiration\s+Date\b", r"(?i)\bunless\s+extended\b"),
    "withdrawal_deadline": (r"(?i)\bwithdraw(?:al|n)?\b.{0,40}\b(right|deadline|until|prior)\b", r"(?i)\bright\s+to\s+withdraw\b"),
    "conditions": (r"(?i)\bconditions?\s+to\s+(the\s+)?offer\b", r"(?i)\bminimum\s+condition\b", r"(?i)\bfinancing\s+condition\b", r"(?i)\bregulatory\s+approvals?\b"),
    "restrictions": (r"(?i)\bjurisdictions?\b", r"(?i)\bnot\s+being\s+made\b", r"(?i)\brestricted\s+jurisdict", r"\bERISA\b"),
    "proration_min_tender": (r"(?i)\bproration\b", r"(?i)\bpro\s*ration\b", r"(?i)\bminimum\s+tender\b", r"(?i)\bmajority\s+of\s+the\s+outstanding\b"),
}

# Labels of span models and the fields they hint at.
LABEL_HINTS = {
    "offeror_organization": "offeror", "target_organization": "target", "purchaser_organization": "purchaser",
    "security_name": "security_description", "cusip_code": "cusip", "isin_code": "isin", "ticker_symbol": "ticker",
    "offer_price_amount": "offer_price", "expiration_datetime": "expiration_date", "withdrawal_datetime": "withdrawal_deadline",
    "effective_datetime": "effective_date", "settlement_datetime": "settlement_date", "minimum_tender_condition": "minimum_tender_condition",
    "proration_terms": "proration_terms", "available_option": "available_option", "currency_code": "currency",
    "money_amount": "offer_price", "calendar_date": "expiration_date", "org_name": "offeror",
    "offeror": "offeror", "target": "target", "purchaser": "purchaser", "security": "security_description", "cusip": "cusip",
    "isin": "isin", "ticker": "ticker", "offer_price": "offer_price", "expiration_date": "expiration_date",
    "withdrawal_deadline": "withdrawal_deadline", "effective_date": "effective_date", "settlement_date": "settlement_date", "currency": "currency",
}

# Headings that models mistake for values.
HEADINGS = (
    "offer price", "offer expiration time", "expiration time", "expiration date", "effective time", "effective date", "withdrawal rights",
    "withdrawal deadline", "settlement date", "minimum condition", "parent", "the offeror", "the company", "target company", "shares", "share",
    "common stock", "cusip number", "title of class of securities", "filing persons", "subject company",
)
PRIORITY_HEADINGS = ("summary term sheet", "important dates", "summary of the offer", "questions and answers", "q&a")
WEAK_SECURITIES = ("shares", "share", "common stock", "stock", "securities", "class a", "class b", "ordinary shares")
BOILERPLATE_SECURITIES = ("shares", "share", "common stock", "stock", "securities")
AGENTS = (
    r"(?i)\b(?:computershare|information\s+agent|depositary|depository|depository\s+trust|dtc|exchange\s+agent|paying\s+agent|transfer\s+agent|"
    r"macken(?:zie)?\s+partners|georgeson|innisfree|df\s*king|okapi\s+partners|morrow\s+sodali|trustee|trust\s+company|jefferies)\b"
)
SHELLS = r"(?i)^(?:parent|merger\s*sub(?:sidiary)?|purchaser|offeror|company|the\s+company|target\s+company|acquiring\s+company|acquisition\s+sub(?:sidiary)?|buyer)$"

# What a document's role adds to a candidate's rank.
ROLE_BONUS = {
    ("cusip", "cover"): 0.25, ("ticker", "cover"): 0.2, ("security_description", "cover"): 0.2, ("target", "cover"): 0.2, ("offeror", "cover"): 0.1,
    ("offer_price", "otp"): 0.2, ("expiration_date", "otp"): 0.2, ("withdrawal_deadline", "otp"): 0.15, ("cash_amount", "otp"): 0.1,
    ("offer_price", "cover"): -0.05, ("expiration_date", "cover"): -0.05,
}

# Merger fields, reference fields and their kinds.
MERGER_FIELDS = (
    "acquirer", "target", "consideration_type", "cash_consideration", "stock_exchange_ratio", "shareholder_vote_date", "closing_conditions", "event_status",
    "mandatory_voluntary_indicator", "security_description", "ticker", "cusip", "isin", "effective_date", "available_options", "default_option", "election_deadline",
)
CORE_FIELDS = ("acquirer", "target", "cash_consideration", "stock_exchange_ratio", "shareholder_vote_date", "effective_date", "security_description", "ticker", "cusip", "isin")
REVIEWED = ("manually_reviewed", "adjudicated", "verified")
MERGER_LABELS = {
    "acquirer organization": "acquirer", "target organization": "target", "cash consideration per share": "cash_consideration", "stock exchange ratio": "stock_exchange_ratio",
    "shareholder vote date": "shareholder_vote_date", "merger closing condition": "closing_conditions", "merger event status": "event_status", "affected security": "security_description",
    "stock ticker": "ticker", "CUSIP identifier": "cusip", "ISIN identifier": "isin", "merger effective date": "effective_date", "shareholder election option": "available_options",
    "default election option": "default_option", "election deadline": "election_deadline",
}
WINDOW_ANCHORS = (
    r"agreement and plan of merger|merger agreement|business combination agreement",
    r"merger consideration|cash consideration|per share",
    r"exchange ratio|stock consideration|right to receive",
    r"special meeting|shareholder vote|stockholder vote",
    r"effective time|effective date|completed the merger",
    r"closing conditions|conditions to closing|regulatory approval",
    r"election deadline|cash election|stock election|default option",
    r"CUSIP|ISIN|ticker symbol",
)
ORGANIZATION_ENDING = r"(?i)\b(?:inc\.?|corp\.?|corporation|company|co\.?|llc|ltd\.?|plc|bancorp|holdings?|group|limited)\b"
ADVISORY = r"(?i)\b(?:advisory|underwriting|financial advisor|fairness opinion|financial point of view|investment bank|dealer manager|financial adviser)\b"
GENERIC_ROLES = ("parent", "company", "holdings", "merger sub", "purchaser", "acquirer", "buyer", "surviving corporation", "pubco")
DATE_CUES = {
    "shareholder_vote_date": r"(?i)\b(?:special meeting|annual meeting|shareholders? meeting|stockholders? meeting|meeting of (?:the )?stockholders|vote on|to vote|meeting will be held)\b",
    "effective_date": r"(?i)\b(?:effective time|merger effective|become effective|effective date|certificate of merger)\b",
}
NO_DATE_CONTEXT = r"(?i)\b(?:agreement|plan of merger|dated|record date|expiration date|report|entered into|filed on|as of)\b"
EVIDENCE_PATTERNS = {
    "merger_agreement_signed": r"\b(?:entered into|executed|signed)\b.{0,180}?\b(?:agreement and plan of merger|merger agreement)\b",
    "merger_completed": r"\b(?:completed|consummated)\s+(?:the\s+|its\s+|a\s+|previously announced\s+|proposed\s+){0,4}merger\b|\bmerger\s+(?:was\s+|has been\s+|had been\s+)(?:completed|consummated)\b",
    "merger_agreement_terminated": r"\bterminated\s+(?:the|its)\s+(?:previously announced\s+)?(?:agreement and plan of merger|merger agreement)\b|\bmerger agreement\s+(?:was|has been)\s+terminated\b",
}
CONDITIONAL = r"(?i)\b(?:if|unless|may|could|would|will|shall)\b[^.;]{0,70}$"
