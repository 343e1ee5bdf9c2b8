"""The notification fields: group, where they come from, and patterns that show they are mentioned."""

from __future__ import annotations

from dataclasses import dataclass

INTERNAL, DERIVED, EXTRACTABLE, UNCLEAR = "internal_only", "derived_from_public", "public_document_extractable", "unclear_requires_investigation"
AUTOMATIC, WEAK, MANUAL, NEVER = "strong_automatic", "weak_heuristic", "requires_manual_annotation", "cannot_evaluate_from_public"


@dataclass(frozen=True)
class Field:
    name: str
    group: str
    source_class: str
    kind: str
    difficulty: str
    ground_truth: str
    patterns: tuple[str, ...] = ()


def _f(name: str, group: str, source: str, difficulty: str, truth: str, *patterns: str) -> Field:
    kind = {INTERNAL: "internal", EXTRACTABLE: "explicit"}.get(source, "derived")
    return Field(name, group, source, kind, difficulty, truth, tuple("(?is)" + p for p in patterns))


_META, _SEC, _EVENT, _CONV, _ELECT, _POS = "notification_metadata", "security", "event", "conversion_exchange", "election_response", "position_payment"

# The 39 fields and their patterns.
FIELDS = (
    _f("notification_family", _META, DERIVED, "low", WEAK, r"\btender\s+offer\b", r"\boffer\s+to\s+purchase\b"),
    _f("notification_type", _META, DERIVED, "medium", MANUAL, r"\b(new|amended|updated|cancelled|withdrawn)\b.{0,40}\b(offer|tender|notification)\b"),
    _f("notification_status", _META, DERIVED, "medium", WEAK, r"\b(amendment|amended|withdrawn|withdrawal|cancell?ed|terminated|expired|completed)\b"),
    _f("processing_status", _META, INTERNAL, "n/a", NEVER),
    _f("mandatory_voluntary_indicator", _META, EXTRACTABLE, "medium", MANUAL, r"\bvoluntary\s+tender\b", r"\bmandatory\b", r"\bholders?\s+may\s+tender\b", r"\boptional\b"),
    _f("security_description", _SEC, EXTRACTABLE, "low", WEAK, r"\bcommon\s+stock\b", r"\bordinary\s+shares?\b", r"\bnotes?\b", r"\bdebentures?\b", r"\bpreferred\s+stock\b"),
    _f("isin", _SEC, EXTRACTABLE, "low", MANUAL, r"\bISIN\b[:\s]*[A-Z]{2}[A-Z0-9]{9}\d\b", r"\bISIN\b"),
    _f("cusip", _SEC, EXTRACTABLE, "low", MANUAL, r"\bCUSIP\b[:\s]*[0-9A-Z]{6}[0-9A-Z]{2}[0-9]\b", r"\bCUSIP\b[:\sNo.]*[0-9A-Z]{8,9}\b", r"\bCUSIP\b"),
    _f("ticker", _SEC, EXTRACTABLE, "low", WEAK, r"\bticker\s+symbol\b", r"\bNYSE\b", r"\bNasdaq\b", r"\bTrading\s+Symbol\b"),
    _f("currency", _SEC, EXTRACTABLE, "low", WEAK, r"\bU\.?S\.?\s*dollars?\b", r"\bUSD\b", r"\bEUR\b", r"\bpound\s+sterling\b", r"\bcurrency\b"),
    _f("coupon_rate", _SEC, EXTRACTABLE, "medium", MANUAL, r"\bcoupon\b", r"\binterest\s+rate\b", r"\b%\s*per\s+annum\b"),
    _f("maturity_date", _SEC, EXTRACTABLE, "medium", MANUAL, r"\bmaturit(?:y|ies)\b", r"\bdue\s+[A-Z][a-z]+\s+\d{1,2},\s+\d{4}\b"),
    _f("corporate_action_type", _EVENT, DERIVED, "low", AUTOMATIC, r"\btender\s+offer\b", r"\bexchange\s+offer\b", r"\boffer\s+to\s+purchase\b"),
    _f("event_subtype", _EVENT, EXTRACTABLE, "medium", MANUAL, r"\bDutch\s+auction\b", r"\bmodified\s+Dutch\b", r"\bexchange\s+offer\b", r"\bodd[- ]lot\b", r"\bfixed[- ]price\b"),
    _f("effective_date", _EVENT, EXTRACTABLE, "medium", MANUAL, r"\beffective\s+date\b", r"\bcommencement\s+date\b", r"\boffer\s+commences?\b"),
    _f("record_date", _EVENT, EXTRACTABLE, "medium", MANUAL, r"\brecord\s+date\b"),
    _f("ex_date", _EVENT, UNCLEAR, "high", NEVER, r"\bex[- ](?:dividend|date)\b"),
    _f("payment_date", _EVENT, EXTRACTABLE, "medium", MANUAL, r"\bpayment\s+date\b", r"\bwill\s+be\s+paid\b", r"\bpromptly\s+after\b.{0,40}\bexpir"),
    _f("settlement_date", _EVENT, EXTRACTABLE, "medium", MANUAL, r"\bsettlement\s+date\b", r"\bsettle(?:ment|d)\b"),
    _f("old_security_description", _CONV, EXTRACTABLE, "medium", MANUAL, r"\bold\s+notes?\b", r"\bexisting\s+(common\s+stock|notes?|shares?)\b", r"\bsecurities\s+to\s+be\s+exchanged\b"),
    _f("old_security_isin", _CONV, EXTRACTABLE, "medium", MANUAL, r"\bISIN\b"),
    _f("new_security_description", _CONV, EXTRACTABLE, "medium", MANUAL, r"\bnew\s+notes?\b", r"\bexchange\s+for\b", r"\breplacement\s+securities\b"),
    _f("new_security_isin", _CONV, EXTRACTABLE, "medium", MANUAL, r"\bISIN\b"),
    _f("conversion_ratio", _CONV, EXTRACTABLE, "high", MANUAL, r"\bconversion\s+ratio\b", r"\bexchange\s+ratio\b", r"\bper\s+share\b.{0,30}\bshare"),
    _f("conversion_price", _CONV, EXTRACTABLE, "high", MANUAL, r"\bconversion\s+price\b"),
    _f("redemption_amount", _CONV, EXTRACTABLE, "medium", MANUAL, r"\bredemption\s+(amount|price)\b", r"\bredeem(?:ed|able)?\b"),
    _f("call_price", _CONV, EXTRACTABLE, "medium", MANUAL, r"\bcall\s+price\b", r"\bmake[- ]whole\b"),
    _f("election_required", _ELECT, DERIVED, "medium", WEAK, r"\belection\b", r"\bholders?\s+must\b", r"\bchoose\b", r"\belect\s+to\b"),
    _f("available_options", _ELECT, EXTRACTABLE, "high", MANUAL, r"\bcash\s+election\b", r"\bstock\s+election\b", r"\bmixed\s+consideration\b", r"\boption\s+[A-C]\b", r"\bproration\b"),
    _f("default_option", _ELECT, EXTRACTABLE, "high", MANUAL, r"\bdefault\s+(option|election)\b", r"\bif\s+no\s+election\b"),
    _f("election_deadline", _ELECT, EXTRACTABLE, "medium", MANUAL, r"\belection\s+deadline\b", r"\bexpiration\s+date\b", r"\bexpir(?:e|es|ation)\b"),
    _f("response_deadline", _ELECT, EXTRACTABLE, "medium", MANUAL, r"\bresponse\s+deadline\b", r"\bwithdraw(?:al)?\b.{0,40}\b(deadline|right|until)\b", r"\bExpiration\s+Date\b"),
    _f("cancellation_reason", _ELECT, EXTRACTABLE, "high", MANUAL, r"\b(terminat(?:e|ed|ion)|withdraw(?:n|al)|cancell?(?:ed|ation))\b.{0,80}\b(because|due to|reason)\b", r"\boffer\s+has\s+been\s+(terminated|withdrawn|cancelled)\b"),
    _f("eligible_quantity", _POS, INTERNAL, "n/a", NEVER),
    _f("position_quantity", _POS, INTERNAL, "n/a", NEVER),
    _f("principal_amount", _POS, UNCLEAR, "high", NEVER, r"\bprincipal\s+amount\b", r"\baggregate\s+principal\b"),
    _f("interest_amount", _POS, UNCLEAR, "high", NEVER, r"\baccrued\s+interest\b", r"\binterest\s+amount\b"),
    _f("cash_amount", _POS, UNCLEAR, "high", NEVER, r"\$\s?\d+(?:\.\d+)?\s+per\s+(share|note)", r"\boffer\s+price\b", r"\bcash\s+consideration\b"),
    _f("debit_credit_indicator", _POS, INTERNAL, "n/a", NEVER),
)
BENCHMARK_FIELDS = ("corporate_action_type", "security_description", "cusip", "ticker", "election_deadline", "response_deadline", "notification_status", "available_options", "conversion_ratio", "cash_amount")
PLACEHOLDERS = ("processing_status", "eligible_quantity", "position_quantity", "debit_credit_indicator")

# Fields that are optional for, or not relevant to, an event type; all others are relevant.
_OPTIONAL = {
    "tender_offer": "coupon_rate maturity_date old_security_description old_security_isin new_security_description new_security_isin conversion_ratio conversion_price redemption_amount call_price record_date",
    "exchange_offer": "coupon_rate maturity_date conversion_price cash_amount ex_date record_date",
    "rights_issue": "old_security_description",
    "merger": "ex_date record_date",
    "conversion": "election_deadline available_options cash_amount coupon_rate maturity_date record_date",
}
_NOT_RELEVANT = {
    "tender_offer": "ex_date",
    "exchange_offer": "",
    "rights_issue": "coupon_rate maturity_date call_price redemption_amount",
    "merger": "coupon_rate maturity_date call_price",
    "conversion": "ex_date",
}


def relevance(event_type: str, field: str) -> str:
    if field in PLACEHOLDERS or field in _NOT_RELEVANT[event_type].split():
        return "not_relevant"
    return "optional" if field in _OPTIONAL[event_type].split() else "relevant"
