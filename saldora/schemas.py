"""Schemas and status codes. Every frame carries its ordinals, as order has meaning in documents."""

from __future__ import annotations

PAGES = "doc_id string, page int, text string"
ITEMS = "doc_id string, item_ord long, label string, page int, current_values array<double>, prior_values array<double>, source_line string, double_row boolean"
POSITIONS = "doc_id string, section string, label string, current_value double, prior_value double, page int, source_line string, note string"
FACTS = "doc_id string, source_type string, label string, value double, filename string, source_line string, sheet string"
CELLS = "path string, sheet string, sheet_ord int, row int, col int, value string"
CHECKLIST = "item_id string, category string, description string, references array<string>, keywords array<string>, applicable_to array<string>, size_classes array<string>, mandatory boolean, relevant boolean, guidance string"

OK, DEVIATION, ONLY_CURRENT, ONLY_PRIOR, MISSING_VALUE = "OK", "DEVIATION", "ONLY_CURRENT", "ONLY_PRIOR", "MISSING_VALUE"
NO_VOUCHER, NO_VALUE, NOTE = "NO_VOUCHER", "NO_VALUE", "NOTE"
SAME, CHANGED, NEW, MISSING = "SAME", "CHANGED", "NEW", "MISSING"
COMPLIANT, PARTIAL, NOT_COMPLIANT, NOT_ASSESSABLE, NOT_APPLICABLE = "COMPLIANT", "PARTIAL", "NOT_COMPLIANT", "NOT_ASSESSABLE", "NOT_APPLICABLE"

#: The status words of the German reports.
GERMAN = {
    OK: "OK", DEVIATION: "ABWEICHUNG", ONLY_CURRENT: "NUR_AKTUELL", ONLY_PRIOR: "NUR_VORJAHR", MISSING_VALUE: "FEHLENDER_WERT",
    NO_VOUCHER: "KEIN_BELEG", NO_VALUE: "KEIN_WERT", NOTE: "HINWEIS", SAME: "IDENT", CHANGED: "GEÄNDERT", NEW: "NEU", MISSING: "FEHLT",
    COMPLIANT: "ENTSPRICHT", PARTIAL: "TEILWEISE ENTSPRECHEND", NOT_COMPLIANT: "NICHT ENTSPRECHEND", NOT_ASSESSABLE: "NICHT BEURTEILBAR", NOT_APPLICABLE: "NICHT ANWENDBAR"}
