"""Fixed values that results depend on: word lists, labels, patterns, profiles."""

from __future__ import annotations

# Sections of formal documents and the words that announce them, folded to ASCII.
SECTIONS = {
    "has_parties_section": "strony umowy, strony, powod, pozwany, strona powodowa, strona pozwana, zamawiajacy, wykonawca, zleceniodawca, zleceniobiorca, sprzedajacy, kupujacy, nabywca, sprzedawca, strona, stronami, umawiajace sie strony, powodka",
    "has_subject_section": "przedmiot umowy, przedmiot, zakres umowy, obowiazki stron, zakres prac, zakres uslug, opis przedmiotu",
    "has_court_section": "sad rejonowy, sad okregowy, sad apelacyjny, do sadu, wydzial cywilny",
    "has_claim_section": "pozew, zadanie pozwu, wnosze o, domagam sie, zasadzenie, o zaplate, wartosc przedmiotu sporu",
    "has_justification_section": "uzasadnienie, stan faktyczny, dowod, dowody, okolicznosci, fakty",
    "has_principal_section": "mocodawca, udzielajacy pelnomocnictwa, dane mocodawcy",
    "has_attorney_section": "pelnomocnik, dane pelnomocnika, ustanawiam pelnomocnikiem",
    "has_authorization_scope_section": "udzielam pelnomocnictwa, upowazniam, upelnomocniam, do reprezentowania, reprezentowania mnie, w moim imieniu, zakres pelnomocnictwa",
    "has_attachments_section": "zalacznik, zalaczniki, lista zalacznikow, zalacznik nr",
}
NEGATIONS = "brak braki brakuje brakujacy brakujace brakujaca bez".split()

# Words of document types, in order of precedence; a type's score is the share of them that occur.
TYPE_WORDS = {
    "contract": "umowa, strony umowy, zleceniodawca, zleceniobiorca, zamawiajacy, wykonawca, przedmiot umowy",
    "lawsuit": "pozew, powod, pozwany, sad rejonowy, sad okregowy, wnosze o, wartosc przedmiotu sporu, uzasadnienie",
    "power_of_attorney": "pelnomocnictwo, mocodawca, pelnomocnik, udzielam pelnomocnictwa, upowazniam, do reprezentowania, zakres pelnomocnictwa",
    "invoice": "faktura, nabywca, sprzedawca, kwota brutto, vat",
    "tax_form": "deklaracja, pit, urzad skarbowy, nip, podatek",
}
DOCUMENT_TYPES = "unknown lawsuit power_of_attorney application invoice contract id_card passport bank_statement tax_form financial_report government_tender law_and_regulation manual patent scientific_article other".split()

# Labels of training corpora and the document types they stand for.
LABEL_TYPES = {
    "financial_reports": "financial_report", "government_tenders": "government_tender", "laws_and_regulations": "law_and_regulation", "manuals": "manual", "patents": "patent",
    "scientific_articles": "scientific_article", "invoices": "invoice", "contracts": "contract", "id_card": "id_card", "passport": "passport", "bank_statements": "bank_statement",
    "tax_forms": "tax_form", "lawsuits": "lawsuit", "power_of_attorney": "power_of_attorney", "applications": "application",
}

# Built-in profiles; (order, name, field, severity, message).
_DATE, _SIGNED, _FILES = "Data dokumentu", "Podpis", "Załączniki"
_UNSIGNED = "Brakuje podpisu albo oznaczenia miejsca na podpis."
_NO_FILES = "Nie wykryto sekcji załączników; sprawdź ręcznie, czy są wymagane."
PROFILES = {
    ("contract", "MVP - umowa"): [
        (10, _DATE, "has_date", "error", "Brakuje daty sporządzenia lub zawarcia umowy."),
        (20, "Oznaczenie stron umowy", "has_parties_section", "error", "Brakuje sekcji z oznaczeniem stron umowy."),
        (30, "Przedmiot umowy", "has_subject_section", "error", "Brakuje sekcji opisującej przedmiot umowy."),
        (40, _SIGNED, "has_signature", "error", _UNSIGNED),
        (50, _FILES, "has_attachments_section", "warning", _NO_FILES),
    ],
    ("lawsuit", "MVP - pozew"): [
        (10, _DATE, "has_date", "error", "Brakuje daty sporządzenia pozwu."),
        (20, "Oznaczenie sądu", "has_court_section", "error", "Brakuje oznaczenia sądu."),
        (30, "Oznaczenie stron", "has_parties_section", "error", "Brakuje oznaczenia stron postępowania."),
        (40, "Żądanie pozwu", "has_claim_section", "error", "Brakuje żądania pozwu lub wartości przedmiotu sporu."),
        (50, "Uzasadnienie", "has_justification_section", "error", "Brakuje sekcji uzasadnienia pozwu."),
        (60, _SIGNED, "has_signature", "error", _UNSIGNED),
        (70, _FILES, "has_attachments_section", "warning", _NO_FILES),
    ],
    ("power_of_attorney", "MVP - pełnomocnictwo"): [
        (10, _DATE, "has_date", "error", "Brakuje daty sporządzenia pełnomocnictwa."),
        (20, "Mocodawca", "has_principal_section", "error", "Brakuje danych mocodawcy."),
        (30, "Pełnomocnik", "has_attorney_section", "error", "Brakuje danych pełnomocnika."),
        (40, "Zakres umocowania", "has_authorization_scope_section", "error", "Brakuje zakresu pełnomocnictwa lub treści umocowania."),
        (50, _SIGNED, "has_signature", "error", "Brakuje podpisu mocodawcy albo oznaczenia miejsca na podpis."),
    ],
}
NO_TEXT = ("Tekst dokumentu", "has_text", "error", "Nie udało się odczytać tekstu dokumentu.")
NO_PROFILE = ("Formal validation profile", "document_type", "warning", "Formal validation is not available for this document type yet.")

# Patterns. Those for Spark also need the flags (?iU).
DATE = r"\b(?:\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{2,4}|\d{4}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{1,2}|\d{1,2}\s+(?:stycz\w*|lut\w*|mar\w*|kwiet\w*|maj(?:a|em|u|o)?|czerwc\w*|lipc\w*|sierp\w*|wrze\w*|pa[zź]dziernik\w*|listopad\w*|grud\w*)\s+\d{4}(?:\s*r\.?)?)\b"
REDACTION = r"\[?\s*utajni\w*\s*[:.]?\s*(data|adres|imie\s*/?\s*nazwisko|imi[eę]\s*/?\s*nazwisko|im|pesel|email|telefon)\s*\]?"
SIGNED = r"\b(?:podpis|podpisano|wlasnoreczny\s+podpis|czytelny\s+podpis|podpis\s+elektroniczny|kwalifikowany\s+podpis|signature|signed)\b"
UNSIGNED = r"\b(?:brak|bez|nie)\s+podpis\w*\b|\bmiejsce\s+pozostawione\s+puste\b"
PESEL = r"\b\d{11}\b"
ADDRESS = r"\b\d+\s+[A-Za-z0-9\s]+(Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln)\b"
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"(?:\+?48[\s\-]?)?[4-9]\d{2}[\s\-]?\d{3}[\s\-]?\d{3}"
PAGE_DATE = r"\b\d{4}[-./]\d{2}[-./]\d{2}\b|\b\d{2}[-./]\d{2}[-./]\d{4}\b"
PAGE_DATE_PL = r"\b\d{1,2}\s+(?:stycz\w*|lut\w*|mar\w*|kwiet\w*|maj(?:a|em|u|o)?|czerw\w*|lip\w*|sierp\w*|wrze\w*|paź\w*|listopad\w*|grud\w*)\.?\s+\d{2,4}"
LABEL = "[UTAJNIONO: {}]"


def listed(words: str) -> list[str]:
    return words.split(", ")
