"""The stamped corpus: short templates of formal documents set before the supplied texts, the same in Spark and DuckDB."""

from __future__ import annotations

# Own sentences; each shows a case: complete, unsigned, negated, ... The last stands for a page that could not be read.
TEMPLATES = [
    "UMOWA nr 7 z dnia 12.03.2024\nStrony umowy: zamawiający oraz wykonawca.\nPrzedmiot umowy: remont dachu.\nZałączniki: 1. plan.\nPodpisano w Łodzi, podpis czytelny.",
    "Umowa zlecenia\nZleceniodawca i zleceniobiorca ustalają zakres prac 3 maja 2023 r. oraz 3 Maja 2023 r.\nBrak podpisu.",
    "Umowa. Strony zawarły ją 2024-01-05. Do akt brak załączników, bez opisu przedmiotu.\nmiejsce pozostawione puste",
    "POZEW\nSąd Rejonowy w Gdańsku, wydział cywilny. Powód Jan, pozwany Piotr. Wnoszę o zasądzenie 500 zł.\nWartość przedmiotu sporu: 500.\nUzasadnienie: stan faktyczny jest znany. 1 lutego 2022\nPodpis: JAN",
    "PEŁNOMOCNICTWO\nMocodawca: Ewa. Pełnomocnik: Adam. Upoważniam do reprezentowania w moim imieniu. 07/08/2021 signed",
    "Faktura VAT nr 9, nabywca i sprzedawca, kwota brutto 10,00. Data 1 . 2 . 2023",
    "Deklaracja PIT, NIP 123, urząd skarbowy, podatek.\n[UTAJNIONO: DATA] [UTAJNIONO: IMIE/NAZWISKO] utajniono adres [UTAJNIONO: Email]",
    "",
]

PAGE_TEMPLATES = [
    "PESEL 44051401458 oraz jan.kowal@poczta.example.pl tel 601234567",
    "Data 27.01.1975 i 27 maja 2020 oraz 27 innych MAJA",
    "Nr 2023-05-06, 48601234567 koniec 05.06.2023",
    "bez danych",
]


def values(texts: list[str]) -> str:
    rows = ", ".join(f"({i}, '{t.replace(chr(10), '|')}')" for i, t in enumerate(texts))
    return f"(VALUES {rows}) AS v(slot, template)"


def stamped(documents: str = "documents") -> str:
    """SQL for (doc_id, text): line breaks of templates are written as bars."""
    n = len(TEMPLATES)
    text = f"CASE WHEN d.doc_id % {n} = {n - 1} THEN '' ELSE concat(replace(v.template, '|', chr(10)), chr(10), d.text) END"
    return f"SELECT d.doc_id, {text} AS text FROM {documents} d JOIN {values(TEMPLATES)} ON d.doc_id % {n} = v.slot"


def pages(conversations: str = "conversations") -> str:
    """SQL for (conv_id, turn, text)."""
    n = len(PAGE_TEMPLATES)
    return f"SELECT c.conv_id, c.turn, concat(v.template, ' ', c.text) AS text FROM {conversations} c JOIN {values(PAGE_TEMPLATES)} ON (c.conv_id + c.turn) % {n} = v.slot"
