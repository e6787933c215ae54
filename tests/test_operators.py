from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import text as T
from palimpsest.operators import classify, formal, jobs, legal, ocr, pii, rules, store
from palimpsest.sources import readers
from palimpsest.streaming import analysis


def fields(spark, text):
    return formal.extract(spark.createDataFrame([(text,)], "text string")).first()


def test_text_functions(spark):
    row = spark.createDataFrame([(" ŻÓŁĆ straße é-1 ",)], "t string").select(F.expr(T.fold("t")).alias("a"), F.expr(T.searchable("t")).alias("b"), T.classifier_text("t").alias("c"), F.expr(T.strip("t")).alias("d")).first()
    assert (row.a.strip(), row.b, row.c, row.d) == ("zolc strasse é-1", "zolc strasse 1", "zoc strae e 1", "ŻÓŁĆ straße é-1")


def test_negation_reaches_five_words(spark):
    assert not fields(spark, "brak a b c d zalacznik").has_attachments_section
    assert fields(spark, "brak a b c d e zalacznik").has_attachments_section
    assert fields(spark, "brak zalacznika ale a b c d zalacznik jest").has_attachments_section


def test_dates_keep_the_first_spelling_and_five(spark):
    row = fields(spark, "3 Maja 2020, 3 maja 2020 1.1.20 2.1.20 3.1.20 4.1.20 5.1.20 [UTAJNIONO: DATA]")
    assert row.date_candidates == ["3 Maja 2020", "1.1.20", "2.1.20", "3.1.20", "4.1.20"]
    assert row.redaction_labels == ["data"]


def test_signatures_and_null_text(spark):
    assert fields(spark, "Podpis: Jan").has_signature and not fields(spark, "brak podpisu, podpis").has_signature
    row = fields(spark, None)
    assert (row.has_text, row.has_date, row.document_type, row.confidence) == (False, False, "unknown", 0.0)


def test_rule_types(spark):
    held = [("t", "p", 2, "B", "regex_match", "has_date", "error", None, "Tr.e", True), ("t", "p", 1, "A", "required_field", "has_text", "error", " ", None, True), ("t", "p", 3, "C", "date_range", "x", "error", None, None, True), ("t", "p", 0, "D", "required_field", "has_signature", "error", "m", None, False)]
    by_type = rules.profiles(spark.createDataFrame(held, rules.RULE_SCHEMA))
    docs = spark.createDataFrame([("t", True, False), ("t", False, True), ("u", True, True)], "document_type string, has_text boolean, has_date boolean").withColumn("has_signature", F.lit(False))
    out = {(r.document_type, r.has_text): r for r in rules.report(rules.issues(docs, by_type)).collect()}
    assert [i.message for i in out["t", True].issues] == ["Field 'has_date' does not match required pattern"]
    assert [i.field_name for i in out["t", False].issues] == ["has_text", "has_text"] and out["t", False].issues[1].message == "Brakuje wymaganego elementu: A"
    assert out["t", True].total_rules == 4 and out["t", True].completeness_score == 0.75
    assert out["u", True].issues[0].details == {"document_type": "u", "reason": "unsupported_document_type"} and out["u", True].completeness_score == 1.0


def test_rules_see_lists_and_text(spark):
    held = [("t", "p", i, name, "required_field", name, "error", "m", None, True) for i, name in enumerate(["document_text", "date_candidates", "redaction_labels"])]
    held += [("t", "p", 9, "R", "regex_match", "document_text", "error", None, "1.1.*", True)]
    by_type = rules.profiles(spark.createDataFrame(held, rules.RULE_SCHEMA))
    docs = formal.extract(spark.createDataFrame([("1.1.2020 x",), ("",)], "text string")).withColumn("document_type", F.lit("t"))
    got = {r.text: [i.field_name for i in r.issues if i.ord >= 0] for r in rules.issues(docs, by_type).collect()}
    assert got == {"1.1.2020 x": ["redaction_labels"], "": ["document_text", "date_candidates", "redaction_labels", "document_text"]}
    assert rules.broken_patterns(spark, spark.createDataFrame([(*held[-1][:8], p, True) for p in ("a+", "(", None)], rules.RULE_SCHEMA)) == ["("]


@pytest.mark.parametrize(("clamp", "score"), [(True, 0.0), (False, -1.0)])
def test_scores(spark, clamp, score):
    issue = f"array_repeat(CAST(named_struct('ord',1,'rule_name','','field_name','','severity','error','message','','details',map('a','b')) AS {rules.ISSUE}), 2)"
    df = spark.range(1).select(F.lit(1).cast("long").alias("total_rules"), F.lit(True).alias("has_text"), F.expr(issue).alias("issues"))
    assert rules.report(df, clamp).first().completeness_score == score


def page(spark, *texts):
    return spark.createDataFrame([([(t, i * 120, 0, 100, 20) for i, t in enumerate(texts)],)], f"words array<{pii.WORD}>")


def test_detection_stays_out_of_filters(spark):
    each = T.each(pii.personal_data(page(spark, "a", "b")), "found", "w")
    plan = each._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_extract_all" in line or "RLIKE" in line for line in plan.split("\n") if "Filter" in line or "Join" in line)


def test_detectors_match_at_the_start(spark):
    found = pii.personal_data(page(spark, "44051401458,", "(a@b.pl)", "a@b.pl.", "601-234-567", "6012345678", "27.01.1975,", "27.01.1975")).first().found
    assert [(w.text, w.label) for w in found] == [("44051401458,", "[UTAJNIONO: PESEL]"), ("a@b.pl.", "[UTAJNIONO: EMAIL]"), ("601-234-567", "[UTAJNIONO: TELEFON]"), ("27.01.1975", "[UTAJNIONO: DATA]")]


def test_entities_skip_found_places(spark):
    df = page(spark, "1", "maja", "2020", "Jan").withColumn("entities", F.expr("array(named_struct('fragment', 'Jan maja', 'label', 'N'))"))
    assert [(w.text, w.label) for w in pii.personal_data(df, entities="entities").first().found] == [("1", C.LABEL.format("DATA")), ("maja", C.LABEL.format("DATA")), ("2020", C.LABEL.format("DATA")), ("Jan", "N")]


def test_digits_merge_near_their_anchor_only(spark):
    words = [("1", 0, 0, 10, 10), ("2", 40, 5, 10, 10), ("3", 80, 0, 10, 10), ("a", 95, 0, 10, 10), ("4", 120, 0, 10, 10)]
    df = spark.createDataFrame([(words,), ([],)], f"words array<{pii.WORD}>").select(pii.merge_digits("words").alias("m"))
    first, empty = (r.m for r in df.collect())
    assert [(w.text, w.x, w.width, w.height) for w in first] == [("12", 0, 20, 15), ("34", 80, 20, 10), ("a", 95, 10, 10)] and empty == []


def test_payloads(spark):
    rows = ['{"content": " ", "text": " x "}', '{"words_per_page": [[{"tekst": " a "}, {"tekst": " "}], [], [{"tekst": "b"}]]}', '{"pages": [{"lines": ["l1 ", {"content": "l2"}, {"content": " "}]}]}', "no json", None]
    df = spark.createDataFrame([(r,) for r in rows], "p string").select(ocr.payload_text("p").alias("t"))
    assert [r.t for r in df.collect()] == [" x ", "a\nb", "l1\nl2", "", ""]


def test_best_match_takes_the_first_of_equals(spark):
    errors = spark.createDataFrame([("a", 0, "umowa"), ("a", 1, " "), ("a", 2, "zzz")], "analysis_id string, error_idx int, text_reference string")
    words = spark.createDataFrame([("a", i, f"w{i}", t, 1, 2, 3, 4, 1) for i, t in enumerate(["xyz", "Umowy", "umowa", "UMOWA"])], "analysis_id string, idx int, word_id string, text string, x int, y int, width int, height int, page int")
    assert {r.error_idx: r.word_id for r in legal.locate(errors, words).collect()} == {0: "w2", 1: None, 2: None}


def test_store(spark):
    df = spark.createDataFrame([(i, i % 2, None if i == 3 else i) for i in range(30)], "id int, owner_id int, v int")
    assert store.one_or_none(df, id=4).v == 4 and store.one_or_none(df, id=99) is None
    with pytest.raises(ValueError):
        store.one_or_none(df, owner_id=1)
    with pytest.raises(ValueError):
        store.page(df, 1, 101)
    assert store.visible(df, 1).count() == 15 and store.visible(df, 1, admin=True).count() == 30
    new = store.updated(df, spark.createDataFrame([(3, 7), (4, None)], "id int, v int"), "id")
    assert {r.id: r.v for r in new.where("id in (3, 4)").collect()} == {3: 7, 4: 4} and store.page_count(df.limit(0)).first().pages == 0


def test_classifier(spark):
    corpus = readers.synthetic_corpus(spark, {"invoices": "faktura vat kwota nabywca", "contracts": "umowa strony zakres prace", "odd": "qqq www eee rrr"}, each=8)
    model = classify.train(corpus, rounds=30)
    rows = {r.text: r for r in classify.classify(spark.createDataFrame([("faktura VAT kwota",), ("umowa, strony",), ("qqq www",), ("",)], "text string"), model).collect()}
    assert [rows[t].model_type for t in ("faktura VAT kwota", "umowa, strony", "qqq www", "")] == ["invoice", "contract", "other", None]


def test_recognition_errors_stay_in_the_row(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def engine(content, path):
        if content == b"bad":
            raise OSError("broken")
        return [[{"text": "w", "x": 1, "y": 2, "width": 3, "height": 4}]]

    rows = {r.path[-5:]: r for r in readers.recognised(readers.files(spark, str(tmp_path)), engine).collect()}
    assert rows["a.pdf"].pages[0][0].text == "w" and rows["b.pdf"].error == "OSError: broken"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, t, datetime(2024, 1, 1, i)) for i, t in enumerate(["Umowa strony umowy 1.1.2024 podpis", "", "Faktura VAT"])]
    older = (0, "POZEW sąd rejonowy", datetime(2023, 1, 1))
    docs = spark.createDataFrame([older, *rows, rows[0]], "doc_id long, text string, sent_at timestamp")
    docs.write.parquet(str(tmp_path / "in"))
    by_type = rules.profiles(rules.builtin_rules(spark))
    analysis.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), by_type).awaitTermination(120)
    got = analysis.latest(spark.read.parquet(str(tmp_path / "out"))).select(*analysis.REPORT)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, analysis.analyse(docs.where("year(sent_at) = 2024").dropDuplicates(["doc_id"]), by_type).collect()))


def test_a_bad_pattern_fails_its_documents_alone(spark):
    held = [("t", "p", 1, "A", "regex_match", "document_text", "error", None, "(", True), ("u", "q", 1, "B", "regex_match", "document_text", "error", None, "(", False)]
    docs = spark.createDataFrame([("pozew",), (None,)], "text string")
    by_type = rules.profiles(spark.createDataFrame(held, rules.RULE_SCHEMA).withColumn("document_type", F.expr("IF(document_type = 't', 'lawsuit', 'unknown')")))
    got = {r.text: (r.status, r.error_message, r.is_complete, r.document_status) for r in jobs.analysed(docs, by_type).collect()}
    assert got == {"pozew": ("failed", "not a regular expression: (", None, "queued"), None: ("completed", None, False, "processed")}


def test_classifier_is_stored_or_not_ready(spark, tmp_path):
    path = str(tmp_path / "model")
    docs = spark.createDataFrame([("faktura vat netto brutto",), ("",)], "text string")
    with pytest.raises(classify.NotReady):
        classify.load(spark, path)
    plain = jobs.analysed(docs, rules.profiles(rules.builtin_rules(spark)), lambda rows: classify.stored_or_none(rows, path))
    keywords = {r.text: r.document_type for r in formal.extract(docs).collect()}
    assert {r.text: r.document_type for r in plain.collect()} == keywords
    corpus = readers.synthetic_corpus(spark, {"faktura_vat": "faktura netto brutto vat", "pozew": "powod pozwany sad pozew"}, 10)
    classify.save(classify.train(corpus), path)
    got = {r.text: (r.model_type, r.model_confidence is None) for r in classify.stored_or_none(docs, path).collect()}
    assert got[""][0] is None and got["faktura vat netto brutto"][0] not in (None, "unknown")


def test_named_entities_by_language(spark):
    words = [("Jan", 0, 0, 9, 9), ("de", 10, 0, 9, 9), ("Kowal", 20, 0, 9, 9)]
    raw = [("kowal  JAN", "PERSON"), ("de", "GPE"), ("de", "placeName")]
    pages = spark.createDataFrame([("en", words, raw), ("pl", words, raw), (None, words, raw), ("en", words[:1], raw)], f"lang string, words array<{pii.WORD}>, raw array<struct<fragment:string,kind:string>>")
    rows = pii.personal_data(pages.withColumn("entities", pii.routed("raw", "lang")), entities="entities").collect()
    got = [[(w.text, w.label[12:-1]) for w in r.found] for r in rows]
    assert got == [[("Kowal", "IMIE/NAZWISKO"), ("Jan", "IMIE/NAZWISKO")], [("de", "ADRES")], [("de", "ADRES")], []]


def test_zoom_falls_until_pages_fit():
    seen = []

    def engine(least):
        def run(content, path, zoom):
            seen.append(round(zoom, 2))
            if zoom > least:
                raise readers.TooLarge("pixels")
            return [path]

        return run

    assert readers.zoomed(engine(1.4))(b"", "a") == ["a"] and seen == [2.08, 1.39]
    with pytest.raises(readers.TooLarge):
        readers.zoomed(engine(0.5))(b"", "a")
    assert seen[2:] == [2.08, 1.39]
    with pytest.raises(readers.TooLarge):
        readers.zoomed(engine(0.5), 720)(b"", "a")
    assert seen[4:] == [10.0, 6.67, 4.44]


def test_corpus_splits_differ(spark):
    rows = readers.synthetic_splits(spark, {"a": "x y z", "b": "u v w"}, 4, 2).collect()
    assert sorted({(r.split, r.label, r.i) for r in rows}) == [(s, c, i) for s, n in (("train", 4), ("valid", 2)) for c in "ab" for i in range(n)]
    assert {r.text for r in rows if r.split == "valid"}.isdisjoint({r.text for r in rows if r.split == "train"})


def test_missing_files_and_requests(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "b", bytearray(b"x"))], "doc_id long, path string, content binary")
    got = {r.doc_id: (r.status, r.error_message, r.pages) for r in jobs.recognised(docs).collect()}
    assert got == {1: ("ocr_failed", "there is no file", []), 2: ("ocr_failed", "no recognition engine is configured", [])}
    with pytest.raises(ValueError):
        jobs.requested(docs, "post")
