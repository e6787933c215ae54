import re
import time

from pyspark.sql import functions as F

from palimpsest.llm import html_text, pseudonyms


def test_malformed_tags_take_linear_time():
    began = time.time()
    for page in ("<a " + "/" * 5000 + "'", "<a " + " /" * 5000 + '"x', "<p a='" * 3000, "<div>" * 20_000 + "</p></b>" * 20_000, "<a \"'" * 3000 + ">x", "<script" + " " * 20_000):
        html_text.main_text(page)
    assert time.time() - began < 20


def test_foreign_and_paragraph_cases():
    assert html_text.main_text('<article><p>one</p><svg class="i"/><p>two</p><svg><text>x</text></svg><p>three</p></article>') == "one\ntwo\nthree"
    assert html_text.main_text('<article><p class="ad-free reading">a</p><p class="social-history">b</p><p class="ad">c</p><object><p>d</p></object></article>') == "a\nb\nd"


def test_mail_names_are_permuted(spark):
    rows = [(i, f"to {name}@example.com.", 7, 8, 9) for i, name in enumerate([*"abcdefghijklmnopqrstuvwxyz", "jan.kowal-12", "Jan.Kowal_12", "x" * 64])]
    df = spark.createDataFrame(rows, "doc_id int, text string, _found int, _moved int, n_findings int")
    once = pseudonyms.pseudonymise(df, "k")
    assert once.columns == [*df.columns, "n_findings_"] and once.where("_found <> 7 OR _moved <> 8 OR n_findings <> 9").isEmpty()
    got = {r.doc_id: r.text for r in once.collect()}
    assert len(set(got.values())) == len(rows)
    assert all(re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", got[i]))).endswith("@aaaaaaa.aaa.") for i in got)
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymise(once.select("doc_id", "text"), "k", undo=True).collect()} == {r[0]: r[1] for r in rows}
    assert pseudonyms.pseudonymise(df.limit(0), "k").count() == 0
    assert pseudonyms.pseudonymise(df.where("doc_id = 26").withColumn("text", F.expr("repeat(text, 5000)")), "k").first().n_findings_ == 5000
