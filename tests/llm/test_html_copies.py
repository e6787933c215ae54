from palimpsest.llm import html_text


def test_copies_and_article_bodies_are_no_template(spark):
    foot = "<div>Site <i>line</i></div>"
    copy = f"<body>{foot}<article><div class=body><p>one</p><ul><li>two</ul><table><tr><td>three</table></div></article>"
    bare = f"<body>{foot}<div><p>no article</p></div>"
    shared = "<div><p>kept in every article</p></div><div>by a machine</div>"
    rows = [(i, f"http://a.example/?from={i}", copy + f"<footer>{i}</footer>") for i in range(6)]
    rows += [(10 + i, f"http://a.example/{i}", f"<body>{foot}<article>{shared}<p>text {i}</p></article>") for i in range(6)]
    rows += [(20 + i, f"http://b.example/?from={i}", bare) for i in range(6)] + [(30 + i, f"http://b.example/{i}", f"<body>{foot}<p>text {i}</p>") for i in range(6)]
    rows += [(40 + i, "http://c.example/", bare) for i in range(6)]
    want = {i: "one\ntwo\nthree" for i in range(6)} | {10 + i: f"kept in every article\ntext {i}" for i in range(6)}
    want |= {20 + i: "no article" for i in range(6)} | {30 + i: f"text {i}" for i in range(6)} | {40 + i: "Site line\nno article" for i in range(6)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want
    assert {r.page_id: r.text for r in html_text.extract(pages, broadcast_rows=0).collect()} == want
    assert {html_text.main_text(copy, html_text.template_candidates(html_text.parse(copy)))} == {"one\ntwo\nthree"}
