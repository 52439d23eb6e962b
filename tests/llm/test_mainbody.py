from newsloom.llm import mainbody

from .fixtures import entities, items

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"
BODY = "The council approved the repair of the old road after a long debate in the town hall on Monday."


def page(n):
    return f"""<html lang="en"><head><title>Road repair number {n} approved | The Post</title>
<script>var a=1;</script>
</head><body>
<nav><ul>
<li><a href="/1">Home</a></li>
</ul></nav>
<div class="m">
<h1>Road repair number {n} approved</h1>
<p class="b">By Ann Lee</p>
<p>{BODY} It was point {n}.</p>
<h2>What comes next</h2>
<p><a href="/t/1">The department</a> said the work on the bridge would begin before the rains, whatever the cost.</p>
<div><a href="/s/2">Another story of the day</a><p>The minister said the water of the lake was safe for all the people of the town.</p></div>
<p>Share this story: Post | Mail</p>
</div>
<div class="c">
<p>I have lived here for years and the council never did a thing about the road.</p>
</div>
<footer>© The Post</footer>
</body></html>"""


def test_page_and_lost_markup(spark):
    rows = [dict(id=i, source_name="The Post", title=None, raw_text_original=page(i)) for i in range(3)]
    rows.append(dict(id=9, source_name="The Post", title="A plain headline", raw_text_original=f"Home\nSport\nA plain headline\n{BODY}\nContact"))
    rows += [dict(id=20), dict(id=21, raw_text_original=""), dict(id=22, raw_text_original="<p></p>"), dict(rows[0])]
    got = {}
    for r in mainbody.body_lines(items(spark, rows), *entities(spark), spark.read.parquet(SAMPLES)).collect():
        got.setdefault(r[0], []).append(r[1])
    assert {k: sorted(v) for k, v in got.items()} == {0: [8, 10, 11, 12], 1: [8, 10, 11, 12], 2: [8, 10, 11, 12], 9: [3, 4]}
    bodies = {r[0]: r[1] for r in mainbody.main_bodies(items(spark, rows[3:4]), *entities(spark), spark.read.parquet(SAMPLES)).collect()}
    assert bodies == {9: f"A plain headline\n{BODY}"}
    assert mainbody.body_lines(items(spark, []), *entities(spark), spark.read.parquet(SAMPLES)).count() == 0


def test_lines_on_many_pages_are_left_out():
    often = {mainbody.line_key("Nonsense report, Kaali people know the truth."): False}
    found = mainbody.blocks(f"A headline\n{BODY}\nNonsense report, Meeli people know the truth.", "A headline", (), frozenset(["the", "of"]))
    assert [n for n, _ in mainbody.main_lines(found, often)] == [1, 2]


def kept(page):
    found = mainbody.blocks(page, None, (), frozenset(["the", "of", "and", "in"]))
    return [(n, k) for n, k in mainbody.main_lines(found, {})]


def test_lists_in_an_article():
    page = f"<html><body>\n<article>\n<h1>The headline</h1>\n<p>{BODY}</p>\n<ul>\n<li>a first point on the road</li>\n<li>a second one in the hall</li>\n</ul>\n<p>{BODY}</p>\n</article>\n</body></html>"
    assert [n for n, _ in kept(page)] == [3, 4, 6, 7, 9]


def test_paragraphs_in_elements_of_their_own_and_articles_in_parts():
    page = f"<html><body>\n<h1>The headline</h1>\n<div>\n<p>{BODY}</p>\n</div>\n<div>\n<p>{BODY}</p>\n</div>\n<div class='ad'>\n<p>Buy the best of all the things in the shop of the town now.</p>\n</div>\n</body></html>"
    assert [n for n, _ in kept(page)] == [2, 4, 7]
    page = f"<html><body>\n<section class='s'>\n<h1>The headline</h1>\n<p>{BODY}</p>\n</section>\n<section class='s'>\n<p>{BODY} And the rest of it.</p>\n</section>\n</body></html>"
    assert [n for n, _ in kept(page)] == [3, 4, 7]


def test_page_in_one_line(spark):
    page = f"<html><head><title>The headline | Post</title></head><body><nav><a href='/1'>Home</a></nav><article><h1>The headline</h1><p>{BODY}</p><p>{BODY} More.</p></article><footer><p>The Post of the town.</p></footer></body></html>"
    df = items(spark, [dict(id=1, source_name="Post", raw_text_original=page)])
    assert [tuple(r) for r in mainbody.body_lines(df, *entities(spark), spark.read.parquet(SAMPLES)).collect()] == [(1, 1)]
    assert mainbody.main_bodies(df, *entities(spark), spark.read.parquet(SAMPLES)).first()["body"] == f"The headline\n{BODY}\n{BODY} More."
