import random

from newsloom.llm import sitelines

from .fixtures import entities, items


def test_lines_and_blocks(spark):
    e, a = entities(spark)
    rows = [dict(id=i, source_name="The Post" if i % 2 else "post online", clean_text_original=f"Share  this {i}\nAll rights reserved\n\nown text {chr(97 + i)}\n---") for i in range(10)]
    rows += [dict(id=100 + i, source_name="Small", clean_text_original="Share this") for i in range(7)] + [dict(id=300), dict(id=301, source_name="The Post", clean_text_original="")]
    got = {(r[0], r[1]) for r in sitelines.site_lines(items(spark, rows), e, a).collect()}
    assert got == {(i, n) for i in range(10) for n in (1, 2, 5)}
    lengths = {r["length"] for r in sitelines.site_blocks(items(spark, rows), e, a)[1].where("line_no = 1").collect()}
    assert lengths == {2}
    clean = {r["raw_item_id"]: r["text"] for r in sitelines.without_site_lines(items(spark, rows), e, a).collect()}
    assert clean[3] == "\nown text d" and clean[100] == "Share this" and clean[300] is None and clean[301] == ""


def test_disguises_and_share_of_large_source(spark):
    e, a = entities(spark)
    rows = [dict(id=i, source_name="Big", clean_text_original=f"unique {chr(97 + i % 26)}{chr(97 + i // 26)}" + ("\nRеаd tіme" if i < 5 else "\nread time" if i < 9 else "")) for i in range(225)]
    assert sitelines.site_lines(items(spark, rows), e, a).count() == 9
    rows += [dict(id=1000 + i, source_name="Big", clean_text_original=f"x {chr(97 + i)}") for i in range(10)]
    assert sitelines.site_lines(items(spark, rows), e, a).count() == 0
    assert sitelines.site_lines(items(spark, []), e, a).count() == 0


def test_blocks_decide_and_not_lines_alone(spark):
    random.seed(8)
    e, a = entities(spark)
    texts = ["\n".join(random.choice("aaab") * 2 for _ in range(random.randint(0, 9))) for _ in range(60)]
    df = items(spark, [dict(id=i, source_name="S", clean_text_original=t) for i, t in enumerate(texts)])
    docs = [t.split("\n") if t else [] for t in texts]

    def spread(block):
        return sum(any(d[i : i + len(block)] == block for i in range(len(d))) for d in docs)

    for least in (1, 3):
        lengths, covered = {}, set()
        for i, d in enumerate(docs):
            for s in range(len(d)):
                if n := max((n for n in {least, 1, 2, 4, 8} if least <= n <= len(d) - s and spread(d[s : s + n]) >= 8), default=0):
                    lengths[i, s + 1] = n
                    covered |= {(i, x) for x in range(s + 1, s + 1 + n)}
        starts = sitelines.site_blocks(df, e, a, least_lines=least)[1].collect()
        assert {(r["id"], r["line_no"]): r["length"] for r in starts} == lengths
        assert {tuple(r) for r in sitelines.site_lines(df, e, a, least_lines=least).collect()} == covered and covered
