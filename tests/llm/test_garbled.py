import pytest

from newsloom.llm import garbled

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


@pytest.fixture(scope="module")
def fixer(spark):
    return garbled.Repairer(garbled.language_samples(spark.read.parquet(SAMPLES)))


def wrong(text, encoding):
    return "".join(bytes([b]).decode(encoding) if b < 128 or encoding != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())


def test_round_trips(fixer, spark):
    texts = [r["text"] for r in spark.read.parquet(SAMPLES).where("lang in ('ta', 'hi', 'te', 'fr', 'mr')").orderBy("sample_id").limit(40).collect()]
    done = 0
    for text in texts:
        for encoding in ("cp1252", "latin-1", "mac_roman"):
            done += fixer.text(wrong(text, encoding))[0] == text
        done += fixer.text(wrong(wrong(text, "cp1252"), "cp1252"))[0] == text
    assert done >= 0.95 * 4 * len(texts)


def test_proper_text_stays(fixer):
    for text in ("the CHÂTEAU D’ÉTÉ stall", "SÃO VERÃO docked", "«MAÇÃ E PÃO»", "NAÏVE on £4", "Là où l’été a été très sec", "The ship «Заря» left", "α-4, 12 km², 20 °C", "", "plain"):
        assert fixer.text(text) == (text, ""), text


def test_spark(spark):
    rows = [(1, "the cafÃ© near"), (2, "impay�es"), (3, None), (4, ""), (5, "fine"), (1, "the cafÃ© near"), (6, "une longue grÃ¨ve " * 300)]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, broken boolean")
    samples = spark.read.parquet(SAMPLES)
    got = sorted((r["doc_id"], r["text_new"][:14], r["broken"]) for r in garbled.garbled(df, samples).collect())
    assert got == [(1, "the café near", False), (1, "the café near", False), (2, "impay�es", True), (6, "une longue grè", False)]
    assert garbled.garbled(df.limit(0), samples).count() == 0
    assert garbled.garbled(df, samples.limit(0)).where("doc_id = 2").count() == 1
