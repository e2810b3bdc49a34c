"""One row of each group stays where a key stands for several texts."""

from docketlake.llm import jaccard

A, B, C = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, "g") for i, t in rows], "doc_id long, text string, k1 string")
    out = jaccard.one_per_group(df)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_another_text_under_the_key_stays(spark):
    assert kept(spark, [(7, A), (9, A), (7, B), (3, B)]) == [(3, B), (9, A)]
    assert kept(spark, [(7, C), (7, B), (3, B)]) == [(3, B), (7, C)]


def test_near_copies_under_one_key(spark):
    assert kept(spark, [(5, A), (5, A + " end"), (5, A), (5, C), (8, C + " end"), (2, B)]) == [(2, B), (5, A), (8, C + " end")]


def test_texts_without_words(spark):
    rows = [(1, None), (1, ""), (1, ""), (1, A), (None, A), (None, A), (0, A)]
    assert kept(spark, rows) == sorted([(0, A), (1, ""), (1, None), (None, A), (None, A)], key=repr)
