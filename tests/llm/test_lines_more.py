"""Line dedup: sketches come first, names hold dots, texts are long."""

from docketlake.llm import lines


def test_sketches_are_made_of_raw_rows(spark):
    df = spark.createDataFrame([(i, f"s{i % 30}", "menu\nown " + str(i)) for i in range(200)], "doc_id long, source string, text string")
    lines_ = lines._spread(lines._hashed(df, "text", "source"), lines.MIN_SITES)
    assert {(r.sites, r.exact) for r in lines_.collect()} == {(30, None)}
    plan = lines.spread(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_with_dots_and_clashes(spark):
    rows = [(i, f"s{i}", "menu\nown " + str(i), 7, "k", "h") for i in range(12)]
    df = spark.createDataFrame(rows, "`doc.id` long, `web.site` string, `te.xt` string, removed_lines int, text_key string, hits string")
    out = lines.without_boilerplate(df, text="te.xt", site="web.site")
    assert sorted(out.columns) == sorted(df.columns)
    assert {(r["te.xt"], r.removed_lines, r.text_key, r.hits) for r in out.collect()} == {(f"own {i}", 1, "k", "h") for i in range(12)}


def test_a_very_long_text_and_one_line_of_many_rows(spark):
    long = "\n".join(f"line {i}" for i in range(200_000)) + "\nmenu"
    df = spark.createDataFrame([(0, "s0", long), *((i, f"s{i % 12}", "menu") for i in range(1, 3000))], "doc_id long, source string, text string")
    out = {r.doc_id: r for r in lines.without_boilerplate(df).collect()}
    assert out[0].removed_lines == 1 and out[0].text == long[:-5]
    assert all(out[i].text == "" for i in range(1, 3000))
