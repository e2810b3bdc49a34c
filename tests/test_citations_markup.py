import pytest
from pyspark.sql import functions as F

from docketlake.functions import citations as C
from docketlake.functions import markup as M


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("answer", "ids"),
    [
        ("It follows [k40], then [7731], then [k40].", ["k40", "7731"]),
        ("He wrote [recte] and [4], with [a note].", []),
        ("[b12 ,c9] holds; [roll-88]", ["b12", "c9", "roll-88"]),
        ("[Clause 12](a link)", []),
        ("", []),
    ],
)
def test_cited_ids(spark, answer, ids):
    assert value(spark, C.cited_ids(F.lit(answer))) == ids


def test_invalid_ids_and_flags(spark):
    answer = F.lit("Held in [m63], [k40] and [7731].")
    seen = F.array(F.lit("7731"))
    assert value(spark, C.invalid_ids(answer, seen)) == ["k40", "m63"]
    assert not value(spark, C.citation_valid(answer, seen))
    assert not value(spark, C.citation_valid(F.lit(""), seen))
    assert value(spark, C.gold_cited(answer, seen))


def test_numbers_and_segments(spark):
    answer = F.lit("a [d1] b **[d2, d1]** c [1957] d")
    known = F.array(F.lit("d1"), F.lit("d2"))
    assert [tuple(x) for x in value(spark, C.numbers(answer, known))] == [("d1", 1, 2), ("d2", 2, 1)]
    parts = [(s.type, s.text, s.numbers) for s in value(spark, C.segments(answer, known))]
    assert parts == [("text", "a ", None), ("citation", None, [1]), ("text", " b ", None), ("citation", None, [2, 1]), ("text", " c [1957] d", None)]


def t(text, bold=False, italic=False):
    return M.text_span(text, bold, italic)


@pytest.mark.parametrize(
    ("xml", "blocks"),
    [
        ("<document><body></body></document>", []),
        ("<d><para>Plain.</para></d>", [("paragraph", [t("Plain.")])]),
        ("<d><para><b>J.</b> - is</para></d>", [("paragraph", [t("J.", bold=True), t(" - is")])]),
        ("<d><para>a <i>b <b>c</b></i> d</para></d>", [("paragraph", [t("a "), t("b ", italic=True), t("c", True, True), t(" d")])]),
        ('<d><para>See <link href="55">x <b>y</b></link>.</para></d>', [("paragraph", [t("See "), {"type": "link", "text": "x y", "bold": None, "italic": None, "doc_id": "55"}, t(".")])]),
        ("<d><headnote><dbs_act>Act</dbs_act> - z</headnote></d>", [("headnote", [t("Act", bold=True), t(" - z")])]),
        ('<d><para class="fact">F</para></d>', [("fact_label", [t("F")])]),
        ("<d><dbs_members>M</dbs_members></d>", [("counsel", [t("M")])]),
        ("<d><para>  </para><para>x</para></d>", [("paragraph", [t("x")])]),
        ("<d><headnote>a<para>b</para></headnote></d>", [("headnote", [t("a"), t("b")]), ("paragraph", [t("b")])]),
    ],
)
def test_parse_xml(xml, blocks):
    assert [(b["type"], b["spans"]) for b in M.blocks_of(xml)] == blocks


def test_malformed_xml():
    with pytest.raises(ValueError):
        M.blocks_of("<d><para>x</d>", fallback=False)
    assert M.blocks_of("<d><para>x &amp; y</d>") == [{"type": "paragraph", "spans": [t("x & y")]}]
    assert M.blocks_of(None) is None


def test_legacy_html():
    page = "\n<!DOCTYPE html><html><body><p><b>One</b>  two</p><div><p>a</p><p>b</p></div><p>lost"
    assert [b["spans"][0]["text"] for b in M.blocks_of(page)] == ["One two", "ab"]


def test_deep_nesting():
    xml = "<d><para>" + "<b>" * 5000 + "x" + "</b>" * 5000 + "</para></d>"
    assert M.blocks_of(xml) == [{"type": "paragraph", "spans": [t("x", bold=True)]}]


def test_blocks_column(spark):
    df = spark.createDataFrame([("<d><para>x</para></d>",), (None,)], "c string").select(M.blocks(F.col("c")).alias("b"), M.is_legacy(F.col("c")).alias("l"))
    rows = df.collect()
    assert rows[0].b[0].spans[0].text == "x" and rows[1].b is None and rows[0].l is False
