"""Trees, archives and paths on small cases."""

import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.functions import text as t
from folium.operators import html, paths
from folium.sources import books


def test_transform_is_ordered_and_undone():
    out = html.transform('<p>One. Two! <b>x <i>y</p><p>z</b><img src="a">', html.ConvertOptions(replacements=(("One", "1"), ("1. ", "!"))))
    assert '<span class="frag" id="frag.1.1">!</span><span class="frag" id="frag.1.2">Two! </span>' in out
    assert '<p><b><i><span class="frag" id="frag.2.1">z</span></i></b>' in out and '<span class="frag" id="frag.3.1"><img src="a"/></span>' in out
    doc = html.parse("<p>A. B.<ul><li>c</ul>d")
    before = html.render(doc)
    html.add_spans(doc, "frag", "frag")
    assert html.find_class(doc, "frag") is not None
    html.remove_spans(doc, "frag")
    assert html.render(doc) == before


def test_pages_are_handed_on_in_pieces():
    pages = [f"<p>{i} said. " + "Words. " * (i % 7) * 3000 for i in range(60)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["page_id", "html"])
    pieces = list(html._mapped(lambda x: html.transform(x), pa.string(), "html", "html")([batch]))
    assert max(p.nbytes for p in pieces) < 12 * html.PIECE < sum(p.nbytes for p in pieces)
    rows = pa.Table.from_batches(pieces).to_pydict()
    assert rows["page_id"] == list(range(len(pages))) and rows["html"] == [None if x is None else html.transform(x) for x in pages]
    events = list(html._mapped(html.body_events, pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])), "html", "events")([batch]))
    assert len(events) == len(pieces) and sum(map(len, events)) == len(pages)


def test_preserved_suffix_is_checked():
    with pytest.raises(ValueError):
        paths.PathOptions(preserve=(".EPUB",))


def test_punctuation_skips_texts_without_signs(spark):
    r = random.Random(3)
    bits = ["-", "--", ".", ". ", "1/2", "1/4", "3/4", "/", "1", "0s", "(c)", "(C)", "(R)", "(tm)", "(", "[", '"', "'", "“", "–", " ", "\n", "a", "é", "😀", "90s", "$1", "\\"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(500)] + [None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string")
    for row in df.withColumn("new", t.smart_punctuation(F.col("text"))).collect():
        expected = row.text
        for p, sign in html._DASHES if row.text else ():
            expected = p.sub(sign, expected)
        assert row.new == expected
    plan = df.select(t.smart_punctuation(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" in plan and "regexp_replace(" not in plan.split("CASE WHEN")[0]


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("b.txt", "b" * 100)
        z.writestr("a/c.txt", "c")
    (tmp_path / "x.EPUB").write_bytes(buffer.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    entries = books.read_archives(spark, str(tmp_path))
    assert [r.error is None for r in entries.orderBy("ord").collect()] == [False, True, True, True]
    good = entries.filter("error is null").selectExpr("'out/y.epub' as out", "*", "name = 'b.txt' as is_changed")
    assert [r.status for r in books.write_archives(good, str(tmp_path)).collect()] == ["converted"]
    with zipfile.ZipFile(tmp_path / "out/y.epub") as z:
        assert z.namelist() == ["mimetype", "a/c.txt", "b.txt"] and z.read("b.txt") == b"b" * 100
