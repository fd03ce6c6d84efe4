"""Pages and containers: fragments, rewriting, round trips, annotation."""

from __future__ import annotations

import zipfile

import pytest

from lectern.plans import pipeline
from lectern.sources import dom, epub
from lectern.streaming import books as arriving

NS = '<?xml version="1.0"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body>{}</body></html>'


def walk(body: str):
    found = dom.fragments(dom.parse(NS.format(body))[1])
    return [(n.tag, k, dom.fragment_text(n, k)) for n, k, _ in found if n.tag != "body"]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("<p>a <b>b</b> c</p>", [("p", "WHOLE_DOM", "a b c")]),
        ("<div>a<p>b</p>c</div>", [("div", "TEXT", "a"), ("p", "WHOLE_DOM", "bc"), ("p", "TAIL", "c")]),
        ("<div><b>x</b>y<p>z</p></div>", [("b", "WHOLE_DOM", "xy"), ("p", "WHOLE_DOM", "z")]),
        ("<div>\t<p>z</p></div>", [("div", "TEXT", "\t"), ("p", "WHOLE_DOM", "z")]),
        ("<div> \n<p>z</p></div>", [("p", "WHOLE_DOM", "z")]),
        ("<script>var x</script><p>z</p>", [("p", "WHOLE_DOM", "z")]),
    ],
)
def test_fragments(body, expected):
    assert walk(body) == expected


@pytest.mark.parametrize(
    "page, texts",
    [
        (NS.format("<p>a</p><p>b &amp; c</p>"), ["a", "b & c"]),
        ("<p>one<br>two<p>three<!-- no --></p><script>'</p>'</script>", ["onetwo", "three"]),
        (NS.format("<p>a&nbsp;b</p>"), ["a\xa0b"]),
        (NS.format('<meta charset="x"><p>a</p>'), ["a"]),
        ("", []),
        ("<p>   </p><p>x", ["x"]),
        ("<div><p>in <i>it</i></div><p>out", ["in it", "out"]),
    ],
)
def test_paragraphs(spark, page, texts):
    df = spark.createDataFrame([(1, page), (2, None)], "k int, html string")
    assert [r.text for r in dom.page_paragraphs(df).orderBy("para_idx").collect()] == texts


def test_rewrite():
    page = NS.format('<p id="i" class="c">a</p>tail<div>b<p>c</p></div>')
    skipped = len(list(dom.fragments(dom.parse(page)[1]))) - 5
    out = dom.rewrite(page, [None] * skipped + ["A", None, "B", ["C", "D"]])
    assert '<p id="i" class="c">a</p><p class="c">A</p>tail<div>bB<p>c</p><p>CD</p></div>' in out
    assert dom.rewrite(page, []).count("<p") == 2


def container(tmp, name="book", chapters=("one", "two"), suffix="html"):
    long = "That the quarrelsome magistrate, whom the indefatigable widow, who had ignored the admonition that he mentioned because of it, contemplated while the harbour slept, vindicated the melancholy which she perpetuated is what they said that they knew."
    entries = [("mimetype", b"application/epub+zip"), (epub.CONTAINER, b'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')]
    items = "".join(f'<item id="{c}" href="{c}.{suffix}" media-type="application/xhtml+xml"/>' for c in chapters)
    refs = "".join(f'<itemref idref="{c}"/>' for c in chapters)
    entries.append(("O/c.opf", f'<package xmlns="{epub.OPF}"><metadata xmlns:dc="{epub.DC}"><dc:title>T</dc:title><dc:creator>X</dc:creator></metadata><manifest><item id="css" href="s.css" media-type="text/css"/><item id="ncx" href="t.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine><itemref idref="css"/><itemref idref="gone"/>{refs}</spine></package>'.encode()))
    points = "".join(f'<navPoint id="{c}" playOrder="{k + 1}"><navLabel><text>{c}</text></navLabel><content src="{c}.{suffix}"/></navPoint>' for k, c in enumerate(chapters))
    entries.append(("O/t.ncx", f'<ncx xmlns="{epub.NCX}"><navMap>{points}</navMap></ncx>'.encode()))
    entries += [(f"O/{c}.{suffix}", NS.format(f"<p>Short.</p><p>{long}</p><p>{long} {long}</p>").encode()) for c in chapters]
    path = tmp / f"{name}.epub"
    path.write_bytes(epub.pack(entries))
    return path


@pytest.mark.parametrize("suffix", ["html", "xhtml"])
def test_annotated_book(spark, tmp_path, suffix):
    container(tmp_path, suffix=suffix)
    files = epub.entries(epub.read_books(spark, str(tmp_path)))
    lexicon = spark.createDataFrame([("the", 7.0)], "word string, zipf double")
    done = pipeline.annotate_books(files, lexicon=lexicon, pattern="^one$")
    out = {r.entry_path: bytes(r.content) for r in done.entries.collect()}
    before = {r.entry_path: bytes(r.content) for r in files.collect()}
    assert out[f"O/two.{suffix}"] == before[f"O/two.{suffix}"]  # not chosen: byte for byte
    page, notes = out[f"O/one.{suffix}"].decode(), out[f"O/one_ext.{suffix}"].decode()
    assert page.count("#llmnote-") == 2 == notes.count("<h3 ")
    assert f'href="one_ext.{suffix}#llmnote-1"' in page
    package = epub.Package(out["O/c.opf"], "O/c.opf")
    assert package.itemrefs() == ["css", "gone", "one", f"item_one_ext_{suffix}", "two"]
    assert [(r[3], r[2]) for r in epub.Navigation(out["O/t.ncx"]).rows()] == [("one", 1), ("one 译文参考", 3), ("two", 2)]
    assert done.totals.first().n_paragraphs == 2


def test_archive_and_stream(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    container(source)
    lexicon = spark.createDataFrame([("the", 7.0)], "word string, zipf double")
    query = arriving.annotate_arriving(spark, str(source), str(target), str(tmp_path / "cp"), available_now=True, lexicon=lexicon)
    query.awaitTermination(120)
    with zipfile.ZipFile(target / "book.epub") as z:
        first = z.infolist()[0]
        assert (first.filename, first.compress_type) == ("mimetype", zipfile.ZIP_STORED)
        assert "O/one_ext.html" in z.namelist() and z.testzip() is None


def test_metadata_and_labels():
    package = epub.Package(f'<package xmlns="{epub.OPF}"><metadata xmlns:dc="{epub.DC}"><dc:title>T</dc:title><dc:creator>X</dc:creator><dc:creator>Y</dc:creator></metadata><manifest/><spine/></package>'.encode(), "c.opf")
    package.title, package.authors = "A & B", ["N", "M"]
    again = epub.Package(package.content(), "c.opf")
    assert (again.title, again.authors, again.ncx()) == ("A & B", ["N", "M"], None)
    nav = epub.Navigation(f'<ncx xmlns="{epub.NCX}"><navMap><navPoint id="a" playOrder="1"><navLabel><text>x</text></navLabel><content src="a"/></navPoint></navMap></ncx>'.encode())
    nav.relabel(["x"])
    nav.relabel(["y"])
    assert nav.rows()[0][3] == "x - y"
    with pytest.raises(ValueError):
        nav.relabel(["y", "z"])


@pytest.mark.parametrize("name", ["../x", "/x", "a/../../x"])
def test_unsafe_names(tmp_path, name):
    path = tmp_path / "x.epub"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, "x")
    with pytest.raises(ValueError):
        list(epub.unpack(path.read_bytes()))


def test_folder_with_log(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    container(source)
    lexicon = spark.createDataFrame([("the", 7.0)], "word string, zipf double")
    done = pipeline.annotate_folder(spark, str(source), str(tmp_path / "out"), logs=str(tmp_path / "logs"), lexicon=lexicon).collect()
    assert [r.book_id for r in done] == ["book"] and (tmp_path / "out" / "book.epub").stat().st_size == done[0].bytes
    assert "n_notes 6" in next((tmp_path / "logs").glob("annotate_*.log")).read_text()


def shelf(spark):
    """Two books; one has chapters of the same file name in two folders, the other no title."""
    text = "Although the captain remembered the melancholy obligation, the perpetual circumspection, which precipitated an imperceptible deterioration that everyone corroborated, vindicated those who listened because the magistrate equivocated."
    manifest = [("b1", 0, "x1", "a/ch1.xhtml", epub.XHTML_TYPE), ("b1", 1, "x2", "b/ch1.xhtml", epub.XHTML_TYPE), ("b1", 2, "ncx", "toc.ncx", epub.NCX_TYPE), ("b2", 0, "y1", "ch1.html", epub.XHTML_TYPE), ("b2", 1, "y2", ".html", epub.XHTML_TYPE), ("b2", 2, "ncx", "toc.ncx", epub.NCX_TYPE)]
    spine = [("b1", 0, "x1"), ("b1", 1, "x2"), ("b2", 0, "y1"), ("b2", 1, "y2")]
    pages = [(b, h, NS.format(f"<p>{text}</p>")) for b, _, _, h, t in manifest if t == epub.XHTML_TYPE]
    return epub.built(
        spark.createDataFrame(manifest, "book_id string, ord int, item_id string, href string, media_type string"),
        spark.createDataFrame(spine, "book_id string, spine_idx int, idref string"),
        spark.createDataFrame(pages, "book_id string, href string, html string"),
        spark.createDataFrame([("b1", "The First", ["A", "B"])], "book_id string, title string, creators array<string>"),
    )


def test_shelf_annotated(spark):
    files = shelf(spark)
    lexicon = spark.createDataFrame([("the", 7.0)], "word string, zipf double")
    done = pipeline.annotate_books(files, lexicon=lexicon, provider=lambda sentences, systems: [s[-20:] for s in systems])
    said = {(r.book_id, r.note_content) for r in done.notes.collect()}
    assert {b for b, _ in said} == {"b1", "b2"}
    assert all(("“The First”" if b == "b1" else "“未知书籍”") in c for b, c in said)
    entries = done.entries.cache()
    manifest = epub.relation(epub.catalogue(entries), "manifest").where("item_id like 'item%'")
    assert {(r.book_id, r.item_id, r.href) for r in manifest.collect()} >= {("b1", "item_a/ch1_ext_xhtml", "a/ch1_ext.xhtml"), ("b1", "item_b/ch1_ext_xhtml", "b/ch1_ext.xhtml"), ("b2", "item_ch1_ext_html", "ch1_ext.html")}
    named = pipeline.annotate_books(files, lexicon=lexicon, name="Mine", provider=lambda sentences, systems: systems)
    assert all("“Mine”" in r.note_content for r in named.notes.collect())


def test_refused_books(spark):
    rows = [("good", epub.pack([(epub.CONTAINER, b"<x/>"), ("a.txt", b"12345")])), ("broken", b"no zip"), ("null", None), ("large", epub.pack([(epub.CONTAINER, b"<x/>"), ("a.txt", b"1" * 5000)])), ("bare", epub.pack([("a.txt", b"1")]))]
    books = spark.createDataFrame(rows, "book_id string, content binary")
    assert {r.book_id for r in epub.refused(books, entry_bytes=1000).collect()} == {"broken", "null", "large", "bare"}
    assert {r.book_id for r in epub.entries(books, entry_bytes=1000).collect()} == {"good", "bare"}
    assert epub.refused(books.limit(0)).count() == 0
