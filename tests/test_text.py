"""Text functions and the reference's own cases."""

import io
import os
import re
import struct
import zipfile
import zlib

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill import core, joins
from leafmill.functions import images, markup, paths, pdf, text
from leafmill.operators import fidelity, package, shaping
from leafmill.plans import catalog, jobs, library, report
from leafmill.sources import epub


def test_math():
    out = text.math_markup("The relation is σ_{family} and the value is x^{2}.")
    assert '<span class="math" role="math">σ<sub>family</sub></span>' in out
    assert '<span class="math" role="math">x<sup>2</sup></span>' in out
    assert "σ<sub>family</sub>" in text.math_markup("sharks = σfamily = Sharks")
    fence = "```text\nrecord_{id}\n```"
    assert text.math_markup(fence) == fence


def test_fragment():
    out, changes = markup.clean_fragment('<p>before</p><page>garbage</page><img src="images/missing.jpg">')
    assert "<page" not in out and "missing.jpg" not in out and "garbage" in out and changes == 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/pdivtrlia=\"' &x", max_size=60))
def test_any_fragment_becomes_xml(s):
    out, _ = markup.clean_fragment(s)
    assert markup.xml_error(f"<div xmlns:epub='e'>{out}</div>") is None


def test_chapters_and_parts(spark):
    docs = spark.createDataFrame([(1, "  # First\n\nA\n\n# Second\n\nB"), (2, "no heading")], "doc_id long, text string")
    got = [tuple(r) for r in shaping.chapters(docs).orderBy("doc_id", "idx").collect()]
    assert got == [(1, 1, "First", "A"), (1, 2, "Second", "B"), (2, 1, "Document", "no heading")]
    marked = spark.createDataFrame([(1, "# A\nx\x01y\x02a\n# B\x01\nz")], "doc_id long, text string")
    assert [(r["title"], r["body"]) for r in shaping.chapters(marked).orderBy("idx").collect()] == [("A", "x\x01y\x02a"), ("B\x01", "z")]
    book = spark.createDataFrame([(1, 1, "Book", "one\n\ntwo\n\nthree")], "doc_id long, idx int, title string, body string")
    parts = shaping.sized(book, 5).orderBy("part_no").collect()
    assert [(r["title"], r["body"]) for r in parts] == [("Book (1/3)", "one"), ("Book (2/3)", "two"), ("Book (3/3)", "three")]


def test_text_layer(spark):
    pages = spark.createDataFrame([(1, 0, "w = r = (n + 1) / 2"), (2, 0, " "), (2, 1, "x"), (2, 2, "")], "doc_id long, page_index int, text string")
    toc = spark.createDataFrame([(1, 0, 1, "Intro", 1)], "doc_id long, ord int, level int, title string, page_number int")
    got = {r["doc_id"]: r["text"] for r in shaping.text_layer(pages, toc).collect()}
    assert got == {1: "# Intro\n\nw = r = (n + 1) / 2", 2: "x"}


def test_normalize(spark):
    cases = ["Hyphen-\nated  TEXT", "ſtraße", "soft\u00adhyphen", " \t\n", "", None]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [tuple(r) for r in df.select(text.normalized(F.col("t")), text.normalized_unicode("t")).collect()]
    assert got[0] == ("hyphenated text",) * 2
    assert got[1] == ("strasse",) * 2
    assert got[2] == ("softhyphen",) * 2 and got[3] == ("", "") and got[5] == (None, None)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="aB É ß ﬁ Σς-\n\t\x1c\x85\u00a0\u00ad\u0130ſ½µ日", max_size=25), max_size=8))
def test_normal_form_is_one_for_both_ways(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for plain, general, t in df.select(text.normalized("t"), text.normalized_unicode("t"), "t").collect():
        assert plain == general, t


def test_normal_form_of_ligatures_and_sigma(spark):
    df = spark.createDataFrame([("ﬁne ΟΔΟΣ",), ("Straße K ² ½",)], "t string")
    assert [r[0] for r in df.select(text.normalized("t")).collect()] == ["fine οδοσ", "strasse k 2 1⁄2"]


def test_paths(spark):
    cases = [("a/b", "../c.x", "a/c.x"), ("", "./d%20e", "d e"), ("a", "b+c?q#f", "a/b+c"), ("a", "../../x", "../x"), ("a", "%zz", "a/%zz"), ("a", "%20%zz%C3%A9%", "a/ %zzé%")]
    df = spark.createDataFrame(cases, "b string, r string, want string")
    assert all(r[0] == r[1] for r in df.select(paths.resolved(F.col("b"), F.col("r")), "want").collect())


def test_fidelity(spark):
    pages = spark.createDataFrame([(1, k, t) for k, t in enumerate(["a b c d e f", "q w e r t y u", "z x c v b n", "", "g h j k l m"])], "doc_id long, page int, text string")
    derived = spark.createDataFrame([(1, "a b c d e f g h j k l m")], "doc_id long, text string")
    by = fidelity.page_coverage(pages, derived)
    assert [r["coverage"] for r in by.orderBy("page").collect()] == [1.0, 0.0, 0.0, 1.0, 1.0]
    assert [(r["first"], r["last"]) for r in fidelity.missing_spans(by).collect()] == [(2, 3)]
    toc = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "nowhere"), (1, 2, "abc")], "doc_id long, ord int, title string")
    counts = spark.createDataFrame([(1, 2, 0, 1)], "doc_id long, source_images int, derived_images int, spine_documents int")
    m = fidelity.metrics(pages, derived, toc, counts)
    found = fidelity.findings(m)
    codes = {r["code"] for r in found.collect()}
    assert codes == {"fidelity/low-text-coverage", "fidelity/missing-span", "fidelity/extra-content", "fidelity/toc-entries-missing", "fidelity/images-dropped"}
    assert report.verdicts(m.select(F.col("doc_id").cast("string").alias("epub")), found).first()["verdict"] == "fail"


def _book(**changed):
    data = epub.built("T", "A", "en", "urn:x", [("chapter_001.xhtml", "One", '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>One</title></head><body><p>hello</p></body></html>')], {})
    parts = {i.filename: zipfile.ZipFile(io.BytesIO(data)).read(i) for i in zipfile.ZipFile(io.BytesIO(data)).infolist()}
    return data, parts


def _codes(spark, tmp_path, files):
    for name, data in files.items():
        (tmp_path / f"{name}.epub").write_bytes(data)
    _, findings, _ = library.validate(epub.read_members(spark, str(tmp_path)))
    out = {name: set() for name in files}
    for r in findings.collect():
        out[r["epub"].rsplit("/", 1)[-1].removesuffix(".epub")].add(r["code"])
    return out


def test_package_rules(spark, tmp_path):
    clean, parts = _book()
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("EPUB/extra.txt", "x")
        z.writestr("mimetype", "wrong")
        for n, b in parts.items():
            if n not in ("mimetype", "EPUB/style/main.css"):
                z.writestr(n, b"<html><body><p>open<a href='gone.xhtml'/><img src='http://x/y'/></body></html>" if n.endswith("chapter_001.xhtml") else b"<html xmlns='http://www.w3.org/1999/xhtml'><body><a href='gone.xhtml'>x</a><img src='http://x/y'/></body></html>" if n.endswith("nav.xhtml") else b)
    got = _codes(spark, tmp_path, {"clean": clean, "bad": raw.getvalue(), "junk": b"no zip"})
    assert got["clean"] == set()
    assert got["junk"] == {"zip/unreadable"}
    assert got["bad"] >= {"ocf/mimetype-not-first", "ocf/mimetype-compressed", "ocf/mimetype-content", "opf/manifest-file-missing", "opf/undeclared-resource", "content/not-xml", "content/remote-resource", "content/broken-reference"}


def test_repair():
    clean, parts = _book()
    assert not epub.repaired(clean)["changed"] and epub.quick_issues(clean) == []
    parts["EPUB/chapter_001.xhtml"] = b"<html><head><title>One</title></head><body><p>open <page>kept</page></body></html>"
    fixed = epub.repaired(epub.archive_bytes(list(parts.items())))
    assert fixed["changed"] and fixed["issues_after"] == [] and fixed["issues_before"]
    assert b"kept" in zipfile.ZipFile(io.BytesIO(fixed["content"])).read("EPUB/chapter_001.xhtml")


def test_build_books(spark):
    chapters = spark.createDataFrame([(1, 1, "chapter_001.xhtml", "One", '<html xmlns="http://www.w3.org/1999/xhtml"><body/></html>')], "doc_id long, number int, name string, title string, xhtml string")
    books = spark.createDataFrame([(1, "T", "A", "en")], "doc_id long, title string, author string, language string")
    row = epub.write_books(chapters, books).first()
    assert epub.quick_issues(bytes(row["content"])) == [] and row["error"] is None


def test_folder_stream(spark, tmp_path):
    from leafmill.streaming import folder

    clean, _ = _book()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(clean)
    seen = []
    for _ in range(2):
        folder.run(folder.new_packages(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, k: seen.extend(r["epub"] for r in df.collect())).awaitTermination()
    assert seen == ["a.epub"]


#: The least JPEG that has a frame of three colours, and PNG images of one pixel.
JPEG = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x01\x00\x01\x03\x01\x11\x00\x02\x11\x00\x03\x11\x00\xff\xda\x00\x02\x00\xff\xd9"


def png(colour=6, samples=4, rows=None):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(1 + samples) if rows is None else rows)) + chunk(b"IEND", b"")


def test_image_probe():
    kinds = [(JPEG, ("JPEG", "RGB", True)), (png(), ("PNG", "RGBA", True)), (png(0, 1), ("PNG", "L", True)), (b"GIF89a" + struct.pack("<HH", 2, 3) + b"\x00" * 4 + b"\x2c\x00\x3b", ("GIF", "P", True)), (b"RIFF" + struct.pack("<I", 20) + b"WEBPVP8 " + b"\x00" * 12, ("WEBP", "RGB", True))]
    for data, (kind, mode, fine) in kinds:
        got = images.probe(data)
        assert (got["format"], got["mode"], got["decodable"]) == (kind, mode, fine)
        for k in range(len(data)):
            images.probe(data[:k])
            images.probe(data[:k] + bytes([data[k] ^ 0x55]) + data[k + 1 :])
    for data in (None, b"", b"no image", JPEG[:-2], png()[:-6], png(rows=b""), png().replace(b"IDAT", b"IDAX")):
        assert not images.probe(data)["decodable"] and images.probe(data)["error"]
    assert images.cover(JPEG) == JPEG and images.cover(png()) is None and images.cover(png(), lambda _: JPEG) == JPEG and images.cover(b"x", lambda _: JPEG) is None and images.cover(png(), lambda _: b"x") is None


def test_cover_repair(tmp_path, spark):
    page = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>One</title></head><body><p><img src="old.png" alt="c"/></p></body></html>'
    data = epub.built("T", "A", "en", "urn:x", [("chapter_001.xhtml", "One", page)], {"old.png": png()}, JPEG)
    assert epub.quick_issues(data) == []
    parts = {r[2]: r[4] for r in epub.members_of("", data)}
    parts["EPUB/content.opf"] = parts["EPUB/content.opf"].replace(b'href="cover.jpg" media-type="image/jpeg"', b'href="old.png" media-type="image/png"').replace(b'id="img_0000" href="old.png"', b'id="x" href="cover.jpg"')
    old = epub.archive_bytes(list(parts.items()))
    assert len(epub.quick_issues(old)) == 1 and "plain JPEG" in epub.quick_issues(old)[0]
    assert epub.repaired(old)["unfixable"] and not epub.repaired(old)["changed"]
    fixed = epub.repaired(old, lambda _: JPEG)
    new = {r[2]: r[4] for r in epub.members_of("", fixed["content"])}
    assert fixed["issues_after"] == [] and "EPUB/old.png" not in new and new["EPUB/cover.jpg"] == JPEG and b"cover.jpg" in new["EPUB/chapter_001.xhtml"]
    # in place, with a backup
    parts["EPUB/chapter_001.xhtml"] = b"<html><body><p>open"
    bad = epub.archive_bytes(list(parts.items()))
    path = tmp_path / "b.epub"
    path.write_bytes(bad)
    for again in range(2):
        row = epub.rewrite(spark.createDataFrame([(str(path),)], "path string")).first()
        assert row["changed"] == (not again) and (tmp_path / "b.epub.bak").read_bytes() == bad
    assert not (tmp_path / "b.epub.tmp").exists() and not epub.structure_issues(path.read_bytes())


def test_convert_the_reference_case(spark):
    texts = spark.createDataFrame([(1, "Book", "A", "# Intro\n\nσ_{family} = Sharks\n\n![](images/page_0_0.jpg)\n\n![](images/page_7_7.jpg)", JPEG), (2, "No: figures", None, None, b"no image")], "doc_id long, title string, author string, text string, cover binary")
    figures = spark.createDataFrame([(1, 0, 0, JPEG)], "doc_id long, page_index int, image_index int, content binary")
    got = {r["doc_id"]: r for r in library.convert(texts, figures).collect()}
    assert got[1]["filename"] == "Book.epub" and got[2]["filename"] == "No_ figures.epub" and got[2]["error"] is None
    files = {r[2]: r[4] for r in epub.members_of("", bytes(got[1]["content"]))}
    page = files["EPUB/chapter_001.xhtml"]
    assert b"<sub>family</sub>" in page and page.count(b"<img") == 1 and files["EPUB/images/page_0_0.jpg"] == JPEG and files["EPUB/cover.jpg"] == JPEG
    assert epub.quick_issues(bytes(got[1]["content"])) == [] and "EPUB/cover.jpg" not in {r[2] for r in epub.members_of("", bytes(got[2]["content"]))}


def test_pages_are_normalized_one_by_one(spark):
    pages = spark.createDataFrame([(1, 0, "one two three four five foo-\n"), (1, 1, " "), (1, 2, "bar six"), (1, 3, "seven eight nine"), (2, 0, "only three words"), (3, 0, "")], "doc_id long, page int, text string")
    derived = spark.createDataFrame([(1, "one two three four five foo- bar six seven eight nine"), (2, "only three words"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["extra_ratio"] for r in fidelity.extra_ratio(pages, derived).collect()}
    assert got == {1: 0.0, 2: 0.0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=6))
def test_shingles_over_page_ends(spark, pages):
    rows = [(1, k, " ".join(p)) for k, p in enumerate(pages)]
    own = [w for p in pages for w in p]
    want = {tuple(own[k : k + 5]) for k in range(len(own) - 4)} or ({tuple(own)} if own else set())
    assert fidelity.joined_runs(spark.createDataFrame(rows, "doc_id long, page int, text string"), ["doc_id"]).distinct().count() == len(want)


def test_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL", 0)
    rows = core.stored(spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 17}" if k % 5 else None) for k in range(500)], "v long, k string"), "t")
    few = core.stored(spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", 3), ("unused", 4)], "k string, n long"), "t")
    for how in ("inner", "left"):
        want = rows.join(few, "k", how).select("v", "k", "n").collect()
        assert sorted(map(repr, joins.looked_up(rows, few, "k", how).select("v", "k", "n").collect())) == sorted(map(repr, want))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        core.shared_folder(Session())


def test_json_outputs(spark):
    from leafmill.sources import recognition

    raw = spark.createDataFrame([("a", '"plain"'), ("b", '{"text": "t", "content": "c"}'), ("c", '{"content": "c"}'), ("d", '["x", "y z"]'), ("e", "not json {"), ("f", "[]")], "name string, text string")
    assert {r["name"]: r["text"] for r in recognition.from_json(raw).collect()} == {"a": "plain", "b": "t", "c": "c", "d": "x\n\ny z", "e": "not json {", "f": ""}


def test_markdown():
    for given_text, want in (
        ("a _b c_ __d__ *e* **f** snake_case_name `_x_`", "<p>a <em>b c</em> <strong>d</strong> <em>e</em> <strong>f</strong> snake_case_name <code>_x_</code></p>"),
        ("- a\n- b\n  1. c\n  2. d\n- e", "<ul><li>a</li><li>b<ol><li>c</li><li>d</li></ol></li><li>e</li></ul>"),
        ("see [the *x*][Y] and [z][]\n\n[y]: <http://h/y> \"t\"\n[Z]: /z", '<p>see <a href="http://h/y">the <em>x</em></a> and <a href="/z">z</a></p>'),
        ("[no][none]", "<p>[no][none]</p>"), ("```\n[y]: /z\n```", "<pre><code>[y]: /z\n</code></pre>"), ("2 * 3 * 4", "<p>2 * 3 * 4</p>"),
    ):
        assert markup.markdown_html(given_text) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab *_`[]()!#->|\n1.:", max_size=60))
def test_any_markdown_becomes_xml(s):
    out, _ = markup.clean_fragment(markup.markdown_html(s))
    assert markup.xml_error(f"<div xmlns:epub='e'>{out}</div>") is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="σxα_^{}$\\()[]a1 =<&\n`", max_size=40))
def test_math_keeps_what_is_no_formula(s):
    out = text.math_markup(s)
    bare = re.sub(r"</?(?:span|sub|sup)[^>]*>", "", out)
    if not re.search(r"[$\\_^]", s) and not re.search("[σα][a-z]{2,}", s):
        assert out == "\n".join(s.splitlines())
    assert bare.count("σ") == s.count("σ") and "<span" not in text.math_markup("```\n" + s.replace("`", "") + "\n```")


def test_command_line(spark, tmp_path, capsys):
    clean, parts = _book()
    (tmp_path / "good.epub").write_bytes(clean)
    assert library.main([str(tmp_path)], spark) == 0 and "good.epub: PASS" in capsys.readouterr().out
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    assert library.main([str(tmp_path), "--json", str(tmp_path / "out")], spark) == 1
    said = capsys.readouterr().out
    assert "bad.epub: FAIL" in said and "zip/unreadable" in said and any(f.startswith("part-") for f in os.listdir(tmp_path / "out"))


def test_render_order_and_bound(spark):
    spine = spark.createDataFrame([("e", k, f"i{k}") for k in range(5)], "epub string, pos int, idref string")
    entries = spark.createDataFrame([("e", f"i{k}", f"p{k}") for k in range(5) if k != 3], "epub string, id string, path string")
    packs = spark.createDataFrame([("e", "p0", "o", None, None)], "epub string, nav_path string, opf_path string, container_error string, opf_error string")
    members = spark.createDataFrame([("e", f"p{k}", b"x", None) for k in (0, 1, 4)], "epub string, name string, content binary, error string")
    assert [r["path"] for r in package.reading_order(spine, entries, packs, members).orderBy("pos").collect()] == ["p1", "p4"]
    rows = package.to_render(spine, entries, packs, members, most=3)
    assert [(r["document"], r["is_nav"], r["content"] is None) for r in rows.orderBy("pos").collect()] == [("p0", True, False), ("p1", False, False), ("p2", False, True)]
    assert [(r["code"], r["location"]) for r in package.render_failures(rows, packs, members).collect()] == [("render/missing-spine-doc", "p2")]


def test_pdf_pages(spark, tmp_path):
    packed = zlib.compress(b"1 0 2 20 << /Type /Pages /Count 12 /Kids [3 0 R] >> << /Type /Page >>")
    cases = [(b"%PDF-1.7 << /Type /Pages /Kids [<< /X 1 >>] /Count 3 >> << /Type /Pages /Count 2 >> << /Type /Page >>", 3), (b"%PDF-1.4 << /Type /Page /A << /B 1 >> >> <</Type/Page>> << /Type /PageLabel >>", 2), (b"%PDF-1.5 5 0 obj << /Type /ObjStm /Filter /FlateDecode >> stream\n" + packed + b"\nendstream", 12), (b"no pdf /Type /Page", None), (b"%PDF-1.4", None), (b"", None), (None, None), (b"%PDF-1.5 << /ObjStm >> stream\nxx", None)]
    assert [pdf.page_count(data) for data, _ in cases] == [n for _, n in cases]
    (tmp_path / "in").mkdir()
    for k, (data, _) in enumerate(cases[:4]):
        (tmp_path / "in" / f"b{k}.{'PDF' if k % 2 else 'pdf'}").write_bytes(data)
    (tmp_path / "in" / "other.txt").write_bytes(b"x")
    log = {r["original_name"]: r for r in jobs.accept(jobs.ingest(spark, str(tmp_path / "in")), str(tmp_path / "kept")).collect()}
    assert {n: (r["status"], r["page_count"], r["code"]) for n, r in log.items()} == {"b0.pdf": ("pending", 3, 200), "b1.PDF": ("pending", 2, 200), "b2.pdf": ("pending", 12, 200), "b3.PDF": ("error", None, 400)}
    assert len({r["job_id"] for r in log.values()}) == 4 and all(os.path.exists(r["pdf_path"]) for r in log.values() if r["code"] == 200) and len(os.listdir(tmp_path / "kept")) == 3


def test_figures_of_equal_index(spark, tmp_path):
    """Of order lines that repeat a number, the first in the table counts, as in DuckDB, however the table is read."""
    import duckdb

    rows = [(k, 1, 1, 10.0, 0.09 if k % 2 else 0.01) for k in range(40)] + [(999, 1, 1, 5.0, 0.0)] * 500 + [(k, 1, 1, 10.0, 0.01 if k % 2 else 0.09) for k in range(40)]
    rows += [(k, 2, 2, 10.0, 0.08 - 0.01 * (r == k % 5)) for r in range(5) for k in range(40)]
    path = f"{tmp_path}/lineitem.parquet"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {', '.join(map(str, rows))}) t(l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount)) TO '{path}'")
    wide = spark.read.parquet(path)
    assert wide.count() == len(rows)
    with duckdb.connect() as c:
        c.sql("SET threads = 1")
        c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
        want = sorted(c.sql(catalog.ORACLES["figures_kept"]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["figures_kept"](spark, str(tmp_path)).collect()) == want
    images = spark.createDataFrame([(1, 0, 0, 7, 100, 100, area, row) for row, area in ((3, 0.1), (1, 0.9), (2, 0.1))], "doc_id long, page_index int, image_index int, xref int, width int, height int, area_fraction double, row int")
    assert shaping.figures_kept(images, ("row",)).count() == 0 and shaping.figures_kept(images.filter("row > 1"), ("row",)).count() == 1
