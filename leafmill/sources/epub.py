"""EPUB archives: a Spark data source of members, tables made from them, a writer and repair.

``format("epub")`` lists archives on the driver and opens each in a task of its own: one row for each member with its order, compression and bytes; an archive that
cannot be opened gives one row with ``error``, a damaged member a row with its name and ``error``.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import core
from ..functions import images as pictures
from ..functions import markup
from ..functions.batches import on_batches

MEMBERS = "epub string, ord int, name string, compress_type int, content binary, error string"
MEMBERS_A_BATCH = 64
_ARROW = pa.schema([("epub", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("compress_type", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/"}
FIELDS = ("identifier", "title", "language")


def members_of(epub: str, data: bytes) -> list[tuple]:
    """Rows of MEMBERS for the bytes of an archive."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError) as e:
        return [(epub, None, None, None, None, f"not an archive: {e}")]
    rows = []
    for k, info in enumerate(archive.infolist()):
        try:
            rows.append((epub, k, info.filename, info.compress_type, archive.read(info), None))
        except (zipfile.BadZipFile, OSError, zlib.error, NotImplementedError, RuntimeError) as e:
            rows.append((epub, k, info.filename, info.compress_type, None, f"damaged member: {e}"))
    return rows


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        system, path = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.path.lower().endswith(".epub")] or [_File("")]

    def read(self, partition):
        if partition.path:
            system = fs.FileSystem.from_uri(self.path)[0] if ":/" in self.path else fs.LocalFileSystem()
            with system.open_input_file(partition.path) as f:
                rows = members_of(partition.path, f.read())
            for k in range(0, len(rows), MEMBERS_A_BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + MEMBERS_A_BATCH], strict=True), _ARROW, strict=True)], schema=_ARROW)


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema):
        return _Reader(self.options["path"])


def read_members(spark: SparkSession, path: str) -> DataFrame:
    core.ship(spark)
    spark.dataSource.register(EpubSource)
    return spark.read.format("epub").load(path)


def _resolve(folder: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(folder, unquote(urlparse(href).path)))


def package_of(members: pd.DataFrame) -> pd.DataFrame:
    """One package as one row: container and OPF errors, paths, manifest, spine, metadata."""
    content = {n: c for n, c in zip(members["name"], members["content"], strict=True) if n is not None}
    out = {"epub": members["epub"].iloc[0], "container_error": None, "opf_path": None, "opf_error": None, "nav_path": None, "ncx_path": None, "cover_path": None, "manifest": [], "spine": [], "metadata": []}

    def done():
        return pd.DataFrame([out])

    box = content.get("META-INF/container.xml")
    if box is None:
        return done()
    try:
        root = ET.fromstring(box)
    except ET.ParseError as e:
        out["container_error"] = str(e)
        return done()
    first = root.find(".//c:rootfile", NS)
    out["opf_path"] = None if first is None else first.get("full-path")
    if not out["opf_path"] or out["opf_path"] not in content:
        return done()
    try:
        opf = ET.fromstring(content[out["opf_path"]])
    except ET.ParseError as e:
        out["opf_error"] = str(e)
        return done()
    folder = posixpath.dirname(out["opf_path"])
    paths = {}
    for k, item in enumerate(opf.iterfind(".//o:manifest/o:item", NS)):
        row = {"ord": k, "id": item.get("id", ""), "href": item.get("href", ""), "path": _resolve(folder, item.get("href", "")), "media_type": item.get("media-type", ""), "properties": (item.get("properties") or "").split()}
        out["manifest"].append(row)
        paths[row["id"]] = row["path"]
        if "nav" in row["properties"]:
            out["nav_path"] = row["path"]
        if "cover-image" in row["properties"] and out["cover_path"] is None:
            out["cover_path"] = row["path"]
    spine = opf.find(".//o:spine", NS)
    if spine is not None:
        out["ncx_path"] = paths.get(spine.get("toc"))
        out["spine"] = [{"pos": k, "idref": x.get("idref", "")} for k, x in enumerate(spine.iterfind("o:itemref", NS))]
    if out["cover_path"] is None:
        for meta in opf.iterfind(".//o:meta", NS):
            if meta.get("name") == "cover":
                out["cover_path"] = paths.get(meta.get("content"))
    for field in FIELDS:
        found = opf.find(f".//d:{field}", NS)
        out["metadata"].append({"field": field, "value": None if found is None else (found.text or "").strip()})
    return done()


PACKAGE = (
    "epub string, container_error string, opf_path string, opf_error string, nav_path string, ncx_path string, cover_path string, manifest array<struct<ord:int,id:string,href:string,path:string,media_type:string,properties:array<string>>>,"
    " spine array<struct<pos:int,idref:string>>, metadata array<struct<field:string,value:string>>"
)


def packages(members: DataFrame) -> DataFrame:
    """One row for each package. Only the container and OPF members are shuffled."""
    small = members.filter("name = 'META-INF/container.xml' or name like '%.opf'").select("epub", "name", "content")
    return small.groupBy("epub").applyInPandas(package_of, PACKAGE)


def manifest(packs: DataFrame) -> DataFrame:
    return packs.select("epub", F.explode("manifest").alias("m")).select("epub", "m.*")


def spine(packs: DataFrame) -> DataFrame:
    return packs.select("epub", F.explode("spine").alias("s")).select("epub", "s.*")


def metadata(packs: DataFrame) -> DataFrame:
    return packs.select("epub", F.explode("metadata").alias("m")).select("epub", "m.*")


def _document(content: bytes) -> dict:
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        tree = markup.parse(content.decode("utf-8", "replace"))
        return {"xml_error": str(e), "namespace": None, "refs": [], "text": _loose_text(tree)}
    space = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else None
    refs = [{"tag": e.tag.rpartition("}")[2], "attr": a, "value": e.get(a)} for e in root.iter() if isinstance(e.tag, str) for a in markup.REFERENCE_ATTRIBUTES if e.get(a)]
    texts: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            texts.append(x)
        elif isinstance(x.tag, str) and x.tag.rpartition("}")[2] not in ("script", "style"):
            # what follows a script or style within its parent goes with it
            for child in reversed(x):
                if child.tail and not (isinstance(child.tag, str) and child.tag.rpartition("}")[2] in ("script", "style")):
                    todo.append(child.tail)
                todo.append(child)
            if x.text:
                todo.append(x.text)
    return {"xml_error": None, "namespace": space, "refs": refs, "text": " ".join(texts)}


def _loose_text(tree: list) -> str:
    texts, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            texts.append(x)
        elif x is not None and x[0] not in ("script", "style"):
            todo.extend(reversed(x[2]))
    return " ".join(texts)


@on_batches("struct<xml_error:string,namespace:string,refs:array<struct<tag:string,attr:string,value:string>>,text:string>")
def document_parsed(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_document(c) for c in contents], columns=["xml_error", "namespace", "refs", "text"])


def documents(members: DataFrame, entries: DataFrame) -> DataFrame:
    """(epub, path, xml_error, namespace, refs, text) of the content documents that a manifest names."""
    named = entries.filter("media_type = 'application/xhtml+xml' or endswith(path, '.xhtml') or endswith(path, '.html')").select("epub", "path").distinct()
    return named.join(members.select("epub", F.col("name").alias("path"), "content"), ["epub", "path"]).withColumn("d", document_parsed("content")).select("epub", "path", "d.*")


def spine_documents(members: DataFrame, order: DataFrame) -> DataFrame:
    """(epub, path, text) of the documents that a spine names. order(epub, path, ...)."""
    named = order.select("epub", "path").distinct()
    return named.join(members.select("epub", F.col("name").alias("path"), "content"), ["epub", "path"]).withColumn("d", document_parsed("content")).select("epub", "path", "d.text")


def refs(docs: DataFrame) -> DataFrame:
    return docs.select("epub", F.col("path").alias("doc_path"), F.posexplode("refs").alias("ord", "r")).select("epub", "doc_path", "ord", "r.*")


def zipped(parts: list[tuple[str, bytes, int]]) -> bytes:
    """An archive of (name, content, compression), with fixed times so that equal parts give equal bytes."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, data, kind in parts:
            z.writestr(zipfile.ZipInfo(name), data, kind)
    return raw.getvalue()


def archive_bytes(parts: list[tuple[str, bytes]]) -> bytes:
    """An archive with the mimetype first and stored, all else deflated."""
    return zipped([("mimetype", b"application/epub+zip", zipfile.ZIP_STORED), *((n, b, zipfile.ZIP_DEFLATED) for n, b in parts if n != "mimetype")])


_CONTAINER = b'<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


#: The style sheet of written books.
_STYLE = b"""body { font-family: Georgia, serif; line-height: 1.6; margin: 1em 2em; }
h1, h2, h3 { margin-top: 1.5em; }
p { margin: 0.5em 0; text-indent: 1.5em; }
img { max-width: 100%; height: auto; }
.math { font-family: "STIX Two Math", "Cambria Math", "DejaVu Serif", serif; white-space: nowrap; }
.math sub, .math sup { font-size: 0.75em; line-height: 0; }
pre, code { font-family: monospace; background: #f4f4f4; padding: 0.2em 0.4em; }
pre { white-space: pre-wrap; overflow-wrap: break-word; }
code { overflow-wrap: break-word; }
table { border-collapse: collapse; width: 100%; }
th, td { border: 1px solid #ccc; padding: 0.4em 0.8em; overflow-wrap: break-word; }
"""
_COVER = "cover.jpg"


def built(title: str, author: str, language: str, identifier: str, chapters: list[tuple[str, str, str]], images: dict[str, bytes], cover: bytes | None = None) -> bytes:
    """A package of chapters (name, title, xhtml), images by path and a cover (a plain JPEG). Raises ValueError if the archive that was written has an issue."""
    from html import escape

    items = [f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, (n, _, _) in enumerate(chapters)]
    items += [f'<item id="img_{k:04d}" href="{escape(n)}" media-type="{_MIME.get(n.rpartition(".")[2].lower(), "image/jpeg")}"/>' for k, n in enumerate(sorted(images))]
    meta = ""
    if cover:
        items.append(f'<item id="cover-img" href="{_COVER}" media-type="image/jpeg" properties="cover-image"/>')
        meta = '<meta name="cover" content="cover-img"/>'
    opf = f'<?xml version="1.0"?><package xmlns="{NS["o"]}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{NS["d"]}"><dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>{escape(language)}</dc:language>{meta}</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style/main.css" media-type="text/css"/>{"".join(items)}</manifest><spine toc="ncx"><itemref idref="nav"/>{"".join(f"""<itemref idref="c{k}"/>""" for k in range(len(chapters)))}</spine></package>'
    nav = '<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>' + "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, t, _ in chapters) + "</ol></nav></body></html>"
    points = "".join(f'<navPoint id="p{k}" playOrder="{k + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for k, (n, t, _) in enumerate(chapters))
    ncx = f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{escape(identifier)}"/></head><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>'
    parts = [("META-INF/container.xml", _CONTAINER), ("EPUB/content.opf", opf.encode()), ("EPUB/nav.xhtml", nav.encode()), ("EPUB/toc.ncx", ncx.encode()), ("EPUB/style/main.css", _STYLE)]
    parts += [(f"EPUB/{n}", x.encode()) for n, _, x in chapters] + [(f"EPUB/{n}", bytes(b)) for n, b in sorted(images.items())]
    if cover:
        parts.append((f"EPUB/{_COVER}", cover))
    data = archive_bytes(parts)
    if found := structure_issues(data):
        raise ValueError("; ".join(found))
    return data


def write_books(chapters: DataFrame, books: DataFrame, convert=None) -> DataFrame:
    """(doc_id, content, error): packages from chapter_documents() and books(doc_id, title, author, language[, images map<string,binary>][, cover binary]).

    A cover that is no plain JPEG goes through ``convert`` (bytes to JPEG bytes), if given, else the book has none. A book that fails its own check has an error and no content.
    """

    def build(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:
            return pd.DataFrame({"doc_id": [], "content": [], "error": []})
        b = right.iloc[0]
        rows = left.sort_values("number")
        figures = dict(b["images"]) if "images" in right.columns and b["images"] is not None else {}
        front = pictures.cover(b["cover"], convert) if "cover" in right.columns and b["cover"] is not None else None
        try:
            data, error = built(b["title"], b["author"], b["language"], f"urn:leafmill:{key[0]}", list(zip(rows["name"], rows["title"], rows["xhtml"], strict=True)), figures, front), None
        except ValueError as e:
            data, error = None, str(e)
        return pd.DataFrame({"doc_id": [key[0]], "content": [data], "error": [error]})

    return chapters.groupBy("doc_id").cogroup(books.groupBy("doc_id")).applyInPandas(build, "doc_id long, content binary, error string")


def write_files(books: DataFrame, folder: str) -> DataFrame:
    """Writes archives (filename, content) as files of ``folder``; each is written beside its place first and then moved, so a reader never sees half of one. Returns (path, size)."""

    def run(batches):
        system, local = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(local, recursive=True)
        for batch in batches:
            out = []
            for name, content in zip(batch["filename"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if content is not None:
                    with system.open_output_stream(f"{local}/{name}.tmp", compression=None) as f:
                        f.write(content)
                    system.move(f"{local}/{name}.tmp", f"{local}/{name}")
                    out.append({"path": f"{folder}/{name}", "size": len(content)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("size", pa.int64())]))

    return core.stored(books.select("filename", "content").mapInArrow(run, "path string, size long"), "files")


_CONTENT = re.compile(r"\.(xhtml|html)$")
_XML = re.compile(r"\.(xhtml|html|ncx|opf)$")
_IMAGE = re.compile(r"\.(jpg|jpeg|png)$")


def structure_issues(data: bytes) -> list[str]:
    """Hard issues: damage, no mimetype, malformed documents, images that do not decode."""
    rows = members_of("", data)
    if rows and rows[0][5] and rows[0][2] is None:
        return [rows[0][5]]
    out = [f"{n}: {e}" for _, _, n, _, _, e in rows if e]
    if out:
        return out
    if not any(r[2] == "mimetype" for r in rows):
        out.append("no mimetype member")
    for _, _, name, _, content, _ in rows:
        if _XML.search(name):
            out += [f"{name}: {e}"] if (e := markup.xml_error(content)) else []
        elif _IMAGE.search(name) and (e := pictures.probe(content)["error"]):
            out.append(f"{name}: the image does not decode ({e})")
    return out


def _cover_entry(opf: bytes) -> str | None:
    """The href of the cover in a manifest: by its property, else by the meta element's id."""
    try:
        root = ET.fromstring(opf)
    except ET.ParseError:
        return None
    items = list(root.iterfind(".//o:manifest/o:item", NS))
    named = [i.get("href") for i in items if "cover-image" in (i.get("properties") or "").split()]
    wanted = [m.get("content") for m in root.iterfind(".//o:metadata/o:meta", NS) if m.get("name") == "cover"][:1]
    return next(iter(named), None) or next((i.get("href") for i in items if wanted and i.get("id") == wanted[0]), None)


def _beside(opf_name: str, href: str) -> str:
    """A member's path from a manifest's href, as the writer lays packages out: in the folder of the OPF, not normalised."""
    folder, slash, _ = opf_name.rpartition("/")
    return f"{folder}{slash}{href}"


def _cover_of(contents: dict[str, bytes]) -> tuple[str, str, str] | None:
    """(OPF member, href, member) of a package's cover, if it is there."""
    opf = next((n for n in contents if n.endswith(".opf")), None)
    href = _cover_entry(contents[opf]) if opf else None
    return (opf, href, _beside(opf, href)) if href and _beside(opf, href) in contents else None


def quick_issues(data: bytes) -> list[str]:
    """The short check of a finished book: hard issues, and a hint if the cover is no plain JPEG."""
    out = structure_issues(data)
    contents = {r[2]: r[4] for r in members_of("", data) if r[2] is not None and r[5] is None}
    if (found := _cover_of(contents)) and pictures.probe(contents[found[2]])["decodable"] and not pictures.is_plain_cover(contents[found[2]]):
        kind = pictures.probe(contents[found[2]])
        out.append(f"{found[2]}: the cover is {kind['format']}/{kind['mode']}, not a plain JPEG")
    return out


def _cover_repaired(contents: dict[str, bytes], convert) -> tuple[bool, list[str]]:
    """Puts a plain JPEG in the place of another cover: the manifest's entry and references in documents follow."""
    found = _cover_of(contents)
    if not found or pictures.is_plain_cover(contents[found[2]]):
        return False, []
    opf, href, member = found
    made = pictures.cover(contents[member], convert)
    if made is None:
        return False, [f"{member}: the cover cannot be made a plain JPEG"]
    if _beside(opf, _COVER) != member:
        del contents[member]
        for name in [n for n in contents if re.search(r"\.(xhtml|html|ncx)$", n)]:
            contents[name] = contents[name].replace(href.encode(), _COVER.encode())
    ET.register_namespace("", NS["o"])
    ET.register_namespace("dc", NS["d"])
    root = ET.fromstring(contents[opf])
    for item in root.iterfind(".//o:manifest/o:item", NS):
        if item.get("href") == href:
            item.set("href", _COVER)
            item.set("media-type", "image/jpeg")
    contents[opf] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    contents[_beside(opf, _COVER)] = made
    return True, []


def repaired(data: bytes, convert=None) -> dict:
    """Content documents filtered again and written well-formed, the cover as a plain JPEG; other members are kept as they are. What cannot be mended is told in ``unfixable``."""
    before = quick_issues(data)
    rows = members_of("", data)
    if any(r[5] for r in rows):
        return {"changed": False, "issues_before": before, "issues_after": before, "unfixable": [r[5] for r in rows if r[5]], "content": None}
    contents = {r[2]: r[4] for r in rows}
    packed = [n for n in contents if n != "mimetype" and not n.startswith("META-INF/")]
    changed = False
    for name in [n for n in contents if _CONTENT.search(n)]:
        content = contents[name]
        images = frozenset(posixpath.relpath(n, posixpath.dirname(name) or ".") for n in packed)
        text = content.decode("utf-8", "replace")
        body = re.search(r"(?is)<body[^>]*>(.*)</body\s*>", text)
        fragment, changes = markup.clean_fragment(body[1] if body else text, images)
        if changes or markup.xml_error(content):
            title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
            head = re.sub(r"<[^>]*>", "", title[1]) if title else ""
            contents[name] = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{head}</title></head><body>{fragment}</body></html>'.encode()
            changed = True
    new_cover, unfixable = _cover_repaired(contents, convert)
    first_stored = rows and rows[0][2] == "mimetype" and rows[0][3] == zipfile.ZIP_STORED
    changed |= new_cover or not first_stored
    new = archive_bytes(list(contents.items())) if changed else None
    return {"changed": changed, "issues_before": before, "issues_after": quick_issues(new) if new else before, "unfixable": unfixable, "content": new}


@on_batches("struct<changed:boolean,issues_before:array<string>,issues_after:array<string>,unfixable:array<string>,content:binary>")
def archive_repaired(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repaired(bytes(c)) for c in contents], columns=["changed", "issues_before", "issues_after", "unfixable", "content"])


def rewrite(paths: DataFrame) -> DataFrame:
    """Repairs archives (path) where they lie: the old file is kept as path.bak, the new one is written beside it and moved into its place. Returns path, changed, issues and backup.

    A task that is tried again finds the archive repaired and changes nothing.
    """

    def run(batches):
        for batch in batches:
            out = []
            for path in batch["path"].to_pylist():
                system, local = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
                with system.open_input_file(local) as f:
                    old = f.read()
                found = repaired(old)
                if found["changed"]:
                    for name, data in ((f"{local}.bak", old), (f"{local}.tmp", found["content"])):
                        with system.open_output_stream(name, compression=None) as f:
                            f.write(data)
                    system.move(f"{local}.tmp", local)
                out.append({"path": path, "backup": f"{path}.bak" if found["changed"] else None, **{k: found[k] for k in ("changed", "issues_before", "issues_after", "unfixable")}})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("changed", pa.bool_()), ("issues_before", pa.list_(pa.string())), ("issues_after", pa.list_(pa.string())), ("unfixable", pa.list_(pa.string())), ("backup", pa.string())]))

    return core.stored(paths.select("path").mapInArrow(run, "path string, changed boolean, issues_before array<string>, issues_after array<string>, unfixable array<string>, backup string"), "rewritten")
