"""Books in EPUB containers: reading their tables, changing them, packing them again.

A book is unpacked in memory into rows of (book_id, entry_path, content), its
package document and navigation into relations; nothing is written to disk on
the way.  Entries with absolute or climbing names and entries or books beyond
a size are refused.
"""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dom

CONTAINER = "META-INF/container.xml"
MIMETYPE = "application/epub+zip"
XHTML_TYPE = "application/xhtml+xml"
NCX_TYPE = "application/x-dtbncx+xml"
DC, OPF = "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/opf"
NCX = "http://www.daisy.org/z3986/2005/ncx/"
#: Largest entry and largest book, unpacked, in bytes.
ENTRY_BYTES, BOOK_BYTES = 64 << 20, 1 << 30

REFUSALS = (ValueError, TypeError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)
ENTRIES = "book_id string, entry_path string, content binary"


def unpack(content: bytes, entry_bytes: int = ENTRY_BYTES, book_bytes: int = BOOK_BYTES) -> Iterator[tuple[str, bytes]]:
    """Files of a container; refuses unsafe names and oversized contents."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            name = info.filename
            if info.is_dir():
                continue
            if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or ":" in name.split("/")[0]:
                raise ValueError(f"unsafe entry name: {name}")
            total += info.file_size
            if info.file_size > entry_bytes or total > book_bytes:
                raise ValueError(f"entry too large: {name}")
            yield name, z.read(info)


def pack(entries: list[tuple[str, bytes]]) -> bytes:
    """A container of the entries: the type first and stored, the rest compressed, in order of name."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        first = zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0))
        z.writestr(first, MIMETYPE, zipfile.ZIP_STORED)
        for name, content in sorted(entries):
            if name != "mimetype":
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read_books(spark: SparkSession, path: str, glob: str = "*.epub") -> DataFrame:
    """(book_id, content) of the containers below ``path``; the name without suffix is the id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("book_id"), "content")


def entries(books: DataFrame, entry_bytes: int = ENTRY_BYTES, book_bytes: int = BOOK_BYTES) -> DataFrame:
    """One row for each file of each book; books that ``refused`` lists give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for book, content in zip(b["book_id"], b["content"]):
                try:
                    rows = [(book, name, data) for name, data in unpack(content, entry_bytes, book_bytes)]
                except REFUSALS:
                    rows = []
                yield pd.DataFrame(rows, columns=["book_id", "entry_path", "content"])

    return books.select("book_id", "content").mapInPandas(run, ENTRIES)


def refused(books: DataFrame, entry_bytes: int = ENTRY_BYTES, book_bytes: int = BOOK_BYTES) -> DataFrame:
    """(book_id, reason) of the books that are no readable container, are too large or have unsafe names: one of them ends no job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for book, content in zip(b["book_id"], b["content"]):
                try:
                    names = {name for name, _ in unpack(content, entry_bytes, book_bytes)}
                    reason = None if CONTAINER in names else f"no {CONTAINER}"
                except REFUSALS as e:
                    reason = str(e)
                if reason:
                    rows.append((book, reason))
            yield pd.DataFrame(rows, columns=["book_id", "reason"])

    return books.select("book_id", "content").mapInPandas(run, "book_id string, reason string")


def _local(node: ET.Element, name: str) -> ET.Element | None:
    return next((n for n in node.iter() if dom.local(n.tag) == name.lower()), None)


def opf_path(container: bytes) -> str:
    """Path of the package document that a container file names first."""
    node = _local(ET.fromstring(container), "rootfile")
    if node is None:
        raise ValueError("container names no package document")
    return node.get("full-path")


class Package:
    """A package document: metadata, manifest and spine."""

    def __init__(self, content: bytes, path: str):
        self.path, self.root = path, ET.fromstring(content)
        self.metadata, self.manifest, self.spine = (_local(self.root, n) for n in ("metadata", "manifest", "spine"))

    def items(self) -> list[tuple[str, str, str]]:
        return [(n.get("id"), n.get("href"), n.get("media-type")) for n in self.manifest if dom.local(n.tag) == "item"]

    def itemrefs(self) -> list[str]:
        return [n.get("idref") for n in self.spine if dom.local(n.tag) == "itemref"]

    def _dc(self, name: str) -> list[ET.Element]:
        return [n for n in self.metadata if n.tag == f"{{{DC}}}{name}"] if self.metadata is not None else []

    @property
    def title(self) -> str | None:
        found = self._dc("title")
        return found[0].text if found else None

    @title.setter
    def title(self, value: str) -> None:
        for node in self._dc("title")[:1]:
            node.text = value

    @property
    def authors(self) -> list[str]:
        return [n.text for n in self._dc("creator") if n.text]

    @authors.setter
    def authors(self, names: list[str]) -> None:
        """New creators in place of the old ones; none are added where there were none."""
        old = self._dc("creator")
        if not old:
            return
        at = list(self.metadata).index(old[0])
        for k, name in enumerate(names):
            node = ET.Element(f"{{{DC}}}creator", {f"{{{OPF}}}file-as": name, f"{{{OPF}}}role": "aut"})
            node.text = name
            self.metadata.insert(at + k, node)
        for node in old:
            self.metadata.remove(node)

    def ncx(self) -> str | None:
        """Path of the navigation file: the item with id ``ncx``, else the first of its media type."""
        found = [h for i, h, _ in self.items() if i == "ncx"] or [h for _, h, t in self.items() if t == NCX_TYPE]
        return posixpath.normpath(posixpath.join(posixpath.dirname(self.path), found[0])) if found else None

    def add(self, item_id: str, href: str, after: str | None = None) -> None:
        """A page in manifest and spine: behind the first reference to ``after``, else at the end."""
        space = self.manifest.tag.rpartition("}")[0] + "}" if "}" in self.manifest.tag else ""
        ET.SubElement(self.manifest, f"{space}item", {"id": item_id, "href": href, "media-type": XHTML_TYPE})
        at = next((k + 1 for k, n in enumerate(self.spine) if n.get("idref") == after), len(self.spine)) if after else len(self.spine)
        self.spine.insert(at, ET.Element(f"{space}itemref", {"idref": item_id}))

    def content(self) -> bytes:
        return _written(self.root, {"dc": DC, "opf": OPF})


class Navigation:
    """A navigation file: its points, their labels and order."""

    def __init__(self, content: bytes):
        self.root = ET.fromstring(content)
        self.map = _local(self.root, "navMap")

    def points(self) -> list[ET.Element]:
        return [n for n in self.map.iter() if dom.local(n.tag) == "navpoint"]

    def rows(self) -> list[tuple[int, str, int, str, str]]:
        out = []
        for k, p in enumerate(self.points()):
            text, content = _local(p, "text"), _local(p, "content")
            out.append((k, p.get("id"), int(p.get("playOrder") or 0), text.text if text is not None else None, content.get("src") if content is not None else None))
        return out

    def relabel(self, labels: list[str]) -> None:
        """Labels merged with new ones by position; more new ones than points are an error."""
        texts = [n for n in self.root.iter() if dom.local(n.tag) == "text"]
        if len(labels) > len(texts):
            raise ValueError(f"{len(labels)} labels for {len(texts)} places")
        for node, label in zip(texts, labels):
            origin = node.text
            node.text = origin if origin == label else " - ".join(x for x in (origin, label) if x is not None)

    def add(self, nav_id: str, label: str, src: str, after: str | None = None) -> None:
        """A point behind the first direct one whose source contains ``after``, else at the end; orders are not renumbered."""
        space = self.map.tag.rpartition("}")[0] + "}" if "}" in self.map.tag else ""
        count = len(self.points())
        node = ET.Element(f"{space}navPoint", {"id": nav_id, "playOrder": str(count + 1)})
        ET.SubElement(ET.SubElement(node, f"{space}navLabel"), f"{space}text").text = label
        ET.SubElement(node, f"{space}content", {"src": src})
        at = len(self.map)
        if after:
            for k, p in enumerate(self.map):
                content = _local(p, "content")
                if content is not None and after in (content.get("src") or ""):
                    at = k + 1
                    break
        self.map.insert(at, node)

    def content(self) -> bytes:
        return _written(self.root, {})


def _written(root: ET.Element, prefixes: dict[str, str]) -> bytes:
    """A document with declaration and indents; the root's namespace is the default one."""
    for prefix, uri in prefixes.items():
        ET.register_namespace(prefix, uri)
    ET.indent(root)
    default = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else None
    if default:
        for n in root.iter():
            if isinstance(n.tag, str) and n.tag.startswith(f"{{{default}}}"):
                n.tag = n.tag[len(default) + 2 :]
        root.set("xmlns", default)
    out = io.BytesIO()
    ET.ElementTree(root).write(out, encoding="utf-8", xml_declaration=True)
    return out.getvalue()


def catalogue(files: DataFrame) -> DataFrame:
    """(book_id, package, manifest, spine, nav) of each book, from its container, package and navigation files.

    Only these small files of a book meet in one task; chapters stay where they are.
    """
    small = files.where(F.col("entry_path").eqNullSafe(CONTAINER) | F.lower("entry_path").rlike(r"\.(opf|ncx)$"))
    schema = (
        "book_id string, package struct<opf_path:string, ncx_path:string, title:string, authors:array<string>>, "
        "manifest array<struct<ord:int, item_id:string, href:string, media_type:string>>, spine array<struct<spine_idx:int, idref:string>>, "
        "nav array<struct<nav_idx:int, nav_id:string, play_order:int, label:string, src:string>>"
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {p: bytes(c) for p, c in zip(pdf["entry_path"], pdf["content"])}
        path = opf_path(by[CONTAINER])
        package = Package(by[path], path)
        ncx = package.ncx()
        nav = Navigation(by[ncx]).rows() if ncx in by else []
        return pd.DataFrame(
            {
                "book_id": [pdf["book_id"].iloc[0]],
                "package": [{"opf_path": path, "ncx_path": ncx, "title": package.title, "authors": package.authors}],
                "manifest": [[{"ord": k, "item_id": i, "href": h, "media_type": t} for k, (i, h, t) in enumerate(package.items())]],
                "spine": [[{"spine_idx": k, "idref": r} for k, r in enumerate(package.itemrefs())]],
                "nav": [[dict(zip(("nav_idx", "nav_id", "play_order", "label", "src"), r)) for r in nav]],
            }
        )

    return small.groupBy("book_id").applyInPandas(one, schema)


def relation(catalogued: DataFrame, name: str) -> DataFrame:
    """``manifest``, ``spine`` or ``nav`` as rows."""
    return catalogued.select("book_id", F.explode(name).alias("_r")).select("book_id", "_r.*")


def chapters(files: DataFrame, catalogued: DataFrame, pattern: str | None = None) -> DataFrame:
    """(book_id, spine_idx, item_id, chapter_name, href, entry_path, html) of the pages in reading order.

    A page's file is looked up by its href below the package document, as
    written, with escapes decoded, and from the container's root.  ``pattern``
    keeps pages whose name it meets, before any page is decoded.
    """
    from ..functions.text import stem
    from ..operators.numbering import reading_order

    order = reading_order(relation(catalogued, "spine"), relation(catalogued, "manifest")).where(F.col("media_type") == XHTML_TYPE)
    order = order.withColumn("chapter_name", stem("href"))
    if pattern:
        order = order.where(F.col("chapter_name").rlike(pattern))
    base = catalogued.select("book_id", F.regexp_extract("package.opf_path", r"^(.*/)[^/]*$", 1).alias("_base"))
    plain = F.coalesce(F.try_url_decode(F.replace("href", F.lit("+"), F.lit("%2B"))), "href")
    paths = F.array_distinct(F.array(F.concat("_base", "href"), F.concat("_base", plain), F.col("href"), plain))
    wanted = order.join(base, "book_id").select("book_id", "spine_idx", "item_id", "chapter_name", "href", F.posexplode(paths).alias("_rank", "entry_path"))
    found = wanted.join(files, ["book_id", "entry_path"])
    best = found.groupBy("book_id", "spine_idx").agg(F.min("_rank").alias("_rank"))
    return found.join(best, ["book_id", "spine_idx", "_rank"]).select("book_id", "spine_idx", "item_id", "chapter_name", "href", "entry_path", F.decode("content", "UTF-8").alias("html"))


def changed(files: DataFrame, pages: DataFrame, additions: DataFrame | None = None, labels=None, title: str | None = None, authors: list[str] | None = None) -> DataFrame:
    """Entries of books with ``pages`` (book_id, entry_path, content) in place of their old ones.

    ``additions`` (book_id, entry_path, content, item_id, after_id, nav_label)
    are new pages, listed in package and navigation behind the page they
    belong to.  ``labels`` is a function from a book's list of navigation
    labels to new ones.  Package and navigation are rewritten once a book.
    """
    keep = files.join(pages.select("book_id", "entry_path"), ["book_id", "entry_path"], "left_anti").unionByName(pages.select("book_id", "entry_path", "content"))
    small = keep.where(F.col("entry_path").eqNullSafe(CONTAINER) | F.lower("entry_path").rlike(r"\.(opf|ncx)$"))
    if additions is not None:
        keep = keep.unionByName(additions.select("book_id", "entry_path", "content"))
    listed = small.select("book_id", "entry_path", "content", *[F.lit(None).cast("string").alias(c) for c in ("item_id", "after_id", "nav_label")], F.lit(None).cast("int").alias("place"))
    if additions is not None:
        listed = listed.unionByName(additions.select("book_id", "entry_path", F.lit(None).cast("binary").alias("content"), "item_id", "after_id", "nav_label", "place"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        book = pdf["book_id"].iloc[0]
        own = pdf[pdf["content"].notna()]
        by = {p: bytes(c) for p, c in zip(own["entry_path"], own["content"])}
        if CONTAINER not in by:
            return pd.DataFrame({"book_id": [], "entry_path": [], "content": []})
        path = opf_path(by[CONTAINER])
        package = Package(by[path], path)
        ncx = package.ncx()
        nav = Navigation(by[ncx]) if ncx in by else None
        if nav is not None and labels is not None:
            nav.relabel(labels([n.text for n in nav.root.iter() if dom.local(n.tag) == "text"]))
        for r in pdf[pdf["content"].isna()].sort_values(["place", "entry_path"]).itertuples():
            href = posixpath.relpath(r.entry_path, posixpath.dirname(path) or ".")
            package.add(r.item_id, href, r.after_id)
            if nav is not None:
                nav.add(r.item_id, r.nav_label, href, r.after_id)
        if title is not None:
            package.title = title
        if authors is not None:
            package.authors = authors
        out = [(path, package.content())] + ([(ncx, nav.content())] if nav is not None else [])
        return pd.DataFrame({"book_id": book, "entry_path": [p for p, _ in out], "content": [c for _, c in out]})

    rebuilt = listed.groupBy("book_id").applyInPandas(one, ENTRIES)
    return keep.join(rebuilt.select("book_id", "entry_path"), ["book_id", "entry_path"], "left_anti").unionByName(rebuilt)


def packed(files: DataFrame) -> DataFrame:
    """(book_id, content): each book's container.  A book is packed by one task, since a container is one file."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"book_id": [pdf["book_id"].iloc[0]], "content": [pack([(p, bytes(c)) for p, c in zip(pdf["entry_path"], pdf["content"])])]})

    return files.where("entry_path is not null and content is not null").select("book_id", "entry_path", "content").groupBy("book_id").applyInPandas(one, "book_id string, content binary")


def write_books(books: DataFrame, folder: str) -> DataFrame:
    """Writes each container to ``folder`` as its id's file; (book_id, path, bytes) of what was written."""
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for book, content in zip(b["book_id"], b["content"]):
                path = os.path.join(folder, f"{book}.epub")
                part = f"{path}.{os.getpid()}.part"  # a task that runs twice never leaves half a file
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
                rows.append((book, path, len(content)))
            yield pd.DataFrame(rows, columns=["book_id", "path", "bytes"])

    return books.mapInPandas(run, "book_id string, path string, bytes bigint")


def built(manifest: DataFrame, spine: DataFrame, pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Entries of books from their tables: manifest, spine, pages (book_id, href, html) and titles (book_id, title, creators).

    Navigation lists the spine's pages in order.  Items without a page get no file.
    """
    from ..operators.numbering import last_items, reading_order

    items = last_items(manifest).join(manifest.groupBy("book_id", "item_id").agg(F.min("ord").alias("ord")), ["book_id", "item_id"])
    lists = items.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("ord", "item_id", "href", "media_type"))).alias("items"))
    refs = spine.select("book_id", "spine_idx", "idref").distinct().groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("spine_idx", "idref"))).alias("refs"))
    nav = reading_order(spine, manifest).groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("spine_idx", "item_id", "href"))).alias("points"))
    books = lists.join(refs, "book_id", "left").join(nav, "book_id", "left")
    books = books.join(titles.select("book_id", "title", "creators" if "creators" in titles.columns else F.array().cast("array<string>").alias("creators")), "book_id", "left") if titles is not None else books.withColumn("title", F.lit(None).cast("string")).withColumn("creators", F.array().cast("array<string>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                meta = (dom.element("dc:title", r.title) if r.title else "") + "".join(dom.element("dc:creator", c) for c in (r.creators if r.creators is not None else ()))
                rows = "".join(f"<item{_attributes(id=i['item_id'], href=i['href'], media__type=i['media_type'])}/>" for i in r.items)
                order = "".join(f"<itemref{_attributes(idref=i['idref'])}/>" for i in (r.refs if r.refs is not None else ()))
                points = "".join(
                    f'<navPoint{_attributes(id=p["item_id"], playOrder=str(k + 1))}><navLabel>{dom.element("text", p["item_id"])}</navLabel><content{_attributes(src=p["href"])}/></navPoint>' for k, p in enumerate(r.points if r.points is not None else ())
                )
                made = {
                    CONTAINER: '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
                    "OEBPS/content.opf": f'<?xml version="1.0" encoding="utf-8"?><package xmlns="{OPF}" version="2.0"><metadata xmlns:dc="{DC}" xmlns:opf="{OPF}">{meta}</metadata><manifest>{rows}</manifest><spine toc="ncx">{order}</spine></package>',
                    "OEBPS/toc.ncx": f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="{NCX}" version="2005-1"><navMap>{points}</navMap></ncx>',
                }
                yield pd.DataFrame({"book_id": r.book_id, "entry_path": list(made), "content": [c.encode() for c in made.values()]})

    files = books.mapInPandas(run, ENTRIES)
    return files.unionByName(pages.select("book_id", F.concat(F.lit("OEBPS/"), "href").alias("entry_path"), F.encode("html", "UTF-8").alias("content")))


def _attributes(**given: str | None) -> str:
    return "".join(f' {k.replace("__", "-")}="{dom.escape(v)}"' for k, v in given.items() if v is not None)
