"""Packages: container and package files, manifests, spines, entry classification, title pages.

XML is parsed once a package, in Arrow batches, into arrays of plain records and an error
text (a malformed file fails its row, not the job); all rules are column expressions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base_name, directory, extension, is_directory, is_html, is_junk, joined_path, words_longer_than

_OCF = "{urn:oasis:names:tc:opendocument:xmlns:container}"
PACKAGE_TYPE = "application/oebps-package+xml"
PARSED = "book string, root struct<version:string,files:array<struct<path:string,type:string,strict:boolean>>>, error string"
OPF = (
    "book string, path string, manifest array<struct<id:string,href:string,type:string,properties:string>>, spine array<struct<idref:string,linear:string>>, "
    "meta array<struct<tag:string,name:string,property:string,refines:string,id:string,content:string,text:string,role:string>>, error string"
)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _rows(fields: str, make):
    names = {"container": ["book", "root", "error"], "opf": ["book", "path", "manifest", "spine", "meta", "error"]}[fields]
    strings = lambda *n: pa.list_(pa.struct([(x, pa.string()) for x in n]))
    types = {
        "book": pa.string(),
        "path": pa.string(),
        "error": pa.string(),
        "root": pa.struct([("version", pa.string()), ("files", pa.list_(pa.struct([("path", pa.string()), ("type", pa.string()), ("strict", pa.bool_())])))]),
        "manifest": strings("id", "href", "type", "properties"),
        "spine": strings("idref", "linear"),
        "meta": strings("tag", "name", "property", "refines", "id", "content", "text", "role"),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types[n]) for n in names], names)

    return run


def _container(row: dict) -> dict:
    try:
        root = ET.fromstring(row["xml"] or "")
    except ET.ParseError as e:
        return {"book": row["book"], "error": f"container: {e}"}
    files = [{"path": e.get("full-path"), "type": e.get("media-type"), "strict": e.tag == f"{_OCF}rootfile"} for e in root.iter() if _local(e.tag) == "rootfile"]
    return {"book": row["book"], "root": {"version": root.get("version"), "files": files}}


def _package(row: dict) -> dict:
    try:
        root = ET.fromstring(row["xml"] or "")
    except ET.ParseError as e:
        return {"book": row["book"], "path": row["path"], "error": f"package: {e}"}
    out: dict = {"book": row["book"], "path": row["path"], "manifest": [], "spine": [], "meta": []}
    for e in root.iter():
        tag = _local(e.tag)
        attr = {_local(k): v for k, v in e.attrib.items()}
        if tag == "item":
            out["manifest"].append({"id": attr.get("id"), "href": attr.get("href"), "type": attr.get("media-type"), "properties": attr.get("properties")})
        elif tag == "itemref":
            out["spine"].append({"idref": attr.get("idref"), "linear": attr.get("linear")})
        elif tag in ("meta", "contributor"):
            out["meta"].append({"tag": tag, "text": "".join(e.itertext()), **{k: attr.get(k) for k in ("name", "property", "refines", "id", "content", "role")}})
    return out


def containers(files: DataFrame) -> DataFrame:
    """Of book and xml: the container's rootfiles."""
    return files.select("book", "xml").mapInArrow(_rows("container", _container), PARSED)


def packages(files: DataFrame) -> DataFrame:
    """Of book, path and xml: manifest, spine and metadata."""
    return files.select("book", "path", "xml").mapInArrow(_rows("opf", _package), OPF)


def package_path(parsed: DataFrame, strict: bool = True) -> DataFrame:
    """book, path, error. Strict: version 1.0 and the first rootfile of the package type; lenient: the first that has a path."""
    files = F.col("root.files")
    fits = F.filter(files, lambda f: f["strict"] & (f["type"] == PACKAGE_TYPE)) if strict else F.filter(files, lambda f: F.coalesce(f["path"], F.lit("")) != "")
    path = F.get(fits, 0)["path"]
    version = (F.coalesce("root.version", F.lit("")) == "1.0") if strict else F.lit(True)
    error = F.coalesce("error", F.when(~version, F.lit("container: version")).when(path.isNull(), F.lit("container: no package")))
    return parsed.select("book", F.when(error.isNull(), path).alias("path"), error.alias("error"))


def find_entry(entries: DataFrame, name: str) -> DataFrame:
    """The first entry of each book of that name, without regard to case and leading slashes."""
    fold = F.lower(F.ltrim("name", F.lit("/")))
    return entries.filter(fold == name.lower()).groupBy("book").agg(F.min_by("name", "ord").alias("name"))


def content_documents(parsed: DataFrame) -> DataFrame:
    """book, pos, name of the manifest's HTML documents, in manifest order."""
    items = parsed.select("book", "path", F.posexplode("manifest").alias("pos", "item"))
    keep = F.coalesce(F.col("item.type"), F.lit("")).isin("application/xhtml+xml", "text/html") | is_html(F.coalesce("item.href", F.lit("")))
    return items.filter(keep).select("book", "pos", joined_path(directory(F.col("path")), F.col("item.href")).alias("name"))


def first_linear(parsed: DataFrame) -> DataFrame:
    """book, path and the idref of the first spine item that is not linear='no'."""
    linear = F.filter("spine", lambda s: F.coalesce(s["linear"], F.lit("")) != "no")
    return parsed.select("book", "path", F.get(linear, 0)["idref"].alias("idref"), "manifest")


def first_document(parsed: DataFrame) -> DataFrame:
    """book and the name of the first linear document: of its manifest items the last HTML one."""
    found = first_linear(parsed).withColumn("hits", F.filter("manifest", lambda m: m["id"] == F.col("idref")))
    last = F.element_at(F.filter("hits", lambda m: F.coalesce(m["type"], F.lit("")).isin("application/xhtml+xml", "text/html") | is_html(F.coalesce(m["href"], F.lit("")))), -1)
    href = F.when(F.size("hits") > 0, last["href"])
    return found.select("book", F.when(is_html(href), joined_path(directory(F.col("path")), href)).alias("name"))


def classify(entries: DataFrame, opf: DataFrame, contents: DataFrame) -> DataFrame:
    """Entries (book, ord, name) with an action. Later rules win: copy, package, content, and
    ignored directories, junk and the mimetype entry. A content path that no entry has is
    looked for without regard to case, and its first entry is taken."""
    wanted = contents.select("book", "name").distinct()
    exact = entries.join(wanted, ["book", "name"], "left_semi").select("book", "ord")
    missing = wanted.join(entries, ["book", "name"], "left_anti").select("book", F.lower("name").alias("fold")).distinct()
    folded = entries.withColumn("fold", F.lower("name")).join(missing, ["book", "fold"]).groupBy("book", "fold").agg(F.min("ord").alias("ord")).select("book", "ord")
    content = exact.unionByName(folded).distinct().withColumn("content", F.lit(True))
    marked = entries.join(content, ["book", "ord"], "left").join(opf.select("book", F.col("path").alias("opf")), "book", "left")
    action = (
        F.when((F.col("name") == "mimetype") | is_junk(F.col("name")) | is_directory(F.col("name")), "ignore")
        .when(F.col("content"), "content")
        .when(F.col("name") == F.col("opf"), "package")
        .otherwise("copy")
    )
    return marked.select("book", "ord", "name", action.alias("action"))


def cover_candidates(parsed: DataFrame) -> DataFrame:
    """book, pos, name: the cover meta's content as a path, the item of that id, the item whose
    properties are exactly cover-image; then each joined to the package's folder."""
    cover = F.get(F.filter("meta", lambda m: (m["tag"] == "meta") & (m["name"] == "cover")), 0)["content"]
    with_cover = parsed.withColumn("cover", cover)
    by_id = F.get(F.filter("manifest", lambda m: m["id"] == F.col("cover")), 0)["href"]
    by_property = F.get(F.filter("manifest", lambda m: m["properties"] == "cover-image"), 0)["href"]
    plain = with_cover.withColumn("plain", F.filter(F.array("cover", by_id, by_property), lambda x: F.coalesce(x, F.lit("")) != ""))
    folder = directory(F.col("path"))
    return plain.select("book", F.posexplode(F.concat("plain", F.transform("plain", lambda x: joined_path(folder, x)))).alias("pos", "name"))


def resolve_cover(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """The last candidate that has an entry, of each book."""
    first = entries.groupBy("book", "name").agg(F.min("ord").alias("ord"))
    return candidates.join(first, ["book", "name"]).groupBy("book").agg(F.max_by("name", "pos").alias("name"))


def mark_cover(parsed: DataFrame) -> DataFrame:
    """The manifest with properties='cover-image' on the first item of the cover's id ('cover' if no meta names one)."""
    wanted = F.coalesce(F.get(F.filter("meta", lambda m: (m["tag"] == "meta") & (m["name"] == "cover")), 0)["content"], F.lit("cover"))
    at = F.array_position(F.transform("manifest", lambda m: F.coalesce(m["id"], F.lit("")) == wanted), True)
    return parsed.withColumn("manifest", F.transform("manifest", lambda m, i: F.when(i + 1 == at, m.withField("properties", F.lit("cover-image"))).otherwise(m)))


def prune_metadata(parsed: DataFrame, stamps: tuple[str, ...] = ("calibre:timestamp",)) -> DataFrame:
    """Metadata without time stamps and book-producer contributors."""
    drop = lambda m: ((m["tag"] == "meta") & F.coalesce(m["name"], F.lit("")).isin(*stamps)) | ((m["tag"] == "contributor") & (F.coalesce(m["role"], F.lit("")) == "bkp"))
    return parsed.withColumn("meta", F.filter("meta", lambda m: ~drop(m)))


def needs_title_page(bodies: DataFrame, force: bool | None = None) -> DataFrame:
    """book, required, from the events of each first document's body (book, name, kind, text):
    more than 4 paragraphs, 20 words of over 3 bytes, or 4 images; or no image and fewer than 5 words."""
    if force is not None:
        return bodies.select("book").distinct().withColumn("required", F.lit(force))
    n = bodies.groupBy("book").agg(
        F.max("name").alias("name"),
        F.sum((F.col("kind") == "p").cast("long")).alias("pc"),
        F.sum(F.col("kind").isin("img", "svg").cast("long")).alias("ic"),
        F.sum(F.when(F.col("kind") == "txt", words_longer_than(F.col("text"), 3)).otherwise(0)).alias("wc"),
    )
    name = F.lower(base_name(F.col("name")))
    titled = F.contains(name, F.lit("cover")) | F.contains(name, F.lit("title"))
    heavy = (F.col("pc") > 4) | (F.col("wc") > 20) | ((F.col("ic") == 0) & (F.col("wc") < 5)) | (F.col("ic") > 4)
    return n.select("book", "pc", "ic", "wc", F.coalesce(is_html(F.col("name")) & ~titled & heavy, F.lit(False)).alias("required"))


def add_title_page(parsed: DataFrame, required: DataFrame, item_id: str = "title-page-placeholder", file_name: str = "title-page-placeholder.xhtml") -> DataFrame:
    """Packages with the placeholder as last manifest item and first spine item, where it is required."""
    item = F.struct(F.lit(item_id).alias("id"), F.lit(file_name).alias("href"), F.lit("application/xhtml+xml").alias("type"), F.lit(None).cast("string").alias("properties"))
    ref = F.struct(F.lit(item_id).alias("idref"), F.lit(None).cast("string").alias("linear"))
    need = F.coalesce("required", F.lit(False))
    joined = parsed.join(required.select("book", "required"), "book", "left")
    return joined.withColumn("manifest", F.when(need, F.concat("manifest", F.array(item))).otherwise(F.col("manifest"))).withColumn("spine", F.when(need, F.concat(F.array(ref), "spine")).otherwise(F.col("spine"))).drop("required")


def first_entry_window() -> Window:
    return Window.partitionBy("book").orderBy("ord")


def content_hashes(entries: DataFrame, content: Column | str = "bytes") -> DataFrame:
    """SHA-1 of each file, to compare two sets of files by a full join."""
    return entries.select("book", "name", F.sha1(content).alias("sha1"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files that only one of two sets of hashes has, or that differ."""
    joined = a.alias("a").join(b.alias("b"), ["book", "name"], "full")
    return joined.filter(~F.col("a.sha1").eqNullSafe(F.col("b.sha1"))).select("book", "name", F.col("a.sha1").alias("left"), F.col("b.sha1").alias("right"))


def has_book_extension(path: Column) -> Column:
    return F.lower(extension(path)) == ".epub"
