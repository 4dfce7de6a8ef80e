"""Registered queries of the engine's own operators, each with its DuckDB SQL where SQL can
express it. Inputs are whole tables; where the tables lack an operator's edge cases, rows
of literals are added on both sides, and package-like inputs are derived from ids by
expressions that both dialects read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import catalog, covers, html, packages, paths, spans

EDGES = [(-1, "One. Two! 'Three?' Four… five"), (-2, ""), (-3, "? "), (-4, 'He said "no." Then\tleft.\nEnd'), (-5, "a -- b --- c... 1/2 (c)"), (-6, "x�y    z"), (-7, "...  .\f!")]
_EDGE_SQL = ", ".join("({}, {})".format(i, " || ".join(["''", *(f"chr({ord(c)})" for c in x)])) for i, x in EDGES)
DOCS = f"d as (select doc_id, text from documents union all select * from (values {_EDGE_SQL}) v(doc_id, text))"
_PIECES = "case when {0} = '' then [''] else list_filter(string_split(regexp_replace({0}, '([.!?][''\"”’“…]?[\t\n\f\r ]+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') end"
_WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PAIRS = (("the", "THE"), ("THE ", "<b>"), ("", "never"), ("e", "ee"), ("aa", "a"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' ids and texts, and the edge rows."""
    return _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(EDGES, "doc_id long, text string"))


def sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "sentence"))


def sentence_counts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("lang", F.size(t.sentences(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_sentences"))


def span_numbering(spark, sf_dir):
    return spans.number_spans(spans.line_events(_docs(spark, sf_dir))).select("doc_id", "para", "seg", "text")


def find_replace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.replace_in_order(F.col("text"), PAIRS).alias("text"))


def strip_replacement(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.strip_replacement(F.col("text")).alias("text"))


def punctuation(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.smart_punctuation(F.col("text")).alias("text"))


def word_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.words_longer_than(F.col("text"), 3).cast("long").alias("n_words"))


def white_space(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", t.is_space(F.col("line")).alias("blank"))


def class_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.has_token(F.col("text"), "the").alias("hit"), t.has_suffix_fold(F.col("text"), F.lit("ER.")).alias("ends"))


def content_hash(spark, sf_dir):
    d = _docs(spark, sf_dir)
    a = packages.content_hashes(d.select(F.lit("x").alias("book"), F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("bytes")))
    b = packages.content_hashes(d.select(F.lit("x").alias("book"), F.col("doc_id").alias("name"), t.strip_replacement(F.col("text")).cast("binary").alias("bytes")))
    return a.join(packages.differing(a, b).select("book", "name", F.lit(True).alias("differs")), ["book", "name"], "left").select(F.col("name").alias("doc_id"), "sha1", F.coalesce("differs", F.lit(False)).alias("differs"))


#: A book of ten entries for every ten documents.
_ENTRY = """cast(floor(doc_id / 10) as bigint) as book_no, cast(doc_id % 10 as int) as ord, case doc_id % 10
  when 0 then 'mimetype' when 1 then 'OPS/book.opf' when 2 then 'OPS/One.xhtml' when 3 then 'OPS/two.html' when 4 then 'OPS/TWO.html'
  when 5 then '__MACOSX/two.html' when 6 then 'OPS/thumbs.db' when 7 then 'OPS/img/' when 8 then '.DS_Store' else 'OPS/img/' || cast(doc_id as varchar(20)) || '.png' end as name"""


def _entries(spark, sf_dir):
    return _table(spark, sf_dir, "documents").selectExpr(*_split(_ENTRY)).withColumn("book", F.col("book_no").cast("string"))


def _split(select: str) -> list[str]:
    """The select list's parts, for selectExpr."""
    parts, depth, now = [], 0, ""
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += c
    return [*parts, now]


def action_classify(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    books = entries.select("book").distinct()
    contents = books.select("book", F.explode(F.array(*map(F.lit, ("OPS/one.xhtml", "OPS/two.html", "OPS/none.html")))).alias("name"))
    return packages.classify(entries.select("book", "ord", "name"), books.withColumn("path", F.lit("OPS/book.opf")), contents)


CONTAINER = '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/b{0}.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def _opf(doc_id: Column, lang: Column) -> Column:
    """A package document for each id; every seventh is malformed."""
    number = doc_id.cast("string")
    return F.concat(
        F.lit('<package xmlns="http://www.idpf.org/2007/opf"><metadata><meta name="cover" content="c"/><meta name="calibre:series" content="'),
        F.when(doc_id % 3 == 0, F.concat(F.lit("S"), (doc_id % 5).cast("string"))).otherwise(""),
        F.lit('"/><meta name="calibre:series_index" content="'),
        F.concat((doc_id % 4).cast("string"), F.lit(".50")),
        F.lit('"/><meta property="belongs-to-collection" id="x"> '),
        F.coalesce(lang, F.lit("")),
        F.lit(' </meta><meta refines="#x" property="collection-type">'),
        F.when(doc_id % 2 == 0, "series").otherwise("set"),
        F.lit('</meta><meta refines="#x" property="group-position">3</meta></metadata><manifest><item id="a" href="a%20b.txt" media-type="text/html"/><item id="d" href="../d/'),
        number,
        F.lit('.XHTML" media-type="x/y"/><item id="c" href="c.png" media-type="image/png" properties="cover-image"/></manifest><spine><itemref idref="a" linear="no"/><itemref idref="d"/></spine>'),
        F.when(doc_id % 7 == 0, "").otherwise("</package>"),
    )


def _packages(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return packages.packages(d.select(F.col("doc_id").cast("string").alias("book"), F.lit("OPS/book.opf").alias("path"), _opf(F.col("doc_id"), F.col("lang")).alias("xml")))


def package_path(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    version = F.when(F.col("doc_id") % 3 == 0, "1.1").otherwise("1.0")
    xml = F.concat(F.lit('<container version="'), version, F.lit('" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfile full-path="x.txt" media-type="text/plain"/><rootfile full-path="OPS/'), F.col("doc_id").cast("string"), F.lit('.opf" media-type="application/oebps-package+xml"/></container>'))
    parsed = packages.containers(d.select(F.col("doc_id").cast("string").alias("book"), xml.alias("xml")))
    strict, lenient = packages.package_path(parsed), packages.package_path(parsed, False)
    return strict.select("book", F.col("path").alias("strict_path"), "error").join(lenient.select("book", F.col("path").alias("lenient_path")), "book")


def content_documents(spark, sf_dir):
    return packages.content_documents(_packages(spark, sf_dir))


def first_document(spark, sf_dir):
    return packages.first_document(_packages(spark, sf_dir))


def cover_candidates(spark, sf_dir):
    return packages.cover_candidates(_packages(spark, sf_dir))


def cover_resolved(spark, sf_dir):
    entries = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("book"), F.lit(0).alias("ord"), F.when(F.col("doc_id") % 2 == 0, "OPS/c.png").otherwise("c").alias("name"))
    return packages.resolve_cover(packages.cover_candidates(_packages(spark, sf_dir)), entries)


def package_edits(spark, sf_dir):
    p = packages.prune_metadata(packages.mark_cover(_packages(spark, sf_dir)))
    p = packages.add_title_page(p, p.select("book", (F.col("book").cast("long") % 2 == 0).alias("required")))
    return p.select("book", F.to_json("manifest").alias("manifest"), F.to_json("spine").alias("spine"), F.size("meta").alias("n_meta"), "error")


def series_extract(spark, sf_dir):
    return catalog.series_rows(catalog.series_of(_packages(spark, sf_dir).filter("error is null")))


_CONTENT = """'book-' || cast(doc_id as varchar(20)) as image_id, case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then null else 'w' end as work_id,
  case when doc_id % 4 = 0 then null else 'S' || cast(doc_id % 9 as varchar(20)) end as series, case when doc_id % 4 = 0 then null else '1' end as series_number,
  case when doc_id % 6 = 0 then null when doc_id % 6 = 1 then '' else 'id' || cast(doc_id % 3 as varchar(20)) end as series_id"""
_UPDATES = """'book-' || cast(floor(doc_id / 2) as bigint) as image_id, case when doc_id % 7 = 0 then null else 'S' || cast(doc_id % 11 as varchar(20)) end as series,
  case when doc_id % 7 = 0 then null else cast(doc_id % 4 as varchar(20)) end as series_number, doc_id as seq"""


def _upserted(spark, sf_dir, **flags):
    d = _table(spark, sf_dir, "documents").select("doc_id").distinct()
    content = d.selectExpr(*_split(_CONTENT))
    updates = d.filter("doc_id % 3 <> 0").selectExpr(*_split(_UPDATES.replace("as bigint) as image_id", "as bigint) as image_id")))
    return catalog.upsert_series(content, content.limit(0).select("image_id", "series", "series_number"), updates, **flags)


def _upsert_sql(no_replace: bool) -> str:
    when = "p.image_id is not null" + (" and c.series is null" if no_replace else "")
    return f"""with c as (select {_CONTENT} from (select distinct doc_id from documents)),
u as (select {_UPDATES} from (select distinct doc_id from documents) where doc_id % 3 <> 0),
p as (select image_id, series, series_number from (select *, row_number() over (partition by image_id order by seq desc) as n from u) where n = 1),
k as (select series, min(series_id) as known_id from c where work_id <> '' and series_id <> '' group by series)
select c.image_id, c.work_id, case when {when} then p.series else c.series end as series, case when {when} then p.series_number else c.series_number end as series_number,
  case when {when} then coalesce(k.known_id, p.series) else c.series_id end as series_id
from c left join p using (image_id) left join k on k.series = p.series"""


OPTIONS = paths.PathOptions(preserve=(".pdf",))
_FILE = """case when doc_id % 17 = 0 then 'lib' else 'in' || cast(doc_id % 3 as varchar(20)) end as input, true as is_dir,
  'in' || cast(doc_id % 3 as varchar(20)) || '/' || source || '/' || cast(floor(doc_id / 2) as bigint) || case doc_id % 5 when 0 then '.epub' when 1 then '.EPUB' when 2 then '.out.epub' when 3 then '.pdf' else '.txt' end as path,
  source || '/' || cast(floor(doc_id / 2) as bigint) || case doc_id % 5 when 0 then '.epub' when 1 then '.EPUB' when 2 then '.out.epub' when 3 then '.pdf' else '.txt' end as rel"""
_PLAN_SQL = f"""f as (select distinct {_FILE} from documents),
s as (select *, case when lower(rel) like '%.out.epub' then 'skip' when lower(rel) like '%.epub' then 'convert' when lower(rel) like '%.pdf' then 'copy' else 'skip' end as status from f),
p as (select input, path, status, case status when 'convert' then input || '_converted/' || substr(rel, 1, length(rel) - 5) || '.out.epub' when 'copy' then input || '_converted/' || rel end as output from s)"""


def _planned(spark, sf_dir):
    return paths.plan(_table(spark, sf_dir, "documents").selectExpr(*_split(_FILE)), OPTIONS)


def path_plan(spark, sf_dir):
    return _planned(spark, sf_dir)


def path_conflicts(spark, sf_dir):
    return paths.conflicts(_planned(spark, sf_dir))


def path_skip(spark, sf_dir):
    planned = _planned(spark, sf_dir)
    return paths.skip_existing(planned, planned.filter(F.col("output").contains("src1/")).select(F.col("output").alias("path")))


def status_summary(spark, sf_dir):
    return paths.status_summary(path_skip(spark, sf_dir))


def covers_missing(spark, sf_dir):
    books = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book")).distinct()
    made = covers.wanted(books).filter((F.col("book") % 2 == 0) & (F.col("kind") == "full"))
    return covers.missing(covers.wanted(books), made)


def page_transform(spark, sf_dir):
    options = html.ConvertOptions(smart_punctuation=True, css=(("extra", "p { margin: 0 }"),), replacements=(("&#160;", " "),))
    return html.transform_pages(_table(spark, sf_dir, "pages").select("page_id", "html"), options)


def title_pages(spark, sf_dir):
    events = html.page_events(_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("book"), "html"))
    rows = events.select("book", F.concat(F.lit("OPS/"), "book", F.lit(".html")).alias("name"), F.explode_outer("events").alias("e")).select("book", "name", F.coalesce("e.kind", F.lit("none")).alias("kind"), F.coalesce("e.text", F.lit("")).alias("text"))
    return packages.needs_title_page(rows)


_SQL_REPLACED = "text"
for _find, _new in PAIRS:
    _SQL_REPLACED = f"replace({_SQL_REPLACED}, '{_find}', '{_new}')" if _find else _SQL_REPLACED

QUERIES = {f.__name__: f for f in (sentence_split, sentence_counts, span_numbering, find_replace, strip_replacement, punctuation, word_bytes, white_space, class_tokens, content_hash, action_classify, package_path, content_documents, first_document, cover_candidates, cover_resolved, package_edits, series_extract, path_plan, path_conflicts, path_skip, status_summary, covers_missing, page_transform, title_pages)} | {
    "series_upsert": lambda spark, sf_dir: _upserted(spark, sf_dir)[0],
    "series_no_replace": lambda spark, sf_dir: _upserted(spark, sf_dir, no_replace=True)[0],
    "series_no_persist": lambda spark, sf_dir: _upserted(spark, sf_dir, no_persist=True)[1],
}

ORACLES = {
    "sentence_split": f"with {DOCS}, p as (select doc_id, {_PIECES.format('text')} as s from d) select doc_id, (i - 1)::int as pos, s[i] as sentence from p, unnest(generate_series(1, len(s))) g(i)",
    "sentence_counts": f"select lang, count(*) as n_docs, sum(len({_PIECES.format('text')}))::bigint as n_sentences from documents group by lang",
    "span_numbering": f"""with {DOCS}, l as (select doc_id, i as line, string_split(text, chr(10))[i] as content from d, unnest(generate_series(1, len(string_split(text, chr(10))))) g(i)),
e as (select doc_id, line, 0 as place, 'blk' as kind, '' as text from l union all
  select doc_id, line, j, 'txt', s[j] from (select doc_id, line, {_PIECES.format('content')} as s from l), unnest(generate_series(1, len(s))) h(j)),
b as (select *, sum((kind = 'blk')::int) over (partition by doc_id order by line, place) as b from e),
k as (select *, lag(b, 1, 0) over (partition by doc_id order by line, place) as pb from b where kind = 'txt' and not regexp_full_match(text, '{_WHITE}*')),
n as (select *, sum((b > pb)::int) over (partition by doc_id order by line, place)::bigint as para from k)
select doc_id, para, row_number() over (partition by doc_id, para order by line, place)::int as seg, text from n""",
    "find_replace": f"with {DOCS} select doc_id, {_SQL_REPLACED} as text from d",
    "strip_replacement": f"with {DOCS} select doc_id, replace(text, chr(65533), '') as text from d",
    "word_bytes": f"with {DOCS} select doc_id, len(list_filter(string_split_regex(text, '{_WHITE}+'), lambda w: strlen(w) > 3))::bigint as n_words from d",
    "white_space": f"with {DOCS} select doc_id, (i - 1)::int as pos, regexp_full_match(x, '{_WHITE}*') as blank from (select doc_id, i, string_split(text, chr(10))[i] as x from d, unnest(generate_series(1, len(string_split(text, chr(10))))) g(i))",
    "class_tokens": f"with {DOCS} select doc_id, text <> '' and list_contains(string_split_regex(text, '[ \\t\\r\\n\\f]'), 'the') as hit, suffix(lower(text), 'er.') as ends from d",
    "content_hash": f"with {DOCS} select doc_id, sha1(text) as sha1, contains(text, chr(65533)) as differs from d",
    "action_classify": f"""with e as (select {_ENTRY} from documents), x as (select cast(book_no as varchar) as book, ord, name from e)
select book, ord, name, case when name in ('mimetype', 'OPS/thumbs.db', '__MACOSX/two.html') or name like '%/' then 'ignore' when name in ('OPS/One.xhtml', 'OPS/two.html') then 'content' when name = 'OPS/book.opf' then 'package' else 'copy' end as action from x""",
    "package_path": """select doc_id::varchar as book, case when doc_id % 3 <> 0 then 'OPS/' || doc_id || '.opf' end as strict_path, case when doc_id % 3 = 0 then 'container: version' end as error, 'x.txt' as lenient_path from documents""",
    "content_documents": """select doc_id::varchar as book, p::int as pos, case p when 0 then 'OPS/a%20b.txt' else 'd/' || doc_id || '.XHTML' end as name from documents, unnest([0, 1]) g(p) where doc_id % 7 <> 0""",
    "first_document": """select doc_id::varchar as book, case when doc_id % 7 <> 0 then 'd/' || doc_id || '.XHTML' end as name from documents""",
    "cover_candidates": """select doc_id::varchar as book, p::int as pos, ['c', 'c.png', 'c.png', 'OPS/c', 'OPS/c.png', 'OPS/c.png'][p + 1] as name from documents, unnest([0, 1, 2, 3, 4, 5]) g(p) where doc_id % 7 <> 0""",
    "cover_resolved": """select doc_id::varchar as book, case when doc_id % 2 = 0 then 'OPS/c.png' else 'c' end as name from documents where doc_id % 7 <> 0""",
    "series_extract": """select doc_id::varchar as image_id, case when doc_id % 3 = 0 then 'S' || (doc_id % 5) when doc_id % 2 = 0 then lang end as series,
  case when doc_id % 3 = 0 then case doc_id % 4 when 0 then '0.5' else (doc_id % 4) || '.5' end when doc_id % 2 = 0 then '3' end as series_number from documents where doc_id % 7 <> 0""",
    "series_upsert": _upsert_sql(False),
    "series_no_replace": _upsert_sql(True),
    "series_no_persist": f"""with c as (select {_CONTENT} from documents), u as (select {_UPDATES} from (select distinct doc_id from documents) where doc_id % 3 <> 0)
select image_id, series, series_number from (select *, row_number() over (partition by image_id order by seq desc) as n from u) where n = 1 and image_id not in (select image_id from c)""",
    "path_plan": f"with {_PLAN_SQL} select input, path, output, status from p",
    "path_conflicts": f"""with {_PLAN_SQL} select 'file' as kind, path as name, count(distinct input) as n from p where output is not null group by path having count(distinct input) > 1
union all select 'output', output, count(distinct path) from p where output is not null group by output having count(distinct path) > 1""",
    "path_skip": f"with {_PLAN_SQL} select input, path, output, case when contains(output, 'src1/') then 'skip' else status end as status from p",
    "status_summary": f"with {_PLAN_SQL} select case when contains(output, 'src1/') then 'skip' else status end as status, count(*) as n from p group by 1",
    "covers_missing": "select book, kind from (select distinct doc_id as book from documents), unnest(['full', 'library_full', 'library_list', 'library_grid']) g(kind) where not (book % 2 = 0 and kind = 'full')",
}
