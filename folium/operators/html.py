"""A lenient HTML tree, edits on it and a polyglot rendering; run in Arrow batches.

The tree builder closes what the HTML standard says a start tag closes (paragraphs before
blocks, items, cells, options), adds html, head, body and tbody where they are implied, and
reopens formatting elements that a block's end left open. It is a subset: foster parenting
and templates are not built. A page that fails gives an error text, not a failed job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style"}
BLOCKS = set("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
FORMAT = set("a b big code em font i nobr s small strike strong tt u".split())
HEAD = set("base link meta title script style noscript template".split())
BOOLEAN = set("async autofocus autoplay checked controls default defer disabled hidden ismap loop multiple muted nomodule novalidate open readonly required reversed selected".split())
STARTS = set("p ol ul table h1 h2 h3 h4 h5 h6".split())
NO_SPANS = set("script style pre audio video svg math img".split())
NO_PUNCTUATION = set("pre code script style".split())
NO_COUNT = NO_SPANS | {"p"}
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_SENTENCE = re.compile("(?s).*?[.!?]['\"”’“…]?[\\t\\n\\f\\r ]+|.+")


@dataclass(eq=False)
class Node:
    """kind: doc, element, text, comment, doctype, xml."""

    kind: str
    tag: str = ""
    attrs: list[tuple[str, str | None]] = field(default_factory=list)
    text: str = ""
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)

    def add(self, child: Node, at: int | None = None) -> Node:
        child.parent = self
        self.children.insert(len(self.children) if at is None else at, child)
        return child

    def get(self, key: str) -> str | None:
        return next((v for k, v in self.attrs if k == key), None)

    def set(self, key: str, value: str) -> None:
        for i, (k, _) in enumerate(self.attrs):
            if k == key:
                self.attrs[i] = (k, value)
                return
        self.attrs.append((key, value))

    def walk(self) -> Iterator[Node]:
        """Preorder, without the node itself."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))


def element(tag: str, attrs: dict | None = None, text: str | None = None) -> Node:
    n = Node("element", tag, list((attrs or {}).items()))
    if text is not None:
        n.add(Node("text", text=text))
    return n


def span(prefix: str, cls: str, para: int, seg: int) -> Node:
    return element("span", {"class": cls, "id": f"{prefix}.{para}.{seg}"})


def matches(n: Node, key: str, value: str) -> bool:
    return any(k == key and v == value for k, v in n.attrs)


def find_tag(root: Node, tag: str) -> Node | None:
    return next((n for n in root.walk() if n.kind == "element" and n.tag.lower() == tag), None)


def find_class(root: Node, token: str) -> Node | None:
    return next((n for n in root.walk() if n.kind == "element" and token in re.split("[ \t\r\n\f]", n.get("class") or "")), None)


def is_white(text: str) -> bool:
    return not text or text.isspace() and not any(c in "\x1c\x1d\x1e\x1f" for c in text)


def is_empty(n: Node) -> bool:
    return all(c.kind == "comment" or c.kind == "text" and is_white(c.text) for c in n.children)


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.doc = Node("doc")
        self.html = self.head = self.body = None
        self.open: list[Node] = []
        self.formats: list[Node] = []

    # -- where things go

    def _html(self) -> Node:
        if self.html is None:
            self.html = self.doc.add(element("html"))
        return self.html

    def _head(self) -> Node:
        if self.head is None:
            self.head = self._html().add(element("head"))
        return self.head

    def _body(self) -> Node:
        if self.body is None:
            self._head()
            self.open = [self._html().add(element("body"))]
            self.body = self.open[0]
        return self.body

    @property
    def here(self) -> Node:
        if self.body is None and not self.open:
            return self._head() if self.head is not None else self._html()
        return self.open[-1] if self.open else self._body()

    def _reopen(self) -> None:
        for f in list(self.formats):
            if f not in self.open:
                copy = self.here.add(Node("element", f.tag, list(f.attrs)))
                self.formats[self.formats.index(f)] = copy
                self.open.append(copy)

    def _close(self, tags: set[str], until: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in until:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    # -- events

    def handle_starttag(self, tag, attrs):
        attrs = [(k, v if v is not None else "") for k, v in dict(reversed(attrs)).items()][::-1]
        if tag == "html":
            self._html().attrs += [a for a in attrs if a[0] not in dict(self._html().attrs)]
            return
        if tag == "head":
            self._head().attrs += attrs
            return
        if tag == "body":
            self._body().attrs += [a for a in attrs if a[0] not in dict(self.body.attrs)]
            return
        if self.body is None and not (tag in HEAD or self.open):
            self._body()
        node = Node("element", tag, attrs)
        if self.body is None:
            (self.open[-1] if self.open else self._head()).add(node)
            if tag not in VOID:
                self.open.append(node)
            return
        if tag in BLOCKS:
            self._close({"p"}, {"table", "td", "th", "button"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag == "tr" and self.here.tag == "table":
            self.open.append(self.here.add(element("tbody")))
        if tag not in BLOCKS and tag not in {"tr", "td", "th", "tbody", "thead", "tfoot", "li", "dt", "dd"}:
            self._reopen()
        self.here.add(node)
        if tag not in VOID:
            self.open.append(node)
            if tag in FORMAT:
                self.formats.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "head" and self.body is None:
            self.open = []
            return
        if tag in ("html", "body"):
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self._body()
            self.here.add(element("p"))
            return
        if tag in FORMAT:
            self.formats = [f for f in self.formats if not (f.tag == tag and (f in self.open))] if any(f.tag == tag and f in self.open for f in self.formats) else self.formats
        for i in range(len(self.open) - 1, 0 if self.body is not None else -1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return

    def handle_data(self, data):
        if self.open and self.body is None:
            self.open[-1].add(Node("text", text=data))
            return
        if self.body is None:
            if is_white(data):
                if self.head is not None:
                    (self.html if self.head else self.doc).add(Node("text", text=data))
                return
            self._body()
        if not is_white(data):
            self._reopen()
        last = self.here.children[-1] if self.here.children else None
        if last is not None and last.kind == "text":
            last.text += data
        else:
            self.here.add(Node("text", text=data))

    def handle_comment(self, data):
        (self.here if self.html is not None else self.doc).add(Node("comment", text=data))

    def handle_decl(self, decl):
        self.doc.add(Node("doctype", text=decl))

    def handle_pi(self, data):
        if data.lower().startswith("xml ") and self.html is None:
            self.doc.add(Node("xml", text=data.rstrip("?")))


def parse(text: str) -> Node:
    b = _Builder()
    b.feed(text.removeprefix("﻿"))
    b.close()
    b._body()
    return b.doc


# -- rendering


def _escape(text: str, quote: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace(" ", "&#160;")
    return text.replace('"', "&#34;") if quote else text


def render(root: Node) -> str:
    """Markup that is both XML and HTML: void elements closed, others never self-closed."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.kind == "text":
            out.append(n.text if n.parent is not None and n.parent.tag in RAW else _escape(n.text))
        elif n.kind == "comment":
            out.append(f"<!--{n.text}-->")
        elif n.kind == "doctype":
            out.append(f"<!{n.text}>")
        elif n.kind == "xml":
            out.append(f"<?{n.text}?>")
        elif n.kind == "element":
            attrs = list(n.attrs)
            keys = {k for k, _ in attrs}
            spaces = {"html": "http://www.w3.org/1999/xhtml", "svg": "http://www.w3.org/2000/svg", "math": "http://www.w3.org/1998/Math/MathML"}
            if n.tag in spaces and "xmlns" not in keys:
                attrs.insert(0, ("xmlns", spaces[n.tag]))
            if n.tag in RAW and "type" not in keys:
                attrs.insert(0, ("type", "text/javascript" if n.tag == "script" else "text/css"))
            written = "".join(f' {k}="{_escape(k if k in BOOLEAN and not v else v or "", True)}"' for k, v in attrs)
            if n.tag in VOID:
                out.append(f"<{n.tag}{written}/>")
            else:
                out.append(f"<{n.tag}{written}>")
                stack.append(f"</{n.tag}>")
                stack.extend(reversed(n.children))
        else:
            stack.extend(reversed(n.children))
    return "".join(out)


def dump(root: Node) -> str:
    """One line a node, in preorder, indented by depth."""
    lines, stack = [], [(c, 0) for c in reversed(root.children)]
    while stack:
        n, depth = stack.pop()
        if n.kind == "element":
            cls, own = n.get("class"), n.get("id")
            other = next(((k, v) for k, v in n.attrs if k not in ("class", "id")), None)
            lines.append("  " * depth + n.tag + (f".{cls}" if cls else "") + (f"#{own}" if own else "") + (f"[{other[0]}={other[1]}]" if other else ""))
        else:
            lines.append("  " * depth + f"{n.kind}: {n.text!r}")
        stack.extend((c, depth + 1) for c in reversed(n.children))
    return "\n".join(lines)


# -- edits, in the order in which they are applied


@dataclass(frozen=True)
class ConvertOptions:
    smart_punctuation: bool = False
    replacements: tuple[tuple[str, str], ...] = ()
    dummy_titlepage: bool | None = None
    css: tuple[tuple[str, str], ...] = ()
    charset: str = ""
    span_class: str = "frag"
    span_prefix: str = "frag"
    style_class: str = "reader-fixes"
    style: str = "div#book-inner { margin-top: 0; margin-bottom: 0; }"


def fix_charset(doc: Node) -> None:
    head = find_tag(doc, "head")
    for n in head.walk() if head else ():
        if n.tag != "meta":
            continue
        if (c := n.get("charset")) is not None and c.upper() != "UTF-8":
            n.set("charset", "UTF-8")
        if (n.get("http-equiv") or "").lower() == "content-type" and (content := n.get("content")):
            kind, *parameters = [p.strip() for p in content.split(";")]
            if not re.fullmatch(r"[^/\s]+/[^/\s]+", kind):
                continue
            pairs = dict(p.split("=", 1) for p in parameters if "=" in p)
            if pairs.get("charset", "utf-8").lower() != "utf-8":
                n.set("content", "; ".join([kind, *(f"{k}={'utf-8' if k == 'charset' else v}" for k, v in sorted(pairs.items()))]))


def add_style(doc: Node, cls: str, css: str) -> None:
    find_tag(doc, "head").add(element("style", {"type": "text/css", "class": cls}, css))


def wrap_body(doc: Node) -> None:
    body = find_tag(doc, "body")
    for c in body.children:
        if matches(c, "id", "book-columns") and any(matches(g, "id", "book-inner") for g in c.children):
            return
    inner, outer = element("div", {"id": "book-inner"}), element("div", {"id": "book-columns"})
    for c in body.children:
        inner.add(c)
    body.children = []
    body.add(outer).add(inner)


def split_sentences(text: str) -> list[str]:
    return _SENTENCE.findall(text) if text else [""]


def add_spans(doc: Node, prefix: str, cls: str) -> None:
    body = find_tag(doc, "body")
    if find_class(body, cls) is not None:
        return
    para, seg, fresh = 0, 0, False

    def visit(n: Node) -> None:
        nonlocal para, seg, fresh
        stack = list(reversed(n.children))
        while stack:
            c = stack.pop()
            if c.kind == "text":
                made: list[Node] = []
                for s in split_sentences(c.text):
                    if is_white(s) and c.parent.tag != "p":
                        made.append(Node("text", text=s))
                        continue
                    if fresh:
                        para, seg, fresh = para + 1, 0, False
                    seg += 1
                    w = span(prefix, cls, para, seg)
                    w.add(Node("text", text=s))
                    made.append(w)
                at = c.parent.children.index(c)
                c.parent.children[at : at + 1] = made
                for m in made:
                    m.parent = c.parent
            elif c.kind == "element" and c.tag == "img":
                para, seg, fresh = para + 1, 1, False
                at, parent = c.parent.children.index(c), c.parent
                w = span(prefix, cls, para, seg)
                parent.children[at] = w
                w.parent = parent
                w.add(c)
            elif c.kind == "element" and c.tag not in NO_SPANS:
                fresh = fresh or c.tag in STARTS
                stack.extend(reversed(c.children))

    visit(body)


def remove_spans(doc: Node, prefix: str) -> None:
    """The inverse of add_spans; text that was one node is one again."""
    for n in list(doc.walk()):
        if n.tag == "span" and (n.get("id") or "").startswith(prefix + "."):
            at = n.parent.children.index(n)
            n.parent.children[at : at + 1] = n.children
            for c in n.children:
                c.parent = n.parent
    for n in [doc, *doc.walk()]:
        joined: list[Node] = []
        for c in n.children:
            if c.kind == "text" and joined and joined[-1].kind == "text":
                joined[-1].text += c.text
            else:
                joined.append(c)
        n.children = joined


_DASHES = [(re.compile(p), r) for p, r in (("---", "—"), ("--", "–"), (r"\.\.\.|\. \. \.", "…"), (r"(?<![0-9/])1/2(?![0-9/])", "½"), (r"(?<![0-9/])1/4(?![0-9/])", "¼"), (r"(?<![0-9/])3/4(?![0-9/])", "¾"), (r"(?i)\(c\)", "©"), (r"(?i)\(r\)", "®"), (r"(?i)\(tm\)", "™"), (r"(?<![^\s(\[{–—])\"(?=\S)", "“"), ("\"", "”"), (r"(?<![^\s(\[{–—“])'(?=\S)(?![0-9]0s)", "‘"), ("'", "’"))]


def educate(text: str) -> str:
    for p, r in _DASHES:
        text = p.sub(r, text)
    return unescape(text)


def smarten(doc: Node) -> None:
    stack = [find_tag(doc, "body")]
    while stack:
        for c in stack.pop().children:
            if c.kind == "text" and not is_white(c.text):
                c.text = educate(c.text)
            elif c.kind == "element" and c.tag not in NO_PUNCTUATION:
                stack.append(c)


def clean(doc: Node) -> None:
    for n in list(doc.walk()):
        if n.kind == "text":
            n.text = n.text.replace("�", "")
        elif n.tag == "meta" and n.get("name") in ("Adept.expected.resource", "Adept.resource") or (n.tag == "o:p" or n.tag.startswith("st1:")) and is_empty(n):
            n.parent.children.remove(n)


def transform(text: str, o: ConvertOptions = ConvertOptions()) -> str:
    doc = parse(text)
    fix_charset(doc)
    add_style(doc, o.style_class, o.style)
    wrap_body(doc)
    add_spans(doc, o.span_prefix, o.span_class)
    for cls, css in o.css:
        add_style(doc, cls, css)
    if o.smart_punctuation:
        smarten(doc)
    clean(doc)
    out = render(doc)
    for find, new in o.replacements:
        if find:
            out = out.replace(find, new)
    return out


def body_events(text: str) -> list[dict]:
    """What the title-page rule counts: paragraphs (not entered), images and text of the body."""
    out, stack = [], list(reversed(find_tag(parse(text), "body").children))
    while stack:
        n = stack.pop()
        if n.kind == "text":
            out.append({"kind": "txt", "text": n.text})
        elif n.kind == "element":
            if n.tag in ("p", "img", "svg"):
                out.append({"kind": n.tag, "text": ""})
            if n.tag not in NO_COUNT:
                stack.extend(reversed(n.children))
    return out


#: Signs of markup whose results are handed on together; a worker holds so much output at a time, not a batch's.
PIECE = 1 << 18


def _mapped(make: Callable[[str], object], kind: pa.DataType, column: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n != column]
            markup = batch.column(column)
            first, size, values, failed = 0, 0, [], []
            for at in range(len(batch)):
                x = markup[at].as_py()
                try:
                    values.append(None if x is None else make(x))
                    failed.append(None)
                except Exception as e:  # one bad page is a row with an error
                    values.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
                size += len(x or "")
                if size >= PIECE or at + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(i).slice(first, len(values)) for i in keep] + [pa.array(values, kind), pa.array(failed, pa.string())], [batch.schema.names[i] for i in keep] + [into, "error"])
                    first, size, values, failed = at + 1, 0, [], []

    return run


def _others(df: DataFrame, column: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != column)


def transform_pages(pages: DataFrame, options: ConvertOptions = ConvertOptions(), column: str = "html") -> DataFrame:
    """The table with the transformed markup in ``column`` and an error column."""
    return pages.mapInArrow(_mapped(lambda x: transform(x, options), pa.string(), column, column), f"{_others(pages, column)}{column} string, error string")


def page_events(pages: DataFrame, column: str = "html") -> DataFrame:
    """The table with events (kind, text) of each body instead of the markup."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    return pages.mapInArrow(_mapped(body_events, kind, column, "events"), f"{_others(pages, column)}events array<struct<kind:string,text:string>>, error string")
