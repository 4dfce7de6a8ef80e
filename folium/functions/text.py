"""Column functions on text: sentences, white space, class tokens, suffixes, ordered
replacement, punctuation, file-name rules. Built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = "(?s).*?[.!?]['\"”’“…]?[\\t\\n\\f\\r ]+|.+"
#: Every sign with the Unicode property White_Space, written out.
WHITE = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
JUNK = ("calibre_bookmarks.txt", "iTunesMetadata.plist", "iTunesArtwork.plist", ".DS_STORE", "thumbs.db", "Thumbs.db")


def sentences(text: Column) -> Column:
    """Pieces that end after a sentence's end and its white space; together they are the text. '' gives ['']."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(SENTENCE), 0))


def is_space(text: Column) -> Column:
    """White space only, or empty."""
    return text.rlike(f"^[{WHITE}]*$") & ~text.rlike(f"[^{WHITE}]")


def has_token(text: Column, token: str) -> Column:
    """A class attribute's test: one of the tokens between space, tab and line signs."""
    return (text != "") & F.array_contains(F.split(text, "[ \\t\\r\\n\\f]"), token)


def has_suffix_fold(text: Column, suffix: Column) -> Column:
    return F.endswith(F.lower(text), F.lower(suffix))


def strip_replacement(text: Column) -> Column:
    return F.replace(text, F.lit("�"), F.lit(""))


def replace_in_order(text: Column, pairs) -> Column:
    """Each pair is a whole pass over what the one before left; an empty find does nothing."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])) if p[0] else t, pairs, text)


def _where(text: Column, signs: tuple[str, ...], step) -> Column:
    """The step, only for texts that have one of the signs. A lambda binds the text, so that a chain of steps isn't written out twice for each."""

    def run(t: Column) -> Column:
        return F.when(reduce(lambda a, b: a | b, (F.contains(t, F.lit(x)) for x in signs)), step(t)).otherwise(t)

    return F.element_at(F.transform(F.array(text), run), 1)


def _replaced(t: Column, steps) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, t)


def smart_punctuation(text: Column) -> Column:
    """Dashes, ellipses, fractions, signs and curly quotes of one text node. Patterns begin with the sign itself, what must not stand before it follows."""
    dashes = [("---", "—"), ("--", "–")]
    fractions = [(rf"{a}(?<![0-9/]{a})/{b}(?![0-9/])", sign) for a, b, sign in ((1, 2, "½"), (1, 4, "¼"), (3, 4, "¾"))]
    signs = [(r"\((?i:c)\)", "©"), (r"\((?i:r)\)", "®"), (r"\((?i:tm)\)", "™")]
    double = (r"\"(?<![^\s(\[{–—]\")(?=\S)", "“")
    single = (r"'(?<![^\s(\[{–—“]')(?=\S)(?![0-9]0s)", "‘")
    t = F.make_valid_utf8(text)
    t = replace_in_order(t, dashes)
    t = _where(t, ("...", ". . ."), lambda t: _replaced(t, [(r"\.\.\.|\. \. \.", "…")]))
    t = _where(t, ("1/2", "1/4", "3/4"), lambda t: _replaced(t, fractions))
    t = _where(t, ("(",), lambda t: _replaced(t, signs))
    t = _where(t, ("\"",), lambda t: F.replace(_replaced(t, [double]), F.lit("\""), F.lit("”")))
    return _where(t, ("'",), lambda t: F.replace(_replaced(t, [single]), F.lit("'"), F.lit("’")))


def words_longer_than(text: Column, n_bytes: int) -> Column:
    """White-space separated words of more bytes than that."""
    return F.size(F.filter(F.split(text, f"[{WHITE}]+"), lambda w: F.octet_length(w) > n_bytes))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def directory(path: Column) -> Column:
    """The part before the last slash, '.' if there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def joined_path(folder: Column, href: Column) -> Column:
    """A cleaned join: no empty, '.' or resolvable '..' part."""
    parts = F.filter(F.split(F.concat_ws("/", folder, href), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    return F.when(F.size(kept) == 0, F.lit(".")).otherwise(F.array_join(kept, "/"))


def is_junk(path: Column) -> Column:
    """Files that tools leave behind; case counts, and only a top __MACOSX folder."""
    return base_name(path).isin(*JUNK) | (directory(path) == "__MACOSX")


def is_directory(path: Column) -> Column:
    return F.endswith(path, F.lit("/"))


def is_html(path: Column) -> Column:
    return F.lower(extension(path)).isin(".htm", ".html", ".xhtml")
