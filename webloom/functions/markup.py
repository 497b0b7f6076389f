"""HTML extraction as native regular expressions over one page per row.

Every scanner consumes comments, scripts and style sheets as whole tokens, so markup inside them is never seen.
Quantifiers are possessive and every token that is begun also matches up to the end of the page (a start tag without
``>`` is dropped afterwards): no place is scanned again for each token, and matching is linear on hostile pages.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import as_col, bound, let
from .urls import basename, url_path

# One attribute: a name, optionally followed by "=" and a value that is quoted or bare.
_ATTR = r"""[^\s/=>"'][^\s/=>]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
# The rest of a start tag after its name, up to but without ">". A quote counts only after "=".
_ATTRS = r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_COMMENT = r"!--.*?(?:-->|\z)"
# The end of a start tag, or of the page inside one.
_END = r"(?:>|\z)"
_STYLE = rf"style(?:[\s/]{_ATTRS})?+(?:>.*?(?:</style\s*+>|\z)|\z)"
_SCRIPT = rf"script(?:[\s/]{_ATTRS})?+(?:>.*?(?:</script\s*+>|\z)|\z)"

_ANCHORS = rf"(?is)<(?:{_COMMENT}|{_STYLE}|{_SCRIPT}|a[\s/]({_ATTRS}{_END}))"
_ASSET = rf"<(?:{_COMMENT}|{_STYLE}|{_SCRIPT}|(?:link|img|source)[\s/]{_ATTRS}{_END})"
_ASSETS = rf"(?is){_ASSET}"
# The whole page as asset tokens and the text between them; the whole tag as attributes and what separates them.
# (Cut by matching and not by splitting: a split compiles its pattern anew for every value.)
_PAGE_PIECES = rf"(?is){_ASSET}|(?:[^<]++|(?!{_ASSET})<)++"
_TAG_PIECES = rf"""(?s){_ATTR}|[\s/=>"']++"""
_ASSET_TAG = rf"(?is)^<(?:(?:link|img|source)[\s/]{_ATTRS}>\z|script[\s/])"
_START_TAGS = rf"(?is)<(?:{_COMMENT}|{_STYLE}|{_SCRIPT}|[a-z][^\s/>]*+(?:[\s/]{_ATTRS})?+{_END})"
_INPUTS = rf"(?is)<(?:{_COMMENT}|{_STYLE}|{_SCRIPT}|input[\s/]({_ATTRS}{_END}))"
_OPEN_SCRIPT = rf"(?is)^<script(?:[\s/]{_ATTRS})?+>"
_TITLE = (
    rf"(?is)^(?:[^<]++|<(?:{_COMMENT}|{_STYLE}|{_SCRIPT})|<(?!title[\s>]))*+"
    r"<title(?:\s[^>]*+)?+>(.*?)(?:</title|\z)"
)

# Elements that never have content.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)

# --- character references -------------------------------------------------------------------------

# Name to characters, from the standard library's table; the look-up is a scan, so the usual names come first.
_COMMON = [name for name in ("amp", "quot", "lt", "gt", "nbsp", "apos", *sorted(name2codepoint)) if name + ";" in html5]
_NAMED = {name: html5[name + ";"] for name in _COMMON} | {n[:-1]: c for n, c in sorted(html5.items()) if n.endswith(";")}
# Names that also count without a semicolon, the longest first.
_OLD = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_NUMERIC = "#[0-9]++;?+|#[xX][0-9A-Fa-f]++;?+"
_REFERENCE = rf"&(?:{_NUMERIC}|[A-Za-z][A-Za-z0-9]*+;?+)"
# In an attribute an old name without semicolon only counts as a whole, and not before "=".
_ATTR_REFERENCE = rf"&(?:{_NUMERIC}|[A-Za-z][A-Za-z0-9]*+;|(?:{_OLD})(?![A-Za-z0-9=;]))"


# Numbers 0x80-0x9F stand for the Windows characters at these places.
_C1 = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
_FROM_C1, _TO_CP1252 = "".join(map(chr, _C1)), bytes(_C1).decode("cp1252")
_VALID_CODE = r"^(?!00000000|0000[Dd][89A-Fa-f])00(?:0[0-9A-Fa-f]{5}|10[0-9A-Fa-f]{4})\z"
# Control and non-characters stand for nothing.
_NO_CHARACTER = r"(?i)^(?:000000(?:0[1-8bef]|1[0-9a-f]|7f)|0000fd[de][0-9a-f]|00[01][0-9a-f]fff[ef])\z"


def _number(ref: Column) -> Column:
    """The character of ``&#number;``; an invalid number becomes the replacement character."""
    written = F.regexp_extract(ref, "^&#[xX]?0*+([0-9A-Fa-f]*)", 1)
    decimal = F.when(F.length(written) > 8, F.lit("FFFFFFFF")).otherwise(F.hex(F.coalesce(F.nullif(written, F.lit("")), F.lit("0")).cast("bigint")))
    digits = F.when(ref.rlike("^&#[xX]"), written).otherwise(decimal)
    return let(
        F.when(F.length(digits) > 8, F.lit("FFFFFFFF")).otherwise(F.lpad(digits, 8, "0")),
        lambda code: F.when(code.rlike(_NO_CHARACTER), F.lit(""))
        .when(code.rlike(_VALID_CODE), F.translate(F.decode(F.unhex(code), "UTF-32"), _FROM_C1, _TO_CP1252))
        .otherwise(F.lit("\ufffd")),
    )


def _character(ref: Column, in_attribute: bool) -> Column:
    """One ``&name;``, ``&name`` or ``&#number;``. Unknown names stay, but in text for an old name that they begin with."""
    names = list(_NAMED)
    table = F.map_from_arrays(
        F.split(F.lit(" ".join(names)), " "), F.split(F.lit("\u0000".join(_NAMED[n] for n in names)), "\u0000")
    )
    named = F.when(F.endswith(ref, F.lit(";")), F.try_element_at(table, F.substr(ref, F.lit(2), F.length(ref) - 2)))

    def begun(old: Column) -> Column:
        return F.when(old != "", F.concat(F.try_element_at(table, old), F.substr(ref, F.length(old) + 2)))

    by_prefix = let(F.regexp_extract(ref, f"^&({_OLD})", 1), begun)
    if in_attribute:
        by_prefix = F.when(~F.endswith(ref, F.lit(";")), by_prefix)
    return F.when(F.startswith(ref, F.lit("&#")), _number(ref)).otherwise(F.coalesce(named, by_prefix, ref))


def unescape(text: Column | str, in_attribute: bool = False) -> Column:
    """Decode character references. Strings without ``&`` pass through untouched."""
    pattern = _ATTR_REFERENCE if in_attribute else _REFERENCE

    def decode(value: Column) -> Column:
        decoded = F.array_join(
            F.zip_with(
                F.split(value, pattern, -1),
                F.regexp_extract_all(value, F.lit(pattern), F.lit(0)),
                lambda part, ref: F.when(ref.isNull(), part).otherwise(F.concat(part, _character(ref, in_attribute))),
            ),
            "",
        )
        return F.when(F.contains(value, F.lit("&")), decoded).otherwise(value)

    return bound(text, decode)


# --- tags and attributes --------------------------------------------------------------------------


def attr_token(attrs: Column, name: str) -> Column:
    """The whole ``name=value`` token, NULL when absent. Of repeated attributes the last one counts."""
    tokens = F.regexp_extract_all(attrs, F.lit(_ATTR), F.lit(0))
    own = F.filter(tokens, lambda t: t.rlike(rf"(?i)^{name}(?:\s*=|\z)"))
    return F.get(F.reverse(own), F.lit(0))


def token_value(token: Column) -> Column:
    """Decoded value of an attribute token; a bare attribute is an empty string."""
    raw = F.regexp_extract(token, r"(?s)^[^=]*=\s*(.*)\z", 1)
    return unescape(F.regexp_replace(raw, r"""(?s)^(?:"(.*)"|'(.*)')\z""", "$1$2"), in_attribute=True)


def attr_value(attrs: Column, name: str) -> Column:
    # One quoted attribute and nothing else: no need to split into tokens.
    alone = rf"""(?i)^\s*{name}="[^"&]*"\s*\z"""
    return let(
        attrs,
        lambda text: F.when(text.rlike(alone), F.regexp_extract(text, r'"([^"]*)"', 1)).otherwise(
            let(attr_token(text, name), lambda token: F.when(token.isNotNull(), token_value(token)))
        ),
    )


def extract_anchors(html: Column | str) -> Column:
    """``href`` of every ``<a href>`` in document order, character references decoded."""
    attrs = _closed_attrs(as_col(html), _ANCHORS)
    return F.filter(F.transform(attrs, lambda a: attr_value(a, "href")), lambda href: href.isNotNull())


def _closed_attrs(html: Column, pattern: str) -> Column:
    """Attribute texts that the pattern's group captures together with the ``>`` of their tag; tags without one are dropped."""
    found = F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda a: F.coalesce(F.endswith(a, F.lit(">")), F.lit(False)))
    return F.transform(found, lambda a: F.substr(a, F.lit(1), F.length(a) - 1))


def scan_assets(html: Column) -> Column:
    """Tokens of the asset scanner: asset tags, whole scripts, and comments and style sheets to be skipped."""
    return F.regexp_extract_all(html, F.lit(_ASSETS), F.lit(0))


def page_pieces(html: Column) -> Column:
    """The page cut into asset tokens and the text between them, nothing left out."""
    return F.regexp_extract_all(html, F.lit(_PAGE_PIECES), F.lit(0))


def is_asset_tag(piece: Column) -> Column:
    """True for a piece that is an asset tag, or a script with attributes (together with its body)."""
    return F.startswith(piece, F.lit("<")) & piece.rlike(_ASSET_TAG)


def open_tag(token: Column) -> Column:
    """Start tag of an asset token (a script token also holds the script's body)."""
    return F.when(F.lower(F.substring(token, 1, 7)) == "<script", F.regexp_extract(token, _OPEN_SCRIPT, 0)).otherwise(
        token
    )


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^<([A-Za-z]+)", 1))


def asset_attr(tag: Column) -> Column:
    return F.when(tag == "link", F.lit("href")).otherwise(F.lit("src"))


def _tag_attrs(tag: Column) -> Column:
    return F.regexp_extract(tag, r"(?s)^<[A-Za-z][^\s/>]*(.*)>\z", 1)


def asset_href(tag_text: Column, tag: Column) -> Column:
    attrs = _tag_attrs(tag_text)
    return F.when(tag == "link", attr_value(attrs, "href")).otherwise(attr_value(attrs, "src"))


def extract_asset_refs(html: Column | str) -> Column:
    """``array<struct<tag,attr,href>>`` of ``link href`` and ``script``/``img``/``source src``, in document order."""
    refs = F.transform(
        F.filter(scan_assets(as_col(html)), lambda t: ~t.rlike("(?i)^<(?:!|style)")),
        lambda t: let(
            F.struct(open_tag(t).alias("text"), tag_name(t).alias("tag")),
            lambda s: F.struct(
                s["tag"].alias("tag"),
                asset_attr(s["tag"]).alias("attr"),
                asset_href(s["text"], s["tag"]).alias("href"),
            ),
        ),
    )
    return F.filter(refs, lambda r: r["href"].isNotNull())


def replace_attr(tag_text: Column, name: Column, value: Column) -> Column:
    """The start tag with the value of one attribute replaced, and everything else byte for byte the same."""
    escaped = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return let(
        F.concat(name, F.lit('="'), escaped, F.lit('"')),
        lambda token: F.array_join(
            F.transform(
                F.regexp_extract_all(tag_text, F.lit(_TAG_PIECES), F.lit(0)),
                lambda old: F.when(F.lower(F.regexp_extract(old, r"^[^\s=]+", 0)) == name, token).otherwise(old),
            ),
            "",
        ),
    )


# --- page fields ----------------------------------------------------------------------------------


def strip_text(text: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z", "")


def extract_title(html: Column | str, url: Column | str) -> Column:
    """First title text. Only where the tag is absent: the URL's last segment, else ``Untitled``."""
    h = as_col(html)
    name = basename(url_path(url))
    fallback = F.when(name == "", F.lit("Untitled")).otherwise(name)
    return let(
        F.regexp_extract(h, _TITLE, 1),
        lambda text: F.when(text != "", strip_text(unescape(text)))
        .when(F.regexp_extract(h, _TITLE, 0) != "", F.lit(""))
        .otherwise(fallback),
    )


def extract_form_fields(html: Column | str, form_id: str) -> Column:
    """Named hidden inputs of the form with this id, as a map; NULL when there is no such form."""
    h = as_col(html)
    forms = F.filter(
        F.regexp_extract_all(h, F.lit(rf"(?is)<(?:{_COMMENT}|{_STYLE}|{_SCRIPT}|form[\s/]{_ATTRS}(?:>.*?(?:</form|\z)|\z))"), F.lit(0)),
        lambda t: t.rlike("(?i)^<form"),
    )
    own = F.filter(
        forms, lambda f: attr_value(F.regexp_extract(f, rf"(?is)^<form[\s/]({_ATTRS})>", 1), "id") == form_id
    )
    return F.when(
        h.rlike("(?i)<form"),
        let(F.get(own, F.lit(0)), lambda form: F.when(form.isNotNull(), _hidden_inputs(form))),
    )


def _hidden_inputs(form: Column) -> Column:
    attrs = _closed_attrs(form, _INPUTS)
    fields = F.transform(
        F.filter(attrs, lambda a: attr_value(a, "type") == "hidden"),
        lambda a: F.struct(attr_value(a, "name").alias("name"), F.coalesce(attr_value(a, "value"), F.lit("")).alias("value")),
    )
    named = F.filter(fields, lambda f: F.coalesce(f["name"] != "", F.lit(False)))
    return let(
        named,
        lambda all_: F.map_from_entries(
            # A later field of the same name wins.
            F.filter(
                all_,
                lambda f, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["name"] == f["name"]),
            )
        ),
    )


# --- main content ---------------------------------------------------------------------------------

# Content selectors in order of preference.
CONTENT_SELECTORS = ("main", "article", "#content", ".content", ".entry-content", "body")


_SKIP = rf"(?:[^<]++|<(?:{_COMMENT}|{_STYLE}|{_SCRIPT})"


def _hit(selector: str, text: Column, whole: Column) -> Column:
    return F.struct(F.lit(selector).alias("selector"), text.alias("text"), whole.alias("whole"))


def _tag_hit(html: Column, selector: str) -> Column:
    """First element of this name: the ``whole`` of it where one pass can tell, else the ``text`` of its start tag."""
    start = rf"(?is)^{_SKIP}|<(?!{selector}[\s/>]))*+(<{selector}(?:[\s/]{_ATTRS})?+"
    first = start + ">)"
    # Closed, and no element of the same name inside.
    plain = rf"{start}(?<!/)>{_SKIP}|<(?!/?{selector}[\s/>]))*+</{selector}\s*+>)"
    none = F.lit("")
    return F.when(
        html.rlike(rf"(?i)<{selector}[\s/>]"),
        let(
            F.regexp_extract(html, plain, 1),
            lambda whole: F.when(whole != "", _hit(selector, none, whole)).otherwise(
                let(F.regexp_extract(html, first, 1), lambda text: F.when(text != "", _hit(selector, text, none)))
            ),
        ),
    )


def _attr_hit(html: Column, selector: str) -> Column:
    """First start tag with this id or class."""
    word = selector[1:]
    kind = "id" if selector[0] == "#" else "class"

    def matches(tag: Column) -> Column:
        value = attr_value(_tag_attrs(tag), kind)
        test = value == word if kind == "id" else F.array_contains(F.split(value, r"\s+"), word)
        is_tag = tag.rlike(rf"(?is)^<[a-z].*\b{kind}\b") & ~tag.rlike("(?i)^<(?:script|style)")
        return F.coalesce(is_tag & test, F.lit(False))

    tags = F.filter(F.regexp_extract_all(html, F.lit(_START_TAGS), F.lit(0)), matches)
    # Few pages pass the first test; only those are cut into tags.
    return F.when(
        html.rlike(rf"""(?i)\b{kind}\s*+=\s*+(?:"[^"]*?\b{word}\b|'[^']*?\b{word}\b|[^\s"'>=]*?\b{word}\b)"""),
        let(F.get(tags, F.lit(0)), lambda text: F.when(text.isNotNull(), _hit(selector, text, F.lit("")))),
    )


def _outer_html(html: Column, start: Column) -> Column:
    """Source slice from a start tag to its matching end tag.

    Tags of the same name are counted. Where the element is never closed it ends with the document's body.
    """
    name = F.replace(F.replace(start["name"], F.lit("\\E"), F.lit("")), F.lit("\\Q"), F.lit(""))
    same_name = F.concat(
        F.lit(rf"(?is)<(?:{_COMMENT}|{_STYLE}|{_SCRIPT}|/?\Q"),
        name,
        F.lit(rf"\E(?:[\s/]{_ATTRS})?+{_END}|/(?:body|html)\s*+>)"),
    )
    return let(same_name, lambda rx: _balanced(html, start, rx))


def _balanced(html: Column, start: Column, rx: Column) -> Column:
    scan = F.struct(F.regexp_extract_all(html, rx, F.lit(0)).alias("tokens"), F.split(html, rx, -1).alias("texts"))

    def delta(token: Column) -> Column:
        low = F.lower(F.substr(token, F.lit(1), F.length(start["name"]) + 2))
        opens = F.startswith(low, F.concat(F.lit("<"), start["name"])) & ~F.endswith(token, F.lit("/>"))
        closes = F.startswith(low, F.concat(F.lit("</"), start["name"]))
        return F.when(~F.endswith(token, F.lit(">")), 0).when(opens, 1).when(closes, -1).otherwise(0)

    def ends_document(token: Column) -> Column:
        return token.rlike(r"(?i)^</(?:body|html)\s*>\z") & (delta(token) == 0)

    def slice_out(s: Column) -> Column:
        first = F.array_position(s["tokens"], start["text"]).cast("int")
        count = F.size(s["tokens"])

        def walk(state: Column, token: Column) -> Column:
            at = state["at"] + 1
            depth = F.when(at < first, F.lit(0)).otherwise(state["depth"] + delta(token))
            done = (at >= first) & (state["end"] == 0) & (depth <= 0)
            stop = (at > first) & (state["end"] == 0) & (state["stop"] == 0) & ends_document(token)
            return F.struct(
                at.alias("at"),
                depth.alias("depth"),
                F.when(done, at).otherwise(state["end"]).alias("end"),
                F.when(stop, at).otherwise(state["stop"]).alias("stop"),
            )

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"), F.lit(0).alias("stop"))
        walked = F.aggregate(s["tokens"], zero, walk)

        def cut(w: Column) -> Column:
            closed = w["end"] > 0
            # The last token inside the slice, and whether the text after it belongs to the slice too.
            last = F.when(closed, w["end"]).when(w["stop"] > 0, w["stop"] - 1).otherwise(count)
            inner = F.zip_with(
                F.slice(s["texts"], first + 1, last - first),
                F.slice(s["tokens"], first + 1, last - first),
                lambda text, token: F.concat(text, token),
            )
            rest = F.when(closed, F.lit("")).otherwise(F.get(s["texts"], last))
            return F.concat(start["text"], F.array_join(inner, ""), rest)

        return let(walked, cut)

    alone = start["name"].isin(*VOID_TAGS) | F.endswith(start["text"], F.lit("/>"))
    return F.when(alone, start["text"]).otherwise(let(scan, slice_out))


def extract_main_content(html: Column | str) -> Column:
    """Outer HTML of the first content selector that has a hit, in order of preference; else an empty string."""
    h = as_col(html)
    hits = [_attr_hit(h, s) if s[0] in "#." else _tag_hit(h, s) for s in CONTENT_SELECTORS]

    def cut(hit: Column) -> Column:
        name = F.lower(F.regexp_extract(hit["text"], r"^<([A-Za-z][^\s/>]*)", 1))
        start = F.struct(name.alias("name"), hit["text"].alias("text"))
        return F.when(hit["whole"] != "", hit["whole"]).otherwise(let(start, lambda tag: _outer_html(h, tag)))

    return let(F.coalesce(*hits), lambda hit: F.when(hit.isNull(), F.lit("")).otherwise(cut(hit)))
