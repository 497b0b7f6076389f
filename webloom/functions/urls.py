"""URL algebra as native expressions.

A *canonical* URL is ``scheme://host/path``: lower-case scheme and host, no parameters, query or fragment.
A value that is not a crawlable URL becomes NULL, and every later filter drops it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import as_col, bound, let

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"

# Schemes whose paths may carry ``;parameters``.
PARAM_SCHEMES = (
    "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms", "sftp", "tel",
)

# Folders that belong to the content management system.
CMS_FOLDERS = ("wp-content", "wp-admin", "wp-includes")

_PARAMS_AT_END = r";[^/]*\z"
_DOT_SEGMENT = r"/\.\.?(?:/|\z)"


def tidy_url(url: Column | str) -> Column:
    """Drop leading blanks and control bytes, and tabs and line breaks anywhere."""
    return F.regexp_replace(as_col(url), r"^[\x00-\x20]+|[\t\r\n]+", "")


def strip_fragment(url: Column | str) -> Column:
    return F.regexp_replace(as_col(url), r"(?s)#.*\z", "")


def canonicalize_url(url: Column | str, strip_slash: bool = False) -> Column:
    """Canonical form, or NULL. ``strip_slash`` also removes one trailing slash (never the root slash)."""
    return bound(url, lambda raw: _canonical(raw, strip_slash))


def _canonical(raw: Column, strip_slash: bool) -> Column:
    # Most URLs are canonical already: one test and no rewriting.
    last = r"[^?#;\t\r\n/]" if strip_slash else ""
    done = raw.rlike(rf"^[a-z][a-z0-9+.\-]*://[a-z0-9.:_\-]+/(?:[^?#;\t\r\n]*{last})?\z")
    whole = F.regexp_extract(tidy_url(raw), rf"^{SCHEME}://[^/?#]+[^?#]*", 0)
    # Parameters of the last segment, under the schemes that have them; then the root path, then a last slash.
    whole = F.regexp_replace(whole, rf"(?s)^((?i:{'|'.join(PARAM_SCHEMES)})://[^/]+/(?:.*/)?[^/;]*);[^/]*\z", "$1")
    whole = F.regexp_replace(whole, r"^([^:]+://[^/]+)\z", "$1/")
    if strip_slash:
        whole = F.regexp_replace(whole, r"(?s)^([^:]+://[^/]+/.*)/\z", "$1")
    lowered = let(
        whole,
        lambda u: F.when(
            u != "",
            F.concat(
                F.lower(F.regexp_extract(u, r"^[^:]+://[^/]+", 0)), F.regexp_extract(u, r"(?s)^[^:]+://[^/]+(/.*)\z", 1)
            ),
        ),
    )
    return F.when(done, raw).otherwise(lowered)


def url_host(url: Column | str) -> Column:
    """Lower-cased network location (user info and port kept); empty when there is none."""
    return F.lower(F.regexp_extract(as_col(url), rf"^{SCHEME}://([^/?#]*)", 1))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), rf"^{SCHEME}://[^/?#]*([^?#]*)", 1)


def is_internal(url: Column | str, site: Column | str) -> Column:
    """True when the host equals the site exactly. Sub-domains are external; NULL and empty URLs are not internal."""
    # NULL and empty URLs have no host to compare.
    host = url_host(url)
    return F.coalesce((host != "") & (host == as_col(site)), F.lit(False))


# --- reference resolution -------------------------------------------------------------------------


def base_parts(base: Column | str) -> dict[str, Column]:
    """What resolution needs from a canonical page URL. Compute it once per page, before exploding."""
    b = as_col(base)
    folder = F.regexp_extract(b, rf"(?s)^{SCHEME}://[^/]+(/(?:.*/)?)", 1)
    return {
        "scheme": F.regexp_extract(b, rf"^({SCHEME}):", 1),
        "root": F.regexp_extract(b, rf"^{SCHEME}://[^/]+", 0),
        "folder": folder,
        "is_plain": ~folder.rlike(r"//|/\.\.?/"),  # nothing to fold in the folder itself
    }


def relative_part(base_scheme: Column, ref: Column) -> Column:
    """A tidied reference without a scheme equal to the page's."""
    same = F.startswith(F.lower(ref), F.concat(base_scheme, F.lit(":")))
    return F.when(same, F.substr(ref, F.length(base_scheme) + 2)).otherwise(ref)


def remove_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` out of an absolute path."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda stack, seg: F.when(seg == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        .when(seg == ".", stack)
        .otherwise(F.concat(stack, F.array(seg))),
    )
    closed = F.when(path.rlike(r"/\.\.?\z"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return let(
        F.array_join(closed, "/"),
        lambda joined: F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined)),
    )


def _without_empty_tail(tail: Column) -> Column:
    no_query = F.regexp_replace(tail, r"^\?(?=#|\z)", "")
    return F.when(tail == "", tail).otherwise(F.regexp_replace(no_query, r"^([^#]*)#\z", "$1"))


def _join_path(base: Column, parts: Column | dict[str, Column], whole: Column, tail: Column) -> Column:
    """Join a reference without authority: ``whole`` is its path with parameters, ``tail`` its query and fragment."""

    def joined(cut: Column) -> Column:
        path, params = cut["path"], cut["params"]
        merged = F.when(F.startswith(path, F.lit("/")), path).otherwise(
            F.regexp_replace(F.concat(parts["folder"], path), r"/{2,}", "/")
        )
        clean = let(merged, lambda m: F.when(m.rlike(_DOT_SEGMENT), remove_dot_segments(m)).otherwise(m))
        return F.when((path == "") & (params == ""), F.concat(base, tail)).otherwise(
            F.concat(parts["root"], clean, params, tail)
        )

    local = F.regexp_replace(whole, r"^//", "")  # an empty authority
    return let(
        local,
        lambda head: let(
            F.when(
                F.contains(head, F.lit(";")),
                F.struct(
                    F.regexp_replace(head, _PARAMS_AT_END, "").alias("path"),
                    F.regexp_replace(F.regexp_extract(head, r";[^/]*\z", 0), r"^;\z", "").alias("params"),
                ),
            ).otherwise(F.struct(head.alias("path"), F.lit("").alias("params"))),
            joined,
        ),
    )


# Shapes with nothing to fold, cut or drop: a path from the root, and one from the page's folder.
_PLAIN_ROOTED = r"(?s)^/(?!/|\.\.?(?:/|\z))(?!.*/\.\.?(?:/|\z))[^;?#]*\z"
_PLAIN_RELATIVE = r"(?s)^(?![./])(?!.*(?:/\.\.?(?:/|\z)|//))[^:;?#]+\z"


def join_reference(base: Column, parts: Column | dict[str, Column], ref: Column, rest: Column) -> Column:
    """Resolve ``ref`` (tidied; ``rest`` is its :func:`relative_part`) against a canonical page URL."""
    other_scheme = ref.rlike(rf"^{SCHEME}:") & ~F.startswith(F.lower(ref), F.concat(parts["scheme"], F.lit(":")))
    general = let(
        F.regexp_extract(rest, r"^[^?#]*", 0),
        lambda whole: let(
            _without_empty_tail(F.substr(rest, F.length(whole) + 1)),
            lambda tail: F.when(
                F.startswith(whole, F.lit("//")) & (F.length(whole) > 2) & (F.substr(whole, F.lit(3), F.lit(1)) != "/"),
                F.concat(parts["scheme"], F.lit(":"), whole, tail),
            ).otherwise(_join_path(base, parts, whole, tail)),
        ),
    )
    return (
        F.when(rest.rlike(_PLAIN_ROOTED), F.concat(parts["root"], rest))
        .when(parts["is_plain"] & rest.rlike(_PLAIN_RELATIVE), F.concat(parts["root"], parts["folder"], rest))
        .when(other_scheme, ref)
        .otherwise(general)
    )


def is_canonical_path(ref: Column, strip_slash: bool = False) -> Column:
    """True where page root + reference is the canonical target already: the usual link from the root of a site."""
    last = r"[^;?#\t\r\n/]" if strip_slash else ""
    return ref.rlike(rf"(?s)^/(?!/|\.\.?(?:/|\z))(?!.*/\.\.?(?:/|\z))(?:[^;?#\t\r\n]*{last})?\z")


def resolve_url(base: Column | str, ref: Column | str) -> Column:
    """Absolute URL of a reference found in the canonical page URL ``base``."""

    def resolved(b: Column) -> Column:
        parts = F.struct(*[part.alias(name) for name, part in base_parts(b).items()])
        return let(
            parts,
            lambda p: let(
                tidy_url(ref), lambda r: let(relative_part(p["scheme"], r), lambda rest: join_reference(b, p, r, rest))
            ),
        )

    return bound(base, resolved)


# --- paths ---------------------------------------------------------------------------------------


def decode_path(path: Column | str) -> Column:
    """Percent-decode. ``+`` stays ``+`` and a malformed escape stays as it is."""

    def decode(p: Column) -> Column:
        kept = F.regexp_replace(p, r"%(?![0-9A-Fa-f]{2})", "%25")
        return F.when(
            F.contains(p, F.lit("%")), F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))
        ).otherwise(p)

    return bound(path, decode)


def basename(path: Column | str) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """Directory part. Slashes at its end are dropped, unless it consists of slashes only."""
    return F.regexp_replace(F.regexp_extract(as_col(path), r"(?s)^(.*/)", 1), r"(?<=[^/])/+\z", "")


def has_ext(path: Column | str) -> Column:
    """The last segment has a dot after some other character; a dotfile has no extension."""
    return basename(path).rlike(r"(?s)[^.].*[.]")


def tidy_path(path: Column) -> Column:
    """Collapse repeated slashes and ``.`` segments, and drop a trailing slash."""

    def tidy(p: Column) -> Column:
        messy = p.rlike(r"//|(?:^|/)\.(?:/|\z)|/\z")
        inner = F.regexp_replace(p, r"/(?:\.?/)+", "/")
        clean = F.regexp_replace(F.regexp_replace(inner, r"^(?:\./)+", ""), r"/\.?\z|^\.\z", "")
        return F.when(messy, clean).otherwise(p)

    return let(path, tidy)


def _relative_file(url: Column | str) -> Column:
    return F.ltrim(decode_path(url_path(url)), F.lit("/"))


def site_path(url: Column | str, root: str = "html") -> Column:
    """Generic layout: every page under ``root``, extensionless paths become folders with ``index.html``."""

    def mapped(path: Column) -> Column:
        return (
            F.when(path == "", F.lit("index.html"))
            .when(~has_ext(path), F.concat(path, F.lit("/index.html")))
            .otherwise(path)
        )

    return tidy_path(F.concat(F.lit(root + "/"), let(_relative_file(url), mapped)))


def cms_path(url: Column | str, with_backup: bool = False) -> Column:
    """CMS layout: the URL's own directories, with CMS folders and root-level ``.php`` files kept as they are."""

    def mapped(path: Column) -> Column:
        in_cms_folder = F.lit(False)
        for folder in CMS_FOLDERS:
            in_cms_folder = in_cms_folder | F.startswith(path, F.lit(folder))
        out = (
            F.when(path == "", F.lit("index.php"))
            .when(in_cms_folder, path)
            .when(F.endswith(path, F.lit(".php")) & ~F.contains(path, F.lit("/")), path)
        )
        if with_backup:
            archive = F.endswith(path, F.lit(".sql")) | F.endswith(path, F.lit(".zip"))
            out = out.when(archive, F.concat(F.lit("backup/"), basename(path)))
        return out.when(~has_ext(path), F.concat(path, F.lit("/index.html"))).otherwise(path)

    return tidy_path(let(_relative_file(url), mapped))


def relative_path(from_path: Column | str, to_path: Column | str) -> Column:
    """POSIX relative path of ``to_path`` seen from the directory of ``from_path``."""
    origin = F.split(as_col(from_path), "/")
    target = F.split(as_col(to_path), "/")

    def between(ends: Column) -> Column:
        folder, dest = ends["folder"], ends["dest"]
        differs = F.array_position(F.zip_with(folder, dest, lambda a, b: a.eqNullSafe(b)), F.lit(False))
        return let(
            F.when(differs == 0, F.size(folder).cast("int")).otherwise((differs - 1).cast("int")),
            lambda common: let(
                F.concat(
                    F.array_repeat(F.lit(".."), F.size(folder) - common),
                    F.slice(dest, common + 1, F.greatest(F.size(dest) - common, F.lit(0))),
                ),
                lambda steps: F.when(F.size(steps) == 0, F.lit(".")).otherwise(F.array_join(steps, "/")),
            ),
        )

    ends = F.struct(
        F.slice(origin, F.lit(1), F.size(origin) - 1).alias("folder"),
        target.alias("dest"),
    )
    return let(ends, between)


def page_slug(url: Column | str) -> Column:
    def slug(path: Column) -> Column:
        return (
            F.when(path == "", F.lit("home"))
            .when(path.rlike(r"(?s)[^./][^/]*\.php\z"), F.regexp_replace(path, r"\.php\z", ""))
            .when(F.endswith(path, F.lit(".php")), path)
            .when(~has_ext(path), basename(path))
            .otherwise(path)
        )

    return let(F.trim(url_path(url), F.lit("/")), slug)


# --- identifiers and dates -----------------------------------------------------------------------


def post_id(url: Column | str) -> Column:
    """Reproducible identifier in [0, 1000000). It can collide; see ``operators.export.with_collision_rank``."""
    return F.conv(F.substring(F.md5(as_col(url)), 1, 8), 16, 10).cast("bigint") % 1000000


def asset_fallback_name(url: Column | str) -> Column:
    return F.concat(F.lit("asset_"), F.substring(F.md5(as_col(url)), 1, 16))


def asset_name(url: Column | str) -> Column:
    """File name of an asset: the last path segment, or a hash where the path ends in a slash."""
    return let(
        basename(url_path(url)), lambda name: F.when(name == "", asset_fallback_name(url)).otherwise(name)
    )


def rfc822_date(ts: Column | str) -> Column:
    return F.concat(F.date_format(as_col(ts), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def sql_date(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd HH:mm:ss")
