"""URL columns, built from regular expressions so a bad URL never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions.common import c, contains_any, map_lookup, trim_ws

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(c(url), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def host(url: Column | str) -> Column:
    """Lowercase host without port; '' for anything that is not absolute."""
    return F.lower(F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1))


def netloc(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1))


def path(url: Column | str) -> Column:
    """Path with its leading slash; '/' when the URL has none."""
    found = F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def query(url: Column | str) -> Column:
    return F.regexp_extract(c(url), r"^[^?#]*\?([^#]*)", 1)


def is_absolute(url: Column | str) -> Column:
    return c(url).rlike(_ABSOLUTE)


def base_url(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def segments(path_col: Column) -> Column:
    return F.filter(F.split(path_col, "/"), lambda s: s != "")


def strip_slash(col: Column) -> Column:
    return F.regexp_replace(col, "/$", "")


def normalize_url(url: Column | str) -> Column:
    """No fragment, sorted query keys (first value kept), no trailing slash, lowercase host.

    Values are kept as written; percent-encoding is not rewritten.
    """
    u = c(url)
    pairs = F.filter(F.split(query(u), "&"), lambda p: p != "")
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    first_only = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.struct(
                F.substring_index(p, "=", 1).alias("k"),
                F.regexp_extract(p, "=(.*)$", 1).alias("v"),
                (F.array_position(keys, F.substring_index(p, "=", 1)) == i + 1).alias("first"),
            ),
        ),
        lambda s: s["first"],
    )
    sorted_query = F.array_join(
        F.transform(F.array_sort(first_only), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&"
    )
    p = path(u)
    short = F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    rebuilt = F.concat(
        base_url(u), short, F.when(sorted_query == "", F.lit("")).otherwise(F.concat(F.lit("?"), sorted_query))
    )
    return F.when(is_absolute(u), rebuilt).otherwise(u)


def cache_key(url: Column | str, setting: Column | str) -> Column:
    digest = F.sha2(F.concat(normalize_url(url), F.lit("#"), c(setting)), 256)
    return F.concat(F.lit("session-"), F.substring(digest, 1, 12))


def kb_domain(url: Column | str) -> Column:
    """Store key of a site: last two host labels joined by a dash."""
    labels = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")
    return F.when(
        is_absolute(url), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "-")
    ).otherwise(F.regexp_replace(c(url), "[^a-zA-Z0-9-]", "-"))


def root_domain(hostname: Column | str) -> Column:
    """Last two labels of a host, whatever the suffix."""
    return F.regexp_extract(c(hostname), r"([^.]+\.)?[^.]+$", 0)


def registrable_domain(hostname: Column | str) -> Column:
    """Two labels, or three below the known two-part suffixes."""
    clean = F.regexp_replace(c(hostname), r"^www\.", "")
    suffixes = "|".join(x.replace(".", r"\.") for x in K.MULTI_PART_TLDS)
    return F.regexp_extract(clean, rf"([^.]+\.)?(?:{suffixes}|[^.]+)$", 0)


def is_docs_subdomain(hostname: Column | str) -> Column:
    clean = F.regexp_replace(c(hostname), r"^www\.", "")
    root = registrable_domain(clean)
    prefix = F.substring(clean, F.lit(1), F.length(clean) - F.length(root) - 1)
    return (clean != root) & F.lower(prefix).isin(K.DOCS_SUBDOMAINS)


def match_key(url: Column | str) -> Column:
    """Scheme + host + path without trailing slash, query dropped."""
    u = c(url)
    return F.when(
        is_absolute(u), F.concat(scheme(u), F.lit("://"), host(u), strip_slash(path(u)))
    ).otherwise(F.lower(strip_slash(u)))


def host_path_key(url: Column | str) -> Column:
    u = c(url)
    return F.when(
        is_absolute(u), F.concat(F.regexp_replace(host(u), r"^www\.", ""), strip_slash(path(u)))
    ).otherwise(u)


def strip_page_ext(col: Column) -> Column:
    return F.regexp_replace(col, r"\.(md|html|htm|mdx)$", "")


def _collapse_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path in one fold."""
    parts = F.split(F.regexp_replace(p, "^/", ""), "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    # a path that ends in a dot segment keeps its directory slash
    tail = F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"), tail)
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.regexp_replace(joined, "/+$", "/")).otherwise(p)


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute form of a link found on ``base``."""
    h, b = c(href), c(base)
    h_path = F.regexp_extract(h, "^([^?#]*)", 1)
    h_rest = F.regexp_extract(h, r"^[^?#]*([?#].*)$", 1)
    folder = F.regexp_extract(path(b), "^(.*/)", 1)
    return (
        F.when(h.rlike("^https?://"), h)
        .when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(base_url(b), _collapse_dots(h_path), h_rest))
        .when(h.startswith("#"), F.concat(base_url(b), path(b), F.when(query(b) != "", F.concat(F.lit("?"), query(b))).otherwise(""), h))
        .when(h.startswith("?"), F.concat(base_url(b), path(b), h))
        .otherwise(F.concat(base_url(b), _collapse_dots(F.concat(folder, h_path)), h_rest))
    )


def docs_subpath(url: Column | str, min_segments: int = 1, llms_url: Column | None = None) -> Column:
    """First path segment when it names a documentation area, else null."""
    parts = segments(path(url))
    first = F.get(parts, F.lit(0))
    found = F.when(
        (F.size(parts) >= min_segments) & F.lower(first).isin(K.DOCS_PATH_SEGMENTS), F.concat(F.lit("/"), first)
    )
    if llms_url is None:
        return found
    folder = F.regexp_extract(path(llms_url), "^(.*)/[^/]*$", 1)
    return F.coalesce(F.when(folder != "", folder), found)


def walk_up(url: Column | str, filename: str) -> Column:
    """Candidate file URLs in up to three parent folders, nearest first."""
    parts = segments(path(url))
    n = F.size(parts)
    depths = F.when(n >= 2, F.sequence(n - 1, F.greatest(n - 3, F.lit(1)), F.lit(-1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        depths,
        lambda d: F.concat(base_url(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), d), "/"), F.lit("/" + filename)),
    )


def input_type(url: Column | str, override: Column | None = None) -> Column:
    detected = F.when(F.lower(c(url)).contains("sitemap.xml"), F.lit("sitemap")).otherwise(F.lit("doc"))
    return detected if override is None else F.coalesce(override, detected)


def is_non_doc_url(url: Column | str) -> Column:
    return contains_any(F.lower(c(url)), K.NON_DOC_URL_PARTS)


def slug_words(url: Column | str) -> Column:
    """Lowercase words of the path, the extension of the last part removed."""
    parts = segments(path(url))
    n = F.size(parts)
    bare = F.transform(
        parts,
        lambda p, i: F.when(i == n - 1, F.regexp_replace(p, r"(?i)\.(html?|php|jsp|aspx|pdf|md|txt)$", "")).otherwise(p),
    )
    words = F.flatten(F.transform(bare, lambda p: F.split(p, "[-_]")))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.lower(w))


def slug_typo_hits(url: Column | str) -> Column:
    """Array of (segment, suggestion, edit_distance) for known misspellings.

    The dictionary has 19 fixed entries, so it stays a literal map in the
    projection: no join and no shuffle.
    """
    hits = F.transform(
        F.filter(
            slug_words(url),
            lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$") & ~w.isin(K.SLUG_ALLOWED_TERMS) & w.isin(list(K.SLUG_TYPOS)),
        ),
        lambda w: F.struct(w.alias("segment"), map_lookup(w, K.SLUG_TYPOS).alias("suggestion")),
    )
    return F.transform(
        hits,
        lambda h: F.struct(
            h["segment"].alias("segment"),
            h["suggestion"].alias("suggestion"),
            F.lit("HIGH").alias("confidence"),
            F.levenshtein(h["segment"], h["suggestion"]).cast("long").alias("edit_distance"),
        ),
    )


def is_http_url(url: Column | str) -> Column:
    return c(url).rlike(r"(?i)^https?://[^/?#\s]+")


def related_group(root: Column) -> Column:
    """Number of the alias group a root domain belongs to, else null."""
    table = {name: i for i, names in enumerate(K.RELATED_DOMAIN_GROUPS) for name in names}
    return map_lookup(root, table)


def is_related_domain(a: Column | str, b: Column | str, use_tld_list: bool = False) -> Column:
    root = registrable_domain if use_tld_list else root_domain
    ra, rb = root(a), root(b)
    same_group = F.coalesce(related_group(ra) == related_group(rb), F.lit(False))
    return (c(a) == c(b)) | (ra == rb) | same_group


def clean_domain(col: Column | str) -> Column:
    """Bare domain of whatever was typed: URL, host, or host with path."""
    bare = F.regexp_replace(F.regexp_replace(trim_ws(c(col)), r"(?i)^https?://", ""), r"^www\.", "")
    short = F.regexp_replace(bare, r"/.*$", "")
    return F.coalesce(map_lookup(short, K.DOMAIN_ALIASES), short)


def with_scheme(col: Column | str) -> Column:
    return F.when(c(col).rlike("(?i)^https?://"), c(col)).otherwise(F.concat(F.lit("https://"), c(col)))


def client_ip_hash(*candidates: Column) -> Column:
    """First 16 hex digits of the hash of the first known client address."""
    return F.substring(F.sha2(F.coalesce(*candidates, F.lit("unknown")), 256), 1, 16)
