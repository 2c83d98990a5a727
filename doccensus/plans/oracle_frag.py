"""Checking-SQL fragments, written independently of the Spark expressions."""


def q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def lst(values) -> str:
    return "[" + q(values) + "]"


def alt(words) -> str:
    """Literal alternation as a regular expression body inside a SQL string."""
    import re

    return "|".join(re.escape(w).replace("'", "''") for w in words)


def scheme(u):
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"


def netloc(u):
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1))"


def host(u):
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"


def path(u):
    return f"coalesce(nullif(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), ''), '/')"


def query(u):
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def base(u):
    return f"({scheme(u)} || '://' || {netloc(u)})"


def segs(p):
    return f"list_filter(string_split({p}, '/'), lambda s: s <> '')"


def nowww(h):
    return rf"regexp_replace({h}, '^www\.', '')"


def noslash(x):
    return f"regexp_replace({x}, '/$', '')"


def root2(h):
    return f"array_to_string(string_split({h}, '.')[greatest(len(string_split({h}, '.')) - 1, 1):], '.')"


def match_key(u):
    return f"({scheme(u)} || '://' || {host(u)} || {noslash(path(u))})"


def trim(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squash(x):
    return trim(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def rnd(x):
    return f"CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS BIGINT)"


def nmatch(x, pattern, flags=""):
    """Number of matches; case-insensitivity goes into the pattern."""
    p = f"(?{flags})" + pattern if flags else pattern
    return f"CAST(len(regexp_extract_all({x}, '{p}')) AS BIGINT)"
