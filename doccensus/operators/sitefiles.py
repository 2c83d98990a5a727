"""llms.txt entries, page mapping, sitemaps and sitemap discovery.

Site files arrive as (base_url, bucket, body) or (url, body). Relations
between pages and entries are equi joins on derived keys: no join compares
every page of a site with every entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import urls as U
from doccensus.functions.common import by_shuffle, c, extract, extract_all, rank_within, salted_join, settled, top_k, trim_ws

_LINK_LINE = r"^-?\s*\[([^\]]+)\]\(([^)]+)\)(?:\s*:?\s*(.*))?$"


def _kept_lines(files: DataFrame, *keys: str) -> DataFrame:
    lines = files.select(*keys, F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", trim_ws(F.col("line")))
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith(">"))


def llms_entries(files: DataFrame) -> DataFrame:
    """(base_url, bucket, pos, title, url, description), relative links made absolute."""
    kept = _kept_lines(files, "base_url", "bucket")
    line, base = F.col("line"), F.col("base_url")
    target = trim_ws(F.regexp_extract(line, _LINK_LINE, 2))
    linked = line.rlike(_LINK_LINE)
    plain = extract(line, r"^(https?://\S+)")
    absolute = (
        F.when(target.startswith("/"), F.concat(base, target))
        .when(~target.startswith("http"), F.concat(base, F.lit("/"), target))
        .otherwise(target)
    )
    short = F.regexp_replace(F.replace(plain, base, F.lit("")), "^/", "")
    return kept.select(
        "base_url",
        "bucket",
        F.col("pos").cast("long").alias("pos"),
        F.when(linked, trim_ws(F.regexp_extract(line, _LINK_LINE, 1)))
        .otherwise(F.coalesce(F.nullif(short, F.lit("")), F.lit("Home")))
        .alias("title"),
        F.when(linked, absolute).otherwise(plain).alias("url"),
        F.when(linked, F.nullif(trim_ws(F.regexp_extract(line, _LINK_LINE, 3)), F.lit(""))).alias("description"),
    ).filter(F.col("url").isNotNull())


def _parent(path: Column) -> Column:
    parts = U.segments(path)
    n = F.size(parts)
    return F.when(n > 1, F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n - 1), "/"))).otherwise(F.lit("/"))


def _prefixes(path: Column) -> Column:
    """Every leading substring of a path, the empty one included."""
    return F.transform(F.sequence(F.lit(0), F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def _placed_entries(entries: DataFrame) -> DataFrame:
    return entries.select(
        "bucket", "pos", "url", U.host("url").alias("host"), U.strip_slash(U.path("url")).alias("path")
    ).filter(F.col("host") != "")


def _placed_targets(targets: DataFrame) -> DataFrame:
    p = U.strip_slash(U.path("target_url"))
    return targets.select("target_url", U.host("target_url").alias("host"), p.alias("path"), _parent(p).alias("parent"))


def relevant_entries(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Entries that matter to target pages, factored by what they match.

    ``section`` rows hold the entries below a section's path and are shared by
    every target of that section; ``ancestor`` rows hold entries whose path
    begins a target's own path. A target's set is the union of both, so the
    result grows with entries times path depth, never with entries times pages.
    """
    placed, aimed = _placed_entries(entries), _placed_targets(targets)
    sections = aimed.select("host", F.col("parent").alias("scope_path")).distinct()
    leading = placed.withColumn("scope_path", F.explode(_prefixes(F.col("path"))))
    below = salted_join(leading, sections, ["host", "scope_path"], ["bucket", "pos"])
    own_paths = aimed.select("host", F.col("path").alias("scope_path")).distinct()
    above = own_paths.withColumn("path", F.explode(_prefixes(F.col("scope_path")))).join(placed, ["host", "path"])
    shape = lambda df, kind: df.select("host", F.lit(kind).alias("scope"), "scope_path", "bucket", "pos", "url")
    return shape(below, "section").unionByName(shape(above, "ancestor"))


def to_crawl(entries: DataFrame, targets: DataFrame, kb: DataFrame, cap: int | None = None) -> DataFrame:
    """Relevant entries per target that the store lacks, in order; with ``cap`` the first ones only.

    An entry above a target lies above its section too or, being no shorter than it, inside it. So all targets of a section
    have one list, which is ranked once and then joined: of the pairs, as many as targets times entries of their
    section, only the result is made. A target that does not lie under its section (an odd path) has a list of its own.
    """
    missing = entries.join(kb.select("url").distinct(), "url", "left_anti")
    order = [F.col("bucket"), F.col("pos"), F.col("url")]
    scoped = relevant_entries(missing, targets)
    own, root = F.col("path"), (F.col("path") == "") & (F.col("parent") == "/")
    aimed = settled(_placed_targets(targets).distinct().withColumn("list", F.struct("parent", F.when(~(own.startswith(F.col("parent")) | root), own).alias("own"))))
    lists = aimed.groupBy("host", "list").agg(F.min("path").alias("path"))
    scopes = lists.select(
        "host", "list",
        F.explode(F.array(
            F.struct(F.lit("section").alias("scope"), F.col("list.parent").alias("scope_path")),
            F.struct(F.lit("ancestor").alias("scope"), F.col("path").alias("scope_path")),
        )).alias("s"),
    ).select("host", "list", "s.scope", "s.scope_path")
    own_scope = by_shuffle(scopes)
    listed = salted_join(scoped, own_scope, ["host", "scope", "scope_path"], ["bucket", "pos"]).select("host", "list", "bucket", "pos", "url").distinct()
    ranked = rank_within(listed, ["host", "list"], order) if cap is None else top_k(listed, ["host", "list"], order, cap, ["url", "pos"])
    return salted_join(ranked, by_shuffle(aimed.select("target_url", "host", "list")), ["host", "list"], ["bucket", "pos"]).select("target_url", "bucket", "pos", "url", "rank")


def _mapping_lines(files: DataFrame) -> DataFrame:
    kept = _kept_lines(files, "base_url", "bucket")
    linked = extract(F.col("line"), r"\[[^\]]*\]\(([^)]+)\)")
    plain = F.when(F.col("line").startswith("http"), F.regexp_extract("line", r"^(\S+)", 1))
    return kept.select("base_url", "bucket", "pos", F.coalesce(linked, plain).alias("entry")).filter(F.col("entry").isNotNull())


def page_mapping(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each page is listed in its site's llms.txt; the last line wins.

    Entries are reduced to the last line per (site, key) before the join, so a
    page meets at most one row per key kind however often a URL is listed.
    """
    lines = _mapping_lines(files)
    entry = F.col("entry")
    key = U.match_key(entry)
    nested = F.regexp_extract(key, r"^.+?(https?://.*)$", 1)
    entry_path = U.strip_slash(F.when(entry.startswith("http"), U.path(entry)).otherwise(entry))
    kinds = F.array(
        F.struct(F.lit("exact").alias("kind"), F.concat(F.lit("u:"), U.strip_page_ext(key)).alias("key")),
        F.struct(F.lit("exact").alias("kind"), F.concat(F.lit("p:"), U.strip_page_ext(entry_path)).alias("key")),
        F.struct(F.lit("md").alias("kind"), F.concat(F.lit("u:"), key).alias("key")),
        F.struct(F.lit("md").alias("kind"), F.concat(F.lit("p:"), entry_path).alias("key")),
        F.when(nested != "", F.struct(F.lit("md").alias("kind"), F.concat(F.lit("u:"), nested).alias("key"))),
        F.when(key.endswith("/"), F.struct(F.lit("exact").alias("kind"), F.concat(F.lit("s:"), key).alias("key"))),
    )
    listed = (
        lines.select("base_url", "bucket", "pos", "entry", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
        .groupBy("base_url", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
        .agg(F.max(F.struct("bucket", "pos", "entry")).alias("last"))
    )
    target = U.match_key("url")
    target_path = U.strip_slash(U.path("url"))
    has_path = target_path != ""
    wanted = F.array(
        F.struct(F.lit("exact").alias("kind"), F.concat(F.lit("u:"), U.strip_page_ext(target)).alias("key")),
        F.struct(F.lit("exact").alias("kind"), F.concat(F.lit("s:"), target, F.lit("/")).alias("key")),
        F.when(has_path, F.struct(F.lit("exact").alias("kind"), F.concat(F.lit("p:"), U.strip_page_ext(target_path)).alias("key"))),
        F.struct(F.lit("md").alias("kind"), F.concat(F.lit("u:"), target, F.lit(".md")).alias("key")),
        F.when(has_path, F.struct(F.lit("md").alias("kind"), F.concat(F.lit("p:"), target_path, F.lit(".md")).alias("key"))),
    )
    asked = pages.select(
        "page_id", U.base_url("url").alias("base_url"), F.explode(F.filter(wanted, lambda k: k.isNotNull())).alias("k")
    ).select("page_id", "base_url", "k.kind", "k.key")
    found = asked.join(listed, ["base_url", "kind", "key"], "left").groupBy("page_id").agg(
        F.max(F.when(F.col("kind") == "exact", F.col("last"))).alias("exact"),
        F.max(F.when(F.col("kind") == "md", F.col("last"))).alias("md"),
    )
    status = lambda ok: F.when(ok, "mapped").otherwise("not_verified")
    return found.select(
        "page_id",
        status(F.col("exact").isNotNull() | F.col("md").isNotNull()).alias("mapping"),
        F.coalesce("exact.entry", "md.entry").alias("mapped_url"),
        status(F.col("md").isNotNull()).alias("md_mapping"),
        F.col("md.entry").alias("md_url"),
    )


def openapi_specs(files: DataFrame) -> DataFrame:
    section = extract(F.col("body"), r"(?is)##\s*OpenAPI\s*Specs?\s*\n(.*?)(?:\n##|$)")
    lines = files.select("base_url", "bucket", F.posexplode(F.split(section, "\n")).alias("pos", "line"))
    spec = extract(F.col("line"), r"(https?://[^\s)]+)")
    return lines.select("base_url", "bucket", F.col("pos").cast("long").alias("pos"), spec.alias("spec")).filter("spec IS NOT NULL")


def llms_full_sections(files: DataFrame, key: str, content_chars: int | None = None) -> DataFrame:
    """Top-level sections of long single-file dumps."""
    parts = files.filter(F.length("body") > 500).select(
        key, F.posexplode(F.filter(F.split("body", r"(?m)(?=^#\s)"), lambda s: F.length(trim_ws(s)) > 100)).alias("pos", "s")
    )
    head = trim_ws(F.regexp_replace(F.substring_index("s", "\n", 1), r"^#+\s*", ""))
    return parts.select(
        key, F.col("pos").cast("long").alias("pos"), F.coalesce(F.nullif(head, F.lit("")), F.lit("docs")).alias("title"),
        (F.col("s") if content_chars is None else F.substring("s", 1, content_chars)).alias("content"),
    )


def sitemap_locs(body: Column | str, limit: int | None = None) -> Column:
    """Distinct http(s) locations of one file in order."""
    locs = F.transform(extract_all(c(body), r"(?is)<loc>(.*?)</loc>"), lambda x: trim_ws(x))
    urls = F.array_distinct(F.filter(locs, lambda x: U.is_http_url(x)))
    return urls if limit is None else F.slice(urls, 1, limit)


def sitemap_urls(files: DataFrame, limit: int | None = None) -> DataFrame:
    return files.filter(F.col("body").contains("<urlset")).select(
        F.col("url").alias("sitemap_url"), F.posexplode(sitemap_locs("body", limit)).alias("pos", "url")
    ).select("sitemap_url", F.col("pos").cast("long").alias("pos"), "url")


def _index_entries(files: DataFrame) -> DataFrame:
    """file, child: what the index files list. Narrow rows: a body is read once and never part of a shuffle."""
    return files.filter(F.col("body").contains("<sitemapindex")).select(F.col("url").alias("file"), F.explode(sitemap_locs("body", None)).alias("child"))


def reached_files(roots: DataFrame, children: DataFrame, max_depth: int | None) -> DataFrame:
    """root, file, depth: the files below each root with their least depth, down to ``max_depth`` or to the last one.

    A semi-naive fixpoint: each round follows only the files that the round before met for the first time, writes them once to
    the shared folder and leaves out what was met already, which also ends cycles.
    """
    frontier = seen = settled(roots.select(F.col("url").alias("root"), F.col("url").alias("file"), F.lit(0).cast("long").alias("depth")).distinct())
    children, depth = settled(children.distinct()), 0
    while depth != max_depth:
        depth += 1
        met = frontier.join(children, "file").select("root", F.col("child").alias("file")).distinct()
        frontier = settled(met.join(seen.select("root", "file"), ["root", "file"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def expand_sitemap_index(roots: DataFrame, files: DataFrame, max_depth: int | None = 3) -> DataFrame:
    """All page URLs reachable from each root, with the depth they come from; a file is opened once per root.

    ``max_depth`` None follows index files as far as they go.
    """
    listed = files.filter(F.col("body").contains("<urlset")).select(F.col("url").alias("file"), F.explode(sitemap_locs("body", None)).alias("url"))
    pages = reached_files(roots, _index_entries(files), max_depth).join(listed, "file")
    return pages.groupBy("root", "url").agg(F.min("depth").alias("depth"))


def unopened_sitemaps(roots: DataFrame, files: DataFrame, max_depth: int = 3) -> DataFrame:
    """(root, file): sitemap files that lie just deeper than ``max_depth`` below a root, so that nothing is lost silently."""
    below = reached_files(roots, _index_entries(files), max_depth + 1)
    return below.filter(F.col("depth") == max_depth + 1).select("root", "file")


def docs_preview(llms: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Page count and categories per site file, llms.txt before the sitemap."""
    lines = F.split("body", "\n")
    plain = F.filter(lines, lambda x: x.rlike(r"^-\s+[A-Z]") & ~x.contains("["))
    heads = F.filter(lines, lambda x: x.startswith("## ") | x.startswith("# "))
    names = F.concat(
        F.transform(plain, lambda x: trim_ws(F.regexp_replace(x, r"^-\s+", ""))),
        F.transform(heads, lambda x: trim_ws(F.regexp_replace(x, r"^#+\s+", ""))),
    )
    links = F.size(F.filter(lines, lambda x: x.rlike(r"\[.+\]\(.+\)")))
    first = llms.filter(F.length("body") > 50).select(
        "site", F.lit("llms.txt").alias("source"),
        F.when(links > 0, links).otherwise(F.floor(F.length("body") / 80)).cast("long").alias("page_count"),
        F.slice(F.filter(names, lambda x: x != ""), 1, 10).alias("categories"),
    )
    locs = F.transform(extract_all(F.col("body"), r"(?i)<loc>(.*?)</loc>"), lambda x: trim_ws(x))
    docs = F.filter(locs, lambda x: x.rlike("(?i)" + K.DOCS_PREVIEW_PATTERN))
    second = (
        sitemaps.filter(F.length("body") > 50)
        .join(first.select("site"), "site", "left_anti")
        .select(
            "site", F.lit("sitemap.xml").alias("source"),
            F.when(F.size(docs) > 0, F.size(docs)).otherwise(F.size(locs)).cast("long").alias("page_count"),
            F.array().cast("array<string>").alias("categories"),
        )
    )
    return first.unionByName(second)


DIRECT_SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml"]


def discover_sitemap(sites: DataFrame, robots: DataFrame, log: DataFrame) -> DataFrame:
    """Sitemap of every site: robots directive, else the first direct path that answers.

    ``error`` keeps the last failure met before the search ended.
    """
    directive = extract(F.col("body"), r"(?i)Sitemap:\s*(https?://\S+)")
    named = sites.join(robots.select("base_url", directive.alias("directive")), "base_url", "left")
    zipped = F.col("directive").endswith(".gz")
    order = {p: i for i, p in enumerate(DIRECT_SITEMAPS)}
    tried = sites.select(
        "base_url",
        F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.concat("base_url", F.lit(p)).alias("url")) for p, i in order.items()])).alias("t"),
    ).select("base_url", "t.ord", "t.url")
    gz = named.filter(zipped).select("base_url", F.lit(-1).alias("ord"), F.col("directive").alias("url"))
    seen = log.groupBy("url").agg(F.min("status_code").alias("status"))
    asked = tried.unionByName(gz).join(seen, "url", "left").withColumn("status", F.coalesce("status", F.lit(0)))
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    note = (
        F.when((F.col("ord") == -1) & ok, F.concat(F.lit("Unreadable compressed sitemap at "), F.col("url")))
        .when(F.col("status") == 0, F.concat(F.lit("Connection failed for "), F.col("url")))
        .when(F.col("status").isin(401, 403) | (F.col("ord") == -1), F.concat(F.lit("Access Denied ("), F.col("status"), F.lit(") at "), F.col("url")))
    )
    direct = asked.groupBy("base_url").agg(
        F.min_by("url", F.when(ok & (F.col("ord") >= 0), F.col("ord"))).alias("direct_url"),
        F.min(F.when(ok & (F.col("ord") >= 0), F.col("ord"))).alias("hit"),
        F.array_agg(F.when(note.isNotNull(), F.struct("ord", note.alias("note")))).alias("notes"),
    )
    before = F.filter(F.array_sort("notes"), lambda n: n["ord"] < F.coalesce(F.col("hit"), F.lit(99)))
    last = F.get(F.reverse(before), F.lit(0))["note"]
    by_robots = F.col("directive").isNotNull() & ~zipped
    return named.join(direct, "base_url").select(
        "base_url",
        F.when(by_robots, F.col("directive")).otherwise(F.col("direct_url")).alias("sitemap_url"),
        F.when(by_robots, "robots.txt").when(F.col("direct_url").isNotNull(), "direct").otherwise("not-found").alias("method"),
        F.when(~by_robots | F.col("directive").isNull(), last).alias("error"),
        F.when(zipped, F.col("directive")).alias("skipped_gzip"),
    )
