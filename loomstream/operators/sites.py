"""What a site's manifest says about its URLs: which may be crawled, which are articles, what they are boosted by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstream.functions.urls import allowed_url, article_url, blacklisted_path, host, path, query_string
from loomstream.operators.joins import domain_suffix_join

#: Columns of a manifest that the rules read; a missing column is an empty rule.
_RULES = {
    "subdomain_blacklist": "array<string>", "path_blacklist": "array<struct<needle:string,location:string>>",
    "article_url_pattern": "array<struct<subdomain:string,path_regex:string,query_regex:string>>",
}


def with_site(rows: DataFrame, url: str, sites: DataFrame, domains: tuple[str, ...] = ("root_domain", "aka_root_domain")) -> DataFrame:
    """Rows with the manifest of their URL's site in a struct column `site`, null where no site claims the host."""
    known = sites.select(*[F.col(d).alias(f"__{d}") for d in domains], F.struct(*[F.col(c) for c in sites.columns]).alias("site"))
    joined = domain_suffix_join(rows, url, known, [f"__{d}" for d in domains])
    return joined.drop(*[f"__{d}" for d in domains])


def _rule(rows: DataFrame, name: str) -> Column:
    has = name in [f.name for f in rows.schema["site"].dataType.fields]
    return F.coalesce(F.col(f"site.{name}") if has else F.lit(None).cast(_RULES[name]), F.array().cast(_RULES[name]))


def allowed_by_site(rows: DataFrame, url: str) -> Column:
    """Whether a URL may be crawled: of an allowed form, on a known site (`site` as of with_site()), on no blacklisted subdomain or path."""
    u = F.col(url)
    banned = F.array_contains(_rule(rows, "subdomain_blacklist"), host(u)) | blacklisted_path(path(u), _rule(rows, "path_blacklist"))
    return allowed_url(u) & F.col("site").isNotNull() & ~F.coalesce(banned, F.lit(False))


def article_by_site(rows: DataFrame, url: str) -> Column:
    """Whether an allowed URL has one of its site's article patterns: the subdomain is a suffix of its host, or the
    host is the site's own, and the path and query hold what the pattern asks for."""
    u = F.col(url)
    return allowed_by_site(rows, url) & article_url(host(u), path(u), query_string(u), F.col("site.root_domain"), F.col("site.aka_root_domain"), _rule(rows, "article_url_pattern"))


def notification_sites(rows: DataFrame, url: str, text: str, sites: DataFrame, name: str = "short_name") -> DataFrame:
    """Rows with `site_name`: the site of the URL, or where there is none the one that the text before ': ' names."""
    by_url = with_site(rows, url, sites)
    named = sites.select(F.col(name).alias("__name")).distinct()
    lead = F.when(F.col(url).isNull() & F.col(text).contains(": "), F.substring_index(text, ": ", 1))
    out = by_url.withColumn("__lead", lead).join(F.broadcast(named), F.col("__lead") == F.col("__name"), "left")  # one row a site
    return out.withColumn("site_name", F.coalesce(F.col(f"site.{name}"), F.col("__name"))).drop("site", "__lead", "__name")


def feature_boosts(rows: DataFrame, url: str, feature: str, patterns: DataFrame, sites: DataFrame, name: str = "short_name") -> DataFrame:
    """Rows with `boost`: of the site's patterns that fit, the last one's; 0 without any.

    patterns: site name, ord, feature_id (null: any), subdomain (the host or a suffix of it), path_regex, query_regex
    (null: anything), boost. Patterns are met by site and checked there; a site has few.
    """
    found = with_site(rows, url, sites).withColumn("__site", F.col(f"site.{name}")).drop("site")
    own = patterns.groupBy(F.col(name).alias("__site")).agg(F.array_sort(F.collect_list(F.struct("ord", "feature_id", "subdomain", "path_regex", "query_regex", "boost"))).alias("__patterns"))
    h, p, q = host(F.col(url)), path(F.col(url)), query_string(F.col(url))

    def fits(x: Column) -> Column:
        named = x["feature_id"].isNull() | (x["feature_id"] == F.col(feature))
        placed = x["subdomain"].isNull() | (h == x["subdomain"]) | h.endswith(F.concat(F.lit("."), x["subdomain"]))
        return named & placed & (x["path_regex"].isNull() | F.regexp_like(p, x["path_regex"])) & (x["query_regex"].isNull() | F.regexp_like(q, x["query_regex"]))

    last = F.try_element_at(F.filter("__patterns", fits), F.lit(-1))["boost"]
    return found.join(F.broadcast(own), "__site", "left").withColumn("boost", F.coalesce(last, F.lit(0))).drop("__site", "__patterns")  # one row a site
