"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    """Host without a leading www.; '' for what is no URL."""
    return F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def suffixes(h: Column) -> Column:
    """The host and every shorter suffix of whole labels that still has a dot, longest first."""
    parts = F.split(h, r"\.")
    n = F.size(parts)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))).otherwise(F.array(h))


def query_string(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))


def of_domain(h: Column, domain_: str) -> Column:
    return (h == domain_) | h.endswith("." + domain_)


# Hosts that are written in one way, and what is done to the paths of others.
CANONICAL_HOSTS = {"www.abcnews.go.com": "abcnews.go.com", "www.archaeology.org": "archaeology.org", "detail-online.com": "www.detail-online.com"}
PATH_REWRITES = (
    ("businessinsider.com", r"^(/[^/]+)/.*$", "$1"),
    ("cnn.com", r"/index\.html$", "/"),
    ("slate.com", r"(?<!\.single)\.html$", ".single.html"),
    ("theverge.com", r"/in/[0-9]{6,9}$", ""),
    ("washingtonpost.com", r"^/pb/", "/"),
)


def rewritten_host(h: Column) -> Column:
    out = h
    for wrong, right in CANONICAL_HOSTS.items():
        out = F.when(h == wrong, right).otherwise(out)
    return out


def rewritten_path(h: Column, p: Column) -> Column:
    """The path as the host's own rule has it; other hosts' paths stay."""
    out = p
    for domain_, pattern, into in PATH_REWRITES:
        out = F.when(of_domain(h, domain_), F.regexp_replace(p, pattern, into)).otherwise(out)
    return out


def clean_url(url: Column, https: Column, kept_parameters: Column) -> Column:
    """Scheme by the site, host lower-cased, default ports, a bare slash, the fragment and unlisted parameters dropped; some hosts are rewritten."""
    query = query_string(url)
    params = F.filter(F.split(query, "&"), lambda p: F.coalesce(F.array_contains(kept_parameters, F.substring_index(p, "=", 1)), F.lit(False)))
    port = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#:]+:(\d+)", 1)
    odd = (port != "") & ~((port == "80") & url.rlike("(?i)^http:")) & ~((port == "443") & url.rlike("(?i)^https:"))
    p = rewritten_path(host(url), path(url))
    out = F.concat(
        F.when(F.coalesce(https, F.lit(False)), "https://").otherwise("http://"), rewritten_host(host(url)), F.when(odd, F.concat(F.lit(":"), port)).otherwise(""),
        F.when(F.length(p) > 1, p).otherwise(""), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""),
    )
    return F.coalesce(out, url)


# Endings of paths that are no pages.
BINARY_ENDINGS = ("/atom.xml", "/rss.xml", ".gif", ".jpeg", ".jpg", ".mp3", ".mp4", ".mpeg", ".pdf", ".png")


def allowed_url(url: Column) -> Column:
    """Not too long, no video host or path, no scripts, no binary or feed files."""
    h, p = host(url), path(url)
    bad = (F.length(url) > 767) | h.contains("video.") | h.contains("videos.") | p.startswith("/cgi-bin/") | p.contains("/video/") | p.contains("/videos/")
    for ending in BINARY_ENDINGS:
        bad = bad | p.endswith(ending)
    return F.coalesce(~bad, F.lit(False))


def article_url(h: Column, p: Column, query: Column, root: Column, aka: Column, patterns: Column) -> Column:
    """Whether any pattern struct<subdomain, path_regex, query_regex> fits: its subdomain or one of the site's domains is
    the host or a suffix of it, and its regular expressions (one at least) are found in path and query."""
    ends = suffixes(h)
    own = F.array_contains(ends, root) | F.arrays_overlap(ends, F.coalesce(aka, F.array().cast("array<string>")))

    def fits(x: Column) -> Column:
        placed = F.coalesce(F.array_contains(ends, x["subdomain"]), F.lit(False)) | F.coalesce(own, F.lit(False))
        asks = x["path_regex"].isNotNull() | x["query_regex"].isNotNull()
        found = F.coalesce(F.regexp_like(p, x["path_regex"]), F.lit(True)) & F.coalesce(F.regexp_like(query, x["query_regex"]), F.lit(True))
        return placed & asks & found

    return F.coalesce(F.exists(patterns, fits), F.lit(False))


# Pictures that are a site's sign and not an article's, as they are and by pattern.
SITE_IMAGES = (
    "http://media.cleveland.com/design/alpha/img/logo_cleve.gif", "http://www.sfgate.com/img/pages/article/opengraph_default.png",
    "http://www.telegraph.co.uk/template/ver1-0/i/telegraphFacebook.jpg", "http://thehill.com/sites/default/files/thehill_logo_200.jpg",
    "http://www.nationaljournal.com/nationaljournal-fb.png", "http://s.wsj.net/blogs/img/WSJ_Logo_BlackBackground_1200x630social",
    "http://www.buffalonews.com/images/BNSocialShareLG.jpg", "http://www.abc.net.au/news/linkableblob/6072216/data/abc-news.jpg?2",
    "http://images.forbes.com/media/assets/forbes_1200x1200.jpg", "http://images.rigzone.com/images/rz-facebook.jpg", "http://www.inc.com/images/incthumb250.png",
    "http://fm.cnbc.com/applications/cnbc.com/staticcontent/img/cnbc_logo.gif", "http://static.cdn-seekingalpha.com/uploads/2013/8/19/social_sa_logo.png",
    "http://idge.staticworld.net/ifw/IFW_logo_social_300x300.png", "http://www.scientificamerican.com/sciam/includes/themes/sciam/images/logo400x400.jpg",
    "http://mw1.wsj.net/MW5/content/images/logos/mw-social-logo.jpg", "http://www1.ibdcd.com/images/IBDicon_309171.png", "https://s0.wp.com/i/blank.jpg",
    "http://local.mercurynews.com/common/dfm/assets/logos/1200x627/mercurynews.png", "http://www.accountingtoday.com/media/newspics/AT_180x180.jpg",
    "http://assets.fiercemarkets.net/public/opengraphimages/updated/opengraph_fierceenergy.jpg",
    "https://s0.wp.com/wp-content/themes/vip/recode/img/_default/default-thumbnail-post.png", "http://media.scmagazine.com/images/2013/02/19/sc_logo_21413_345884.png",
    "http://idge.staticworld.net/nww/nww_logo_300x300.png", "http://oystatic.ignimgs.com/src/core/img/widgets/global/page/ign-logo-100x100.jpg",
    "https://s0.wp.com/wp-content/themes/vip/time2014/img/time-logo-og.png", "http://www.usertesting.com/blog/wp-content/uploads/2014/05/Poll-FeaturedImage.png",
)
SITE_IMAGE_PATTERNS = (
    r"^http.*nyt[^/]*\.com/.*_black\.png$", r"^http://cdn\.fxstreet\.com/", r"/bhorowitz/sites/1/meta_images/original/logo.png(\?.*)?$", r"//cdn\.gotraffic\.net/.*FB-Sharing",
    r"//www\.abc\.net\.au/.*/data/abc-news\.jpg.*", r"//\w+\.cloudfront\.net/_/fp/img/default-preview-image\.",
)


def article_image(url: Column) -> Column:
    """Whether an image's URL may be an article's picture: not empty and no known sign of a site; null is none."""
    bad = (url == "") | url.isin(*SITE_IMAGES)
    for p in SITE_IMAGE_PATTERNS:
        bad = bad | url.rlike(p)
    return F.coalesce(~bad, F.lit(False))


MATCH_KINDS = {
    "EQUALS": lambda p, n: p == n, "STARTS_WITH": lambda p, n: p.startswith(n), "ENDS_WITH": lambda p, n: p.endswith(n),
    "CONTAINS": lambda p, n: p.contains(n), "REGEX_FIND": lambda p, n: F.regexp_like(p, n), "REGEX_MATCH": lambda p, n: F.regexp_like(p, F.concat(F.lit("^(?:"), n, F.lit(")$"))),
}


def blacklisted_path(p: Column, rules: Column) -> Column:
    """Whether any rule struct<needle, location> of the array matches the path."""

    def one(r: Column) -> Column:
        out = F.lit(False)
        for kind, test in MATCH_KINDS.items():
            out = F.when(r["location"] == kind, test(p, r["needle"])).otherwise(out)
        return F.coalesce(out, F.lit(False))

    return F.coalesce(F.exists(rules, one), F.lit(False))


def youtube_id(url: Column) -> Column:
    v = F.regexp_extract(url, r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|v/)|youtu\.be/)([\w-]{6,})", 1)
    return F.when(v != "", v)


def crawl_priority(url: Column, is_article: Column, dated: Column, now_ms: int) -> Column:
    """Articles by age of the date in their URL, 2000 less an hour each, at least 100; undated 100; others 10."""
    hours = F.floor((F.lit(now_ms) - dated) / 3_600_000)
    return F.when(~is_article, F.lit(10)).otherwise(F.coalesce(F.greatest(F.lit(100), F.lit(2000) - hours), F.lit(100))).cast("bigint")
