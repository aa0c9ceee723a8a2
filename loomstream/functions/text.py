"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that carry no subject (a common public selection).
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for "
    "from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with would you your yours yourself yourselves".split()
)
# Keywords that are never valid, endings and beginnings that make one invalid, and spellings that are put right.
KEYWORD_BLACKLIST = (
    "and", "apartments", "blog", "business school", "business schools", "bw business schools page", "capitals", "ceo", "cinema", "committee", "commodities", "company", "corrections", "crime",
    "department", "dialogue", "economy", "economic", "education", "films", "financial calculator", "financial calculators", "first", "graduate reviews", "hedge funds", "hello", "is",
    "internet", "inequality", "insurance", "jobs", "kids", "kidz", "leadership", "lifestyle", "litigation", "markets", "media", "mobile", "movies", "my", "news", "opinion", "party", "pm",
    "profile", "restaurants", "retail", "retailing", "shopping", "show", "society", "son", "sports", "stocks", "stock market", "story", "story-video", "teams", "tech", "technology", "that",
    "the", "their", "there", "they", "times", "top business schools worldwide", "trial", "trials", "try", "university", "up", "video", "web", "why", "with", "yet",
)
KEYWORD_STARTS = ("#", "@", "bloomberg ", "mba ")
KEYWORD_ENDS = ("@bloomberg", " jobs", " news", " profile", " restaurants", " trends")
SPELLINGS = (("Aol", "AOL"), ("Ios", "iOS"), ("Ipad", "iPad"), ("Iphone", "iPhone"), ("Iwatch", "iWatch"), ("Ipod", "iPod"))
PERSON_TITLES = ("dr", "mr", "ms", "mrs", "miss", "prof", "rev")
TITLE_NOISE = (
    r"</?(i|b|em|strong)>",
    r"^[a-zA-Z\.]{3,15}\s(\||--|-|–|—)\s",
    r"\s\([A-Za-z]{2,15}(\s[A-Za-z]{2,15})?\)$",
    r"\s*(\||--|-|–|—)\s+([A-Z][A-Za-z]+\.com)$",
    r"\s*(\||--|-|–|—)\s+[A-Z][A-Za-z\s']{2,25}$",
    r"\s+(\||\|\|)\s+[A-Za-z\s']{2,25}$",
    r"\s+(\||\|\|)\s+http://[A-Za-z\.]+$",
    r"\s+\[[A-Z]+\]$",
    r"^Daily Report: ",
    r" - artnet News$",
)
STEM_LENGTH, MAX_KEYWORD, MAX_TITLE = 4, 50, 256


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once, however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def scrub_keyword(c: Column) -> Column:
    """Without signs around it; a possessive ending goes and stops the scrubbing at the end."""

    def unsigned(x: Column) -> Column:
        end = F.regexp_replace(x, r"[’'”\",;\-!?*)/$—″\]\s]+$", "")
        one_dot = let(end, lambda e: F.when(e.endswith(".") & (F.regexp_count(e, F.lit(r"\.")) == 1), F.rtrim(F.substring(e, 1, F.length(e) - 1))).otherwise(e))
        return F.when(x.rlike("[’']s$"), F.trim(F.regexp_replace(x, "[’']s$", ""))).otherwise(F.trim(F.regexp_replace(one_dot, "-based$", "")))

    return let(F.regexp_replace(F.trim(c), r"^[‘'“\"()\-.?:&,!*+/—%…\[\s]+", ""), unsigned)


def clean_keyword(c: Column) -> Column:
    """Scrubbed, cut at the first apostrophe, abbreviations without dots, capitalised, some spellings put right."""

    def spelled(x: Column) -> Column:
        fixed = F.when(x.rlike(r"^\p{Lu}"), x).otherwise(F.initcap(x))
        for wrong, right in SPELLINGS:
            fixed = F.regexp_replace(fixed, f"(?i){wrong}", right)
        return F.when(x.rlike(r"^([A-Z]+\.){2,10}$"), F.translate(x, ".", "")).otherwise(fixed)

    return let(F.trim(F.regexp_replace(scrub_keyword(c), "[’'].*$", "")), spelled)


def valid_keyword(c: Column) -> Column:
    """Whether a keyword says anything: its length, first letter, form and a list of words decide. Null is not valid."""
    c = F.trim(c)
    low = F.lower(c)
    bad = (F.length(low) < 2) | (F.length(low) > MAX_KEYWORD) | ~c.rlike(r"^\p{L}") | low.rlike(r"^best( [a-z]+)? of ") | low.contains("…") | low.rlike("&.*;|;.*&")
    for p in KEYWORD_STARTS:
        bad = bad | low.startswith(p)
    for p in KEYWORD_ENDS:
        bad = bad | low.endswith(p)
    return F.coalesce(~(bad | low.isin(*KEYWORD_BLACKLIST)), F.lit(False))


def without_person_title(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^(" + "|".join(PERSON_TITLES) + r")\.?\s+", "")


def unescape(c: Column) -> Column:
    """HTML character references replaced, the names of HTML 4 among them; no-break spaces become spaces, zero-width ones go."""

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&(#?\w{2,8});", 1)
        code = F.coalesce(F.when(name.rlike(r"^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).try_cast("bigint"), _entity_codes()[name])
        good = code.isNotNull() & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(good, F.concat(sign, F.regexp_replace(piece, r"^&#?\w{2,8};", ""))).otherwise(piece)

    plain = F.when(c.contains("&"), F.array_join(F.transform(F.split(c, r"(?=&#?\w{2,8};)"), one), "")).otherwise(c)
    return F.regexp_replace(F.translate(plain, "\u00a0", " "), "[\u200b-\u200f\ufeff]", "")


def _entity_codes() -> Column:
    """Names of character references and their code points, as the standard library lists them."""
    pairs = [F.lit(x) for name, code in [*sorted(name2codepoint.items()), ("apos", 0x2019)] for x in (name, code)]
    return F.create_map(*pairs)


def _until_gone(c: Column, pattern: str) -> Column:
    """The pattern removed until it is found no more: anchored ones are repeated within one expression."""
    if pattern.startswith("^"):
        return F.regexp_replace(c, f"^(?:{pattern[1:]})+", "")
    if pattern.endswith("$"):
        return F.regexp_replace(c, f"(?:{pattern[:-1]})+$", "")
    return F.aggregate(F.sequence(F.lit(0), F.regexp_count(c, F.lit("<"))), c, lambda a, _: F.regexp_replace(a, pattern, ""))


def clean_title(c: Column) -> Column:
    """Unescaped, runs of space collapsed, each kind of noise removed until it is gone, cut to MAX_TITLE, first letters raised."""
    c = F.regexp_replace(unescape(c), r"[\s\x{A0}]{2,}", " ")
    for pattern in TITLE_NOISE:
        c = _until_gone(c, pattern)
    return let(c, _fitted_title)


def _fitted_title(c: Column) -> Column:
    c = F.when(F.length(c) > MAX_TITLE, F.concat(F.substring(c, 1, MAX_TITLE - 1), F.lit("…"))).otherwise(c)
    raised = F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2_000_000_000))), " ")
    return F.trim(F.when(c.rlike(r"^\p{Ll}"), raised).otherwise(c))


def deduping_stems(title: Column) -> Column:
    """Distinct first letters (STEM_LENGTH) of the cleaned title words that are no stop words; null gives an empty array."""
    words = F.transform(F.split(F.coalesce(title, F.lit("")), r"[\s\x{A0}]+"), lambda w: F.lower(clean_keyword(w)))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, STEM_LENGTH)))


def word_count(paragraphs: Column) -> Column:
    """Runs of space plus one, summed over the paragraphs; null paragraphs count as empty."""
    return F.aggregate(F.coalesce(paragraphs, F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.regexp_count(p, F.lit(r"\s+")), F.lit(0)) + 1)


def best_description(description: Column, paragraphs: Column, least: int = 50, most: int = 2048) -> Column:
    """The description, else the first paragraph of some length; cut to `most` characters."""
    first = F.get(F.filter(paragraphs, lambda p: F.length(p) >= least), F.lit(0))
    return F.substring(F.coalesce(F.when(F.trim(description) != "", description), first), 1, most)


def shortened(c: Column, limit: int, keep: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit(mark))).otherwise(c)


def java_hash(c: Column) -> Column:
    """31-based string hash over characters as a signed 32-bit value (ASCII text)."""
    h = F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda a, x: F.when(x == "", a).otherwise(F.pmod(a * 31 + F.ascii(x), F.lit(1 << 32))))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def character_bucket(c: Column, buckets: int) -> Column:
    """Sum of the character codes modulo `buckets`."""
    return F.pmod(F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda a, x: a + F.when(x == "", F.lit(0)).otherwise(F.ascii(x))), F.lit(buckets))


def version_key(c: Column, parts: Column | int) -> Column:
    """Dotted numbers as an array of at least `parts` numbers that compares like versions: 1.10 > 1.9, 1 = 1.0."""
    nums = F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.concat(nums, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(parts) - F.size(nums), F.lit(0))))


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, however many parts either has; null when either is."""
    parts = F.greatest(F.size(F.split(a, r"\.")), F.size(F.split(b, r"\.")))
    x, y = version_key(a, parts), version_key(b, parts)
    return F.when(a.isNull() | b.isNull(), None).when(x < y, -1).when(x > y, 1).otherwise(0)


def object_id(*keys: Column) -> Column:
    """24 hex digits that depend on the keys alone."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *keys), 256), 1, 24)


def starts_any_word(c: Column, prefix: str) -> Column:
    return F.exists(F.split(F.lower(c), r"[^\w]+"), lambda w: w.startswith(prefix.lower()))


def words_starting(c: Column, prefix: str) -> Column:
    """The words of a title that begin with the prefix, case aside: one row each when exploded, as a type-ahead lists them."""
    return F.filter(F.split(c, r"[^\w]"), lambda w: F.lower(w).startswith(prefix.lower()))


def blob_field(c: Column, name: str) -> Column:
    """The value of `name(value)` in a string of such fields joined by '!'."""
    v = F.regexp_extract(c, rf"(?:^|!){name}\(([^)]*)\)", 1)
    return F.when(v != "", v)


def rule_score(title: Column, body: Column, title_rules: dict[str, float], body_rules: dict[str, float], blacklist: tuple[str, ...] = ()) -> Column:
    """Best score of the regular expressions found in the lower-cased texts; 0 when any blacklisted one is found."""
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    banned = F.lit(False)
    for p in blacklist:
        banned = banned | t.rlike(p) | b.rlike(p)
    hits = [F.when(x.rlike(p), F.lit(float(s))).otherwise(0.0) for x, rules in ((t, title_rules), (b, body_rules)) for p, s in rules.items()]
    best = F.greatest(F.lit(0.0), F.lit(0.0), *hits)
    return F.when(banned, 0.0).otherwise(best)
