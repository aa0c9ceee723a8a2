"""Keywords of articles: names in sentences, blocks of capitalised words, known entities, one form per keyword."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstream.functions.text import PERSON_TITLES, clean_keyword, scrub_keyword, valid_keyword
from loomstream.session import ship

#: Strength of a keyword found in the title and in the first paragraph (fixed values).
TITLE_STRENGTH, FIRST_PARAGRAPH_STRENGTH = 150, 100
#: First strength and the most of it, by kind of name (fixed values).
NAME_STRENGTH = {"p": (5, 20), "o": (5, 20), "l": (3, 15)}


def sentences(c: Column) -> Column:
    """Sentences of a text: they end with . ! or ? before a gap and a capital letter or a quotation mark; no statistics."""
    marked = F.regexp_replace(c, r"([.!?][”\"’)]?)\s+([\p{Lu}“\"¿¡])", "$1\u0001$2")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def first_two_thirds(paragraphs: Column) -> Column:
    return F.slice(paragraphs, 1, F.ceil(F.size(paragraphs) * 2 / 3).cast("int"))


def capitalised(c: Column) -> Column:
    """Runs of capitalised words in a text, as written."""
    return F.regexp_extract_all(c, F.lit(r"(\p{Lu}[\p{L}\p{M}’'-]*(?: (?:& )?\p{Lu}[\p{L}\p{M}’'-]*)*)"), F.lit(1))


def found_names(docs: DataFrame, key: str, paragraphs: str, gazetteer: DataFrame) -> DataFrame:
    """(key, paragraph_number, keyword, type, strength): names of the gazetteer in the first two thirds of the paragraphs.

    A stand-in for statistical name finders: runs of capitalised words, cleaned, that the gazetteer (keyword, type) has,
    case aside. Strength starts at the kind's value less the paragraph's number (from 1), at least 1, and grows by that
    value with every repeat up to the kind's most. Null paragraphs have no names; types that NAME_STRENGTH lacks have none.
    """
    p = docs.select(key, F.posexplode(first_two_thirds(F.col(paragraphs))).alias("pos", "p"))
    run = p.select(key, (F.col("pos") + 1).alias("paragraph_number"), F.explode(sentences(F.col("p"))).alias("s")).select(key, "paragraph_number", F.explode(capitalised(F.col("s"))).alias("k"))
    run = run.select(key, "paragraph_number", clean_keyword(F.col("k")).alias("keyword")).groupBy(key, "paragraph_number", "keyword").agg(F.count("*").alias("n"))
    known = gazetteer.select(F.lower("keyword").alias("__low"), "type").groupBy("__low").agg(F.min("type").alias("type")).filter(F.col("type").isin(*NAME_STRENGTH))
    hit = run.filter(valid_keyword(F.col("keyword"))).withColumn("__low", F.lower("keyword")).join(known, "__low")
    start = F.lit(0)
    most = F.lit(0)
    for kind, (s, m) in NAME_STRENGTH.items():
        start, most = F.when(F.col("type") == kind, s).otherwise(start), F.when(F.col("type") == kind, m).otherwise(most)
    strength = F.when(F.col("n") == 1, F.greatest(F.lit(1), start - F.col("paragraph_number"))).otherwise(F.least(most, F.greatest(F.lit(1), start - F.col("paragraph_number")) + start * (F.col("n") - 1)))
    return hit.select(key, "paragraph_number", "keyword", "type", strength.cast("int").alias("strength"))


def known_entities(rows: DataFrame, keyword: str, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows with `entity_id`, `entity_keyword` and `entity_type` of the keyword, case aside; null where none is known.

    links: keyword, entity_id; entities: id, keyword, short_name, type. A link to an entity that is gone counts as none.
    Of several links of one keyword the smallest entity id is taken.
    """
    one = links.filter("entity_id is not null").groupBy(F.lower("keyword").alias("__low")).agg(F.min("entity_id").alias("entity_id"))
    named = entities.select(F.col("id").alias("entity_id"), F.coalesce("short_name", "keyword").alias("entity_keyword"), F.col("type").alias("entity_type"))
    return rows.withColumn("__low", F.lower(F.col(keyword))).join(one.join(named, "entity_id"), "__low", "left").drop("__low")


def blocks(c: Column) -> Column:
    """Runs of words that begin with a capital, each word scrubbed, joined by single spaces."""
    words = F.filter(F.split(c, r"[\s\x{A0}]"), lambda w: w != "")
    marked = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}"), scrub_keyword(w)).otherwise(F.lit("\u0001")))
    runs = F.split(F.array_join(marked, " "), " ?\u0001 ?")
    return F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != "")


def block_entities(texts: DataFrame, key: str, text: str, links: DataFrame, entities: DataFrame, strength: int = TITLE_STRENGTH) -> DataFrame:
    """(key, entity_id, keyword, type, strength): entities named in a text's blocks, each once.

    A block that names an entity stands for it; else the block without its last word and without its first word are
    looked at in the same way. All parts of a block are met with the links by equality, then each block's few parts are
    walked from the whole down, longest first.
    """
    ship(texts.sparkSession)
    b = texts.select(key, F.posexplode(blocks(F.col(text))).alias("block", "b")).withColumn("w", F.split("b", " "))
    n = F.size("w")
    spans = F.expr("explode(flatten(transform(sequence(0, size(w) - 1), i -> transform(sequence(i + 1, size(w)), j -> struct(i AS i, j AS j)))))")
    parts = b.withColumn("n", n).withColumn("s", spans).select(key, "block", "n", "s.i", "s.j", F.expr("array_join(slice(w, s.i + 1, s.j - s.i), ' ')").alias("part"))
    met = known_entities(parts, "part", links, entities).filter("entity_id is not null")
    each = met.groupBy(key, "block", "n").agg(F.collect_list(F.struct("i", "j", "entity_id", "entity_keyword", "entity_type")).alias("hits"))
    kind = dict(texts.dtypes)[key]

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k, n_words, hits in zip(pdf[key], pdf["n"], pdf["hits"], strict=True):
                by = {(h["i"], h["j"]): h for h in hits}
                level, seen = {(0, int(n_words))}, []
                while level:
                    seen += [by[s] for s in sorted(level) if s in by]
                    level = {t for s in level if s not in by and s[1] - s[0] > 1 for t in ((s[0], s[1] - 1), (s[0] + 1, s[1]))}
                out += [(k, h["entity_id"], h["entity_keyword"], h["entity_type"]) for h in seen]
            yield pd.DataFrame(out, columns=[key, "entity_id", "keyword", "type"])

    found = each.mapInPandas(walk, f"`{key}` {kind}, entity_id string, keyword string, type string").distinct()
    return found.withColumn("strength", F.lit(strength))


def better_spelling(a: str, b: str) -> str:
    """The longer of two spellings; of equally long ones the first unless it is all upper or all lower case."""
    a, b = a.strip(), b.strip()
    if len(a) != len(b):
        return a if len(a) > len(b) else b
    return a if a not in (a.upper(), a.lower()) else b


def merged(a: dict, b: dict) -> dict:
    """One keyword of two: of the earlier paragraph (the stronger of equal ones), the better spelling, 5 more than the stronger, the more special type."""
    if b["paragraph_number"] is None:
        first = a["paragraph_number"] is not None
    else:
        pa, pb = a["paragraph_number"] or 0, b["paragraph_number"]
        first = pa < pb or (pa == pb and a["strength"] > b["strength"])
    kind = a if a["depth"] > b["depth"] else b
    return (a if first else b) | {"keyword": better_spelling(a["keyword"], b["keyword"]), "strength": max(a["strength"], b["strength"]) + 5, "type": kind["type"], "depth": kind["depth"]}


def _without_title(k: str) -> str:
    head, _, rest = k.partition(" ")
    return rest.strip() if rest and head.rstrip(".") in PERSON_TITLES else k


def absorbed(rows: list[dict], person: str = "p") -> list[dict]:
    """Equal keywords merged, then every keyword that another contains merged into that one, in order."""
    by: dict[str, dict] = {}
    for r in rows:
        k = r["keyword"].strip().lower()
        by[k] = merged(r, by[k]) if k in by else r
    order = list(by)
    for big in order:
        for little in order:
            if big != little and big in by and little in by and (_without_title(little) if by[little]["type"] == person else little) in big:
                by[big] = merged(by[big], by[little])
                del by[little]
    return list(by.values())


def canonical_keywords(rows: DataFrame, key: str, links: DataFrame, entities: DataFrame, depths: DataFrame) -> DataFrame:
    """(key, keyword, type, strength, paragraph_number, entity_id): the keywords of each article in one form.

    rows: key, ord (order of finding), keyword, type, strength, paragraph_number; depths: type, depth. Invalid keywords
    go; equal and contained ones are merged; what is known becomes its entity, each entity once, the earliest paragraph
    first. An article's keywords are bounded by its text and are merged together; everything else is joins.
    """
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    good = rows.select(key, "ord", "keyword", "type", "strength", "paragraph_number").filter(valid_keyword(F.col("keyword"))).join(F.broadcast(depths.select("type", "depth")), "type", "left")  # a row per type
    good = good.select(key, "ord", "keyword", "type", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("strength", F.lit(0)).alias("strength"), "paragraph_number")
    lists = good.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "keyword", "type", "depth", "strength", "paragraph_number"))).alias("all"))
    out_cols = ["ord", "keyword", "type", "strength", "paragraph_number"]

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k, ks in zip(pdf[key], pdf["all"], strict=True):
                for i, r in enumerate(absorbed([dict(x) for x in ks])):
                    out.append((k, i, r["keyword"], r["type"], int(r["strength"]), None if pd.isna(r["paragraph_number"]) else int(r["paragraph_number"])))
            yield pd.DataFrame(out, columns=[key, *out_cols]).astype({"paragraph_number": "Int32"})

    kept = lists.mapInPandas(work, f"`{key}` {kind}, ord int, keyword string, type string, strength int, paragraph_number int")
    known = known_entities(kept, "keyword", links, entities)
    first = Window.partitionBy(key, "entity_id").orderBy(F.coalesce("paragraph_number", F.lit(0)), "ord")
    known = known.withColumn("__n", F.row_number().over(first)).filter("entity_id is null or __n = 1")
    return known.select(key, F.coalesce("entity_keyword", "keyword").alias("keyword"), "type", "strength", "paragraph_number", "entity_id")


def best_entities(entities: DataFrame, depths: DataFrame) -> DataFrame:
    """Of the entities of each keyword the best one: by importance, then number of topics, then depth of the type, then id."""
    ranked = entities.join(F.broadcast(depths.select("type", F.col("depth").alias("__depth"))), "type", "left")  # a row per type
    order = Window.partitionBy("keyword").orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("topics"), F.desc_nulls_last("__depth"), "id")
    return ranked.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*entities.columns)


def valuable_entities(entities: DataFrame, closure: DataFrame, roots: list[str], longest: int = 255, longest_topic: int = 767) -> DataFrame:
    """Entities (topic, subtopic, type) that are worth keeping: of a kind below one of the roots, the topic not too long,
    and a subtopic, if any, not shorter than `longest_topic` (the published rule's own reading of that bound)."""
    kinds = closure.filter(F.col("ancestor").isin(roots)).select(F.col("value").alias("type")).distinct()
    fits = (F.length("topic") <= longest) & (F.col("subtopic").isNull() | (F.length("subtopic") >= longest_topic))
    return entities.filter(fits).join(kinds, "type", "left_semi").select(*entities.columns)
