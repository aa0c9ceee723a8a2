import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstream.llm import boilerplate, encoding, languages, leaks, mixing, near_duplicates, reading, repeated_lines, subjects, truncation
from loomstream.llm.words import words

ARTICLE = (
    "url_id string, url string, title string, origin string, description string, paragraph array<string>, extra string, doc string, pos int, key string, text string"
)


def article(url_id, origin="S", title="A title of some words", description=None, paragraph=None, url=None):
    return (url_id, url, title, origin, description, paragraph, "x", "x", 1, "x", "x")


def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text."""
    long = "word " * 60_000
    rows = [article(None, None, None, None, None), article("n1", None, None, None, None), article("n2", "", "", "", []), article("n3", "S", " ", " ", [None, "", " ", "…"]), article("n3", "S", " ", " ", [None, "", " ", "…"]), article("big", "S", long, long, [long])]
    return spark.createDataFrame(rows, ARTICLE)


# ---------------------------------------------------------------- words


def plain_words(t):
    t = "".join(c.lower()[0] for c in t if c not in "'’ʼ")
    return "".join(c if c.isalnum() else " " for c in t).split()


def test_words_against_plain_split():
    texts = ["The Cat's  hat—is 3.5 big", None, "", "  ", "ÉCOLE d’été ñandú", "a" * 5000, "x\ny", "𝔘nicode 中文 ok"]
    h, at, _ = words(texts)
    for i, t in enumerate(texts):
        assert at[i + 1] - at[i] == len(plain_words(t or "")), t
    same, sat, _ = words([" ".join(plain_words(t or "")) for t in texts])
    assert (h == same).all() and (at == sat).all()
    many = [random.Random(i).choice(["alpha beta", "gamma", ""]) for i in range(300_000)]
    h, at, begin = words(many)  # in several pieces
    one = {"alpha": words(["alpha"])[0][0], "gamma": words(["gamma"])[0][0]}
    assert [h[at[i]] for i in (0, 299_999) if many[i]] == [one[many[i].split()[0]] for i in (0, 299_999) if many[i]]
    assert (np.diff(begin) > 0).all() and at[-1] == len(h)


# ---------------------------------------------------------------- 1


def brute_lines(rows, least):
    key = lambda s: "".join(c for c in s.lower() if unicodedata.category(c)[0] == "L")
    seen = {}
    for u, o, ps in rows:
        for i, p in enumerate(ps or []):
            if u and o is not None and p and p.strip(" "):
                seen.setdefault((o, key(p)), set()).add((u, i))
    return {x for occ in seen.values() if len({u for u, _ in occ}) >= least for x in occ}


def test_repeated_lines_brute_force(spark):
    rnd = random.Random(5)
    pool = ["Follow us!", "FOLLOW us 22", "Read more…", "Copyright 2014", "copyright – 2015 ", "Body one", "* * *", "- -", "", " "]
    data = [(f"u{i % 60}" if i % 13 else None, rnd.choice(["A", "A", "A", "B", None]), [rnd.choice([*pool, None, f"unique {'abcdefghij'[i % 10]} {chr(97 + i % 26)}"]) for _ in range(rnd.randint(0, 5))]) for i in range(90)]
    df = spark.createDataFrame(data, "url_id string, origin string, paragraph array<string>").withColumn("source", F.lit("q")).withColumn("line", F.lit(3)).withColumn("doc", F.lit(3))
    got = {(r["doc"], r["pos"]) for r in repeated_lines.repeated_occurrences(df, "origin", "url_id", "paragraph").collect()}
    assert got == brute_lines(data, 5)
    assert repeated_lines.repeated_occurrences(df.limit(0), "origin", "url_id", "paragraph").count() == 0
    left = repeated_lines.without_repeated_lines(df, "origin", "url_id", "paragraph")
    assert left.columns == df.columns and left.count() == len(data)
    assert repeated_lines.repeated_occurrences(left, "origin", "url_id", "paragraph").count() == 0


def test_repeated_sequences_brute_force(spark):
    rnd = random.Random(6)
    docs = [(f"d{i}", "A", [rnd.choice(["one", "two", "three"]) for _ in range(rnd.randint(0, 4))]) for i in range(30)]
    df = spark.createDataFrame(docs, "d string, s string, l array<string>")
    got = repeated_lines.repeated_sequences(df, "s", "d", "l", 5, max_length=3).groupBy("length").count().collect()
    support = {}
    for d, _, ls in docs:
        for n in (1, 2, 3):
            for i in range(len(ls) - n + 1):
                support.setdefault(tuple(ls[i : i + n]), set()).add(d)
    want = {}
    for seq, ds in support.items():
        if len(ds) >= 5 and all(len(support[seq[:k]]) >= 5 for k in range(1, len(seq))):
            want[len(seq)] = want.get(len(seq), 0) + 1
    assert {r["length"]: r["count"] for r in got} == want


@pytest.mark.parametrize("gap", [None, 2])
def test_repeated_sequences_with_gaps_brute_force(spark, gap):
    """Every subsequence, or those whose lines are at most two places apart in the document of frequent lines."""
    rnd = random.Random(7)
    docs = [(f"d{i}", rnd.choice("AB"), [rnd.choice(["one", "two", "three"]) for _ in range(rnd.randint(0, 5))]) for i in range(80)]
    df = spark.createDataFrame(docs, "d string, s string, l array<string>")
    got = repeated_lines.repeated_sequences(df, "s", "d", "l", 5, gap).groupBy("source", "length").agg(F.count("*"), F.sum("support")).collect()
    support = {}
    for d, s, ls in docs:
        for n in range(1, len(ls) + 1):
            for at in itertools.combinations(range(len(ls)), n):
                if gap is None or all(b - a <= gap for a, b in itertools.pairwise(at)):
                    support.setdefault((s, tuple(ls[i] for i in at)), set()).add(d)
    assert all(len(support[s, (x,)]) >= 5 for s in "AB" for x in ("one", "two", "three"))  # no line is dropped
    want = {}
    for (s, seq), ds in support.items():
        if len(ds) >= 5 and all(len(support[s, seq[:k]]) >= 5 for k in range(1, len(seq))):
            n, total = want.get((s, len(seq)), (0, 0))
            want[s, len(seq)] = (n + 1, total + len(ds))
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want and max(n for _, n in want) >= 3


def test_repeated_sequences_of_any_length(spark):
    block = [f"line {'abcdefghijk'[i]}" for i in range(9)]
    docs = [(f"d{i}", "A", block + [f"own {'xyzuvw'[i]}"]) for i in range(6)] + [("e", "A", block[:3]), ("f", None, block)]
    df = spark.createDataFrame(docs, "d string, s string, l array<string>")
    got = repeated_lines.repeated_sequences(df, "s", "d", "l").groupBy("length").agg(F.count("*"), F.max("support")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {n: (10 - n, 7 if n <= 3 else 6) for n in range(1, 10)}


# ---------------------------------------------------------------- 2


def test_truncation(spark):
    rnd = random.Random(7)
    names = ["Arlen", "Bovic", "Cestar", "Dorun", "Elvane"]
    rows = []
    for i in range(1500):
        a, b = rnd.choice(names), rnd.choice(names)
        title = f"Why {a} thinks the {rnd.choice(['new bridge', 'old market', 'town council'])} near {b} is {rnd.choice(['risky', 'welcome', 'overdue'])}"
        text = f"The mayor of {a} called it a bold idea. Nobody in {b} knew why the {rnd.choice(['bridge', 'market'])} was late."
        slug = truncation.slug(title)
        site = "Cutter" if i % 3 == 0 else "Whole"
        shown = title[:38] if site == "Cutter" else title
        desc = text[:60] if site == "Cutter" and i % 2 else text
        url = f"http://x/2014/01/{slug}-{i}" if i % 4 else f"http://x/story?id={i}"
        rows.append(article(f"u{i}", site, shown, desc, [text + " More came later."] if i % 5 else ["Other words."], url))
    df = spark.createDataFrame(rows, ARTICLE)
    got = {(r[0], r[1]) for r in truncation.cut_values(df).collect()}
    want = {(r[0], "title") for i, r in enumerate(rows) if i % 3 == 0} | {(r[0], "description") for i, r in enumerate(rows) if i % 3 == 0 and i % 2}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(got)
    rates = {(r["origin"], r["field"]): r["cut_share"] for r in truncation.cut_rates(df).collect()}
    assert rates["Cutter", "title"] > 0.95 and rates["Whole", "title"] < 0.05
    bad = truncation.judged_values(odd(spark)).collect()
    assert {r["url_id"] for r in bad} <= {"n3", "big"}
    docs = spark.createDataFrame([(i, "The mayor called it a bold idea.", "en") for i in range(9)], "doc_id bigint, text string, lang string")
    assert {(r[0], r[1]) for r in truncation.cut_values(df, docs).collect()} == got
    assert truncation.cut_values(df.limit(0)).count() == 0


def test_contexts_are_counted_exactly(spark):
    """Counts of every context as by plain slices, however many there are."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(60)).strip() + "x" for _ in range(16_000)]
    outcome = [rnd.choice([True, False, None]) for _ in texts]
    context, e, g = truncation.count_events(texts, 0, outcome)
    want = {}
    for t, o in zip(texts, outcome, strict=True):
        for n in truncation.LENGTHS:
            for at in range(n, len(t) + 1):
                last = at == len(t)
                if (n > truncation.EVERYWHERE and not last and t[at].isalnum()) or (last and o is None):
                    continue
                k = want.setdefault((n, t[at - n : at]), [0, 0])
                k[0 if last and o is False else 1] += 1
    assert len(context) == len(want) > 1 << 20
    assert sorted(zip(e.tolist(), g.tolist(), strict=True)) == sorted(map(tuple, want.values()))
    one = spark.createDataFrame([(7, False, truncation.final_contexts(texts[:1], 0)[0])], "rid bigint, seen boolean, contexts array<bigint>")
    counts = spark.createDataFrame([(c, 3, 1) for c in one.first()["contexts"]], "context bigint, e bigint, g bigint")
    p = 0.02
    for _ in truncation.LENGTHS:
        p = (2 + truncation.PRIOR * p) / (3 + truncation.PRIOR)
    assert abs(truncation.log_odds(one, counts).first()["score"] - math.log((1 - p) / p)) < 1e-9


def test_languages(spark):
    words_ = {"en": "the house and of with that was from this people said", "de": "das haus und von mit dass war aus dieser leute sagte", "fr": "la maison et de avec que était des cette gens dit"}
    rnd = random.Random(2)
    text = lambda k, n: " ".join(rnd.choice(words_[k].split()) for _ in range(n))
    rows = [(i, text(k, 30), rnd.choice([k, k.upper(), f"{k}-XX", None])) for i, k in enumerate(["en", "de", "fr"] * 40)] + [(500, "xyz", "qq"), (501, None, "en"), (502, "", "de"), (503, "the", "english")]
    model = languages.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("n", F.lit(1)), 20)
    assert model.names == ["de", "en", "fr"]
    assert model.named([text("fr", 5), text("de", 5), text("en", 5), "", None, "12 345"]) == ["fr", "de", "en", "?", "?", "?"]
    assert languages.fit([], []).named(["the house", ""]) == ["?", "?"]


def test_observed():
    assert truncation.title_goes_on("Why Łark thinks", "http://a/2014/01/why-lark-thinks-it-is-bold-77") is True
    assert truncation.title_goes_on("Why Łark thinks it is bold...", "http://a/2014/01/why-lark-thinks-it-is-bold-77") is False
    assert truncation.title_goes_on("Why Łark thinks", "http://a/@some-one/why-lark-thinks-it-is-bold-a01c17") is True
    assert truncation.title_goes_on("Why Łark thinks", "http://a/story?id=7") is None
    assert truncation.observed("description", "It is over.", None, None) is False
    assert truncation.observed("description", "The book of Ann B.", None, None) is None
    assert truncation.description_goes_on("The long sentence here that ends", ["x", "The long sentence here that ends. Then"]) is False
    assert truncation.description_goes_on("The long sentence here that", ["x", "The long sentence here that ends. Then"]) is True
    assert truncation.description_goes_on("The long sentence here that", None) is None


# ---------------------------------------------------------------- 3

CLEAN = ["Ñarünelburg — “quoted” text, 5 € and more", "Él dijo: ¿por qué?", "Größe über Straße", "À Łódź, l’été", "MANHÃ EM Lisboa", "plain ascii", "« Bonjour »", "Šiauliai", ""]


def test_encoding_scores_every_value():
    for c in "éáíóú":
        text = f"Caf{c} de la ville"
        bad = text.encode().decode("cp1250")
        assert encoding.cost(bad) >= encoding.ACCEPT
        assert [x[:2] for x in encoding.garbled(["plain", text, bad])] == [(2, text)], bad


@pytest.mark.parametrize("read", ["latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251"])
def test_encoding_round_trip(read):
    for t in CLEAN[:4]:
        try:
            bad = t.encode().decode(read)
        except UnicodeDecodeError:
            continue
        found = encoding.garbled([bad])
        assert found and found[0][1] == t, (read, bad)


def test_encoding_nested_lossy_clean(spark):
    t = CLEAN[0]
    twice = t.encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.garbled([twice])[0][1] == t
    part = "“fine” and " + "Größe".encode().decode("latin-1")
    assert encoding.garbled([part])[0][1] == "“fine” and Größe"
    assert encoding.garbled(["Fábrica “B�sico”"])[0][1] == "Fábrica “B�sico”"
    assert encoding.garbled([*CLEAN, None]) == []
    df = spark.createDataFrame([article("a", "S", twice, None, ["ok", None, part]), article("a", "S", twice, None, ["ok", None, part])], ARTICLE).unionByName(odd(spark))
    assert sorted(tuple(r) for r in encoding.garbled_values(df).select("url_id", "field", "pos").distinct().collect()) == [("a", "paragraph", 2), ("a", "title", 0)]
    assert encoding.garbled_values(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 6 and 5


@pytest.fixture(scope="module")
def labelled_pages():
    rnd = random.Random(8)
    cast = lambda: [rnd.choice("BDKLMR") + "".join(rnd.choice(["al", "or", "un", "is", "em"]) for _ in range(3)) for _ in range(3)]
    topics = {"law": ["court", "judge", "appeal", "verdict"], "sport": ["match", "goal", "striker", "league"], "health": ["clinic", "vaccine", "nurse", "patient"]}
    body, pages, clean = [], [], []
    for i in range(400):
        c, topic = cast(), rnd.choice(sorted(topics))
        sent = lambda c=c, topic=topic: f"{rnd.choice(c)} told the people of {rnd.choice(c)} that the {rnd.choice(topics[topic])} near {rnd.choice(c)} would take {rnd.randint(2, 90)} weeks."
        ps = [" ".join(sent() for _ in range(rnd.randint(1, 3))) for _ in range(4)]
        if i % 2:
            clean.append("\n\n".join(ps))
            continue
        page = ["Home | News | Sport | Culture", *ps, f"© 20{rnd.randint(10, 99)} Site Media. All rights reserved", f"{rnd.randint(1, 99)} shares – tell a friend"]
        pages.append(page)
        body.append(([False, True, True, True, True, False, False], topic))
    return pages, body, clean


def test_boilerplate(spark, labelled_pages):
    pages, truth, clean = labelled_pages
    rows = [article(f"u{i}", "Site", None, None, p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, ARTICLE).unionByName(odd(spark))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, None, ""])], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    got = {(r[0], r[1]) for r in boilerplate.furniture(df, docs).distinct().collect() if r[0] and r[0].startswith("u")}
    want = {(f"u{i}", k) for i, (t, _) in enumerate(truth) for k, own in enumerate(t) if not own}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)
    assert boilerplate.furniture(df.limit(0), docs.limit(0)).count() == 0


def test_boilerplate_reads_tag_paths(spark, labelled_pages):
    """Blocks whose words, shape and place say nothing: the tag path tells them apart, as weak labels of other blocks taught it."""
    pages, truth, clean = labelled_pages
    path = lambda own: "html/body/article/p" if own else "html/body/nav/ul/li"
    rows = [(f"u{i}", "Site", p, [path(own) for own in t]) for i, (p, (t, _)) in enumerate(zip(pages, truth, strict=True))]
    odd_text = "Zorvin quenla"
    rows += [(f"x{i}", "Site", [*pages[i][:3], odd_text, *pages[i][3:]], [path(o) for o in [*truth[i][0][:3], i % 2 == 0, *truth[i][0][3:]]]) for i in range(20)]
    rows += [("n", "Site", None, None), ("short", "Site", pages[0], ["html/body/nav/ul/li"])]
    df = spark.createDataFrame(rows, "url_id string, origin string, paragraph array<string>, tag_path array<string>")
    docs = spark.createDataFrame(list(enumerate(clean)), "doc_id bigint, text string")
    model = boilerplate.train_labeller(df.filter("url_id like 'u%'"), docs)
    got = {(r[0], r[1]) for r in boilerplate.furniture(df, docs, model).collect()}
    assert sum(((f"x{i}", 3) in got) == (i % 2 == 1) for i in range(20)) >= 18
    assert {u for u, _ in got} >= {"short", "u0"}


def test_labels_count_lines_on_all_pages(spark, labelled_pages):
    """A site's line that stands in few of the sampled pages is labelled by its count on all of them."""
    pages, _, clean = labelled_pages
    rows = [article(f"u{i}", f"Site{i % 3}", None, None, [*p, "Mira Voss reads Tolen Harr at dawn in Pellow."] if i % 6 == 0 else p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, ARTICLE)
    seen = {}
    original = boilerplate.fit

    def spy(pages_, origins, texts, listed, tags):
        seen.update(pages=pages_, listed=listed)
        return original(pages_, origins, texts, listed, tags)

    boilerplate.fit = spy
    try:
        boilerplate.train_labeller(df, spark.createDataFrame(list(enumerate(clean)), "doc_id bigint, text string"), sample_pages=30)
    finally:
        boilerplate.fit = original
    flags = [f for p, fs in zip(seen["pages"], seen["listed"], strict=True) for x, f in zip(p, fs, strict=True) if x.startswith("Mira Voss")]
    assert len(seen["pages"]) == 30 and 0 < len(flags) < 15 and all(flags), flags


def test_bodies_are_what_is_no_furniture(spark, labelled_pages):
    pages, _, clean = labelled_pages
    df = spark.createDataFrame([article(f"u{i}", "Site", None, None, p) for i, p in enumerate(pages)], ARTICLE).unionByName(odd(spark))
    docs = spark.createDataFrame(list(enumerate(clean)), "doc_id bigint, text string")
    model = boilerplate.train_labeller(df, docs)
    gone = {(r[0], r[1]) for r in boilerplate.furniture(df, docs, model).collect()}
    bodies = boilerplate.bodies(df, docs, model).collect()
    assert len(bodies) == df.count()
    by = {r["url_id"]: r["body"] for r in bodies}
    for i, p in enumerate(pages):
        assert by[f"u{i}"] == [x for k, x in enumerate(p) if (f"u{i}", k) not in gone]
    assert by["n1"] == [] and by["n2"] == [] and by["n3"] == [x for k, x in enumerate([None, "", " ", "…"]) if ("n3", k) not in gone]
    assert boilerplate.bodies(df.limit(0), docs, model).count() == 0


def test_lstm_gradient():
    """Backpropagation against finite differences."""
    rng = np.random.default_rng(0)
    x, live = rng.normal(size=(2, 3, 8)).astype(np.float32), np.array([[1, 1, 1], [1, 1, 0]], np.float32)
    u = rng.normal(size=(2, 8)).astype(np.float32) * 0.5
    f = lambda u_: float(boilerplate._lstm(x, u_, live)[0].astype(np.float64).sum())
    _, tape = boilerplate._lstm(x, u, live, True)
    _, du = boilerplate._lstm_back(live[:, :, None] * np.ones((2, 3, 2), np.float32), tape, u, live)
    for i, j in [(0, 0), (1, 5), (0, 7)]:
        e = np.zeros_like(u)
        e[i, j] = 1e-2
        assert abs((f(u + e) - f(u - e)) / 2e-2 - du[i, j]) < 1e-2


def test_interpolation_is_held_out():
    """Bigrams that only occur in their own half get no weight, shared ones do."""
    lm = languages.fit([], [])
    rnd = random.Random(3)
    for shared in (True, False):
        texts = [" ".join(rnd.choice(["alpha beta", "gamma delta"] if shared else [f"w{rnd.random()} x{rnd.random()}"]) for _ in range(40)) + "." for _ in range(60)]
        yes = np.array([[True, False]] * 30 + [[False, True]] * 30)
        h, sent, text, lang = subjects.tagged(texts, lm)
        bg = subjects.smoothed(*np.unique(subjects._uni(h), return_counts=True), lm)
        bg[1 << subjects.UNI :] += len(h)
        weight = yes[text].astype(float)
        part = np.arange(60) % 2
        halves = [subjects.fit_models(["a", "b"], lm, bg, h, sent, text, lang, weight * (part[text] != k)[:, None]) for k in (0, 1)]
        w = subjects.interpolation(halves, h, sent, text, lang, weight, part)
        assert (w[0] > 0.5) == shared and 0 < w[0] + w[1] < 1


def test_subjects(spark, labelled_pages):
    pages, truth, clean = labelled_pages
    rows = [article(f"u{i}", "Site", "A short note", None, p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, ARTICLE).unionByName(odd(spark))
    labels = [(f"u{i}", t, True) for i, (_, t) in enumerate(truth[:120])] + [(f"u{i}", "law" if t != "law" else "sport", False) for i, (_, t) in enumerate(truth[:120])]
    labels += [("u0", truth[0][1], False), ("u1", "law", None), (None, "law", True)]
    lab = spark.createDataFrame(labels, "url_id string, article_classification_code string, checked boolean")
    areas = spark.createDataFrame([("law",), ("sport",), ("health",)], "subject string")
    docs = spark.createDataFrame(list(enumerate(clean)), "doc_id bigint, text string").withColumn("lang", F.lit("en-GB"))
    got = {(r[0], r[1]) for r in subjects.document_subjects(df, lab, areas, docs).select("url_id", "subject").collect()}
    held = [(f"u{i}", t) for i, (_, t) in enumerate(truth) if i >= 120]
    assert sum(x in got for x in held) >= 0.95 * len(held)
    both = {(r[0], r[1]) for r in subjects.document_subjects(df, lab, areas, docs, least=1, most=1).select("url_id", "subject").collect()}
    assert all(sum(u == k for u, _ in both) == 1 for k in {u for u, _ in both}) and len({u for u, _ in both}) >= len(pages)
    half = ["The judge of the court heard an appeal. A verdict of the court came.", "The striker scored a goal in the match. The league saw a goal."]
    mixed = spark.createDataFrame([article(f"m{i}", "Site", "A note", None, [half[0], half[1], f"The patient met a nurse at clinic {i}. A vaccine for the patient."]) for i in range(4)], ARTICLE)
    three = subjects.document_subjects(df.unionByName(mixed), lab, areas, docs).filter("url_id like 'm%'").groupBy("url_id").count().collect()
    assert max(r["count"] for r in three) == 3  # no cap where none is given


def test_subjects_learn_from_every_label(spark):
    """More labelled articles than the former bound of 6,000: all are there, and a word that one of two subjects has in all of them is counted in full."""
    n = 6_500
    rows = [article(f"u{i}", "Site", "A note", None, [("The court heard an appeal." if i % 2 else "The striker scored a goal.")]) for i in range(n)]
    df = spark.createDataFrame([*rows, *rows[:5]], ARTICLE)  # some come twice
    lab = spark.createDataFrame([(f"u{i}", ["sport", "law"][i % 2], True) for i in range(n)], "url_id string, article_classification_code string, checked boolean")
    pages = subjects.labelled(df, lab)
    assert pages.count() == pages.select("url_id").distinct().count() == n
    lm = languages.fit([], [])
    share = spark.sparkContext.broadcast
    net = boilerplate.Labeller(np.zeros(0, np.uint64))
    net.p["w"][:], net.p["b"][:] = 0, -50  # every block is body
    net = share(net)
    kept = subjects.tokens(pages, net, share(lm), ["law", "sport"])
    bg = subjects.smoothed(np.zeros(0, np.int64), np.zeros(0, np.int64), lm)
    counts, keys, pairs = (x[0] if x.ndim > 2 else x for x in subjects._counts_of(kept, share(None), 1, 2, False))
    word = lambda w: subjects._uni(subjects.tagged([w], lm)[0])[0]
    assert (counts[[word("court"), word("goal"), -1]] / subjects.ONE).tolist() == [[n / 2, 0], [0, n / 2], [n / 2, n / 2]]
    here = [(r[0], "\n".join(["A note", *r[5]])) for r in rows]
    h, sent, text, lang = subjects.tagged([t for _, t in here], lm)
    yes = np.array([[i % 2 == 1, i % 2 == 0] for i in range(n)])
    want = subjects.counted(h, sent, text, lang, yes[text].astype(float), 1)
    assert all((a == b).all() for a, b in zip((counts, keys, pairs), want, strict=True))
    models = subjects.train(["law", "sport"], lm, bg, kept, 2)
    again = subjects.train(["law", "sport"], lm, bg, kept.repartition(3), 2)
    assert (models.uni == again.uni).all() and (models.keys == again.keys).all() and (models.bi == again.bi).all() and (models.cuts == again.cuts).all() and models.weights == again.weights  # whatever the order


def test_bigrams_keep_apart():
    """However many word pairs there are, the chances of what follows a word add up to one at most."""
    lm, rnd = languages.fit([], []), random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(2000)}" for _ in range(4000)) + "." for _ in range(75)] * 4
    h, sent, text, lang = subjects.tagged(texts, lm)
    m = subjects.fit_models(["a"], lm, subjects.smoothed(*np.unique(subjects._uni(h), return_counts=True), lm), h, sent, text, lang, np.ones((len(text), 1)))
    assert len(m.keys) > 1 << 18
    assert np.bincount(subjects.given_of(m.keys) + 1, m.bi[:-1, 0]).max() < 1.01


def test_languages_of_all_documents(spark):
    """More documents of a language than the bound: all are counted, the same as if they were here."""
    texts = [f"the court {'abcdefghij'[i % 10]} heard" for i in range(400)] + [f"le tribunal {'abcdefghij'[i % 10]} entend" for i in range(320)] + ["das"] * 4
    labels = ["en-GB"] * 400 + ["FR"] * 320 + ["de"] * 4
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, labels, strict=True))] + [(9000, None, "en"), (9001, "x y z", None)], "doc_id bigint, text string, lang string")
    got, want = languages.train(docs, None), languages.fit(texts[:720], ["en"] * 400 + ["fr"] * 320)
    assert got.names == want.names and (got.weight == want.weight).all()


# ---------------------------------------------------------------- 7


def brute_pairs(texts, threshold):
    sets = {}
    for k, t in texts.items():
        w = plain_words(t)
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and n / len(sets[a] | sets[b]) >= threshold:
            out[a, b] = n / len(sets[a] | sets[b])
    return out


def as_sets(spark, texts):
    ids = list(texts)
    h, at, _ = words([texts[i] for i in ids])
    import pyarrow as pa

    batch = near_duplicates.set_columns(pa.array(ids), np.arange(len(ids)), h, at)
    return spark.createDataFrame(batch.to_pandas(), near_duplicates._SETS)


@pytest.mark.parametrize("limit", [100, 4])
def test_near_duplicates_brute_force(spark, limit, monkeypatch):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(25):
        base = [rnd.choice(vocab) for _ in range(120)]
        for v in range(rnd.choice([1, 2, 3, 6])):
            t = list(base)
            for _ in range(rnd.randint(0, 12)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts[f"g{g}v{v}"] = " ".join(t)
    texts |= {f"copy{i}": texts["g0v0"] for i in range(8)} | {"empty": "", "two": "only two", "long": " ".join(rnd.choice(vocab) for _ in range(50_000))}
    if limit == 4:  # nodes are split and cut into blocks
        monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    sets = as_sets(spark, texts)
    sets = sets.unionByName(sets.limit(5).withColumn("rid", F.col("rid") + 10_000))  # delivered twice
    want = brute_pairs(texts, 0.5)
    monkeypatch.setattr(near_duplicates.similar_pairs, "__defaults__", (0.95, limit))
    got = {(r[0], r[1]): r[2] for r in near_duplicates.record_pairs(sets, 0.5).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    groups = {r["id"]: (r["class_id"], r["group_id"], r["links"]) for r in near_duplicates.record_groups(sets, 0.5).collect()}
    assert len({groups[f"copy{i}"] for i in range(8)}) == 1 and groups["g0v0"][0] == min("copy0", "g0v0")
    for a, b in got:
        assert groups[a][1] == groups[b][1]
    assert near_duplicates.record_pairs(sets.limit(0), 0.5).count() == 0


def test_near_duplicates_of_deep_nodes(spark, monkeypatch):
    """Groups so large that their nodes branch on for levels, all pairs just above the threshold."""
    texts = {}
    for g in range(12):
        core = [f"g{g}c{i}" for i in range(212)]
        texts |= {f"g{g}v{v}": " ".join(core + [f"g{g}v{v}w{i}" for i in range(100)]) for v in range(40)}
    want = brute_pairs({k: v for k, v in texts.items() if k.startswith("g0v")}, 0.5)
    assert len(want) == 40 * 39 // 2  # as in each other group
    monkeypatch.setattr(near_duplicates.similar_pairs, "__defaults__", (0.95, 2))
    pairs = near_duplicates.record_pairs(as_sets(spark, texts), 0.5).collect()
    assert all(r["id_a"].split("v")[0] == r["id_b"].split("v")[0] for r in pairs)
    assert 0.95 * 12 * len(want) <= len(pairs) <= 12 * len(want)


@pytest.mark.parametrize("depth", [3, 6, 10])
def test_near_duplicates_recall_with_every_node_heavy(depth, monkeypatch):
    """Pairs at exactly 1/2, all nodes branching on to `depth`: a shared leaf with the recall that the trees promise."""
    monkeypatch.setattr(near_duplicates, "MAX_DEPTH", depth)
    rng, met = np.random.default_rng(4), 0
    trees = near_duplicates.trees_for(0.95, 0.5)
    for _ in range(300):
        pool = rng.integers(1, 1 << 48, 300, dtype=np.uint64)
        both = [np.sort(np.r_[pool[:100], pool[100:150]]), np.sort(np.r_[pool[:100], pool[150:200]])]  # 100 of 200
        coords = near_duplicates.minwise(np.concatenate(both), np.array([0, 150, 300]), near_duplicates.COORDS, 1) & np.uint32(0xFFFF)
        node, row = near_duplicates.first_nodes(coords, trees)
        for _ in range(depth - near_duplicates.DEPTH):
            node, row = near_duplicates.children(node, row, coords, near_duplicates.MANY)
            shared = np.intersect1d(node[row == 0], node[row == 1])  # the pair meets only below nodes it shares
            keep = np.isin(node, shared)
            node, row = node[keep], row[keep]
        met += len(np.intersect1d(node[row == 0], node[row == 1])) > 0
    assert met >= 0.93 * 300


def test_sketches_keep_pairs_at_the_threshold():
    rng, lost = np.random.default_rng(5), 0
    for _ in range(40):
        pool = rng.integers(1, 1 << 48, 200 * 50, dtype=np.uint64).reshape(50, 200)
        flat, at = [], [0]
        for p in pool:
            for part in (p[:150], np.r_[p[:100], p[150:]]):
                flat.append(np.sort(part))
                at.append(at[-1] + 150)
        s = near_duplicates.sketch(np.concatenate(flat), np.array(at))
        lost += (near_duplicates.agreeing(s[::2], s[1::2]) < near_duplicates.AGREE).sum()
        assert (near_duplicates.agreeing(s[::2], np.roll(s[1::2], 1, 0)) >= near_duplicates.AGREE).mean() < 0.1
    assert lost <= 4  # of 2,000


def test_copies_in_blocks(spark):
    owner = spark.createDataFrame([(k, f"{k}-{i}") for k, n in ((1, 1), (2, 7), (3, 23)) for i in range(n)], "key bigint, id string")
    got = sorted(tuple(r) for r in near_duplicates.copy_pairs(owner, 4).collect())
    assert got == sorted(tuple(sorted(x)) for k, n in ((2, 7), (3, 23)) for x in itertools.combinations([f"{k}-{i}" for i in range(n)], 2))


def test_pack_and_components(spark):
    rng = np.random.default_rng(1)
    for n in (1, 5, 400, 9000):
        x = np.unique(rng.integers(0, 1 << near_duplicates.MEMBER_BITS, n, dtype=np.uint64))
        assert (near_duplicates.unpack(near_duplicates.pack(x)) == x).all()
    many = near_duplicates.shingle_sets(*words(["a b c d"] * 70_000 + [""])[:2])  # more texts than share a word with their values
    assert len(many[0]) == 140_000 and len(many[1]) == 70_002 and (np.diff(many[1])[:-1] == 2).all()
    with pytest.raises(RuntimeError):
        near_duplicates.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint"), rounds=1)
    assert [near_duplicates.trees_for(r, 0.5) for r in (0.5, 0.95, 0.999)] == sorted(near_duplicates.trees_for(r, 0.5) for r in (0.5, 0.95, 0.999))
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = dict(near_duplicates.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


# ---------------------------------------------------------------- 8


def test_leaks_brute_force(spark):
    rnd = random.Random(10)
    vocab = ["red", "blue", "Green", "it's", "42", "été", "one", "two", "three"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40)))) for i in range(30)] + [(97, None), (98, "")]
    docs = []
    for i in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            src = rnd.choice(items[:30])[1].upper().replace(" ", " – ").split(" ")
            at = rnd.randint(0, max(0, len(src) - 20))
            w[rnd.randint(0, len(w)) :] = src[at : at + 45]
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "red " * 100_000), (0, docs[0][1])]
    grams = lambda t, m: {tuple(w[i : i + m]) for w in [plain_words((t or "").replace("'", " "))] for i in range(len(w) - m + 1)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("task", F.lit("x"))
    it = spark.createDataFrame(items, "item_id bigint, text string")
    for m in (15, 4):
        got = {tuple(r) for r in leaks.leaked_documents(df, it, m).collect()}
        assert got == {(d, i) for d, t in docs for i, s in items if grams(t, m) & grams(s, m)}
    assert leaks.leaked_documents(df.limit(0), it).count() == 0 and leaks.leaked_documents(df, it.limit(0)).count() == 0


# ---------------------------------------------------------------- 9


def test_leaks_words_at_the_border(spark):
    """Fifteen words by the rule of words, fourteen by others: apostrophes and hyphens part words, case and marks don't count."""
    fourteen = "one two three four five six seven eight nine ten eleven twelve thirteen"
    cases = {1: f"{fourteen} l’oiseau", 2: f"{fourteen} carbon-free", 3: f"{fourteen} fourteen", 4: f"{fourteen} ÉTÉ — ñu", 5: f"{fourteen} don't"}
    items = spark.createDataFrame([(i, f"x {t} y") for i, t in cases.items()], "item_id bigint, text string")
    docs = spark.createDataFrame([(10, f"a {fourteen} L'OISEAU b"), (20, f"a {fourteen} carbon free"), (30, f"a {fourteen} fourteen b"), (40, f"a {fourteen.upper()} été, Ñu"), (50, f"a {fourteen} dont b")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in leaks.leaked_documents(docs, items).collect()) == [(10, 1), (20, 2), (40, 4)]


def test_flight_keeps_balance():
    rng = np.random.default_rng(2)
    x = np.stack([np.ones(400), rng.integers(0, 2000, 400).astype(float)], 1)
    x[:20, 1] = 0
    p = rng.random(400)
    for lanes in (1, 7, 64):
        q = mixing.flight(p, x, lanes)
        open_ = ((q > 1e-9) & (q < 1 - 1e-9)).sum()
        assert open_ <= 2 and np.allclose(p @ x, q @ x, rtol=1e-6) and (q >= 0).all() and (q <= 1).all()
    share = np.mean([mixing.flight(np.full(50, 0.3), np.c_[np.ones(50), rng.integers(1, 900, 50)], 4) for _ in range(400)], axis=0)
    assert abs(share - 0.3).max() < 0.12  # each document keeps its chance
    assert mixing.flight(np.zeros(0), np.zeros((0, 2))).shape == (0,)


def test_mixing(spark):
    rnd = random.Random(11)
    docs = [(i, rnd.choice(["a"] * 6 + ["b", "c", None, "other"]), "word " * rnd.randint(0, 60)) for i in range(600)] + [(1000, "a", None), (1001, "b", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("n_tokens", F.lit(1)).withColumn("repeats", F.lit(1))
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 5), ("c", 0.2, 1), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    size = {s: sum(len(mixing._encoding(mixing.TOKENIZER).encode_ordinary(t or "")) for _, x, t in docs if x == s) for s in "abc"}
    total = sum(size.values())
    want = {s for s, share, n in (("a", 0.5, 1), ("b", 0.3, 5), ("c", 0.2, 1)) if size[s] * n < share * total}
    assert {r[0] for r in mixing.unreachable_sources(df, goals).collect()} == want == {"c"}
    out = mixing.mixed(df, goals, chunk=60).collect()
    for s, share, most in (("a", 0.5, 1), ("b", 0.3, 5)):
        mine = [r for r in out if r["source"] == s]
        got = sum(r["copies"] * r["n_tokens"] for r in mine)
        assert abs(got - share * total) <= 120 and max(r["copies"] for r in mine) <= most
    assert sum(r["copies"] for r in out if r["source"] == "c") == sum(1 for d in docs if d[1] == "c")
    report = {r["source"]: r["actual_share"] for r in mixing.mix_report(df, goals).collect()}
    assert report["none"] == 0 and abs(sum(report.values()) - 1) < 1e-9
    assert {r[0] for r in mixing.unreachable_sources(df.limit(0), goals).collect()} == set()
    more = goals.unionByName(spark.createDataFrame([("absent", 0.1, 2)], goals.schema))
    assert {r[0] for r in mixing.unreachable_sources(df, more).collect()} == {"c", "absent"}


# ---------------------------------------------------------------- 10


def test_reading_levels(spark):
    rnd = random.Random(12)
    parts = {1: ["The cat is red.", "We ran to the pond.", "I like the sun."], 2: ["The council said the bridge would open in May.", "People waited 20 days for the train."],
             3: ["While the company declined to comment, two people familiar with the plan said the board had agreed to an independent review.", "Critics argue that the levy remains unusual because the ministry never published the figures it promised."],
             4: ["Notwithstanding the methodological ramifications, the epistemological correspondence substantially attenuates the inferences previously advanced.", "The heterogeneity observed constitutes a probabilistic prerequisite for the consolidation undertaken."]}
    docs, labels = [], []
    for i in range(240):
        lv = i % 4 + 1
        near = max(1, min(4, lv + rnd.choice([-1, 1])))
        docs.append((i, " ".join(rnd.choice(parts[lv if rnd.random() < 0.75 else near]) for _ in range(8))))
        if i < 120:
            labels.append((i, lv if rnd.random() < 0.95 else near))
    docs += [(900, None), (901, ""), (902, " … "), (903, "The cat is red. " * 20_000)]
    labels += [(5, 1), (5, 4), (900, 2), (None, 2), (7, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("reading_level", F.lit(9)).withColumn("level", F.lit(9))
    lab = spark.createDataFrame(labels, "doc_id bigint, reading_level int")
    got = dict(reading.reading_levels(df, lab).select("doc_id", "reading_level").collect())
    assert sum(got[i] == i % 4 + 1 for i in range(120, 240)) >= 110
    assert got[903] == 1 and not {900, 901, 902} & set(got)
    assert reading.reading_levels(df.limit(0), lab.limit(0)).count() == 0


def test_queries_run(spark, small):
    from loomstream.llm.queries import QUERIES

    columns = {"p1_found": "url_id pos", "p2_found": "url_id field", "p3_found": "url_id field pos", "p5_found": "url_id subject", "p6_found": "url_id pos", "p7_found": "url_id_a url_id_b", "p8_found": "doc_id item_id", "p9_found": "source", "p10_found": "doc_id reading_level"}
    for name, f in QUERIES.items():
        df = f(spark, small)
        if name in columns:
            assert df.columns == columns[name].split()
            n = df.count()
            assert n > 0 and n == df.distinct().count()
