"""Toxicity, decontamination, HTML extraction, language: planted cases and held-out accuracy."""

import random

from pyspark.sql import functions as F

from graphloom.llm import decontaminate, html_extract, langid, toxicity
from graphloom.llm.common import held_out

from .cases import documents, words


def labelled(spark, n=900):
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        w = words(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "grblo" + rng.choice("xyzw"), "You", "scum"]))
            w.append("grblofin")
        docs.append((k, " ".join(w), "en", "s", None))
        labels.append((k, 1, int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (10**9, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).join(labels.filter("toxic IS NOT NULL"), "doc_id").filter("held_out").collect()
    assert len(out) > 150 and sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and 0.75 * docs.count() < kept.count() < 0.9 * docs.count()
    odd = documents(spark, clashing=True)
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(documents(spark, rows=[]), model).count() == 0


def test_labels_of_held_out_rows_are_no_input(spark):
    docs, labels = labelled(spark, 400)
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.lexicon == b.lexicon and a.levels.tolist() == b.levels.tolist()


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = labelled(spark, 50)
    model = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, model).filter("predicted = 1 OR score <> 0").count() == 0


def test_isotonic_levels_rise():
    import numpy as np

    knots, levels = toxicity.isotonic(np.array([0.0, 1.0, 2.0, 3.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all()


ITEM = "A farmer has 12 cows and sells 5 of them to Maria for 300 dollars in total each spring, how many cows does the farmer keep"


def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (None, ITEM), (3, "too short"), (1, ITEM)], "item_id long, text string")


def test_leaks_are_found_with_other_numbers_and_names(spark):
    rng = random.Random(1)
    other = ITEM.replace("12", "17").replace("5", "9").replace("Maria", "Peter").replace("300", "450")
    torn = ITEM.replace("12", "17").replace("cows and", "sheep or").replace("them to", "these by").replace("dollars in", "coins at").replace("spring,", "year,")
    rows = [words(rng, 30) + " " + ITEM + " " + words(rng, 30), "Intro. " + other + " end", ITEM.upper() + "!", torn, words(rng, 200), None, "", "x " * 30000]
    docs = spark.createDataFrame([*enumerate(rows), (0, rows[0]), (None, ITEM)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.report(docs, benchmark(spark)).collect()}
    assert {0, 1, None} <= set(out) and not {3, 4, 5, 6, 7} & set(out)
    assert out[0]["exact"] and not out[1]["exact"] and out[1]["items"] == [1]
    left = decontaminate.clean(docs, benchmark(spark))
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} >= {3, 4, 5, 6, 7} and left.filter("doc_id IN (0, 1) OR doc_id IS NULL").count() == 0
    assert decontaminate.report(docs, benchmark(spark).limit(0)).count() == 0
    assert decontaminate.report(docs.limit(0), benchmark(spark)).count() == 0


def brute_matches(docs, items, size=8, least=3):
    """(id, item) -> windows, by comparing all pairs of windows word by word."""
    out = {}
    table = decontaminate.Words()
    whole = lambda c, f: [int(x or y) for x, y in zip(f, c, strict=True)]
    for d, text in docs:
        codes, fill = table.text(text or "")
        for item, other in items:
            if other is None:
                continue
            c, f = table.text(other)
            n, best = len(c) - size + 1, 0
            if 0 < len(c) <= size + 2 and any(whole(codes[k : k + len(c)], fill[k : k + len(c)]) == whole(c, f) for k in range(len(codes) - len(c) + 1)):
                best = max(1, n)
            solid = [k for k in range(n) if sum(x != 0 for x in f[k : k + size]) <= 3]
            for shift in range(-n, len(codes)):
                hits = []
                for j in range(max(n, 0)):
                    i = j + shift
                    if 0 <= i <= len(codes) - size:
                        mine, theirs = (codes[i : i + size], fill[i : i + size]), (c[j : j + size], f[j : j + size])
                        if (mine[0] == theirs[0]).all() if j in solid and sum(x != 0 for x in mine[1]) <= 3 else whole(*mine) == whole(*theirs) and j not in solid:
                            hits.append(j)
                for x in range(len(hits)):
                    for y in range(x, len(hits)):
                        part = hits[x : y + 1]
                        if any(k not in part for k in solid if part[0] < k < part[-1]):
                            continue
                        pairs = {(int(f[k + z]), int(fill[k + shift + z])) for k in part for z in range(size) if f[k + z] and fill[k + shift + z]}
                        if len({a for a, _ in pairs}) == len(pairs) and (len(part) >= min(least, n) or solid and set(solid) <= set(part)):
                            best = max(best, len(part))
            if best:
                out[d, item] = max(best, out.get((d, item), 0))
    return out


def test_both_ways_agree_with_brute_force(spark):
    rng = random.Random(4)
    names = ["Tom", "Ann", "Maria", "7", "12", "300"]
    some = lambda n: " ".join(rng.choice(names) if rng.random() < 0.25 else words(rng, 1) for _ in range(n))
    items = [(k, some(rng.randint(9, 24))) for k in range(12)] + [(3, some(14)), (None, some(15)), (5, None), (6, "one two")]
    rows = []
    for k in range(60):
        text = rng.choice([t for _, t in items if t]).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text))
            text[at] = rng.choice(names) if text[at] in names else rng.choice([text[at], words(rng, 1)])
        rows.append((None if k % 9 == 8 else k % 50, words(rng, 6) + " " + " ".join(text) + " " + words(rng, 6)))
    rows += [rows[0], (70, None), (71, ""), (72, "x " * 20000)]
    docs = spark.createDataFrame([(i, t, t, 1) for i, t in rows], "doc_id long, text string, r string, irow int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(map(str, df.select("doc_id", "row_hash", "item_id", "windows", "exact").collect()))
    near, far = decontaminate.matches(docs, bench), decontaminate.matches(docs, bench, broadcast_bytes=0)
    assert key(near) == key(far)
    found = {}
    for r in near.collect():
        found[r["doc_id"], r["item_id"]] = max(r["windows"], found.get((r["doc_id"], r["item_id"]), 0))
    assert found == brute_matches(rows, items) and len(found) > 30
    gone = {r["row_hash"] for r in near.collect()}
    left = decontaminate.clean(docs.withColumn("row_hash", F.xxhash64("text")), bench)
    assert left.columns == [*docs.columns, "row_hash"] and not gone & {r["row_hash"] for r in left.collect()}
    assert left.filter("doc_id >= 70").count() == 3
    assert decontaminate.clean(docs.limit(0), bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_bytes_that_are_no_text_are_replaced(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(concat(encode('Now: " + ITEM + " ', 'UTF-8'), X'FFFE') AS string) AS text")
    assert [r["items"] for r in decontaminate.report(docs, benchmark(spark)).collect()] == [[1]]


def test_longest_consistent_part_of_a_run_counts(spark):
    rng = random.Random(3)
    item = "On the way " + words(rng, 12) + " near Tom " + words(rng, 14) + " with Tom " + words(rng, 6)
    numbers = "there are 3 red and 5 blue marbles inside the old box on the table near the door"
    rows = ["Intro. " + "Bob".join(item.rsplit("Tom", 1)), numbers.replace("3", "4").replace("5", "4"), words(rng, 60)]
    bench = spark.createDataFrame([(1, item), (2, numbers)], "item_id long, text string")
    out = {r["doc_id"]: r["items"] for r in decontaminate.report(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string"), bench).collect()}
    assert out == {0: [1], 1: [2]}
    hit = lambda k, a, b: (k, k, (a,), (b,))
    assert decontaminate.runs([hit(k, 1 if k < 4 else 2, 1) for k in range(6)], 3) == (4, True)
    assert decontaminate.runs([hit(k, 1 + k % 2, 1) for k in range(6)], 3) is None


def test_items_dense_in_slots_and_short_items_are_found(spark):
    rng = random.Random(12)
    items = ["Add 3 and 4 and 5 and 6 then 7 then 8 then 9 to 12", "Der Hund und Die Katze im Haus am See mit Hut und Schal", "Why do cats purr", "Maria walked to the old mill by noon", "1 2 3 4 5 6 7 8 9 10 11 12"]
    rows = [words(rng, 9) + " Question: " + item + ". " + words(rng, 9) for item in items] + [words(rng, 40), "Why do dogs purr", "2 3 4 5 6 7 8 9 10 11 12 13"[::-1]]
    docs = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    pairs = lambda **how: sorted((r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.matches(docs, bench, **how).collect())
    assert pairs() == pairs(broadcast_bytes=0) == [(k, k, True) for k in range(5)]


def test_dense_windows_do_not_break_a_run():
    hits = [(k, k, (k,), (k,)) for k in (0, 1, 5)]
    assert decontaminate.runs(hits, 3, (0, 1, 5, 6)) == (3, True)
    assert decontaminate.runs(hits, 3, (0, 1, 3, 5, 6)) is None
    assert decontaminate.runs(hits[:2], 3, (0, 1)) == (2, True)


def test_article_text(spark):
    page = "<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies on this site for many things.</div><article><h1>Head &amp; more</h1><p>One\n two&nbsp;<b>three</b>four.<p>Five.<script>if (a<b) {}</script><form>Send <input></form><section class='comments'>A reader says something long here.</section></article><aside>Related things to read</aside><footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<p>" + "plain text without an article " * 5), (5, "u", "<" * 50000)]
    out = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1]["text"] == "Head & more One two threefour. Five." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == out[3]["text"] == "" and out[None]["text"].startswith("plain text")
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_fits_its_pages():
    rows = [r for page in html_extract.PAGES for r in html_extract.labelled_blocks(page)]
    assert sum(html_extract.is_main(r[:-1]) == bool(r[-1]) for r in rows) >= 0.97 * len(rows)


def held_out_pages():
    """(html, main words) of layouts that the tree was not grown from, each with words of its own."""
    rng = random.Random(8)
    some = lambda n: words(rng, n)
    for k in range(24):
        main, page = [], []

        def keep(open_tag, n, close):
            text = some(n)
            main.append(text)  # noqa: B023
            page.append(open_tag + text + close)  # noqa: B023

        drop = lambda open_tag, n, close: page.append(open_tag + some(n) + close)  # noqa: B023, E731
        page.append("<html><head><title>" + some(5) + "</title></head><body>")
        drop("<nav><ul><li><a href=x>", 1, "</a></li><li><a href=y>" + some(2) + "</a></li></ul></nav>")
        if k % 3 == 0:
            drop("<div class='cookie consent'><p>", 18, "</p></div>")
        wrap = ["<article>", "<main id=content>", "<div class='entry-content'>", "<div>"][k % 4]
        page.append(wrap)
        keep("<h1>", 6, "</h1>")
        for j in range(rng.randint(3, 7)):
            keep("<p>", rng.randint(15, 90), "</p>")
            if j == 1 and k % 4 < 3:
                keep("<figure><img src=a><figcaption>", 8, "</figcaption></figure>")
            if j == 2 and k % 2:
                drop("<div class='ad-slot'>", 12, "</div>")
        keep("<h2 class='section-header'>", 3, "</h2>")
        keep("<p>", 40, "</p>")
        page.append("</" + wrap[1:].split()[0].strip(">") + ">")
        drop("<section class='comments'><p>", 35, "</p></section>")
        drop("<footer><p>", 9, "</p></footer>")
        yield "".join(page), " ".join(main).split()


def test_words_of_held_out_pages():
    from collections import Counter

    both = got = want = 0
    for page, main in held_out_pages():
        found = html_extract.main_text(page).split()
        both += sum((Counter(found) & Counter(main)).values())
        got, want = got + len(found), want + len(main)
    print(f"precision {both / got:.3f}, recall {both / want:.3f}")
    assert both / got >= 0.97 and both / want >= 0.97


def test_damaged_and_misleading_markup():
    long = "A plain sentence that goes on for a while so that it looks like the text of an article, nothing else. " * 2
    tidy = " ".join(long.split())
    text = lambda page: html_extract.main_text(page)
    assert text(f"<article><p>{long}<figure><figcaption>A caption here</figcaption></figure></article>") == f"{tidy} A caption here"
    assert text(f"<article><h2 class='post-header'>On it</h2><div class='related-work'><p>{long}</p></div></article>") == f"On it {tidy}"
    assert text(f"<article><svg><path d=x><p>{long}</p></article>") == tidy
    assert text(f"<article><p>{long}<a title=\"abc>link</a> <b class=\"x\">word</b></p></article>") == f"{tidy} link word"
    assert text(f"<article><p data-x='<b>no</b>' title=\"a > b\">{long}</p></article>") == tidy
    assert text(f"<article><header><h1>The title</h1></header><p>{long}</p></article>") == f"The title {tidy}"
    assert len(text("<article>" + '<a "  ' * 20000 + f"<p>{long}")) > 0


def test_languages(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "mo", "ti"], "bb": ["schu", "wen", "grat"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [(k, text("aa" if k % 2 else "bb", 30), "aa" if k % 2 else "bb", f"h{k % 2}") for k in range(200)] + [(900, "", None, "h1"), (901, None, None, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    pages = [(k, f"https://x{k % 2}.example.org/{'aa' if k % 2 else 'bb'}/p", f"<html lang='{'aa' if k % 2 else 'bb'}'><body><article><p>{text('aa' if k % 2 else 'bb', 25) if k < 40 else ''}</p></article>") for k in range(42)] + [(99, None, None)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = langid.identify(docs, pages).collect()
    assert len(out) == docs.count() + pages.count()
    by_doc = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    truth = {r["doc_id"]: r["lang"] for r in docs.filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()}
    assert truth and all(by_doc[i]["lang"] == want for i, want in truth.items())
    assert by_doc[900]["lang"] == "aa"  # no words: the prior of its host
    by_page = {r["page_id"]: r["lang"] for r in out if r["page_id"] is not None}
    assert by_page[40] == "bb" and by_page[41] == "aa" and by_page[99] is not None  # markup, address and host decide
    assert langid.identify(docs.limit(0), pages.limit(0)).count() == 0


def test_declared_language_behind_a_long_comment_and_other_ids(spark):
    docs = spark.createDataFrame([(f"d{k}", "ka mo ti " * 9 if k % 2 else "schu wen grat " * 9, "aa" if k % 2 else "bb", "h") for k in range(40)], "doc_id string, text string, lang string, source string")
    pages = [(f"p{k}", None, f"<html {'x' * 9000}='1' lang='{'aa' if k % 2 else 'bb'}'>" + ("<article><p>" + ("ka mo ti " if k % 2 else "schu wen grat ") * 9 if k < 30 else "")) for k in range(32)]
    pages += [pages[0], ("c", None, "<!--" + "-" * 6000 + "><!-- --><html lang=bb>")]
    pages = spark.createDataFrame([(*p, 1.0, "z") for p in pages], "page_id string, url string, html string, ll double, host string")
    out = [r for r in langid.identify(docs, pages).collect() if r["page_id"]]
    assert len(out) == 34 and sum(r["page_id"] == "p0" for r in out) == 2
    by = {r["page_id"]: r["lang"] for r in out}
    assert (by["p30"], by["p31"], by["c"]) == ("bb", "aa", "bb")


def test_rare_languages_keep_their_trigrams(spark):
    docs = [(k, "ka mo ti " * 5, "aa", "h") for k in range(3000)] + [(10_000 + k, "schu wen grat " * 5, "bb", "h") for k in range(8)]
    langs, names, table, floor = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), "doc_id", "text", "lang")
    assert langs == ["aa", "bb"] and " sc" in names and table[names.index(" sc"), 1] > floor[1]


def test_bytes_that_are_no_text_and_names_that_clash(spark):
    bad = "cast(concat(encode('<article><p>you idiot ', 'UTF-8'), X'FFFE') AS string)"
    table = spark.sql(f"SELECT 1L AS doc_id, {bad} AS text, 2L AS page_id, 'u' AS url, {bad} AS html, 0.5D AS score, 'x' AS id, 'en' AS lang, 's' AS source, true AS held_out")
    docs, labels = labelled(spark, 300)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(table, model).count() == 1
    assert toxicity.clean(table.withColumn("text", F.lit("fine words")), model).columns == table.columns
    assert html_extract.extract_pages(table).first()["text"] == "you idiot \ufffd\ufffd"
    assert langid.identify(table, table).count() == 2


def test_repeated_ids_leave_the_sample_bounded(spark, monkeypatch):
    docs, labels = labelled(spark, 300)
    many = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 100)
    rows = toxicity.labelled(many, labels, "doc_id", "text")
    assert 60 < rows.count() <= 100
    assert sorted(map(str, rows.collect())) == sorted(map(str, toxicity.labelled(many.repartition(7), labels, "doc_id", "text").collect()))


def test_the_shuffled_path_writes_only_what_may_be_the_benchmarks(spark):
    """Short items are asked for by the filter too: of 25,000 clean words nothing but a few false positives is written."""
    rng = random.Random(6)
    items = ["Why do cats purr", "one two", "Maria walked to the old mill by noon", "How far is the moon from here"]
    docs = spark.createDataFrame([(k, words(rng, 5000)) for k in range(5)] + [(9, "Say: why do cats purr")], "doc_id long, text string")
    src = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.xxhash64("doc_id", "text").alias("r"), "text")
    bench = decontaminate.benchmark_items(spark.createDataFrame([*enumerate(items)], "item_id long, text string"), "item_id", "text")
    cut, ask = decontaminate.benchmark_windows(bench, decontaminate.WINDOW)
    lengths = sorted(r[0] for r in ask.filter("whole > 0").select("whole").distinct().collect())
    assert len(lengths) > 2 and decontaminate.asked(src, cut, lengths, decontaminate.WINDOW).count() < 100


def test_wrappers_and_names_of_parts_do_not_hide_the_article():
    """Forms and widgets around the page, class names that only look like asides, buttons in sentences; asides stay out."""
    some = lambda n, mark="KEEP": f"{mark} " + " ".join("some plain words of a page that say things".split()[k % 8] for k in range(n))
    nav, foot = "<nav><a href=/a>Home</a> <a href=/b>More things</a></nav>", f"<footer><p>{some(9, 'DROP')}</p></footer>"
    comments = f"<div class='comments'><p>{some(80, 'DROP')}</p><p>{some(80, 'DROP')}</p></div>"
    pages = [
        f"<body><form action=x>{nav}<h1>{some(5)}</h1><p>{some(60)}</p><p>{some(50)}</p><input>{foot}</form></body>",
        f"<body><form><div class='sidebar'>{some(20, 'DROP')}</div><div><p>{some(60)}</p><p>{some(50)}</p></div></form></body>",
        f"<body><div class='widget-content'><p>{some(150)}</p></div></body>",
        f"<article><p>{some(60)}</p><section class='social-movements'><p>{some(40)}</p></section><div class='tasting-menu'><p>{some(30)}</p></div><blockquote class='comment'>{some(20)}</blockquote></article>{foot}",
        f"<article><p>{some(60)} <button>KEEP press</button> {some(3)}</p>{comments}</article>",
        f"{nav}<div><h1>KEEP x</h1><p>{some(40)}</p></div><div class='comment-list'><p>{some(80, 'DROP')}</p><p>{some(80, 'DROP')}</p></div><div class='cookie-notice'>{some(30, 'DROP')}</div>{foot}",
        f"{nav}<div class='cookie-notice'><p>{some(25, 'DROP')}</p></div><form><p>{some(12, 'DROP')}</p><input></form>{foot}",
    ]
    for page in pages:
        text = html_extract.main_text(page).split()
        assert (text.count("KEEP"), text.count("DROP")) == (page.count("KEEP"), 0), page
