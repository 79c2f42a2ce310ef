"""Trained operators, HTML extraction and the pipeline."""

from __future__ import annotations

import math
import random
import zlib

import pytest

from tessera.llm import common, entry, html_text, language, packing, pii, simhash, toxicity
from tests.conftest import SF
from tests.llm.conftest import got

SF1 = "/root/testdata/sf0.01"


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_suffix_automaton_knows_substrings():
    rng = random.Random(2)
    text = [rng.randrange(3) for _ in range(60)]
    nexts = language.suffix_automaton(text)
    subs = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(2000):
        word = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 8)))
        state = 0
        for c in word:
            state = nexts[state].get(c) if state is not None else None
        assert (state is not None) == (word in subs)


def plain_phrases(text: str, training: list[str], block: int) -> int:
    """Greedy longest matches, block by block."""
    letters = lambda t: "".join(chr(c) for c in language.code_points(t))
    known, text, count = [letters(t) for t in training], letters(text), 0
    for at in range(0, max(1, len(text)), block):
        part, i = text[at : at + block], 0
        count += not part
        while i < len(part):
            j = i + 1
            while j <= len(part) and any(part[i:j] in t for t in known):
                j += 1
            i = max(i + 1, j - 1)
            count += 1
    return count


def first_unknown(text: str, training: tuple) -> int:
    """A block that begins with a letter of no training text has an empty phrase before it."""
    letters = "".join(chr(c) for c in language.code_points(text))
    known = {c for t in training for c in map(chr, language.code_points(t))}
    return sum(letters[i] not in known for i in range(0, len(letters), 16))


def test_cross_parsing_counts():
    training = (("aa", ("the cat sat on the mat", "a dog!")), ("bb", ("der hund sitzt", "eine katze")))
    parser = language.CrossParser(training, 16)
    texts = ["the cat", "der hund sitzt auf der matte", "x", "你好 the", "", "The CAT... 12 sat"]
    counts, _ = parser.phrases(texts)
    for row, text in zip(counts, texts):
        for n, (_, known) in zip(row, training):
            assert n == plain_phrases(text, list(known), 16) + first_unknown(text, known)


def test_language_model_of_many_letters_is_small():
    """20 languages of 10,000 letters: memory follows the sample, and lookups find just what is there."""
    rng = random.Random(6)
    training = tuple((f"l{k:02}", ("".join(chr(0x4E00 + rng.randrange(10000)) for _ in range(20000)),)) for k in range(20))
    parser = language.CrossParser(training, 16)
    assert sum(t.keys.nbytes + t.targets.nbytes for t in parser.automata) < 100_000_000
    text = training[7][1][0][300:340] + "x" + training[8][1][0][:20]
    counts, _ = parser.phrases([text])
    for k in (7, 8, 9):
        assert counts[0][k] == plain_phrases(text, list(training[k][1]), 16) + first_unknown(text, training[k][1])
    assert language.CrossParser((("aa", ("b",)),)).predict(["b" * 10**6, None])[0] == ["aa", "und"]


def test_language_reads_texts_in_pieces():
    """The same predictions, whatever is read at a time; slices of a batch by their bytes."""
    import pyarrow as pa

    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
    known = language.CrossParser((("aa", (" ".join(word("abcde") for _ in range(300)),)), ("bb", (" ".join(word("defgh") for _ in range(300)),))), 16)
    texts = [" ".join(word(rng.choice(["abcde", "defgh"])) for _ in range(rng.choice([1, 3, 40, 900]))) for _ in range(60)] + [None, "", "12", "e" * 17]
    want = known.predict(texts)
    assert {*want[0]} == {"aa", "bb", "und"}
    for piece in (1, 16, 50, 1000):
        assert known.predict(texts, piece) == want
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n >= 0 else None for n in (3, -1, 5, 20, 1, 1, 1, 1)])], ["text"])
    assert [s.num_rows for s in common.slices_by_size(batch, 0, rows=3, size=9)] == [3, 1, 3, 1]


def test_null_ids_are_never_held_out(spark):
    docs = spark.createDataFrame([(None, "some text"), (1, "more text")], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    assert {(r["doc_id"], r["held_out"]) for r in language.predictions(docs).collect()} == {(None, False), (1, held(1))}
    assert {(r["doc_id"], r["held_out"]) for r in toxicity.score(docs, labels).collect()} == {(None, False), (1, held(1))}


def test_language(spark, docs, empty):
    table = common.table(spark, SF1, "documents")
    out = language.predictions(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == table.count() and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in out)
    tested = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in tested) >= 0.97 * len(tested)
    found = {(r["text"], r["__lang_pred"]) for r in language.identify(docs).collect()}
    assert (None, "und") in found and ("", "und") in found and ("!!! ### 123 …", "und") in found and ("a b c", "en") in found
    assert language.predictions(empty).count() == 0
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    unlabelled = docs.withColumn("lang", docs["source"].substr(5, 1).cast("string")).replace("", None, "lang")
    assert {r["lang_pred"] for r in language.predictions(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("words", [1, 900])
def test_language_learns_from_texts_of_any_length(spark, words):
    """Only labelled texts under 20 characters, or only ones over 2,000 that begin without a letter."""
    own = {"aa": ["maru", "tesilo", "kano"], "bb": ["grxth", "wolz", "dwingf"]}
    rng = random.Random(3)
    texts = [(i, "aabb"[i % 2 * 2 :][:2]) for i in range(80)]
    rows = [(i, "12 " * words + " ".join(rng.choice(own[lang]) for _ in range(words)), lang) for i, lang in texts]
    table = spark.createDataFrame([*rows, *rows[:2] * 200, (98, None, "cc"), (99, "1 2", "cc")], "doc_id long, text string, lang string")
    assert {len(t) < 20 for _, t, _ in rows} == {words == 1} and {len(t) > 2000 for _, t, _ in rows} == {words > 1}
    learned = language.training_texts(table)
    assert set(learned) == {"aa", "bb"}
    whole = {k: sum(min(2000, len(t) - 3 * words) for i, t, lang in rows if lang == k and not held(i)) for k in learned}
    for k, found in learned.items():
        assert all(0 < len(t) <= 2000 for t in found) and min(whole[k], 20_000) <= sum(map(len, found)) < 22_000
    pred = {r["doc_id"]: r["lang_pred"] for r in language.predictions(table).collect()}
    assert all(pred[i] == lang for i, _, lang in rows) and pred[98] == pred[99] == "und"
    assert language.keep_identified(table).count() == len(rows) + 400


def test_prediction_ignores_labels_it_must_not_see(spark):
    """Held-out labels and the label columns of scored rows change nothing."""
    from pyspark.sql import functions as F

    table = common.table(spark, SF, "documents")
    other = table.withColumn("lang", F.when(common.fold(F.col("doc_id")) == 2, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    columns = ("doc_id", "lang_pred", "score")
    assert got(language.predictions(table), *columns) == got(language.predictions(other), *columns)
    labels = common.table(spark, SF, "labels")
    turned = labels.withColumn("toxic", F.when(common.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert got(toxicity.score(table, labels), "doc_id", "score") == got(toxicity.score(table, turned), "doc_id", "score")


def test_toxicity(spark, docs, empty):
    table, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    out = toxicity.score(table, labels).join(labels, "doc_id").collect()
    tested = [r for r in out if r["held_out"]]
    hits = sum(r["predicted"] and r["toxic"] for r in tested)
    print("toxicity held out: recall", hits / sum(r["toxic"] for r in tested), "precision", hits / sum(r["predicted"] for r in tested))
    assert hits >= 0.7 * sum(r["toxic"] for r in tested) and hits >= 0.7 * sum(r["predicted"] for r in tested)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    small = toxicity.score(docs, labels.limit(0)).collect()
    assert len(small) == docs.count() and {r["score"] for r in small} == {0.0}
    assert toxicity.score(empty, labels).count() == 0


def plain_kneser_ney(texts: list[tuple[int, str]], order: int):
    """p(class, character, context) of interpolated Kneser-Ney, from the definition."""
    d, seen = toxicity.DISCOUNT, [{}, {}]
    for toxic, text in texts:
        for word in text.lower().split():
            padded = " " * (order - 1) + word + " "
            for i in range(len(word) + 1):
                gram = padded[i : i + order]
                seen[toxic][gram] = seen[toxic].get(gram, 0) + 1
    kinds = {order: set(seen[0]) | set(seen[1])}
    for size in range(order - 1, 0, -1):
        kinds[size] = {g[1:] for g in kinds[size + 1]}
    letters = sorted(kinds[1])

    def interpolated(counts, c, lower):
        total, n = sum(counts.values()), sum(1 for v in counts.values() if v)
        return (max(counts.get(c, 0) - d, 0) + d * n * lower) / total if total else lower

    def shared(c, h):
        lower = shared(c, h[1:]) if h else 1 / (len(letters) + 1)
        return interpolated({x: sum(g[1:] == h + x for g in kinds[len(h) + 2]) for x in letters if h + x in kinds[len(h) + 1]}, c, lower)

    def p(toxic, c, h):
        return interpolated({x: seen[toxic].get(h + x, 0) for x in letters}, c, shared(c, h[1:]))

    return p, letters, seen


def test_kneser_ney_is_a_distribution(spark):
    texts = [(0, "aab abb ab"), (0, "abc aab ba"), (1, "cab cab abb"), (1, "bac")]
    p, letters, seen = plain_kneser_ney(texts, 3)
    df = spark.createDataFrame(texts, "toxic int, text string")
    counted = toxicity.count_grams(toxicity.count_words(df), 3).cache()
    assert {(r["gram"], r["ordinary"], r["toxic"]) for r in counted.collect()} == {(g, seen[0].get(g, 0), seen[1].get(g, 0)) for g in seen[0] | seen[1]}
    totals = toxicity.context_totals(counted, 3)
    found = toxicity.probabilities(counted, totals, toxicity.shared_backoff(counted, 3), 3).collect()
    assert len(found) == counted.count()
    for r in found:
        assert r["p_ordinary"] == pytest.approx(p(0, r["gram"][2], r["gram"][:2])) and r["p_toxic"] == pytest.approx(p(1, r["gram"][2], r["gram"][:2]))
    for h in {g[:2] for g in seen[0] | seen[1]} | {"xx"}:
        for toxic in (0, 1):  # "?" stands for all characters never seen
            assert sum(p(toxic, c, h) for c in [*letters, "?"]) == pytest.approx(1)
    contexts = toxicity.model(counted, 3)
    of = lambda word: sum(math.log(p(1, g[2], g[:2]) / p(0, g[2], g[:2])) for g in toxicity.grams(word, 3))
    vocabulary = ["cab", "abb", "bac", "zzz", "abz", "a", "c\U0001f600b", "bbbbbb"]
    ratios = {r["word"]: r["ratio"] for r in toxicity.word_ratios(spark.createDataFrame([(w,) for w in vocabulary], "word string"), contexts, 3, 7).collect()}  # chunks of one or two words
    assert set(ratios) == set(vocabulary) and all(ratios[w] == pytest.approx(of(w)) for w in vocabulary)

    def plain(text):
        kinds = toxicity.words(text)
        each = sorted(of(w) / (len(w) + 1) for w in set(kinds))[-3:]
        return (sum(map(of, kinds)) / sum(len(w) + 1 for w in kinds), each[-1], sum(each) / 3) if kinds else (0, 0, 0)

    many = ["", " ", "cab cab abb", "a", "zz a cab bac abb cab", "C\U0001f600B cab", "ab " * 500, *[f"{w} x{i} cab" for i, w in enumerate(vocabulary)], "ab " * 500]
    rows = spark.createDataFrame(list(enumerate(many)) + [(None, "cab")], "doc_id long, text string").repartition(2)
    for size, held in ((1, 0), (300, 0), (toxicity.BLOCK, 0), (1, 10**6), (300, 10**6)):  # a text is a block of its own, or shares one; the model is joined or at hand
        for r in toxicity.figures(rows, contexts, 3, size, held).collect():
            assert (r["whole"], r["most"], r["three"]) == pytest.approx(plain("cab" if r["doc_id"] is None else many[r["doc_id"]]))
    assert toxicity.figures(rows, contexts, 3).count() == len(many) + 1


def test_toxicity_counts_grow_and_the_sample_does_not(spark):
    """Texts over any length are learned from; rows that repeat an id are in the regression's sample once."""
    long = "nasty " * 3000
    rows = [(i, (long if i % 2 else "kindly " * 3000) + str(i)) for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:3] * 100], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels, rows=4).collect()
    assert len(out) == docs.count() and all(r["predicted"] == r["doc_id"] % 2 for r in out)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="home with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and this is a long notice about them that nobody reads.</p></div>
<main><article><h2>Title &amp; more</h2><p>First   para&shy;graph with <b>bold</b> text<br>and a\tbreak.<p>Second one, &lt;tag&gt; &eacute;.<div class="ad">Buy this</div>
<form><input><button>Go</button></form><blockquote>Quote</blockquote><aside>More links</aside><p>End.</p></article><section class="comments"><p>Nice article, thanks a lot for writing it!</p></section></main>
<footer>&copy; me</footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "Title & more\nFirst para­graph with bold text and a break.\nSecond one, <tag> é.\nQuote\nEnd."


def test_html_hidden_elements_are_no_text():
    page = "<body><article><p>A sentence that is long enough to be read.</p><p {}>Not this one, although it is long as well.</p><p>And another sentence after it.</p></article></body>"
    want = "A sentence that is long enough to be read.\nAnd another sentence after it."
    for mark in ("hidden", "hidden=''", "hidden=until-found", "class=x hidden", "aria-hidden=true", "style='display: none'"):
        assert html_text.main_text(page.format(mark)) == want
    assert html_text.main_text(page.format("class=hiding")).count("\n") == 2


def test_html_without_article():
    links = "".join(f"<a href=/{i}>Link {i}</a> " for i in range(30))
    long = "<p>" + "A long sentence of the main text goes here. " * 8 + "</p>"
    text = html_text.main_text(f"<body><div id=top-menu>{links}</div><div>{links}</div><div><h1>Head</h1>{long}<p>Short.</p>{long}</div><div>{links}</div></body>")
    assert text.startswith("Head\nA long sentence") and "Short." in text and "Link" not in text


STORY = "<p>" + "A long sentence of the main text goes here. " * 8 + "</p>"


@pytest.mark.parametrize("body", [f"<div><h1>Head</h1>{STORY}{STORY}</div>", f"<article><h1>Head</h1>{STORY}{STORY}</article>"])
@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><script>x</script><body>{}</body></html>",
        "<html><head><meta charset=utf-8><title>T</title>{}</html>",
        "<body><form id=aspnetForm method=post role=form><input type=hidden>{}</form></body>",
        "<body><div class='page with-sidebar'>{}</div></body>",
        "<body><div id=wrap class=no-sidebar><main class=has-banner><div class=has-banner>{}</div></main></div></body>",
    ],
)
def test_html_elements_around_the_page_are_no_furniture(page, body):
    more = "<div class=sidebar><p>Some other words.</p></div><div class=related><article><p>Read on there.</p></article></div>"
    want = html_text.main_text(f"<body>{body}</body>")
    assert want.startswith("Head\nA long") and want.count("A long sentence") == 16
    assert html_text.main_text(page.format(body)) == want == html_text.main_text(page.format(body + more))


def test_html_furniture_that_holds_much_stays_furniture():
    comments = f"<section class=comments>{STORY * 3}</section>"
    for page in ("<body>{}</body>", "<body><form>{}</form></body>", "<main>{}</main>"):
        assert html_text.main_text(page.format("<article><p>A short article, of one sentence only.</p></article>" + comments)) == "A short article, of one sentence only."
    text = html_text.main_text(f"<head><title>No</title><noscript><img src=x>No</noscript></head><div>{STORY}</div><div class=related><article><p>Read on.</p></article></div>")
    assert text.startswith("A long") and "No" not in text and "Read on" not in text


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "<!-- x", "<script>var x", "plain text", "&amp", "<div><div></p></article>", "<p>a" * 3000, "<" * 5000, "\x00<p>퟿"])
def test_html_odd(html):
    assert isinstance(html_text.main_text(html), str)


def plain_article(page: str) -> str:
    """The article of a page of the test tables, whose articles hold h1, p, b and br alone."""
    import html
    import re

    blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", page, re.S)[1])
    found = (" ".join(html.unescape(b.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for b in blocks)
    return "\n".join(t for t in found if t)


def test_html_on_the_pages_table(spark):
    """Whole texts against a plain version."""
    rows = common.table(spark, SF1, "pages").collect()
    want = sorted((r["page_id"], plain_article(r["html"])) for r in rows)
    assert sorted((r["page_id"], r["text"]) for r in html_text.extract(common.table(spark, SF1, "pages")).collect()) == want


def test_html_threshold_decides_within_articles():
    """Lists of links go, short lines and a single line of links stay; an article without content is none."""
    menu = "<ul>" + "".join(f"<li><a href=/{i}>More {i}</a></li>" for i in range(12)) + "</ul>"
    page = f"<body><article><h1>Head</h1>{STORY}<p>Short.</p>{STORY}{menu}{STORY}<p><a href=/x>Source</a></p></article><article>{menu}<p>x</p></article></body>"
    text = html_text.main_text(page)
    assert text.count("A long sentence") == 24 and "Head\n" in text and "\nShort.\n" in text and text.endswith("\nSource") and "More" not in text


@pytest.mark.parametrize("unit", ["<div><p></p>", "<div class=ad>x", "<article>x", "<p>a", "<", "<a ", "<!--", "&", "&#1", "</", "<p a='", "<script>", "<![CDATA[", "<?"])
def test_html_takes_linear_time(unit):
    """Five megabytes of any of these in seconds, not hours; pages cut off within markup."""
    import time

    begin = time.time()
    html_text.main_text("<p>Begin " + unit * (5_000_000 // len(unit)))
    assert time.time() - begin < 60


def test_html_broken_markup_is_no_text():
    assert html_text.main_text("<p>one <!-- x --> two<!--> three <b") == "one two three"
    assert html_text.main_text("<p>x<![if !IE]>y<![endif]>z") == "xyz"
    assert html_text.main_text("<p>a &#" + "1" * 6000 + "; &#" + "0" * 6000 + "65;b") == "a \ufffd Ab"


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "", 7)], "page_id long, url string, html string, text long")
    out = html_text.extract(pages)
    assert out.count() == 4 and sorted(r["n_chars"] for r in out.collect())[:2] == [0, 0] and html_text.extract(pages.limit(0)).count() == 0


def test_exact_dedup_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF1}/documents.parquet'")
    want = sorted(duckdb.sql(entry.oracle_sql()["op6_exact_dedup"]).fetchall())
    assert sorted(tuple(r) for r in entry.op6_exact_dedup(spark, SF1).collect()) == want


def test_pipeline(spark):
    """Each stage against a plain version of its own input."""
    import corpus_pipeline

    docs = common.table(spark, SF1, "documents")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        by[name] = docs = common.written(stage(spark, docs, SF1), name)
        assert name == "packing" or docs.columns == columns
    texts = {n: {r["doc_id"]: r["text"] for r in by[n].collect()} for n in names[:4]}
    source = {r["doc_id"]: r["text"] for r in common.table(spark, SF1, "documents").collect()}
    assert set(texts["language"]) == {i for i, t in source.items() if t and any(map(str.isalpha, t))}
    first: dict[str, int] = {}
    for i, t in sorted(texts["language"].items()):
        first.setdefault(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert set(texts["exact_dedup"]) == set(first.values())
    fps = {i: simhash.simhash(t) for i, t in texts["exact_dedup"].items()}
    from tests.llm.test_texts import base_spans, plain_components

    label = plain_components(list(fps.values()))
    least: dict[int, int] = {}
    for i, f in fps.items():
        least[label[f]] = min(i, least.get(label[f], i))
    assert set(texts["near_dedup"]) == set(least.values())
    assert set(texts["pii"]) == set(texts["near_dedup"])
    found = {r["doc_id"]: r["spans"] for r in pii.detect(by["near_dedup"]).collect()}
    for i, text in texts["near_dedup"].items():
        spans = [(s["start"], s["end"], s["kind"]) for s in found[i]]
        assert {(a, b, kind) for a, _, b, kind in base_spans(text)} <= set(spans)
        out, at = "", 0
        for start, end, kind in spans:
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert texts["pii"][i] == out + text[at:]
    assert sum(r["length"] for r in by["packing"].collect()) == sum(len(packing.tokens.encoding().encode_ordinary(t)) + 1 for t in texts["pii"].values())
    assert pii.KINDS[:4] == pii.BASE
