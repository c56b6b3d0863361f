"""Language identification, HTML extraction and secret scanning: held-out accuracy and cases."""

import hashlib
import html
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SF
from voxlake.llm import html_extraction, language_id, secret_scan
from voxlake.llm.queries import QUERIES

SF_MORE = "/root/testdata/sf0.01"


def documents(spark, rows):
    extra = "source string, score double, lang_pred string, held_out int, place int, label int, word string"
    return spark.createDataFrame(
        [(*r, "s", 0.0, "p", 1, 2, 3, "w") for r in rows], f"doc_id long, text string, lang string, {extra}"
    )


# --- languages -------------------------------------------------------------------------


def test_language_query_on_held_out_documents(spark):
    got = QUERIES["op4_language_id"](spark, SF_MORE)
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred == r.languages[0]
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    columns = ["doc_id", "lang_pred", "score"]
    one = language_id.identify_languages(docs).select(columns).collect()
    two = language_id.identify_languages(wrong).select(columns).collect()
    assert sorted(one) == sorted(two)


def test_mixture_shares(spark):
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    model = language_id.fit(docs)
    letters = np.unpackbits(model.letters).astype(bool)
    long = {r.lang: r.text for r in docs.where("n_chars > 4000").orderBy("doc_id").collect()}
    assert len(long) >= 3
    for a in long:
        alone = language_id.infer(language_id.trigrams(long[a][:4000], letters), model)
        assert alone[0][0] == a and alone[0][1] > 0.95
        for b in long:
            if a == b:
                continue
            text = long[a][:3000] + " " + long[b][:1000]
            shares = dict(language_id.infer(language_id.trigrams(text, letters), model))
            assert shares[a] == pytest.approx(0.75, abs=0.12)
            assert shares[b] == pytest.approx(0.25, abs=0.12)


def test_shares_maximise_the_likelihood():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(30), size=3).T
    counts = rng.multinomial(5000, p @ [0.5, 0.3, 0.2]).astype(float)
    share, best = language_id._shares(p, counts)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0.01, 0.98, 60) for b in np.linspace(0.01, 0.98 - a, 20) if a + b < 0.99]
    assert share.sum() == pytest.approx(1)
    assert best >= max(float(counts @ np.log(p @ np.array(g))) for g in grid) - 0.5


def test_odd_texts(spark):
    rows = [(i, "le chat et la souris dans la maison " * 5, "fr") for i in range(0, 40, 2)]
    rows += [(i, "the cat and the mouse in the house " * 5, "en") for i in range(1, 40, 2)]
    rows += [(90, None, "fr"), (91, "", None), (92, "12 34 !! ??", "en"), (93, "the " * 100_000, None),
             (94, "the cat", None), (94, "the cat", None), (None, "la maison", None), (95, "日本語", None)]
    got = {}
    for r in language_id.identify_languages(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.held_out))
    for i in (90, 91, 92):
        assert got[i] == [("und", 0.0, zlib.crc32(str(i).encode()) % 4 == 2)]
    assert got[93][0][0] == "en" and len(got[94]) == 2 and got[94][0][0] == "en"
    assert got[None] == [("fr", got[None][0][1], False)]
    assert got[95][0][0] in ("fr", "en")
    kept = language_id.with_language(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert kept.count() == len(rows) - 3


def test_no_labels_and_no_rows(spark):
    assert language_id.identify_languages(documents(spark, [])).collect() == []
    (r,) = language_id.identify_languages(documents(spark, [(1, "a b", None)])).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)


# --- pages ---------------------------------------------------------------------------------


def truth(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", article)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def test_pages_query(spark):
    got = {r.page_id: r for r in QUERIES["op7_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got[r.page_id].url == r.url
        assert got[r.page_id].text == truth(r.html)
        assert got[r.page_id].n_chars == len(truth(r.html))


@pytest.fixture(scope="module")
def weights(spark):
    return html_extraction._learned(spark.read.parquet(f"{SF}/pages.parquet"), 2_000)


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>The title of it</title>{head}</head><body>{body}</body></html>"


WORDS = "This paragraph has a good number of words in it, as those of an article have."


@pytest.mark.parametrize("body, want", [
    # No article element: the weights alone find the content.
    (f"<nav><a href=x>Home page of us</a></nav><div id=x><h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p></div>"
     "<footer>All rights are reserved by us</footer>", f"Head\n{WORDS}\n{WORDS}"),
    # What stands inside the content but is not the article.
    (f"<article><p>{WORDS}</p><aside>Read this as well</aside><div class='ad box'>Buy it now</div>"
     f"<form><p>Subscribe to us</p></form><script>var x = '<p>no</p>';</script><style>p{{}}</style><p>{WORDS}</p></article>"
     "<section id='comments'><p>I like this page a lot, thank you for it all</p></section>", f"{WORDS}\n{WORDS}"),
    # Broken markup, references and white space.
    (f"<article><p>A &amp; B &lt;c&gt; &eacute;&#233;&#xe9; &copy\n\n  and <b>bold<p>{WORDS}<br>next  line</article>",
     f"A & B <c> ééé © and bold\n{WORDS} next line"),
    (f"<article><!-- <p>not this</p> --><ul><li>One item of it<li>Two items of it</ul><p>{WORDS}</article>",
     f"One item of it\nTwo items of it\n{WORDS}"),
    ("", ""), ("   ", ""), ("<p></p><script>x</script>", ""),
])
def test_pages(weights, body, want):
    assert html_extraction.main_text(page(body), *weights) == want


BODY = f"<h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p>"


@pytest.mark.parametrize("body", [
    f"<div class='no-sidebar'>{BODY}</div>", f"<article class='post ad-free'>{BODY}</article>",
    f"<article class='widget'>{BODY}</article>", f"<main class='content-with-comments'>{BODY}</main>",
    f"<div class='widget'><article>{BODY}</article></div>", f"<main id='share'><div>{BODY}</div></main>",
    f"<div data-id='ad' data-role='banner'>{BODY}</div>", f"<form><article>{BODY}</article></form>",
    f"<form action=x><div>{BODY}</div></form><form><p>Subscribe to us</p></form>",
    f"<main><article>{BODY}</article><section class='comments'><article><p>I like it</p></article></section></main>",
    f"<aside><article><p>Read this too</p></article></aside><article>{BODY}</article>",
])
def test_containers_are_not_hidden(weights, body):
    for around in ("<html><body class='home has-sidebar'>{}</body></html>", "<html id=widget><body class=ad>{}</body></html>"):
        assert html_extraction.main_text(around.format(body), *weights) == f"Head\n{WORDS}\n{WORDS}"


@pytest.mark.parametrize("mark", [
    "class='post-comments'", "id='comment-list'", "class='sidebar--left'", "class='cookie-notice'", "class='box ad-slot'",
    "class='site-footer'", "id=main_navigation", "class='Related-Posts'", "class='widget-area'", "role=complementary",
])
def test_longer_names_mark_what_is_not_the_article(weights, mark):
    other = f"<div {mark}><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p></div>"
    assert html_extraction.main_text(page(f"<article>{BODY}{other}</article>"), *weights) == f"Head\n{WORDS}\n{WORDS}"
    assert html_extraction.main_text(page(f"<article>{BODY}</article>{other}"), *weights) == f"Head\n{WORDS}\n{WORDS}"


@pytest.mark.parametrize("mark", [
    "with-sidebar", "post category-social tag-menu", "page sidebar-right", "builder-widget", "builder-widget-text",
    "layout--banner", "js-popup", "marketshare", "admin", "has-comments",
])
def test_names_about_the_page_hide_nothing(weights, mark):
    for body in (f"<div class='{mark}'>{BODY}</div>", f"<div class='{mark}'><article>{BODY}</article></div>"):
        assert html_extraction.main_text(page(body + "<p>Short</p>"), *weights).startswith(f"Head\n{WORDS}\n{WORDS}")


def test_equal_articles_in_marked_elements_are_kept():
    item = "<div class='widget'><article><p>One two three</p></article></div>"
    assert html_extraction.main_text(item * 3, {}, {"article": -0.1, "/article": -0.1, "div": -0.1, "/div": -0.1,
                                                    "p": -0.1, "/p": -0.1}) == "\n".join(["One two three"] * 3)


def test_best_region_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-5, 5, rng.integers(0, 15)).tolist()
        start, end = html_extraction.best_region(scores)
        best = max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        assert sum(scores[start:end]) == best


def test_odd_pages(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "no markup at all", "t"), (None, "u", "<p>x", "t"),
            (4, "u", "<article><p>" + "word " * 200_000 + "</p></article>", "t"), (5, "u", "<" * 2_000, "t"),
            (5, "u", "<a " * 2_000, "t"), (6, "u", "<p>a", "t"), (6, "u", "<p>a", "t")]
    schema = "page_id long, url string, html string, text string"
    got = html_extraction.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == by_id[2].text == "" and by_id[2].url is None
    assert by_id[3].text == "no markup at all" and by_id[4].n_chars == 999_999
    assert html_extraction.extract_pages(spark.createDataFrame([], schema)).collect() == []


# --- secrets -----------------------------------------------------------------------------------


LONG = 1_000_000


@pytest.mark.parametrize("page", [
    '<a b="c ', "<a b ", "<a b", "<article>x ", "<form>a ", "<script ", "<!--", "<a '\"><b", "class=' ", "<", "<div class=\"advert",
    "</a", "&", "<![", "<a\"'",
])
@pytest.mark.parametrize("end", ["", ">"])
def test_broken_pages_of_a_megabyte(page, end):
    start = time.time()
    html_extraction.main_text("<article>some words</article>" + page * (LONG // len(page)) + end, {}, {})
    assert time.time() - start < 20


@pytest.mark.parametrize("page, want", [
    ('<a title="x > y">z</a>', [(0, 17, "a"), (18, 22, "a")]),
    ('<a title="x >z</a> b', [(0, 13, "a"), (14, 18, "a")]),
    ("<a <b>", [(0, 6, "a")]), ("a < b <!-- <p> --> <p", [(6, 18, "")]), ("<style>a<b</style x></style >c", [(0, 29, "")]),
    ("x > <!-- no end", [(4, 15, "")]), ("<!doctype html><p/>", [(0, 15, ""), (15, 19, "p")]), ("1 < 2 > 0", []),
])
def test_markup(page, want):
    assert [(t.start, t.end, t.name) for t in html_extraction.markup(page)] == want


def test_candidates_of_odd_texts_of_a_megabyte(spark):
    rows = ["a" * LONG, "-" * LONG, "=" * LONG, "9" * LONG, "ab1" + "=" * LONG, ("-" * LONG) + "a", "key" + ":" * LONG + "x1" + "a" * 20,
            "key" + "!:" * (LONG // 2) + "," + "x1" + "a" * 20]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    start = time.time()
    out = secret_scan.scan_secrets(docs).collect()
    assert time.time() - start < 120
    assert {(r.doc_id, r.length) for r in out} == {(3, LONG), (4, LONG + 3), (6, 22), (7, 22)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ9+/_=-. \"", max_size=60))
def test_candidate_pattern(text):
    """Whole runs of such characters, of 16 and more, that hold a digit."""
    want = [m for m in re.findall("[A-Za-z0-9+/_=-]+", text) if len(m) >= 16 and re.search("[0-9]", m)]
    assert [m[0] for m in re.finditer(secret_scan.CANDIDATE, text)] == want


def test_secret_query(spark):
    """Every assigned token is found, no card number or digest is."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").collect()}
    got = QUERIES["op5_secret_scan"](spark, SF_MORE).collect()
    want = {i for i, t in docs.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
    assert {r.doc_id for r in got if r.secret} == want and want
    assert all(not r.secret for r in got if r.length == 16)


def test_forest_on_held_out_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = secret_scan.candidates(docs)
    labelled = secret_scan.labelled_findings(found)
    words = secret_scan.word_counts(docs)
    ready = secret_scan.features(
        labelled, secret_scan.dictionary(found, words), secret_scan.transitions(words)
    ).withColumn("kept_out", F.pmod(F.xxhash64("value"), F.lit(3)) == 0)
    model = secret_scan.train(ready.where("not kept_out"))
    judged = model.transform(ready.where("kept_out")).groupBy("label").agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right"), F.count("*").alias("n")
    ).collect()
    assert len(judged) == 2 and all(r.right > 0.97 and r.n > 30 for r in judged)


def test_word_statistics(spark):
    rows = [(1, "The cat, the CAT! a1 (dog)", None), (2, "cat\tdog\n", None), (3, None, None)]
    words = secret_scan.word_counts(documents(spark, rows))
    assert {r.word: r.n for r in words.collect() if r.word} == {"the": 2, "cat": 3, "dog": 2}
    pairs = {r.pair: r.surprise for r in secret_scan.transitions(words).collect()}
    assert set(pairs) == {"th", "he", "ca", "at", "do", "og"}
    assert pairs["ca"] == pytest.approx(-np.log2(3.5 / 21.5))


HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_neighbours_and_places(spark):
    rows = [(1, f'a {HEX}', None), (2, f'{HEX} b c', None), (3, f'a b c d {HEX} e {HEX}', None)]
    got = {(r.doc_id, r.place): (r.before, r.after) for r in secret_scan.candidates(documents(spark, rows)).collect()}
    assert got == {
        (1, 1): (["a"], ""), (2, 0): ([], "b"), (3, 4): (["b", "c", "d"], "e"), (3, 6): (["d", HEX, "e"], ""),
    }


def test_secrets_in_odd_documents(spark):
    rows = [(i, f'some words token = "{zlib.crc32(str(i).encode()):08x}{HEX[:32]}" and more', "en") for i in range(30)]
    rows += [(100 + i, f"in commit {HEX} of it", "en") for i in range(30)]
    rows += [(200, None, None), (201, "", None), (None, f"api_key: {HEX}", None), (202, "word " * 100_000 + HEX, None),
             (203, f'secret = "{HEX}"', None), (203, f'secret = "{HEX}"', None)]
    got = secret_scan.scan_secrets(documents(spark, rows)).collect()
    assert len(got) == 64
    secret = {r.doc_id for r in got if r.secret}
    assert secret >= set(range(30)) | {203, None} and not secret & set(range(100, 130))
    assert next(r.place for r in got if r.doc_id == 202) == 100_000


def test_secrets_without_candidates_or_with_one_class(spark):
    assert secret_scan.scan_secrets(documents(spark, [])).collect() == []
    assert secret_scan.scan_secrets(documents(spark, [(1, "no candidate", None)])).collect() == []
    got = secret_scan.scan_secrets(documents(spark, [(1, f"x {HEX}", None)])).collect()
    assert [(r.score, r.secret) for r in got] == [(0.0, False)]


def key(i):
    return hashlib.sha256(str(i).encode()).hexdigest()[:40]


@pytest.mark.parametrize("form, values", [
    ('{{"id":"{0}","secret":"{1}"}}', "01"), ('"api_key":"{1}"', "1"), ('token="{1}"', "1"),
    ("API_KEY={1}", "1"), ("--define=api_key={1}", "1"), ("a={0};password={1}", "01"),
    ("https://example.org/x?id={0}&access_token={1}", "01"), ('"my_long_s3_secret_key":"{1}"', "n1"),
    ("password=hunter2and99", "h"),
])
def test_candidates_inside_words(spark, form, values):
    meant = {"0": (key(0), 0), "1": (key(1), 1), "n": ("my_long_s3_secret_key", 0), "h": ("password=hunter2and99", 1)}
    found = secret_scan.candidates(documents(spark, [(1, "see " + form.format(key(0), key(1)) + " there", None)]))
    # The first rows are the findings, copies made from them follow.
    rows = secret_scan.labelled_findings(found).where("before = array('see')").collect()
    got = sorted({(r.nth, r.value, int(r.label)) for r in rows if r.word.count(r.value) and "/objects/" not in r.word
                  and not r.value.startswith("your_token")})
    assert got == [(k, *meant[v]) for k, v in enumerate(values)]


def test_secrets_inside_words(spark):
    forms = ['{{"id":"{0}","secret":"{1}"}}', "API_KEY={1}", "https://example.org/x?id={0}&access_token={1}"]
    rows = [(i, "see " + forms[i % 3].format(key(i), key(1000 + i)) + " there", None) for i in range(90)]
    got = secret_scan.scan_secrets(documents(spark, rows)).collect()
    assert len(got) == 150
    assert {r.value_sha256 for r in got if r.secret} == {hashlib.sha256(key(1000 + i).encode()).hexdigest() for i in range(90)}


def test_few_secrets_among_many_candidates(spark):
    """Two secrets in 20,000 candidates, far fewer than one in the sample by size alone."""
    rows = [(i, " ".join(f"see {key(f'{i} {k}')} there" for k in range(200)), None) for i in range(100)]
    rows += [(200 + i, f'then token = "{key(i)}" there', None) for i in range(2)]
    docs = documents(spark, rows)
    found = secret_scan.candidates(docs)
    sample = secret_scan.drawn(found, 50).groupBy(secret_scan.is_named().alias("label")).count().collect()
    sizes = {r["label"]: r["count"] for r in sample}
    assert sizes[1.0] == 2 and 20 < sizes[0.0] < 100
    for findings in (50, secret_scan.TRAIN_FINDINGS):
        got = secret_scan.scan_secrets(docs, findings=findings)
        assert sorted(r.doc_id for r in got.where("secret").collect()) == [200, 201]


def test_no_python_in_native_plans(spark):
    for name in ("op2_chat_formatting", "op5_secret_scan"):
        df = QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
