"""Licence scan, byte-level BPE, HTML extraction and chat formatting."""

import hashlib
import random
import re
import sys
from collections import defaultdict

import public_tokenizers
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rentlens.llm import bpe, chat, html, license, queries  # noqa: E402

PATH, PATTERN = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN


# ---- licences ----------------------------------------------------------------

def test_licence_query(spark):
    docs = helpers.rows(spark.read.parquet(f"{helpers.SF}/documents.parquet"), "doc_id", "text")
    want = helpers.licences(docs)
    got = queries.op2_license_scan(spark, helpers.SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licence_cases(spark):
    notice = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction")
    made = [(1, "Under the MIT License. x under-the-mit-license"), (2, None), (3, ""), (4, notice), (5, "Apache\nLicense, Version 2.0 " * 3),
            (6, "ACC BY NC cc by nc-sa"), (7, "é" * 10 + " under the mit licence"), (8, "the mit " * 30000 + "license"),
            (9, notice.replace("hereby granted", "not granted")), (1, "Under the MIT License. x under-the-mit-license")]
    df = spark.createDataFrame(made, "doc_id bigint, text string").withColumn("labels", F.lit(0)).withColumn("places", F.lit(0))
    got = {r["doc_id"]: r for r in license.license_summary(license.license_scan(df)).collect()}
    for d, want in helpers.licences(made).items():
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
    assert got[4]["labels"] == "mit" and got[4]["base_labels"] == "" and got[4]["score"] == 1
    assert got[9]["labels"] == "" and got[6]["labels"] == "cc-by-nc,cc-by-nc-sa"
    assert license.license_summary(license.license_scan(df.limit(0))).count() == 0


def test_licence_notice_with_changed_words_still_aligns():
    idf = {w: 1.0 + len(w) for t in license.NOTICES for w in t.text.encode().split()}
    text = next(t.text for t in license.NOTICES if t.name == "bsd-text").replace("provided that the", "if all")
    index = license.Index(license.NOTICES, idf)
    found = index.scan(license.words_of(b"Copyright X. " + text.encode()))
    assert {index.templates[n].label for n, _, _ in found} == {"bsd"} and all(0.8 < s < 1 for _, _, s in found)


# ---- BPE ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference):
    vocab = bpe.Vocabulary(PATH, PATTERN)
    rnd = random.Random(2)
    letters = "aab  \n\t\x0b\x1c\x1f\x85\xa0\u2003\u3000'stre'll1234,.!éß漢字🙂ÀИ\u200b\r\x00"
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert vocab.encode(text).tolist() == reference.encode_ordinary(text), repr(text)
    for text in ("", " ", "a" * 5000, "ab" * 3000, "".join(rnd.choice("abcdefgh") for _ in range(50000)), "<|endoftext|>", " \n" * 3000):
        assert vocab.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_of_a_text_longer_than_a_stretch(reference):
    vocab = bpe.Vocabulary(PATH, PATTERN)
    text = "The word  is\n" * 120_000
    assert vocab.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_query(spark, reference):
    docs = helpers.rows(spark.read.parquet(f"{helpers.SF}/documents.parquet"), "doc_id", "text")
    want = {d: reference.encode_ordinary(t) for d, t in docs}
    texts = dict(docs)
    got = queries.op3_bpe(spark, helpers.SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), helpers.sha(" ".join(map(str, ids))), helpers.sha(texts[r["doc_id"]]))


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "x y"), (3, "x y")], "doc_id bigint, text string")
    df = df.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    got = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == [b"", b"", b"x y", b"x y", b"x y"]
    assert {r["n_tokens"] for r in bpe.token_digests(bpe.decode(bpe.encode(df.where("text is null"), PATH, PATTERN), PATH)).collect()} == {0}
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0
    bad = spark.createDataFrame([(1, [10 ** 6])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception):
        bpe.decode(bad, PATH).collect()


# ---- HTML --------------------------------------------------------------------

def article(source):
    """Blocks of the article element of a test page, by plain regular expressions."""
    import html as entities
    inner = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n\n".join(filter(None, (" ".join(entities.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in blocks)))


def test_html_query(spark):
    pages = helpers.rows(spark.read.parquet(f"{helpers.SF}/pages.parquet"), "page_id", "url", "html")
    got = {r["page_id"]: r for r in queries.op9_html(spark, helpers.SF).collect()}
    assert len(got) == len(pages)
    for i, url, source in pages:
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, article(source), len(article(source)))


def test_html_cases(spark):
    body = "<p>A first &amp; long   paragraph of the\n story with many words in it.</p><p>A second&nbsp;one<br>with a <a href='x'>link</a> inside, and more.</p>"
    page = ("<html><head><title>T</title><script>if (a < b) x('<p>no</p>')</script></head><body><header><h2>Site</h2></header>"
            "<nav><a href=/>Home</a></nav><div class='cookie-notice'><p>We use cookies on this site today.</p></div><main>" + body +
            "<form><p>Your mail here please</p><input></form><section class=\"comments\"><p>Nice story, thank you all.</p></section>"
            "</main><aside><p>Related things to read</p></aside><footer><p>Copyright of the site.</p></footer></body></html>")
    want = "A first & long paragraph of the story with many words in it.\n\nA second one with a link inside, and more."
    made = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "just words < here"), (5, "u", page.replace("main", "div")),
            (6, "u", "<p>cut <b"), (7, "u", "<b>" * 20000 + "deep" + "<p>" * 20000), (8, "u", "<!-- <p>x</p>"), (1, "u", page)]
    df = spark.createDataFrame(made, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("h", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {1: want, 2: "", 3: "", 4: "just words < here", 5: want, 6: "cut", 7: "deep", 8: ""}
    assert html.extract(df.limit(0)).count() == 0


def test_html_names_on_wrappers_and_widgets_inside_the_article(spark):
    first = "The first paragraph of a story that has a number of words in it."
    last = "The last paragraph of the story ends it with some more words."
    widget = "<aside>" + "<p><a href='x'>link</a></p>" * 40 + "</aside>"
    comments = "<div class='comments'><article class='comment'><p>Nice story, thank you all.</p></article></div>"
    article = f"<article><header class='entry-header'><h1>Heading</h1></header><p>{first}</p>{{}}<p>{last}</p>{{}}</article>"
    want = f"Heading\n\n{first}\n\n{last}"
    plain, long = article.format("", ""), article.format(widget, comments)
    pages = [f"<html><body class='no-sidebar comments-open single'>{plain}</body></html>",
             f"<body class='sidebar'><div id='content-with-sidebar'>{plain}</div></body>",
             f"<body><div class='sidebar'><p>Things</p></div><div class='layout banner'>{plain}</div></body>",
             f"<body><div class='site-nav'><p>Menu of the site here</p></div>{long}</body>",
             f"<body><main role='main' class='widget'>{plain}</main></body>"]
    made = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").withColumn("url", F.lit("u"))
    got = {r["page_id"]: r["text"] for r in html.extract(made).collect()}
    assert got[0] == got[1] == got[3] == got[4] == want and got[2].endswith(want)
    for source in pages:  # the default weights alone
        assert html.main_text(source, {}).endswith(f"{first}\n\n{last}")


# ---- chat --------------------------------------------------------------------

def digest(turns):
    loss = "".join(t for _, r, t in turns if r == "assistant")
    return len(turns), helpers.sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), helpers.sha(loss)


def test_chat_query(spark):
    want = defaultdict(list)
    for c, n, role, text in helpers.rows(spark.read.parquet(f"{helpers.SF}/conversations.parquet"), "conv_id", "turn", "role", "text") + queries.EXTRA_TURNS:
        want[c].append((n, role, text))
    got = queries.op7_chat(spark, helpers.SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(sorted(want[r["conv_id"]]))


def test_chat_escapes_are_reversible():
    rnd = random.Random(4)
    parts = [*chat.CONTROL, "\\", "<", "[", "/", "s>", "x", "|", "turn|>", "\n", ""]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        marked = chat.escape(text)
        assert chat.unescape(marked) == text and not any(c in marked for c in chat.CONTROL)


def test_chat_odd_rows(spark):
    made = [(1, 0, None, None), (1, None, "assistant", "z"), (1, 0, "assistant", "\\</s>"), (1, 0, "assistant", "a"), (None, 0, "user", "x"),
            (2, 0, "assistant", "é" * 50000), (2, 0, "assistant", "é" * 50000), (3, 0, "<|text|>", "<|end|>")]
    df = spark.createDataFrame(made, "conv_id bigint, turn bigint, role string, text string").withColumn("record", F.lit(1)).repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(chat.turn_records(df)))).collect()}
    turns = defaultdict(list)
    for c, n, r, t in made:
        turns[c].append((10 ** 9 if n is None else n, r or "", t or ""))
    for c, some in turns.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(sorted(some))
    assert chat.read_back(chat.format_turns(chat.canonical_turns(chat.turn_records(df.limit(0))))).count() == 0


def test_chat_layouts(spark):
    import json
    qa = [("user", "q"), ("assistant", "a")]
    made = [({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, qa, "messages"),
            ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, qa, "conversations"),
            ({"instruction": "q", "input": "", "output": "a"}, qa, "instruction"),
            ({"instruction": "q", "input": "i", "output": "a"}, [("user", "q\n\ni"), ("assistant", "a")], "instruction"),
            ({"prompt": "q", "completion": "a"}, qa, "prompt_completion"),
            ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
             [("system", "s"), ("user", "q"), ("assistant", "")], "conversations_system"),
            ({"question": "q", "answer": "a"}, qa, "question_answer"), ({"odd": 1}, [("unmapped", '{"odd": 1}')], None)]
    df = spark.createDataFrame([(n, json.dumps(r)) for n, (r, _, _) in enumerate(made)] + [(99, None), (98, "[")], "conv_id bigint, record string")
    got = defaultdict(list)
    for r in chat.canonical_turns(df).orderBy("conv_id", "seq").collect():
        got[r["conv_id"]].append(r)
    for n, (_, turns, layout) in enumerate(made):
        assert [(r["role"], r["text"]) for r in got[n]] == turns and {r["layout"] for r in got[n]} == {layout}
    assert 99 not in got and got[98][0]["role"] == "unmapped"
    formatted = chat.format_turns(chat.canonical_turns(df))
    spans = {(r["conv_id"], r["nth"]): r["segment"][r["loss_start"]:r["loss_start"] + r["loss_length"]] for r in formatted.collect()}
    assert spans[0, 1] == "a" and spans[0, 0] == ""


def test_html_unclosed_elements_quotes_and_comment_names():
    """Markup that ordinary pages hold: unclosed and nested hidden elements, quotes in bare values, names of comments
    and sidebars by their first word or written together."""
    one, two = "The first paragraph has quite a few words in it.", "The second one goes on about the same things."
    inner = f"<p>{one}</p>%s<p>{two}</p>"
    want = f"{one}\n\n{two}"
    for odd in ("<button>", "<svg><path d='M0'>", "<select>", "<object><object>x</object>y</object>", "<svg><g><svg>a</svg>b</g></svg>",
                "<button>Read more</button>", "<template><p>no</p></template>", "<noscript><img src=x></noscript>", "<svg/>",
                "<div class='comments-area'><p>I say no.</p><p>Me too.</p><p>All of us say so.</p></div>",
                "<ol id=comment-list><li>I say no.</li><li>Me too, all the time.</li></ol>", "<div class='CommentList'><p>I say no.</p></div>",
                "<div id='leftsidebar'><p>Other things here</p></div>", "<div class='related-articles'><p>Read this one</p></div>",
                "<div class='sharebar'>Share this page</div>", "<div class=cookieBanner><p>We set cookies.</p></div>",
                "<textarea>my draft <p></textarea>", "<script>if (a<b) '</p>'</script>"):
        page = f"<html><body><article>{inner % odd}</article></body></html>"
        assert html.main_text(page, {}) == want, odd
    assert html.main_text(f"<body><article><p data-x=don't>{one}</p><p title = \"a > 'b'\">{two}</p></article></body>", {}) == want
    assert html.main_text(f"<body><article><p a=1 'b>{one}</p><p>{two}</p></article></body>", {}) == want
    # wrappers that hold the article, words that only begin alike, states, and other attributes ending in id
    for attribute in ("class='sidebar-layout'", "class='comments-enabled'", "class='navy shareholders commentary'", "data-id='comments'",
                      "id='content-with-sidebar'", "class='related-content'"):
        assert html.main_text(f"<body><div {attribute}><article>{inner % ''}</article></div></body>", {}) == want, attribute
    for attribute in ("class='navy'", "class='shareholders'", "class='commentary'", "data-id='comments'"):
        assert html.main_text(f"<body><article><div {attribute}>{inner % ''}</div></article></body>", {}) == want, attribute
    long = "<p a='" + "x" * 200_000 + f"'>{one}</p>" + "<b " * 20_000
    assert html.main_text(long, {}) == one
