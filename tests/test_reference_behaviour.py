"""Behaviour of the operators on small inputs, in rows and columns."""

import datetime
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars, speakable as S, unicode_classes as U
from lectern.operators import html_blocks as H, providers, relational as R, stages
from lectern.plans import catalogue
from lectern.sources import feeds, ledger, library
from lectern.streaming import poll


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def kinds(page):
    return [(b["kind"], b["text"]) for b in H.Page(page).blocks]


# --- HTML to blocks


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>Hi<a href='#footnote-1'>1</a>.</p><div class=footnote><a class=footnote-number id=footnote-1>1</a><div class=footnote-content>A note.</div></div></article>", [("prose", "Hi. A note.")]),
        ("<article><p>out</p><div class='available-content'><p>in</p></div></article>", [("prose", "in")]),
        ("<article><div><div><p>a</p><h2>b</h2><p>c</p></div></div></article>", [("prose", "a"), ("heading", "b"), ("prose", "c")]),
        ("<article><p>a</p><div class='subscription-widget-wrap'><p>buy</p></div><nav><p>x</p></nav></article>", [("prose", "a")]),
        ("<article><hr><script>x</script><style>y</style><svg></svg><button>b</button>bare text</article>", []),
        ("<article><h3>  a   b </h3><p> </p></article>", [("heading", "a b")]),
        ("<article><p>see <a href=u>the <b>link</b></a> and <code>x = 1</code></p></article>", [("prose", "see the link and ⟪x = 1⟫")]),
        ("<article><p>O(n<sup>2</sup>) W<sub>q</sub> x<sup><a href='#footnote-9'>9</a></sup></p></article>", [("prose", "O(n²) W_q x")]),
        ("<article><blockquote><p>q</p></blockquote><ul><li>a<ul><li>b</li></ul></li><li><a href=u>c</a></li></ul></article>", [("quote", "q"), ("list", "ab\nc")]),
        ("<article><p>one<p>two<b>three<br>four</article>", [("prose", "one"), ("prose", "twothree four")]),
        ("", []),
    ],
)
def test_blocks(page, want):
    assert kinds(page) == want


def test_code_table_and_visuals():
    b = H.Page("<article><pre><code class='language-python'>a\n\nb</code></pre><div class=highlighted_code_block data-attrs='{\"language\": \"bash\"}'><pre>ls</pre></div><table><tr><th>a</th><td> b </td></tr><tr><td></td></tr></table></article>").blocks
    assert [(x["kind"], x.get("lang"), x.get("lines")) for x in b[:2]] == [("code", "python", 2), ("code", "bash", 1)] and b[2]["rows"] == [["a", "b"]]
    page = """<article><figure><img src='https://c.example/f/https%3A%2F%2Fs.example%2Fa_2000x400.png' data-attrs='{"topImage": true, "alt": "x"}'><figcaption>Cap</figcaption></figure><p>one <img src='https://s.example/a_2000x400.png'> two</p></article>"""
    b = H.Page(page).blocks
    assert [x["kind"] for x in b] == ["visual", "visual", "prose"] and b[2]["text"] == "one two" and b[0]["vid"] == b[1]["vid"] and len(b[0]["vid"]) == 10
    assert b[0]["visual"]["hint"] == "formula" and b[0]["visual"]["hero"] and b[0]["visual"]["caption"] == "Cap" and b[0]["visual"]["alt"] == "x"
    assert H.Page("<article><div class=paywall></div><div class=paywall></div></article>").dropped == {".paywall": 2}


def test_block_frames_and_registry(spark):
    page = "<article><img src='https://a.example/x.png'><p>t</p><img src='https://a.example/x.png' alt='last'></article>"
    b = H.extract_blocks(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"))
    assert [(r.item_id, r.idx, r.kind) for r in b.collect()] == [(1, 0, "visual"), (1, 1, "prose"), (1, 2, "visual")]
    assert [(r.first_pos, r.alt) for r in H.visuals(b).collect()] == [(0, "last")]


# --- speakability


def test_needs_model_asks_for_foreign_letters(spark):
    texts = ["il valore σ cresce", "το σ είναι γράμμα", "una frase e una a", "usa 30B", "", "x σ 30B"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    want = {i: bool(S.foreign_letters_of(t)) or "30B" in t for i, t in enumerate(texts)}
    assert dict(map(tuple, d.select("key", S.needs_model(F.col("text"), "it")).collect())) == want and want[0]
    got = stages.sanitize(d.filter("key = 0"), lambda: Scripted(["il valore sigma cresce"]), lambda x: x)
    assert [tuple(r) for r in got.collect()] == [(0, "il valore sigma cresce")]


@pytest.mark.parametrize("text", ["Questa è una frase, con (parentesi).", "This is plain English.", "これは日本語です。", "Это русский текст.", "هذا نص عربي.", "यह हिन्दी है।", "95,3 2024 3 e-mail l'accuratezza — ok"])
def test_speakable(spark, text):
    assert one(spark, text, lambda c: F.size(S.unspeakable_tokens(c, "it"))) == 0
    assert one(spark, text, lambda c: F.size(S.unspeakable_chars(c))) == 0 and S.foreign_letters_of(text) == []


@pytest.mark.parametrize("token", ["https://x.y/z", "--model", "a_b", "4.5", "Qwen3.5", "V3.2", "30B", "32k", "5:1", "20-40", "≤", "█"])
def test_unspeakable(spark, token):
    assert one(spark, f"prima {token} dopo {token}", lambda c: S.unspeakable_tokens(c, "it")) == [token]


def test_locale_and_foreign(spark):
    assert one(spark, "4.5", lambda c: S.needs_model(c, "en")) is False and one(spark, "4.5", lambda c: S.needs_model(c, "it")) is True
    assert S.foreign_letters_of("il valore σ cresce") == ["σ"] and S.foreign_letters_of("το σ είναι γράμμα") == []


@pytest.mark.parametrize("text", ["vedi https://a.b/c qui", "apri ⟪editor⟫ e scrivi", "┌──┐ | a | $ ls -la | grep x", "```python\nx = 1\n```", "uno , due ..  tre\n\n\n\n- quattro 30B"])
def test_strip_is_idempotent_and_speakable(spark, text):
    strip = lambda c: S.strip_unspeakable(c, "it")
    once = one(spark, text, strip)
    assert one(spark, once, strip) == once and one(spark, once, lambda c: S.needs_model(c, "it")) is False
    if "editor" in text:
        assert once == "apri editor e scrivi"


def test_invisible(spark):
    assert one(spark, "a­b​c\n", S.remove_invisible) == "abc\n" and one(spark, "​ ⁠", S.is_effectively_empty) is True
    assert all(U.speakable(c) for c in "a1 .,'") and not any(U.speakable(c) for c in "#*/%&@_[]{}")
    assert unicodedata.category("-") == "Pd" and "\\x{2d}" not in U.edge_class()


# --- scalars


def test_scalars(spark):
    assert one(spark, "Bread & Wine, part 2: how/why", scalars.slug) == "Bread___Wine__part_2__how_why" and len(one(spark, "x" * 500, scalars.slug)) == 150
    assert one(spark, "Bread: how/why", scalars.library_name) == "Bread how why" and one(spark, "///", scalars.library_name) == "Unknown"
    assert one(spark, "https://www.my-blog.example.com/x", scalars.host_author) == "My Blog" and one(spark, "nothing", scalars.host_author) == "Unknown"
    assert one(spark, "https://c/https://s.example/a", scalars.image_url) == "https://s.example/a" and one(spark, "https://c/https%3A%2F%2Fs+1", scalars.image_url) == "https://s+1"
    assert [one(spark, x, scalars.visual_class) for x in ("decorativo", "essenziale", "illustrative", "odd", None)] == ["decorative", "essential", "illustrative", "decorative", "decorative"]
    assert one(spark, "2024-01-02", scalars.year_of) == "2024" and one(spark, "May", scalars.year_of) == ""
    assert one(spark, "2", lambda c: scalars.script_form(c, "sup")) == "²" and one(spark, "q", lambda c: scalars.script_form(c, "sub")) == "_q"
    pair = spark.createDataFrame([("def f():\n    return total_of_everything", "It says return total_of_everything now"), ("x = 1", "sets x"), ("abcdefgh", "abcdefgh")], "a string, b string")
    assert [r[0] for r in pair.select(scalars.is_echo(F.col("a"), F.col("b"))).collect()] == [True, False, True]


# --- triage


@pytest.mark.parametrize(
    "raw, n, want",
    [
        ('{"tail_from": 3, "drop": [1], "refers_back": [2]}', 5, (3, [1], [2])), ('Sure: {"drop": [0]} done', 2, (None, [0], [])), ("not json", 5, (None, [], [])), ("", 5, (None, [], [])),
        ("[]", 5, (None, [], [])), ("{oops", 5, (None, [], [])), ("null", 5, (None, [], [])), ('{"tail_from": 99, "drop": [1, 42, -1, "x"], "refers_back": [7]}', 3, (None, [1], [])),
    ],
)
def test_verdict(spark, raw, n, want):
    v = one(spark, raw, lambda c: R.parse_verdict(c, F.lit(n)))
    assert (v.tail_from, v.drop, v.refers_back) == want


def test_apply_and_reposition(spark):
    b = spark.createDataFrame([(1, 0, "visual", ""), (1, 1, "prose", "as above"), (1, 2, "prose", "bye"), (2, 0, "prose", "alone")], "item_id long, idx int, kind string, text string")
    v = spark.createDataFrame([(1, (2, [], [1]))], "item_id long, verdict struct<tail_from:int,drop:array<int>,refers_back:array<int>>")
    out = R.apply_verdict(b, v)
    got = {(r.item_id, r.idx): r for r in R.reposition(out).collect()}
    assert len(got) == 4 and got[1, 2].dropped and got[1, 2].text == "" and not got[2, 0].dropped
    assert got[1, 0].play_pos == 1 and got[1, 1].play_pos == 0 and got[1, 2].play_pos == 2


# --- stages


class Scripted:
    """Answers in turn; an exception in the list is raised."""

    def __init__(self, replies):
        self.replies = list(replies)

    def generate(self, prompt):
        r = self.replies.pop(0) if len(self.replies) > 1 else self.replies[0]
        if r == "raise":
            raise RuntimeError("no")
        return r


@pytest.mark.parametrize("text, replies, want", [
    ("frase pulita", ["unused"], "frase pulita"), ("​", ["unused"], ""), ("usa 30B qui", ["usa trenta miliardi"], "usa trenta miliardi"),
    ("usa 30B qui", ["usa 30B"], "usa"), ("usa 30B qui", ["raise"], "usa qui"), ("usa 30B qui", [""], ""),
])
def test_sanitize(spark, tmp_path, text, replies, want):
    turn = iter(range(9))

    def write(df):
        p = str(tmp_path / f"w{next(turn)}")
        df.write.parquet(p)
        return df.sparkSession.read.schema(df.schema).parquet(p)

    out = stages.sanitize(spark.createDataFrame([(1, text)], "key long, text string"), lambda: Scripted(replies), write)
    assert [tuple(r) for r in out.collect()] == [(1, want)]


def test_translate_and_describe(spark):
    b = spark.createDataFrame([(1, "a", None), (2, "", None), (3, "c", "done")], "key long, text string, translated_text string")
    assert [tuple(r) for r in stages.translate(b, lambda: Scripted(["", "", "x"])).collect()] == [(1, "x", None)]
    assert [tuple(r) for r in stages.translate(b, lambda: Scripted([""])).collect()] == [(1, "", None)]
    rows = spark.createDataFrame([("k1", "p"), ("k1", "p"), ("k2", "p")], "key string, prompt string")
    cache = spark.createDataFrame([("k2", "held")], "key string, description string")
    got, made = stages.describe(rows, cache, lambda: Scripted(["new"]), lambda d: d)
    assert sorted(map(tuple, got.collect())) == [("k1", "new"), ("k2", "held")] and made.count() == 1
    assert stages.describe(rows, cache, lambda: Scripted([" "]), lambda d: d)[1].count() == 0
    assert providers.Offline().generate(providers.prompt("x", "hello", language="it")) == "hello"


def test_describe_rejects_echoes(spark):
    code = "x = compute_all(y)\nreturn x"
    rows = spark.createDataFrame([("k", "p", code)], "key string, prompt string, code string")
    cache = spark.createDataFrame([], "key string, description string")
    for replies, want in (([f"It is {code}", "It computes x."], [("k", "It computes x.")]), (["run x = compute_all(y) then"], []), ([""], []), (["raise"], [])):
        got, made = stages.describe(rows, cache, lambda: Scripted(replies), lambda d: d, code="code")  # noqa: B023
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in made.collect()] == want


def test_echo_guard_finds_short_items_and_lines(spark, tmp_path):
    items = ["photosynthesis", "carbon dioxide", "short", "one two three four", "a line of many words\nanother line, never said"]
    texts = ["On photosynthesis.", "of carbon\n dioxide, short", "xone two three fourx", "so a line of many words is said", "", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, catalogue.echo_guard(spark, str(tmp_path)).collect()))
    assert got == [(0, 0), (1, 1), (3, 2), (4, 3)]
    pairs = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(items) for j, b in enumerate(texts)], "i long, j long, a string, b string")
    assert got == sorted(map(tuple, pairs.filter(scalars.is_echo(F.col("a"), F.col("b"))).select("i", "j").collect()))


def test_attach(spark):
    b = spark.createDataFrame(
        [(1, 0, "visual", "v1", False, None, None), (1, 1, "visual", "v2", False, None, None), (1, 2, "table", None, False, "a, b", None), (1, 3, "code", None, False, None, None), (1, 4, "prose", None, True, None, None)],
        "item_id long, idx int, kind string, vid string, dropped boolean, description string, translated_text string",
    )
    f = spark.createDataFrame([(1, "v1", "essential", "A chart"), (1, "v2", "decorative", "A frame")], "item_id long, vid string, klass string, description string")
    assert {r.idx: r.translated_text for r in R.attach_descriptions(b, f).collect()} == {0: "A chart", 1: None, 2: "a, b", 3: "", 4: None}


def test_wer_pairs_scores_whole_texts(spark, tmp_path):
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1] / len(a) if a else float(bool(b))

    rng = random.Random(8)
    texts = ["", "a", "b a"] + [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (29, 31, 64, 65, 140, 7, 200, 1, 130)]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.wer for r in catalogue.wer_pairs(spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(brute(texts[i].split(), texts[i - 1].split()), abs=1e-6) for i in range(1, len(texts))}


def test_word_error_rate(spark):
    assert stages.word_error_rate("Hello, world!", "hello world") == 0 and stages.word_error_rate("a b c d", "a x c") == 0.5 and stages.word_error_rate(None, "a") is None
    assert spark.createDataFrame([("a b", "a")], "a string, b string").select(stages.wer(F.col("a"), F.col("b"))).first()[0] == 0.5
    assert stages.word_diff("a b", "a c") == ["  a", "- b", "+ c"]


# --- sources and the poll


def test_feeds(spark, tmp_path):
    (tmp_path / "list.txt").write_text("https://a/feed\n\n# off\n  https://b/feed  \n")
    assert [r[0] for r in feeds.feed_list(spark, str(tmp_path / "list.txt")).collect()] == ["https://a/feed", "https://b/feed"]
    (tmp_path / "f.xml").write_text(
        """<rss><channel><item><title>T1</title><link>https://a/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><author>me@x.y</author><description>short</description></item>
        <item><title>No link</title></item></channel></rss>"""
    )
    got = feeds.entries(feeds.read_feed(spark, str(tmp_path / "f.xml")), F.lit("https://a/feed")).collect()
    assert len(got) == 1 and got[0].title == "T1" and got[0].author == "" and got[0].published_at == "2024-01-02T03:04:05+00:00" and got[0].content_html == "short"
    assert [one(spark, n, lambda c: feeds.first_usable(F.repeat(F.lit("x"), c), F.repeat(F.lit("x"), c)), "int") for n in (1200, 200, 199)] == ["feed", "page", None]


def test_ledger_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert ledger.read(spark, path).count() == 0
    rows = spark.createDataFrame([("f", "a"), ("f", "a"), ("g", "a")], "feed_url string, post_url string")
    ledger.mark(spark, path, rows)
    ledger.mark(spark, path, rows)
    assert sorted((r.feed_url, r.post_url) for r in ledger.read(spark, path).collect()) == [("f", "a"), ("g", "a")]


def test_poll_marks_after_success(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "seen")
    schema = "feed_url string, post_url string, entry_pos int"
    runs = []

    def snapshot(posts):
        spark.createDataFrame([("f", p, i) for i, p in enumerate(posts)], schema).coalesce(1).write.mode("append").parquet(source)

    def process(df, fail):
        runs.append(sorted(r.post_url for r in df.collect()))
        return df.withColumn("ok", ~F.col("post_url").isin(fail))

    for posts, fail in ((["a", "b"], ["b"]), (["a", "b", "c"], ["none"]), (["a", "b", "c"], ["none"])):
        snapshot(posts)
        poll.start(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "cp"), lambda df, fail=fail: process(df, fail)).awaitTermination()
    assert runs == [["a", "b"], ["b", "c"], []] and sorted(r.post_url for r in ledger.read(spark, path).collect()) == ["a", "b", "c"]
    many = spark.createDataFrame([("f", f"p{i}", i) for i in range(9)], schema)
    poll.handle(many, str(tmp_path / "other"), lambda df: process(df, []), per_run=5)
    assert runs[-1] == ["p0", "p1", "p2", "p3", "p4"]


def test_library(spark, tmp_path):
    items = spark.createDataFrame([("B/x", "T: 1", "2024-05-01", b"1"), ("A", "t", "", None)], "author string, title string, published_at string, audio binary")
    assert [r.folder for r in library.summary(items).collect()] == ["A/t", "B x/T 1"]
    root = str(tmp_path / "lib")
    library.publish(items, root)
    library.publish(items.withColumn("audio", F.lit(b"2")), root)
    got = {r.folder: bytes(r.audio) for r in spark.read.parquet(root).collect()}
    assert got == {"B x/T 1": b"1", "A/t": b"2"}
    library.publish(items, root, overwrite=True)
    assert {r.folder for r in spark.read.parquet(root).collect()} == {"B x/T 1", "A/t"}


def test_dates_are_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC" and datetime.datetime(2024, 1, 1)


# --- the same rules, said once more in Python


def spoken_again(text, language="it"):
    """strip_unspeakable by its rules, letter by letter."""
    import re

    decimal, group = map(re.escape, {"it": (",", ".")}[language])
    number = re.compile(rf"[+-]?(\d+|\d{{1,3}}({group}\d{{3}})+)({decimal}\d+)?")

    def odd(token):
        edge = {c for c in token if ord(c) < 0x10000 and U.speakable(c) and not c.isalnum() and unicodedata.category(c) != "Pd"}
        core = token.strip("".join(edge)) if edge else token
        if not core.strip(U.WORD_JOINERS) or number.fullmatch(core):
            return False
        return any(c.isdigit() for c in core) or not (core[0].isalpha() and core[-1].isalpha() and all(map(U.speakable, core)))

    text = "".join(c for c in text if not U.silent(c)).replace("⟪", " ").replace("⟫", " ")
    text = re.sub(r"\S+", lambda m: "" if odd(m[0]) else m[0], text)
    for pattern, by in S.MENDING:
        text = re.sub(pattern.replace("(?md)", "(?m)"), by.replace("$1", r"\1"), text)
    return text.strip()


def test_strip_against_a_restatement(spark, small):
    rng = random.Random(3)
    signs = ["a", "è", "30B", " ", "  ", "\n", "\r", "\t", ",", ".", ";", "(", ")", "-", "--x", "σ", "⟪", "x/y", "1.000,5", "\u200b", "…", "#", "\x1c", "\u2028"]
    texts = ["uno\r, due", " , inizio", "a .. b", "x\n\n\n\ny 30B", "( 30B )"] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() if r.text and len(r.text) < 5000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.strip_unspeakable(F.col("t"), "it")).collect()
    assert {i: t for i, t in got} == {i: spoken_again(t) for i, t in enumerate(texts)}


def test_describe_unspeakable(spark):
    told = one(spark, "il σ vale 30B e a/b", lambda c: S.describe_unspeakable(c, "it"))
    assert "'30B'" in told and "'a/b'" in told and "SOLIDUS" in told and "σ" in told and one(spark, "tutto bene", lambda c: S.describe_unspeakable(c, "it")) == ""


def test_languages(spark):
    from lectern.functions import language as L

    assert [L.code(x) for x in ("Italian", "it", "pt-BR", "zh_Hant", "Klingon")] == ["it", "it", "pt", "zh", "Klingon"]
    assert [L.tag(x) for x in ("it", "pt-PT", "Portuguese", "??")] == ["it-IT", "pt-PT", "pt-BR", "??"]
    assert [L.display_name(x) for x in ("it", "pt-BR", "none such")] == ["Italian", "Portuguese", "none such"]
    assert L.number_signs("Polish") == (",", "\u00a0") and L.number_signs("xx") == (".", ",")
    assert [one(spark, x, L.name_column) for x in ("it", "German", "pt-BR", "xx")] == ["Italian", "German", "Portuguese", "xx"]


def test_strip_cleans_a_text_once_and_in_long_runs(spark):
    df = spark.createDataFrame([(" ".join(["parola"] * 350) + " C++ " + "due, " * 150 + "\u00a0x9y\u3000fine",), ("\u2009\u200bsolo\x1f ",), ("@@ \u00a0 ##",), ("",), (None,)], "x string")
    out = df.select(S.strip_unspeakable(F.col("x")).alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count(U.silent_class()) == 1
    assert [r.t for r in out.collect()] == [" ".join(["parola"] * 350) + " " + "due, " * 150 + "\u00a0\u3000fine", "solo", "", "", None]
    text = " ".join(["a1b", "parola,"] * 260 + ["fine", "C++", "a1b"])
    assert one(spark, text, S.unspeakable_tokens) == ["a1b", "C++"]


def test_sanitize_asks_its_gate_once(spark):
    from lectern.session import durable

    said = spark.createDataFrame([("a", "una parola"), ("b", "con C++ dentro"), ("c", " ")], "key string, text string")
    out = stages.sanitize(said, providers.Offline, durable)
    assert "PythonUDF" not in out._jdf.queryExecution().optimizedPlan().toString() and "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert dict(map(tuple, out.collect())) == {"a": "una parola", "b": "con dentro", "c": ""}


# --- bad pages


def test_bad_pages_are_isolated(spark):
    deep = "<article>" + "<div>" * 3000 + "<p>deep</p>"
    rows = [(1, deep), (2, "<article><![foo[bar]]><p>after</p></article>"), (3, "<article><aside>x</aside><nav>y</nav><nav>z</nav><p>a</p></article>"), (4, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert sorted((r.item_id, r.text) for r in H.extract_blocks(pages).collect()) == [(1, "deep"), (2, "after"), (3, "a")]
    assert sorted(map(tuple, H.dropped_counts(pages).collect())) == [(3, "aside", 1), (3, "nav", 2)]

    def rows_of(page):
        if page._texts(0) == ["bad"]:
            raise ValueError("broken")
        return []

    out = H.read_pages(spark.createDataFrame([(1, "bad"), (2, "good")], "page_id long, html string"), "page_id", "html", "item_id long, error string", rows_of)
    assert [tuple(r) for r in out.collect()] == [(1, "ValueError: broken")]


def test_pages_of_a_batch_are_handed_on_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(H, "run_arrow", lambda df, run, schema: run)
    run = H.read_pages(spark.createDataFrame([], "page_id long, html string"), "page_id", "html", "item_id long, idx int, error string", lambda page: [{"idx": i} for i in range(len(page.blocks))])
    pages = [(i, None if i % 5 == 0 else f"<article><p>{'a' * 100_000}</p><p>b</p></article>") for i in range(100)]
    out = list(run([pa.RecordBatch.from_pylist([{"page_id": i, "html": h} for i, h in pages])]))
    assert [r["item_id"] for b in out for r in b.to_pylist()] == [i for i, h in pages if h for _ in range(2)]
    assert max(b.num_rows for b in out) <= 30


def test_notes_lose_their_number():
    page = "<article><p>Text<a href='#footnote-a-2'>2</a></p><div class=footnote><a class=footnote-number>2</a> The note.</div></article>"
    assert kinds(page) == [("prose", "Text. The note.")]
    assert H.inner_url("https://a.example/https://b.example/x") == "https://b.example/x" and H.inner_url("xhttps://b") == "xhttps://b"


# --- fetching


class Web:
    pages = {"https://a.example/1": "<html><head><title>The &amp; page</title><meta property='og:image' content='https://i.example/p.png'><meta name=author content=\"Ann Lee\"></head><body><p>" + "word " * 80 + "</p></body></html>"}

    def __init__(self):
        self.busy = {"https://b.example/2": 2}

    def get(self, url):
        if self.busy.get(url, 0):
            self.busy[url] -= 1
            raise providers.Busy(0.0)
        if url == "https://b.example/2":
            return "<p>too short</p>"
        return self.pages[url]


def test_fetch_cascade(spark):
    from lectern.sources import fetch

    schema = "url string, title string, author string, published_at string, image_url string, content_html string, generator string"
    rows = [
        ("https://a.example/1", "", "", "2024-01-01", None, "<p>short</p>", ""), ("https://b.example/2", "B", "http://me", "", "", None, ""),
        ("https://my-blog.example/3", "Own", "http://profile", "", "", "<p>" + "x" * 1300 + "</p>", ""), ("https://gone.example/4", "D", "", "", "", "", ""), ("https://s.example/5", "S", "", "", "", "", "SubStack"),
    ]
    entries = spark.createDataFrame(rows, schema)
    special = spark.createDataFrame([("https://s.example/5", ("<p>api</p>", "Api", "Cy", "sub", "2023", "c.png"))], f"url string, article {fetch.ARTICLE}")
    got = {r.url[-1]: r for r in fetch.fetch_articles(entries, Web, lambda d: d.cache(), special=special).collect()}
    assert {k: r.strategy for k, r in got.items()} == {"1": "page", "2": None, "3": "feed", "4": None, "5": "special"}
    assert got["1"].article.title == "The & page" and got["1"].article.author == "Ann Lee" and got["1"].article.cover_image.endswith("p.png") and got["1"].article.published_at == "2024-01-01"
    assert got["3"].article.author == "My Blog" and got["5"].article.title == "Api" and "KeyError" in got["4"].error and "no strategy" in got["2"].error
    items = {r.url[-1]: r for r in fetch.feed_items(fetch.fetch_articles(entries, Web, lambda d: d.cache()), Web, lambda d: d.cache()).collect()}
    assert set(items) == {"1", "3"} and items["1"].image_url == "https://i.example/p.png" and items["3"].image_url is None
    assert [r[0] for r in entries.select(fetch.is_substack(F.col("url"), F.col("generator"))).collect()] == [False] * 4 + [True]
    assert one(spark, "https://x.SUBSTACK.com/p", lambda c: fetch.is_substack(c, F.lit(None))) is True
    assert one(spark, ["", "  ", " Eve "], fetch.byline, "array<string>") == "Eve" and one(spark, "<b>a</b>  b<i> </i>", fetch.text_length) == 3
    assert one(spark, "https://4th-o'neil.example/", scalars.host_author) == "4Th O'Neil"


def test_busy_hosts_are_asked_again(spark):
    from lectern.sources import fetch

    urls = spark.createDataFrame([("https://b.example/2",)] * 2, "url string")
    assert [(r.html, r.error) for r in fetch.get_pages(urls, Web, wait=lambda s: None).collect()] == [("<p>too short</p>", None)]
    assert [r.error[:4] for r in fetch.get_pages(urls, Web, tries=2, wait=lambda s: None).collect()] == ["Busy"]


# --- whole runs


class Reader(providers.Offline):
    """A model with an answer for each stage."""

    def generate(self, prompt):
        stage = prompt.split("\n", 1)[0].removeprefix("STAGE: ")
        text = super().generate(prompt)
        if stage == "triage":
            return '{"tail_from": 7, "drop": [], "refers_back": [2]}' if "Goodbye" in text else "{}"
        if stage == "translate" and "poison" in text:
            raise RuntimeError("refused")
        if stage == "code":
            return "It adds."
        return {"table": "", "translate": text.upper(), "sanitize 1": "thirty billion"}.get(stage, text)


def test_process_items(spark, tmp_path):
    from lectern.operators import narrate

    turn = iter(range(99))

    def write(df):
        p = str(tmp_path / f"w{next(turn)}")
        df.write.parquet(p)
        return df.sparkSession.read.schema(df.schema).parquet(p)

    page = """<article><h1>Head</h1><img src='https://i.example/a_900x300.png'><p>as above</p><pre>a = b + c</pre><table><tr><td>x</td><td>y</td></tr></table>
      <img src='https://i.example/badge.svg'><p>has 30B in it</p><p>Goodbye</p></article>"""
    items = spark.createDataFrame([(1, page), (2, "<article><p>poison</p></article>"), (3, "<article><p>fine</p></article>"), (4, None)], "item_id long, html string")
    models = narrate.Models(text=Reader, vision=Reader, speech=Reader)
    episodes, made = narrate.process_items(items, models, write, "en")
    got = {r.item_id: r for r in episodes.collect()}
    assert [got[i].ok for i in (1, 2, 3, 4)] == [True, False, True, True] and got[2].stage == "translate" and "refused" in got[2].error and got[2].audio is None
    assert bytes(got[3].audio) == b"[FINE]" and bytes(got[4].audio) == b"" and got[1].worst_wer == 0
    # the prose that refers back plays before its picture; the dropped tail, and the badge, are silent
    assert bytes(got[1].audio).decode() == "[HEAD][AS ABOVE][A picture.][It adds.][x, y][thirty billion]"
    assert {k: made[k].count() for k in ("triage", "visual", "table", "code", "text")} == {"triage": 3, "visual": 1, "table": 0, "code": 1, "text": 4}
    # a second run with the caches asks for nothing that is held
    class Silent(providers.Offline):
        def generate(self, prompt):
            raise RuntimeError("asked again: " + prompt[:40])

        look = speak = generate

    again = narrate.Models(text=Silent, vision=Silent, speech=Silent, caches=made)
    episodes, _ = narrate.process_items(items.filter("item_id IN (1, 3)"), again, write, "en")
    assert {r.item_id: (r.ok, bytes(r.audio)) for r in episodes.collect()} == {i: (True, bytes(got[i].audio)) for i in (1, 3)}


def test_tables_of_many_rows_are_shown_in_part(spark):
    from lectern.operators import narrate

    rows = [[str(i)] for i in range(60)]
    b = spark.createDataFrame([(1, 0, "table", rows, False)], "item_id long, idx int, kind string, rows array<array<string>>, dropped boolean")
    out, made = narrate.describe_tables(b, narrate.Models(), lambda d: d, "en")
    said = out.first().description
    assert said.split("\n") == [str(i) for i in range(50)] and made.count() == 1
