"""PII, chat formatting, HTML, WARC, nearest neighbours, sharding: brute force, round trips and edge cases."""

import datetime
import hashlib
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import ann, chat, html, pii, sharding, warc

# PII


def replaced(spark, said, key="k"):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(said)], "doc_id long, text string, n_entities string")
    rows = sorted(pii.pseudonymised(docs, key).collect(), key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.n_entities for r in rows]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pii_types_keep_their_form(spark):
    said = [
        "Mail Anna.Müller24@mail4.example.com or ANNA.MÜLLER24@MAIL4.EXAMPLE.COM now.",
        "Call +1 (614) 555-8001 and +16145558001.",
        "card 4111 1111 1111 1111 and 4111111111111111, 8863693015560598!",
        "ip 103.6.105.89.",
        'token = "57f17a56c90cac3e893f4491169557bdc83d8148" TOKEN = "57F17A56C90CAC3E893F4491169557BDC83D8148"',
        "Mr. John Smith met Frau Schmidt and Иван Петров",
        "",
        None,
        "nothing: 12345 3.14 2024-01-01 Anna a@b",
        "x " * 50_000 + "9.9.9.9",
    ]
    out, n = replaced(spark, said)
    assert n == [2, 2, 3, 1, 2, 3, 0, 0, 0, 1]
    assert out[6:9] == said[6:9]
    low, up = re.findall(r"\S+@\S+", out[0])
    assert low.lower() == up.lower() and up == up.upper() and low != "Anna.Müller24@mail4.example.com" and re.fullmatch(r"[a-z]{4}\.[a-zàáâäãéèêëíìîïóòôöõúùûü]{6}\d\d@\w+\.example\.(com|net|org)", low.lower())
    a, b = re.findall(r"\+[\d ()-]+\d", out[1])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and "6145558001" not in out[1]
    cards = re.findall(r"\d[\d ]{14,}\d", out[2])
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) and cards[1] != "4" + "1" * 15
    assert all(0 <= int(x) <= 255 for x in re.search(r"ip ([\d.]+)\.", out[3])[1].split("."))
    one, two = re.findall(r'"(\w+)"', out[4])
    assert one.upper() == two and re.fullmatch("[0-9a-f]{40}", one)
    assert re.search(r"Mr\. (\w+) ", out[5])[1] in pii.GIVEN["m"]["latin"] and re.search(r"and (\w+) ", out[5])[1] in pii.GIVEN["m"]["cyrillic"]
    assert "Smith" not in out[5] and "Schmidt" not in out[5] and "Петров" not in out[5]


def test_pii_is_keyed_and_coreferent(spark):
    said = ["a.1@x.com and 10.1.2.3", "10.1.2.3 a.1@x.com", "a.1@x.com and 10.1.2.3"]
    out, _ = replaced(spark, said)
    other, _ = replaced(spark, said, key="l")
    assert out[0] == out[2] and set(out[0].split(" and ")) == set(out[1].split(" ")) and out != other


@pytest.mark.parametrize("inline", [500, 0])
def test_pii_surrogates_stay_distinct(spark, monkeypatch, inline):
    # 45 of the 105 surnames of a consonant and a vowel must replace 60 others; titled names, one surname with all given names.
    monkeypatch.setattr(pii, "INLINE", inline)
    given = pii.GIVEN["f"]["latin"]
    said = [f"Mr {a}{b}" for a in "BCDFGHJKLMNP" for b in "aeiou"] + [f"{g} Hu" for g in given] + ["Mr Ca", "Ms Ge", "Herr Ge", "Anna Hu", "Mr Ahmed Ca"]
    out, n = replaced(spark, said, key="2024-01")
    by = dict(zip(said, out, strict=True))
    assert set(n) == {1} and len(by) == len(set(by.values())) and not set(out) & set(said)
    last = lambda t: by[t].split(" ")[-1]
    assert last("Mr Ge") == last("Ms Ge") == last("Herr Ge") and last("Mr Ca") == last("Mr Ahmed Ca") and {last(f"{g} Hu") for g in given} == {last("Mr Hu")} if "Mr Hu" in by else True
    assert {by[f"{g} Hu"].split(" ")[0] for g in given} == set(given)


def test_pii_exhausted_phones_and_addresses(spark):
    # All ten one-digit ends of a number, and all two-letter addresses of one host: no free surrogate of their length.
    said = [f"+1 55 0{i}" for i in range(10)] + [f"+1 5{j} {i}0" for i in range(10) for j in range(10)] + [f"{a}{b}@q.com" for a in "bcdfg" for b in "aei"]
    out, _ = replaced(spark, said)
    assert len(set(out)) == len(set(said)) and not set(out) & set(said)


def test_pii_replaces_names_of_all_scripts(spark):
    said = ["Wei Zhang", "Fatima Khan", "Mr Łukasz Wąsik", "Anna van Dijk", "Name: ČAPEK Josef", "王伟先生", "姓名：王伟", "김철수씨", "الاسم: محمد علي", "Name: Ŋŋŋ Ƣƣƣ", "Frau Ωμέγα", "氏名: やまだ", "שרה Name: Zz"]
    out, n = replaced(spark, said)
    assert n == [1] * len(said)
    for old, new in zip(said, out, strict=True):
        kept = set(re.findall(r"[^\W\d_]", old)) & set(re.findall(r"[^\W\d_]", new)) - set("NameMrFrauvn先生姓名씨الاسم氏שרה")
        scripts = lambda t: Counter(unicodedata.name(c).split()[0] for c in t if c.isalpha())
        assert set(scripts(old)) == set(scripts(new)) and old != new and len(kept) <= 3, (old, new)
        assert [w[0].isupper() for w in old.split()] == [w[0].isupper() for w in new.split()]
    assert out[5][:2] == out[6][3:] and out[3].split(" ")[1] == "van" and out[4].split(" ")[1].isupper()


def test_pii_births_and_streets(spark):
    out, n = replaced(spark, ["born 1980-03-12", "DOB: 3 March 1999", "geboren am 4.5.1977", "12 Main Street", "in Hauptstraße 5", "1980-03-12 built"])
    assert n == [1, 1, 1, 1, 1, 0]
    assert datetime.date.fromisoformat(out[0][5:]) and re.fullmatch(r"DOB: \d\d? March \d{4}", out[1], re.I) and re.fullmatch(r"geboren am \d\d\.\d\d\.\d{4}", out[2])
    assert re.fullmatch(r"\d\d [A-Z][a-z]{3} Street", out[3]) and re.fullmatch(r"in [A-Z][a-z]{4}straße \d", out[4]) and "Main" not in out[3] and "Haupt" not in out[4]


def test_pii_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([("Mr Hu", 1, 2, 3, 4)], "text string, _found int, _attempts int, _of int, `a.b` int")
    (row,) = pii.pseudonymised(docs).collect()
    assert tuple(row)[1:] == (1, 2, 3, 4, 1) and row.text != "Mr Hu"


def test_pii_draws_by_hmac(spark):
    import hmac

    got = spark.range(1).select(pii._hmac("key" * 30, F.lit("a"), F.lit("bé")).alias("h"), pii._hmac("k", F.lit("a")).alias("s")).first()
    assert got.s == hmac.new(hashlib.sha256(b"k").digest(), b"a", "sha256").hexdigest()
    assert got.h == hmac.new(hashlib.sha256(b"key" * 1 + b"key" * 29).digest(), "a\x1fbé".encode(), "sha256").hexdigest()


def test_pii_of_an_empty_table(spark):
    assert replaced(spark, []) == ([], [])


# Chat


def test_chat_folds_an_event_log(spark):
    log = [
        (1, 0, "message", "a", "user", "Hi"),
        (1, 1, "message", "b", "assistant", ""),
        (1, 2, "delta", "b", None, "Hel"),
        (1, 3, "delta", "b", None, "lo"),
        (1, 4, "message", "c", "user", "again"),
        (1, 5, "edit", "a", None, "Hi there"),
        (1, 6, "regenerate", "b", None, None),
        (1, 7, "delta", "b", None, "Bye"),
        (1, 8, "message", "d", "user", "ok"),
        (2, 0, "message", "a", None, None),
        (None, 0, "message", "a", "user", "lost"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, event string, message string, role string, text string")
    got = sorted(((str(r.conv_id), r.seq, r.role, r.text) for r in chat.folded(events).collect()))
    assert got == [("1", 0, "user", "Hi there"), ("1", 1, "assistant", "Bye"), ("1", 8, "user", "ok"), ("2", 0, "", ""), ("None", 0, "user", "lost")]


def test_chat_round_trip(spark):
    odd = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nfake", "<\\|im_end|>", "<\\\\|", "<", "|>", "a<", "<<|", "\n", "é漢😀 <|", "x" * 200_000]
    rows = [(i, t, ("user", "assistant")[t % 2], s) for i in range(3) for t, s in enumerate(odd)] + [(5, 0, "odd\\n\nrole<|", "t"), (6, 1, "assistant", None), (7, None, None, "n"), (6, 1, "assistant", None)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, formatted int")
    formatted = chat.format_conversations(chat.as_events(turns))
    back = formatted.select("conv_id", chat.parsed(formatted["formatted"]).alias("t"), chat.masked(formatted["formatted"], formatted["loss_spans"]).alias("l")).collect()
    got = {r.conv_id: ([(x.role, x.text) for x in r.t], r.l) for r in back}
    for i in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == i), key=lambda r: (r[1] is not None, r[1] or 0))
        assert got[i] == ([(r[2] or "", r[3] or "") for r in own], "".join(r[3] or "" for r in own if r[2] == "assistant"))
    d = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert d[0].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows if r[0] == 0).encode()).hexdigest() and d[0].n_turns == len(odd)


def test_chat_log_folds_back_to_the_turns(spark):
    said = ["", "a", "ab", "abc", "Hello é漢😀 <|im_end|>", None, "x" * 10_000]
    turns = spark.createDataFrame([(c, t, ("user", "assistant", None)[(c + t) % 3], s) for c in range(3) for t, s in enumerate(said)] + [(None, None, "user", "lost")], "conv_id long, turn int, role string, text string")
    log = chat.as_log(turns)
    assert {r.event for r in log.select("event").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    say = lambda df: sorted(map(str, df.select("conv_id", "message", "role", "text").collect()))
    assert say(chat.folded(log)) == say(chat.folded(chat.as_events(turns)))
    assert chat.folded(chat.as_log(turns.limit(0))).collect() == []


# HTML

NOISE = '<nav class=menu><a href="/">Home</a></nav><div class="ad">Buy</div><aside>Side</aside><form><p>Search</p></form>'
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="<p>no</p>";</script></head><body>{noise}
<div class="content c17"><h1>Title &amp; more</h1><p>First&nbsp; para <b>bold</b>
<p>Second <a href=x>link</a> para that is long enough to count.<br>line<ul><li>One<li>Two</ul><div class="comments"><p>Great post, I agree with all of it, really.</p></div></div>
<footer><p>&copy; 2024</p></footer>"""


def test_html_main_text():
    page = html.Page(PAGE.format(noise=NOISE))
    assert page.text(None) == "Title & more\n\nFirst para bold\n\nSecond link para that is long enough to count. line\n\nOne\n\nTwo"
    assert max(page.votes(), key=page.votes().get) == "html>body>div.c.content"


@pytest.mark.parametrize("source", ["", "<", "<p", "plain words", "<p>a", "</p></div>", "<!-- open", "<script>x", "<div " * 50, "<div>" * 2000 + "deep", "<p>a&#x41;&bogus;&lt;b&gt;", "<article></article>"])
def test_html_broken_pages(source):
    html.Page(source).text(None)


def test_html_consensus_wins_over_a_page_of_its_own(spark):
    long = "<p>" + "Good words here. " * 20 + "</p>"
    pages = [(i, "http://Site.example/a", f'<body><div class="post p{i}">{long}</div><div class="x"><p>Promo text for all.</p></div></body>', "") for i in range(6)]
    pages += [(6, "http://site.example/b", f'<body><div class="post p9"><p>Short body.</p></div><div class="x">{long}{long}</div></body>', ""), (7, None, None, ""), (8, "not a url", "<p>Alone</p>", ""), (8, "not a url", "<p>Alone</p>", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.text) for r in html.extracted(df).collect())
    assert got[6] == (6, "Short body.") and got[7] == (7, "") and got[8] == got[9] == (8, "Alone") and "Promo" not in got[0][1]


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><a title=it's href=x>One</a><p>Second</p><p class='related-work'>Related</p><p>Third</p></article>", "One\n\nSecond\n\nRelated\n\nThird"),
        ("<article><h1 class=post-header>Head</h1><div class=header><p>Lead</p></div><p>Body</p><div class=comments><p>c</p></div><p class=advert>Buy</p></article>", "Head\n\nLead\n\nBody"),
        ("<body>" + "<div>" * 2000 + "<nav>MENU</nav><p>text", "text"),
        ("<article><p><a href=x>" + "long link " * 40 + "</a></p></article>", ("long link " * 40).strip()),
        ("<body><ul><li><a href=x>Menu</a><li><a href=y>More</a></ul><p><a href=z>One link</a></p><p>text</p>", "One link\n\ntext"),
        ("<article><p>Text</p><ul><li><a href=x>Source</a></ul></article>", "Text\n\nSource"),
        ("a < b <p>c", "a < b\n\nc"),
        ("<p>a</p><!--> <p>b</p><!-- <p>no</p> --!", "a\n\nb"),
        ("<article><p>" + "w " * 400_000 + "</article>", ("w " * 400_000).strip()),
    ],
)
def test_html_keeps_the_article_and_nothing_else(source, text):
    assert html.Page(source).text(None) == text


@pytest.mark.parametrize("part", ["<a ", "<", '<a x="', "<a x='", "<p><b>", "</i><b>", "<div>", "<!--", "</", "<div class=a>"])
def test_html_is_read_in_linear_time(part):
    began = time.perf_counter()
    html.Page("<article><i>" + part * (1_000_000 // len(part))).text(None)
    assert time.perf_counter() - began < 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["nav", "p", "div", "div class=ad", "footer", "article", "section", "aside", "ul"]).flatmap(lambda t: st.tuples(st.just(t), st.integers(0, 9), st.integers(0, 3))), max_size=25))
def test_html_skips_as_a_tree_walk_does(parts):
    # Well-formed pages: (tag, word, how many open elements end before it). The oracle walks the tree.
    source, stack, said = "<article>", [], []
    for tag, word, ends in parts:
        for _ in range(min(ends, len(stack))):
            source += f"</{stack.pop().split()[0]}>"
        if tag == "article" or (stack and stack[-1] == "p"):
            continue
        stack.append(tag)
        source += f"<{tag}><div>w{word}</div>" if tag != "p" else f"<p>w{word}"
        if not any(t in ("nav", "div class=ad", "footer", "aside") for t in stack):
            said.append(f"w{word}")
    source += "".join(f"</{t.split()[0]}>" for t in reversed(stack)) + "</article>"
    assert html.Page(source).text(None) == "\n\n".join(said)


# WARC


def test_warc_round_trip(spark):
    body = "<p>" + "é" * 200 + "</p>"
    rows = [(5, "http://a/ü?x=1", body), (3, None, body), (9, "u\r\nEvil: 1", body), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", body), (10, "v", "x" * 500_000)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = sorted(warc.read_archives(warc.archived(pages)).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [r.page_id for r in got] == [3, 4, 5, 6, 7, 8, 9, 10, None]
    assert [r.refers_to for r in got] == [None, None, 3, None, None, None, 3, None, None]
    for r, said in zip(got, [x[2] or "" for x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))], strict=True):
        assert r.payload_bytes == len(said.encode()) and r.payload_digest == hashlib.sha256(said.encode()).hexdigest()
        assert r.payload == (said.encode() if r.record_type == "response" else None) and (r.record_type == "revisit") == (r.refers_to is not None)


def test_warc_reader_takes_any_chunks_and_finds_damage():
    data = [warc.record(i, "u", b"payload%d" % i, hashlib.sha256(b"payload%d" % i).hexdigest(), None) for i in range(3)]
    packed = b"".join(map(warc.member, data))
    for size in (1, 7, 10**6):
        found = [warc.parsed(*r) for r in warc.records(packed[i : i + size] for i in range(0, len(packed), size))]
        assert [f[0] for f in found] == [0, 1, 2] and found[2][6] == b"payload2"
    for broken in (packed[:-5], packed[:40] + b"\0\0" + packed[42:], warc.member(data[0][:-1]), warc.member(data[0].replace(b"payload0", b"payloadX"))):
        with pytest.raises(ValueError):
            list(warc.records(iter([broken])))


def test_warc_of_an_empty_table(spark):
    assert warc.read_archives(warc.archived(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


# Nearest neighbours


@pytest.mark.parametrize("sample, heavy", [(20_000, 10_000), (200, 2)])
def test_neighbours_against_brute_force(spark, monkeypatch, sample, heavy):
    monkeypatch.setattr(ann, "GROUP_ROWS", 300)
    monkeypatch.setattr(ann, "SAMPLE", sample)
    monkeypatch.setattr(ann, "HEAVY", heavy)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(20, 8)).repeat(60, axis=0) + rng.normal(size=(1200, 8)) * 0.3, np.tile(rng.normal(size=8), (700, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)] + [(5000, None, ""), (5050, [0.0] * 8, ""), (5100, [float("nan")] + [1.0] * 7, ""), (5150, [None] + [1.0] * 7, ""), (5200, [1.0] * 3, ""), (None, [1.0] * 8, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = {}
    for r in ann.neighbours(df, lambda v: v % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, len(x), 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for _, v, s in own)
        hit += len({v for _, v, _ in own} & set(best.tolist()))
        if q >= 1200:  # ties go to the smaller id
            assert [v for _, v, _ in own] == best.tolist()
    assert len(got) == 38 and hit >= 0.9 * 380


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_leaves_and_visits_stay_small_as_rows_grow(spark, monkeypatch, n):
    monkeypatch.setattr(ann, "SAMPLE", 1_000)
    seen = {}
    visits, deepened = ann._visits, ann._deepened
    monkeypatch.setattr(ann, "_visits", lambda tree, *rest: seen.setdefault("visits", visits(tree, *rest)))
    monkeypatch.setattr(ann, "_deepened", lambda tree, index, counts, seed: seen.update(counts=counts) or deepened(tree, index, counts, seed))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 16))[rng.integers(0, 50, n)] + rng.normal(size=(n, 16)) * 0.4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, lambda v: v % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 10 * len(got) and len(got) == n // 100
    assert max(seen["counts"].values()) <= ann.FULL and seen["visits"] * ann.LEAF < 0.5 * n


def test_neighbours_of_few_rows(spark):
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda v: v == 0).collect() == []
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.neighbours(df, lambda v: v == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]


# Sharding


def test_sharding_law_and_order(spark):
    rows = [(i, f"t{i}", None, i % 3, {"a": i}) for i in range(500)] + [(7, "same", "x", 1, None)] * 250 + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, _bucket int, m map<string,int>")
    sharded = sharding.shard(df, 24, seed=3, bucket_bytes=4000)
    got = sharded.collect()
    assert sharded.columns == ["doc_id", "text", "_bucket", "m", "shard", "slot"]
    assert Counter((r.doc_id, r.text, r._bucket) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    place = {r.doc_id: r.slot + 32 * r.shard for r in got if r.text != "same"}
    ids = [i for i in range(500) if i != 7]
    assert abs(np.corrcoef(ids, [place[i] for i in ids])[0, 1]) < 0.2


def test_sharding_is_decided_by_seed_and_rows(spark):
    rows = [(i % 300, f"t{i % 300}") for i in range(400)]
    placed = lambda df, seed=3: sorted(map(str, sharding.shard(df, 7, seed, bucket_bytes=2000).collect()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = placed(df)
    for n in (1, 3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert placed(df.repartition(n)) == first
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert placed(df, 4) != first


def test_fisher_yates_by_its_definition(spark):
    def by_hand(n):
        out = list(range(1, n + 1))
        for i in range(n, 1, -1):
            j = drawn[i] % i + 1
            out[i - 1], out[j - 1] = out[j - 1], out[i - 1]
        return out

    drawn = {r.id: r.d for r in spark.range(200).select("id", F.xxhash64(F.lit(9), F.col("id").cast("int")).alias("d")).collect()}
    got = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 50, 150)], "n int").filter("n > 0").select("n", sharding.fisher_yates(F.col("n"), lambda i: F.xxhash64(F.lit(9), i)).alias("p")).collect()
    assert all(r.p == by_hand(r.n) for r in got) and len(got) == 5


def test_sharding_of_an_empty_table_and_files(spark, tmp_path):
    assert sharding.shard(spark.createDataFrame([], "doc_id long"), 24).collect() == []
    out = sharding.shard(spark.range(100).withColumnRenamed("id", "doc_id"), 4, bucket_bytes=200)
    sharding.write(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "shard=2")).count() == 25


def test_sharding_query_against_its_definition(spark, tmp_path):
    from chronoloom.llm import queries

    rows = [(i, "é" * (i % 40) if i % 9 else None, "x") for i in range(100)] + [(100 + i, "same", "x") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_two_pass_shuffle(spark, str(tmp_path)).collect()
    said = {i: (t or "").encode() for i, t, _ in rows}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len(b) + 8, zlib.crc32(b)) for i, b in said.items())
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert Counter(r.shard for r in got) == Counter({s: 7 if s < 160 % 24 else 6 for s in range(24)})
