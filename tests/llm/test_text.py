"""BPE, language, media, shards and pages against libraries, round trips and held-out labels."""

import collections
import hashlib
import html
import json
import random
import re
import zlib

import edge
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismill.llm import bpe, langid, ogg, queries, tokenbin, wrappers
from prismill.llm.store import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = bpe.read_spec(PATH)
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.WordEncoder(SPEC)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab'slTt \x1c<|endoftext|>é1²", max_size=60))
def test_ids_and_texts_equal_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert OWN.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("ab'sT \x1c\u00a0\n<|endoftext|>é1²", max_size=40), max_size=8))
def test_texts_encoded_together_equal_the_library(texts):
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in OWN.encode_all(texts)] == want
    assert [x.tolist() for x in bpe.library(SPEC).encode_all(texts)] == want


def test_words_stay_with_a_worker_up_to_a_limit(monkeypatch):
    code = bpe.WordEncoder(bpe.read_spec(queries.tokenizer_path()))
    want = [x.tolist() for x in code.encode_all(["some words of a text", None, "other words"])]
    code.forget()
    assert len(code.table.keys) > 0
    monkeypatch.setattr(bpe, "KEEP_BYTES", 100)
    code.forget()
    assert len(code.table.keys) == 0 and [x.tolist() for x in code.encode_all(["some words of a text", None, "other words"])] == want


def test_special_tokens_in_texts():
    for text in ("<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "it's <| endoftext|>"):
        assert np.frombuffer(OWN.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_small_memory_gives_the_same_ids():
    small = bpe.WordEncoder(SPEC, cached_words=3)
    text = " ".join(f"word{i % 17}" for i in range(200))
    assert small.encode(text) == OWN.encode(text)


def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch):
    whole = bpe.wordhash.hashes
    monkeypatch.setattr(bpe.wordhash, "hashes", lambda data, a, b, seed=0: whole(data, a, b, seed) if seed else whole(data, a, b) % np.uint64(3))
    code = bpe.WordEncoder(SPEC)
    for _ in range(2):
        for texts in (["one two three four five", "two six one"], ["seven one"]):
            assert [x.tolist() for x in code.encode_all(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["op2_language", "op3_bpe", "op6_token_shards", "op7_repeats", "op8_media", "op9_main_text"])
def test_results_do_not_depend_on_files_and_batches(spark, tiny, tmp_path, monkeypatch, name):
    """The same rows, dealt at random over seven files and in batches of three texts."""
    for table in ("documents", "pages"):
        spark.read.parquet(f"{tiny}/{table}.parquet").repartition(7).write.parquet(str(tmp_path / f"{table}.parquet"))
    want = sorted(map(str, queries.QUERIES[name](spark, tiny).collect()))
    monkeypatch.setattr(bpe.texts, "__defaults__", (2000,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, queries.QUERIES[name](spark, str(tmp_path)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_round_trip_query(spark, tiny):
    got = {r.doc_id: r for r in queries.op3_bpe(spark, tiny).collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(spark):
    docs = edge.documents(spark)
    out = bpe.decode(bpe.encode(docs, SPEC), SPEC)
    assert set(out.columns) == {*docs.columns, "decoded"}
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r.ids) == LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.key.startswith("kept")
    assert bpe.round_trip(edge.empty(spark), SPEC).count() == 0


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op2_language(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    right = got.where("lang = lang_pred").count() / got.count()
    assert right > 0.97


def test_held_out_is_the_stated_rule(spark):
    d = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("h", langid.held_out())
    for r in d.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_mixed_text_gets_spans():
    rng = random.Random(3)
    en, ru = "the quick brown fox and then that".split(), "это наш большой дом и сад".split()
    fr = "les maisons sont dans une grande ville avec des".split()
    counts, scripts = {}, {}
    for name, words in (("en", en), ("fr", fr), ("ru", ru)):
        some = [rng.choice(words) for _ in range(500)]
        h, _, s = langid.grams(some)
        counts[name] = np.bincount(h, minlength=langid.GRAMS)
        scripts[name] = np.bincount(s, [len(w) for w in some], len(langid._NAMES))
    model = langid.Model.of(counts, scripts)
    docs = [en + ru + fr * 2, ru, ["日本"], en[:1]]
    path, size, _ = langid.Labeller(model).label(docs)
    names = [model.languages[i] for i in path]
    assert names[: len(en)] == ["en"] * len(en) and names[len(en) : len(en) + len(ru)] == ["ru"] * len(ru)
    assert names[len(en) + len(ru) : len(en) + len(ru) + len(fr)] == ["fr"] * len(fr)
    assert size[-2] == 0  # a script that nobody uses says nothing


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(4)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(0, 6, (lengths.sum(), 3)).astype(np.float32)
    got, at = langid._viterbi(scores, lengths), 0
    for n in lengths:
        s = scores[at : at + n]
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert abs(value(tuple(got[at : at + n])) - value(best)) < 1e-3
        at += n


def test_language_edges(spark):
    docs = edge.documents(spark)
    model = langid.fit(docs)
    out = {(r.doc_id, r.text): r for r in langid.identify(docs, model, spans="spans").collect()}
    assert out[0, None].lang_pred == "und" and out[0, None].score == 0 and out[0, None].spans == []
    assert out[1, ""].lang_pred == "und" and out[2, "   \n\t "].lang_pred == "und"
    assert out[4, "one two three"].lang_pred == "en" and out[6, edge.LONG].lang_pred == "en"
    assert out[4, "one two three"].key == "kept4"
    assert langid.identify(edge.empty(spark), model).count() == 0
    signs = spark.createDataFrame([(1, "12 ½ ² Ⅷ"), (2, "日本")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(signs, model).orderBy("doc_id").collect()] == ["und", "en"]
    none = langid.fit(edge.empty(spark))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def ogg_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
def test_checksum_bit_by_bit(data):
    assert ogg.checksum(data) == ogg_checksum(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000) | st.sampled_from([0, 254, 255, 256, 510, 65025, 65026]), min_size=1, max_size=6), st.integers(0, 2**32 - 1))
def test_packets_survive_paging_and_interleaving(sizes, serial):
    packets = [(bytes([k % 251]) * n, sum(sizes[: k + 1])) for k, n in enumerate(sizes)]
    other = [(b"text/x", 0), (b"1", 1)]
    data = ogg.interleave([ogg.pages(packets, serial), ogg.pages(other, serial ^ 1)])
    streams, bad = ogg.demultiplex(data)
    assert bad == 0 and streams[serial].packets == [p for p, _ in packets] and streams[serial ^ 1].packets == [p for p, _ in other]
    assert streams[serial].positions[len(packets) - 1] == packets[-1][1]


def test_damaged_pages_are_counted_and_passed_over():
    data = bytearray(ogg.store("some text " * 20_000))
    whole, _ = ogg.demultiplex(bytes(data))
    data[len(data) // 2] ^= 1
    streams, bad = ogg.demultiplex(b"noise" + bytes(data) + b"OggS")
    assert bad >= 1 and sum(s.pages for s in streams.values()) == sum(s.pages for s in whole.values()) - 1
    assert ogg.demultiplex(None) == ({}, 0)


def test_media_query_and_edges(spark):
    docs = edge.documents(spark)
    out = ogg.described(ogg.stored(docs.drop("media"), to="media"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes > r.payload_bytes and f"{len(payload) / ogg.RATE:.4f}s" in r.feature
    assert ogg.described(ogg.stored(edge.empty(spark))).count() == 0
    assert ogg.store("same") == ogg.store("same")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=400))
def test_perfect_hash_is_minimal_and_perfect(keys):
    keys = np.array(keys, np.int64)
    h = tokenbin.Perfect.build(keys)
    assert h.size == len(keys) and sorted(h.slots(keys)) == list(range(len(keys)))


def test_shard_file_round_trip():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 60_000, n).astype("<u2") for n in (0, 5, 1, 3000, 2)]
    keys = np.array([tokenbin.NULL_KEY, -4, 7, 7, 2**40])
    s = tokenbin.Shard(tokenbin.pack(ids, keys, 2))
    assert all(np.array_equal(s.row(i), ids[i]) for i in range(5))
    assert s.find(np.array([7, 8, -4, 2**40, tokenbin.NULL_KEY])).tolist() == [2, -1, 1, 4, 0]


def test_shards_query(spark, tiny):
    got = sorted(queries.op6_token_shards(spark, tiny).collect())
    start = 0
    for r, d in zip(got, spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = [*LIBRARY.encode(d.text, add_special_tokens=False).ids, 2]
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_shards_by_key_and_edges(spark):
    docs = edge.documents(spark)
    scratch = Scratch(spark, "test")
    manifest = tokenbin.write(docs, lambda ts: bpe.library(SPEC).encode_all(ts), 2, scratch, 49408, parts=3, shard_tokens=1000)
    keys = spark.createDataFrame([(4,), (6,), (0,), (None,), (99,)], "doc_id long")
    got = {}
    for r in tokenbin.lookup(manifest, keys).collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    enc = lambda t: [*LIBRARY.encode(t, add_special_tokens=False).ids, 2]
    assert got == {4: [enc("one two three")] * 2, 6: [enc(edge.LONG)], 0: [[2]], None: [enc("a text without an id")]}
    assert tokenbin.described(manifest).count() == docs.count()
    none = tokenbin.write(edge.empty(spark), lambda ts: [], 2, scratch, 49408, parts=2)
    assert none.count() == 0 and tokenbin.described(none).count() == 0
    with pytest.raises(TypeError):
        tokenbin.write(docs.withColumn("doc_id", F.col("doc_id").cast("string")), lambda ts: [], 2, scratch, 49408)


def test_shards_are_placed_in_the_order_of_numbers(spark, monkeypatch):
    """Parts beyond 999 and shards beyond 9999 of a part, in pages of three."""
    monkeypatch.setattr(tokenbin, "PAGE", 3)
    rng = random.Random(2)
    rows = [(p, k, f"{p}/{k}", 0, 0, 1, rng.randrange(9)) for p in (0, 1, 9, 10, 999, 1000, 2500) for k in range(2)] + [(3, k, f"3/{k}", 0, 0, 1, 1) for k in (0, 9, 10, 9999, 10000)]
    rows = [(p, sorted(x[1] for x in rows if x[0] == p).index(k), *more) for p, k, *more in rows]
    rng.shuffle(rows)
    got = sorted((r.part, r.shard, r.tokens, r.before, r.page) for r in tokenbin._placed(spark.createDataFrame(rows, tokenbin.MANIFEST), Scratch(spark, "t")).collect())
    before = 0
    for i, (_, _, n, b, page) in enumerate(got):
        assert (b, page) == (before, i // 3)
        before += n


def test_lookup_over_many_pages(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "PAGE", 2)
    docs = spark.createDataFrame([(3 * i % 101, f"text {i}") for i in range(101)] + [(50, "once more")], "doc_id long, text string")
    manifest = tokenbin.write(docs, lambda ts: bpe.library(SPEC).encode_all(ts), 2, Scratch(spark, "t"), 49408, parts=9, shard_tokens=8)
    assert manifest.select("page").distinct().count() > 2
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*LIBRARY.encode(r.text, add_special_tokens=False).ids, 2])
    got = {}
    for r in tokenbin.lookup(manifest, spark.range(-5, 120).withColumnRenamed("id", "doc_id")).collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


PAGE = "<html><head><title>t</title></head><body><div class=menu><a href=/>Home</a></div><div class=body-text><h2>{}</h2>{}</div><div class='box notice'>accept</div><footer>f</footer></body></html>"


def test_wrapper_aligns_options_and_repeats():
    pages = [PAGE.format(f"T{i}", "".join(f"<p>p{i}{k}</p>" for k in range(1 + i % 3)) + "<hr>" * (i == 2)) for i in range(6)]
    w = None
    for p in pages:
        x = wrappers.wrapper(wrappers.parse(p))
        w = wrappers._joined(w, x) if w else x
    assert wrappers.pattern(w) == "html(head() body(div.menu() div.body-text(h2(#) (p(#))+ (hr())?) div.box.notice() footer()))"
    assert wrappers.content(w)[0] == ["/html/body/div.body-text"]


def test_groups_repeat():
    page = "<body><article>" + "<h3>a</h3><p>b</p>" * 3 + "</article></body>"
    assert "(h3(#) p(#))+" in wrappers.pattern(wrappers.wrapper(wrappers.parse(page))).replace("=", "#")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b &lt; c<br>d", "a b < c d"), ("<article>x<b>y</b> z</article><aside>no</aside>", "xy z"),
        ("<body><nav>n</nav><main><h1>H</h1><script>var a='</p>'</script><p>one\n  two</p><form>f</form></main></body>", "H one two"),
        ("<article><p>text</p><section class='comments'><p>first!</p></section></article>", "text"), ("<article>1 < 2 and <unknown>3</unknown></article>", "1 < 2 and 3"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"), ("<header>site</header><div><p>body of it</p></div>", "body of it"), ("<div>" * 3000 + "deep", "deep"), ("<!-- <p>no --><p>yes", "yes"),
    ],
)
def test_main_text(page, text):
    assert wrappers.main_text(page, None) == text


def test_articles_keep_what_other_pages_say_too():
    page = lambda i: f"<article><h1>T {i}</h1><p>story {i}</p><h2>Background</h2><p>more {i}</p><div class=box>Join us</div><p class=x>All figures are in euros.</p></article>"
    for n in (1, 3, 4, 5, 8, 40):
        pages = [page(i) for i in range(n)]
        rule = json.dumps(wrappers.content(merged(pages)))
        want = [f"T {i} story {i} Background more {i} Join us All figures are in euros." for i in range(n)]
        assert [wrappers.main_text(p, rule) for p in pages] == want, n


def test_named_paragraphs_go_where_the_wrapper_calls_them_template():
    page = lambda i: f"<article><p>story {i}</p><p class=advert>Buy now</p><p class='search-form'>the form of search {i}</p><p id=comment>A comment on law {i}</p></article>"
    pages = [page(i) for i in range(6)]
    rule = json.dumps(wrappers.content(merged(pages)))
    assert [wrappers.main_text(p, rule) for p in pages] == [f"story {i} the form of search {i} A comment on law {i}" for i in range(6)]
    assert wrappers.main_text(pages[0], json.dumps(wrappers.content(merged([pages[0]] * 6)))) == "story 0 Buy now the form of search 0 A comment on law 0"


def test_hosts_without_article_made_of_given_texts(spark, tiny):
    """Bars, boxes and legal lines around a text in unnamed containers; words found against words of the text."""
    docs = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) BETWEEN 200 AND 4000").orderBy("doc_id").limit(120).collect()]
    legal = "This site may not be copied, kept or sold, in whole or in part, without a written word of its owners. " * 30
    scores = {"rule": [], "alone": []}
    for host in range(6):
        own = docs[host * 20 : host * 20 + 20]
        bar = "".join(f"<a href=/{k}>Section {k} of site {host}</a> " for k in range(30))
        box = f"<div class=k{'abcdef'[host]}><p>Read what others read at site {host}</p><p>{legal}</p></div>"
        made = lambda t: f"<html><body><div class=u>{bar}</div>{box}<div class=w><div class=v><h1>A title</h1>" + "".join(f"<p>{html.escape(x)}</p>" for x in t.split("\n")) + f"</div></div><div class=z>{legal}</div></body></html>"  # noqa: E731, B023
        pages = [made(t) for t in own]
        rule = json.dumps(wrappers.content(merged(pages)))
        for t, p in zip(own, pages, strict=True):
            want = collections.Counter(("A title " + t).split())
            for name, r in (("rule", rule), ("alone", None)):
                got = collections.Counter(wrappers.main_text(p, r).split())
                both = sum((got & want).values())
                scores[name].append(2 * both / (sum(got.values()) + sum(want.values())))
    assert np.mean(scores["rule"]) > 0.95 and min(scores["rule"]) > 0.9 and np.mean(scores["rule"]) > np.mean(scores["alone"]) + 0.2


def test_wrappers_of_many_different_pages_stay_small():
    pages = [f"<body><article><h1>T {i}</h1>" + "".join(f"<div class=c{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k // 26)}{chr(97 + k % 26)}><p>x{i}{k}</p></div>" for k in range(40)) + "</article></body>" for i in range(60)]
    w = merged(pages)
    assert len(json.dumps(w)) < 100_000
    assert all(wrappers.main_text(p, json.dumps(wrappers.content(w))) == wrappers.main_text(p, None) for p in pages)


@pytest.mark.parametrize("n", [20, 300])
def test_a_wrapper_forgets_no_child(spark, n):
    """However many boxes the pages of a host have, all are known as template, in one wrapper and in partial ones that meet."""
    box = lambda k: f"<div class=k{chr(97 + k // 26)}{chr(97 + k % 26)}>box {k} says this on every page</div>"
    page = lambda i: "<html><body>" + "".join(map(box, range(n))) + f"<div class=w><p>story {' '.join(f'{i}x{k}' for k in range(9))}</p></div></body></html>"
    want = [f"story {' '.join(f'{i}x{k}' for k in range(9))}" for i in range(12)]
    rule = json.dumps(wrappers.content(merged([page(i) for i in range(12)])))
    assert [wrappers.main_text(page(i), rule) for i in range(12)] == want
    pages = spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(12)], "page_id long, url string, html string").repartition(4)
    assert [r.text for r in wrappers.extract(pages).orderBy("page_id").collect()] == want


def test_children_are_aligned_along_the_longest_common_list():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (list(map(str, rng.integers(0, rng.integers(1, 12), rng.integers(0, 15)))) for _ in "ab")
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
        length = wrappers._longest(a, b)
        assert all(length(i, j) == best[i, j] for i in range(len(a) + 1) for j in range(len(b) + 1))


def test_partial_wrappers_meet_in_rounds(spark, monkeypatch):
    """A host in more parts than a task puts together gets the same texts."""
    page = lambda i: f"<html><body><div class=a>{'the same on every page ' * 20}</div><div class=b><p>story number {i}</p></div></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(60)], "page_id long, url string, html string").repartition(30)
    monkeypatch.setattr(wrappers, "FAN_IN", 3)
    assert sorted(r.text for r in wrappers.extract(pages).collect()) == sorted(f"story number {i}" for i in range(60))


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<p>one <svg width="9" viewBox="0 0 1 1"/> two</p><p>three</p>', "one two three"),
        ("<p>one</p><svg/><p>two</p><svg><path d='M0'/><text>no</text></svg><p>three</p>", "one two three"),
        ("<p>one</p><svg><svg><text>no</text></svg><text>no</text></svg><p>two</p>", "one two"),
        ("<p>one</p><svg viewBox='0'><path d='M0'><p>two</p><p>three</p>", "one two three"),
        ("<p>one <a href='#'><svg><g><path d='M0'></a> two</p><math><mi>x</mi><p>three</p><svg></svg>", "one two x three"),
        ("<p>so <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds</p>", "so a=1 holds"),
        ("<p class=notice-board>first</p><p class='search-tip'>kept words</p><p>t</p><div class='notice'>no</div><div class='comment-list'>no</div><div id=ad-container>no</div>", "first kept words t"),
        ("<svg><title/><style/><g><title>no</g><foreignObject><p>no</p></foreignObject></svg><p>two</p>", "two"),
        ("<svg><style>a{content:'<p>no</p>'}</style></svg><p>two</p>", "two"),
        ("<div><video src='x'><source src='y'>no</div><p>two</p><object><p>no</p><object>no</object>no</object><canvas>no</canvas><p>three</p>", "two three"),
        ("<p>one <audio controls> two</p><p>three</p>", "one three"),
        ("<p>one</p><script>if (a < b) '<p>no</p>'</script><p>two</p>", "one two"),
    ],
)
def test_media_and_drawings_end_where_they_end(inside, text):
    assert wrappers.main_text(f"<html><body><article>{inside}</article></body></html>", None) == text


def merged(pages):
    w = None
    for p in pages:
        x = wrappers.wrapper(wrappers.parse(p))
        w = wrappers._joined(w, json.loads(json.dumps(x))) if w else x
    return w


def test_groups_of_any_size_repeat():
    page = "<article>" + "<h3>a</h3><p>b</p><ul><li>c</ul><pre>d</pre><dl><dd>e</dl><ol><li>f</ol>" * 3 + "</article>"
    assert "(h3(#) p(#) ul(li(#)) pre(#) dl(dd(#)) ol(li(#)))+" in wrappers.pattern(wrappers.wrapper(wrappers.parse(page))).replace("=", "#")
    twice = [["h3", "", "p"][i % 3] or "ul" for i in range(9)]
    assert wrappers._shortest(twice, 1) == 3 and wrappers._shortest(list("abcd"), 1) == 0 and wrappers._shortest(list("abacabac"), 1) == 4


def test_the_wrapper_finds_the_content_of_hosts_without_article():
    """The longest text of a page is the same on all pages: only the host tells that it is template."""
    legal, about = "These lines stand on every page and are longer than what it says. " * 4, "Who writes here, and why, at some length. " * 3
    story = lambda i: " ".join(f"word{i}x{k}" for k in range(12 + i))
    page = lambda i: f"<html><body><div class=a><p>{about}</p></div><div class=b><h1>The news</h1><p>{story(i)}</p><p>Read more each day.</p></div><div class=c><p>{legal}</p></div></body></html>"
    pages = [page(i) for i in range(8)]
    rule = json.dumps(wrappers.content(merged(pages)))
    want = [f"The news {story(i)} Read more each day." for i in range(8)]
    with_rule = [wrappers.main_text(p, rule) for p in pages]
    assert with_rule == want
    assert all(wrappers.main_text(p, None) != t for p, t in zip(pages, with_rule, strict=True))


def test_the_wrapper_chooses_among_articles():
    page = lambda i: f"<body><article class='teaser'><p>Try it now, as everybody does, it is {'very ' * 30} good</p></article><article><h1>T{i}</h1><p>story {i} goes on</p></article></body>"
    pages = [page(i) for i in range(6)]
    rule = json.dumps(wrappers.content(merged(pages)))
    assert [wrappers.main_text(p, rule) for p in pages] == [f"T{i} story {i} goes on" for i in range(6)]
    assert wrappers.main_text("<body><article class=related><p>another long text of a page</p></article><article><p>this</p></article></body>", None) == "this"


def test_slots_of_copies_alone_take_nothing_from_articles():
    page = lambda body: f"<html><body><article>{body}</article></body></html>"
    alone = ["<h1>A</h1><p>one</p><p>two</p><ul><li>item</li></ul><p>last</p>"] * 5 + ["<h1>B</h1><p>old</p><blockquote>said</blockquote>"] * 4
    pages = [page(x) for x in alone + [f"<h1>T {i}</h1><p>first {i}</p><p>second {i}</p>" for i in range(6)] + [f"<h1>U {i}</h1><p>third {i}</p><h2>Share it</h2>" for i in range(5)]]
    for order in (pages, pages[::-1], pages[::2] + pages[1::2]):
        w = None
        for p in order:
            x = wrappers.wrapper(wrappers.parse(p))
            w = wrappers._joined(w, json.loads(json.dumps(x))) if w else x
        rule = json.dumps(wrappers.content(w))
        got = [wrappers.main_text(p, rule) for p in pages]
        assert got == ["A one two item last"] * 5 + ["B old said"] * 4 + [f"T {i} first {i} second {i}" for i in range(6)] + [f"U {i} third {i} Share it" for i in range(5)]


def independent(page):
    """The blocks of a page's article by regular expressions alone, for pages that have one and nothing but text in it."""
    inside = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)[^>]*>", re.sub(r"<br\s*/?>", " ", inside))
    return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts) if x)


def test_pages_query_against_an_independent_extractor(spark, tiny):
    got = {r.page_id: r.text for r in queries.op9_main_text(spark, tiny).collect()}
    pages = [r for r in spark.read.parquet(f"{tiny}/pages.parquet").collect() if r.html.count("<article") == 1]
    inside = [re.search(r"<article[^>]*>(.*?)</article>", r.html, re.S)[1] for r in pages]
    plain = [r for r, x in zip(pages, inside, strict=True) if not re.search(r"<(?!/?(?:h1|p|b|br)\b)", x)]
    assert len(plain) > 0.9 * len(got) and [got[r.page_id] for r in plain] == [independent(r.html) for r in plain]


def test_pages_query_and_both_ways_to_apply_rules(spark, tiny, monkeypatch):
    want = {tuple(r) for r in queries.op9_main_text(spark, tiny).collect()}
    assert len(want) == spark.read.parquet(f"{tiny}/pages.parquet").count() and all(r[3] == len(r[2]) > 0 for r in want)
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in queries.op9_main_text(spark, tiny).collect()} == want


def test_pages_edges(spark):
    rows = [(1, None, None, "x"), (None, "http://[bad", "<p>hi", "x"), (1, "http://a.b/c", "", "x"), (2, "http://a.b/d", "<p>" + edge.LONG, "x"), (2, "http://a.b/d", "<p>" + edge.LONG, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = wrappers.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 5
    assert sorted(r.n_chars for r in got.collect()) == [0, 0, 2, len(edge.LONG), len(edge.LONG)]
    assert wrappers.extract(pages.limit(0)).count() == 0
