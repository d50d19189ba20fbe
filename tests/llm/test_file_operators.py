"""Packing, media shards, archives, chat, pages, quality and the pipeline."""

import dataclasses
import hashlib
import io
import math
import re
import tarfile
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import plain
from graphloom.llm import chat, extraction, media, packing, quality, queries, stores, vocab, warc

# -- Packing


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 60), st.lists(st.integers(1, 60), max_size=120))
def test_runs_are_best_fit_decreasing(capacity, lengths):
    lengths = [min(n, capacity) for n in lengths]
    runs, used, taken = defaultdict(list), Counter(), set()
    for run in packing.place_runs(Counter(lengths).items(), capacity):
        runs[run[0]].append(run)
    for length, number in Counter(lengths).items():
        for nth in range(number):
            _, first, sequence, each, offset = max(r for r in runs[length] if r[1] <= nth)
            sequence, at = sequence + (nth - first) // each, offset + (nth - first) % each * length
            for x in range(at, at + length):
                assert (sequence, x) not in taken
                taken.add((sequence, x))
            used[sequence] += length
    assert all((s, x) in taken for s, n in used.items() for x in range(n))
    assert sorted(capacity - n for n in used.values()) == plain.best_fit(lengths, capacity)


def check_packing(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(vocab.default_path("byte_bpe_50k.json"))
    real.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = real.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for n, r in enumerate(sorted(pieces[doc], key=lambda r: r.piece)):
            held = b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(held))
            assert n == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == len(plain.best_fit([r.length for r in rows], capacity))


def test_packing_query(spark, data, documents):
    check_packing(queries.op1_packing(spark, data).collect(), {r.doc_id: r.text for r in documents.collect()})


def test_packing_of_odd_rows(odd, nothing):
    path = vocab.default_path("byte_bpe_50k.json")
    pack = lambda df: packing.pack_documents(df, lambda: vocab.json_ids(path), 64)
    rows = pack(odd).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count() and pack(nothing).count() == 0
    ends = defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in v) == max(a + n for a, n in v) <= 64 for v in ends.values())


# -- Media


def test_media_query(spark, data, documents):
    got = {r.doc_id: r for r in queries.op2_media(spark, data).collect()}
    for r in documents.select("doc_id", "text").collect():
        data_ = (r.text or "").encode()
        payload = data_ + b" " * ((-len(data_)) % 192 or (192 if not data_ else 0))
        m = got[r.doc_id]
        assert (m.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32) == (len(data_), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (m.width, m.height * m.width) == (192, len(payload)) and m.media_sha256 == hashlib.sha256(media.to_png(payload)).hexdigest()


def test_media_read_back_equal_plain_versions(spark, data, documents, tmp_path):
    folder = f"file://{tmp_path}/m"
    manifest = media.store(documents.select("doc_id", "text"), ["doc_id"], folder=folder)
    rows = {r.doc_id: r for r in media.with_features(media.in_shard_order(manifest)).collect()}
    source = stores.Input()
    for r in documents.select("doc_id", "text").collect():
        m = rows[r.doc_id]
        png = source.read(m.shard, m.offset, m.length)
        assert (hashlib.sha256(png).hexdigest(), len(png)) == (m.media_sha256, m.media_bytes) and png[:8] == b"\x89PNG\r\n\x1a\n"
        # Chunks as the format has them: length, kind, data, checksum; lines with a filter byte before them.
        at, chunks = 8, {}
        while at < len(png):
            size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
            chunks[kind] = png[at + 8 : at + 8 + size]
            assert zlib.crc32(png[at + 4 : at + 8 + size]) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
            at += 12 + size
        lines = zlib.decompress(chunks[b"IDAT"])
        assert chunks[b"IHDR"] == (192).to_bytes(4, "big") + (len(lines) // 193).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0]) and set(lines[::193]) == {0}
        samples = [x for i, x in enumerate(lines) if i % 193]
        counts, n = Counter(samples), len(samples)
        mean = sum(samples) / n
        spread = (sum((x - mean) ** 2 for x in samples) / n) ** 0.5
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        eighths = [sum(c for x, c in counts.items() if x // 32 == k) / n for k in range(8)]
        assert [float(x) for x in m.feature.split(",")] == pytest.approx([mean, spread, entropy, *eighths], abs=6e-5)


def test_shards_are_tar_files_and_copies_are_stored_once(odd, nothing, tmp_path):
    manifest = media.store(odd.coalesce(1), ["doc_id"], folder=f"file://{tmp_path}/m")
    rows = manifest.collect()
    assert len(rows) == odd.count() and manifest.columns[0] == "doc_id"
    (path,) = {r.shard for r in rows}
    with tarfile.open(fileobj=io.BytesIO(stores.Input().read(path, 0, stores.opened(path)[0].get_file_info(stores.opened(path)[1]).size))) as tar:
        members = {m.name.removesuffix(".png"): tar.extractfile(m).read() for m in tar.getmembers()}
    assert set(members) == {r.digest for r in rows} and all(hashlib.sha256(v).hexdigest() == k for k, v in members.items())
    assert len({(r.offset, r.digest) for r in rows}) < len(rows)
    assert media.media_columns(nothing, ["doc_id"]).count() == 0


def test_damaged_media_is_refused():
    png = media.to_png(b"x" * 192)
    assert media.from_png(png) == b"x" * 192
    for at in (3, 20, 45):
        with pytest.raises((ValueError, zlib.error)):
            media.from_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])


# -- Archives


def test_archive_round_trip(tmp_path):
    for number in (1, 3000):
        archive = warc.Archive(f"file://{tmp_path}/{number}.warc.zst")
        pages = [(i, f"http://x/{i} y", f"<p>page {i} {'text ' * 80}</p>".encode()) for i in range(number)]
        for i, url, body in pages:
            archive.add(warc.record(i, url, body, None, "2024-01-01T00:00:00Z"))
        archive.close()
        held = (tmp_path / f"{number}.warc.zst").read_bytes()
        assert held[:4] == b"\x5d\x2a\x4d\x18"
        got = list(warc.records(f"file://{tmp_path}/{number}.warc.zst", piece=1000))
        assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == [p[2] for p in pages]
        assert got[0][0]["WARC-Target-URI"] == "http://x/0%20y"
        (tmp_path / "cut.warc.zst").write_bytes(held[:-3])
        with pytest.raises(Exception):
            list(warc.records(f"file://{tmp_path}/cut.warc.zst"))


@pytest.mark.parametrize("change", [lambda d: d.replace(b"WARC/1.1", b"WARC/9.9"), lambda d: d.replace(b"Content-Length: 89", b"Content-Length: 88"), lambda d: d.replace(b"WARC-Date", b"X-Date"), lambda d: d[:-1]])
def test_bad_records_are_refused(change):
    data = warc.record(1, "u", b"x" * 10, None, "d")
    assert warc.parsed(data)[0]["WARC-Type"] == "response"
    with pytest.raises(ValueError):
        warc.parsed(change(data))


def test_archives_of_odd_pages(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (2, None, "same"), (None, "u\r\nX: y", "same"), (3, "u", None), (4, "u", ""), (None, "u", "alone"), (5, "u", "é" * 20_000)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, key string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).collect()), key=repr)
    assert got == sorted([(1, 4, "response", None), (2, 4, "revisit", 1), (2, 4, "revisit", 1), (None, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (None, 5, "response", None), (5, 40_000, "response", None)], key=repr)
    least = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, least_bytes=5)).collect()}
    assert least[2] == "response"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


# -- Chat


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>[]/\\sINSTYrole ab")))
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(rf"[<\[](?:{chat.CONTROL})", chat.escape(text))


pieces = st.sampled_from(["<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>", "<</SYS>>", "\n", "\\", "<", "a ", "<role>", "</role>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>"]), st.lists(pieces, max_size=6).map("".join)), max_size=6), st.integers(1, 7))
def test_conversations_are_read_back(turns, step):
    text, spans = chat.render(chat.HOUSE, messages=[{"role": r, "text": t} for r, t in turns])
    got = []
    reader = chat.TurnReader(lambda role, t: got.append((role, t)))
    for i in range(0, len(text), step):
        reader.feed(text[i : i + step])
    reader.close()
    assert got == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def test_templates():
    source = "{% for x in xs %}{% if not loop.first %}, {% endif %}{% if x.a == 'b' + 'c' or x['n'] in 'xyz' %}{% generation %}{{ x.a | upper }}{% endgeneration %}{% else %}{{ x.n }}{% endif %}{% endfor %}!"
    assert chat.render(source, xs=[{"a": "bc"}, {"a": "q", "n": "y"}, {"n": "w"}]) == ("BC, Q, w!", [(0, 2), (4, 5)])
    assert chat.fold_body(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == (chat.Put(chat.Const("abCd")),)
    assert chat.render("{{ x.__class__ }}{{ x['y'].z }}", x="text")[0] == ""
    for bad in ("{{ x( }}", "{{ open('f') }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x | exec }}", "{% include 'x' %}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "a"), (None, 0, "user", "x"), (2, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.turns_sha256) for r in chat.formatted(df).collect()}
    assert got == {1: (4, 1, hashlib.sha256(b"\n\nuser\na\nuser\na\nassistant\nb\n").hexdigest()), None: (1, 0, hashlib.sha256(b"user\nx\n").hexdigest()), 2: (1, 100_000, hashlib.sha256(b"assistant\n" + b"z" * 100_000 + b"\n").hexdigest())}
    assert chat.formatted(df.limit(0)).count() == 0


# -- Pages


def wanted(page):
    import html

    main = page[page.index("<article>") : page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:article|h1|p)>|<br>", main))
    return "\n".join(b for b in blocks if b)


def test_main_text_of_held_out_pages(spark, data):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect()]
    model = extraction.train(pages[::2])
    assert all(model.main_text(p) == wanted(p) for p in pages[1::2])
    # Also where the names that labels come from are missing.
    bare = lambda p: re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", p).replace(' class="ad"', "")
    hit = [model.main_text(bare(p)) == wanted(p) for p in pages[1::2]]
    assert sum(hit) >= 0.9 * len(hit)


@pytest.mark.parametrize("head", [
    "<html><head><title>x</title><body>", "<html><head><title>x</title>", "<head><meta charset=utf-8><script>var a</script><style>p</style>", "<head><head><title>x</title></head>",
    "<body><svg width=1 />", "<body><math/>", "<body><svg><path d=''/><title>no</title>no</svg>", "<head><template>no <p>no</p></template><title>x</title><body>",
])
def test_a_head_left_open_and_an_empty_svg_keep_the_text(head):
    for body in ("<article><p>Some text.</p></article>", "<span>Some text.</span>", "Some text."):
        assert [text for _, text in extraction.read_page(head + body)[1]] == ["Some text."]


def test_marginals_are_those_of_all_labellings():
    from itertools import product
    from math import exp, prod

    model = extraction.train(["<article><h1>A title here</h1><p>Some text, more text.</p></article><nav><ul><li><a>x</a></ul></nav>"] * 3)
    elements, _ = extraction.read_page("<div><h1>Title</h1><p>Text, and text.</p></div><nav><ul><li><a>link</a></ul></nav>")
    seen = extraction.features(elements)
    weight, total = [0.0] * len(elements), 0.0
    for labels in product((0, 1), repeat=len(elements)):
        w = prod(exp(sum(model.weights.get(x, 0) for x in f)) if y else 1.0 for f, y in zip(seen, labels))
        for i in range(1, len(elements)):
            pair = model.pair.get(model.kind(seen[i]), extraction._NEUTRAL)
            w *= exp(pair[labels[elements[i].parent]][labels[i]])
        total += w
        weight = [a + w * y for a, y in zip(weight, labels)]
    assert model.marginals(elements, seen)[0] == pytest.approx([w / total for w in weight])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<article><p>a<br>b &amp; &lt;c&gt;<p>d <b>e</b>f</article>", "a b & <c>\nd ef"), ("<article><script>var t='</p>'</script><p>x<!-- y --></p></article><footer>z", "x"),
    ("<main><div class='comments'><p>one says</p></div><h1>T</h1><p>text &nbsp; more</p><form><p>mail</p></form></main>", "T\ntext more"), ("<article><p>cut off &am", "cut off &am"), ("<article><p>a</p><di", "a"),
])
def test_page_details(spark, data, page, text):
    model = extraction.train([r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()])
    pages = spark.createDataFrame([(1, page, "q"), (1, page, "q"), (None, page, "q")], "page_id long, html string, text string")
    got = extraction.extracted(pages, model, ["page_id"]).collect()
    assert [r.text for r in got] == [text] * 3 and got[0].n_chars == len(text)
    assert extraction.extracted(pages.limit(0), model, ["page_id"]).count() == 0


WORDS = " ".join(f"lorem{i % 37} ipsum," if i % 9 == 0 else f"dolor{i % 53}" for i in range(200)) + "."
NAV = "<nav><a href=/>Home</a> <a href=/b>Blog</a></nav>"


def article(inside):
    return f"{NAV}<article><h1>T</h1><p>{WORDS}</p>{inside}</article><footer>c 2020</footer>"


PROBES = {
    f"<body><p>{WORDS}</p></body>": [WORDS],
    f"<div id=nav><a href=/>Home</a> <a href=/b>Blog</a></div><div id=content><h1>Title here</h1><p>{WORDS}</p><ul><li>first item</li><li>second item</li></ul><pre>x = 1\ny = 2</pre></div>": ["Title here", WORDS, "first item", "second item", "x = 1 y = 2"],
    f"{NAV}<article><h1>T</h1><p>{WORDS}</p><table><tr><td>cell one</td><td>cell two</td></tr></table><p>{WORDS}</p></article><footer>c 2020</footer>": ["T", WORDS, "cell one", "cell two", WORDS],
    f"{NAV}<article><h1>T</h1><p>{WORDS}</p><section id='shared-memory'><h2>Shared memory</h2><p>{WORDS}</p></section></article><footer>c 2020</footer>": ["T", WORDS, "Shared memory", WORDS],
    f"{NAV}<article><h1>T</h1><p>{WORDS}</p><div class='comments'><p>nice post!</p></div></article>": ["T", WORDS],
    "<p>Hello there.</p>": ["Hello there."],
    # A paragraph that is one link, and sections whose names only may mean no content.
    article(f"<p><a href=x>See this link only</a></p><p>{WORDS}</p>"): ["T", WORDS, "See this link only", WORDS],
    article(f'<section class="related work"><h2>Related work</h2><p>{WORDS}</p></section>'): ["T", WORDS, "Related work", WORDS],
    article(f'<section id="social-impact"><h2>Social impact</h2><p>{WORDS}</p><p>{WORDS}</p></section>'): ["T", WORDS, "Social impact", WORDS, WORDS],
    article(f'<div class="menu design"><p>{WORDS}</p></div>'): ["T", WORDS, WORDS],
    article('<div class="related"><ul><li><a href=1>Other page</a></li><li><a href=2>More of it</a></li></ul></div>'): ["T", WORDS],
    article('<div class="social"><a href=1>Tweet</a> <a href=2>Like</a></div>'): ["T", WORDS],
    article(f'<div class="comments"><p>{WORDS}</p><p>{WORDS}</p></div>'): ["T", WORDS],
    article(f"<p><label>lab</label></p><p>{WORDS}</p>"): ["T", WORDS, WORDS],
    article(f"<label>lab<p>{WORDS}</p>"): ["T", WORDS, WORDS],
    article("<h2>References</h2><ol><li><a href=1>First source of it, 2001</a></li><li><a href=2>Second source, 2002</a></li></ol>"): ["T", WORDS, "References", "First source of it, 2001", "Second source, 2002"],
    # Shapes that training doesn't make.
    article(f"<details><summary>In short</summary><p>{WORDS}</p></details>"): ["T", WORDS, "In short", WORDS],
    article(f"<address>Written in Rome.</address><p>{WORDS}</p>"): ["T", WORDS, "Written in Rome.", WORDS],
    article(f"<p>Short.</p><p>{WORDS}</p><hr><p>End.</p>"): ["T", WORDS, "Short.", WORDS, "End."],
    f'<body class="has-sidebar no-banner">{NAV}<main class="with-nav"><h1>T</h1><p>{WORDS}</p></main><div class="sidebar"><p>other things</p></div></body>': ["T", WORDS],
    f'<div class="page with-sidebar">{NAV}<article><h1>T</h1><p>{WORDS}</p></article><div class="sidebar"><p>other things</p></div></div>': ["T", WORDS],
    f'<div class="nav"><a href=1>a</a> <a href=2>b</a></div><div id="post"><h1 class="header">Title</h1><p>{WORDS}</p><p><a href=3>go on</a></p><p>{WORDS}</p></div><div class="footer">c 2020</div>': ["Title", WORDS, "go on", WORDS],
    "just text": ["just text"],
}


@pytest.fixture(scope="module")
def page_model(spark):
    return extraction.trained_on(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("page", list(PROBES))
def test_pages_of_other_shapes(page_model, page):
    assert page_model.main_text(page) == "\n".join(PROBES[page])


# -- Quality


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = [r for r in queries.op10_quality(spark, big).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good = [r.score for r in rows if labels[r.doc_id] == 1]
    bad = [r.score for r in rows if labels[r.doc_id] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.95


def test_long_texts_are_read_whole():
    net = quality.fit(["good text, and more of it. " * 20] * 20 + ["BAD!! TEXT!! " * 40] * 20, np.array([1.0] * 20 + [0.0] * 20), epochs=6)
    text = "good text, and more of it. " * 9000
    assert net.score(text) > 0.8 and net.score(text + "BAD!! TEXT!! " * 60) < 0.5 > net.score("BAD!! TEXT!! " * 60 + text)
    small = dataclasses.replace(net, window=8)
    assert small.score(text[:9999]) == pytest.approx(net.score(text[:9999]), abs=1e-5)


def plain_score(net, text):
    """The network as loops over chunks, steps and places."""
    data, width = text.encode(), len(net.table)
    number = max(1, -(-len(data) // net.stride))
    data = data.ljust((number - 1) * net.stride + width, b"\0")
    held = [np.maximum(net.bias + sum(net.table[p, data[s * net.stride + p]] for p in range(width)), 0) for s in range(number)]
    firsts = [0] if number <= net.chunk else sorted({*range(0, number - net.chunk + 1, net.chunk // 2), number - net.chunk})
    units = [np.maximum(np.mean(held[a : a + net.chunk], axis=0) @ net.mix + net.mix_bias, 0) for a in firsts]
    return 1 / (1 + np.exp(-(np.max(units, axis=0) @ net.out + net.out_bias)))


def small_net():
    net = quality.fit(["good text, and more. " * 9] * 8 + ["BAD!! " * 30] * 8, np.array([1.0] * 8 + [0.0] * 8), filters=3, width=4, hidden=5, steps=3)
    return dataclasses.replace(net, chunk=8, table=net.table.astype(float), bias=net.bias + 0.2, mix=net.mix.astype(float), mix_bias=net.mix_bias + 0.05, out=net.out.astype(float))


def test_scores_equal_the_plain_network():
    net = small_net()
    for text in ("", "a", "good text", "é" * 50, "BAD!! text " * 40, "x y " * 7):
        assert net.score(text) == pytest.approx(plain_score(net, text), abs=1e-9)
        assert dataclasses.replace(net, window=1).score(text) == pytest.approx(plain_score(net, text), abs=1e-9)


def test_gradients_equal_differences():
    net, labels = small_net(), np.array([1.0, 0.0, 1.0])
    data = [net.padded(t) for t in ("good text, and more", "BAD!! BAD!! " * 5, "of it é")]
    loss = lambda n: quality.gradients(n, data, labels)[0]
    found, draw, step = quality.gradients(net, data, labels)[1], np.random.default_rng(1), 1e-6
    for name in quality.LEARNED:
        value = np.asarray(getattr(net, name), float)
        live = [i for i in np.ndindex(value.shape) if found[name][i] != 0] or [()]
        for at in [live[k] for k in draw.integers(0, len(live), 12)]:
            ends = []
            for sign in (1, -1):
                moved = value.copy()
                moved[at] += sign * step
                ends.append(loss(dataclasses.replace(net, **{name: float(moved) if name == "out_bias" else moved})))
            assert found[name][at] == pytest.approx((ends[0] - ends[1]) / (2 * step), abs=1e-6)


def test_gradients_of_a_long_text_need_little_memory():
    net = small_net()
    data = [net.padded("good text, and more of it. " * 200_000), net.padded("BAD!! " * 9)]
    tracemalloc.start()
    whole = quality.gradients(net, data, np.array([1.0, 0.0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    small = quality.gradients(dataclasses.replace(net, window=50), data, np.array([1.0, 0.0]))
    assert whole[0] == pytest.approx(small[0]) and all(np.allclose(whole[1][k], small[1][k], atol=1e-9) for k in quality.LEARNED)


def test_training_takes_rows_within_its_bounds(spark):
    rows = [(i, "some text " * 5) for i in range(30)] + [(100, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, quality int")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "fit", lambda texts, labels: seen.append(texts))
        quality.train(docs, labels)
        quality.train(docs, labels, longest=2999)
        quality.train(docs, labels, longest=2999, sample_bytes=525)
        quality.train(docs, labels, sample_rows=3)
    free = sum(zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows)
    held = zlib.crc32(b"100") % 5 == 0
    assert [len(t) for t in seen] == [free, free - (not held), 10, 3]


def test_repeated_ids_give_one_model(spark):
    rows = [(i, f"{w} text {i} " * 20) for i in range(20) for w in ("some", "other")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    nets = [quality.train(spark.createDataFrame(r, "doc_id long, text string").repartition(3), labels, steps=2) for r in (rows, rows[::-1])]
    assert (nets[0].table == nets[1].table).all() and nets[0].out_bias == nets[1].out_bias


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    net = quality.train(odd, labels, epochs=1)
    got = quality.scored(odd, net, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.rejecting(odd, net, 0.0).columns == odd.columns
    none = quality.train(odd, labels.limit(0))
    assert quality.scored(nothing, none, ["doc_id"]).count() == 0 and none.score("x") > 0.5


# -- Pipeline


def test_pipeline_stage_by_stage(spark, data, documents):
    import corpus_pipeline as p

    docs, seen = documents, {}
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = p.written(stage(spark, docs, data), "test")
        if name != p.STAGES[-1][0]:
            assert docs.columns == documents.columns
            seen[name] = before, {r.doc_id: r.text for r in docs.collect()}
    net = quality.train(documents, spark.read.parquet(f"{data}/labels.parquet"))
    before, after = seen["quality classifier"]
    assert after == {i: t for i, t in before.items() if net.score(t or "") >= p.LEAST_QUALITY}
    before, after = seen["exact dedup"]
    first = {}
    for i, t in sorted(before.items()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
    assert set(after) == set(first.values())
    before, after = seen["n-gram jaccard join"]
    assert set(after) == {r[0] for r in plain.near_duplicates(list(before.items())) if r[0] == r[1]}
    before, after = seen["pii"]
    assert set(after) == set(before)
    for i, t in before.items():
        spans = plain.base_spans(t)
        assert (after[i] == t) or spans
        assert all(t[int(a) : int(b)] not in after[i] for kind, a, b in (s.split(":") for s in spans) if kind == "email")
    check_packing(docs.collect(), after)


def test_pipeline_of_odd_rows(spark, odd, nothing, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, 1), (6, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, nothing, odd.select("doc_id", "text")):
        for name, stage in p.STAGES[:-1]:
            after = p.written(stage(spark, docs, str(tmp_path)), "test")
            assert after.columns == docs.columns and after.count() <= docs.count()
            docs = after
        packed = p.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.filter("piece = 0").count() == docs.count()
