"""Exact dedup, near duplicates, PII and BPE."""

import base64
import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

import plain
from graphloom.llm import bpe, exact_dedup, near_dup, pii, queries, vocab


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    compare(queries.queries()[name](spark, data), queries.oracle_sql()[name], data)


# -- Exact dedup


def test_exact_dedup_of_odd_rows(odd, nothing):
    got = [tuple(r)[:4] for r in exact_dedup.exact_dedup(odd).collect()]
    same = [r for r in got if r[2] == 4]
    assert sorted(same, key=repr) == sorted([(1, 1, 4, True), (1, 1, 4, False), (2, 1, 4, False), (None, 1, 4, False)], key=repr)
    assert sorted((r for r in got if r[1] == 3), key=repr) == [(3, 3, 3, True), (4, 3, 3, False), (None, 3, 3, False)]
    assert len(got) == odd.count() and sum(r[3] for r in got) == 6
    assert exact_dedup.exact_dedup(nothing).count() == 0
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 8]


def test_texts_with_null_ids_only_keep_one_row(spark):
    rows = [(None, "alone"), (None, "twice"), (None, "twice "), (1, "shared"), (None, "shared")]
    docs = spark.createDataFrame([(i, t.replace("twice ", "twice")) for i, t in rows], "doc_id long, text string")
    assert sorted((tuple(r) for r in exact_dedup.drop_exact_copies(docs).collect()), key=repr) == [(1, "shared"), (None, "alone"), (None, "twice")]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted([(None, None, 1, True), (None, None, 2, True), (None, None, 2, False), (1, 1, 2, True), (None, 1, 2, False)], key=repr)


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, near_dup.drop_near_copies])
def test_ties_are_settled_by_further_columns(spark, drop):
    rows = [(1, "a b", s, {"k": m}) for s in "zyx" for m in (2, 1)] + [(1, "a  b", "x", {"k": 1}), (2, "c", "w", None)]
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame(given, "doc_id long, text string, source string, more map<string,int>").repartition(3)
        assert sorted((r.doc_id, r.text, r.source, (r.more or {}).get("k")) for r in drop(docs).collect()) == [(1, "a  b", "x", 1), (2, "c", "w", None)]


# -- Near duplicates


def test_band_plan_reaches_its_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.9999)):
        bands, rows = near_dup.band_plan(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 256


def test_jaccard_join_equals_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in near_dup.jaccard_join(documents).collect()), key=repr)
    assert got == plain.near_duplicates(rows)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{draw.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = base[:]
        words[draw.randrange(120)] = f"new{i % 40}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{draw.randrange(10_000)}" for _ in range(100))) for i in range(40)]
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 16)
    got = sorted((tuple(r) for r in near_dup.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == plain.near_duplicates(rows)


def test_few_long_texts_are_counted_once_in_empty_blocks(spark, monkeypatch):
    draw = random.Random(6)
    rows = []
    for i in range(40):
        words = [f"w{draw.randrange(10_000)}" for _ in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    monkeypatch.setattr(near_dup, "BLOCK_WORDS", 25)
    got = sorted((tuple(r) for r in near_dup.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == plain.near_duplicates(rows)
    assert {r[2] for r in got} == {1}


def test_chained_components_are_cut_into_their_buckets(spark, monkeypatch):
    draw = random.Random(8)
    words, rows = [f"w{draw.randrange(10_000)}" for _ in range(60)], []
    for i in range(300):
        at = draw.randrange(60)
        words = words[:at] + [f"v{i}"] + words[at + 1 :]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ways = []
    paired = near_dup._paired
    monkeypatch.setattr(near_dup, "_paired", lambda members: ways.append(members) or paired(members))
    found = {}
    for most in (1024, 8):
        monkeypatch.setattr(near_dup, "BLOCK_TEXTS", most)
        found[most] = sorted((tuple(r) for r in near_dup.jaccard_join(docs).collect()), key=repr)
    assert found[8] == found[1024] == plain.near_duplicates(rows)
    assert len(ways) == 4 and ways[-1].count() > 300


def test_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = plain.near_duplicates([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = [tuple(r) for r in near_dup.jaccard_join(docs).collect()]
    assert sum(r[2] for r in expected) > 10 and sum(r[2] for r in got) >= 0.9 * sum(r[2] for r in expected)
    assert len(got) == len(expected) and len(set(got) - set(expected)) <= 2


def test_jaccard_join_of_odd_rows(odd, nothing):
    got = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in near_dup.jaccard_join(odd).collect()}
    assert got == {(1, 1, 0, 4), (2, 1, 0, 4), (None, 1, 0, 4), (3, 3, 0, 4), (4, 3, 0, 4), (5, 3, 0, 4), (None, 3, 0, 4), (6, 6, 0, 1), (7, 7, 0, 1), (8, 8, 0, 1)}
    assert near_dup.jaccard_join(odd).count() == odd.count() and near_dup.jaccard_join(nothing).count() == 0
    kept = near_dup.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8]


# -- PII

TRAPS = [
    "a@b.cc_d@e.ff", "x..y@z-.a.b.", "a@b", "@a.b", "a@b.c@d.e", "%%@1.2.3.4", "q" * 5000 + "@" , "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "1.2.3", "999999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4  111", "1" * 400, "+1 (212) 555-0100", "+1 212", "++12 345 678 90", "+49 30 1234567890123456", "é4111111111111111é a@b.cd", "+1-2-3-4-5-6-7-8-9 ", "😀 a@b.co 😀 1.1.1.1",
]


def test_base_spans_equal_the_plain_patterns(spark, documents):
    draw = random.Random(3)
    texts = TRAPS + ["".join(draw.choice("ab1.2@+ -()é9%_\n") for _ in range(draw.randrange(80))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").union(documents.select("text"))
    got = df.select("text", pii.listed(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert [(r.text, r.s) for r in got if r.s != ",".join(plain.base_spans(r.text))] == []
    # The same where a text is cut into parts of a few characters.
    got = df.select("text", pii.listed(pii.base_spans(F.coalesce("text", F.lit("")), size=3)).alias("s")).filter("length(text) < 6000").collect()
    assert len(got) > 400 and [(r.text, r.s) for r in got if r.s != ",".join(plain.base_spans(r.text))] == []


def test_parts_cut_no_word_and_give_the_text(spark, documents):
    draw = random.Random(5)
    texts = ["".join(draw.choice("aé中1.@+ -()'_,\n") for _ in range(draw.randrange(90))) for _ in range(200)] + ["", "x" * 7000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").union(documents.select("text").filter("text is not null"))
    for row in df.select("text", pii.parts(F.col("text"), 5).alias("p")).collect():
        assert "".join(p.text for p in row.p) == row.text and [p.at for p in row.p] == [sum(len(q.text) for q in row.p[:i]) for i in range(len(row.p))]
        assert sorted(m[0] for p in row.p for m in plain.TERM.finditer(p.text)) == sorted(m[0] for m in plain.TERM.finditer(row.text))


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 63, 64, 65, 300)]
    for levels in (0, 1, 2):
        for r in spark.createDataFrame(rows, "n array<int>").select("n", pii.running(F.col("n"), levels, 4).alias("s")).collect():
            assert r.s == [sum(r.n[:i]) for i in range(len(r.n))]


def many_spans(n, gap):
    """A text of so many addresses, in order mails, numbers and cards."""
    return gap.join(f"name{i}@host{i % 977}.example.com call +49 30 {1000000 + i} or 10.{i % 256}.0.{i // 256 % 256}" for i in range(n // 3))


def test_many_spans_in_one_text_take_linear_time(spark):
    def took(n, gap):
        docs = spark.createDataFrame([(1, many_spans(n, gap)), (2, "no address here")], "doc_id long, text string").coalesce(1)
        start = time.time()
        found = {r.doc_id: r.n for r in pii.pii_spans(docs, keep=["doc_id"]).select("doc_id", F.size("spans").alias("n")).collect()}
        assert found == {1: n // 3 * 3, 2: 0}
        clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
        assert "@" not in clean[1] and clean[1].count("[EMAIL]") == n // 3 and clean[2] == "no address here"
        return time.time() - start

    took(300, "\n")
    assert took(12_000, "; ") < 4 * took(6_000, "\n") + 5


def test_entities_at_random_places_disclose_nothing(documents):
    texts = [r.text or "" for r in documents.orderBy("doc_id").collect()]
    draw, moved = random.Random(9), list(texts)
    for t in texts:
        for kind, a, b in (s.split(":") for s in plain.base_spans(t)):
            i = draw.randrange(len(moved))
            at = draw.randrange(len(moved[i]) + 1)
            at += len(moved[i][at:]) - len(moved[i][at:].lstrip("".join(c for c in set(moved[i]) if not c.isspace())))
            moved[i] = f"{moved[i][:at]} {t[int(a):int(b)]} {moved[i][at:]}"
    assert plain.disclosing(moved) == set()


def test_terms_that_disclose_are_found_and_others_left(spark):
    said = ["reach {} of wolfgang today", "the wolfgang desk is {} here", "ask wolfgang via {} soon", "call {} at the desk"]
    rows = [s.format("w@corp.example.com") for s in said] + [f"the desk is open today soon {i}" for i in range(60)] + ["call x%d@y.example.com at the desk" % i for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_spans(docs, keep=["doc_id"]).select("doc_id", pii.listed(F.col("spans")).alias("spans")).collect()}
    assert got[0] == "email:6:24,term:28:36" and got[1] == "term:4:12,email:21:39" and got[3] == "email:5:23" and got[10] == ""
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] == "reach [EMAIL] of [TERM] today" and clean[10] == rows[10]


def test_copies_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, "mail zaphod z@corp.example.com") for i in range(30)] + [(100 + i, f"plain text {i}") for i in range(30)], "doc_id long, text string")
    assert pii.pii_spans(docs, keep=["doc_id"]).select(F.explode("spans").alias("s")).filter("s.rank = 4").count() == 0


def term_values(docs):
    got = pii.pii_spans(docs, keep=["doc_id"]).select("doc_id", F.transform(F.filter("spans", lambda s: s["rank"] == 4), lambda s: s["value"]).alias("terms"))
    return {r.doc_id: r.terms for r in got.collect() if r.terms}


def test_terms_of_entities_seen_once_are_found(spark):
    rows = ["ask zaphod at z@corp.example.com today"] * 3 + [f"ask about the plan today {i}" for i in range(1000)]
    assert term_values(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")) == {0: ["zaphod"], 1: ["zaphod"], 2: ["zaphod"]}


def test_entities_of_a_domain_are_evidence_together(spark):
    rows = [f"note {w} from magrathea p{i}@mag.example.com" for i, w in enumerate("one two three four five six seven eight".split())]
    rows += [f"note one two three four five six seven eight from {i}" for i in range(60)]
    assert term_values(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")) == {i: ["magrathea"] for i in range(8)}


def test_a_disclosing_term_is_marked_wherever_it_stands(spark):
    said = ["reach {} of wolfgang", "the wolfgang desk is {}", "ask wolfgang via {}", "call {} at the desk"]
    rows = [s.format("w@corp.example.com") for s in said] + [f"the desk is open {i}" for i in range(200)]
    rows[0] += "\nWolfgang " + "is open " * 20 + "wolfgang's Wolfgang"
    rows += ["no mail of 😀 Wolfgang here"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {k: v.count("wolfgang") for k, v in term_values(docs).items() if "wolfgang" in v} == {0: 3, 1: 1, 2: 1, 204: 1}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "olfgang" not in clean[204] and "😀 [TERM] here" in clean[204] and clean[0].count("olfgang") == 1


def test_disclosing_pairs_equal_the_plain_count(spark):
    # The table's words are invented: what discloses an entity in it is added.
    said = ["reach {} of wolfgang", "the wolfgang desk is {}", "ask wolfgang via {}", "call wolfgang with {} at the desk", "{} trillian"]
    held = {"wolfgang": "w@corp.example.com", "zaphod": "+49 30 12345678", "marvin": "10.1.2.3"}
    added = spark.createDataFrame([(s.format(e).replace("wolfgang", w),) for s in said for w, e in held.items()], "text string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").union(added)
    got = pii.disclosing(docs, pii.written(pii.found_spans(docs, size=70), "found"))
    expected = plain.disclosing([r.text or "" for r in docs.select("text").collect()])
    assert {tuple(r) for r in got.collect()} == expected and expected


def test_pii_of_odd_rows(odd, nothing):
    got = pii.pii_spans(odd, keep=["doc_id"])
    assert got.count() == odd.count() and got.filter("size(spans) > 0").first().doc_id == 8
    assert pii.sanitised(odd).columns == odd.columns and pii.sanitised(odd).count() == odd.count()
    assert pii.pii_spans(nothing).count() == 0 and pii.sanitised(nothing).count() == 0


# -- BPE


@pytest.fixture(scope="module")
def coded():
    import public_tokenizers
    import tiktoken

    path = vocab.default_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    real = tiktoken.Encoding("real", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return (*bpe.coder(path, public_tokenizers.PATTERN), real)


def ids_of(held):
    return [int.from_bytes(held[i : i + 4], "little") for i in range(0, len(held), 4)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdetheouion  \n\t.,'s!?0123éüßñ\x1c\x85\xa0½²"), st.characters(codec="utf-8")), max_size=60))
def test_bpe_equals_the_library(coded, text):
    encode, decoder, _, real = coded
    got = ids_of(encode(text))
    assert got == real.encode_ordinary(text)
    assert "".join(decoder.decode([i] for i in got)) == text == "".join(decoder.decode([got]))


def test_decoder_replaces_what_is_no_utf8(coded):
    _, _, tokens, _ = coded
    single = {t: i for i, t in tokens.items() if len(t) == 1}
    for data in (b"\xff", b"a\xe4\xb8", b"\xe4\xb8\xade", b"\xc0\x80", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80\xf0\x9f", b"\xf4\x90\x80\x80"):
        decoder = bpe.Decoder(tokens)
        assert "".join(decoder.decode([single[bytes([b])]] for b in data)) == data.decode("utf-8", "replace")


def test_bpe_query_equals_the_library(spark, data, documents, coded):
    real = coded[-1]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, data).collect()}
    for r in documents.select("doc_id", "text").collect():
        ids = real.encode_ordinary(r.text or "")
        held = b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(held).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_bpe_of_odd_rows(odd, nothing):
    import public_tokenizers

    path = vocab.default_path("byte_bpe_multi_50k.tiktoken")
    got = bpe.round_trip(odd, path, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count()
    assert bpe.round_trip(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_words_between_spaces_encode_as_in_the_text():
    from tokenizers import Tokenizer

    path = vocab.default_path("byte_bpe_50k.json")
    real = Tokenizer.from_file(path)
    real.encode_special_tokens = True
    encode = vocab.json_ids(path)
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("abc thé  \n'd<|endoftext|>.9 ") for _ in range(draw.randrange(50)))
        assert ids_of(encode(text)) == real.encode(text, add_special_tokens=False).ids
