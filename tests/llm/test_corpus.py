"""The corpus operators against brute force, on odd rows and on the small tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daypanel.llm import bpe, chat, exact, jaccard, language, lines, packing, shards, spans, vectors, warc
from daypanel.llm.components import components
from daypanel.llm.queries import held_out
from daypanel.llm.words import Encoder
from daypanel.sources.tables import load, shared_folder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def empty(df):
    return df.filter("1 = 0")


# 1: chat


def read_back(df):
    return {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}


def test_chat_escapes_merges_and_spans(spark):
    rows = [
        (1, 0, "user", "a &lt;| <|im_end|> &amp;"),
        (1, 1, "assistant", "first <|im_sep|>"),
        (1, 2, "assistant", None),
        (1, 3, "assistant", "\n"),
        (1, 4, "tool\nx", "t"),
        (2, 1, None, ""),
        (2, None, "assistant", "<<||"),
        (None, 1, "assistant", "é𝔘"),
        (None, 1, "assistant", "é𝔘"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = read_back(df)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows[:5]]
    assert got[1]["loss_texts"] == ["first <|im_sep|>", "", "\n"]
    assert got[1]["formatted"].count("<|im_start|>") == 3
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("assistant", "<<||"), ("", "")]
    assert got[None]["loss_texts"] == ["é𝔘", "é𝔘"]
    for r in got.values():
        for s, text in zip(r["loss_spans"], r["loss_texts"], strict=True):
            raw = r["formatted"][s["start"] : s["start"] + s["length"]]
            assert raw.replace("&lt;|", "<|").replace("&amp;", "&") == text
    assert read_back(empty(df)) == {}


# 2: packing, 7: tokens


def library_ids(vocabulary, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_equals_library(vocabulary):
    rng = np.random.default_rng(0)
    alphabet = [*"abAB'strellvemd09²½Ⅷ éÉßΣσςİ×÷ª漢ͅ!#$_` \n\t\x1c\x1d\x85\xa0", "<|endoftext|>", "<|", "'re", "don't", "É", "𝔘"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(4000)] + [None, "", "a" * 5000]
    _, want = library_ids(vocabulary, texts)
    encoder = Encoder(vocabulary)
    for part in (texts[:7], texts):
        flat, bounds = encoder.encode_batch(pa.array(part, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want[: len(part)]


def test_bpe_round_trip(spark, odd_docs, vocabulary):
    rows = odd_docs.collect()
    library, want = library_ids(vocabulary, [r["text"] for r in rows])
    expected = Counter((r["doc_id"], tuple(i), library.decode(i, skip_special_tokens=False)) for r, i in zip(rows, want, strict=True))
    encoded = bpe.encode_texts(odd_docs, vocabulary, table_words=5)
    assert encoded.columns == [*odd_docs.columns, "ids"]
    apart = bpe.decode_ids(encoded, vocabulary)
    for found in (apart, bpe.encode_and_decode(odd_docs, vocabulary)):
        got = Counter((r["doc_id"], struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"]), r["decoded"]) for r in found.collect())
        assert got == expected
    assert bpe.encode_texts(empty(odd_docs), vocabulary).count() == 0
    strange = spark.createDataFrame([(struct.pack("<3I", 320, 4_000_000_000, 320),), (None,)], "ids binary")
    assert [r["decoded"] for r in bpe.decode_ids(strange, vocabulary).collect()] == ["a</w> a</w>", ""]


def test_packing_holds_every_token(odd_docs, vocabulary):
    rows = odd_docs.collect()
    _, ids = library_ids(vocabulary, [r["text"] for r in rows])
    want = Counter()
    for r, i in zip(rows, ids, strict=True):
        i = [*i, 2]
        for s in range(0, len(i), 64):
            piece = struct.pack(f"<{len(i[s : s + 64])}I", *i[s : s + 64])
            want[r["doc_id"], s, len(i[s : s + 64]), len(i), zlib.crc32(piece), piece] += 1
    got = packing.pack_documents(odd_docs, vocabulary, 2, 64, group=50).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(empty(odd_docs), vocabulary).count() == 0


def test_first_fit_decreasing_equals_plain_search():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100):
        lengths = rng.integers(1, 33, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 32)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            k = next((j for j, r in enumerate(room) if r >= lengths[i]), len(room))
            if k == len(room):
                room.append(32)
            assert (bins[i], offsets[i]) == (k, 32 - room[k])
            room[k] -= lengths[i]


# 3: Jaccard


def brute_components(texts):
    """texts: (key, text) pairs; (n_shingles, component) of each key."""
    sets, parent = {}, {}
    for k, t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOWER)) if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            one, two = sets[a], sets[b]
            if one and two and 100 * len(one & two) >= 80 * len(one | two):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_near_duplicates_equal_brute_force(spark, small):
    docs = load(spark, small, "documents").select("doc_id", "text")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert got == want
    assert {c for _, c in got.values()} < set(got)


@pytest.mark.parametrize("small_to", [0, 9, 24])
def test_small_sets_chains_and_families(spark, monkeypatch, small_to):
    """Texts of few words, at and around the threshold, under every boundary between small and large."""
    rng = np.random.default_rng(small_to)
    base = [[f"w{rng.integers(400)}" for _ in range(n)] for n in (3, 5, 6, 9, 12, 14, 20, 28, 60)]
    texts = []
    for words in base * 12:
        words = list(words)
        for _ in range(rng.integers(0, 3)):
            kind, at = rng.integers(3), rng.integers(len(words))
            words = words[:at] if kind == 0 and at > 2 else [*words, f"w{rng.integers(400)}"] if kind == 1 else [words[-1], *words]
        texts.append((len(texts), " ".join(words)))
    monkeypatch.setattr(jaccard, "boundary", lambda sizes: small_to)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_odd_rows(odd_docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd_docs).collect())
    assert got[2, 3, 1] == 2 and got[1, 3, 1] == 1
    assert got[3, 0, 3] == got[4, 0, 4] == got[8, 0, 8] == got[None, 6, None] == 1
    assert {k[2] for k in got if k[0] in (5, 6)} == {5}
    kept = jaccard.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, None, 5, 7, 8])
    assert jaccard.near_duplicates(empty(odd_docs)).count() == 0


def test_keep_first_goes_by_texts_where_keys_are_null_or_repeat(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (8, text("b")), (9, text("d")), (9, text("d")), (10, text("e"))]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (10, text("e"))]
    assert Counter(map(tuple, kept)) == Counter(want)


def test_hot_copies_and_near_copies_make_no_pairs(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    texts = [(i, " ".join(base)) for i in range(300)]
    texts += [(300 + i, " ".join([*base[: (k := rng.integers(80))], f"x{i}", *base[k:]])) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.near_duplicates(df).collect()} == {0}


def test_boundary_weighs_subsets_against_lists():
    assert jaccard.boundary({}) == 0
    assert 4 <= jaccard.boundary({n: 100 for n in range(1, 25)}) <= 24
    for n in range(1, 200):
        assert jaccard.prefix(n) >= 1 and jaccard.overlap_needed(n, n) <= n


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(5, 5), (9, 8), (8, 9), (-3, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 300)]} | {5: 5, 8: -3, 9: -3, -3: -3}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4: WARC


def test_warc_round_trip_in_many_ranges(spark):
    big = "".join(chr(32 + (i * 7919) % 90) for i in range(300_000))
    rows = [(i, f"http://h/{i} é\n", f"<p>{i}</p>" + big[i : i + i * 40]) for i in range(120)]
    rows += [(500 + i, None, "same " * 300) for i in range(40)] + [(600, "u", None), (601, "", ""), (None, "n", "same " * 300), (539, "again", "same " * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("equal", F.lit(1)).repartition(3)
    path = warc.write_archives(pages, f"{shared_folder(spark)}/test-archives-{id(rows)}")
    for split in (700, 1 << 20):
        got = warc.read_archives(spark, path, split_bytes=split, batch_bytes=2_000).collect()
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter(
            (p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in rows
        )
        revisits = {r["page_id"]: r["refers_to_page"] for r in got if r["record_type"] == "revisit"}
        assert revisits == {p: 539 for p in [*range(500, 539), None]}
        whole = {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response" and r["page_id"] != 539}
        assert whole == {p: h or "" for p, _, h in rows if p is not None and not 500 <= p <= 539}
    assert warc.read_archives(spark, warc.write_archives(empty(pages), path + "-none")).count() == 0


def test_warc_members_are_plain_gzip_and_end_in_zero():
    import gzip

    member = warc._member([("WARC-Type", "response")], b"x" * 10, 6)
    assert member[-1] == 0 and gzip.decompress(member).startswith(warc.VERSION)
    assert gzip.decompress(warc.EMPTY_MEMBER) == b"" and warc.EMPTY_MEMBER[-1] == 0


# 5: language


def test_language_held_out_accuracy_and_mixtures(spark, medium):
    docs = load(spark, medium, "documents")
    model = language.fit(docs.filter(~held_out("doc_id")))
    found = language.identify(docs, model).filter(held_out("doc_id"))
    right = found.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.98
    texts = {r["lang"]: r["text"] for r in docs.filter("length(text) between 1500 and 4000 and lang is not null").collect()}
    one, two = sorted(texts)[:2]
    mixed = spark.createDataFrame([(texts[one][:1200] + "\n" + texts[two][:600], "?")], "text string, lang_shares string")
    shares = language.identify(mixed, model).first()["lang_shares"]
    assert set(shares) == {one, two} and 0.55 < shares[one] < 0.78 and abs(sum(shares.values()) - 1) < 1e-9


def test_pipeline_writes_the_predicted_language_where_it_is_null(spark, small):
    import corpus_pipeline as pipeline

    docs = load(spark, small, "documents")
    hidden = docs.withColumn("lang", F.when(~held_out("doc_id"), F.col("lang")))
    rows = {r["doc_id"]: r["lang"] for r in pipeline.language_id(spark, hidden, small).collect()}
    before = {r["doc_id"]: r["lang"] for r in hidden.collect() if r["doc_id"] in rows}
    assert None in before.values() and all(rows.values())
    assert all(rows[i] == v for i, v in before.items() if v is not None)


def test_language_of_odd_rows(spark, odd_docs):
    labelled = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string"
    )
    model = language.fit(labelled)
    assert model["languages"] == ["en", "fr"]
    got = language.identify(odd_docs, model)
    assert got.columns == [*odd_docs.columns, "lang_pred", "score", "lang_shares"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert [by[i]["lang_pred"] for i in (3, 4, 8)] == ["und"] * 3 and by[3]["score"] == 0
    assert all(r["lang_pred"] in ("en", "fr") and 0 <= r["score"] <= 1 for i, r in by.items() if i not in (3, 4, 8))
    short = language.identify(spark.createDataFrame([("é",), ("12",)], "text string"), model).collect()
    assert [r["lang_pred"] for r in short] == ["en", "und"]
    none = language.fit(empty(labelled))
    assert {r["lang_pred"] for r in language.identify(odd_docs, none).collect()} == {"und"}
    assert language.identify(empty(odd_docs), model).count() == 0


# 6: lines


def test_repeated_passages_go_and_clean_texts_stay(spark):
    passage = [f"line {i} of the passage has quite some words in it, more than a few, {i}" for i in range(12)]
    alone = " ".join(f"p{i}" for i in range(60))
    texts = []
    for d in range(30):
        own = [f"document {d} says {d * 100 + i} things that nobody else says here" for i in range(9)]
        texts.append((d, "\n".join([*own[:4], *passage, *own[4:], *([alone] if d % 3 == 0 else []), "The end."])))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("gone", F.lit(1))
    got = {r["doc_id"]: r for r in lines.drop_repeated_chunks(df).collect()}
    assert got[0]["text"] == texts[0][1] and got[0]["lines_removed"] == 0
    for d in range(1, 30):
        left = got[d]["text"].split("\n")
        assert [x for x in left if x.startswith("document ")] == [x for x in texts[d][1].split("\n") if x.startswith("document ")]
        assert left[-1] == "The end." and alone not in left
        assert got[d]["lines_removed"] >= 8 and got[d]["lines_total"] - got[d]["lines_removed"] == len(left)


def brute_repeats(texts, least=50):
    """Lines of each text covered by a run of lines of more than `least` words that stands at an earlier place too."""
    seen, gone = set(), []
    for text in texts:
        own, covered = text.split("\n"), set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = "\n".join(own[a:b])
                if len(run.split()) > least:
                    if run in seen:
                        covered |= set(range(a, b))
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                seen.add("\n".join(own[a:b]))
        gone.append(covered)
    return gone


@pytest.mark.parametrize("share", [1_000_003, 3])
def test_passages_in_differing_contexts_go_whole(spark, monkeypatch, share):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(lines, "SHARE", share)
    line = lambda n, w="c": " ".join(f"{w}{x}" for x in rng.integers(10**9, size=n))
    texts = []
    for size, words in ((2, 30), (2, 45), (3, 25), (4, 20), (5, 15), (6, 11), (12, 5), (2, 20)):
        passage = [line(words, "p") for _ in range(size)]
        if size == 4:
            passage.insert(2, "")
        for _ in range(4):
            before, after = ([line(int(rng.integers(1, 40))) for _ in range(int(rng.integers(4)))] for _ in range(2))
            texts.append("\n".join([*before, *passage, *after]))
    want = brute_repeats(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.drop_repeated_passages(df).collect()}
    assert sum(map(len, want)) == 3 * (2 + 2 + 3 + 5 + 5 + 6 + 12)
    for d, text in enumerate(texts):
        own = text.split("\n")
        least = "\n".join(x for i, x in enumerate(own) if i not in want[d])
        if d < 28:
            assert got[d]["text"] == least and got[d]["lines_removed"] == len(want[d])
        # Of the passage of 40 words only what is a chunk of its own may go.
        assert [x for x in got[d]["text"].split("\n") if x[:1] == "c"] == [x for x in own if x[:1] == "c"]


def test_chunks_at_one_line_of_different_rows_of_a_key_go(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, f"{passage}\n{k} {w}") for k in (None, 7) for w in ("own", "other")]
    got = lines.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(passage in r["text"] for r in got) == 1 and sum(r["lines_removed"] for r in got) == 3


def test_passages_keep_their_first_place(spark):
    same = "\n".join(["a line that comes again and again, of ten words"] * 30)
    df = spark.createDataFrame([(1, same), (2, same + "\nthe end")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.drop_repeated_passages(df).collect()}
    assert got[2]["text"] == "the end"
    assert len(got[1]["text"].split()) > 50 and 0 < got[1]["lines_removed"] < 30


def test_passages_of_odd_rows(odd_docs):
    got = lines.drop_repeated_passages(odd_docs)
    assert got.columns == [*odd_docs.columns, "lines_total", "lines_removed"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == odd_docs.count()
    assert (rows[3]["text"], rows[3]["lines_total"], rows[4]["text"], rows[4]["lines_total"]) == (None, 0, "", 1)
    before = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert all(rows[i]["text"] == before[i] for i in (1, 2, 5, 7, 8, None))
    assert rows[6]["text"].endswith("one more") and rows[6]["lines_removed"] >= 30_000 - 1
    assert lines.drop_repeated_passages(empty(odd_docs)).count() == 0


def test_line_dedup_of_odd_rows(odd_docs):
    got = lines.drop_repeated_chunks(odd_docs)
    assert got.columns == [*odd_docs.columns, "lines_total", "lines_removed"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == odd_docs.count()
    assert (rows[3]["text"], rows[3]["lines_total"], rows[4]["text"], rows[4]["lines_total"]) == (None, 0, "", 1)
    before = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert all(rows[i]["text"] == before[i] for i in (1, 2, 5, 7, 8, None))
    assert rows[6]["text"].endswith("one more") and rows[6]["lines_removed"] > 25_000
    assert lines.drop_repeated_chunks(empty(odd_docs)).count() == 0


# 8: vectors


def brute_links(rows, cosine=0.98):
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = {i: np.array(v) / np.linalg.norm(v) if sound(v) else None for i, (_, v, _) in enumerate(rows)}
    links, parent = Counter(), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b, same = unit[i], unit[j], rows[i][2] is not None and rows[i][2] == rows[j][2]
            if same and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    least = {p: min(rows[i][0] for i in range(len(rows)) if parent[i] == p) for p in set(parent)}
    return Counter((rows[i][0], links[i], least[parent[i]], rows[i][0] == least[parent[i]]) for i in range(len(rows)))


def test_vectors_equal_brute_force_over_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for name, value in (("CELL", 40), ("BLOCK", 16)):
        monkeypatch.setattr(vectors, name, value)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[rng.integers(12)] + rng.normal(size=8) * 0.12], int(rng.integers(2))) for i in range(400)]
    rows += [(400 + i, rows[0][1], rows[0][2]) for i in range(60)]
    nan = float("nan")
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 8, 1), (603, [nan] * 8, 1), (604, [1.0, None], 1), (605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1)]
    rows += [(607, [1e200] * 8, 1), (608, [1e-200] * 8, 1), (609, rows[0][1], None), (605, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit(1)).repartition(4)
    got = Counter(tuple(r) for r in vectors.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())
    scaled = [(k, [x * 1e-190 for x in v] if v and v[0] == 1e200 else [x * 1e190 for x in v] if v and v[0] == 1e-200 else v, c) for k, v, c in rows]
    assert got == brute_links(scaled)
    assert vectors.near_vectors(empty(df)).count() == 0


# 9: shards


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one_to_one_and_turns_back(spark, rows):
    df = spark.range(rows).withColumn("p", shards.permute(F.col("id"), rows, 7))
    got = df.withColumn("b", shards.permute(F.col("p"), rows, 7, back=True)).collect()
    assert sorted(r["p"] for r in got) == list(range(rows)) and all(r["b"] == r["id"] for r in got)
    if rows >= 97:
        assert [r["p"] for r in got] != [r["id"] for r in got]


def test_shards_are_even_and_repeatable(spark, odd_docs):
    df = odd_docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))
    df = df.unionByName(spark.range(500).select(F.lit(77).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("crc")))
    a = shards.shard_rows(df, 7, seed=1)
    b = shards.shard_rows(df.repartition(9), 7, seed=1)
    rows = Counter(tuple(r) for r in a.collect())
    assert rows == Counter(tuple(r) for r in b.collect()) != Counter(tuple(r) for r in shards.shard_rows(df, 7, seed=2).collect())
    slots = defaultdict(list)
    for r in a.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter(r["doc_id"] for r in a.collect()) == Counter(r["doc_id"] for r in df.collect())
    assert shards.shard_rows(empty(df), 7).count() == 0
    with pytest.raises(ValueError):
        shards.shard_rows(df.withColumn("slot", F.lit(1)), 7)


# 10: exact copies


def test_copies_by_recipe_equal_whole_texts(spark, odd_docs):
    got = exact.find_copies(odd_docs).collect()
    texts = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in odd_docs.collect()]
    groups = defaultdict(list)
    for k, t in texts:
        groups[t].append(k)
    best = lambda t: max((k for k in groups[t] if k is not None), default=None)
    want = Counter((k, best(t), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in texts)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact.find_copies(empty(odd_docs)).count() == 0
    kept = exact.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(groups)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(best(t) for t in groups)


def test_chunks_cover_their_text(spark):
    texts = ["", "a", "x" * 20_000, "One sentence. " * 900, "é\n" * 3000, "\r\n\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", exact.chunks_of(F.col("t")).alias("c")).collect():
        assert "".join(r["c"]) == r["t"] and all(len(c) <= 8192 for c in r["c"])


def test_seed_moves_on_when_chunks_clash(spark, monkeypatch):
    monkeypatch.setattr(exact, "_identifier", lambda c, seed: F.struct(F.when(F.lit(seed < 2), 0).otherwise(F.xxhash64(c)).alias("a")))
    assert exact.verified_seed(spark.createDataFrame([("a",), ("b",), ("a",)], "chunk string")) == 2


def test_spans_in_runs_of_texts():
    texts = pa.array(["a b", None, "", "ccc " * 10, "d"], pa.string())
    assert [(at, len(p)) for at, p in spans.parts(texts, 6)][0] == (0, 3)
    assert sum(len(p) for _, p in spans.parts(texts, 1)) == 5


# the pipeline


def test_pipeline_stages(spark, small, odd_docs, vocabulary):
    import corpus_pipeline as pipeline

    docs = load(spark, small, "documents")
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        after = stage(spark, docs, small)
        assert after.columns == docs.columns, name
        rows = {r["doc_id"]: r for r in after.collect()}
        before = {r["doc_id"]: r for r in docs.collect()}
        if k == 0:
            assert set(rows) == {i for i, r in before.items() if re.search(r"[^\W\d_]", r["text"] or "")}
        if k == 1:
            assert set(rows) == set(before)
            assert all(r["n_chars"] == len(r["text"]) for i, r in rows.items() if r["text"] != before[i]["text"])
        if k == 2:
            want = brute_components([(i, r["text"]) for i, r in before.items()])
            assert set(rows) == {i for i, (_, c) in want.items() if c == i}
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    packed = pipeline.STAGES[-1][1](spark, docs, small)
    assert {r["doc_id"] for r in packed.collect()} == set(rows)
    odd = odd_docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for table in (odd, empty(odd)):
        docs = table
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, small)
        docs.collect()


# Words that polynomial hashes confuse


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_polynomial_hashes_confuse(spark, vocabulary, n):
    one, two = thue_morse(n), thue_morse(n, "ba")
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} x {two}")], "doc_id long, text string").coalesce(1)
    library, want = library_ids(vocabulary, [one, two, f"{one} x {two}"])
    rows = bpe.encode_and_decode(docs, vocabulary).orderBy("doc_id").collect()
    assert [list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])) for r in rows] == want
    assert [r["decoded"] for r in rows] == [library.decode(i, skip_special_tokens=False) for i in want]
    packed = packing.pack_documents(docs, vocabulary, 2, 100_000).orderBy("doc_id").collect()
    assert [r["ids_crc32"] for r in packed] == [zlib.crc32(struct.pack(f"<{len(i) + 1}I", *i, 2)) for i in want]
    texts = spark.createDataFrame([(1, f"a b c d {one}"), (2, f"a b c d {two}")], "doc_id long, text string").coalesce(1)
    assert [r["component_id"] for r in jaccard.near_duplicates(texts).orderBy("doc_id").collect()] == [1, 2]


def test_distinct_spans_by_bytes():
    data = np.frombuffer(b"ab cd ab  abcd", np.uint8)
    words, inverse = spans.distinct(data, np.array([0, 3, 6, 10, 12]), np.array([2, 5, 8, 12, 14]))
    assert words == [b"ab", b"cd"] and inverse.tolist() == [0, 1, 0, 0, 1]
    assert spans.distinct(data, np.zeros(0, np.int64), np.zeros(0, np.int64))[0] == []
    assert len(set(spans.hashes([b"a", b"b", b""]).tolist())) == 3


def test_one_odd_character_leaves_the_other_words_plain():
    texts = pa.array(["Some Words’ end, İ don't 漢字x É", "’", None, "plain’s Étude"])
    data, offsets = spans.buffers(texts)
    low, starts, ends = spans.word_spans(data, offsets)
    words = [low[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["some", "Words’", "end", ",", "İ", "don", "'t", "漢字x", "é", "’", "plain’s", "étude"]


def test_words_of_any_script_go_through_the_table(spark, vocabulary):
    docs = spark.createDataFrame([(i, "Всё хорошо, “quoted” words — 漢字 and é " * 3) for i in range(4)], "doc_id long, text string")
    counted = {r["word"]: r["n"] for r in bpe.count_words(docs).collect()}
    assert counted["Всё"] == counted["漢字"] == counted["“quoted”"] == counted["words"] == 12
    table = {r["word"]: bytes(r["ids"]) for r in bpe.word_table(bpe.count_words(docs), vocabulary).collect()}
    _, want = library_ids(vocabulary, list(table))
    assert [struct.pack(f"<{len(i)}I", *i) for i in want] == list(table.values())
    assert bpe.word_table(bpe.count_words(docs), vocabulary, 3).count() <= 3
    assert bpe.word_table(bpe.count_words(docs), vocabulary, 1000, 0).count() == 0


def test_hot_tokens_are_dealt_out_and_lose_no_link(spark, monkeypatch):
    """Near copies in some runs of texts, single ones in others: with and without salts the links are the same."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[: (k := rng.integers(60))], f"x{i}", *base[k:]]) for i in range(120)]
    texts += [" ".join(rng.choice(["red", "blue", "green", "gold"], 6)) for _ in range(60)] + [" ".join(f"y{i}-{j}" for j in range(30)) for i in range(30)]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[i]) for i in order]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_components(rows)
    for hot in (2, 16, 10**9):
        monkeypatch.setattr(jaccard, "HOT", hot)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
        assert got == want
    own = df.selectExpr("doc_id AS key", "text").coalesce(1)
    monkeypatch.setattr(jaccard, "HOT", 16)
    listed = jaccard.postings(own, 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    together = listed.filter("held >= 0").groupBy("token").count().agg(F.max("count")).first()[0]
    assert together < 16 < listed.groupBy("token").count().agg(F.max("count")).first()[0]
