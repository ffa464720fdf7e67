"""Each operator against brute force or an exact round trip, on rows that are awkward in every way."""

import gzip
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from awkward import awkward_rows, text

from llm import difference_cover, exact_dedup, jaccard, packing, quality, suffix_dedup, syncmers, token_counts, toxicity, unigram, warc
from llm.labels import held_out

ROWS = [(i, t or "") for i, t, _ in awkward_rows()]


def collected(df):
    return [tuple(r) for r in df.collect()]


# 1 packing


@pytest.mark.parametrize("shard", [1 << 18, 3000])
def test_packing_places_every_id_once(awkward, shard):
    tokenizer = token_counts.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(awkward, public_tokenizers.path("word_bpe_49k.json"), shard_tokens=shard).collect()
    wanted = Counter()
    for doc_id, body in ROWS:
        wanted[doc_id, tuple(tokenizer.encode(body, add_special_tokens=False).ids + [1])] += 1
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        total = sum(r["length"] for r in own)
        assert total == own[0]["sequence_tokens"] <= 2048 and total & (total - 1) == 0
    # A document's pieces, put together by start, are its ids; crcs tell which document of several with an id.
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"], r["doc_tokens"]].append(r)
    for (doc_id, tokens), pieces in by_id.items():
        own = [ids for (i, ids), n in wanted.items() for _ in range(n) if i == doc_id and len(ids) == tokens]
        assert sum(r["length"] for r in pieces) == tokens * len(own)
        for r in pieces:
            cuts = [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for ids in own]
            assert r["ids_crc32"] in cuts
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in wanted.items())


def test_packing_puts_neighbours_together(spark):
    # Five vocabularies; documents of one share words, not their order.
    words = [text(900 + topic, 160).split(" ") for topic in range(5)]
    rare = [(i, " ".join(np.random.default_rng(i).permutation(words[i % 5]))) for i in range(60)]
    rows = packing.pack(spark.createDataFrame(rare, "doc_id long, text string").coalesce(1), public_tokenizers.path("word_bpe_49k.json")).collect()
    sequences = defaultdict(set)
    for r in rows:
        sequences[r["sequence_id"]].add(r["doc_id"] % 5)
    assert np.mean([len(topics) for topics in sequences.values()]) < 2.2  # by chance about 3


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# 2 exact dedup


@pytest.mark.parametrize("block", [1024, 7])
def test_exact_copies(awkward, block):
    got = Counter(collected(exact_dedup.exact_copies(awkward, block)))
    groups = defaultdict(list)
    for doc_id, body in ROWS:
        groups[body].append(doc_id)
    expected = Counter()
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, left = (max(known) if known else None), True
        for i in ids:
            expected[i, keep, len(ids), left and i == keep, hashlib.sha256(body.encode()).hexdigest()] += 1
            left = left and i != keep
    assert got == expected


def test_exact_copies_of_nothing(nothing):
    assert exact_dedup.exact_copies(nothing).count() == 0


# 3 token counts


def test_token_counts(awkward, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = token_counts.load_tokenizer(path)
    expected = Counter()
    for doc_id, body in ROWS:
        n = len(tokenizer.encode(body, add_special_tokens=False).ids)
        expected[doc_id, len(body.encode()), n, n > 1024] += 1
    assert Counter(collected(token_counts.token_counts(awkward, path))) == expected
    assert token_counts.token_counts(nothing, path).count() == 0


@pytest.mark.parametrize("name, make", [("byte_bpe_50k.json", token_counts.SegmentCounter), ("word_bpe_49k.json", packing.WordEncoder)])
def test_safe_boundaries(name, make):
    """Random strings of everything that splitting patterns look at."""
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "B1", "É", "é", " ", "\x1c", ".", "!!", "'s", "<|endoftext|>", "日本", "　", "᠎", "\x85", "😀", "İ", "Σ", "ſ", "ĳ"]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(8000)]
    encoder = make(public_tokenizers.path(name))
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = encoder(texts)
    if isinstance(got[0], bytes):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == expected
    else:
        assert got == [len(ids) for ids in expected]


def test_parts_of_words_are_encoded_once():
    """Letters in any case and punctuation that come with several partners go to the merge model once."""
    calls, ids = [], packing.plain_ids
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Quorum quorum, quorum. QUORUM, other, other. 12 Émile émile,", "", "quorum. 12 a\x1cb"]
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "plain_ids", lambda tokenizer, text: calls.append(text) or ids(tokenizer, text))
        got = encoder(texts)
    assert [np.frombuffer(packed, "<u4").tolist() for packed in got] == expected
    assert sorted(calls) == sorted({"quorum", "other", "émile", ",", "."})


def test_many_parts_of_words_are_merged_together():
    """Different words of a block don't cost a call of the merge model each; ids and cached parts stay right."""
    calls, ids = [], packing.plain_ids
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng, letters = np.random.default_rng(5), [*"abcdefghijklmnopqrstuvwxyzABCXYZéÈñßöÿŁſǅɏ"]
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) + "".join(rng.choice([*"!,.;-$%"], rng.integers(0, 4))) for _ in range(6000)]
    words += ["aaaa" * 15, "inin" * 16, "thththth" * 40, "12a", "don't", "日本", "!!"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) + rng.choice(["", " ", "\n", "\x1cab"]) for _ in range(600)] + ["", " ", *words[-7:]]
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "plain_ids", lambda tokenizer, text: calls.append(text) or ids(tokenizer, text))
        got = encoder(texts[:300]) + encoder(texts[300:])
        patch.setattr(packing.WordEncoder, "KNOWN", 10)
        again = encoder(texts[:300]) + encoder(texts[300:])
    assert [np.frombuffer(packed, "<u4").tolist() for packed in got] == expected
    assert again == got
    assert {*calls} <= {"inin" * 16, "thththth" * 40} | {c for c in calls if len(c.encode()) > 64}


# 4 suffix dedup


def repeats_by_force(rows, length):
    """(n_bytes, n_removed, n_spans, digest) of each row, earlier rows first."""
    seen, out = set(), []
    for doc_id, body in rows:
        data = body.encode()
        covered = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                covered[at : at + length] = b"\1" * length
            seen.add(window)
        spans = sum(c and not (at and covered[at - 1]) for at, c in enumerate(covered))
        left = bytes(b for b, c in zip(data, covered) if not c)
        out.append((doc_id, len(data), sum(covered), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("length, hot, array", [(100, 8192, 1 << 20), (100, 1, 200), (24, 1, 300), (24, 8192, 1 << 20)])
def test_repeated_strings(spark, awkward, length, hot, array):
    # Equal ids go by Spark's hash of the text, so the order is taken from there.
    keyed = suffix_dedup.keyed(awkward, ["doc_id"]).orderBy("no_id", "id", "hash").collect()
    expected = repeats_by_force([(r["carried"]["doc_id"], r["text"]) for r in keyed], length)
    got = collected(suffix_dedup.digests(awkward, length=length, anchor=12 if length < 40 else 20, hot=hot, array_bytes=array))
    assert Counter(got) == Counter(expected)


def test_kept_text_has_whole_characters(spark):
    body = "é" * 80
    docs = spark.createDataFrame([(1, "x" + body), (2, "yy" + body + "z")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs, ["doc_id"]).select("carried.doc_id", "kept_text", "n_removed").collect()}
    assert rows[2]["kept_text"] == "yyz" and rows[1]["n_removed"] > 0
    assert suffix_dedup.without_repeats(docs.where("false"), []).count() == 0


@pytest.mark.parametrize("depth", [3, 9, 100, 1000])
def test_suffix_ranks(depth):
    rng = np.random.default_rng(0)
    for n in [*range(20), 300]:
        for symbols in (1, 2, 200):
            body = rng.integers(0, symbols, n)
            ranks = difference_cover.suffix_ranks(body.astype(np.int64) + 1, symbols + 1, depth)
            prefixes = [tuple(body[i : i + depth] + 1) for i in range(n)]
            order = sorted(range(n), key=lambda i: prefixes[i])
            for a, b in zip(order, order[1:]):
                assert ranks[a] < ranks[b] or prefixes[a] == prefixes[b]


def test_suffix_arrays_get_only_spans_with_equals():
    """Spans of one anchor that share no window stay out of the suffix arrays; equal windows of other anchors don't count."""
    rng = np.random.default_rng(8)
    body = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    shared, anchor = body(100), body(20)
    spans = [  # anchor, bytes, has an equal window
        (1, body(60) + anchor + body(60), False),
        (1, body(39) + anchor + body(50), False),
        (2, shared + body(11), True),
        (2, body(7) + shared, True),
        (2, body(130), False),
        (3, body(5) + shared + body(9), False),
    ]
    for repeat in (1, 50):
        chosen = spans * repeat if repeat == 1 else [(10 * n + a, b, e) for n in range(repeat) for a, b, e in spans]
        anchors = np.array([a for a, _, _ in chosen], np.int64)
        windows = np.array([len(b) - 99 for _, b, _ in chosen], np.int32)
        kept = suffix_dedup._with_equals(anchors, windows, np.frombuffer(b"".join(b for _, b, _ in chosen), np.uint8), 100)
        assert kept.tolist() == [e for _, _, e in chosen]


# 5 fingerprints


def test_fingerprints(awkward, nothing):
    got = syncmers.fingerprints(awkward).collect()
    keyed = awkward.selectExpr("doc_id", "coalesce(text, '') AS text", "doc_id IS NULL AS none", "xxhash64(coalesce(text, '')) AS h")
    order = keyed.orderBy("none", "doc_id", ascending=[True, False]).collect()
    order.sort(key=lambda r: (r["none"], -(r["doc_id"] or 0), r["h"], r["text"]))
    expected = Counter()
    for at, row in enumerate(order):
        body, following = row["text"], order[(at + 1) % len(order)]["text"]
        third = len(body) // 3
        edited = body[: len(body) - third] + following[:third]
        a, b, c = (syncmers.anchors(t)[0] for t in (body, edited, following))
        expected[
            row["doc_id"], len(body), hashlib.sha256(edited.encode()).hexdigest(), syncmers.fingerprint(*syncmers.anchors(body)),
            round(syncmers.likeness(a, b), 9), round(syncmers.likeness(a, c), 9),
        ] += 1
    found = Counter(
        (r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got
    )
    assert found == expected
    assert syncmers.fingerprints(nothing).count() == 0


def test_syncmers_by_definition():
    def plain(data: bytes, k: int, s: int) -> list[int]:
        padded = bytes(k - 1) + data + bytes(k - 1)
        values = np.frombuffer(padded, np.uint8).astype(np.uint64) + np.uint64(1)
        inner = syncmers.scrambled(syncmers.windows_hash(values, s)).tolist()
        return [i for i in range(len(padded) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]

    for body in ("a", "For For For", text(3, 40)):
        hashes, at = syncmers.anchors(body)
        assert at.tolist() == plain(body.encode(), syncmers.K, syncmers.S)
        back, places = syncmers.anchors_of(syncmers.fingerprint(hashes, at))
        assert back.tolist() == hashes.tolist() and places.tolist() == at.tolist()
        assert np.diff(at, prepend=0).max() <= syncmers.K - syncmers.S + 1
    passage = text(9, 30)
    pairs = syncmers.matched_positions(*(syncmers.fingerprint(*syncmers.anchors(t)) for t in (passage, "ab " + passage)))
    assert sum(b - a == 3 for a, b in pairs) > 0.8 * len(pairs) > 0


# 6 Jaccard join


def links_by_force(rows, words=5, threshold=0.8):
    def shingles(body):
        found = re.findall(r"\w+", body.lower())
        size = min(words, len(found))
        return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()

    sets = [shingles(body) for _, body in rows]
    links = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a].append(b)
                links[b].append(a)
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, own in enumerate(links):
            low = min([root[a], *(root[b] for b in own)])
            changed |= low != root[a]
            root[a] = low
    members = defaultdict(list)
    for a, r in enumerate(root):
        members[r].append(rows[a][0])
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return Counter((rows[a][0], smallest[root[a]], len(links[a])) for a in range(len(rows)))


def near_group(n=60, words=120):
    base = text(50, words).split(" ")
    rows = []
    for i in range(n):
        own = list(base)
        own[(7 * i) % words] = f"edit{i}"
        rows.append((1000 + i, " ".join(own)))
    return rows + rows[:5]


@pytest.mark.parametrize("tile", [512, 8])
def test_jaccard_join(spark, awkward, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = ROWS + near_group()
    docs = awkward.select("doc_id", "text", "hash", "class").unionByName(
        spark.createDataFrame([(i, t, None, None) for i, t in near_group()], "doc_id long, text string, hash string, class string")
    )
    got = collected(jaccard.join(docs).select("doc_id", "class_id", "n_links"))
    assert Counter(got) == links_by_force(rows)


def test_jaccard_join_of_nothing(nothing):
    assert jaccard.join(nothing).count() == 0


def test_matched_length_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        length = jaccard.matched_length(threshold, 0.999)
        assert 1 - (1 - threshold**length) ** jaccard.TREES >= 0.999
        assert length == jaccard.LONGEST or 1 - (1 - threshold ** (length + 1)) ** jaccard.TREES < 0.999


# 7 toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_trie_by_edit_distance():
    terms = ["idiot", "moron", "stupid", "worthless", "disgusting", "trash", "trashy"]
    trie = toxicity.FuzzyTrie(terms, states=40)
    rng = np.random.default_rng(5)
    words = list(terms)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(word) + 1)
            word[at : at + rng.integers(0, 2)] = rng.choice(list("idotrash"), rng.integers(0, 2)).tolist()
        words.append("".join(word))
    for word in words:
        near = [(edit_distance(word, t), t) for t in terms]
        near = [(d, t) for d, t in near if d <= trie.edits_of(t)]
        assert trie.nearest(word) == (min(near) if near else None), word


def test_context_tells_quotation_from_abuse():
    matcher = toxicity.Matcher(["idiot"])
    _, terms, quoted, direct = toxicity.features(matcher, 'they wrote "you idi0t!" in a letter and you IDIOT read it')
    assert (terms, quoted, direct) == (["idiot"], 1, 1)


def test_toxicity_model(spark, awkward, nothing):
    rows = [(i, text(i, 60) + (" you utter scumbag." if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows + [(i, None) for i in (301, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    right = [r["predicted"] == (r["doc_id"] % 3 == 0) for r in got if r["held_out"] and r["doc_id"] < 300]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    unlabelled = toxicity.toxicity(awkward, labels.where("false"))
    assert {r["score"] for r in unlabelled.collect()} == {0.5}
    assert toxicity.toxicity(nothing, labels).count() == 0


# 8 web archives


def test_arc_to_warc_round_trip(spark):
    html = "<p>" + "x" * 200
    rows = [(1, "http://a/ b\n", html), (2, None, html), (2, None, html), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", html), (7, "u", "é" * 60), (8, "u", "WARC/1.0\r\n\r\n\r\n\r\nlong enough to be stored once, as it has over a hundred bytes in it, surely it has by now")]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, digest string, type string")
    for version in ("1", "2"):
        got = Counter(collected(warc.convert_pages(pages, version, 500).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")))
        seen, expected = {}, Counter()
        for page, _, body in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            data = (body or "").encode()
            first = seen.setdefault(data, page) if len(data) >= 100 else None
            again = len(data) >= 100 and (data, "seen") in seen
            seen[data, "seen"] = True
            expected[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, None] += 1
        assert got == expected
    assert warc.convert_pages(pages.where("false")).count() == 0


def test_arc_headers_and_lengths():
    version_2 = b"filedesc://x 0.0.0.0 20000101000000 text/plain 200 - - 0 - 0\n"
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    line = b"http://x 1.2.3.4 19990101000000 text/html 200 - - 0 f %d\n" % len(body)
    found = list(warc.arc_records(version_2 + line + body + b"\n" + line + body))
    assert [f.get("URL") for _, f, _, _ in found] == ["filedesc://x", "http://x", "http://x"]
    assert found[1][2] == body and found[1][3] is None
    assert list(warc.arc_records(b"not a header\n"))[0][3] is not None
    assert list(warc.arc_records(b"http://x 1.2.3.4 19990101 text/html 99\nshort"))[0][3] == "declared length runs past the end"


def test_archives_are_files_of_their_formats(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x", "<p>hi")], "page_id long, url string, html string")
    warc.write_arc(pages, str(tmp_path / "arc"))
    (arc,) = filter(None, (gzip.decompress(f.read_bytes()) for f in (tmp_path / "arc").glob("*.gz")))
    assert arc.startswith(b"filedesc://")
    warc.write_warc(warc.mark_revisits(warc.arc_to_warc_fields(warc.read_arc(spark, str(tmp_path / "arc")))), str(tmp_path / "warc"))
    (data,) = filter(None, (gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz")))
    assert data.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and data.endswith(b"<p>hi\r\n\r\n")


# 9 quality


def test_quality_model(spark, awkward, nothing):
    rows = [(i, text(i, 80) if i % 3 else "!! ".join(text(i, 80).upper().split(" "))) for i in range(400)]
    docs = spark.createDataFrame(rows + [(401, None), (402, "   ")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    right = [r["predicted"] == (r["doc_id"] % 3 > 0) for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert {r["score"] for r in quality.quality(awkward, labels.where("false")).collect()} == {0.5}
    assert quality.quality(nothing, labels).count() == 0


def test_every_word_has_its_own_vector(spark):
    """Context vectors by force, of more words than any fixed table of 4096 slots has room for."""
    rows = [(i, " ".join(f"word{i * 60 + j}" for j in range(90))) for i in range(120)] + [(200, None), (201, "")]
    found = quality.context_vectors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = dict(zip([r["key"] for r in found], quality.decode([bytes(r["vector"]) for r in found])))
    expected, keys = defaultdict(lambda: np.zeros(quality.SIZE, np.int64)), quality.Keys()
    for _, body in rows:
        for run in keys(body or ""):
            places, signs = quality.index_vectors(run)
            for at, key in enumerate(run):
                for near in (n for n in range(at - 2, at + 3) if n != at and 0 <= n < len(run)):
                    expected[key][places[near]] += signs[near]
    assert len(found) == len(got) == len(expected) > 7000
    assert all((got[key] == row).all() for key, row in expected.items())


def test_vectors_are_encoded_whole():
    edges = [0, 1, -1, 2, -2, 3, -3, 127, -128, 32767, -32768, 1 << 40, -(1 << 40)]
    rows = np.array([[n if place in (0, 5, 63) else 0 for place in range(quality.SIZE)] for n in edges])
    packed = quality.encode(rows).to_pylist()
    assert (quality.decode(packed) == rows).all() and quality.decode([]).shape == (0, quality.SIZE)


def test_sums_take_bounded_memory():
    """Sums of three million terms, most of them different, are made in parts and small whole numbers."""
    rng = np.random.default_rng(2)
    runs = [rng.integers(0, 200_000, n) * 0x9E3779B97F4A7 for n in [0, 1, 2, 3, 70_000] + [100_000] * 29]
    tracemalloc.start()
    known, table = quality.context_sums(runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    for key in (*known[:3], runs[1][0], *runs[2], *runs[3], runs[4][65_535], runs[4][-1]):
        expected = np.zeros(quality.SIZE, np.int64)
        for run in runs:
            for at in np.flatnonzero(run == key):
                near = np.array([run[n] for n in range(at - 2, at + 3) if n != at and 0 <= n < len(run)], np.int64)
                places, signs = quality.index_vectors(near)
                np.add.at(expected, places, signs)
        assert (table[np.searchsorted(known, key)] == expected).all()


def test_shapes_of_plain_words_are_those_of_the_patterns():
    signs = ["a", "B", "7", ".", "!", "é", "Ä", "ª", "-", "x", "Q", ","]
    rng = np.random.default_rng(4)
    for word in {"".join(rng.choice(signs, rng.integers(0, 7))) for _ in range(4000)}:
        by_patterns = quality._DIGIT.sub("0", quality._LOWER.sub("a", quality._UPPER.sub("A", word)))
        assert quality.shape_of(word) == re.sub(r"(.)\1+", r"\1\1", by_patterns)


def test_temperature_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4 * quality.SIZE + 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float)
    model = quality.fit(x[:3000], y[:3000], np.zeros((1, 1)))
    p = model.probability(x[3000:])
    assert abs(p.mean() - y[3000:].mean()) < 0.06
    assert -np.mean(np.log(np.where(y[3000:] == 1, p, 1 - p))) < 0.75


# 10 unigram model


@pytest.fixture(scope="module")
def model():
    return unigram.UnigramModel.load(public_tokenizers.path("piece_bpe_32k.model"))


def test_viterbi_finds_the_best_path(model):
    """Against all segmentations of short strings, and the library's best path for the same pieces as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    pieces = {p.piece: p.score for p in proto.pieces if p.type == 1}

    def best(body):
        if not body:
            return 0.0
        options = [pieces[body[:n]] + best(body[n:]) for n in range(1, len(body) + 1) if body[:n] in pieces]
        return max(options) if options else -1e18

    score = dict(enumerate(proto.pieces))
    for body in ("the", "▁anther", "▁tionbleer", "▁then", "onati"):
        assert sum(score[i].score for i in model.viterbi(body)) == best(body)
    encoder = unigram.Encoder(model)
    for body in ("the thing", "antheretion. Blé\nnew line", "ñandú 12", "日本 😀", text(3, 12)):
        assert encoder(body).tolist() == library.nbest_encode_as_ids(body, 2)[0]
        assert model.decode(encoder(body).tolist()) == library.decode(encoder(body).tolist()) == body


def test_double_array_holds_the_keys():
    keys = sorted({b"a", b"ab", b"abc", b"b", b"\xff\x00", *(bytes([i, j]) for i in range(30) for j in range(0, 250, 7))})
    base, check, value = unigram.double_array(keys)
    for index, key in enumerate(keys):
        node = 0
        for byte in key:
            assert check[base[node] + byte] == node
            node = base[node] + byte
        assert value[node] == index


def test_codec(awkward, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = unigram.codec_digests(awkward, path).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in rows if r["round_trip"]) == Counter(
        (i, hashlib.sha256(t.encode()).hexdigest()) for i, t in ROWS if "▁" not in t
    )
    assert [r["doc_id"] for r in rows if not r["round_trip"]] == [14]
    back = unigram.decoded(unigram.encoded(awkward, path), path)
    assert Counter(collected(back)) == Counter((i, t.replace("▁", " ")) for i, t in ROWS)
    assert unigram.codec_digests(nothing, path).count() == 0


def test_segments_do_not_change_the_path(model):
    rng = np.random.default_rng(8)
    parts = [" ", "  ", "a", "the", "\n", ".", "▁", "日", "tion", "É"]
    encoder = unigram.Encoder(model)
    for _ in range(400):
        body = "".join(rng.choice(parts, rng.integers(1, 9)))
        assert encoder(body).tolist() == model.viterbi(" " + body), repr(body)


def test_null_ids_are_never_held_out(spark):
    docs = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in docs.select(held_out(0, 1)).collect()] == [False, True]
