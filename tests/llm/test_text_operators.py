"""Each operator against a brute-force version, and on nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns."""

import base64
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from lociframe.llm import ann, components, jaccard_join, language_id, line_dedup, packing, pieces, quality_classifier, quality_rules, tokens, warc
from lociframe.llm.shared import mix, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, h1 long, words string, score double, n_lines string"


def extra(rows):
    """Rows with columns whose names clash with what operators make."""
    return [(i, t, "en", 1, "w", 0.5, "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(11)
    vocabulary = ["ab", "cde", "fg,", "Hi!", "é", "日本", "x1", "the", "of", "#tag"]
    base = ["\n".join(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 8))) for _ in range(25)]
    rows = [(i, base[i] if i < 25 else rnd.choice(base).replace("ab", rnd.choice(["ab", "zz"]), 1)) for i in range(90)]
    rows += [(100, None), (101, ""), (102, " \n\t\n "), (None, base[0]), (104, base[1]), (104, base[1]), (105, "word " * 30_000), (106, "a b c d e f g h " * 3), (107, "\U0001f600 \x00 ▁ a▁b")]
    return spark.createDataFrame(extra(rows), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_word_spans():
    data, offsets = np.frombuffer(b" ab c" + b"" + b"d\x0be", np.uint8), np.array([0, 5, 5, 8])
    assert [x.tolist() for x in word_spans(data, offsets)] == [[1, 4, 5, 7], [3, 5, 6, 8], [0, 0, 2, 2]]


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(wins).items() if n > 1}
    covered = {j for i, w in enumerate(wins) if w in twice for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, none):
    found = quality_rules.apply_policy(quality_rules.ledger(docs))
    rows = [tuple(r) for r in found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    want = []
    for i, t in pairs(docs):
        m = brute_rules(t)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert not found.where("base_failed and kept").count()
    assert quality_rules.ledger(none).count() == 0
    alone = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    assert alone["too_few_words"].n_failed == sum(w[1] < 20 for w in want)


def brute_dedup(rows):
    trim = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    wins = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            filled = [(k, trim(x)) for k, x in enumerate(t.split("\n")) if trim(x)]
            for a, b, c in zip(filled, filled[1:], filled[2:], strict=False):
                wins[a[1], b[1], c[1]].add((i, a[0], b[0], c[0]))
    gone = defaultdict(set)
    for places in wins.values():
        for i, *ks in sorted(places)[1:]:
            gone[i].update(ks)
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i] or i is None)) for i, t in rows]


def test_line_dedup(docs, none):
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed_lines"]
    assert sorted(pairs(found), key=repr) == sorted(brute_dedup(pairs(docs)), key=repr)
    assert found.where("n_removed_lines > 0").count() > 5
    assert line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize(("often", "block", "at_once", "edges"), [(200, 4096, 2_000_000, 1_000_000), (8, 5, 0, 7)])
def test_jaccard_join(docs, none, monkeypatch, often, block, at_once, edges):
    monkeypatch.setattr(jaccard_join, "OFTEN_ONE_IN", often)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SEARCH_AT_ONCE", at_once)
    monkeypatch.setattr(components, "EDGES_A_TASK", edges)
    rows = pairs(docs)

    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)
    found = jaccard_join.similarity_components(docs)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert len({w[2] for w in want}) < len(want) - 10
    if often == 200:
        assert jaccard_join.similarity_components(none).count() == 0
        kept = [r.doc_id for r in jaccard_join.one_of_each(docs).select("doc_id").collect()]
        assert sorted(kept, key=repr) == sorted([i for i in root if find(i) == i] + [None], key=repr)


def test_jaccard_join_with_a_null_id_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text + " more")], "doc_id long, text string").coalesce(1)
    found = {(r.doc_id, r.component_id) for r in jaccard_join.similarity_components(docs).collect()}
    assert found == {(None, None), (1, 1), (2, 1)}


def test_linked_sets_share_a_bucket():
    """Of sets that link, those of too few groups apart, all share a key; whichever tokens count as frequent."""
    rng = np.random.default_rng(5)
    sets = []
    for n in [*range(1, 40), *range(40, 900, 43)]:
        base = mix(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(12):
            out, new = rng.integers(0, n // 7 + 1), rng.integers(0, n // 7 + 1)
            sets.append(np.unique(np.concatenate((rng.permutation(base)[out:], mix(rng.integers(0, 1 << 63, new, dtype=np.uint64))))))
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    for share in (0, 0.1, 0.5):
        flat = np.concatenate(sets)
        often = np.unique(flat[rng.random(len(flat)) < share])
        of, keys, poor = jaccard_join.group_keys(flat, starts, often)
        own = [set(keys[of == k].tolist()) for k in range(len(sets))]
        linked = 0
        for k in range(len(sets)):
            for j in range(k - k % 12, k):
                both = len(np.intersect1d(sets[k], sets[j]))
                if 9 * both >= 4 * (len(sets[k]) + len(sets[j])) and not np.array_equal(sets[k], sets[j]):
                    linked += 1
                    assert own[k] & own[j] or (poor[k] and poor[j])
        assert linked > 300 and (share or poor.mean() < 0.2)


def test_least_labels():
    rng = np.random.default_rng(9)
    u, v = rng.integers(0, 400, 250), rng.integers(0, 400, 250)
    nodes, roots = components.least_labels(u, v)
    want = {int(x): int(x) for x in nodes}
    for _ in range(len(want)):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            want[a] = want[b] = min(want[a], want[b])
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == want


def test_tree_pairs_against_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.poisson(3, (40, jaccard_join.GROUPS))
    points = np.vstack([base, np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0)]).astype(np.uint16)
    sizes = points.sum(1).astype(np.int64)
    comp = np.arange(80) // 2
    a, b = (np.concatenate(z) for z in zip(*jaccard_join.tree_pairs(points, sizes, comp), strict=True))
    want = {(i, j) for i in range(80) for j in range(i) if comp[i] != comp[j] and 9 * int(np.minimum(points[i], points[j]).sum()) >= 4 * (sizes[i] + sizes[j])}
    assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == want and len(want) >= 40


def test_a_tree_of_three_levels_prunes(monkeypatch):
    """800 points make leaves, boxes and boxes of boxes; sizes part them, and no pair that links is lost."""
    rng = np.random.default_rng(1)
    base = rng.poisson(np.geomspace(0.5, 40, 400)[:, None], (400, jaccard_join.GROUPS))
    points = np.vstack([base, np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0)]).astype(np.uint16)
    sizes, comp, bounded, old = points.sum(1).astype(np.int64), np.arange(800), [], jaccard_join.may_link

    def counted(a, b, total):
        bounded.append(len(a))
        return old(a, b, total)

    monkeypatch.setattr(jaccard_join, "may_link", counted)
    found = {(max(x, y), min(x, y)) for a, b in jaccard_join.tree_pairs(points, sizes, comp) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(800) for j in range(i) if 9 * int(np.minimum(points[i], points[j]).sum()) >= 4 * (sizes[i] + sizes[j])}
    assert found == want and len(want) >= 400 and len(bounded) >= 3 and sum(bounded) < 0.6 * 800 * 799 / 2


def test_token_histogram(docs, none):
    counted = tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoder = tokens.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = [len(encoder.encode_ordinary(t or "")) for _, t in pairs(docs)]
    table = tokens.length_histogram(counted).persist()
    rows = {r.n_tokens: r for r in table.collect()}
    assert set(rows) == set(n)
    for k, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.docs_up_to, r.truncated_total) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(x <= k for x in n), sum(min(x, k) for x in n))
    report = {r.context_limit: tuple(r)[1:] for r in tokens.limit_report(table, docs.sparkSession.createDataFrame([(7,), (1000,)], "context_limit int")).collect()}
    assert report == {k: (sum(x > k for x in n), sum(n), sum(min(x, k) for x in n)) for k in (7, 1000)}
    assert tokens.length_quantile(table, 0.5).first().n_tokens == sorted(n)[-(-len(n) // 2) - 1]
    assert tokens.length_histogram(tokens.token_counts(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.with_crc32(packing.pack(docs, WORDS)).collect()
    made = defaultdict(list)
    for r in rows:
        made[r.doc_id].append(r)
    for i, t in pairs(docs):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(made[i], key=lambda r: r.start)
        if i in (104,):
            continue  # a repeated row: its pieces come twice
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in own)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        ends = [a + b for a, b in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)
    assert packing.pack(none, WORDS).count() == 0


def test_level_choice_grows_squares_least():
    rng = np.random.default_rng(3)
    levels = packing.Levels(16)
    levels.count[1:16] = rng.integers(0, 4, 15)
    for size in range(1, 17):
        def squares(h, size=size):
            count = levels.count.copy()
            if h:
                count[h] -= 1
            if h + size < 16:
                count[h + size] += 1
            return int((count[1:16] ** 2).sum())

        options = [0] + [h for h in range(1, 17 - size) if levels.count[h]]
        assert squares(levels.place(size)) == min(map(squares, options))


def brute_squares(sizes, capacity):
    """The windows that the squares rule makes, as lists of (document, start, length), closed ones and those left open."""
    closed, windows = [], []  # open windows in the order of their last change
    for doc, n in enumerate(sizes):
        start = 0
        while n - start >= capacity:
            closed.append([(doc, start, capacity)])
            start += capacity
        if n == start:
            continue
        fills = Counter(sum(p[2] for p in w) for w in windows)

        def squares(h, size=n - start, fills=fills):
            after = fills.copy()
            after[h] -= h > 0
            if h + size < capacity:
                after[h + size] += 1
            return sum(x * x for x in after.values())

        level = min([h for h in fills if h + n - start <= capacity] + [0], key=lambda h: (squares(h), -h))
        own = next((w for w in reversed(windows) if level and sum(p[2] for p in w) == level), [])
        windows = [w for w in windows if w is not own]
        own.append((doc, start, n - start))
        (closed if level + n - start == capacity else windows).append(own)
    return closed, windows


def test_packing_follows_the_squares():
    """Windows that fill up are those of the rule; at the end only what the gaps of open windows hold moves."""
    rng = np.random.default_rng(21)
    sizes = np.minimum(rng.geometric(0.12, 400), 40).tolist()
    made = defaultdict(list)
    for doc, start, n, window, offset in packing.pack_partition(iter(sizes), 16):
        made[window].append((offset, doc, start, n))
    closed, left = brute_squares(sizes, 16)
    found = sorted(sorted(p[1:] for p in w) for w in made.values())
    assert all(w in found for w in (sorted(w) for w in closed)) and len(closed) > 200
    stays = sum(p in w2 for w in left for p in w for w2 in found)
    gaps = sum(16 - sum(p[2] for p in w) for w in left)
    assert sum(len(w) for w in left) - stays <= gaps
    fills = [sum(p[2] for p in w) for w in found]
    assert sum(fills) == sum(sizes) and sum(f < 16 for f in fills) <= 4 and all(f == 16 or f & (f - 1) == 0 for f in fills)


def test_pieces_match_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = pieces.round_trip_digests(docs, PIECES)
    want = []
    for i, t in pairs(docs):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)
    encoded = pieces.encode(docs, PIECES)
    assert sorted((tuple(r) for r in pieces.decode(encoded, PIECES).collect()), key=repr) == sorted([(i, sp.decode(sp.encode(t or ""))) for i, t in pairs(docs)], key=repr)
    assert pieces.round_trip_digests(none, PIECES).count() == 0


def test_odd_strings_encode_exactly():
    import pyarrow as pa
    import sentencepiece

    sp, model, rnd = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.piece_model(PIECES), random.Random(1)
    texts = ["".join(rnd.choice(["a", "  ", "\n", "▁", "é", "日", "\U0001f600", "aaaa", "<s>", "the", "ha"]) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + ["a" * 999, "ha" * 700, None, " " * 99]
    ids, starts = model.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert sp.encode(t or "", add_bos=True, add_eos=True) == ids[starts[k] : starts[k + 1]].tolist()


def test_lower_words_encode_exactly():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, encode, rnd = Tokenizer.from_file(WORDS), tokens.lower_word_encoder(WORDS), random.Random(2)
    texts = ["".join(rnd.choice(["it's", "IT'S ", " ", "\xa0", "\x1c", "\x85", "É", "É", "İ", "ß", "ΑΣ ", "<|endoftext|>", "<|ENDOFTEXT|>", "a, ", "!!, ", "x. ", "12", "½", "\x0b", "ab12cd", "'s", "'ve", "x'1", "***", "&&b", "é=", "\u0338", "Σ.b", "σΣ", "Σ", "b'", "\x1d", "don't3", "\u0301"]) for _ in range(rnd.randint(0, 20))) for _ in range(800)] + [None]
    ids, starts = encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert tokenizer.encode(t or "", add_special_tokens=False).ids == ids[starts[k] : starts[k + 1]].tolist()


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a b/c", "same"), (2, None, "same"), (9, "u", "same"), (3, "u", ""), (4, "u", None), (7, "u", "päyload\r\n\r\nWARC/1.1"), (None, "n", "same"), (8, "v", "once\n\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    for version in (1, 2):
        records = warc.with_revisits(warc.convert(warc.archives(pages, "page_id", "url", "html", version)))
        path = f"file://{tmp_path}/v{version}"
        warc.write_warc(records, path, records_per_file=3)
        read = warc.referred(warc.read_warc(spark, path)).collect()
        said = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
        found = {r.key: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read}
        first = {"same": "2", "": "3"}
        want = {}
        for i, _, t in rows:
            head = first.get(t or "", str(i))
            want[None if i is None else str(i)] = (len((t or "").encode()), said(t), "response" if head == str(i) else "revisit", None if head == str(i) else head)
        assert found == want
        assert {r.key: bytes(r.payload).decode() for r in read if r.record_type == "response"} == {"2": "same", "3": "", "7": rows[5][2], "8": "once\n\n"}
    assert warc.convert(warc.archives(pages.limit(0), "page_id", "url", "html")).count() == 0


def test_arc_stops_at_a_broken_record():
    data = warc.write_arc(iter([("1", "u", b"abc"), ("2", "u", b"defg")]))
    assert [r["block"][-3:] for r in warc.read_arc(data)] == [b"abc", b"efg"] and len(list(warc.read_arc(data[:-1]))) == 1 and list(warc.read_arc(b"")) == []


def test_arc_with_broken_headers():
    data = warc.write_arc(iter([("1", "http://a", b"abc"), ("2", "http://b", b"defg")]))
    cut = data.index(b"\nhttp://b")
    keys = lambda d: [r["URL"] for r in warc.read_arc(d)]
    assert keys(data) == ["http://a", "http://b"]
    for bad in (b"\nhttp://x 0.0.0.0", b"\nhttp://x 0.0.0.0 20240101 text/html many", b"\nhttp://x 0.0.0.0 soon text/html 3", b"\n\r\n\xff\xfe"):
        assert keys(data[:cut] + bad + data[cut:]) == ["http://a", "http://b"]
    assert keys(data.replace(b"1 0 lociframe", b"v 0 lociframe")) == ["http://a", "http://b"]
    for junk in (b"junk", b"\x00" * 50, b"filedesc://x 0 0 0 none\n1 0 x\n", b"filedesc://x\n", b"\n\n"):
        assert keys(junk) == []


def test_warc_parts_of_any_size():
    rows = [{"record_id": f"urn:{k}", "url": "u", "date": "d", "http_head": b"h", "payload": bytes([65 + k]) * 50 * k, "payload_bytes": 50 * k, "payload_digest": "x", "refers_to": None, "refers_to_url": None, "refers_to_date": None} for k in range(9)]
    import gzip

    data = b"".join(gzip.compress(warc._warc(r).encode() + b"\n") for r in rows)
    assert b"".join(warc.inflated(data)) == gzip.decompress(data)
    for size in (1, 7, 1000):
        plain = gzip.decompress(data)
        found = list(warc.parse_warc(plain[k : k + size] for k in range(0, len(plain), size)))
        assert [(h["WARC-Record-ID"], b.partition(b"\r\n\r\n")[2]) for h, b in found] == [(f"<{r['record_id']}>", r["payload"]) for r in rows]
    assert len(list(warc.parse_warc(warc.inflated(data[:-20])))) == 8


def test_warc_by_bytes(spark, tmp_path, monkeypatch):
    """Archives, batches and files end by bytes: with tiny limits a long page has files of its own."""
    monkeypatch.setattr(warc, "BATCH_BYTES", 500)
    monkeypatch.setattr(warc, "FILE_BYTES", 3_000)
    pages = spark.createDataFrame([(k, f"http://a/{k}", "é" * 20_000 if k == 5 else f"<p>{k}</p>" * (1 + 30 * (k % 3))) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    archives = warc.archives(pages, "page_id", "url", "html")
    assert archives.count() > 10
    warc.write_warc(warc.with_revisits(warc.convert(archives)), f"file://{tmp_path}/w", records_per_file=10)
    assert len(list((tmp_path / "w").glob("*.gz"))) > 4
    read = {int(r.key): r.payload.decode() for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert read == {r.page_id: r.html for r in pages.collect()}


def test_one_id_with_several_texts(spark):
    """Rows that repeat an id with an unlike text are documents of their own: no line and no text is lost."""
    rows = [(1, "p\na one\nb two\nc three\nq"), (2, "x\na one\nb two\nc three\ny"), (2, "u1\nu2\nu3\nu4\nu5"), (2, "u1\nu2\nu3\nu4\nu5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(r.text for r in line_dedup.dedup_lines(docs).collect()) == sorted([rows[0][1], "x\ny", rows[2][1], rows[3][1]])
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, same), (2, same + " more"), (2, "quite another text of six words"), (2, "quite another text of six words"), (3, same + " end"), (4, "a third text that has five words"), (4, ""), (4, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, __id int").repartition(3)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([rows[0], rows[2], rows[5], rows[6], rows[7]])
    assert sorted(tuple(r)[::2] for r in jaccard_join.similarity_components(docs).collect()) == [(1, 1), (2, 1), (2, 2), (2, 2), (3, 1), (4, 4), (4, 4), (4, 4)]


def test_binary_payloads(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe"
    data = warc.write_arc(iter([])) + b"\nhttp://x 0.0.0.0 2001020304 a/b %d\n" % len(block) + block
    records = warc.with_revisits(warc.convert(spark.createDataFrame([(bytearray(data),)], "content binary")))
    assert records.first().date == "2001-02-03T04:00:00Z"
    warc.write_warc(records, f"file://{tmp_path}/b")
    assert bytes(warc.read_warc(spark, f"file://{tmp_path}/b").first().payload) == b"\xff\xfe"


def test_language(spark, none):
    rnd = random.Random(4)
    words = {"en": ["the", "and", "with", "where", "think"], "de": ["der", "und", "nicht", "schön", "für"], "fr": ["être", "avec", "où", "ça", "que"]}
    make = lambda lang: " ".join(rnd.choice(words[lang]) for _ in range(20))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    train = spark.createDataFrame(rows + [(999, None, "en"), (998, "xx", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert model.languages == ["de", "en", "fr"]
    test = spark.createDataFrame([(i, make(lang).upper() if i % 2 else make(lang), lang, 1) for i, lang in enumerate(["en", "de", "fr"] * 10)] + [(50, None, "x", 1), (51, "12 !", "x", 1), (52, "", "x", 1), (53, "Ж" * 9, "x", 1), (54, "und " * 50_000, "de", 1)], "doc_id long, text string, true_lang string, score int")
    found = {r.doc_id: r for r in language_id.identify(test, model, carry=("true_lang",)).collect()}
    assert all(found[i].lang_pred == found[i].true_lang for i in [*range(30), 54])
    assert [(found[i].lang_pred, found[i].score) for i in (50, 51, 52)] == [("und", 0.0)] * 3 and found[53].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.identify(none, model).count() == 0
    assert language_id.fit(none) is None and language_id.identify(test, None).first().lang_pred == "und"


def mapped(text):
    """Bytes as the trees see them: lower case, all ASCII but letters one separator."""
    return bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode())


def brute_bits(train, text):
    """The code length of text after the training texts, by counting every context afresh: orders 3 to 0, escape C, then 8 bits."""
    seen = defaultdict(Counter)
    for t in train:
        data = b"   " + mapped(t) + b" "
        for i in range(3, len(data)):
            for k in range(4):
                seen[data[i - k : i]][data[i]] += 1
    data, bits = b"   " + mapped(text) + b" ", 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            c = seen.get(data[i - k : i])
            if c and data[i] in c:
                bits += np.log2((sum(c.values()) + len(c)) / c[data[i]])
                break
            if c:
                bits += np.log2((sum(c.values()) + len(c)) / len(c))
        else:
            bits += 8
    return bits


def test_code_lengths_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEP", 11)
    rnd = random.Random(12)
    letters = {f"l{k}": "abcdefgh é日ж."[k : k + 6] for k in range(5)}
    train = {lang: ["".join(rnd.choice(of) for _ in range(rnd.randint(0, 40))) for _ in range(6)] for lang, of in letters.items()}
    model = language_id.fit(spark.createDataFrame([(t, lang) for lang, ts in train.items() for t in ts], "text string, lang string"))
    texts = ["".join(rnd.choice("abcdefgh é日жx") for _ in range(n)) for n in (0, 1, 2, 3, 17, 60)]
    data = b"".join(t.encode() for t in texts)
    bits, size = model.lengths(np.frombuffer(data, np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]]))
    assert size.tolist() == [len(t.encode()) + 1 for t in texts]
    for k, t in enumerate(texts):
        assert bits[k] == pytest.approx([brute_bits(train[lang], t) for lang in model.languages], rel=1e-5), t


def test_every_language_is_learnt(spark):
    rows = [(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(0x4E00 + k)} " * 5, f"l{k:03}") for k in range(260)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, max_docs=1)
    assert len(model.languages) == 260
    assert language_id.identify(docs, model, carry=("lang",)).where("lang = lang_pred").count() == 260


def test_quality_classifier(spark, none):
    rnd = random.Random(6)
    good = lambda: " ".join(rnd.choice(["river", "stone", "walks", "under", "light."]) for _ in range(60))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "NOW!!", "$$$", "|"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t, _ in rows] + [(900, None, 0.1), (901, "", 0.1), (None, good(), 0.1), (902, "x" * 500_000, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id long, quality int")
    held = quality_classifier.remainder("doc_id", 5) == 0
    model = quality_classifier.fit(docs, labels.where(~held))
    found = quality_classifier.score(docs, model).join(labels.where(held & F.col("quality").isNotNull()), "doc_id").collect()
    assert len(found) > 40 and all((r.score >= 0.3) == bool(r.quality) for r in found)
    every = quality_classifier.score(docs, model)
    assert every.count() == 304 and every.where("score between 0 and 1").count() == 304
    assert quality_classifier.score(none, model).count() == 0
    assert quality_classifier.fit(docs, labels.limit(0)) is None and quality_classifier.score(docs, None).first().score == 0.5


def test_clashing_names(spark):
    """Columns that are called like those that operators make in passing, or return."""
    rows = [(1, "the river walks under stones. " * 9, "a", "b", "c", "d", 5, 6), (2, None, "a", "b", "c", "d", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text string, __letters string, __id string, __gone string, __lines int, ids int")
    carry = tuple(docs.columns)
    same = lambda df: sorted((tuple(r) for r in df.select(*docs.columns).collect()), key=repr) == sorted(rows, key=repr)
    assert same(line_dedup.dedup_lines(docs)) and same(quality_classifier.score(docs, None, carry=carry))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert same(quality_classifier.score(docs, quality_classifier.fit(docs, labels), carry=carry))
    model = language_id.fit(docs.withColumn("lang", F.lit("en")))
    assert same(language_id.identify(docs, model, carry=carry))
    assert pieces.encode(docs, PIECES, carry=carry).columns == [c for c in carry if c != "ids"] + ["ids"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counted = tokens.token_counts(docs.withColumn("n_tokens", F.lit(1)), path, public_tokenizers.PATTERN, carry=(*carry, "n_tokens"))
    assert same(counted) and counted.columns == [*carry, "n_tokens"] and {r.n_tokens for r in counted.collect()} != {1}


def test_isotonic():
    assert quality_classifier.isotonic(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


def brute_search(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i in queries:
            near = sorted(((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in ok if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_ann(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8), (None, rows[1][1])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    queries = {i for i, _ in rows if i is not None and i % 20 == 0}
    want = brute_search(rows, queries, 5)
    for exact in (True, False):
        found = defaultdict(list)
        for r in ann.search(vectors, F.col("vec_id") % 20 == 0, exact=exact).orderBy("rank").collect():
            found[r.query_id].append((r.vec_id, r.score))
        assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
        hits = sum(len({a for a, _ in found[q]} & {a for a, _ in want[q]}) for q in want)
        assert hits >= (5 * len(want) if exact else 0.9 * 5 * len(want))
        assert [a for a, _ in found[0]] == [400, 401, 402, 403, 404] and found[0][0][1] == pytest.approx(1)


def test_ann_in_blocks(spark, monkeypatch):
    """Buckets of more vectors, or of more queries, than fit one block: the same answers as without blocks."""
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=5) + 4 * (k % 2)]) for k in range(300)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 3 == 0).collect()))
    exact = sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 3 == 0, exact=True).collect()))
    monkeypatch.setattr(ann, "MAX_BUCKET", 7)
    assert sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 3 == 0).collect())) == whole and len(whole) == 500
    assert sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 3 == 0, exact=True).collect())) == exact


def test_session_without_a_checkpoint_folder():
    """In local mode a temporary folder serves; a session of its own, with no Spark settings of the machine."""
    code = """
import tempfile, os
os.environ["SPARK_CONF_DIR"] = tempfile.mkdtemp()
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from lociframe.llm import ann
from lociframe.operators import intervals
rows = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(40)], "vec_id long, embedding array<double>")
assert ann.search(rows, F.col("vec_id") % 20 == 0).count() == 10
from lociframe.model import materialized
assert materialized(spark.range(5), "x").count() == 5
"""
    done = subprocess.run([sys.executable, "-c", code], env={k: v for k, v in os.environ.items() if k != "SPARK_CONF_DIR"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_ann_on_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    found = sorted(tuple(r)[:3] for r in ann.search(few, F.col("vec_id") == 0).collect())
    assert found == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0
