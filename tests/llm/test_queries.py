"""The registered queries over a small folder of tables, against brute force, with held-out rows and types; and over
empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_text_operators import PIECES, WORD, WORDS, brute_dedup, brute_rules, brute_search

import public_tokenizers
from lociframe.llm import queries, quality_classifier

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid string"
SPEECH = {"en": "the river and stone with light under where think walks", "de": "der fluss und nicht schön für stein licht unter wo", "fr": "être avec où ça que pierre sous la rivière lumière"}


def remainder(i, k):
    return zlib.crc32(str(i).encode()) % k


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(17)
    path = str(tmp_path_factory.mktemp("tables"))

    def prose(lang, n):
        return "\n".join(" ".join(rnd.choice(SPEECH[lang].split()) for _ in range(9)) for _ in range(n))

    rows = []
    for i in range(150):
        lang = rnd.choice(sorted(SPEECH))
        rows.append((i, prose(lang, rnd.randint(2, 9)) if i % 4 else "BUY!! NOW!! $$$ | " * 9 + prose(lang, 2), lang))
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(1, 30, 3)]  # exact copies
    rows += [(300 + k, rows[k][1] + " more", rows[k][2]) for k in range(1, 40, 4)]  # near copies
    rows += [(400, None, None), (401, "", "en"), (402, " \n", None), (403, "12 !?", "fr"), (404, "x" * 90_000, "en"), (405, None, "de")]
    made = [(i, t, lang, "web", len(t or ""), "s") for i, t, lang in rows]
    spark.createDataFrame(made, DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(150)] + [(1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(k, f"http://a/{k}", [None, "", f"<p>{k % 7}</p>", f"<p>é{k}</p>"][k % 4]) for k in range(40)] + [(3, "http://twice", "<p>é3</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(2)
    vectors = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(220, 6)))] + [(300, [1e200] * 6), (301, [0.0] * 6), (302, None), (303, [float("inf")] * 6)]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, rows, pages, vectors


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: queries.queries()[name](spark, folder[0])


def test_line_dedup(run, folder):
    want = {i: t for i, t in brute_dedup([r[:2] for r in folder[1]])}
    found = run("op1_line_dedup").collect()
    assert {r.doc_id: r.kept_md5 for r in found} == {i: None if t is None else hashlib.md5(t.encode()).hexdigest() for i, t in want.items()}
    assert sum(r.n_removed_lines for r in found) > 30


def test_quality_rules(run, folder):
    found = {r.doc_id: r for r in run("op2_quality_rules").collect()}
    for i, t, _ in folder[1]:
        m, r = brute_rules(t), found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and not (r.base_failed and r.kept)


def test_jaccard_join(run, folder):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = {i: shingles(t) for i, t, _ in folder[1]}
    least = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in run("op3_jaccard_join").collect()}
    assert found == {i: (len(s), least[i]) for i, s in sets.items()} and len(links) > 15


def test_token_counts(run, folder):
    from lociframe.llm import tokens

    encoder = tokens.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = [len(encoder.encode_ordinary(t or "")) for _, t, _ in folder[1]]
    found = {r.n_tokens: (r.n_docs, r.docs_at_least) for r in run("op4_token_counts").collect()}
    assert found == {k: (n.count(k), sum(x >= k for x in n)) for k in set(n)}


def test_packing(run, folder):
    from tokenizers import Tokenizer

    tokenizer, made, windows = Tokenizer.from_file(WORDS), defaultdict(list), defaultdict(list)
    for r in run("op5_packing").collect():
        made[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for i, t, _ in folder[1]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(made[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)


def test_warc(run, folder):
    first = {}
    for i, _, h in folder[2]:
        if h is not None or True:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in folder[2]:
        data, head = (h or "").encode(), first[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if head == i else "revisit", None if head == i else head))
    assert sorted((tuple(r) for r in run("op6_warc").collect()), key=repr) == sorted(want, key=repr)


def test_language(run, folder):
    found = {r.doc_id: r for r in run("op7_language_id").collect()}
    assert len(found) == len(folder[1])
    for i, t, lang in folder[1]:
        r = found[i]
        assert r.held_out == (remainder(i, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", t or ""))
    held = [(i, lang) for i, _, lang in folder[1] if i < 150 and found[i].held_out]
    assert len(held) > 20 and sum(found[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)


def test_neighbours(run, folder):
    want = brute_search(folder[3][:220] + [(300, [1.0] * 6)], {k for k in range(0, 301, 50)}, 5)
    found = defaultdict(list)
    for r in sorted(run("op8_ann").collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    assert sum(len({a for a, _ in found[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    vectors = {i: np.array(v) / max(map(abs, v)) for i, v in [*folder[3][:220], folder[3][220]]}
    for q, near in found.items():
        for i, s in near:
            assert s == pytest.approx(vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i]), abs=1e-12)


def test_pieces(run, folder):
    import sentencepiece

    sp, want = sentencepiece.SentencePieceProcessor(model_file=PIECES), []
    for i, t, _ in folder[1]:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in run("op9_piece_codec").collect()) == sorted(want)


def test_quality_classifier(run, folder):
    found = {r.doc_id: r for r in run("op10_quality_classifier").collect()}
    assert len(found) == len(folder[1])
    for i, r in found.items():
        assert r.held_out == (remainder(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [i for i in range(150) if found[i].held_out]
    assert len(held) > 15 and all(found[i].predicted == int(i % 4 > 0) for i in held)


def test_normal_equations_against_all_rows_at_once(spark):
    """The ridge scores of partition sums are those of the whole matrix."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    rows = [(i, " ".join(["stone"] * int(5 + 20 * abs(v[0]))) + "!" * int(3 * abs(v[1])) + " A" * int(4 * abs(v[2])), int(v[0] > 0.5)) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_classifier.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 3]
    data = b"".join(t.encode() for _, t, _ in kept)
    z = model.features(quality_classifier.statistics(np.frombuffer(data, np.uint8), np.cumsum([0, *[len(t) for _, t, _ in kept]])))
    a, b = z.T @ z, z.T @ np.array([y for *_, y in kept], float)
    a += quality_classifier.RIDGE * len(rows) / 100 * np.diag(np.append(np.ones(quality_classifier.N_FEATURES), 1e-6))
    assert np.allclose(z @ np.linalg.solve(a, b), z @ model.ridge, atol=1e-6)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
