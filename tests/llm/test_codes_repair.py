"""Vector codes and conversation repair against brute force, on odd rows and on empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lociframe.llm import conversation_repair, queries, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, code string"
TURNS = "conv_id long, turn long, role string, text string"


def brute_codes(rows):
    """{(vec_id, vector): (code, error)}, label errors and digest of one codebook a part, all distances compared."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = [[int(np.floor(1024 * x)) for x in r[1]] for r in rows]
    cuts = np.cumsum([0, *[len(x) for x in np.array_split(range(len(q[0])), 4)]])
    codes, errors, entries = [[] for _ in q], [0] * len(q), []
    for a, b in itertools.pairwise(cuts):
        parts = [x[a:b] for x in q]
        book = [list(p) for p in parts[:256]]
        for k in range(5):
            found = [min((sum((u - v) ** 2 for u, v in zip(p, e, strict=True)), i) for i, e in enumerate(book)) for p in parts]
            if k < 4:
                for i in range(len(book)):
                    if own := [p for p, f in zip(parts, found, strict=True) if f[1] == i]:
                        book[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        for n, (d, i) in enumerate(found):
            codes[n].append(i)
            errors[n] += d
        entries += [x for e in book for x in e]
    by_label = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    out = sorted((repr(r[0]), "".join(f"{i:02x}" for i in c), e, by_label[r[2]]) for r, c, e in zip(rows, codes, errors, strict=True))
    return out, hashlib.sha256(",".join(map(str, entries)).encode()).hexdigest()


def run_codes(spark, path, rows):
    spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(3).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    found = queries.queries()["op11_vector_codes"](spark, str(path))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return found.collect()


@pytest.mark.parametrize("size", [8, 6, 3])
def test_vector_codes(spark, tmp_path, size):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(12, size))
    rows = [(int(i) * 3 - 100, [float(x) for x in centres[i % 12] + rng.normal(size=size) * 0.2], [None, 1, 2, 1][i % 4]) for i in range(420)]
    rows += [(5000 + k, list(rows[k][1]), 2) for k in range(40)] + [(rows[7][0], list(rows[7][1]), 1), (None, [0.5] * size, None), (None, [-0.5] * size, 1)]
    odd = [(9000, None, 1), (-9001, [None, *[0.0] * (size - 1)], 1), (-9002, [float("nan")] * size, 1), (9003, [float("-inf")] * size, 2), (9004, [1.0] * (size + 1), 2), (9005, [], 1)]
    found = run_codes(spark, tmp_path, rows + odd)
    want, digest = brute_codes(rows)
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in found) == want and {r.codebooks_sha256 for r in found} == {digest}


def test_vector_codes_few_and_equal_rows(spark, tmp_path):
    rows = [(i, [0.25 * (i % 2)] * 4, None) for i in range(5)]  # entries that tie, fewer than the codebook holds
    found = run_codes(spark, tmp_path, rows)
    want, digest = brute_codes(rows)
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in found) == want and found[0].codebooks_sha256 == digest
    assert run_codes(spark, tmp_path, []) == [] and run_codes(spark, tmp_path, [(1, None, 2)]) == []
    assert len(run_codes(spark, tmp_path, [(1, [1e200, -1e200, 0.0, 1.0], 1), (2, [0.0] * 4, 1), (3, [1e300] * 4, 1)])) == 3


def test_bounds_spare_comparisons(spark):
    """In tight clusters most parts keep their entry without being compared with all; the codes stay exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 8)) * 4
    rows = [(i, [float(x) for x in centres[i % 300] + rng.normal(size=8) * 0.05], 0, "") for i in range(3000)]
    rows_df = vector_codes.usable(spark.createDataFrame(rows, VECTORS))
    books = vector_codes.first_codebooks(rows_df)
    state, moved, scans = vector_codes.begin(rows_df, books), [np.zeros(256)] * 4, []
    for _ in range(3):
        state = vector_codes.assigned(state, books, moved).cache()
        scans.append(state.agg({"n_scanned": "sum"}).first()[0])
        books, moved = vector_codes.means(state, books)
    assert 11_000 < scans[0] <= 4 * 3000 and scans[2] < scans[0] // 2


def initials(turns):
    return "".join(r[:1] if r[:1] else "?" for r, _ in turns)


def brute_damage(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c] += []
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out[c] += [(t, "user" if code == 4 else r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def brute_repair(rows):
    """All ways of edits with two inserts at most in a row, by cost, then by their letters."""
    seen, kinds, counts = set(), [], defaultdict(int)
    for _, r, x in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", x)
        kind = "blank" if not shown else "duplicate" if (r, x) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((r, x))
        kinds.append(kind)
        counts[kind] += 1
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    inserts = [[], [("user", "")], [("assistant", "")], [("user", ""), ("assistant", "")], [("assistant", ""), ("user", "")]]
    ways = [(2 * len(i), "I" * len(i), tuple(i)) for i in inserts]
    for (_, r, x), kind in zip(rows, kinds, strict=True):
        step = {}
        for cost, audit, made in ways:
            options = [(3, "D", ())]
            if kind not in ("blank", "duplicate"):
                extra = kind == "truncated"
                options += [(extra, "K", ((r, x),)), (2 + extra, "R", (("user", x),)), (2 + extra, "R", (("assistant", x),))]
            for (c, letter, turn), tail in itertools.product(options, inserts):
                new = (*made, *turn, *tail)
                if re.fullmatch("s?(ua)*u?", initials(new)):
                    key = initials(new)[:1] == "s", len(new), initials(new)
                    way = (cost + c + 2 * len(tail), audit + letter + "I" * len(tail), new)
                    step[key] = min(step.get(key, way), way)
        ways = list(step.values())
    cost, audit, made = min(w for w in ways if re.fullmatch("(s?(ua)+)?", initials(w[2])))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()


def run_repair(spark, path, rows):
    spark.createDataFrame([(*r, "y") for r in rows], TURNS + ", lost string").repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    found = queries.queries()["op12_conversation_repair"](spark, str(path)).collect()
    return {r.conv_id: tuple(r)[1:] for r in found}, len(found)


def test_conversation_repair(spark, tmp_path):
    rnd, rows = random.Random(3), []
    for c in range(150):
        turns = 0
        for t in range(rnd.randint(1, 6)):
            turns += rnd.choice([1, 1, 1, 0, 3])
            rows.append((c, turns, rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "umpire"]) if rnd.random() < 0.4 else ["user", "assistant"][t % 2],
                         rnd.choice(["Yes.", "No!", "cut", "cut ", " \n\t", "", None, "Why?\n", "é…", "x."]) if rnd.random() < 0.6 else f"Line {t}."))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "So."), (None, None, "system", "Be."), (500, None, "user", "Hi."), (500, None, "user", "Hi."), (501, 10**12, "system", "a. " * 9000)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    found, n = run_repair(spark, tmp_path, rows)
    want = {c: brute_repair(v) for c, v in brute_damage(rows).items()}
    assert n == len(want) and found == want
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert len({w[6] for w in want.values()}) > 60 and {x for w in want.values() for x in w[6]} == set("KRDI")


def test_repair_of_no_rows(spark, tmp_path):
    assert run_repair(spark, tmp_path, []) == ({}, 0)


def test_repair_in_blocks(spark, monkeypatch):
    """The fold in blocks gives what one block gives."""
    rnd = random.Random(9)
    rows = [(1, k, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", f"c{k}."]), False) for k in range(60)]
    df = spark.createDataFrame(rows, TURNS + ", lost boolean")
    whole = [tuple(r) for r in conversation_repair.repair(df).collect()]
    for size in (1, 7):
        monkeypatch.setattr(conversation_repair, "BLOCK", size)
        assert [tuple(r) for r in conversation_repair.repair(df).collect()] == whole
