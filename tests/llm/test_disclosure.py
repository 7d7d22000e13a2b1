"""Personal data and disclosing terms against brute force with the contract's plain patterns; odd, long and empty texts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from lociframe.llm import disclosure, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EITHER = re.compile("|".join({"email": r"(?<![A-Za-z0-9._%+-])" + PLAIN["email"], "card": r"[0-9](?:[\x20-]?[0-9]){13,}"}.get(k, PLAIN[k]) for k in ("email", "phone", "card", "ip")))
TERM = re.compile(r"\w{3,}")
SCHEMA = "doc_id long, text string, m string, start long, base string"


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute_base(text):
    kinds = [(at, kind, p) for at, (kind, p) in enumerate(PLAIN.items()) if kind != "email" or "@" in text]
    out = [(m.start(), at, kind, m.end()) for at, kind, p in kinds for m in re.finditer(p, text) if valid(kind, m[0])]
    return sorted(out)


def kind_of(m):
    return "email" if "@" in m else "phone" if m[0] == "+" else "ip" if "." in m else "card"


def words(text):
    return [w for w in TERM.findall(text.lower()) if len(w) <= 64]


def brute_spans(texts):
    """All spans of every text, by the formulas of the docstring."""
    base, near, holds = [brute_base(t) for t in texts], [set() for _ in texts], [set() for _ in texts]
    terms = [set(words(EITHER.sub(" ", t))) for t in texts]
    for i, t in enumerate(texts):
        found, pieces = EITHER.findall(t), EITHER.split(t)
        for k, m in enumerate(found if base[i] else []):
            if valid(kind_of(m), m):
                e = kind_of(m), m.lower() if kind_of(m) in ("email", "ip") else re.sub("[^0-9]", "", m)
                holds[i].add(e)
                near[i] |= {(e, w) for w in words(pieces[k])[-10:] + words(pieces[k + 1])[:10]}
    both, of = Counter(p for x in near for p in x), defaultdict(set)
    for i, x in enumerate(near):
        for p in x:
            of[p].add(texts[i])
    n_e, n_t = Counter(e for x in holds for e in x), Counter(w for x in terms for w in x)
    going = set()
    for (e, w), n in both.items():
        ic, left = math.log2(len(texts) / n_e[e]), math.log2(n_t[w] / n)
        if n >= 2 and len(of[e, w]) > 1 and ic > 0 and ic - left >= 0.5 * ic and left <= 1:
            going.add((e, w))
    out = []
    for i, t in enumerate(texts):
        gone = {w for e, w in near[i] if (e, w) in going}
        masked = EITHER.sub(lambda m: " " * len(m[0]), t)
        more = [(m.start(), 4, "term", m.end()) for m in TERM.finditer(masked) if m[0].lower() in gone and not any(b[0] < m.end() and m.start() < b[3] for b in base[i])]
        out.append(sorted(base[i] + more))
    return base, out


def named(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def corpus():
    rnd = random.Random(11)
    common = [f"{a}{b}{c}" for a in "bdfk" for b in "aeio" for c in ("n", "rt", "s", "Lé")]
    people = [("anna.k+x@mail.example.org", "harbour", "Quillon"), ("198.51.100.7", "lantern42", "violet"), ("4539 1488 0343 6467", "Zephyr", "common"), ("+44 (20) 7946-0958", "ledger", "5550")]
    out = []
    for i in range(160):
        words_ = [rnd.choice(common) for _ in range(rnd.randint(15, 60))]
        if i % 4 == 0:
            value, a, b = people[(i // 4) % 4]
            at = rnd.randrange(len(words_))
            words_[at:at] = [a, value, b] if i % 8 else [value, "," + a]
        out.append(" ".join(words_))
    out += [out[0]] * 3 + [out[4] + " anon@host.example", out[4] + " anon@host.example"]  # copies of one text tell nothing
    odd = [
        "", " \n", "a@b", "a@b.c", "x@y.c.@d.e", "a@b.c_x@d.e%f@g.h-", "é@b.c é1.2.3.4é", "a@b@c.d", "..@-.-", "@", "+", "0", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0255.0.00.1", "1.2.3.456", "1..2.3.4",
        "99999999999999999999.1.1.1", "4539-1488-0343-6467-", "45391488034364670", "4539  1488 0343 6467", "0 0 0 0 0 0 0 0 0 0 0 0 0 0", "00000000000000000000", "+1 (017) 555-7713.9", "+1 1", "+12", "+1 ( ) .", "++1 555 555 5555 5",
        "+1234567890123456", "+4539148803436467@x.org 4539148803436467.1.2.3", "tel:+1-202-555-0143ext", "日本語1.1.1.1語 a@b.c", "ref1.2.3.4ref", "𝒳 a@b.c 𝒳", "4539148803436467@z.example 1.2.3.4@z.example",
    ]
    return out + odd


def run(spark, path, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "m", 1, "b") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return queries.queries()["op13_disclosure"](spark, str(path)).collect()


def test_disclosure(spark, tmp_path):
    texts = corpus()
    found = {r.doc_id: r for r in run(spark, tmp_path, [*texts, None])}
    base, spans = brute_spans([*texts, ""])
    for i, r in found.items():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[2] == k for b in base[i]) for k in disclosure.KINDS)
        assert r.base_sha256 == hashlib.sha256(named(base[i]).encode()).hexdigest() and r.spans == named(spans[i])
    assert len(found) == len(texts) + 1
    assert sum(r.n_terms for r in found.values()) > 40 and all(r.n_terms == 0 for r in found.values() if r.base_sha256 == hashlib.sha256(b"").hexdigest())


def test_repeated_and_null_ids(spark, tmp_path):
    texts = [*corpus(), None]
    found = run(spark, tmp_path, texts, [None if i % 3 else 7 for i in range(len(texts))])
    want = Counter(named(s) for s in brute_spans([t or "" for t in texts])[1])
    assert Counter(r.spans for r in found) == want


def test_long_texts(spark, tmp_path):
    """Runs, chains and thousands of values take time in proportion to the text."""
    texts = ["a" * 300_000, "a." * 150_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "+1" + " (" * 150_000, "1 " * 150_000, "a@b" + ".c" * 150_000, "a1@b.c 1.2.3.4 " * 5_000, "4539148803436467 x " * 3_000, " " * 300_000]
    found = {r.doc_id: r for r in run(spark, tmp_path, texts)}
    for i, t in enumerate(texts):
        want = named(brute_base(t))
        assert found[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == [] and [r.spans for r in run(spark, tmp_path, [None, "nothing here"])] == ["", ""]


def test_sanitised(spark):
    rows = [(1, "write anna@x.org near Harbour"), (2, "ask anna@x.org at harbour now"), (3, "plain words"), (4, "pay 4539148803436467.1.2.3 or 4539148803436467")] + [(k, "plain words") for k in range(5, 30)]
    found = disclosure.find(spark.createDataFrame(rows, "doc_id long, text string"))
    told = {r.doc_id: r.s for r in found.select("doc_id", disclosure.sanitised().alias("s")).collect()}
    assert told[1] == "write <email> near " and told[2] == "ask <email> at  now" and told[3] is None
    assert told[4] == "pay <card>.1.2.3 or <card>"
