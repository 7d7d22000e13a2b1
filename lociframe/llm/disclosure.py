"""Sanitisation of texts by what terms disclose, in DataFrame functions only.

Personal data are spans of four kinds, found by fixed patterns (leftmost, without overlap inside a kind): email, ip, card, phone.
Every such value is an entity to protect. Cutting its spans isn't enough where words near it tell it as well, so the corpus is asked
how much they tell. With n documents, n(e) that hold entity e, n(t) that hold term t, and n(e, t) that hold t within CONTEXT terms of e,
without another entity between them:

    information of e            IC = log2(n / n(e))
    what t discloses of it      PMI = log2(n * n(e, t) / (n(e) * n(t)))
    what is left after t        IC - PMI = log2(n(t) / n(e, t))

A term goes where it discloses DISCLOSED of the entity's information at least and leaves MOST_LEFT bits at most; it is removed where
at most REMOVE_LEFT bits are left, and generalised (to <number>, <code>, <name> or <word>) otherwise. Estimates need MIN_DOCUMENTS
documents, not all of one text. The term then goes wherever it stands in a document where it is near the entity; documents without
personal data are never touched.

A term is a run of 3 to 64 letters, digits and underscores outside personal data, in lower case. All counts are over all rows: copies
count each, null texts are empty, an empty table gives an empty result. Results depend on the text alone, so repeated and null ids do no
harm; extra columns aren't read. Patterns never try a start within a run again and offsets are summed in blocks, so long texts take time
in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import all_matches, let, placed
from .shared import stored

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, with possessive runs that start where runs start or the last match ended: the same matches in one pass.
_RUN_START, _EMAIL = r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PATTERNS = {
    "email": rf"(?:\G|{_RUN_START}){_EMAIL}",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every ip, card and phone holds; with "@" for emails, a cheap first look.
NUMBER = r"[0-9][\x20().0-9-]{5,}[0-9]"
#: What parts a text for its terms. An email begins where a run does here: looking on from each match of another kind would take the square
#: of a long run.
ANY = "|".join((_RUN_START + _EMAIL, PATTERNS["phone"], PATTERNS["card"], PATTERNS["ip"]))
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
TERM = r"[\p{L}\p{N}_]{3,}"
LONGEST_TERM = 64
CONTEXT = 10
MIN_DOCUMENTS = 2
DISCLOSED, MOST_LEFT, REMOVE_LEFT = 0.5, 1.0, 0.15
#: Rows of a term, or of an entity and a term, that may be broadcast: at most some 400 bytes each.
BROADCAST_TERMS = 50_000
_JOINT = "\u001f"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (1 + (F.length(digits) - i) % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


#: Whether a match of a kind's pattern is personal data.
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(OCTETS),
    "card": lambda m: F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """The personal data of a text, an array of (start, kind_at, kind, end) in order."""

    def of(at: int, kind: str) -> Column:
        found = F.filter(placed(text, PATTERNS[kind]), lambda z: VALID[kind](z.m))
        return F.transform(found, lambda z: F.struct(z.start.alias("start"), F.lit(at).alias("kind_at"), F.lit(kind).alias("kind"), (z.start + F.length(z.m)).alias("end")))

    return F.sort_array(F.concat(*[of(at, kind) for at, kind in enumerate(KINDS)]))


def _terms(text: Column) -> Column:
    return F.filter(all_matches(F.lower(text), TERM), lambda t: F.length(t) <= LONGEST_TERM)


def _maybe(text: Column) -> Column:
    return text.contains("@") | text.rlike(NUMBER)


def _entity(m: Column) -> Column:
    """The entity that a match of ANY names: its kind and plain value; null where it isn't personal data."""
    return (
        F.when(m.contains("@"), F.concat(F.lit("email:"), F.lower(m)))
        .when(m.startswith("+"), F.when(VALID["phone"](m), F.concat(F.lit("phone:"), _digits(m))))
        .when(m.contains("."), F.when(VALID["ip"](m), F.concat(F.lit("ip:"), m)))
        .otherwise(F.when(VALID["card"](m), F.concat(F.lit("card:"), _digits(m))))
    )


def contexts(text: Column) -> Column:
    """The distinct (entity, term) of a text as joined strings: terms within CONTEXT terms of the entity."""
    found, pieces = all_matches(text, ANY), F.split(text, ANY, -1)

    def pairs(z: Column) -> Column:
        def of(m: Column, i: Column) -> Column:
            before, after = F.get(z.terms, i), F.slice(F.get(z.terms, i + 1), 1, CONTEXT)
            near = F.concat(F.slice(before, F.greatest(F.size(before) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT)), after)
            entity = _entity(m)
            return F.when(entity.isNotNull(), F.transform(near, lambda t: F.concat(entity, F.lit(_JOINT), t))).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.flatten(F.transform(z.found, of)))

    return let(F.struct(found.alias("found"), F.transform(pieces, _terms).alias("terms")), pairs)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base (its spans) and, only for texts with personal data, text, h1 and h2 (its hash), entities and pairs."""
    text = F.col("text")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", F.when(_maybe(text), base_spans(text)))
    rows = rows.withColumn("private", F.coalesce(F.size("base"), F.lit(0)) > 0)
    own = {"text": text, "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text"), "entities": F.array_distinct(F.filter(F.transform(all_matches(text, ANY), _entity), lambda e: e.isNotNull())), "pairs": contexts(text)}
    return rows.select(F.col(id_col), "private", F.when(F.col("private"), F.col("base")).alias("base"), *[F.when(F.col("private"), c).alias(name) for name, c in own.items()])


def _small(df: DataFrame) -> DataFrame:
    """df, stored, marked for broadcast if it is small enough for that."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """pair, entity, term, n_both, n_entity, n_term and left (bits of the entity that the term leaves), of all terms that go."""
    near = found.select(F.explode("pairs").alias("pair"), "h1").groupBy("pair").agg(F.count(F.lit(1)).alias("n_both"), F.min("h1").alias("low"), F.max("h1").alias("high"))
    near = near.where((F.col("n_both") >= MIN_DOCUMENTS) & (F.col("low") < F.col("high")))
    near = stored(near.select("pair", F.substring_index("pair", _JOINT, 1).alias("entity"), F.substring_index("pair", _JOINT, -1).alias("term"), "n_both"), "pairs")
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    wanted = _small(stored(near.select("term").distinct(), "terms"))
    text = F.col(text_col).cast("string")
    words = F.array_distinct(_terms(F.when(_maybe(text), F.regexp_replace(text, ANY, " ")).otherwise(text)))
    terms = docs.select(F.explode(words).alias("term")).join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    counted = near.join(entities, "entity").join(terms, "term").withColumn("n", F.lit(docs.count()))
    information = F.log2(F.col("n") / F.col("n_entity"))
    left = F.log2(F.col("n_term") / F.col("n_both"))
    return counted.withColumn("left", left).where((information - F.col("left") >= DISCLOSED * information) & (information > 0) & (F.col("left") <= MOST_LEFT))


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """The spans of a text's flagged terms ((term, removed) in terms) outside its personal data."""
    masked = F.array_join(F.transform(F.arrays_zip(F.split(text, ANY, -1).alias("p"), all_matches(text, ANY).alias("m")), lambda z: F.concat(z.p, F.repeat(F.lit(" "), F.coalesce(F.length(z.m), F.lit(0))))), "")
    keys = F.map_from_entries(terms)
    hits = F.filter(placed(masked, TERM), lambda z: F.map_contains_key(keys, F.lower(z.m)))
    spans = F.transform(hits, lambda z: F.struct(z.start.alias("start"), F.lit(len(KINDS)).alias("kind_at"), F.lit("term").alias("kind"), (z.start + F.length(z.m)).alias("end"), F.element_at(keys, F.lower(z.m)).alias("removed"), z.m.alias("m")))
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, base (start, kind_at, kind, end of its personal data), terms (the same with removed and m,
    of the terms that go) and, where base isn't empty, text."""
    found = stored(scanned(docs, id_col, text_col), "private")
    private = found.where("private")
    flagged = stored(disclosing(docs, private, text_col).select("pair", "term", (F.col("left") <= REMOVE_LEFT).alias("removed")), "disclosing")
    near = private.select("h1", "h2", F.explode("pairs").alias("pair")).distinct()
    hits = near.join(_small(flagged), "pair").groupBy("h1", "h2", "term").agg(F.max("removed").alias("removed"))
    hits = hits.groupBy("h1", "h2").agg(F.collect_list(F.struct("term", "removed")).alias("flagged"))
    spans = _term_spans(F.col("text"), F.col("flagged"), F.col("base"))
    kind = "array<struct<start:bigint,kind_at:int,kind:string,end:bigint,removed:boolean,m:string>>"
    told = private.join(hits, ["h1", "h2"], "left").select(id_col, "base", F.when(F.col("flagged").isNotNull(), spans).otherwise(F.array().cast(kind)).alias("terms"), "text")
    clean = found.where("not private").select(id_col, F.array().cast("array<struct<start:bigint,kind_at:int,kind:string,end:bigint>>").alias("base"), F.array().cast(kind).alias("terms"), F.lit(None).cast("string").alias("text"))
    return told.unionByName(clean)


def number_of(kind: str) -> Column:
    """How many personal data of a kind a row of find() has."""
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def all_spans() -> Column:
    plain = F.transform("terms", lambda s: F.struct(s.start.alias("start"), s.kind_at.alias("kind_at"), s.kind.alias("kind"), s.end.alias("end")))
    return F.sort_array(F.concat(F.col("base"), plain))


def sanitised() -> Column:
    """The text of a row of find() with <kind> for personal data, terms generalised or removed; null for texts that stay as they are."""
    general = F.transform("terms", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.when(s.removed, "").when(s.m.rlike("^[0-9]+$"), "<number>").when(s.m.rlike("[0-9]"), "<code>").when(s.m.rlike(r"^\p{Lu}"), "<name>").otherwise("<word>").alias("put")))
    plain = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.concat(F.lit("<"), s.kind, F.lit(">")).alias("put")))
    merged = F.sort_array(F.concat(plain, general))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def put(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(s.start - a["at"], F.lit(0)).cast("int"))
        label = F.when(s.start >= a["at"], s["put"]).otherwise("")  # what overlaps the span before goes with it
        return F.struct(F.greatest(a["at"], s.end).alias("at"), F.concat(a["out"], F.array(F.concat(gap, label))).alias("out"))

    done = F.aggregate(merged, start, put)
    rest = let(done, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    return F.when(F.col("text").isNotNull(), rest)
