"""Requests in plain text: the names they mention, misspelt words, chains of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import all_matches, let, placed
from ..functions.text import clean, edit_distance, fuzzy_limit

#: What names look like, and what stands before a gene (fixed values).
TOKEN = r"chr[0-9A-Za-z]+[:_-]\d+[-_]\d+|[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9]|[A-Za-z0-9]"
PEAK = r"(?i)^chr[0-9A-Za-z]+[:_-]\d+[-_]\d+$"
GENE_SHAPED = r"^[A-Za-z]{2,}\d+[A-Za-z0-9]*$"
GENE_CUE = r"(?i)\b(?:plot|show|visuali[sz]e|display|violin(?:\s+plot)?|dot\s*plot|impute|predict|expression\s+(?:of|for)|gene|genes|feature\s+plot|overlay|color(?:\s+\w+)?\s+by|links?\s+(?:for|to|of))\s*$"
CUE_LENGTH = 40
#: Gene names that are English words, which count as genes in capitals or after the word gene only (fixed values).
ENGLISH_GENES = tuple(
    """ace ache ado ar arc bad bid camp cast cat chat clock coil cope fry gal gale gem hunk ilk impact itch kin kit mag mall max met mice musk numb oaf oat
    palm pip plat pole poll pomp prep pry ran reck rest sag sell set she si ski son star strap sync tank tat th timeless trio tub was mars grasp sis lars tars
    wap an the and or of to in on at by for with from into onto is are be me my we us you it its this that near all any can do does how what why who which
    where when top per up out not no yes new old one two use get show plot run find make give let see""".split()
)
#: Gene names that are technical words, which count after the word gene only (fixed values).
TECHNICAL_GENES = ("tf", "pc", "ids", "pdf")
#: Words of requests that misspelt ones are taken for, the first that is near; and words that stay as they are (fixed values).
KEYWORDS = tuple(
    """cluster clusters violin dotplot umap expression markers marker rename recluster rerun resolution parameters parameter settings filtering filter genes
    gene plot show find tell about cell cells color colors min dist list qc spatial tissue coordinates""".split()
)
NEVER_CORRECTED = tuple(
    """how now low row snow slow shoe shop shot stow call calls well wells sell sells tells bell bells fell yell tall till toll dell fine kind mind bind wind
    fund fond fins gone gent gents last lost lust mist most must just dust diet disk issue market special revolution pilot impression colon filler fitter
    perimeter perimeters slot blot plod ploy""".split()
)
#: Names of plots and what they are called here (fixed values).
SYNONYMS = ((r"\bvln\s*plots?\b|\bvln\b", "violin plot"), (r"\bfeature\s*plots?\b", "feature plot"), (r"\bdot\s*plots?\b", "dot plot"), (r"\bdim\s*plots?\b", "umap plot"))
#: Verbs that begin a command (fixed values).
RENAMES = "rename|change|set|call|label"
FIRST_VERBS = RENAMES + "|plot|show|run|execute|find|get|update|create|display|visualize|cluster|analyze|rerun"
VERBS = (
    "plot|show|rename|change|run|find|get|set|update|create|display|visualize|execute|analyze|rerun|highlight|isolate|focus|clear|remove|reset|impute|segment|filter"
    "|recluster|redo|compare|describe|tell|list|give|make"
)
NEXT_VERBS = "plot|show|display|visualize|rename|change|set|find|get"


def entities(texts: DataFrame, genes: DataFrame | None = None, labels: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """A row for each text: id_col, genes (text, symbol, start, end, guessed), clusters (text, ids, start, end), both in order, and masked:
    the text with "gene" and "cluster" in their place, lists of them as one.

    genes (name) and labels (label, cluster) are joined by token, so neither is held whole in one place. A name that is both is a
    label, unless words before it ask for a gene. Without genes, tokens shaped like one are guessed. id_col must be unique."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    shouting = F.length(F.regexp_replace(letters, "[^A-Z]", "")) > 0.8 * F.length(letters)

    tokens = texts.select(F.col(id_col).alias("of"), F.explode(placed(text, TOKEN)).alias("t")).select("of", F.col("t.m").alias("tok"), "t.start")
    if genes is None:
        tokens = tokens.withColumn("symbol", F.lit(None).cast("string"))
    else:
        index = genes.where("name <> ''").groupBy(F.upper("name").alias("gene_key")).agg(F.min("name").alias("symbol"))
        tokens = tokens.join(index, F.upper("tok") == F.col("gene_key"), "left")
    if labels is None:
        tokens = tokens.withColumn("ids", F.lit(None).cast("array<bigint>"))
    else:
        index = labels.where("label is not null").groupBy(F.lower("label").alias("label_key")).agg(F.sort_array(F.collect_list(F.col("cluster").cast("long"))).alias("ids"))
        tokens = tokens.join(index, F.lower("tok") == F.col("label_key"), "left")
    tok, symbol, ids = (F.col(c) for c in ("tok", "symbol", "ids"))
    can_be = symbol.isNotNull() | ids.isNotNull() | tok.rlike(PEAK)
    if genes is None:
        can_be |= tok.rlike(GENE_SHAPED)
    span = F.struct("start", (F.col("start") + F.length("tok")).alias("end"), tok.alias("text"), "symbol", "ids")
    spans = tokens.where(can_be).groupBy("of").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    rows = texts.select(F.col(id_col), text.alias("said"), shouting.alias("shouting")).join(spans, F.col(id_col) == F.col("of"), "left")

    def kind(s: Column) -> Column:
        """What a token that can be a name is; what stands before it is looked at only where that decides."""
        before = F.substring(F.col("said"), (F.greatest(s.start - CUE_LENGTH, F.lit(0)) + 1).cast("int"), F.least(s.start, F.lit(CUE_LENGTH)).cast("int"))
        low, capitals = F.lower(s.text), (s.text == F.upper(s.text)) & ~F.col("shouting")
        word = (F.length(s.text) == 1) | low.isin(*TECHNICAL_GENES) | low.isin(*ENGLISH_GENES) & ~capitals
        barred = s.text.rlike(r"^\d+(?:\.\d+)?$") | word & ~before.rlike(r"(?i)\bgenes?\s*$")
        out = F.when(s.text.rlike(PEAK), "peak").when(s.ids.isNotNull() & ~(s.symbol.isNotNull() & before.rlike(GENE_CUE)), "cluster")
        if genes is None:
            out = out.when(s.ids.isNull() & s.text.rlike(GENE_SHAPED), "guess")
        return out.when(s.symbol.isNotNull() & ~barred, "gene")

    told = F.transform("spans", lambda s: let(kind(s), lambda k: F.struct(s.start.alias("start"), s.end.alias("end"), s.text.alias("text"), F.when(k == "gene", s.symbol).otherwise(s.text).alias("symbol"), s.ids.alias("ids"), k.alias("kind"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string,symbol:string,ids:array<bigint>,kind:string>>")
    rows = rows.select(id_col, "said", F.coalesce(F.filter(told, lambda s: s.kind.isNotNull()), none).alias("named"))
    spans = F.col("named")
    genes_ = F.transform(F.filter(spans, lambda s: s.kind != "cluster"), lambda s: F.struct(s.text.alias("text"), s.symbol.alias("symbol"), s.start.alias("start"), s.end.alias("end"), (s.kind == "guess").alias("guessed")))
    clusters = F.transform(F.filter(spans, lambda s: s.kind == "cluster"), lambda s: F.struct(s.text.alias("text"), s.ids.alias("ids"), s.start.alias("start"), s.end.alias("end")))
    return rows.select(id_col, genes_.alias("genes"), clusters.alias("clusters"), masked(F.col("said"), spans).alias("masked"))


def masked(text: Column, spans: Column) -> Column:
    """text with the word of its kind in place of each of spans (start, end, kind, in order), lists of one kind as one word."""
    kept = F.transform(spans, lambda s, i: F.concat(F.substring(text, let(F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0), lambda a: a + 1).cast("int"), (s.start - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)).cast("int")), F.when(s.kind == "cluster", "cluster").otherwise("gene")))
    last = F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"]).otherwise(0)
    whole = F.concat(F.array_join(kept, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))
    return F.regexp_replace(whole, r"(?i)(?<![A-Za-z0-9_])(gene|cluster)(?:\s*(?:,|and|&)?\s*\1(?![A-Za-z0-9_]))+", "$1")  # words are ASCII here


def tidied(text: Column) -> Column:
    """Trimmed, without closing punctuation, single spaces, plots by the names they have here."""
    out = F.regexp_replace(F.regexp_replace(F.trim(text), r"[,.?!;:]+$", ""), r"\s+", " ")
    for pattern, name in SYNONYMS:
        out = F.regexp_replace(out, "(?i)" + pattern, name)
    return out


def _new_name_at(text: Column) -> Column:
    """How many characters of a text come before a new name; all of them where none is given."""
    front = F.regexp_extract(text, rf"(?i)^(.*?)(?:{RENAMES})\s+cluster\s+\S+.*?\s+(?:to|as)\s+", 1)
    asked = text.rlike(rf"(?i)(?:{RENAMES})\s+cluster\s+\S+.*?\s+(?:to|as)\s+")
    led = F.regexp_extract(F.substring(text, F.length(front) + 1, F.length(text)), r"(?i)^(.*?\s+(?:to|as)\s+)", 1)
    return F.when(asked, F.length(front) + F.length(led)).otherwise(F.length(text))


def _with_deletions(word: Column, edits: int = 2) -> Column:
    """word and what is left of it after up to so many deletions: words within that many edits have one of these in common."""
    out = F.array(word)
    for _ in range(edits):
        shorter = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def near_keywords(words: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """word and keyword: the first of keywords that each word (lower case, distinct) is a misspelling of.

    Both sides meet by what deletions leave of them, so no word is compared with all keywords; edit distances decide."""
    listed = words.sparkSession.createDataFrame(list(enumerate(keywords)), "rank int, keyword string").withColumn("limit", fuzzy_limit(F.col("keyword"))).where("limit > 0")
    keys = listed.select("rank", "keyword", "limit", F.explode(_with_deletions(F.col("keyword"))).alias("left"))
    longest = max(map(len, keywords)) + 2  # a longer word has more edits than any limit
    asked = words.where(F.length("word") <= longest).select("word", F.explode(_with_deletions(F.col("word"))).alias("left"))
    met = asked.join(F.broadcast(keys), "left").where(F.abs(F.length("word") - F.length("keyword")) <= F.col("limit")).select("word", "rank", "keyword", "limit").distinct()
    near = met.where(edit_distance(F.col("word"), F.col("keyword")) <= F.col("limit"))
    return near.groupBy("word").agg(F.min(F.struct("rank", "keyword")).alias("best")).select("word", "best.keyword")


def corrected(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id_col and text: tidied, misspelt words as the keyword they are near; a new name after "to" or "as" stays as it is.

    Words are looked up once each, whatever the number of texts they are in. id_col must be unique."""
    rows = texts.select(F.col(id_col), tidied(F.coalesce(F.col(text_col), F.lit(""))).alias("said")).withColumn("upto", _new_name_at(F.col("said")))
    words = F.split(F.substring(F.col("said"), F.lit(1), F.col("upto")), " ", -1)
    open_ = F.filter(F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike("^[a-zA-Z]+$")), lambda w: F.lower(w)), lambda w: ~w.isin(*NEVER_CORRECTED) & ~w.isin(*KEYWORDS))
    asked = rows.select(F.col(id_col).alias("of"), F.explode(F.array_distinct(open_)).alias("word"))
    found = asked.join(near_keywords(asked.select("word").distinct()), "word")
    found = found.groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("word", "keyword"))).alias("right"))
    rows = rows.join(found, F.col(id_col) == F.col("of"), "left")

    def spelt(w: Column) -> Column:
        right = F.when(w.rlike("^[a-zA-Z]{3,}$"), F.element_at("right", F.lower(w)))
        first = F.substring(w, 1, 1)
        return F.coalesce(F.when(first == F.upper(first), F.concat(F.upper(F.substring(right, 1, 1)), F.substring(right, F.lit(2), F.length(right)))).otherwise(right), w)

    done = F.concat(F.array_join(F.transform(words, spelt), " "), F.substring(F.col("said"), F.col("upto") + 1, F.length("said")))
    return rows.select(id_col, F.when(F.col("right").isNull(), F.col("said")).otherwise(done).alias("text"))


def _polite(verbs: str) -> str:
    return rf"(?i)(?:^|^can\s+you\s+|please\s+)(?:{verbs})"


def _numbers(section: Column) -> Column:
    """The cluster numbers of a rename's first part: the one after "cluster" and those of its list, else any numbers."""
    first = F.regexp_extract(section, r"(?i)^cluster\s+(\d+)", 1)
    rest = F.regexp_extract_all(section, F.lit(r"(?i)(?:,|and)\s+(?:cluster\s+)?(\d+)"), F.lit(1))
    listed = F.array_distinct(F.concat(F.filter(F.array(first), lambda x: x != ""), rest))
    return F.when(F.size(listed) > 0, listed).otherwise(all_matches(section, r"\d+"))


def _renames(verb: Column, numbers: Column, name: Column) -> Column:
    return F.transform(numbers, lambda n: F.concat(verb, F.lit(" cluster "), n, F.lit(" to "), name))


def _after_then(text: Column) -> Column:
    """The commands of clauses parted by "then": a clause without a verb takes the first one's, renames of several clusters become
    one each; empty unless two or more are commands. A "then" right after "to" or "as" is a new name."""
    then = r"(?i)(?<!\b(?:to|as)\s{0,20})(?:,\s*|\s+)(?:and\s+)?then\s+"
    section = rf"(?i)(?:{RENAMES})\s+(.+?)\s+(?:to|as)\s+([^,]+?)(?:\s*,\s*then|$)"
    command = rf"(?i)^(?:{VERBS})\b"

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"(?i)^(?:can\s+you\s+|please\s+)", "")

    def led(clause: Column, i: Column, verb: Column) -> Column:
        """clause with the verb that it lacks."""
        rest = bare(clause)
        again = rest.rlike(r"(?i)^cluster\s+\d+\s+(?:to|as)\s+") & verb.isin(*RENAMES.split("|")) | ~rest.rlike(command) & (F.length(rest) > 5)
        return F.when((i > 0) & (verb != "") & again, F.concat(verb, F.lit(" "), rest)).otherwise(clause)

    def told(clause: Column, first: Column) -> Column:
        verb = F.coalesce(F.nullif(F.regexp_extract(clause, rf"(?i)({RENAMES})", 1), F.lit("")), F.nullif(first, F.lit("")), F.lit("rename"))
        name = F.trim(F.regexp_extract(clause, section, 2))
        return let(_numbers(F.regexp_extract(clause, section, 1)), lambda n: F.when(clause.rlike(section) & (F.size(n) > 1) & (name != ""), _renames(verb, n, name)).otherwise(F.array(clause)))

    def fold(z: Column) -> Column:
        clauses = F.transform(z.clauses, lambda c, i: led(c, i, z.verb))
        told_ = F.flatten(F.transform(clauses, lambda c: told(c, z.verb)))
        return F.filter(told_, lambda c: (F.length(bare(F.trim(c))) > 5) & bare(F.trim(c)).rlike(rf"(?i)^(?:{VERBS}|cluster)\b"))

    clauses = F.transform(F.split(text, then, -1), lambda c: F.regexp_replace(F.trim(c), r"[\s;,]+$", ""))
    verb = F.regexp_extract(clauses[0], _polite(FIRST_VERBS).replace(f"(?:{FIRST_VERBS})", f"({FIRST_VERBS})"), 1)
    return F.when(text.rlike(then), let(F.struct(clauses.alias("clauses"), verb.alias("verb")), fold))


def _verb(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?i)(?:^|^can\s+you\s+)({RENAMES})", 1)


def _one_name(text: Column) -> Column:
    """Renames of several clusters to one name."""
    asked = text.rlike(rf"(?i)(?:^|^can\s+you\s+)(?:{RENAMES})\s+(?:cluster\s+\d+(?:\s*(?:,|and)\s+(?:cluster\s+)?\d+)+)\s+(?:to|as)\s+[^,]+$")
    numbers = F.regexp_extract_all(text, F.lit(r"(?i)(?:cluster\s+|(?:,|and)\s+(?:cluster\s+)?)(\d+)"), F.lit(1))
    return F.when(asked, _renames(_verb(text), numbers, F.trim(F.regexp_extract(text, r"(?i)(?:to|as)\s+([^,]+?)$", 1))))


def _names_by_and(text: Column) -> Column:
    """Renames of clusters to a name each, joined by "and cluster"."""
    asked = text.rlike(rf"(?i)(?:^|^can\s+you\s+)(?:{RENAMES})\s+.*?\s+(?:to|as)\s+[^,]+?(?:,\s*)?\s+and\s+cluster\s+\d+\s+(?:to|as)\s+")
    first = rf"(?i)(?:{RENAMES})\s+(.+?)\s+(?:to|as)\s+([^,]+?)$"
    other = r"(?i)cluster\s+(\d+)\s+(?:to|as)\s+([^,]+?)$"

    def told(parts: Column) -> Column:
        head = F.trim(parts[0])
        section = F.regexp_extract(head, first, 1)
        listed = F.concat(F.filter(F.array(F.regexp_extract(section, r"(?i)^cluster\s+(\d+)", 1)), lambda x: x != ""), F.regexp_extract_all(section, F.lit(r"(?i)(?:,|and)\s+(?:cluster\s+)?(\d+)"), F.lit(1)))
        rest = F.filter(F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.concat(F.lit("cluster "), F.trim(p))), lambda p: p.rlike(other))
        one = F.transform(rest, lambda p: F.concat(_verb(text), F.lit(" cluster "), F.regexp_extract(p, other, 1), F.lit(" to "), F.trim(F.regexp_extract(p, other, 2))))
        return F.concat(_renames(_verb(text), F.array_distinct(listed), F.trim(F.regexp_extract(head, first, 2))), one)

    return F.when(asked, let(F.split(text, r"(?i)(?:,\s*)?\s+and\s+cluster\s+", -1), told))


def _other_actions(text: Column) -> Column:
    """Commands of different kinds joined by "and"."""
    asked = text.rlike(rf"(?i)\b(?:rerun|run|execute|update|change|set|find|get|create|cluster|analyze)\s+[^and]+?\s+and\s+(?:{NEXT_VERBS})")
    parts = F.split(text, rf"(?i)\s+and\s+(?=(?:{NEXT_VERBS}|run|execute|update|create|cluster|analyze))", -1)
    return F.when(asked, F.filter(parts, lambda p: F.length(F.trim(p)) > 5))


def commands(text: Column) -> Column:
    """The commands of a text, an array: clauses parted by "then" or "and", verbs carried on, renames of several clusters one each;
    a plot of two genes is one command, and so is what has no parts."""
    name = r"[A-Za-z0-9-]+"
    genes = rf"(?i)(?:^|^can\s+you\s+)(?:plot|show|display)\s+(?:genes?|gene\s+expression)\s+{name}\s+and\s+{name}"
    dots = rf"(?i)(?:^|^can\s+you\s+)(?:dotplot|dot\s+plot)\s+(?:for|of)\s+{name}\s+and\s+{name}"
    pair = rf"(?i)(?:^|^can\s+you\s+)(?:plot|show|display)\s+({name})\s+and\s+({name})"
    words = ("cluster", "gene", "genes", "plot", "show", "display")

    def names_gene(k: int) -> Column:
        x = F.regexp_extract(text, pair, k)
        return (F.length(x) >= 2) & ~x.rlike(r"^\d+$") & ~F.lower(x).isin(*words)

    whole = F.array(text)
    one = text.rlike(genes) | text.rlike(dots) | text.rlike(pair) & names_gene(1) & names_gene(2)
    several = F.coalesce(*[F.when(F.size(x) > 1, x) for x in (_after_then(text), _one_name(text), _names_by_and(text), _other_actions(text))], whole)
    return F.when(text.isNotNull(), F.when(one, whole).otherwise(several))
