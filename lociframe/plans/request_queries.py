"""Queries on requests in plain text, over conversations and requests made of their rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..functions import text as tx
from ..operators import requests as rq

#: Requests made of a row: n and k are numbers, w a word of its text; and the commands they hold.
CHAINS = (
    ("Rename cluster {n} and {k} to {w} cells, then show cluster {n}", ("Rename cluster {n} to {w} cells", "Rename cluster {k} to {w} cells", "show cluster {n}")),
    ("call cluster {n}, {k} and 77 as {w}", ("call cluster {n} to {w}", "call cluster {k} to {w}", "call cluster 77 to {w}")),
    ("rename cluster {n} to {w} and cluster {k} to other cells", ("rename cluster {n} to {w}", "rename cluster {k} to other cells")),
    ("rerun qc steps and plot {w}", ("rerun qc steps", "plot {w}")),
    ("plot {w} and Nphs2", ("plot {w} and Nphs2",)),
    ("find markers of cluster {n}, then cluster {k} too", ("find markers of cluster {n}", "find cluster {k} too")),
    ("can you rename cluster {n} to {w} then cluster {k} to {w} too", ("can you rename cluster {n} to {w}", "rename cluster {k} to {w} too")),
    ("rename cluster {n}, cluster {k} and cluster 9 to {w} and then run umap", ("rename cluster {n} to {w}", "rename cluster {k} to {w}", "rename cluster 9 to {w}", "run umap")),
    ("show genes {w} and Nphs2", ("show genes {w} and Nphs2",)),
    ("{w}", ("{w}",)),
)
#: Requests for settings and what they ask: old and new name, least genes and counts, most mitochondrial reads, variable genes, min_dist, two samples.
SETTINGS = (
    ("please rename cluster {n} to \"{w}\".", "'{n}'", "'{w}'", *["NULL"] * 7),
    ("change the label of region {w} as the {w}", "'{w}'", "'{w}'", *["NULL"] * 7),
    ("cluster {n} should be named {w}", "'{n}'", "'{w}'", *["NULL"] * 7),
    ("rename cluster {n} to {w} and cluster {k} to x", *["NULL"] * 9),
    ("keep cells with min genes {n}, {k} counts and mt below 7.5", *["NULL"] * 2, "{n}", "{k}", "7.5", *["NULL"] * 4),
    ("filter at 10% mito and {k} genes", *["NULL"] * 2, "{k}", "NULL", "10", *["NULL"] * 4),
    ("use {n} highly variable genes", *["NULL"] * 5, "{n}", *["NULL"] * 3),
    ("variable features: {n}, min-dist=0.{k}", *["NULL"] * 5, "{n}", "0.{k}", *["NULL"] * 2),
    ("difference between {w} and the s7 in cluster {n}", *["NULL"] * 7, "'{w}'", "'s7'"),
    ("sample {n} vs. sample {k}", *["NULL"] * 7, "'sample {n}'", "'sample {k}'"),
)


def _turns(spark, sf):
    return m.table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))


def _made(spark, sf, forms):
    """A request of each turn by one of forms."""
    n = F.col("conv_id") % 40 + 10
    w = F.coalesce(F.nullif(F.regexp_extract("text", "([A-Za-z]{4,})", 1), F.lit("")), F.lit("Tubule"))
    pick = F.element_at(F.array(*[F.lit(f[0]) for f in forms]), ((F.col("conv_id") * 7 + F.col("turn")) % len(forms) + 1).cast("int"))
    rows = _turns(spark, sf).select("id", pick.alias("form"), n.cast("string").alias("n"), (n + 1).cast("string").alias("k"), w.alias("w"))
    text = F.col("form")
    for c in ("n", "k", "w"):
        text = F.replace(text, F.lit("{" + c + "}"), F.col(c))
    return rows.select("id", text.alias("text"))


def _names(spark, sf):
    """Genes: words of the benchmark's items but every fourth; labels: the words that items begin with."""
    items = m.table(spark, sf, "benchmark")
    genes = items.where("item_id % 4 <> 0").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("name")).distinct()
    return genes, items.select(F.regexp_extract("text", "([A-Za-z]+)", 1).alias("label"), (F.col("item_id") % 20).alias("cluster"))


def request_entities(spark, sf):
    found = rq.entities(_turns(spark, sf), *_names(spark, sf))
    told = lambda c, name: F.array_join(F.transform(c, lambda g: F.concat_ws(":", g[name].cast("string"), g.start.cast("string"), g.end.cast("string"))), ",")
    ids = F.array_join(F.transform("clusters", lambda g: F.array_join(g.ids, "+")), ",")
    return found.select("id", told(F.col("genes"), "symbol").alias("genes"), told(F.col("clusters"), "text").alias("clusters"), ids.alias("ids"), F.md5("masked").alias("masked_md5"))


def request_spelling(spark, sf):
    rows = _turns(spark, sf)
    return rq.corrected(rows).select("id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def request_chains(spark, sf):
    return _made(spark, sf, CHAINS).select("id", F.posexplode(rq.commands(F.col("text"))).alias("place", "command"))


def request_settings(spark, sf):
    t = F.col("text")
    rows = _made(spark, sf, SETTINGS).select("id", tx.rename(t).alias("r"), tx.cell_filter(t).alias("f"), tx.hvg_count(t).alias("hvg"), tx.min_dist(t).alias("min_dist"), tx.sample_pair(t).alias("p"))
    return rows.select("id", F.col("r.old").alias("old_name"), F.col("r.new").alias("new_name"), "f.min_features", "f.min_total", "f.max_mito_pct", F.col("hvg").cast("double").alias("hvg"), "min_dist", F.col("p.a").alias("sample_a"), F.col("p.b").alias("sample_b"))


def request_gate(spark, sf):
    """Why each turn asks for nothing, by the names it mentions, and whether it is on topic; also of a request made of it."""
    rows = _turns(spark, sf)
    found = rq.entities(rows, *_names(spark, sf)).select("id", F.size("genes").alias("n_genes"), F.size("clusters").alias("n_labels"))
    rows = rows.select("id", "text").join(found, "id")
    rows = rows.select("id", "n_genes", "n_labels", F.explode(F.array(F.col("text"), F.concat(F.lit("how many cells does "), F.split("text", " ")[0], F.lit(" have?")), F.concat(F.lit("What is the role of "), F.split("text", " ")[1]))).alias("text"))
    reason = tx.non_command(F.col("text"), F.col("n_genes"), F.col("n_labels"), has_genes=True)
    return rows.groupBy(F.coalesce(reason, F.lit("none")).alias("reason"), tx.on_topic(F.col("text"), F.lit(0), F.lit(0), has_genes=True).alias("on_topic")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_genes").alias("n_genes"))


def _list(words):
    return ", ".join(f"'{w}'" for w in words)


def _matches(pattern, text="t"):
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _filled(s):
    for c in ("n", "k", "w"):
        s = f"replace({s}, '{{{c}}}', {c})"
    return s


_ROWS = "turns AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, text FROM conversations)"
_PARTS = "p AS (SELECT id, conv_id * 7 + turn AS pick, CAST(conv_id % 40 + 10 AS VARCHAR) AS n, CAST(conv_id % 40 + 11 AS VARCHAR) AS k, coalesce(nullif(regexp_extract(text, '([A-Za-z]{4,})', 1), ''), 'Tubule') AS w FROM turns)"
_GENES = """genes AS (SELECT upper(w) AS key, min(w) AS symbol FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark WHERE item_id % 4 <> 0) GROUP BY 1),
    labels AS (SELECT lower(w) AS key, string_agg(c, '+' ORDER BY CAST(c AS BIGINT)) AS ids FROM (SELECT regexp_extract(text, '([A-Za-z]+)', 1) AS w, CAST(item_id % 20 AS VARCHAR) AS c FROM benchmark) GROUP BY 1)"""
_ENTITIES = rf"""{_ROWS}, {_GENES},
    cut AS (SELECT id, text, regexp_extract_all(text, '{rq.TOKEN}') AS ms, string_split_regex(text, '{rq.TOKEN}') AS ps, length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.8 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS shouting FROM turns),
    tok AS (SELECT id, text, shouting, m, CAST(sum(length(piece) + CASE WHEN i > 1 THEN length(ms[i - 1]) ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS s
        FROM (SELECT id, text, shouting, ms, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS piece, unnest(range(1, len(ms) + 1)) AS i FROM cut)),
    known AS (SELECT t.*, symbol, ids, text[greatest(s - {rq.CUE_LENGTH}, 0) + 1 : s] AS before FROM tok t LEFT JOIN genes g ON g.key = upper(m) LEFT JOIN labels l ON l.key = lower(m)),
    told AS (SELECT id, text, s, s + length(m) AS e, m, symbol, ids, CASE WHEN {_matches(rq.PEAK, 'm')} THEN 'peak' WHEN ids IS NOT NULL AND NOT (symbol IS NOT NULL AND {_matches(rq.GENE_CUE, 'before')}) THEN 'cluster'
        WHEN symbol IS NULL OR regexp_matches(m, '^\d+(?:\.\d+)?$') THEN NULL WHEN regexp_matches(before, '(?i)\bgenes?\s*$') THEN 'gene' WHEN length(m) = 1 OR lower(m) IN ({_list(rq.TECHNICAL_GENES)}) THEN NULL
        WHEN lower(m) IN ({_list(rq.ENGLISH_GENES)}) AND NOT (m = upper(m) AND NOT shouting) THEN NULL ELSE 'gene' END AS kind FROM known),
    spans AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS prev FROM told WHERE kind IS NOT NULL),
    found AS (SELECT id, string_agg(CASE WHEN kind = 'gene' THEN symbol ELSE m END || ':' || s || ':' || e, ',' ORDER BY s) FILTER (kind <> 'cluster') AS genes, string_agg(m || ':' || s || ':' || e, ',' ORDER BY s) FILTER (kind = 'cluster') AS clusters,
        string_agg(ids, ',' ORDER BY s) FILTER (kind = 'cluster') AS ids, string_agg(text[prev + 1 : s] || CASE WHEN kind = 'cluster' THEN 'cluster' ELSE 'gene' END, '' ORDER BY s) AS front, max(e) AS last,
        count(*) FILTER (kind <> 'cluster') AS n_genes, count(*) FILTER (kind = 'cluster') AS n_labels FROM spans GROUP BY id)"""
_T = r"regexp_replace(regexp_replace(lower(trim(text)), '[.!?,;:]+$', ''), '\s+', ' ', 'g')"


def _gate_sql():
    gene, label, named, embedded = "n_genes > 0", "n_labels > 0", _matches(tx.DATA_OBJECT), _matches(tx.EMBEDDED_REQUEST)
    unsupported = " ".join(f"WHEN {_matches(p)} THEN 'unsupported:{topic}'" for p, topic in tx.UNSUPPORTED)
    return rf"""CASE WHEN t = '' THEN 'empty' {unsupported}
        WHEN ({gene} AND {_matches(tx.GENE_KNOWLEDGE)} AND NOT {_matches(tx.LOOKS_AT_DATA)}) OR ({gene} AND {_matches(tx.GENERAL_TRUTH)} AND NOT {_matches(tx.OWN_DATA)}) THEN 'gene knowledge'
        WHEN {_matches(tx.SOCIAL)} AND len(string_split(t, ' ')) <= 6 AND NOT {embedded} THEN 'small talk' WHEN {_matches(tx.GENERAL_CHAT)} THEN 'general chat'
        WHEN NOT {_matches(tx.QUESTION_START)} OR {embedded} OR ({_matches(tx.SETTINGS_QUESTION)} AND {_matches(tx.GATE_SETTINGS)}) THEN 'none' WHEN regexp_matches(t, '^(?:why|should)\b') THEN 'question'
        WHEN regexp_matches(t, '^how\s+many\s+(?:cells|genes|clusters|samples)\b') AND NOT (regexp_matches(t, '^how\s+many\s+cells\b') AND ({named} OR {label})) THEN 'question'
        WHEN regexp_matches(t, '^(?:how|where)\s+(?:do|can|should)\s+i\b') THEN 'how-to question' WHEN {named} OR {label} OR ({gene} AND {_matches(tx.EXPRESSION_WORDS)}) THEN 'none' ELSE 'question' END"""


_KEYWORDS = ", ".join(f"({i}, '{w}', {0 if len(w) < 4 else 1 if len(w) <= 5 else 2})" for i, w in enumerate(rq.KEYWORDS))
_TIDY = r"regexp_replace(regexp_replace(trim(text), '[,.?!;:]+$', ''), '\s+', ' ', 'g')"
for _p, _s in rq.SYNONYMS:
    _TIDY = f"regexp_replace({_TIDY}, '(?i){_p}', '{_s}', 'g')"
_ASKED = rf"(?i)(?:{rq.RENAMES})\s+cluster\s+\S+.*?\s+(?:to|as)\s+"
_SETTING_COLUMNS = ("old_name", "new_name", "min_features", "min_total", "max_mito_pct", "hvg", "min_dist", "sample_a", "sample_b")


def _setting_sql(i):
    cases = []
    for k, form in enumerate(SETTINGS):
        value = form[1 + i]
        value = "NULL" if value == "NULL" else _filled(value if value.startswith("'") else f"'{value}'")
        cases.append(f"WHEN {k} THEN " + (value if i in (0, 1, 7, 8) or value == "NULL" else f"CAST({value} AS DOUBLE)"))
    kind = "VARCHAR" if i in (0, 1, 7, 8) else "DOUBLE"
    not_a_name = "lower(w) IN ('then', 'this', 'that') AND" if i < 2 else "false AND"  # such a word is no new name
    return f"CAST(CASE WHEN {not_a_name} pick IS NOT NULL THEN NULL ELSE CASE pick % {len(SETTINGS)} {' '.join(cases)} END END AS {kind}) AS {_SETTING_COLUMNS[i]}"


QUERIES = {
    "request_entities": (request_entities, rf"""WITH {_ENTITIES}, mk AS (SELECT t.id, genes, clusters, ids, coalesce(front, '') || t.text[coalesce(last, 0) + 1 :] AS masked FROM turns t LEFT JOIN found USING (id))
        SELECT id, coalesce(genes, '') AS genes, coalesce(clusters, '') AS clusters, coalesce(ids, '') AS ids,
        md5(regexp_replace(regexp_replace(masked, '(?i)\b(gene)(?:\s*(?:,|and|&)?\s*gene\b)+', '\1', 'g'), '(?i)\b(cluster)(?:\s*(?:,|and|&)?\s*cluster\b)+', '\1', 'g')) AS masked_md5 FROM mk"""),
    "request_spelling": (request_spelling, rf"""WITH {_ROWS}, kw AS (SELECT * FROM (VALUES {_KEYWORDS}) AS v(nth, kw, most)), tidy AS (SELECT id, {_TIDY} AS t FROM turns),
        cut AS (SELECT id, t, CASE WHEN regexp_matches(t, '{_ASKED}') THEN length(regexp_extract(t, '(?i)^(.*?)(?:{rq.RENAMES})\s+cluster\s+\S+.*?\s+(?:to|as)\s+', 1)) ELSE -1 END AS pos FROM tidy),
        cut2 AS (SELECT id, t, CASE WHEN pos < 0 THEN length(t) ELSE pos + length(regexp_extract(t[pos + 1 :], '(?i)^(.*?\s+(?:to|as)\s+)', 1)) END AS upto FROM cut),
        w AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT id, string_split(t[1 : upto], ' ') AS ws FROM cut2)),
        fix AS (SELECT w, arg_min(kw, nth) AS fixed FROM (SELECT DISTINCT lower(w) AS w FROM w WHERE regexp_matches(w, '^[a-zA-Z]{{3,}}$')) x JOIN kw ON most > 0 AND abs(length(w) - length(kw)) <= most AND damerau_levenshtein(w, kw) <= most
            WHERE w NOT IN ({_list(rq.NEVER_CORRECTED)}) AND w NOT IN ({_list(rq.KEYWORDS)}) GROUP BY w),
        done AS (SELECT w.id, string_agg(CASE WHEN fixed IS NULL THEN w.w WHEN w.w[1] = upper(w.w[1]) THEN upper(fixed[1]) || fixed[2:] ELSE fixed END, ' ' ORDER BY i) AS front FROM w LEFT JOIN fix ON fix.w = lower(w.w) AND regexp_matches(w.w, '^[a-zA-Z]{{3,}}$') GROUP BY 1)
        SELECT id, md5(front || t[upto + 1 :]) AS text_md5, CAST(length(front || t[upto + 1 :]) AS INTEGER) AS n_chars FROM cut2 JOIN done USING (id)"""),
    "request_chains": (request_chains, f"WITH {_ROWS}, {_PARTS}, a AS (SELECT id, CASE pick % {len(CHAINS)} " + " ".join(f"WHEN {i} THEN [{', '.join(_filled(chr(39) + c + chr(39)) for c in chain)}]" for i, (_, chain) in enumerate(CHAINS)) + " END AS a FROM p) SELECT id, CAST(unnest(range(0, len(a))) AS INTEGER) AS place, unnest(a) AS command FROM a"),
    "request_settings": (request_settings, f"WITH {_ROWS}, {_PARTS} SELECT id, {', '.join(_setting_sql(i) for i in range(9))} FROM p"),
    "request_gate": (request_gate, rf"""WITH {_ENTITIES}, x AS (SELECT id, coalesce(n_genes, 0) AS n_genes, coalesce(n_labels, 0) AS n_labels, unnest([t.text, 'how many cells does ' || string_split(t.text, ' ')[1] || ' have?', 'What is the role of ' || string_split(t.text, ' ')[2]]) AS text FROM turns t LEFT JOIN found USING (id)),
        y AS (SELECT *, {_T} AS t FROM x) SELECT coalesce({_gate_sql()}, 'empty') AS reason, coalesce(regexp_matches(text, '(?i)\b(?:cluster|region|sample)\s*#?\s*\d+\b') OR regexp_matches(text, '(?i)\b(?:{'|'.join(tx.VOCABULARY)})\b'), false) AS on_topic, count(*) AS n, CAST(sum(n_genes) AS BIGINT) AS n_genes FROM y GROUP BY 1, 2"""),
}
