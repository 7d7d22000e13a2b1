"""Column functions behind the text command surface."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from .places import let, placed, running

#: Stop words of pathway term tokens (fixed values).
TERM_STOP_WORDS = ("and", "the", "for", "from", "with", "pathway", "process", "regulation")
#: Patterns by which an input's kind is told, and how sure that is (fixed values, in order; the first kind that matches wins).
INPUT_KINDS = (
    ("navigation", 0.95, (
        r"^(help|what can you do|commands|menu|options)$",
        r"^(show|list)\s+(?:me\s+)?(?:the\s+)?(?:available\s+)?(?:commands?|options?|features?|capabilities?)",
        r"^(\?|h\?|help\?)$",
    )),
    ("question", 0.85, (
        r"^(what|how|why|when|where)\s+(?:is|are|does|do|can|will|would)(?!\s+about\s+cluster)",
        r"^(can\s+you\s+)?(?:tell|explain|describe)\s+(?:me\s+)?(?:about|what|how)(?!\s+cluster)",
        r"^(?:what|which)\s+(?:is|are)\s+(?:the\s+)?(?:meaning|definition|purpose|role|function)",
        r"^(?:do\s+you\s+)?know\s+(?:about|what|how)(?!\s+cluster)",
        r"^(?:is|are)\s+(?:there|this|that)\s+(?:a|any)",
        r"^(?:what|how)\s+(?:does|do)\s+(?:this|that|it|the)",
        r"^(?:what|how)\s+(?:can|should)\s+(?:i|we)",
        r"^(?:what|which)\s+(?:does|do)\s+(?:this|that|it)\s+(?:mean|indicate|show)",
        r"^what\s+about\s+(?!cluster)",
    )),
    ("command", 0.6, (
        r"^(plot|show|display|visualize|create|run|execute|find|get|set|change|update|rename)",
        r"^(?:please\s+)?(?:can\s+you\s+)?(?:plot|show|display|run|find|get)",
        r"^(?:i\s+)?(?:want|would like|need)\s+(?:to\s+)?(?:plot|show|see|run|find|get)",
        r"^what\s+about\s+cluster",
        r"^do\s+you\s+know\s+(?:anything\s+)?about\s+cluster",
    )),
)
#: Words of requests to highlight clusters, and of what makes them something else (fixed values).
CLEAR_HIGHLIGHT = (
    r"\bun-?highlight\w*|\bde-?select\w*|\bstop\s+highlighting\b",
    r"\b(?:clear|remove|reset|undo|turn\s+off)\s+(?:the\s+|my\s+|this\s+)?(?:cluster\s+)?(?:highlight\w*|selection)\b",
    r"\b(?:show|display|bring\s+back)\s+(?:all|every)\s+(?:the\s+|of\s+the\s+)?clusters?\b",
    r"\bevery\s+cluster\s+(?:is\s+)?visible\b",
)
HIGHLIGHT = (
    r"^(?:please\s+)?(?:(?:can|could|would)\s+you\s+)?(?:just\s+|only\s+)?(?:highlight|isolate|spotlight|select|focus\s+on)\b",
    r"\b(?:show|display|plot|keep)\s+(?:me\s+)?only\b",
    r"\bonly\s+(?:show|display)\b",
    r"^(?:please\s+)?(?:can\s+you\s+)?just\s+(?:show|display)\b",
)
NOT_HIGHLIGHT = r"\b(?:markers?|genes?|degs?|differential\w*|violin|dot\s*plots?|dotplot|express\w*|rename|call|label)\b"
#: Words of questions for a cluster's size or type, and of what makes them something else (fixed values).
CLUSTER_SUMMARY = r"\b(?:size|how\s+(?:big|large|small)|how\s+many\s+cells|number\s+of\s+cells|cell\s+counts?|summar(?:y|i[sz]e)|overview|what\s+(?:cell\s+)?(?:type|kind\s+of\s+cells?)|which\s+cell\s+type)\b"
NOT_SUMMARY = r"\b(?:markers?|genes?|degs?|differential\w*|rename|call|label|between|vs\.?|versus|disease|control|regions?|resolution|recluster\w*|umap|highlight\w*|motifs?|peaks?)\b"
#: Words of comparisons of one cluster with all others (fixed values).
DIFFERENTIAL = r"\b(?:de|degs?|differential\w*|markers?|genes?)\b"
THE_REST = r"\b(?:vs\.?|versus|against|compared\s+(?:to|with))\s+(?:all\s+)?(?:the\s+)?(?:rest|everything(?:\s+else)?|all(?:\s+(?:other|the\s+other))?(?:\s+(?:cells|clusters))?|other\s+(?:cells|clusters)|others)\b"
#: Words of questions for the settings in use, and of requests to change them (fixed values).
ASKS_SETTINGS = r"\b(?:settings?|parameters?|params)\b|\b(?:you\s+(?:use|used|using)|are\s+you\s+using|being\s+used|(?:was|were)\s+(?:used|applied)|currently\s+(?:used|using|set))\b"
SETTING_WORDS = r"\b(?:settings?|parameters?|params|thresholds?|resolution|variable\s+genes|hvgs?|pcs?|principal\s+components?|neighbou?rs|min[\s_]?dist|cutoffs?)\b"
CHANGES_SETTINGS = r"\d|\b(?:set|change|update|increase|decrease|lower|raise|rerun|recompute|redo)\b"
#: Steps whose parameters a text may mean, by their words (fixed values, in order).
STEP_WORDS = (
    ("featureSelection", r"\b(?:variable\s+genes?|hvgs?|feature\s+selection|features)\b"),
    ("geneFiltering", r"\bgene\s+filter"),
    ("cellFiltering", r"\b(?:filter(?:ing)?|thresholds?|qc|quality|min(?:imum)?\s+genes|mito)\b"),
    ("pca", r"\b(?:pca|pcs?|principal\s+components?)\b"),
    ("umap", r"\b(?:umap|embedding|min[\s_]*dist|neighbou?rs)\b"),
    ("clustering", r"\b(?:cluster(?:ing|s)?|resolution)\b"),
)


def clean(text: Column) -> Column:
    """Trimmed, without closing punctuation, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[\s.,!?;:]+$", ""), r"\s+", " ")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def input_type(text: Column) -> Column:
    """navigation, question, command or unknown."""
    low, out = F.lower(F.trim(text)), F.lit("unknown")
    for kind, _, patterns in reversed(INPUT_KINDS):
        out = F.when(_any(low, patterns), kind).otherwise(out)
    return out


def input_confidence(text: Column) -> Column:
    """How sure the kind of an input is; .3 for unknown ones."""
    kind = input_type(text)
    return F.coalesce(*[F.when(kind == name, F.lit(sure)) for name, sure, _ in INPUT_KINDS], F.lit(0.3))


def highlight_direction(text: Column) -> Column:
    """rna_on_atac or atac_on_rna: whose clusters are to be shown on the other's cells; null if a text doesn't say."""
    low = F.lower(clean(text))
    source, onto = F.regexp_extract(low, r"\b(rna|atac)\s+cluster\b", 1), F.regexp_extract(low, r"\b(?:on|onto|in)\s+(?:the\s+)?(rna|atac)\b", 1)
    return F.when((source == "rna") | (source == "") & (onto == "atac"), "rna_on_atac").when((source == "atac") | (source == "") & (onto == "rna"), "atac_on_rna")


def highlight_request(text: Column) -> Column:
    """clear, highlight or null; texts on the chromatin modality are another command's."""
    low = F.lower(clean(text))
    clear = F.when(~low.rlike(r"\brna\b"), "clear")
    wanted = F.when(~low.rlike(NOT_HIGHLIGHT) & _any(low, HIGHLIGHT), "highlight")
    return F.when(low.rlike(r"\batac\b"), F.lit(None).cast("string")).when(_any(low, CLEAR_HIGHLIGHT), clear).otherwise(wanted)


def asks_cluster_summary(text: Column) -> Column:
    low = F.lower(clean(text))
    return low.rlike(CLUSTER_SUMMARY) & ~low.rlike(NOT_SUMMARY)


def compares_with_rest(text: Column) -> Column:
    low = F.lower(clean(text))
    return low.rlike(DIFFERENTIAL) & low.rlike(THE_REST)


def asks_settings(text: Column) -> Column:
    low = F.lower(clean(text))
    return ~low.rlike(CHANGES_SETTINGS) & low.rlike(ASKS_SETTINGS) & low.rlike(SETTING_WORDS)


def parameter_group(text: Column) -> Column:
    """The step whose parameters a text means, by its words; null if none."""
    low, out = F.lower(clean(text)), F.lit(None).cast("string")
    for step, pattern in reversed(STEP_WORDS):
        out = F.when(low.rlike(pattern), step).otherwise(out)
    return out


#: Texts that ask for nothing the engine does, and why, in order (fixed values).
SOCIAL = r"^(?:hi|hello|hey|yo|hiya|thanks?|thank\s+you|thx|ty|ok(?:ay)?|cool|great|nice|awesome|perfect|good\s+(?:morning|afternoon|evening|night)|bye|goodbye|see\s+you|sorry|help|i\s*(?:am|'m)\s+(?:confused|lost|stuck))\b"
GENERAL_CHAT = r"\b(?:joke|weather|poem|story|email|e-mail|what\s+time\s+is\s+it|who\s+(?:made|built|created|wrote)|your\s+name)\b"
UNSUPPORTED = (
    (r"\b(?:trajector(?:y|ies)|pseudo-?time|lineage|monocle|slingshot|paga|palantir|cellrank)\b", "run trajectory or pseudotime analysis"),
    (r"\b(?:rna\s+velocity|velocity|scvelo|velocyto)\b", "estimate RNA velocity"),
    (r"\b(?:go\s+(?:enrichment|terms?|analysis)|gene\s+ontology|kegg|reactome|gsea|pathway\s+(?:enrichment|analysis))\b", "run GO or pathway enrichment"),
    (r"\b(?:export|download)\b|\bsave\b.*\b(?:as|to)\b|\b(?:csv|pdf|png|svg|tiff?|xlsx|excel|h5ad|rds|loom)\b", "export or save files"),
    (r"\b(?:doublets?|scrublet|doubletfinder)\b", "detect doublets"),
    (r"\bcell[\s-]*cycle\b|\bs[\s-]*phase\b|\bg2m?\b", "score the cell cycle"),
    (r"\b(?:infercnv|copy[\s-]*number|cnvs?)\b", "infer copy-number changes (CNV)"),
    (r"\b(?:deconvol\w*|cell2location|rctd|spotlight|cibersort)\b", "deconvolute spots"),
    (r"\b(?:harmony|scvi|bbknn|combat|scanorama|batch[\s-]*(?:correct\w*|effects?|integration|removal))\b|\bintegrat\w*\s+(?:the\s+|all\s+|across\s+(?:the\s+)?)?samples\b", "batch-correct or integrate samples from chat (WNN joins RNA and ATAC, not samples)"),
    (r"\b(?:azimuth|singler|celltypist|scanvi|label\s+transfer|cell\s+atlas|reference\s+(?:atlas|mapping|annotation)|predict\s+(?:the\s+)?cell\s+types?)\b", "annotate cells automatically with a reference atlas"),
)
#: Words by which questions on genes at large, on settings and on the data are told from requests (fixed values).
GENE_KNOWLEDGE = r"\b(?:role|roles|function|functions|involved|disease|diseases|disorders?|mutations?|variants?|associated|literature|papers?|publications?|known\s+for|biology|regulates?|what\s+does\s+\S+\s+do)\b"
GENERAL_TRUTH = r"\b(?:normally|usually|typically|generally|in\s+general|commonly|known\s+to\s+be)\b"
OWN_DATA = r"\b(?:plot|show|display|visuali[sz]e|violin|dot\s*plot|dotplot|umap|my|this|our|here|cluster\s*\d+)\b"
LOOKS_AT_DATA = r"\b(?:express\w*|levels?|plot|show|display|visuali[sz]e|violin|dot\s*plot|dotplot|umap|where|distribut\w*|markers?)\b"
QUESTION_START = r"^(?:what|what's|whats|how|why|who|where|which|is|are|does|do\s+(?:you|i|we|they|these|those|the|this|cells|genes)|should|could\s+you\s+explain|can\s+you\s+explain|explain|define|tell\s+me\s+what)\b"
EMBEDDED_REQUEST = r"(?:^|[?.!,;]\s*|\b(?:and|then|please)\s+)(?:please\s+)?(?:show|plot|run|find|give|list|make|draw|display|rename|compute|calculate|recluster|rerun|redo|highlight|impute|segment|annotate|compare)\b"
DATA_OBJECT = r"\b(?:cluster|clusters|region|regions|sample|samples)\s*#?\s*\d+\b|\b(?:selected|selection|selections|my\s+(?:area|areas|region|regions|roi)|between\s+the\s+samples|across\s+(?:the\s+)?samples|per\s+sample)\b"
EXPRESSION_WORDS = r"\b(?:express(?:ed|es|ion|ing)?|levels?|distribut(?:ed|ion)|linked|links?|peaks?)\b"
SETTINGS_QUESTION = r"\b(?:you\s+(?:use|used|using)|are\s+you\s+using|being\s+used|(?:was|were)\s+(?:used|applied)|applied|current(?:ly)?|right\s+now|at\s+the\s+moment)\b"
GATE_SETTINGS = r"\b(?:settings?|parameters?|thresholds?|resolution|variable\s+genes|hvgs?|pcs?|principal\s+components?|neighbou?rs|min[\s_]?dist|filter(?:ing)?|cutoffs?)\b"
GENE_SHAPED = r"\b[A-Za-z]{2,}\d+[A-Za-z0-9]*\b"
#: Words of the engine's own field (fixed values).
VOCABULARY = (
    "umap", "tsne", "embedding", r"dimension\w*", "reduction", "clusters?", "clustering", r"recluster\w*", "cells?", "genes?",
    "markers?", "degs?", r"differential\w*", "upregulated", "enriched", r"express\w*", "violins?", r"dot\s*plots?", "dotplots?",
    "bubble", r"plot\w*", r"visuali[sz]\w*", r"feature\s+plot", "qc", "quality", r"mito\w*", "mt", "umis?", "counts?", r"filter\w*", "thresholds?",
    "cutoffs?", "resolution", "leiden", "louvain", "pca", "pcs?", "principal", "components?", "hvgs?", "variable", "features?",
    "neighbou?rs?", r"min[\s_-]*dist\w*", "spread", "parameters?", "settings?", "rename", "relabel", "labels?", r"annotat\w*",
    "banksy", "regions?", "domains?", "niches?", "tissue", r"spatial\w*", r"segment\w*", "composition", "fractions?",
    "proportions?", "samples?", "control", "disease", "atac", "rna", "wnn", "multiome", r"modalit\w*", r"integrat\w*",
    "peaks?", "links?", "linked", "linkpeaks", "motifs?", "tfs?", "transcription", r"imput\w*", "spage", "cellchat",
    r"ligand\w*", "receptors?", "interactions?", r"communicat\w*", "crosstalk", r"highlight\w*", r"un-?highlight\w*", r"de-?select\w*", "selection", "selected",
    "selections", "roi", "colou?rs?", "colormap", "viridis", "magma", "plasma", "inferno", "dataset", "data",
)


def non_command(text: Column, n_genes: Column | int = 0, n_labels: Column | int = 0, has_genes: bool = False) -> Column:
    """Why a text asks for nothing that can be done, by ordered rules; null if it may ask for something.

    n_genes and n_labels are the numbers of names that entities() found in it; without a list of genes (has_genes) words of a
    gene's shape count as genes."""
    tidy = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[.!?,;:]+$", ""), r"\s+", " ")
    return let(tidy, lambda t: _why_not(t, n_genes, n_labels, has_genes))


def _why_not(t: Column, n_genes: Column | int, n_labels: Column | int, has_genes: bool) -> Column:
    """non_command() of a tidied text, which some forty patterns look at."""
    gene = (F.lit(0) + n_genes > 0) | (F.lit(not has_genes) & t.rlike(GENE_SHAPED))
    label, embedded, named = F.lit(0) + n_labels > 0, t.rlike(EMBEDDED_REQUEST), t.rlike(DATA_OBJECT)
    out = F.when(t == "", "empty")
    for pattern, topic in UNSUPPORTED:
        out = out.when(t.rlike(pattern), "unsupported:" + topic)
    out = out.when(gene & t.rlike(GENE_KNOWLEDGE) & ~t.rlike(LOOKS_AT_DATA) | gene & t.rlike(GENERAL_TRUTH) & ~t.rlike(OWN_DATA), "gene knowledge")
    out = out.when(t.rlike(SOCIAL) & (F.size(F.split(t, " ")) <= 6) & ~embedded, "small talk").when(t.rlike(GENERAL_CHAT), "general chat")
    out = out.when(~t.rlike(QUESTION_START) | embedded | t.rlike(SETTINGS_QUESTION) & t.rlike(GATE_SETTINGS), F.lit(None).cast("string"))
    out = out.when(t.rlike(r"^(?:why|should)\b"), "question")
    out = out.when(t.rlike(r"^how\s+many\s+(?:cells|genes|clusters|samples)\b") & ~(t.rlike(r"^how\s+many\s+cells\b") & (named | label)), "question")
    out = out.when(t.rlike(r"^(?:how|where)\s+(?:do|can|should)\s+i\b"), "how-to question")
    return out.when(named | label | gene & t.rlike(EXPRESSION_WORDS), F.lit(None).cast("string")).otherwise("question")


def on_topic(text: Column, n_genes: Column | int = 0, n_labels: Column | int = 0, has_genes: bool = False) -> Column:
    """Whether a text is about the data at all: it names a gene, a label or a numbered cluster, or uses a word of the field."""
    t = F.coalesce(text, F.lit(""))
    named = (F.lit(0) + n_genes > 0) | (F.lit(0) + n_labels > 0) | (F.lit(not has_genes) & t.rlike(GENE_SHAPED))
    return named | t.rlike(r"(?i)\b(?:cluster|region|sample)\s*#?\s*\d+\b") | t.rlike(r"(?i)\b(?:" + "|".join(VOCABULARY) + r")\b")


def plain(text: Column) -> Column:
    """Trimmed, without closing punctuation (commas stay), single spaces."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[.!?;]+$", ""), r"\s+", " ")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of pattern's first match holds; null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


_NUMBER = r"(\d+(?:\.\d+)?)"


def cell_filter(text: Column) -> Column:
    """Struct of min_features, min_total and max_mito_pct named in a text, null where not named. Numbers of variable genes are
    no filter."""
    return let(F.lower(plain(text)), _cell_filter)


def _cell_filter(t: Column) -> Column:
    mito = F.coalesce(
        _found(t, _NUMBER + r"\s*(?:%|percent)?\s*(?:of\s+)?(?:mito(?:chondrial)?|mt)\b"),
        _found(t, r"\b(?:mito(?:chondrial)?|mt)(?:\s*(?:percent(?:age)?|fraction|reads|counts|threshold|cutoff))?\s*(?:<=|<|>|=|to|of|at|above|below|over|under|less\s+than|more\s+than)?\s*" + _NUMBER),
    )
    genes = []
    for pattern in (
        r"\bmin(?:imum)?\s*(?:detected\s+)?genes?(?:\s+per\s+cell)?\s*(?:=|>=|>|to|of|at)?\s*" + _NUMBER,
        r"\bgenes?\s*(?:detected|per\s+cell)?\s*(?:cutoff|threshold|filter|minimum)\s*(?:=|to|of|at)?\s*" + _NUMBER,
        r"\b(?:cutoff|threshold|filter)\s+(?:of|to|at)\s+(?:at\s+least\s+)?" + _NUMBER + r"\s*(?:detected\s+)?(?:genes?|per\s+cell)",
        _NUMBER + r"\s*\+?\s*(?:or\s+more\s+)?(?:detected\s+)?genes?\b",
    ):
        around = F.regexp_extract(t, r"(.{0,12}" + pattern.replace(_NUMBER, _NUMBER.replace("(\\d+", "(?:\\d+", 1)) + ")", 1)
        genes.append(F.when(~around.rlike("variable|hvg"), _found(t, pattern)))
    total = F.coalesce(_found(t, _NUMBER + r"\s*(?:umis?|counts|reads)\b"), _found(t, r"\b(?:min(?:imum)?\s*)?(?:umis?|counts)\s*(?:=|>=|>|to|of|at)?\s*" + _NUMBER))
    total = F.when(~total.eqNullSafe(mito), total)
    return F.struct(F.coalesce(*genes).try_cast("double").alias("min_features"), total.try_cast("double").alias("min_total"), mito.try_cast("double").alias("max_mito_pct"))


def hvg_count(text: Column) -> Column:
    t = F.lower(plain(text))
    before = _found(t, r"(\d+)\s*(?:highly\s+)?(?:variable|hvgs?)(?:\s+(?:genes?|features?))?")
    return F.coalesce(before, _found(t, r"\b(?:(?:highly\s+)?variable\s+(?:genes?|features?)|hvgs?|features?)\s*(?:=|to|of|,|:)?\s*(?:like\s+)?(\d+)")).try_cast("int")


def min_dist(text: Column) -> Column:
    t = plain(text)
    after = _found(t, r"(?i)\bmin(?:imum)?[\s_-]*dist(?:ance)?\s*(?:=|to|of|:)?\s*(\d*\.?\d+)")
    return F.coalesce(after, _found(t, r"(?i)(\d*\.?\d+)\s*min(?:imum)?[\s_-]*dist")).try_cast("double")


def _unquoted(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "^[\"'\u201c\u201d\u2018\u2019]+|[\"'\u201c\u201d\u2018\u2019]+$", ""))


def rename(text: Column, known: Column | None = None) -> Column:
    """Struct (kind, old, new) of a request to rename a cluster or region; null without one, or where several are chained.

    known, an array of labels, allows "rename X to Y" where X is one of them."""
    t = F.regexp_replace(plain(text), r"(?i)^(?:please|pls|can you|could you|would you|let'?s|lets|i want to|i'd like to)\s+", "")
    t = F.regexp_replace(t, r"(?i)\s*,?\s*(?:please\s+|can you\s+|could you\s+)?rename\s+it\b.*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\s+please$", ""), r"(?i)^(?:i\s+think|i\s+believe|looks\s+like)\s+", "")

    return let(t, lambda x: _renamed(x, known))


def _renamed(t: Column, known: Column | None) -> Column:
    def made(kind: Column, old: Column, new: Column) -> Column:
        return let(F.when(kind == "region", F.regexp_replace(_unquoted(plain(new)), r"(?i)^the\s+", "")).otherwise(_unquoted(plain(new))), lambda x: told(kind, old, x))

    def told(kind: Column, old: Column, new: Column) -> Column:
        chain = new.rlike(r"(?i)\bthen\b") | new.rlike(r"(?i)(?:\band\b|,)\s*(?:rename\s+|relabel\s+|call\s+|label\s+|change\s+)?(?:cluster|region)\s+\S+\s+(?:to|as)\b")
        return F.when((new != "") & ~new.rlike("(?i)^(?:it|this|that)$") & ~chain, F.struct(kind.alias("kind"), old.alias("old"), new.alias("new")))

    out = None
    for pattern in (
        r"(?i)^(?:rename|relabel|call|name|label|mark)\s+(cluster|region)\s+(\S+)\s+(?:(?:to|as|=)\s+)?(.+)$",
        r"(?i)^(?:change|set|update)\s+(?:the\s+)?(?:name|label)\s+(?:of|for)\s+(cluster|region)\s+(\S+)\s+(?:to|as|=)\s+(.+)$",
        r"(?i)^(?:change|set|update)\s+(cluster|region)\s+(\S+)(?:'s)?\s+(?:name|label)\s+(?:to|as|=)\s+(.+)$",
        r"(?i)^(cluster|region)\s+(\d+)\s+(?:is|=|should\s+be(?:\s+(?:named|called|labell?ed))?|will\s+be(?:\s+(?:named|called))?)\s+(.+)$",
        r"(?i)^(?:rename|relabel)\s+()(\d+)\s+(?:to|as)\s+(.+)$",
    ):
        kind = F.lower(F.regexp_extract(t, pattern, 1))
        one = made(F.when(kind == "", "cluster").otherwise(kind), F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 3))
        out = F.when(t.rlike(pattern), one) if out is None else out.when(t.rlike(pattern), one)
    if known is None:
        return out
    pattern = r"(?i)^(?:rename|relabel)\s+(.+?)\s+(?:to|as)\s+(.+)$"
    old = F.regexp_replace(_unquoted(F.regexp_extract(t, pattern, 1)), r"(?i)^(?:the\s+)?cluster\s+", "")
    listed = F.array_contains(F.transform(known, F.lower), F.lower(old))
    return out.when(t.rlike(pattern) & listed, made(F.lit("cluster"), old, F.regexp_extract(t, pattern, 2)))


def sample_pair(text: Column, samples: tuple[str, ...] = ()) -> Column:
    """Struct (a, b) of two samples that a text compares: the first two of samples by where they stand, else by its words."""
    t = plain(text)
    out = None
    if len(samples) >= 2:
        at = F.array_sort(F.filter(F.array(*[F.struct(F.locate(s.lower(), F.lower(t)).alias("at"), F.lit(s).alias("name")) for s in samples]), lambda x: x["at"] > 0))
        out = F.when(F.size(at) >= 2, F.struct(at[0]["name"].alias("a"), at[1]["name"].alias("b")))
    for pattern in (
        r"(?i)\bbetween\s+(.+?)\s+and\s+(.+?)(?:\s+(?:in|for|within)\s+cluster\b.*)?$",
        r"(?i)\b(sample\s*\d+|\S+)\s+(?:vs\.?|versus)\s+(sample\s*\d+|\S+)",
        r"(?i)\bcompare\s+(\S+)\s+(?:and|with|to)\s+(\S+)\s+(?:in|for|within)\s+cluster\b",
    ):
        one = F.struct(*[F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(t, pattern, k), "(?i)^(?:the\\s+)?", ""), r"(?i)\s+(?:in|for)\s+cluster.*$", "")).alias(name) for k, name in ((1, "a"), (2, "b"))])
        out = F.when(t.rlike(pattern), one) if out is None else out.when(t.rlike(pattern), one)
    return out


def choice(text: Column, n: int) -> Column:
    """0-based option of a number, an ordinal or a number word; null if it is out of range."""
    low = F.lower(F.trim(text))
    picked = F.regexp_extract(low, r"\b(\d+)\b", 1).try_cast("int")
    for names in (("first", "second", "third", "fourth", "fifth"), ("one", "two", "three", "four", "five")):
        for k, name in enumerate(names):
            picked = F.coalesce(picked, F.when(low.rlike(rf"\b{name}\b"), F.lit(k + 1)))
    return F.when(picked.between(1, n), picked - 1)


def term_tokens(term: Column) -> Column:
    """Lower-case word parts of a pathway term, without its collection prefix, short parts and stop words."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(term, r"^[A-Z]+_", ""), "_", " ")), r"[^a-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(bare, " "), lambda w: (F.length(w) > 2) & ~w.isin(*TERM_STOP_WORDS)))


def osa_distance(a: str, b: str) -> int:
    """Edits by insertion, deletion, substitution or a swap of neighbours, no part edited twice."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """osa_distance of two columns, null if either is."""
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def fuzzy_limit(target: Column) -> Column:
    """Edits allowed against a target: none under 4 characters, 1 up to 5, else 2."""
    n = F.length(target)
    return F.when(n < 4, 0).when(n <= 5, 1).otherwise(2)


def fuzzy_match(text: Column, target: Column) -> Column:
    """True if text is within the target's limit of edits; lengths that differ by more are not compared."""
    limit = fuzzy_limit(target)
    near = F.abs(F.length(text) - F.length(target)) <= limit
    return F.when(near, edit_distance(F.when(near, F.lower(text)), F.lower(target)) <= limit).otherwise(F.lit(False))


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first balanced object or array outside strings; null without one."""
    def find(s: str | None) -> str | None:
        start = min((i for i in (s.find("{"), s.find("[")) if i >= 0), default=-1) if s else -1
        if start < 0:
            return None
        depth, quoted, skip = 0, False, False
        for i in range(start, len(s)):
            c = s[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    return s[start : i + 1]
        return None

    return text.map(find)


#: An object without objects inside; braces in its strings count for nothing.
FLAT_OBJECT = r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}'


def complete_objects(text: Column) -> Column:
    """The whole flat objects of a text, such as a list that breaks off; empty if there is none, null for null."""
    return F.regexp_extract_all(text, F.lit(f"({FLAT_OBJECT})"), F.lit(1))


def whole_items(text: Column) -> Column:
    """The outermost objects of a text that are whole and valid JSON, nested ones too, such as those of a list that breaks off.

    Strings, escapes and braces are found once; an object goes from where the running depth of braces becomes 1 to where it is 0 again."""
    braces = F.filter(placed(text, r'(?s)"(?:[^"\\]|\\.)*+(?:"|$)|\\.|[{}]'), lambda z: z.m.isin("{", "}"))

    def cut(z: Column) -> Column:
        marks = F.arrays_zip(z.marks.start.alias("start"), z.marks.m.alias("m"), z.depth.alias("depth"))
        opens = F.filter(marks, lambda x: (x.m == "{") & (x.depth == 1))
        closes = F.filter(marks, lambda x: (x.m == "}") & (x.depth == 0))
        whole = F.filter(F.arrays_zip(opens.start.alias("a"), closes.start.alias("b")), lambda x: x.b.isNotNull())
        items = F.transform(whole, lambda x: F.substring(text, (x.a + 1).cast("int"), (x.b - x.a + 1).cast("int")))
        return F.filter(items, lambda x: F.try_parse_json(x).isNotNull())

    def deep(marks: Column) -> Column:
        return let(F.struct(marks.alias("marks"), running(F.transform(marks, lambda z: F.when(z.m == "{", F.lit(1)).otherwise(F.lit(-1)).cast("long"))).alias("depth")), cut)

    return let(braces, deep)


def gate(confidence: Column, has_required: Column) -> Column:
    """Confidence after the parameter check: missing ones cap it at .3, present ones raise it to .75."""
    return F.when(has_required, F.greatest(confidence, F.lit(0.75))).otherwise(F.least(confidence, F.lit(0.3)))


def gated(action: Column, confidence: Column, has_required: Column) -> Column:
    """The action, or NONE where the scorer is below .3 sure or the parameter check leaves it below .5."""
    return F.when((confidence < 0.3) | (gate(confidence, has_required) < 0.5), F.lit("NONE")).otherwise(action)


def ambiguous(top: Column, second: Column) -> Column:
    return (top < 0.6) & (top - F.coalesce(second, F.lit(0.0)) < 0.15)
