"""Column functions for intervals and chromosomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(x: Column) -> Column:
    return x.try_cast("bigint")


def parse_peak(name: Column) -> Column:
    """Struct (chr, start, end, mid) of names like chr:s-e, chr-s-e or chr_s_e (the last two fields are the places); null otherwise."""
    pattern = r"^(.+)[:\-_](\d+)[\-_](\d+)$"
    start, end = _whole(F.regexp_extract(name, pattern, 2)), _whole(F.regexp_extract(name, pattern, 3))
    made = F.struct(F.regexp_extract(name, pattern, 1).alias("chr"), start.alias("start"), end.alias("end"), ((start + end) / 2).alias("mid"))
    return F.when(name.rlike(pattern), made)


def peak_name(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("-", chrom, start.cast("string"), end.cast("string"))


def chromosome_rank(chrom: Column) -> Column:
    """Numeric prefix, then X 23, Y 24, M or MT 25, all others 1000."""
    bare = F.regexp_replace(chrom, "^chr", "")
    number = F.regexp_extract(bare, r"^(\d+)", 1)
    return F.when(number != "", number.try_cast("int")).when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(1000)


def genome_of(summary: Column) -> Column:
    """Assembly named in a run's summary text; the first rule that matches wins, null if none does."""
    low = F.lower(summary)
    return F.when(low.rlike("hg38|grch38|human"), "hg38").when(low.rlike("hg19|grch37"), "hg19").when(low.rlike("mm39|grcm39"), "mm39").when(low.rlike("mm10|grcm38|mouse"), "mm10")


def display_gene(name: Column, genome: Column) -> Column:
    """Upper case for human assemblies, capitalised for mouse; interval names stay."""
    title = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 20)))
    return F.when(name.rlike("^chr[^:]*:"), name).when(genome.rlike("^hg"), F.upper(name)).when(genome.rlike("^mm"), title).otherwise(name)


def barcode_of(number: Column) -> Column:
    return F.concat(F.lit("cellid_"), F.lpad(number.cast("string"), 9, "0"), F.lit("-1"))


def number_of(barcode: Column) -> Column:
    return _whole(F.regexp_extract(barcode, r"^cellid_(\d+)-1$", 1))


#: Coefficients of the normal tail polynomial, Abramowitz and Stegun 26.2.17 (fixed values), of t to t^5.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_STEP = 0.2316419


def normal_tail(z: Column) -> Column:
    """Upper tail probability of |z| under the standard normal, by the polynomial approximation."""
    t = 1 / (1 + TAIL_STEP * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def normal_tail_sql(z: str) -> str:
    t = f"(1 / (1 + {TAIL_STEP} * abs({z})))"
    poly = "0.0"
    for c in reversed(TAIL):
        poly = f"(({poly} + {c}) * {t})"
    return f"exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * {poly}"
