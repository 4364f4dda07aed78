"""Column expressions for text, genome coordinates, flags and hash randomness. No UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words read as true and as false in the tabulated reading of a text flag.
TRUE_WORDS = ["true", "t", "1", "yes", "pass", "passed"]
FALSE_WORDS = ["false", "f", "0", "no", "fail", "failed"]
# Words read as true in the strict reading; everything else is false.
STRICT_TRUE_WORDS = ["true", "1", "yes", "y"]

# Coordinate bin width, bins reserved per chromosome, codes of the sex chromosomes.
BIN_WIDTH = 10_000
BINS_PER_CHROMOSOME = 100_000
LAST_AUTOSOME = 19
X_CODE = 20
Y_CODE = 21
NON_CANONICAL_ORDER = 10_000

# Upper distance limits and the class each one names.
DISTANCE_CLASSES = [(2_000, "promoter_2kb"), (10_000, "proximal_10kb"), (50_000, "proximal_50kb")]
FAR_CLASS = "distal_gt50kb"
NO_ANCHOR_CLASS = "no_reference_chromosome"


def r6(c: Column) -> Column:
    """Six decimals; minus zero becomes zero so that engines agree."""
    return F.round(c, 6) + F.lit(0.0)


def flag_from_text(c: Column) -> Column:
    """Tabulated flag: a listed word gives true or false, any other text gives NULL."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def strict_flag(c: Column) -> Column:
    """Strict flag: a listed word is true, everything else (NULL too) is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(STRICT_TRUE_WORDS), F.lit(False))


def normalize_barcode(c: Column) -> Column:
    return F.translate(F.trim(c), ",", ".")


def regroup_barcode(c: Column) -> Column:
    """Eight dot-separated tokens to four comma-separated pairs; NULL for any other shape."""
    t = F.split(F.trim(c), r"\.")
    pairs = [F.concat_ws(".", t[i], t[i + 1]) for i in range(0, 8, 2)]
    return F.when(F.size(t) == 8, F.concat_ws(",", *pairs))


def composite_key(*cols: Column) -> Column:
    return F.concat_ws("::", *[c.cast("string") for c in cols])


def normalize_symbol(c: Column) -> Column:
    return F.upper(F.trim(c))


def term_mask(c: Column, terms: list[str]) -> Column:
    """Case-insensitive: does the text contain any of the literal terms?"""
    text = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t.lower())) for t in terms])


def normalize_chromosome(c: Column) -> Column:
    t = F.trim(c)
    return F.when((t == "") | t.startswith("chr"), t).otherwise(F.concat(F.lit("chr"), t))


def chromosome_code(c: Column) -> Column:
    """1..19 for the autosomes, 20 for X, 21 for Y; NULL for every other sequence name.

    One map lookup on the bare name, so the text work happens once per row.
    """
    bare = F.regexp_replace(F.upper(F.trim(c)), "^(CHR)?(0*(?=[0-9]))?", "")
    codes = {**{str(i): i for i in range(1, LAST_AUTOSOME + 1)}, "X": X_CODE, "Y": Y_CODE}
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in codes.items() for v in kv]), bare)


def chromosome_token(c: Column) -> Column:
    """Canonical token 1..19, X, Y without prefix; NULL for every other sequence name."""
    code = chromosome_code(c)
    return F.when(code == X_CODE, "X").when(code == Y_CODE, "Y").otherwise(code.cast("string"))


def chromosome_order(c: Column) -> Column:
    return F.coalesce(chromosome_code(c), F.lit(NON_CANONICAL_ORDER))


def encode_bin(chrom: Column, midpoint: Column) -> Column:
    """One integer per (chromosome, fixed-width bin); NULL off the canonical set.

    A coordinate past the space reserved per chromosome is an error, never a silent clash.
    """
    local = F.floor(midpoint / BIN_WIDTH).cast("bigint")
    code = chromosome_code(chrom).cast("bigint")
    checked = F.when(local >= BINS_PER_CHROMOSOME, F.raise_error(F.lit("coordinate past the bin space")).cast("bigint"))
    return F.when(code.isNotNull() & (midpoint >= 0), F.coalesce(checked, code * BINS_PER_CHROMOSOME + local))


def decode_bin(code: Column) -> Column:
    """struct(chrom, start, end, chrom_code, local_bin) of an encoded bin."""
    chrom_code = F.floor(code / BINS_PER_CHROMOSOME).cast("int")
    local = (code % BINS_PER_CHROMOSOME).cast("bigint")
    name = F.when(chrom_code == X_CODE, "X").when(chrom_code == Y_CODE, "Y").otherwise(chrom_code.cast("string"))
    return F.struct(
        F.concat(F.lit("chr"), name).alias("chrom"),
        (local * BIN_WIDTH).alias("start"),
        ((local + 1) * BIN_WIDTH).alias("end"),
        chrom_code.alias("chrom_code"),
        local.alias("local_bin"),
    )


def distance_class(distance: Column) -> Column:
    expr = F.when(distance.isNull(), NO_ANCHOR_CLASS)
    for limit, name in DISTANCE_CLASSES:
        expr = expr.when(distance <= limit, name)
    return expr.otherwise(FAR_CLASS)


def width_bin(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("int")


def edge_bin(c: Column, edges: list[float]) -> Column:
    """Number of inner edges at or below the value (bins closed on the left)."""
    return reduce(lambda a, b: a + b, [(c >= e).cast("int") for e in edges])


def gc_fraction(seq: Column) -> Column:
    """G and C over A, C, G and T; NULL when none of the four occurs."""
    s = F.upper(seq)
    valid = F.length(F.regexp_replace(s, "[^ACGT]", ""))
    return F.when(valid > 0, F.length(F.regexp_replace(s, "[^GC]", "")) / valid)


def hash60(*parts) -> Column:
    """Uniform 60-bit number from the parts: the same in Spark, DuckDB and any retry."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def fixed6(c: Column) -> Column:
    """Six-decimal text, a dash for missing."""
    return F.when(c.isNull() | F.isnan(c), "—").otherwise(F.format_string("%.6f", c))
