"""Column functions for loci and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chromosome names by code 1 to 26.
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y", "XY", "MT"]


def chromosome_code(name: Column) -> Column:
    """1..22, X 23, Y 24, XY 25, MT 26 for any spelling (chr prefix, case, X|Y, M); others null."""
    plain = F.regexp_replace(F.upper(F.trim(name)), "^CHR", "")
    plain = F.when(plain == "X|Y", "XY").when(plain == "M", "MT").otherwise(plain)
    return F.create_map(*[F.lit(x) for k, c in enumerate(CHROMOSOMES) for x in (c, k + 1)])[plain]


def chromosome_name(code: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in CHROMOSOMES]), code.cast("int"))


def locus_label(label: Column, chrom: Column, pos: Column, ref: Column, repeat_ref: bool = False) -> Column:
    """The id, or chr<chrom>-<pos>-<ref> where it is empty or '.'; ``repeat_ref`` appends the reference allele twice."""
    made = F.concat_ws("-", F.concat(F.lit("chr"), chromosome_name(chrom)), pos.cast("string"), ref, *[ref] * repeat_ref)
    return F.when(F.coalesce(label, F.lit("")).isin("", "."), made).otherwise(label)


def allele_list(ref: Column, alt: Column) -> Column:
    return F.split(F.concat_ws(",", ref, alt), ",")


def call_alleles(gt: Column) -> Column:
    """array(a1, a2) of a GT field; null when not of two parts, or either is '.' or no number."""
    parts = F.split(gt, r"[/|]")
    a, b = (F.try_element_at(parts, F.lit(k)).try_cast("bigint") for k in (1, 2))
    return F.when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), F.array(a, b))


def filter_passes(mark: Column) -> Column:
    """FILTER '.' or 'PASS'."""
    return mark.isin(".", "PASS")


def field(call: Column, fmt: Column, key: str) -> Column:
    """The value of a FORMAT key in a call; null where the key or the trailing field is absent."""
    at = F.array_position(F.split(fmt, ":"), key).cast("int")
    return F.when(at > 0, F.try_element_at(F.split(call, ":"), F.greatest(at, F.lit(1))))


def kept_call(call: Column, fmt: Column) -> Column:
    """The GT of a call, null when missing or when FT is there and neither PASS nor '.'."""
    ft = field(call, fmt, "FT")
    return F.when((call != ".") & (ft.isNull() | ft.isin("PASS", ".")), field(call, fmt, "GT"))


def star_as(alleles: Column, call: Column, reference: bool = True) -> Column:
    """A call's alleles with '*' read as the reference allele, or the whole call as missing."""
    def star(a: Column) -> Column:
        return F.try_element_at(alleles, (a + 1).cast("int")) == "*"

    if reference:
        return F.transform(call, lambda a: F.when(star(a), F.lit(0).cast("bigint")).otherwise(a))
    return F.when(~F.exists(call, lambda a: F.coalesce(star(a), F.lit(False))), call)


def dosage(a1: Column, a2: Column, major: Column) -> Column:
    """Number of alleles that aren't the major one; null for missing calls."""
    return F.when(a1.isNotNull() & a2.isNotNull(), (a1 != major).cast("long") + (a2 != major).cast("long"))


def coded(dose: Column, model: str = "additive") -> Column:
    """Dosage under a disease model: additive, dominant (any) or recessive (both)."""
    if model == "additive":
        return dose
    if model not in ("dominant", "recessive"):
        raise ValueError(f"no disease model {model}")
    return (dose > (0 if model == "dominant" else 1)).cast("long")


def folded(m: Column, n: Column) -> Column:
    """Minor allele frequency of ``m`` non-major alleles among ``n`` genotypes; null without genotypes."""
    f = m / (2 * n)
    return F.when(n > 0, F.least(f, 1 - f))


def within(m: Column, n: Column, low: float, high: float) -> Column:
    """Is the folded frequency in [low, high]? Counts are compared, so a folded 0.05 is within 0.05."""
    minor = F.least(m, 2 * n - m)
    return F.coalesce((n > 0) & (minor <= high * 2 * n + 1e-9) & (minor >= low * 2 * n - 1e-9), F.lit(False))


def madsen_browning(m: Column, n: Column) -> Column:
    """(2n + 2) / sqrt(n (m + 1) (2n - m + 1)); 1 for an empty group."""
    return F.when(n > 0, (2 * n + 2) / F.sqrt(n.cast("double") * (m + 1) * (2 * n - m + 1))).otherwise(1.0)


def role_class(role: Column) -> Column:
    """intron, exon, reg or other for dbSNP function codes."""
    return F.when(role.isin("intron", "splice-3", "splice-5"), "intron").when(role.isin("cds-synon", "stop-gain", "missense", "frameshift"), "exon").when(role.isin("utr-3", "utr-5", "regulatory"), "reg").otherwise("other")


def window_name(chrom: Column, k: Column, width_kb: int, step_kb: int) -> Column:
    return F.concat(F.lit("chr"), chromosome_name(chrom), F.lit(":"), (k * step_kb).cast("string"), F.lit("K-"), (k * step_kb + width_kb).cast("string"), F.lit("K"))


def escaped(name: Column, delimiter: str = ",") -> Column:
    """A name without the report's delimiter: '_' instead, or '-' where the delimiter is '_'."""
    return F.replace(name, F.lit(delimiter), F.lit("-" if delimiter == "_" else "_"))


def without_version(accession: Column) -> Column:
    return F.regexp_replace(accession, r"\.[^.]*$", "")


def profile_name(population: Column, metric: Column, cutoff: Column) -> Column:
    """POP-RS0.80 or POP-DP0.80."""
    return F.format_string("%s-%s%.2f", population, metric, cutoff)
