"""Content ids, name normalisers and path classifiers as Column expressions.

All are JVM-side and null-safe: a null input gives a null key, except where a default
is stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes by kind, first match wins in the order of ``file_type``.
FASTA = (".fa", ".fasta", ".fna", ".fas")
ANNOTATION = (".gff", ".gff3", ".gtf")
VARIANT = (".vcf", ".bcf")
INTERVAL = (".bed", ".bedgraph", ".bigwig", ".bw")
CHECKSUM = (".md5", ".sha1", ".sha256", ".checksums")
ARCHIVE = (".tar", ".zip", ".tgz", ".tbz2", ".xz", ".7z")
COMPRESSION = (".gz", ".bgz", ".bz2", ".zst")


def _ends(value: Column, suffixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | value.endswith(s)
    return found


def content_id(value: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of a string."""
    return F.substring(F.sha2(value, 256), 1, length)


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_type(path: Column) -> Column:
    """Kind of a file by its suffix, one compression suffix aside."""
    name = F.lower(base_name(path))
    bare = F.regexp_replace(name, r"\.(gz|bgz|bz2|zst)$", "")
    return (
        F.when(_ends(bare, FASTA), "fasta")
        .when(_ends(bare, ANNOTATION), "annotation")
        .when(_ends(bare, VARIANT), "variant")
        .when(_ends(bare, INTERVAL), "interval")
        .when(_ends(name, CHECKSUM), "checksum")
        .when(_ends(bare, ARCHIVE) | _ends(name, (".tar.gz", ".tar.bz2", ".tar.zst")), "archive")
        .otherwise("other")
    )


def member_type(name: Column, protein: tuple[str, ...] = (".faa", ".pep"), tables: tuple[str, ...] = (".tsv", ".csv", ".xlsx", ".xls")) -> Column:
    """Kind of an archive member: protein before annotation before sequence before table."""
    bare = F.regexp_replace(F.lower(name), r"\.gz$", "")
    return F.when(_ends(bare, protein), "protein_fasta").when(_ends(bare, ANNOTATION), "annotation").when(_ends(bare, FASTA), "fasta").when(_ends(bare, tables), "table").otherwise("other")


def annotation_role(path: Column, primary: list[tuple[str, ...]], secondary: list[tuple[str, ...]], default: str = "other_annotation") -> Column:
    """Struct (role, is_primary) by ordered rules: pattern on the lower-cased base name, role, and maybe a pattern on the whole path."""
    low = F.lower(path)
    found = [
        F.when(F.lower(base_name(path)).rlike(pattern) & (low.rlike(folder[0]) if folder else F.lit(True)), F.struct(F.lit(role).alias("role"), F.lit(flag).alias("is_primary")))
        for flag, rules in ((True, primary), (False, secondary))
        for pattern, role, *folder in rules
    ]
    return F.coalesce(*found, F.struct(F.lit(default).alias("role"), F.lit(False).alias("is_primary")))


#: Role patterns on base names, in order of precedence.
PRIMARY_ROLES = [("gene_models_main", "gene_models_main"), (r"_?genomic\.gff3?\.gz$", "ncbi_genomic"), (r"\.gene\.gff|\.gene_models\.gff", "soyomics_gene", "(^|/)gff/")]
SECONDARY_ROLES = [
    ("iprscan", "functional_iprscan"),
    ("repeat", "repeat"),
    ("noncoding|ncrna", "noncoding"),
    ("gene_models_low|low_quality_genes", "low_quality_gene_model"),
    ("gene_models_exons", "gene_model_exons"),
    ("gcv_genome", "gcv_genome"),
    ("gcv_genes", "gcv_genes"),
]


def genome_role(path: Column) -> Column:
    """Role of a sequence file: soft-masked, main, genomic export, or generic."""
    low = F.lower(path)
    return F.when(low.contains("softmask"), "softmasked").when(low.contains("genome_main"), "main").when(low.contains("_genomic.fna"), "ncbi_genomic").otherwise("generic_genome")


def path_fields(path: Column, layouts: list[tuple[str, int, int | None, int | None, int | None]]) -> Column:
    """Struct (source, genus, species, label) of a path.

    ``layouts`` has (prefix, least number of parts, index of genus or species, index of
    epithet or None, index of label or None), tried in order; the source is the prefix
    with slashes as underscores, and otherwise the first part.
    """
    parts = F.split(path, "/")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    out = None
    for prefix, least, genus, epithet, label in layouts:
        taxon = F.lit("") if genus is None else F.trim(F.regexp_replace(part(genus), "_", " "))
        first = F.lit("") if genus is None else F.element_at(F.split(taxon, " +"), 1)
        species = taxon if epithet is None else F.concat_ws(" ", part(genus), F.regexp_replace(part(epithet), "_", " "))
        value = F.struct(F.lit(prefix.replace("/", "_")).alias("source"), first.alias("genus"), species.alias("species"), (F.lit("") if label is None else part(label)).alias("label"))
        here = path.startswith(prefix + "/") & (F.size(parts) >= least)
        out = F.when(here, value) if out is None else out.when(here, value)
    rest = F.struct(part(0).alias("source"), F.lit("").alias("genus"), F.lit("").alias("species"), F.lit("").alias("label"))
    return rest if out is None else out.otherwise(rest)


def is_genome_fasta(kind: Column, type_: Column, path: Column) -> Column:
    """A plain sequence file below a folder named genome."""
    return (kind == "file") & (type_ == "fasta") & F.concat(F.lit("/"), F.lower(path), F.lit("/")).contains("/genome/")


def assembly_stem(label: Column) -> Column:
    """The label up to and including its ``.gnm`` part, or all of it."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"^(.+?\.gnm[^.]+)", 1), F.lit("")), label)


def pair_key(source: Column, *parts: Column) -> Column:
    """Parts joined by a bar, the source first."""
    return F.concat_ws("|", source, *parts)


def material_key(value: Column, strip_version: bool = False) -> Column:
    """Lower-case letters and digits only; optionally without a T2T or version suffix."""
    if strip_version:
        value = F.regexp_replace(value, r"(?i)(?:[_-]?t2t(?:-?2)?|\.v\d+)$", "")
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def sequence_prefix(path: Column) -> Column:
    """Base name up to its first dot, lower-cased."""
    return F.lower(F.split_part(base_name(path), F.lit("."), F.lit(1)))


def binomial(species: Column) -> Column:
    """The first two words."""
    return F.array_join(F.slice(F.split(F.trim(species), r"\s+"), 1, 2), " ")


def safe_path(name: Column) -> Column:
    """Relative, without a parent step or drive letter, and not empty."""
    path = F.translate(name, "\\", "/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return ~path.startswith("/") & (F.size(parts) > 0) & ~F.exists(parts, lambda p: p == "..") & ~F.coalesce(F.get(parts, F.lit(0)).rlike("^[A-Za-z]:$"), F.lit(False))


def redacted_link(target: Column) -> Column:
    """Link targets; absolute ones only as a digest."""
    return F.when(target.startswith("/"), F.concat(F.lit("<absolute:path-sha256:"), F.sha2(target, 256), F.lit(">"))).otherwise(target)


def text_bool(value: Column) -> Column:
    """True for "true" in any case; everything else, null too, is false."""
    return F.coalesce(F.lower(value) == "true", F.lit(False))


def nullable_int(value: Column) -> Column:
    """A whole number; empty text is null, other text is an error."""
    return F.nullif(F.trim(value), F.lit("")).cast("bigint")


def joined(values: Column) -> Column:
    """List as text with semicolons; empty or null as a dot."""
    return F.coalesce(F.nullif(F.array_join(values, ";"), F.lit("")), F.lit("."))


def present(value: Column) -> Column:
    """Neither null nor one of the spellings of nothing."""
    return F.coalesce(~F.trim(value).isin("", ".", "None"), F.lit(False))


def is_digest(value: Column) -> Column:
    """64 lower-case hex digits."""
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def alnum(value: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def taxon_matches(expected: Column, observed: Column, aliases: Column) -> Column:
    """Equal as letters and digits, or an accepted alias."""
    return (alnum(observed) == alnum(expected)) | F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: alnum(a) == alnum(observed))
