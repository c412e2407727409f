"""Record rewrites: DataFrames of variants (chrom, pos, id, ref, alt, qual, filter, info, ...) to the same, columns kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.functions import alleles as A
from varspan.functions import genotypes as G
from varspan.functions import sequence as S
from varspan.functions.info import delete_info_field, has_info_field, info_field, replace_info_field, set_in_column, set_info_field
from varspan.shared import compiled

SIZED = ("DEL", "INV", "DUP", "CNV")


def add_type_and_length(df: DataFrame) -> DataFrame:
    """svtype, svlen, and both in info. A type that info has stays, cut to three letters; else it is inferred from the alleles.
    The length of sequences comes from the alleles, of symbolic records from SVLEN or END; unknown ones and breakends have 0.
    SVLEN is written where it is positive or was there."""
    compiled(df.sparkSession)
    info, shape = F.col("info"), F.col("_alt")
    own = F.when(info.contains("SVTYPE="), F.substring(info_field(info, "SVTYPE"), 1, 3))
    known = df.withColumns({"_own": own, "_alt": A.alt_kind(F.col("alt")), "_ref": A.alt_kind(F.col("ref"))})
    kind = F.coalesce(F.when(F.col("_own") != "", F.col("_own")), A.svtype(F.col("ref"), F.col("alt"), shape))
    both = (shape == A.DNA) & (F.col("_ref") == A.DNA)
    size = (
        F.when(F.upper("svtype") == "BND", 0)
        .when(both & (F.upper("svtype") == "INS"), F.length("alt") - 1)
        .when(both, F.length("ref") - 1)
        .when(shape == A.SYMBOLIC, F.greatest(A.symbolic_length(F.col("pos"), info), F.lit(0)))
        .otherwise(0)
    )
    # each step is a column, so that what the next one names again is not computed again
    typed = known.withColumn("svtype", kind).withColumn("svlen", size).withColumn("_typed", set_in_column(info, "SVTYPE", F.col("svtype")))
    write = (F.col("svlen") > 0) | info.contains("SVLEN=") & has_info_field(info, "SVLEN")
    both_set = F.when(write, set_in_column(F.col("_typed"), "SVLEN", F.col("svlen").cast("string"))).otherwise(F.col("_typed"))
    return typed.withColumn("info", both_set).drop("_own", "_alt", "_ref", "_typed")


def length_into_alt(df: DataFrame, with_insertions: bool = False) -> DataFrame:
    """A symbolic ALT becomes '<TYPE-SVLEN>', type and length (its sign too) as INFO has them; records without SVLEN, and of
    types that aren't sized, stay."""
    types = ("DEL", "INV", "DUP", "INS", "CNV") if with_insertions else SIZED
    kind = F.coalesce(*[F.when(F.contains("info", F.lit(f"SVTYPE={t}")), F.lit(t)) for t in types])
    size = info_field(F.col("info"), "SVLEN").try_cast("int")
    sized = F.col("alt").startswith("<") & kind.isNotNull() & size.isNotNull()
    return df.withColumn("alt", F.when(sized, F.concat(F.lit("<"), kind, F.lit("-"), size.cast("string"), F.lit(">"))).otherwise(F.col("alt")))


def length_out_of_alt(df: DataFrame) -> DataFrame:
    return df.withColumn("alt", F.regexp_replace("alt", "^(<...).*$", "$1>"))


def fix_replacement_length(df: DataFrame) -> DataFrame:
    """SVLEN, where there is one, of sequence replacements (both alleles over one base) is len(ref) - 1."""
    both = F.col("ref").rlike("^[ACGTNacgtn]{2,}$") & F.col("alt").rlike("^[ACGTNacgtn]{2,}$")
    return df.withColumn("info", F.when(both, replace_info_field(F.col("info"), "SVLEN", (F.length("ref") - 1).cast("string"))).otherwise(F.col("info")))


def fit_to_contigs(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Drops records off their contig, and symbolic ones that reach over its end (insertions apart); strips lengths from ALT;
    upper case. END is set on every record: where symbolic ones end, else (insertions too) POS. contigs: chrom, length. svlen
    must be there."""
    sizes = contigs.select("chrom", F.col("length").alias("_length"))
    symbolic = F.col("alt").startswith("<") & ~F.upper("alt").startswith("<INS")
    end = F.when(symbolic, F.col("pos") + F.col("svlen")).otherwise(F.col("pos"))
    return (
        length_out_of_alt(df.join(sizes, "chrom"))
        .where("pos between 1 and _length")
        .where(~(symbolic & (F.col("pos") + F.col("svlen") > F.col("_length"))))
        .withColumns({"info": set_info_field(F.col("info"), "END", end.cast("string")), "ref": F.upper("ref"), "alt": F.upper("alt")})
        .drop("_length")
    )


def compress_alleles(df: DataFrame, contigs: DataFrame, qual: float) -> DataFrame:
    """Sequences give way to their lengths: REF N, ALT '<TYPE-length>' of DEL, INV, DUP, CNV whose length is known; '<INS>' and
    records off their contig are dropped; one QUAL; FILTER PASS."""
    sizes = contigs.select("chrom", F.col("length").alias("_length"))
    sized = F.col("svtype").isin(*SIZED) & F.col("svlen").isNotNull()
    return (
        df.join(sizes, "chrom")
        .where("pos between 1 and _length")
        .where(F.upper("alt") != "<INS>")
        .withColumns({"alt": F.when(sized, F.concat(F.lit("<"), "svtype", F.lit("-"), "svlen", F.lit(">"))).otherwise(F.col("alt")), "ref": F.when(sized, "N").otherwise(F.col("ref"))})
        .transform(clean_quality, qual)
        .drop("_length")
    )


def clean_quality(df: DataFrame, qual: float) -> DataFrame:
    return df.withColumns({"qual": F.lit(float(qual)), "filter": F.lit("PASS")})


def clean_alleles(df: DataFrame, qual: float) -> DataFrame:
    """Upper case, letters other than ACGT as N (sequences only), one QUAL, FILTER PASS."""
    alt = F.when(F.col("alt").startswith("<"), F.col("alt")).otherwise(S.clean_sequence(F.col("alt")))
    return clean_quality(df.withColumns({"ref": S.clean_sequence(F.col("ref")), "alt": alt}), qual)


def clean_breakends(df: DataFrame, qual: float) -> DataFrame:
    """Upper case but for the mate inside the brackets (other letters stay), one QUAL, FILTER PASS."""
    parts = [F.regexp_extract("alt", r"^([^\[\]]*)([\[\]].*[\[\]])([^\[\]]*)$", i) for i in (1, 2, 3)]
    alt = F.when(F.col("alt").rlike(r"[\[\]]"), F.concat(F.upper(parts[0]), parts[1], F.upper(parts[2]))).otherwise(F.col("alt"))
    return clean_quality(df.withColumns({"ref": F.upper("ref"), "alt": alt}), qual)


def id_into_alt(df: DataFrame) -> DataFrame:
    """ALT '<DEL-id>'."""
    return df.withColumn("alt", F.concat(F.lit("<DEL-"), "id", F.lit(">")))


def chromosome_number(chrom: Column) -> Column:
    """1 to 22, X 23, Y 24, M 25; null for others."""
    name = F.regexp_extract(chrom, "^chr([0-9]{1,2}|X|Y|M)$", 1)
    return F.when(name == "X", 23).when(name == "Y", 24).when(name == "M", 25).otherwise(name.try_cast("int"))


def mate_parity(chrom1: Column, chrom2: Column) -> Column:
    """0 both even, 1 mixed, 2 both odd, 3 where either is no standard chromosome (X odd, Y even, M odd)."""
    a, b = chromosome_number(chrom1) % 2, chromosome_number(chrom2) % 2
    return F.coalesce(F.when(a + b == 0, 0).when(a != b, 1).when(a + b == 2, 2), F.lit(3))


def drop_orientation(df: DataFrame) -> DataFrame:
    """Every breakend as bases, mate, '[', whatever its brackets and side: the orientation is forgotten."""
    turned = F.translate("alt", "]", "[")
    return df.withColumn("alt", F.when(turned.startswith("["), F.regexp_replace(turned, r"^(\[[^\[]*\[)(.*)$", "$2$1")).otherwise(turned))


def symmetrize(df: DataFrame) -> DataFrame:
    """The record as seen from its mate: ends swapped, brackets turned by direction, REF N, flag SYMMETRIZED."""
    b = A.breakend(F.col("chrom"), F.col("pos"), F.col("alt"))
    bracket = F.when(b["dir1"] == 1, "]").otherwise("[")
    mate = F.concat(bracket, b["chrom1"], F.lit(":"), b["pos1"], bracket)
    alt = F.when(b["dir2"] == 1, F.concat(F.lit("N"), mate)).otherwise(F.concat(mate, F.lit("N")))
    info = F.when(F.col("info") == ".", "SYMMETRIZED").otherwise(F.concat("info", F.lit(";SYMMETRIZED")))
    return df.withColumn("_b", b).withColumns({"_alt": alt, "_info": info}).withColumns(
        {"chrom": F.col("_b.chrom2"), "pos": F.col("_b.pos2"), "ref": F.lit("N"), "alt": F.col("_alt"), "info": F.col("_info")}
    ).drop("_b", "_alt", "_info")


def shift_duplications(df: DataFrame, contigs: DataFrame, forward: bool) -> DataFrame:
    """POS moved by SVLEN to the other end of the copy, clamped to the contig."""
    moved = (
        F.least(F.col("pos") + F.col("svlen"), F.col("_length")) if forward else F.greatest(F.col("pos") - F.col("svlen"), F.lit(1))
    )
    sizes = contigs.select("chrom", F.col("length").alias("_length"))
    return df.join(sizes, "chrom").withColumn("pos", moved.cast("int")).drop("_length")


def force_duplication(df: DataFrame) -> DataFrame:
    return df.withColumns({"alt": F.lit("<DUP>"), "svtype": F.lit("DUP"), "info": set_info_field(F.col("info"), "SVTYPE", F.lit("DUP"))})


def restore_insertions(df: DataFrame) -> DataFrame:
    """Duplications made from insertions (INSDUP in info) become these again, from INS_POS, INS_ALT, INS_SVLEN (else the length
    of INS_ALT) and INS_QUAL, with type, length and END of the insertion; where the duplication was is kept in INSDUP_POS and
    INSDUP_SVLEN; the helper fields go."""
    info = F.col("info")
    was = F.contains(info, F.lit("INSDUP"))
    alt, place = info_field(info, "INS_ALT"), info_field(info, "INS_POS")
    kept = info
    for field in ("INS_POS", "INS_ALT", "INS_QUAL", "INS_SVLEN"):
        kept = delete_info_field(kept, field)
    length = F.coalesce(info_field(info, "INS_SVLEN"), F.length(alt).cast("string"))
    for field, value in (("SVTYPE", F.lit("INS")), ("SVLEN", length), ("END", place)):
        kept = set_info_field(kept, field, value)
    kept = F.concat(kept, F.lit(";INSDUP_POS="), F.col("pos").cast("string"), F.lit(";INSDUP_SVLEN="), F.coalesce(info_field(info, "SVLEN"), F.lit(".")))
    return df.withColumns(
        {
            "pos": F.when(was, place.try_cast("int")).otherwise(F.col("pos")),
            "alt": F.when(was, alt).otherwise(F.col("alt")),
            "qual": F.when(was, info_field(info, "INS_QUAL").try_cast("double")).otherwise(F.col("qual")),
            "info": F.when(was, kept).otherwise(info),
        }
    )


def intervals_to_records(bed: DataFrame, svtype: str) -> DataFrame:
    return bed.select(
        "chrom", (F.col("start") + 1).alias("pos"), F.concat_ws("_", "chrom", "start", "end").alias("id"), F.lit("N").alias("ref"),
        F.lit(f"<{svtype}>").alias("alt"), F.lit(svtype).alias("svtype"), (F.col("end") - F.col("start")).alias("svlen"),
    )


def assembly_calls(df: DataFrame, least: int) -> DataFrame:
    """Passing calls whose alleles differ by `least` bases or more: FILTER PASS, info rewritten to type and length (alleles of
    one length keep theirs)."""
    diff = F.length("alt") - F.length("ref")
    kind = F.when(diff > 0, "INS").when(diff < 0, "DEL").otherwise("SUB")
    return (
        df.where((F.col("filter") == ".") | (F.upper("filter") == "PASS"))
        .where(F.abs(diff) >= least)
        .withColumns({"svtype": kind, "svlen": F.abs(diff), "filter": F.lit("PASS")})
        .withColumn("info", F.when(F.col("svtype") == "SUB", F.col("info")).otherwise(F.concat(F.lit("SVTYPE="), "svtype", F.lit(";SVLEN="), "svlen")))
    )


def sequences_of(spans: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """chrom, first, last, seq: the reference from first to last (1-based, inclusive) of each different span, from blocks
    (chrom, block, seq; block_size bases each). Spans travel to their blocks; no task holds a contig. Spans off the contig
    have no row."""
    spans = spans.select("chrom", "first", "last").where("first >= 1 and first <= last").distinct()
    parts = spans.withColumn("block", F.explode(F.sequence(F.floor((F.col("first") - 1) / block_size).cast("int"), F.floor((F.col("last") - 1) / block_size).cast("int"))))
    from_base = F.greatest(F.col("first") - 1 - F.col("block") * block_size, F.lit(0))
    to_base = F.least(F.col("last") - F.col("block") * block_size, F.lit(block_size))
    piece = F.struct("block", F.substring(F.col("seq"), (from_base + 1).cast("int"), (to_base - from_base).cast("int")).alias("piece"))
    # size estimates don't see the blocks' sequences: a broadcast by these would bring the whole reference to the driver
    whole = parts.hint("merge").join(blocks.select("chrom", "block", "seq").hint("merge"), ["chrom", "block"])
    whole = whole.groupBy("chrom", "first", "last").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    joined = whole.select("chrom", "first", "last", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("seq"))
    return joined.where(F.length("seq") == F.col("last") - F.col("first") + 1)


def materialize(df: DataFrame, blocks: DataFrame, block_size: int, contigs: DataFrame) -> DataFrame:
    """Symbolic DEL, INV, DUP (any case) with a SVLEN get their sequences from reference blocks (chrom, block, seq): a DEL its
    REF, an INV its reverse complement, a DUP becomes an insertion of the copy, in SVTYPE and END of info (and svtype,
    if it is there) too. Records with sequences and breakends pass, repeated rows stay repeated. Dropped: records off their
    contig, symbolic ones of other types, without SVLEN, or over the contig's end."""
    inside = df.join(contigs.select("chrom", F.col("length").alias("_length")), "chrom").where("pos between 1 and _length").drop("_length")
    symbolic = F.col("alt").startswith("<")
    kind = F.upper(F.substring("alt", 2, 3))
    size = info_field(F.col("info"), "SVLEN").try_cast("int")
    wanted = inside.where(symbolic & kind.isin("DEL", "INV", "DUP") & (size >= 0)).withColumns({"_last": F.col("pos") + size, "_kind": kind})
    found = sequences_of(wanted.select("chrom", F.col("pos").alias("first"), F.col("_last").alias("last")), blocks, block_size)
    found = found.select("chrom", F.col("first").alias("pos"), F.col("last").alias("_last"), F.col("seq").alias("_seq"))
    seq, anchor = F.col("_seq"), F.substring("_seq", 1, 1)
    body = F.substring(F.col("_seq"), F.lit(2), F.length("_seq"))
    copied = F.regexp_replace("info", "SVTYPE=DUP", "SVTYPE=INS")
    new = {
        "ref": F.when(F.col("_kind") == "DUP", anchor).otherwise(seq),
        "alt": F.when(F.col("_kind") == "DEL", anchor).when(F.col("_kind") == "INV", F.concat(anchor, S.reverse_complement(body))).otherwise(seq),
        "info": F.when(F.col("_kind") == "DUP", replace_info_field(copied, "END", F.col("pos").cast("string"))).otherwise(F.col("info")),
    }
    if "svtype" in df.columns:
        new["svtype"] = F.when(F.col("_kind") == "DUP", "INS").otherwise(F.col("svtype"))
    made = wanted.join(found, ["chrom", "pos", "_last"]).withColumns(new).select(*df.columns)
    return inside.where(~symbolic).select(*df.columns).unionByName(made)


def correct_genotypes(df: DataFrame, least: int, both_ways: bool) -> DataFrame:
    """new_gt by read support (gt, ad_ref, ad_alt): 0/1 with too few alternative reads is 0/0; both_ways also 0/0 and 0/1
    with too few reference reads become 0/1 and 1/1, 1/1 with too few alternative ones 0/1; haploid alike. Phased cells stay phased."""
    gt, ref, alt = F.regexp_replace("gt", "\\|", "/"), F.col("ad_ref") < least, F.col("ad_alt") < least
    het = gt.isin("0/1", "1/0")
    new = F.when(het & alt, "0/0").when((gt == "1") & alt, "0") if not both_ways else (
        F.when((gt == "0/0") & ref, "0/1")
        .when(het & alt, "0/0")
        .when(het & ref, "1/1")
        .when((gt == "1/1") & alt, "0/1")
        .when((gt == "0") & ref, "1")
        .when((gt == "1") & alt, "0")
    )
    phased = F.when(F.col("gt").contains("|"), F.regexp_replace(new, "/", "|")).otherwise(new)
    return df.withColumn("new_gt", F.coalesce(phased, F.col("gt")))


def caller_flags(supp: Column) -> dict[str, Column]:
    """Bit 0 pav, 1 pbsv, 2 sniffles."""
    return {name: F.shiftright(supp, i).bitwiseAND(1).cast("int").alias(name) for i, name in enumerate(("pav", "pbsv", "sniffles"))}


def genotype_features(df: DataFrame) -> DataFrame:
    """gt_count, ks_1, ks_2, ad_ref, ad_alt from gt and the comma pairs ks and ad; missing as -1."""
    return df.withColumns(
        {
            "gt_count": G.gt_count(F.col("gt")),
            **{f"ks_{i + 1}": G.pair_or_missing(F.col("ks"), i) for i in (0, 1)},
            **{n: G.pair_or_missing(F.col("ad"), i) for i, n in enumerate(("ad_ref", "ad_alt"))},
        }
    )


def split_alleles(df: DataFrame) -> DataFrame:
    """A row for each ALT of a multiallelic record; of gt, this allele is 1, others 0, missing stays."""
    one = df.select("*", F.posexplode(F.split("alt", ",")).alias("_i", "_alt"))
    own = F.transform(
        F.split("gt", "[/|]"), lambda a: F.when(a == ".", ".").when(a == (F.col("_i") + 1).cast("string"), "1").otherwise("0")
    )
    phased = F.when(F.col("gt").contains("|"), F.array_join(own, "|")).otherwise(F.array_join(own, "/"))
    return one.withColumns({"gt": phased, "alt": F.col("_alt")}).drop("_i", "_alt")


def rekey(df: DataFrame) -> DataFrame:
    """new_id 'chrom_n', n by position, alleles and id: numbered in blocks, not one task a contig."""
    from varspan.operators.scan import running_sum

    out = running_sum(df, ["chrom"], "pos", ["ref", "alt", "id"], F.lit(1), "_n")
    return out.withColumn("new_id", F.concat_ws("_", "chrom", "_n")).drop("_n")


def fill_manifest(df: DataFrame, column: str, prefix: str, suffix: str, key: str) -> DataFrame:
    """Blank cells get prefix + key + suffix."""
    return df.withColumn(column, F.coalesce(F.when(F.trim(column) != "", F.col(column)), F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(suffix))))


def with_coverage(manifest: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """coverage (key, coverage) as text, 'NA' where absent."""
    return manifest.join(coverage.select(key, F.col("coverage").cast("string").alias("coverage")), key, "left").withColumn("coverage", F.coalesce("coverage", F.lit("NA")))


def sites_only(df: DataFrame) -> DataFrame:
    """Genotypes give way to one 0/1 for each site."""
    return df.select("chrom", "pos", "id", "ref", "alt", F.lit("0/1").alias("gt")).distinct()


def copy_fields(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target's map column `fields` with the source's fields that it lacks, matched by key (never by row order)."""
    extra = source.select(*keys, F.col("fields").alias("_source"))
    own = F.col("fields")
    added = F.map_filter(F.coalesce("_source", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
    return target.join(extra, keys, "left").withColumn("fields", F.map_concat(own, added)).drop("_source")


def set_genotypes(gt: Column, mode: str) -> Column:
    """'carrier': cells without an alternative allele become 0/1; 'reference': missing ones become 0; 'all': all are 0/1."""
    if mode == "all":
        return F.lit("0/1")
    if mode == "carrier":
        return F.when(G.n_alts(gt) == 0, "0/1").otherwise(gt)
    return F.when(G.is_missing(gt), F.regexp_replace(gt, "\\.", "0")).otherwise(gt)


def caller_table(df: DataFrame, caller: str, fields: list[str]) -> DataFrame:
    """Rows whose id names the caller, with the given INFO fields as number columns (absent: -1)."""
    return df.where(F.col("id").contains(caller)).select("id", *[F.coalesce(info_field(F.col("info"), k).try_cast("double"), F.lit(-1.0)).alias(k.lower()) for k in fields])


def split_remapped(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(duplications, insertions) by remap class: 'tandem...' are duplications, 'partial' with a hit inside the record's
    length are both, the rest stay insertions. df: class, hit_distance, svlen."""
    tandem = F.col("class").startswith("tandem")
    both = (F.col("class") == "partial") & (F.col("hit_distance") <= F.col("svlen"))
    return df.where(tandem | both), df.where(~tandem)


def assign_genotypes(df: DataFrame) -> DataFrame:
    """new_gt, gq and p_ref's phred from posteriors (p0, p1, p2) of each cell: the likeliest class; a het keeps its phase if it was
    het; haploid cells get one allele; cells without reads keep their genotype."""
    best = F.greatest("p0", "p1", "p2")
    called = F.when(F.col("p0") == best, 0).when(F.col("p1") == best, 1).otherwise(2)
    old = F.col("gt")
    phased_het = G.is_het(old) & old.contains("|")
    diploid = F.when(called == 0, "0/0").when((called == 1) & phased_het, old).when(called == 1, "0/1").otherwise("1/1")
    haploid = F.when(called == 0, "0").otherwise("1")
    floor = F.lit(1e-10)
    logs = F.array(*[F.log10(F.greatest(F.col(p), floor)) for p in ("p0", "p1", "p2")])
    return df.withColumns(
        {
            "new_gt": F.when(F.col("depth") == 0, old).when(G.is_diploid(old), diploid).otherwise(haploid),
            "new_gq": G.genotype_quality(logs),
            "new_sq": G.reference_phred(F.col("p0")),
        }
    )


def info_to_format(cells: DataFrame, sites: DataFrame, names: list[str]) -> DataFrame:
    """cells (chrom, pos, ref, alt, and fields, a map) with the named INFO values of their site as fields: they replace fields
    of their name, and values that the site lacks ('.' or no such field) add none. Cells without a site stay."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), info_field(F.col("info"), n).alias("value")) for n in names])
    there = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "."))
    keys = ["chrom", "pos", "ref", "alt"]
    known = sites.groupBy(*keys).agg(F.min("info").alias("info")).select(*keys, F.map_from_entries(there).alias("_site"))
    joined = cells.join(known, keys, "left")
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter("fields", lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce("_site", none), k), F.lit(False)))
    return joined.withColumn("fields", F.map_concat(kept, F.coalesce("_site", none))).select(*cells.columns)
