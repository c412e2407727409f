"""Schemas of the tables that the operators read and write. Positions: pos is 1-based, start and end 0-based half-open."""

VARIANTS = "chrom string, pos int, id string, ref string, alt string, qual double, filter string, info string"
INTERVALS = "chrom string, start int, end int, name string"
CONTIGS = "chrom string, length int, rank int"
GENOTYPES = (
    "variant_id string, sample_id string, gt string, ft string, sq int, gq int, ps string, ne int, dp int, "
    "ad_ref int, ad_alt int, ks1 int, ks2 int"
)
ALIGNMENTS = "read_id string, flag int, chrom string, pos int, mapq int, cigar string, seq string"
CLIPS = "record_id string, side int, read_id string, is_rc boolean, read_pos int, read_len int"
DEPTH = "chrom string, pos int, depth int"
BIN_COVERAGE = "chrom string, start int, end int, bin_key string, cov double"
BREAKPOINTS = "chrom string, pos int, other_chrom string, other_pos int, type int"
PEDIGREE = "family string, child bigint, father bigint, mother bigint"
COVERAGE = "id bigint, coverage double, sex string"
CHUNKS = "chrom string, start int, end int, n int"
