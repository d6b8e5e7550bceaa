"""Canonical schemas. Coordinates are 0-based and half-open."""

BLOCKS = "array<struct<l:int,r:int>>"
READS = f"chrom string, left int, right int, strand tinyint, ranges {BLOCKS}, splice array<boolean>, s_tag boolean, e_tag boolean, capped boolean, condensed boolean, source string, weight double, s_weight double, e_weight double, elcigar string"
TRANSCRIPTS = f"{READS}, transcript_id string, gene_id string, is_reference boolean, attributes map<string,string>"
JUNCTIONS = "chrom string, start int, end int, strand string, motif int, annotated boolean, uniq bigint, multi bigint, overhang int, name string"
FASTQ = "name string, seq1 string, plus1 string, qual1 string, seq2 string, plus2 string, qual2 string"
SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
GENOME = "chrom string, seq string"
BEDGRAPH = "chrom string, start int, end int, value double"
