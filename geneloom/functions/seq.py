"""Sequence functions: ``Column -> Column`` on DNA, RNA and protein strings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import _col

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWYX"  # fixed value: 20 residues and X


def clean_dna(c) -> Column:
    return F.regexp_replace(F.translate(F.upper(_col(c)), "U", "T"), "[^ACGTN]", "N")


def dna_to_rna(c) -> Column:
    return F.translate(clean_dna(c), "T", "U")


def clean_rna(c) -> Column:
    """Upper case, blanks and codon markers removed, T -> U."""
    return F.translate(F.upper(_col(c)), "T \n\rE", "U")


def valid_rna(c) -> Column:
    return _col(c).rlike("^[ACGUN]+$")


def clean_marked_rna(c) -> Column:
    """RNA that may carry the codon marker ``E``."""
    return F.regexp_replace(F.translate(F.upper(_col(c)), "T", "U"), "[^ACGUNE]", "N")


def codon_markers(c) -> Column:
    """Put ``E`` before each 3-mer; the last one may be short."""
    return F.regexp_replace(_col(c), "(.{1,3})", "E$1")


def reverse_complement(c) -> Column:
    return F.upper(F.reverse(F.translate(_col(c), "ACGTacgt", "TGCAtgca")))


def clean_protein(c) -> Column:
    return F.regexp_replace(F.upper(_col(c)), f"[^{AMINO_ACIDS}]", "X")


def one_hot_dna(c) -> Column:
    """``array<array<float>>`` of shape (L, 4); N gives zeros.

    For short windows. Long model inputs are encoded inside the inference task
    with :func:`one_hot_numpy`, so the L x 4 array never becomes a column.
    """
    letters = F.filter(F.split(F.upper(_col(c)), ""), lambda x: x != "")
    return F.transform(letters, lambda x: F.array(*[(x == b).cast("int").cast("float") for b in "ACGT"]))


def one_hot_numpy(seq: str, channels_first: bool = False) -> np.ndarray:
    codes = np.frombuffer(seq.upper().encode("ascii"), dtype=np.uint8)
    hot = (codes[:, None] == np.frombuffer(b"ACGT", dtype=np.uint8)[None, :]).astype(np.float32)
    return np.ascontiguousarray(hot.T) if channels_first else hot


def chunks(c, size: int) -> Column:
    """Fixed-size pieces, the last one short; empty text gives no piece.

    One regular-expression pass over the text, so the cost is linear however
    long the sequence is.
    """
    return F.regexp_extract_all(_col(c), F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def chunks_min_tail(c, size: int, min_tail: int) -> Column:
    """As :func:`chunks`, but a tail shorter than ``min_tail`` joins its neighbour.

    A full piece is cut only while at least ``min_tail`` letters follow it.
    """
    return F.regexp_extract_all(_col(c), F.lit(f"(?s)(.{{{size}}}(?=.{{{min_tail}}})|.+)"), F.lit(1))


def windows(c, size: int) -> Column:
    """``array<struct(start, stop, piece)>``, 0-based half-open; one window if it fits."""
    pieces = F.when(F.length(_col(c)) == 0, F.array(F.lit(""))).otherwise(chunks(c, size))
    return F.transform(pieces, lambda p, i: F.struct(
        (i * size).alias("start"), (i * size + F.length(p)).alias("stop"), p.alias("piece")))


def locate_cds(cdna, cds) -> Column:
    """``struct(start0, stop0, status)``: first hit of the CDS inside the cDNA."""
    cdna, cds = _col(cdna), _col(cds)
    hit = F.position(cds, cdna)
    again = F.position(cds, cdna, hit + 1)
    status = (F.when(F.coalesce(cdna, F.lit("")) == "", F.lit("missing_cdna_sequence"))
              .when(F.coalesce(cds, F.lit("")) == "", F.lit("missing_cds_sequence"))
              .when(hit == 0, F.lit("cds_not_found_inside_cdna"))
              .when(again > 0, F.lit("mapped_cds_multiple_hits_used_first"))
              .otherwise(F.lit("mapped")))
    mapped = status.startswith("mapped")
    start0 = F.when(mapped, hit - 1).otherwise(F.lit(-1))
    stop0 = F.when(mapped, hit - 1 + F.length(cds)).otherwise(F.lit(-1))
    return F.struct(start0.cast("bigint").alias("start0"), stop0.cast("bigint").alias("stop0"),
                    status.alias("status"))


def marked_transcript(cdna, start0, stop0) -> Column:
    """UTR5 + codon-marked CDS + UTR3 as RNA."""
    rna, start0, stop0 = dna_to_rna(cdna), _col(start0), _col(stop0)
    return F.concat(
        F.substring(rna, F.lit(1), start0.cast("int")),
        codon_markers(F.substring(rna, (start0 + 1).cast("int"), (stop0 - start0).cast("int"))),
        F.substring(rna, (stop0 + 1).cast("int"), F.length(rna)))


def tss_1based(strand, start, end) -> Column:
    """Gene start on ``+``, gene end on ``-``, NULL on any other strand."""
    strand = _col(strand)
    return F.when(strand == "+", _col(start)).when(strand == "-", _col(end))


def coordinate(c) -> Column:
    """Integer coordinate from text such as ``100`` or ``100.0``; NULL if invalid."""
    from .ids import to_number

    return to_number(c).try_cast("bigint")


def tss_status(chrom_length, start, end, strand) -> Column:
    return (F.when(_col(chrom_length).isNull(), F.lit("chromosome_not_in_fasta"))
            .when(_col(start).isNull() | _col(end).isNull(), F.lit("invalid_coordinates"))
            .when(~F.coalesce(_col(strand), F.lit("")).isin("+", "-"), F.lit("invalid_strand"))
            .otherwise(F.lit("ok")))


def padded_slice(seq, start0, stop0, length=None) -> Column:
    """``[start0, stop0)`` of a sequence, clipped and padded with N on both sides."""
    seq, start0, stop0 = _col(seq), _col(start0), _col(stop0)
    total = F.length(seq) if length is None else _col(length)
    lo = F.least(F.greatest(start0, F.lit(0)), total)
    hi = F.greatest(F.least(stop0, total), lo)
    left = F.greatest(F.least(F.lit(0), stop0) - start0, F.lit(0))
    right = F.greatest(stop0 - F.greatest(total.cast("bigint"), start0), F.lit(0))
    return F.concat(
        F.repeat(F.lit("N"), left.cast("int")),
        F.upper(F.substring(seq, (lo + 1).cast("int"), (hi - lo).cast("int"))),
        F.repeat(F.lit("N"), right.cast("int")))


def centered_slice(seq, center0, size: int) -> Column:
    start = _col(center0) - F.lit(size // 2)
    return padded_slice(seq, start, start + F.lit(size))
