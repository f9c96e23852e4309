"""Plans on gene coordinates: start-site windows, splice sites, track summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import num, seq
from ..models.specs import REGULATORY_WINDOWS, SPLICE_CONTEXT, SPLICE_RADIUS, STANDARD_CHROMOSOMES
from ..operators import vectors
from ..operators.ranges import with_neighbours
from ..session import materialize
from ..sources.splits import read_fasta_tiles

PROFILE_GROUPS = tuple(f"{sites}_sites_{channel}_profile" for sites in ("all", "donor", "acceptor")
                       for channel in ("acceptor", "donor"))


def standard_protein_coding(master: DataFrame) -> DataFrame:
    return master.where((F.col("gene_type") == "protein_coding") & (F.col("assembly") == "GRCh38")
                        & F.col("chromosome").isin(*STANDARD_CHROMOSOMES))


def start_sites(master: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Master rows with ``tss_1based``, ``tss_0based``, ``chrom_length`` and a ``tss_status``.

    ``chromosomes`` is ``[chromosome, chrom_length]``, one row per chromosome.
    """
    lo, hi = seq.coordinate("gene_start"), seq.coordinate("gene_end")
    out = master.join(chromosomes.select("chromosome", "chrom_length"), "chromosome", "left")
    out = out.withColumn("tss_status", seq.tss_status("chrom_length", lo, hi, "strand"))
    tss = F.when(F.col("tss_status") == "ok", seq.tss_1based("strand", lo, hi))
    return out.withColumn("tss_1based", tss).withColumn("tss_0based", tss - 1)


def bounded_windows(sites: DataFrame, half: int = 500) -> DataFrame:
    """0-based half-open windows around the start site; out-of-bounds ones keep a status only."""
    a, b = F.col("tss_0based") - half, F.col("tss_0based") + half
    inside = (a >= 0) & (b <= F.col("chrom_length"))
    status = F.when(F.col("tss_status") != "ok", F.col("tss_status")).when(inside, F.lit("ok")).otherwise(F.lit("window_out_of_bounds"))
    return (sites.withColumn("window_status", status)
            .withColumn("window_start", F.when(status == "ok", a)).withColumn("window_stop", F.when(status == "ok", b)))


def bed3(windows: DataFrame) -> DataFrame:
    return windows.where("window_status = 'ok'").select(F.concat_ws(
        "\t", "chromosome", F.col("window_start").cast("string"), F.col("window_stop").cast("string")).alias("value"))


# Chromosome sequences are cut into tiles of this many bases, so that a window
# join moves a few tiles per gene instead of a whole chromosome.
TILE = 1 << 16


def chromosome_tiles(records: DataFrame, tile: int = TILE) -> DataFrame:
    """``[chromosome, tile_no, bases, chrom_length]`` from ``[chromosome, sequence]``."""
    return records.select("chromosome", F.length("sequence").alias("chrom_length"),
                          F.posexplode(seq.chunks("sequence", tile)).alias("tile_no", "bases"))


def tiles_from_fasta(spark, path, tile: int = TILE) -> DataFrame:
    """``[chromosome, tile_no, bases, chrom_length]`` of FASTA files, put together once; the longest sequence is read by many tasks and is never one row."""
    records, tiles = read_fasta_tiles(spark, path, tile)
    named = records.select("file", "record", F.col("record_id").alias("chromosome"), F.col("length").alias("chrom_length"))
    return materialize(tiles.join(named, ["file", "record"]).select("chromosome", F.col("tile_no").cast("int").alias("tile_no"), "bases", "chrom_length"), "tiles")


def genome_windows(sites: DataFrame, key: str, tiles: DataFrame, start: str, stop: str, tile: int = TILE) -> DataFrame:
    """``[key, sequence]``: the bases of ``[start, stop)``, padded with N beyond the chromosome.

    ``sites`` needs ``chromosome`` and ``chrom_length``. Each window asks for the
    tiles it touches (an equi-join) and is put together from its few pieces.
    """
    lo = F.greatest(F.col(start), F.lit(0))
    hi = F.least(F.col(stop), F.col("chrom_length").cast("bigint"))
    first, last = F.floor(lo / tile), F.floor((hi - 1) / tile)
    asked = sites.where(hi > lo).select(key, "chromosome", F.col(start).alias("_a"), F.col(stop).alias("_b"), "chrom_length",
                                        F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("tile_no"))
    hits = asked.join(tiles.select("chromosome", "tile_no", "bases"), ["chromosome", "tile_no"])
    t0 = F.col("tile_no").cast("bigint") * tile
    piece = F.substring("bases", (F.greatest(F.col("_a") - t0, F.lit(0)) + 1).cast("int"),
                        (F.least(F.col("_b") - t0, F.lit(tile)) - F.greatest(F.col("_a") - t0, F.lit(0))).cast("int"))
    body = hits.groupBy(key).agg(
        F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.first("chrom_length").alias("_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile_no", piece.alias("p")))), lambda s: s["p"]), "").alias("_s"))
    return body.select(key, F.concat(
        F.repeat(F.lit("N"), F.greatest(-F.col("_a"), F.lit(0)).cast("int")), F.upper("_s"),
        F.repeat(F.lit("N"), F.greatest(F.col("_b") - F.col("_n"), F.lit(0)).cast("int"))).alias("sequence"))


def splice_sites(exons: DataFrame, transcript: str) -> DataFrame:
    """``[transcript, strand, site_type, site_1based]`` from distinct exons ``start, stop, strand``.

    On ``+`` a donor is the end of every exon but the last and an acceptor the
    start of every exon but the first; ``-`` mirrors both.
    """
    near = with_neighbours(exons, [transcript], ["start", "stop"], ["start"])
    plus = F.col("strand") == "+"
    has_next, has_prev = F.col("next_start").isNotNull(), F.col("prev_start").isNotNull()
    donor = F.when(plus & has_next, F.col("stop")).when(~plus & has_prev, F.col("start"))
    acceptor = F.when(plus & has_prev, F.col("start")).when(~plus & has_next, F.col("stop"))
    return (near.where(F.col("strand").isin("+", "-"))
            .select(transcript, "strand", F.explode(F.array(
                F.struct(F.lit("donor").alias("site_type"), donor.alias("site_1based")),
                F.struct(F.lit("acceptor").alias("site_type"), acceptor.alias("site_1based")))).alias("s"))
            .select(transcript, "strand", "s.site_type", "s.site_1based").where("site_1based IS NOT NULL"))


def canonical_splice_sites(master: DataFrame, exons: DataFrame, chromosomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gene table with a site status and the site table of all canonical transcripts.

    ``exons`` is ``[transcript_id, chromosome, start, stop, strand, exon_number]`` as scanned.
    """
    keyed = exons.select(
        F.explode(F.array_distinct(F.array("transcript_id", F.substring_index("transcript_id", ".", 1)))).alias("key"),
        F.col("chromosome").alias("exon_chromosome"), "start", "stop", "exon_number").distinct()
    names = keyed.select("key").distinct()
    genes = master.join(chromosomes.select("chromosome", F.lit(True).alias("_known")), "chromosome", "left")
    asked = genes.select("ensembl_gene_id", F.posexplode(F.array(
        F.trim("canonical_transcript_id_versioned"), F.trim("canonical_transcript_id"))).alias("_p", "key")).where("key <> ''")
    chosen = asked.join(names, "key").groupBy("ensembl_gene_id").agg(F.min_by("key", "_p").alias("key"))
    exon_rows = (genes.select("ensembl_gene_id", "chromosome", "strand").join(chosen, "ensembl_gene_id")
                 .join(keyed, "key").where("exon_chromosome = chromosome")
                 .select("ensembl_gene_id", "strand", "start", "stop", "exon_number").distinct())
    counts = exon_rows.groupBy("ensembl_gene_id").agg(F.count(F.lit(1)).alias("n_exons"))
    status = (F.when(F.col("_known").isNull(), F.lit("chromosome_not_in_fasta"))
              .when(F.col("key").isNull(), F.lit("canonical_transcript_exons_not_found"))
              .when(F.coalesce("n_exons", F.lit(0)) < 2, F.lit("single_exon_or_no_junctions"))
              .when(~F.col("strand").isin("+", "-"), F.lit("invalid_strand")).otherwise(F.lit("ok")))
    state = (genes.join(chosen, "ensembl_gene_id", "left").join(counts, "ensembl_gene_id", "left")
             .withColumn("site_status", status))
    state = materialize(state, "site_state")
    usable = exon_rows.join(state.where("site_status = 'ok'").select("ensembl_gene_id"), "ensembl_gene_id", "left_semi")
    sites = splice_sites(usable.select("ensembl_gene_id", "strand", "start", "stop", "exon_number"), "ensembl_gene_id")
    sites = sites.withColumn("site_0based", F.col("site_1based") - 1).join(
        master.select("ensembl_gene_id", "chromosome"), "ensembl_gene_id")
    per_gene = sites.groupBy("ensembl_gene_id").agg(
        F.count(F.lit(1)).alias("n_splice_sites"), F.count_if(F.col("site_type") == "donor").alias("n_donor_sites"),
        F.count_if(F.col("site_type") == "acceptor").alias("n_acceptor_sites"))
    table = state.drop("_known", "key", "n_exons").join(per_gene, "ensembl_gene_id", "left").fillna(
        0, ["n_splice_sites", "n_donor_sites", "n_acceptor_sites"])
    return table, sites


def splice_input_bounds(sites: DataFrame) -> DataFrame:
    flank = SPLICE_RADIUS + SPLICE_CONTEXT // 2
    return (sites.withColumn("input_start", F.col("site_0based") - flank)
            .withColumn("input_stop", F.col("site_0based") + flank + 1))


def site_profiles(predictions: DataFrame, gene: str, width: int) -> DataFrame:
    """Average acceptor and donor channel over all, donor and acceptor sites of a gene.

    ``predictions`` is ``[gene, site_type, model, acceptor, donor]`` with array
    channels. Models are averaged by the same mean, since every site has each
    model once. The result is the six averages appended; absent site types give zeros.
    """
    by_type = predictions.groupBy(gene, "site_type").agg(
        vectors.sum_of("acceptor").alias("acceptor"), vectors.sum_of("donor").alias("donor"), F.count(F.lit(1)).alias("n"))
    def pick(kind, channel):
        return F.first(F.when(F.col("site_type") == kind, F.struct(F.col(channel).alias("v"), "n")), ignorenulls=True)

    wide = by_type.groupBy(gene).agg(*[pick(k, c).alias(f"{k}_{c}") for k in ("donor", "acceptor") for c in ("acceptor", "donor")])
    zeros = F.array_repeat(F.lit(0.0), width)

    def mean(col):
        return F.coalesce(F.transform(F.col(col)["v"], lambda x: x / F.col(col)["n"]), zeros)

    def both(channel):
        d, a = F.col(f"donor_{channel}"), F.col(f"acceptor_{channel}")
        n = F.coalesce(d["n"], F.lit(0)) + F.coalesce(a["n"], F.lit(0))
        return F.zip_with(F.coalesce(d["v"], zeros), F.coalesce(a["v"], zeros), lambda x, y: (x + y) / n)

    return wide.select(gene, F.concat(
        both("acceptor"), both("donor"), mean("donor_acceptor"), mean("donor_donor"),
        mean("acceptor_acceptor"), mean("acceptor_donor")).alias("vector"))


def half_bins(width: int, resolution: int) -> int:
    """Bins on each side of the centre; Python and the source both round half to even."""
    return max(1, round((width / 2) / resolution))


def window_features(tracks: DataFrame, gene: str, bins: int, resolution: int) -> DataFrame:
    """``[gene, track, summary_stat, value]`` of regulatory track summaries.

    ``tracks`` is long ``[gene, track, bin, value]``; NaN bins are ignored and the
    summaries are compressed with a signed log.
    """
    centre = bins // 2
    v = F.when(~F.isnan("value"), F.col("value"))
    aggs = []
    for name, width, op in REGULATORY_WINDOWS:
        if width is None:
            inside = F.lit(True)
        else:
            half = half_bins(width, resolution)
            inside = F.col("bin").between(max(0, centre - half), min(bins, centre + half) - 1)
        agg = F.max if op == "max" else F.avg
        aggs.append(agg(F.when(inside, v)).alias(name))
    names = [w[0] for w in REGULATORY_WINDOWS]
    return (tracks.groupBy(gene, "track").agg(*aggs).unpivot([gene, "track"], names, "summary_stat", "value")
            .withColumn("value", num.signed_log1p("value")))


def window_summaries(vector, bins: int, resolution: int) -> Column:
    """Array of ``(summary_stat, value)`` of one track held as an array of bins; the row-local form of :func:`window_features`."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    centre, out = bins // 2, []
    for name, width, op in REGULATORY_WINDOWS:
        lo, hi = 0, bins
        if width is not None:
            half = half_bins(width, resolution)
            lo, hi = max(0, centre - half), min(bins, centre + half)
        kept = F.filter(F.slice(v, lo + 1, hi - lo), lambda x: ~F.isnan(x))
        value = F.array_max(kept) if op == "max" else mean_of_values(kept)
        out.append(F.struct(F.lit(name).alias("summary_stat"), num.signed_log1p(value).alias("value")))
    return F.array(*out)


def mean_of_values(values: Column) -> Column:
    """Mean of an array, NULL if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def central_bins(vector, bins: int) -> Column:
    """Mean of the three central bins of one track held as an array; the row-local form of :func:`central_bins_mean`."""
    return mean_of_values(F.transform(F.slice(F.col(vector), bins // 2, 3), lambda x: x.cast("double")))


def central_bins_mean(tracks: DataFrame, gene: str, bins: int) -> DataFrame:
    """``[gene, track, value]``: mean of the three central bins."""
    centre = bins // 2
    return tracks.where(F.col("bin").between(centre - 1, centre + 1)).groupBy(gene, "track").agg(F.avg("value").alias("value"))


def log_zscore_tracks(vectors_df: DataFrame, vector: str = "vector") -> DataFrame:
    logged = vectors_df.withColumn(vector, F.transform(vector, lambda x: F.log1p(x)))
    return vectors.zscore(logged, vector, dtype="float")
