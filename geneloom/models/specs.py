"""Fixed inference parameters of the model families.

``cut`` names the piece rule, ``pool`` how pieces become one vector:
``token_sum`` divides the sum of all token vectors by the number of tokens,
``piece_length`` averages piece means weighted by piece length.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class InferenceSpec:
    name: str
    cut: str                 # whole | fixed | min_tail | window | token_bound | words
    size: int = 0            # letters, or words, per piece
    min_tail: int = 0
    max_tokens: int = 0
    pool: str = "token_sum"
    batch: int = 16
    min_piece: int = 0       # smallest piece when memory runs out
    full_length_up_to: int = 0


# Piece sizes, token limits and batch sizes per model family.
SPECS = {s.name: s for s in (
    InferenceSpec("text_bert", "words", size=256, max_tokens=512, pool="token_sum", batch=16),
    InferenceSpec("nucleotide_transformer", "fixed", size=6000, pool="token_sum", batch=1, min_piece=750),
    InferenceSpec("dna_bert2", "token_bound", size=1600, max_tokens=512, pool="piece_length", batch=1),
    InferenceSpec("hyena_dna", "fixed", size=12000, pool="token_sum", batch=1, min_piece=1000),
    InferenceSpec("rna_fm", "min_tail", size=1000, min_tail=200, pool="piece_length", batch=4),
    InferenceSpec("helix_mrna", "fixed", size=12000, pool="token_sum", batch=1),
    InferenceSpec("orthrus", "fixed", size=50000, pool="piece_length", batch=1, full_length_up_to=50000),
    InferenceSpec("msa_transformer", "window", size=1022, pool="piece_length", batch=1),
)}

# Track models. Bins and tracks of the output, input length in bases.
TRACK_BINS, TRACK_COUNT = 896, 5313
BASENJI_LENGTH, ENFORMER_LENGTH = 131_072, 393_216
SPLICE_CONTEXT, SPLICE_RADIUS, SPLICE_MODELS = 10_000, 50, 5
DEEPSEA_WIDTH, DEEPSEA_FEATURES = 1000, 919
# Regulatory summaries as (name, width in bases or None for all, operation).
REGULATORY_WINDOWS = (
    ("central_1kb_mean", 1_000, "mean"),
    ("central_10kb_mean", 10_000, "mean"),
    ("central_100kb_mean", 100_000, "mean"),
    ("full_1mb_mean", None, "mean"),
    ("central_10kb_max", 10_000, "max"),
)
REGULATORY_OUTPUTS = ("CAGE", "RNA_SEQ", "DNASE", "ATAC", "CHIP_HISTONE", "CHIP_TF", "PROCAP")
# Names of the standard chromosomes.
STANDARD_CHROMOSOMES = tuple([f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY"])
