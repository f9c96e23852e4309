"""Identifier and string functions: ``Column -> Column``, all JVM-side."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as "missing" under each cleaning policy.
MISSING_ANY_CASE_WITH_NULL = ("", "nan", "none", "null", "na")
MISSING_ANY_CASE = ("", "nan", "none", "na")
MISSING_EXACT = ("", "nan", "NaN", "None", "NONE")
# Default NA spellings of a header CSV read as text.
CSV_NA_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Tokens that never name a gene in a model vocabulary.
SPECIAL_TOKENS = ("[PAD]", "[CLS]", "[SEP]", "[MASK]", "[UNK]")
# Source labels under which STRING aliases carry Entrez ids.
ENTREZ_ALIAS_SOURCES = ("geneid", "entrez", "hgnc_entrez", "kegg_geneid")

WHITESPACE = " \t\n\r\x0b\x0c"
ANY_SEPARATOR = r"[|,;\s]+"
SYMBOL_SEPARATOR = r"[|,;]+"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def clean(c, policy: str = "exact") -> Column:
    """Trim, then turn the policy's missing spellings (and NULL) into ``''``."""
    s = strip(F.coalesce(_col(c), F.lit("")))
    if policy == "trim":
        return s
    if policy == "exact":
        return F.when(s.isin(*MISSING_EXACT), F.lit("")).otherwise(s)
    words = {"any_case": MISSING_ANY_CASE, "any_case_null": MISSING_ANY_CASE_WITH_NULL}[policy]
    return F.when(F.lower(s).isin(*words), F.lit("")).otherwise(s)


def na_to_empty(c) -> Column:
    """Apply the CSV reader's NA spellings: NULL and NA words become ``''``."""
    c = _col(c)
    return F.when(c.isNull() | c.isin(*CSV_NA_SPELLINGS), F.lit("")).otherwise(c)


def strip_version(c, policy: str = "exact") -> Column:
    """Text before the first dot."""
    return F.substring_index(clean(c, policy), ".", 1)


def strip_version_suffix(c) -> Column:
    """Drop only a trailing ``.<digits>``; ``ENSG1.2_PAR_Y`` stays whole."""
    return F.regexp_replace(_col(c), r"\.\d+$", "")


def norm_symbol(c, policy: str = "exact") -> Column:
    return F.upper(clean(c, policy))


def to_number(c) -> Column:
    """Parse a number or give NULL; never raises, never accepts ``1d`` style text."""
    s = strip(_col(c).cast("string"))
    finite = F.when(s.rlike(NUMBER), s.try_cast("double"))
    infinite = F.when(s.rlike(r"(?i)^[+-]?inf(inity)?$"),
                      F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.coalesce(finite, infinite)


def norm_entrez(c, policy: str = "exact") -> Column:
    """``7157.0`` -> ``7157``; text that is no number is kept as it is."""
    s = clean(c, policy)
    as_int = F.when(s.rlike(NUMBER), s.try_cast("double")).try_cast("bigint").cast("string")
    return F.when(s == "", F.lit("")).otherwise(F.coalesce(as_int, s))


def norm_entrez_strict(c) -> Column:
    """As :func:`norm_entrez`, but only for plain digits with an optional ``.0``."""
    s = clean(c, "any_case")
    digits = F.regexp_extract(s, r"^(\d+)(\.0)?$", 1)
    return F.when(digits != "", F.coalesce(digits.try_cast("bigint").cast("string"), digits)).otherwise(s)


def clean_entrez(c) -> Column:
    """Digits only (a ``.0`` tail is dropped), anything else becomes ``''``."""
    return F.regexp_extract(strip(F.coalesce(_col(c).cast("string"), F.lit(""))), r"^(\d+)(\.0)?$", 1)


INHIBITORY = "(?i)^inhib_"
METHOD_ENTREZ = "entrez_id_exact_unique"
METHOD_ENTREZ_INHIBITORY = "entrez_id_exact_unique_from_inhibitory_augmented_token"


def component_token_id(c) -> Column:
    return clean_entrez(F.regexp_replace(strip(c), INHIBITORY, ""))


def component_token_method(c) -> Column:
    return F.when(strip(c).rlike(INHIBITORY), F.lit(METHOD_ENTREZ_INHIBITORY)).otherwise(F.lit(METHOD_ENTREZ))


def extract_entrez_ids(c) -> Column:
    """All isolated digit runs, ``.0`` tails removed, ``0`` dropped, order kept."""
    s = clean(c, "any_case")
    s = F.regexp_replace(s, r"(\d+)\.0(?=$|[\s,;|])", "$1")
    runs = F.regexp_extract_all(s, F.lit(r"(?<![A-Za-z0-9])(\d+)(?![A-Za-z0-9])"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda x: x != "0"))


def extract_digit_runs(c) -> Column:
    """Every digit run; ``7157.0`` yields both ``7157`` and ``0``."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(\d+)"), F.lit(1))


def canonical_uniprot(c, last_pipe_field: bool = False) -> Column:
    s = clean(c, "any_case")
    if last_pipe_field:
        s = F.substring_index(s, "|", -1)
    return F.upper(F.substring_index(s, "-", 1))


def base_accession(c) -> Column:
    return F.substring_index(strip(c), "-", 1)


def fasta_accession(c) -> Column:
    """Second pipe field of ``sp|P1|NAME``, else the first word."""
    c = _col(c)
    return F.when(c.contains("|"), strip(F.split_part(c, F.lit("|"), F.lit(2)))).otherwise(
        F.substring_index(strip(c), " ", 1))


def clean_ensp(c) -> Column:
    return F.regexp_extract(strip(F.coalesce(_col(c), F.lit(""))), r"^(?:9606\.)?(ENSP\d+)(?:\.\d+)?$", 1)


def versioned_id(base, version) -> Column:
    b, v = clean(base), clean(version)
    return F.when(b == "", F.lit("")).when(v == "", b).otherwise(F.concat(b, F.lit("."), v))


def split_tokens(c, pattern: str = ANY_SEPARATOR, policy: str = "any_case") -> Column:
    """Split a multi-valued cell; missing cells give an empty array."""
    s = clean(c, policy)
    trimmed = F.transform(F.split(s, pattern), lambda t: clean(t, "trim" if policy == "trim" else policy))
    return F.filter(trimmed, lambda t: t != "")


def split_pipe(c, policy: str = "exact") -> Column:
    return split_tokens(c, r"\|", policy)


def split_semicolon(c) -> Column:
    return split_tokens(c, ";", "trim")


def split_ids_any(c) -> Column:
    """Split on pipe, comma, semicolon or blank under the widest missing policy."""
    return F.filter(F.transform(F.split(clean(c, "any_case_null"), r"[|,; ]"), strip), lambda t: t != "")


def join_unique(arr, sep: str = "|", policy: str = "exact") -> Column:
    """Sorted, distinct, non-missing values joined by ``sep``."""
    kept = F.filter(F.transform(_col(arr), lambda t: clean(t, policy)), lambda t: t != "")
    return F.array_join(F.array_sort(F.array_distinct(kept)), sep)


def unique_keep_order(arr) -> Column:
    return F.array_distinct(F.filter(F.transform(_col(arr), strip), lambda t: t != ""))


def json_leaves(c) -> Column:
    """Flatten scalar / list / object JSON of any depth to an array of strings.

    The JSON text is tokenised with one regular expression; object keys are the
    tokens that end in a colon, the rest are leaves.
    """
    tokens = F.regexp_extract_all(
        F.coalesce(_col(c), F.lit("")),
        F.lit(r'("(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|true|false)'),
        F.lit(1),
    )
    leaves = F.filter(tokens, lambda t: ~t.endswith(":"))
    leaves = F.transform(leaves, lambda t: F.when(t == "true", F.lit('"True"'))
                         .when(t == "false", F.lit('"False"')).otherwise(t))
    return F.from_json(F.concat(F.lit("["), F.array_join(leaves, ","), F.lit("]")), "array<string>")


def hit_uniprot(hit) -> Column:
    """``struct(ids, status)`` preferring reviewed, then unreviewed, then other ids."""
    hit = _col(hit)
    uni = F.get_json_object(hit, "$.uniprot")
    empty = F.array().cast("array<string>")

    def leaves(v):
        # a bare scalar has lost its quotes on extraction
        return (F.when(v.isNull(), empty).when(v.startswith("[") | v.startswith("{"), json_leaves(v)).otherwise(F.array(v)))

    fields = F.from_json(F.when(uni.startswith("{"), uni), "map<string,string>")
    reviewed = F.coalesce(leaves(fields["Swiss-Prot"]), empty)
    unreviewed = F.coalesce(leaves(fields["TrEMBL"]), empty)
    rest = F.map_values(F.map_filter(fields, lambda k, v: ~k.isin("Swiss-Prot", "TrEMBL")))
    other = F.coalesce(F.when(~uni.startswith("{"), leaves(uni)), F.flatten(F.transform(rest, leaves)), empty)

    def pick(arr, status):
        return F.struct(F.array_join(unique_keep_order(arr), "|").alias("ids"), F.lit(status).alias("status"))

    return (F.when(F.size(reviewed) > 0, pick(reviewed, "mapped_reviewed_swissprot"))
            .when(F.size(unreviewed) > 0, pick(unreviewed, "mapped_unreviewed_trembl"))
            .when(F.size(other) > 0, pick(other, "mapped_other"))
            .otherwise(F.struct(F.lit("").alias("ids"), F.lit("missing").alias("status"))))


def hit_matches_query(hit, query) -> Column:
    """True if any ``ensembl[].gene`` of the hit equals the query id."""
    entries = F.from_json(F.get_json_object(_col(hit), "$.ensembl"), "array<struct<gene:string>>")
    return F.coalesce(F.exists(entries, lambda e: e["gene"] == _col(query)), F.lit(False))


def mapping_status(exact, entrez, uniprot, uniprot_status) -> Column:
    exact, entrez, uniprot = _col(exact), _col(entrez), _col(uniprot)
    prefix = F.when(exact, F.lit("mapped_exact_ensembl")).otherwise(
        F.lit("mapped_without_exact_ensembl_confirmation"))
    no_e, no_u = entrez == "", uniprot == ""
    return (F.when(no_e & no_u, F.lit("found_but_missing_entrez_and_uniprot"))
            .when(no_e, F.concat_ws("; ", prefix, F.lit("missing_entrez"), _col(uniprot_status)))
            .when(no_u, F.concat_ws("; ", prefix, F.lit("mapped_entrez"), F.lit("missing_uniprot")))
            .otherwise(F.concat_ws("; ", prefix, F.lit("mapped_entrez"), _col(uniprot_status))))


GENE_COLUMN = r"^(.+) \((\d+)\)$"


def gene_column_symbol(c) -> Column:
    return F.regexp_extract(_col(c), GENE_COLUMN, 1)


def gene_column_entrez(c) -> Column:
    return F.regexp_extract(_col(c), GENE_COLUMN, 2)


def concept_key(c) -> Column:
    """``struct(value, status)`` of a concept name such as ``Gene_7157``."""
    c = _col(c)
    rest = F.regexp_replace(c, "^Gene_", "")
    parts = F.filter(F.split(rest, "_"), lambda p: p != "")
    digits = F.forall(parts, lambda p: p.rlike(r"^\d+$"))
    status = (F.when(~c.startswith("Gene_"), F.lit("non_gene"))
              .when((F.size(parts) == 1) & digits, F.lit("single_entrez"))
              .when((F.size(parts) > 1) & digits, F.lit("multi_entrez"))
              .otherwise(F.lit("bad_gene_concept")))
    value = (F.when(status == "non_gene", F.lit(None).cast("string"))
             .when(status == "bad_gene_concept", rest).otherwise(F.array_join(parts, "|")))
    return F.struct(value.alias("value"), status.alias("status"))


def node_kind(c) -> Column:
    s = strip(c)
    return F.when(s.contains("::"), F.substring_index(s, "::", 1)).otherwise(F.lit(""))


def node_local_id(c) -> Column:
    """Text after the first ``::`` only."""
    s = strip(c)
    return F.when(s.contains("::"), F.regexp_replace(s, r"^.*?::", "")).otherwise(s)


def is_gene_node(node_id, kind) -> Column:
    return (strip(kind) == "Gene") | strip(node_id).startswith("Gene::")


def typed_key(*parts) -> Column:
    return F.concat_ws("||", *[strip(F.coalesce(_col(p).cast("string"), F.lit(""))) for p in parts])


def go_token(c) -> Column:
    return F.concat(F.lit("GO_"), F.replace(_col(c), F.lit("GO:"), F.lit("")))


def entity_token(c) -> Column:
    return F.concat(F.lit("UNIPROT_"), canonical_uniprot(c, last_pipe_field=True))


def symbol_token(c) -> Column:
    return F.concat(F.lit("symbol_"), F.lower(F.regexp_replace(_col(c), "[^A-Za-z0-9]+", "_")))


def text_tokens(c) -> Column:
    runs = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(runs, lambda t: F.length(t) >= 2)


def is_special_token(c) -> Column:
    s = strip(c)
    return (s == "") | (s.startswith("<") & s.endswith(">")) | s.isin(*SPECIAL_TOKENS)


def first_existing(*cols) -> Column:
    """First cell that is neither blank nor the word ``nan``, else ``''``."""
    usable = []
    for c in cols:
        s = strip(F.coalesce(_col(c), F.lit("")))
        usable.append(F.when((s != "") & (F.lower(s) != "nan"), s))
    return F.coalesce(*usable, F.lit(""))


def find_gene_id(c) -> Column:
    return F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"(ENSG\d+)", 1)


def find_transcript_id(c) -> Column:
    return F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"(ENST\d+)", 1)


def tokens_with_prefix(c, prefixes: Iterable[str]) -> Column:
    tokens = F.split(clean(c), ANY_SEPARATOR)
    prefixes = list(prefixes)

    def keep(t):
        hit = t.startswith(prefixes[0])
        for p in prefixes[1:]:
            hit = hit | t.startswith(p)
        return hit

    return F.filter(tokens, keep)


REFSEQ_PREFIXES = ("NM_", "NR_", "XM_", "XR_")


def string_protein_ids(arr) -> Column:
    return F.transform(F.filter(_col(arr), lambda p: p.startswith("ENSP")),
                       lambda p: F.concat(F.lit("9606."), p))


def feature_text(c) -> Column:
    """Free text made safe for a pipe-joined feature name."""
    return F.translate(F.coalesce(_col(c).cast("string"), F.lit("")), "\t\n|", "  /")


def gene_entity_entrez(c) -> Column:
    """Canonical integer of ``Gene::<digits>``, NULL for other entity names."""
    digits = F.regexp_extract(_col(c), r"^Gene::([0-9]+)$", 1)
    return F.when(digits != "", digits).try_cast("bigint")


def canonical_digits(c) -> Column:
    """``'007'`` -> ``'7'``; anything that is not all digits -> ``''``."""
    s = strip(c)
    return F.when(s.rlike(r"^\d+$"), F.coalesce(s.try_cast("bigint").cast("string"), s)).otherwise(F.lit(""))
