"""Frame schemas and the fixed values every operator agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the data contract -----------------------------------------

SENTIMENTS = ["positif", "négatif", "neutre"]

TEXT_CANDIDATES = [
    "text", "review", "review_body", "review_text",
    "content", "comment", "verbatim", "avis",
]
ID_CANDIDATES = ["id", "review_id", "verbatim_id", "index"]
SOURCE_CANDIDATES = ["source", "origin", "platform", "channel", "provenance"]
LANG_CANDIDATES = ["lang", "language", "langue"]
# Exact-case text lookup used for uploads and for the raw metadata scan.
UPLOAD_TEXT_CANDIDATES = [
    "text", "review", "review_body", "review_text",
    "comment", "verbatim", "content",
]

# Cells a CSV reader of the pandas family takes for "no value".
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# The code points Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

DEFAULT_SOURCE = "unknown"
DEFAULT_LANG = "fr"
BATCH_SIZE = 10
MAX_RETRIES = 2
MAX_CATEGORIES = 5
SUMMARY_MAX = 150
SUMMARY_MIN = 5
THEME_MAX_WORDS = 5
FALLBACK_CATEGORY = "Autre"
UNKNOWN_SOURCE = "inconnue"
TEXT_NOT_FOUND = "(Texte original introuvable)"
EMPTY_SYNTHESIS = "Aucun avis disponible pour cette catégorie."

# Texts of issues and errors; {} marks where values go.
DUPLICATE_ID = "ID dupliqué: {}"
UNKNOWN_ID = "ID inconnu: {} (attendus: {})"
EMPTY_THEME = "Thème vide"
LONG_THEME = "Thème trop long ({} mots): '{}'"
SHORT_SUMMARY = "Résumé trop court: '{}'"
COUNT_MISMATCH = "Le LLM a retourné {} analyses au lieu de {}"
MISSING_VERBATIMS = "{} verbatim(s) sauté(s) par le LLM"
ATTEMPTS_FAILED = "Échec après {} tentatives: {}"
NO_API_ANSWER = "Pas de réponse de l'API"
INVALID_JSON = "JSON invalide: {}"
INVALID_SCHEMA = "Validation du schéma: réponse non conforme ({})"
RAW_EXCERPT = 200

# Lines of the text report, padded by the caller.
REPORT_TOTAL = "Total verbatims analysés : {}"
REPORT_OVERALL = "  {} : {}% ({})  {}"
REPORT_CATEGORY = "{} | Total: {} ({}%)"
REPORT_SHARE = "    - {} : {}% ({}) {}"

# --- frames --------------------------------------------------------------------

VERBATIM = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("lang", T.StringType()),
])

ANALYSIS = T.StructType([
    T.StructField("verbatim_id", T.StringType()),
    T.StructField("theme", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("texte_original", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("macro_theme", T.StringType()),
])
ANALYSIS_FIELDS = ANALYSIS.fieldNames()
REQUIRED_FIELDS = ["verbatim_id", "theme", "summary", "sentiment"]
OPTIONAL_FIELDS = ["texte_original", "source", "macro_theme"]

ERROR = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("batch_idx", T.LongType()),
    T.StructField("verbatim_id", T.StringType()),
    T.StructField("expected", T.IntegerType()),
    T.StructField("got", T.IntegerType()),
    T.StructField("issues", T.ArrayType(T.StringType())),
    T.StructField("data", ANALYSIS),
    T.StructField("missing_ids", T.ArrayType(T.StringType())),
    T.StructField("verbatim_ids", T.ArrayType(T.StringType())),
    T.StructField("detail", T.StringType()),
    T.StructField("error", T.StringType()),
])

SYNTHESIS = T.StructType([
    T.StructField("macro_theme", T.StringType()),
    T.StructField("positive_points", T.ArrayType(T.StringType())),
    T.StructField("negative_points", T.ArrayType(T.StringType())),
    T.StructField("global_synthesis", T.StringType()),
])

# Themes and categories are keys, so they are read as maps: as fields of an
# inferred struct, two that differ only by case would collide.
REPORT = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("source_file", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("total_verbatims", T.LongType()),
    ])),
    T.StructField("global_sentiment", T.MapType(T.StringType(), T.LongType())),
    T.StructField("theme_distribution", T.MapType(T.StringType(), T.StructType(
        [T.StructField(name, T.LongType()) for name in ["total", *SENTIMENTS]]
    ))),
    T.StructField("syntheses", T.MapType(T.StringType(), SYNTHESIS)),
])
